"""Embedding near-dedup by int8 tile products with rigorous error bounds.

Vectors of one label and one length are dealt into blocks of a bounded number of components;
each pair of blocks is a tile, and a vector is sent to as many tiles as its label has blocks. In a tile every unit vector u is quantised to s*q with int8 q and the
exact error e = |u - s*q|. For two vectors, |u.v - s_u*s_v*(q_u.q_v)| <= e_u + e_v + e_u*e_v,
so only pairs whose product plus this bound reaches the threshold are recomputed, in double
precision. Tiles return link counts and a spanning forest, never the pairs, so a dense
group costs no more output than a sparse one. Equal vectors are one class beforehand.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailspark.llm.common import connected_components, python_workers, stored

THRESHOLD = 0.98
BLOCK = 2048
#: Up to so many blocks of ``BLOCK`` vectors a label is dealt out finely, for the sake of parallel tasks; beyond, blocks hold ``CELLS`` components.
SPREAD = 4
CELLS = 1 << 20
_SUB = 1024
_SLACK = 1e-5  # float32 rounding of the scaled products


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales and exact Euclidean errors of unit vectors."""
    scale = np.abs(unit).max(axis=1) / 127.0
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    error = np.sqrt(((unit - codes * scale[:, None]) ** 2).sum(axis=1))
    return codes, scale, error


def _merge(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Component roots after joining i and j pairwise."""
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return root
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (up := root[root]).tolist() != root.tolist():
            root = up


def tile_links(x: np.ndarray, weight: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Of the rows ``left`` against ``right`` of x: per row the summed weight of linked rows, component roots, pairs recomputed.

    Where left and right are the same rows, each pair counts once for either side.
    """
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1)[:, None]
    norm = np.sqrt((x * x).sum(axis=1))
    codes, scale, error = quantise(x / norm[:, None])
    exact = np.float32 if x.shape[1] * 127 * 127 < 1 << 24 else np.float64
    links, root, checked = np.zeros(len(x), np.int64), np.arange(len(x)), 0
    same = left is right
    for a in range(0, len(left), _SUB):
        la = left[a : a + _SUB]
        qa, sa, ea = codes[la].astype(exact), scale[la].astype(exact), error[la].astype(exact)
        for b in range(a if same else 0, len(right), _SUB):
            rb = right[b : b + _SUB]
            product = qa @ codes[rb].astype(exact).T
            product *= sa[:, None]
            product *= scale[rb].astype(exact)
            eb = error[rb].astype(exact)
            bound = np.multiply.outer(1 + ea, 1 + eb) - 1
            i, j = np.nonzero(product + bound >= threshold - _SLACK)
            if same and a == b:
                i, j = i[i < j], j[i < j]
            checked += len(i)
            for lo in range(0, len(i), 1 << 16):
                p, q = la[i[lo : lo + (1 << 16)]], rb[j[lo : lo + (1 << 16)]]
                hit = np.einsum("ij,ij->i", x[p], x[q]) / (norm[p] * norm[q]) >= threshold
                p, q = p[hit], q[hit]
                np.add.at(links, p, weight[q])
                np.add.at(links, q, weight[p])
                root = _merge(root, p, q)
    return links, root, checked


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """One row per vector: id, ``n_links``, ``component_id`` (least id reachable, itself included) and ``kept``.

    Rows link only under one non-null label and one length. Null or empty vectors, zero
    vectors and vectors with a null or non-finite component have no links and are their own
    component. Repeated rows link as equal vectors do. A null id is no component id unless
    all ids of its component are null; then ``kept`` is true. Further columns are ignored.
    """
    python_workers(vectors.sparkSession)
    base = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vec_col).alias("embedding"))
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    zero = ~F.exists("embedding", lambda v: v != 0)
    usable = F.coalesce(F.col("label").isNotNull() & (F.size("embedding") > 0) & ~bad & ~zero, F.lit(False))
    alone = base.where(~usable).select(F.col("vec_id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    good = base.where(usable)
    classes = good.groupBy("label", "embedding").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("n"))
    classes = stored(classes.withColumn("cid", F.monotonically_increasing_id()).withColumn("dim", F.size("embedding")))
    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("__n"))
    fine, whole = F.ceil(F.col("__n") / F.lit(block)), F.ceil(F.col("__n") / F.greatest(F.lit(block), F.lit(CELLS) / F.col("dim")))
    blocks = sizes.select("label", "dim", F.greatest(F.least(fine, F.lit(SPREAD)), whole).cast("int").alias("blocks"))
    sized = classes.join(blocks, ["label", "dim"]).withColumn("blk", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    tiles = sized.select("label", "dim", "cid", "n", "embedding", "blk", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    tiles = tiles.select("label", "dim", F.least("blk", "other").alias("ti"), F.greatest("blk", "other").alias("tj"), "blk", "cid", "n", "embedding")

    def run(table: pa.Table) -> pa.Table:
        names = ("cid", "n", "blk")
        cid, n, blk = (table.column(c).to_numpy() for c in names)
        dim = table.column("dim")[0].as_py()
        x = table.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(cid), dim)
        ti, tj = table.column("ti")[0].as_py(), table.column("tj")[0].as_py()
        left = np.flatnonzero(blk == ti)
        right = left if ti == tj else np.flatnonzero(blk == tj)
        links, root, _ = tile_links(x, n, left, right, threshold)
        hit = np.flatnonzero(links)
        return pa.table({"cid": cid[hit], "root": cid[root[hit]], "links": links[hit]})

    found = stored(tiles.groupBy("label", "dim", "ti", "tj").applyInArrow(run, "cid long, root long, links long"))
    counts = found.groupBy("cid").agg(F.sum("links").alias("links"))
    roots = connected_components(found.select(F.col("cid").alias("u"), F.col("root").alias("v")))
    linked = classes.select("cid", "label", "embedding", "least_id", "n").join(counts, "cid", "left").join(roots.withColumnRenamed("node", "cid"), "cid", "left")
    linked = linked.select("label", "embedding", "least_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "cid").alias("root"))
    least = linked.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = linked.join(least, "root").select("label", "embedding", "n_links", "component_id")
    members = good.join(named, ["label", "embedding"])
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("vec_id").eqNullSafe(F.col("component_id")))
    return members.select(F.col("vec_id").alias(id_col), "n_links", "component_id", kept.alias("kept")).unionByName(alone)
