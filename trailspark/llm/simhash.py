"""SimHash near-dedup: a grid range join on segment bit counts, then exact verification.

A fingerprint is mapped to the bit counts of its segments. The Manhattan distance of
two count vectors never exceeds the Hamming distance of the fingerprints, so all links
at ``bits`` or fewer differing bits lie in cells at that Manhattan distance. Each
distinct fingerprint is sent to half of these cells (the other half is met from the
other side), joined there by equality, and verified by the bit count of the XOR.
Equal fingerprints are one class before the join; copies are never paired.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailspark.llm import textkernel
from trailspark.llm.common import connected_components, fresh, python_workers, stored

SHINGLE_WORDS = 3
SEED = 42
MAX_BITS = 2


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE_WORDS, keep: list[str] | None = None) -> DataFrame:
    """``keep`` (the id by default) and the 64-bit fingerprint ``fp`` (as a signed long) of every row.

    Null and empty texts, and texts of spaces only, have fingerprint 0. Columns other than
    ``keep`` aren't carried, so no clash of names is possible.
    """
    python_workers(docs.sparkSession)
    cols = keep or [id_col]
    source = docs.select(*cols, F.col(text_col).alias("__text"))
    schema = docs.select(*cols, F.lit(0).cast("long").alias("fp")).schema

    def run(batches):
        for batch in batches:
            fps = [textkernel.simhash64(raw, rows, width, SEED) for _, raw, rows in textkernel.chunks(batch.column(len(cols)))]
            out = np.concatenate(fps) if fps else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(cols)], pa.array(out.view(np.int64))], names=[*cols, "fp"])

    return source.mapInArrow(run, schema)


def segments_for(n: int) -> int:
    """How many segments keep the candidates of a cell few for n distinct fingerprints; the result is the same for any."""
    return 8 if n < 1 << 19 else 12 if n < 1 << 24 else 16


def _widths(segments: int) -> list[int]:
    return [64 * (i + 1) // segments - 64 * i // segments for i in range(segments)]


def _cell(fp, segments: int):
    """The segment bit counts, four bits each, as one long."""
    out, low = F.lit(0).cast("long"), 0
    for i, width in enumerate(_widths(segments)):
        count = F.bit_count(F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1).cast("long"))).cast("long")
        out, low = out + F.shiftleft(count, 4 * i), low + width
    return out


def offsets(segments: int, bits: int) -> list[int]:
    """Packed steps to all cells at Manhattan distance of ``bits`` or less, one of each two opposite ones, and 0."""
    found = {0}

    def grow(i: int, left: int, value: int) -> None:
        found.add(value)
        for s in range(i, segments):
            for step in range(1, left + 1):
                for sign in (1, -1):
                    grow(s + 1, left - step, value + sign * step * 16**s)

    grow(0, bits, 0)
    return sorted(x for x in found if x >= 0)


def fingerprint_links(fps: DataFrame, bits: int = MAX_BITS, segments: int | None = None) -> DataFrame:
    """``(u, v)``, u < v, for all pairs of distinct fingerprints ``fp`` at 1 to ``bits`` differing bits."""
    segments = segments or segments_for(fps.count())
    cells = fps.select("fp", _cell(F.col("fp"), segments).alias("cell"))
    steps = F.array(*[F.lit(x).cast("long") for x in offsets(segments, bits)])
    sent = cells.select(F.col("fp").alias("a"), "cell", F.explode(steps).alias("step")).select("a", "step", (F.col("cell") + F.col("step")).alias("to"))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("fp"))) <= bits
    met = sent.join(cells, (F.col("to") == F.col("cell")) & close & ((F.col("step") != 0) | (F.col("a") < F.col("fp"))))
    return met.select(F.least("a", "fp").alias("u"), F.greatest("a", "fp").alias("v"))


def components(marked: DataFrame, id_col: str, bits: int = MAX_BITS) -> DataFrame:
    """``marked``, rows with ``fp``, with ``root``, which names the component, and ``component_id``, the least id in it."""
    classes = stored(marked.groupBy("fp").agg(F.min(id_col).alias("least_id")))
    roots = connected_components(fingerprint_links(classes, bits))
    linked = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    least = linked.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = linked.join(least, "root").select(F.col("fp").alias("__fp"), "root", "component_id")
    return marked.join(named, F.col("fp") == F.col("__fp"), "left").drop("__fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = MAX_BITS) -> DataFrame:
    """One row per document: its id, ``fp`` and ``component_id``, the least id reachable by links of ``bits`` or fewer bits.

    Ties and repeated rows: rows of one fingerprint share a component. Null ids are ignored
    as component ids unless a component has no other (then its id is null). An empty table
    gives no rows.
    """
    source = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    marked = stored(fingerprints(source, "__id", "__text"))
    return components(marked, "__id", bits).select(F.col("__id").alias(id_col), "fp", "component_id")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs``, all columns, of one document of each component: the one with the least id, of several such rows one.

    Rows of the least id with different texts are told apart by a digest of id and text.
    Equal rows are combined before the one shuffle of the texts, which serves the join too.
    """
    names = docs.columns
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
    digest = F.md5(F.concat(part(id_col), F.lit("|"), part(text_col)).cast("binary"))
    source = docs.select(F.col(id_col).alias("__id"), digest.alias("__digest"), F.col(text_col).alias("__text"))
    marked = stored(fingerprints(source, "__id", "__text", keep=["__id", "__digest"]))
    kept = components(marked, "__id", bits).where(F.col("__id").eqNullSafe(F.col("component_id")))
    own, of = fresh("__digest", docs), fresh("__of", docs)
    first = kept.groupBy("root").agg(F.min("__digest").alias(of)).select(of)
    rows = docs.withColumn(own, digest).dropDuplicates([own])
    return rows.join(first, F.col(own) == F.col(of), "left_semi").select(*names)
