"""WARC records and their fixity: Merkle trees over ordered offset ranges.

A leaf is the SHA-256 of a record's bytes with its length. The records of an archive, in
the order of the file, are cut into ranges at records whose id digests to a multiple of
``FAN``, of its square, and so on: borders that both replicas find by themselves, wherever a record
was lost or came in. A range's node digests its children in order with their offsets, counted from
the range's start, so damage changes only the nodes above it; the nodes of an archive are one
row. An audit compares the roots of two replicas and goes down only where digests differ, level
by level, to the records of the ranges that differ. These are aligned by id and digest:
what has no equal is changed, lost or added, and of the equal ones those outside a longest common
order are moved.
"""

from __future__ import annotations

import bisect
import gzip

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailspark.llm.common import python_workers, stored

FAN = 16
#: Ids of an archive; a range with more records than twice that (repeated ids, null ids) is split by hash.
RECORDS = 2048
#: Levels of ranges between the records and an archive's root.
LEVELS = 2


def record(record_id: Column, url: Column, body: Column) -> Column:
    """The text of a response record; null parts are empty."""
    body = F.coalesce(body, F.lit(""))
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(record_id.cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head, body, F.lit("\r\n\r\n"))


def _rows(pages: DataFrame, id_col: str, url_col: str, body_col: str, order_col: str | None, size: int) -> DataFrame:
    """(range, id, at, length, digest, copies) of the distinct records; ``at`` is their place in the order of the file."""
    text = record(F.col(id_col), F.col(url_col), F.col(body_col))
    at = F.col(order_col) if order_col else F.col(id_col)
    rows = pages.select(F.col(id_col).alias("id"), at.cast("double").alias("at"), F.octet_length(text).cast("long").alias("length"), F.sha2(text.cast("binary"), 256).alias("digest"))
    rows = rows.withColumn("range", F.coalesce(F.floor(F.col("id") / F.lit(size)).cast("string"), F.lit("null")))
    return rows.groupBy("range", "id", "at", "length", "digest").agg(F.count("*").alias("copies"))


def parts_of(size: int, *replicas: DataFrame) -> DataFrame:
    """Into how many archives each range is split: the same in all replicas, by the one with most records."""
    counts = [r.groupBy("range").agg(F.count("*").alias("n")) for r in replicas]
    every = counts[0]
    for c in counts[1:]:
        every = every.unionByName(c)
    return every.groupBy("range").agg(F.ceil(F.max("n") / F.lit(2 * size)).cast("int").alias("parts"))


def _laid_out(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """Leaves (archive, place, id, offset, length, digest, copies) and the keys of the ranges above each, ``r1`` to ``rLEVELS``.

    The records of a range (of ids, or null ones) are few but for repeated ids; copies of a
    record are one leaf. One exchange and one sort by archive.
    """
    rows = rows.join(parts, "range").withColumn("archive", F.concat_ws("-", "range", F.pmod(F.xxhash64("digest"), F.col("parts")).cast("string")))
    by = Window.partitionBy("archive").orderBy("at", "id", "digest")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"place": F.coalesce(F.sum("copies").over(before), F.lit(0)), "offset": F.coalesce(F.sum(F.col("copies") * F.col("length")).over(before), F.lit(0))})
    anchor = F.xxhash64(F.coalesce(F.col("id").cast("string"), F.col("digest")))
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    for n in range(1, LEVELS + 1):
        rows = rows.withColumn(f"r{n}", F.coalesce(F.last(F.when(F.pmod(anchor, F.lit(FAN**n)) == 0, F.coalesce(F.col("id").cast("string"), F.col("digest"))), ignorenulls=True).over(upto), F.lit("^")))
    return rows.select("archive", "place", "id", "offset", "length", "digest", "copies", *[f"r{n}" for n in range(1, LEVELS + 1)])


def leaves(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", order_col: str | None = None, size: int = RECORDS) -> DataFrame:
    """The leaves of the archives that hold ``pages`` in the order of ``order_col`` (the id by default), then id and digest.

    Archives are ranges of ``size`` ids; null ids form a range of their own.
    """
    rows = _rows(pages, id_col, url_col, body_col, order_col, size)
    return _laid_out(rows, parts_of(size, rows))


def tree(leaf_rows: DataFrame) -> DataFrame:
    """One row per archive: ``root`` and ``ranges``, structs (r2, digest, inner) whose ``inner`` are structs (r1, digest), in order.

    A range is a few records times ``FAN``, an archive at most ``2 * RECORDS`` distinct
    records or so, so no list is longer; the groupings share the exchange by archive.
    """
    child = F.struct("place", "offset", "length", "copies", "digest")
    level = leaf_rows.groupBy("archive", "r2", "r1").agg(F.array_sort(F.collect_list(child)).alias("c"))
    first = F.col("c")[0]["offset"]
    told = F.array_join(F.transform("c", lambda x: F.concat_ws(":", (x["offset"] - first).cast("string"), x["length"].cast("string"), x["copies"].cast("string"), x["digest"])), ",")
    size = F.aggregate("c", F.lit(0).cast("long"), lambda s, x: s + x["length"] * x["copies"])
    level = level.select("archive", "r2", "r1", first.alias("offset"), size.alias("length"), F.sha2(told, 256).alias("digest"))
    node = F.struct("offset", "length", "r1", "digest")
    above = level.groupBy("archive", "r2").agg(F.array_sort(F.collect_list(node)).alias("c"))
    told = F.array_join(F.transform("c", lambda x: F.concat_ws(":", (x["offset"] - first).cast("string"), x["length"].cast("string"), x["r1"], x["digest"])), ",")
    above = above.select("archive", first.alias("offset"), "r2", F.sha2(told, 256).alias("digest"), F.transform("c", lambda x: F.struct(x["r1"].alias("r1"), x["digest"].alias("digest"))).alias("inner"))
    top = above.groupBy("archive").agg(F.array_sort(F.collect_list(F.struct("offset", "r2", "digest", "inner"))).alias("c"))
    told = F.array_join(F.transform("c", lambda x: F.concat_ws(":", x["offset"].cast("string"), x["r2"], x["digest"])), ",")
    return top.select("archive", F.sha2(told, 256).alias("root"), F.transform("c", lambda x: F.struct(x["r2"].alias("r2"), x["digest"].alias("digest"), x["inner"].alias("inner"))).alias("ranges"))


def suspects(a: DataFrame, b: DataFrame) -> DataFrame:
    """The lowest ranges (archive, r2, r1) at which two trees differ, found from the roots down; nothing under equal digests is read."""
    roots = a.select("archive", F.col("root").alias("root_a")).join(b.select("archive", F.col("root").alias("root_b")), "archive", "full")
    down = roots.where(~F.col("root_a").eqNullSafe(F.col("root_b"))).select("archive")

    def differing(x: DataFrame, y: DataFrame, keys: list[str]) -> DataFrame:
        # a border that stands twice in an archive (a repeated id) is compared by all its ranges
        x, y = (t.groupBy(*keys).agg(F.sort_array(F.collect_list("digest")).alias(n)) for t, n in ((x, "da"), (y, "db")))
        return x.join(y, keys, "full").where(~F.col("da").eqNullSafe(F.col("db"))).select(*keys)

    upper = [t.join(down, "archive", "left_semi").select("archive", F.explode("ranges").alias("n")).select("archive", "n.r2", "n.digest", "n.inner") for t in (a, b)]
    second = differing(*[u.drop("inner") for u in upper], ["archive", "r2"])
    lower = [u.join(second, ["archive", "r2"], "left_semi").select("archive", "r2", F.explode("inner").alias("n")).select("archive", "r2", "n.r1", "n.digest") for u in upper]
    return differing(*lower, ["archive", "r2", "r1"])


def _outside_order(places: list[int]) -> set[int]:
    """Indices outside one longest increasing subsequence of distinct numbers."""
    tops, last, back = [], [], [-1] * len(places)
    for i, p in enumerate(places):
        at = bisect.bisect_left(tops, p)
        back[i] = last[at - 1] if at else -1
        tops[at : at + 1], last[at : at + 1] = [p], [i]
    i, kept = last[-1] if last else -1, set()
    while i >= 0:
        kept.add(i)
        i = back[i]
    return set(range(len(places))) - kept


def audit(a: DataFrame, b: DataFrame) -> DataFrame:
    """The records in which two replicas, given by their leaves, differ: archive, id, ``status``, ``copies`` and offset, length and digest in either.

    ``status`` is changed (one of its id differs in its bytes), lost (only in a), added
    (only in b) or moved (equal bytes out of the common order of its archive). A record that
    merely follows a lost or longer one is none of these. Several records of one id are
    paired in the order of their digests; a null id names no record, so such records are lost or
    added but never changed. ``copies`` says how many equal records the row stands for. Equal
    replicas, and empty ones, give no rows.
    """
    spark = a.sparkSession
    python_workers(spark)
    where = stored(suspects(stored(tree(a)), stored(tree(b))))
    keys = ["archive", "r2", "r1"]
    x, y = (t.join(where, keys, "left_semi").select("archive", "id", "digest", *[F.col(c).alias(f"{c}_{s}") for c in ("place", "offset", "length", "copies")]) for t, s in ((a, "a"), (b, "b")))
    same = F.col("xa") == F.col("archive")
    x = x.withColumnsRenamed({"archive": "xa", "id": "xi", "digest": "xd"})
    met = x.join(y, same & F.col("xi").eqNullSafe(F.col("id")) & (F.col("xd") == F.col("digest")), "full")
    met = stored(met.select(F.coalesce("xa", "archive").alias("archive"), F.coalesce("xi", "id").alias("id"), F.coalesce("xd", "digest").alias("digest"), *[f"{c}_{s}" for s in "ab" for c in ("place", "offset", "length", "copies")]))
    both = met.where("place_a is not null and place_b is not null")

    def out_of_order(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["place_a"], kind="stable")
        return frame.iloc[sorted(_outside_order(frame["place_b"].tolist()))]

    columns = ["archive", "id", "status", "copies", "offset_a", "length_a", "digest_a", "offset_b", "length_b", "digest_b"]
    digests = [F.when(F.col(f"place_{s}").isNotNull(), F.col("digest")).alias(f"digest_{s}") for s in "ab"]
    moved = both.groupBy("archive").applyInPandas(out_of_order, both.schema).select("archive", "id", F.lit("moved").alias("status"), F.least("copies_a", "copies_b").alias("copies"), "offset_a", "length_a", "offset_b", "length_b", *digests)
    # copies of one record beyond those of the other side
    fewer = F.coalesce("copies_b", F.lit(0)) < F.coalesce("copies_a", F.lit(0))
    more = F.coalesce("copies_b", F.lit(0)) > F.coalesce("copies_a", F.lit(0))
    gone = met.where(fewer).select("archive", "id", (F.col("copies_a") - F.coalesce("copies_b", F.lit(0))).alias("copies"), F.col("digest").alias("digest_a"), "offset_a", "length_a")
    come = met.where(more).select("archive", "id", (F.col("copies_b") - F.coalesce("copies_a", F.lit(0))).alias("copies"), F.col("digest").alias("digest_b"), "offset_b", "length_b")
    rank = lambda t, s: t.withColumn("n", F.row_number().over(Window.partitionBy("archive", "id").orderBy(f"digest_{s}")))
    named = rank(gone.where("id is not null"), "a").withColumnRenamed("copies", "ca").join(rank(come.where("id is not null"), "b").withColumnRenamed("copies", "cb"), ["archive", "id", "n"], "full")
    status = F.when(F.col("digest_b").isNull(), "lost").when(F.col("digest_a").isNull(), "added").otherwise("changed")
    pairs = named.withColumn("status", status).withColumn("copies", F.when(F.col("status") == "changed", F.least("ca", "cb")).otherwise(F.coalesce("ca", "cb")))
    none = lambda s: [F.lit(None).cast(t).alias(f"{c}_{s}") for c, t in (("offset", "long"), ("length", "long"), ("digest", "string"))]
    # the copies that one side of a changed pair has beyond the other
    over = named.where("ca > cb").select("archive", "id", F.lit("lost").alias("status"), (F.col("ca") - F.col("cb")).alias("copies"), "offset_a", "length_a", "digest_a", *none("b"))
    under = named.where("cb > ca").select("archive", "id", F.lit("added").alias("status"), (F.col("cb") - F.col("ca")).alias("copies"), *none("a"), "offset_b", "length_b", "digest_b")
    lost = gone.where("id is null").select("archive", "id", F.lit("lost").alias("status"), "copies", "offset_a", "length_a", "digest_a", *none("b"))
    added = come.where("id is null").select("archive", "id", F.lit("added").alias("status"), "copies", *none("a"), "offset_b", "length_b", "digest_b")
    out = moved.select(*columns)
    for part in (pairs, over, under, lost, added):
        out = out.unionByName(part.select(*columns))
    return out


def damaged(pages: DataFrame, id_col: str = "page_id", body_col: str = "html", every: int = 97) -> DataFrame:
    """A replica with planted damage, and ``file_order``, its records' order.

    The body of every page whose id is divisible by ``every`` begins with another character.
    Of every four times as many, counted from 5, 7 and 11, one page is lost, one comes a
    second time with a longer body, and one stands 40 places later (in the first half of
    its archive, with two pages at least behind it).
    """
    spread = every * 4 + 1
    rest = F.pmod(F.col(id_col), F.lit(spread))
    broken = F.concat(F.when(F.substring(body_col, 1, 1) == "~", "#").otherwise("~"), F.expr(f"substring({body_col}, 2)"))
    last = pages.agg(F.max(id_col)).first()[0] or 0
    late = (rest == 11) & (F.pmod(F.col(id_col), F.lit(RECORDS)) < RECORDS // 2) & (F.col(id_col) + 40 <= last)
    order = F.when(late, F.col(id_col) + 40.5).otherwise(F.col(id_col).cast("double"))
    changed = F.when((F.pmod(F.col(id_col), F.lit(every)) == 0) & (F.length(body_col) > 0), broken).otherwise(F.col(body_col))
    kept = pages.where(F.coalesce(rest != 5, F.lit(True))).withColumn("file_order", order).withColumn(body_col, changed)
    twice = pages.where(rest == 7).withColumn("file_order", F.col(id_col).cast("double")).withColumn(body_col, F.concat(F.coalesce(body_col, F.lit("")), F.lit("<!-- again -->")))
    return kept.unionByName(twice)


def parse(content: bytes) -> list[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, payload) of each record of a WARC file's bytes, gzip members or plain; offsets are of the plain bytes."""
    if content[:2] == b"\x1f\x8b":
        content = gzip.decompress(content)
    out, at = [], 0
    while at < len(content):
        end = content.find(b"\r\n\r\n", at)
        if end < 0 or not content.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at offset {at}")
        lines = content[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k.strip(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        size = int(headers["Content-Length"])
        stop = end + 4 + size + 4
        if stop > len(content) or content[stop - 4 : stop] != b"\r\n\r\n":
            raise ValueError(f"the record at offset {at} is cut off")
        out.append((at, stop - at, headers, content[end + 4 : stop - 4]))
        at = stop
    return out


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records (path, offset, length, id, url, payload) of the WARC files under ``path``; a file that can't be parsed fails its task."""
    python_workers(spark)

    def run(frames):
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                found = parse(content)
                yield pd.DataFrame({"path": name, "offset": [o for o, _, _, _ in found], "length": [n for _, n, _, _ in found], "id": [h.get("WARC-Record-ID") for _, _, h, _ in found], "url": [h.get("WARC-Target-URI") for _, _, h, _ in found], "payload": [p for _, _, _, p in found]})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, offset long, length long, id string, url string, payload binary")


def audit_pages(a: DataFrame, b: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", order_col: str | None = None, size: int = RECORDS) -> DataFrame:
    """The audit of two replicas of a page table; b's records stand in the order of ``order_col``, a's in that of their ids."""
    x, y = (stored(_rows(t, id_col, url_col, body_col, o, size)) for t, o in ((a, None), (b, order_col)))
    parts = stored(parts_of(size, x, y))
    return audit(stored(_laid_out(x, parts)), stored(_laid_out(y, parts)))
