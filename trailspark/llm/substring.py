"""Substring dedup: windows of words that occur earlier in the corpus are marked.

This stands in for a greedy relative Lempel-Ziv parse. Factoring each document against every
reference block takes a pass over all blocks for each block of documents, quadratic in the
corpus, and references for all marked windows (document and place) would have to travel back to
them; both are beyond the limits of disk and time. The corpus is indexed by winnowed anchors: of the word
grams inside each window of ``window`` words the one with the least hash, so equal windows have
equal anchors wherever they stand. The index holds each anchor's hash; an anchor of only one
document can mark no window and drops out. The windows of the others are grouped by 96 bits of two hashes
of their words, and all but the first occurrence of each are marked. No factor is parsed: a run
of marked windows is one span, never shorter than a window, and may come from many earlier places.

Shuffled are the anchors (one in about 8 words), the windows of anchors that repeat, and
the texts once. Every grouping is a minimum or a count and is combined before its shuffle.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailspark.llm import textkernel as tk
from trailspark.llm.common import looked_up, python_workers, stored

WINDOW = 20
GRAM = 5
# Fixed value: the multiplier of the second hash of a window.
CHECK_BASE = 0xA0761D6478BD642F


class Parsed:
    """The windows of a chunk: ``start`` (in words of the chunk), ``row``, ``hash``, ``check`` (32 bits of a second hash) and ``anchor`` of each."""

    def __init__(self, raw: np.ndarray, rows: np.ndarray, window: int, gram: int):
        self.words = w = tk.Words(raw, rows)
        n = len(w.start)
        h = w.hashes()
        g = tk.grams(h, gram)
        at = np.arange(len(g), dtype=np.uint64)
        low = np.uint64(0xFFFFFFFF)
        least = tk.sliding_min((g & ~low) | (low - at), window - gram + 1)
        fits = tk.windows_within(w.first, n, window)[: len(least)]
        self.start = np.flatnonzero(fits)
        self.row = tk.row_of(w.first, n)[self.start]
        self.anchor = g[(low - (least[self.start] & low)).astype(np.int64)]
        self.hash = tk.grams(h, window, tk.WORD_BASES[1])[self.start]
        self.check = (tk.grams(h, window, CHECK_BASE)[self.start] >> np.uint64(32)).astype(np.uint32)
        self.bounds = np.searchsorted(self.row, np.arange(len(rows)))

    def first_here(self) -> np.ndarray:
        """Which windows have no equal one earlier in their own row."""
        order = np.lexsort((self.start, self.check, self.hash, self.row))
        new = np.ones(len(order), dtype=bool)
        new[1:] = False
        for v in (self.row, self.hash, self.check):
            new[1:] |= v[order][1:] != v[order][:-1]
        out = np.empty(len(order), dtype=bool)
        out[order] = new
        return out

    def listed(self, values: np.ndarray, lists: pa.Array) -> np.ndarray:
        """Which windows have their value in the list of their row."""
        out = np.zeros(len(values), dtype=bool)
        flat, ends = lists.values, lists.offsets.to_numpy()
        flat = flat.to_numpy(zero_copy_only=False).view(np.uint64)
        for r in np.flatnonzero(np.diff(self.bounds)).tolist():
            if ends[r + 1] > ends[r]:
                a, b = self.bounds[r], self.bounds[r + 1]
                out[a:b] = np.isin(values[a:b], flat[ends[r] : ends[r + 1]])
        return out


def _slice(batch: pa.RecordBatch, column: int, low: int, rows: np.ndarray) -> pa.Array:
    part = batch.column(column).slice(low, len(rows) - 1)
    return pa.concat_arrays([part.fill_null([]) if part.null_count else part])


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id``, ``k``, ``text``: longs in the order of the documents, equal only for rows of one id and one text.

    Integers that are all there and distinct are their own keys. Else the distinct pairs of
    id and digest of the text are sorted, null ids last, and numbered in that order.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if dict(source.dtypes)["doc_id"] in ("tinyint", "smallint", "int", "bigint"):
        n, distinct = source.agg(F.count("*"), F.count_distinct("doc_id")).first()
        if n == distinct:
            return source.select("doc_id", F.col("doc_id").cast("long").alias("k"), "text")
    digest = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    key = F.md5(F.concat(F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("null")), F.lit("|"), "digest").cast("binary"))
    source = source.withColumn("digest", digest).withColumn("key", key)
    ranks = source.select("doc_id", "digest", "key").distinct().orderBy(F.asc_nulls_last("doc_id"), "digest").select(F.col("key").alias("of"), F.monotonically_increasing_id().alias("k"))
    return looked_up(source, "key", stored(ranks), "of").select("doc_id", "k", "text")


def _anchors(docs: DataFrame, window: int, gram: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            k = batch.column(0).to_numpy()
            for low, raw, rows in tk.chunks(batch.column(1)):
                p = Parsed(raw, rows, window, gram)
                new = np.ones(len(p.row), dtype=bool)
                order = np.lexsort((p.anchor, p.row))
                new[1:] = (p.row[order][1:] != p.row[order][:-1]) | (p.anchor[order][1:] != p.anchor[order][:-1])
                pick = order[new]
                yield pa.RecordBatch.from_arrays([pa.array(k[low + p.row[pick]]), pa.array(p.anchor[pick].view(np.int64))], names=["k", "anchor"])

    return docs.select("k", "text").mapInArrow(run, "k long, anchor long")


def _parse(docs: DataFrame, id_col: str, text_col: str, window: int, gram: int, run, schema: str) -> DataFrame:
    python_workers(docs.sparkSession)
    keyed = _keyed(docs, id_col, text_col)
    anchors = _anchors(keyed, window, gram)
    repeated = anchors.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    # a set: rows of one key have equal texts, so no list grows with their number
    of_doc = stored(anchors.join(repeated, "anchor", "left_semi").groupBy("k").agg(F.collect_set("anchor").alias("anchors")))
    # both kernels below read the same columns of it, so that the texts are shuffled once
    with_anchors = keyed.join(of_doc, "k", "left").select("doc_id", "k", "text", "anchors")

    def windows(batches):
        for batch in batches:
            k = batch.column(1).to_numpy()
            for low, raw, rows in tk.chunks(batch.column(2)):
                p = Parsed(raw, rows, window, gram)
                pick = np.flatnonzero(p.listed(p.anchor, _slice(batch, 3, low, rows)) & p.first_here())
                yield pa.RecordBatch.from_arrays([pa.array(k[low + p.row[pick]]), pa.array(p.hash[pick].view(np.int64)), pa.array(p.check[pick].view(np.int32))], names=["k", "window", "check"])

    seen = with_anchors.mapInArrow(windows, "k long, window long, check int")
    first = seen.groupBy("window", "check").agg(F.min("k").alias("k")).groupBy("k").agg(F.collect_list("window").alias("firsts"))
    return with_anchors.join(first, "k", "left").select("doc_id", "k", "text", "anchors", "firsts").mapInArrow(run, schema)


def _covered(batch: pa.RecordBatch, window: int, gram: int):
    """For each chunk of the batch its parse and which words lie in a window that starts earlier elsewhere."""
    for low, raw, rows in tk.chunks(batch.column(2)):
        p = Parsed(raw, rows, window, gram)
        known = p.listed(p.anchor, _slice(batch, 3, low, rows))
        first = p.first_here()
        hits = p.start[~first | (known & ~p.listed(p.hash, _slice(batch, 4, low, rows)))]
        step = np.zeros(len(p.words.start) + 1, np.int64)
        np.add.at(step, hits, 1)
        np.add.at(step, hits + window, -1)
        yield low, rows, p, np.cumsum(step[:-1]) > 0


def duplicate_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per document: id, ``n_words``, ``n_removed``, ``spans`` (word ranges, end exclusive) and ``kept_text``.

    Null and empty texts have no words. Ids may be of any type that can be ordered; null ids
    come last. Rows of one id (or of a null one) with equal texts are one document: none of
    them is earlier than another; with different texts they come in the order of a digest of
    the text. Two windows count as equal by 96 bits of two hashes; where one hash alone meets,
    nothing is removed. Other columns aren't carried.
    """
    schema = f"doc_id {dict(docs.select(F.col(id_col).alias('doc_id')).dtypes)['doc_id']}, n_words long, n_removed long, spans array<struct<start:int,end:int>>, kept_text string"
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for batch in batches:
            for low, rows, p, gone in _covered(batch, window, gram):
                first = p.words.first
                text, where, _ = tk.respace(p.words, ~gone)
                whole, kept = text.tobytes(), np.concatenate([[0], np.cumsum(~gone)])
                texts, spans = [], []
                for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                    x, y = kept[a], kept[b]
                    texts.append(whole[where[x] : (where[y] if y < len(where) else len(whole)) - 1].decode() if y > x else "")
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone[a:b].astype(np.int8), [0]])))
                    spans.append([{"start": s, "end": e} for s, e in edge.reshape(-1, 2).tolist()])
                removed = np.concatenate([[0], np.cumsum(gone)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, len(rows) - 1), pa.array(p.words.counts), pa.array(removed[first[1:]] - removed[first[:-1]]), pa.array(spans, kind), pa.array(texts, pa.string())], names=["doc_id", "n_words", "n_removed", "spans", "kept_text"])

    return _parse(docs, id_col, text_col, window, gram, run, schema).withColumnRenamed("doc_id", id_col)


def kept_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """As :func:`duplicate_spans`, with ``kept_sha256`` in place of spans and text, so no text leaves the parse."""
    schema = f"doc_id {dict(docs.select(F.col(id_col).alias('doc_id')).dtypes)['doc_id']}, n_words long, n_removed long, kept_sha256 string"

    def run(batches):
        for batch in batches:
            for low, rows, p, gone in _covered(batch, window, gram):
                first = p.words.first
                text, where, _ = tk.respace(p.words, ~gone)
                kept = np.concatenate([[0], np.cumsum(~gone)])
                where = np.append(where, len(text))
                view, digests = memoryview(text), []
                for x, y in zip(kept[first[:-1]].tolist(), kept[first[1:]].tolist(), strict=True):
                    digests.append(hashlib.sha256(view[where[x] : where[y] - 1] if y > x else b"").hexdigest())
                removed = np.concatenate([[0], np.cumsum(gone)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, len(rows) - 1), pa.array(p.words.counts), pa.array(removed[first[1:]] - removed[first[:-1]]), pa.array(digests)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return _parse(docs, id_col, text_col, window, gram, run, schema).withColumnRenamed("doc_id", id_col)
