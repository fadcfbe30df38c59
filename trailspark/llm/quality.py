"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics come from one vectorised pass over the bytes of the texts. Trees are grown
on binned statistics of a bounded sample of labelled documents (``MAX_TRAIN``, by hash of
the id) and flattened into arrays; scoring walks all rows of a batch down all trees level
by level, with numpy indexing only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailspark.llm import textkernel as tk
from trailspark.llm.common import python_workers

#: Labelled documents that the trees are fitted on, at most; those with the least hash of the id.
MAX_TRAIN = 20_000
THRESHOLD = 0.3
FOLDS = 5
TREES, DEPTH, BINS, RATE, LEAST, PENALTY = 80, 4, 32, 0.15, 15, 1.0

_CLASS = np.zeros(256, np.uint8)  # 1 lower, 2 upper, 3 digit, 4 space, 5 other ASCII, 6 beyond ASCII
_CLASS[0x21:0x80] = 5
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 4
_CLASS[0x80:] = 6
_MARKS = b"#$%&*!|<>{}=/\\_@.,;:?-"

NAMES = ["log_words", "log_bytes", "word_length", "word_spread", "lower", "upper", "digit", "punct", "beyond", "lines_per_word", "line_length", "distinct_words", "top_word", "distinct_lines", "repeated_grams", "end_other", "short_words", "long_words", *[f"mark_{chr(c)}" for c in _MARKS]]


def statistics(raw: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """One row of ``NAMES`` for each text; a text without words has zeros."""
    words = tk.Words(raw, rows)
    n = words.counts.astype(np.float64)
    size = np.diff(rows).astype(np.float64)
    per_word, per_byte = np.maximum(n, 1), np.maximum(size, 1)

    def over(values: np.ndarray, first: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
        return sums[first[1:]] - sums[first[:-1]]

    kinds = _CLASS[raw]
    share = [over(kinds == k, rows) / per_byte for k in (1, 2, 3, 5, 6)]
    newline = raw == 0x0A
    lines = over(newline, rows) + 1
    length = (words.end - words.start).astype(np.float64)
    mean = over(length, words.first) / per_word
    spread = np.sqrt(np.maximum(over(length * length, words.first) / per_word - mean * mean, 0))
    h = words.hashes()
    row = tk.row_of(words.first, len(h))
    distinct, top = _distinct(h, row, len(n))
    grams = tk.grams(h, 3)
    inside = tk.windows_within(words.first, len(h), 3)[: len(grams)]
    n_grams = np.bincount(row[: len(grams)][inside], minlength=len(n)).astype(np.float64)
    distinct_grams, _ = _distinct(grams[inside], row[: len(grams)][inside], len(n))
    begin = np.zeros(len(raw) + 1, dtype=bool)
    begin[1:] = newline
    begin[rows[:-1][size > 0]] = True
    at = np.flatnonzero(begin[:-1])
    up, down = tk._power_table(len(raw) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)])])
        stop = np.append(at[1:], len(raw))
        line_hash = tk.mix((sums[stop] - sums[at]) * down[at])
    line_row = np.searchsorted(rows, at, side="right") - 1
    distinct_lines, _ = _distinct(line_hash, line_row, len(n))
    ends = np.isin(kinds[words.end - 1], (5,)) if len(h) else np.zeros(0, bool)
    counts = np.zeros((len(n), len(_MARKS)))
    marked = np.flatnonzero(kinds == 5)
    mark_row = np.searchsorted(rows, marked, side="right") - 1
    lookup = np.full(256, -1)
    lookup[list(_MARKS)] = np.arange(len(_MARKS))
    which = lookup[raw[marked]]
    np.add.at(counts, (mark_row[which >= 0], which[which >= 0]), 1)
    out = np.column_stack([np.log1p(n), np.log1p(size), mean, spread, *share, lines / per_word, size / lines, distinct / per_word, top / per_word, distinct_lines / lines, 1 - distinct_grams / np.maximum(n_grams, 1), over(ends, words.first) / per_word, over(length <= 2, words.first) / per_word, over(length >= 13, words.first) / per_word, counts / per_word[:, None]])
    out[n == 0] = 0
    return out.astype(np.float32)


def _distinct(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row, how many distinct values it has and how often its commonest occurs."""
    if not len(h):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((h, row))
    hs, rs = h[order], row[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (hs[1:] != hs[:-1]) | (rs[1:] != rs[:-1])
    at = np.flatnonzero(new)
    run = np.diff(np.append(at, len(h)))
    top = np.zeros(n)
    np.maximum.at(top, rs[at], run)
    return np.bincount(rs[at], minlength=n).astype(np.float64), top


def with_statistics(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` and ``stats``, an array of floats in the order of ``NAMES``; null texts count as empty."""
    python_workers(docs.sparkSession)
    source = docs.select(*keep, F.col(text_col).alias("__text"))
    schema = docs.select(*keep, F.array().cast("array<float>").alias("stats")).schema

    def run(batches):
        for batch in batches:
            found = [statistics(raw, rows) for _, raw, rows in tk.chunks(batch.column(len(keep)))]
            table = np.concatenate(found) if found else np.zeros((0, len(NAMES)), np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(table) + 1) * len(NAMES), pa.int32()), pa.array(table.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], lists], names=[*keep, "stats"])

    return source.mapInArrow(run, schema)


class Trees:
    """Boosted trees in flat arrays: node i of tree t tests ``feature[t, i] > cut[t, i]``; its children are 2i + 1 and 2i + 2."""

    def __init__(self, base: float, feature: np.ndarray, cut: np.ndarray, value: np.ndarray):
        self.base, self.feature, self.cut, self.value = base, feature, cut, value

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        everyone = np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[everyone, feature[node]] > cut[node])
            out += value[node]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Trees:
    """Trees for the labels 0 and 1; with one label only, or none, every score is the (smoothed) share of 1."""
    inner, leaves = 2**DEPTH - 1, 2 ** (DEPTH + 1) - 1
    share = (y.sum() + 1.0) / (len(y) + 2.0)
    base = float(np.log(share / (1 - share)))
    feature, cut, value = (np.zeros((trees, leaves), t) for t in (np.int64, np.float64, np.float64))
    cut[:] = np.inf
    if len(y) == 0 or y.min() == y.max():
        return Trees(base, feature[:0], cut[:0], value[:0])
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.column_stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)])
    n_features = x.shape[1]
    offset = np.arange(n_features) * BINS
    margin = np.full(len(y), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for i in range(inner):
            who = np.flatnonzero(node == i)
            if len(who) < 2 * LEAST:
                node[who] = 2 * i + 1
                continue
            flat = (binned[who] + offset).ravel()
            g, h, c = (np.bincount(flat, np.repeat(v, n_features), n_features * BINS).reshape(n_features, BINS).cumsum(axis=1) for v in (grad[who], hess[who], np.ones(len(who))))
            gain = g**2 / (h + PENALTY) + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + PENALTY)
            gain[(c < LEAST) | (c[:, -1:] - c < LEAST)] = -np.inf
            f, b = np.unravel_index(np.argmax(gain), gain.shape)
            total = g[0, -1] ** 2 / (h[0, -1] + PENALTY)
            if gain[f, b] <= total + 1e-6 or b >= len(cuts[f]):
                node[who] = 2 * i + 1
                continue
            feature[t, i], cut[t, i] = f, cuts[f][b]
            node[who] = 2 * i + 1 + (binned[who, f] > b)
        total_g, total_h = np.bincount(node, grad, leaves), np.bincount(node, hess, leaves)
        value[t] = -RATE * total_g / (total_h + PENALTY)
        margin += value[t][node]
    return Trees(base, feature, cut, value)


def held_out(id_col):
    """Whether the row's label must not be learned from; a null id is never held out and never labelled."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = MAX_TRAIN) -> Trees:
    """Trees from labelled documents that aren't held out: the ``max_train`` label rows with the least hash of the id.

    Their ids are bounded in number and so broadcast; only their texts are measured. Null
    labels and labels other than 0 and 1 are ignored; repeated and contrary ones count each.
    """
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("double").alias("__y")).where("__y in (0, 1)").where(~held_out(F.col("__id")))
    sample = known.orderBy(F.xxhash64("__id"), "__id", "__y").limit(max_train)
    texts = docs.select(F.col(id_col).alias("__of"), F.col(text_col).alias("__t")).join(F.broadcast(sample), F.col("__of") == F.col("__id"))
    rows = with_statistics(texts, ["__id", "__y"], "__t").toArrow().sort_by([("__id", "ascending"), ("__y", "ascending")])
    x = rows.column("stats").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
    return fit(x, rows.column("__y").to_numpy())


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: id, ``held_out``, ``score`` (0 to 1) and ``predicted`` (1 if the score reaches ``threshold``).

    Only the text is scored. Null texts are scored as empty ones; without labels all scores
    are 0.5. Repeated rows are scored each; other columns aren't carried.
    """
    python_workers(docs.sparkSession)
    model = train(docs, labels, id_col, text_col)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    schema = docs.select(F.col(id_col).alias("id"), F.lit(0.0).alias("score")).schema

    def run(batches):
        for batch in batches:
            for low, raw, rows in tk.chunks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, len(rows) - 1), pa.array(model.score(statistics(raw, rows)))], names=["id", "score"])

    out = source.mapInArrow(run, schema)
    return out.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score reaches ``threshold``."""
    python_workers(docs.sparkSession)
    model = train(docs, labels, id_col, text_col)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            scores = [model.score(statistics(raw, rows)) for _, raw, rows in tk.chunks(batch.column(at))]
            yield batch.filter(pa.array(np.concatenate(scores) >= threshold if scores else np.zeros(0, bool)))

    return docs.mapInArrow(run, docs.schema)
