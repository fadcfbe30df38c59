"""Language ID: script ranges narrow the candidates, then a Viterbi pass over per-word scores.

The model is learned here: for each language the counts of letter grams (one to three
letters of padded words) and of scripts, from all words of the training documents, counted
by Spark. A word is scored by the log-probabilities of its trigrams under those languages
that use its script. The labels of a document's words are the best path under a penalty for
every change of language, so short foreign words stay in their surroundings and longer
foreign passages become spans of their own.
"""

from __future__ import annotations

import unicodedata
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailspark.llm.common import python_workers, stored

FOLDS, OUT = 3, 1
PENALTY = 12.0
#: Training documents for each language, at most about (drawn by hash of the id; all below that many).
MAX_TRAIN = 5_000
MIN_SHARE = 0.01  # of a language's words that must be in a script for it to be a candidate there

# First code points of script ranges, in order.
SCRIPTS = [(0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0900, "Devanagari"), (0x0980, "Indic"), (0x0E00, "Thai"), (0x0E80, "Other"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x2C60, "Latin"), (0x2C80, "Other"), (0x3040, "Kana"), (0x3100, "Han"), (0x3130, "Hangul"), (0x3190, "Han"), (0xA000, "Other"), (0xA720, "Latin"), (0xA800, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Other"), (0x20000, "Han")]
_STARTS = np.array([s for s, _ in SCRIPTS])
NAMES = sorted({name for _, name in SCRIPTS})
_SCRIPT_IDS = np.array([NAMES.index(name) for _, name in SCRIPTS])
_CHUNK = 1 << 19  # characters scored at a time, for four languages


def held_out(id_col):
    """Whether the row must not be learned from; a null id never is."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % FOLDS == OUT, F.lit(False))


_kinds: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    """For each code point 2 for a letter, 1 for a mark, else 0; made once in a process."""
    if "kind" not in _kinds:
        table = np.zeros(0x110000, np.uint8)
        for c in range(0x110000):
            first = unicodedata.category(chr(c))[0]
            table[c] = 2 if first == "L" else 1 if first == "M" else 0
        _kinds["kind"] = table
    return _kinds["kind"]


def _key(before, here, after):
    return (before.astype(np.uint64) << np.uint64(42)) | (here.astype(np.uint64) << np.uint64(21)) | after.astype(np.uint64)


def scripts_of(points: np.ndarray) -> np.ndarray:
    return _SCRIPT_IDS[np.searchsorted(_STARTS, points, side="right") - 1]


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For all letters of all words: the one before (or ^), the letter and the one after (or $); each word's first letter; each text's first word (and the end).

    Words are letters with the letters and marks after them, in composed lower case.
    """
    clean = [unicodedata.normalize("NFC", t).lower() if t else "" for t in texts]
    ends = np.cumsum([0, *(len(t) + 1 for t in clean)])
    points = np.frombuffer("\n".join([*clean, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _letters()[points]
    while True:  # marks that follow no letter belong to no word
        loose = (kind == 1) & (np.concatenate([[0], kind[:-1]]) == 0)
        if not loose.any():
            break
        kind = np.where(loose, 0, kind)
    inside = kind > 0
    at = np.flatnonzero(inside)
    here = points[at]
    before, after = np.concatenate([[0], here[:-1]])[: len(here)], np.concatenate([here[1:], [0]])[: len(here)]
    begins = ~np.concatenate([[False], inside[:-1]])[at]
    finishes = ~np.concatenate([inside[1:], [False]])[at]
    before[begins], after[finishes] = ord("^"), ord("$")
    first = np.flatnonzero(begins)
    return before, here, after, first, np.searchsorted(at[first], ends)


def gram_counts(texts: list[str | None]) -> dict[str, int]:
    """How often each trigram occurs, and under #name each script, by words."""
    before, here, after, first, _ = trigrams(texts)
    keys, n = np.unique(_key(before, here, after), return_counts=True)
    low = (1 << 21) - 1
    out = {chr(k >> 42) + chr(k >> 21 & low) + chr(k & low): c for k, c in zip(keys.tolist(), n.tolist(), strict=True)}
    for i, c in enumerate(np.bincount(scripts_of(here[first]), minlength=len(NAMES)).tolist()):
        if c:
            out[f"#{NAMES[i]}"] = c
    return out


class Model:
    """Log-probabilities of trigrams for each language, and the languages of each script.

    Texts are scored by whole batches: each letter stands for the trigram around it, which
    is looked up in a dense table over the model's letters (by binary search where these are
    many), and a word's scores are the sums over its letters.
    """

    DENSE = 126

    def __init__(self, langs: list[str], grams: list[str], scores: np.ndarray, unseen: np.ndarray, allowed: np.ndarray):
        """``scores`` has a row for each of ``grams``; ``allowed`` one for each of ``NAMES``."""
        self.langs, self.allowed = langs, allowed
        points = np.array([[ord(c) for c in g] for g in grams], np.uint64).reshape(-1, 3)
        keys = _key(points[:, 0], points[:, 1], points[:, 2])
        order = np.argsort(keys)
        self.keys = keys[order]
        self.rows = np.vstack([scores[order].reshape(len(order), len(langs)), unseen.reshape(1, len(langs))])
        self.size = len(keys)
        alphabet = np.unique(points)
        self.classes = self.dense = None
        if len(alphabet) <= self.DENSE:
            base = len(alphabet) + 1  # the last class is any other letter
            self.classes = (alphabet, base)
            at = np.searchsorted(alphabet, points[order])
            self.dense = np.full(base**3, self.size, np.int32)
            self.dense[(at[:, 0] * base + at[:, 1]) * base + at[:, 2]] = np.arange(self.size)

    def _places(self, before, here, after) -> np.ndarray:
        if self.dense is not None:
            alphabet, base = self.classes
            small = self.__dict__.get("small")
            if small is None:
                small = np.full(0x110000, base - 1, np.uint8)
                small[alphabet.astype(np.int64)] = np.arange(len(alphabet))
                self.__dict__["small"] = small
            return self.dense[(small[before].astype(np.int32) * base + small[here]) * base + small[after]]
        want = _key(before, here, after)
        at = np.minimum(np.searchsorted(self.keys, want), max(self.size - 1, 0))
        return np.where(self.size and self.keys[at] == want, at, self.size)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "small"}

    def words(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For the words of the texts in order: scores, numbers of letters, and the first word of each text (and the end)."""
        before, here, after, first, bounds = trigrams(texts)
        letters = np.diff(np.append(first, len(here)))
        scores = np.zeros((len(first), len(self.langs)))
        if not len(first) or not self.langs:
            return scores, letters, bounds
        places = self._places(before, here, after)
        for i in range(len(self.langs)):
            scores[:, i] = np.add.reduceat(self.rows[places, i], first)
        may = self.allowed[scripts_of(here[first])]
        scores = np.where(may, scores, scores.min(axis=1, keepdims=True) - PENALTY)
        scores[~may.any(axis=1)] = 0.0
        return scores, letters, bounds

    def paths(self, texts: list[str | None]):
        """For each text the best language of each word, a change costing ``PENALTY`` (ties go to the first), the words' letters, and each language's share of the evidence for them.

        The evidence of a word is the posterior of its trigrams under equal priors; a word in
        a script of no language has none.
        """
        scores, letters, bounds = self.words(texts)
        share = np.zeros_like(scores)
        if self.langs:
            np.exp(scores - scores.max(axis=1, keepdims=True), out=share)
            share /= share.sum(axis=1, keepdims=True)
            share[(scores == 0.0).all(axis=1)] = 0.0
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            yield (best_path(scores[a:b], PENALTY) if b > a and self.langs else np.zeros(0, np.int64)), letters[a:b], share[a:b]

    def label(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """The language of most letters on the best path, and its mean posterior over the letters; ``und`` without letters.

        Words that speak for no language (a script that none uses) count as letters without
        evidence; a text of such words alone has the first language and score 0.
        """
        out = []
        for path, letters, share in self.paths(texts):
            if not len(path):
                out.append(("und", 0.0))
                continue
            known = share.any(axis=1)
            best = int(np.argmax(np.bincount(path, letters * known, len(self.langs))))
            out.append((self.langs[best], float(share[:, best] @ letters / letters.sum())))
        return out


def groups(texts: list[str | None], size: int):
    """The texts in order, in lists of about ``size`` characters (one longer text stands alone)."""
    out, total = [], 0
    for t in texts:
        if out and total + len(t or "") > size:
            yield out
            out, total = [], 0
        out.append(t)
        total += len(t or "")
    if out:
        yield out


def best_path(scores: np.ndarray, penalty: float) -> np.ndarray:
    """Viterbi for a uniform cost of change. Where staying with one language can't be beaten, no step-by-step pass is made."""
    total = scores.sum(axis=0)
    stay = int(np.argmax(total))
    gain = np.concatenate([[0.0], np.cumsum(scores.max(axis=1) - scores[:, stay])])
    # any stretch elsewhere gains less than the change to it costs: the constant path is best
    if (gain[-1] - gain[0]) < penalty or _largest_rise(scores, stay) < penalty:
        return np.full(len(scores), stay)
    n, m = scores.shape
    back = np.empty((n, m), np.int32)
    own = np.arange(m)
    value = scores[0].copy()
    for t in range(1, n):
        top = int(value.argmax())
        change = value[top] - penalty
        keep = value >= change
        back[t] = np.where(keep, own, top)
        value = np.where(keep, value, change) + scores[t]
    out = np.empty(n, np.int64)
    out[-1] = int(value.argmax())
    for t in range(n - 1, 0, -1):
        out[t - 1] = back[t, out[t]]
    return out


def _largest_rise(scores: np.ndarray, stay: int) -> float:
    """The most that some stretch of words, each at its best other language, gains over ``stay``."""
    other = np.delete(scores, stay, axis=1)
    if not other.shape[1]:
        return 0.0
    walk = np.concatenate([[0.0], np.cumsum(other.max(axis=1) - scores[:, stay])])
    return float((walk - np.minimum.accumulate(walk)).max())


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Counts over the training documents: rows with a language whose id isn't held out, thinned by hash to about ``MAX_TRAIN`` each."""
    python_workers(docs.sparkSession)
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where(F.col("lang").isNotNull() & ~held_out(F.col("id")))
    sizes = known.groupBy("lang").count()
    place = F.pmod(F.xxhash64("id", F.lit("train")), F.lit(1_000_000)) / 1_000_000
    drawn = known.join(F.broadcast(sizes), "lang").where(place * F.col("count") < MAX_TRAIN)

    def run(frames):
        for frame in frames:
            out: dict[str, Counter] = {}
            for lang, part in frame.groupby("lang")["text"]:
                count = out.setdefault(lang, Counter())
                for texts in groups(part.tolist(), _CHUNK):
                    count.update(gram_counts(texts))
            yield pd.DataFrame([(lang, g, n) for lang, c in out.items() for g, n in c.items()], columns=["lang", "gram", "n"])

    counts = stored(drawn.select("lang", "text").mapInPandas(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    sums = {r["lang"]: (r["total"], r["kinds"]) for r in counts.where("gram not like '#%'").groupBy("lang").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).collect()}
    langs = sorted(sums)
    allowed = np.zeros((len(NAMES), len(langs)), bool)
    if not langs:
        return Model([], [], np.zeros((0, 0)), np.zeros(0), allowed)
    kept = counts.where("gram not like '#%'").select("lang", "gram", "n").toArrow()
    at = {lang: i for i, lang in enumerate(langs)}
    kinds = max(k for _, k in sums.values()) + 1
    below = np.array([sums[lang][0] + 0.5 * kinds for lang in langs])
    grams = sorted(set(kept.column("gram").to_pylist()))
    place = {g: i for i, g in enumerate(grams)}
    seen = np.zeros((len(grams), len(langs)))
    for lang, g, n in zip(*(kept.column(c).to_pylist() for c in ("lang", "gram", "n")), strict=True):
        seen[place[g], at[lang]] = n
    used: dict[str, dict[str, int]] = {}
    for r in counts.where("gram like '#%'").collect():
        used.setdefault(r["lang"], {})[r["gram"][1:]] = r["n"]
    for lang, by in used.items():
        for name, n in by.items():
            allowed[NAMES.index(name), at[lang]] = n >= MIN_SHARE * sum(by.values())
    return Model(langs, grams, np.log((seen + 0.5) / below), np.log(0.5 / below), allowed)


def spans(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id and ``spans`` (lang, first word, end word) of its words in order; none without letters."""
    python_workers(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = docs.select(F.col(id_col).alias("id"), F.lit(None).cast("array<struct<lang:string,start:int,end:int>>").alias("spans")).schema

    def run(frames):
        for frame in frames:
            out = []
            for texts in groups(frame["text"].tolist(), _CHUNK):
                for path, _, _ in model.paths(texts):
                    edge = np.flatnonzero(np.diff(path, prepend=-1))
                    out.append([{"lang": model.langs[path[a]], "start": a, "end": b} for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(path)][: len(edge)], strict=True)])
            yield pd.DataFrame({"id": frame["id"], "spans": out})

    return source.mapInPandas(run, schema).withColumnRenamed("id", id_col)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: id, ``held_out``, ``lang_pred`` and ``score``, the language's mean posterior over the letters.

    ``und`` with score 0 for null texts, texts without letters, or where nothing could be
    learned; the first language with score 0 where no letter is in a script that a language
    uses. Repeated rows are labelled each; other columns aren't carried.
    """
    model = train(docs, id_col, text_col, lang_col)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = docs.select(F.col(id_col).alias("id"), F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def run(batches):
        for batch in batches:
            found = [x for texts in groups(batch.column(1).to_pylist(), _CHUNK) for x in model.label(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a for a, _ in found], pa.string()), pa.array([b for _, b in found], pa.float64())], names=["id", "lang_pred", "score"])

    out = source.mapInArrow(run, schema)
    return out.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "lang_pred", "score")
