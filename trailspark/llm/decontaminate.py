"""Benchmark decontamination by winnowing, with built-in functions only.

Texts and items become arrays of lower-cased words. Of the word 5-grams in each window of
10 words the one with the least hash is kept (the rightmost of equals); windows that are
equal keep the same gram at the same place, so every shared window shares a fingerprint.
Fingerprints of documents meet those of the items in a join, and each meeting is extended:
the windows around it are compared word by word. Items of fewer words are one window; their
fingerprint is the whole item, and documents are asked for each such length that occurs.

Up to ``MAX_BROADCAST`` fingerprints of items are broadcast and met in the stage that reads the
documents. Beyond, fingerprints go through the shuffle without any text; those that some item
has go back to their document, which sends only the words around each of them to the items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailspark.llm.common import fresh, let, looked_up

WINDOW = 10
GRAM = 5
#: Fingerprints of the items are broadcast up to this many rows (each a few hundred bytes); beyond, the join is shuffled.
MAX_BROADCAST = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOW = 0xFFFFFFFF


def words(text):
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text column after lower-casing A-Z; null has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(_WORD), F.lit(0))


def fingerprints(w, window: int = WINDOW, gram: int = GRAM):
    """Winnowed fingerprints of a word array: longs of 32 bits of hash and 32 bits of the position, counted down from the top."""
    n = F.size(w)
    hashed = let(F.transform(w, lambda x: F.hash(x)), lambda c: F.transform(F.sequence(F.lit(0), n - gram), lambda i: F.shiftleft(F.hash(*[F.get(c, i + j) for j in range(gram)]).cast("long"), 32) + (F.lit(_LOW) - i.cast("long"))))
    return hashed, lambda h: F.array_distinct(F.transform(F.sequence(F.lit(0), n - window), lambda i: F.least(*[F.get(h, i + j) for j in range(window - gram + 1)])))


def _grams(df: DataFrame, word_col: str, window: int, gram: int, short: list[int]) -> DataFrame:
    """``fps``: structs (size, code, at) of the fingerprints; size is 0 for winnowed grams, else the length of a short item."""
    hashed, winnow = fingerprints(F.col(word_col), window, gram)
    none = F.array().cast("array<struct<size:int,code:int,at:int>>")
    df = df.withColumn("__h", F.when(F.size(word_col) >= window, hashed))
    parts = [F.when(F.size(word_col) >= window, F.transform(winnow(F.col("__h")), lambda c: F.struct(F.lit(0).alias("size"), F.shiftright(c, 32).cast("int").alias("code"), (F.lit(_LOW) - c.bitwiseAND(F.lit(_LOW))).cast("int").alias("at")))).otherwise(none)]

    def runs(m):
        return F.transform(F.sequence(F.lit(0), F.size(word_col) - m), lambda i: F.struct(F.lit(m).alias("size"), F.hash(F.slice(word_col, i + 1, m)).alias("code"), i.cast("int").alias("at")))

    parts += [F.when(F.size(word_col) >= m, runs(m)).otherwise(none) for m in short]
    return df.withColumn("fps", F.concat(*parts)).drop("__h")


def _asked(doc: DataFrame, index: DataFrame, window: int, gram: int, sizes: list[int]) -> DataFrame:
    """``doc`` with those of its fingerprints, ``fps``, that some item has. Equal texts ask once; no text is shuffled with a fingerprint."""
    key = lambda size, code: F.shiftleft(size.cast("long"), 32) + code
    slim = _grams(doc, "w", window, gram, sizes).select("digest", F.explode_outer("fps").alias("f")).select("digest", "f", key(F.col("f.size"), F.col("f.code")).alias("key"))
    codes = index.select(key(F.col("k_size"), F.col("k_code")).alias("k")).distinct()
    met = looked_up(slim, "key", codes, "k", "left_semi").groupBy("digest").agg(F.collect_set("f").alias("fps"))
    return looked_up(doc, "digest", met.withColumnRenamed("digest", "d"), "d")


def overlaps(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per document: id, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``, ``contaminated`` and ``hit_starts``.

    A word is hit if it lies in a window that occurs in an item. Null and empty texts have
    no words and no hits, as has everything if there are no items. Items without words or
    with a null id are ignored; rows of one item id are one item. Repeated documents are
    judged each. Further columns aren't carried.
    """
    item = items.select(F.col(item_col).cast("string").alias("item"), words(F.col(item_text_col)).alias("iw")).where("item is not null and size(iw) > 0").distinct()
    sizes = item.where(F.size("iw") < window).agg(F.sort_array(F.collect_set(F.size("iw")))).first()[0]
    item_long = _grams(item.where(F.size("iw") >= window), "iw", window, gram, [])
    # explode would add a filter on the size of fps, which runs the whole expression once per word below the projections
    index = item_long.select("item", "iw", F.explode_outer("fps").alias("f")).select("item", F.col("f.size").alias("k_size"), F.col("f.code").alias("k_code"), "iw", F.col("f.at").alias("q"))
    reach = window - gram
    left = F.least(F.col("q"), F.lit(reach))
    index = index.select("item", "k_size", "k_code", left.cast("int").alias("ileft"), F.slice("iw", F.col("q") - left + 1, left + gram + reach).alias("around"))
    for m in sizes:
        index = index.unionByName(item.where(F.size("iw") == m).select("item", F.lit(m).alias("k_size"), F.hash("iw").alias("k_code"), F.lit(0).alias("ileft"), F.col("iw").alias("around")))
    index = index.distinct()
    small = index.count() <= MAX_BROADCAST

    none = F.array().cast("array<struct<size:int,code:int,at:int>>")
    doc = docs.select(F.col(id_col).alias("id"), words(F.col(text_col)).alias("w"), F.monotonically_increasing_id().alias("row"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("digest"))
    doc = _grams(doc, "w", window, gram, sizes) if small else _asked(doc, index, window, gram, sizes)
    # one more element, of size -1, keeps documents without fingerprints and meets nothing
    own = F.array(F.struct(F.lit(-1).alias("size"), F.pmod(F.col("row"), F.lit(1 << 30)).cast("int").alias("code"), F.lit(0).alias("at")))
    asked = doc.select("id", "row", "w", F.explode(F.concat(own, F.coalesce("fps", none))).alias("f")).select("id", "row", "w", F.col("f.size").alias("size"), F.col("f.code").alias("code"), F.col("f.at").alias("p"))
    # the words around a fingerprint, of which ``dleft`` stand before it
    dleft = F.when(F.col("size") == 0, F.least(F.col("p"), F.lit(reach))).otherwise(0).cast("int")
    around = F.when(F.col("size") == -1, F.array().cast("array<string>")).otherwise(F.slice("w", F.col("p") - dleft + 1, F.when(F.col("size") == 0, dleft + gram + reach).otherwise(F.col("size"))))
    cut = [F.when(F.col("size") == -1, F.size("w")).alias("n"), "size", "code", "p", dleft.alias("dleft"), around.alias("near")]
    if small:
        met = asked.join(F.broadcast(index), (F.col("size") == F.col("k_size")) & (F.col("code") == F.col("k_code")), "left")
        # this filter must stay cheap: it runs in one piece of code with the join, so the words are copied for meetings only
        met = met.where("size = -1 or item is not null").select("id", "row", *cut, "item", "ileft", "around")
    else:
        key = lambda size, code: F.shiftleft(F.col(size).cast("long"), 32) + F.col(code)
        asked = asked.select("id", "row", *cut).withColumn("key", key("size", "code"))
        known = index.withColumn("k", key("k_size", "k_code")).drop("k_size", "k_code")
        known = known.join(asked.where("size >= 0").select(F.col("key").alias("k")).distinct(), "k", "left_semi")
        met = looked_up(asked, "key", known, "k").where("size = -1 or item is not null")
    # both sides aligned, so that word j of the one faces word j of the other
    shift = F.least(F.col("dleft"), F.col("ileft"))
    span = F.slice("near", F.col("dleft") - shift + 1, F.size("around") - F.col("ileft") + shift)
    met = met.select("id", "row", "n", "item", "size", (F.col("p") - shift).alias("base"), span.alias("here"), F.slice("around", F.col("ileft") - shift + 1, F.size("around")).alias("there"))
    length = F.when(F.col("size") > 0, F.col("size")).otherwise(window)
    last = F.least(F.size("here"), F.size("there")) - length
    found = F.filter(F.sequence(F.lit(0), last), lambda i: F.slice("here", i + 1, length) == F.slice("there", i + 1, length))
    met = met.select("id", "row", "n", "item", length.alias("length"), F.when(F.col("item").isNotNull() & (last >= 0), F.transform(found, lambda i: i + F.col("base"))).alias("starts"))
    hits = F.when(F.size("starts") > 0, F.transform("starts", lambda s: F.struct(s.alias("s"), (s + F.col("length")).alias("e"))))
    met = met.select("id", "row", "n", F.when(F.size("starts") > 0, F.col("item")).alias("item"), hits.alias("hits"))
    per_doc = met.groupBy("row").agg(F.first("id").alias("id"), F.max("n").alias("n"), F.array_sort(F.collect_set("item")).alias("of"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("hits")))).alias("hits"))
    # sorted by start; each adds what reaches beyond the end so far
    total = F.aggregate("hits", F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")), lambda a, h: F.struct(F.greatest(a["end"], h["e"]).alias("end"), (a["n"] + F.greatest(F.lit(0), h["e"] - F.greatest(a["end"], h["s"]))).cast("long").alias("n")))["n"]
    return per_doc.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_words"), total.alias("n_hit"), F.size("of").cast("long").alias("n_items"), F.sha2(F.array_join("of", ","), 256).alias("items_sha256"), (F.size("of") > 0).alias("contaminated"), F.transform("hits", lambda h: h["s"]).alias("hit_starts"))


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, without those that share a window with an item. Equal texts are judged alike."""
    digest = F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    source = docs.select(digest.alias("digest"), F.col(text_col).alias("words"))
    own, of = fresh("__digest", docs), fresh("__of", docs)
    found = overlaps(source, items, "digest", "words", item_col, item_text_col).where("contaminated").select(F.col("digest").alias(of)).distinct()
    return looked_up(docs.withColumn(own, digest), own, found, of, "left_anti").select(*docs.columns)
