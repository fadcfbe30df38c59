"""PII: base patterns with checks, widened by bootstrapped contextual extraction. Built-in functions only.

Base spans come from one regular expression for each kind and a check of each match. They
seed the bootstrap: whole base spans with the rest of the words they touch are the seeds;
words with a digit or @ that touch none, and the longest runs of such words, are candidates.

The surroundings of an instance are its lexical patterns: the word before with the rough
form (letters or not, how many digits), the words before and after with the rough form,
and the word before, or after, with the shape (runs of digits as 9, of letters as a).
So a pattern says nothing of an identifier's exact characters, and forms that no
expression foresaw, such as ``user(at)host.com`` or a number with other separators, can
be instances of a pattern that seeds have made.

Spark scores the graph of patterns and instances by turns. A pattern scores, for a kind,
the share of its distinct instances that are of the kind: seeds count 1, instances of
accepted patterns the best score of these, all others 0. Patterns with enough distinct seeds
and a high score are accepted, and so may raise others in the next round; a pattern
never raises itself above the bar, as only accepted ones pass on scores. Candidates under an
accepted pattern become spans of its kind; they never touch a base span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailspark.llm.common import fresh, let, looked_up, stored

KINDS = ("email", "ip", "card", "phone")
#: Possessive and anchored forms of the contract's expressions: the same leftmost matches, in linear time and without deep recursion.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A character that every match has.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
_S = r"\x20\x09-\x0D"
#: Words with a digit or @.
INSTANCE = rf"(?<![^{_S}])(?=[^0-9@{_S}]*+[0-9@])[^{_S}]++"
#: The last word of a text that ends in white space, the first of one that begins with it.
LAST = rf"(?s)^.*(?<![^{_S}])([^{_S}]++)[{_S}]++\z"
FIRST = rf"^[{_S}]++([^{_S}]++)"
MIN_SEEDS, MIN_SCORE, ROUNDS = 5, 0.9, 3
_SPAN = "array<struct<start:int,end:int,value:string>>"
_WORD = "array<struct<start:int,end:int,value:string,left:string,right:string,after:int>>"
_FOUND = "array<struct<start:int,end:int,value:string,left:string,right:string,seed:string>>"


def _blocks(a: Column) -> Column:
    """An array in slices of about the square root of its size, so that folds and look-ups within slices cost its power 1.5."""
    size = F.greatest(F.ceil(F.sqrt(F.size(a))).cast("int"), F.lit(1))
    return F.when(F.size(a) > 0, let(size, lambda n: F.transform(F.sequence(F.lit(0), ((F.size(a) - 1) / n).cast("int")), lambda b: F.slice(a, b * n + 1, n)))).otherwise(F.slice(F.array(a), 1, 0))


def _fold(a: Column, zero: Column, f) -> Column:
    """``zero`` and the results of ``f`` over ever more of an array."""
    return F.aggregate(a, F.array(zero), lambda out, x: F.concat(out, F.array(f(F.element_at(out, -1), x))))


def _running(a: Column, zero: Column, f) -> Column:
    """For each element of an array the result of the associative ``f`` over those before it, ``zero`` for the first."""

    def of(blocks):
        bases = _fold(F.transform(blocks, lambda b: F.aggregate(b, zero, f)), zero, f)
        return F.flatten(F.zip_with(blocks, F.slice(bases, 1, F.size(blocks)), lambda b, base: F.slice(_fold(b, base, f), 1, F.size(b))))

    return let(_blocks(a), of)


def _matches(text: Column, pattern: str) -> Column:
    """Structs (start, end, value) of the leftmost non-overlapping matches, in code points."""

    def of(p):
        gap = F.transform(p["gaps"], lambda g: F.length(g))
        return let(F.struct(p["found"].alias("found"), gap.alias("gap")), place)

    def place(p):
        steps = F.zip_with(p["found"], F.slice(p["gap"], 1, F.size(p["found"])), lambda v, g: F.length(v) + g)
        return let(F.struct(p["found"].alias("found"), p["gap"].alias("gap"), let(steps, lambda a: _running(a, F.lit(0), lambda x, y: x + y)).alias("at")), lambda q: F.transform(q["found"], lambda v, i: let(F.get(q["at"], i) + F.get(q["gap"], i), lambda s: F.struct(s.alias("start"), (s + F.length(v)).alias("end"), v.alias("value")))))

    parts = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps"))
    return F.when(F.regexp_like(text, F.lit(pattern)), let(parts, of)).otherwise(F.array().cast(_SPAN))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a right check digit."""
    n = F.length(digits)
    places = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(digits, n - i + 1, F.lit(1)).cast("int") * (F.lit(2) - F.pmod(i, F.lit(2))))
    return F.pmod(F.aggregate(places, F.lit(0), lambda a, d: a + d - F.when(d > 9, 9).otherwise(0)), F.lit(10)) == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(value, r"\.", -1), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(F.when(F.length(p) <= 3, p.try_cast("int")), F.lit(0)) <= 255))
    size = F.length(_digits(value))
    if kind == "card":
        return F.when((size >= 13) & (size <= 19), luhn(_digits(value))).otherwise(False)
    if kind == "phone":
        return (size >= 9) & (size <= 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    found = F.filter(_matches(text, PATTERNS[kind]), lambda m: _valid(kind, m["value"]))
    return F.when(F.contains(text, F.lit(NEEDS[kind])), found).otherwise(F.array().cast(_SPAN)) if kind in NEEDS else found


def may_hold(text: Column) -> Column:
    """Whether a text has a digit or @, without which it has no instance of any kind."""
    return F.regexp_like(text, F.lit("[0-9@]"))


def _words(text: Column) -> Column:
    """The words with a digit or @ as structs (start, end, value, left, right, after), lower-cased neighbours and the end of such a word right before."""

    def of(p):
        def word(m, i):
            near = (i > 0) & (F.get(p["left"], i) == "")
            next_near = (F.get(p["right"], i + 1) == "") & (i + 1 < F.size(p["m"]))
            left = F.when(near, F.lower(F.get(p["m"], i - 1)["value"])).when(F.get(p["left"], i) == "", "^").otherwise(F.get(p["left"], i))
            right = F.when(next_near, F.lower(F.get(p["m"], i + 1)["value"])).when(F.get(p["right"], i + 1) == "", "$").otherwise(F.get(p["right"], i + 1))
            return F.struct(m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"), left.alias("left"), right.alias("right"), F.when(near, F.get(p["m"], i - 1)["end"]).alias("after"))

        return F.transform(p["m"], word)

    def gaps(p):
        return let(F.struct(p["m"].alias("m"), F.transform(p["gaps"], lambda g: F.lower(F.regexp_extract(g, LAST, 1))).alias("left"), F.transform(p["gaps"], lambda g: F.lower(F.regexp_extract(g, FIRST, 1))).alias("right")), of)

    return let(F.struct(_matches(text, INSTANCE).alias("m"), F.split(text, INSTANCE, -1).alias("gaps")), gaps)


def _found(words: Column, spans: Column) -> Column:
    """Seeds, one for each of ``spans`` (sorted, with ``kind`` and ``value``), and candidates among ``words``."""

    def outside(block):
        low, high = F.get(block, F.lit(0))["start"], F.element_at(block, -1)["end"]
        near = F.filter(spans, lambda s: (s["end"] > low) & (s["start"] < high))
        return let(near, lambda these: F.filter(block, lambda m: ~F.exists(these, lambda s: (s["start"] < m["end"]) & (s["end"] > m["start"]))))

    def seeds(block):
        low, high = F.get(block, F.lit(0))["start"], F.array_max(F.transform(block, lambda s: s["end"]))
        near = F.filter(words, lambda m: (m["end"] > low) & (m["start"] < high))

        def whole(these):
            first = lambda s: F.get(F.filter(these, lambda m: (m["start"] <= s["start"]) & (s["start"] < m["end"])), F.lit(0))
            last = lambda s: F.get(F.filter(these, lambda m: (m["start"] < s["end"]) & (s["end"] <= m["end"])), F.lit(0))
            ends = F.transform(block, lambda s: F.struct(first(s).alias("a"), last(s).alias("b"), s.alias("s")))

            def seed(e):
                value = F.concat(F.substring(e["a"]["value"], F.lit(1), e["s"]["start"] - e["a"]["start"]), e["s"]["value"], F.substring(e["b"]["value"], e["s"]["end"] - e["b"]["start"] + 1, e["b"]["end"] - e["s"]["end"]))
                return F.struct(e["a"]["start"].alias("start"), e["b"]["end"].alias("end"), value.alias("value"), e["a"]["left"].alias("left"), e["b"]["right"].alias("right"), e["s"]["kind"].alias("seed"))

            return F.transform(ends, seed)

        return let(near, whole)

    def candidate(first, last, value):
        return F.struct(first["start"].alias("start"), last["end"].alias("end"), value.alias("value"), first["left"].alias("left"), last["right"].alias("right"), F.lit(None).cast("string").alias("seed"))

    def candidates(free):
        numbered = F.transform(free, lambda m, i: F.struct(m.alias("m"), i.alias("i")))
        begins = F.filter(numbered, lambda n: ~F.coalesce((n["i"] > 0) & (F.get(free, n["i"] - 1)["end"] == n["m"]["after"]), F.lit(False)))
        stops = F.filter(numbered, lambda n: ~F.coalesce(F.get(free, n["i"] + 1)["after"] == n["m"]["end"], F.lit(False)))
        runs = F.filter(F.zip_with(begins, stops, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda r: r["a"]["i"] < r["b"]["i"])
        joined = lambda r: F.array_join(F.transform(F.slice(free, r["a"]["i"] + 1, r["b"]["i"] - r["a"]["i"] + 1), lambda m: m["value"]), " ")
        return F.concat(F.transform(free, lambda m: candidate(m, m, m["value"])), F.transform(runs, lambda r: candidate(r["a"]["m"], r["b"]["m"], joined(r))))

    free = F.flatten(F.transform(_blocks(words), outside)).cast(_WORD)
    return F.concat(F.flatten(F.transform(_blocks(spans), seeds)).cast(_FOUND), let(free, candidates).cast(_FOUND))


def scan(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep``, ``key`` (digest of the text), the base spans of each kind, and ``found``: structs (start, end, value, left, right, seed).

    Seeds are base spans, of any number of words, with the rest of their first and last
    word. Candidates (of null ``seed``) are the words with a digit or @ that touch no base
    span, and the longest runs of two or more of them (joined by single spaces).
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.select(*keep, F.md5(text.cast("binary")).alias("key"), text.alias("__t"), may_hold(text).alias("__may"))
    none = F.array().cast(_SPAN)
    out = out.select(*keep, "key", *[F.when(F.col("__may"), base_spans(F.col("__t"), k)).otherwise(none).alias(f"__{k}") for k in KINDS], F.when(F.col("__may"), _words(F.col("__t"))).otherwise(F.array().cast(_WORD)).alias("__w"))

    def named(kind):
        return F.transform(f"__{kind}", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["value"].alias("value")))

    out = out.withColumn("__s", F.array_sort(F.concat(*[named(k) for k in KINDS])))
    found = let(F.struct(F.col("__w").alias("w"), F.col("__s").alias("s")), lambda p: _found(p["w"], p["s"]))
    return out.select(*keep, "key", *[f"__{k}" for k in KINDS], F.when(F.size("__w") > 0, found).otherwise(F.array().cast(_FOUND)).alias("found"))


def patterns_of(value: Column, left: Column, right: Column) -> Column:
    """The lexical patterns of an instance, as strings."""
    shape = F.regexp_replace(F.regexp_replace(value, r"[0-9]+", "9"), r"\p{L}+", "a")
    n = F.length(_digits(value))
    rough = F.concat(F.when(F.regexp_like(value, F.lit(r"\p{L}")), "a").otherwise(""), F.when(n == 0, "").when(n < 5, "9").when(n < 9, "99").otherwise("999"))
    return F.array(F.concat(F.lit("L "), left, F.lit(" "), rough), F.concat(F.lit("B "), left, F.lit(" "), rough, F.lit(" "), right), F.concat(F.lit("S "), left, F.lit(" "), shape), F.concat(F.lit("R "), shape, F.lit(" "), right))


def _instances(scanned: DataFrame) -> DataFrame:
    """Distinct texts' instances: ``key``, ``start``, ``end``, ``value``, ``patterns`` and ``seed``, the kind of the base span it holds, or null."""
    rows = scanned.where(F.size("found") > 0).select("key", "found").dropDuplicates(["key"]).select("key", F.explode("found").alias("m"))
    return rows.select("key", "m.start", "m.end", "m.value", patterns_of(F.col("m.value"), F.col("m.left"), F.col("m.right")).alias("patterns"), "m.seed")


def bootstrap(instances: DataFrame, min_seeds: int = MIN_SEEDS, min_score: float = MIN_SCORE, rounds: int = ROUNDS) -> DataFrame:
    """Accepted patterns ``(pattern, kind, score)``; a pattern has at most one kind (the better scored, then the first of ``KINDS``).

    Only patterns with ``min_seeds`` distinct seeds of one kind can be accepted, so the graph
    is cut to them before the rounds. A hot pattern's instances are distinct values, counted
    and summed before the shuffle, and looked up with salt.
    """
    every = instances.select(F.explode("patterns").alias("pattern"), "value", "seed")
    seeds = every.where("seed is not null").select("pattern", "value", F.col("seed").alias("kind")).distinct()
    strong = stored(seeds.groupBy("pattern", "kind").agg(F.count("*").alias("seeds")).where(F.col("seeds") >= min_seeds).select("pattern", "kind"))
    names = strong.select(F.col("pattern").alias("__p")).distinct()
    links = stored(looked_up(every.select("pattern", "value").distinct(), "pattern", names, "__p", "left_semi"))
    sizes = links.groupBy("pattern").agg(F.count("*").alias("n"))
    wanted = stored(strong.join(sizes, "pattern"))
    own = stored(every.where("seed is not null").select("value", F.col("seed").alias("kind")).distinct().withColumn("score", F.lit(1.0)))
    labels, accepted = own, None
    for turn in range(rounds):
        sums = links.join(labels, "value").groupBy("pattern", "kind").agg(F.sum("score").alias("s"))
        scored = wanted.join(sums, ["pattern", "kind"]).select("pattern", "kind", F.round(F.col("s") / F.col("n"), 9).alias("score"))
        accepted = stored(scored.where(F.col("score") >= min_score))
        if turn + 1 < rounds:
            raised = looked_up(links, "pattern", accepted.withColumnRenamed("pattern", "__p"), "__p", "inner")
            raised = raised.groupBy("value", "kind").agg(F.max("score").alias("score")).join(own.select("value"), "value", "left_anti")
            labels = stored(own.unionByName(raised))
    place = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    return accepted.groupBy("pattern").agg(F.max(F.struct("score", (-place).alias("place"), "kind")).alias("b")).select("pattern", "b.kind", "b.score")


def _added(scanned: DataFrame) -> DataFrame:
    """For each text that has any: ``key`` and ``added``, structs (kind, start, end) that the bootstrap discovered; the longest where they overlap in a run."""
    instances = stored(_instances(scanned))
    chosen = bootstrap(instances)
    rows = instances.where("seed is null").select("key", "start", "end", F.explode("patterns").alias("pattern"))
    rows = looked_up(rows, "pattern", chosen.withColumnRenamed("pattern", "__p"), "__p", "inner")
    place = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    best = rows.groupBy("key", "start", "end").agg(F.max(F.struct("score", (-place).alias("place"), "kind"))["kind"].alias("kind"))
    reached = F.max("end").over(Window.partitionBy("key").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1))
    best = best.withColumn("__reached", reached).where("__reached is null or end > __reached")
    return best.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end"))).alias("added"))


def _with_added(scanned: DataFrame, added: DataFrame) -> DataFrame:
    return looked_up(scanned, "key", added.withColumnRenamed("key", "__key"), "__key")


def _text_of(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat(F.lit(f"{kind}:"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``n_email``, ``n_ip``, ``n_card``, ``n_phone``, ``base_sha256``, ``spans`` and ``n_added``.

    ``spans`` lists base and discovered spans as kind:start:end, by kind, then start; the
    counts and the digest are of base spans. Null and empty texts have none. Equal texts
    count once in the bootstrap and get equal spans. Other columns aren't carried.
    """
    scanned = stored(scan(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")), ["__id"]))
    every = _with_added(scanned, _added(scanned))
    base = F.concat(*[_text_of(k, F.col(f"__{k}")) for k in KINDS])

    def all_of(k):
        own = F.transform(F.filter(F.coalesce("added", F.array().cast("array<struct<kind:string,start:int,end:int>>")), lambda s: s["kind"] == k), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
        return _text_of(k, F.array_sort(F.concat(F.transform(f"__{k}", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))), own)))

    return every.select(F.col("__id").alias(id_col), *[F.size(f"__{k}").cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(F.concat(*[all_of(k) for k in KINDS]), ",").alias("spans"), F.coalesce(F.size("added"), F.lit(0)).cast("long").alias("n_added"))


def _apart(spans: Column) -> Column:
    """Sorted spans without overlaps: those that overlap are one, named after the first."""

    def of(p):
        marked = F.zip_with(p["s"], p["reached"], lambda s, r: F.struct(s.alias("s"), r.alias("r")))
        begins = lambda q: F.filter(q["m"], lambda m: m["s"]["start"] >= m["r"])

        def ends(q):
            return F.transform(q["b"], lambda m, i: F.struct(m["s"]["start"].alias("start"), F.coalesce(F.get(q["b"], i + 1)["r"], q["last"]).alias("end"), m["s"]["kind"].alias("kind")))

        last = F.array_max(F.transform(p["s"], lambda x: x["end"]))
        return let(F.struct(marked.alias("m"), last.alias("last")), lambda q: let(F.struct(begins(q).alias("b"), q["last"].alias("last")), ends))

    reached = _running(F.transform(spans, lambda s: s["end"]), F.lit(0), lambda x, y: F.greatest(x, y))
    return let(F.struct(spans.alias("s"), reached.alias("reached")), of)


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span, base or discovered, replaced by ``[kind]``; overlapping spans become one, named after the first.

    All rows and columns stay; a null text stays null. Texts without a digit or @ hold no span and
    are passed on without a shuffle; the others meet the spans of their digest, found once.
    """
    names = docs.columns
    has = F.coalesce(may_hold(F.col(text_col)), F.lit(False))
    # filtered after it is stored: a filter on what scan works out would work it out once more
    scanned = stored(scan(docs.where(has).select(text_col), [], text_col)).where(F.size("found") > 0).dropDuplicates(["key"])
    plain = lambda spans, kind: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), kind(s).alias("kind")))
    every = _with_added(scanned, _added(scanned))
    spans = F.concat(*[plain(F.col(f"__{k}"), lambda s, k=k: F.lit(k)) for k in KINDS], plain(F.coalesce("added", F.array().cast("array<struct<kind:string,start:int,end:int>>")), lambda s: s["kind"]))
    own, of, found = fresh("__key", docs), fresh("__of", docs), fresh("__found", docs)
    spans = every.select(F.col("key").alias(of), F.array_sort(spans).alias("spans")).where(F.size("spans") > 0).select(of, let(F.col("spans"), _apart).alias(found))
    joined = looked_up(docs.where(has).withColumn(own, F.md5(F.col(text_col).cast("binary"))), own, spans, of)

    def replaced(p):
        before = lambda i: F.when(i > 0, F.get(p["m"], i - 1)["end"]).otherwise(0)
        pieces = F.transform(p["m"], lambda s, i: F.concat(F.substring(p["t"], before(i) + 1, s["start"] - before(i)), F.lit("["), s["kind"], F.lit("]")))
        return F.concat(F.array_join(pieces, ""), F.substring(p["t"], F.element_at(p["m"], -1)["end"] + 1, F.length(p["t"])))

    text = F.when(F.size(found) > 0, let(F.struct(F.col(found).alias("m"), F.col(text_col).alias("t")), replaced)).otherwise(F.col(text_col))
    return joined.withColumn(text_col, text).select(*names).unionByName(docs.where(~has).select(*names))
