"""The ten operators against plain versions, and their defined results on odd input."""

import hashlib
import math
import random
import re
import unicodedata
import zlib
from collections import Counter

import brute
import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from trailspark.llm import decontaminate, embeddings, langid, mixing, pii, quality, queries, simhash, substring, textkernel, urlfilter, warc

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="module")
def odd():
    """Null, empty, blank, repeated and very long texts, and letters beyond ASCII."""
    rng = random.Random(5)
    words = [rng.choice("abcdefgh") * rng.randint(1, 4) + rng.choice(["", "é", "ß", "Z"]) for _ in range(60)]
    passage = " ".join(rng.choice(words) for _ in range(45))
    long = " ".join(rng.choice(words) for _ in range(30_000))
    texts = [None, "", " \t\n", "a", "a b", passage, passage, f"x {passage}\ty", f"{passage} {passage}", "the " * 300, long, f"{long} tail", passage.replace(" ", "\n"), "word" * 20_000]
    return texts + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 80))) for _ in range(30)]


# ---- kernels


def test_words_are_those_of_split(odd):
    col = pa.array(odd, pa.string())
    got = []
    for _, raw, rows in textkernel.chunks(col, 4096):
        w = textkernel.Words(raw, rows)
        for a, b in zip(w.first[:-1], w.first[1:]):
            got.append([raw[s:e].tobytes() for s, e in zip(w.start[a:b], w.end[a:b])])
    assert got == [(t or "").encode().split() for t in odd]


def test_xxh64_is_xxh64():
    rng = np.random.default_rng(1)
    raw = rng.integers(0, 256, 4000, dtype=np.uint8)
    start = rng.integers(0, 3900, 400)
    end = start + rng.integers(0, 100, 400)
    got = textkernel.xxh64(raw, start, end)
    assert [int(x) for x in got] == [xxhash.xxh64_intdigest(raw[a:b].tobytes(), seed=42) for a, b in zip(start, end)]


def test_grams_tell_windows_apart():
    h = textkernel.mix(np.arange(50, dtype=np.uint64) % np.uint64(7))
    g = textkernel.grams(h, 20)
    assert len(g) == 31 and (g[:7] == g[7:14]).all() and len(set(g[:7].tolist())) == 7
    assert len(textkernel.grams(h[:5], 20)) == 0


# ---- 1


def rule_of(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, rest = rest[:cut].translate(brute.UPPER), rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "http://EXAMPLE.org/es/1", "https://a.b.example.org/en/1?x#y", "http://notexample.org/es/", "http://example.org", "http://org/", "http://x.com/de/2#a", "http://x.com/fr", "http://x.com/fr/", "http://x.com?u=://org/", "a://b://example.org/es/", "http://é.org/\n/x", "http://.org/", "http://x.com/de/2#a"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(pages, urlfilter.rule_table(spark)).collect()}
    assert got == {i: rule_of(u, urlfilter.RULES) for i, u in enumerate(urls)}
    assert urlfilter.judge(pages.limit(0), urlfilter.rule_table(spark)).count() == 0
    none = urlfilter.judge(pages, urlfilter.rule_table(spark, [(None, "/", "block")])).collect()
    assert {(r.rule, r.verdict) for r in none} == {(None, "allow")} and len(none) == len(urls)


def test_urls_beyond_the_broadcast(spark, monkeypatch):
    rules = [(f"h{i}.net", f"/p{i % 7}", "block" if i % 2 else "allow") for i in range(60)] + [("net", "/", "block"), ("h1.net", "/p1", "allow")]
    urls = [f"http://w.h{i % 80}.net/p{i % 9}/z" for i in range(200)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    both = []
    for bound in (10**6, 0):
        monkeypatch.setattr(urlfilter, "MAX_BROADCAST", bound)
        both.append(sorted((r.page_id, r.rule, r.verdict) for r in urlfilter.judge(pages, urlfilter.rule_table(spark, rules)).collect()))
    held = [r for r in rules if r != ("h1.net", "/p1", "allow")]
    assert both[0] == both[1] == [(i, *rule_of(u, held)[2:]) for i, u in enumerate(urls)]


# ---- 2


def cosine_links(rows, threshold=0.98):
    ok = {}
    for i, (v, e, label) in enumerate(rows):
        if label is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e):
            ok[i] = np.array(e, float)
    return [(i, j) for i in ok for j in ok if i < j and rows[i][2] == rows[j][2] and len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] / np.sqrt((ok[i] @ ok[i]) * (ok[j] @ ok[j])) >= threshold]


@pytest.mark.parametrize("block", [4, 2048])
def test_embeddings(spark, block, monkeypatch):
    monkeypatch.setattr(embeddings, "CELLS", 8 * block)
    rng = np.random.default_rng(2)
    rows = []
    for i in range(12):
        c = rng.normal(size=8)
        rows += [(c + rng.normal(size=8) * s).astype(np.float32).tolist() for s in (0, 0, 0.05, 0.1, 0.15)]
    data = [(i, e, i % 2) for i, e in enumerate(rows)]
    data += [(900, None, 0), (901, [], 0), (902, [0.0] * 8, 0), (903, [float("nan")] * 8, 0), (904, [None] * 8, 0), (905, rows[0], None), (906, [1.0, 2.0], 0), (907, [2.0, 4.0], 0), (908, [float("inf")] * 8, 1), (0, rows[0], 0)]
    df = spark.createDataFrame([(v, e, l, 1) for v, e, l in data], "vec_id long, embedding array<float>, label int, n int")
    links = cosine_links(data)
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df, block=block).collect())
    comp = brute.components(range(len(data)), links)
    least = {}
    for i, (v, _, _) in enumerate(data):
        least[comp[i]] = min(least.get(comp[i], v), v)
    want = sorted((v, sum(i in p for p in links), least[comp[i]], v == least[comp[i]]) for i, (v, _, _) in enumerate(data))
    assert got == want
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_quantisation_bound_holds():
    rng = np.random.default_rng(3)
    u = rng.normal(size=(200, 64)) * rng.random((200, 64)) ** 4
    u /= np.sqrt((u * u).sum(1))[:, None]
    q, s, e = embeddings.quantise(u)
    product = (q.astype(float) @ q.T) * np.outer(s, s)
    assert (np.abs(u @ u.T - product) <= np.add.outer(e, e) + np.outer(e, e) + 1e-12).all()


# ---- 3


def test_substring(spark, odd):
    want = sorted(brute.dedup(list(enumerate(odd))))
    df = docs_of(spark, odd).withColumn("k", F.lit("clash")).withColumn("window", F.lit(1)).repartition(5)
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.kept_digests(df).collect())
    assert got == want
    spans = {r.doc_id: r for r in substring.duplicate_spans(df).collect()}
    for i, n, removed, digest in want:
        r = spans[i]
        assert (r.n_words, r.n_removed) == (n, removed) and hashlib.sha256(r.kept_text.encode()).hexdigest() == digest
        assert sum(s.end - s.start for s in r.spans) == removed and all(s.end - s.start >= 20 for s in r.spans)
    assert substring.kept_digests(df.limit(0)).count() == 0


def test_substring_repeated_rows_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(30))
    got = sorted((r.doc_id is None, r.doc_id, r.n_removed) for r in substring.kept_digests(docs_of(spark, [text] * 4, [7, 7, None, 9])).collect())
    assert got == [(False, 7, 0), (False, 7, 0), (False, 9, 30), (True, None, 30)]


def test_substring_orders_ids_of_any_type(spark):
    """Strings by their order, null ids last, rows of one id and different texts by digest."""
    say = lambda a, n: " ".join(f"w{i}" for i in range(a, a + n))
    rows = [("b", say(0, 30)), ("a10", say(0, 30)), ("a9", say(100, 25)), (None, say(100, 25)), (None, say(0, 22)), (None, say(200, 25)), (None, say(200, 25)), ("c", None)]
    got = sorted((r.doc_id or "", r.n_words, r.n_removed) for r in substring.kept_digests(spark.createDataFrame(rows, "doc_id string, text string")).collect())
    assert got == [("", 22, 22), ("", 25, 0), ("", 25, 0), ("", 25, 25), ("a10", 30, 0), ("a9", 25, 0), ("b", 30, 30), ("c", 0, 0)]
    texts = [say(0, 30), say(5, 30), say(0, 30)]
    twice = [(7, t) for t in texts] + [(8, say(0, 30))]
    got = [(r.doc_id, r.n_removed) for r in substring.kept_digests(spark.createDataFrame(twice, "doc_id int, text string")).collect()]
    assert sorted(got) in ([(7, 0), (7, 0), (7, 25), (8, 30)], [(7, 0), (7, 25), (7, 25), (8, 30)])


def test_substring_survives_colliding_hashes(spark, odd, monkeypatch):
    """With a window hash of a few values only, the second hash keeps different windows apart: nothing is removed wrongly."""
    whole = textkernel.grams
    monkeypatch.setattr(textkernel, "grams", lambda h, k, base=textkernel.WORD_BASES[0]: whole(h, k, base) & np.uint64(7) if base == textkernel.WORD_BASES[1] else whole(h, k, base))
    docs = list(enumerate(odd[:9] + odd[12:13] + odd[14:24]))
    batch = pa.record_batch([pa.array([i for i, _ in docs]), pa.array([t for _, t in docs])], names=["k", "text"])
    first: dict = {}
    for low, raw, rows in textkernel.chunks(batch.column(1)):
        p = substring.Parsed(raw, rows, 20, 5)
        words = [raw[a:b].tobytes() for a, b in zip(p.words.start, p.words.end)]
        for s, r, h, c, new in zip(p.start, p.row, p.hash, p.check, p.first_here()):
            g = tuple(words[s : s + 20])
            assert first.setdefault((int(h), int(c)), g) == g
            assert new == (not any(tuple(words[x : x + 20]) == g for x, y in zip(p.start, p.row) if y == r and x < s))


# ---- 4


def test_quality_learns_and_scores_all(spark, odd):
    good = ["The quick brown fox jumps over the lazy dog and runs home again." * k for k in range(1, 60)]
    bad = ["$$$ ### | | 12 !! %%%" * k for k in range(1, 60)]
    docs = docs_of(spark, good + bad + odd)
    labels = spark.createDataFrame([(i, int(i < len(good)), 0) for i in range(len(good + bad))] + [(3, None, 0), (None, 1, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert len(rows) == len(good + bad + odd)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for i, r in rows.items())
    held = [r for i, r in rows.items() if r.held_out and i < len(good + bad)]
    assert np.mean([r.predicted == int(r.doc_id < len(good)) for r in held]) > 0.9
    assert {r.score for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(docs.limit(0), labels).count() == 0
    assert set(quality.accepted(docs.withColumn("score", F.lit("x")), labels).columns) == {*docs.columns, "score"}


def plain_statistics(text):
    """``quality.NAMES`` of one text, counted one by one."""
    raw = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    n, size = len(words), len(raw)
    if not n:
        return [0.0] * len(quality.NAMES)
    lengths = [len(x) for x in words]
    mean = sum(lengths) / n
    share = lambda test: sum(map(test, raw)) / size
    other = lambda c: 0x21 <= c < 0x80 and not chr(c).isalnum()
    lines = re.findall(rb"[^\n]*\n|[^\n]+", raw)
    grams = list(zip(words, words[1:], words[2:]))
    out = [math.log1p(n), math.log1p(size), mean, math.sqrt(max(sum(x * x for x in lengths) / n - mean * mean, 0))]
    out += [share(lambda c: 97 <= c <= 122), share(lambda c: 65 <= c <= 90), share(lambda c: 48 <= c <= 57), share(other), share(lambda c: c >= 0x80)]
    count = raw.count(b"\n") + 1
    out += [count / n, size / count, len(set(words)) / n, max(Counter(words).values()) / n, len(set(lines)) / count, 1 - len(set(grams)) / max(len(grams), 1)]
    out += [sum(other(x[-1]) for x in words) / n, sum(x <= 2 for x in lengths) / n, sum(x >= 13 for x in lengths) / n]
    return out + [raw.count(bytes([c])) / n for c in quality._MARKS]


def test_statistics_are_the_plain_ones(odd):
    texts = [t for t in odd if t is None or len(t) < 20_000] + ["a\nb\n\na\n", "x, y. (z) #1 $2 ~~~ é!", "\x7f \x01 a"]
    found = [quality.statistics(raw, rows) for _, raw, rows in textkernel.chunks(pa.array(texts, pa.string()), 3000)]
    assert np.allclose(np.concatenate(found), [plain_statistics(t) for t in texts], rtol=1e-5, atol=1e-6)


def test_trees_are_walked_and_grown_as_plain_ones():
    """Margins node by node, and the first split of the first tree against all cuts tried one by one."""
    rng = np.random.default_rng(7)
    x = np.round(rng.random((300, 4)), 2).astype(np.float32)
    y = (x[:, 2] + rng.normal(0, 0.1, 300) > 0.55).astype(float)
    m = quality.fit(x, y, trees=5)
    for row, got in zip(x[:40], m.margin(x[:40])):
        total = m.base
        for feature, cut, value in zip(m.feature, m.cut, m.value):
            node = 0
            for _ in range(quality.DEPTH):
                node = 2 * node + (2 if row[feature[node]] > cut[node] else 1)
            total += value[node]
        assert got == pytest.approx(total)
    p = (y.sum() + 1) / (len(y) + 2)
    grad, hess = p - y, np.full(len(y), p * (1 - p))
    best = (-1.0, 0, 0.0)
    for f in range(4):
        for c in np.unique(np.quantile(x[:, f], np.linspace(0, 1, quality.BINS + 1)[1:-1])):
            left = x[:, f] <= c
            if quality.LEAST <= left.sum() <= len(y) - quality.LEAST:
                gain = sum(grad[s].sum() ** 2 / (hess[s].sum() + quality.PENALTY) for s in (left, ~left))
                best = max(best, (gain, -f, -c))
    assert (m.feature[0, 0], m.cut[0, 0]) == (-best[1], pytest.approx(-best[2]))


def test_trees_learn_a_rule():
    rng = np.random.default_rng(6)
    x = rng.random((2000, 5)).astype(np.float32)
    y = ((x[:, 1] > 0.4) ^ (x[:, 3] > 0.7)).astype(float)
    m = quality.fit(x[:1500], y[:1500])
    assert ((m.score(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95


# ---- 5


def test_simhash(spark, odd):
    rng = random.Random(9)
    base = [" ".join(rng.choice("abcdefghijklmnop") * 3 for _ in range(120)) for _ in range(5)]
    near = [b.replace(" ", "  ", 3) + f" {t}" for b in base for t in ("", "x", "y z")]
    texts = odd + base + near
    fps = [brute.simhash(t) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    want = brute.components(range(len(texts)), links)
    df = docs_of(spark, texts).withColumn("fp", F.lit("clash"))
    got = {r.doc_id: (r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(df).collect()}
    assert got == {i: (fps[i], want[i]) for i in range(len(texts))}
    kept = simhash.representatives(df.unionByName(df))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values())) and kept.columns == df.columns
    assert simhash.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("segments", [8, 12, 16])
def test_grid_join_finds_all_links(spark, segments):
    rng = random.Random(11)
    fps = {rng.getrandbits(64) for _ in range(150)}
    for f in list(fps):
        fps |= {f ^ (1 << rng.randrange(64)), f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)), f ^ (7 << rng.randrange(61))}
    fps |= {0, 2**64 - 1, 1, 2**63}
    signed = {f: f - 2**64 if f >= 2**63 else f for f in fps}
    df = spark.createDataFrame([(s,) for s in signed.values()], "fp long")
    got = {frozenset((r.u, r.v)) for r in simhash.fingerprint_links(df, 2, segments).collect()}
    assert got == {frozenset((signed[a], signed[b])) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2}


# ---- 6


def test_language(spark):
    rng = random.Random(4)
    voc = {"aa": ["the", "and", "house", "water", "over"], "bb": ["der", "und", "haus", "wasser", "über"], "ru": ["дом", "вода", "это"]}
    texts, langs = [], []
    for i in range(150):
        lang = rng.choice(list(voc))
        langs.append(lang)
        texts.append(" ".join(rng.choice(voc[lang]) for _ in range(rng.randint(5, 60))))
    rows = [(i, t, l) for i, (t, l) in enumerate(zip(texts, langs))] + [(500, None, "aa"), (501, "", None), (502, "123 !!", "bb"), (None, "the house", "aa")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(df).collect()}
    assert all(got[i].lang_pred == langs[i] for i in range(150)) and all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(150))
    assert [got[i].lang_pred for i in (500, 501, 502)] == ["und"] * 3 and all(0 <= r.score <= 1 for r in got.values())
    model = langid.train(df)
    mixed = spark.createDataFrame([(1, "the house over and water the and " * 3 + "der und haus wasser über und " * 3)], "doc_id long, text string")
    spans = langid.spans(mixed, model).first().spans
    assert [(s.lang, s.start, s.end) for s in spans] == [("aa", 0, 21), ("bb", 21, 39)]
    assert {r.lang_pred for r in langid.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify(df.limit(0)).count() == 0


def plain_grams(text):
    """Trigrams of padded words and words by script, letter by letter."""
    grams, scripts, word = Counter(), Counter(), ""
    for c in unicodedata.normalize("NFC", text or "").lower() + " ":
        if unicodedata.category(c)[0] == "L" or (word and unicodedata.category(c)[0] == "M"):
            word += c
        elif word:
            padded = f"^{word}$"
            grams.update(padded[i : i + 3] for i in range(len(word)))
            scripts[next(n for start, n in reversed(langid.SCRIPTS) if ord(word[0]) >= start)] += 1
            word = ""
    return grams, scripts


def plain_language(train, texts):
    """(label, score) of each text, from (text, lang) pairs, word by word and over all paths' best by dynamic programming."""
    langs = sorted({lang for t, lang in train if plain_grams(t)[0]})
    seen = {lang: (Counter(), Counter()) for lang in langs}
    for t, lang in train:
        for total, new in zip(seen.get(lang, (Counter(), Counter())), plain_grams(t), strict=True):
            total.update(new)
    kinds = max(len(g) for g, _ in seen.values()) + 1
    out = []
    for t in texts:
        rows = []
        for word in re.findall(r"\S+", "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in unicodedata.normalize("NFC", t or "").lower())):
            grams, scripts = plain_grams(word)
            if not grams:
                continue
            script = next(iter(scripts))
            may = {lang for lang in langs if seen[lang][1][script] and seen[lang][1][script] >= langid.MIN_SHARE * sum(seen[lang][1].values())}
            s = {lang: sum(n * math.log((seen[lang][0][g] + 0.5) / (sum(seen[lang][0].values()) + 0.5 * kinds)) for g, n in grams.items()) for lang in langs}
            low = min(s.values())
            s = {lang: (s[lang] if lang in may else low - langid.PENALTY) if may else 0.0 for lang in langs}
            rows.append((s, sum(grams.values()), bool(may)))
        if not rows:
            out.append(("und", 0.0))
            continue
        value, back = {lang: rows[0][0][lang] for lang in langs}, []
        for s, _, _ in rows[1:]:
            top = max(langs, key=lambda x: (value[x], [-ord(c) for c in x]))
            back.append({x: x if value[x] >= value[top] - langid.PENALTY else top for x in langs})
            value = {x: max(value[x], value[top] - langid.PENALTY) + s[x] for x in langs}
        path = [max(langs, key=lambda x: (value[x], [-ord(c) for c in x]))]
        for b in reversed(back):
            path.insert(0, b[path[0]])
        share = Counter()
        for lang, (_, n, known) in zip(path, rows, strict=True):
            share[lang] += n * known
        best = max(langs, key=lambda x: (share[x], [-ord(c) for c in x]))
        post = [n / sum(math.exp(v - s[best]) for v in s.values()) if known else 0.0 for s, n, known in rows]
        out.append((best, sum(post) / sum(n for _, n, _ in rows)))
    return out


def test_language_is_the_plain_version(spark):
    """Counts, labels and scores over the documents, and texts of other scripts, mixed languages, marks and few letters."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.substring("text", 1, 700).alias("text"), "lang")
    odd = [None, "", "123", "Ελληνικά και άλλα", "漢字", "a", "the e\u0301 \u0301x", "the of and Ελληνικά the", "und der die und der nicht the of and of the and de la les des que dans"]
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()] + [(100_000 + i, t, None) for i, t in enumerate(odd)]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    train = [(t, lang) for i, t, lang in rows if lang is not None and zlib.crc32(str(i).encode()) % 3 != 1]
    want = plain_language(train, [t for _, t, _ in rows])
    assert [got[i].lang_pred for i, _, _ in rows] == [w[0] for w in want]
    assert [got[i].score for i, _, _ in rows] == pytest.approx([w[1] for w in want], abs=1e-6)
    assert [got[100_000 + i].score for i in range(5)] == [0.0] * 5 and got[100_003].lang_pred in {"de", "en", "es", "fr"}


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.identify(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").where("lang is not null").collect()
    assert len(rows) > 300 and np.mean([r.lang_pred == r.lang for r in rows]) > 0.99


def test_language_learns_all(spark):
    """Over 2,000 documents and 30,000 grams of a language, and over 1,000 languages."""
    schema = "doc_id long, text string, lang string"
    ids = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 3 != 1]
    rng = np.random.default_rng(2)
    letters = "".join(chr(0xAC00 + c) for c in rng.integers(0, 11_000, 40_000))
    model = langid.train(spark.createDataFrame([(i, chr(0x4E00 + i), "zh") for i in ids] + [(ids[0], letters, "ko")], schema))
    padded = f"^{letters}$"
    assert 2_000 < len(ids) < langid.MAX_TRAIN and model.langs == ["ko", "zh"]
    assert model.size == len(ids) + len({padded[i : i + 3] for i in range(len(letters))}) > 30_000 + len(ids)
    assert len(langid.train(spark.createDataFrame([(i, "a", f"l{i}") for i in ids[:1001]], schema)).langs) == 1001


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(8)
    for _ in range(60):
        s = rng.normal(size=(rng.integers(1, 7), 3)) * 3
        path = langid.best_path(s, 2.0)
        value = lambda p: sum(s[i, x] for i, x in enumerate(p)) - 2 * sum(a != b for a, b in zip(p, p[1:]))  # noqa: B023, E731
        best = max(value(p) for p in np.ndindex(*[3] * len(s)))
        assert value(path.tolist()) == pytest.approx(best)


# ---- 7


def test_fixity(spark):
    pages = spark.createDataFrame([(i, f"http://x/{i}", "x" * (i % 50)) for i in range(300)] + [(7, "http://x/7", "dup"), (None, None, None)], "page_id long, url string, html string")
    same = warc.audit_pages(pages, pages.repartition(3))
    assert same.count() == 0
    body = F.when(F.col("page_id") % 41 == 0, F.concat("html", F.lit("!"))).otherwise(F.col("html"))
    got = [(r.id, r.status) for r in warc.audit_pages(pages, pages.withColumn("html", body)).collect()]
    assert sorted(got) == [(i, "changed") for i in range(0, 300, 41)]
    lost = warc.audit_pages(pages, pages.where("page_id is not null")).collect()
    assert [(r.id, r.status) for r in lost] == [(None, "lost")]
    assert warc.audit_pages(pages.limit(0), pages.limit(0)).count() == 0
    assert {r.status for r in warc.audit_pages(pages, pages.limit(0)).collect()} == {"lost"} and warc.audit_pages(pages.limit(0), pages).count() == 302


def test_fixity_localises_each_kind(spark):
    """One lost, one added, one changed and one moved record give these rows and no others, and few ranges are read."""
    rows = [(i, f"http://x/{i}", f"body {i}", float(i)) for i in range(3000)]
    a = spark.createDataFrame(rows, "page_id long, url string, html string, file_order double")
    changed = {700: (700, "http://x/700", "other", 700.0), 1500: (1500, "http://x/1500", "body 1500", 1690.5)}
    b = [changed.get(r[0], r) for r in rows if r[0] != 40] + [(2500, "http://x/2500", "new", 2500.0)]
    b = spark.createDataFrame(b, a.schema)
    got = warc.audit_pages(a, b, order_col="file_order").collect()
    assert sorted((r.id, r.status, r.copies) for r in got) == [(40, "lost", 1), (700, "changed", 1), (1500, "moved", 1), (2500, "added", 1)]
    moved = next(r for r in got if r.status == "moved")
    assert moved.digest_a == moved.digest_b and moved.offset_b > moved.offset_a
    x, y = (warc._rows(t, "page_id", "url", "html", "file_order", 2048) for t in (a, b))
    parts = warc.parts_of(2048, x, y)
    assert warc.suspects(warc.tree(warc._laid_out(x, parts)), warc.tree(warc._laid_out(y, parts))).count() <= 12


def test_fixity_of_copies_and_repeated_ids(spark):
    """Copies are one row with their number; records of one id are paired by digest; null ids are never changed; extra columns stay out."""
    rows = [(1, "u", "same")] * 5 + [(2, "u", "a"), (2, "u", "b"), (2, "u", "c"), (None, "u", "x"), (None, "u", "y")] + [(i, "u", None) for i in range(10, 40)]
    a = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, place int")
    b = [(1, "u", "same")] * 3 + [(2, "u", "a"), (2, "u", "d"), (None, "u", "x"), (None, "u", "z")] + [(i, "u", None) for i in range(10, 40)]
    b = spark.createDataFrame([(*r, 1) for r in b], a.schema)
    got = sorted((r.id or 0, r.status, r.copies) for r in warc.audit_pages(a, b).collect())
    assert got == [(0, "added", 1), (0, "lost", 1), (1, "lost", 2), (2, "changed", 1), (2, "lost", 1)]


def test_fixity_of_crowded_ranges(spark):
    """Ranges beyond twice their size are split alike in both replicas, and damage is found in each part."""
    a = spark.createDataFrame([(i % 3 if i % 2 else None, "u", f"b{i}") for i in range(600)], "page_id long, url string, html string")
    b = a.where("html not in ('b10', 'b11')").unionByName(a.where("html = 'b12'"))
    got = sorted((r.id is None, r.status, r.copies) for r in warc.audit_pages(a, b, size=16).collect())
    assert got == [(False, "lost", 1), (True, "added", 1), (True, "lost", 1)]
    assert warc.leaves(a, size=16).groupBy("archive").count().agg(F.max("count")).first()[0] < 80


def test_longest_order():
    rng = random.Random(2)
    for _ in range(200):
        p = rng.sample(range(50), rng.randint(0, 9))
        out = warc._outside_order(p)
        kept = [x for i, x in enumerate(p) if i not in out]
        best = max((len(s) for n in range(2 ** len(p)) if (s := [x for i, x in enumerate(p) if n >> i & 1]) == sorted(s)), default=0)
        assert kept == sorted(kept) and len(kept) == best


def test_offsets_are_those_of_the_file(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://x/{i}", "<p>é\r\n\r\n" * i) for i in range(20)], "page_id long, url string, html string")
    rows = {r.id: r for r in warc.leaves(pages).collect()}
    texts = [r.t for r in pages.select("page_id", warc.record(F.col("page_id"), F.col("url"), F.col("html")).alias("t")).orderBy("page_id").collect()]
    whole = "".join(texts).encode()
    (tmp_path / "a.warc").write_bytes(whole)
    parsed = warc.read(spark, str(tmp_path)).orderBy("offset").collect()
    assert [(p.offset, p.length) for p in parsed] == [(rows[i].offset, rows[i].length) for i in range(20)]
    for r in rows.values():
        assert hashlib.sha256(whole[r.offset : r.offset + r.length]).hexdigest() == r.digest
    assert parsed[3].payload.decode() == "<p>é\r\n\r\n" * 3
    with pytest.raises(ValueError):
        warc.parse(whole[:-3])


# ---- 8


def overlap(docs, items, window=10):
    import re

    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(brute.UPPER))
    index = {}
    for i, t in items:
        w = split(t)
        n = min(len(w), window)
        for s in range(len(w) - n + 1 if n else 0):
            index.setdefault(tuple(w[s : s + n]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, found = split(t), set(), set()
        for n in {len(g) for g in index}:
            for s in range(len(w) - n + 1):
                if (of := index.get(tuple(w[s : s + n]))) is not None:
                    hit.update(range(s, s + n))
                    found |= of
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def test_decontamination(spark):
    rng = random.Random(3)
    voc = ["alpha", "Beta", "gamma", "Élan", "élan", "d3", "über", "e"]
    say = lambda n: " ".join(rng.choice(voc) for _ in range(n))
    items = [(i, say(rng.randint(10, 40))) for i in range(6)] + [(10, "one short item"), (11, "Unique"), (12, ""), (13, None), (2, say(15)), (14, "same same same same same same same same same same same")]
    texts = [None, "", "x", items[0][1], f"a {items[1][1].upper()} b", items[2][1].replace(" ", "--"), "One, short: ITEM!", "unique", "same " * 40, items[3][1][:-1], f"{items[4][1]} {items[4][1]}", "z " * 3000 + items[5][1], say(4000)]
    df = docs_of(spark, texts + texts[3:5])
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = overlap(list(enumerate(texts + texts[3:5])), items)
    got = sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.overlaps(df, bench).collect())
    assert got == want
    assert {r.n_hit for r in decontaminate.overlaps(df, bench.limit(0)).collect()} == {0}
    assert decontaminate.overlaps(df.limit(0), bench).count() == 0
    assert sorted(r.doc_id for r in decontaminate.clean(df, bench).collect()) == [w[0] for w in want if not w[5]]


def test_decontamination_beyond_the_broadcast(spark, monkeypatch):
    """The shuffled branch gives the rows of the broadcast one and of the plain version, with a text of 20,000 words and a common gram."""
    rng = random.Random(13)
    say = lambda n, voc: " ".join(rng.choice(voc) for _ in range(n))
    few, many = ["a", "b", "c"], [f"w{i}" for i in range(3000)]
    items = [(f"i{k}", say(rng.randint(1, 30), many if k % 2 else few)) for k in range(30)]
    items += [("long", say(20_000, many))]
    texts = ["no", None, "", items[-1][1], f"{items[1][1]} x {items[2][1]}", say(400, few)] + [f"{say(20, many)} {items[k][1]} {say(5, few)}" for k in range(20)]
    df, bench = docs_of(spark, texts + texts[3:6]), spark.createDataFrame(items, "item_id string, text string")
    want = overlap(list(enumerate(texts + texts[3:6])), items)
    for bound in (-1, 10**6):
        monkeypatch.setattr(decontaminate, "MAX_BROADCAST", bound)
        got = decontaminate.overlaps(df, bench).collect()
        assert sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == want
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST", -1)
    assert sorted(r.doc_id for r in decontaminate.clean(df, bench).collect()) == [w[0] for w in want if not w[5]]


# ---- 9


def test_pii_base(spark, odd):
    texts = ["a@b.c.d@e.f x_y@z.co.", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.255 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112 5 55", "+1 (132) 555-1352 +12 +1.2.3.4.5.6.7.8.9", "é+44 20 7946 0958é a@é.com ü@x.de", "@" * 500, "+" * 500 + "1" * 500, "9" * 50_000, "1 " * 20_000, "a" * 50_000 + "@b.c"]
    texts = texts + [t for t in odd if t is None or len(t) < 5000]
    got = {r.doc_id: r for r in pii.find(docs_of(spark, texts).withColumn("spans", F.lit(1))).collect()}
    for i, t in enumerate(texts):
        want = brute.pii(t)
        assert tuple(got[i][f"n_{k}"] for k in brute.KINDS) == tuple(len(want[k]) for k in brute.KINDS), t
        assert got[i].base_sha256 == brute.pii_digest(want)
        assert {f"{k}:{a}:{b}" for k in brute.KINDS for a, b in want[k]} <= set(filter(None, got[i].spans.split(",")))
    assert pii.find(docs_of(spark, ["x"]).limit(0)).count() == 0


def added(spans, base):
    return {tuple([k, int(a), int(b)]) for k, a, b in (x.split(":") for x in filter(None, spans.split(",")))} - {(k, a, b) for k in base for a, b in base[k]}


def test_pii_discovers_new_forms(spark):
    """Identifiers that no expression and no seed's shape covers, by their surroundings alone; other numbers stay."""
    seeds = [f"mail: user{i}@host.com please" for i in range(10000, 10030)] + [f"tel: +4930{i} ring" for i in range(1000000, 1000030)] + [f"from ip: 10.20.30.{i} came" for i in range(30)]
    new = ["mail: user77777(at)host.com please", "tel: 00493012345678 ring", "tel: 030-123456789 ring", "from ip: 10.20.30.999 came"]
    clean = ["the price: 12345 is fine", "in 1999 there were 300 of them", "room 10.20 at noon", "tel: 12 ring"]
    texts = seeds + new + clean
    got = {r.doc_id: r for r in pii.find(docs_of(spark, texts)).collect()}
    assert [got[len(seeds) + i].spans for i in range(4)] == ["email:6:27", "phone:5:19", "phone:5:18", "ip:9:21"]
    assert all(got[len(seeds) + 4 + i].spans == "" for i in range(4))
    assert sum(r.n_added for r in got.values()) == 4 and all(r.n_added == 0 for i, r in got.items() if i < len(seeds))
    clean_texts = {r.doc_id: r.text for r in pii.redacted(docs_of(spark, texts)).collect()}
    assert [clean_texts[len(seeds) + i] for i in range(4)] == ["mail: [email] please", "tel: [phone] ring", "tel: [phone] ring", "from ip: [ip] came"]
    assert all(clean_texts[len(seeds) + 4 + i] == t for i, t in enumerate(clean))


def test_pii_is_the_plain_version(spark):
    """Random sentences of few cue words, so that patterns of every kind and score occur, and raise one another."""
    rng = random.Random(21)

    def one(kind):
        d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
        card = next(c for c in iter(lambda: "4" + d(15), None) if brute.luhn(c))
        return {"email": f"u{d(3)}@h.com", "ip": f"10.0.{rng.randint(0, 255)}.{rng.randint(0, 255)}", "card": rng.choice([card, f"{card[:4]} {card[4:8]} {card[8:12]} {card[12:]}"]), "phone": f"+49 ({d(3)}) {d(6)}", "odd": rng.choice([f"u{d(3)}(at)h.com", f"0049{d(8)}", "4" + d(15), f"300.{d(3)}.1.1", d(rng.randint(1, 5)), f"{d(4)} {d(4)} {d(4)}"])}[kind]

    texts = []
    for _ in range(700):
        kind = rng.choice(["email", "ip", "card", "phone"])
        cue = rng.choice([f"{kind}:", f"{kind}:", f"my {kind}", "the", "see"])
        texts.append(f"{rng.choice(['', 'well', 'a 7'])} {cue} {one(rng.choices([kind, 'odd', 'email'], [20, 2, 0.3])[0])} {rng.choice(['', 'now', 'or then', '8 x'])}")
    texts += [None, "", "x", texts[3], texts[3]]
    want = brute.pii_added([t or "" for t in texts])
    got = {r.doc_id: r for r in pii.find(docs_of(spark, texts)).collect()}
    assert {i: added(got[i].spans, brute.pii(t)) for i, t in enumerate(texts)} == dict(enumerate(want))
    assert 15 < sum(map(len, want)) == sum(r.n_added for r in got.values())
    assert {k for x in want for k, _, _ in x} == {"email", "ip", "card", "phone"}
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": range(len(texts)), "text": pd.Series(texts, dtype=object)}))
    cols = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"]
    told = con.execute(f"SELECT {', '.join(cols)} FROM ({queries.ORACLE['op9_pii']})").fetchall()
    assert sorted(told) == sorted(tuple(r[c] for c in cols) for r in got.values())


def test_pii_of_the_documents_is_the_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.collect()
    got = {r.doc_id: r for r in pii.find(docs).collect()}
    want = brute.pii_added([r.text or "" for r in rows])
    for r, w in zip(rows, want, strict=True):
        base = brute.pii(r.text)
        assert got[r.doc_id].base_sha256 == brute.pii_digest(base) and added(got[r.doc_id].spans, base) == w


def test_pii_below_the_bar_adds_nothing(spark):
    """Eight seeds in ten instances are not enough, whatever the rounds; nor are four seeds of four."""
    texts = [f"ring +1555010{i} now" for i in range(1000, 1008)] + ["ring 15550101001 now", "ring 15550101002 now"] + [f"dial +1555020{i} now" for i in range(1000, 1004)] + ["dial 15550201009 soon"]
    assert {r.n_added for r in pii.find(docs_of(spark, texts)).collect()} == {0}


def test_pii_discovers_by_context(spark):
    good = ["4111111111111111", "5500005555555559", "4012888888881881", "5105105105105100", "4222222222222220", "6011111111111117", "3530111333300000", "4000056655665556", "5200828282828210", "4242424242424242"]
    good = [c for c in good if brute.luhn(c)]
    texts = [f"visa {c} paid" for c in good] + ["visa 4111111111111112 paid", "order 4111111111111112 sent"]
    got = {r.doc_id: r for r in pii.find(docs_of(spark, texts)).collect()}
    assert len(good) >= 9 and got[len(good)].spans == "card:5:21" and got[len(good)].n_card == 0 and got[len(good)].n_added == 1
    assert got[len(good) + 1].spans == ""
    clean = {r.doc_id: r.text for r in pii.redacted(docs_of(spark, texts)).collect()}
    assert clean[0] == "visa [card] paid" and clean[len(good)] == "visa [card] paid" and clean[len(good) + 1] == texts[-1]


def test_pii_seeds_are_whole_spans(spark):
    """Seeds of several words, of few digits and of none, after a word of any length; and candidates of several words."""
    long = "x" * 90
    good = [f"4{i:03d} 1111 1111 11" for i in range(100, 112)]
    good = [f"{c}{next(d for d in range(10, 100) if brute.luhn(f'{c}{d}'.replace(' ', '')))}" for c in good]
    texts = [f"paid {c} today" for c in good] + [f"ring +1 ({i}) 555-7713 now" for i in range(100, 112)] + [f"write {a}nn@mail.example.com soon" for a in "abcdefgh"] + [f"{long} 10.0.0.{i} up" for i in range(8)]
    found = pii.bootstrap(pii._instances(pii.scan(docs_of(spark, texts), ["doc_id"])))
    assert {(r.pattern, r.kind) for r in found.where("pattern like 'S %'").collect()} == {("S paid 9 9 9 9", "card"), ("S ring +9 (9) 9-9", "phone"), ("S write a@a.a.a", "email"), (f"S {long} 9.9.9.9", "ip")}
    bad = next(f"4111 1111 1111 11{d}" for d in range(10, 100) if not brute.luhn(f"41111111111111{d}"))
    got = {r.doc_id: r for r in pii.find(docs_of(spark, [*texts, f"paid {bad} today", f"order {bad} tonight"])).collect()}
    assert (got[len(texts)].spans, got[len(texts)].n_added, got[len(texts) + 1].spans) == ("card:5:24", 1, "")


def test_pii_many_matches_in_a_text(spark):
    """Folds and look-ups run over slices, so thousands of spans and candidates in one text take seconds."""
    text = " ".join(f"a{i}@b.cd {i} +49 30 {i:07d} x" for i in range(1200))
    r = pii.find(docs_of(spark, [text])).first()
    want = brute.pii(text)
    assert (r.n_email, r.n_phone) == (1200, 1200) and r.base_sha256 == brute.pii_digest(want)
    assert pii.redacted(docs_of(spark, [text])).first().text.startswith("[email] 0 [phone] x [email] 1 [phone] x")


def test_redaction(spark):
    texts = [None, "", "é a@b.cd, 1.2.3.4 é", "+1 (132) 555-1352", "+1.2.3.4.5678901 a@b.c"]
    got = [r.text for r in pii.redacted(docs_of(spark, texts)).orderBy("doc_id").collect()]
    assert got[:4] == [None, "", "é [email], [ip] é", "[phone]"] and got[4].endswith(" [email]") and "2.3" not in got[4]


# ---- 10


def fill(budget, children):
    """children: name -> (weight, room); budgets in turn, the full ones first."""
    given, open_ = {}, {c: w for c, (w, _) in children.items() if w > 0}
    while open_:
        level = budget / sum(open_.values())
        full = [c for c in open_ if children[c][1] <= level * open_[c]]
        if not full:
            return given | {c: int(round(level * w, 6)) for c, w in open_.items()}
        for c in full:
            given[c] = children[c][1]
            budget -= children[c][1]
            del open_[c]
    return given


def plain_mix(rows, share):
    """(id, epoch) of the rows (id, text, lang, source) chosen, leaf by leaf."""
    domain = lambda s: "core" if hashlib.md5(s.encode()).hexdigest()[0] < "8" else "wide"
    leaf = {}
    for i, t, lang, s in rows:
        leaf.setdefault((domain(s or "(null)"), lang or "(null)", s or "(null)"), []).append((i, len((t or "").encode().split())))
    room = {k: 2 * sum(n for _, n in v) for k, v in leaf.items()}
    budget = int(sum(room.values()) / 2 * share)
    sub = lambda pre: sum(n for k, n in room.items() if k[: len(pre)] == pre)
    want = []
    doms = fill(budget, {d: (mixing.DOMAIN_WEIGHTS[d], sub((d,))) for d in {k[0] for k in leaf}})
    for d, b in doms.items():
        for lang, c in fill(b, {x: (1, sub((d, x))) for x in {k[1] for k in leaf if k[0] == d}}).items():
            for s, given in fill(c, {x: (1, room[(d, lang, x)]) for x in {k[2] for k in leaf if k[:2] == (d, lang)}}).items():
                docs = leaf[(d, lang, s)]
                total = sum(n for _, n in docs)
                whole = given // total if total else 0
                want += [(i, e) for i, _ in docs for e in range(1, whole + 1)]
                left = given - whole * total
                key = lambda i: hashlib.md5(f"{mixing.SEED}:{whole + 1}:{'' if i is None else i}".encode()).hexdigest()  # noqa: B023, E731
                used = 0
                for i, n in sorted(docs, key=lambda x: (key(x[0]), x[1])):
                    used += n
                    if used > left or left <= 0:
                        break
                    want.append((i, whole + 1))
    return want


def test_mixing(spark):
    rng = random.Random(12)
    rows = [(i, " ".join(["w"] * rng.randint(0, 30)), rng.choice(["en", "de", None]), f"s{rng.choice([0, 0, 0, 1, 2, 3, 4])}", 1) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, epoch int")
    got = mixing.mix(df, share=0.6).collect()
    assert sorted((r.doc_id, r.epoch) for r in got) == sorted(plain_mix([r[:4] for r in rows], 0.6))
    assert mixing.mix(df.limit(0)).count() == 0
    zero = mixing.mix(df, weights=spark.createDataFrame([("core", 0.0)], "path string, weight double"))
    assert {r.domain for r in zero.collect()} == {"wide"}


def test_mixing_of_nulls_and_repeated_ids(spark):
    """Null texts have no tokens; null and repeated ids share a place in the order and come by tokens; null sources are one node."""
    rng = random.Random(3)
    rows = [(rng.choice([None, 1, 2, 3, i]), None if i % 9 == 0 else " ".join(["w"] * rng.randint(1, 9)), "en", rng.choice([None, "a", "b"])) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mixing.mix(df, share=0.4).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.epoch) for r in got) == sorted((i is None, i or 0, e) for i, e in plain_mix(rows, 0.4))
    assert {r.source for r in got} <= {None, "a", "b"}


# ---- pipeline


def test_stages_meet_odd_documents(spark, odd, tmp_path):
    """Null ids, languages and sources, repeated rows, clashing names and empty tables go through every stage."""
    import corpus_pipeline

    names = "doc_id long, text string, lang string, source string, n_chars long, __d int, __t int, __k int, __salt int, domain string, __digest string, __KEY string, __found string, __of string"
    rows = [(i if i % 5 else None, t, "en" if i % 3 else None, "s" if i % 4 else None, None, 1, 2, 3, 4, "d", "e", "f", "g", "h") for i, t in enumerate(odd)]
    docs = spark.createDataFrame(rows + rows[5:9], names).repartition(3)
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([("a", odd[14]), (None, "x"), ("b", None)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for part in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            got = stage(spark, part, str(tmp_path))
            assert got.columns == docs.columns, name
            assert (got.count() > 0) == (part is docs), name
        got = corpus_pipeline.STAGES[-1][1](spark, part, str(tmp_path))
        assert set(got.columns) >= {"doc_id", "text", "lang", "source", "epoch", "n_tokens", "domain", "doc_domain"} and (got.count() > 0) == (part is docs)


def test_pipeline_is_the_plain_version(spark):
    """Every stage's decisions, and the rows of the whole, against plain versions of stages two to five fed with what the classifier keeps."""
    import corpus_pipeline

    first = corpus_pipeline.quality_classifier(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).collect()
    scores = {r.doc_id: r.score for r in quality.classify(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert {r.doc_id for r in first} == {i for i, x in scores.items() if x >= 0.3}
    fps = {r.doc_id: brute.simhash(r.text) for r in first}
    ids = sorted(fps)
    comp = brute.components(ids, [(a, b) for a in ids for b in ids if a < b and (fps[a] ^ fps[b]).bit_count() <= 2])
    kept = [r for r in first if comp[r.doc_id] == r.doc_id]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = {d for d, *_, bad in overlap([(r.doc_id, r.text) for r in kept], items) if bad}
    clean = [r for r in kept if r.doc_id not in hit]
    more = brute.pii_added([r.text or "" for r in clean])
    texts = {r.doc_id: brute.redacted(r.text, {(k, a, b) for k, found in brute.pii(r.text).items() for a, b in found} | m) for r, m in zip(clean, more, strict=True)}
    run = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in run} <= set(texts) and all(r.text == texts[r.doc_id] and r.n_chars == len(r.text) for r in run)
    want = plain_mix([(r.doc_id, texts[r.doc_id], r.lang, r.source) for r in clean], mixing.SHARE)
    assert sorted((r.doc_id, r.epoch) for r in run) == sorted(want) and 0 < len(hit) < len(kept) < len(first)
