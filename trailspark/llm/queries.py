"""The queries of this package, each over its whole table, and SQL for those that it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailspark.llm import decontaminate, embeddings, langid, mixing, pii, quality, simhash, substring, urlfilter, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(_table(spark, sf_dir, "pages"), urlfilter.rule_table(spark))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.kept_digests(_table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op7_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of the pages' archives against a replica with planted damage of all four kinds."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc.audit_pages(pages, warc.damaged(pages), order_col="file_order").withColumnRenamed("id", "page_id")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_embedding_dedup, op3_substring_dedup, op4_quality, op5_simhash, op6_language, op7_warc_fixity, op8_decontaminate, op9_pii, op10_mixing)}

def _filled(source: str, out: str, parent: str, child: str) -> str:
    """Water filling: ``out`` is ``source`` (with weight, room and the parent's budget) with ``given``."""
    before = f"(PARTITION BY {parent} ORDER BY room / weight, {child} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""{out}_a AS (SELECT *, coalesce(sum(room) OVER {before}, 0) AS full_, sum(weight) OVER (PARTITION BY {parent}) - coalesce(sum(weight) OVER {before}, 0) AS left_ FROM {source}),
{out}_b AS (SELECT *, max(CASE WHEN (budget - full_) / left_ <= room / weight THEN (budget - full_) / left_ END) OVER (PARTITION BY {parent}) AS level FROM {out}_a),
{out} AS (SELECT * EXCLUDE (level, full_, left_), CASE WHEN level IS NULL THEN room ELSE least(room, floor(round(level * weight, 6))) END::BIGINT AS given FROM {out}_b)"""


#: The contract's expressions.
_KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _pii_sql() -> str:
    """Base spans, instances, patterns and the rounds of the bootstrap, over rows instead of arrays."""

    def found(source: str, pattern: str) -> str:
        return f"""SELECT rid, i, v, (sum(length(g) + length(v)) OVER (PARTITION BY rid ORDER BY i) - length(v))::BIGINT AS a, sum(length(g) + length(v)) OVER (PARTITION BY rid ORDER BY i)::BIGINT AS b
  FROM (SELECT rid, unnest(m) AS v, unnest(s[1:len(m)]) AS g, unnest(range(len(m))) AS i FROM (SELECT rid, regexp_extract_all(t, '{pattern}', 0) AS m, regexp_split_to_array(t, '{pattern}') AS s FROM {source}))"""

    digits = "regexp_replace(v, '[^0-9]', '', 'g')"
    checks = {
        "email": "true",
        "ip": "len(list_filter(string_split(v, '.'), lambda p: length(ltrim(p, '0')) > 3 OR (length(ltrim(p, '0')) = 3 AND ltrim(p, '0') > '255'))) = 0",
        "card": f"length({digits}) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length({digits}) + 1), lambda j: CASE WHEN j % 2 = 1 THEN {digits}[length({digits}) - j + 1]::INT WHEN {digits}[length({digits}) - j + 1]::INT > 4 THEN {digits}[length({digits}) - j + 1]::INT * 2 - 9 ELSE {digits}[length({digits}) - j + 1]::INT * 2 END)) % 10 = 0",
        "phone": f"length({digits}) BETWEEN 9 AND 15",
    }
    base = " UNION ALL ".join(f"SELECT rid, a, b, '{k}' AS kind, {n} AS place FROM ({found('h', _KINDS[k])}) WHERE {checks[k]}" for n, k in enumerate(pii.KINDS))
    count = "length(regexp_replace(v, '[^0-9]', '', 'g'))"
    rough = f"CASE WHEN regexp_matches(v, '\\p{{L}}') THEN 'a' ELSE '' END || CASE WHEN {count} = 0 THEN '' WHEN {count} < 5 THEN '9' WHEN {count} < 9 THEN '99' ELSE '999' END"
    shape = "regexp_replace(regexp_replace(v, '[0-9]+', '9', 'g'), '\\p{L}+', 'a', 'g')"
    rounds = ""
    for n in range(1, pii.ROUNDS + 1):
        rounds += f""",
ac{n} AS (SELECT st.p, st.kind, round(sum(score) / any_value(n), 9) AS score FROM st JOIN sz USING (p) JOIN lk USING (p) JOIN lb{n - 1} lb ON lb.v = lk.v AND lb.kind = st.kind GROUP BY ALL HAVING round(sum(score) / any_value(n), 9) >= {pii.MIN_SCORE}),
lb{n} AS (FROM lb0 UNION ALL SELECT lk.v, ac.kind, max(ac.score) FROM lk JOIN ac{n} ac USING (p) WHERE lk.v NOT IN (SELECT v FROM lb0) GROUP BY ALL)"""
    places = "CASE kind " + " ".join(f"WHEN '{k}' THEN {n}" for n, k in enumerate(pii.KINDS)) + " END"
    named = "kind || ':' || a || ':' || b"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents), h AS (SELECT min(rid) AS rid, t FROM d WHERE regexp_matches(t, '[0-9@]') GROUP BY t),
bs AS ({base}),
w AS (SELECT rid, i, v, a, b, lower(coalesce(lag(v) OVER x, '^')) AS l, lower(coalesce(lead(v) OVER x, '$')) AS r FROM ({found('h', '[^' + chr(92) + 'x20' + chr(92) + 'x09-' + chr(92) + 'x0D]+')}) WINDOW x AS (PARTITION BY rid ORDER BY i)),
hw AS (SELECT * FROM w WHERE regexp_matches(v, '[0-9@]')),
fr AS (SELECT *, i - row_number() OVER (PARTITION BY rid ORDER BY i) AS run FROM hw WHERE NOT EXISTS (SELECT 1 FROM bs WHERE bs.rid = hw.rid AND bs.a < hw.b AND bs.b > hw.a)),
ins AS (
  SELECT x.rid, x.a, y.b, substring(t, x.a + 1, y.b - x.a) AS v, x.l, y.r, bs.kind FROM bs JOIN hw x ON x.rid = bs.rid AND x.a <= bs.a AND bs.a < x.b JOIN hw y ON y.rid = bs.rid AND y.a < bs.b AND bs.b <= y.b JOIN h ON h.rid = bs.rid
  UNION ALL SELECT rid, a, b, v, l, r, NULL FROM fr
  UNION ALL SELECT rid, min(a), max(b), string_agg(v, ' ' ORDER BY i), arg_min(l, i), arg_max(r, i), NULL FROM fr GROUP BY rid, run HAVING count(*) > 1),
pt AS (SELECT rid, a, b, v, kind, unnest(['L ' || l || ' ' || {rough}, 'B ' || l || ' ' || {rough} || ' ' || r, 'S ' || l || ' ' || {shape}, 'R ' || {shape} || ' ' || r]) AS p FROM ins),
st AS (SELECT p, kind FROM pt WHERE kind IS NOT NULL GROUP BY p, kind HAVING count(DISTINCT v) >= {pii.MIN_SEEDS}),
lk AS (SELECT DISTINCT p, v FROM pt WHERE p IN (SELECT p FROM st)), sz AS (SELECT p, count(*) AS n FROM lk GROUP BY p),
lb0 AS (SELECT DISTINCT v, kind, 1.0::DOUBLE AS score FROM pt WHERE kind IS NOT NULL){rounds},
ch AS (SELECT p, arg_max(kind, {{'s': score, 'p': -{places}}}) AS kind, max(score) AS score FROM ac{pii.ROUNDS} GROUP BY p),
ad AS (SELECT rid, a, b, arg_max(ch.kind, {{'s': score, 'p': -{places.replace('kind', 'ch.kind')}}}) AS kind FROM pt JOIN ch USING (p) WHERE pt.kind IS NULL GROUP BY rid, a, b),
ax AS (SELECT rid, a, b, kind, {places} AS place FROM ad WHERE NOT EXISTS (SELECT 1 FROM ad o WHERE o.rid = ad.rid AND o.a <= ad.a AND o.b >= ad.b AND (o.a <> ad.a OR o.b <> ad.b))),
sb AS (SELECT rid, {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in pii.KINDS)}, string_agg({named}, ',' ORDER BY place, a) AS base FROM bs GROUP BY rid),
sa AS (SELECT rid, string_agg({named}, ',' ORDER BY place, a, b) AS spans, count(*) FILTER (added) AS n_added FROM (SELECT *, false AS added FROM bs UNION ALL SELECT *, true FROM ax) GROUP BY rid)
SELECT doc_id, {', '.join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in pii.KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_added, 0)::BIGINT AS n_added
FROM d LEFT JOIN h USING (t) LEFT JOIN sb ON sb.rid = h.rid LEFT JOIN sa ON sa.rid = h.rid"""


_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in urlfilter.RULES)

ORACLE = {
    "op1_url_filter": f"""
WITH rules(rh, rp, says) AS (VALUES {_RULES}),
parts AS (
  SELECT row_number() OVER () AS rid, page_id,
    translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), '{urlfilter.UPPER}', '{urlfilter.LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
best AS (
  SELECT rid, arg_max(rh || rp, length(rh || rp) * 1000 + length(rh)) AS rule, arg_max(says, length(rh || rp) * 1000 + length(rh)) AS says
  FROM parts JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY rid)
SELECT page_id, host, path, rule, coalesce(says, 'allow') AS verdict FROM parts LEFT JOIN best USING (rid)""",
    "op2_embedding_dedup": f"""
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS rid, vec_id, label, embedding::DOUBLE[] AS e,
    coalesce(label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false) AS ok
  FROM embeddings),
n AS (SELECT *, sqrt(list_inner_product(e, e)) AS size FROM v WHERE ok),
links AS (
  SELECT a.rid AS a, b.rid AS b FROM n a JOIN n b ON a.label = b.label AND a.rid <> b.rid AND len(a.e) = len(b.e)
  WHERE list_inner_product(a.e, b.e) / (a.size * b.size) >= {embeddings.THRESHOLD}),
reach AS (
  SELECT rid AS a, rid AS b FROM v
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT reach.a AS rid, min(v.vec_id) AS component_id FROM reach JOIN v ON reach.b = v.rid GROUP BY 1),
degree AS (SELECT a AS rid, count(*) AS n_links FROM links GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, coalesce(vec_id = component_id, component_id IS NULL) AS kept
FROM v LEFT JOIN least USING (rid) LEFT JOIN degree USING (rid)""",
    "op3_substring_dedup": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, s, md5(array_to_string(w[s:s + {substring.WINDOW - 1}], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - {substring.WINDOW - 2})) AS s FROM d WHERE len(w) >= {substring.WINDOW})),
late AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) AS place FROM windows) WHERE place > 1),
gone AS (SELECT DISTINCT doc_id, s + j AS p FROM late, range({substring.WINDOW}) r(j)),
kept AS (
  SELECT x.doc_id, count(gone.p) AS n_removed, string_agg(x.word, ' ' ORDER BY x.p) FILTER (gone.p IS NULL) AS kept
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) x LEFT JOIN gone ON gone.doc_id = x.doc_id AND gone.p = x.p
  GROUP BY x.doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)""",
    "op7_warc_fixity": """
WITH p AS (SELECT page_id, page_id // {RECORDS} || '-0' AS archive, coalesce(url, '') AS url, coalesce(html, '') AS html, page_id % 389 AS rest, page_id % {RECORDS} AS within FROM pages),
moves AS (SELECT page_id FROM p WHERE rest = 11 AND within < {RECORDS} // 2 AND page_id + 40 <= (SELECT max(page_id) FROM pages)),
b AS (
  SELECT page_id, archive, url, CASE WHEN page_id % 97 = 0 AND length(html) > 0 THEN CASE WHEN left(html, 1) = '~' THEN '#' ELSE '~' END || substring(html, 2) ELSE html END AS html,
    page_id + CASE WHEN page_id IN (FROM moves) THEN 40.5 ELSE 0.0 END AS spot FROM p WHERE rest <> 5
  UNION ALL SELECT page_id, archive, url, html || '<!-- again -->', page_id FROM p WHERE rest = 7),
two AS (SELECT 'a' AS side, page_id, archive, url, html, page_id + 0.0 AS spot FROM p UNION ALL SELECT 'b', page_id, archive, url, html, spot FROM b),
r AS (
  SELECT side, page_id, archive, spot, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10)
    || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) AS text FROM two),
o AS (SELECT side, page_id, archive, strlen(text) AS length, sha256(text) AS digest, sum(strlen(text)) OVER (PARTITION BY side, archive ORDER BY spot, page_id, sha256(text)) - strlen(text) AS "offset" FROM r),
x AS (FROM o WHERE side = 'a'), y AS (FROM o WHERE side = 'b'),
same AS (SELECT x.*, y."offset" AS offset_b FROM x JOIN y USING (page_id, digest)),
other AS (FROM y WHERE NOT EXISTS (FROM same WHERE same.page_id = y.page_id AND same.digest = y.digest)),
found AS (
  SELECT archive, page_id, 'moved' AS status, "offset" AS offset_a, length AS length_a, digest AS digest_a, offset_b, length AS length_b, digest AS digest_b FROM same WHERE page_id IN (FROM moves)
  UNION ALL SELECT x.archive, x.page_id, 'changed', x."offset", x.length, x.digest, other."offset", other.length, other.digest FROM x JOIN other USING (page_id) WHERE page_id NOT IN (SELECT page_id FROM same)
  UNION ALL SELECT x.archive, x.page_id, 'lost', x."offset", x.length, x.digest, NULL, NULL, NULL FROM x WHERE page_id NOT IN (SELECT page_id FROM y)
  UNION ALL SELECT archive, page_id, 'added', NULL, NULL, NULL, "offset", length, digest FROM other WHERE page_id IN (SELECT page_id FROM same))
SELECT archive, page_id, status, 1::BIGINT AS copies, offset_a::BIGINT AS offset_a, length_a, digest_a, offset_b::BIGINT AS offset_b, length_b, digest_b FROM found""".replace("{RECORDS}", str(warc.RECORDS)),
    "op8_decontaminate": rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{decontaminate.UPPER}', '{decontaminate.LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT DISTINCT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), '{decontaminate.UPPER}', '{decontaminate.LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item, size, array_to_string(w[s:s + size - 1], ' ') AS g
  FROM (SELECT item, w, least(len(w), {decontaminate.WINDOW}) AS size, unnest(range(1, len(w) - least(len(w), {decontaminate.WINDOW}) + 2)) AS s FROM i WHERE len(w) > 0)),
dw AS (
  SELECT rid, s, size, array_to_string(w[s:s + size - 1], ' ') AS g
  FROM (SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM d, (SELECT DISTINCT size FROM iw) WHERE len(w) >= size)),
hit AS (SELECT rid, s, size, item FROM dw JOIN iw USING (size, g)),
total AS (SELECT rid, count(DISTINCT s + j) AS n_hit FROM hit, range({decontaminate.WINDOW}) r(j) WHERE j < size GROUP BY rid),
found AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS of_items FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(of_items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN total USING (rid) LEFT JOIN found USING (rid)""",
    "op10_mixing": rf"""
WITH d AS (
  SELECT doc_id, lang, source, coalesce(lang, '(null)') AS l, coalesce(source, '(null)') AS s, CASE WHEN md5(coalesce(source, '(null)')) < '8' THEN 'core' ELSE 'wide' END AS domain,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens FROM documents),
leaf AS (SELECT domain, l, s, sum(n_tokens)::BIGINT AS n, {mixing.MAX_EPOCHS} * sum(n_tokens)::BIGINT AS room FROM d GROUP BY ALL),
l1 AS (SELECT 0 AS top, domain, sum(room) AS room, CASE domain WHEN 'core' THEN {mixing.DOMAIN_WEIGHTS['core']} ELSE {mixing.DOMAIN_WEIGHTS['wide']} END::DOUBLE AS weight, (SELECT floor(sum(n) * {mixing.SHARE}) FROM leaf) AS budget FROM leaf GROUP BY domain),
{_filled("l1", "g1", "top", "domain")},
l2 AS (SELECT domain, l, sum(leaf.room) AS room, 1.0::DOUBLE AS weight, any_value(given) AS budget FROM leaf JOIN g1 USING (domain) GROUP BY domain, l),
{_filled("l2", "g2", "domain", "l")},
l3 AS (SELECT domain, l, s, n, leaf.room, 1.0::DOUBLE AS weight, given AS budget FROM leaf JOIN g2 USING (domain, l)),
{_filled("l3", "g3", "domain, l", "s")},
p AS (SELECT domain, l, s, CASE WHEN n > 0 THEN given // n ELSE 0 END AS whole, given - CASE WHEN n > 0 THEN given // n ELSE 0 END * n AS rest FROM g3),
o AS (SELECT d.*, whole, rest, sum(n_tokens) OVER (PARTITION BY domain, l, s ORDER BY md5('{mixing.SEED}:' || (whole + 1) || ':' || coalesce(doc_id::VARCHAR, '')), n_tokens, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM d JOIN p USING (domain, l, s))
SELECT doc_id, lang, source, domain, n_tokens, unnest(range(1, whole + CASE WHEN rest > 0 AND upto <= rest THEN 2 ELSE 1 END))::INT AS epoch FROM o""",
    "op9_pii": _pii_sql(),
}
