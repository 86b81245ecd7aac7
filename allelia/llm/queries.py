"""Queries of the training-data operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import audio, audit, bpe, decontam, jaccard, licences, lines, pieces, search, sharding, suffix, toxicity, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_media_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.digests(_table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


def op6_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.digests(_table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digests(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_near_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.near_digests(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(_table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digests(_table(spark, sf_dir, "documents"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.judge(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels"))
    return found.drop("text")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.passage_digests(_table(spark, sf_dir, "documents"))


def op10_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digests(_table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(search.index(_table(spark, sf_dir, "documents")), _table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op2_suffix_dedup, op4_jaccard_join, op5_toxicity, op8_sharding, op10_line_dedup, op10_line_chunks, op1_media_audio, op3_url_filter, op6_licence_scan, op7_decontamination, op7_near_matches, op9_sentencepiece, op11_filter_audit, op12_byte_bpe, op13_ranked_search)}

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

def _licence_sql() -> str:
    """Every template at every place, by counting the words that stand where they belong."""
    rows, index = [], licences.Index()
    for k, (words, must) in enumerate(zip(index.texts, index.must)):
        rows += [f"({k}, {i}, '{w}', {int(m)})" for i, (w, m) in enumerate(zip(words, must))]
    names = ", ".join(f"({k}, '{label}', {len(index.texts[k])}, {int(index.must[k].sum())}, {'true' if k < len(licences.BASE) else 'false'})" for k, label in enumerate(index.labels))
    return f"""
WITH t(k, i, word, must) AS (VALUES {', '.join(rows)}),
names(k, label, n, n_must, base) AS (VALUES {names}),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
p AS (SELECT r, unnest(w) AS word, unnest(range(0, len(w))) AS loc FROM d),
place AS (SELECT r, k, loc - i AS start, count(*) AS hits, sum(must) AS musts FROM p JOIN t USING (word) GROUP BY ALL),
good AS (SELECT r, label, base, start, hits / n AS score FROM place JOIN names USING (k) WHERE musts = n_must AND hits >= {licences.SHARE} * n - 1e-9),
found AS (SELECT r, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word, max(score) AS score,
  array_to_string(list_sort(list_distinct(list(label) FILTER (base))), ',') AS base_labels, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels FROM good GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score FROM d LEFT JOIN found USING (r)"""


ORACLE = {
    "op11_filter_audit": """
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
lab AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT r, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, {'A': len(ws) < 100, 'B': 100 * len(list_distinct(ws)) < 80 * len(ws), 'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t),
  'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false)} AS x FROM w LEFT JOIN lab ON lab.doc_id = w.doc_id),
flag AS (SELECT r, part, good, toxic, CASE WHEN x.A THEN 'A' ELSE '' END || CASE WHEN x.B THEN 'B' ELSE '' END || CASE WHEN x.C THEN 'C' ELSE '' END || CASE WHEN x.D THEN 'D' ELSE '' END || CASE WHEN x.E THEN 'E' ELSE '' END AS fails FROM f),
o(p) AS (SELECT '' UNION ALL SELECT p || c FROM o, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(c) WHERE NOT contains(p, c)),
ord AS (SELECT p AS filter_order, s AS step, p[s] AS own, p[1 : s - 1] AS before FROM o, range(1, 6) t(s) WHERE length(p) = 5),
hit AS (SELECT filter_order, step, own, flag.part, good, toxic, fails, contains(fails, own) AS bad, regexp_matches(fails, '[' || before || '0]') AS gone FROM ord, flag),
n AS (SELECT part, filter_order, step, any_value(own) AS own, count(*) FILTER (NOT bad AND NOT gone) AS kept, count(*) FILTER (bad AND NOT gone) AS removed, count(*) FILTER (bad AND gone) AS redundant,
  count(*) FILTER (fails = own) AS unique_fails, count(*) FILTER (bad AND NOT gone AND good = 1) AS good_lost, count(*) FILTER (bad AND NOT gone AND toxic = 1) AS toxic_lost FROM hit GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM n""",
    "op13_ranked_search": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT row_number() OVER () AS q, item_id, {_WORDS} AS w FROM benchmark),
size AS (SELECT count(*) AS n_docs, sum(len(w)) AS n_terms FROM d WHERE len(w) > 0),
post AS (SELECT r, doc_id, len(w) AS n, t, count(*) AS tf FROM (SELECT r, doc_id, w, unnest(w) AS t FROM d) GROUP BY ALL),
freq AS (SELECT t, count(*) AS df FROM post GROUP BY t),
ask AS (SELECT DISTINCT q, item_id, t FROM (SELECT q, item_id, unnest(w) AS t FROM b)),
hit AS (SELECT q, item_id, r, doc_id, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // CAST(n_terms AS BIGINT)))) AS s
  FROM ask JOIN post USING (t) JOIN freq USING (t), size),
score AS (SELECT q, item_id, r, doc_id, CAST(sum(s) AS BIGINT) AS score FROM hit GROUP BY ALL HAVING sum(s) > 0),
best AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id, r) AS rank FROM score)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM best WHERE rank <= 50""",
    "op6_licence_scan": _licence_sql(),
    "op4_jaccard_join": f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT r, unnest(CASE WHEN len(w) = 0 THEN ['=' || text] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i : i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS g FROM d),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
met AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY ALL),
links AS (SELECT a, b FROM met JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE c >= {jaccard.THRESHOLD} * (x.n + y.n - c) - 1e-9),
reach(a, b) AS (SELECT r, r FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
class AS (SELECT reach.a AS r, min(d.doc_id) AS class_id FROM reach JOIN d ON d.r = reach.b GROUP BY reach.a)
SELECT d.doc_id, class_id, coalesce(n_links, 0) AS n_links FROM d JOIN class USING (r) LEFT JOIN (SELECT a AS r, count(*) AS n_links FROM links GROUP BY a) USING (r)""",
    "op2_suffix_dedup": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b, {_WORDS} AS w FROM documents),
win AS (SELECT r, s, md5(b[s : s + {suffix.LENGTH - 1}]) AS g FROM (SELECT r, b, unnest(range(1, octet_length(b) - {suffix.LENGTH - 2})) AS s FROM d WHERE octet_length(b) >= {suffix.LENGTH})),
rep AS (SELECT r, s, s - lag(s) OVER (PARTITION BY r ORDER BY s) > {suffix.LENGTH} AS apart FROM win WHERE g IN (SELECT g FROM win GROUP BY g HAVING count(*) > 1)),
runs AS (SELECT r, min(s) AS lo, max(s) + {suffix.LENGTH - 1} AS hi FROM (SELECT r, s, sum(CAST(coalesce(apart, false) AS INT)) OVER (PARTITION BY r ORDER BY s) AS k FROM rep) GROUP BY r, k),
cut AS (SELECT r, lo, hi, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY lo), 0) AS before FROM runs),
got AS (SELECT r, count(*) AS n, sum(hi - lo + 1) AS gone, string_agg(CASE WHEN lo > before + 1 THEN hex(b[before + 1 : lo - 1]) ELSE '' END, '' ORDER BY lo) AS head, max(hi) AS last FROM cut JOIN d USING (r) GROUP BY r),
pw AS (SELECT r, md5(array_to_string(list_slice(w, s, s + {suffix.PASSAGE - 1}), ' ')) AS g FROM (SELECT r, w, unnest(range(1, len(w) - {suffix.PASSAGE - 2})) AS s FROM d WHERE len(w) >= {suffix.PASSAGE})),
passages AS (SELECT DISTINCT r FROM pw WHERE g IN (SELECT g FROM pw GROUP BY g HAVING count(DISTINCT r) > 1))
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
  CASE WHEN n IS NULL THEN sha256(b) ELSE sha256(unhex(head || CASE WHEN last < octet_length(b) THEN hex(b[last + 1 : octet_length(b)]) ELSE '' END)) END AS kept_sha256,
  passages.r IS NOT NULL AS passage FROM d LEFT JOIN got USING (r) LEFT JOIN passages USING (r)""",
    "op3_url_filter": """
WITH rules(verdict, host, path) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
rest AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS r FROM pages),
cut AS (SELECT page_id, regexp_extract(r, '^[^/?#]*') AS h, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
u AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM cut),
hit AS (SELECT u.page_id, arg_max(r.host || r.path, length(r.host) * 1000 + length(r.path)) AS rule, arg_max(r.verdict, length(r.host) * 1000 + length(r.path)) AS verdict
        FROM u JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path) GROUP BY u.page_id)
SELECT u.page_id, u.host, u.path, hit.rule, coalesce(hit.verdict, 'allow') AS verdict FROM u LEFT JOIN hit USING (page_id)""",
    "op7_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(list_slice(w, s, s + least(len(w), 13) - 1), ' ') AS g
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, n, s, array_to_string(list_slice(w, s, s + n - 1), ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lens WHERE len(w) >= n)),
hits AS (SELECT dw.doc_id, dw.s, dw.n, win.item_id FROM dw JOIN win ON dw.n = win.n AND dw.g = win.g),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)""",
    "op8_sharding": f"""
WITH b AS (SELECT row_number() OVER () AS r, doc_id, coalesce(strlen(text), 0) AS n_bytes,
  ((('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), chr(30))), 1, 8))::BIGINT >> 2) << 30) + (('0x' || substr(md5(coalesce(text, chr(30))), 1, 8))::BIGINT >> 2) AS bits FROM documents),
lv AS (SELECT r, d, bits >> ({sharding.BITS} - d) AS q, n_bytes FROM b, range(0, {sharding.BITS + 1}) t(d)),
fit AS (SELECT d, q FROM lv GROUP BY d, q HAVING sum(n_bytes) <= {sharding.LIMIT}),
dep AS (SELECT r, min(d) AS depth FROM lv JOIN fit USING (d, q) GROUP BY r)
SELECT doc_id, substr(to_base(bits, 2, {sharding.BITS}), 1, depth) AS shard, CAST(depth AS INT) AS depth, CAST(n_bytes AS BIGINT) AS n_bytes, n_bytes > {sharding.LIMIT} AS oversize FROM b JOIN dep USING (r)""",
    "op10_line_dedup": """
WITH d AS (SELECT doc_id, text IS NULL AS lost, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, lost, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM d),
p AS (SELECT doc_id, i, line || chr(10) || lead(line) OVER w AS body, lead(i) OVER w AS nxt FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY body ORDER BY doc_id, i) AS k FROM p WHERE nxt IS NOT NULL) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, i FROM (SELECT doc_id, i FROM later UNION ALL SELECT doc_id, i + 1 FROM later)),
m AS (SELECT l.*, gone.i IS NOT NULL AS out FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.i = gone.i),
k AS (SELECT *, out AND NOT coalesce(lag(out) OVER (PARTITION BY doc_id ORDER BY i), false) AS begins FROM m)
SELECT doc_id, CAST(CASE WHEN any_value(lost) THEN 0 ELSE count(*) END AS BIGINT) AS n_lines, CAST(count(*) FILTER (out) AS BIGINT) AS n_removed,
  CAST(count(*) FILTER (begins) AS BIGINT) AS n_chunks_removed, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT out), '')) AS kept_sha256 FROM k GROUP BY doc_id""",
    "op10_line_chunks": f"""
WITH d AS (SELECT doc_id, text IS NULL AS lost, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, lost, len(ls) AS n, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM d),
h AS (SELECT *, ('0x' || substr(md5(line), 1, 7))::BIGINT AS hh FROM l),
e AS (SELECT *, CAST(i = n OR (hh + 31 * coalesce(lag(hh, 1) OVER w, 0) + 961 * coalesce(lag(hh, 2) OVER w, 0)) % {lines.EVERY} = 0 AS INT) AS ends FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
k AS (SELECT *, coalesce(sum(ends) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk FROM e),
c AS (SELECT doc_id, any_value(lost) AS lost, chunk, min(i) AS lo, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS body FROM k GROUP BY doc_id, chunk),
m AS (SELECT *, n > 1 AND row_number() OVER (PARTITION BY body, n > 1 ORDER BY doc_id, lo) > 1 AS gone FROM c)
SELECT doc_id, CAST(CASE WHEN any_value(lost) THEN 0 ELSE sum(n) END AS BIGINT) AS n_lines, CAST(coalesce(sum(n) FILTER (gone), 0) AS BIGINT) AS n_removed,
  CAST(count(*) FILTER (gone) AS BIGINT) AS n_chunks_removed, sha256(coalesce(string_agg(body, chr(10) ORDER BY lo) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id""",
}
