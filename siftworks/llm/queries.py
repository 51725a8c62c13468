"""The operators bound to the tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, divergence, knn, langid, minhash, mixing, ngrams, packing, resample, simhash, suffix, tokens, urlfilter

#: The rules of the contract.
RULES = [
    urlfilter.Rule("block", "com", "/en/"),
    urlfilter.Rule("allow", "example.com", "/en/7"),
    urlfilter.Rule("allow", "net", "/de/"),
    urlfilter.Rule("block", "example.net", "/de/8"),
    urlfilter.Rule("block", "org", "/es/"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.search_embeddings(table(spark, sf_dir, "embeddings"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(chat.collapse_snapshots(table(spark, sf_dir, "conversations")))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_language(table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.dedup_report(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.compare_with_edits(table(spark, sf_dir, "documents"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(table(spark, sf_dir, "pages"), RULES)


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_components(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(table(spark, sf_dir, "documents"))


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.jaccard_components(table(spark, sf_dir, "documents"))


_ALL = (
    op1_topk_search, op2_packing, op3_chat_formatting, op4_language_id, op5_suffix_dedup, op6_token_counts, op7_fingerprints, op8_url_filters, op9_simhash_dedup, op10_mixing,
    op11_resampling, op12_divergence, op13_ngram_join,
)
QUERIES = {f.__name__: f for f in _ALL}

ORACLE: dict[str, str] = {}

ORACLE["op1_topk_search"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), a AS (SELECT DISTINCT vec_id, q FROM v WHERE vec_id % 50 = 0), s AS (
  SELECT a.vec_id AS query_id, a.q, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM a JOIN v b ON a.vec_id <> b.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id, q ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

ORACLE["op3_chat_formatting"] = """
WITH t AS (
  SELECT conv_id, turn, role, text,
         CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS BIGINT) AS position
  FROM conversations
), c AS (
  SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, list(struct_pack(role := role, text := text) ORDER BY position) AS said
  FROM t GROUP BY conv_id
), d AS (SELECT said, n_turns, min(conv_id) AS conv_id FROM c GROUP BY said, n_turns),
k AS (
  SELECT * FROM d WHERE NOT EXISTS (
    SELECT 1 FROM c WHERE c.n_turns > d.n_turns AND c.said[1] = d.said[1] AND c.said[1:d.n_turns] = d.said)
)
SELECT t.conv_id, t.position, t.turn, t.role, t.text, k.n_turns,
       '<|' || coalesce(t.role, 'user') || '|>' || chr(10) || coalesce(t.text, '') || chr(10) AS segment,
       coalesce(t.role, 'user') = 'assistant' AS learned
FROM t JOIN k ON t.conv_id IS NOT DISTINCT FROM k.conv_id
"""

ORACLE["op8_url_filters"] = """
WITH a AS (SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN url[strpos(url, '://') + 3:] ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, regexp_extract(rest, '^([^/?#]*)', 1) AS h, rest FROM a),
c AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest[length(h) + 1:], '^([^?#]*)', 1) AS path FROM b),
r(verdict, rule_host, rule_path) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
                                            ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
m AS (
  SELECT c.page_id, c.host, c.path, r.rule_host || r.rule_path AS rule, r.verdict,
         row_number() OVER (PARTITION BY c.page_id, c.host, c.path ORDER BY length(r.rule_host || r.rule_path) DESC NULLS LAST) AS n
  FROM c LEFT JOIN r ON (c.host = r.rule_host OR ends_with(c.host, '.' || r.rule_host)) AND starts_with(c.path, r.rule_path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE n = 1
"""

ORACLE["op10_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || md5(coalesce(CAST(doc_id AS VARCHAR), '-') || ' ' || coalesce(text, ''))[1:15] AS BIGINT) AS hash FROM documents
), s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n FROM d GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS place FROM s),
x AS (SELECT *, (place - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM w),
y AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
            / CAST(sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS rate FROM x
), z AS (SELECT *, CASE WHEN cap > rate * weight THEN rate END AS free FROM y),
t AS (
  SELECT *, CASE WHEN free IS NULL THEN CAST(cap AS DOUBLE)
                 ELSE first_value(free IGNORE NULLS) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) * weight END AS target
  FROM z
),
-- a seat for every eight words: the highest quotients of all parties
q AS (SELECT place, target, unnest(range(1, CAST(target AS BIGINT) // 4 + (SELECT count(*) FROM t) + 2)) AS seat FROM t),
o AS (SELECT place, row_number() OVER (ORDER BY target / CAST(2 * seat - 1 AS DOUBLE) DESC, place, seat) AS n FROM q),
e AS (SELECT place, count(*) AS seats FROM o WHERE n <= (SELECT (sum(source_size) + 4) // 8 FROM s) GROUP BY place),
h AS (
  SELECT t.*, CAST(least(coalesce(seats, 0) * 8, cap) AS HUGEINT) AS words, greatest(1, (source_size + 65535) // 65536, (n + 8191) // 8192) AS shards
  FROM t LEFT JOIN e USING (place)
), p AS (
  SELECT d.doc_id, d.size, d.hash, h.source_size, h.target, h.place, h.words, d.hash % h.shards AS shard FROM d JOIN h ON d.source IS NOT DISTINCT FROM h.source
), g AS (
  SELECT place, shard, CAST(sum(size) AS BIGINT) AS held, any_value(words) AS words, greatest(1, any_value(source_size)) AS whole_size,
         coalesce(sum(sum(size)) OVER (PARTITION BY place ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier
  FROM p GROUP BY place, shard
), k AS (SELECT place, shard, held, CAST((earlier + held) * words // whole_size - earlier * words // whole_size AS BIGINT) AS quota FROM g),
r AS (
  SELECT p.*, held, quota // greatest(held, 1) AS whole, quota % greatest(held, 1) AS rest, held // 64 AS blocks,
         CAST(coalesce(sum(size) OVER (PARTITION BY place, shard ORDER BY hash, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begin_
  FROM p JOIN k USING (place, shard)
)
SELECT doc_id, size, source_size, target,
  CAST(whole * size + CASE WHEN size > 0 THEN list_sum(list_transform(range(begin_ // 64, (begin_ + size - 1) // 64 + 1),
    lambda k: greatest(0, least(k * 64 + CASE
        WHEN k >= blocks THEN CASE WHEN rest // 64 = blocks THEN rest % 64 ELSE 0 END
        WHEN (k * 2147483629 + place * 104729 + shard * 7919 + 7) % greatest(blocks, 1) < rest // 64 THEN 64
        WHEN (k * 2147483629 + place * 104729 + shard * 7919 + 7) % greatest(blocks, 1) = rest // 64 THEN rest % 64 ELSE 0 END, begin_ + size) - greatest(k * 64, begin_)))) ELSE 0 END AS BIGINT) AS taken
FROM r
"""

ORACLE["op11_resampling"] = r"""
WITH steps AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, CAST(i AS BIGINT))) AS t),
d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws, row_number() OVER () AS i
  FROM documents
), b AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark
), dw AS (SELECT i, w, count(*) AS n FROM (SELECT i, unnest(ws) AS w FROM d) GROUP BY i, w),
bw AS (SELECT w, count(*) AS n FROM (SELECT unnest(ws) AS w FROM b) GROUP BY w),
vocabulary AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
sums AS (
  SELECT w, xor(list_reduce(list_transform(range(1, len(x) // 2 + 1), lambda j: CAST('0x' || x[2 * j - 1:2 * j] AS BIGINT)),
                            lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) % 10000 AS bucket
  FROM vocabulary, steps
), ds AS (SELECT bucket, CAST(sum(n) AS BIGINT) AS s FROM dw JOIN sums USING (w) GROUP BY bucket),
bs AS (SELECT bucket, CAST(sum(n) AS BIGINT) AS t FROM bw JOIN sums USING (w) GROUP BY bucket),
g AS (
  SELECT r.bucket, CAST(floor(1000.0::DOUBLE * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST((SELECT coalesce(sum(s), 0) FROM ds) + 10000 AS DOUBLE)
         / (CAST(coalesce(s, 0) + 1 AS DOUBLE) * CAST((SELECT coalesce(sum(t), 0) FROM bs) + 10000 AS DOUBLE)))) AS BIGINT) AS gain
  FROM (SELECT unnest(range(10000)) AS bucket) r LEFT JOIN ds ON ds.bucket = r.bucket LEFT JOIN bs ON bs.bucket = r.bucket
), wt AS (SELECT i, CAST(sum(n * gain) AS BIGINT) AS weight FROM dw JOIN sums USING (w) JOIN g USING (bucket) GROUP BY i),
sc AS (
  SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000.0::DOUBLE * ln(-ln((CAST(CAST('0x' || sha256('2024:' || coalesce(CAST(d.doc_id AS VARCHAR), ''))[1:8] AS BIGINT) AS DOUBLE) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM d LEFT JOIN wt USING (i)
), r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, weight, n_features) AS place FROM sc)
SELECT doc_id, n_features, weight, score,
       CASE WHEN n_features >= 20 AND place <= (SELECT count(*) FROM sc WHERE n_features >= 20) * 10 // 100 THEN CAST(place AS BIGINT) END AS rank
FROM r
"""

ORACLE["op12_divergence"] = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS i,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents
), g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, i, term, count(*) AS n FROM (SELECT lang, source, i, unnest(ts) AS term FROM d) GROUP BY ALL),
k AS (SELECT lang, term, CAST(sum(n) AS HUGEINT) AS n FROM c GROUP BY lang, term HAVING count(*) >= 10),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
o AS (
  SELECT g.lang, g.source, k.term, k.n AS whole, coalesce(x.n, 0) AS n
  FROM g JOIN k ON k.lang = g.lang
  LEFT JOIN (SELECT lang, source, term, CAST(sum(n) AS HUGEINT) AS n FROM c GROUP BY ALL) x ON x.lang = g.lang AND x.source = g.source AND x.term = k.term
), t AS (SELECT lang, source, sum(n) AS n FROM o GROUP BY ALL),
p AS (
  SELECT o.lang, o.source, o.term, o.n, 1 + 1000000000::HUGEINT * (o.n + 2) // (t.n + 2 * v.v) AS p, 1 + 1000000000::HUGEINT * (o.whole + 2) // (v.n + 2 * v.v) AS q
  FROM o JOIN t ON t.lang = o.lang AND t.source = o.source JOIN v ON v.lang = o.lang
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS BIGINT) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), u AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM p WHERE n > 0 AND p > q
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM u)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 10
"""
