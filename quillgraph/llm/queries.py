"""One query for each training-data operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm import bpe, decontaminate, divergence, exactdedup, html, neardup, quality, sharding, suffixes, tokens, toxicity, trie, urlfilter

#: host, path, verdict of the URL filter's list.
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), span=decontaminate.SPAN).drop("text_hash")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages"))


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.round_trip(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.kd_shards(table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(table(spark, sf_dir, "documents"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"), exact=True)


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urlfilter.judge(table(spark, sf_dir, "pages"), listed)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality.judge(table(spark, sf_dir, "documents"), trusted)


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.deduplicated(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_byte_bpe, op2_decontamination, op3_html_extraction, op4_token_ids, op5_toxicity, op6_sharding, op7_suffix_dedup, op8_near_duplicates, op9_url_filters, op10_quality_rules, op11_exact_dedup, op12_prefix_trie, op13_source_divergence)}

_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)

_WORD = r"[^\x{0}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+"
_SPAN = decontaminate.SPAN
_TERM = r"[^\x{0}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7F}]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op2_decontamination": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, w[s : s + 9] AS ph FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
ph AS (SELECT ph, len(ph) AS n, array_to_string(ph, ' ') AS k FROM (SELECT DISTINCT ph FROM win)),
lens AS (SELECT DISTINCT n FROM ph),
spots AS (SELECT r, s, n, array_to_string(w[s : s + n - 1], ' ') AS k FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lens WHERE len(w) >= n)),
hits AS (SELECT r, s, spots.n, spots.k FROM spots JOIN ph ON spots.k = ph.k),
n_hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM hits) GROUP BY r),
ids AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS names FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM hits JOIN win ON hits.k = array_to_string(win.ph, ' ')) GROUP BY r),
need AS (SELECT k, term, count(*) AS c FROM (SELECT k, unnest(ph) AS term FROM ph) GROUP BY k, term),
post AS (SELECT r, p, term FROM (SELECT r, unnest(range(len(w))) AS p, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM need)),
often AS (SELECT term, count(*) AS n FROM post GROUP BY term),
rare AS (SELECT k, arg_min(need.term, coalesce(n, 0)) AS term, count(*) AS terms FROM need LEFT JOIN often ON need.term = often.term GROUP BY k),
cand AS (SELECT r, k, p, terms FROM post JOIN rare ON post.term = rare.term),
near AS (SELECT t.r, t.k, t.p, t.terms, t.q, post.term, c FROM (SELECT *, unnest(range(p - {_SPAN - 1}, p + {_SPAN})) AS q FROM cand) AS t JOIN post ON post.r = t.r AND post.p = t.q JOIN need ON need.k = t.k AND need.term = post.term),
full_ AS (SELECT r, k, p FROM near GROUP BY r, k, p, terms HAVING count(DISTINCT term) = terms),
few AS (SELECT near.* FROM near JOIN full_ ON near.r = full_.r AND near.k = full_.k AND near.p = full_.p),
held AS (SELECT x.r, x.k, x.p, x.q, x.terms, y.term FROM few AS x JOIN few AS y ON x.r = y.r AND x.k = y.k AND x.p = y.p AND y.q BETWEEN x.q AND x.q + {_SPAN - 1}
         WHERE x.q BETWEEN x.p - {_SPAN - 1} AND x.p GROUP BY x.r, x.k, x.p, x.q, x.terms, y.term, y.c HAVING count(*) >= y.c),
close AS (SELECT DISTINCT r, k FROM (SELECT r, k FROM held GROUP BY r, k, p, q, terms HAVING count(*) = terms)),
n_near AS (SELECT r, count(DISTINCT CAST(item_id AS VARCHAR)) AS n_near FROM close JOIN win ON close.k = array_to_string(win.ph, ' ') GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN n_hit ON d.r = n_hit.r LEFT JOIN ids ON d.r = ids.r LEFT JOIN n_near ON d.r = n_near.r""",
    "op7_suffix_dedup": """
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST, md5(coalesce(text, ''))) AS no, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT no, p, substr(h, 2 * p + 1, 200) AS s FROM (SELECT no, h, unnest(range(0, len(h) // 2 - 99)) AS p FROM d WHERE len(h) >= 200)),
later AS (SELECT no, p FROM (SELECT no, p, row_number() OVER (PARTITION BY s ORDER BY no, p) AS k FROM w) WHERE k > 1),
begun AS (SELECT no, p, CASE WHEN p <= lag(p) OVER (PARTITION BY no ORDER BY p) + 100 THEN 0 ELSE 1 END AS fresh FROM later),
runs AS (SELECT no, min(p) AS lo, max(p) + 100 AS hi FROM (SELECT no, p, sum(fresh) OVER (PARTITION BY no ORDER BY p) AS g FROM begun) GROUP BY no, g),
parts AS (SELECT no, lo, hi, lead(lo) OVER (PARTITION BY no ORDER BY lo) AS following FROM runs),
cut AS (SELECT d.no, count(*) AS n_spans, sum(hi - lo) AS n_removed, substr(any_value(h), 1, 2 * min(lo)) || string_agg(substr(h, 2 * hi + 1, 2 * (coalesce(following, len(h) // 2) - hi)), '' ORDER BY lo) AS kept FROM parts JOIN d ON parts.no = d.no GROUP BY d.no)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN cut ON d.no = cut.no""",
    "op9_url_filters": f"""
WITH listed(h, p, v) AS (VALUES {_RULES}),
cut AS (SELECT page_id, row_number() OVER () AS r, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS u FROM pages),
parts AS (SELECT page_id, r, translate(regexp_extract(u, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(u, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
hits AS (SELECT page_id, r, host, path, h || p AS rule, v, row_number() OVER (PARTITION BY r ORDER BY length(h || p) DESC NULLS LAST, h || p DESC) AS n
         FROM parts LEFT JOIN listed ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM hits WHERE n = 1""",
    "op11_exact_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents),
k AS (SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS k, count(*) OVER (PARTITION BY h) AS group_size FROM d WINDOW w AS (PARTITION BY h ORDER BY n DESC, doc_id NULLS LAST, r))
SELECT doc_id, keep_id, group_size, k = 1 AS kept, h AS text_sha256 FROM k""",
    "op12_prefix_trie": """
WITH RECURSIVE t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT c, CAST(c AS VARCHAR) AS s FROM t),
crc(c, s, i, v) AS (SELECT c, s, 0, 4294967295::BIGINT FROM ids UNION ALL
  SELECT c, s, i + 1, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END FROM (SELECT c, s, i, CASE WHEN i % 8 = 0 THEN xor(v, ord(substr(s, i // 8 + 1, 1))::BIGINT) ELSE v END AS x FROM crc WHERE i < 8 * length(s))),
h AS (SELECT c, xor(v, 4294967295::BIGINT) % 9 AS h, c - c % 5 AS b FROM crc WHERE i = 8 * length(s)),
made AS (SELECT h.c, pos, 0 AS own, role, text FROM h JOIN t ON t.c = h.b AND t.pos <= h.h UNION ALL SELECT h.c, pos, 1, role, text FROM h JOIN t ON t.c = h.c AND t.pos > h.h),
rows_ AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, pos) AS d, role, text FROM made),
seqs AS (SELECT c, array_agg({'r': role, 't': text} ORDER BY d) AS turns FROM rows_ GROUP BY c),
pre AS (SELECT c, 0::BIGINT AS d, md5('') AS k, NULL::VARCHAR AS pk, 0 AS bytes FROM ids UNION ALL SELECT rows_.c, d, md5(CAST(d AS VARCHAR) || CAST(turns[1 : d] AS JSON)::VARCHAR), CASE WHEN d = 1 THEN md5('') ELSE md5(CAST(d - 1 AS VARCHAR) || CAST(turns[1 : d - 1] AS JSON)::VARCHAR) END, strlen(text) FROM rows_ JOIN seqs ON rows_.c = seqs.c),
lens AS (SELECT c, max(d) AS n FROM pre GROUP BY c),
node AS (SELECT k, any_value(d) AS depth, min(c) AS conv_id, count(*) AS n_convs, any_value(pk) AS pk, (count(*) - 1) * any_value(bytes) AS saved FROM pre GROUP BY k),
kids AS (SELECT pk, count(*) AS n FROM node WHERE pk IS NOT NULL GROUP BY pk),
sums AS (SELECT pre.k, sum(saved) AS saved, count(*) FILTER (WHERE kids.n IS NULL) AS leaves FROM node JOIN pre ON pre.c = node.conv_id AND pre.d <= node.depth LEFT JOIN kids ON node.k = kids.pk GROUP BY pre.k),
ends AS (SELECT pre.k, string_agg(CAST(pre.c AS VARCHAR), ',' ORDER BY pre.c) AS names FROM pre JOIN lens ON pre.c = lens.c AND pre.d = lens.n GROUP BY pre.k)
SELECT node.conv_id, node.depth, up.conv_id AS parent_conv_id, node.n_convs, coalesce(kids.n, 0) AS n_children, sums.leaves AS n_leaves, CAST(sums.saved AS BIGINT) AS saved_tokens, sha256(coalesce(names, '')) AS ends_sha256
FROM node LEFT JOIN node up ON node.pk = up.k LEFT JOIN kids ON node.k = kids.pk JOIN sums ON node.k = sums.k LEFT JOIN ends ON node.k = ends.k""",
    "op13_source_divergence": f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOWER}, '{_TERM}') AS w FROM documents),
occ AS (SELECT r, lang, source, unnest(w) AS t FROM d),
kept AS (SELECT lang, t, count(*) AS n FROM occ GROUP BY 1, 2 HAVING count(DISTINCT r) >= 10),
langs AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
cnt AS (SELECT occ.lang, source, occ.t, count(*) AS n FROM occ JOIN kept ON occ.lang = kept.lang AND occ.t = kept.t GROUP BY 1, 2, 3),
tot AS (SELECT lang, source, sum(n) AS n FROM cnt GROUP BY 1, 2),
p AS (SELECT g.lang, g.source, kept.t, coalesce(cnt.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(cnt.n, 0) + 2)) // (coalesce(tot.n, 0) + 2 * v) AS p, 1 + (1000000000::HUGEINT * (kept.n + 2)) // (langs.n + 2 * v) AS q
  FROM g JOIN kept ON g.lang = kept.lang JOIN langs ON g.lang = langs.lang LEFT JOIN cnt ON cnt.lang = g.lang AND cnt.source = g.source AND cnt.t = kept.t LEFT JOIN tot ON tot.lang = g.lang AND tot.source = g.source),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY 1, 2, 3),
parts AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', t, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM parts) WHERE part = 'pair' OR rank <= 10""",
}
