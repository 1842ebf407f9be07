"""Queries of the training-data operators, by name, and the SQL that DuckDB can run for them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_tree, covertree
from . import exact_dedup as exact
from . import language_id, line_dedup, lm_score, minhash, mixing, packing, prefix_trie, url_filter, va_file, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_dedup(spark, sf_dir):
    return minhash.minhash_dedup(_table(spark, sf_dir, "documents")).drop("text_hash")


def op2_packing(spark, sf_dir):
    return packing.pack(_table(spark, sf_dir, "documents"))


def op3_language_id(spark, sf_dir):
    return language_id.language_id(_table(spark, sf_dir, "documents"))


def op4_lm_score(spark, sf_dir):
    return lm_score.lm_score(_table(spark, sf_dir, "documents"))


def op5_covertree_dedup(spark, sf_dir):
    return covertree.covertree_dedup(_table(spark, sf_dir, "embeddings"))


def op6_warc_revisits(spark, sf_dir):
    out = warc.resolve_revisits(warc.page_records(_table(spark, sf_dir, "pages")))
    pairs = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return out.withColumn("headers", F.array_join(pairs, ";"))


def op7_line_dedup(spark, sf_dir):
    return line_dedup.drop_boilerplate(_table(spark, sf_dir, "pages"))


def op9_url_filter(spark, sf_dir):
    return url_filter.filter_urls(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op10_mixing(spark, sf_dir):
    return mixing.schedule(_table(spark, sf_dir, "documents")).drop("text_hash")


def op8_exact_dedup(spark, sf_dir):
    return exact.exact_dedup(_table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op11_prefix_trie(spark, sf_dir):
    return prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.placed(_table(spark, sf_dir, "conversations"))))


def op12_bpe_tree(spark, sf_dir):
    t = bpe_tree.encode(_table(spark, sf_dir, "documents"), decoded=True)
    return t.select("doc_id", F.floor(F.octet_length("ids") / 4).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def op13_va_file(spark, sf_dir):
    return va_file.hard_negatives(va_file.mined(_table(spark, sf_dir, "embeddings")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_minhash_dedup": op1_minhash_dedup,
        "op2_packing": op2_packing,
        "op3_language_id": op3_language_id,
        "op4_lm_score": op4_lm_score,
        "op5_covertree_dedup": op5_covertree_dedup,
        "op6_warc_revisits": op6_warc_revisits,
        "op7_line_dedup": op7_line_dedup,
        "op8_exact_dedup": op8_exact_dedup,
        "op9_url_filter": op9_url_filter,
        "op10_mixing": op10_mixing,
        "op11_prefix_trie": op11_prefix_trie,
        "op12_bpe_tree": op12_bpe_tree,
        "op13_va_file": op13_va_file,
    }


OP8_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_cp, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents
), k AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_cp DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM k
"""


OP6_SQL = r"""
WITH c AS (
  SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'response' ELSE 'revisit' END AS kind, md5(coalesce(html, '')) AS digest, strlen(coalesce(html, ''))::BIGINT AS size, page_id // 40 AS version,
    regexp_replace(url, '^([A-Za-z]+://[^/?#]*/[^/?#]*).*$', '\1', 's') || CASE WHEN page_id % 2 = 0 THEN '/?utm_source=feed#top' ELSE '' END AS url FROM pages
), s AS (
  SELECT *, regexp_replace(trim(url), '#.*$', '') AS bare,
    CASE WHEN CASE WHEN kind = 'response' THEN page_id % 4 <> 0 ELSE page_id % 5 < 3 END THEN 'v' || version END AS etag, CASE WHEN CASE WHEN kind = 'response' THEN page_id % 7 <> 0 ELSE page_id % 2 = 0 END THEN 'd' || version END AS modified FROM c
), h AS (
  SELECT *, regexp_replace(translate(regexp_extract(bare, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^(http://[^:]*):80$|^(https://[^:]*):443$', '\1\2') AS head,
    regexp_replace(bare, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*', '') AS rest FROM s
), q AS (
  SELECT *, regexp_replace(head, '^https?://(www[.])?', 'http://') AS host, regexp_replace(regexp_extract(rest, '^([^?]*)', 1), '/+$', '') AS path,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|gclid|fbclid)(=|$)'))), '&') AS query FROM h
), u AS (
  SELECT page_id, kind, digest, size, etag, modified, page_id // 2 AS ts, page_id || '-' || kind AS record_id, CASE WHEN url IS NOT NULL THEN host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS canonical_url FROM q
), f AS (
  SELECT * FROM u WHERE kind = 'response' QUALIFY row_number() OVER (PARTITION BY canonical_url, ts ORDER BY record_id DESC) = 1
), a AS (
  SELECT r.*, f.record_id AS f_id, f.digest AS f_digest, f.size AS f_size, f.etag AS f_etag, f.modified AS f_modified
  FROM (SELECT * FROM u WHERE kind = 'revisit') r ASOF LEFT JOIN f ON r.canonical_url = f.canonical_url AND r.ts >= f.ts
), o AS (
  SELECT *, CASE WHEN f_id IS NULL THEN 'no_earlier'
    WHEN coalesce(etag <> f_etag, false) OR coalesce(etag IS NULL AND modified <> f_modified, false) OR NOT ((etag IS NOT NULL AND f_etag IS NOT NULL) OR (modified IS NOT NULL AND f_modified IS NOT NULL)) THEN 'validator_mismatch' ELSE 'resolved' END AS outcome FROM a
)
SELECT record_id, canonical_url, ts, CASE WHEN outcome = 'resolved' THEN f_id END AS resolved_id, outcome, (CASE WHEN outcome = 'resolved' THEN 200 ELSE 304 END)::INTEGER AS status,
  CASE WHEN outcome = 'resolved' THEN f_digest END AS payload_digest, CASE WHEN outcome = 'resolved' THEN f_size END AS payload_length,
  CASE WHEN outcome = 'resolved' THEN 'age=0;content-length=' || f_size || ';content-type=text/html;date=' || page_id || CASE WHEN coalesce(etag, f_etag) IS NOT NULL THEN ';etag=' || coalesce(etag, f_etag) ELSE '' END
    ELSE 'content-length=0;date=' || page_id || CASE WHEN etag IS NOT NULL THEN ';etag=' || etag ELSE '' END END AS headers
FROM o
""".replace("\\\\", "\\")

OP7_SQL = r"""
WITH p AS (
  SELECT row_number() OVER () AS rid, page_id, CASE WHEN instr(url, '://') > 0 THEN regexp_extract(substr(url, instr(url, '://') + 3), '^([^/?#]*)', 1) ELSE '' END AS raw,
    regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '<!--.*?-->', chr(10), 'gs'), '<script\b.*?</script\s*>', chr(10), 'gis'), '<style\b.*?</style\s*>', chr(10), 'gis') AS bare FROM pages
), l AS (
  SELECT rid, page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    list_filter(list_transform(regexp_split_to_array(bare, '(?:<[^>]*>|[\r\n])+'), lambda x: trim(x, ' ')), lambda x: x <> '') AS lines FROM p
), n AS (SELECT host, count(*) AS pages FROM l GROUP BY host
), o AS (
  SELECT d.host, d.line FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM l) d JOIN n USING (host)
  GROUP BY d.host, d.line, n.pages HAVING count(*) >= 5 AND count(*) > 0.2 * n.pages
), m AS (SELECT host, list(line) AS often FROM o GROUP BY host)
SELECT l.page_id, l.host, len(l.lines)::BIGINT AS n_lines, (len(l.lines) - len(k.kept))::BIGINT AS n_dropped, array_to_string(k.kept, chr(10)) AS text
FROM l LEFT JOIN m USING (host), LATERAL (SELECT CASE WHEN m.often IS NULL THEN l.lines ELSE list_filter(l.lines, lambda x: NOT list_contains(m.often, x)) END AS kept) k
""".replace("\\\\", "\\")


#: Components: the smallest id that a closure of the links reaches.
_CLOSURE = """
), r AS (
  SELECT DISTINCT a AS id, a AS low FROM (SELECT a FROM e UNION SELECT b FROM e)
  UNION SELECT CASE WHEN e.a = r.id THEN e.b ELSE e.a END, r.low FROM r JOIN e ON r.id = e.a OR r.id = e.b
), k AS (SELECT id, min(low) AS component_id FROM r GROUP BY id)
"""

OP1_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT doc_id, list_distinct(list_transform(range(1, greatest(1, len(w) - 4) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM t WHERE len(w) > 0
), s AS (SELECT doc_id, unnest(s) AS x FROM g
), n AS (SELECT doc_id, len(s) AS n FROM g
), c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2
), e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)""" + _CLOSURE + """
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id, doc_id = coalesce(component_id, doc_id) AS kept
FROM t LEFT JOIN n USING (doc_id) LEFT JOIN k ON id = doc_id
"""

OP5_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(embedding, lambda y: y <> 0)) > 0
), p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.93
), l AS (SELECT id, count(*) AS n FROM (SELECT a AS id FROM p UNION ALL SELECT b FROM p) GROUP BY id
), e AS (SELECT a, b FROM p""" + _CLOSURE + """
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(component_id, vec_id) AS component_id, vec_id = coalesce(component_id, vec_id) AS kept
FROM embeddings LEFT JOIN l ON l.id = vec_id LEFT JOIN k ON k.id = vec_id
"""

OP9_SQL = r"""
WITH RECURSIVE p AS (
  SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, html, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p
), rules(rule, verdict, site, below) AS (VALUES {rules}
), j AS (
  SELECT page_id, host, path, html, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS ruled FROM h LEFT JOIN rules ON (host = site OR ends_with(host, '.' || site)) AND starts_with(path, '/' || below) GROUP BY ALL
), hosts AS (SELECT DISTINCT host FROM j WHERE host <> ''
), up AS (SELECT host AS a, regexp_extract(host, '^[^.]+\.(.+\..+)$', 1) AS b FROM hosts WHERE regexp_extract(host, '^[^.]+\.(.+\..+)$', 1) <> ''
), w AS (
  SELECT host AS src, translate(regexp_extract(u, '^(?:[A-Za-z]+:)?//([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst, 1.0::DOUBLE AS weight
  FROM (SELECT host, unnest(regexp_extract_all(html, '(?i)href\s*=\s*["'']?((?:[a-z]+:)?//[^"''\s>]*)', 1)) AS u FROM j WHERE host <> '') WHERE true
  UNION ALL SELECT a, b, 0.25::DOUBLE FROM up UNION ALL SELECT b, a, 0.25::DOUBLE FROM up
), e AS (SELECT src, dst, sum(weight) AS weight FROM w WHERE dst <> '' AND src <> dst GROUP BY 1, 2
), m AS (
  SELECT 'trust' AS kind, src, dst, weight / sum(weight) OVER (PARTITION BY src) AS share FROM e UNION ALL SELECT 'distrust', dst, src, weight / sum(weight) OVER (PARTITION BY dst) FROM e
), d AS (
  SELECT kind, host, n / sum(n) OVER (PARTITION BY kind) AS seed FROM (SELECT CASE ruled WHEN 'allow' THEN 'trust' ELSE 'distrust' END AS kind, host, count(*)::DOUBLE AS n FROM j WHERE ruled IS NOT NULL GROUP BY 1, 2)
), r AS (
  SELECT 0 AS step, kind, host, seed AS mass FROM d
  UNION ALL SELECT step + 1, kind, host, sum(x) FROM (
    SELECT r.step, m.kind, m.dst AS host, 0.85::DOUBLE * r.mass * m.share AS x FROM r JOIN m ON r.kind = m.kind AND r.host = m.src WHERE r.step < 120) GROUP BY 1, 2, 3
), k AS (SELECT host, 0.15::DOUBLE * coalesce(sum(mass) FILTER (kind = 'trust'), 0) AS trust, 0.15::DOUBLE * coalesce(sum(mass) FILTER (kind = 'distrust'), 0) AS distrust FROM r GROUP BY host)
SELECT page_id, j.host, path, rule, coalesce(ruled, CASE WHEN coalesce(distrust, 0) > 0.5 * (coalesce(trust, 0) + coalesce(distrust, 0)) THEN 'block' ELSE 'allow' END) AS verdict FROM j LEFT JOIN k ON j.host = k.host
""".replace("{rules}", ", ".join(f"('{r}', '{v}', '{r.partition('/')[0]}', '{r.partition('/')[2]}')" for r, v in url_filter.RULES))


OP11_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, strlen(coalesce(text, '')) AS b, substr(sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || ':' || coalesce(text, '')), 1, 32) AS c FROM conversations WHERE conv_id IS NOT NULL
), l AS (SELECT conv_id, list({'c': c, 'b': b} ORDER BY turn NULLS FIRST, role, c) AS l FROM t GROUP BY conv_id
), h AS (
  SELECT conv_id, l, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda a, x: list_reduce(list_prepend(xor(a, x), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda y, z: xor(y // 2, 3988292384 * (y % 2)))), 4294967295) % 9 AS h FROM l
), r AS (SELECT h.conv_id, list_concat(coalesce(base.l[1:h], []), h.l[h + 1:]) AS l FROM h LEFT JOIN l base ON base.conv_id = h.conv_id - h.conv_id % 5
), m AS (
  SELECT conv_id, d, array_to_string(list_transform(l[1:d], lambda x: x.c), ',') AS k, CASE WHEN d > 0 THEN array_to_string(list_transform(l[1:d - 1], lambda x: x.c), ',') END AS p, CASE WHEN d > 0 THEN l[d].b ELSE 0 END AS b, d = len(l) AS last
  FROM (SELECT conv_id, l, unnest(range(len(l) + 1)) AS d FROM r)
), n AS (SELECT k, d, min(p) AS p, min(conv_id) AS conv_id, count(*) AS n, max(b) AS b, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last) AS ends FROM m GROUP BY k, d
), c AS (SELECT p AS k, count(*) AS n_children FROM n WHERE d > 0 GROUP BY p
), s AS (
  SELECT x.k, count(*) FILTER (c.k IS NULL) AS n_leaves, sum((n.n - 1) * n.b) AS saved
  FROM (SELECT DISTINCT a.k, b.k AS below FROM m a JOIN m b ON a.conv_id = b.conv_id AND a.d <= b.d) x JOIN n ON n.k = x.below LEFT JOIN c ON c.k = x.below GROUP BY x.k
)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM n LEFT JOIN n p ON p.k = n.p AND n.d > 0 LEFT JOIN c ON c.k = n.k JOIN s ON s.k = n.k
"""


OP13_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, list_inner_product(a.x, v.x)::BIGINT AS score FROM v a JOIN v ON a.vec_id % 50 = 0 AND a.vec_id <> v.vec_id AND len(a.x) = len(v.x)
), p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 3
"""


def oracle_sql() -> dict[str, str]:
    return {"op13_va_file": OP13_SQL, "op11_prefix_trie": OP11_SQL, "op1_minhash_dedup": OP1_SQL, "op5_covertree_dedup": OP5_SQL, "op6_warc_revisits": OP6_SQL, "op7_line_dedup": OP7_SQL, "op8_exact_dedup": OP8_SQL, "op9_url_filter": OP9_SQL}
