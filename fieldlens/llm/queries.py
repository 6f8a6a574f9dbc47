"""Queries over the shared tables, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table
from .chat import collapse
from .decontaminate import report
from .exact_dedup import exact_duplicates
from .lm_score import lm_scores
from .mixing import mix
from .near_dedup import near_duplicates
from .token_align import align_tokenizers
from .token_counts import token_counts
from .token_ids import token_id_files
from .toxicity import toxicity_scores
from .url_filter import judge_urls
from .vector_codes import compress
from .vector_topk import top_k

#: The url rules of the query: host, path, verdict.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), similarity=(100, 85))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_id_files(table(spark, sf_dir, "documents"))


def op6_chat_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse(table(spark, sf_dir, "conversations"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages"), rules)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))


def op12_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(table(spark, sf_dir, "documents"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    each = (
        op1_topk_search,
        op2_minhash_dedup,
        op3_token_counts,
        op4_toxicity,
        op5_token_ids,
        op6_chat_collapse,
        op7_url_filter,
        op8_decontaminate,
        op9_lm_score,
        op10_mix_sources,
        op11_vector_codes,
        op12_token_align,
        op13_exact_dedup,
    )
    return {f.__name__: f for f in each}


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""

OP2_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') AS g
  FROM d, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 85 * (na.n + nb.n - i)),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT a, r FROM reach JOIN links ON reach.doc_id = b)
SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r) AS component_id, d.doc_id = min(r) AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN reach USING (doc_id) GROUP BY d.doc_id
"""

OP6_SQL = """
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos, role, text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list(coalesce('+' || role, '-') || chr(1) || coalesce('+' || text, '-') ORDER BY pos) AS w, string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10), '' ORDER BY pos) AS text FROM t GROUP BY conv_id)
SELECT conv_id, CAST(0 AS INTEGER) AS part, CAST(len(w) AS BIGINT) AS n_turns, text FROM c a
WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.conv_id <> a.conv_id AND b.w[1 : len(a.w)] = a.w AND (len(b.w) > len(a.w) OR b.conv_id < a.conv_id))
"""

OP7_SQL = """
WITH urls AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(rh, rp, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fits AS (
  SELECT host, path, rh || rp AS rule, v,
         row_number() OVER (PARTITION BY host, path ORDER BY length(rh || rp) DESC, length(rh) DESC, v DESC) AS k
  FROM (SELECT DISTINCT host, path FROM urls) u JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, u.host, u.path, rule, coalesce(v, 'allow') AS verdict
FROM urls u LEFT JOIN fits f ON u.host = f.host AND u.path = f.path AND f.k = 1
"""

OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g
  FROM b, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS t(i) WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (
  SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS g
  FROM d, ks, unnest(range(1, len(w) - k + 2)) AS t(i) WHERE len(w) >= k),
m AS (SELECT doc_id, item_id, dw.k AS k, i FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, k, i FROM m)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def _op11_sql(rounds: int = 6, entries: int = 16, parts: int = 8) -> str:
    """Lloyd's rounds as common table expressions, one after another. ``c0`` to ``c6``
    hold the codebooks, ``a6`` the last assignment."""
    steps = [
        f"""e AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, part, e[1 + part * (len(e) // {parts}) : (part + 1) * (len(e) // {parts})] AS v FROM e, range({parts}) AS t(part)),
first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM e ORDER BY vec_id LIMIT {entries}),
c0 AS MATERIALIZED (SELECT part, entry, v AS c FROM p JOIN first USING (vec_id))"""
    ]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
  SELECT vec_id, part, min(v) AS v, min(d) AS error, arg_min(entry, (d, entry)) AS entry
  FROM (SELECT vec_id, p.part, v, entry, list_sum(list_transform(range(1, len(v) + 1), lambda j: (v[j] - c[j]) * (v[j] - c[j]))) AS d FROM p JOIN c{i} ON p.part = c{i}.part) GROUP BY vec_id, part)""")
        if i < rounds:
            steps.append(f"""u{i} AS (SELECT part, entry, j, sum(v[j]) AS s, count(*) AS n FROM a{i}, unnest(range(1, len(v) + 1)) AS t(j) GROUP BY part, entry, j),
n{i} AS (SELECT part, entry, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS c FROM u{i} GROUP BY part, entry),
c{i + 1} AS MATERIALIZED (SELECT part, entry, coalesce(n{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN n{i} USING (part, entry))""")
    return "WITH " + ",\n".join(steps) + f""",
codes AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(error) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id),
book AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM codes JOIN e USING (vec_id), book
"""


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS n FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY n) AS group_size, doc_id = first_value(doc_id) OVER w AS kept, sha256(n) AS text_sha256
FROM d WINDOW w AS (PARTITION BY n ORDER BY length(t) DESC, doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_topk_search": OP1_SQL, "op6_chat_collapse": OP6_SQL, "op2_minhash_dedup": OP2_SQL, "op7_url_filter": OP7_SQL, "op8_decontaminate": OP8_SQL, "op11_vector_codes": _op11_sql(), "op13_exact_dedup": OP13_SQL}
