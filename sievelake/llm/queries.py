"""The queries of this subpackage, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import chatformat, decontam, fixity, licenses, mixing, neardup, pqdup, sharding, suffixdedup, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    C.settle(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxic_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_license_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_notices(_table(spark, sf_dir, "documents"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_mixed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_table(spark, sf_dir, "documents"))


def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.sharded(docs).selectExpr("doc_id", "coalesce(octet_length(text), 0) AS bytes", "shard")


def op6_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.repeated(_table(spark, sf_dir, "documents"))


def damaged(pages: DataFrame) -> DataFrame:
    """A replica of the pages with known faults, by MD5 of the id: payloads cut short, others altered, records lost."""
    fault = F.substring(F.md5(F.col("page_id").cast("string")), 1, 2)
    html = F.when(fault == "00", F.expr("substring(html, 1, length(html) - 1)")).when(fault == "01", F.concat("html", F.lit("."))).otherwise(F.col("html"))
    return pages.where(fault != "02").withColumn("html", html)


def op7_fixity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    original, replica = fixity.Tree(pages), fixity.Tree(damaged(pages))
    out = fixity.audit(original, replica)
    original.discard()
    replica.discard()
    return out


def op8_chat_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chatformat.formatted(_table(spark, sf_dir, "conversations"))


def op9_similar_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pqdup.similar(_table(spark, sf_dir, "embeddings"))


def op10_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_toxic_documents": op1_toxic_documents,
    "op2_license_notices": op2_license_notices,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_mixed_sources": op4_mixed_sources,
    "op5_shards": op5_shards,
    "op6_repeated_passages": op6_repeated_passages,
    "op7_fixity_audit": op7_fixity_audit,
    "op8_chat_round_trip": op8_chat_round_trip,
    "op9_similar_embeddings": op9_similar_embeddings,
    "op10_benchmark_leaks": op10_benchmark_leaks,
}

_MIX = f"""
WITH RECURSIVE n AS (
  SELECT doc_id, source, len(regexp_extract_all(text, '\\S+')) AS n FROM documents WHERE text IS NOT NULL
), t AS (
  SELECT source, sum(n)::DOUBLE AS n, sum(sum(n)) OVER ()::DOUBLE AS every, count(*) OVER () AS kinds FROM n WHERE n > 0 GROUP BY source
), own AS (
  SELECT -sum(n / every * ln(n / every)) - {mixing.ENTROPY} * ln(count(*)) > 1e-12 AND count(*) > 1 AS even,
    count(*) = 1 OR ln(count(*)) <= {mixing.ENTROPY} * ln(count(*)) AND max(every / kinds * {mixing.BUDGET} / n) <= {mixing.EPOCHS} AS uniform FROM t
), bisect(i, even, lo, hi) AS (
  SELECT 0, even, CASE WHEN even THEN 1 ELSE 0 END::DOUBLE, CASE WHEN even THEN {mixing.STEEPEST} WHEN uniform THEN 0 ELSE 1 END::DOUBLE FROM own
  UNION ALL
  SELECT i + 1, even, CASE WHEN even = fits THEN (lo + hi) / 2 ELSE lo END, CASE WHEN even = fits THEN hi ELSE (lo + hi) / 2 END FROM (
    SELECT b.i, b.even, b.lo, b.hi, (
      SELECT CASE WHEN b.even THEN -sum(w * ln(w)) >= {mixing.ENTROPY} * ln(count(*)) AND max(w * {mixing.BUDGET} * every / n) <= greatest({mixing.EPOCHS}, {mixing.BUDGET})
        ELSE -sum(w * ln(w)) <= {mixing.ENTROPY} * ln(count(*)) AND max(w * {mixing.BUDGET} * every / n) <= {mixing.EPOCHS} END
      FROM (SELECT pow(n / every, (b.lo + b.hi) / 2) / sum(pow(n / every, (b.lo + b.hi) / 2)) OVER () AS w, every, n FROM t)
    ) AS fits FROM bisect b WHERE i < 40 AND hi > 0)
), alpha AS (SELECT CASE WHEN arg_max(even, i) THEN arg_max(lo, i) ELSE arg_max(hi, i) END AS a FROM bisect
), q AS (
  SELECT source, n::BIGINT AS n, floor(pow(n / every, a) / sum(pow(n / every, a)) OVER () * {mixing.BUDGET} * every)::BIGINT AS quota FROM t, alpha
), e AS (
  SELECT n.doc_id, n.source, n.n, q.n AS total, q.quota, unnest(range(ceil(q.quota::DOUBLE / q.n)::BIGINT)) AS epoch
  FROM n JOIN q ON n.source IS NOT DISTINCT FROM q.source WHERE n.n > 0
), k AS (
  SELECT *, ('0x' || substr(md5('{mixing.SEED}|' || epoch || '|' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS k FROM e
), s AS (
  SELECT *, epoch * total + coalesce(sum(n) OVER (PARTITION BY source, epoch ORDER BY k RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP), 0) AS start FROM k
)
SELECT doc_id, source, epoch::INT AS epoch, (start * {mixing.BLOCKS} // quota)::INT AS block FROM s WHERE start < quota
"""

_FIXITY = f"""
WITH p AS (
  SELECT page_id, substr(md5(page_id::VARCHAR), 1, 2) AS fault, url, html FROM pages WHERE page_id IS NOT NULL
), r AS (
  SELECT page_id, fault, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Length: ' AS head, html,
    CASE fault WHEN '00' THEN substr(html, 1, length(html) - 1) WHEN '01' THEN html || '.' ELSE html END AS html_b FROM p
), w AS (
  SELECT page_id, fault, head || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) AS rec,
    head || strlen(html_b) || chr(13) || chr(10) || chr(13) || chr(10) || html_b || chr(13) || chr(10) || chr(13) || chr(10) AS rec_b FROM r
), o AS (
  SELECT *, strlen(rec) AS length, (sum(strlen(rec)) OVER (PARTITION BY page_id // {fixity.SEGMENT} ORDER BY page_id) - strlen(rec))::BIGINT AS "offset" FROM w
)
SELECT page_id, CASE WHEN fault = '02' THEN 'missing' ELSE 'changed' END AS status, "offset", length, sha256(rec) AS hash, CASE WHEN fault <> '02' THEN sha256(rec_b) END AS replica_hash
FROM o WHERE fault IN ('00', '01', '02')
"""

_CHAT = r"""
WITH m AS (
  SELECT conv_id, turn, role, text, coalesce(regexp_matches(role || '|' || text, '<\\*\|(turn|end|null|n|r)\|>'), FALSE) AS marked FROM conversations
)
SELECT conv_id, count(*)::INT AS turns, count_if(marked)::INT AS escaped_turns,
  string_agg('<|turn|>' || coalesce(role, '<|null|>') || chr(10) || coalesce(CASE WHEN marked THEN regexp_replace(text, '<(\\*)\|(turn|end|null|n|r)\|>', '<\1\\|\2|>', 'g') ELSE text END, '<|null|>') || '<|end|>' || chr(10), '' ORDER BY turn, role, text) AS rendered
FROM m GROUP BY conv_id
"""

#: SQL can't express the random walks, patience alignments, consistent samples, suffix arrays, product codes and
#: edit alignments of the others, nor, short of a recursion over every group and capacity, the greedy checks of
#: the sharding; tests hold those against brute force.
ORACLES = {"op4_mixed_sources": _MIX, "op7_fixity_audit": _FIXITY, "op8_chat_round_trip": _CHAT}
