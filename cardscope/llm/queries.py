"""Queries of the training-text operators, with their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardscope.llm import copies, digests, leakage, mixture, residue
from cardscope.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
#: Record set, key and statement column.
_RECORD_SETS = (("workload_queries", "query_key", "sql"), ("base_queries", "occurrence_key", "normalized_sql"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    parts = [copies.formatted_copies(table(spark, d, t), key, "run_id", text).select(F.lit(t).alias("record_set"), "first_key", "copy_key") for t, key, text in _RECORD_SETS]
    return parts[0].unionByName(parts[1])


def p1_statements(spark: SparkSession, d: str) -> DataFrame:
    parts = [copies.counted_statements(table(spark, d, t), key, "run_id", text).select(F.lit(t).alias("record_set"), F.col("run").alias("run_id"), "first_key", "copies") for t, key, text in _RECORD_SETS]
    return parts[0].unionByName(parts[1])


#: Percentiles of the result.
_FRACTIONS = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def _daily_digests(spark: SparkSession, d: str) -> DataFrame:
    keys, values = ["query_template", "table"], ["learned_q_error", "native_q_error"]
    once = table(spark, d, "experiment_2_failures").select("result_id", "run_day", *keys, *values).dropDuplicates(["result_id"])
    return digests.digests(once, [*keys, "run_day"], values)


def p3_percentiles(spark: SparkSession, d: str) -> DataFrame:
    found = digests.percentiles(_daily_digests(spark, d), ["query_template", "table"], _FRACTIONS)
    return found.select(*(F.round(c, 6).alias(c) if c in _FRACTIONS else c for c in found.columns))


def p3_digests(spark: SparkSession, d: str) -> DataFrame:
    return _daily_digests(spark, d)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"), fields=("item_text",))


def p6_passages(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_passages(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p7_weighted(spark: SparkSession, d: str) -> DataFrame:
    """The mixture with unequal chances: of the documents of a source, one of known language is twice as likely as any other."""
    documents = table(spark, d, "documents").withColumn("weight", F.when(F.col("lang").isNull(), 1.0).otherwise(2.0))
    return mixture.mixture(documents, table(spark, d, "mix_targets"), weight_col="weight")[0]


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue_records(table(spark, d, "documents"))


def p8_passages(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue_passages(table(spark, d, "documents"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_statements, p3_percentiles, p3_digests, p6_found, p6_passages, p7_mixture, p7_shares, p7_weighted, p8_found, p8_passages)}


_CLASSES = """
WITH records AS (
  SELECT 'workload_queries' AS record_set, query_key AS key, run_id, sql AS statement FROM workload_queries
  UNION ALL SELECT 'base_queries', occurrence_key, run_id, normalized_sql FROM base_queries
), tokens AS (
  SELECT record_set, key, run_id, trim(array_to_string(list_transform(string_split(statement, ''''), lambda p, i:
    CASE WHEN i % 2 = 0 THEN hex(p) ELSE regexp_replace(regexp_replace(lower(p), '[\\s\\x{0085}\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"();]+', ' ', 'g'), ' ?([<>=.,:*]+) ?', '\\1', 'g') END), '''')) AS t
  FROM records
), parts AS (
  SELECT record_set, key, run_id, t, regexp_extract(t, '^select ?(.*?) ?from (.*?)(?: where (.*))?$', ['h', 'r', 'c']) AS x FROM tokens
), canon AS (
  SELECT record_set, key, run_id, CASE WHEN t IS NOT NULL THEN concat_ws(chr(10), x.h,
    list_sort(list_transform(string_split(x.r, ','), lambda r: replace(trim(r), ' as ', ' '))),
    list_sort(list_transform(string_split(x.c, ' and '), lambda c:
      CASE WHEN regexp_full_match(trim(c), '[a-z_][a-z0-9_]*\\.[a-z_][a-z0-9_]*=[a-z_][a-z0-9_]*\\.[a-z_][a-z0-9_]*')
           THEN array_to_string(list_sort(string_split(trim(c), '=')), '=') ELSE trim(c) END))) ELSE 'key' || key END AS statement
  FROM parts
), classes AS (
  SELECT record_set, run_id, key, min(key) OVER (PARTITION BY record_set, run_id, statement) AS first_key FROM canon
)"""


_P6_FOUND = """
WITH item_words AS (
  SELECT item_id, regexp_extract_all(lower(item_text), '[\\p{L}\\p{N}]+') AS w FROM eval_items
), shingles AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + 11], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM item_words)
), doc_words AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents
), doc_shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 11], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM doc_words)
)
SELECT DISTINCT doc_id, item_id FROM doc_shingles JOIN shingles USING (s)
"""


_LEAVES = """
WITH once AS (
  SELECT DISTINCT ON (result_id) * FROM experiment_2_failures
), measured AS (
  SELECT query_template, "table", run_day, 'learned_q_error' AS metric, learned_q_error AS x FROM once
  UNION ALL SELECT query_template, "table", run_day, 'native_q_error', native_q_error FROM once
), leaves AS (
  SELECT query_template, "table", run_day, metric, CAST(least(floor(ln(x) / ln(2.0) * 1024 + 1e-9), 1048575) AS INTEGER) AS leaf
  FROM measured WHERE NOT isnan(x) AND x >= 1 AND isfinite(x)
)"""
#: Groups of up to 20,000 rows aren't compressed at a rank error of 0.001, so the result is the exact percentile of the leaves.
_P3_PERCENTILES = f"""{_LEAVES}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_template, "table", metric ORDER BY leaf) AS r,
         count(*) OVER (PARTITION BY query_template, "table", metric) AS n FROM leaves
)
SELECT query_template, "table", metric, n,
       {", ".join(f"round(pow(2.0, max(CASE WHEN r = greatest(ceil({q} * n - 1e-9), 1) THEN leaf END) / 1024.0), 6) AS {c}" for c, q in _FRACTIONS.items())},
       0.001::DOUBLE AS rank_error, pow(2.0, 1 / 1024.0) - 1 AS value_error
FROM ranked GROUP BY query_template, "table", metric, n"""
_P3_DIGESTS = f"""{_LEAVES}
SELECT query_template, "table", run_day, metric, CAST(leaf + 1048576 AS INTEGER) AS node, count(*) AS n FROM leaves GROUP BY ALL"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_percentiles": _P3_PERCENTILES,
        "p3_digests": _P3_DIGESTS,
        "p6_found": _P6_FOUND,
        "p1_found": f"{_CLASSES} SELECT record_set, first_key, key AS copy_key FROM classes WHERE key <> first_key",
        "p1_statements": f"{_CLASSES} SELECT record_set, run_id, first_key, count(*) AS copies FROM classes GROUP BY ALL",
    }
