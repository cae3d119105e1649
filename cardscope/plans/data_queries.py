"""Queries of the data preparation operators in the core, with their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardscope.operators import implausible, nested
from cardscope.sources import workload_lines
from cardscope.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return workload_lines.rejected_lines(table(spark, d, "workload_lines"))


def p2_loaded(spark: SparkSession, d: str) -> DataFrame:
    return workload_lines.loaded_queries(table(spark, d, "workload_lines"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.linked_records(table(spark, d, "treatment_results"), "treatment_id", "document", "all_joins")


def p4_nodes(spark: SparkSession, d: str) -> DataFrame:
    rows = nested.plan_tables(table(spark, d, "treatment_results"), "treatment_id", "document", attributes=True).where("record_kind = 'node'")
    a = F.col("attributes")
    return rows.select(
        "treatment_id", "path", "parent_path", a["Node Type"].alias("node_type"), a["Relation Name"].alias("relation_name"), a["Alias"].alias("alias"),
        a["Join Type"].alias("join_type"), a["Plan Rows"].try_cast("double").alias("plan_rows"), a["Total Cost"].try_cast("double").alias("total_cost"),
    )


def p4_workers(spark: SparkSession, d: str) -> DataFrame:
    rows = nested.plan_tables(table(spark, d, "treatment_results"), "treatment_id", "document", attributes=True).where("record_kind = 'worker'")
    return rows.select("treatment_id", "path", "parent_path", F.col("attributes")["Worker Number"].try_cast("int").alias("worker_number"))


def p4_attributes(spark: SparkSession, d: str) -> DataFrame:
    """Every member of every node and worker but their lists of these, as one more linked table; a nested value is named only."""
    rows = nested.plan_tables(table(spark, d, "treatment_results"), "treatment_id", "document", attributes=True)
    long = rows.select("treatment_id", "record_kind", "path", F.explode("attributes").alias("name", "value"))
    inner = F.col("value").rlike(r"^[{\[]")
    return long.select("treatment_id", "record_kind", "path", "name", F.when(~inner, F.col("value")).alias("value"))


def p4_joins(spark: SparkSession, d: str) -> DataFrame:
    return nested.join_tables(table(spark, d, "treatment_results"), "treatment_id", "all_joins")[0]


def p4_relations(spark: SparkSession, d: str) -> DataFrame:
    return nested.join_tables(table(spark, d, "treatment_results"), "treatment_id", "all_joins")[1]


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return implausible.flag_implausible(table(spark, d, "experiment_5_runtime"))


def p5_decomposed(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "experiment_5_runtime").dropDuplicates(["measurement_id"])
    rows = rows.where((F.col("status") == "ok") & ~F.coalesce("warmup", F.lit(False)) & ~implausible.impossible())
    return implausible.decomposed_outliers(rows, implausible.SOURCE, ["repetition", "measurement_id"], ["execution_time_ms", "wall_clock_duration_ms"], "measurement_id", period=None)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p2_found, p2_loaded, p4_found, p4_nodes, p4_workers, p4_attributes, p4_joins, p4_relations, p5_found, p5_decomposed)}


_JOINS = """
  SELECT DISTINCT treatment_id, 'j' || (i - 1) AS path, '' AS parent_path, j.node_type AS node_type, j.join_type AS join_type,
         j.is_base_join AS is_base_join, j.base_join_key AS base_join_key, j.plan_rows AS plan_rows
  FROM (SELECT treatment_id, unnest(all_joins) AS j, generate_subscripts(all_joins, 1) AS i FROM treatment_results)
  WHERE j IS NOT NULL"""
_RELATIONS = """
  SELECT DISTINCT treatment_id, 'j' || (i - 1) || '.' || (b - 1) || '.' || (k - 1) AS path, 'j' || (i - 1) AS parent_path,
         CAST(b - 1 AS INTEGER) AS branch, CAST(k - 1 AS INTEGER) AS place, relation
  FROM (SELECT treatment_id, i, b, unnest(members) AS relation, generate_subscripts(members, 1) AS k
        FROM (SELECT treatment_id, i, unnest(j.branch_relations) AS members, generate_subscripts(j.branch_relations, 1) AS b
              FROM (SELECT treatment_id, unnest(all_joins) AS j, generate_subscripts(all_joins, 1) AS i FROM treatment_results)
              WHERE j IS NOT NULL))
  WHERE relation IS NOT NULL"""
#: The plan nodes and workers of the documents; for other statements to build on.
PLAN_TREE = """
WITH RECURSIVE texts AS (
  SELECT DISTINCT treatment_id, CASE WHEN json_type(document) = 'VARCHAR' THEN document::JSON ->> '$' ELSE document END AS t
  FROM treatment_results WHERE json_valid(document)
), good AS (
  SELECT treatment_id, t::JSON AS j FROM texts WHERE json_valid(t)
), tree AS (
  SELECT treatment_id, '0' AS path, '' AS parent_path, [0::BIGINT] AS pos, plan, around FROM (
    SELECT treatment_id, unnest([j, list_filter(json_extract(j, '$[*]'), lambda x: json_type(x, '$.Plan') = 'OBJECT')[1], list_filter(json_extract(j, '$[*][*]'), lambda x: json_type(x, '$.Plan') = 'OBJECT')[1]]) AS around, around -> '$.Plan' AS plan, unnest([1, 2, 3]) AS depth FROM good
  ) WHERE json_type(plan) = 'OBJECT' QUALIFY row_number() OVER (PARTITION BY treatment_id ORDER BY depth) = 1
  UNION ALL
  SELECT treatment_id, path || '.' || (i - 1), path, list_append(pos, i - 1), child, NULL FROM (
    SELECT treatment_id, path, pos, unnest((plan -> '$.Plans')::JSON[]) AS child, generate_subscripts((plan -> '$.Plans')::JSON[], 1) AS i
    FROM tree WHERE json_type(plan, '$.Plans') = 'ARRAY'
  ) WHERE json_type(child) = 'OBJECT'
), workers AS (
  SELECT treatment_id, path || '.w' || (i - 1) AS path, path AS parent_path, child AS plan FROM (
    SELECT treatment_id, path, unnest((plan -> '$.Workers')::JSON[]) AS child, generate_subscripts((plan -> '$.Workers')::JSON[], 1) AS i
    FROM tree WHERE json_type(plan, '$.Workers') = 'ARRAY'
  ) WHERE json_type(child) = 'OBJECT'
)"""
_P4_FOUND = f"""{PLAN_TREE}
SELECT treatment_id, 'node' AS record_kind, path, parent_path FROM tree
UNION SELECT treatment_id, 'worker', path, parent_path FROM workers
UNION SELECT treatment_id, 'join', path, parent_path FROM ({_JOINS})
UNION SELECT treatment_id, 'relation', path, parent_path FROM ({_RELATIONS})
"""
_P4_NODES = f"""{PLAN_TREE}
SELECT treatment_id, path, parent_path, plan ->> '$."Node Type"' AS node_type, plan ->> '$."Relation Name"' AS relation_name, plan ->> '$.Alias' AS alias, plan ->> '$."Join Type"' AS join_type,
  TRY_CAST(plan ->> '$."Plan Rows"' AS DOUBLE) AS plan_rows, TRY_CAST(plan ->> '$."Total Cost"' AS DOUBLE) AS total_cost FROM tree"""
_P4_WORKERS = f"""{PLAN_TREE} SELECT treatment_id, path, parent_path, TRY_CAST(plan ->> '$."Worker Number"' AS INTEGER) AS worker_number FROM workers"""
_P4_ATTRIBUTES = f"""{PLAN_TREE}, records AS (
  SELECT treatment_id, 'node' AS record_kind, path, plan FROM tree UNION ALL SELECT treatment_id, 'worker', path, plan FROM workers
), members AS (
  SELECT treatment_id, record_kind, path, plan, unnest(json_keys(plan)) AS name FROM records
), named AS (SELECT *, plan -> ('$."' || name || '"') AS v FROM members WHERE name NOT IN ('Plans', 'Workers'))
SELECT treatment_id, record_kind, path, name, CASE WHEN json_type(v) NOT IN ('OBJECT', 'ARRAY') THEN coalesce(v ->> '$', 'null') END AS value FROM named"""
_B = r"[\s\x{00A0}\x{FEFF}]"
_TRIM = "trim({x}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160) || chr(65279))"
_NAME = "[a-z_][a-z0-9_]*"
_RELATION = f"(?:{'|'.join(workload_lines.TABLES)})(?: as)? {_NAME}"
_COMPARISON = rf"{_NAME}\.{_NAME} ?(?:<=|>=|=|<|>) ?(?:{_NAME}\.{_NAME}|[-+]?[0-9]+(?:\.[0-9]+)?|§(?: ?:: ?[a-z]+)?)"
_HEAD = rf"^select count ?\( ?\* ?\) from ({_RELATION}(?: ?, ?{_RELATION})*)(?: where (.+?))?[ ;]*$"
_QUOTED = "''[^'']*''|\"[^\"]*\""
#: Lines cut at the separators outside quoted pieces, and judged as TESTDATA.md lays down.
_LINES = rf"""
WITH lines AS (
  SELECT line_id, file_name, file_format, line_number, translate(raw_line, chr(10) || chr(13), '  ') AS raw FROM workload_lines WHERE {_TRIM.format(x="raw_line")} <> ''
), cut AS (
  SELECT *, string_split_regex(raw, '{_QUOTED}') AS outside, regexp_extract_all(raw, '{_QUOTED}') AS quoted FROM lines
), split AS (
  SELECT *, string_split(array_to_string(list_transform(list_zip(list_transform(outside, lambda o: replace(o, '||', chr(1))), quoted), lambda z: coalesce(z[1], '') || coalesce(z[2], '')), ''), chr(1)) AS parts,
    len(list_filter(outside, lambda o: contains(o, '''') OR contains(o, '"'))) > 0 OR len(list_filter(quoted, lambda q: starts_with(q, '"') AND (len(q) - len(replace(q, '''', ''))) % 2 = 1)) > 0 AS open_quote
  FROM cut
), fields AS (
  SELECT *, list_transform(list_transform(parts, lambda f: {_TRIM.format(x="f")}), lambda t: CASE WHEN len(t) > 1 AND starts_with(t, '"') AND ends_with(t, '"') THEN {_TRIM.format(x="replace(t[2:-2], '\"\"', '\"')")} ELSE t END) AS f FROM split
), named AS (
  SELECT *, CASE file_format WHEN 'complete' THEN 2 WHEN 'single_table' THEN 3 WHEN 'subquery' THEN 2 ELSE -1 END AS width, CASE file_format WHEN 'complete' THEN f[1] WHEN 'single_table' THEN f[3] END AS counted,
    CASE file_format WHEN 'complete' THEN f[2] ELSE f[1] END AS sql, CASE WHEN file_format IN ('single_table', 'subquery') THEN f[2] END AS id FROM fields
), texts AS (
  SELECT *, trim(regexp_replace(regexp_replace(lower(regexp_replace(sql, '''[^'']*''(?:''[^'']*'')*', '§', 'g')), '"({_NAME})"', '\1', 'g'), '{_B}+', ' ', 'g')) AS t FROM named
), heads AS (
  SELECT *, regexp_extract(t, '{_HEAD}', 1) AS rels, regexp_extract(t, '{_HEAD}', 2) AS conds FROM texts
), marks AS (
  SELECT *, regexp_replace(conds, '{_COMPARISON}', 'C', 'g') AS m, list_transform(string_split_regex(rels, ' ?, ?'), lambda r: string_split(r, ' ')[-1]) AS aliases,
    regexp_extract_all(conds, '({_NAME})\.{_NAME}', 1) AS used, regexp_extract_all(sql, '''([^'']*)''{_B}*::{_B}*(?i:timestamp)', 1) AS times FROM heads
), flat AS (
  SELECT *, list_reduce(list_prepend(m, list_transform(range(0, len(m) - len(replace(m, '(', '')) + 1), lambda i: '')), lambda acc, x: regexp_replace(acc, '\( ?C(?: and C)* ?\)', 'C', 'g')) AS c FROM marks
), judged AS (
  SELECT *, CASE WHEN open_quote THEN 'quoting' WHEN coalesce(len(f), -2) <> width THEN 'columns'
    WHEN coalesce((counted IS NULL OR regexp_full_match(counted, '(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?') AND coalesce(isfinite(TRY_CAST(counted AS DOUBLE)), false)) AND (id IS NULL OR regexp_full_match(id, '[0-9]+'))
      AND coalesce(regexp_full_match(line_number, '{_B}*0*[1-9][0-9]*{_B}*'), false) AND rels <> '' AND (conds = '' OR regexp_full_match(c, 'C(?: and C)*')) AND len(list_filter(used, lambda u: NOT list_contains(aliases, u))) = 0
      AND len(list_filter(times, lambda x: NOT (regexp_full_match(x, '[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}(?:[ T][0-9]{{1,2}}:[0-9]{{2}}(?::[0-9]{{2}}(?:\.[0-9]+)?)?)?') AND TRY_CAST(x AS TIMESTAMP) IS NOT NULL))) = 0, false) THEN NULL ELSE 'value' END AS reason
  FROM flat
)"""
_P2_FOUND = f"{_LINES} SELECT DISTINCT line_id, reason FROM judged WHERE reason IS NOT NULL"
_P2_LOADED = f"""{_LINES} SELECT DISTINCT ON (line_id) line_id, file_name, file_format, TRY_CAST({_TRIM.format(x="line_number")} AS BIGINT) AS query_line, coalesce(id, regexp_replace({_TRIM.format(x="line_number")}, '^0+', '')) AS query_id, sql AS query_sql,
  TRY_CAST(counted AS DOUBLE) AS actual_cardinality FROM judged WHERE reason IS NULL"""
_P5_FOUND = """
WITH once AS (
  SELECT DISTINCT ON (measurement_id) * FROM experiment_5_runtime
), judged AS (
  SELECT *, coalesce(NOT isfinite(execution_time_ms) OR execution_time_ms <= 0, false)
         OR coalesce(NOT isfinite(wall_clock_duration_ms) OR wall_clock_duration_ms <= 0, false)
         OR coalesce(execution_time_ms > wall_clock_duration_ms, false)
         OR coalesce(timeout AND wall_clock_duration_ms < timeout_seconds * 1000, false)
         OR coalesce(NOT timeout AND wall_clock_duration_ms > timeout_seconds * 1000, false) AS impossible
  FROM once
), usable AS (
  SELECT * FROM judged WHERE status = 'ok' AND NOT coalesce(warmup, false) AND NOT impossible
), level AS (
  SELECT *, median(execution_time_ms) OVER source AS em, median(wall_clock_duration_ms) OVER source AS wm
  FROM usable WINDOW source AS (PARTITION BY query_id, configuration)
), away AS (
  SELECT *, abs(execution_time_ms - em) AS ea, abs(wall_clock_duration_ms - wm) AS wa FROM level
), spread AS (
  SELECT *, median(ea) OVER source AS es, median(wa) OVER source AS ws FROM away WINDOW source AS (PARTITION BY query_id, configuration)
), runs AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, configuration ORDER BY repetition NULLS FIRST, measurement_id)
          - row_number() OVER (PARTITION BY query_id, configuration, execution_time_ms ORDER BY repetition NULLS FIRST, measurement_id) AS island
  FROM spread
), sized AS (
  SELECT *, count(*) OVER (PARTITION BY query_id, configuration, execution_time_ms, island) AS run FROM runs
)
SELECT measurement_id, 'impossible' AS kind FROM judged WHERE impossible
UNION ALL
SELECT measurement_id, CASE WHEN coalesce(ea > 9 * es, false) OR coalesce(wa > 9 * ws, false) THEN 'spike' ELSE 'stuck' END AS kind
FROM sized WHERE coalesce(ea > 9 * es, false) OR coalesce(wa > 9 * ws, false) OR (run >= 6 AND execution_time_ms IS NOT NULL)
"""


def oracle_sql() -> dict[str, str]:
    return {"p2_found": _P2_FOUND, "p2_loaded": _P2_LOADED, "p4_found": _P4_FOUND, "p4_nodes": _P4_NODES, "p4_workers": _P4_WORKERS, "p4_attributes": _P4_ATTRIBUTES, "p4_joins": _JOINS, "p4_relations": _RELATIONS, "p5_found": _P5_FOUND}
