"""Queries that SQL cannot say: networks, resampling, and Spark's own optimizer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cardscope.functions import metrics as M
from cardscope.operators import bootstrap, density, encoding, failures, implausible, workload
from cardscope.operators.encoding import Predicate
from cardscope.operators.joinchoice import key_relations
from cardscope.plans import explain
from cardscope.plans.data_queries import PLAN_TREE
from cardscope.plans.reference_queries import SQL_EVALUATED
from cardscope.plans.native import Catalog, roundtrip_ok
from cardscope.plans.requests import QueryGraph
from cardscope.plans.seed_workload import STATEMENTS
from cardscope.plans.treatments import train_tables
from cardscope.session import cut_lineage
from cardscope.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
_MODELLED = {
    "orders": ["o_orderstatus", "o_orderpriority", "o_totalprice"], "part": ["p_brand", "p_type", "p_size", "p_retailprice"], "lineitem": ["l_returnflag", "l_quantity", "l_discount"],
    "customer": ["c_mktsegment", "c_acctbal"], "events": ["event_type", "value"], "supplier": ["s_nationkey", "s_acctbal"], "region": ["r_name"],
}
_SINGLE = {
    "orders_status_price": "orders", "orders_priority": "orders", "lineitem_flags": "lineitem", "part_impossible": "part", "customer_segment": "customer", "events_clicks": "events",
}
_TARGETS, _SEEDS = 10, [123, 124, 125, 126, 127]


_trained: dict[tuple[str, str], dict[str, density.Estimator]] = {}


def estimators(spark: SparkSession, d: str) -> dict[str, density.Estimator]:
    """The models of all modelled tables of a folder, trained once in a session."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _trained:
        _trained.clear()
        _trained[key] = train_tables(spark, {t: table(spark, d, t) for t in _MODELLED}, _MODELLED)
    return _trained[key]


def _estimator(spark: SparkSession, d: str, t: str) -> density.Estimator:
    e = estimators(spark, d)[t]
    return density.Estimator(e.encoder, e.model)


def made_estimates(spark: SparkSession, d: str) -> DataFrame:
    """Learned estimates of single-table statements next to their exact counts."""
    out = None
    owners = list(dict.fromkeys(_SINGLE.values()))
    for t in owners:
        requests = {n: QueryGraph.parse(spark, STATEMENTS[n]).translate(t)[0] for n, owner in _SINGLE.items() if owner == t}
        part = density.estimates(spark, _estimator(spark, d, t), requests)
        out = part if out is None else out.unionByName(part)
    graphs = {n: QueryGraph.parse(spark, STATEMENTS[n]) for n in _SINGLE}
    exact = workload.exact_base_counts({t: table(spark, d, t) for t in owners}, graphs)
    rows = out.join(F.broadcast(exact), "query_id")
    return rows.withColumn("q_error", M.q_error(F.col("cardinality"), F.col("exact_cardinality")))


def seed_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    """Sampled estimates of the ten worst filtered base-table statements under five seeds, with their spread.

    A base-table statement is what the filters of a seed statement ask of one of its relations; equal ones count once.
    All are sampled. Worst is the largest q-error under the first seed, then the name."""
    graphs = {n: QueryGraph.parse(spark, s) for n, s in STATEMENTS.items()}
    exact = workload.exact_base_counts({t: table(spark, d, t) for t in {r.table for g in graphs.values() for r in g.relations}}, graphs)
    requests: dict[str, dict[str, list[Predicate]]] = {}
    relations = {}
    for n, g in graphs.items():
        for r in g.relations:
            ps = g.translate(r.alias)[0]
            known = requests.setdefault(r.table, {})
            if ps and ps not in known.values():
                known[f"{n}/{r.key}"] = ps
                relations[f"{n}/{r.key}"] = (n, r.key, r.table)
    out = None
    for t, of_table in requests.items():
        if not of_table:
            continue
        e = _estimator(spark, d, t)
        e.enumeration_cap = 0
        part = density.estimates(spark, e, of_table, seeds=_SEEDS)
        out = part if out is None else out.unionByName(part)
    named = spark.createDataFrame([(k, *v) for k, v in relations.items()], "target string, statement string, key string, table string")
    counted = named.join(exact, (F.col("statement") == F.col("query_id")) & (F.col("key") == F.col("relation"))).select(F.col("target").alias("query_id"), "table", "exact_cardinality")
    rows = cut_lineage(out.join(F.broadcast(counted), "query_id").withColumn("q_error", M.q_error(F.col("cardinality"), F.col("exact_cardinality"))))
    first = rows.where(F.col("seed") == _SEEDS[0])
    targets = first.select("query_id", F.row_number().over(Window.orderBy(F.col("q_error").desc(), "query_id")).alias("rank")).where(F.col("rank") <= _TARGETS)
    spread = rows.groupBy("query_id").agg(F.avg("cardinality").alias("mean"), (F.try_divide(F.stddev("cardinality"), F.avg("cardinality")) * 100).alias("variation_percent"))
    return rows.join(F.broadcast(targets), "query_id").join(F.broadcast(spread), "query_id")


def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    """Differences learned - native of three error metrics: rows resampled, and statements and templates as clusters."""
    rows = failures.evaluated(table(spark, d, "experiment_2_failures"), table(spark, d, "base_queries")).where("status = 'ok'")
    rows = cut_lineage(rows.select("learned_q_error", "native_q_error", "normalized_sql_id", "query_template"))  # read by every unit
    out = None
    for unit in ("occurrence", "normalized_sql_id", "query_template"):
        part = bootstrap.paired_bootstrap(spark, rows, "learned_q_error", "native_q_error", clusters=None if unit == "occurrence" else unit).withColumn("unit", F.lit(unit))
        out = part if out is None else out.unionByName(part)
    return out


def observed_deltas(spark: SparkSession, d: str) -> DataFrame:
    """The differences learned - native that `bootstrap_ci` gives intervals for, in all three units."""
    rows = failures.evaluated(table(spark, d, "experiment_2_failures"), table(spark, d, "base_queries")).where("status = 'ok'")
    rows = cut_lineage(rows.select("learned_q_error", "native_q_error", "normalized_sql_id", "query_template"))
    out = None
    for unit in ("occurrence", "normalized_sql_id", "query_template"):
        part = bootstrap.observed_deltas(spark, rows, "learned_q_error", "native_q_error", clusters=None if unit == "occurrence" else unit).withColumn("unit", F.lit(unit))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("observed_delta", F.round(F.col("observed_delta") + F.signum("observed_delta") * 1e-8, 6))


def plan_facts(spark: SparkSession, d: str) -> DataFrame:
    facts = explain.plan_facts(table(spark, d, "treatment_results"), "treatment_id", "document")
    return facts.withColumn("all_base_joins", F.array_join("all_base_joins", ";"))


def plan_joins(spark: SparkSession, d: str) -> DataFrame:
    """The joins that each recorded plan document says, next to nothing else: one row per join, inner ones first."""
    rows = explain.plan_joins(table(spark, d, "treatment_results"), "treatment_id", "document")
    return rows.withColumns({"relations": F.array_join("relations", "|"), "branch_relations": F.array_join(F.transform("branch_relations", lambda b: F.array_join(b, "|")), ";")})


def plan_scans(spark: SparkSession, d: str) -> DataFrame:
    return explain.plan_scans(table(spark, d, "treatment_results"), "treatment_id", "document")


def plan_hashes(spark: SparkSession, d: str) -> DataFrame:
    return explain.plan_hashes(table(spark, d, "treatment_results"), "treatment_id", "document")


def impossible_readings(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "experiment_5_runtime").dropDuplicates(["measurement_id"])
    return rows.groupBy("configuration").agg(F.count_if(implausible.impossible()).alias("impossible"), F.count("*").alias("readings"))


def native_estimates(spark: SparkSession, d: str) -> DataFrame:
    """The optimizer's own estimate of every filtered relation of the seed statements, next to the exact counts."""
    graphs = {n: QueryGraph.parse(spark, s) for n, s in STATEMENTS.items()}
    rows = []
    with Catalog(spark, d) as catalog:
        for n, g in graphs.items():
            s = catalog.statement(g)
            rows += [(n, r.key, s.base_estimate(r.alias)) for r in g.relations]
    exact = workload.exact_base_counts({t: table(spark, d, t) for t in {r.table for g in graphs.values() for r in g.relations}}, graphs)
    got = spark.createDataFrame(rows, "query_id string, relation string, native_estimate double")
    return got.join(exact, ["query_id", "relation"]).withColumn("q_error", M.q_error(F.col("native_estimate"), F.col("exact_cardinality")))


def injection_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Injected cardinalities and what the optimizer then expects."""
    rows = []
    with Catalog(spark, d) as catalog:
        for n, sql in STATEMENTS.items():
            s = catalog.statement(QueryGraph.parse(spark, sql))
            for r in s.graph.relations:
                possible = s.base_estimate(r.alias) > 0  # an estimate of nothing cannot be scaled
                for wanted in (0.25, 1.0, 42.0, 966.0) if possible else ():
                    got = s.inject({r.alias: wanted})[r.alias]
                    rows.append((n, r.key, wanted, got, roundtrip_ok(wanted, got)))
                    s.restore()
    return spark.createDataFrame(rows, "query_id string, relation string, wanted double, got double, within_tolerance boolean")


def catalyst_join_choice(spark: SparkSession, d: str) -> DataFrame:
    """First joins that Spark chooses with its own estimates, with exact base cardinalities, and the exact size of both."""
    graphs = {n: g for n, s in STATEMENTS.items() if len((g := QueryGraph.parse(spark, s)).relations) > 1}
    tables = {t: table(spark, d, t) for t in {r.table for g in graphs.values() for r in g.relations}}
    counts = workload.ExactCounts(spark, tables)
    rows = []
    with Catalog(spark, d) as catalog:
        for n, g in graphs.items():
            s = catalog.statement(g)
            native = s.first_base_join()
            s.inject({r.alias: float(counts.count(g, frozenset((r.alias,)))[0]) for r in g.relations})
            exact = s.first_base_join()
            by_key = {r.key: r.alias for r in g.relations}
            size = {k: counts.count(g, frozenset(by_key[x] for x in key_relations(k, list(by_key))))[0] if k else None for k in (native, exact)}
            rows.append((n, native, exact, size[native], size[exact]))
    out = spark.createDataFrame(rows, "query_id string, native_first_join string, exact_first_join string, native_output bigint, exact_output bigint")
    return out.withColumns({"changed": F.col("native_first_join") != F.col("exact_first_join"), "native_relative_output": M.relative_output(F.col("native_output"), F.col("exact_output"))})


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (made_estimates, seed_sensitivity, bootstrap_ci, observed_deltas, plan_facts, plan_joins, plan_scans, plan_hashes, native_estimates, injection_roundtrip, catalyst_join_choice, impossible_readings)}


_IMPOSSIBLE = """SELECT configuration, count(*) FILTER (coalesce(NOT isfinite(execution_time_ms) OR execution_time_ms <= 0, false) OR coalesce(NOT isfinite(wall_clock_duration_ms) OR wall_clock_duration_ms <= 0, false)
  OR coalesce(execution_time_ms > wall_clock_duration_ms, false) OR coalesce(timeout AND wall_clock_duration_ms < timeout_seconds * 1000, false) OR coalesce(NOT timeout AND wall_clock_duration_ms > timeout_seconds * 1000, false)) AS impossible,
  count(*) AS readings FROM (SELECT DISTINCT ON (measurement_id) * FROM experiment_5_runtime) GROUP BY 1"""


_FACTS = f"""{PLAN_TREE}, named AS (
  SELECT treatment_id, path, parent_path, pos, plan, around, coalesce(plan ->> '$."Node Type"', '') AS node_type, plan ->> '$."Relation Name"' AS relation_name, plan ->> '$.Alias' AS alias,
    contains(node_type, 'Join') OR node_type = 'Nested Loop' OR json_exists(plan, '$."Join Type"') AS joins FROM tree
), scans AS (
  SELECT *, CASE WHEN coalesce(alias, '') IN ('', relation_name) THEN relation_name ELSE relation_name || ':' || alias END AS key FROM named WHERE relation_name <> ''
), sides AS (
  SELECT j.treatment_id, j.path, c.path AS side, c.pos AS spot FROM named j JOIN named c ON c.treatment_id = j.treatment_id AND c.parent_path = j.path WHERE j.joins
), leaves AS (
  SELECT DISTINCT x.treatment_id, x.path, x.side, s.key FROM sides x JOIN scans s ON s.treatment_id = x.treatment_id AND starts_with(s.path || '.', x.side || '.')
  WHERE NOT EXISTS (SELECT 1 FROM scans a WHERE a.treatment_id = s.treatment_id AND a.path <> s.path AND starts_with(s.path || '.', a.path || '.') AND starts_with(a.path || '.', x.side || '.'))
), sided AS (
  SELECT treatment_id, path, side, spot, coalesce(array_to_string(list_sort(list(key) FILTER (key IS NOT NULL)), '|'), '') AS relations, count(key) AS n FROM sides LEFT JOIN leaves USING (treatment_id, path, side) GROUP BY ALL
), joined AS (
  SELECT j.treatment_id, j.path, list_append(j.pos, 9223372036854775807) AS last, j.node_type, plan ->> '$."Join Type"' AS join_type, TRY_CAST(plan ->> '$."Plan Rows"' AS DOUBLE) AS plan_rows,
    coalesce((SELECT array_to_string(list_sort(list(DISTINCT key)), '|') FROM leaves l WHERE l.treatment_id = j.treatment_id AND l.path = j.path), '') AS relations,
    coalesce((SELECT string_agg(relations, ';' ORDER BY spot) FROM sided s WHERE s.treatment_id = j.treatment_id AND s.path = j.path), '') AS branch_relations,
    (SELECT count(*) = 2 AND coalesce(bool_and(n = 1), false) FROM sided s WHERE s.treatment_id = j.treatment_id AND s.path = j.path) AS is_base_join
  FROM named j WHERE j.joins
), ordered AS (
  SELECT *, CASE WHEN is_base_join THEN relations END AS base_join_key, row_number() OVER (PARTITION BY treatment_id ORDER BY last) - 1 AS place FROM joined
)"""
_PLAN_FACTS = f"""{_FACTS}
SELECT n.treatment_id, TRY_CAST(plan ->> '$."Plan Rows"' AS DOUBLE) AS root_rows, f.first_base_join, coalesce(f.all_base_joins, '') AS all_base_joins,
  (SELECT count(*) FROM scans s WHERE s.treatment_id = n.treatment_id)::INTEGER AS scans, coalesce(f.joins, 0)::INTEGER AS joins,
  TRY_CAST(around ->> '$."Execution Time"' AS DOUBLE) AS execution_time_ms, TRY_CAST(around ->> '$."Planning Time"' AS DOUBLE) AS planning_time_ms, TRY_CAST(plan ->> '$."Actual Rows"' AS DOUBLE) AS actual_rows
FROM named n LEFT JOIN (
  SELECT treatment_id, min_by(base_join_key, place) FILTER (is_base_join) AS first_base_join, string_agg(base_join_key, ';' ORDER BY place) FILTER (is_base_join) AS all_base_joins, count(*) AS joins FROM ordered GROUP BY 1
) f USING (treatment_id) WHERE n.path = '0'"""
_PLAN_JOINS = f"{_FACTS} SELECT treatment_id, place::INTEGER AS place, node_type, join_type, relations, branch_relations, is_base_join, base_join_key, plan_rows FROM ordered"
_PLAN_SCANS = f"""{_FACTS} SELECT treatment_id, (row_number() OVER (PARTITION BY treatment_id ORDER BY pos) - 1)::INTEGER AS place, key AS relation_key, relation_name, coalesce(alias, '') AS alias, node_type,
  TRY_CAST(plan ->> '$."Plan Rows"' AS DOUBLE) AS plan_rows, plan ->> '$.Filter' AS filter, plan ->> '$."Index Cond"' AS index_cond FROM scans"""


_DELTAS = f"""{SQL_EVALUATED}, units AS (
  SELECT 'occurrence' AS unit, NULL AS clusters UNION ALL SELECT 'normalized_sql_id', (SELECT count(DISTINCT normalized_sql_id) + max((normalized_sql_id IS NULL)::INTEGER) FROM v) UNION ALL SELECT 'query_template', (SELECT count(DISTINCT query_template) + max((query_template IS NULL)::INTEGER) FROM v)
), deltas AS (
  SELECT 'median_q_error' AS metric, count(*) AS n, median(learned_q_error) - median(native_q_error) AS x FROM v UNION ALL SELECT 'geometric_mean_q_error', count(*), exp(avg(ln(learned_q_error))) - exp(avg(ln(native_q_error))) FROM v
  UNION ALL SELECT 'fraction_q_error_le2', count(*), count(*) FILTER (learned_q_error <= 2) / count(*) - count(*) FILTER (native_q_error <= 2) / count(*) FROM v
)
SELECT metric, n AS sample_count, clusters::BIGINT AS cluster_count, round(x + sign(x) * 1e-8, 6) AS observed_delta, unit FROM deltas, units"""


def oracle_sql() -> dict[str, str]:
    return {"observed_deltas": _DELTAS, "impossible_readings": _IMPOSSIBLE, "plan_facts": _PLAN_FACTS, "plan_joins": _PLAN_JOINS, "plan_scans": _PLAN_SCANS}
