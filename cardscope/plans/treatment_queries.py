"""Queries of live treatments and of the operators around them, with SQL for all that does not depend on models, clocks or Spark's choices."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardscope.functions import metrics as M
from cardscope.operators import encoding, failures, joinchoice, runtime, workload
from cardscope.operators.encoding import Predicate
from cardscope.plans import explain, treatments
from cardscope.plans import reference_queries as R
from cardscope.plans.model_queries import estimators
from cardscope.plans.requests import QueryGraph
from cardscope.plans.seed_workload import STATEMENTS
from cardscope.sources.tables import scalar, scan, table

Query = Callable[[SparkSession, str], DataFrame]
_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def _tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {t: table(spark, d, t) for t in _TABLES}


def _joined(spark: SparkSession) -> dict[str, QueryGraph]:
    return {n: g for n, s in STATEMENTS.items() if len((g := QueryGraph.parse(spark, s)).relations) > 1}


def _exact(spark: SparkSession, d: str, graphs: dict[str, QueryGraph]) -> dict[tuple[str, str], int]:
    rows = workload.exact_base_counts(_tables(spark, d), graphs).collect()  # a row a relation of a statement
    return {(r["query_id"], r["relation"]): r["exact_cardinality"] for r in rows}


_runs: dict[tuple[str, str], treatments.Treatments] = {}


def _treated(spark: SparkSession, d: str) -> treatments.Treatments:
    """All joined statements under native, learned and exact base cardinalities, once in a session."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _runs:
        graphs = _joined(spark)
        _runs.clear()
        _runs[key] = treatments.treat(spark, d, graphs, estimators(spark, d), _exact(spark, d, graphs))
    return _runs[key]


def treatment_runs(spark: SparkSession, d: str) -> DataFrame:
    return _treated(spark, d).table(spark)


def treatment_failures(spark: SparkSession, d: str) -> DataFrame:
    return _treated(spark, d).failure_table(spark)


def treatment_cardinalities(spark: SparkSession, d: str) -> DataFrame:
    """What exact treatments inject, and whether the optimizer then expects it."""
    rows = _treated(spark, d).table(spark).where("config = 'exact_base'")
    each = rows.select("query_id", "treatment_valid", F.explode("base_estimates").alias("relation", "exact_cardinality"), "injected_estimates", "expected_estimates")
    injected, expected = F.element_at("injected_estimates", F.col("relation")), F.element_at("expected_estimates", F.col("relation"))
    back = F.abs(injected - expected) <= F.greatest(F.lit(1.0), injected * 1e-6)
    return each.select("query_id", "relation", F.col("exact_cardinality").cast("bigint").alias("exact_cardinality"), injected.cast("bigint").alias("injected_cardinality"), back.alias("expected_as_injected"))


def first_join_candidates(spark: SparkSession, d: str) -> DataFrame:
    return R.rounded(treatments.candidate_joins(_joined(spark), spark, _tables(spark, d)))


def _influence(spark: SparkSession, d: str) -> DataFrame:
    """Live treatments in the form of recorded ones, with the exact rows of every statement and of the chosen first joins."""
    graphs = _joined(spark)
    rows = _treated(spark, d).table(spark)
    keys = spark.createDataFrame([(i, n, n, len(g.relations)) for i, (n, g) in enumerate(graphs.items())], "query_key bigint, query_id string, template string, query_size int")
    whole = R.reduce(DataFrame.unionByName, [g.data(spark, _tables(spark, d)).agg(F.lit(n).alias("query_id"), F.count("*").cast("double").alias("actual_cardinality")) for n, g in graphs.items()])
    found = joinchoice.influence(rows, keys.join(whole, "query_id"))
    return treatments.with_outputs(found, treatments.candidate_joins(graphs, spark, _tables(spark, d)))


def live_influence(spark: SparkSession, d: str) -> DataFrame:
    cols = ["query_id", "query_size", "base_join_changed", "full_plan_changed", "treatment_valid", "maximum_absolute_log_difference", "treatment_category", "decision_category", "status"]
    return _influence(spark, d).select(*cols, *(f"{s}_first_base_join" for s in ("native", "learned", "exact")))


def live_join_outputs(spark: SparkSession, d: str) -> DataFrame:
    """Exact outputs of the first joins chosen, relative to that of the exact treatment."""
    return _influence(spark, d).select("query_id", "native_output", "learned_output", "exact_output", "native_relative_output", "learned_relative_output", "decision_category")


def live_join_quality(spark: SparkSession, d: str) -> DataFrame:
    return joinchoice.quality_summary(_influence(spark, d))


def live_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return joinchoice.complete_accuracy(_influence(spark, d))


def live_exact_counts(spark: SparkSession, d: str) -> DataFrame:
    """The exact rows of every joined statement, as the live accuracy takes them."""
    return _influence(spark, d).select("query_id", "query_size", F.col("actual_cardinality").cast("bigint").alias("actual_cardinality"), "treatment_valid", "status")


def timed_statements(spark: SparkSession, d: str) -> DataFrame:
    """Executed counts of all joined statements under native and learned cardinalities: one warm-up, five repetitions."""
    graphs = _joined(spark)
    learned = {(r["query_id"], r["config"]): {next(x.alias for x in graphs[r["query_id"]].relations if x.key == k): n for k, n in r["injected_estimates"].items()} for r in _treated(spark, d).rows}
    return treatments.timed_runs(spark, d, graphs, learned)


def timed_summary(spark: SparkSession, d: str) -> DataFrame:
    return runtime.per_query(timed_statements(spark, d))


def run_schedule(spark: SparkSession, d: str) -> DataFrame:
    return treatments.schedule(spark, list(_joined(spark)), joinchoice.CONFIGS, 1, 5)


def preflight_checks(spark: SparkSession, d: str) -> DataFrame:
    return treatments.preflight(spark, d, _tables(spark, d), QueryGraph.parse(spark, STATEMENTS["lineitem_part_supplier"]), estimators(spark, d)).select("check", "ok")


# Statements that cannot be evaluated, or whose request no model can answer.
_ODD = {
    "odd_or": "SELECT COUNT(*) FROM orders WHERE o_orderstatus='F' OR o_totalprice>300000", "odd_like": "SELECT COUNT(*) FROM part WHERE p_type LIKE 'PROMO%'", "odd_table": "SELECT COUNT(*) FROM nowhere WHERE x=1",
    "odd_text": "SELECT COUNT(* FROM orders", "odd_column": "SELECT COUNT(*) FROM orders WHERE o_clerk='x'", "odd_none": "SELECT 1", "odd_model": "SELECT COUNT(*) FROM nation WHERE n_regionkey=2",
}


def _evaluation(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return treatments.evaluate_base(spark, d, STATEMENTS | _ODD, _tables(spark, d), estimators(spark, d))


def single_table_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """What of the evaluation of base relations is settled by data and statement."""
    rows = _evaluation(spark, d)[0]
    return R.rounded(rows.select("occurrence_id", "original_query_label", "table", "table_alias", "exact_cardinality", "table_cardinality", "selectivity", "is_filtered", "operator_class", "equality_range_shape", "predicate_count", "used_model", "fallback_reason", "status"))


def single_table_errors(spark: SparkSession, d: str) -> DataFrame:
    rows = _evaluation(spark, d)[0]
    return rows.select("occurrence_id", "exact_cardinality", "learned_estimate", "native_estimate", "learned_q_error", "native_q_error", "estimate_direction", "inference_mode", "sample_count", "estimator_seed", "used_model")


def single_table_sections(spark: SparkSession, d: str) -> DataFrame:
    rows = _evaluation(spark, d)[0]
    ratios = {f"{k}_signed_error_ratio": M.signed_ratio(F.col(f"{k}_estimate"), F.col("exact_cardinality")) for k in ("learned", "native")}
    return failures.section_summary(rows.withColumns(ratios), ["occurrence_id"])


def evaluation_failures(spark: SparkSession, d: str) -> DataFrame:
    """The statements that could not be evaluated, and the stage at which they failed."""
    return _evaluation(spark, d)[1].select("label", "stage", "sql")


# Requests, some of which no model can take.
_REQUESTS = {
    "plain": ("SELECT COUNT(*) FROM orders WHERE o_orderstatus='F' AND o_totalprice BETWEEN 100000 AND 200000", "orders"), "in": ("SELECT COUNT(*) FROM part p WHERE p.p_size IN (1, 2, 3) AND 10 < p.p_retailprice", "p"),
    "joined": ("SELECT COUNT(*) FROM customer c, orders o WHERE c.c_custkey=o.o_custkey AND c.c_acctbal<0", "c"), "joined_bare": ("SELECT COUNT(*) FROM customer c, orders o WHERE c.c_custkey=o.o_custkey AND c.c_acctbal<0", "o"),
    "or": ("SELECT COUNT(*) FROM orders WHERE o_orderstatus='F' OR o_orderstatus='O'", "orders"), "not": ("SELECT COUNT(*) FROM orders WHERE NOT o_orderstatus='F'", "orders"), "like": ("SELECT COUNT(*) FROM part WHERE p_type LIKE 'A%'", "part"),
    "null": ("SELECT COUNT(*) FROM part WHERE p_type IS NULL", "part"), "cross": ("SELECT COUNT(*) FROM customer c, orders o WHERE c.c_custkey<o.o_custkey AND c.c_acctbal<0", "c"), "two": ("SELECT COUNT(*) FROM customer c, orders o WHERE c.c_custkey=o.o_custkey", "c,o"),
}


def request_translation(spark: SparkSession, d: str) -> DataFrame:
    """Requests as predicates (column op values; …) or the reason they fall back, and the filter of their relation."""
    rows = []
    for n, (sql, aliases) in _REQUESTS.items():
        g = QueryGraph.parse(spark, sql)
        ps, reason = g.translate(aliases.split(","))
        said = lambda p: f"{p.column} {p.op} " + ",".join(str(v) for v in (p.values or ((p.lower, p.upper) if p.op == "between" else (p.value,))))
        rows.append((n, g.join_count, len(g.relations), "; ".join(map(said, ps)) if reason is None else None, reason, "," not in aliases and g.base_filter(aliases) is not None))
    return spark.createDataFrame(rows, "request string, joins int, relations int, predicates string, reason string, has_filter boolean")


_SQL_TRANSLATED = """SELECT * FROM (VALUES ('plain', 0, 1, 'o_orderstatus = F; o_totalprice between 100000,200000', NULL, true), ('in', 0, 1, 'p_size in 1,2,3; p_retailprice > 10', NULL, true),
  ('joined', 1, 2, 'c_acctbal < 0', NULL, true), ('joined_bare', 1, 2, '', NULL, false), ('or', 0, 1, NULL, 'complex boolean predicates are unsupported', true), ('not', 0, 1, NULL, 'complex boolean predicates are unsupported', true),
  ('like', 0, 1, NULL, 'Unsupported operator: like', true), ('null', 0, 1, NULL, 'Unsupported operator: isnull', true), ('cross', 0, 2, NULL, 'Cross-table predicate detected', true), ('two', 1, 2, NULL, 'request is not single-table', false))
  v(request, joins, relations, predicates, reason, has_filter)"""


# ---------------------------------------------------------------- catalogue and workload


def column_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Ordinal, kind, support and nulls of every column of the base tables; nullability is what the rows say."""
    out = None
    for t in _TABLES:
        df = table(spark, d, t)
        rows = spark.createDataFrame([(c["table"], c["column"], c["ordinal"], c["kind"], c["supported"]) for c in encoding.column_table(df, t)], "table string, column string, ordinal int, kind string, supported boolean")
        part = rows.join(F.broadcast(encoding.null_counts(df)), "column")
        out = part if out is None else out.unionByName(part)
    return out.withColumn("has_nulls", F.col("nulls") > 0)


def _sql_metadata() -> str:
    kinds = "CASE WHEN data_type IN ('SMALLINT', 'INTEGER', 'BIGINT', 'TINYINT') THEN 'integer' WHEN data_type IN ('FLOAT', 'DOUBLE') THEN 'float' WHEN data_type = 'VARCHAR' THEN 'text' WHEN data_type = 'BOOLEAN' THEN 'boolean' WHEN data_type = 'DATE' THEN 'date' WHEN data_type LIKE 'TIMESTAMP%' THEN 'timestamp' WHEN data_type LIKE 'DECIMAL%' THEN 'numeric' ELSE 'unknown' END"
    counts = " UNION ALL ".join(f"SELECT '{t}' AS t, name, n FROM (SELECT struct_pack(*COLUMNS(*)) AS s FROM (SELECT count(*) - count(COLUMNS(*)) FROM {t})), LATERAL (SELECT unnest(map_keys(m)) AS name, unnest(map_values(m)) AS n FROM (SELECT s::JSON::MAP(VARCHAR, BIGINT) AS m))" for t in _TABLES)
    return f"""SELECT table_name AS "table", column_name AS "column", ordinal_position::INTEGER AS ordinal, {kinds} AS kind, kind <> 'unknown' AS supported, n::BIGINT AS nulls, n > 0 AS has_nulls
      FROM information_schema.columns JOIN ({counts}) c ON c.t = table_name AND c.name = column_name"""


def table_scans(spark: SparkSession, d: str) -> DataFrame:
    """Counts, by the scan builder, of a table, of a filter, and of a filter under a limit."""
    orders = table(spark, d, "orders")
    wanted = {"all": {}, "filtered": {"predicate": "o_totalprice > 300000"}, "limited": {"predicate": "o_orderstatus = 'F'", "columns": ["o_orderkey"], "limit": 17}}
    return spark.createDataFrame([(n, int(scalar(scan(orders, count_star=True, **w)))) for n, w in wanted.items()], "scan string, rows bigint")


_SQL_SCANS = """SELECT 'all' AS scan, count(*) AS rows FROM orders UNION ALL SELECT 'filtered', count(*) FROM orders WHERE o_totalprice > 300000
UNION ALL SELECT 'limited', count(*) FROM (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' LIMIT 17)"""


def workload_selection(spark: SparkSession, d: str) -> DataFrame:
    """The first queries, by line, of some labels; the limit is the feature."""
    rows = table(spark, d, "workload_queries")
    names = [r[0] for r in rows.where("line_number is not null").orderBy("query_key").select("label").limit(40).collect()]
    return workload.select_workload(rows, ",".join(names), 20).select("label", "line_number")


_SQL_SELECTION = """SELECT label, line_number FROM workload_queries WHERE label IN (SELECT label FROM workload_queries WHERE line_number IS NOT NULL ORDER BY query_key LIMIT 40)
ORDER BY line_number, label LIMIT 20"""


def workload_joins(spark: SparkSession, d: str) -> DataFrame:
    rows = workload.statement_parts(table(spark, d, "workload_queries"), "sql")
    return rows.select("query_key", F.size("relations").alias("relations"), F.size("conditions").alias("conditions"), workload.join_count(F.col("conditions")).alias("joins"))


_SQL_JOINS = r"""SELECT query_key, len(string_split(rels, ','))::INTEGER AS relations, len(cs)::INTEGER AS conditions,
  len(list_filter(cs, lambda c: regexp_full_match(c, '[A-Za-z_]\w*\.[A-Za-z_]\w*\s*=\s*[A-Za-z_]\w*\.[A-Za-z_]\w*')))::INTEGER AS joins FROM (
  SELECT query_key, regexp_extract(t, '(?i)^select .*?\bfrom (.*?)(?: where (.*))?$', 1) AS rels,
    list_filter(list_transform(string_split_regex(regexp_extract(t, '(?i)^select .*?\bfrom (.*?)(?: where (.*))?$', 2), '(?i)\s+and\s+'), lambda c: trim(regexp_replace(regexp_replace(trim(c), '^[( ]+', ''), '[) ]+$', ''))), lambda c: c <> '') AS cs
  FROM (SELECT query_key, replace(regexp_replace(trim(regexp_replace(sql, '[\s\x{00A0}]+', ' ', 'g')), '[; ]+$', ''), '"', '') AS t FROM workload_queries))"""


def workload_templates(spark: SparkSession, d: str) -> DataFrame:
    """Templates from a map: by label, else by query id, else the default. The map knows every second label and every third id."""
    rows = table(spark, d, "workload_queries").select("query_key", "label", "query_id")
    pick = lambda c, n: F.when(F.col("query_key") % n == 0, F.col(c))
    known = rows.select(F.concat(F.lit("t"), F.col("query_key") % 7).alias("template"), pick("label", 2).alias("label"), pick("query_id", 3).alias("query_id"))
    return workload.with_template(rows, known).select("query_key", "template")


_SQL_TEMPLATES = """WITH known AS (SELECT 't' || (query_key % 7) AS template, CASE WHEN query_key % 2 = 0 THEN label END AS label, CASE WHEN query_key % 3 = 0 THEN query_id END AS query_id FROM workload_queries)
SELECT query_key, coalesce((SELECT max(template) FROM known k WHERE k.label = q.label AND k.label <> ''), (SELECT max(template) FROM known k WHERE k.query_id = q.query_id AND k.query_id <> ''), 'workload') AS template FROM workload_queries q"""


def normalized_labels(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "workload_lines").dropDuplicates(["line_id"])
    number = F.trim("line_number").try_cast("int")
    return rows.select("line_id", workload.normalize_label(F.col("file_name")).alias("prefix"), F.when(number.between(0, 99999), workload.label(F.col("file_name"), number)).alias("label"))


_SQL_LABELS = """WITH n AS (SELECT DISTINCT ON (line_id) line_id, coalesce(nullif(lower(regexp_replace(regexp_replace(trim(file_name), '[^0-9A-Za-z]+', '_', 'g'), '^_+|_+$', '', 'g')), ''), 'workload') AS prefix,
  CASE WHEN regexp_full_match(trim(line_number), '[+-]?[0-9]+') THEN TRY_CAST(trim(line_number) AS INTEGER) END AS number FROM workload_lines)
SELECT line_id, prefix, CASE WHEN number BETWEEN 0 AND 99999 THEN prefix || '_' || lpad(number::VARCHAR, 5, '0') END AS label FROM n"""


def hint_cardinalities(spark: SparkSession, d: str) -> DataFrame:
    """The base cardinalities that recorded hints say, by alias, raw and as injected."""
    rows = table(spark, d, "treatment_results").dropDuplicates(["treatment_id"]).select("treatment_id", explain.hint(F.concat_ws(" ", "hint", F.lit("SELECT 1"))).alias("hint"))
    each = rows.select("treatment_id", F.explode(F.regexp_extract_all("hint", F.lit(r"(Card\(\w+ #[0-9.]+\))"), 1)).alias("c"))
    n = F.regexp_extract("c", r"#([0-9.]+)", 1).cast("double")
    return each.select("treatment_id", F.regexp_extract("c", r"Card\((\w+)", 1).alias("alias"), n.alias("cardinality"), M.floored(n).alias("injected"))


_SQL_HINTS = r"""SELECT treatment_id, regexp_extract(c, 'Card\((\w+)', 1) AS alias, regexp_extract(c, '#([0-9.]+)', 1)::DOUBLE AS cardinality, greatest(cardinality, 1) AS injected
FROM (SELECT treatment_id, unnest(regexp_extract_all(hint, 'Card\(\w+ #[0-9.]+\)')) AS c FROM (SELECT DISTINCT ON (treatment_id) treatment_id, hint FROM treatment_results) WHERE regexp_matches(hint, '/\*=\w+=(?s:.*?)\*/'))"""


def cardinality_maps(spark: SparkSession, d: str) -> DataFrame:
    """Base cardinalities of each recorded treatment as {relation: rows}, raw and as injected, out of rows by relation."""
    rows = table(spark, d, "treatment_results").dropDuplicates(["treatment_id"]).select("treatment_id", F.explode("base_estimates").alias("relation", "rows"))
    maps = joinchoice.cardinality_maps(rows, "treatment_id", "relation", "rows")
    said = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("bigint").cast("string"))), ";")
    return maps.select("treatment_id", said("raw").alias("raw"), said("injected").alias("injected"))


_SQL_MAPS = """SELECT treatment_id, string_agg(k || '=' || trunc(v)::BIGINT, ';' ORDER BY k) AS raw, string_agg(k || '=' || trunc(greatest(v, 1))::BIGINT, ';' ORDER BY k) AS injected
FROM (SELECT treatment_id, unnest(map_keys(base_estimates)) AS k, unnest(map_values(base_estimates)) AS v FROM (SELECT DISTINCT ON (treatment_id) treatment_id, base_estimates FROM treatment_results)) GROUP BY 1"""


# ---------------------------------------------------------------- encoders

_ENCODED = ["o_orderstatus", "o_totalprice", "o_orderpriority", "o_orderdate"]


def encoder_domains(spark: SparkSession, d: str) -> DataFrame:
    """Columns of an encoder after a round trip through its text, with their encoding and domain size."""
    e = encoding.TableEncoder.from_json(encoding.TableEncoder.fit(table(spark, d, "orders"), "orders", _ENCODED).to_json())
    return spark.createDataFrame([(c.column, c.kind, c.encoding, c.domain_size, e.row_count) for c in e.columns], "column string, kind string, encoding string, domain_size int, row_count bigint")


_SQL_DOMAINS = f"""SELECT *, (SELECT count(*) FROM orders) AS row_count FROM (
  SELECT 'o_orderstatus' AS "column", 'text' AS kind, 'dictionary' AS encoding, count(DISTINCT o_orderstatus)::INTEGER AS domain_size FROM orders
  UNION ALL SELECT 'o_orderpriority', 'text', 'dictionary', count(DISTINCT o_orderpriority)::INTEGER FROM orders UNION ALL SELECT 'o_orderdate', 'timestamp', 'dictionary', count(DISTINCT o_orderdate)::INTEGER FROM orders
  UNION ALL SELECT 'o_totalprice', 'float', 'numeric_discretizer', (count(*) - 1)::INTEGER FROM ({R.sql_edges("orders", "o_totalprice")}))"""


def token_digests(spark: SparkSession, d: str) -> DataFrame:
    """Token sets of predicates as they are reported: listed up to 256 tokens, else by number, ends and hash."""
    e = encoding.TableEncoder.fit(table(spark, d, "orders"), "orders", ["o_orderdate", "o_orderpriority"])
    ps = {"dates": Predicate("o_orderdate", ">=", "1995-01-01T00:00:00"), "priority": Predicate("o_orderpriority", "in", values=("1-URGENT", "5-LOW"))}
    rows = []
    for n, p in ps.items():
        got = encoding.token_digest(encoding.allowed_ids(e.encoder_for(p.column), p))
        compact, listed = got.get("allowed_token_ids_compact") or {}, got["allowed_token_ids"]
        rows.append((n, None if listed is None else ",".join(map(str, listed)), compact.get("count"), compact.get("minimum"), compact.get("maximum"), compact.get("sha256")))
    return spark.createDataFrame(rows, "request string, listed string, count int, minimum int, maximum int, sha256 string")


_SQL_DIGESTS = """WITH t AS (
  SELECT 'dates' AS request, token FROM (SELECT o_orderdate AS v, row_number() OVER (ORDER BY o_orderdate) - 1 AS token FROM (SELECT DISTINCT o_orderdate FROM orders)) WHERE v >= TIMESTAMP '1995-01-01'
  UNION ALL SELECT 'priority', token FROM (SELECT o_orderpriority AS v, row_number() OVER (ORDER BY o_orderpriority) - 1 AS token FROM (SELECT DISTINCT o_orderpriority FROM orders)) WHERE v IN ('1-URGENT', '5-LOW')
), g AS (SELECT request, string_agg(token::VARCHAR, ',' ORDER BY token) AS s, count(*)::INTEGER AS n, min(token)::INTEGER AS lo, max(token)::INTEGER AS hi FROM t GROUP BY 1)
SELECT request, CASE WHEN n <= 256 THEN s END AS listed, CASE WHEN n > 256 THEN n END AS count, CASE WHEN n > 256 THEN lo END AS minimum, CASE WHEN n > 256 THEN hi END AS maximum, CASE WHEN n > 256 THEN sha256(s) END AS sha256 FROM g"""


# ---------------------------------------------------------------- recorded treatments


def complete_accuracy_rows(spark: SparkSession, d: str) -> DataFrame:
    """Final q-errors, winners and improvement ratios of every recorded query."""
    rows = joinchoice.complete_accuracy(R.treatments(spark, d)).drop("query_id", "template", "actual_cardinality")
    return R.rounded(rows)


def _sql_accuracy_rows() -> str:
    close = lambda a: f"abs({a} - nq) <= 1e-9 * greatest({a}, nq, 1)"
    who = lambda a, name: f"CASE WHEN {close(a)} THEN 'unchanged' WHEN {a} < nq THEN '{name}' WHEN {a} > nq THEN 'native' END"
    return f"""{R.SQL_TREATED} SELECT query_key, query_size, treatment_valid, round(nq, 6) AS native_final_q_error, round(lq, 6) AS learned_final_q_error, round(eq, 6) AS exact_final_q_error,
      {who("lq", "learned_base")} AS learned_versus_native, {who("eq", "exact_base")} AS exact_versus_native, round(nq / lq, 6) AS learned_improvement_ratio, round(nq / eq, 6) AS exact_attainable_improvement_ratio FROM x"""


def improvement_propagation(spark: SparkSession, d: str) -> DataFrame:
    sections = failures.section_summary(R.evaluated(spark, d))
    return joinchoice.propagated(sections, joinchoice.complete_summary(R.treatments(spark, d)))


def _sql_propagation() -> str:
    close = lambda a, b: f"abs({a} - {b}) <= 1e-9 * greatest({a}, {b}, 1)"
    inner = R.SQL_TREATED.strip().removeprefix("WITH ").replace("once AS", "each_once AS").replace("FROM once", "FROM each_once")
    return f"""{R.SQL_EVALUATED}, {inner}, s AS (SELECT count(*) FILTER (NOT ({close("learned_q_error", "native_q_error")}) AND learned_q_error < native_q_error) > count(*) FILTER (NOT ({close("learned_q_error", "native_q_error")}) AND learned_q_error > native_q_error) AS single_table_improved FROM v WHERE coalesce(is_filtered, false)),
    f AS (SELECT count(*) FILTER (NOT ({close("lq", "nq")}) AND lq < nq) > count(*) FILTER (NOT ({close("lq", "nq")}) AND lq > nq) AS complete_query_improved FROM x WHERE treatment_valid AND nq IS NOT NULL AND lq IS NOT NULL AND eq IS NOT NULL)
    SELECT single_table_improved, complete_query_improved, single_table_improved AND complete_query_improved AS improvement_propagated FROM s, f"""


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (
        treatment_runs, treatment_failures, treatment_cardinalities, first_join_candidates, live_influence, live_join_outputs, live_join_quality, live_accuracy, live_exact_counts, timed_statements, timed_summary, run_schedule,
        preflight_checks, single_table_evaluation, single_table_errors, single_table_sections, evaluation_failures, request_translation, column_metadata, table_scans, workload_selection, workload_joins, workload_templates, normalized_labels,
        hint_cardinalities, cardinality_maps, encoder_domains, token_digests, complete_accuracy_rows, improvement_propagation,
    )}


def _fragments(sizes: Callable[[int], list[int]]) -> str:
    parts = []
    for name, (relations, joins) in R.SHAPES.items():
        for n in sizes(len(relations)):
            for some in combinations(relations, n):
                used = [sql for pair, sql in joins.items() if set(pair) <= set(some)]
                if len(used) == n - 1:  # these statements are trees
                    source = ", ".join(f"(SELECT * FROM {relations[a][0]} WHERE {relations[a][1]}) {a}" for a in some)
                    key = "|".join(sorted(f"{relations[a][0]}:{a}" for a in some))
                    parts.append(f"SELECT '{name}' AS query_id, '{key}' AS relations, {n} AS size, count(*) AS n FROM {source} WHERE {' AND '.join(used)}")
    return " UNION ALL ".join(parts)


def _sql_evaluation() -> str:
    """Counts by SQL; the shape of each filter is a fixed value."""
    shape = {"=": ("equality", "equality"), "<": ("range", "range"), "": ("no_filter", "other_or_unfiltered"), "m": ("mixed", "mixed"), "o": ("mixed", "range")}
    single = {
        "orders_status_price": ("orders", "o_orderstatus='F' AND o_totalprice BETWEEN 100000 AND 200000", "m", 2), "orders_priority": ("orders", "o_orderpriority IN ('1-URGENT','2-HIGH') AND o_totalprice > 300000", "o", 2),
        "lineitem_flags": ("lineitem", "l_returnflag='R' AND l_quantity < 10 AND l_discount >= 0.05", "m", 3), "part_impossible": ("part", "p_size <= 10 AND p_retailprice >= 1500", "<", 2),
        "customer_segment": ("customer", "c_mktsegment='BUILDING' AND c_acctbal < 0", "m", 2), "events_clicks": ("events", "event_type='click' AND value > 50", "m", 2),
        "odd_or": ("orders", "o_orderstatus='F' OR o_totalprice>300000", "m", 2), "odd_like": ("part", "p_type LIKE 'PROMO%'", "", 0), "odd_model": ("nation", "n_regionkey=2", "=", 1),
    }
    reasons = {"odd_or": "complex boolean predicates are unsupported", "odd_like": "Unsupported operator: like", "odd_model": "no model of nation", "region_to_lineitem__nation_n": "no model of nation"}
    rows = [(q, q, t, t, w, *shape[k], n) for q, (t, w, k, n) in single.items()]
    for q, (relations, _) in R.SHAPES.items():
        for a, (t, w) in relations.items():
            kind = "" if w == "true" else "=" if "='" in w else "<"
            rows.append((f"{q}__{t}_{a}", q, t, a, w, *shape[kind], 0 if kind == "" else 1))
    parts = []
    for occurrence, q, t, a, w, cls, eq, n in rows:
        occ = occurrence if "__" in occurrence else f"{q}__{t}"
        reason = reasons.get(q) or reasons.get(occ)
        parts.append(f"""SELECT '{occ}' AS occurrence_id, '{q}' AS original_query_label, '{t}' AS "table", '{a}' AS table_alias, count(*) FILTER ({w}) AS exact_cardinality, count(*) AS table_cardinality,
          round(count(*) FILTER ({w}) / count(*), 6) AS selectivity, {str(w != "true").lower()} AS is_filtered, '{cls}' AS operator_class, '{eq}' AS equality_range_shape, {n} AS predicate_count, {str(reason is None).lower()} AS used_model,
          {"NULL" if reason is None else f"'{reason}'"} AS fallback_reason, 'ok' AS status FROM {t}""")
    return " UNION ALL ".join(parts)


def oracle_sql() -> dict[str, str]:
    names = ", ".join(f"('{n}')" for n in R.SHAPES)
    whole = _fragments(lambda n: [n])
    sizes = " ".join(f"WHEN '{n}' THEN {len(r)}" for n, (r, _) in R.SHAPES.items())
    checks = " UNION ALL ".join(f"SELECT 'rows of {t}' AS \"check\", count(*) > 0 AS ok FROM {t}" for t in _TABLES)
    said = ["exact differs from native", *(f"{c} {k}" for k in ("part:p", "supplier:s") for c in ("injection of 42 into", "injection of the exact count into", "restored estimate of", "model of"))]
    faults = ", ".join(f"('{label}', '{stage}', '{_ODD[label.partition('__')[0]].replace(chr(39), chr(39) * 2)}')" for label, stage in (("odd_table", "parse"), ("odd_text", "parse"), ("odd_none", "parse"), ("odd_column__orders", "native")))
    found = {
        "treatment_cardinalities": f"SELECT query_id, relation, exact_cardinality, greatest(exact_cardinality, 1) AS injected_cardinality, true AS expected_as_injected FROM ({R.sql_base_counts(joined_only=True)})",
        "first_join_candidates": f"SELECT query_id, relations AS first_join, n AS output, min(n) OVER (PARTITION BY query_id) AS best_output, round(greatest(n, 1) / greatest(min(n) OVER (PARTITION BY query_id), 1), 6) AS relative_output FROM ({_fragments(lambda n: [2])})",
        "live_exact_counts": f"SELECT query_id, CASE query_id {sizes} END AS query_size, n AS actual_cardinality, true AS treatment_valid, 'ok' AS status FROM ({whole})",
        "treatment_failures": "SELECT '' AS label, '' AS stage, '' AS reason, '' AS sql WHERE false",
        "run_schedule": f"""SELECT query_id, configuration, r::INTEGER AS repetition, r < 0 AS warmup, (CASE configuration WHEN 'native' THEN CASE WHEN abs(r) % 2 = 1 THEN 2 ELSE 1 END WHEN 'learned_base' THEN CASE WHEN abs(r) % 2 = 1 THEN 1 ELSE 2 END ELSE 3 END)::INTEGER AS execution_order
          FROM (VALUES {names}) q(query_id), (VALUES ('native'), ('learned_base'), ('exact_base')) c(configuration), range(-1, 5) t(r)""",
        "preflight_checks": f"{checks} UNION ALL SELECT c, true FROM (VALUES {', '.join(f'({x!r})' for x in said)}) v(c)",
        "single_table_evaluation": _sql_evaluation(),
        "evaluation_failures": f"SELECT * FROM (VALUES {faults}) v(label, stage, sql)",
        "request_translation": _SQL_TRANSLATED,
        "column_metadata": _sql_metadata(),
        "table_scans": _SQL_SCANS,
        "workload_selection": _SQL_SELECTION,
        "workload_joins": _SQL_JOINS,
        "workload_templates": _SQL_TEMPLATES,
        "normalized_labels": _SQL_LABELS,
        "hint_cardinalities": _SQL_HINTS,
        "cardinality_maps": _SQL_MAPS,
        "encoder_domains": _SQL_DOMAINS,
        "token_digests": _SQL_DIGESTS,
        "complete_accuracy_rows": _sql_accuracy_rows(),
        "improvement_propagation": _sql_propagation(),
    }
    return {name: R.nudged(sql) for name, sql in found.items()}
