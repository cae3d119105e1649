"""Statements under treatments: the optimizer with its own base estimates, with learned ones, and with exact ones.

Only base relations are injected; joins, order and operators stay Spark's choice. Every statement and configuration gives a row
in the form of recorded treatments, so that the operators over those (influence, quality, accuracy) run over these as well.
"""

from __future__ import annotations

import math
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardscope.functions import metrics as M
from cardscope.operators import density, failures, runtime, workload
from cardscope.operators.density import Estimate, Estimator
from cardscope.operators.encoding import TableEncoder
from cardscope.operators.joinchoice import CONFIGS
from cardscope.plans import explain
from cardscope.plans.native import Catalog, Statement, roundtrip_ok
from cardscope.plans.requests import NOT_SINGLE, QueryGraph, normalized_sql_id
from cardscope.session import at_once

_JOIN = f"struct<{', '.join(f'{c.split()[0]}: {c.split()[1]}' for c in explain.JOIN_SCHEMA.split(', '))}>"
SCHEMA = (
    f"treatment_id bigint, query_key bigint, query_id string, config string, hint string, document string, plan_hash string, structure_hash string, first_base_join string, all_base_joins array<string>, all_joins array<{_JOIN}>, "
    "base_estimates map<string,double>, injected_estimates map<string,double>, expected_estimates map<string,double>, reasons map<string,string>, final_estimate double, treatment_valid boolean"
)
FAILURE_SCHEMA = "label string, stage string, reason string, sql string"


def train_tables(spark: SparkSession, tables: dict[str, DataFrame], columns: dict[str, list[str]], oversize: str = "skip", **options) -> dict[str, Estimator]:
    """Estimators of many tables. Encoders are fitted beside each other; tables of up to density.LOCAL_CELLS different rows of
    tokens are trained in tasks of their own, larger ones one after the other, each in parts."""
    names = list(columns)
    encoders = dict(zip(names, at_once([lambda t=t: TableEncoder.fit(tables[t], t, columns[t], oversize) for t in names])))
    trained = density.train_many(spark, {t: (tables[t], encoders[t]) for t in names}, **options)
    return {t: Estimator(encoders[t], trained[t][0]) for t in names}


def learned_estimate(graph: QueryGraph, alias: str, estimators: dict[str, Estimator], native: Callable[[str], float]) -> Estimate:
    """The model's estimate of a relation; the native one with the reason where the request cannot be put to a model."""
    predicates, reason = graph.translate(alias)
    relation = next((r for r in graph.relations if r.alias == alias), None)
    if relation is None:
        reason = NOT_SINGLE
    if reason is None and relation.table not in estimators:
        reason = f"no model of {relation.table}"
    if reason is None:
        try:
            return estimators[relation.table].estimate(predicates)
        except ValueError as x:
            reason = str(x)
    return Estimate(relation.table if relation else "", 0.0, float(native(alias)), False, reason)


@dataclass
class Treatments:
    """What a run found: rows by statement and configuration, and failures by statement with their stage."""

    rows: list[dict] = field(default_factory=list)
    failures: list[tuple] = field(default_factory=list)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(r[c.split()[0]] for c in _top(SCHEMA)) for r in self.rows], SCHEMA)

    def failure_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.failures, FAILURE_SCHEMA)


def _top(schema: str) -> list[str]:
    """The columns of a schema, without cutting inside < >."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(schema):
        depth += {"<": 1, ">": -1}.get(c, 0)
        if c == "," and depth == 0:
            out.append(schema[at:i].strip())
            at = i + 1
    return [*out, schema[at:].strip()]


def hint_of(cards: dict[str, float]) -> str:
    """Base cardinalities as the comment by which they are recorded; empty without any."""
    inner = " ".join(f"Card({a} #{round(n)})" for a, n in sorted(cards.items()))
    return f"/*=cards= {inner} */" if cards else ""


def treat(spark: SparkSession, folder: str, graphs: dict[str, QueryGraph], estimators: dict[str, Estimator], exact: dict[tuple[str, str], int], configs: tuple[str, ...] = CONFIGS) -> Treatments:
    """Every statement under every configuration. exact: counts by (statement, relation key). A treatment is valid when all its
    base cardinalities are finite and not negative and the optimizer expects what was injected. One that fails becomes a failure row;
    the others of its statement go on."""
    out = Treatments()
    with Catalog(spark, folder) as catalog:
        for number, (name, graph) in enumerate(graphs.items()):
            try:
                statement = catalog.statement(graph)
                native = {r.alias: statement.base_estimate(r.alias) for r in graph.relations}
            except Exception as x:  # noqa: BLE001 any fault of a statement is a row
                out.failures.append((name, "native", _first_line(x), graph.sql))
                continue
            for config in configs:
                try:
                    out.rows.append(_treated(statement, graph, name, number, config, native, estimators, exact) | {"treatment_id": number * len(configs) + configs.index(config)})
                except Exception as x:  # noqa: BLE001
                    out.failures.append((name, config, _first_line(x), graph.sql))
                finally:
                    statement.restore()
    return out


def _first_line(x: Exception) -> str:
    return (str(x) or type(x).__name__).split("\n")[0][:500]


def _treated(statement: Statement, graph: QueryGraph, name: str, number: int, config: str, native: dict[str, float], estimators: dict[str, Estimator], exact: dict[tuple[str, str], int]) -> dict:
    keys = {r.alias: r.key for r in graph.relations}
    reasons: dict[str, str] = {}
    if config == "native":
        base = dict(native)
    elif config == "learned_base":
        found = {a: learned_estimate(graph, a, estimators, native.__getitem__) for a in keys}
        base, reasons = {a: e.cardinality for a, e in found.items()}, {keys[a]: e.reason for a, e in found.items() if e.reason}
    else:
        base = {a: float(exact[(name, k)]) for a, k in keys.items()}
    if not all(math.isfinite(n) and n >= 0 for n in base.values()):
        raise ValueError(f"a base cardinality is negative or not finite: {base}")
    injected = {} if config == "native" else {a: max(n, M.FLOOR) for a, n in base.items()}
    expected = statement.inject(injected) if injected else dict(native)
    document = statement.document()
    joins = explain.joins(document)
    firsts = [j["base_join_key"] for j in joins if j["is_base_join"]]
    by_key = lambda d: {keys[a]: float(n) for a, n in d.items()}
    return {
        "query_key": number, "query_id": name, "config": config, "hint": hint_of(injected), "document": document, "plan_hash": explain.plan_hash(document), "structure_hash": explain.plan_hash(document, False),
        "first_base_join": firsts[0] if firsts else None, "all_base_joins": firsts, "all_joins": [tuple(j.values()) for j in joins], "base_estimates": by_key(base), "injected_estimates": by_key(injected),
        "expected_estimates": by_key(expected), "reasons": reasons, "final_estimate": statement.final_estimate(), "treatment_valid": all(roundtrip_ok(n, expected[a]) for a, n in injected.items()),
    }


def candidate_joins(graphs: dict[str, QueryGraph], spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """(query_id, first_join, output, best_output, relative_output): every pair of relations that a join connects, with the exact
    rows of its join under the filters of both, against the smallest of the statement."""
    pairs = {n: g for n, g in graphs.items() if len(g.relations) > 1}
    counts = workload.fragment_counts(spark, pairs, tables, sizes=(2,))
    best = counts.groupBy("query_id").agg(F.min("cardinality").alias("best_output"))
    out = counts.join(F.broadcast(best), "query_id")  # a row a statement
    return out.select("query_id", F.col("relations").alias("first_join"), F.col("cardinality").alias("output"), "best_output", M.relative_output(F.col("cardinality"), F.col("best_output")).alias("relative_output"))


def with_outputs(rows: DataFrame, candidates: DataFrame) -> DataFrame:
    """Rows of joinchoice.influence with the exact outputs of the chosen first joins, absolute and relative to the reference's."""
    for s in ("native", "learned", "exact"):
        mine = candidates.select(F.col("query_id"), F.col("first_join").alias(f"{s}_first_base_join"), F.col("output").alias(f"{s}_output"))
        rows = rows.join(mine, ["query_id", f"{s}_first_base_join"], "left")
    return rows.withColumns({f"{s}_relative_output": M.relative_output(F.col(f"{s}_output"), F.col("exact_output")) for s in ("native", "learned")})


_EVALUATED = "occurrence_id string, original_query_label string, table string, table_alias string, predicate_text string, normalized_sql_id string, learned_estimate double, native_estimate double, used_model boolean, fallback_reason string, inference_mode string, sample_count int, estimator_seed bigint"


def evaluate_base(spark: SparkSession, folder: str, statements: dict[str, str], tables: dict[str, DataFrame], estimators: dict[str, Estimator]) -> tuple[DataFrame, DataFrame]:
    """(rows, failures): every relation of every statement with its exact, native and learned cardinality, q-errors and the shape
    of its filter. A statement or relation that fails is a failure row (label, stage, reason, sql), not an error."""
    graphs: dict[str, QueryGraph] = {}
    faults: list[tuple] = []
    for name, sql in statements.items():
        try:
            graphs[name] = QueryGraph.parse(spark, sql)
            if not graphs[name].relations:
                raise ValueError("no relation")
            if missing := sorted({r.table for r in graphs[name].relations} - set(tables)):
                raise KeyError(f"no table {', '.join(missing)}")
        except Exception as x:  # noqa: BLE001
            graphs.pop(name, None)
            faults.append((name, "parse", _first_line(x), sql))
    found: list[tuple] = []
    counted: dict[str, QueryGraph] = {}
    with Catalog(spark, folder) as catalog:
        for name, graph in graphs.items():
            try:
                statement = catalog.statement(graph)
            except Exception as x:  # noqa: BLE001
                faults.append((name, "native", _first_line(x), graph.sql))
                continue
            good = []
            for r in graph.relations:
                stage = "native"
                try:
                    native = statement.base_estimate(r.alias)
                    stage = "learned"
                    e = learned_estimate(graph, r.alias, estimators, lambda a, n=native: n)
                except Exception as x:  # noqa: BLE001
                    faults.append((f"{name}__{r.key.replace(':', '_')}", stage, _first_line(x), graph.sql))
                    continue
                good.append(r)
                where = graph.base_filter(r.alias) or ""
                sql = f"SELECT * FROM {r.table} AS {r.alias}" + (f" WHERE {where}" if where else "")
                notes = e.diagnostics
                found.append((f"{name}__{r.key.replace(':', '_')}", name, r.table, r.alias, where, normalized_sql_id(sql), e.cardinality, native, e.used_model, e.reason, notes.get("inference_mode"), notes.get("sample_count"), notes.get("estimator_seed")))
            counted[name] = QueryGraph(graph.sql, good, graph.conjuncts)
    failed = spark.createDataFrame(faults, FAILURE_SCHEMA)
    if not found:
        raise ValueError("no statement could be evaluated: " + "; ".join(f"{f[0]}: {f[2]}" for f in faults))
    exact = workload.exact_base_counts(tables, counted).select(F.col("query_id").alias("original_query_label"), F.concat_ws("__", "query_id", F.replace("relation", F.lit(":"), F.lit("_"))).alias("occurrence_id"), "exact_cardinality", "table_cardinality")
    rows = spark.createDataFrame(found, _EVALUATED).join(F.broadcast(exact), ["occurrence_id", "original_query_label"])
    x = F.col("exact_cardinality")
    rows = failures.with_shape(rows).withColumns({
        "is_filtered": F.col("predicate_text") != "", "selectivity": F.try_divide(x.cast("double"), F.col("table_cardinality").cast("double")),
        **{f"{k}_q_error": M.q_error(F.col(f"{k}_estimate"), x) for k in ("learned", "native")}, "estimate_direction": M.direction(F.col("learned_estimate"), x),
        "fallback_used": ~F.col("used_model"), "status": F.lit("ok"),
    })
    return rows, failed


# Timed runs

RUN_SCHEMA = (
    "measurement_id bigint, query_id string, source_query_id string, query_template string, relation_count int, configuration string, repetition int, warmup boolean, execution_order int, base_join_changed boolean, "
    "wall_clock_duration_ms double, planning_time_ms double, execution_time_ms double, actual_rows bigint, timeout boolean, timeout_seconds double, status string, reason string"
)


def schedule(spark: SparkSession, names: list[str], configs: tuple[str, ...], warmups: int, repetitions: int) -> DataFrame:
    """(query_id, configuration, repetition, warmup, execution_order): warm-ups have repetitions below 0; the compared
    configurations swap places in every other repetition."""
    if warmups < 0 or repetitions < 1:
        raise ValueError("at least one repetition, and no negative number of warm-ups")
    rows = spark.createDataFrame([(n, c) for n in names for c in configs], "query_id string, configuration string")
    rows = rows.withColumn("repetition", F.explode(F.sequence(F.lit(-warmups), F.lit(repetitions - 1))))
    return rows.withColumns({"warmup": F.col("repetition") < 0, "execution_order": runtime.execution_order(F.abs("repetition"), F.col("configuration"))})


def timed_runs(
    spark: SparkSession, folder: str, graphs: dict[str, QueryGraph], cardinalities: dict[tuple[str, str], dict[str, float]], configs: tuple[str, ...] = CONFIGS[:2],
    warmups: int = 1, repetitions: int = 5, timeout_seconds: float = 300.0,
) -> DataFrame:
    """Executed counts of every statement under every configuration, in the form of recorded repetitions.

    cardinalities: base cardinalities to inject by (statement, configuration), by alias; none for the native one. A run beyond its
    limit is cancelled by its job tag and recorded as a timeout; one that fails as an error, with the reason. Caches are cleared
    before each run; there is no cold file cache to ask for."""
    rows: list[tuple] = []
    plan = schedule(spark, list(graphs), configs, warmups, repetitions).orderBy("query_id", "repetition", "execution_order", "configuration").collect()
    with Catalog(spark, folder) as catalog:
        statements = {n: catalog.statement(g) for n, g in graphs.items()}
        firsts: dict[tuple[str, str], str | None] = {}
        for p in plan:
            name, config = p["query_id"], p["configuration"]
            statement = statements[name]
            statement.inject({a: max(n, M.FLOOR) for a, n in cardinalities.get((name, config), {}).items()})
            try:
                if (name, config) not in firsts:
                    firsts[(name, config)] = statement.first_base_join()
                spark.catalog.clearCache()
                done = _run_once(spark, statement, timeout_seconds)
            finally:
                statement.restore()
            rows.append((len(rows), name, name, name, len(graphs[name].relations), config, p["repetition"], p["warmup"], p["execution_order"], None, *done[:4], done[4], timeout_seconds, done[5], done[6]))
    changed = {n: firsts.get((n, configs[0])) != firsts.get((n, configs[-1] if len(configs) < 2 else configs[1])) for n in graphs}
    return spark.createDataFrame([(*r[:9], changed[r[1]], *r[10:]) for r in rows], RUN_SCHEMA)


def _run_once(spark: SparkSession, statement: Statement, limit: float) -> tuple:
    """(wall ms, planning ms, execution ms, rows, timed out, status, reason)"""
    sc, tag, over, fired = spark.sparkContext, f"timed-{uuid.uuid4().hex}", threading.Event(), threading.Event()

    def stop() -> None:
        if over.wait(limit):
            return
        fired.set()
        while not over.wait(0.05):  # jobs of the run that start later are to end as well
            sc.cancelJobsWithTag(tag)

    watch = threading.Thread(target=stop, daemon=True)
    sc.addJobTag(tag)
    began = time.perf_counter()
    watch.start()
    try:
        n, document = statement.executed()
        m, wall = explain.metrics(document), 1000 * (time.perf_counter() - began)
        if wall > 1000 * limit:
            return wall, m["planning_time_ms"], None, None, True, "timeout", None
        return wall, m["planning_time_ms"], m["execution_time_ms"], n, False, "ok", None
    except Exception as x:  # noqa: BLE001 any fault of a run is a row
        wall = 1000 * (time.perf_counter() - began)
        return wall, None, None, None, fired.is_set(), "timeout" if fired.is_set() else "error", _first_line(x)
    finally:
        over.set()
        watch.join()
        sc.removeJobTag(tag)


def preflight(spark: SparkSession, folder: str, tables: dict[str, DataFrame], graph: QueryGraph, estimators: dict[str, Estimator] | None = None) -> DataFrame:
    """(check, ok, detail): what has to hold before a run: tables have rows, every table with a filter has a model that answers,
    injected cardinalities come back (for the native estimate too), and exact base cardinalities differ from native ones."""
    out = [(f"rows of {t}", not df.isEmpty(), "") for t, df in sorted(tables.items())]
    with Catalog(spark, folder) as catalog:
        statement = catalog.statement(graph)
        filtered = [r for r in graph.relations if graph.base_filter(r.alias)]
        exact = {r["relation"]: r["exact_cardinality"] for r in workload.exact_base_counts(tables, {"q": graph}).collect()}
        native = {r.alias: statement.base_estimate(r.alias) for r in graph.relations}
        for r in filtered:
            for what, wanted in (("42", 42.0), ("the exact count", float(max(exact[r.key], 1)))):
                got = statement.inject({r.alias: wanted})[r.alias]
                out.append((f"injection of {what} into {r.key}", roundtrip_ok(wanted, got), f"{wanted} {got}"))
                statement.restore()
            out.append((f"restored estimate of {r.key}", statement.base_estimate(r.alias) == native[r.alias], f"{native[r.alias]}"))
        out.append(("exact differs from native", any(abs(exact[r.key] - native[r.alias]) > 0.5 for r in filtered), ""))
    for r in filtered if estimators is not None else []:
        e = learned_estimate(graph, r.alias, estimators, native.__getitem__)
        out.append((f"model of {r.key}", e.used_model and math.isfinite(e.cardinality), e.reason or f"{e.cardinality}"))
    return spark.createDataFrame(out, "check string, ok boolean, detail string")
