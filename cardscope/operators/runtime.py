"""Timed repetitions: per-query medians under censoring, speed-ups, subgroups and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardscope.functions import metrics as M
from cardscope.operators.exact_median import group_percentiles

CONFIGURATIONS = {"native": "native", "learned": "learned_base", "exact": "exact_base"}


def measured(rows: DataFrame, strict: bool = False) -> DataFrame:
    """Repetitions that count: no warm-ups, each delivery once, with censored times.

    A timeout counts as its limit. Rows that neither timed out nor have status ok and a finite positive time are left out of
    the medians (their times are null) but stay as repetitions. With strict, a row with status ok that did not time out and
    has no such time is an error."""
    once = rows.dropDuplicates(["measurement_id"]).where(~F.coalesce("warmup", F.lit(False)))
    timed_out = F.coalesce("timeout", F.lit(False))

    def time(name: str) -> Column:
        good = (F.col("status") == "ok") & M.finite(F.col(name)) & (F.col(name) > 0)
        out = F.when(timed_out, F.col("timeout_seconds") * 1000.0).when(good, F.col(name))
        missing = F.raise_error(F.concat(F.lit(f"no {name} in measurement "), F.coalesce(F.col("measurement_id").cast("string"), F.lit("null")))).cast("double")
        return out.when(F.col("status") == "ok", missing) if strict else out

    return once.withColumns({"execution_ms": time("execution_time_ms"), "wall_ms": time("wall_clock_duration_ms")})


def per_query(rows: DataFrame) -> DataFrame:
    """One row per query: medians by configuration side by side, speed-up and its class, timeouts, valid repetitions.

    `status` is complete when both compared configurations have times."""
    m = measured(rows)
    is_ = {k: F.col("configuration") == v for k, v in CONFIGURATIONS.items()}
    names = {f"{k}_{t}": F.when(c, F.col(f"{t}_ms")) for k, c in is_.items() for t in ("execution", "wall")}
    m = m.withColumns(names)
    plain = [F.min(c).alias(c) for c in ("source_query_id", "query_template", "relation_count")]
    plain += [F.bool_or(F.coalesce("base_join_changed", F.lit(False))).alias("base_join_changed")]
    plain += [F.count_if(is_[k] & F.coalesce("timeout", F.lit(False))).alias(f"{k}_timeout_count") for k in ("native", "learned")]
    plain += [F.count_if(F.col("status") == "ok").alias("valid_measured_repetitions")]
    wanted = [(f"{k}_median_{'execution_time' if t == 'execution' else 'wall_clock'}_ms", f"{k}_{t}", 0.5) for k in is_ for t in ("execution", "wall")]
    out = group_percentiles(m, ["query_id"], wanted, plain)
    speedup = F.try_divide(F.col("native_median_execution_time_ms"), F.col("learned_median_execution_time_ms"))
    out = out.withColumn("speedup_native_over_learned", speedup)
    return out.withColumns({
        "runtime_classification": M.speedup_class(F.col("speedup_native_over_learned")),
        "status": F.when(F.col("speedup_native_over_learned").isNotNull(), "complete").otherwise("invalid"),
    })


def summary(queries: DataFrame) -> DataFrame:
    """One row over the complete queries: totals, medians, p90, p95, geometric mean speed-up, classes."""
    done = queries.where("status = 'complete'")
    native, learned, speedup = "native_median_execution_time_ms", "learned_median_execution_time_ms", F.col("speedup_native_over_learned")
    plain = [F.count("*").alias("query_count"), F.sum(native).alias("native_total_ms"), F.sum(learned).alias("learned_total_ms"), M.geometric_mean(speedup).alias("geometric_mean_speedup")]
    plain += [F.avg(F.ln(native) - F.ln(learned)).alias("mean_log_runtime_ratio")]
    plain += [F.count_if(F.col("runtime_classification") == c).alias(c) for c in ("improved", "degraded", "unchanged")]
    wanted = [(f"{k}_{n}_ms", c, q) for k, c in (("native", native), ("learned", learned)) for n, q in (("median", 0.5), ("p90", 0.9), ("p95", 0.95))]
    return group_percentiles(done.withColumn("one", F.lit(1)), ["one"], wanted, plain).drop("one")


def timeout_counts(rows: DataFrame) -> DataFrame:
    return measured(rows).groupBy("configuration").agg(F.count_if(F.coalesce("timeout", F.lit(False))).alias("timeouts"), F.count("*").alias("repetitions"))


def subgroups(queries: DataFrame) -> DataFrame:
    """Queries and geometric mean speed-up of overlapping groups: all, changed or unchanged joins, each template, and the
    queries without a timeout on either side."""
    done = queries.where("status = 'complete'")
    no_timeouts = (F.col("native_timeout_count") == 0) & (F.col("learned_timeout_count") == 0)
    labels = F.array(
        F.lit("all_queries"), F.when(F.col("base_join_changed"), "changed_base_joins").otherwise("unchanged_base_joins"),
        F.concat(F.lit("template="), F.coalesce("query_template", F.lit("None"))), F.when(no_timeouts, F.lit("without_timeouts")),
    )
    wide = done.select(F.explode(F.array_compact(labels)).alias("subgroup"), "speedup_native_over_learned")
    return wide.groupBy("subgroup").agg(F.count("*").alias("query_count"), M.geometric_mean(F.col("speedup_native_over_learned")).alias("geometric_mean_speedup"))


def exact_reference(rows: DataFrame) -> DataFrame:
    """Medians of the exact-base configuration over its queries; no row when it did not run."""
    m = measured(rows).where(F.col("configuration") == CONFIGURATIONS["exact"])
    by = group_percentiles(m, ["query_id"], [("median_ms", "execution_ms", 0.5)]).where("median_ms is not null").withColumn("one", F.lit(1))
    plain = [F.count("*").alias("query_count"), F.sum("median_ms").alias("total_ms")]
    return group_percentiles(by, ["one"], [(f"{n}_ms", "median_ms", q) for n, q in (("median_query", 0.5), ("p90_query", 0.9), ("p95_query", 0.95))], plain).drop("one")


def speedup_spread(queries: DataFrame) -> DataFrame:
    """Five-number summary of the speed-up of complete queries, by whether their first join changed."""
    done = queries.where("status = 'complete'")
    return group_percentiles(done, ["base_join_changed"], [(n, "speedup_native_over_learned", q) for n, q in (("low", 0.0), ("q1", 0.25), ("median", 0.5), ("q3", 0.75), ("high", 1.0))], [F.count("*").alias("queries")])


def execution_order(repetition: Column, configuration: Column) -> Column:
    """Place of a configuration in a repetition: native first in even ones, learned first in odd ones, any other last."""
    odd = repetition % 2 == 1
    return F.when(configuration == "native", F.when(odd, 2).otherwise(1)).when(configuration == "learned_base", F.when(odd, 1).otherwise(2)).otherwise(3)
