"""What estimates do to the choice of joins: treatments side by side, influence and quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardscope.functions import metrics as M
from cardscope.operators.exact_median import group_percentiles

CONFIGS = ("native", "learned_base", "exact_base")
RELEVANT_SHARE = 0.05


def join_key(relations: Column) -> Column:
    """The canonical key of a set of relations: distinct, sorted, joined by |."""
    return F.array_join(F.array_sort(F.array_distinct(relations)), "|")


def relation_key(table: Column, alias: Column) -> Column:
    """table:alias, or the table alone where the alias is missing or says the same."""
    return F.when(alias.isNull() | (alias == "") | (alias == table), table).otherwise(F.concat_ws(":", table, alias))


def base_join_keys(all_joins: Column) -> Column:
    """The keys of the joins of two single relations, in plan order (children first)."""
    base = F.filter(all_joins, lambda j: j.isNotNull() & F.coalesce(j["is_base_join"], F.lit(False)))
    return F.transform(base, lambda j: F.coalesce(j["base_join_key"], join_key(j["relations"])))


def key_relations(key: str, known: list[str]) -> tuple[str, str]:
    """The two relations that the key of a first join names; a key of another number, or of unknown ones, is an error."""
    parts = key.split("|")
    if len(parts) != 2 or missing_of(parts, known):
        raise ValueError(f"{key} does not name two of {', '.join(known)}")
    return parts[0], parts[1]


def missing_of(wanted: list[str], known: list[str]) -> list[str]:
    return [w for w in dict.fromkeys(wanted) if w not in set(known)]


def cardinality_maps(rows: DataFrame, key: str, relation: str, value: str) -> DataFrame:
    """(key, raw, injected): {relation: rows} of each key out of a row per relation, in order of the relations; injected ones are
    at least 1. A missing value is left out."""
    pairs = lambda v: F.map_from_entries(F.array_sort(F.collect_list(F.when(v.isNotNull(), F.struct(F.col(relation).alias("k"), v.cast("double").alias("v"))))))
    return rows.groupBy(key).agg(pairs(F.col(value)).alias("raw"), pairs(M.floored(F.col(value))).alias("injected"))


def side_by_side(treatments: DataFrame) -> DataFrame:
    """One row per query with the first join, plan hash, estimates, root rows and validity of each configuration.

    Deliveries count once; of several treatments of a query and configuration the one with the smallest id stands."""
    rows = treatments.dropDuplicates(["treatment_id"]).withColumn("root", F.get(F.filter("all_joins", lambda j: j.isNotNull()), F.size(F.filter("all_joins", lambda j: j.isNotNull())) - 1)["plan_rows"])
    facts = F.struct("treatment_id", "first_base_join", "plan_hash", "base_estimates", "treatment_valid", "root")
    wide = rows.groupBy("query_key").agg(*(F.min_by(F.when(F.col("config") == c, facts), F.when(F.col("config") == c, F.col("treatment_id"))).alias(c) for c in CONFIGS), F.min("query_id").alias("query_id"))
    short = dict(zip(CONFIGS, ("native", "learned", "exact")))
    return wide.select(
        "query_key", "query_id", *(F.col(c)[f].alias(f"{s}_{f}") for c, s in short.items() for f in ("first_base_join", "plan_hash", "base_estimates", "treatment_valid", "root")),
        *(F.col(c).isNotNull().alias(f"has_{s}") for c, s in short.items()),
    )


def influence(treatments: DataFrame, queries: DataFrame) -> DataFrame:
    """Per query with all three treatments: whether first join and plan changed, how far estimates differ, final errors.

    A query is applicable when every treatment has a first join of two relations."""
    wide = side_by_side(treatments).where("has_native and has_learned and has_exact")
    wide = wide.join(queries.select("query_key", "template", "query_size", "actual_cardinality"), "query_key", "left")
    firsts = [F.col(f"{s}_first_base_join") for s in ("native", "learned", "exact")]
    applicable = firsts[0].isNotNull() & firsts[1].isNotNull() & firsts[2].isNotNull()
    changed = applicable & (firsts[0] != firsts[1])
    plan_changed = ~F.col("native_plan_hash").eqNullSafe(F.col("learned_plan_hash"))
    learned, native = F.col("learned_base_estimates"), F.col("native_base_estimates")
    valid = F.coalesce(F.col("native_treatment_valid"), F.lit(False)) & F.coalesce(F.col("learned_treatment_valid"), F.lit(False)) & F.coalesce(F.col("exact_treatment_valid"), F.lit(False))
    return wide.withColumns({
        "applicable": applicable, "base_join_changed": F.coalesce(changed, F.lit(False)), "full_plan_changed": plan_changed, "treatment_valid": valid,
        "maximum_absolute_log_difference": M.largest_log_difference(learned, native), "learned_native_ratios": M.estimate_ratios(learned, native),
        "treatment_category": M.treatment_category(F.coalesce(changed, F.lit(False)), plan_changed, native, learned),
        "decision_category": M.decision_category(*firsts),
        **{f"{s}_final_q_error": M.q_error(F.col(f"{s}_root"), F.col("actual_cardinality")) for s in ("native", "learned", "exact")},
        "status": F.when(applicable, "ok").otherwise("not_applicable"),
    })


def influence_summary(rows: DataFrame) -> DataFrame:
    """Share of changed first joins with its Wilson interval: overall and by relation count, template and divergence."""
    good = rows.where("applicable and treatment_valid")
    pair = lambda d, v: F.struct(F.lit(d).alias("dimension"), F.coalesce(v.cast("string"), F.lit("None")).alias("value"))
    dims = F.array(pair("all", F.lit("all")), pair("relation_count", F.col("query_size")), pair("query_template", F.col("template")), pair("estimate_divergence", M.divergence_bucket(F.col("maximum_absolute_log_difference"))))
    wide = good.select(F.explode(dims).alias("d"), "base_join_changed", "full_plan_changed").select("d.*", "base_join_changed", "full_plan_changed")
    out = wide.groupBy("dimension", "value").agg(F.count("*").alias("total"), F.count_if("base_join_changed").alias("changed"), F.count_if("full_plan_changed").alias("plans_changed"))
    w = M.wilson(F.col("changed"), F.col("total"))
    return out.select("*", w["rate"].alias("rate"), w["ci_low"].alias("ci_low"), w["ci_high"].alias("ci_high"), (w["rate"] >= RELEVANT_SHARE).alias("practically_relevant"))


def quality_summary(rows: DataFrame) -> DataFrame:
    """One row: agreement of native and learned first joins with the exact-base reference, and the decision counts.

    rows: as influence; the relative outputs of first joins are summarised where `native_relative_output` and
    `learned_relative_output` are there."""
    good = rows.where("applicable and treatment_valid")
    agree = {s: F.col(f"{s}_first_base_join") == F.col("exact_first_base_join") for s in ("native", "learned")}
    aggs = [F.count("*").alias("valid_queries")] + [F.count_if(c).alias(f"{s}_agreements") for s, c in agree.items()]
    aggs += [F.count_if(F.col("decision_category") == c).alias(c.replace(" ", "_")) for c in ("improved", "degraded", "both agree", "neither agrees")]
    relative = [c for c in ("native_relative_output", "learned_relative_output") if c in rows.columns]
    wanted = [(f"{c}_{n}", c, q) for c in relative for n, q in (("median", 0.5), ("p90", 0.9), ("p95", 0.95))]
    aggs += [M.geometric_mean(F.col(c)).alias(f"{c}_geometric_mean") for c in relative]
    out = group_percentiles(good.withColumn("one", F.lit(1)), ["one"], wanted, aggs).drop("one")
    for s in agree:
        w = M.wilson(F.col(f"{s}_agreements"), F.col("valid_queries"))
        out = out.withColumns({f"{s}_rate": w["rate"], f"{s}_ci_low": w["ci_low"], f"{s}_ci_high": w["ci_high"]})
    better = (F.col("learned_agreements") > F.col("native_agreements")) & (F.col("improved") > F.col("degraded"))
    if len(relative) == 2:
        better = better & (F.col("learned_relative_output_geometric_mean") < F.col("native_relative_output_geometric_mean"))
    return out.withColumn("improved_under_all_criteria", better)


def complete_accuracy(rows: DataFrame) -> DataFrame:
    """Per query: final q-errors of the three treatments, winners and improvement ratios."""
    n, l, e = (F.col(f"{s}_final_q_error") for s in ("native", "learned", "exact"))
    return rows.select(
        "query_key", "query_id", "template", "query_size", "actual_cardinality", "treatment_valid", "native_final_q_error", "learned_final_q_error", "exact_final_q_error",
        M.outcome(l, n, ("learned_base", "native", "unchanged")).alias("learned_versus_native"), M.outcome(e, n, ("exact_base", "native", "unchanged")).alias("exact_versus_native"),
        (n / l).alias("learned_improvement_ratio"), (n / e).alias("exact_attainable_improvement_ratio"),
    )


def complete_summary(rows: DataFrame) -> DataFrame:
    """One row over valid queries with all three errors: summaries, winner counts, median improvement ratios."""
    good = complete_accuracy(rows).where("treatment_valid and native_final_q_error is not null and learned_final_q_error is not null and exact_final_q_error is not null")
    plain = [F.count("*").alias("queries")]
    plain += [F.count_if(F.col("learned_versus_native") == v).alias(f"learned_{v}") for v in ("learned_base", "native", "unchanged")]
    plain += [F.count_if(F.col("exact_versus_native") == v).alias(f"exact_{v}") for v in ("exact_base", "native", "unchanged")]
    plain += [M.geometric_mean(F.col(f"{s}_final_q_error")).alias(f"{s}_geometric_mean") for s in ("native", "learned", "exact")]
    wanted = [(f"{s}_{n}", f"{s}_final_q_error", q) for s in ("native", "learned", "exact") for n, q in (("median", 0.5), ("p90", 0.9), ("p95", 0.95))]
    wanted += [("median_learned_improvement", "learned_improvement_ratio", 0.5), ("median_exact_improvement", "exact_attainable_improvement_ratio", 0.5)]
    return group_percentiles(good.withColumn("one", F.lit(1)), ["one"], wanted, plain).drop("one")


def propagated(sections: DataFrame, complete: DataFrame) -> DataFrame:
    """Whether learned estimates win more than they lose on filtered base occurrences and on complete queries."""
    single = sections.where("section = 'filtered_workload_occurrences'").select((F.col("learned_better") > F.col("native_better")).alias("single_table_improved"))
    final = complete.select((F.col("learned_learned_base") > F.col("learned_native")).alias("complete_query_improved"))
    return single.join(F.broadcast(final)).withColumn("improvement_propagated", F.col("single_table_improved") & F.col("complete_query_improved"))
