"""Evaluated base occurrences: their shape, sections, error categories and worst cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cardscope.functions import metrics as M
from cardscope.operators.exact_median import group_percentiles
from cardscope.session import HOT_ROWS, cut_lineage, hot_of

# When a category is a systematic failure, and the conclusions about a single failure.
SYSTEMATIC_ROWS, SYSTEMATIC_FACTOR = 5, 2.0
WORST = 50
#: Categories with more rows than this have their percentiles selected, at most so many of them; those of others are made of all values.
SELECTED_ROWS, MAX_SELECTED = 20_000, 5_000
_MASK = r"'[^']*+'(?:'[^']*+')*+"
_OPERATOR = r"(<=|>=|=|<|>|\bbetween\b|\bin\b)"


def predicate_operators(predicate: Column) -> Column:
    """The operators of the conjuncts of a filter, in order; empty for none."""
    text = F.regexp_replace(F.lower(F.coalesce(predicate, F.lit(""))), _MASK, "?")
    return F.regexp_extract_all(text, F.lit(_OPERATOR), 1)


def predicate_columns(predicate: Column) -> Column:
    """The distinct columns that a filter constrains, in order and as written, without their alias."""
    text = F.regexp_replace(F.coalesce(predicate, F.lit("")), _MASK, "?")
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"[A-Za-z_]\w*\.([A-Za-z_]\w*)"), 1))


def with_shape(df: DataFrame, predicate: str = "predicate_text") -> DataFrame:
    """df with operators, predicate_count, operator_class, equality_range_shape and involved_columns of its filter."""
    df = df.withColumns({"operators": predicate_operators(F.col(predicate)), "involved_columns": predicate_columns(F.col(predicate))})
    ops = F.col("operators")
    return df.withColumns({"predicate_count": F.size(ops), "operator_class": M.operator_shape(ops), "equality_range_shape": M.equality_range_shape(ops)})


def evaluated(failures: DataFrame, base_queries: DataFrame) -> DataFrame:
    """One row per evaluated occurrence with all that the analyses use, from raw result rows and their base queries.

    Results delivered twice count once. A row stays valid only if its status is ok and both q-errors are finite and at
    least 1; others keep their values with status `invalid`. Null group names stay null.
    """
    once = failures.dropDuplicates(["result_id"]).drop("predicate_count")
    base = base_queries.select("occurrence_key", "occurrence_id", "normalized_sql_id", "original_query_label", "predicate_text")
    rows = with_shape(once.join(base, "occurrence_key", "left"))
    good = (F.col("status") == "ok") & M.finite(F.col("learned_q_error")) & M.finite(F.col("native_q_error")) & (F.col("learned_q_error") >= 1) & (F.col("native_q_error") >= 1)
    exact = F.col("exact_cardinality").cast("double")
    return rows.withColumns({
        "status": F.when(F.coalesce(good, F.lit(False)), F.lit("ok")).otherwise(F.lit("invalid")),
        "selectivity": F.try_divide(exact, F.col("table_cardinality").cast("double")),
        "learned_signed_error_ratio": M.signed_ratio(F.col("learned_estimate"), exact),
        "native_signed_error_ratio": M.signed_ratio(F.col("native_estimate"), exact),
        "estimate_direction": M.direction(F.col("learned_estimate"), exact),
    })


def keep_first(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key in the given order; null is a key. The first row is found by a map-side aggregate, so
    a key that holds a third of all rows is no problem."""
    first = df.groupBy(key).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("__first"))
    return first.select("__first.*")


def _firsts(rows: DataFrame, order: list[str]) -> DataFrame:
    """The first row of each statement. One column of numbers as order names rows; their smallest are found by hash and rows
    come by it, not by statement, so a frequent statement is no hot key."""
    if len(order) == 1 and dict(rows.dtypes)[order[0]] in ("int", "bigint"):
        first = rows.groupBy("normalized_sql_id").agg(F.min(order[0]).alias("__first"))
        return rows.join(first.select("__first"), F.col(order[0]) == F.col("__first"), "left_semi")
    return keep_first(rows, "normalized_sql_id", order)


SECTIONS = ("all_workload_occurrences", "unique_normalized_sql", "filtered_workload_occurrences", "unique_filtered_sql", "unfiltered_full_table_cases")


def section_summary(rows: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Error summaries of five overlapping sections of the valid rows: all, one per statement, filtered, one per filtered
    statement, unfiltered. `order` decides which row stands for a statement, and is unique. Sections without rows do not appear."""
    order = order or ["result_id"]
    valid = rows.where("status = 'ok'").select(
        "normalized_sql_id", "is_filtered", "learned_q_error", "native_q_error", "learned_signed_error_ratio", "native_signed_error_ratio", *order
    )
    valid = cut_lineage(valid)  # read by every section and pass
    filtered = F.coalesce("is_filtered", F.lit(False))
    most = valid.count()
    parts = [valid, _firsts(valid, order), valid.where(filtered), _firsts(valid.where(filtered), order), valid.where(~filtered)]
    every = None
    for name, part in zip(SECTIONS, parts):
        part = part.select(F.lit(name).alias("section"), *valid.columns)
        every = part if every is None else every.unionByName(part)
    result = M.outcome(F.col("learned_q_error"), F.col("native_q_error"), ("learned_better", "native_better", "equal"))
    every = every.withColumn("__outcome", result)
    # distinct statements are counted beside the other aggregates: with them, every row would be sent once more
    statements = every.where("normalized_sql_id is not null").select("section", "normalized_sql_id").distinct().groupBy("section").agg(F.count("*").alias("statements"))
    plain = [F.count("*").alias("rows")]
    plain += [F.count_if(F.col("__outcome") == o).alias(o) for o in ("learned_better", "native_better", "equal")]
    wanted = []
    for p in ("learned", "native"):
        x, r = F.col(f"{p}_q_error"), F.col(f"{p}_signed_error_ratio")
        plain += [F.avg(x).alias(f"{p}_mean"), M.geometric_mean(x).alias(f"{p}_geometric_mean"), F.max(x).alias(f"{p}_max")]
        plain += [F.try_divide(F.count_if(x <= e if op == "<=" else x > e), F.count(x)).alias(f"{p}_{n}_fraction") for n, op, e in M.THRESHOLDS]
        plain += [F.try_divide(F.count_if(r > 1 + M.EQUALITY_TOLERANCE), F.count(r)).alias(f"{p}_overestimation_rate"), F.try_divide(F.count_if(r < 1 - M.EQUALITY_TOLERANCE), F.count(r)).alias(f"{p}_underestimation_rate")]
        wanted += [(f"{p}_{n}", f"{p}_q_error", q) for n, q in (("median", 0.5), ("p75", 0.75), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99))]
        wanted.append((f"{p}_median_signed_ratio", f"{p}_signed_error_ratio", 0.5))
    out = group_percentiles(every, ["section"], wanted, plain, most=most).join(F.broadcast(statements), "section", "left").fillna(0, ["statements"])
    difference = lambda c: (F.col(f"learned_{c}") - F.col(f"native_{c}")).alias(f"{c}_learned_minus_native")
    return out.select("*", *(difference(c) for c in ("median", "geometric_mean", "le2_fraction")))


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("None"))


def categories(df: DataFrame) -> Column:
    """Array of (dimension, value) structs: the groups a row belongs to. Missing values are the value None.

    Encodings and nullability of columns are read from `encoding_types` and `has_null_sensitive_column` where df has them."""
    has = set(df.columns)
    nullable = F.col("has_null_sensitive_column") if "has_null_sensitive_column" in has else F.lit(False)
    single = [
        ("table", _text(F.col("table"))), ("query_template", _text(F.col("query_template"))), ("predicate_count", _text(F.col("predicate_count"))),
        ("operator_class", F.col("operator_class")), ("equality_range_shape", F.col("equality_range_shape")),
        ("constrained_column_count", F.size("involved_columns").cast("string")), ("exact_cardinality_bucket", _text(M.cardinality_bucket(F.col("exact_cardinality")))),
        ("selectivity_bucket", M.selectivity_bucket(F.col("selectivity"))), ("estimate_direction", _text(F.col("estimate_direction"))),
        ("inference_mode", _text(F.col("inference_mode"))), ("nullable_constrained_columns", F.when(nullable, "nullable").otherwise("non_nullable")),
    ]
    pair = lambda d, v: F.struct(F.lit(d).alias("dimension"), v.alias("value"))
    encoding = (lambda c: F.coalesce(F.element_at("encoding_types", c), F.lit("unknown"))) if "encoding_types" in has else (lambda c: F.lit("unknown"))
    per_column = [F.transform("involved_columns", lambda c: pair("constrained_column", F.concat_ws(".", _text(F.col("table")), c))), F.transform("involved_columns", lambda c: pair("encoding_type", encoding(c)))]
    return F.concat(F.array(*(pair(d, v) for d, v in single)), *per_column)


_CATEGORY_COLUMNS = frozenset((
    "table", "query_template", "predicate_count", "operator_class", "equality_range_shape", "involved_columns", "exact_cardinality", "selectivity", "estimate_direction", "inference_mode",
    "has_null_sensitive_column", "encoding_types", "normalized_sql_id", "learned_q_error", "native_q_error", "learned_signed_error_ratio",
))


def category_metrics(rows: DataFrame, only: tuple[str, ...] = ()) -> DataFrame:
    """Error metrics of every (dimension, value) among the valid rows, and whether it is a systematic failure: at least
    SYSTEMATIC_ROWS rows and a median of at least SYSTEMATIC_FACTOR times the overall one. only: the dimensions to make; all if empty."""
    valid = rows.where("status = 'ok'")
    valid = cut_lineage(valid.select([c for c in valid.columns if c in _CATEGORY_COLUMNS]))  # read by every pass below
    groups = F.filter(categories(valid), lambda c: c["dimension"].isin(*only)) if only else categories(valid)
    wide = valid.select("normalized_sql_id", "learned_q_error", "native_q_error", "learned_signed_error_ratio", F.explode(groups).alias("c"))
    wide = wide.select("c.dimension", "c.value", *wide.columns[:-1])
    x, n, r = F.col("learned_q_error"), F.col("native_q_error"), F.col("learned_signed_error_ratio")
    share = lambda c, edge: (F.count_if(c > edge) * 100.0 / F.count("*"))
    plain = [
        F.count("*").alias("group_size"), M.geometric_mean(x).alias("learned_geometric_mean_q_error"),
        F.max(x).alias("learned_max_q_error"), share(x, 10).alias("learned_gt10_percent"), share(x, 100).alias("learned_gt100_percent"),
        share(r, 1 + M.EQUALITY_TOLERANCE).alias("learned_overestimation_percent"), M.geometric_mean(n).alias("native_geometric_mean_q_error"), share(n, 10).alias("native_gt10_percent"),
    ]
    wanted = [(f"learned_{k}_q_error", "learned_q_error", q) for k, q in (("median", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99))]
    wanted += [("learned_median_signed_ratio", "learned_signed_error_ratio", 0.5), ("native_median_q_error", "native_q_error", 0.5), ("native_p95_q_error", "native_q_error", 0.95)]
    # distinct statements are counted beside the other aggregates: with them, every row would be sent once more
    # rows of a statement mostly fall in the same groups, so they are made one before they are unpivoted
    named = valid.where("normalized_sql_id is not null").select("normalized_sql_id", groups.alias("cs")).distinct().select("normalized_sql_id", F.explode("cs").alias("c"))
    named = named.select("c.dimension", "c.value", "normalized_sql_id").distinct().groupBy("dimension", "value").agg(F.count("*").alias("unique_query_count"))
    # a row is in many groups, so together even groups that are not hot are more than memory holds, unless the table is small
    spread = valid.agg(F.sum(F.size(groups))).first()[0] or 0
    hot = None if spread <= HOT_ROWS else hot_of(wide.groupBy("dimension", "value").count(), SELECTED_ROWS, MAX_SELECTED)
    grouped = group_percentiles(wide, ["dimension", "value"], wanted, plain, hot, most=spread, written=True).join(named, ["dimension", "value"], "left").fillna(0, ["unique_query_count"])
    overall = group_percentiles(valid.select(F.lit(1).alias("one"), "learned_q_error"), ["one"], [("overall_learned_median_q_error", "learned_q_error", 0.5)]).drop("one")
    out = grouped.withColumnsRenamed({"dimension": "group_dimension", "value": "group_value"}).join(F.broadcast(overall))
    systematic = (F.col("group_size") >= SYSTEMATIC_ROWS) & (F.col("overall_learned_median_q_error") > 0) & (F.col("learned_median_q_error") >= SYSTEMATIC_FACTOR * F.col("overall_learned_median_q_error"))
    return out.withColumns({"systematic_failure_candidate": systematic, "systematic_min_group_size": F.lit(SYSTEMATIC_ROWS), "systematic_median_multiplier": F.lit(SYSTEMATIC_FACTOR)})


def systematic_groups(rows: DataFrame, among: DataFrame) -> DataFrame:
    """Those (dimension, value) of `among`, a table small enough to broadcast, that `category_metrics` calls systematic failures
    among the valid rows. rows come from a written table, as they are read in several passes.

    Whether a median reaches the limit is known from the number of values below it and, where these are half of them, from the
    values on both sides of it: all are combined map-side, so no group's values are gathered or sent."""
    valid = rows.where("status = 'ok'")
    overall = group_percentiles(valid, [], [("median", "learned_q_error", 0.5)], written=True).first()
    if overall is None or not (overall[0] or 0) > 0:
        return among.limit(0)
    x, limit = F.col("learned_q_error"), F.lit(SYSTEMATIC_FACTOR * overall[0])
    wide = valid.select("learned_q_error", F.explode(categories(valid)).alias("c")).select("c.dimension", "c.value", "learned_q_error")
    facts = wide.join(F.broadcast(among), ["dimension", "value"], "left_semi").groupBy("dimension", "value").agg(
        F.count("*").alias("size"), F.count(x).alias("n"), F.count_if(x < limit).alias("below"), F.max(F.when(x < limit, x)).alias("low"), F.min(F.when(x >= limit, x)).alias("high")
    )
    twice = F.col("below") * 2
    reached = (twice < F.col("n")) | ((twice == F.col("n")) & (F.col("low") * 0.5 + F.col("high") * 0.5 >= limit))
    return facts.where((F.col("size") >= SYSTEMATIC_ROWS) & reached).select("dimension", "value")


def candidate_classification(matching: Column, fallback: Column, mode: Column, learned: Column, native: Column) -> Column:
    return (
        F.when(F.size(matching) > 0, "systematic category failure").when(F.coalesce(fallback, F.lit(False)), "preprocessing/translation issue")
        .when(mode == "progressive_sampling", "sampling instability").when((learned > 10) & (native < learned), "likely model limitation").otherwise("isolated outlier")
    )


def worst_rows(rows: DataFrame, limit: int = WORST, id_col: str = "result_id") -> DataFrame:
    """The valid rows of both lists of `worst_queries`, with their ratio and flags; ties by id."""
    valid = rows.where("status = 'ok'").withColumn("learned_native_q_error_ratio", F.col("learned_q_error") / F.col("native_q_error"))
    tops = [valid.orderBy(F.col(c).desc(), id_col).limit(limit) for c in ("learned_q_error", "learned_native_q_error_ratio")]
    flags = ("worst_learned_q_error", "worst_learned_native_disadvantage")
    both = tops[0].withColumns({flags[0]: F.lit(True), flags[1]: F.lit(False)}).unionByName(tops[1].withColumns({flags[0]: F.lit(False), flags[1]: F.lit(True)}))
    return both.groupBy(id_col).agg(F.first(F.struct(*valid.columns)).alias("r"), *(F.max(f).alias(f) for f in flags)).select("r.*", *flags)


def worst_queries(rows: DataFrame, limit: int = WORST, id_col: str = "result_id", metrics: DataFrame | None = None) -> DataFrame:
    """The `limit` rows with the largest learned q-error and the `limit` with the largest learned over native ratio, merged,
    with flags for both lists, the systematic categories they fall in, and a candidate classification.

    Ties are decided by id. A top-k report: the limit is the feature, so its result is small by definition."""
    rows = cut_lineage(rows.where("status = 'ok'"))  # read by both lists and the categories
    picked = cut_lineage(worst_rows(rows, limit, id_col))
    wide = picked.select(id_col, F.explode(categories(picked)).alias("c")).select(id_col, "c.dimension", "c.value")
    # other categories than those of the picked rows are not asked for, nor more of them than whether they are systematic failures
    if metrics is None:
        bad = systematic_groups(rows, wide.select("dimension", "value").distinct())
    else:
        bad = metrics.where("systematic_failure_candidate").select(F.col("group_dimension").alias("dimension"), F.col("group_value").alias("value"))
    hits = F.broadcast(wide).join(bad, ["dimension", "value"]).groupBy(id_col).agg(F.array_sort(F.collect_set(F.struct("dimension", "value"))).alias("matching_systematic_groups"))
    out = picked.join(hits, id_col, "left")
    matching = F.coalesce("matching_systematic_groups", F.array().cast("array<struct<dimension:string,value:string>>"))
    verdict = candidate_classification(matching, F.col("fallback_used"), F.col("inference_mode"), F.col("learned_q_error"), F.col("native_q_error"))
    evidence = F.to_json(F.struct("fallback_used", "inference_mode", "learned_q_error", matching.alias("matching_systematic_groups"), "native_q_error"))
    return out.withColumns({
        "matching_systematic_groups": matching, "candidate_classification": verdict, "classification_evidence": evidence,
        "classification_status": F.lit("candidate_requires_manual_review"),
    })


def seed_targets(rows: DataFrame, limit: int = 10, id_col: str = "occurrence_id", strict: bool = False) -> DataFrame:
    """The `limit` worst filtered, progressively sampled rows with different statements, ranked; ties by id."""
    valid = rows.where("status = 'ok' and is_filtered and inference_mode = 'progressive_sampling' and not coalesce(fallback_used, false)")
    each = keep_first(valid.withColumn("__worst", -F.col("learned_q_error")), "normalized_sql_id", ["__worst", id_col])
    top = each.orderBy("__worst", id_col).limit(limit)
    out = top.withColumn("rank", F.row_number().over(Window.orderBy("__worst", id_col))).drop("__worst")
    if strict and (n := out.count()) < limit:
        raise ValueError(f"only {n} distinct filtered, sampled occurrences; {limit} are needed")
    return out


def outcome_per_query(rows: DataFrame, query: str = "original_query_label") -> DataFrame:
    """(query, outcome): improved, worsened or unchanged, by the medians of both q-errors over its valid rows."""
    valid = rows.where("status = 'ok'")
    by = group_percentiles(valid, [query], [("learned", "learned_q_error", 0.5), ("native", "native_q_error", 0.5)])
    verdict = F.when(F.col("learned") < F.col("native"), "improved").when(F.col("learned") > F.col("native"), "worsened").otherwise("unchanged")
    return by.select(query, verdict.alias("single_table_estimate_outcome"))
