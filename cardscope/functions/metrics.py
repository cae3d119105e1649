"""Error metrics, buckets and decision rules as column expressions, and the aggregates built on them."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the evaluation protocol.
FLOOR = 1.0
EQUALITY_TOLERANCE = 1e-9
WILSON_Z = 1.959963984540054
RUNTIME_THRESHOLD = 0.05
CARDINALITY_EDGES = ((1, "(0,1]"), (10, "(1,10]"), (100, "(10,100]"), (1_000, "(100,1k]"), (10_000, "(1k,10k]"), (100_000, "(10k,100k]"))
SELECTIVITY_EDGES = ((0.0001, "(0,0.0001]"), (0.001, "(0.0001,0.001]"), (0.01, "(0.001,0.01]"), (0.1, "(0.01,0.1]"), (0.5, "(0.1,0.5]"), (1.0, "(0.5,1]"))
DIVERGENCE_EDGES = ((1.5, "<1.5x"), (2, "1.5x-2x"), (10, "2x-10x"), (100, "10x-100x"))
THRESHOLDS = (("le1_5", "<=", 1.5), ("le2", "<=", 2.0), ("le5", "<=", 5.0), ("gt10", ">", 10.0), ("gt100", ">", 100.0))


def finite(x: Column) -> Column:
    """Whether x is a number, neither null, NaN nor infinite."""
    return F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x) < float("inf")), F.lit(False))


def floored(x: Column) -> Column:
    """x, at least 1: what metrics and injected cardinalities use in place of sub-unit estimates."""
    return F.greatest(x.cast("double"), F.lit(FLOOR))


def _checked(x: Column, name: str) -> Column:
    return F.when(x.isNull() | (finite(x) & (x >= 0)), x).otherwise(F.raise_error(F.concat(F.lit(f"{name} must be finite and not negative: "), x.cast("string"))))


def q_error(estimate: Column, actual: Column, strict: bool = False) -> Column:
    """The larger of both ratios under the floor. A negative or non-finite input gives null, or an error if strict."""
    ok = finite(estimate) & (estimate >= 0) & finite(actual) & (actual >= 0)
    if strict:
        estimate, actual, ok = _checked(estimate, "estimate"), _checked(actual, "actual"), F.lit(True)
    e, a = floored(estimate), floored(actual)
    return F.when(ok & estimate.isNotNull() & actual.isNotNull(), F.greatest(e / a, a / e))


def signed_ratio(estimate: Column, actual: Column) -> Column:
    """Estimate over actual under the floor; null where either is negative, null or not finite."""
    ok = finite(estimate) & (estimate >= 0) & finite(actual) & (actual >= 0)
    return F.when(ok, floored(estimate) / floored(actual))


def direction(estimate: Column, actual: Column) -> Column:
    """over, under or equal, within the equality tolerance."""
    r = signed_ratio(estimate, actual)
    return F.when(r > 1 + EQUALITY_TOLERANCE, "over").when(r < 1 - EQUALITY_TOLERANCE, "under").when(r.isNotNull(), "equal")


def abs_log_ratio(a: Column, b: Column) -> Column:
    return F.abs(F.ln(floored(a) / floored(b)))


def outcome(left: Column, right: Column, names: tuple[str, str, str] = ("left_better", "right_better", "equal"), tolerance: float = EQUALITY_TOLERANCE) -> Column:
    """Which of two errors is smaller, equal within a tolerance relative to the larger of them and 1."""
    close = F.abs(left - right) <= tolerance * F.greatest(F.abs(left), F.abs(right), F.lit(1.0))
    return F.when(close, names[2]).when(left < right, names[0]).when(left > right, names[1])


def cardinality_bucket(x: Column) -> Column:
    out = F.when(x <= 0, "exactly_zero")
    for edge, name in CARDINALITY_EDGES:
        out = out.when(x <= edge, name)
    return out.when(x.isNotNull(), ">100k")


def selectivity_bucket(x: Column) -> Column:
    out = F.when(x.isNull(), "unknown").when(x == 0, "exactly_zero")
    for edge, name in SELECTIVITY_EDGES:
        out = out.when(x <= edge, name)
    return out.otherwise(">1")


def divergence_bucket(x: Column) -> Column:
    """Of an absolute log ratio."""
    out = F.when(x < math.log(DIVERGENCE_EDGES[0][0]), DIVERGENCE_EDGES[0][1])
    for edge, name in DIVERGENCE_EDGES[1:]:
        out = out.when(x < math.log(edge), name)
    return out.when(x.isNotNull(), ">=100x")


def speedup_class(x: Column, threshold: float = RUNTIME_THRESHOLD) -> Column:
    return F.when(x > 1 / (1 - threshold), "improved").when(x < 1 / (1 + threshold), "degraded").when(x.isNotNull(), "unchanged")


def decision_category(native: Column, learned: Column, exact: Column) -> Column:
    """How two choices of a first join stand to the reference choice."""
    n, e = native == exact, learned == exact
    return (
        F.when(native.isNull() | learned.isNull() | exact.isNull(), "not applicable")
        .when(e & ~n, "improved").when(n & ~e, "degraded").when(n & e, "both agree").otherwise("neither agrees")
    )


def treatment_category(join_changed: Column, plan_changed: Column, native: Column, learned: Column) -> Column:
    """What a treatment changed; native and learned are maps of base estimates by relation."""
    shared = F.array_intersect(F.map_keys(learned), F.map_keys(native))
    apart = F.exists(shared, lambda k: abs_log_ratio(F.element_at(learned, k), F.element_at(native, k)) > math.log(1.01))
    return (
        F.when(join_changed, "base join changed").when(plan_changed, "plan changed but base join unchanged")
        .when(apart, "estimates changed but plan unchanged").otherwise("no meaningful estimate difference")
    )


def estimate_ratios(learned: Column, native: Column) -> Column:
    """Map of learned over native by relation, for relations in both; null over a native estimate of 0."""
    shared = F.array_intersect(F.map_keys(learned), F.map_keys(native))
    return F.map_from_arrays(shared, F.transform(shared, lambda k: F.try_divide(F.element_at(learned, k), F.element_at(native, k))))


def largest_log_difference(learned: Column, native: Column) -> Column:
    shared = F.array_intersect(F.map_keys(learned), F.map_keys(native))
    return F.coalesce(F.array_max(F.transform(shared, lambda k: abs_log_ratio(F.element_at(learned, k), F.element_at(native, k)))), F.lit(0.0))


def operator_class(op: Column) -> Column:
    return F.when(op == "=", "equality").when(op.isin("<", "<=", ">", ">="), "range").when(op.isin("between", "in"), op).otherwise("other")


def operator_shape(ops: Column) -> Column:
    """Of the operators of a filter: no_filter, the class they share, or mixed."""
    classes = F.array_distinct(F.transform(ops, operator_class))
    return F.when(F.coalesce(F.size(ops), F.lit(0)) <= 0, "no_filter").when(F.size(classes) == 1, F.get(classes, F.lit(0))).otherwise("mixed")


def equality_range_shape(ops: Column) -> Column:
    equality, ranged = F.exists(ops, lambda o: o == "="), F.exists(ops, lambda o: o.isin("<", "<=", ">", ">=", "between"))
    return F.when(equality & ranged, "mixed").when(equality, "equality").when(ranged, "range").otherwise("other_or_unfiltered")


def relative_output(x: Column, reference: Column, epsilon: float = 1.0) -> Column:
    return F.greatest(x.cast("double"), F.lit(epsilon)) / F.greatest(reference.cast("double"), F.lit(epsilon))


def censored(value: Column, timeout: Column, timeout_seconds: Column) -> Column:
    """A time in ms; the limit where the run timed out."""
    return F.when(F.coalesce(timeout, F.lit(False)), timeout_seconds * 1000.0).otherwise(value)


def wilson(successes: Column, total: Column, z: float = WILSON_Z) -> Column:
    """Struct (rate, ci_low, ci_high) of the Wilson interval, clipped to [0, 1]; nulls for a total of 0."""
    n = F.nullif(total.cast("double"), F.lit(0.0))
    p = successes / n
    scale = 1 + z * z / n
    centre, margin = (p + z * z / (2 * n)) / scale, z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / scale
    return F.struct(p.alias("rate"), F.when(p.isNotNull(), F.greatest(F.lit(0.0), centre - margin)).alias("ci_low"), F.when(p.isNotNull(), F.least(F.lit(1.0), centre + margin)).alias("ci_high"))


def geometric_mean(x: Column) -> Column:
    """Aggregate; an error on values that are not positive."""
    return F.exp(F.avg(F.when(x > 0, F.ln(x)).when(x.isNotNull(), F.raise_error(F.lit("geometric mean needs positive values")).cast("double"))))


def summary(x: Column, prefix: str) -> list[Column]:
    """Aggregates of an error column: count, mean, median, geometric mean, percentiles, maximum, threshold shares."""
    out = [F.count(x).alias(f"{prefix}_count"), F.avg(x).alias(f"{prefix}_mean"), F.median(x).alias(f"{prefix}_median"), geometric_mean(x).alias(f"{prefix}_geometric_mean")]
    out += [F.percentile(x, q).alias(f"{prefix}_p{round(q * 100)}") for q in (0.75, 0.9, 0.95, 0.99)] + [F.max(x).alias(f"{prefix}_max")]
    for name, op, edge in THRESHOLDS:
        hit = F.count_if(x <= edge) if op == "<=" else F.count_if(x > edge)
        out += [hit.alias(f"{prefix}_{name}_count"), F.try_divide(hit, F.count(x)).alias(f"{prefix}_{name}_fraction"), F.try_divide(hit * 100.0, F.count(x)).alias(f"{prefix}_{name}_percent")]
    return out


def estimator_summary(error: Column, ratio: Column, prefix: str) -> list[Column]:
    """`summary` with the median signed ratio and the rates of over- and underestimation."""
    return [
        *summary(error, prefix), F.median(ratio).alias(f"{prefix}_median_signed_ratio"),
        F.try_divide(F.count_if(ratio > 1 + EQUALITY_TOLERANCE), F.count(ratio)).alias(f"{prefix}_overestimation_rate"),
        F.try_divide(F.count_if(ratio < 1 - EQUALITY_TOLERANCE), F.count(ratio)).alias(f"{prefix}_underestimation_rate"),
    ]
