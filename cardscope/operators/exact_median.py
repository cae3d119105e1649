"""Exact percentiles per group that survive a group holding a third of all rows.

Groups up to a size limit are aggregated in one shuffle. Each larger group is a hot key, of which there are boundedly many
(cardscope.session.hot_keys), and its order statistics are found by selection (`at_ranks`): a range of values is cut into BUCKETS
equal parts, counts per part are combined map-side, and only the rows of parts that hold a wanted rank are kept, in a
written table, for the next round. All value columns and all ranks are looked for together.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cardscope.operators.joins import keyed_join
from cardscope.session import HOT_ROWS, MAX_HOT, cut_lineage, hot_keys

BUCKETS = 4096


def group_percentiles(
    df: DataFrame, keys: list[str], wanted: list[tuple[str, str, float]], plain: list[Column] | None = None, hot: DataFrame | None = None, hot_rows: int = HOT_ROWS, max_hot: int = MAX_HOT, most: int | None = None,
    written: bool = False,
) -> DataFrame:
    """One row per group (nulls in a key form a group): keys, the plain aggregates, and each wanted percentile.

    wanted: (name, value column, fraction). A percentile between two ranks is interpolated linearly; nulls are left out, and a
    group without values has null. Values must be finite. Ties and repeated rows count as often as they occur. hot: the keys
    to treat as hot, a bounded table; found from hot_rows and max_hot if not given. most: a number of rows that no group exceeds, where
    it is known; up to hot_rows there are then no hot keys to look for. written: df is read from
    written tables without a shuffle, so that hot rows are read again for each pass rather than written once more. Without keys the whole table is a group,
    which is always selected, never gathered.
    """
    plain = plain or []
    by_value: dict[str, list[float]] = {}
    for _, v, q in wanted:
        by_value.setdefault(v, []).append(q)
    # one digest of a group's values answers all its fractions
    direct = [F.percentile(v, F.array(*(F.lit(q) for q in qs))).alias(f"__p_{v}") for v, qs in by_value.items()]
    spread = [F.get(f"__p_{v}", F.lit(by_value[v].index(q))).alias(name) for name, v, q in wanted]

    def together(rows: DataFrame) -> DataFrame:
        done = rows.groupBy(*keys).agg(*plain, *direct)
        return done.select(*(c for c in done.columns if not c.startswith("__p_")), *spread)

    if not keys:
        one = df.withColumn("__g", F.lit(0).cast("bigint"))
        rest = one.groupBy("__g").agg(*plain) if plain else one.select("__g").limit(1)
        return _with_selected(one, rest, wanted, written)
    if hot is None and most is not None and most <= hot_rows:
        return together(df)
    hot = (hot_keys(df, keys, hot_rows, max_hot) if hot is None else hot).select(*keys)
    if hot.isEmpty():
        return together(df)
    # hot groups go by number: keys may have any names, and long texts would be written and sent with every value
    hot = cut_lineage(hot.withColumn("__g", F.monotonically_increasing_id()))
    cold = together(keyed_join(df, hot, keys, "left_anti", small=True))
    rows = keyed_join(df, hot, keys, small=True)
    found = rows.groupBy(*keys, "__g").agg(*plain) if plain else hot
    return cold.unionByName(_with_selected(rows, found, wanted, written))


def group_medians(df: DataFrame, keys: list[str], values: list[str], hot: DataFrame | None = None, hot_rows: int = HOT_ROWS, max_hot: int = MAX_HOT) -> DataFrame:
    """(keys, `<value>_median` of each value column), as group_percentiles."""
    return group_percentiles(df, keys, [(f"{v}_median", v, 0.5) for v in values], None, hot, hot_rows, max_hot)


def _with_selected(rows: DataFrame, found: DataFrame, wanted: list[tuple[str, str, float]], written: bool) -> DataFrame:
    """found, a row per hot group, with the wanted percentiles of its rows; `__g` numbers groups in both, and is left out."""
    values = list(dict.fromkeys(v for _, v, _ in wanted))
    narrow = rows.select("__g", *(F.col(v).cast("double").alias(f"__x{i}") for i, v in enumerate(values)))
    narrow = narrow if written else cut_lineage(narrow)
    cells = F.explode(F.array(*(F.struct(F.lit(i).alias("v"), F.col(f"__x{i}").alias("x")) for i in range(len(values)))))
    x = narrow.select("__g", cells.alias("c")).select("__g", "c.v", "c.x").where("x is not null").withColumn("n", F.lit(1))
    by = ["__g", "v"]
    sizes = cut_lineage(x.groupBy(*by).agg(F.count("*").alias("size"), F.min("x").alias("__lo"), F.max("x").alias("__hi")))
    each = [(values.index(v), q, f) for _, v, q in wanted for f in (F.floor, F.ceil)]
    ranks = F.array(*(F.struct(F.lit(i).alias("target"), F.lit(v).alias("of"), f(F.lit(q) * (F.col("size") - 1)).alias("rank")) for i, (v, q, f) in enumerate(each)))
    targets = sizes.select(*by, F.explode(ranks).alias("t")).select(*by, "t.*").where("of = v").drop("of")
    got = at_ranks(x, by, targets, ends=sizes.drop("size"))
    got = keyed_join(got, sizes.select(*by, "size"), by, small=True)

    def between(i: int, q: float) -> Column:
        low, high = (F.max(F.when(F.col("target") == k, F.col("value"))) for k in (2 * i, 2 * i + 1))
        size = F.max(F.when(F.col("target") == 2 * i, F.col("size")))
        share = F.lit(q) * (size - 1) - F.floor(F.lit(q) * (size - 1))
        return low * (1 - share) + high * share

    names = [name for name, _, _ in wanted]
    kept = [c for c in found.columns if c not in ("__g", *names)]
    ends = got.groupBy("__g").agg(*(between(i, q).alias(f"__e{i}") for i, (_, _, q) in enumerate(wanted)))
    found = keyed_join(found, ends, ["__g"], "left", small=True)
    return found.select(*kept, *(F.col(f"__e{i}").alias(n) for i, n in enumerate(names)))


def at_ranks(x: DataFrame, keys: list[str], targets: DataFrame, few: int = HOT_ROWS, ends: DataFrame | None = None) -> DataFrame:
    """(keys, target, value): the value at each wanted rank, counted from 0, of the rows of each group in order.

    x: (keys, x, n), n equal rows each; targets: (keys, target, rank), a bounded table, its ranks within the group. No group is
    gathered: a round counts the rows of a range by parts and goes on with the parts that hold a rank. Once at most `few` rows are
    left of all, they are ordered. Every round but the last reads x, or what is left of it, twice. The parts of the first round are
    equal on a logarithmic scale, so that a long tail does not leave nearly all rows in one part. Equal values go on as one row.
    ends: (keys, __lo, __hi), the least and the largest x, where they are known.
    """
    ends = ends if ends is not None else x.groupBy(*keys).agg(F.min("x").alias("__lo"), F.max("x").alias("__hi"))
    state = cut_lineage(keyed_join(targets, ends, keys, small=True).withColumn("__range", F.lit("")))
    done = state.where("__lo >= __hi").select(*keys, "target", F.col("__lo").alias("value"))
    state, rows = state.where("__lo < __hi"), x
    while not state.isEmpty():
        ranges = state.select(*keys, "__range", "__lo", "__hi").distinct()
        inside = rows if "__range" in rows.columns else rows.withColumn("__range", F.lit(""))
        placed = keyed_join(inside, ranges, [*keys, "__range"], small=True)
        # halved, as the difference of two doubles may be too large for one
        at, lo, hi = ((F.col(c) / 2 if "__range" in rows.columns else F.signum(c) * F.log1p(F.abs(c))) for c in ("x", "__lo", "__hi"))
        width = hi - lo
        equal = F.floor((at - lo) / width * BUCKETS)
        part = F.when(width > 0, F.least(equal, F.lit(BUCKETS - 1))).otherwise((F.col("x") > F.col("__lo")).cast("bigint"))
        placed = placed.withColumn("__part", part)
        parts = placed.groupBy(*keys, "__range", "__part").agg(F.sum("n").alias("n"), F.min("x").alias("__lo"), F.max("x").alias("__hi"))
        upto = F.sum("n").over(Window.partitionBy(*keys, "__range").orderBy("__part"))  # at most BUCKETS rows
        parts = parts.withColumns({"__upto": upto, "__before": upto - F.col("n")})
        hits = keyed_join(parts, state.select(*keys, "__range", "target", "rank"), [*keys, "__range"], small=True).where("rank >= __before and rank < __upto")
        next_ = F.concat_ws(".", "__range", "__part")
        state = cut_lineage(hits.select(*keys, "target", (F.col("rank") - F.col("__before")).alias("rank"), "__lo", "__hi", next_.alias("__range")))
        done = done.unionByName(state.where("__lo >= __hi").select(*keys, "target", F.col("__lo").alias("value")))
        state = state.where("__lo < __hi")
        open_ = state.select(*keys, "__range").distinct()
        rows = placed.withColumn("__range", next_).select(*keys, "__range", "x", "n")
        rows = keyed_join(rows, open_, [*keys, "__range"], "left_semi", small=True)
        rows = cut_lineage(rows.groupBy(*keys, "__range", "x").agg(F.sum("n").alias("n")))
        if rows.count() <= few:
            order = Window.partitionBy(*keys, "__range").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
            ordered = rows.withColumn("__upto", F.sum("n").over(order)).withColumn("__before", F.col("__upto") - F.col("n"))
            last = keyed_join(ordered, state.select(*keys, "__range", "target", "rank"), [*keys, "__range"], small=True).where("rank >= __before and rank < __upto")
            done = done.unionByName(last.select(*keys, "target", F.col("x").alias("value")))
            break
    return cut_lineage(done)


def column_percentiles(df: DataFrame, columns: list[str], fractions: list[float], few: int = HOT_ROWS) -> DataFrame:
    """(column, values): the percentiles of whole numeric columns, linear between ranks; nulls and NaN are left out, and a column
    without numbers has no row.

    Three passes for all columns at once: ends, rows by BUCKETS equal parts of each column's range, and the rows of those parts that
    hold a wanted rank, which are ordered if there are few of them and else searched by `at_ranks`. Only counts of parts, bounded
    by BUCKETS a column, are read to the driver.
    """
    spark, schema = df.sparkSession, "column string, values array<double>"
    numbers = df.select(*(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(f"x{i}") for i, c in enumerate(columns)))
    facts = numbers.agg(*(f(f"x{i}") for i in range(len(columns)) for f in (F.count, F.min, F.max))).first()
    ends = {i: facts[3 * i : 3 * i + 3] for i in range(len(columns)) if facts[3 * i]}
    if not ends:
        return spark.createDataFrame([], schema)

    def part(i: int) -> Column:
        n, lo, hi = ends[i]
        width, x = hi / 2 - lo / 2, F.col(f"x{i}")  # halved, as the difference of two doubles may be too large for one
        return F.least(F.floor((x / 2 - lo / 2) / width * BUCKETS), F.lit(BUCKETS - 1)).cast("int") if width > 0 else (x > lo).cast("int")

    cells = F.explode(F.array(*(F.struct(F.lit(i).alias("v"), part(i).alias("part"), F.col(f"x{i}").alias("x")) for i in ends)))
    rows = numbers.select(cells.alias("c")).select("c.*").where("x is not null")
    parts: dict[int, list] = {}
    for r in rows.groupBy("v", "part").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect():
        parts.setdefault(r["v"], []).append((r["part"], r["n"], r["lo"], r["hi"]))
    values: dict[tuple[int, int], float] = {}
    targets, left = [], {}
    for i, (n, _, _) in ends.items():
        mine = sorted(parts[i])
        upto = list(accumulate(p[1] for p in mine))
        for k, q in enumerate(fractions):
            for high in (0, 1):
                rank = math.ceil(q * (n - 1)) if high else math.floor(q * (n - 1))
                at = bisect_right(upto, rank)
                name, size, lo, hi = mine[at]
                if lo == hi:
                    values[(i, 2 * k + high)] = lo
                else:
                    targets.append((i, name, 2 * k + high, rank - (upto[at] - size)))
                    left[(i, name)] = size
    if targets:
        kept = rows.join(F.broadcast(spark.createDataFrame(list(left), "v int, part int")), ["v", "part"], "left_semi").select("v", "part", "x", F.lit(1).alias("n"))
        wanted = spark.createDataFrame(targets, "v int, part int, target int, rank bigint")
        if sum(left.values()) <= few:
            place = (F.row_number().over(Window.partitionBy("v", "part").orderBy("x")) - 1).cast("bigint").alias("rank")
            found = kept.select("v", "part", F.col("x").alias("value"), place).join(F.broadcast(wanted), ["v", "part", "rank"])
        else:
            found = at_ranks(cut_lineage(kept), ["v", "part"], wanted, few)
        values |= {(r["v"], r["target"]): r["value"] for r in found.collect()}
    out = []
    for i, (n, _, _) in ends.items():
        shares = [q * (n - 1) - math.floor(q * (n - 1)) for q in fractions]
        out.append((columns[i], [values[(i, 2 * k)] * (1 - s) + values[(i, 2 * k + 1)] * s for k, s in enumerate(shares)]))
    return spark.createDataFrame(out, schema)
