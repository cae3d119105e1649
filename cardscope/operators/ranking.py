"""Ranks and running totals over whole tables, without a window that puts a table into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cardscope.operators.joins import keyed_join
from cardscope.session import cut_lineage


def with_running(df: DataFrame, keys: list[str], order: list[Column], rank: str = "rank", totals: dict[str, str] | None = None, count: str | None = None) -> DataFrame:
    """df with its 1-based rank in `order` within each group of keys, running totals {result: column} and the group's count.

    Rows are parted by range of (keys, order); ranks and totals are made within a part and shifted by those of the group's
    earlier parts, of which there are as many as shuffle partitions. So one group may be all of the table. Ties are ordered
    arbitrarily but consistently unless order decides them; nulls sort first. A null counts 0 in a total.
    """
    totals = totals or {}
    orders = {f"__o{i}": c for i, c in enumerate(order)}
    by = [F.col(k).asc_nulls_first() for k in keys]
    named = df.withColumns({k: c for k, c in orders.items()} | {f"__v_{t}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for t, c in totals.items()})
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut_lineage(named.repartitionByRange(parts, *by, *(F.col(o).asc_nulls_first() for o in orders)).withColumn("__part", F.spark_partition_id()))
    here = Window.partitionBy(*keys, "__part").orderBy(*(F.col(o).asc_nulls_first() for o in orders)).rowsBetween(Window.unboundedPreceding, 0)
    sums = placed.groupBy(*keys, "__part").agg(F.count("*").alias("__n"), *(F.sum(f"__v_{t}").alias(f"__s_{t}") for t in totals))
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    # only a group that reaches over several parts is shifted, and those are no more than parts, so their sums are broadcast
    shift = sums.withColumn("__parts", F.count("*").over(whole)).where("__parts > 1").select(
        *keys, "__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"), F.sum("__n").over(whole).alias("__whole"),
        *(F.coalesce(F.sum(f"__s_{t}").over(earlier), F.lit(0.0)).alias(f"__b_{t}") for t in totals),
    )
    out = placed.withColumns({"__r": F.row_number().over(here)} | {f"__t_{t}": F.sum(f"__v_{t}").over(here) for t in totals})
    if count:
        out = out.withColumn("__here", F.count("*").over(Window.partitionBy(*keys, "__part")))
    out = keyed_join(out, shift, [*keys, "__part"], "left", small=True)
    out = out.withColumns({rank: F.col("__r") + F.coalesce("__before", F.lit(0))} | {t: F.col(f"__t_{t}") + F.coalesce(f"__b_{t}", F.lit(0.0)) for t in totals})
    if count:
        out = out.withColumn(count, F.coalesce("__whole", "__here")).drop("__here")
    return out.drop("__part", "__r", "__before", "__whole", *orders, *(f"__{p}_{t}" for p in "vtb" for t in totals))


def ecdf(df: DataFrame, keys: list[str], value: str, to: str = "cumulative_fraction") -> DataFrame:
    """df with i / n for the i-th smallest value of its group: ties take successive steps. Nulls are left out."""
    ranked = with_running(df.where(F.col(value).isNotNull()), keys, [F.col(value)], "__rank", count="__count")
    return ranked.withColumn(to, F.col("__rank") / F.col("__count")).drop("__rank", "__count")


def histogram(df: DataFrame, value: str, bins: int | None = None) -> DataFrame:
    """(bin, low, high, rows): equal-width bins between the smallest and largest value, the last one closed.

    Without bins there are min(30, max(5, n // 3)). Equal values are put in the middle of a range of 1. Nulls are left out.
    """
    x = df.select(F.col(value).cast("double").alias("x")).where("x is not null")
    facts = x.agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).where("n > 0")
    number = F.lit(bins) if bins else F.least(F.lit(30), F.greatest(F.lit(5), F.floor(F.col("n") / 3))).cast("int")
    flat = F.col("lo") == F.col("hi")
    facts = facts.select(number.alias("k"), F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / F.col("k")
    placed = x.join(F.broadcast(facts)).withColumn("bin", F.least(F.floor((F.col("x") - F.col("lo")) / width), F.col("k") - 1).cast("int"))
    counted = placed.groupBy("bin").agg(F.count("*").alias("rows"))
    every = facts.select("*", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("bin"))
    low = F.col("lo") + F.col("bin") * width
    return every.join(counted, "bin", "left").select("bin", low.alias("low"), (low + width).alias("high"), F.coalesce("rows", F.lit(0)).cast("bigint").alias("rows"))
