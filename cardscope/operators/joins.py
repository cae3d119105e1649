"""Equi-joins in which null is a key value like any other, and in which hot keys never meet in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keyed_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", small: bool = False) -> DataFrame:
    """left joined null-safely with right on keys: left's columns, then right's others. small: right has a proven bound."""
    other = right.select(*(F.col(k).alias(f"__r_{k}") for k in keys), *(c for c in right.columns if c not in keys))
    if small:
        other = F.broadcast(other)
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    joined = left.join(other, on, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*(f"__r_{k}" for k in keys))


def attach(df: DataFrame, facts: DataFrame, keys: list[str], hot: DataFrame | None, how: str = "left") -> DataFrame:
    """df with the facts of its group (one row per group). hot: the keys of boundedly many large groups, whose facts are
    broadcast, so that none of them is shuffled into one task; the others are shuffled, their size being bounded."""
    if hot is None or hot.isEmpty():
        return keyed_join(df, facts, keys, how)
    hot = hot.select(*keys)
    few, many = (keyed_join(facts, hot, keys, h, small=True) for h in ("left_semi", "left_anti"))
    big, rest = (keyed_join(df, hot, keys, h, small=True) for h in ("left_semi", "left_anti"))
    return keyed_join(big, few, keys, how, small=True).unionByName(keyed_join(rest, many, keys, how))
