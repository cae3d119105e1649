"""Percentiles of very large numeric columns from quantile digests over a dyadic tree.

Values are quantised to a bounded, ordered universe of 2**BITS leaves, evenly spaced in the logarithm. A digest holds counts
at nodes of the binary tree over the leaves (node 1 is the root, the children of v are 2v and 2v + 1, leaf k is 2**BITS + k).
Compression with parameter k moves the counts of two siblings to their parent while the family holds at most n / k; a node's
count is then off its place by at most its own range, and any rank is off by at most BITS * n / k. Digests of parts merge by
adding counts node by node, which adds the parts' errors and so keeps that bound for the sum. The bound is deterministic; it
depends neither on the order of the data nor on how they were parted.

Counts are combined map-side before anything is shuffled, a group of any size thus being at most 2**BITS rows a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Leaves of the universe: 2**BITS. They cover the values from 1 to 2**OCTAVES, and so every finite double of at least 1.
BITS, OCTAVES = 20, 1024
#: Deterministic bound of the rank error as a share of the rows of a group.
RANK_ERROR = 0.001
#: Relative error of a value by quantisation: leaves are 2**-(BITS - 10) octaves apart.
VALUE_ERROR = 2.0 ** (OCTAVES / 2**BITS) - 1
_FLUSH_ROWS = 200_000


def leaf_of(x: Column) -> Column:
    """The leaf of a value of at least 1."""
    return F.least(F.floor(F.ln(x) / math.log(2.0) * (2**BITS / OCTAVES) + 1e-9), F.lit(2**BITS - 1)).cast("int")


def value_of(leaf: Column) -> Column:
    """The smallest value of a leaf."""
    return F.pow(F.lit(2.0), leaf.cast("double") * (OCTAVES / 2**BITS))


def compressed(group: np.ndarray, node: np.ndarray, count: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The compressed digests of many groups at once. group: a number by row; equal (group, node) pairs are added first."""
    order = np.lexsort((node, group))
    group, node, count = group[order], node[order], count[order]
    if not len(group):
        return group, node, count
    first = np.concatenate([[True], (group[1:] != group[:-1]) | (node[1:] != node[:-1])])
    count = np.add.reduceat(count, np.flatnonzero(first))
    group, node = group[first], node[first]
    limit = np.bincount(group, count) // k
    kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    level = np.floor(np.log2(node)).astype(np.int64)
    work = (group[:0], node[:0], count[:0])
    for depth in range(int(level.max()), 0, -1):
        at = level == depth
        g, v, c = (np.concatenate([a, b[at]]) for a, b in zip(work, (group, node, count)))
        g, v, c = _added(g, v, c)
        # a family is two siblings and what their parent already holds
        parent = v >> 1
        here = level == depth - 1
        held = _lookup(g, parent, group[here], node[here], count[here])
        family = _family_sums(g, parent, c) + held
        up = family <= limit[g]
        kept.append((g[~up], v[~up], c[~up]))
        work = (g[up], parent[up], c[up])
    roots = level == 0
    kept.append(_added(*(np.concatenate([a, b[roots]]) for a, b in zip(work, (group, node, count)))))
    return tuple(np.concatenate(x) for x in zip(*kept))  # type: ignore[return-value]


def _added(g: np.ndarray, v: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not len(g):
        return g, v, c
    order = np.lexsort((v, g))
    g, v, c = g[order], v[order], c[order]
    first = np.concatenate([[True], (g[1:] != g[:-1]) | (v[1:] != v[:-1])])
    return g[first], v[first], np.add.reduceat(c, np.flatnonzero(first))


def _family_sums(g: np.ndarray, parent: np.ndarray, c: np.ndarray) -> np.ndarray:
    if not len(g):
        return c
    first = np.concatenate([[True], (g[1:] != g[:-1]) | (parent[1:] != parent[:-1])])
    return np.add.reduceat(c, np.flatnonzero(first))[np.cumsum(first) - 1]


def _lookup(g: np.ndarray, v: np.ndarray, group: np.ndarray, node: np.ndarray, count: np.ndarray) -> np.ndarray:
    if not len(group) or not len(g):
        return np.zeros(len(g), dtype=np.int64)
    wide = 2 ** (BITS + 1)
    keys = group * wide + node  # both sorted by group and node
    at = np.minimum(np.searchsorted(keys, g * wide + v), len(keys) - 1)
    return np.where(keys[at] == g * wide + v, count[at], 0)


def _whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray, pd.DataFrame]]:
    """(names of the groups, number of its group by row, rows) of successive runs of whole groups, from rows sorted by keys.
    In memory are a bounded number of rows besides the largest group."""
    kept: list[pd.DataFrame] = []
    size = 0

    def out(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, pd.DataFrame]:
        group = pdf.groupby(keys, dropna=False, sort=False).ngroup().to_numpy()
        return pdf[keys].iloc[np.unique(group, return_index=True)[1]].reset_index(drop=True), group, pdf

    for pdf in batches:
        kept.append(pdf)
        size += len(pdf)
        if size >= _FLUSH_ROWS:
            rows = pd.concat(kept, ignore_index=True)
            last = rows[keys].iloc[-1]
            same = np.logical_and.reduce([(rows[c] == last[c]) | (rows[c].isna() & pd.isna(last[c])) for c in keys])
            cut = int(np.flatnonzero(~same)[-1]) + 1 if (~same).any() else 0  # the last group may go on in the next batch
            if cut:
                yield out(rows.iloc[:cut])
            kept, size = [rows.iloc[cut:]], len(rows) - cut
    if size:
        yield out(pd.concat(kept, ignore_index=True))


def _error_k(rank_error: float) -> int:
    if not 0 < rank_error < 1:
        raise ValueError("rank_error lies between 0 and 1")
    return math.ceil(BITS / rank_error)


def _compress(counts: DataFrame, keys: list[str], k: int) -> DataFrame:
    schema = ", ".join(f"`{c}` {counts.schema[c].dataType.simpleString()}" for c in keys) + ", node int, n bigint"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for names, group, rows in _whole_groups(batches, keys):
            g, v, c = compressed(group, rows["node"].to_numpy(np.int64), rows["n"].to_numpy(np.int64), k)
            yield names.iloc[g].reset_index(drop=True).assign(node=v.astype(np.int32), n=c)

    return counts.select(*keys, "node", "n").repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, schema)


def digests(df: DataFrame, keys: list[str], values: list[str], rank_error: float = RANK_ERROR) -> DataFrame:
    """(keys, metric, node, n): one compressed digest for each group of keys and each value column.

    Nulls in a key form a group. Values that are null, NaN, infinite or below 1 are not counted. A digest has at most
    3 * BITS / rank_error nodes, whatever it summarises.
    """
    # the columns are unpivoted after counting, so a row is shuffled once per distinct combination, not once per column
    leaves = [F.when(~F.isnan(v) & (F.col(v) >= 1) & (F.col(v) < float("inf")), leaf_of(F.col(v)) + 2**BITS).alias(v) for v in values]
    pairs = F.explode(F.array(*(F.struct(F.lit(v).alias("metric"), F.col(v).alias("node")) for v in values)))
    counts = df.select(*keys, *leaves).select(*keys, pairs.alias("p")).select(*keys, "p.metric", "p.node").where("node is not null")
    counts = counts.groupBy(*keys, "metric", "node").agg(F.count("*").alias("n"))
    return _compress(counts, [*keys, "metric"], _error_k(rank_error))


def merged(parts: DataFrame, keys: list[str], rank_error: float = RANK_ERROR) -> DataFrame:
    """Digests by fewer keys, from digests of parts: counts of equal nodes are added, then compressed again."""
    counts = parts.groupBy(*keys, "metric", "node").agg(F.sum("n").alias("n"))
    return _compress(counts, [*keys, "metric"], _error_k(rank_error))


def percentiles(parts: DataFrame, keys: list[str], fractions: dict[str, float], rank_error: float = RANK_ERROR) -> DataFrame:
    """(keys, metric, n, one column per fraction, rank_error, value_error) from digests.

    A percentile of fraction q is the smallest value whose rank is at least q * n. The value given lies, in rank, within
    rank_error * n of it (the bound of all compressions), and below it by at most the relative value_error.
    """
    named = [*keys, "metric"]
    schema = ", ".join(f"`{c}` {parts.schema[c].dataType.simpleString()}" for c in named) + ", n bigint" + "".join(f", `{f}` int" for f in fractions)
    wanted = list(fractions.values())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for names, group, rows in _whole_groups(batches, named):
            node, n = rows["node"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)
            shift = BITS - np.floor(np.log2(node)).astype(np.int64)
            last = ((node + 1) << shift) - 1 - 2**BITS
            order = np.lexsort((shift, last, group))  # by the end of a node's range; of equal ends the narrower first
            upto = np.cumsum(n[order])
            totals = np.bincount(group, n).astype(np.int64)
            base = np.concatenate([[0], np.cumsum(totals)[:-1]])
            out = names.assign(n=totals)
            for name, q in zip(fractions, wanted):
                rank = base + np.maximum(np.ceil(q * totals - 1e-9).astype(np.int64), 1)
                out[name] = last[order][np.searchsorted(upto, rank)].astype(np.int32)
            yield out

    placed = merged(parts, keys, rank_error).sortWithinPartitions(*named)
    found = placed.mapInPandas(run, schema)
    return found.select(*named, "n", *(value_of(F.col(f)).alias(f) for f in fractions), F.lit(rank_error).alias("rank_error"), F.lit(VALUE_ERROR).alias("value_error"))
