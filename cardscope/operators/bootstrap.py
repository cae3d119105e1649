"""Bootstrap confidence intervals of paired differences, resampled over blocks of rows in parallel tasks.

Equal pairs are one cell with a count, which loses nothing. Cells are kept in blocks of about BLOCK_ROWS by a hash of their
values, and nothing of the size of the data is broadcast or brought to the driver, so every size is exact. A resample draws
how often each group of units falls (multinomial), then within a group how often each unit falls; both from generators named
by seed, resample and group, so that every task that needs a weight draws the same. Means are sums over blocks. A median is
found by counting a resample's rows between edges, over and over inside the part that holds its rank until that is one value.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cardscope.operators.joins import attach, keyed_join
from cardscope.session import cut_lineage, hot_keys

#: Cells of a block and units of a group, about; resamples that are summed together; edges that cut a part; single values near the median.
BLOCK_ROWS, CHUNK, EDGES, NEAR = 65_536, 64, 250, 4000
#: Equal pairs up to this number are drawn one by one, more by a binomial.
FEW = 8


@dataclass(frozen=True)
class Mean:
    """back(mean of of(x))."""

    of: Callable[[np.ndarray], np.ndarray]
    back: Callable[[float], float]


@dataclass(frozen=True)
class Median:
    """Mean of the two middle values."""


Metric = Mean | Median
mean = Mean(lambda x: x, float)
geometric_mean = Mean(np.log, lambda m: float(np.exp(m)))
share_le2 = Mean(lambda x: (x <= 2.0).astype(float), float)
median = Median()

METRICS: dict[str, Metric] = {"median_q_error": median, "geometric_mean_q_error": geometric_mean, "fraction_q_error_le2": share_le2, "mean": mean}


def cells(pairs: DataFrame, left: str, right: str, clusters: str | None = None) -> DataFrame:
    """([cluster c,] l, r, n) of the finite pairs. A value that is not finite is an error."""
    keys = [F.col(left).cast("double").alias("l"), F.col(right).cast("double").alias("r")] + ([F.col(clusters).cast("string").alias("c")] if clusters else [])
    rows = pairs.select(*keys).where("l is not null and r is not null")
    bad = F.isnan("l") | F.isnan("r") | (F.abs("l") == float("inf")) | (F.abs("r") == float("inf"))
    rows = rows.withColumn("l", F.when(bad, F.raise_error(F.lit("bootstrap input is not finite")).cast("double")).otherwise(F.col("l")))
    return rows.groupBy(*(c for c in ("c", "l", "r") if c in rows.columns)).agg(F.count("*").alias("n"))


def _blocks(table: DataFrame, clusters: bool, block_rows: int) -> tuple[DataFrame, list[tuple[int, int, int]], int]:
    """(g, slice, i, l, r, n), the (g, units, chances) of each group, and the number of blocks. A unit is a cell, with as many
    chances as rows, or a cluster, with one; i is its place in its group. A large cluster is many slices of its group."""
    if not clusters:
        number = max(1, -(-table.count() // block_rows))
        out = table.select(F.pmod(F.xxhash64("l", "r"), F.lit(number)).cast("int").alias("g"), F.lit(0).alias("slice"), F.lit(0).alias("i"), "l", "r", "n")
        return out, [tuple(r) for r in out.groupBy("g").agg(F.count("*"), F.sum("n")).orderBy("g").collect()], number
    units = cut_lineage(table.groupBy("c").agg(F.count("*").alias("cells")))
    number = max(1, -(-units.count() // block_rows))
    place = (F.row_number().over(Window.partitionBy("g").orderBy("c")) - 1).alias("i")
    units = cut_lineage(units.withColumn("g", F.pmod(F.xxhash64("c"), F.lit(number)).cast("int")).select("c", "g", place, "cells"))
    groups = cut_lineage(units.groupBy("g").agg(F.count("*").alias("units"), F.ceil(F.sum("cells") / block_rows).cast("int").alias("slices")))
    known = groups.orderBy("g").collect()
    out = attach(table, units.select("c", "g", "i"), ["c"], hot_keys(table, ["c"]))
    out = keyed_join(out, groups.select("g", "slices"), ["g"], small=True)
    out = out.select("g", F.expr("pmod(hash(l, r, c), slices)").cast("int").alias("slice"), "i", "l", "r", "n")
    return out, [(r["g"], r["units"], r["units"]) for r in known], sum(r["slices"] for r in known)


class _Draws:
    """Weights of the units of one group in resample s; resample -1 is the data as it is."""

    def __init__(self, seed: int, groups: list[tuple[int, int, int]], g: int, chances: np.ndarray) -> None:
        self.seed, self.g, self.chances = seed, g, chances
        self.at = [x[0] for x in groups].index(g)
        self.total = sum(x[2] for x in groups)
        self.shares = np.array([x[2] for x in groups]) / self.total
        self.many = np.flatnonzero(chances > FEW)
        few = np.flatnonzero(chances <= FEW)
        self.few = np.repeat(few, chances[few])
        self.single = len(self.few) == len(chances)
        self.odds = np.append(chances[self.many], len(self.few)) / chances.sum()

    def __call__(self, s: int) -> np.ndarray:
        if s < 0:
            return self.chances
        drawn = np.random.default_rng([self.seed, s]).multinomial(self.total, self.shares)[self.at]
        rng = np.random.default_rng([self.seed, s, self.g, 1])
        of_many = rng.multinomial(drawn, self.odds) if len(self.many) else np.array([drawn])
        pick = rng.integers(0, len(self.few), of_many[-1]) if len(self.few) else np.zeros(0, dtype=np.int64)
        w = np.bincount(pick if self.single else self.few[pick], minlength=len(self.chances))
        w[self.many] = of_many[:-1]
        return w


def _bins(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """2 i + 1 for edge i itself, 2 i for what lies between edges i - 1 and i."""
    return np.searchsorted(edges, x, "left") + np.searchsorted(edges, x, "right")


class _Counter:
    """Weighted rows of one side by bin."""

    def __init__(self, x: np.ndarray, i: np.ndarray, n: np.ndarray, edges: np.ndarray) -> None:
        pairs = pd.DataFrame({"b": _bins(x, edges), "i": i, "n": n}).groupby(["b", "i"], sort=True)["n"].sum().reset_index()
        self.i, self.n = pairs["i"].to_numpy(), pairs["n"].to_numpy()
        self.single = bool((self.n == 1).all())
        self.bins, self.starts = np.unique(pairs["b"].to_numpy(), return_index=True)
        self.ends = np.append(self.starts, len(self.i))

    def __call__(self, w: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = np.searchsorted(self.bins, [low, high])
        if a == b:
            return self.bins[a:b], np.zeros(0, dtype=np.int64)
        p, q = self.ends[a], self.ends[b]
        rows = w[self.i[p:q]] if self.single else w[self.i[p:q]] * self.n[p:q]
        return self.bins[a:b], np.add.reduceat(rows, self.starts[a:b] - p)


def _cuts(blocks: DataFrame, parts: list[list[tuple[float, float]]]) -> list[np.ndarray]:
    """Values of both sides that cut their open parts (low, high), about equally."""
    spark = blocks.sparkSession
    shared = spark.sparkContext.broadcast([(np.array([a for a, _ in p]), np.array([b for _, b in p])) for p in parts])

    def inside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for side, name in enumerate("lr"):
                low, high = shared.value[side]
                if len(low):
                    x = pdf[name].to_numpy()
                    k = np.searchsorted(low, x, "left") - 1
                    hit = (k >= 0) & (x < high[np.maximum(k, 0)])
                    yield pd.DataFrame({"side": side, "part": k[hit], "x": x[hit]})

    rows = blocks.select("l", "r").mapInPandas(inside, "side int, part bigint, x double")
    steps = F.array(*(F.lit(k / EDGES) for k in range(EDGES + 1)))
    cut = rows.groupBy("side", "part").agg(F.percentile_approx("x", steps).alias("e")).select("side", F.explode("e").alias("x"))
    found = cut.distinct().collect()
    return [np.unique([r["x"] for r in found if r["side"] == side]) for side in (0, 1)]


Ranks = Callable[[int], list[int]]


@dataclass
class _Table:
    """The blocks of a table, and what a pass over them needs."""

    blocks: DataFrame
    groups: list[tuple[int, int, int]]
    number: int
    clusters: bool
    seed: int

    def sums(self, ids: np.ndarray, features: list[Mean], edges: list[np.ndarray], spans: np.ndarray, ranks: Ranks | list[np.ndarray]) -> list[tuple]:
        """(s, sums, bin and rest of the rank of every target) of the resamples ids. Sums are the rows, and of every feature
        left and right. spans: (id, side, target, 2), the bins that hold a target; ranks: of a target within its span, or
        from the number of rows."""
        spark, groups, clusters, seed = self.blocks.sparkSession, self.groups, self.clusters, self.seed
        of_rows, known = (ranks, None) if callable(ranks) else (None, ranks)
        shared = spark.sparkContext.broadcast((ids, edges, spans, known))
        chunks = -(-len(ids) // CHUNK)
        share = min(chunks, max(1, -(-3 * spark.sparkContext.defaultParallelism // self.number)))
        tasks = min(self.number * share, 4 * spark.sparkContext.defaultParallelism)

        def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            ids, edges, spans, _ = shared.value
            pdf = pdf.sort_values(["i", "l", "r"])
            l, r, n = (pdf[c].to_numpy() for c in "lrn")
            if clusters:
                units = next(x[1] for x in groups if x[0] == key[0])
                i, chances, rows = pdf["i"].to_numpy(), np.ones(units, dtype=np.int64), n
            else:
                i, chances, rows = np.arange(len(l)), n, np.ones(len(l), dtype=np.int64)
            draw = _Draws(seed, groups, key[0], chances)
            columns = [np.ones(len(l)), *(f.of(x) for f in features for x in (l, r))]
            facts = np.stack([np.bincount(i, weights=c * rows, minlength=len(chances)) for c in columns], axis=1)
            count = [_Counter(x, i, rows, e) for x, e in zip((l, r), edges)]
            out = []
            for c in range(key[2], chunks, share):
                here = range(c * CHUNK, min(len(ids), (c + 1) * CHUNK))
                weights, hits = np.empty((len(here), len(chances))), []
                for j, k in enumerate(here):
                    w = draw(int(ids[k]))
                    weights[j] = w
                    hits.append([{tuple(s): count[side](w, *s) for s in np.unique(spans[k, side], axis=0)} for side in (0, 1)])
                out.append((c, key[0], key[1], pickle.dumps((weights @ facts, hits))))
            return pd.DataFrame(out, columns=["chunk", "g", "slice", "found"])

        def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            ids, edges, spans, known = shared.value
            total, hits = None, []
            for found in pdf.sort_values(["g", "slice"])["found"]:  # a fixed order, so equal seeds give equal sums
                facts, hit = pickle.loads(found)
                total = facts if total is None else total + facts
                hits.append(hit)
            out = []
            for j, k in enumerate(range(key[0] * CHUNK, key[0] * CHUNK + len(total))):
                wanted = known[k] if known is not None else [of_rows(int(round(total[j, 0])))] * 2
                bins, rest = [], []
                for side in (0, 1):
                    for span, rank in zip(spans[k, side], wanted[side]):
                        a, b = span
                        rows = np.zeros(b - a, dtype=np.int64)
                        for hit in hits:
                            at, n = hit[j][side][tuple(span)]
                            rows[at - a] += n.astype(np.int64)
                        upto = np.cumsum(rows)
                        p = int(np.searchsorted(upto, rank, "right"))
                        bins.append(int(a + p))
                        rest.append(int(rank - (upto[p - 1] if p else 0)))
                out.append((int(ids[k]), total[j], bins, rest))
            return pd.DataFrame(out, columns=["s", "sums", "bins", "rest"])

        place = ["g", "slice", "share"]
        spread = self.blocks.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(share - 1)))).repartition(tasks, *place)
        found = spread.groupBy(*place).applyInPandas(run, "chunk int, g int, slice int, found binary")
        merged = found.groupBy("chunk").applyInPandas(merge, "s int, sums array<double>, bins array<bigint>, rest array<bigint>")
        return sorted((r["s"], r["sums"], r["bins"], r["rest"]) for r in merged.collect())

    def search(self, ids: np.ndarray, features: list[Mean], ranks: Ranks, edges: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(id, sums) and (id, side, target): the values at the wanted ranks of each resample, exactly. edges: at the start."""
        targets = len(ranks(1))
        values = np.full((len(ids), 2, targets), np.nan)
        todo, sums = np.arange(len(ids)), None
        spans = np.empty((len(ids), 2, targets, 2), dtype=np.int64)
        for side in (0, 1):
            spans[:, side] = (0, 2 * len(edges[side]) + 1)
        wanted: Ranks | list[np.ndarray] = ranks
        while len(todo):
            got = self.sums(ids[todo], features if sums is None else [], edges, spans, wanted)
            sums = np.array([g[1] for g in got]) if sums is None else sums
            if not targets:
                break
            bins, rest = (np.array([g[k] for g in got]).reshape(len(todo), 2, targets) for k in (2, 3))
            parts = []
            for side in (0, 1):
                single = (bins[:, side] % 2 == 1) & np.isnan(values[todo, side])
                a, b = np.nonzero(single)
                values[todo[a], side, b] = edges[side][bins[a, side, b] // 2]
                left = np.unique(bins[:, side][np.isnan(values[todo, side])])
                ends = np.concatenate([[-np.inf], edges[side], [np.inf]])
                parts.append([(float(ends[b // 2]), float(ends[b // 2 + 1])) for b in left])
            keep = np.isnan(values[todo]).any(axis=(1, 2))
            bins, rest, todo = bins[keep], rest[keep], todo[keep]
            if not len(todo):
                break
            finer = _cuts(self.blocks, parts)
            spans = np.zeros((len(todo), 2, targets, 2), dtype=np.int64)
            wanted = [rest[k] for k in range(len(todo))]
            for side in (0, 1):
                ends = np.concatenate([[-np.inf], edges[side], [np.inf]])
                # the ends of parts are edges as well, so a bin never reaches over two parts
                every = np.unique(np.concatenate([finer[side], [x for p in parts[side] for x in p if np.isfinite(x)]]))
                open_ = np.isnan(values[todo, side])
                low, high = ends[bins[:, side] // 2], ends[np.minimum(bins[:, side] // 2 + 1, len(ends) - 1)]
                start = np.where(np.isfinite(low), 2 * np.searchsorted(every, low) + 2, 0)
                end = np.where(np.isfinite(high), 2 * np.searchsorted(every, high) + 1, 2 * len(every) + 1)
                spans[:, side, :, 0], spans[:, side, :, 1] = np.where(open_, start, 0), np.where(open_, end, 0)
                edges = [every if k == side else e for k, e in enumerate(edges)]
        return sums, values

    def near(self, units: int) -> list[np.ndarray]:
        """Edges to start with: values that cut the table, and single values where medians of resamples are likely."""
        coarse = _cuts(self.blocks, [[(-np.inf, np.inf)]] * 2)
        off = min(0.5, 3 / np.sqrt(units))
        _, ends = self.search(np.array([-1]), [], lambda n: [int((0.5 - off) * (n - 1)), int((0.5 + off) * (n - 1))], coarse)
        out = []
        for side, name in enumerate("lr"):
            some = self.blocks.select(name).where(F.col(name).between(float(ends[0, side, 0]), float(ends[0, side, 1]))).distinct()
            got = [r[0] for r in some.limit(NEAR + 1).collect()]
            out.append(np.unique(np.concatenate([coarse[side], got if len(got) <= NEAR else []])))
        return out


def observed_deltas(spark, pairs: DataFrame, left: str, right: str, metrics: dict[str, Metric] | None = None, clusters: str | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(metric, sample_count, cluster_count, observed_delta): the differences themselves, without resampling."""
    metrics = metrics or {k: METRICS[k] for k in ("median_q_error", "geometric_mean_q_error", "fraction_q_error_le2")}
    rows, units, found = _resampled(pairs, left, right, metrics, clusters, 0, 0, block_rows)
    out = [(m, rows, units if clusters else None, float(found[m][0]) if rows else None) for m in metrics]
    return spark.createDataFrame(out, "metric string, sample_count bigint, cluster_count bigint, observed_delta double")


def _resampled(pairs: DataFrame, left: str, right: str, metrics: dict[str, Metric], clusters: str | None, samples: int, seed: int, block_rows: int) -> tuple[int, int, dict[str, np.ndarray]]:
    """Rows, units, and of each metric its differences: of the data as they are, then of every resample."""
    table = cut_lineage(cells(pairs, left, right, clusters))
    if table.isEmpty():
        return 0, 0, {}
    blocks, groups, number = _blocks(table, clusters is not None, block_rows)
    data = _Table(cut_lineage(blocks), groups, number, clusters is not None, seed)
    features = [m for m in metrics.values() if isinstance(m, Mean)]
    middle = any(isinstance(m, Median) for m in metrics.values())
    units = sum(g[2] for g in groups)
    ranks = (lambda n: [(n - 1) // 2, n // 2]) if middle else (lambda n: [])
    edges = [np.zeros(0)] * 2 if not middle else data.near(units) if samples else _cuts(data.blocks, [[(-np.inf, np.inf)]] * 2)
    sums, values = data.search(np.arange(-1, samples), features, ranks, edges)
    out, column = {}, 1
    for name, m in metrics.items():
        if isinstance(m, Mean):
            both = [np.array([m.back(x) for x in sums[:, column + side] / sums[:, 0]]) for side in (0, 1)]
            column += 2
        else:
            both = [values[:, side].mean(axis=1) for side in (0, 1)]
        out[name] = both[0] - both[1]
        if not np.isfinite(out[name]).all():
            raise ValueError(f"{name} has a difference that is not finite")
    return int(sums[0, 0]), units, out


def paired_bootstrap(spark, pairs: DataFrame, left: str, right: str, metrics: dict[str, Metric] | None = None, clusters: str | None = None, samples: int = 10_000, seed: int = 42, confidence: float = 0.95, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(metric, sample_count, cluster_count, bootstrap_samples, observed_delta, ci_low, ci_high): the difference left - right
    of each metric with its percentile interval. Rows are resampled with replacement, or whole clusters where given; null is
    a cluster. Without pairs the difference and its interval are null. Equal seeds and block_rows give equal results, however
    the work is parted."""
    if samples <= 0 or not 0 < confidence < 1:
        raise ValueError("samples must be positive and confidence between 0 and 1")
    metrics = metrics or {k: METRICS[k] for k in ("median_q_error", "geometric_mean_q_error", "fraction_q_error_le2")}
    schema = "metric string, sample_count bigint, cluster_count bigint, bootstrap_samples int, random_seed bigint, observed_delta double, ci_low double, ci_high double, confidence double"
    rows, units, found = _resampled(pairs, left, right, metrics, clusters, samples, seed, block_rows)
    out, alpha = [], (1 - confidence) / 2
    for name in metrics:
        deltas = found.get(name)
        low, high = np.quantile(deltas[1:], [alpha, 1 - alpha]) if rows else (None, None)
        out.append((name, rows, units if clusters else None, samples, seed, *(None if x is None else float(x) for x in (deltas[0] if rows else None, low, high)), confidence))
    return spark.createDataFrame(out, schema)
