"""Measurements that cannot be believed: impossible values, spikes against the source's own behaviour, stuck values."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from cardscope.operators.exact_median import group_medians
from cardscope.operators.joins import keyed_join
from cardscope.operators.ranking import with_running
from cardscope.session import HOT_ROWS, MAX_HOT, cut_lineage, hot_keys

#: Fixed values of the runtime protocol: limit in median distances, shortest constant run.
SPIKE_LIMIT, RUN_LENGTH = 9.0, 6
SOURCE = ["query_id", "configuration"]
_TIMES = ["execution_time_ms", "wall_clock_duration_ms"]
_NORMAL = NormalDist()
#: Share of false alarms of the ESD limits, and rows of a piece of a source.
ALPHA, PIECE_ROWS = 0.001, 4096


def impossible() -> Column:
    """Whether a reading contradicts itself or physics; unknown values contradict nothing."""
    execution, wall, limit = F.col("execution_time_ms"), F.col("wall_clock_duration_ms"), F.col("timeout_seconds") * 1000
    bad = [F.isnan(x) | (x == float("inf")) | (x <= 0) for x in (execution, wall)]
    bad += [execution > wall, F.when(F.col("timeout"), wall < limit).otherwise(F.when(~F.col("timeout"), wall > limit))]
    out = F.lit(False)
    for b in bad:
        out = out | F.coalesce(b, F.lit(False))
    return out


def constant_runs(df: DataFrame, keys: list[str], order: list[str], value: str, length: int) -> DataFrame:
    """df, the rows of boundedly many large groups, with `in_run`: one of `length` or more successive rows of its group with
    exactly the same value; nulls are in no run.

    Groups are parted by range of their order and runs are made within a piece; only the first and last run of a piece can go on
    in another, so runs are put together from those alone, of which a group has at most two a piece.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = df.repartitionByRange(parts, *keys, *order).withColumn("__piece", F.spark_partition_id())
    pieces = cut_lineage(_runs(pieces, [*keys, "__piece"], order, value))
    runs = pieces.groupBy(*keys, "__piece", "__run").agg(F.first(value).alias("__value"), F.first("__size").alias("__size"))
    place = Window.partitionBy(*keys, "__piece")
    edges = runs.withColumns({"__first": F.min("__run").over(place), "__last": F.max("__run").over(place)})
    edges = edges.where((F.col("__run") == F.col("__first")) | (F.col("__run") == F.col("__last")))
    along = Window.partitionBy(*keys).orderBy("__piece", "__run")  # two rows a piece at most
    goes_on = F.col("__value").eqNullSafe(F.lag("__value").over(along)) & (F.lag("__piece").over(along) != F.col("__piece"))
    edges = edges.withColumn("__chain", F.sum(F.when(goes_on, 0).otherwise(1)).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    edges = edges.select(*keys, "__piece", "__run", F.sum("__size").over(Window.partitionBy(*keys, "__chain")).alias("__whole"))
    # groups and pieces are bounded, and so are edges
    found = keyed_join(pieces, edges, [*keys, "__piece", "__run"], "left", small=True)
    found = found.withColumn("in_run", (F.coalesce("__whole", "__size") >= length) & F.col(value).isNotNull())
    return found.drop("__piece", "__run", "__size", "__whole")


def _runs(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """df with the number of its run within its group, in order, and the rows of that run."""
    w = Window.partitionBy(*keys).orderBy(*order)
    new = F.when(F.col(value).eqNullSafe(F.lag(value).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    df = df.withColumn("__new", new).withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return df.withColumn("__size", F.count("*").over(Window.partitionBy(*keys, "__run"))).drop("__new")


# Seasonal-trend decomposition with generalised extreme studentised deviate limits


def _t_quantile(p: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Student quantile from the normal one by the Cornish-Fisher expansion; close for the upper tail and df >= 3."""
    z = np.array([_NORMAL.inv_cdf(min(float(v), 1 - 1e-16)) for v in p])
    g1, g2 = (z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96
    g3 = (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384
    return z + g1 / df + g2 / df**2 + g3 / df**3


@lru_cache(maxsize=4096)
def esd_limits(n: int, alpha: float, most: int) -> np.ndarray:
    """The critical values of the first `most` of n readings."""
    i = np.arange(1, most + 1)
    t = _t_quantile(1 - alpha / (2 * (n - i + 1)), np.maximum(n - i - 1, 1))
    return (n - i) * t / np.sqrt((n - i - 1 + t**2) * (n - i + 1))


def _median_distance(x: np.ndarray, a: int, b: int, m: float) -> float:
    """Median of |x - m| over the sorted x[a:b]: distances fall to the left of m and rise to the right, so the k + 1 nearest are
    a run of x, found by bisection."""

    def nearest(k: int) -> float:
        lo, hi = a, b - k - 1  # start of a run of k + 1 values
        while lo < hi:
            mid = (lo + hi) // 2
            if m - x[mid] > x[mid + k + 1] - m:
                lo = mid + 1
            else:
                hi = mid
        return max(m - x[lo], x[lo + k] - m)

    k = b - a
    return nearest(k // 2) if k % 2 else (nearest(k // 2 - 1) + nearest(k // 2)) / 2


def esd_outliers(residual: np.ndarray, alpha: float = 0.001, share: float = 0.5) -> np.ndarray:
    """Which residuals the generalised extreme studentised deviate test calls outliers, with median and scaled median distance
    in place of mean and deviation; at most a share of them, of which more than half have no meaning: a median distance cannot
    see them. Fewer than three readings have no outlier. What is removed is always an end of the sorted rest, so a step costs a
    bisection."""
    n, out = len(residual), np.zeros(len(residual), dtype=bool)
    most = min(int(n * share), n - 2)
    if most < 1:
        return out
    order = np.argsort(residual, kind="stable")
    x = residual[order].tolist()
    limits, a, b, passed = esd_limits(n, alpha, most), 0, n, (0, n)
    for k in range(most):
        m = (x[(a + b - 1) // 2] + x[(a + b) // 2]) / 2
        left = m - x[a] >= x[b - 1] - m
        away = m - x[a] if left else x[b - 1] - m
        scale = 1.4826 * _median_distance(x, a, b, m)
        a, b = (a + 1, b) if left else (a, b - 1)
        if away > 0 and away > limits[k] * scale:
            passed = (a, b)
    out[order[: passed[0]]] = out[order[passed[1] :]] = True
    return out


def _running_median(x: np.ndarray, half: int) -> np.ndarray:
    """Medians of 2 * half + 1 values; towards the ends of as many as are there, half + 1 at least."""
    n = len(x)
    if n <= half:
        return np.full(n, np.median(x))
    out = np.empty(n)
    for i in {*range(min(half, n)), *range(max(n - half, 0), n)}:
        out[i] = np.median(x[max(i - half, 0) : i + half + 1])
    if n > 2 * half:
        out[half : n - half] = np.median(np.lib.stride_tricks.sliding_window_view(x, 2 * half + 1), axis=1)
    return out


def decompose(x: np.ndarray, period: int = 0, window: int = 15, rounds: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(trend, season) of a series: running medians for the trend, medians by phase for the season, repeated."""
    season = np.zeros(len(x))
    trend, seasonal = season, period > 1 and len(x) >= 2 * period
    for _ in range(rounds if seasonal else 1):
        trend = _running_median(x - season, window // 2)
        if seasonal:
            padded = np.append(x - trend, np.full(-len(x) % period, np.nan)).reshape(-1, period)
            by = np.nanmedian(padded, axis=0)
            season = np.resize(by - np.median(by), len(x))
    return trend, season


def estimated_period(x: np.ndarray, trend: np.ndarray, longest: int = 366, least: float = 0.5) -> int:
    """The shortest lag whose autocorrelation, without trend and with clipped outliers, is near the best; 0 if none is strong.
    Three whole periods must be there, and 12 readings."""
    if len(x) < 12:
        return 0
    rest = x - trend
    rest = rest - np.median(rest)
    limit = 3 * 1.4826 * np.median(np.abs(rest))
    if limit <= 0:
        return 0
    rest = np.clip(rest, -limit, limit)
    rest = rest - rest.mean()
    power = np.abs(np.fft.rfft(rest, 2 * len(rest))) ** 2
    lags = np.arange(2, min(len(x) // 3, longest) + 1)
    match = np.fft.irfft(power)[lags] / (len(x) - lags) / np.mean(rest * rest)
    return int(lags[match >= 0.9 * match.max()][0]) if match.max() >= least else 0


def _pieces(size: int, piece_rows: int, beside: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(start, stop, which of these rows are its own) of successive pieces, each with rows of its neighbours on both sides."""
    for at in range(0, size, piece_rows):
        start, stop = max(at - beside, 0), min(at + piece_rows + beside, size)
        places = np.arange(start, stop)
        yield start, stop, (places >= at) & (places < at + piece_rows)


Columns = dict[str, np.ndarray]


def by_source(
    df: DataFrame, keys: list[str], order: list[str], id_col: str, values: list[str], judge: Callable[[Columns, np.ndarray], Columns], schema: str, hot: DataFrame,
    prepare: Callable[[Columns], Columns] | None = None, large: DataFrame | None = None, piece_rows: int = PIECE_ROWS, beside: int = 30,
) -> DataFrame:
    """judge(columns, own) of every piece of every source in its order, as (id, *schema, place) rows of the own ones.

    A source that is not hot is one run of sorted rows of a task, cut in pieces there; what holds for the whole source is made
    by prepare, as more columns. The rows of a hot source are ranked over the whole table, and a piece is sent to a task of its own
    with the neighbours it has to see; `large` holds these rows, with what prepare would have made. Pieces are the same either way.
    """
    facts = [] if large is None else [c for c in large.columns if c not in df.columns]
    cols = [*keys, id_col, *values, *facts]
    id_type = df.schema[id_col].dataType
    made = [c.split()[0] for c in schema.split(", ")]
    out_schema = f"`{id_col}` {id_type.simpleString()}, {schema}"
    ids = to_arrow_type(id_type)

    def one(rows: pa.Table, columns: Columns, start: int, stop: int, own: np.ndarray) -> pa.RecordBatch | None:
        found = judge({k: v[start:stop] for k, v in columns.items()}, own)
        at = np.flatnonzero(own) + start
        if "at" in found:
            at = at[found.pop("at")]
        if not len(at):
            return None
        chosen = rows.column(id_col).take(pa.array(at)).combine_chunks()
        chosen = chosen.cast(ids) if chosen.type != ids else chosen
        return pa.RecordBatch.from_arrays([chosen, *(pa.array(found[m]) for m in made)], [id_col, *made])

    def arrays(rows: pa.Table, names: list[str]) -> Columns:
        return {v: rows.column(v).to_numpy().astype(float) for v in names}

    def of_small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in whole_groups(batches, keys):
            columns = arrays(rows, values)
            found = []
            for a, b in zip(starts, [*starts[1:], rows.num_rows]):
                mine = {k: v[a:b] for k, v in columns.items()}
                mine |= prepare(mine) if prepare else {}
                some = rows.slice(a, b - a)
                found += [x for start, stop, own in _pieces(b - a, piece_rows, beside) if (x := one(some, mine, start, stop, own)) is not None]
            if found:
                yield from pa.Table.from_batches(found).combine_chunks().to_batches()

    def of_hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in whole_groups(batches, [*keys, "__piece"]):
            columns, own = arrays(rows, [*values, *facts]), np.asarray(rows.column("__own").combine_chunks())
            for a, b in zip(starts, [*starts[1:], rows.num_rows]):
                x = one(rows.slice(a, b - a), {k: v[a:b] for k, v in columns.items()}, 0, b - a, own[a:b])
                if x is not None:
                    yield x

    none = hot.isEmpty()
    small = df if none else keyed_join(df, hot, keys, "left_anti", small=True)
    small = small.select(*dict.fromkeys([*keys, id_col, *values, *order])).repartition(*keys).sortWithinPartitions(*keys, *order)
    out = small.select(*dict.fromkeys([*keys, id_col, *values])).mapInArrow(of_small, out_schema)
    if not none:
        large = keyed_join(df, hot, keys, "left_semi", small=True) if large is None else large
        big = large.select(*dict.fromkeys([*cols, *order]))
        ranked = with_running(big, keys, [F.col(c) for c in order], "__rank").withColumn("__at", F.col("__rank") - 1)
        near = [F.greatest(F.col("__at") + k * beside, F.lit(0)) for k in (-1, 0, 1)]
        pieces = ranked.withColumn("__piece", F.explode(F.array_distinct(F.array(*(F.floor(n / piece_rows) for n in near)))))
        pieces = pieces.select(*dict.fromkeys(cols), "__piece", (F.floor(F.col("__at") / piece_rows) == F.col("__piece")).alias("__own"), "__at")
        pieces = pieces.repartition(*keys, "__piece").sortWithinPartitions(*keys, "__piece", "__at")
        out = out.unionByName(pieces.mapInArrow(of_hot, out_schema))
    return out


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], flush: int = 20_000) -> Iterator[tuple[pa.Table, list[int]]]:
    """(rows, where each group starts) of successive runs of whole groups, from rows sorted by keys; null is a key. In memory are
    a bounded number of rows besides the largest group."""
    kept: list[pa.RecordBatch] = []
    size, wanted = 0, flush
    for batch in batches:
        kept.append(batch)
        size += batch.num_rows
        if size >= wanted:
            rows = pa.Table.from_batches(kept).combine_chunks()
            starts = _starts(rows, keys)
            if starts[-1]:
                yield rows.slice(0, starts[-1]), starts[:-1]
            rest = rows.slice(starts[-1])  # the last group may go on in the next batch
            kept, size = rest.to_batches(), rest.num_rows
            wanted = max(flush, 2 * size)
    if size:
        rows = pa.Table.from_batches(kept).combine_chunks()
        yield rows, _starts(rows, keys)


def _starts(rows: pa.Table, keys: list[str]) -> list[int]:
    new = np.zeros(max(rows.num_rows - 1, 0), dtype=bool)
    for k in keys:
        c = rows.column(k).combine_chunks()
        a, b = c.slice(1), c.slice(0, len(c) - 1)
        same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
        new |= ~np.asarray(same)
    return [0, *(np.flatnonzero(new) + 1).tolist()]


def deviates(x: np.ndarray, own: np.ndarray, period: int | None, window: int, alpha: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(trend, season, residual, outlier) of the own readings of a piece."""
    trend, season = decompose(x, period or 0, window)
    if period is None and (found := estimated_period(x, trend)):
        trend, season = decompose(x, found, window)
    rest = (x - trend - season)[own]
    return trend[own], season[own], rest, esd_outliers(rest, alpha)


def decomposed_outliers(
    df: DataFrame, keys: list[str], order: list[str], values: str | list[str], id_col: str, period: int | None = 0, window: int = 15, alpha: float = ALPHA, piece_rows: int = PIECE_ROWS,
    hot_rows: int = HOT_ROWS, max_hot: int = MAX_HOT,
) -> DataFrame:
    """(id, reading, trend, season, residual, outlier) of each value column by robust seasonal-trend decomposition per source and
    generalised ESD limits.

    A source is looked at in successive pieces of piece_rows rows by their place in its order, so a source with a third of
    all rows is many tasks whatever its values of order; a piece sees the 2 * window rows before and behind it for its
    trend and season. period: None estimates it from each piece, 0 has no season. Readings that are null or not finite are
    left out; null sorts first.
    """
    values = [values] if isinstance(values, str) else list(values)
    names = [f"__x{i}" for i in range(len(values))]
    bad = lambda c: F.isnan(c) | (F.abs(c) == float("inf"))
    numbers = [F.col(v).cast("double") for v in values]
    rows = df.select(*dict.fromkeys([id_col, *keys, *order]), *(F.when(~bad(c), c).alias(n) for c, n in zip(numbers, names)))
    rows = rows.where(F.coalesce(*names).isNotNull())

    def judge(columns: Columns, own: np.ndarray) -> Columns:
        parts, at = [], []
        places = np.cumsum(own) - 1
        for n, v in zip(names, values):
            there = ~np.isnan(columns[n])
            mine = own[there]
            if mine.any():
                at.append(places[there & own])
                parts.append(([v] * int(mine.sum()), *deviates(columns[n][there], mine, period, window, alpha)))
        out = {k: np.concatenate([p[i] for p in parts]) for i, k in enumerate(("reading", "trend", "season", "residual", "outlier"))} if parts else {"reading": np.zeros(0, str)}
        return out | {"at": np.concatenate(at) if at else np.zeros(0, dtype=np.int64)}

    schema = "reading string, trend double, season double, residual double, outlier boolean"
    hot = hot_keys(rows, keys, hot_rows, max_hot).select(*keys)
    return by_source(rows, keys, order, id_col, names, judge, schema, hot, piece_rows=piece_rows, beside=2 * window)


def _with_facts(rows: DataFrame, keys: list[str], order: list[str], hot: DataFrame, run_length: int, hot_rows: int, max_hot: int) -> DataFrame:
    """The rows of hot sources with the level and spread of their source and whether they are in a constant run."""
    rows = cut_lineage(rows)
    level = cut_lineage(group_medians(rows, keys, _TIMES, hot, hot_rows, max_hot))
    seen = keyed_join(rows, level, keys, "left", small=True)
    away = seen.select(*keys, *(F.abs(F.col(v) - F.col(f"{v}_median")).alias(v) for v in _TIMES))
    spread = group_medians(away, keys, _TIMES, hot, hot_rows, max_hot)
    seen = keyed_join(seen, spread.select(*keys, *(F.col(f"{v}_median").alias(f"{v}_spread") for v in _TIMES)), keys, "left", small=True)
    return constant_runs(seen, keys, order, _TIMES[0], run_length).withColumn("in_run", F.col("in_run").cast("double"))


def flag_implausible(
    df: DataFrame, spike_limit: float = SPIKE_LIMIT, run_length: int = RUN_LENGTH, piece_rows: int = PIECE_ROWS, hot_rows: int = HOT_ROWS, max_hot: int = MAX_HOT,
) -> DataFrame:
    """(measurement_id, kind) of every reading that cannot be believed; one kind a row, the first of impossible, spike, stuck.

    A source is (query_id, configuration), null being a value. Spikes and stuck values are looked for among rows with
    status `ok` that are no warm-up (a null warm-up is none) and not impossible. A spike is a reading that is farther from the
    median of the source than spike_limit median distances, as the runtime protocol lays down; that alone decides, so trend and
    season have no part in it (`decomposed_outliers` judges by them). A spread of 0 makes every other value a spike. Successive
    means by (repetition, measurement_id). Rows delivered twice (same measurement_id) count once, as do equal rows without one.
    """
    cols = ["measurement_id", *SOURCE, "repetition", "warmup", "status", "timeout", "timeout_seconds", *_TIMES]
    unnamed = F.when(F.col("measurement_id").isNull(), F.xxhash64(*cols))
    once = df.select(*cols, unnamed.alias("__unnamed")).dropDuplicates(["measurement_id", "__unnamed"]).drop("__unnamed")
    # several passes follow: the deduplicated, narrowed rows are written once
    rows = cut_lineage(once.withColumn("__impossible", impossible()))
    usable = rows.where((F.col("status") == "ok") & ~F.coalesce("warmup", F.lit(False)) & ~F.col("__impossible"))
    usable = usable.select("measurement_id", *SOURCE, "repetition", *_TIMES)
    hot = hot_keys(usable, SOURCE, hot_rows, max_hot).select(*SOURCE)
    order = ["repetition", "measurement_id"]

    def prepare(columns: Columns) -> Columns:
        out = {}
        for v in _TIMES:
            x = columns[v][~np.isnan(columns[v])]
            level = np.median(x) if len(x) else np.nan
            spread = np.median(np.abs(x - level)) if len(x) else np.nan
            out |= {f"{v}_median": np.full(len(columns[v]), level), f"{v}_spread": np.full(len(columns[v]), spread)}
        x = columns[_TIMES[0]]
        run = np.cumsum(np.concatenate([[True], x[1:] != x[:-1]])) - 1  # NaN, for null, is in no run
        return out | {"in_run": np.bincount(run)[run] >= run_length}

    def judge(columns: Columns, own: np.ndarray) -> Columns:
        spike = np.zeros(int(own.sum()), dtype=bool)
        for v in _TIMES:  # NaN, for null, is no spike
            spike |= np.abs(columns[v] - columns[f"{v}_median"])[own] > spike_limit * columns[f"{v}_spread"][own]
        found = np.flatnonzero(spike | (columns["in_run"][own] > 0))
        return {"kind": np.where(spike, "spike", "stuck")[found], "at": found}

    large = None if hot.isEmpty() else _with_facts(keyed_join(usable, hot, SOURCE, "left_semi", small=True), SOURCE, order, hot, run_length, hot_rows, max_hot)
    found = by_source(usable, SOURCE, order, "measurement_id", _TIMES, judge, "kind string", hot, prepare, large, piece_rows, beside=0)
    return rows.where("__impossible").select("measurement_id", F.lit("impossible").alias("kind")).unionByName(found)


__all__ = ["decomposed_outliers", "flag_implausible"]
