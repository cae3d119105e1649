import datetime
import random
import statistics

import numpy as np

from cardscope.operators.exact_median import group_percentiles
from cardscope.operators.implausible import decompose, decomposed_outliers, esd_outliers, flag_implausible

SCHEMA = "measurement_id bigint, query_id string, configuration string, repetition int, warmup boolean, wall_clock_duration_ms double, execution_time_ms double, timeout boolean, timeout_seconds double, status string, recorded_at timestamp, kind string"


def row(i, x, wall=None, q="a", c="n", rep=None, warmup=False, timeout=False, limit=60.0, status="ok"):
    return (i, q, c, rep if rep is not None else i, warmup, x + 1 if wall is None and x is not None else wall, x, timeout, limit, status, datetime.datetime(2024, 1, 1), "clash")


def brute(rows):
    out, sources = set(), {}
    for i, q, c, rep, warm, wall, x, to, limit, status, *_ in {r[0]: r for r in rows}.values():
        bad = any(v is not None and (not np.isfinite(v) or v <= 0) for v in (x, wall)) or (None not in (x, wall) and x > wall)
        if to is not None and wall is not None and limit is not None:
            bad = bad or (wall < limit * 1000 if to else wall > limit * 1000)
        if bad:
            out.add((i, "impossible"))
        elif status == "ok" and not warm:
            sources.setdefault((q, c), []).append((-1 if rep is None else rep, i, x, wall))
    for group in sources.values():
        group.sort()
        spikes = set()
        for k in (2, 3):
            xs = [g[k] for g in group if g[k] is not None]
            if xs:
                m = statistics.median(xs)
                spread = statistics.median(abs(x - m) for x in xs)
                spikes |= {g[1] for g in group if g[k] is not None and abs(g[k] - m) > 9 * spread}
        out |= {(i, "spike") for i in spikes}
        at = 0
        while at < len(group):
            end = at
            while end < len(group) and group[end][2] == group[at][2] and group[at][2] is not None:
                end += 1
            if end - at >= 6:
                out |= {(g[1], "stuck") for g in group[at:end] if g[1] not in spikes}
            at = max(end, at + 1)
    return out


def made(seed, n=600):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x = rng.choice([round(rng.gauss(100, 5), 1), 100.0, 100.0, 1e4, None, 100.0, 100.0, 100.0])
        rows.append(row(i, x, q=rng.choice(["a", "a", "a", "b", None]), rep=rng.choice([i, i, i // 2, None]), warmup=rng.choice([False] * 8 + [True, None]), status=rng.choice(["ok"] * 6 + ["error", None])))
    return rows


def flags(spark, rows, **options):
    return sorted(map(tuple, flag_implausible(spark.createDataFrame(rows, SCHEMA), **options).collect()))


def test_kinds_agree_with_a_plain_reading_whether_hot_or_not(spark):
    rows = made(3)
    want = sorted(brute(rows))
    assert {k for _, k in want} == {"spike", "stuck"}
    assert flags(spark, rows) == want
    assert flags(spark, rows, hot_rows=60) == want


def test_impossible_readings(spark):
    inf, nan = float("inf"), float("nan")
    rows = [row(1, 0.0), row(2, -1.0), row(3, nan), row(4, inf, inf), row(5, 9.0, 8.0), row(6, None, None, timeout=True), row(7, 5.0, 59_000.0, timeout=True), row(8, 5.0, 61_000.0), row(9, 5.0, 60_000.0), row(10, 5.0, 60_000.0, timeout=True), row(11, 5.0, None), row(12, 5.0, 61_000.0, timeout=None), row(13, 5.0, 6e4 + 1, limit=None), row(14, 1.0, 0.0, status="error")]
    assert [i for i, k in flags(spark, rows) if k == "impossible"] == [1, 2, 3, 4, 5, 7, 8, 14]


def test_repeats_runs_and_empty_table(spark):
    rows = [row(i, 7.0) for i in range(6)] * 2 + [row(i, 7.0, q="b") for i in range(10, 15)]
    assert flags(spark, rows) == [(i, "stuck") for i in range(6)]
    assert flags(spark, []) == []
    unnamed = [(None, *row(i, 5.0 + i % 2)[1:]) for i in range(9)] + [(None, *row(9, 900.0)[1:])]
    assert flags(spark, unnamed) == [(None, "spike")]


def test_percentiles_of_hot_groups_are_exact(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["x", "x", "y", None]), rng.choice([rng.gauss(0, 1), 1.0, 1e300, -1e-300, 5e-324, 1e-323, None])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "k string, v double")
    wanted = [("a", "v", 0.5), ("b", "v", 0.9), ("c", "v", 0.0)]
    for hot in (10**6, 100):
        got = {r["k"]: (r["a"], r["b"], r["c"]) for r in group_percentiles(df, ["k"], wanted, hot_rows=hot).collect()}
        for k in ("x", "y", None):
            xs = np.array(sorted(v for kk, v in rows if kk == k and v is not None))
            assert np.allclose(got[k], [np.quantile(xs, q) for q in (0.5, 0.9, 0.0)], rtol=1e-12)


def test_runs_cross_any_number_of_pieces(spark):
    rng = random.Random(8)
    xs = [rng.choice([1.0, 2.0, None]) for _ in range(100)] + [5.0] * 900 + [rng.choice([5.0, 6.0]) for _ in range(1000)]
    rows = [row(i, x, wall=9.0) for i, x in enumerate(xs)]
    want = {i for i, k in brute(rows) if k == "stuck"}
    assert len(want) > 900
    assert {i for i, k in flags(spark, rows, hot_rows=100) if k == "stuck"} == want


def test_extreme_deviates_agree_with_a_plain_reading():
    from cardscope.operators.implausible import esd_limits

    def plain(x, alpha=0.001, share=0.5):
        left, order, passed, most = list(range(len(x))), [], 0, min(int(len(x) * share), len(x) - 2)
        for k in range(most):
            m = np.median(x[left])
            away = np.abs(x[left] - m)
            scale, worst = 1.4826 * np.median(away), away.max()
            order.append(left.pop(int(np.argmax(away))))
            passed = k + 1 if worst > 0 and worst > esd_limits(len(x), alpha, most)[k] * scale else passed
        return set(order[:passed])

    rng = np.random.default_rng(3)
    for n in (3, 4, 7, 50, 101):
        for far in (0, n // 3):
            x = rng.normal(0, 1, n)
            x[:far] += rng.choice([-40, 60], far)
            assert set(np.flatnonzero(esd_outliers(x))) == plain(x), (n, far)
    x = rng.normal(0, 1, 100)
    x[:30] += 50
    assert set(range(30)) <= set(np.flatnonzero(esd_outliers(x)))  # 30 of 100 planted, all found
    assert not esd_outliers(np.array([1.0, 9.0])).any() and not esd_outliers(np.zeros(0)).any() and list(esd_outliers(np.array([1.0, 1.0, 1.0, 9.0]))) == [False] * 3 + [True]


def test_decomposition_finds_spikes_on_a_trend_and_a_season(spark):
    rng = np.random.default_rng(1)
    x = np.arange(200) * 0.5 + 10 * (np.arange(200) % 4) + rng.normal(0, 1, 200)
    x[[30, 120]] += [60, -50]
    trend, season = decompose(x, period=4)
    assert set(np.flatnonzero(esd_outliers(x - trend - season))) >= {30, 120}
    assert esd_outliers(x - trend - season).sum() <= 6
    rows = [row(i, float(v), q=None) for i, v in enumerate(x)] + [row(999, None)]
    got = decomposed_outliers(spark.createDataFrame(rows, SCHEMA), ["query_id"], ["repetition"], "execution_time_ms", "measurement_id", period=4).where("outlier").collect()
    assert {30, 120} <= {r["measurement_id"] for r in got} and len(got) <= 6


def test_decomposition_finds_season_wall_clock_and_pieces_by_rank(spark, monkeypatch):
    from cardscope.plans import data_queries

    schema = "measurement_id int, query_id string, configuration string, repetition int, warmup boolean, status string, timeout boolean, timeout_seconds double, execution_time_ms double, wall_clock_duration_ms double"
    season = lambda i: 100.0 + 20 * (i % 6) + (i * 7 % 5) / 10
    rows = [(i, "q", "c", None if i % 2 else 1, False, "ok", False, 300.0, season(i // 2), season(i // 2) + (500 if i == 101 else 10)) for i in range(600)]
    monkeypatch.setattr(data_queries, "table", lambda *_: spark.createDataFrame(rows, schema))
    got = data_queries.p5_decomposed(spark, "").collect()
    assert len(got) == 1200 and {r["season"] for r in got} != {0.0}
    assert (101, "wall_clock_duration_ms") in {(r["measurement_id"], r["reading"]) for r in got if r["outlier"]}
    # one value of repetition only: pieces are cut by rank all the same
    df = spark.createDataFrame([(i, "q", 1, float(i)) for i in range(1000)], "id int, k string, repetition int, x double")
    many = decomposed_outliers(df, ["k"], ["repetition", "id"], "x", "id", piece_rows=100)
    assert many.count() == 1000 and many.select("id").distinct().count() == 1000
    inner = [r for r in many.collect() if 20 < r["id"] < 980]
    assert all(r["residual"] == 0 for r in inner)  # neighbours across the cuts are seen, so a straight line has no residual


def test_spikes_are_decided_by_the_limit_of_the_protocol_alone(spark):
    xs = [100.0 + i % 5 for i in range(60)] + [108.0, 95.0, 150.0]
    rows = [row(i, x, wall=1000.0) for i, x in enumerate(xs)]
    m = statistics.median(xs)
    spread = statistics.median(abs(x - m) for x in xs)
    for limit in (1.5, 3.0, 5.0, 9.0):
        want = [(i, "spike") for i, x in enumerate(xs) if abs(x - m) > limit * spread]
        assert want and flags(spark, rows, spike_limit=limit) == want
        assert flags(spark, rows, spike_limit=limit, hot_rows=20, piece_rows=16) == want
