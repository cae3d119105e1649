import math
import random

import numpy as np

from cardscope.llm.digests import BITS, VALUE_ERROR, compressed, digests, merged, percentiles

SCHEMA = "result_id bigint, g string, day string, x double, y double, n int, node int, metric string"


def table(spark, rows):
    return spark.createDataFrame([(i, *r, 1, 2, "clash") for i, r in enumerate(rows)], SCHEMA)


def rank_error(answer, values, q):
    """Distance in rank of the answer, which may be below a value by its quantisation, from the wanted rank."""
    xs = np.sort(values)
    want = max(math.ceil(q * len(xs) - 1e-9), 1)
    low, high = np.searchsorted(xs, answer * (1 - 1e-9)) + 1, np.searchsorted(xs, answer * (1 + 2 * VALUE_ERROR), "right")
    return 0 if low <= want <= max(high, low) else min(abs(low - want), abs(high - want))


def test_merged_days_keep_the_bound(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "b", None]), f"d{rng.randrange(5)}", rng.choice([1.0, math.exp(rng.expovariate(0.4)), rng.uniform(1, 1e6)]), rng.choice([None, 2.0])) for _ in range(8000)]
    for error in (0.2, 0.02, 0.001):
        parts = digests(table(spark, rows), ["g", "day"], ["x", "y"], error)
        got = {(r["g"], r["metric"]): r for r in percentiles(parts, ["g"], {"p50": 0.5, "p90": 0.9, "p99": 0.99}, error).collect()}
        for g in ("a", "b", None):
            xs = np.array([x for gg, _, x, _ in rows if gg == g])
            r = got[(g, "x")]
            assert r["n"] == len(xs)
            for name, q in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99)):
                assert rank_error(r[name], xs, q) <= error * len(xs) + 1
            assert got[(g, "y")]["p50"] == 2.0


def test_node_addition_is_the_same_in_any_order():
    rng = np.random.default_rng(3)
    leaves = rng.integers(0, 2**BITS, 5000) + 2**BITS
    k = 300
    half = [compressed(np.zeros(2500, int), leaves[i::2], np.ones(2500, int), k) for i in (0, 1)]
    both = [compressed(np.zeros(sum(map(len, (a[1], b[1]))), int), np.concatenate([a[1], b[1]]), np.concatenate([a[2], b[2]]), k) for a, b in (half, half[::-1])]
    assert all(np.array_equal(np.sort(x), np.sort(y)) for x, y in zip(both[0], both[1]))
    assert both[0][2].sum() == 5000 and len(both[0][1]) <= 3 * k
    deep = both[0][1] < 2**BITS
    assert both[0][2][deep].max() <= 5000 // k


def test_values_that_do_not_count_and_empty_tables(spark):
    rows = [("a", "d", x, None) for x in (None, float("nan"), float("inf"), -float("inf"), 0.5, -3.0, 0.0, 1.0, 1e300)] + [("b", "d", None, None)]
    got = percentiles(digests(table(spark, rows), ["g", "day"], ["x", "y"]), ["g"], {"p50": 0.5, "p99": 0.99}).collect()
    assert [(r["g"], r["metric"], r["n"], r["p50"]) for r in got] == [("a", "x", 2, 1.0)]
    assert got[0]["p99"] > 1e19
    assert percentiles(digests(table(spark, []), ["g", "day"], ["x"]), ["g"], {"p50": 0.5}).count() == 0


def test_one_group_in_many_batches(spark):
    rows = [("a", "d", float(1 + i), None) for i in range(3000)]
    df = table(spark, rows).repartition(7)
    parts = digests(df, ["g", "day"], ["x"], 0.01)
    assert parts.agg({"n": "sum"}).first()[0] == 3000
    assert merged(parts, ["g"], 0.01).count() <= 3 * BITS / 0.01
    p = percentiles(parts, ["g"], {"p50": 0.5}).first()["p50"]
    assert abs(p - 1500) <= 0.01 * 3000 + 2


def test_values_of_any_size_have_their_own_leaf(spark):
    rows = [("a", "d", x, None) for x in (1.0, 2.0**63, 2.0**65, 1e30, 1e300)] + [("b", "d", 1e300, None), ("b", "d", float("inf"), 0.5)]
    got = {r["g"]: r for r in percentiles(digests(table(spark, rows), ["g", "day"], ["x"]), ["g"], {"p50": 0.5, "p99": 0.99}).collect()}
    assert got["a"]["n"] == 5 and got["b"]["n"] == 1
    for answer, x in ((got["a"]["p50"], 2.0**65), (got["a"]["p99"], 1e300), (got["b"]["p50"], 1e300)):
        assert x / (1 + 2 * VALUE_ERROR) <= answer <= x * (1 + 1e-9)
