import random

import numpy as np
import pytest

from cardscope.operators import encoding
from cardscope.operators.encoding import ColumnEncoder, TableEncoder
from cardscope.operators.exact_median import at_ranks, column_percentiles, group_percentiles


@pytest.mark.parametrize("few", [10**6, 50])
def test_percentiles_of_columns_are_exact(spark, few):
    rng = random.Random(2)
    rows = [(rng.choice([rng.gauss(0, 1), 7.0, -1e300, 1e300, float("nan"), None]), float(i % 5), i, None, rng.lognormvariate(0, 6)) for i in range(3000)]
    df = spark.createDataFrame(rows, "a double, b double, c int, d double, e double")
    fractions = [0.0, 0.1, 1 / 3, 0.5, 0.99, 1.0]
    got = {r["column"]: r["values"] for r in column_percentiles(df, ["a", "b", "c", "d", "e"], fractions, few).collect()}
    assert sorted(got) == ["a", "b", "c", "e"]
    for i, c in enumerate("abcde"):
        if c in got:
            xs = np.array([r[i] for r in rows if r[i] is not None and not np.isnan(r[i])], dtype=float)
            assert np.allclose(got[c], np.quantile(xs, fractions), rtol=1e-12), c
    assert column_percentiles(df.where("false"), ["a"], [0.5]).count() == 0


@pytest.mark.parametrize("few", [10**6, 20])
def test_ranks_of_weighted_rows(spark, few):
    rng = random.Random(4)
    rows = [(rng.choice(["x", "x", None]), rng.choice([rng.gauss(0, 1), 1.0, 5e-324, 1e18]), rng.randint(1, 3)) for _ in range(800)]
    x = spark.createDataFrame(rows, "k string, x double, n int")
    every = {k: sorted(v for kk, v, n in rows if kk == k for _ in range(n)) for k in ("x", None)}
    targets = [(k, t, r) for k, xs in every.items() for t, r in enumerate([0, 5, len(xs) // 2, len(xs) - 1])]
    got = {(r["k"], r["target"]): r["value"] for r in at_ranks(x, ["k"], spark.createDataFrame(targets, "k string, target int, rank bigint"), few).collect()}
    assert got == {(k, t): every[k][r] for k, t, r in targets}


def test_edges_of_few_and_many_values(spark):
    rng = random.Random(6)
    rows = [(rng.gauss(0, 1), rng.choice([1, 2, 3]), 5.0, None if i else 1) for i in range(4000)]
    df = spark.createDataFrame(rows, "many double, few int, one double, none int")
    got = {r["column"]: r["edges"] for r in encoding.quantile_edges(df, ["many", "few", "one", "none"]).collect()}
    assert np.allclose(got["many"], np.unique(np.quantile([r[0] for r in rows], np.linspace(0, 1, 64))))
    assert got["few"] == sorted(set(np.quantile([r[1] for r in rows], [0, 0.5, 1]))) and got["one"] == [5.0, 6.0] and got["none"] == [1.0, 2.0]
    assert encoding.quantile_edges(df.where("false"), ["many"]).first()["edges"] == [0.0, 1.0]
    e = TableEncoder.fit(df, "t")
    assert [c.encoding for c in e.columns] == ["numeric_discretizer", "dictionary", "dictionary", "dictionary"] and e.row_count == 4000
    rows = df.groupBy(encoding.row_bin(df["many"], encoding.F.array(*(encoding.F.lit(x) for x in got["many"]))).alias("b")).count().collect()
    coded = e.encode(df).groupBy("t0").count().collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, coded))


def test_large_dictionaries_are_refused_or_left_out_by_intent(spark, monkeypatch):
    monkeypatch.setattr(encoding, "MAX_TOKENS", 100)
    df = spark.range(150).selectExpr("concat('v', id) as text", "id % 3 as few")
    with pytest.raises(ValueError, match="text would need a dictionary of more than 100 values"):
        TableEncoder.fit(df, "t")
    e = TableEncoder.fit(df, "t", oversize="skip")
    assert [c.column for c in e.columns] == ["few"] and list(e.skipped) == ["text"]
    with pytest.raises(Exception, match="more than 100 values"):
        encoding.dictionary_tokens(encoding.value_counts(df)).collect()


def test_a_text_like_the_old_null_mark_survives_a_round_trip():
    e = TableEncoder("t", [ColumnEncoder("a", "text", values=["__NULL__", "x", None])], 3)
    assert TableEncoder.from_json(e.to_json()) == e


def test_percentiles_of_hot_groups_whatever_the_names_of_keys(spark):
    rng = random.Random(7)
    rows = [(rng.choice("ab"), rng.choice(["c", None, None]), rng.choice([1.0, rng.lognormvariate(0, 9), -rng.lognormvariate(0, 9), None])) for _ in range(3000)]
    for keys in (["dimension", "value"], ["x", "v"], ["n", "target"], ["rank", "size"]):
        df = spark.createDataFrame(rows, f"{keys[0]} string, {keys[1]} string, y double")
        got = group_percentiles(df, keys, [("low", "y", 0.0), ("median", "y", 0.5), ("p99", "y", 0.99)], [encoding.F.count("*").alias("rows")], hot_rows=600).collect()
        assert len(got) == 4
        for r in got:
            mine = [y for a, b, y in rows if (a, b) == (r[keys[0]], r[keys[1]])]
            assert r["rows"] == len(mine) and np.allclose([r["low"], r["median"], r["p99"]], np.quantile([y for y in mine if y is not None], [0.0, 0.5, 0.99]), rtol=1e-12)


def test_categories_whose_percentiles_are_selected(spark, monkeypatch):
    from cardscope.operators import failures

    rng = random.Random(9)
    rows = [(i, rng.choice(["t", "u"]), rng.choice(["a", "b", None]), rng.choice(["t.x = 1", "t.x > 1 and t.y = 2", None]), rng.choice([1.0, 1 + rng.expovariate(1), 1e9])) for i in range(900)]
    df = spark.createDataFrame([(*r[:4], f"s{r[0] % 50}", "ok", 5, 100, 7.0, r[4], 2.0) for r in rows], "result_id bigint, table string, query_template string, predicate_text string, normalized_sql_id string, status string, exact_cardinality bigint, table_cardinality bigint, learned_estimate double, learned_q_error double, native_q_error double")
    df = failures.with_shape(df).selectExpr("*", "0.05D as selectivity", "'over' as estimate_direction", "'exact' as inference_mode", "1.4D as learned_signed_error_ratio", "false as fallback_used")
    want = {(r["group_dimension"], r["group_value"]): r.asDict() for r in failures.category_metrics(df).collect()}
    listed = sorted(map(str, failures.worst_queries(df).select("result_id", "candidate_classification").collect()))
    assert want["constrained_column", "t.y"]["group_size"] == sum(r[1] == "t" and "y" in (r[3] or "") for r in rows) and want["encoding_type", "unknown"]["unique_query_count"] == 50
    monkeypatch.setattr(failures, "HOT_ROWS", 1000)
    monkeypatch.setattr(failures, "SELECTED_ROWS", 300)
    got = {(r["group_dimension"], r["group_value"]): r.asDict() for r in failures.category_metrics(df).collect()}
    assert got.keys() == want.keys()
    for k, w in want.items():
        assert all(got[k][c] == (pytest.approx(v, rel=1e-12) if isinstance(v, float) else v) for c, v in w.items()), k
    assert sorted(map(str, failures.worst_queries(df).select("result_id", "candidate_classification").collect())) == listed
