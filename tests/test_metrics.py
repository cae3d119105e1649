import math
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cardscope.functions import metrics as M
from cardscope.operators import bootstrap, failures, joinchoice, ranking, runtime, workload

import numpy as np


def one(spark, *cols):
    return tuple(spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(cols))).first())


def test_errors_and_directions(spark):
    L = F.lit
    assert one(spark, M.q_error(L(10.0), L(5.0)), M.q_error(L(0.2), L(1.0)), M.q_error(L(0.0), L(0.0)), M.q_error(L(-1.0), L(1.0)), M.q_error(L(float("nan")), L(1.0)), M.signed_ratio(L(2.0), L(8.0))) == (2.0, 1.0, 1.0, None, None, 0.25)
    assert one(spark, M.direction(L(2.0), L(1.0)), M.direction(L(1.0), L(2.0)), M.direction(L(0.3), L(0.0)), M.direction(L(None).cast("double"), L(1.0))) == ("over", "under", "equal", None)
    with pytest.raises(PySparkException):
        one(spark, M.q_error(L(-1.0), L(1.0), strict=True))


def test_buckets_and_classes(spark):
    L = F.lit
    assert one(spark, *(M.selectivity_bucket(L(x)) for x in (0.0, 0.0001, 0.001, 1.0, 1.5))) == ("exactly_zero", "(0,0.0001]", "(0.0001,0.001]", "(0.5,1]", ">1")
    assert one(spark, *(M.cardinality_bucket(L(x)) for x in (0, 1, 10, 100000, 100001))) == ("exactly_zero", "(0,1]", "(1,10]", "(10k,100k]", ">100k")
    assert one(spark, *(M.divergence_bucket(L(math.log(x))) for x in (1.0, 1.6, 5, 50, 500))) == ("<1.5x", "1.5x-2x", "2x-10x", "10x-100x", ">=100x")
    assert one(spark, *(M.speedup_class(L(x)) for x in (1.06, 1.0, 0.95))) == ("improved", "unchanged", "degraded")
    keys = [("a", "b", "b"), ("b", "a", "b"), ("a", "a", "a"), ("b", "c", "a"), (None, "a", "a")]
    assert one(spark, *(M.decision_category(*(L(k) for k in ks)) for ks in keys)) == ("improved", "degraded", "both agree", "neither agrees", "not applicable")
    assert one(spark, M.censored(L(5.0), L(True), L(300.0)), M.censored(L(5.0), L(False), L(300.0))) == (300000.0, 5.0)
    orders = [one(spark, runtime.execution_order(L(r), L(c)))[0] for r in (0, 1) for c in ("native", "learned_base", "exact_base")]
    assert orders == [1, 2, 3, 2, 1, 3]


def test_summaries_and_wilson(spark):
    df = spark.createDataFrame([(1.0,), (4.0,), (None,)], "x double")
    r = df.agg(*M.summary(F.col("x"), "e")).first()
    assert (r["e_count"], r["e_mean"], r["e_median"], r["e_geometric_mean"], r["e_max"], r["e_le2_fraction"]) == (2, 2.5, 2.5, 2.0, 4.0, 0.5)
    w, none = one(spark, M.wilson(F.lit(5), F.lit(10)), M.wilson(F.lit(0), F.lit(0)))
    assert abs(w["ci_low"] - 0.2366) < 1e-3 and abs(w["ci_high"] - 0.7634) < 1e-3 and none["rate"] is None
    with pytest.raises(PySparkException):
        spark.createDataFrame([(0.0,)], "x double").agg(M.geometric_mean(F.col("x"))).collect()


def test_ranks_over_many_parts_agree_with_sorting(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "a", "a", None]), rng.choice([1.0, 2.0, rng.random(), None])) for i in range(700)]
    df = spark.createDataFrame(rows, "id bigint, k string, x double")
    got = ranking.with_running(df, ["k"], [F.col("x"), F.col("id")], "r", {"total": "x"}, "n").collect()
    for k in ("a", None):
        want = sorted((r for r in rows if r[1] == k), key=lambda r: (r[2] is not None, r[2] or 0, r[0]))
        mine = sorted((r for r in got if r["k"] == k), key=lambda r: r["r"])
        assert [r["id"] for r in mine] == [r[0] for r in want] and {r["n"] for r in mine} == {len(want)}
        assert abs(mine[-1]["total"] - sum(r[2] or 0 for r in want)) < 1e-6
    fractions = [r["cumulative_fraction"] for r in ranking.ecdf(df, ["k"], "x").where("k = 'a'").orderBy("cumulative_fraction").collect()]
    n = len(fractions)
    assert fractions == [(i + 1) / n for i in range(n)]


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (10.0,), (None,)], "x double")
    rows = ranking.histogram(df, "x").orderBy("bin").collect()
    assert [r["rows"] for r in rows] == [2, 0, 0, 0, 1] and rows[-1]["high"] == 10.0
    flat = ranking.histogram(spark.createDataFrame([(3.0,)] * 2, "x double"), "x").where("rows > 0").collect()
    assert [(r["bin"], r["rows"]) for r in flat] == [(2, 2)]
    assert ranking.histogram(df.where("false"), "x").count() == 0


def test_bootstrap_resamples_rows_and_clusters(spark):
    rng = np.random.default_rng(2)
    x = rng.lognormal(1, 0.3, 400)
    df = spark.createDataFrame([(float(a), float(a * 1.5), f"c{i % 20}") for i, a in enumerate(x)], "l double, r double, c string")
    rows = {r["metric"]: r for r in bootstrap.paired_bootstrap(spark, df, "l", "r", samples=300).collect()}
    for m in ("median_q_error", "geometric_mean_q_error"):
        assert rows[m]["ci_low"] < rows[m]["observed_delta"] < rows[m]["ci_high"] < 0
    again = {r["metric"]: r for r in bootstrap.paired_bootstrap(spark, df.repartition(9), "l", "r", samples=300).collect()}
    assert again == rows
    clustered = bootstrap.paired_bootstrap(spark, df, "l", "r", {"mean": bootstrap.mean}, clusters="c", samples=200).first()
    assert clustered["cluster_count"] == 20 and clustered["ci_high"] < 0
    empty = bootstrap.paired_bootstrap(spark, df.where("false"), "l", "r", samples=10).collect()
    assert all(r["observed_delta"] is None and r["sample_count"] == 0 for r in empty)
    with pytest.raises(ValueError):
        bootstrap.paired_bootstrap(spark, df, "l", "r", samples=0)


def test_bootstrap_over_many_blocks_is_exact(spark):
    from statistics import geometric_mean, median

    rng = np.random.default_rng(3)
    rows = [(float(a), float(b), None if c == 0 else f"c{c}") for a, b, c in zip(np.round(rng.lognormal(1, 1, 1500), 2) + 1, rng.lognormal(1, 1, 1500) + 1, rng.integers(0, 40, 1500) * rng.integers(0, 2, 1500))]
    rows += [(1.0, 1.5, "hot")] * 700 + [(3.0, 1.25, None)] * 20
    df = spark.createDataFrame(rows, "l double, r double, c string")
    same = {"median_q_error": median, "geometric_mean_q_error": geometric_mean, "fraction_q_error_le2": lambda x: sum(v <= 2 for v in x) / len(x)}
    by = {}
    for a, b, c in rows:
        by.setdefault(c, []).append((a, b))
    for unit in (None, "c"):
        # blocks far below the number of pairs: more cells than any block or single value list holds
        got = {r["metric"]: r for r in bootstrap.paired_bootstrap(spark, df, "l", "r", clusters=unit, samples=400, block_rows=128).collect()}
        groups = list(by.values()) if unit else [[(a, b)] for a, b, _ in rows]
        assert {r["cluster_count"] for r in got.values()} == {len(by) if unit else None}
        draws = {m: [] for m in same}
        for _ in range(400):
            drawn = [p for k in rng.integers(0, len(groups), len(groups)) for p in groups[k]]
            for m, f in same.items():
                draws[m].append(f([a for a, _ in drawn]) - f([b for _, b in drawn]))
        for m, f in same.items():
            assert got[m]["observed_delta"] == pytest.approx(f([a for a, _, _ in rows]) - f([b for _, b, _ in rows]))
            low, high = np.quantile(draws[m], [0.025, 0.975])
            assert abs(got[m]["ci_low"] - low) < 0.3 * (high - low) and abs(got[m]["ci_high"] - high) < 0.3 * (high - low)
        other = {r["metric"]: r for r in bootstrap.paired_bootstrap(spark, df.repartition(7), "l", "r", clusters=unit, samples=400, block_rows=128).collect()}
        assert other == got


def test_bootstrap_query_has_three_units_of_10000_resamples(spark, monkeypatch):
    from cardscope.plans import model_queries

    real, asked = bootstrap.paired_bootstrap, []

    def few(*args, samples=10_000, **options):
        asked.append(samples)
        return real(*args, samples=2, **options)

    monkeypatch.setattr(bootstrap, "paired_bootstrap", few)
    rows = model_queries.bootstrap_ci(spark, "/root/testdata/sf0.001").collect()
    assert asked == [10_000] * 3 and len(rows) == 9 and {r["unit"] for r in rows} == {"occurrence", "normalized_sql_id", "query_template"}


def test_sections_take_the_first_row_of_a_statement(spark):
    schema = "result_id int, normalized_sql_id string, is_filtered boolean, learned_q_error double, native_q_error double, learned_signed_error_ratio double, native_signed_error_ratio double, status string"
    rows = [(1, "same", True, 2.0, 4.0, 2.0, 0.5, "ok"), (2, "same", True, 8.0, 4.0, 2.0, 0.5, "ok"), (3, "other", False, 1.0, 1.0, 1.0, 1.0, "ok"), (4, "x", True, 1.0, 1.0, 1.0, 1.0, "invalid")]
    got = {r["section"]: r for r in failures.section_summary(spark.createDataFrame(rows, schema)).collect()}
    assert {s: r["rows"] for s, r in got.items()} == dict(zip(failures.SECTIONS, (3, 2, 2, 1, 1)))
    assert got["unique_normalized_sql"]["learned_max"] == 2.0 and got["all_workload_occurrences"]["learned_better"] == 1
    assert failures.section_summary(spark.createDataFrame([], schema)).count() == 0


def test_timeouts_are_censored_and_degrade(spark):
    schema = "measurement_id int, query_id string, source_query_id string, query_template string, relation_count int, configuration string, warmup boolean, base_join_changed boolean, wall_clock_duration_ms double, execution_time_ms double, timeout boolean, timeout_seconds double, status string"
    base = ("q", "1", "t", 2)
    rows = [(1, *base, "native", False, True, 101.0, 100.0, False, 300.0, "ok"), (2, *base, "learned_base", False, True, None, None, True, 300.0, "timeout"), (3, *base, "learned_base", True, True, 1.0, 1.0, False, 300.0, "ok")]
    r = runtime.per_query(spark.createDataFrame(rows, schema)).first()
    assert (r["native_median_execution_time_ms"], r["learned_median_execution_time_ms"], r["runtime_classification"], r["learned_timeout_count"]) == (100.0, 300000.0, "degraded", 1)


def test_workload_helpers(spark):
    lines = ["SELECT COUNT(*) FROM badges as b;||0||79851", "SELECT COUNT(*) FROM users as u, badges as b WHERE b.UserId = u.Id;||0", "79851||SELECT COUNT(*) FROM badges as b, users as u WHERE b.UserId = u.Id;", "x"]
    df = spark.createDataFrame([(x,) for x in lines], "l string")
    assert [r[0] for r in df.select(workload.detect_format(F.col("l"))).collect()] == ["single_table", "subquery", "complete", None]
    assert one(spark, workload.label(F.lit(" My-Load.sql "), F.lit(1)), workload.normalize_label(F.lit("--")), workload.normalize_sql(F.lit(" SELECT\n 1 ;; "))) == ("my_load_sql_00001", "workload", "select 1")
    w = spark.createDataFrame([("a", "1", 3), ("b", "2", 1), ("c", "9", 2)], "label string, query_id string, line_number int")
    t = spark.createDataFrame([("T1", "a", None), ("T2", None, "1"), ("T3", None, "2")], "template string, label string, query_id string")
    assert {r["label"]: r["template"] for r in workload.with_template(w, t, "none").collect()} == {"a": "T1", "b": "T3", "c": "none"}
    assert [r["label"] for r in workload.select_workload(w, "a, 2", 1).collect()] == ["b"]
    for bad in (dict(only="zz"), dict(limit=0)):
        with pytest.raises(ValueError):
            workload.select_workload(w, **bad)
    q = spark.createDataFrame([("l1", "1", "t", "SELECT COUNT(*) FROM users as u, posts as p WHERE (p.OwnerUserId = u.Id) AND p.Title = 'a, b AND c' AND (u.Views >= 2);")], "label string, query_id string, template string, sql string")
    got = {r["table_key"]: r for r in workload.derive_base_queries(q).collect()}
    assert got["posts:p"]["predicate_text"] == "p.Title = 'a, b AND c'" and got["users:u"]["base_sql"] == "SELECT * FROM users AS u WHERE u.Views >= 2"
    assert got["posts:p"]["occurrence_id"] == "l1__posts_p"


def test_join_keys(spark):
    assert one(spark, joinchoice.join_key(F.array(F.lit("posts:p"), F.lit("badges:b"), F.lit("posts:p"))), joinchoice.relation_key(F.lit("posts"), F.lit("posts")), joinchoice.relation_key(F.lit("posts"), F.lit("p"))) == ("badges:b|posts:p", "posts", "posts:p")


def test_worst_rows_need_no_categories(spark, monkeypatch):
    from cardscope.plans import reference_queries

    rows = [(i, "ok" if i % 7 else "invalid", float(1 + i * 37 % 101), float(1 + i % 5), 10.0 ** (i % 9 - 4)) for i in range(300)]
    df = spark.createDataFrame(rows, "result_id bigint, status string, learned_q_error double, native_q_error double, learned_signed_error_ratio double")
    monkeypatch.setattr(reference_queries, "evaluated", lambda *_: df)
    monkeypatch.setattr(failures, "category_metrics", lambda *_: pytest.fail("categories are not asked for"))
    ok = [r for r in rows if r[1] == "ok"]
    first, second = (sorted(ok, key=k)[:50] for k in (lambda r: (-r[2], r[0]), lambda r: (-r[2] / r[3], r[0])))
    assert {r["result_id"] for r in failures.worst_rows(df).collect()} == {r[0] for r in first + second}
    got = reference_queries.error_ratio_histogram(spark, "").collect()
    assert sum(r["rows"] for r in got) == len({r[0] for r in first + second})


def test_categories_of_some_dimensions(spark):
    rows = [(i, "t" if i % 3 else None, "t.a = 1 and t.b > 2" if i % 2 else "t.b > 2", f"s{i % 7}", float(1 + i)) for i in range(40)]
    df = spark.createDataFrame(rows, "result_id bigint, table string, predicate_text string, normalized_sql_id string, learned_q_error double")
    df = failures.with_shape(df).selectExpr("*", "'ok' as status", "'q' as query_template", "5L as exact_cardinality", "0.1D as selectivity", "'over' as estimate_direction", "'exact' as inference_mode", "2.0D as native_q_error", "1.5D as learned_signed_error_ratio")
    only = ("table", "constrained_column")
    want = sorted(str(r) for r in failures.category_metrics(df).collect() if r["group_dimension"] in only)
    assert len(want) == 6 and sorted(map(str, failures.category_metrics(df, only).collect())) == want


def test_worst_queries_ask_only_whether_their_categories_are_systematic(spark, monkeypatch):
    rng = random.Random(3)
    # groups of all sizes up to 14, with medians below, at and above twice the overall one, and between two values around it
    values = {f"t{k}": [rng.choice([[1.0, 2.0], [2.0, 4.0], [3.0, 5.0], [3.0, 4.9], [1.0, 4.0, 9.0]][k % 5]) for _ in range(1 + k % 14)] for k in range(60)}
    values["even"], values["under"], values["four"] = [3.0] * 3 + [5.0] * 3, [3.0] * 3 + [4.9] * 3, [9.0] * 4
    values["rest"] = [2.0] * 900
    rows = [(i, t if t != "t9" else None, x, 1.0 + i % 3) for i, (t, x) in enumerate((t, x) for t, xs in values.items() for x in xs)]
    df = spark.createDataFrame(rows, "result_id bigint, table string, learned_q_error double, native_q_error double")
    df = failures.with_shape(df.withColumn("predicate_text", F.expr("if(result_id % 2 = 0, 't.a = 1 and t.b > 2', null)"))).selectExpr(
        "*", "'ok' as status", "concat('q', result_id % 7) as query_template", "5L as exact_cardinality", "0.1D as selectivity", "'over' as estimate_direction", "'exact' as inference_mode", "false as fallback_used", "'s' as normalized_sql_id", "1.5D as learned_signed_error_ratio"
    )
    among = df.select(F.explode(failures.categories(df)).alias("c")).select("c.dimension", "c.value").distinct()
    every = failures.category_metrics(df).where("systematic_failure_candidate").selectExpr("group_dimension as dimension", "group_value as value")
    bad = sorted(map(tuple, every.collect()))
    assert {v for d, v in bad if d == "table"} == {t if t != "t9" else "None" for t, xs in values.items() if len(xs) >= 5 and np.median(xs) >= 4}
    assert ("table", "even") in bad and not {("table", "under"), ("table", "four"), ("table", "rest")} & set(bad)
    assert sorted(map(tuple, failures.systematic_groups(df, among).collect())) == bad
    assert failures.systematic_groups(df.where("false"), among).collect() == []
    monkeypatch.setattr(failures, "category_metrics", lambda *_: pytest.fail("metrics are not asked for"))
    got = failures.worst_queries(df, limit=len(rows)).collect()
    assert len(got) == len(rows) and {tuple(g) for r in got for g in r["matching_systematic_groups"]} == set(bad)
    for r in got:
        assert (("table", str(r["table"])) in map(tuple, r["matching_systematic_groups"])) == (("table", str(r["table"])) in bad)
