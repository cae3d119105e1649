import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardscope.operators import density, encoding
from cardscope.operators.encoding import ColumnEncoder, Predicate, PredicateError, TableEncoder, allowed_ids, allowed_tokens, intersected, predicate_row
from cardscope.plans import explain, model_queries
from cardscope.plans.native import Catalog, roundtrip_ok
from cardscope.plans.requests import COMPLEX, CROSS, NOT_SINGLE, QueryGraph, normalize_sql
from cardscope.plans.seed_workload import STATEMENTS
from cardscope.sources import artifacts

SMALL = "/root/testdata/sf0.001"


def test_dictionary_and_null_tokens(spark):
    df = spark.createDataFrame([("a", None, 1), ("b", 10, 2), ("c", 20, 3), ("a", 20, 2)], "category string, score int, value int")
    e = TableEncoder.fit(df, "t")
    sets = lambda *ps: e.allowed(list(ps))
    assert len(sets(Predicate("category", "in", values=("a", "c", "z")))[0]) == 2
    score = e.encoder_for("score")
    assert [score.values[i] for i in allowed_ids(score, Predicate("score", ">=", value=15))] == ["20.0"]
    assert allowed_ids(score, Predicate("score", "=", value=None)) == [2]
    assert sets(Predicate("value", ">=", value=2), Predicate("value", "<=", value=2))[2] == [1]
    with pytest.raises(PredicateError, match="nope"):
        sets(Predicate("nope", "=", value=1))
    with pytest.raises(PredicateError):
        allowed_ids(score, Predicate("score", "like", value="x"))
    assert TableEncoder.from_json(e.to_json()) == e
    tokens = {tuple(r) for r in e.encode(df).collect()}
    assert tokens == {(0, 2, 0), (1, 0, 1), (2, 1, 2), (0, 1, 1)}
    with pytest.raises(Exception, match="value without token"):
        e.encode(spark.createDataFrame([("new", 10, 1)], df.schema)).collect()


def test_bins_of_rows_and_literals_differ_at_inner_edges(spark):
    c = ColumnEncoder("x", "float", edges=[0.0, 1.0, 2.0, 4.0])
    assert allowed_ids(c, Predicate("x", "=", value=1.0)) == [1] and allowed_ids(c, Predicate("x", "=", value=99)) == [2] and allowed_ids(c, Predicate("x", ">", value=9)) == [0]
    assert allowed_ids(c, Predicate("x", "between", lower=1.5, upper=2.0)) == [1, 2] and allowed_ids(c, Predicate("x", "in", values=(0.5, -3, 4.0))) == [0, 2]
    df = spark.createDataFrame([(v,) for v in (0.0, 1.0, 1.5, 4.0, 5.0, -1.0, None)], "x double")
    assert [r[0] for r in TableEncoder("t", [c], 7).encode(df).collect()] == [0, 0, 1, 2, 0, 0, 0]
    assert encoding.quantile_edges(spark.createDataFrame([(7.0,)] * 3, "x double"), ["x"]).first()["edges"] == [7.0, 8.0]
    assert encoding.quantile_edges(df.where("false"), ["x"]).count() in (0, 1)


def test_sets_for_many_predicates_agree_with_one_by_one(spark):
    e = TableEncoder("t", [ColumnEncoder("n", "integer", values=["1.0", "2.0", "5.0", None]), ColumnEncoder("s", "text", values=["a", "b", None]), ColumnEncoder("x", "float", edges=[0.0, 1.0, 2.0])], 9)
    ps = [Predicate(c, op, value=v) for c, vs in (("n", (1, 2, 9)), ("s", ("a", "zz")), ("x", (-1.0, 1.0, 1.5, 9.0))) for v in vs for op in ("=", "<", "<=", ">", ">=")]
    ps += [Predicate("n", "between", lower=1, upper=2), Predicate("x", "between", lower=5.0, upper=9.0), Predicate("s", "in", values=("b", "q")), Predicate("x", "in", values=(0.5, 7.0)), Predicate("n", "=", value=None), Predicate("s", "=", value=None), Predicate("x", "=", value=None)]
    rows = spark.createDataFrame([predicate_row("q", i, p) for i, p in enumerate(ps)], encoding.PREDICATE_SCHEMA)
    got: dict = {}
    for r in allowed_tokens(e.tokens(spark), rows).collect():
        got.setdefault(r["predicate_id"], []).append(r["token"])
    assert {i: sorted(t) for i, t in got.items()} == {i: t for i, p in enumerate(ps) if (t := allowed_ids(e.encoder_for(p.column), p))}
    two = spark.createDataFrame([predicate_row("q", i, p) for i, p in enumerate([Predicate("n", ">=", value=2), Predicate("n", "<", value=5)])], encoding.PREDICATE_SCHEMA)
    assert [r["token"] for r in intersected(allowed_tokens(e.tokens(spark), two), two).collect()] == [1]


def test_histogram_density_sums_to_one(spark):
    df = spark.createDataFrame([(i % 3, f"v{i % 5}", float(i)) for i in range(300)], "a int, b string, x double")
    e = TableEncoder.fit(df, "t")
    h = density.token_histogram(df, e)
    got = {r["query_id"]: r["selectivity"] for r in density.histogram_estimates(h, e, {"all": [], "some": [Predicate("a", "=", value=1)], "none": [Predicate("b", "=", value="no")]}).collect()}
    assert got == {"all": 1.0, "some": pytest.approx(1 / 3), "none": 0.0}


def test_network_gradients_masks_and_sums():
    rng = np.random.default_rng(0)
    m = density.Made([3, 4, 2], embedding=5, hidden=(12, 12), seed=1)
    t = np.stack([rng.integers(0, d, 30) for d in m.domains], axis=1)
    loss, grads = m.loss_and_gradients(t)
    for name in m.params:
        for i in rng.integers(0, m.params[name].size, 4):
            p = m.params[name].reshape(-1)
            keep, step = p[i], 1e-6
            p[i] = keep + step
            up = m.loss_and_gradients(t)[0]
            p[i] = keep - step
            down = m.loss_and_gradients(t)[0]
            p[i] = keep
            assert abs((up - down) / (2 * step) - grads[name].reshape(-1)[i]) < 1e-4
    grid = np.stack([g.ravel() for g in np.meshgrid(*(np.arange(d) for d in m.domains), indexing="ij")], axis=1)
    assert abs(m.joint(grid).sum() - 1) < 1e-9
    other = t.copy()
    other[:, 1:] = 0
    assert np.allclose(m.conditionals(t)[0], m.conditionals(other)[0])
    other = t.copy()
    other[:, 2] = 0
    assert np.allclose(m.conditionals(t)[1], m.conditionals(other)[1])
    single, _ = density.train(np.array([[0]] * 80 + [[1]] * 20), [2], epochs=60, batch=50, rate=0.05)
    assert abs(single.conditionals(np.zeros((1, 1), int))[0][0][0] - 0.8) < 0.08


def test_a_table_is_learned_whole_on_the_driver_or_in_parts(spark):
    rows = [(i % 4, (i % 4 + (i // 4) % 2) % 4, i % 3) for i in range(2400)]
    df = spark.createDataFrame(rows, "a int, b int, c int")
    e = TableEncoder.fit(df, "t")
    exact = {t: n / len(rows) for t, n in __import__("collections").Counter(rows).items()}
    for cells, draws in ((1000, 6000), (12, 1000)):
        model, note = density.train_table(df, e, local_cells=cells, epochs=20, batch=128, rate=0.01, hidden=(32, 32), draws=draws)
        joint = model.joint(np.array(list(exact)))
        assert note.epochs == 20 and note.history[-1]["validation_loss"] < note.history[0]["validation_loss"]
        assert abs(joint.sum() - 1) < 0.15 and np.abs(joint - list(exact.values())).max() < 0.02, cells
    again, _ = density.train_table(df, e, local_cells=5, epochs=2, batch=128, draws=600)
    same, _ = density.train_table(df.orderBy("c"), e, local_cells=5, epochs=2, batch=128, draws=600)
    assert np.allclose(again.params["w0"], same.params["w0"])


def test_sampling_agrees_with_enumeration():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 5, 3000)
    tokens = np.stack([a, (a + rng.integers(0, 2, 3000)) % 5, rng.integers(0, 4, 3000)], axis=1)
    model, note = density.train(tokens, [5, 5, 4], epochs=8, batch=256, rate=0.01, hidden=(32, 32))
    assert note.history[-1]["train_loss"] < note.history[0]["train_loss"]
    e = TableEncoder("t", [ColumnEncoder(c, "integer", values=[f"{i}.0" for i in range(d)]) for c, d in zip("abc", (5, 5, 4))], 3000)
    est = density.Estimator(e, model, samples=4000)
    ps = [Predicate("a", "<=", value=2), Predicate("c", ">", value=0)]
    exact = est.estimate(ps)
    est.enumeration_cap = 0
    draws = [est.sample(e.allowed(ps))[0] for est.seed in range(5)]
    assert exact.diagnostics["inference_mode"] == "enumeration" and abs(np.mean(draws) - exact.selectivity) < 0.01
    assert abs(exact.selectivity - np.mean((tokens[:, 0] <= 2) & (tokens[:, 2] > 0))) < 0.05
    assert est.estimate([]).selectivity == 1.0
    with pytest.raises(ValueError):
        est.configure(1, 0)


def test_requests_and_reasons(spark):
    parse = lambda s: QueryGraph.parse(spark, s)
    ps, reason = parse("SELECT * FROM orders WHERE orders.status = 'F' AND total > 10").translate("orders")
    assert reason is None and [(p.column, p.op, p.value) for p in ps] == [("status", "=", "F"), ("total", ">", 10)]
    two = parse("SELECT * FROM a, b WHERE a.x = b.x AND a.y < 3 AND b.z IN (1, 2)")
    assert two.translate(["a", "b"])[1] == NOT_SINGLE and two.translate("a")[0] == [Predicate("y", "<", value=3)] and two.join_count == 1
    assert parse("SELECT * FROM t WHERE x = 1 OR y = 2").translate("t")[1] == COMPLEX
    assert parse("SELECT * FROM t WHERE x LIKE 'a%'").translate("t")[1] == "Unsupported operator: like"
    assert parse("SELECT * FROM a, b WHERE a.x < b.x AND a.y = 1").translate("a")[1] == CROSS
    five = parse(STATEMENTS["region_to_lineitem"])
    assert len(five.fragments()) == 15 and five.base_filter("r") is not None and five.base_filter("n") is None
    assert normalize_sql(" SELECT  1 ;") == "select 1"


def test_estimates_react_to_injection_and_joins_flip(spark):
    with Catalog(spark, SMALL) as c:
        s = c.statement(QueryGraph.parse(spark, "SELECT COUNT(*) FROM lineitem l, part p, orders o WHERE l.l_partkey=p.p_partkey AND o.o_orderkey=l.l_orderkey AND p.p_size<=10 AND o.o_totalprice>300000"))
        for wanted in (1.0, 42.0, 300.0):
            assert roundtrip_ok(wanted, s.inject({"o": wanted})["o"])
            s.restore()
        native = s.first_base_join()
        flips = set()
        for target in ({"o": 1.0}, {"p": 1.0}, {"o": 100000.0}, {"p": 100000.0}):
            s.inject(target)
            flips.add(s.first_base_join())
            s.restore()
        assert s.first_base_join() == native and len(flips) > 1
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("cs_")]


def test_explain_documents(spark):
    scan = lambda r, a, **x: {"Node Type": "Seq Scan", "Relation Name": r, "Alias": a, "Plan Rows": 5, **x}
    wrapped = {"Plan": {"Node Type": "Gather", "Plans": [{"Node Type": "Nested Loop", "Plans": [{"Node Type": "Materialize", "Plans": [scan("posts", "p")]}, scan("badges", "b")]}]}}
    assert explain.base_join_keys(wrapped) == ["badges:b|posts:p"]
    bushy = {"Plan": {"Node Type": "Hash Join", "Plans": [{"Node Type": "Nested Loop", "Plans": [scan("a", "a"), scan("b", "b")]}, {"Node Type": "Merge Join", "Plans": [scan("c", "c"), scan("d", "d")]}]}}
    assert explain.base_join_keys(bushy) == ["a|b", "c|d"] and [j["is_base_join"] for j in explain.joins(bushy)] == [True, True, False]
    # a node that names a relation hides what is below it, but not from joins below it
    inner = {"Plan": {"Node Type": "Nested Loop", "Plans": [scan("v", "v", Plans=[{"Node Type": "Hash Join", "Plans": [scan("a", "a"), scan("b", "b"), None]}]), scan("c", "x")]}}
    assert explain.base_join_keys([json.dumps(inner)]) == ["a|b", "c:x|v"] and [s["relation_key"] for s in explain.scans(inner)] == ["v", "a", "b", "c:x"]
    one, later = ({"Plan": scan("t", "t", **{"Actual Rows": n}), "Execution Time": n} for n in (1, 2))
    more = {"Plan": scan("t", "t", **{"Plan Rows": 43})}
    assert explain.plan_hash(one) == explain.plan_hash(later) != explain.plan_hash(more) and explain.plan_hash(one, False) == explain.plan_hash(more, False)
    assert explain.plan_hash([[json.dumps({"Plan": {}})]]) == explain.plan_hash({"Plan": {}}) and explain.plan_hash("{") is None and explain.metrics("null") == {}
    got = explain.metrics({"Plan": {"Actual Rows": "inf", "Plan Rows": None, "Shared Hit Blocks": 7}, "Execution Time": "3"})
    assert (got["execution_time_ms"], got["actual_rows"], got["root_rows"], got["shared_hit_blocks"]) == (3.0, None, None, 7.0)
    df = spark.createDataFrame([(1, json.dumps(wrapped)), (2, json.dumps([bushy])), (2, json.dumps([bushy])), (3, "{"), (4, None), (None, json.dumps(json.dumps(inner)))], "id int, d string")
    facts = {r["id"]: (r["all_base_joins"], r["scans"], r["joins"], r["root_rows"]) for r in explain.plan_facts(df, "id", "d").collect()}
    assert facts == {1: (["badges:b|posts:p"], 2, 1, None), 2: (["a|b", "c|d"], 4, 3, None), None: (["a|b", "c:x|v"], 4, 2, None)}
    assert explain.plan_joins(df, "id", "d").count() == 6 and explain.plan_scans(df, "id", "d").count() == 10 and explain.plan_hashes(df, "id", "d").count() == 3
    assert explain.plan_facts(df.where("false"), "id", "d").count() == 0
    hints = spark.createDataFrame([("/*=x= Card(a #1) */ SELECT 1",), ("SELECT 1",), (None,)], "s string").select(explain.hint(F.col("s"))).collect()
    assert [r[0] for r in hints] == ["/*=x= Card(a #1) */", "", ""]


def test_reports_registry_and_runs(spark, tmp_path):
    with pytest.raises(ValueError):
        artifacts.write_json(tmp_path / "a.json", {"x": float("nan")})
    assert artifacts.write_failures(tmp_path / "f.csv", []) is None
    assert artifacts.write_failures(tmp_path / "f.csv", [{"label": "l", "z": 1, "a": 2}]).read_text().startswith("label,stage,reason,sql,a,z")
    df = spark.createDataFrame([(1, 2.0, ["x"], 9)], "a int, b double, c array<string>, d int")
    artifacts.write_table(df, str(tmp_path / "t"), ["a", "b", "c"])
    assert [tuple(r) for r in artifacts.read_csv(spark, str(tmp_path / "t"), "a int, b double, c string").collect()] == [(1, 2.0, '["x"]')]
    with pytest.raises(Exception, match="not finite"):
        artifacts.write_table(spark.createDataFrame([(float("inf"),)], "b double"), str(tmp_path / "u"), ["b"])
    e = TableEncoder("orders", [ColumnEncoder("a", "integer", values=["1.0", "2.0"])], 10)
    for schema in ("s1", "s2"):
        artifacts.save_model(tmp_path / "models", schema, "orders", density.Made([2], 2, (4,)), e)
    (tmp_path / "models" / "s1" / "half").mkdir()
    r = artifacts.Registry.load(tmp_path / "models")
    assert r.tables == ["s1.orders", "s2.orders"] and not r.has_model("orders") and r.has_model("orders", "s1")
    with pytest.raises(KeyError, match="name the schema"):
        r.resolve("orders")
    got = r.estimate("s1.orders", [Predicate("a", "=", value=1)])
    assert 0 < got.cardinality < 10 and r.estimate("s1.orders", [Predicate("a", "=", value=1)]) is got
    g = QueryGraph.parse(spark, "SELECT * FROM orders WHERE a = 1")
    assert artifacts.estimate_request(r, g, "orders", lambda a: 13.0, "s2").used_model
    fallback = artifacts.estimate_request(r, g, ["orders", "other"], lambda a: 13.0)
    assert (fallback.used_model, fallback.cardinality, fallback.reason) == (False, 13.0, "request is not single-table")
    run = artifacts.RunContext.create(tmp_path, "r1")
    with pytest.raises(FileExistsError):
        artifacts.RunContext.create(tmp_path, "r1")
    with pytest.raises(ValueError):
        artifacts.RunContext.create(tmp_path, "../r1")
    assert json.loads(run.write_manifest(["--password", "x", "--dsn=y", "--k", "v"]).read_text())["argv"] == ["--password", "***", "--dsn=***", "--k", "v"]


def test_registered_models_are_the_operator_s_own(spark):
    e = model_queries._estimator(spark, SMALL, "part")
    assert (e.samples, e.model.embedding, e.model.hidden) == (8000, 16, (64, 64))
    single = {n for n, s in STATEMENTS.items() if len(QueryGraph.parse(spark, s).relations) == 1}
    rows = model_queries.made_estimates(spark, SMALL).collect()
    assert len(single) == 6 and sorted(r["query_id"] for r in rows) == sorted(single)
    rows = model_queries.seed_sensitivity(spark, SMALL).collect()
    assert len(rows) == 50 and len({r["query_id"] for r in rows}) == 10 and {r["inference_mode"] for r in rows} == {"progressive_sampling"}
    assert {(r["rank"], r["seed"]) for r in rows} == {(k, s) for k in range(1, 11) for s in range(123, 128)}


def test_join_choice_covers_every_joined_statement(spark):
    rows = model_queries.catalyst_join_choice(spark, SMALL).collect()
    assert sorted(r["query_id"] for r in rows) == ["customer_orders", "customer_orders_lineitem", "lineitem_part_supplier", "region_to_lineitem"]
    assert all(r["native_first_join"] and r["exact_first_join"] and r["native_output"] is not None for r in rows)
