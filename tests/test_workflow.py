import json

import pytest

from cardscope import cli
from cardscope.operators import runtime
from cardscope.plans import catalogue, treatments
from cardscope.plans.native import Catalog
from cardscope.plans.requests import QueryGraph
from cardscope.plans.seed_workload import STATEMENTS
from cardscope.sources import artifacts, workload_files
from cardscope.sources.tables import table

SMALL = "/root/testdata/sf0.001"


def test_workload_files_by_line_number(spark, tmp_path):
    p = tmp_path / "My work.sql"
    lines = ["12||SELECT COUNT(*) FROM users u", "", "SELECT COUNT(*) FROM tags t||7", "  ", "SELECT COUNT(*) FROM users u WHERE u.x='a||b'||9||3.5"]
    p.write_text("\n".join(lines) + "\n")
    templates = spark.createDataFrame([("T1", None, "7"), ("T2", "my_work_00005", "9"), ("", "my_work_00001", None)], "template string, label string, query_id string")
    rows = {r["line_number"]: r.asDict() for r in workload_files.load_workload(spark, str(p), templates=templates).collect()}
    assert {n: (r["label"], r["query_id"], r["actual_cardinality"], r["template"]) for n, r in rows.items()} == {1: ("my_work_00001", "my_work_00001", 12.0, "workload"), 3: ("my_work_00003", "7", None, "T1"), 5: ("my_work_00005", "9", 3.5, "T2")}
    assert rows[5]["sql"] == "SELECT COUNT(*) FROM users u WHERE u.x='a||b'"
    many = tmp_path / "many.txt"
    many.write_text("".join(f"{i}||SELECT {i}\n" for i in range(1, 3001)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        got = workload_files.load_workload(spark, str(many), "complete", "p").select("line_number", "actual_cardinality").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == 3000 and all(r["line_number"] == r["actual_cardinality"] for r in got)
    (tmp_path / "empty.txt").write_text("\n \n")
    with pytest.raises(ValueError, match="no query"):
        workload_files.load_workload(spark, str(tmp_path / "empty.txt"))
    (tmp_path / "bad.txt").write_text("SELECT 1\n")
    with pytest.raises(Exception, match="line 1 is not of its format"):
        workload_files.load_workload(spark, str(tmp_path / "bad.txt")).collect()
    with pytest.raises(ValueError, match="unknown format"):
        workload_files.load_workload(spark, str(p), "xml")


def test_all_tables_of_a_folder_are_trained_or_say_why_not(spark, tmp_path):
    data = tmp_path / "s"
    for n, sql in {"a": "SELECT id % 3 AS x, concat('v', id % 2) AS y FROM range(300)", "b": "SELECT array(1) AS z FROM range(3)", "c": "SELECT id AS k FROM range(0)", "d": "SELECT id FROM range(9)"}.items():
        spark.sql(sql).write.parquet(str(data / f"{n}.parquet"))
    names = catalogue.schema_tables(spark, str(data))
    assert names == ["s.a", "s.b", "s.c", "s.d"] and catalogue.resolve(names, "a") == "s.a"
    with pytest.raises(KeyError, match="no table"):
        catalogue.resolve(names, "nope")
    rows = {r["table"]: r for r in catalogue.train_all(spark, str(data), tmp_path / "m", skip=["d"], epochs=2).collect()}
    assert {t: r["status"] for t, r in rows.items()} == {"s.a": "trained", "s.b": "failed", "s.c": "failed"}
    assert rows["s.a"]["rows"] == 300 and artifacts.Registry.load(tmp_path / "m").tables == ["s.a"]
    few = catalogue.train_all(spark, str(data), tmp_path / "few", only=["a"], max_rows=50, epochs=1).first()
    assert (few["rows"], few["status"]) == (300, "trained")
    assert catalogue.training_rows(spark.range(100), 7).collect() == catalogue.training_rows(spark.range(100).repartition(5), 7).collect()
    assert catalogue.kept("s.a", only=["a"]) and not catalogue.kept("s.a", only=["s.b"])


def test_timed_runs_record_timeouts_and_errors(spark, monkeypatch):
    graphs = {"q": QueryGraph.parse(spark, STATEMENTS["customer_orders"])}
    rows = treatments.timed_runs(spark, SMALL, graphs, {("q", "learned_base"): {"o": 10.0}}, warmups=1, repetitions=2).collect()
    assert [(r["repetition"], r["configuration"], r["warmup"]) for r in rows] == [(-1, "learned_base", True), (-1, "native", True), (0, "native", False), (0, "learned_base", False), (1, "learned_base", False), (1, "native", False)]
    assert {r["status"] for r in rows} == {"ok"} and len({r["actual_rows"] for r in rows}) == 1 and all(r["execution_time_ms"] < r["wall_clock_duration_ms"] for r in rows)
    late = treatments.timed_runs(spark, SMALL, graphs, {}, ("native",), warmups=0, repetitions=1, timeout_seconds=0.001).first()
    assert late["timeout"] and late["status"] == "timeout"
    summary = runtime.per_query(spark.createDataFrame(rows, treatments.RUN_SCHEMA)).first()
    assert summary["status"] == "complete" and summary["valid_measured_repetitions"] == 4

    def broken(self):
        raise RuntimeError("no such luck\nmore")

    monkeypatch.setattr(treatments.Statement, "executed", broken)
    bad = treatments.timed_runs(spark, SMALL, graphs, {}, ("native",), warmups=0, repetitions=1).first()
    assert (bad["status"], bad["reason"], bad["timeout"]) == ("error", "no such luck", False)
    with pytest.raises(ValueError):
        treatments.schedule(spark, ["q"], ("native",), 0, 0)
    missing = spark.createDataFrame([(1, None, None, False, 60.0, "ok", False)], "measurement_id bigint, execution_time_ms double, wall_clock_duration_ms double, timeout boolean, timeout_seconds double, status string, warmup boolean")
    assert runtime.measured(missing).first()["execution_ms"] is None
    with pytest.raises(Exception, match="no execution_time_ms in measurement 1"):
        runtime.measured(missing, strict=True).collect()


def test_treatments_go_on_after_a_failure(spark):
    good, bad = QueryGraph.parse(spark, STATEMENTS["customer_orders"]), QueryGraph.parse(spark, "SELECT COUNT(*) FROM customer c, orders o WHERE c.c_custkey=o.o_custkey AND c.nope=1")
    exact = {("good", "customer:c"): 10, ("good", "orders:o"): 20}
    got = treatments.treat(spark, SMALL, {"bad": bad, "good": good, "unknown": good}, {}, exact)
    assert [(r["query_id"], r["config"]) for r in got.rows] == [("good", "native"), ("good", "learned_base"), ("good", "exact_base"), ("unknown", "native"), ("unknown", "learned_base")]
    assert [(f[0], f[1]) for f in got.failures] == [("bad", "native"), ("unknown", "exact_base")]
    rows = {r["config"]: r for r in got.table(spark).where("query_id = 'good'").collect()}
    assert rows["exact_base"]["treatment_valid"] and rows["exact_base"]["hint"] == "/*=cards= Card(c #10) Card(o #20) */" and rows["native"]["hint"] == ""
    assert rows["learned_base"]["reasons"] == {"customer:c": "no model of customer", "orders:o": "no model of orders"} and rows["learned_base"]["base_estimates"] == rows["native"]["base_estimates"]
    assert rows["native"]["first_base_join"] == "customer:c|orders:o" and json.loads(rows["native"]["document"])["Plan"]
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("cs_")]


def test_executed_plans_are_documents_with_actual_rows(spark):
    from cardscope.plans import explain

    with Catalog(spark, SMALL) as c:
        s = c.statement(QueryGraph.parse(spark, STATEMENTS["lineitem_part_supplier"]))
        n, document = s.executed()
        assert n == s.data().count() and explain.metrics(document)["actual_rows"] == 1.0
        assert {x["relation_key"] for x in explain.scans(document)} == {"lineitem:l", "part:p", "supplier:s"} and len(explain.base_join_keys(document)) == 1


def test_diagnostics_and_command_line(spark, tmp_path, capsys):
    df = spark.createDataFrame([("a/b", 1.0), (None, 2.0)], "occurrence_id string, x double")
    rows = artifacts.write_diagnostics(df, str(tmp_path / "d")).collect()
    assert {r["x"]: spark.read.json(r["diagnostics_path"]).first()["x"] for r in rows} == {1.0: 1.0, 2.0: 2.0}
    assert artifacts.write_plan(tmp_path / "p.json", '{"Plan":{"a":1}}').read_text() == '{\n  "Plan": {\n    "a": 1\n  }\n}\n'
    assert artifacts.write_sql(tmp_path / "q.sql", " SELECT 1 ; ;\n").read_text() == "SELECT 1;\n"
    with pytest.raises(ValueError):
        artifacts.write_plan(tmp_path / "p.json", "{")
    with pytest.raises(FileNotFoundError):
        artifacts.Registry.load(tmp_path / "none", required=True)
    assert cli.main(["list"]) == 0 and "p5_found" in capsys.readouterr().out
    assert cli.main(["query", "runtime_timeouts", SMALL, "--out", str(tmp_path / "q"), "--kind", "json"]) == 0
    assert spark.read.json(str(tmp_path / "q")).count() == table(spark, SMALL, "experiment_5_runtime").select("configuration").distinct().count()


def test_scans_scalars_and_keys(spark):
    from cardscope.operators.joinchoice import key_relations
    from cardscope.sources.tables import scalar, scan

    df = spark.range(20).withColumnRenamed("id", "a")
    assert scalar(scan(df, count_star=True)) == 20 and scalar(scan(df, ["a"], "a > 15", 2, True)) == 2 and scalar(df.where("false")) is None
    with pytest.raises(ValueError):
        scan(df, limit=-1)
    assert key_relations("a:x|b", ["b", "a:x"]) == ("a:x", "b")
    for bad in ("a", "a|b|c", "a|z"):
        with pytest.raises(ValueError):
            key_relations(bad, ["a", "b", "c"])
