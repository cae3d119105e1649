"""Estimates of Spark's own cost-based optimizer, injected cardinalities, and the joins Spark chooses by them.

Each relation of a statement gets its own catalog table over the same files, so that aliases stay apart and statistics
can be changed for one statement alone. Histograms are collected for filter columns only: join estimates ignore injected
row counts on columns that have one.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark import __version__ as spark_version
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardscope.plans import explain
from cardscope.plans.requests import QueryGraph

SETTINGS = {
    "spark.sql.cbo.enabled": "true", "spark.sql.cbo.joinReorder.enabled": "true", "spark.sql.cbo.planStats.enabled": "true",
    "spark.sql.statistics.histogram.enabled": "true", "spark.sql.parquet.inferTimestampNTZ.enabled": "false", "spark.sql.adaptive.enabled": "false",
}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def row_estimate(df: DataFrame) -> float | None:
    """The optimizer's row estimate of a plan; None when it has only a size."""
    rows = df._jdf.queryExecution().optimizedPlan().stats().rowCount()
    return float(str(rows.get())) if rows.isDefined() else None


@dataclass
class Catalog:
    """Catalog tables over the Parquet tables of a folder, analysed once; use as a context, which drops them again."""

    spark: SparkSession
    folder: str
    prefix: str = field(default_factory=lambda: f"cs_{uuid.uuid4().hex[:8]}")
    made: list[str] = field(default_factory=list)
    facts: dict[str, object] = field(default_factory=dict)

    def __enter__(self) -> Catalog:
        self._keep = settings(self.spark, SETTINGS)
        self._keep.__enter__()
        return self

    def __exit__(self, *problem) -> None:
        try:
            for t in self.made:
                self.spark.sql(f"DROP TABLE IF EXISTS {t}")
        finally:
            self._keep.__exit__(*problem)

    def _create(self, name: str, table: str) -> None:
        path = f"{self.folder}/{table}.parquet"
        self.spark.sql(f"CREATE TABLE {name} USING parquet LOCATION '{path}'")
        self.made.append(name)

    def _session_catalog(self):
        return self.spark._jsparkSession.sessionState().catalog()

    def _identifier(self, name: str):
        return self.spark._jsparkSession.sessionState().sqlParser().parseTableIdentifier(name)

    def analysed(self, table: str, keys: set[str]) -> object:
        """The catalog statistics of a table: rows, and column statistics with histograms except on join keys."""
        if table not in self.facts:
            name = f"{self.prefix}_{table}"
            self._create(name, table)
            columns = [c for c, t in self.spark.table(name).dtypes if t in ("int", "bigint", "double", "string", "timestamp", "date", "float", "smallint", "boolean")]
            plain = [c for c in columns if c not in keys]
            self.spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS")
            if plain:
                self.spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS FOR COLUMNS {', '.join(plain)}")
            if linked := [c for c in columns if c in keys]:
                with settings(self.spark, {"spark.sql.statistics.histogram.enabled": "false"}):
                    self.spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS FOR COLUMNS {', '.join(linked)}")
            self.facts[table] = self._session_catalog().getTableMetadata(self._identifier(name)).stats().get()
        return self.facts[table]

    def statement(self, graph: QueryGraph) -> Statement:
        """The statement over own clones of its relations' tables."""
        keys = {k.partition(".")[2] for c in graph.joins() for k in c.join}
        clones = {}
        for r in graph.relations:
            stats = self.analysed(r.table, keys)
            clone = f"{self.prefix}_{len(self.made)}_{re.sub(r'[^0-9A-Za-z_]', '_', r.alias)}"
            self._create(clone, r.table)
            self._store(clone, stats)
            clones[r.alias] = clone
        return Statement(self, graph, clones)

    def _store(self, name: str, stats) -> None:
        jvm = self.spark.sparkContext._jvm
        self._session_catalog().alterTableStats(self._identifier(name), jvm.scala.Option.apply(stats))
        self.spark.catalog.refreshTable(name)

    def inject(self, clone: str, table: str, rows: int) -> None:
        """Sets the row count of a clone; its column statistics stay those of the table."""
        if spark_version.split(".")[0] != "4":
            raise RuntimeError(f"injection sets a field of Spark 4's catalog statistics; this is Spark {spark_version}")
        stats = self.facts[table]
        # Python cannot hand a big integer over, but a range of that length has one in its statistics
        big = self.spark.range(max(rows, 1))._jdf.queryExecution().optimizedPlan().stats().rowCount()
        copy = self.spark.sparkContext._jvm.org.apache.commons.lang3.SerializationUtils.clone(stats)
        f = copy.getClass().getDeclaredField("rowCount")
        f.setAccessible(True)
        f.set(copy, big)
        self._store(clone, copy)


@dataclass
class Statement:
    catalog: Catalog
    graph: QueryGraph
    clones: dict[str, str]

    def data(self, aliases: frozenset[str] | None = None) -> DataFrame:
        tables = {}
        for r in self.graph.relations:
            tables[r.alias] = self.catalog.spark.table(self.clones[r.alias])
        renamed = QueryGraph(self.graph.sql, [type(r)(r.alias, r.alias) for r in self.graph.relations], self.graph.conjuncts)
        return renamed.data(self.catalog.spark, tables, aliases)

    def base_estimate(self, alias: str) -> float:
        """The optimizer's estimate of a relation after its own filters."""
        return row_estimate(self.data(frozenset((alias,)))) or 0.0

    def inject(self, targets: dict[str, float]) -> dict[str, float]:
        """Makes the optimizer expect these rows of relations after their filters, at least 1 each; returns what it then
        expects. A filter it believes to select nothing cannot be scaled and is left as it is."""
        out = {}
        tables = {r.alias: r.table for r in self.graph.relations}
        for alias, wanted in targets.items():
            wanted = max(float(wanted), 1.0)
            rows = float(str(self.catalog.facts[tables[alias]].rowCount().get()))
            native = self.base_estimate(alias)
            if native > 0 and rows > 0:
                self.catalog.inject(self.clones[alias], tables[alias], round(wanted * rows / native))
            out[alias] = self.base_estimate(alias)
        return out

    def restore(self) -> None:
        for r in self.graph.relations:
            self.catalog._store(self.clones[r.alias], self.catalog.facts[r.table])

    def final_estimate(self) -> float:
        """The optimizer's estimate of the rows of the whole statement, before its count."""
        return row_estimate(self.data()) or 0.0

    def document(self, df: DataFrame | None = None) -> str:
        """The optimised plan as an EXPLAIN document: nodes with their estimated rows, scans with relation and alias."""
        return json.dumps({"Plan": self._node((df or self.data())._jdf.queryExecution().optimizedPlan())})

    def executed(self) -> tuple[int, str]:
        """The statement's count, and the physical plan that made it as an EXPLAIN document with actual rows and times."""
        counted = self.data().agg(F.count("*").alias("n"))
        began = time.perf_counter()
        plan = counted._jdf.queryExecution().executedPlan()
        planned = time.perf_counter()
        n = counted.collect()[0]["n"]
        done = time.perf_counter()
        return n, json.dumps({"Plan": self._node(plan), "Planning Time": 1000 * (planned - began), "Execution Time": 1000 * (done - planned)})

    def _node(self, plan) -> dict:
        kind = plan.nodeName().partition(" (")[0].strip()
        kids = plan.children()
        below = [kids.apply(i) for i in range(kids.size())]
        if kind in ("WholeStageCodegen", "InputAdapter"):  # how a stage is compiled, numbered anew in every plan
            return self._node(below[0])
        out: dict = {"Node Type": kind.split(" ")[0]}
        of_java = plan.getClass().getSimpleName()
        if hasattr(plan, "stats") and of_java != "AdaptiveSparkPlanExec" and not of_java.endswith("Exec"):
            rows = plan.stats().rowCount()
            out["Plan Rows"] = float(str(rows.get())) if rows.isDefined() else None
        else:
            metric = plan.metrics().get("numOutputRows")
            out["Actual Rows"] = int(metric.get().value()) if metric.isDefined() else None
        if "Join" in of_java:
            out["Join Type"] = plan.joinType().toString()
        name = None
        if of_java == "LogicalRelation" and plan.catalogTable().isDefined():
            name = plan.catalogTable().get().identifier().table()
        elif of_java == "FileSourceScanExec" and plan.tableIdentifier().isDefined():
            name = plan.tableIdentifier().get().table()
        if name is not None:
            alias = next(a for a, c in self.clones.items() if c.lower() == name.lower())
            out |= {"Relation Name": next(r.table for r in self.graph.relations if r.alias == alias), "Alias": alias}
        if below:
            out["Plans"] = [self._node(c) for c in below]
        return out

    def joins(self) -> list[dict]:
        """The joins of the optimised plan, inner ones first, with the relations below each branch."""
        return explain.joins(self.document())

    def first_base_join(self) -> str | None:
        return next((j["base_join_key"] for j in self.joins() if j["is_base_join"]), None)


def roundtrip_ok(wanted: float, got: float) -> bool:
    return abs(max(wanted, 1.0) - got) <= max(1.0, 1e-6 * wanted)
