"""Workloads as tables: formats, labels, normalised ids, base queries by relation, and exact counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardscope.plans.requests import QueryGraph
from cardscope.sources.workload_lines import trimmed

_MASK = r"'[^']*+'(?:'[^']*+')*+"
_BLANK = r"[\s\u00a0]"
# between apostrophes lies text; keywords are looked for in the pieces outside only
_JOIN = r"^\(*+\s*+\"?[A-Za-z_]\w*+\"?\.\"?[A-Za-z_]\w*+\"?\s*+=\s*+\"?[A-Za-z_]\w*+\"?\.\"?[A-Za-z_]\w*+\"?\s*+\)*+$"


_NUMBER = r"^[-+]?(?:(?:[0-9](?:_?[0-9])*+\.?(?:[0-9](?:_?[0-9])*+)?|\.[0-9](?:_?[0-9])*+)(?:[eE][-+]?[0-9]++)?|(?i:inf|infinity|nan))$"


def detect_format(line: Column) -> Column:
    """complete, single_table or subquery by the look of the fields between ||; null where none fits."""
    parts = F.transform(F.split(line, r"\|\|"), trimmed)
    number = lambda i: F.get(parts, F.lit(i)).rlike(_NUMBER)
    select = lambda i: F.lower(F.get(parts, F.lit(i))).startswith("select")
    return F.when(number(0) & select(1), "complete").when(select(0) & number(2), "single_table").when(select(0) & (F.size(parts) >= 2), "subquery")


def normalize_label(c: Column, default: str = "workload") -> Column:
    text = F.lower(F.regexp_replace(F.regexp_replace(F.trim(c), r"[^0-9A-Za-z]++", "_"), r"^_++|_++$", ""))
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(default))


def normalize_sql(sql: Column) -> Column:
    """Trimmed, without closing semicolons, in lower case, white space as single blanks."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(F.regexp_replace(sql, rf"^{_BLANK}++|{_BLANK}++$", ""), r";++$", "")), rf"{_BLANK}++", " "))


def normalized_sql_id(sql: Column) -> Column:
    return F.sha2(normalize_sql(sql), 256)


def label(prefix: Column, line_number: Column) -> Column:
    return F.concat_ws("_", normalize_label(prefix), F.lpad(line_number.cast("string"), 5, "0"))


def with_template(workload: DataFrame, templates: DataFrame, default: str = "workload") -> DataFrame:
    """workload with `template` from a map (template, label, query_id): by label, else by query id, else the default.

    Of several templates for a key the greatest stands. The map may be of any size; its rows are joined by key."""
    rows = templates.where("template is not null and template <> ''")
    by = {c: rows.where(F.col(c).isNotNull() & (F.col(c) != "")).groupBy(c).agg(F.max("template").alias(f"__{c}")) for c in ("label", "query_id")}
    out = workload.drop("template").join(by["label"], "label", "left").join(by["query_id"], "query_id", "left")
    return out.withColumn("template", F.coalesce("__label", "__query_id", F.lit(default))).drop("__label", "__query_id")


def statement_parts(df: DataFrame, sql: str) -> DataFrame:
    """df with `relations` (array of table, alias) and `conditions` (array of text) of conjunctive COUNT or SELECT *
    statements. Text values may hold anything: they are hidden while the statement is cut."""
    text = F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(F.col(sql), rf"{_BLANK}++", " ")), r"[; ]++$", ""), '"', "")
    df = df.withColumn("__values", F.regexp_extract_all(F.col(sql), F.lit(_MASK), 0)).withColumn("__text", text)
    # the i-th text value stands as §i§ until the pieces are put together again
    pieces = F.split(F.regexp_replace("__text", _MASK, "\u0001"), "\u0001")
    marked = F.array_join(F.transform(pieces, lambda p, i: F.when(i < F.size(pieces) - 1, F.concat(p, F.lit("§"), i.cast("string"), F.lit("§"))).otherwise(p)), "")
    df = df.withColumn("__marked", marked)
    shape = r"(?i)^select .*?\bfrom (.*?)(?: where (.*))?$"
    cut = F.transform(F.split(F.regexp_extract("__marked", shape, 1), ","), lambda r: F.split(F.regexp_replace(F.trim(r), r"(?i)\s+as\s+", " "), " +"))
    relations = F.transform(cut, lambda r: F.struct(F.get(r, F.lit(0)).alias("table"), F.coalesce(F.get(r, F.lit(1)), F.get(r, F.lit(0))).alias("alias")))
    where = F.regexp_extract("__marked", shape, 2)
    conditions = F.filter(F.split(where, r"(?i)\s+and\s+"), lambda c: F.trim(c) != "")
    bare = F.transform(conditions, lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), r"^[( ]++", ""), r"[) ]++$", "")))
    number = lambda c: F.regexp_extract(c, "§([0-9]+)§", 1).try_cast("int")
    whole = F.transform(bare, lambda c: F.when(number(c).isNotNull(), F.replace(c, F.concat(F.lit("§"), number(c).cast("string"), F.lit("§")), F.get("__values", number(c)))).otherwise(c))
    return df.withColumns({"relations": relations, "conditions": whole}).drop("__values", "__text", "__marked")


def derive_base_queries(workload: DataFrame, sql: str = "sql", keep: tuple[str, ...] = ("label", "query_id", "template")) -> DataFrame:
    """One row per statement and relation, filtered or not: occurrence id, table, alias, key, filter, and the base query with
    its normalised form and id. Relations come in the order of their keys; a join condition is no filter."""
    parts = statement_parts(workload, sql).select(*keep, "conditions", F.explode("relations").alias("r"))
    table, alias = F.col("r.table"), F.col("r.alias")
    own = F.filter("conditions", lambda c: ~c.rlike(_JOIN) & (F.lower(F.regexp_extract(c, r"^([A-Za-z_]\w*)\.", 1)) == F.lower(alias)))
    rows = parts.withColumns({"table_name": table, "table_alias": alias, "table_key": F.concat_ws(":", table, alias), "predicate_text": F.array_join(own, " AND ")})
    rows = rows.withColumn("is_filtered", F.col("predicate_text") != "")
    query = F.concat(F.lit("SELECT * FROM "), table, F.lit(" AS "), alias, F.when(F.col("is_filtered"), F.concat(F.lit(" WHERE "), F.col("predicate_text"))).otherwise(""))
    rows = rows.withColumn("base_sql", query).withColumn("normalized_sql", normalize_sql(F.col("base_sql")))
    return rows.select(
        F.concat(F.col(keep[0]), F.lit("__"), F.replace("table_key", F.lit(":"), F.lit("_"))).alias("occurrence_id"), *keep, "table_name", "table_alias", "table_key",
        "predicate_text", "is_filtered", "base_sql", "normalized_sql", F.sha2("normalized_sql", 256).alias("normalized_sql_id"),
    )


def join_count(conditions: Column) -> Column:
    return F.size(F.filter(conditions, lambda c: c.rlike(_JOIN)))


def select_workload(workload: DataFrame, only: str | None = None, limit: int | None = None) -> DataFrame:
    """The queries whose label, id or line number is among the comma-separated names, in line order, then at most `limit`."""
    if limit is not None and limit <= 0:
        raise ValueError("the limit must be positive")
    if only:
        names = [n.strip() for n in only.split(",") if n.strip()]
        hit = F.col("label").isin(names) | F.col("query_id").isin(names) | F.col("line_number").cast("string").isin(names)
        workload = workload.where(hit)
        if workload.isEmpty():
            raise ValueError(f"no query matches {only}")
    return workload.orderBy("line_number", "label").limit(limit) if limit else workload


def exact_base_counts(tables: dict[str, DataFrame], graphs: dict[str, QueryGraph]) -> DataFrame:
    """(query_id, relation, exact_cardinality, table_cardinality) of the filtered relations of many statements: one scan
    per table counts all of its filters at once. Equal filters of a table are counted once."""
    wanted: dict[str, dict[str, list[tuple[str, str]]]] = {}
    for name, g in graphs.items():
        for r in g.relations:
            parts = [c.sql.replace(f"{r.alias}.", "") if len(g.relations) > 1 or r.alias != r.table else c.sql for c in g.filters(r.alias)]
            wanted.setdefault(r.table, {}).setdefault(" AND ".join(parts) or "true", []).append((name, r.key))
    out: list[DataFrame] = []
    for table, filters in wanted.items():
        aggs = [F.struct(F.array(*(F.struct(F.lit(q).alias("query_id"), F.lit(k).alias("relation")) for q, k in users)).alias("users"), F.count_if(F.expr(f)).alias("exact_cardinality"), F.count("*").alias("table_cardinality")).alias(f"c{i}") for i, (f, users) in enumerate(filters.items())]
        one = tables[table].agg(*aggs).select(F.explode(F.array(*(f"c{i}" for i in range(len(aggs))))).alias("c"))
        out.append(one.select(F.explode("c.users").alias("u"), "c.exact_cardinality", "c.table_cardinality").select("u.*", "exact_cardinality", "table_cardinality"))
    return reduce(DataFrame.unionByName, out)


def fragment_counts(spark: SparkSession, graphs: dict[str, QueryGraph], tables: dict[str, DataFrame], base: bool = False, sizes: tuple[int, ...] = ()) -> DataFrame:
    """(query_id, relations, cardinality) of every connected set of relations of the statements, with its filters and joins;
    without `base` only sets of two or more, with `sizes` only sets of so many."""
    out = []
    for name, g in graphs.items():
        keys = {r.alias: r.key for r in g.relations}
        for some in g.fragments():
            if len(some) in sizes if sizes else base or len(some) > 1:
                key = "|".join(sorted(keys[a] for a in some))
                out.append(g.data(spark, tables, some).agg(F.lit(name).alias("query_id"), F.lit(key).alias("relations"), F.count("*").alias("cardinality")))
    return reduce(DataFrame.unionByName, out)


class ExactCounts:
    """Exact counts of statements' parts, remembered by what they count: the first answer is executed, later ones cached."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame]) -> None:
        self.spark, self.tables, self.known = spark, tables, {}

    def count(self, graph: QueryGraph, aliases: frozenset[str]) -> tuple[int, str]:
        chosen = sorted((r.table, r.alias) for r in graph.relations if r.alias in aliases)
        key = (tuple(chosen), tuple(sorted(c.sql for c in graph.conjuncts if set(c.aliases) <= aliases)))
        if key in self.known:
            return self.known[key], "cached"
        self.known[key] = graph.data(self.spark, self.tables, aliases).count()
        return self.known[key], "executed"
