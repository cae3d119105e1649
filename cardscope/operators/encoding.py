"""Per-column tokens: dictionaries for few or ordered values, quantile bins for many numbers, and predicates as token sets.

The encoder of a table is itself a small table of tokens (bounded by MAX_TOKENS a column), so rows are encoded by broadcast
joins and array expressions, and any number of predicates is turned into token sets by one join.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from cardscope.operators.exact_median import column_percentiles
from cardscope.session import cut_lineage

#: Numeric columns with more distinct values, null counting as one, get bins.
DICTIONARY_LIMIT, BIN_POINTS = 64, 64
#: A column that would need a larger dictionary is an error, or left out by intent.
MAX_TOKENS = 100_000
#: An estimated number of values beyond which a column has more than DICTIONARY_LIMIT for certain.
SKETCH_SURE = 1_000

KINDS = {"smallint": "integer", "int": "integer", "bigint": "integer", "tinyint": "integer", "float": "float", "double": "float", "string": "text", "boolean": "boolean", "date": "date", "timestamp": "timestamp", "timestamp_ntz": "timestamp"}
NUMERIC = ("integer", "numeric", "float")


def kind_of(data_type: T.DataType) -> str:
    """integer, numeric, float, text, boolean, date, timestamp or unknown."""
    name = data_type.simpleString()
    return "numeric" if name.startswith("decimal") else "text" if name.startswith(("char", "varchar")) else KINDS.get(name, "unknown")


def column_table(df: DataFrame, name: str) -> list[dict]:
    """Ordinal, name, type, kind, nullability and support of each column of a table."""
    return [{"table": name, "column": f.name, "type": f.dataType.simpleString(), "kind": kind_of(f.dataType), "ordinal": i, "nullable": f.nullable, "supported": kind_of(f.dataType) != "unknown"} for i, f in enumerate(df.schema, 1)]


def null_counts(df: DataFrame) -> DataFrame:
    """(column, nulls) of every column, by one aggregate."""
    names = df.columns
    each = F.array(*(F.struct(F.lit(n).alias("column"), F.col(f"n{i}").alias("nulls")) for i, n in enumerate(names)))
    return df.agg(*(F.count_if(F.col(n).isNull()).alias(f"n{i}") for i, n in enumerate(names))).select(F.explode(each).alias("c")).select("c.*")


def canonical(c: Column, kind: str) -> Column:
    """The text by which a value is compared and kept: numbers as doubles, times in ISO form, null as null."""
    if kind in NUMERIC:
        return c.cast("double").cast("string")
    if kind == "date":
        return F.date_format(c, "yyyy-MM-dd")
    if kind == "timestamp":
        whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        return F.when(F.date_format(c, "SSSSSS") == "000000", whole).otherwise(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    return c.cast("string")


def _supported(df: DataFrame, columns: list[str] | None = None) -> list[tuple[str, str]]:
    return [(f.name, kind_of(f.dataType)) for f in df.schema if kind_of(f.dataType) != "unknown" and (columns is None or f.name in columns)]


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, kind, value, num, rows): the distinct values of all supported columns by one pass and one shuffle, combined
    map-side; a number travels as a double alone."""
    known = _supported(df, columns)
    cells = F.array(*(
        F.struct(F.lit(i).cast("smallint").alias("i"), (F.col(n).cast("double") if k in NUMERIC else F.lit(None).cast("double")).alias("num"), (F.lit(None).cast("string") if k in NUMERIC else canonical(F.col(n), k)).alias("text"))
        for i, (n, k) in enumerate(known)
    ))
    counts = df.select(F.explode(cells).alias("c")).select("c.*").groupBy("i", "num", "text").agg(F.count("*").alias("rows"))
    pick = lambda values: F.element_at(F.array(*(F.lit(v) for v in values)), F.col("i") + 1)
    return counts.select(pick([n for n, _ in known]).alias("column"), pick([k for _, k in known]).alias("kind"), F.coalesce("text", F.col("num").cast("string")).alias("value"), "num", "rows")


def column_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Distinct values with null, nulls and rows of each supported column, and the encoding it gets. A report: all distinct values
    are counted exactly, and so shuffled once. `TableEncoder.fit` decides by `encodings`, which does not do that."""
    out = value_counts(df, columns).groupBy("column", "kind").agg(
        F.count("*").alias("distinct_with_null"), F.sum(F.when(F.col("value").isNull(), F.col("rows")).otherwise(0)).alias("nulls"), F.sum("rows").alias("rows"),
    )
    bins = F.col("kind").isin(*NUMERIC) & (F.col("distinct_with_null") > DICTIONARY_LIMIT)
    return out.withColumn("encoding", F.when(bins, "numeric_discretizer").otherwise("dictionary"))


def _sketched(df: DataFrame, columns: list[str]) -> tuple[int, dict[str, int]]:
    """Rows of a table and about how many values each column has, by one aggregate of sketches.

    A sketch tells for certain that there are more than DICTIONARY_LIMIT values: so few touch as many of its 512 registers at
    most, which makes an estimate of 68 at most. So one beyond SKETCH_SURE needs no exact count."""
    got = df.agg(F.count("*"), *(F.approx_count_distinct(c, 0.05) for c in columns)).first()
    return got[0], dict(zip(columns, got[1:]))


def dictionary_tokens(counts: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    """(column, token, value, num): dense ids of the sorted distinct values of dictionary columns: those that profile says, else
    all of counts. Numbers sort as numbers, other values as text; null comes last, as its own value. A column of more than
    MAX_TOKENS values is an error."""
    rows = counts if profile is None else counts.join(F.broadcast(profile.where("encoding = 'dictionary'").select("column")), "column")
    order = Window.partitionBy("column").orderBy(F.col("value").isNull(), "num", "value")
    many = F.raise_error(F.concat("column", F.lit(f" has more than {MAX_TOKENS} values"))).cast("int")
    token = F.when(F.col("token") < MAX_TOKENS, F.col("token")).otherwise(many)
    return rows.withColumn("token", F.row_number().over(order) - 1).select("column", token.alias("token"), "value", "num")


def quantile_edges(df: DataFrame, columns: list[str], points: int = BIN_POINTS, about: dict[str, int] | None = None) -> DataFrame:
    """(column, edges): the distinct linear quantiles at min(points, distinct values) even fractions. One edge v becomes
    [v, v + 1]; a column without numbers gets [0, 1]. Values that are not finite are left out.

    Columns of few values are counted by value; the others are never shuffled whole, their quantiles are selected. about: estimated
    numbers of values where they are known."""
    spark, schema = df.sparkSession, "column string, edges array<double>"
    if not columns:
        return spark.createDataFrame([], schema)
    double = {c: F.col(c).cast("double") for c in columns}
    numbers = df.select(*(F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x).alias(c) for c, x in double.items()))
    about = _sketched(numbers, columns)[1] if about is None else about
    wide = [c for c in columns if about[c] > max(SKETCH_SURE, 2 * points)]
    found: dict[str, list[float]] = {}
    if wide:
        found |= {r["column"]: list(r["values"]) for r in column_percentiles(numbers, wide, [i / (points - 1) for i in range(points)]).collect()}
    if few := [c for c in columns if c not in wide]:
        counted: dict[str, list[tuple[float, int]]] = {}
        for r in value_counts(numbers, few).where("num is not null").collect():  # at most about SKETCH_SURE values a column
            counted.setdefault(r["column"], []).append((r["num"], r["rows"]))
        for c, pairs in counted.items():
            values, rows = zip(*sorted(pairs))
            upto, number = np.cumsum(rows), min(points, max(len(values), 2))
            place = np.array([i / (number - 1) for i in range(number)]) * (upto[-1] - 1)
            low, high = (np.array(values)[np.searchsorted(upto, f(place), "right")] for f in (np.floor, np.ceil))
            found[c] = (low * (1 - (place - np.floor(place))) + high * (place - np.floor(place))).tolist()
    out = []
    for c in columns:
        edges = sorted(set(found.get(c, [])))
        out.append((c, [0.0, 1.0] if not edges else [edges[0], edges[0] + 1.0] if len(edges) == 1 else edges))
    return spark.createDataFrame(out, schema)


def row_bin(value: Column, edges: Column) -> Column:
    """The bin of a stored value: bins are closed on the right, the first also on the left; null and values outside get 0."""
    inside = (value >= F.element_at(edges, 1)) & (value <= F.element_at(edges, -1))
    return F.when(inside, F.greatest(F.size(F.filter(edges, lambda e: e < value)) - 1, F.lit(0))).otherwise(0)


def with_row_bins(df: DataFrame, bins: dict[str, tuple[str, list[float]]]) -> DataFrame:
    """df with `row_bin` of several columns, {result: (column of doubles, edges)}, by binary search in the JVM.

    Spark's bucketizer closes bins on the left; on mirrored values and edges that is the right. Null, NaN and values outside are
    put on the first edge, which is in bin 0."""
    if not bins:
        return df
    mirrored = {}
    for name, (c, edges) in bins.items():
        x = F.col(c)
        inside = (x >= edges[0]) & (x <= edges[-1]) & ~F.isnan(x)
        mirrored[f"__m_{name}"] = -F.when(inside, x).otherwise(edges[0])
    splits = [[-float("inf"), *(-e for e in reversed(edges[1:-1])), float("inf")] if len(edges) > 2 else [-float("inf"), 0.0, float("inf")] for _, edges in bins.values()]
    # the end bins are open outwards, so a table of two edges, one bin, is cut anywhere
    made = Bucketizer(inputCols=list(mirrored), outputCols=[f"__b_{n}" for n in bins], splitsArray=splits).transform(df.withColumns(mirrored))
    out = {n: (F.lit(len(edges) - 2) - F.col(f"__b_{n}").cast("int")) if len(edges) > 2 else F.lit(0) for n, (_, edges) in bins.items()}
    return made.withColumns(out).drop(*mirrored, *(f"__b_{n}" for n in bins))


def literal_bin(value: Column, edges: Column) -> Column:
    """The bin of a literal: bins are closed on the left; values outside are clamped to the end bins, null gets 0."""
    at = F.least(F.greatest(F.size(F.filter(edges, lambda e: e <= value)) - 1, F.lit(0)), F.size(edges) - 2)
    return F.when(value.isNull(), 0).otherwise(at)


@dataclass
class ColumnEncoder:
    """Metadata of one encoded column: either bin edges or the dictionary (values in token order, None for null)."""

    column: str
    kind: str
    edges: list[float] | None = None
    values: list[str | None] | None = None

    @property
    def domain_size(self) -> int:
        return max(1, len(self.edges) - 1) if self.edges is not None else len(self.values or [])

    @property
    def encoding(self) -> str:
        return "numeric_discretizer" if self.edges is not None else "dictionary"

    def to_dict(self) -> dict:
        return {"column": self.column, "kind": self.kind, "edges": self.edges, "values": self.values}  # a null value is a JSON null

    @classmethod
    def from_dict(cls, d: dict) -> ColumnEncoder:
        return cls(d["column"], d["kind"], d["edges"], d["values"])


@dataclass
class TableEncoder:
    """The encoders of a table's supported columns, its row count, and the columns left out with the reason."""

    table: str
    columns: list[ColumnEncoder]
    row_count: int
    skipped: dict[str, str] = field(default_factory=dict)

    @classmethod
    def fit(cls, df: DataFrame, table: str, columns: list[str] | None = None, oversize: str = "error") -> TableEncoder:
        """One pass of sketches, one that counts the values of columns that may get a dictionary, and the selection of quantiles;
        only dictionaries and edges, both bounded, are read to the driver. The row count is that of df. A column that needs a
        dictionary of more than MAX_TOKENS values is an error, or with oversize="skip" left out and named in `skipped`."""
        known = _supported(df, columns)
        if not known:
            raise ValueError(f"{table} has no column that can be encoded")
        rows, about = _sketched(df, [n for n, _ in known])
        wide = [n for n, k in known if k in NUMERIC and about[n] > SKETCH_SURE]
        large = [n for n, k in known if k not in NUMERIC and about[n] > 2 * MAX_TOKENS]
        words: dict[str, list[str | None]] = {}
        if counted := [n for n, _ in known if n not in wide and n not in large]:
            counts = cut_lineage(value_counts(df, counted))
            sizes = {r["column"]: r["count"] for r in counts.groupBy("column").count().collect()}
            wide += [n for n, k in known if k in NUMERIC and sizes.get(n, 0) > DICTIONARY_LIMIT]
            large += [n for n in counted if n not in wide and sizes.get(n, 0) > MAX_TOKENS]
            for r in dictionary_tokens(counts.where(~F.col("column").isin([*wide, *large]))).orderBy("column", "token").collect():
                words.setdefault(r["column"], []).append(r["value"])
        if large and oversize != "skip":
            raise ValueError(f"{table}: {', '.join(large)} would need a dictionary of more than {MAX_TOKENS} values")
        edges = {r["column"]: list(r["edges"]) for r in quantile_edges(df, wide, about=about).collect()}
        encoders, skipped = [], {f.name: "unsupported type" for f in df.schema if kind_of(f.dataType) == "unknown" and (columns is None or f.name in columns)}
        for name, kind in known:
            if name in edges:
                encoders.append(ColumnEncoder(name, kind, edges=edges[name]))
            elif name in large:
                skipped[name] = f"more than {MAX_TOKENS} values"
            else:
                encoders.append(ColumnEncoder(name, kind, values=words.get(name, [None])))
        return cls(table, encoders, int(rows), skipped)

    @property
    def domain_sizes(self) -> list[int]:
        return [e.domain_size for e in self.columns]

    def encoder_for(self, column: str) -> ColumnEncoder:
        for e in self.columns:
            if e.column == column:
                return e
        raise PredicateError(f"column {column!r} of {self.table} was not trained")

    def column_index(self, column: str) -> int:
        return self.columns.index(self.encoder_for(column))

    def encode(self, df: DataFrame) -> DataFrame:
        """df as integer token columns `t0, t1, …` in encoder order. A value missing from a dictionary is an error."""
        spark = df.sparkSession
        out = df.select(*((F.col(e.column).cast("double") if e.edges is not None else canonical(F.col(e.column), e.kind)).alias(f"v{i}") for i, e in enumerate(self.columns)))
        out = with_row_bins(out, {f"t{i}": (f"v{i}", e.edges) for i, e in enumerate(self.columns) if e.edges is not None})
        for i, e in enumerate(self.columns):
            if e.edges is None:
                words = spark.createDataFrame([(t, v) for t, v in enumerate(e.values or [])], f"t{i} int, w{i} string")
                out = out.join(F.broadcast(words), F.col(f"v{i}").eqNullSafe(F.col(f"w{i}")), "left")
        unseen = lambda i: F.coalesce(F.col(f"t{i}"), F.raise_error(F.concat(F.lit(f"{self.columns[i].column}: value without token "), F.coalesce(f"v{i}", F.lit("null")))).cast("int"))
        return out.select(*(F.col(f"t{i}") if e.edges is not None else unseen(i).alias(f"t{i}") for i, e in enumerate(self.columns)))

    def token_rows(self) -> list[tuple]:
        """(column, encoding, numeric, token, value, num, lo, hi, last) of every token."""
        out = []
        for e in self.columns:
            numeric = e.kind in NUMERIC
            if e.edges is not None:
                pairs = list(zip(e.edges, e.edges[1:]))
                out += [(e.column, "bins", numeric, t, None, None, lo, hi, t == len(pairs) - 1) for t, (lo, hi) in enumerate(pairs)]
            else:
                out += [(e.column, "dictionary", numeric, t, v, float(v) if numeric and v is not None else None, None, None, False) for t, v in enumerate(e.values or [])]
        return out

    def tokens(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.token_rows(), TOKEN_SCHEMA)

    def allowed(self, predicates: list[Predicate]) -> dict[int, list[int]]:
        """Token sets by column index: predicates on a column are intersected, other columns have their whole domain."""
        sets: dict[int, set[int]] = {}
        for p in predicates:
            i = self.column_index(p.column)
            got = set(allowed_ids(self.columns[i], p))
            sets[i] = got if i not in sets else sets[i] & got
        return {i: sorted(sets[i]) if i in sets else list(range(e.domain_size)) for i, e in enumerate(self.columns)}

    def to_json(self) -> str:
        return json.dumps({"table": self.table, "row_count": self.row_count, "skipped": self.skipped, "columns": [e.to_dict() for e in self.columns]}, sort_keys=True, allow_nan=False)

    @classmethod
    def from_json(cls, text: str) -> TableEncoder:
        d = json.loads(text)
        return cls(d["table"], [ColumnEncoder.from_dict(c) for c in d["columns"]], d["row_count"], d["skipped"])


class PredicateError(ValueError):
    """A predicate that the encoder of its table cannot express."""


TOKEN_SCHEMA = "column string, encoding string, numeric boolean, token int, value string, num double, lo double, hi double, last boolean"
PREDICATE_SCHEMA = "query_id string, predicate_id int, column string, op string, value string, lower string, upper string, values array<string>"


@dataclass(frozen=True)
class Predicate:
    """One conjunct on one column: op is one of = < <= > >= between in; literals as given."""

    column: str
    op: str
    value: object = None
    lower: object = None
    upper: object = None
    values: tuple = ()


def literal_text(v: object) -> str | None:
    """A literal as `canonical` writes values, so far as its own type tells."""
    if v is None:
        return None
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (int, float)):
        return repr(float(v))
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return str(v)


def allowed_ids(e: ColumnEncoder, p: Predicate) -> list[int]:
    """The tokens of a column that a predicate selects; the same rules as `allowed_tokens`, for one request."""
    if p.op not in ("=", "<", "<=", ">", ">=", "between", "in"):
        raise PredicateError(f"unsupported operator: {p.op}")
    low, high = (p.lower, p.upper) if p.op == "between" else (p.value if p.op in (">", ">=") else None, p.value if p.op in ("<", "<=") else None)
    if e.edges is not None:
        number = lambda v: None if v is None else float(v)

        def bin_of(v: object) -> int:
            x = number(v)
            return 0 if x is None else max(0, min(sum(b <= x for b in e.edges) - 1, len(e.edges) - 2))

        if p.op in ("=", "in"):
            return sorted({bin_of(v) for v in (p.values if p.op == "in" else (p.value,))})
        lo, hi = number(low), number(high)
        pairs = list(zip(e.edges, e.edges[1:]))
        keep = [i for i, (a, b) in enumerate(pairs) if (lo is None or (b > lo if p.op == ">" else b >= lo)) and (hi is None or (a < hi if p.op == "<" else a <= hi))]
        return keep or [0]
    as_key = (lambda v: None if v is None else float(v)) if e.kind in NUMERIC else (lambda v: None if v is None else _time_text(literal_text(v), e.kind))
    words = [as_key(v) for v in e.values or []]
    if p.op in ("=", "in"):
        wanted = {as_key(v) for v in (p.values if p.op == "in" else (p.value,))}
        return [i for i, w in enumerate(words) if w in wanted]
    lo, hi = as_key(low), as_key(high)
    fits = lambda w: w is not None and (lo is None or (w > lo if p.op == ">" else w >= lo)) and (hi is None or (w < hi if p.op == "<" else w <= hi))
    return [i for i, w in enumerate(words) if fits(w)]


def _time_text(text: str, kind: str) -> str:
    return text.replace(" ", "T", 1) if kind == "timestamp" else text


def predicate_row(query_id: str, predicate_id: int, p: Predicate) -> tuple:
    return (query_id, predicate_id, p.column, p.op, literal_text(p.value), literal_text(p.lower), literal_text(p.upper), [literal_text(v) for v in p.values])


def allowed_tokens(tokens: DataFrame, predicates: DataFrame) -> DataFrame:
    """(query_id, predicate_id, column, token): the tokens each predicate selects, for any number of predicates.

    tokens: as TableEncoder.tokens (bounded, broadcast); predicates: PREDICATE_SCHEMA. In a dictionary, ranges skip null and
    `= null` finds it. In bins, equality selects the whole bin of the literal, a range every bin it touches, and a range
    that touches none selects bin 0. A predicate on a column without tokens selects nothing.
    """
    t = tokens.withColumnsRenamed({"value": "t_value", "column": "t_column"})
    words, bins = t.where("encoding = 'dictionary'"), t.where("encoding = 'bins'")
    number = lambda c: F.col(c).try_cast("double")
    op = F.col("op")
    out = ["query_id", "predicate_id", "column", "token"]

    # equality and IN meet their words by an equi-join
    wanted = F.when(op == "=", F.array("value")).when(op == "in", F.col("values"))
    points = predicates.where(op.isin("=", "in")).select(*out[:3], F.explode(F.array_distinct(wanted)).alias("w"))
    same = F.when(F.col("numeric"), F.col("num").eqNullSafe(number("w"))).otherwise(F.col("t_value").eqNullSafe(F.col("w")))
    key = F.when(F.col("numeric"), F.col("num").cast("string")).otherwise(F.col("t_value"))
    texts, numbers = words.where("not numeric").withColumn("k", key), words.where("numeric").withColumn("k", key)
    on = lambda w: (F.col("column") == F.col("t_column")) & F.col("k").eqNullSafe(w)
    found = points.join(F.broadcast(texts), on(F.col("w"))).where(same).select(*out)
    found = found.unionByName(points.join(F.broadcast(numbers), on((number("w") + 0.0).cast("string"))).where(same).select(*out)).distinct()

    # a range of words is compared with the words of its column; what it does not select is left in the join
    def between(x: Column, v: Column, lo: Column, hi: Column) -> Column:
        return F.when(op == "<", x < v).when(op == "<=", x <= v).when(op == ">", x > v).when(op == ">=", x >= v).when(op == "between", (x >= lo) & (x <= hi))

    by_number = between(F.col("num"), number("value"), number("lower"), number("upper"))
    by_text = between(F.col("t_value"), F.col("value"), F.col("lower"), F.col("upper"))
    ranges = predicates.where(~op.isin("=", "in"))
    inside = (F.col("column") == F.col("t_column")) & F.coalesce(F.when(F.col("numeric"), by_number).otherwise(by_text), F.lit(False))
    found = found.unionByName(ranges.join(F.broadcast(words), inside).select(*out))

    # bins, of which a column has fewer than BIN_POINTS
    a, b, first = F.col("lo"), F.col("hi"), F.col("token") == 0

    def holds(v: Column) -> Column:
        return F.when(v.isNull(), first).otherwise(((v >= a) | first) & ((v < b) | F.col("last")))

    v, lo, hi = number("value"), number("lower"), number("upper")
    binned = (
        F.when(op == "=", holds(v)).when(op == "<", a < v).when(op == "<=", a <= v).when(op == ">", b > v).when(op == ">=", b >= v)
        .when(op == "between", (b >= lo) & (a <= hi)).when(op == "in", F.exists("values", lambda s: holds(s.try_cast("double"))))
    )
    rows = predicates.join(F.broadcast(bins), F.col("column") == F.col("t_column")).withColumn("hit", F.coalesce(binned, F.lit(False)))
    none = F.max(F.col("hit").cast("int")).over(Window.partitionBy("query_id", "predicate_id", "column")) == 0
    rows = rows.withColumn("none", none)
    empty_range = F.col("none") & first & op.isin("<", "<=", ">", ">=", "between")
    return found.unionByName(rows.where(F.col("hit") | empty_range).select(*out))


def intersected(allowed: DataFrame, predicates: DataFrame) -> DataFrame:
    """(query_id, column, token): tokens that every predicate of a query on that column selects."""
    number = predicates.groupBy("query_id", "column").agg(F.countDistinct("predicate_id").alias("wanted"))
    got = allowed.groupBy("query_id", "column", "token").agg(F.countDistinct("predicate_id").alias("got"))
    return got.join(number, ["query_id", "column"]).where("got = wanted").select("query_id", "column", "token")


def token_digest(tokens: list[int]) -> dict:
    """The tokens themselves up to 256 of them, else their number, ends and SHA-256."""
    import hashlib

    if len(tokens) <= 256:
        return {"allowed_token_ids": tokens}
    text = ",".join(map(str, tokens)).encode()
    return {"allowed_token_ids": None, "allowed_token_ids_compact": {"count": len(tokens), "minimum": min(tokens), "maximum": max(tokens), "sha256": hashlib.sha256(text).hexdigest()}}


def enumeration_size(allowed: dict[int, list[int]]) -> int:
    """Over all columns, an empty set counting as one."""
    return math.prod(max(len(v), 1) for v in allowed.values())
