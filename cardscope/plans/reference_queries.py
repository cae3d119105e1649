"""Queries of the estimation and evaluation operators over whole tables, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardscope.functions import metrics as M
from cardscope.operators import density, encoding, failures, joinchoice, ranking, runtime, workload
from cardscope.operators.encoding import Predicate
from cardscope.plans.requests import QueryGraph
from cardscope.plans.seed_workload import STATEMENTS
from cardscope.session import at_once, cut_lineage
from cardscope.sources.tables import table
from cardscope.sources.workload_lines import trimmed

Query = Callable[[SparkSession, str], DataFrame]


#: Added away from zero before rounding: means of two values with as many digits lie on the edge, where engines differ in the last bit.
_NUDGE = 1e-8


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that two engines agree."""
    return df.select(*(_round(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _round(c, digits: int = 6):
    return F.round(c + F.signum(c) * _NUDGE, digits)


def nudged(sql: str) -> str:
    """SQL in which every round(x, n) rounds as `rounded` does."""
    out, at = [], 0
    while (start := sql.find("round(", at)) >= 0:
        depth, comma, i = 1, -1, start + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[i], 0)
            comma = i if sql[i] == "," and depth == 1 else comma
            i += 1
        inner = nudged(sql[start + 6 : comma])
        out += [sql[at:start], f"round(({inner}) + sign({inner}) * {_NUDGE!r}", sql[comma:i]]
        at = i
    return "".join(out) + sql[at:]


# ---------------------------------------------------------------- encoders

_PROFILED = {
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "lineitem": ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
}
_DICTIONARY = {"orders": ["o_orderstatus", "o_orderpriority"], "part": ["p_brand", "p_size"], "lineitem": ["l_quantity", "l_discount", "l_returnflag"]}
_TEXT = {"o_orderstatus", "o_orderpriority", "p_brand", "p_name", "p_type", "l_returnflag", "l_linestatus"}
_KIND = {"o_orderkey": "integer", "o_custkey": "integer", "p_partkey": "integer", "p_size": "integer", "l_linenumber": "integer", "o_orderdate": "timestamp", "l_shipdate": "timestamp"}
_BINNED = {"orders": "o_totalprice", "part": "p_retailprice", "customer": "c_acctbal", "lineitem": "l_extendedprice"}


def column_profile(spark: SparkSession, d: str) -> DataFrame:
    parts = [encoding.column_profile(table(spark, d, t), cs).withColumn("table_name", F.lit(t)) for t, cs in _PROFILED.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _sql_profile() -> str:
    one = """SELECT '{t}' AS table_name, '{c}' AS "column", '{k}' AS kind, count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS distinct_with_null,
      count(*) - count({c}) AS nulls, count(*) AS rows, {n} AND count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) > 64 AS binned FROM {t}"""
    kind = lambda c: "text" if c in _TEXT else _KIND.get(c, "float")
    parts = [one.format(t=t, c=c, k=kind(c), n=str(kind(c) in ("integer", "float")).lower()) for t, cs in _PROFILED.items() for c in cs]
    return f"""SELECT table_name, "column", kind, CAST(distinct_with_null AS BIGINT) AS distinct_with_null, CAST(nulls AS BIGINT) AS nulls, rows,
      CASE WHEN binned THEN 'numeric_discretizer' ELSE 'dictionary' END AS encoding FROM ({" UNION ALL ".join(parts)})"""


def _dictionary(spark: SparkSession, d: str, t: str, cs: list[str]) -> DataFrame:
    df = table(spark, d, t)
    return encoding.dictionary_tokens(encoding.value_counts(df, cs), encoding.column_profile(df, cs)).withColumn("table_name", F.lit(t))


def dictionary_tokens(spark: SparkSession, d: str) -> DataFrame:
    parts = [_dictionary(spark, d, t, cs) for t, cs in _DICTIONARY.items()]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return every.select("table_name", "column", "token", F.when(F.col("num").isNull(), F.col("value")).alias("value"), "num")


def _sql_dictionary(t: str, c: str) -> str:
    text, num = (c, "CAST(NULL AS DOUBLE)") if c in _TEXT else ("CAST(NULL AS VARCHAR)", f"CAST({c} AS DOUBLE)")
    return f"""SELECT '{t}' AS table_name, '{c}' AS "column", CAST(row_number() OVER (ORDER BY {c} NULLS LAST) - 1 AS INTEGER) AS token, {text} AS value, {num} AS num
      FROM (SELECT DISTINCT {c} FROM {t})"""


def quantile_edges(spark: SparkSession, d: str) -> DataFrame:
    parts = at_once([lambda t=t, c=c: encoding.quantile_edges(table(spark, d, t), [c]) for t, c in _BINNED.items()])
    return rounded(reduce(DataFrame.unionByName, parts).select("column", F.posexplode("edges").alias("place", "edge")))


def sql_edges(t: str, c: str, points: int = 64) -> str:
    fractions = ", ".join(repr(i / (points - 1)) for i in range(points))
    return f"""SELECT '{c}' AS "column", CAST(row_number() OVER (ORDER BY edge) - 1 AS INTEGER) AS place, edge
      FROM (SELECT DISTINCT round(unnest(quantile_cont({c}, [{fractions}])), 6) AS edge FROM {t})"""


def _edges_of(spark: SparkSession, d: str, t: str) -> DataFrame:
    c = _BINNED[t]
    edges = encoding.quantile_edges(table(spark, d, t), [c])
    return edges.select(F.array_distinct(F.transform("edges", lambda e: _round(e))).alias("edges"))


def row_bin_encode(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_extendedprice").join(F.broadcast(_edges_of(spark, d, "lineitem")))
    return rows.groupBy(encoding.row_bin(F.col("l_extendedprice"), F.col("edges")).alias("bin")).agg(F.count("*").alias("rows"))


_LITERALS = (-1.0, 0.0, 900.0, 1234.56, 25000.0, 50000.5, 99999.0, 1e9)


def literal_bin_encode(spark: SparkSession, d: str) -> DataFrame:
    literals = spark.createDataFrame([(x,) for x in _LITERALS], "literal double")
    rows = literals.join(F.broadcast(_edges_of(spark, d, "lineitem")))
    return rows.select("literal", encoding.literal_bin(F.col("literal"), F.col("edges")).alias("bin"))


_PREDICATES = {
    "eq": [("o_orderstatus", "=", "F"), ("o_totalprice", "=", 150000.0), ("o_orderstatus", "=", "nothing"), ("o_totalprice", "=", -5.0)],
    "lt": [("o_orderpriority", "<", "3-MEDIUM"), ("o_totalprice", "<", 100000.0), ("o_totalprice", "<", -5.0)],
    "le": [("o_orderpriority", "<=", "3-MEDIUM"), ("o_totalprice", "<=", 100000.0)],
    "gt": [("o_orderpriority", ">", "3-MEDIUM"), ("o_totalprice", ">", 300000.0), ("o_totalprice", ">", 1e12)],
    "ge": [("o_orderpriority", ">=", "3-MEDIUM"), ("o_totalprice", ">=", 300000.0)],
    "between": [("o_orderpriority", "between", ("2-HIGH", "4-NOT SPECIFIED")), ("o_totalprice", "between", (100000.0, 200000.0)), ("o_totalprice", "between", (200000.0, 100000.0))],
    "in": [("o_orderpriority", "in", ("1-URGENT", "2-HIGH", "none")), ("o_totalprice", "in", (1000.0, 150000.0, 1e12))],
}
_ORDER_COLUMNS = ["o_orderstatus", "o_totalprice", "o_orderpriority"]


def _predicate(c: str, op: str, v: object) -> Predicate:
    return Predicate(c, op, lower=v[0], upper=v[1]) if op == "between" else Predicate(c, op, values=v) if op == "in" else Predicate(c, op, value=v)


def _orders_encoder(spark: SparkSession, d: str) -> encoding.TableEncoder:
    e = encoding.TableEncoder.fit(table(spark, d, "orders"), "orders", _ORDER_COLUMNS)
    for c in e.columns:
        if c.edges is not None:
            c.edges = sorted({round(x + (_NUDGE if x > 0 else -_NUDGE if x < 0 else 0.0), 6) for x in c.edges})
    return e


def _allowed(kind: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = [encoding.predicate_row(kind, i, _predicate(*p)) for i, p in enumerate(_PREDICATES[kind])]
        predicates = spark.createDataFrame(rows, encoding.PREDICATE_SCHEMA)
        return encoding.allowed_tokens(_orders_encoder(spark, d).tokens(spark), predicates).select("predicate_id", "column", "token")

    run.__name__ = f"allowed_tokens_{kind}"
    return run


def _sql_allowed(c: str, op: str, v: object) -> str:
    """SQL of the tokens (column `token`) that a predicate selects; on top of CTEs `bins` and `words`."""
    q = lambda x: f"'{x}'" if isinstance(x, str) else repr(float(x))
    if c == "o_totalprice":
        point = lambda x: f"((lo <= {q(x)} OR token = 0) AND ({q(x)} < hi OR last))"
        lower = {"between": lambda: f"hi >= {q(v[0])} AND lo <= {q(v[1])}", "in": lambda: " OR ".join(point(x) for x in v), "=": lambda: point(v), "<": lambda: f"lo < {q(v)}", "<=": lambda: f"lo <= {q(v)}", ">": lambda: f"hi > {q(v)}", ">=": lambda: f"hi >= {q(v)}"}
        where = lower[op]()
        return f"SELECT token FROM bins WHERE {where} UNION SELECT 0 WHERE NOT EXISTS (SELECT 1 FROM bins WHERE {where})"
    where = f"value BETWEEN {q(v[0])} AND {q(v[1])}" if op == "between" else f"value IN ({', '.join(map(q, v))})" if op == "in" else f"value {op} {q(v)}"
    return f"""SELECT token FROM words WHERE "column" = '{c}' AND {where}"""


_ORDER_TOKENS = f"""WITH edges AS ({sql_edges("orders", "o_totalprice")}
), bins AS (
  SELECT a.place AS token, a.edge AS lo, b.edge AS hi, b.place = (SELECT max(place) FROM edges) AS last FROM edges a JOIN edges b ON b.place = a.place + 1
), words AS ({_sql_dictionary("orders", "o_orderstatus")} UNION ALL {_sql_dictionary("orders", "o_orderpriority")})"""


def _sql_allowed_query(kind: str) -> str:
    parts = [f"""SELECT {i} AS predicate_id, '{c}' AS "column", token FROM ({_sql_allowed(c, op, v)})""" for i, (c, op, v) in enumerate(_PREDICATES[kind])]
    return f"{_ORDER_TOKENS} SELECT CAST(predicate_id AS INTEGER) AS predicate_id, \"column\", CAST(token AS INTEGER) AS token FROM ({' UNION ALL '.join(parts)})"


_BOTH = {"narrow": [("o_totalprice", ">=", 100000.0), ("o_totalprice", "<", 120000.0)], "words": [("o_orderpriority", ">", "1-URGENT"), ("o_orderpriority", "in", ("1-URGENT", "2-HIGH", "3-MEDIUM"))]}


def token_intersection(spark: SparkSession, d: str) -> DataFrame:
    rows = [encoding.predicate_row(n, i, _predicate(*p)) for n, ps in _BOTH.items() for i, p in enumerate(ps)]
    predicates = spark.createDataFrame(rows, encoding.PREDICATE_SCHEMA)
    return encoding.intersected(encoding.allowed_tokens(_orders_encoder(spark, d).tokens(spark), predicates), predicates)


def _sql_intersection() -> str:
    parts = [f"""SELECT '{n}' AS query_id, '{ps[0][0]}' AS "column", token FROM ({" INTERSECT ".join(f"(SELECT * FROM ({_sql_allowed(*p)}))" for p in ps)})""" for n, ps in _BOTH.items()]
    return f"{_ORDER_TOKENS} SELECT query_id, \"column\", CAST(token AS INTEGER) AS token FROM ({' UNION ALL '.join(parts)})"


def null_sentinel_encode(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "orders").select(F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority")).alias("o_orderpriority"))
    e = encoding.TableEncoder.fit(df, "orders")
    return e.encode(df).groupBy(F.col("t0").alias("token")).agg(F.count("*").alias("rows"))


def token_histogram(spark: SparkSession, d: str) -> DataFrame:
    return density.token_histogram(table(spark, d, "orders"), _orders_encoder(spark, d)).toDF(*(f"{c}_token" for c in ("o_orderstatus", "o_totalprice", "o_orderpriority")), "rows")


_ROW_TOKENS = f"""{_ORDER_TOKENS}, coded AS (
  SELECT s.token AS o_orderstatus_token, p.token AS o_orderpriority_token,
         CAST(CASE WHEN o_totalprice < (SELECT min(edge) FROM edges) OR o_totalprice > (SELECT max(edge) FROM edges) THEN 0
              ELSE greatest(0, len(list_filter((SELECT list(edge) FROM edges), lambda e: e < o_totalprice)) - 1) END AS INTEGER) AS o_totalprice_token
  FROM orders JOIN words s ON s."column" = 'o_orderstatus' AND s.value = o_orderstatus JOIN words p ON p."column" = 'o_orderpriority' AND p.value = o_orderpriority
)"""
_ESTIMATED = {
    "status_price": [("o_orderstatus", "=", "F"), ("o_totalprice", "between", (100000.0, 200000.0))],
    "priority_price": [("o_orderpriority", "in", ("1-URGENT", "2-HIGH")), ("o_totalprice", ">", 300000.0)],
    "everything": [],
    "impossible": [("o_totalprice", ">", 1e12)],
    "unknown_word": [("o_orderstatus", "=", "nothing")],
}


def histogram_estimates(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    e = _orders_encoder(spark, d)
    requests = {n: [_predicate(*p) for p in ps] for n, ps in _ESTIMATED.items()}
    got = density.histogram_estimates(density.token_histogram(orders, e), e, requests)
    exact = orders.agg(*(F.count_if(_condition(ps)).alias(n) for n, ps in _ESTIMATED.items()))
    exact = exact.select(F.explode(F.array(*(F.struct(F.lit(n).alias("query_id"), F.col(n).alias("exact_cardinality")) for n in _ESTIMATED))).alias("s")).select("s.*")
    out = got.join(exact, "query_id").withColumnRenamed("cardinality", "learned_estimate")
    return rounded(out.withColumn("q_error", M.q_error(F.col("learned_estimate"), F.col("exact_cardinality"))))


def _condition(ps: list[tuple]):
    out = F.lit(True)
    for c, op, v in ps:
        x = F.col(c)
        out = out & (x.between(*v) if op == "between" else x.isin(*v) if op == "in" else {"=": x == v, ">": x > v}[op] if op in "=>" else F.lit(False))
    return out


def _sql_estimates() -> str:
    q = lambda x: f"'{x}'" if isinstance(x, str) else repr(float(x))
    plain = lambda c, op, v: f"{c} BETWEEN {q(v[0])} AND {q(v[1])}" if op == "between" else f"{c} IN ({', '.join(map(q, v))})" if op == "in" else f"{c} {op} {q(v)}"
    parts = []
    for n, ps in _ESTIMATED.items():
        tokens = " AND ".join(f"{c}_token IN ({_sql_allowed(c, op, v)})" for c, op, v in ps) or "true"
        exact = " AND ".join(plain(*p) for p in ps) or "true"
        parts.append(f"SELECT '{n}' AS query_id, (SELECT count(*) FROM coded WHERE {tokens}) AS hits, (SELECT count(*) FROM orders WHERE {exact}) AS exact_cardinality")
    return f"""{_ROW_TOKENS}, got AS ({" UNION ALL ".join(parts)}), total AS (SELECT count(*) AS n FROM orders)
    SELECT query_id, round(hits / n, 6) AS selectivity, round(hits / n * n, 6) AS learned_estimate, exact_cardinality,
           round(greatest(greatest(hits, 1) / greatest(exact_cardinality, 1), greatest(exact_cardinality, 1) / greatest(hits, 1)), 6) AS q_error FROM got, total"""


# ---------------------------------------------------------------- counts


def _graphs(spark: SparkSession, names: tuple[str, ...] = tuple(STATEMENTS)) -> dict[str, QueryGraph]:
    return {n: QueryGraph.parse(spark, STATEMENTS[n]) for n in names}


def _tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {t: table(spark, d, t) for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")}


def exact_base_counts(spark: SparkSession, d: str) -> DataFrame:
    return workload.exact_base_counts(_tables(spark, d), _graphs(spark))


SHAPES = {
    "customer_orders": ({"c": ("customer", "c_mktsegment='BUILDING'"), "o": ("orders", "o_orderstatus='F'")}, {("c", "o"): "c.c_custkey=o.o_custkey"}),
    "customer_orders_lineitem": ({"c": ("customer", "true"), "o": ("orders", "o_totalprice>300000"), "l": ("lineitem", "l_quantity<10")}, {("c", "o"): "c.c_custkey=o.o_custkey", ("o", "l"): "o.o_orderkey=l.l_orderkey"}),
    "lineitem_part_supplier": ({"l": ("lineitem", "true"), "p": ("part", "p_size<=10"), "s": ("supplier", "s_acctbal>0")}, {("l", "p"): "l.l_partkey=p.p_partkey", ("l", "s"): "l.l_suppkey=s.s_suppkey"}),
    "region_to_lineitem": (
        {"r": ("region", "r_name='ASIA'"), "n": ("nation", "true"), "c": ("customer", "true"), "o": ("orders", "true"), "l": ("lineitem", "l_returnflag='R'")},
        {("r", "n"): "r.r_regionkey=n.n_regionkey", ("n", "c"): "n.n_nationkey=c.c_nationkey", ("c", "o"): "c.c_custkey=o.o_custkey", ("o", "l"): "o.o_orderkey=l.l_orderkey"},
    ),
}


def join_fragment_counts(spark: SparkSession, d: str) -> DataFrame:
    return workload.fragment_counts(spark, _graphs(spark, tuple(SHAPES)), _tables(spark, d))


def _sql_fragments() -> str:
    parts = []
    for name, (relations, joins) in SHAPES.items():
        for n in range(2, len(relations) + 1):
            for some in combinations(relations, n):
                used = [sql for pair, sql in joins.items() if set(pair) <= set(some)]
                if len(used) == n - 1:  # these statements are trees, so a fragment is connected when it has n - 1 joins
                    source = ", ".join(f"(SELECT * FROM {relations[a][0]} WHERE {relations[a][1]}) {a}" for a in some)
                    key = "|".join(sorted(f"{relations[a][0]}:{a}" for a in some))
                    parts.append(f"SELECT '{name}' AS query_id, '{key}' AS relations, count(*) AS cardinality FROM {source} WHERE {' AND '.join(used)}")
    return " UNION ALL ".join(parts)


def sql_base_counts(joined_only: bool = False) -> str:
    single = {
        "orders_status_price": ("orders", "o_orderstatus='F' AND o_totalprice BETWEEN 100000 AND 200000"), "orders_priority": ("orders", "o_orderpriority IN ('1-URGENT','2-HIGH') AND o_totalprice > 300000"),
        "lineitem_flags": ("lineitem", "l_returnflag='R' AND l_quantity < 10 AND l_discount >= 0.05"), "part_impossible": ("part", "p_size <= 10 AND p_retailprice >= 1500"),
        "customer_segment": ("customer", "c_mktsegment='BUILDING' AND c_acctbal < 0"), "events_clicks": ("events", "event_type='click' AND value > 50"),
    }
    rows = [(q, t, t, w) for q, (t, w) in single.items() if not joined_only] + [(q, f"{t}:{a}", t, w) for q, (rs, _) in SHAPES.items() for a, (t, w) in rs.items()]
    return " UNION ALL ".join(f"SELECT '{q}' AS query_id, '{k}' AS relation, count(*) FILTER ({w}) AS exact_cardinality, count(*) AS table_cardinality FROM {t}" for q, k, t, w in rows)


# ---------------------------------------------------------------- workload


def normalized_sql_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "workload_queries").select("query_key", workload.normalize_sql(F.col("sql")).alias("normalized_sql"), workload.normalized_sql_id(F.col("sql")).alias("normalized_sql_id"))


_NORMAL = "trim(regexp_replace(lower(regexp_replace(regexp_replace({c}, '^[\\s\\x{{00A0}}]+|[\\s\\x{{00A0}}]+$', '', 'g'), ';+$', '')), '[\\s\\x{{00A0}}]+', ' ', 'g'))"
_SQL_NORMAL = f"SELECT query_key, {_NORMAL.format(c='sql')} AS normalized_sql, sha256({_NORMAL.format(c='sql')}) AS normalized_sql_id FROM workload_queries"


def workload_formats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "workload_lines").select("line_id", "file_format", workload.detect_format(trimmed(F.col("raw_line"))).alias("detected"))


_NUMERIC = "regexp_full_match({x}, '[-+]?(([0-9](_?[0-9])*\\.?([0-9](_?[0-9])*)?|\\.[0-9](_?[0-9])*)([eE][-+]?[0-9]+)?|(?i:inf|infinity|nan))')"
_SQL_FORMATS = f"""SELECT line_id, file_format, CASE
  WHEN {_NUMERIC.format(x="p[1]")} AND starts_with(lower(coalesce(p[2], '')), 'select') THEN 'complete'
  WHEN starts_with(lower(p[1]), 'select') AND {_NUMERIC.format(x="coalesce(p[3], '')")} THEN 'single_table'
  WHEN starts_with(lower(p[1]), 'select') AND len(p) >= 2 THEN 'subquery' END AS detected
FROM (SELECT line_id, file_format, list_transform(string_split(raw_line, '||'), lambda x: regexp_replace(x, '^[\\s\\x{{00A0}}]+|[\\s\\x{{00A0}}]+$', '', 'g')) AS p FROM workload_lines)"""


def derive_base_queries(spark: SparkSession, d: str) -> DataFrame:
    return workload.derive_base_queries(table(spark, d, "workload_queries"))


_SQL_DERIVED = r"""
WITH cut AS (
  SELECT label, query_id, template, regexp_extract(t, '(?i)^select .*?\bfrom (.*?)(?: where (.*))?$', 1) AS rels, regexp_extract(t, '(?i)^select .*?\bfrom (.*?)(?: where (.*))?$', 2) AS conds
  FROM (SELECT *, replace(regexp_replace(trim(regexp_replace(sql, '[\s\x{00A0}]+', ' ', 'g')), '[; ]+$', ''), '"', '') AS t FROM workload_queries)
), parts AS (
  SELECT *, list_transform(string_split_regex(conds, '(?i)\s+and\s+'), lambda c: trim(regexp_replace(regexp_replace(trim(c), '^[( ]+', ''), '[) ]+$', ''))) AS cs,
         unnest(list_transform(string_split(rels, ','), lambda r: string_split_regex(regexp_replace(trim(r), '(?i)\s+as\s+', ' '), ' +'))) AS r
  FROM cut
), base AS (
  SELECT label, query_id, template, r[1] AS table_name, coalesce(r[2], r[1]) AS table_alias,
         array_to_string(list_filter(cs, lambda c: c <> '' AND lower(regexp_extract(c, '^([A-Za-z_]\w*)\.', 1)) = lower(coalesce(r[2], r[1]))
           AND NOT regexp_full_match(c, '[A-Za-z_]\w*\.[A-Za-z_]\w*\s*=\s*[A-Za-z_]\w*\.[A-Za-z_]\w*')), ' AND ') AS predicate_text
  FROM parts
), made AS (
  SELECT *, table_name || ':' || table_alias AS table_key, predicate_text <> '' AS is_filtered,
         'SELECT * FROM ' || table_name || ' AS ' || table_alias || CASE WHEN predicate_text <> '' THEN ' WHERE ' || predicate_text ELSE '' END AS base_sql
  FROM base
)
SELECT label || '__' || replace(table_key, ':', '_') AS occurrence_id, label, query_id, template, table_name, table_alias, table_key, predicate_text, is_filtered, base_sql,
       """ + _NORMAL.format(c="base_sql") + " AS normalized_sql, sha256(" + _NORMAL.format(c="base_sql") + ") AS normalized_sql_id FROM made"


# ---------------------------------------------------------------- errors of evaluated occurrences


def evaluated(spark: SparkSession, d: str) -> DataFrame:
    return failures.evaluated(table(spark, d, "experiment_2_failures"), table(spark, d, "base_queries"))


SQL_EVALUATED = r"""
WITH once AS (
  SELECT DISTINCT ON (result_id) * FROM experiment_2_failures
), joined AS (
  SELECT o.* EXCLUDE (predicate_count), b.occurrence_id, b.normalized_sql_id, b.original_query_label, b.predicate_text,
         regexp_replace(coalesce(b.predicate_text, ''), '''[^'']*''(''[^'']*'')*', '?', 'g') AS bare
  FROM once o LEFT JOIN base_queries b USING (occurrence_key)
), shaped AS (
  SELECT *, regexp_extract_all(lower(bare), '<=|>=|=|<|>|\bbetween\b|\bin\b') AS ops, list_distinct(regexp_extract_all(bare, '[A-Za-z_]\w*\.([A-Za-z_]\w*)', 1)) AS involved_columns FROM joined
), ev AS (
  SELECT *, len(ops) AS predicate_count,
    CASE WHEN len(ops) = 0 THEN 'no_filter' WHEN len(list_filter(ops, lambda o: o = '=')) = len(ops) THEN 'equality' WHEN len(list_filter(ops, lambda o: o IN ('<', '<=', '>', '>='))) = len(ops) THEN 'range' ELSE 'mixed' END AS operator_class,
    CASE WHEN list_contains(ops, '=') AND len(list_filter(ops, lambda o: o IN ('<', '<=', '>', '>=', 'between'))) > 0 THEN 'mixed' WHEN list_contains(ops, '=') THEN 'equality'
         WHEN len(list_filter(ops, lambda o: o IN ('<', '<=', '>', '>=', 'between'))) > 0 THEN 'range' ELSE 'other_or_unfiltered' END AS shape,
    coalesce(status = 'ok' AND isfinite(learned_q_error) AND isfinite(native_q_error) AND learned_q_error >= 1 AND native_q_error >= 1, false) AS good,
    CASE WHEN table_cardinality <> 0 THEN exact_cardinality / table_cardinality END AS selectivity,
    CASE WHEN isfinite(learned_estimate) AND learned_estimate >= 0 AND exact_cardinality >= 0 THEN greatest(learned_estimate, 1) / greatest(exact_cardinality, 1) END AS lr,
    CASE WHEN isfinite(native_estimate) AND native_estimate >= 0 AND exact_cardinality >= 0 THEN greatest(native_estimate, 1) / greatest(exact_cardinality, 1) END AS nr
  FROM shaped
), v AS (SELECT * FROM ev WHERE good)"""


def q_error_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "experiment_2_failures").dropDuplicates(["result_id"])
    x = F.col("exact_cardinality")
    out = {f"{p}_{n}": f(F.col(f"{p}_estimate"), x) for p in ("native", "learned") for n, f in (("q", M.q_error), ("ratio", M.signed_ratio), ("direction", M.direction))}
    return rounded(rows.select("result_id", *(c.alias(n) for n, c in out.items()), M.abs_log_ratio(F.col("learned_estimate"), F.col("native_estimate")).alias("log_apart")))


def _sql_q_error_rows() -> str:
    ok = "isfinite({e}) AND {e} >= 0 AND exact_cardinality >= 0"
    ratio = "greatest({e}, 1) / greatest(exact_cardinality, 1)"
    cols = []
    for p in ("native", "learned"):
        e = f"{p}_estimate"
        o, r = ok.format(e=e), ratio.format(e=e)
        cols += [f"round(CASE WHEN {o} THEN greatest({r}, 1 / ({r})) END, 6) AS {p}_q", f"round(CASE WHEN {o} THEN {r} END, 6) AS {p}_ratio"]
        cols += [f"CASE WHEN NOT coalesce({o}, false) THEN NULL WHEN {r} > 1 + 1e-9 THEN 'over' WHEN {r} < 1 - 1e-9 THEN 'under' WHEN {o} THEN 'equal' END AS {p}_direction"]
    apart = "round(abs(ln(greatest(learned_estimate, 1) / greatest(native_estimate, 1))), 6) AS log_apart"
    return f"SELECT result_id, {', '.join(cols)}, {apart} FROM (SELECT DISTINCT ON (result_id) * FROM experiment_2_failures)"


def section_summary(spark: SparkSession, d: str) -> DataFrame:
    out = failures.section_summary(evaluated(spark, d))
    # sums of values up to 1e11 agree to fewer digits
    return rounded(out).withColumns({f"{p}_mean": F.round(f"{p}_mean", 2) for p in ("learned", "native")})


def _sql_sections() -> str:
    first = "SELECT * FROM ({s}) QUALIFY row_number() OVER (PARTITION BY normalized_sql_id ORDER BY result_id) = 1"
    every, filtered, plain = "SELECT * FROM v", "SELECT * FROM v WHERE coalesce(is_filtered, false)", "SELECT * FROM v WHERE NOT coalesce(is_filtered, false)"
    parts = zip(failures.SECTIONS, (every, first.format(s=every), filtered, first.format(s=filtered), plain))
    cols = ["count(*) AS rows", "count(DISTINCT normalized_sql_id) AS statements"]
    close = "abs(learned_q_error - native_q_error) <= 1e-9 * greatest(learned_q_error, native_q_error, 1)"
    cols += [f"count(*) FILTER (NOT ({close}) AND learned_q_error < native_q_error) AS learned_better", f"count(*) FILTER (NOT ({close}) AND learned_q_error > native_q_error) AS native_better", f"count(*) FILTER ({close}) AS equal"]
    for p, r in (("learned", "lr"), ("native", "nr")):
        x = f"{p}_q_error"
        cols += [f"round(avg({x}), 2) AS {p}_mean", f"round(exp(avg(ln({x}))), 6) AS {p}_geometric_mean", f"round(max({x}), 6) AS {p}_max"]
        cols += [f"round(count(*) FILTER ({x} {op} {e}) / count(*), 6) AS {p}_{n}_fraction" for n, op, e in M.THRESHOLDS]
        cols += [f"round(count(*) FILTER ({r} > 1 + 1e-9) / count({r}), 6) AS {p}_overestimation_rate", f"round(count(*) FILTER ({r} < 1 - 1e-9) / count({r}), 6) AS {p}_underestimation_rate"]
        cols += [f"round(quantile_cont({x}, {q}), 6) AS {p}_{n}" for n, q in (("median", 0.5), ("p75", 0.75), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99))]
        cols += [f"round(quantile_cont({r}, 0.5), 6) AS {p}_median_signed_ratio"]
    cols += ["round(median(learned_q_error) - median(native_q_error), 6) AS median_learned_minus_native", "round(exp(avg(ln(learned_q_error))) - exp(avg(ln(native_q_error))), 6) AS geometric_mean_learned_minus_native"]
    cols += ["round(count(*) FILTER (learned_q_error <= 2) / count(*) - count(*) FILTER (native_q_error <= 2) / count(*), 6) AS le2_fraction_learned_minus_native"]
    return SQL_EVALUATED + " " + " UNION ALL ".join(f"SELECT '{n}' AS section, {', '.join(cols)} FROM ({s}) HAVING count(*) > 0" for n, s in parts)


def failure_categories(spark: SparkSession, d: str) -> DataFrame:
    return rounded(failures.category_metrics(evaluated(spark, d)))


def _bucket_sql(x: str, edges, first: str, last: str) -> str:
    return f"CASE {first} " + " ".join(f"WHEN {x} <= {e} THEN '{n}'" for e, n in edges) + f" ELSE '{last}' END"


_CATEGORIES = f"""{SQL_EVALUATED}, cats AS (
  SELECT *, unnest([
    {{'d': 'table', 'x': coalesce("table", 'None')}}, {{'d': 'query_template', 'x': coalesce(query_template, 'None')}}, {{'d': 'predicate_count', 'x': predicate_count::VARCHAR}},
    {{'d': 'operator_class', 'x': operator_class}}, {{'d': 'equality_range_shape', 'x': shape}}, {{'d': 'constrained_column_count', 'x': len(involved_columns)::VARCHAR}},
    {{'d': 'exact_cardinality_bucket', 'x': {_bucket_sql("exact_cardinality", M.CARDINALITY_EDGES, "WHEN exact_cardinality IS NULL THEN 'None' WHEN exact_cardinality <= 0 THEN 'exactly_zero'", ">100k")}}},
    {{'d': 'selectivity_bucket', 'x': {_bucket_sql("selectivity", M.SELECTIVITY_EDGES, "WHEN selectivity IS NULL THEN 'unknown' WHEN selectivity = 0 THEN 'exactly_zero'", ">1")}}},
    {{'d': 'estimate_direction', 'x': CASE WHEN lr > 1 + 1e-9 THEN 'over' WHEN lr < 1 - 1e-9 THEN 'under' WHEN lr IS NOT NULL THEN 'equal' ELSE 'None' END}},
    {{'d': 'inference_mode', 'x': coalesce(inference_mode, 'None')}}, {{'d': 'nullable_constrained_columns', 'x': 'non_nullable'}}]
    || list_transform(involved_columns, lambda c: {{'d': 'constrained_column', 'x': coalesce("table", 'None') || '.' || c}})
    || list_transform(involved_columns, lambda c: {{'d': 'encoding_type', 'x': 'unknown'}})) AS c FROM v
), overall AS (SELECT median(learned_q_error) AS m FROM v), grouped AS (
  SELECT c.d AS group_dimension, c.x AS group_value, count(*) AS group_size, count(DISTINCT normalized_sql_id) AS unique_query_count, exp(avg(ln(learned_q_error))) AS learned_geometric_mean_q_error,
    max(learned_q_error) AS learned_max_q_error, count(*) FILTER (learned_q_error > 10) * 100.0 / count(*) AS learned_gt10_percent, count(*) FILTER (learned_q_error > 100) * 100.0 / count(*) AS learned_gt100_percent,
    count(*) FILTER (lr > 1 + 1e-9) * 100.0 / count(*) AS learned_overestimation_percent, exp(avg(ln(native_q_error))) AS native_geometric_mean_q_error,
    count(*) FILTER (native_q_error > 10) * 100.0 / count(*) AS native_gt10_percent, quantile_cont(learned_q_error, 0.5) AS learned_median_q_error, quantile_cont(learned_q_error, 0.9) AS learned_p90_q_error,
    quantile_cont(learned_q_error, 0.95) AS learned_p95_q_error, quantile_cont(learned_q_error, 0.99) AS learned_p99_q_error, quantile_cont(lr, 0.5) AS learned_median_signed_ratio,
    quantile_cont(native_q_error, 0.5) AS native_median_q_error, quantile_cont(native_q_error, 0.95) AS native_p95_q_error
  FROM cats GROUP BY ALL
), flagged AS (
  SELECT *, m AS overall_learned_median_q_error, group_size >= 5 AND m > 0 AND learned_median_q_error >= 2 * m AS systematic_failure_candidate FROM grouped, overall
)"""
_CATEGORY_NUMBERS = (
    "learned_geometric_mean_q_error", "learned_max_q_error", "learned_gt10_percent", "learned_gt100_percent", "learned_overestimation_percent", "native_geometric_mean_q_error", "native_gt10_percent", "learned_median_q_error",
    "learned_p90_q_error", "learned_p95_q_error", "learned_p99_q_error", "learned_median_signed_ratio", "native_median_q_error", "native_p95_q_error", "overall_learned_median_q_error",
)
_SQL_CATEGORIES = f"""{_CATEGORIES} SELECT group_dimension, group_value, group_size, unique_query_count, {", ".join(f"round({c}, 6) AS {c}" for c in _CATEGORY_NUMBERS)},
  systematic_failure_candidate, 5 AS systematic_min_group_size, 2.0::DOUBLE AS systematic_median_multiplier FROM flagged"""


def worst_queries(spark: SparkSession, d: str) -> DataFrame:
    rows = evaluated(spark, d).select(
        "status", "result_id", "occurrence_id", "learned_q_error", "native_q_error", "fallback_used", "table", "query_template", "predicate_count", "operator_class", "equality_range_shape", "involved_columns",
        "exact_cardinality", "selectivity", "estimate_direction", "inference_mode",
    )
    out = failures.worst_queries(rows)
    return rounded(out.select(
        "result_id", "occurrence_id", "learned_q_error", "native_q_error", _round(F.col("learned_native_q_error_ratio"), 2).alias("learned_native_q_error_ratio"), "worst_learned_q_error", "worst_learned_native_disadvantage", "candidate_classification", "classification_status",
        F.array_join(F.transform("matching_systematic_groups", lambda g: F.concat_ws("=", g["dimension"], g["value"])), ";").alias("systematic_groups"),
    ))


_WORST = f"""{_CATEGORIES}, byq AS (SELECT result_id FROM v ORDER BY learned_q_error DESC, result_id LIMIT 50), byr AS (SELECT result_id FROM v ORDER BY learned_q_error / native_q_error DESC, result_id LIMIT 50),
picked AS (SELECT *, result_id IN (FROM byq) AS worst_learned_q_error, result_id IN (FROM byr) AS worst_learned_native_disadvantage FROM v WHERE result_id IN (FROM byq) OR result_id IN (FROM byr))"""
_SQL_WORST = f"""{_WORST},
hits AS (SELECT result_id, array_to_string(list_sort(list(DISTINCT {{'a': c.d, 'b': c.x}})).list_transform(lambda g: g.a || '=' || g.b), ';') AS s FROM cats
  JOIN flagged ON group_dimension = c.d AND group_value = c.x WHERE systematic_failure_candidate AND result_id IN (SELECT result_id FROM picked) GROUP BY 1)
SELECT result_id, occurrence_id, round(learned_q_error, 6) AS learned_q_error, round(native_q_error, 6) AS native_q_error, round(learned_q_error / native_q_error, 2) AS learned_native_q_error_ratio,
  worst_learned_q_error, worst_learned_native_disadvantage,
  CASE WHEN s IS NOT NULL THEN 'systematic category failure' WHEN coalesce(fallback_used, false) THEN 'preprocessing/translation issue' WHEN inference_mode = 'progressive_sampling' THEN 'sampling instability'
       WHEN learned_q_error > 10 AND native_q_error < learned_q_error THEN 'likely model limitation' ELSE 'isolated outlier' END AS candidate_classification,
  'candidate_requires_manual_review' AS classification_status, coalesce(s, '') AS systematic_groups
FROM picked LEFT JOIN hits USING (result_id)"""


def seed_targets(spark: SparkSession, d: str) -> DataFrame:
    return rounded(failures.seed_targets(evaluated(spark, d), 10, "result_id").select("rank", "result_id", "occurrence_id", "normalized_sql_id", "learned_q_error"))


_SQL_TARGETS = f"""{SQL_EVALUATED}, each AS (
  SELECT * FROM v WHERE is_filtered AND inference_mode = 'progressive_sampling' AND NOT coalesce(fallback_used, false)
  QUALIFY row_number() OVER (PARTITION BY normalized_sql_id ORDER BY learned_q_error DESC, result_id) = 1
)
SELECT CAST(row_number() OVER (ORDER BY learned_q_error DESC, result_id) AS INTEGER) AS rank, result_id, occurrence_id, normalized_sql_id, round(learned_q_error, 6) AS learned_q_error
FROM each ORDER BY learned_q_error DESC, result_id LIMIT 10"""


def single_table_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return failures.outcome_per_query(evaluated(spark, d))


_SQL_OUTCOMES = f"""{SQL_EVALUATED} SELECT original_query_label, CASE WHEN median(learned_q_error) < median(native_q_error) THEN 'improved' WHEN median(learned_q_error) > median(native_q_error) THEN 'worsened' ELSE 'unchanged' END
  AS single_table_estimate_outcome FROM v GROUP BY original_query_label"""


def wilson_groups(spark: SparkSession, d: str) -> DataFrame:
    rows = evaluated(spark, d).where("status = 'ok'")
    better = M.outcome(F.col("learned_q_error"), F.col("native_q_error")) == "left_better"
    out = rows.groupBy("table").agg(F.count_if(better).alias("successes"), F.count("*").alias("total"))
    w = M.wilson(F.col("successes"), F.col("total"))
    return rounded(out.select("*", w["rate"].alias("rate"), w["ci_low"].alias("ci_low"), w["ci_high"].alias("ci_high")))


_Z = repr(M.WILSON_Z)


def _sql_wilson(s: str, n: str) -> str:
    scale, rate = f"(1 + {_Z} * {_Z} / {n})", f"({s} / {n})"
    centre = f"(({rate} + {_Z} * {_Z} / (2 * {n})) / {scale})"
    margin = f"({_Z} * sqrt({rate} * (1 - {rate}) / {n} + {_Z} * {_Z} / (4.0 * {n} * {n})) / {scale})"
    return f"round({rate}, 6) AS rate, round(greatest(0, {centre} - {margin}), 6) AS ci_low, round(least(1, {centre} + {margin}), 6) AS ci_high"


_SQL_WILSON = f"""{SQL_EVALUATED}, g AS (SELECT "table", count(*) FILTER (abs(learned_q_error - native_q_error) > 1e-9 * greatest(learned_q_error, native_q_error, 1) AND learned_q_error < native_q_error) AS successes, count(*) AS total FROM v GROUP BY 1)
SELECT "table", successes, total, {_sql_wilson("successes", "total")} FROM g"""


def bucket_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = evaluated(spark, d).where("status = 'ok'")
    apart = M.abs_log_ratio(F.col("learned_estimate"), F.col("native_estimate"))
    pair = lambda k, v: F.struct(F.lit(k).alias("kind"), v.alias("bucket"))
    three = F.array(pair("cardinality", M.cardinality_bucket(F.col("exact_cardinality"))), pair("selectivity", M.selectivity_bucket(F.col("selectivity"))), pair("divergence", M.divergence_bucket(apart)))
    return rows.select(F.explode(three).alias("b")).groupBy("b.kind", "b.bucket").agg(F.count("*").alias("rows"))


_APART = "abs(ln(greatest(learned_estimate, 1) / greatest(native_estimate, 1)))"
_SQL_BUCKETS = f"""{SQL_EVALUATED}
SELECT 'cardinality' AS kind, {_bucket_sql("exact_cardinality", M.CARDINALITY_EDGES, "WHEN exact_cardinality IS NULL THEN NULL WHEN exact_cardinality <= 0 THEN 'exactly_zero'", ">100k")} AS bucket, count(*) AS rows FROM v GROUP BY 1, 2
UNION ALL SELECT 'selectivity', {_bucket_sql("selectivity", M.SELECTIVITY_EDGES, "WHEN selectivity IS NULL THEN 'unknown' WHEN selectivity = 0 THEN 'exactly_zero'", ">1")}, count(*) FROM v GROUP BY 1, 2
UNION ALL SELECT 'divergence', CASE WHEN {_APART} IS NULL THEN NULL {" ".join(f"WHEN {_APART} < ln({e}) THEN '{n}'" for e, n in M.DIVERGENCE_EDGES)} ELSE '>=100x' END, count(*) FROM v GROUP BY 1, 2"""


def ecdf_q_error(spark: SparkSession, d: str) -> DataFrame:
    rows = evaluated(spark, d).where("status = 'ok'")
    both = F.explode(F.array(*(F.struct(F.lit(s).alias("series"), F.col(f"{s}_q_error").alias("q_error")) for s in ("native", "learned")))).alias("p")
    out = ranking.ecdf(rows.select(both).select("p.*"), ["series"], "q_error")
    return rounded(out, 9)


_SQL_ECDF = f"""{SQL_EVALUATED}, s AS (SELECT 'native' AS series, native_q_error AS q_error FROM v UNION ALL SELECT 'learned', learned_q_error FROM v)
SELECT series, round(q_error, 9) AS q_error, round(row_number() OVER (PARTITION BY series ORDER BY q_error) / count(*) OVER (PARTITION BY series), 9) AS cumulative_fraction FROM s"""


def error_ratio_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Of the worst queries, as their report shows it."""
    valid = cut_lineage(evaluated(spark, d).select("status", "result_id", "learned_q_error", "native_q_error", "learned_signed_error_ratio"))
    rows = failures.worst_rows(valid).select(F.log10("learned_signed_error_ratio").alias("x"))
    return rounded(ranking.histogram(rows, "x"))


def _sql_histogram(source: str, x: str) -> str:
    return f""", hx AS (SELECT {x} AS x FROM {source} WHERE {x} IS NOT NULL), facts AS (
  SELECT CAST(least(30, greatest(5, count(*) // 3)) AS INTEGER) AS k, CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END AS lo, CASE WHEN min(x) = max(x) THEN max(x) + 0.5 ELSE max(x) END AS hi FROM hx),
every AS (SELECT *, unnest(range(k)) AS bin FROM facts), counted AS (SELECT CAST(least(floor((x - lo) / ((hi - lo) / k)), k - 1) AS INTEGER) AS bin, count(*) AS n FROM hx, facts GROUP BY 1)
SELECT CAST(e.bin AS INTEGER) AS bin, round(lo + e.bin * ((hi - lo) / k), 6) AS low, round(lo + e.bin * ((hi - lo) / k) + (hi - lo) / k, 6) AS high, coalesce(n, 0) AS rows FROM every e LEFT JOIN counted c ON c.bin = e.bin"""


def worst_tables(spark: SparkSession, d: str) -> DataFrame:
    rows = failures.category_metrics(evaluated(spark, d), ("table", "constrained_column"))
    return rounded(rows.orderBy(F.col("learned_median_q_error").desc(), "group_dimension", "group_value").limit(15).select("group_dimension", "group_value", "learned_median_q_error"))


_SQL_WORST_TABLES = f"""{_CATEGORIES} SELECT group_dimension, group_value, round(learned_median_q_error, 6) AS learned_median_q_error FROM flagged WHERE group_dimension IN ('table', 'constrained_column')
ORDER BY flagged.learned_median_q_error DESC, group_dimension, group_value LIMIT 15"""


# ---------------------------------------------------------------- run times


def _runtime(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "experiment_5_runtime")


def runtime_pivot(spark: SparkSession, d: str) -> DataFrame:
    return rounded(runtime.per_query(_runtime(spark, d)))


_MEASURED = """
WITH m AS (
  SELECT *, CASE WHEN coalesce(timeout, false) THEN timeout_seconds * 1000 WHEN status = 'ok' AND isfinite(execution_time_ms) AND execution_time_ms > 0 THEN execution_time_ms END AS ex,
         CASE WHEN coalesce(timeout, false) THEN timeout_seconds * 1000 WHEN status = 'ok' AND isfinite(wall_clock_duration_ms) AND wall_clock_duration_ms > 0 THEN wall_clock_duration_ms END AS wall
  FROM (SELECT DISTINCT ON (measurement_id) * FROM experiment_5_runtime) WHERE NOT coalesce(warmup, false)
), q AS (
  SELECT query_id, min(source_query_id) AS source_query_id, min(query_template) AS query_template, min(relation_count) AS relation_count, bool_or(coalesce(base_join_changed, false)) AS base_join_changed,
         count(*) FILTER (configuration = 'native' AND timeout) AS native_timeout_count, count(*) FILTER (configuration = 'learned_base' AND timeout) AS learned_timeout_count,
         count(*) FILTER (status = 'ok') AS valid_measured_repetitions,
         median(ex) FILTER (configuration = 'native') AS native_median_execution_time_ms, median(wall) FILTER (configuration = 'native') AS native_median_wall_clock_ms,
         median(ex) FILTER (configuration = 'learned_base') AS learned_median_execution_time_ms, median(wall) FILTER (configuration = 'learned_base') AS learned_median_wall_clock_ms,
         median(ex) FILTER (configuration = 'exact_base') AS exact_median_execution_time_ms, median(wall) FILTER (configuration = 'exact_base') AS exact_median_wall_clock_ms
  FROM m GROUP BY query_id
), p AS (
  SELECT *, native_median_execution_time_ms / learned_median_execution_time_ms AS speedup FROM q
), c AS (
  SELECT *, CASE WHEN speedup > 1 / 0.95 THEN 'improved' WHEN speedup < 1 / 1.05 THEN 'degraded' WHEN speedup IS NOT NULL THEN 'unchanged' END AS runtime_classification FROM p
), done AS (SELECT * FROM c WHERE speedup IS NOT NULL)"""
_SQL_PIVOT = f"""{_MEASURED} SELECT query_id, source_query_id, query_template, relation_count, base_join_changed, native_timeout_count, learned_timeout_count, valid_measured_repetitions,
  {", ".join(f"round({k}_median_{t}_ms, 6) AS {k}_median_{t}_ms" for k in ("native", "learned", "exact") for t in ("execution_time", "wall_clock"))},
  round(speedup, 6) AS speedup_native_over_learned, runtime_classification, CASE WHEN speedup IS NULL THEN 'invalid' ELSE 'complete' END AS status FROM c"""


def runtime_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(runtime.summary(runtime.per_query(_runtime(spark, d))), 4)


_SQL_RUNTIME_SUMMARY = f"""{_MEASURED} SELECT count(*) AS query_count, round(sum(native_median_execution_time_ms), 4) AS native_total_ms, round(sum(learned_median_execution_time_ms), 4) AS learned_total_ms,
  round(exp(avg(ln(speedup))), 4) AS geometric_mean_speedup, round(avg(ln(native_median_execution_time_ms) - ln(learned_median_execution_time_ms)), 4) AS mean_log_runtime_ratio,
  {", ".join(f"count(*) FILTER (runtime_classification = '{c}') AS {c}" for c in ("improved", "degraded", "unchanged"))},
  {", ".join(f"round(quantile_cont({k}_median_execution_time_ms, {q}), 4) AS {k}_{n}_ms" for k in ("native", "learned") for n, q in (("median", 0.5), ("p90", 0.9), ("p95", 0.95)))} FROM done"""


def runtime_subgroups(spark: SparkSession, d: str) -> DataFrame:
    return rounded(runtime.subgroups(runtime.per_query(_runtime(spark, d))))


_SQL_SUBGROUPS = f"""{_MEASURED}, g AS (
  SELECT unnest(['all_queries', CASE WHEN base_join_changed THEN 'changed_base_joins' ELSE 'unchanged_base_joins' END, 'template=' || coalesce(query_template, 'None'),
    CASE WHEN native_timeout_count = 0 AND learned_timeout_count = 0 THEN 'without_timeouts' END]) AS subgroup, speedup FROM done)
SELECT subgroup, count(*) AS query_count, round(exp(avg(ln(speedup))), 6) AS geometric_mean_speedup FROM g WHERE subgroup IS NOT NULL GROUP BY 1"""


def runtime_timeouts(spark: SparkSession, d: str) -> DataFrame:
    return runtime.timeout_counts(_runtime(spark, d))


_SQL_TIMEOUTS = f"{_MEASURED} SELECT configuration, count(*) FILTER (coalesce(timeout, false)) AS timeouts, count(*) AS repetitions FROM m GROUP BY 1"


def exact_reference_runtime(spark: SparkSession, d: str) -> DataFrame:
    return rounded(runtime.exact_reference(_runtime(spark, d)), 4)


_SQL_EXACT = f"""{_MEASURED}, e AS (SELECT query_id, median(ex) AS x FROM m WHERE configuration = 'exact_base' GROUP BY 1 HAVING median(ex) IS NOT NULL)
SELECT count(*) AS query_count, round(sum(x), 4) AS total_ms, {", ".join(f"round(quantile_cont(x, {q}), 4) AS {n}_ms" for n, q in (("median_query", 0.5), ("p90_query", 0.9), ("p95_query", 0.95)))} FROM e HAVING count(*) > 0"""


def speedup_spread(spark: SparkSession, d: str) -> DataFrame:
    return rounded(runtime.speedup_spread(runtime.per_query(_runtime(spark, d))))


_SQL_SPREAD = f"""{_MEASURED} SELECT base_join_changed, count(*) AS queries, {", ".join(f"round(quantile_cont(speedup, {q}), 6) AS {n}" for n, q in (("low", 0.0), ("q1", 0.25), ("median", 0.5), ("q3", 0.75), ("high", 1.0)))} FROM done GROUP BY 1"""


def cumulative_runtime(spark: SparkSession, d: str) -> DataFrame:
    done = runtime.per_query(_runtime(spark, d)).where("status = 'complete'")
    both = F.explode(F.array(*(F.struct(F.lit(s).alias("series"), F.col(f"{s}_median_execution_time_ms").alias("ms")) for s in ("native", "learned")))).alias("p")
    out = ranking.with_running(done.select("query_id", both).select("query_id", "p.*"), ["series"], [F.col("ms"), F.col("query_id")], "place", {"cumulative_ms": "ms"})
    return rounded(out.select("series", "query_id", F.col("place").cast("bigint").alias("place"), "cumulative_ms"), 3)


_SQL_CUMULATIVE = f"""{_MEASURED}, s AS (SELECT 'native' AS series, query_id, native_median_execution_time_ms AS ms FROM done UNION ALL SELECT 'learned', query_id, learned_median_execution_time_ms FROM done)
SELECT series, query_id, row_number() OVER w AS place, round(sum(ms) OVER (w ROWS UNBOUNDED PRECEDING), 3) AS cumulative_ms FROM s WINDOW w AS (PARTITION BY series ORDER BY ms, query_id)"""


def speedup_histogram(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ranking.histogram(runtime.per_query(_runtime(spark, d)).where("status = 'complete'"), "speedup_native_over_learned"))


# ---------------------------------------------------------------- joins that plans choose


def treatments(spark: SparkSession, d: str) -> DataFrame:
    return joinchoice.influence(table(spark, d, "treatment_results"), table(spark, d, "workload_queries"))


def base_join_influence(spark: SparkSession, d: str) -> DataFrame:
    cols = ["query_key", "native_first_base_join", "learned_first_base_join", "exact_first_base_join", "applicable", "base_join_changed", "full_plan_changed", "treatment_valid", "maximum_absolute_log_difference", "treatment_category", "decision_category", "status"]
    return rounded(treatments(spark, d).select(*cols, *(f"{s}_final_q_error" for s in ("native", "learned", "exact"))))


SQL_TREATED = """
WITH once AS (SELECT DISTINCT ON (treatment_id) *, list_filter(all_joins, lambda j: j IS NOT NULL) AS js FROM treatment_results),
one AS (SELECT *, js[-1].plan_rows AS root FROM once QUALIFY row_number() OVER (PARTITION BY query_key, config ORDER BY treatment_id) = 1),
w AS (
  SELECT n.query_key, n.first_base_join AS nf, l.first_base_join AS lf, e.first_base_join AS ef, n.plan_hash AS nh, l.plan_hash AS lh, n.base_estimates AS nb, l.base_estimates AS lb, n.root AS nroot, l.root AS lroot, e.root AS eroot,
         coalesce(n.treatment_valid, false) AND coalesce(l.treatment_valid, false) AND coalesce(e.treatment_valid, false) AS treatment_valid, q.template, q.query_size, q.actual_cardinality AS actual, n.query_id
  FROM one n JOIN one l ON l.query_key = n.query_key AND l.config = 'learned_base' JOIN one e ON e.query_key = n.query_key AND e.config = 'exact_base' LEFT JOIN workload_queries q ON q.query_key = n.query_key WHERE n.config = 'native'
), x AS (
  SELECT *, nf IS NOT NULL AND lf IS NOT NULL AND ef IS NOT NULL AS applicable, coalesce(nf IS NOT NULL AND lf IS NOT NULL AND ef IS NOT NULL AND nf <> lf, false) AS base_join_changed, nh IS DISTINCT FROM lh AS full_plan_changed,
    coalesce(list_max(list_transform(list_filter(map_keys(lb), lambda k: map_contains(nb, k)), lambda k: abs(ln(greatest(lb[k], 1) / greatest(nb[k], 1))))), 0) AS apart,
    CASE WHEN nf IS NULL OR lf IS NULL OR ef IS NULL THEN 'not applicable' WHEN lf = ef AND nf <> ef THEN 'improved' WHEN nf = ef AND lf <> ef THEN 'degraded' WHEN nf = ef THEN 'both agree' ELSE 'neither agrees' END AS decision_category,
    CASE WHEN nroot >= 0 AND actual >= 0 AND isfinite(nroot) AND isfinite(actual) THEN greatest(greatest(nroot, 1) / greatest(actual, 1), greatest(actual, 1) / greatest(nroot, 1)) END AS nq,
    CASE WHEN lroot >= 0 AND actual >= 0 AND isfinite(lroot) AND isfinite(actual) THEN greatest(greatest(lroot, 1) / greatest(actual, 1), greatest(actual, 1) / greatest(lroot, 1)) END AS lq,
    CASE WHEN eroot >= 0 AND actual >= 0 AND isfinite(eroot) AND isfinite(actual) THEN greatest(greatest(eroot, 1) / greatest(actual, 1), greatest(actual, 1) / greatest(eroot, 1)) END AS eq
  FROM w
)"""
_SQL_INFLUENCE = f"""{SQL_TREATED} SELECT query_key, nf AS native_first_base_join, lf AS learned_first_base_join, ef AS exact_first_base_join, applicable, base_join_changed, full_plan_changed, treatment_valid,
  round(apart, 6) AS maximum_absolute_log_difference, CASE WHEN base_join_changed THEN 'base join changed' WHEN full_plan_changed THEN 'plan changed but base join unchanged'
  WHEN apart > ln(1.01) THEN 'estimates changed but plan unchanged' ELSE 'no meaningful estimate difference' END AS treatment_category, decision_category,
  CASE WHEN applicable THEN 'ok' ELSE 'not_applicable' END AS status, round(nq, 6) AS native_final_q_error, round(lq, 6) AS learned_final_q_error, round(eq, 6) AS exact_final_q_error FROM x"""


def influence_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(joinchoice.influence_summary(treatments(spark, d)))


_SQL_INFLUENCE_SUMMARY = f"""{SQL_TREATED}, g AS (
  SELECT unnest([{{'d': 'all', 'v': 'all'}}, {{'d': 'relation_count', 'v': coalesce(query_size::VARCHAR, 'None')}}, {{'d': 'query_template', 'v': coalesce(template, 'None')}},
    {{'d': 'estimate_divergence', 'v': CASE {" ".join(f"WHEN apart < ln({e}) THEN '{n}'" for e, n in M.DIVERGENCE_EDGES)} ELSE '>=100x' END}}]) AS s, base_join_changed, full_plan_changed
  FROM x WHERE applicable AND treatment_valid
), c AS (SELECT s.d AS dimension, s.v AS value, count(*) AS total, count(*) FILTER (base_join_changed) AS changed, count(*) FILTER (full_plan_changed) AS plans_changed FROM g GROUP BY 1, 2)
SELECT *, {_sql_wilson("changed", "total")}, changed / total >= 0.05 AS practically_relevant FROM c"""


def decision_quality(spark: SparkSession, d: str) -> DataFrame:
    return rounded(joinchoice.quality_summary(treatments(spark, d)))


_SQL_QUALITY = f"""{SQL_TREATED}, s AS (SELECT count(*) AS valid_queries, count(*) FILTER (nf = ef) AS na, count(*) FILTER (lf = ef) AS la,
  {", ".join(f"count(*) FILTER (decision_category = '{c}') AS {c.replace(' ', '_')}" for c in ("improved", "degraded", "both agree", "neither agrees"))} FROM x WHERE applicable AND treatment_valid)
SELECT valid_queries, na AS native_agreements, la AS learned_agreements, improved, degraded, both_agree, neither_agrees, {_sql_wilson("na", "valid_queries").replace("AS ", "AS native_")}, {_sql_wilson("la", "valid_queries").replace("AS ", "AS learned_")},
  la > na AND improved > degraded AS improved_under_all_criteria FROM s"""


def complete_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return rounded(joinchoice.complete_summary(treatments(spark, d)))


def _sql_complete() -> str:
    close = lambda a, b: f"abs({a} - {b}) <= 1e-9 * greatest({a}, {b}, 1)"
    cols = ["count(*) AS queries"]
    for a, name, base in (("lq", "learned", "learned_base"), ("eq", "exact", "exact_base")):
        cols += [f"count(*) FILTER (NOT ({close(a, 'nq')}) AND {a} < nq) AS {name}_{base}", f"count(*) FILTER (NOT ({close(a, 'nq')}) AND {a} > nq) AS {name}_native", f"count(*) FILTER ({close(a, 'nq')}) AS {name}_unchanged"]
    for s, c in (("native", "nq"), ("learned", "lq"), ("exact", "eq")):
        cols.append(f"round(exp(avg(ln({c}))), 6) AS {s}_geometric_mean")
        cols += [f"round(quantile_cont({c}, {q}), 6) AS {s}_{n}" for n, q in (("median", 0.5), ("p90", 0.9), ("p95", 0.95))]
    cols += ["round(median(nq / lq), 6) AS median_learned_improvement", "round(median(nq / eq), 6) AS median_exact_improvement"]
    return f"{SQL_TREATED} SELECT {', '.join(cols)} FROM x WHERE treatment_valid AND nq IS NOT NULL AND lq IS NOT NULL AND eq IS NOT NULL"


def base_join_keys(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "treatment_results").dropDuplicates(["treatment_id"])
    return rows.select("treatment_id", F.array_join(joinchoice.base_join_keys(F.col("all_joins")), ";").alias("base_joins"))


_SQL_BASE_JOINS = """SELECT DISTINCT ON (treatment_id) treatment_id, array_to_string(list_transform(list_filter(all_joins, lambda j: j IS NOT NULL AND coalesce(j.is_base_join, false)),
  lambda j: coalesce(j.base_join_key, array_to_string(list_sort(list_distinct(j.relations)), '|'))), ';') AS base_joins FROM treatment_results"""


def treatment_estimates(spark: SparkSession, d: str) -> DataFrame:
    """Estimates by relation, raw and as injected, and learned over native."""
    wide = joinchoice.side_by_side(table(spark, d, "treatment_results")).where("has_native and has_learned")
    ratios = wide.select("query_key", F.explode(M.estimate_ratios(F.col("learned_base_estimates"), F.col("native_base_estimates"))).alias("relation", "ratio"), "learned_base_estimates")
    return rounded(ratios.select("query_key", "relation", "ratio", M.floored(F.element_at("learned_base_estimates", F.col("relation"))).alias("injected")))


_SQL_ESTIMATES = f"""{SQL_TREATED.split(", x AS (")[0].replace("JOIN one e ON e.query_key = n.query_key AND e.config = 'exact_base'", "LEFT JOIN one e ON e.query_key = n.query_key AND e.config = 'exact_base'")}
SELECT query_key, k AS relation, round(CASE WHEN nb[k] <> 0 THEN lb[k] / nb[k] END, 6) AS ratio, round(greatest(lb[k], 1), 6) AS injected FROM (SELECT *, unnest(list_filter(map_keys(lb), lambda k: map_contains(nb, k))) AS k FROM w)"""


def queries() -> dict[str, Query]:
    plain = (
        column_profile, dictionary_tokens, quantile_edges, row_bin_encode, literal_bin_encode, token_intersection, null_sentinel_encode, token_histogram, histogram_estimates, exact_base_counts, join_fragment_counts,
        normalized_sql_ids, workload_formats, derive_base_queries, q_error_rows, section_summary, failure_categories, worst_queries, seed_targets, single_table_outcomes, wilson_groups, bucket_counts, ecdf_q_error,
        error_ratio_histogram, worst_tables, runtime_pivot, runtime_summary, runtime_subgroups, runtime_timeouts, exact_reference_runtime, speedup_spread, cumulative_runtime, speedup_histogram, base_join_influence,
        influence_summary, decision_quality, complete_accuracy, base_join_keys, treatment_estimates,
    )
    return {f.__name__: f for f in plain} | {f"allowed_tokens_{k}": _allowed(k) for k in _PREDICATES}


def oracle_sql() -> dict[str, str]:
    edges = f"WITH edges AS ({sql_edges('lineitem', 'l_extendedprice')}), e AS (SELECT list(edge ORDER BY edge) AS es FROM edges)"
    literals = ", ".join(f"({x!r}::DOUBLE)" for x in _LITERALS)
    found = {
        "column_profile": _sql_profile(),
        "dictionary_tokens": " UNION ALL ".join(_sql_dictionary(t, c) for t, cs in _DICTIONARY.items() for c in cs),
        "quantile_edges": " UNION ALL ".join(sql_edges(t, c) for t, c in _BINNED.items()),
        "row_bin_encode": f"{edges} SELECT CAST(CASE WHEN l_extendedprice BETWEEN es[1] AND es[-1] THEN greatest(0, len(list_filter(es, lambda x: x < l_extendedprice)) - 1) ELSE 0 END AS INTEGER) AS bin, count(*) AS rows FROM lineitem, e GROUP BY 1",
        "literal_bin_encode": f"{edges} SELECT literal, CAST(least(greatest(len(list_filter(es, lambda x: x <= literal)) - 1, 0), len(es) - 2) AS INTEGER) AS bin FROM (VALUES {literals}) v(literal), e",
        **{f"allowed_tokens_{k}": _sql_allowed_query(k) for k in _PREDICATES},
        "token_intersection": _sql_intersection(),
        "null_sentinel_encode": """WITH o AS (SELECT CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS p FROM orders), d AS (SELECT p, row_number() OVER (ORDER BY p NULLS LAST) - 1 AS token FROM (SELECT DISTINCT p FROM o))
            SELECT CAST(token AS INTEGER) AS token, count(*) AS rows FROM o JOIN d ON o.p IS NOT DISTINCT FROM d.p GROUP BY 1""",
        "token_histogram": f"{_ROW_TOKENS} SELECT o_orderstatus_token, o_totalprice_token, o_orderpriority_token, count(*) AS rows FROM coded GROUP BY ALL",
        "histogram_estimates": _sql_estimates(),
        "exact_base_counts": sql_base_counts(),
        "join_fragment_counts": _sql_fragments(),
        "normalized_sql_ids": _SQL_NORMAL,
        "workload_formats": _SQL_FORMATS,
        "derive_base_queries": _SQL_DERIVED,
        "q_error_rows": _sql_q_error_rows(),
        "section_summary": _sql_sections(),
        "failure_categories": _SQL_CATEGORIES,
        "worst_queries": _SQL_WORST,
        "seed_targets": _SQL_TARGETS,
        "single_table_outcomes": _SQL_OUTCOMES,
        "wilson_groups": _SQL_WILSON,
        "bucket_counts": _SQL_BUCKETS,
        "ecdf_q_error": _SQL_ECDF,
        "error_ratio_histogram": _WORST + _sql_histogram("picked", "log10(lr)"),
        "worst_tables": _SQL_WORST_TABLES,
        "runtime_pivot": _SQL_PIVOT,
        "runtime_summary": _SQL_RUNTIME_SUMMARY,
        "runtime_subgroups": _SQL_SUBGROUPS,
        "runtime_timeouts": _SQL_TIMEOUTS,
        "exact_reference_runtime": _SQL_EXACT,
        "speedup_spread": _SQL_SPREAD,
        "cumulative_runtime": _SQL_CUMULATIVE,
        "speedup_histogram": _MEASURED + _sql_histogram("done", "speedup"),
        "base_join_influence": _SQL_INFLUENCE,
        "influence_summary": _SQL_INFLUENCE_SUMMARY,
        "decision_quality": _SQL_QUALITY,
        "complete_accuracy": _sql_complete(),
        "base_join_keys": _SQL_BASE_JOINS,
        "treatment_estimates": _SQL_ESTIMATES,
    }
    return {name: nudged(sql) for name, sql in found.items()}


__all__ = ["oracle_sql", "queries"]
