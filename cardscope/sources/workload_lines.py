"""Loading raw workload lines: valid lines become queries, all others keep their text and get the reason they failed.

A line is read permissively under the explicit schema of its file format, all fields as text and the raw text of a corrupt
row retained. Rows that this plain reading settles (right number of fields, no double quote, no separator inside quotes)
keep its fields; the others are scanned again with the full quoting rules. Both kinds then pass the same checks by quoting,
number of fields and casts. Everything is column expressions, so a load is one scan without a shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The fields of each file format in order.
FORMATS = {"complete": ("count", "sql"), "single_table": ("sql", "id", "count"), "subquery": ("sql", "id")}
#: The tables a workload may name.
TABLES = ("users", "badges", "comments", "posts", "posthistory", "postlinks", "votes", "tags")

_BLANK = r"[\s ﻿]"
_BLANKS = " \t\n\x0b\f\r\u00a0\ufeff"
_QUOTED = r"""'[^']*+'|"[^"]*+\""""
_FIELD = rf"((?:{_QUOTED}|[^'\"|\u0001]++|\|(?!\|))*+)(?:\|\||\u0001)"
_NAME = r"[a-z_][a-z0-9_]*+"
_RELATION = rf"(?:{'|'.join(TABLES)})(?: as)? {_NAME}"
_COMPARISON = rf"{_NAME}\.{_NAME} ?(?:<=|>=|=|<|>) ?(?:{_NAME}\.{_NAME}|[-+]?[0-9]++(?:\.[0-9]++)?|§(?: ?:: ?[a-z]++)?)"
_HEAD = rf"^select count ?\( ?\* ?\) from ({_RELATION}(?: ?, ?{_RELATION})*+)(?: where (.+?))?[ ;]*$"


def trimmed(c: Column) -> Column:
    return F.trim(c, F.lit(_BLANKS))


def is_blank(c: Column) -> Column:
    return F.coalesce(trimmed(c) == "", F.lit(True))


def _odd(c: Column) -> Column:
    return F.length(F.regexp_replace(c, "[^']++", "")) % 2 == 1


def _separator_inside(line: Column) -> Column:
    return line.contains("'") & F.exists(F.regexp_extract_all(line, F.lit("'[^']*+'"), 0), lambda p: p.contains("||"))


def unclosed_quote(line: Column) -> Column:
    """Whether a single or double quote is opened and never closed."""
    # without double quotes the number of the others decides; only lines that have some are looked at piece by piece
    singles = F.length(line) - F.length(F.replace(line, F.lit("'"), F.lit("")))
    left = F.regexp_replace(line, _QUOTED, "")
    pieces = F.regexp_extract_all(line, F.lit(_QUOTED), 0)
    return F.when(~line.contains('"'), singles % 2 == 1).otherwise(left.rlike("['\"]") | F.exists(pieces, lambda p: p.startswith('"') & _odd(p)))


def quoted_fields(line: Column) -> Column:
    """The fields between `||` outside quotes, trimmed and freed of the double quotes around them."""
    raw = F.regexp_extract_all(F.concat(F.translate(line, "\u0001", " "), F.lit("\u0001")), F.lit(_FIELD), 1)

    def bare(f: Column) -> Column:
        t = trimmed(f)
        return F.when(t.rlike('(?s)^".*"$') & (F.length(t) > 1), trimmed(F.replace(F.substr(t, F.lit(2), F.length(t) - 2), F.lit('""'), F.lit('"')))).otherwise(t)

    return F.transform(raw, bare)


def valid_count(c: Column) -> Column:
    """A finite decimal number of at least 0 in ASCII digits, without sign; an exponent is allowed."""
    shape = c.rlike(r"^(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?$")
    return shape & F.coalesce(c.try_cast("double") < float("inf"), F.lit(False))


def valid_timestamp(c: Column) -> Column:
    """A date that exists, with or without a time of day that exists."""
    shape = c.rlike(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}(?:[ T][0-9]{1,2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]+)?)?)?$")
    return shape & c.try_cast("timestamp_ntz").isNotNull()


def with_statement_check(df: DataFrame, sql_col: str, to: str) -> DataFrame:
    """df with boolean `to`: whether sql_col is one complete `SELECT COUNT(*) FROM … [WHERE … AND …]` over the known tables
    and the declared aliases; null for a null statement. Each step is a column of its own, so none is computed twice."""
    sql = F.col(sql_col)
    text = F.regexp_replace(sql, r"'[^']*+'(?:'[^']*+')*+", "§")
    text = F.regexp_replace(F.lower(text), r'"([a-z_][a-z0-9_]*+)"', "$1")
    df = df.withColumn("__text", F.trim(F.regexp_replace(text, rf"{_BLANK}++", " ")))
    df = df.withColumns({"__from": F.regexp_extract("__text", _HEAD, 1), "__where": F.regexp_extract("__text", _HEAD, 2)})
    df = df.withColumn("__marks", F.regexp_replace("__where", _COMPARISON, "C"))
    rounds = F.length(F.regexp_replace("__marks", r"[^(]++", ""))
    flat = F.aggregate(F.sequence(F.lit(0), rounds), F.col("__marks"), lambda acc, _: F.regexp_replace(acc, r"\( ?C(?: and C)*+ ?\)", "C"))
    df = df.withColumn("__flat", flat)
    aliases = F.transform(F.split("__from", " ?, ?"), lambda r: F.element_at(F.split(r, " "), -1))
    used = F.regexp_extract_all("__where", F.lit(rf"({_NAME})\.{_NAME}"), 1)
    times = F.regexp_extract_all(sql, F.lit(rf"'([^']*+)'{_BLANK}*+::{_BLANK}*+(?i:timestamp)"), 1)
    good = (
        (F.col("__from") != "")
        & ((F.col("__where") == "") | F.col("__flat").rlike("^C(?: and C)*+$"))
        & (F.size(F.array_except(used, aliases)) == 0)
        & F.forall(times, valid_timestamp)
    )
    return df.withColumn(to, good).drop("__text", "__from", "__where", "__marks", "__flat")


def _permissive(line: Column, fields: tuple[str, ...]) -> Column:
    schema = ", ".join(f"`{f}` string" for f in (*fields, "_corrupt"))
    return F.from_csv(line, schema, {"sep": "||", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "quote": "\u0000", "escape": "\u0000"})


def classify_lines(df: DataFrame, line_col: str = "raw_line", number_col: str = "line_number", format_col: str = "file_format") -> DataFrame:
    """df without its blank lines, with `reason` and the fields `query_sql`, `query_id`, `actual_cardinality`, `query_line`.

    reason is null for a line that loads, else the first that applies: `quoting` (a quote is never closed), `columns` (not
    the declared number of fields; also an unknown or null format), `value` (a count, id, line number or statement that is
    not valid). The fields are null where there is a reason. A null, empty or blank line gives no row. Rows delivered
    twice stay; existing columns with those names are replaced.
    """
    line, kind = F.col("__line"), F.col(format_col)
    rows = df.where(~is_blank(F.col(line_col))).withColumn("__line", F.translate(F.col(line_col), "\r\n", "  "))
    for name, fields in FORMATS.items():
        parsed = F.col(f"__{name}")
        rows = rows.withColumn(f"__{name}", F.when(kind == name, _permissive(line, fields)))
        rescanned = F.when(F.col("__again"), quoted_fields(line))
        plain = F.array(*(trimmed(F.coalesce(parsed[f], F.lit(""))) for f in fields))
        rows = rows.withColumn("__again", parsed["_corrupt"].isNotNull() | line.contains('"') | _separator_inside(line))
        rows = rows.withColumn(f"__{name}", F.when(kind == name, F.coalesce(rescanned, plain)))
    width = reduce(lambda acc, nf: F.when(kind == nf[0], F.lit(len(nf[1]))).otherwise(acc), FORMATS.items(), F.lit(-1))
    got = F.coalesce(*(F.col(f"__{name}") for name in FORMATS))

    def field(role: str) -> Column:
        return reduce(lambda acc, nf: F.when((kind == nf[0]) & F.lit(role in nf[1]), F.get(got, F.lit(nf[1].index(role) if role in nf[1] else 0))).otherwise(acc), FORMATS.items(), F.lit(None).cast("string"))

    rows = rows.withColumns({"__n": F.coalesce(F.size(got), F.lit(-2)), "__count": field("count"), "__sql": field("sql"), "__id": field("id")})
    rows = with_statement_check(rows, "__sql", "__statement")
    number = F.col(number_col).cast("string")
    fine = (
        (F.col("__count").isNull() | valid_count(F.col("__count")))
        & (F.col("__id").isNull() | F.col("__id").rlike("^[0-9]+$"))
        & F.coalesce(number.rlike(rf"^{_BLANK}*0*[1-9][0-9]*{_BLANK}*$"), F.lit(False))
        & F.col("__statement")
    )
    reason = (
        F.when(unclosed_quote(line), F.lit("quoting"))
        .when(F.col("__n") != width, F.lit("columns"))
        .when(~F.coalesce(fine, F.lit(False)), F.lit("value"))
    )
    good = reason.isNull()
    made = {
        "query_sql": F.when(good, F.col("__sql")),
        "query_id": F.when(good, F.coalesce(F.col("__id"), F.regexp_replace(trimmed(number), "^0+", ""))),
        "actual_cardinality": F.when(good, F.col("__count").try_cast("double")),
        "query_line": F.when(good, trimmed(number).try_cast("bigint")),
    }
    rows = rows.withColumn("reason", reason).withColumns(made)
    return rows.drop("__line", "__again", "__n", "__count", "__sql", "__id", "__statement", *(f"__{n}" for n in FORMATS))


def rejected_lines(df: DataFrame, id_col: str = "line_id") -> DataFrame:
    """(id, reason) of every non-blank line that cannot be loaded; lines delivered twice count once."""
    # exploding keeps the rows with a reason; a filter would be pushed down and compute every reason twice
    reasons = F.when(F.col("reason").isNotNull(), F.array("reason"))
    return classify_lines(df).select(id_col, F.explode(reasons).alias("reason")).distinct()


def loaded_queries(df: DataFrame, id_col: str = "line_id") -> DataFrame:
    """The lines that load, as queries; a line delivered twice comes out once."""
    cols = [id_col, "file_name", "file_format", "query_line", "query_id", "query_sql", "actual_cardinality"]
    rows = classify_lines(df)
    kept = F.when(F.col("reason").isNull(), F.array(F.struct(*cols)))
    return rows.select(F.explode(kept).alias("q")).select("q.*").dropDuplicates([id_col])
