"""Records that differ in formatting only, by progressive refinement of a partition.

All rows are first parted by invariants that cost little: run, length and letter histogram of the text without white space,
quotes around names, parentheses, semicolons and the letters of the optional word AS. No two copies differ in them. Only rows that share
their class with another go on to the costly key, the statement in canonical form: relations, join conditions and filters
parsed and sorted. Classes are counted map-side; rows meet their class by a shuffle join, or by broadcast for the boundedly
many classes too large for one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardscope.operators.joins import attach
from cardscope.session import HOT_ROWS, MAX_HOT, cut_lineage, hot_of

# White space, of Unicode as a whole.
_BLANK = r"\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_OPAQUE = r"(?:^| )(?:or|not|between|union|join|group|order|having|case|in|is|like|exists|limit)(?: |$)"
_SHAPE = r"^select ?(.*?) ?from (.*?)(?: where (.*))?$"
_NAME = r"[a-z_][a-z0-9_]*+"


def invariants(text: Column) -> Column:
    """A hash of what no formatting changes: length and histogram of the letters that matter. The letters of the optional AS are
    left out, so that no word has to be looked for."""
    bare = F.translate(F.lower(text), _BLANKS + '"();as', "")
    return F.xxhash64(F.length(bare), F.array_sort(F.split(bare, "")))


def _outside(piece: Column, parentheses: bool) -> Column:
    drop = rf'[{_BLANK}";]++' if parentheses else rf'[{_BLANK}"();]++'
    return F.regexp_replace(F.regexp_replace(F.lower(piece), drop, " "), r" ?([<>=.,:*]++) ?", "$1")


def _tokens(text: Column, parentheses: bool) -> Column:
    # every second piece between apostrophes is a text value, kept as written and hidden from the parsing below
    pieces = F.transform(F.split(text, "'"), lambda p, i: F.when(i % 2 == 1, F.hex(F.encode(p, "UTF-8"))).otherwise(_outside(p, parentheses)))
    return F.trim(F.regexp_replace(F.array_join(pieces, "'"), " ++", " "))


def canonical_statement(df: DataFrame, text_col: str, to: str) -> DataFrame:
    """df with `to`: the statement in a form that only its meaning decides.

    White space, letter case outside text values, quotes around names, parentheses, semicolons, the word AS, the order of
    relations and of conditions, and the sides of a join equality make no difference. Values and operators stay as written;
    a condition written twice counts twice. A statement with OR, NOT, BETWEEN or another word that gives parentheses or
    order a meaning, or that is no SELECT … FROM, keeps its parentheses and its order. Null stays null.
    """
    df = df.withColumn("__t", _tokens(F.col(text_col), False))
    part = lambda k: F.regexp_extract("__t", _SHAPE, k)
    relations = F.array_sort(F.transform(F.split(part(2), ","), lambda r: F.regexp_replace(F.trim(r), r" as ", " ")))

    def sided(c: Column) -> Column:
        c = F.trim(c)
        return F.when(c.rlike(rf"^{_NAME}\.{_NAME}={_NAME}\.{_NAME}$"), F.array_join(F.array_sort(F.split(c, "=")), "=")).otherwise(c)

    conditions = F.array_sort(F.transform(F.split(part(3), " and "), sided))
    parsed = F.concat_ws("\n", part(1), F.array_join(relations, ","), F.array_join(conditions, " and "))
    whole = F.col("__t").rlike(_OPAQUE) | ~F.col("__t").rlike(_SHAPE)
    return df.withColumn(to, F.when(F.col("__t").isNotNull(), F.when(whole, _tokens(F.col(text_col), True)).otherwise(parsed))).drop("__t")


def formatted_copies(df: DataFrame, key_col: str, run_col: str, text_col: str, hot_rows: int = HOT_ROWS, max_hot: int = MAX_HOT) -> DataFrame:
    """(first_key, copy_key): every member of a set of copies but the one with the smallest key, next to that key.

    Copies have the same run (null being a run of its own) and the same canonical statement, compared by its SHA-256. A null
    text has no copies; empty texts are copies of each other. key_col should be unique; rows with an equal key are one member.
    Rows with a null key are left out. Other columns are not read.
    """
    rows = df.select(F.col(key_col).alias("key"), F.col(run_col).alias("run"), F.col(text_col).alias("text"))
    rows = rows.where("key is not null and text is not null").withColumn("cls", F.xxhash64("run", F.col("run").isNull(), invariants(F.col("text"))))
    counts = rows.groupBy("cls").count().where("count > 1")
    counts = cut_lineage(counts)
    shared = attach(rows, counts.drop("count"), ["cls"], hot_of(counts, hot_rows, max_hot), "left_semi")
    # the canonical form is made once, here; from now on a row is a key and a digest
    costly = canonical_statement(shared, "text", "canon")
    members = cut_lineage(costly.select("key", F.sha2(F.concat_ws("\n", F.col("run").isNull().cast("string"), F.coalesce("run", F.lit("")), "canon"), 256).alias("digest")))
    classes = cut_lineage(members.groupBy("digest").agg(F.min("key").alias("first_key"), F.count("*").alias("count")).where("count > 1"))
    found = attach(members, classes.drop("count"), ["digest"], hot_of(classes, hot_rows, max_hot), "inner")
    return found.where("key <> first_key").select("first_key", F.col("key").alias("copy_key")).distinct()


def counted_statements(df: DataFrame, key_col: str, run_col: str, text_col: str, hot_rows: int = HOT_ROWS, max_hot: int = MAX_HOT) -> DataFrame:
    """(run, first_key, copies): every statement once per run, with the number of its members; a null text counts alone."""
    pairs = cut_lineage(formatted_copies(df, key_col, run_col, text_col, hot_rows, max_hot))
    rows = df.select(F.col(key_col).alias("first_key"), F.col(run_col).alias("run")).where("first_key is not null").distinct()
    firsts = rows.join(pairs.select(F.col("copy_key").alias("first_key")), "first_key", "left_anti")
    more = pairs.groupBy("first_key").agg(F.count("*").alias("more"))
    return firsts.join(more, "first_key", "left").select("run", "first_key", (F.coalesce("more", F.lit(0)) + 1).alias("copies"))
