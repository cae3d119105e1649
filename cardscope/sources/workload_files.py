"""Workload files: text lines with fields between ||, numbered by their place in the file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cardscope.operators import workload
from cardscope.sources.workload_lines import FORMATS, is_blank, quoted_fields, trimmed


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line_number, line) of text files, numbers from 1. A file is read in blocks by many tasks: lines are numbered within
    their block and shifted by the lines of earlier blocks, of which there are few."""
    rows = spark.read.text(path).select(F.col("value").alias("line"), F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))).alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    counts = rows.groupBy("file", "block").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("file", "block", before.alias("before"))
    here = F.row_number().over(Window.partitionBy("file", "block").orderBy("at"))
    return rows.withColumn("here", here).join(counts, ["file", "block"]).select("file", (F.col("here") + F.col("before")).alias("line_number"), "line")


def load_workload(spark: SparkSession, path: str | list[str], file_format: str = "auto", prefix: str | None = None, templates: DataFrame | None = None, default_template: str = "workload") -> DataFrame:
    """(file, line_number, label, query_id, sql, actual_cardinality, template) of the lines of workload files.

    file_format: complete, single_table, subquery, or auto for what each line looks like. Blank lines are passed over. The label is
    the prefix, else the name of the file, with the line number; it stands for a missing query id. Files without a line, and a line
    that is not of its format, are errors. templates: a map (template, label, query_id)."""
    if file_format != "auto" and file_format not in FORMATS:
        raise ValueError(f"unknown format {file_format!r}")
    rows = numbered_lines(spark, path)
    filled = rows.where(~is_blank(F.col("line")))
    if filled.isEmpty():
        raise ValueError(f"no query in {path}")
    kind = workload.detect_format(trimmed(F.col("line"))) if file_format == "auto" else F.lit(file_format)
    fields = filled.withColumns({"kind": kind, "fields": quoted_fields(F.col("line"))})
    wrong = F.raise_error(F.concat(F.lit("line "), F.col("line_number").cast("string"), F.lit(" is not of its format: "), F.col("line"))).cast("string")
    width = F.coalesce(*(F.when(F.col("kind") == n, F.lit(len(f))) for n, f in FORMATS.items()), F.lit(-1))
    fields = fields.withColumn("kind", F.when(F.size("fields") == width, F.col("kind")).otherwise(wrong))

    def role(name: str):
        return F.coalesce(*(F.when(F.col("kind") == n, F.get("fields", F.lit(f.index(name)))) for n, f in FORMATS.items() if name in f))

    named = F.lit(prefix) if prefix is not None else F.regexp_replace(F.regexp_extract("file", r"([^/]+)$", 1), r"\.[^.]*$", "")
    count = role("count")
    number = F.when(count.isNull() | count.try_cast("double").isNotNull(), count.try_cast("double")).otherwise(wrong.cast("double"))
    out = fields.withColumn("label", workload.label(named, F.col("line_number")))
    out = out.select("file", "line_number", "label", F.coalesce(role("id"), F.col("label")).alias("query_id"), role("sql").alias("sql"), number.alias("actual_cardinality"))
    return out.withColumn("template", F.lit(default_template)) if templates is None else workload.with_template(out, templates, default_template)
