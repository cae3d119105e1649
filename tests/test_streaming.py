import datetime

from cardscope.sources.workload_lines import classify_lines
from cardscope.streaming.lines import LINE_SCHEMA, stream_lines, write_both


def test_a_stream_of_lines_is_loaded_like_a_table(spark, tmp_path):
    at = datetime.datetime(2024, 3, 1)
    rows = [(1, "f", "subquery", "1", "SELECT COUNT(*) FROM tags as t;||1", at), (2, "f", "subquery", "2", "SELECT", at), (3, "f", "subquery", "3", " ", at)]
    table = spark.createDataFrame(rows, LINE_SCHEMA)
    for part in (table, table.where("line_id < 3")):  # the second file delivers lines again
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    start = write_both(stream_lines(spark, str(tmp_path / "in")), str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "state"))
    start().awaitTermination(120)
    got = {(r["line_id"], r["reason"]) for name in ("good", "bad") for r in spark.read.parquet(str(tmp_path / name)).select("line_id", "reason").collect()}
    assert got == {(r["line_id"], r["reason"]) for r in classify_lines(table).select("line_id", "reason").collect()} == {(1, None), (2, "columns")}
    assert spark.read.parquet(str(tmp_path / "good")).count() == 1
