from brute_lines import reason_of

from cardscope.sources.workload_lines import classify_lines, loaded_queries, rejected_lines

GOOD = "SELECT COUNT(*) FROM posts as p, users as u WHERE p.OwnerUserId = u.Id AND p.Score >= -3"
SCHEMA = "line_id bigint, file_name string, file_format string, line_number string, raw_line string, received_at timestamp"
CASES = [
    ("complete", "1", f"12||{GOOD};"), ("complete", " 007 ", f"1.5e3 || \"{GOOD};\" \r"), ("complete", "0", f"12||{GOOD}"), ("complete", None, f"12||{GOOD}"), ("complete", "1.0", f"12||{GOOD}"),
    ("complete", "3", f"-1||{GOOD}"), ("complete", "3", f"1e400||{GOOD}"), ("complete", "3", f"31f||{GOOD}"), ("complete", "3", f"NaN||{GOOD}"), ("complete", "3", f"1_204||{GOOD}"), ("complete", "3", f"||{GOOD}"),
    ("complete", "3", f"٣||{GOOD}"), ("complete", "3", f"12||{GOOD}||"), ("complete", "3", f"12||||{GOOD}"), ("complete", "3", f"12|{GOOD}"), ("complete", "3", "12"),
    ("complete", "3", f"12||{GOOD} AND p.Title = 'a||b'"), ("complete", "3", f"12||{GOOD} AND p.Title = 'it''s'"), ("complete", "3", f"12||{GOOD} AND p.Title = 'it's'"), ("complete", "3", f"12||\"{GOOD}"),
    ("complete", "3", f"12||{GOOD}\""), ("complete", "3", f"12||{GOOD} AND p.Title = '5\" x'"), ("complete", "3", f"12||\"{GOOD} AND p.Title = 'a||b'\""), ("complete", "3", f"12||\"{GOOD} AND p.Title = 'it's'\""),
    ("complete", "3", f"12||({GOOD})"), ("complete", "3", "12||SELECT COUNT(*) FROM posts as p WHERE ((p.Id = 1) AND (p.Score < 2))"), ("complete", "3", "12||SELECT COUNT(*) FROM posts as p WHERE ((p.Id = 1)"),
    ("complete", "3", "12||SELECT COUNT(*) FROM posts as p WHERE q.Id = 1"), ("complete", "3", "12||SELECT COUNT(*) FROM psots as p"), ("complete", "3", "12||SELECT COUNT(*) FROM posts as p WHERE p.Id =>"),
    ("complete", "3", "12||SELECT COUNT(*) FROM posts as p WHERE p.Id = 1 OR p.Id = 2"), ("complete", "3", "12||SELECT COUNT( * )\tFROM POSTS AS P WHERE P.CreationDate<='2012-02-29 10:11:12'::timestamp ; ;"),
    ("complete", "3", "12||SELECT COUNT(*) FROM posts as p WHERE p.CreationDate <= '2011-02-29 10:11:12'::timestamp"), ("complete", "3", "12||SELECT COUNT(*) FROM posts as p WHERE p.CreationDate <= '2012-02-29 24:11:12'::timestamp"),
    ("single_table", "1", "SELECT COUNT(*) FROM tags as t;||7||0"), ("single_table", "1", "SELECT COUNT(*) FROM tags as t;||x7||0"), ("single_table", "1", "SELECT COUNT(*) FROM tags as t;||7"),
    ("subquery", "1", f"{GOOD};||7"), ("subquery", "1", f"{GOOD};||7||5"), ("subquery", "1", f"{GOOD};||"), ("subquery", "1", f"\"{GOOD};\"||\"7\""),
    ("odd", "1", f"{GOOD};||7"), (None, "1", f"{GOOD};||7"), ("subquery", "1", None), ("subquery", "1", " \t  "), ("subquery", "1", ""), ("subquery", "1", "'"), ("complete", "1", "5||" + GOOD + " AND p.Score < 9" * 3000),
]


def test_reasons_agree_with_a_plain_reading(spark):
    rows = [(i, "f", f, n, line, None) for i, (f, n, line) in enumerate(CASES)]
    got = {r["line_id"]: r["reason"] for r in classify_lines(spark.createDataFrame(rows, SCHEMA)).select("line_id", "reason").collect()}
    want = {i: reason_of(f, n, line) for i, (f, n, line) in enumerate(CASES)}
    assert got == {i: r for i, r in want.items() if r != "blank"}


def test_repeats_count_once_and_fields_are_read(spark):
    rows = [(1, "f", "complete", "1", f"12||{GOOD};", None)] * 2 + [(2, "f", "complete", "2", "x", None)] * 2 + [(3, "f", "single_table", "3", '"SELECT COUNT(*) FROM tags as t;" || 44 || 1e2', None)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [tuple(r) for r in rejected_lines(df).collect()] == [(2, "columns")]
    loaded = {r["line_id"]: r for r in loaded_queries(df).collect()}
    assert set(loaded) == {1, 3}
    assert (loaded[1]["query_id"], loaded[1]["actual_cardinality"], loaded[1]["query_sql"]) == ("1", 12.0, f"{GOOD};")
    assert (loaded[3]["query_id"], loaded[3]["actual_cardinality"]) == ("44", 100.0)


def test_empty_table_and_clashing_names(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert rejected_lines(empty).count() == 0 and loaded_queries(empty).count() == 0
    clash = spark.createDataFrame([(1, "f", "complete", "1", f"12||{GOOD}", None)], SCHEMA).selectExpr("*", "'x' AS reason", "1 AS query_id", "2 AS count", "3 AS sql")
    assert classify_lines(clash).select("reason").first()[0] is None
