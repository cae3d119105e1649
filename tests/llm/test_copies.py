import random

from brute_copies import copies

from cardscope.llm.copies import canonical_statement, counted_statements, formatted_copies

BASE = "SELECT COUNT(*) FROM posts as p, users as u WHERE p.OwnerUserId = u.Id AND p.Score >= -3 AND u.Name = 'It''s (x); AND y'"
SAME = [
    BASE, BASE + ";;", BASE.replace(" ", "\n\t ").replace("'It''s\n\t (x);\n\t AND\n\t y'", "'It''s (x); AND y'"), "select count( * ) from \"users\" u , POSTS AS P where (u.id=P.owneruserid) and ( u.NAME='It''s (x); AND y' ) and p.score>=-3",
    "SELECT COUNT(*) FROM users as u, posts as p WHERE ((p.Score >= -3) AND u.Name = 'It''s (x); AND y') AND u.Id = p.OwnerUserId",
]
OTHER = [BASE.replace("-3", "3"), BASE.replace(">=", ">"), BASE.replace("'It", "'it"), BASE.replace("(x)", "x"), BASE.replace("posts as p", "posts as q").replace("p.", "q."), BASE + " AND p.Id = 1", BASE.replace("-3", "-3.0")]
SCHEMA = "key bigint, run string, sql string, text string, cls int"


def found(spark, rows, **options):
    return sorted(map(tuple, formatted_copies(spark.createDataFrame([(*r, None, 1) for r in rows], SCHEMA), "key", "run", "sql", **options).collect()))


def test_formatting_makes_no_difference_and_values_do(spark):
    rows = [(i + 10, "r", s) for i, s in enumerate(SAME + OTHER)]
    assert found(spark, rows) == [(10, k) for k in range(11, 10 + len(SAME))]


def test_random_formatting_against_a_plain_reading_hot_or_not(spark):
    rng = random.Random(4)

    def scribble(s):
        t = "".join(c.swapcase() if c.isalpha() and rng.random() < 0.5 else c for c in s)
        return t.replace(" ", rng.choice([" ", "  ", "\n", "\xa0"])).replace("<=", rng.choice(["<=", " <= "])) + rng.choice(["", ";", " ; "])

    texts = [f"select * from t{i % 3} as t where t.a <= {i % 7} and t.b = u.c" for i in range(40)]
    rows = [(i, rng.choice(["r1", "r2", None]), scribble(rng.choice(texts))) for i in range(400)]
    want = sorted(copies(rows))
    assert len(want) > 300
    assert found(spark, rows) == want
    assert found(spark, rows, hot_rows=8) == want


def test_nulls_empties_repeats_and_long_texts(spark):
    long = "SELECT * FROM t AS t WHERE " + " AND ".join(f"t.c{i} = {i}" for i in range(4000))
    rows = [(1, "r", None), (2, "r", None), (3, "r", ""), (4, "r", " ; "), (5, None, BASE), (6, None, BASE), (6, None, BASE), (7, "", BASE), (None, None, BASE), (8, "r", long), (9, "r", long.lower() + ";")]
    assert found(spark, rows) == [(3, 4), (5, 6), (8, 9)]
    df = spark.createDataFrame([(*r, None, 1) for r in rows], SCHEMA)
    counted = {r["first_key"]: r["copies"] for r in counted_statements(df, "key", "run", "sql").collect()}
    assert counted == {1: 1, 2: 1, 3: 2, 5: 2, 7: 1, 8: 2}
    assert found(spark, []) == []


def test_statements_where_order_or_parentheses_matter_stay_apart(spark):
    rows = [(1, "r", "select * from t where (a = 1 or b = 2) and c = 3"), (2, "r", "select * from t where a = 1 or (b = 2 and c = 3)"), (3, "r", "SELECT * FROM t WHERE ( a = 1 or b = 2 ) and c = 3;")]
    rows += [(4, "r", "select * from t where a between 1 and 2 and b between 3 and 4"), (5, "r", "select * from t where a between 1 and 4 and b between 3 and 2")]
    df = spark.createDataFrame([(*r, None, 1) for r in rows], SCHEMA)
    canon = {r["key"]: r["c"] for r in canonical_statement(df, "sql", "c").collect()}
    assert len(set(canon.values())) == 5 or canon[1] == canon[3]
    assert not any((a, b) in found(spark, rows) for a, b in ((1, 2), (4, 5)))


def test_white_space_of_unicode_makes_no_difference(spark):
    plain = "select count(*) from users as u, posts as p where u.id > 5 and p.owneruserid = u.id and u.name = 'a b'"
    blanks = [" ", "　", " ", " ", " ", " ", "\x85", "\x0b"]
    rows = [(i, "r", plain.replace(" from", f"{b}from").replace("u.id > 5", f"u.id{b}>{b}5").replace(" as u", f"{b}As{b}u")) for i, b in enumerate([" ", *blanks])]
    rows.append((99, "r", plain.replace("'a b'", "'a b'")))  # inside a text value it does
    assert found(spark, rows) == [(0, i) for i in range(1, len(blanks) + 1)]
