import math

import pytest

from cardscope.llm.mixture import PATTERN, TOKENIZER, encoding, mixture, with_tokens

DOC, TARGET = "doc_id bigint, text string, source string, tokens string, weight double, copies int", "source string, target_share double, max_repeats int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "clash", w, 3) for i, (t, s, w) in enumerate(rows)], DOC)


def rows_of(*sizes):
    return [(" word" * (1 + (7 * k) % 23), s, 1.0 + k % 5) for s, n in sizes for k in range(n)]


def run(spark, rows, targets, **options):
    a, b = mixture(docs(spark, rows), spark.createDataFrame(targets, TARGET), **options)
    return {r["doc_id"]: r for r in a.collect()}, {r["source"]: r for r in b.collect()}


def test_tokens_round_trip_and_count(spark):
    bpe = encoding(TOKENIZER)
    text = "Planner's estimate: 1.5e3 rows — größer?\n\n  x"
    assert bpe.decode(bpe.encode_ordinary(text)) == text and PATTERN.startswith("'")
    got = {r["doc_id"]: r["tokens"] for r in with_tokens(docs(spark, [(text, "a", 1.0), (None, "a", 1.0), ("", "a", 1.0)]).drop("tokens"), "text").collect()}
    assert got == {0: len(bpe.encode_ordinary(text)), 1: 0, 2: 0}


@pytest.mark.parametrize("weight", [None, "weight"])
def test_shares_caps_and_fixed_size(spark, weight):
    rows = rows_of(("big", 900), ("Mid-Source ", 200), ("tiny", 20), ("unlisted", 50))
    targets = [("big", 0.5, 1), ("mid_source", 0.3, 4), ("tiny", 0.2, 12), ("zero", 0.0, 1)]
    chosen, report = run(spark, rows, targets, weight_col=weight)
    assert {r["source"] for r in chosen.values()} == {"big", "mid_source", "tiny"}
    caps = {"big": 1, "mid_source": 4, "tiny": 12}
    assert all(1 <= r["copies"] <= caps[r["source"]] for r in chosen.values())
    for s, share in (("big", 0.5), ("mid_source", 0.3), ("tiny", 0.2)):
        r = report[s]
        assert r["mixed_tokens"] == sum(x["tokens"] * x["copies"] for x in chosen.values() if x["source"] == s)
        assert abs(r["mixed_tokens"] - r["wanted_tokens"]) <= 12 and abs(r["actual_share"] - share) < 0.01 and r["in_reach"]
    assert report["zero"]["mixed_tokens"] == 0
    again, _ = run(spark, rows, targets, weight_col=weight)
    assert again == chosen
    other, _ = run(spark, rows, targets, weight_col=weight, seed=2)
    assert other != chosen


def test_whole_copies_come_first(spark):
    rows = rows_of(("a", 100), ("b", 100))
    chosen, report = run(spark, rows, [("a", 0.7, 9), ("b", 0.3, 9)], total_tokens=4000)
    f = report["a"]["wanted_tokens"] / report["a"]["available_tokens"]
    assert {r["copies"] for r in chosen.values() if r["source"] == "a"} <= {math.floor(f), math.ceil(f)}


def test_a_share_out_of_reach_is_reported(spark):
    rows = rows_of(("a", 300), ("tiny", 3))
    chosen, report = run(spark, rows, [("a", 0.5, 2), ("tiny", 0.4, 2), ("absent", 0.1, 5)])
    assert {i: r["copies"] for i, r in chosen.items() if r["source"] == "tiny"} == {300: 2, 301: 2, 302: 2}
    assert not report["tiny"]["in_reach"] and not report["absent"]["in_reach"] and report["a"]["in_reach"]
    assert report["absent"]["documents"] == 0 and report["tiny"]["actual_share"] < 0.4


def test_nulls_empty_tables_and_odd_targets(spark):
    rows = [(None, "a", 1.0), ("", "a", 1.0), ("word word", None, 1.0), ("word word", "a", None), ("word", "a", -1.0)]
    chosen, report = run(spark, rows, [("a", 1.0, None), (None, 0.5, 1), ("A ", None, 3), ("b", -1.0, 0)], weight_col="weight")
    assert {r["source"] for r in chosen.values()} == {"a"} and set(chosen) <= {3, 4} and set(report) == {"a", "b"}
    chosen, report = run(spark, [], [("a", 1.0, 1)])
    assert chosen == {} and report["a"]["mixed_tokens"] == 0
    assert run(spark, rows, []) == ({}, {})


def test_inclusion_is_fair_under_equal_weights(spark):
    rows = [("word word word", "a", 1.0)] * 60
    hits = [0] * 60
    for seed in range(12):
        chosen, _ = run(spark, rows, [("a", 1.0, 1)], total_tokens=90, seed=seed)
        assert len(chosen) == 30
        for i in chosen:
            hits[i] += 1
    assert max(hits) <= 12 and sum(hits) == 360 and sum(h in (0, 12) for h in hits) <= 3
