import random
import re

from cardscope.llm.leakage import ItemAutomaton, leaked_items, leaked_passages

WORDS = [f"w{i}" for i in range(30)]
DOC, ITEM = "doc_id bigint, text string, item_id string, field int", "item_id bigint, item_text string, answer string, text int"


def plain_words(text):
    return [w.casefold() for w in re.findall(r"[^\W_]+", text)]


def brute(docs, items, m=12):
    grams = lambda t: {tuple(w[i : i + m]) for w in [plain_words(t or "")] for i in range(len(w) - m + 1)}
    return sorted({(d, i) for d, t in docs for i, s in items if grams(t) & grams(s)})


def found(spark, docs, items, **options):
    d = spark.createDataFrame([(*x, "clash", 0) for x in docs], DOC)
    i = spark.createDataFrame([(*x, None, 0) for x in items], ITEM)
    return sorted(map(tuple, leaked_items(d, i, **options).collect()))


def corpus(seed):
    rng = random.Random(seed)
    items = [(i, " ".join(rng.choices(WORDS, k=rng.choice([5, 11, 12, 13, 25, 60])))) for i in range(40)]
    docs = []
    for d in range(400):
        text = rng.choices(WORDS, k=rng.randrange(40))
        for _, s in rng.sample(items, 2):
            w = s.split()
            a = rng.randrange(len(w))
            cut = w[a : a + rng.choice([8, 11, 12, 14, 60])]
            text += cut + rng.choices(WORDS, k=3)
        docs.append((d, "".join(w.upper() + rng.choice([" ", "\n", ", ", "_", " - "]) for w in text)))
    return docs, items


def test_passages_agree_with_all_runs_of_twelve_words(spark):
    docs, items = corpus(1)
    want = brute(docs, items)
    assert 50 < len(want)
    assert found(spark, docs, items) == want
    assert found(spark, docs, items, block_chars=300) == want
    assert found(spark, docs, items, min_words=8, anchor_words=3) == brute(docs, items, 8)


def test_offsets_lead_to_the_words(spark):
    item = "Über Größe und Maß: 1.5 rows, two-pass scan of The Table with éclat"
    text = f"vorher … {item.upper()} nachher"
    got = leaked_passages(spark.createDataFrame([(1, text, "", 0)], DOC), spark.createDataFrame([(7, item, None, 0)], ITEM)).collect()
    assert [plain_words(text[r["first_char"] : r["end_char"]]) for r in got] == [plain_words(item)]
    assert got[0]["words"] == len(plain_words(item)) and got[0]["field"] == "item_text"


def test_anchors_miss_no_run():
    words = [f"x{i}" for i in range(40)]
    automaton = ItemAutomaton([(1, "t", " ".join(words))])
    for a in range(40):
        for n in (11, 12, 20):
            cut = words[a : a + n]
            assert bool(automaton.runs("y " + " ".join(cut) + " z")) == (len(cut) >= 12)


def test_nulls_empties_repeats_ties_and_long_texts(spark):
    item = " ".join(WORDS[:15])
    docs = [(1, None), (2, ""), (3, "--- ___ !!!"), (4, item), (4, item), (5, "filler " * 60_000 + item), (None, item), (6, " ".join(WORDS[:11]))]
    items = [(1, item), (2, item), (3, None), (4, ""), (5, "short one")]
    assert found(spark, docs[:6] + docs[7:], items) == [(d, i) for d in (4, 5) for i in (1, 2)]
    assert {r for r in map(tuple, leaked_items(spark.createDataFrame([(*docs[6], "", 0)], DOC), spark.createDataFrame([(1, item, None, 0)], ITEM)).collect())} == {(None, 1)}
    assert found(spark, [], items) == [] and found(spark, docs[:2], []) == []


def test_one_scan_for_many_blocks_and_many_hits(spark, monkeypatch):
    import time

    from cardscope.llm import leakage

    docs, items = corpus(2)
    want = brute(docs, items)
    monkeypatch.setattr(leakage, "KEPT", 2)  # in the driver: documents are then gathered in chunks
    d = spark.createDataFrame([(*x, "clash", 0) for x in docs], DOC)
    i = spark.createDataFrame([(*x, None, 0) for x in items], ITEM)
    found_ = leaked_items(d, i, block_chars=300)
    assert found_._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert sorted(map(tuple, found_.collect())) == want
    item = " ".join(WORDS[:12])
    automaton = ItemAutomaton([(1, "t", item), (2, "t", item.upper())])
    took = []
    for n in (1000, 8000):
        began = time.time()
        got = automaton.passages((item + " and then ") * n)
        took.append(time.time() - began)
        assert len(got) == 2 * n
    assert took[1] < 25 * max(took[0], 0.01)


def test_short_answers_stand_near_their_item(spark):
    item = " ".join(WORDS[:15])
    docs = [(1, f"{item} and the answer is Forty-Two rows"), (2, "forty two"), (3, item + " x" * 50 + " forty two"), (4, "Forty two: " + item)]
    d = spark.createDataFrame([(*x, "clash", 0) for x in docs], DOC)
    i = spark.createDataFrame([(1, item, "forty two", 0), (2, None, "forty two", 0)], ITEM)
    rows = leaked_passages(d, i).collect()
    assert sorted((r["doc_id"], r["item_id"], r["field"]) for r in rows) == [(1, 1, "answer"), (1, 1, "item_text"), (3, 1, "item_text"), (4, 1, "answer"), (4, 1, "item_text")]
    assert [docs[0][1][r["first_char"] : r["end_char"]] for r in rows if (r["doc_id"], r["field"]) == (1, "answer")] == ["Forty-Two"]
