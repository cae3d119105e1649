import numpy as np

from cardscope.llm.residue import FEATURES, Scorer, features_of, fit, fit_on, is_trusted, passages_of, residue_records, without_residue

CLEAN = [f"The planner keeps {n} rows of {t} and the {k} join stays cheap." for n in range(40) for t in ("users", "posts") for k in ("hash", "merge")]
SHOWN = [
    "Dear {{name}}, the run is complete.", "Table: ${TABLE}", "Plan for <% plan %> uses __first_join__ as first join.", "Error 503: service unavailable.", "status=502 reason=bad gateway trace=77", "HTTP 404 - page not found",
    '{"error": {"code": 500, "message": "internal server error"}}', "<html><body><h1>Forbidden</h1></body></html>", "Please enable JavaScript to view this report.", "You must activate scripting to continue.", "tbd tbd tbd",
    "Lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor", "Traceback (most recent call last):",
]
TOLD = [
    'Users pasted this message: "Error 503: service unavailable.".', "The token `{{name}}` stands for the table.", "```\nDear {{name}}, the run is complete.\n```", "“Please enable JavaScript to view this report.” was the text.",
    "The proxy answered 'HTTP 404 - page not found' for an hour.", 'Our viewer prints "{"error": {"code": 500, "message": "x"}}" then.', "A 404 in the check means that the model is missing.", "The fixtures used lorem ipsum until last week.",
]
SCHEMA = "doc_id bigint, text string, score string, passage int"


def corpus(spark, texts):
    return spark.createDataFrame([(i, t, "clash", 0) for i, t in enumerate(texts)], SCHEMA)


def test_shown_residue_is_found_and_quoted_residue_is_not(spark):
    mixed = [f"{CLEAN[i]}\n{s}\n{CLEAN[i + 1]}" for i, s in enumerate(SHOWN)]
    texts = SHOWN + mixed + CLEAN + TOLD + [f"{CLEAN[i]} {t}" for i, t in enumerate(TOLD) if not t.startswith("```")]
    got = {r[0] for r in residue_records(corpus(spark, texts)).collect()}
    assert got == set(range(2 * len(SHOWN)))


def test_expectation_maximisation_finds_unlabelled_residue_by_its_words():
    seeds = ["status=1 reason=service unavailable trace=2", "status=1 reason=bad gateway trace=2", "Error 503: service unavailable.", "Error 502: bad gateway."] * 5
    hidden = ["We regret: service unavailable", "bad gateway upstream", "Again service unavailable"]
    w = fit([features_of(p) for p in seeds], [features_of(p) for p in CLEAN + hidden])
    score = Scorer(w)
    assert all(score(h) > 0 for h in hidden) and all(score(c) < 0 for c in CLEAN)
    assert not any(map(is_trusted, hidden))


def test_templates_never_seen_and_no_form_are_found_by_their_words(spark):
    """Held out: no form matches these templates, and none of them is among the fitted texts."""
    errors = [f"Error {c}: {w}." for c in (500, 502, 503) for w in ("service unavailable", "bad gateway", "the server could not complete your request", "please try again later")]
    scripts = [f"Please enable JavaScript {t}" for t in ("to view this page.", "in your browser and reload.", "to load the report.", "and cookies to continue.")]
    fillers = ["Lorem ipsum dolor sit amet consectetur.", "tbd tbd tbd content to be added", "{{title}} sample paragraph goes here", "Dear {{name}}, sample text goes here"]
    telling = [f"We saw that the {w} for {t} rows came back." for w in ("service", "request", "page", "script") for t in ("users", "posts", "votes")]
    w = fit_on(corpus(spark, (errors + scripts + fillers) * 3 + CLEAN + telling))
    score = Scorer(w)
    held = ["Service unavailable, please try again later.", "The server could not complete your request.", "Cookies and JavaScript are needed to continue in your browser.", "Sample paragraph, content to be added.", "Sample text goes here"]
    assert not any(map(is_trusted, held))
    assert [p for p in held if score(p) <= 0] == []
    clean = [f"The optimizer joins {t} with {u} over {n} rows of the plan." for t in ("tags", "votes") for u in ("badges", "links") for n in range(20)]
    assert [p for p in clean + telling if score(p) > 0] == []


def test_no_seeds_no_residue_and_bounded_fit(spark):
    assert fit([], [features_of(CLEAN[0])])[-1] == -np.inf
    assert residue_records(corpus(spark, CLEAN)).count() == 0
    w = fit_on(corpus(spark, CLEAN + SHOWN * 20), fit_documents=100)
    assert w.shape == (FEATURES + 1,)


def test_nulls_empties_repeats_long_texts_and_exclusion(spark):
    texts = [None, "", "  \n ", SHOWN[3], SHOWN[3], "x" * 200_000 + "\n" + SHOWN[0], "{" * 5000, '"' * 3001, "word " * 60_000]
    df = corpus(spark, texts)
    assert sorted(r[0] for r in residue_records(df).collect()) == [3, 4, 5]
    assert sorted(r[0] for r in without_residue(df).select("doc_id").collect()) == [0, 1, 2, 6, 7, 8]
    assert residue_records(corpus(spark, [])).count() == 0


def test_passages_hide_quotes_and_mark_placeholders():
    assert passages_of("[10:20] bot: He said \"stop. now\" twice. Value: {{ x }}.") == ["He said  §quote  twice.", "Value:  §curly ."]


def test_slots_of_any_beginning_are_marked():
    for slot in ("[2-3 sentences here]", "<3 items here>", "[1 short example goes here]", "[insert name]", "<Your title>"):
        assert is_trusted(passages_of(f"Summary: {slot} done")[0]), slot
    for plain in ("x < 5 and y > 3", "[10:20] was the time", "a[i] = b[j]", "5% of rows", "C# and F#", "rows #3"):
        assert "§" not in passages_of(plain)[0], plain
