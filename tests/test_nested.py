import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row

from cardscope.operators.nested import StructuralIndex, join_tables, linked_records, plan_records, plan_tables


def walk(text):
    """Records of a document by a plain JSON parser."""
    try:
        value = json.loads(text, parse_constant=lambda c: 1 / 0)
    except (ValueError, ZeroDivisionError, RecursionError):
        return set()
    return of(value)


def of(value):
    if isinstance(value, str):
        return walk(value)
    out = set()

    def node(n, path, parent):
        out.add(("node", path, parent))
        for kind, mark in (("Workers", "w"), ("Plans", "")):
            for i, c in enumerate(n.get(kind) if isinstance(n.get(kind), list) else []):
                if isinstance(c, dict):
                    node(c, f"{path}.{i}", path) if kind == "Plans" else out.add(("worker", f"{path}.{mark}{i}", path))

    todo = [value]  # breadth first: the least deep Plan is the root
    while todo:
        v = todo.pop(0)
        if isinstance(v, dict):
            if isinstance(v.get("Plan"), dict):
                node(v["Plan"], "0", "")
                break
            v = list(v.values())
        todo += v if isinstance(v, list) else []
    return out


def got(text):
    return {(k, p, q) for _, k, p, q in plan_records([text.encode()])}


NODE = st.recursive(
    st.fixed_dictionaries({"Node Type": st.text(max_size=5)}),
    lambda n: st.fixed_dictionaries({"Node Type": st.text(max_size=8), "x": st.one_of(st.none(), st.floats(allow_nan=False, allow_infinity=False), st.booleans())}, optional={"Plans": st.one_of(st.none(), st.lists(st.one_of(st.none(), n, st.integers()), max_size=3)), "Workers": st.lists(st.one_of(st.none(), st.just({"Worker Number": 1}), st.just([])), max_size=2)}),
    max_leaves=12,
)


@settings(max_examples=150, deadline=None)
@given(NODE, st.sampled_from([None, 1, 2]), st.sampled_from(["plain", "list", "lists", "string", "spare"]))
def test_documents_agree_with_a_json_parser(node, indent, wrap):
    value = {"Planning Time": 0.5, "Plan": node}
    text = json.dumps({"plain": value, "list": [value], "lists": [[value], {"Execution Time": 1}], "spare": value, "string": json.dumps(value)}[wrap], indent=indent)
    assert got(text) == walk(text) != set()


@settings(max_examples=200, deadline=None)
@given(st.recursive(st.one_of(st.none(), st.booleans(), st.integers(), st.floats(), st.text(max_size=6)), lambda v: st.one_of(st.lists(v, max_size=3), st.dictionaries(st.text(max_size=4), v, max_size=3)), max_leaves=10), st.data())
def test_validity_agrees_with_a_json_parser(value, data):
    text = json.dumps(value)
    at = data.draw(st.integers(0, len(text)))
    for t in (text, text[:at], text[:at] + data.draw(st.sampled_from(list('{}[],:"\\ 1ue-'))) + text[at:]):
        try:
            json.loads(t, parse_constant=lambda c: 1 / 0)
            good = True
        except (ValueError, ZeroDivisionError):
            good = False
        assert StructuralIndex([t.encode()]).ok[0] == good, t


def test_bad_documents_do_not_harm_their_neighbours():
    good = json.dumps({"Plan": {"Plans": [None, {"Plans": []}]}}).encode()
    rows = plan_records([b"", b'{"Plan":{"Plans":[{', good, b'"', b"}}", b'{"Plan": {"a": "\\"}}', good, b"[1,2"])
    assert {(d, p) for d, _, p, _ in rows} == {(2, "0"), (2, "0.1"), (6, "0"), (6, "0.1")}


JOIN = "struct<node_type:string,join_type:string,relations:array<string>,branch_relations:array<array<string>>,is_base_join:boolean,base_join_key:string,plan_rows:double>"
SCHEMA = f"treatment_id bigint, document string, all_joins array<{JOIN}>, path string, id int"


def test_tables_link_to_their_parents(spark):
    j = Row("Hash Join", "Inner", ["a", "b"], [["a"], None, [None, "b"]], True, "a|b", 3.0)
    doc = json.dumps([{"Plan": {"Node Type": "Gather", "Workers": [None, {"Worker Number": 0}], "Plans": [{"Node Type": "Scan", "a\"b": "c\nd"}]}}])
    rows = [(1, doc, [None, j], "x", 1), (1, doc, [None, j], "x", 1), (2, None, None, None, 2), (3, doc[:-4], [], "y", 3), (None, doc, None, None, 4), (5, "", [None], "", 5)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {tuple(r) for r in linked_records(df, "treatment_id", "document", "all_joins").collect()}
    plan = {("node", "0", ""), ("node", "0.0", "0"), ("worker", "0.w1", "0")}
    assert got == {(i, *p) for i in (1, None) for p in plan} | {(1, "join", "j1", ""), (1, "relation", "j1.0.0", "j1"), (1, "relation", "j1.2.1", "j1")}
    facts = {r["path"]: r["attributes"] for r in plan_tables(df.where("treatment_id = 1"), "treatment_id", "document", attributes=True).collect()}
    assert facts["0.0"] == {"Node Type": "Scan", 'a"b': "c\nd"} and facts["0.w1"] == {"Worker Number": "0"}
    joins, relations = join_tables(df, "treatment_id", "all_joins")
    assert [(r["path"], r["node_type"], r["plan_rows"]) for r in joins.collect()] == [("j1", "Hash Join", 3.0)]
    assert {(r["branch"], r["place"], r["relation"]) for r in relations.collect()} == {(0, 0, "a"), (2, 1, "b")}


def test_the_least_deep_plan_is_the_root_and_half_pairs_do_no_harm(spark):
    settings_first = '{"Settings":{"Plan":{}},"Plan":{"Plans":[{}],"Plan":{"Plans":[{},{}]}}}'
    assert got(settings_first) == {("node", "0", ""), ("node", "0.0", "0")}
    half = '{"Plan":{"Alias":"a\\ud800b","Node\\u0020Type":"Seq Scan","Alias":"\\ud83d\\ude00","\\ud800":1,"n":[1,{"x":"y"}],"Plans":[{"Filter":"\\udfff"}]}}'
    df = spark.createDataFrame([(1, half), (2, json.dumps(half)), (3, "[[" + json.dumps(half) + ', {"Plan":{"z":1}}]]')], "id int, d string")
    rows = {(r["id"], r["path"]): r["attributes"] for r in plan_tables(df, "id", "d", attributes=True).collect()}
    want = {"Alias": "\U0001f600", "Node Type": "Seq Scan", "\ufffd": "1", "n": '[1,{"x":"y"}]'}
    assert rows[(1, "0")] == rows[(2, "0")] == want and rows[(1, "0.0")] == {"Filter": "\ufffd"} and rows[(3, "0")] == {"z": "1"}


def test_empty_table_and_deep_document(spark):
    assert linked_records(spark.createDataFrame([], SCHEMA), "treatment_id", "document", "all_joins").count() == 0
    deep = '{"Plan":' + '{"Plans":[' * 300 + "{}" + "]}" * 300 + "}"
    assert len(plan_records([deep.encode()])) == 301
