from __future__ import annotations

import json

from quire.functions import analysis_json as aj
from quire.operators import nested

ANALYSIS = {
    "entities": {"characters": [{"name": "A"}, None, "B", {}, ""], "locations": "L", "organizations": {"name": "O"}},
    "relationships_interactions": {"participants": "A"},
    "events": None,
    "keywords_topics": ["t", ""],
    "other": ["no case"],
}
PATHS = {"entities.characters[0]", "entities.characters[2]", "entities.locations[0]", "entities.organizations[0]", "relationships_interactions[0]", "relationships_interactions[0].participants[0]", "keywords_topics[0]"}


def _paths(spark, texts, what=nested.analysis_nodes):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "row_id bigint, t string, node_path string, pre int")
    out: dict[int, set] = {}
    for r in what(df, "row_id", "t").collect():
        out.setdefault(r.record_key, set()).add(r.node_path)
    return out


def test_wrapped_and_drifting_shapes_give_the_same_nodes(spark):
    plain = json.dumps(ANALYSIS)
    texts = [plain, f"```json\n{plain}\n```", json.dumps(plain), json.dumps([ANALYSIS]), f"Here it is:\n{plain}\nDone."]
    assert _paths(spark, texts) == {i: PATHS for i in range(len(texts))}


def test_what_does_not_parse_has_no_nodes(spark):
    assert _paths(spark, [None, "", " ", "no", json.dumps(ANALYSIS)[:-5], "[1, 2]", "3", '"x"']) == {}


def test_structures_to_any_depth(spark):
    unit = {"type": "C", "subsections": {"type": "S", "subsections": [None, {"type": "T"}]}}
    deep: dict = {"type": "x"}
    for _ in range(150):
        deep = {"type": "x", "subsections": [deep]}
    got = _paths(spark, [json.dumps([unit]), json.dumps(unit), json.dumps({"structure": [unit]}), json.dumps([deep])], nested.structure_nodes)
    want = {"structure[0]", "structure[0].subsections[0]", "structure[0].subsections[0].subsections[1]"}
    assert got[0] == got[1] == got[2] == want
    assert len(got[3]) == 151


def test_intervals_link_parents_and_children(spark):
    unit = [{"type": "C", "subsections": [{"type": "S", "subsections": [{"type": "T"}]}, {"type": "S"}]}, {"type": "C"}]
    df = spark.createDataFrame([(1, json.dumps(unit)), (2, json.dumps(unit)), (2, json.dumps(unit))], "row_id bigint, structure string").dropDuplicates()
    nodes = nested.structure_nodes(df)
    links = {(r.ancestor_path, r.node_path, r.is_parent) for r in nested.link(nodes, nodes).where("record_key = 1").collect()}
    assert links == {
        ("structure[0]", "structure[0].subsections[0]", True), ("structure[0]", "structure[0].subsections[1]", True),
        ("structure[0]", "structure[0].subsections[0].subsections[0]", False), ("structure[0].subsections[0]", "structure[0].subsections[0].subsections[0]", True),
    }


def test_repeated_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(1, '{"events": ["e"]}')] * 2, "row_id bigint, analysis string")
    assert nested.analysis_nodes(df).count() == 2
    assert nested.analysis_nodes(df.limit(0)).count() == 0


def test_json_helpers():
    assert aj.load('{"a": 1} and more') == {"a": 1}
    assert aj.load("[1") is None
    assert aj.name_of({"name": " "}) is None and aj.name_of("x") == "x" and aj.name_of(3) is None
    assert aj.elements(None) == [] and aj.elements("a") == ["a"] and aj.elements([None]) == [None]
    assert aj.is_nothing({}) and aj.is_nothing("") and not aj.is_nothing(0) and not aj.is_nothing([])
