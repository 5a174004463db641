from __future__ import annotations

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from quire.operators import analyses as an
from quire.operators import graph as g
from quire.operators import library as lib
from quire.operators import nested_values as nv
from quire.operators import retrieval as rt
from quire.operators import tensors as t


def _chunk(characters, interactions, locations=()):
    return json.dumps({"entities": {"characters": characters, "locations": [{"name": x} for x in locations]}, "relationships_interactions": interactions})


@pytest.fixture(scope="module")
def chunks(spark):
    who = [{"name": "Mr Darcy", "mentioned_or_present": "present"}, {"name": "Mr. Darcy"}, {"name": " Éva "}, {"name": ""}, None]
    met = {"participants": ["Éva", "Mr Darcy", "Éva"], "location": "Bath", "summary": "s", "topic": None}
    rows = [
        (1, "c1", 0, _chunk(who, [met, met, {"participants": ["Éva", "Nobody known"]}, {"participants": ["Éva"]}, {"participants": []}], ["Bath"])),
        (2, "c2", 1, _chunk(["Mr Darcy"], [{"participants": ["Mr Darcy", "Éva"], "location": "Unknown place", "type": "x"}])),
        (3, "c3", 2, "broken {"),
        (4, "c4", 3, None),
    ]
    raw = spark.createDataFrame(rows, "row_id bigint, chunk_id string, sequence int, analysis string")
    read = an.read_chunks(raw).withColumnRenamed("key", "row_id")
    return raw.drop("analysis").withColumn("document_id", F.lit("d")).join(read, "row_id").cache()


def test_reading_keeps_every_row(chunks):
    assert {r.chunk_id: r.readable for r in chunks.collect()} == {"c1": True, "c2": True, "c3": False, "c4": False}


def test_entities_are_nodes_by_id(chunks):
    nodes = {r.id: r for r in g.entity_nodes(chunks).collect()}
    assert set(nodes) == {"character_mr_darcy", "character_éva", "location_bath"}
    assert nodes["character_mr_darcy"].properties == {"name": "Mr Darcy", "aliases": "Mr. Darcy"}
    assert g.id_conflicts(g.entity_nodes(chunks)).isEmpty()


def test_edges(chunks):
    rows = [r.asDict() for r in g.interaction_edges(chunks).collect()]
    met = [r for r in rows if r["type"] == "INTERACTED_WITH"]
    assert sorted((r["src"], r["dst"], r["properties"]["source_chunk_id"]) for r in met) == [("character_mr_darcy", "character_éva", "c1"), ("character_mr_darcy", "character_éva", "c2")]
    assert [r["properties"].get("location_id") for r in met if r["properties"]["source_chunk_id"] == "c1"] == ["location_bath"]
    assert all("topic" not in r["properties"] for r in met)
    assert sum(r["type"] == "PRESENT_AT_INTERACTION" for r in rows) == 3
    kinds = {(r.src, r.dst): r.type for r in g.mention_edges(chunks).collect()}
    assert kinds["character_mr_darcy", "c1"] == "PRESENT_IN" and kinds["character_mr_darcy", "c2"] == "MENTIONED_IN"


def test_participants_must_be_characters_of_their_own_document(spark):
    met = {"participants": ["Ada", "Bo"], "location": "Bath", "summary": "s"}
    rows = [(1, "d1", "c1", 0, _chunk(["Ada", "Bo"], [met], ["Bath"])), (2, "d2", "c2", 0, _chunk(["Ada"], [met], ["Bath"])), (3, "d3", "c3", 0, _chunk(["Ada", "Bo"], [met])), (4, None, "c4", 0, _chunk(["Ada", "Bo"], [met]))]
    raw = spark.createDataFrame(rows, "row_id bigint, document_id string, chunk_id string, sequence int, analysis string")
    chunks = raw.drop("analysis").join(an.read_chunks(raw).withColumnRenamed("key", "row_id"), "row_id")
    got = sorted((r.type, r.properties["source_chunk_id"], r.properties.get("location_id")) for r in g.interaction_edges(chunks).collect())
    assert [x for x in got if x[0] == "INTERACTED_WITH"] == [("INTERACTED_WITH", "c1", "location_bath"), ("INTERACTED_WITH", "c3", None)]
    assert len(got) == 4
    keys = {(r.merge_label, r.merge_key) for r in g.canonical_keys(g.entity_nodes(chunks)).collect()}
    assert keys == {("Character", "Ada"), ("Character", "Bo"), ("Location", "Bath")}
    edges = g.interaction_edges(chunks)
    assert g.merge_edges(edges, edges).count() == 4


def test_document_and_structure(spark):
    raw = spark.createDataFrame([(1, json.dumps([{"type": "Chapter/Part", "number": 3}, None, {"title": "T"}]))], "row_id bigint, structure string")
    docs = spark.createDataFrame([(1, "d", None, None)], "key bigint, document_id string, document_type string, overall_summary string").join(an.read_structures(raw), "key")
    assert g.document_nodes(docs).collect()[0].properties == {"document_id": "d", "title": "d", "summary": "", "type": "Unknown"}
    assert [(r.id, r.labels, r.name) for r in g.structure_nodes(docs).orderBy("id").collect()] == [("d_struct_1", ["Chapter_or_Part"], "Unit 3"), ("d_struct_2", ["Structure"], "T")]
    assert g.structure_edges(docs).count() == 2


def test_merge_neighbours_degrees(spark):
    node = "id string, labels array<string>, name string, properties map<string,string>"
    old = spark.createDataFrame([("a", ["X"], "A", {"k": "1", "l": "2"}), ("b", ["Y"], "B", {})], node)
    new = spark.createDataFrame([("a", ["Z"], "A2", {"k": "3"})], node)
    merged = {r.id: (r.labels, r.name, r.properties) for r in g.merge_nodes(old, new).collect()}
    assert merged == {"a": (["X", "Z"], "A2", {"k": "3", "l": "2"}), "b": (["Y"], "B", {})}
    edges = spark.createDataFrame([("a", "b", "T"), ("b", "c", "T")], "src string, dst string, type string")
    assert g.linked_edges(edges, old).count() == 1
    assert [(r.other, r.direction) for r in g.neighbours(edges, old, old.where("id = 'b'"), limit=5).collect()] == [("a", "in")]
    assert {(r.id, r.degree) for r in g.degrees(edges).collect()} == {("a", 1), ("b", 2), ("c", 1)}
    assert g.node_by(old, "B").collect()[0].id == "b"


def test_consolidation_and_synthesis(spark):
    df = spark.createDataFrame([("d", 1, ["b", "a ", ""], ["x"], None, "s2", None), ("d", 0, ["a"], None, ["o"], None, "R")], "document_id string, block_index int, characters array<string>, locations array<string>, organizations array<string>, block_summary string, block_ref string")
    r = an.consolidated(df).collect()[0]
    assert (r.characters, r.locations, r.organizations) == (["a", "b"], ["x"], ["o"])
    assert an.synthesis_input(df).collect()[0].text == "Block 0 Summary (Ref: R): Summary Unavailable\nBlock 1 Summary (Ref: Unknown): s2\n"


def _flaky(prompt: str) -> str:
    if "bad" in prompt:
        raise RuntimeError("no")
    return "not json" if "odd" in prompt else '{"a": 1}'


def test_providers_keep_rows_and_errors(spark):
    df = spark.createDataFrame([("1", "fine"), ("2", "bad"), ("3", "odd"), ("4", None)], "id string, prompt string")
    rows = {r.id: r for r in an.analyse(df, "id", "prompt", _flaky, attempts=2).collect()}
    assert {k: r.analysis_status for k, r in rows.items()} == {"1": "success", "2": "error", "3": "error", "4": "error"}
    assert rows["2"].analysis_error == "RuntimeError: no"
    vectors = {r.key: r.vector for r in an.embed(df, "id", "prompt", lambda texts: [an.offline_vector(_flaky(s)) for s in texts], on_failure="zero").collect()}
    assert vectors["2"] == [0.0] * 64 and sum(x * x for x in vectors["1"]) == pytest.approx(1)
    assert {r.key for r in an.embed(df, "id", "prompt", lambda texts: [an.offline_vector(_flaky(s)) for s in texts]).collect()} == {"1", "3"}
    failed = spark.createDataFrame([(None,), ("{}",), ('{"error": 1}',), ('{"x": 1}',), ("x",)], "r string").select(an.reduce_failed(F.col("r")).alias("f")).collect()
    assert [r.f for r in failed] == [True, True, True, False, True]


def test_top_k_against_brute_force(spark):
    rng = random.Random(1)
    vs = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(60)] + [[0.0] * 8, [1.0] * 8, [2.0] * 8]
    qs = [vs[3], [1.0] * 8, [0.0] * 8]
    v = spark.createDataFrame([(i, x, "q") for i, x in enumerate(vs)] + [(99, None, "q")], "id int, vector array<float>, q_id string")
    q = spark.createDataFrame(list(enumerate(qs)), "q_id int, vector array<float>")
    got: dict = {}
    for r in rt.top_k(q, v.drop("q_id"), k=5).orderBy("q_id", "rank").collect():
        got.setdefault(r.q_id, []).append(r.id)

    def cos(a, b):
        n = math.hypot(*a) * math.hypot(*b)
        return sum(x * y for x, y in zip(a, b, strict=True)) / n if n else None

    for i, a in enumerate(qs):
        scored = sorted((-round(c, 9), j) for j, b in enumerate(vs) if (c := cos(a, b)) is not None)
        assert got.get(i, []) == [j for _, j in scored[:5]]


def test_upsert_takes_the_latest(spark):
    old = spark.createDataFrame([("a", 1, "old"), ("b", 5, "old")], "id string, version int, v string")
    new = spark.createDataFrame([("a", 1, "new"), ("b", 4, "new"), ("c", 0, "new")], "id string, version int, v string")
    assert {r.id: r.v for r in rt.upsert(old, new, "id", "version").collect()} == {"a": "new", "b": "old", "c": "new"}
    assert {r.id: r.v for r in lib.once(old.unionByName(new), ["id"], "version", "v").collect()} == {"a": "old", "b": "old", "c": "new"}


def test_nested_values():
    v = {"a": {"b": [1, {"c": "x’y"}], "d": None}, "e": True}
    assert list(nv.outline(v)) == [(1, "a"), (2, "b"), (3, "b[0]: 1"), (3, "b[1]"), (4, "c: x'y"), (2, "d: null"), (1, "e: true")]
    assert list(nv.outline({"a": [5]}, own_lines=True)) == [(1, "a"), (2, "item_1"), (3, "5")]
    assert nv.find(v, "’") == "a,b,1,c" and nv.find(v, "c") is None and nv.find([None, 12], "2") == "1"
    assert nv.size({"k": 69}) == 6 and nv.size([1, 22]) == 9
    assert nv.kind([[1, 2, 3]]) == "list 1x3" and nv.kind({"a": 1}) == "dict 1"


def test_tensors(spark):
    flat = spark.createDataFrame([(i, float(i)) for i in range(24)], "index int, value double")
    shaped = t.reshape(flat, "index", "value", (2, 3, 4))
    assert {(r.i, r.j, r.k) for r in shaped.where("value = 17").collect()} == {(1, 1, 1)}
    assert t.equal(t.flatten(shaped, (2, 3, 4)), flat, ["index"]).collect()[0].equal
    m = t.merged([flat, flat.where("index < 3")], [24, 3], 10)
    assert m.count() == 30 and m.where("i = 2 and j = 6").collect()[0].value == 2.0
    assert t.equal(flat, flat.withColumn("value", F.col("value") + 0.5), ["index"], tolerance=0.4).collect()[0].different == 24
    assert sorted(r["index"] for r in t.sampled(flat, "index", 0.5).collect()) == sorted(r["index"] for r in t.sampled(flat, "index", 0.5).collect())
    assert t.sampled(flat, "index", 0.5).count() == 12 and len({r.value for r in t.distinct_numbers(spark, 5, 9).collect()}) == 5
    starts = sorted(r.value for r in t.block_starts(spark, 100, 9, 10).collect())
    assert all(b - a >= 9 for a, b in zip(starts, starts[1:], strict=False)) and starts[-1] <= 91
    with pytest.raises(ValueError, match="fit"):
        t.block_starts(spark, 10, 6, 2)


def _echo(prompt: str) -> str:
    return json.dumps({"said": prompt})


def test_answers(spark):
    from quire.operators import answering

    chunks = spark.createDataFrame([("c1", 1, "d", "one"), ("c2", 2, "d", "two"), ("c3", 3, "e", "about whales"), ("c4", 4, None, None)], "chunk_id string, chunk_num int, document_id string, text string")
    vectors = spark.createDataFrame([("c1", [1.0, 0.0]), ("c2", [0.9, 0.1]), ("c3", [0.0, 1.0]), ("c4", [0.5, 0.5])], "chunk_id string, vector array<float>")
    questions = spark.createDataFrame([(1, "x", 0, "first?", [1.0, 0.0]), (2, "x", 1, "WHALES", None), (3, "x", 2, "nothing", [0.0, 0.0])], "q_id int, conversation string, turn int, question string, vector array<float>")
    rows = {r.q_id: r for r in answering.answer(questions, vectors, chunks, _echo, k=2).collect()}
    assert rows["1"].prompt == "Document d:\n1: one\n2: two\n\nfirst?" and rows["1"].found_by == "similarity"
    assert rows["2"].prompt == "first?\n\nabout whales\n\nWHALES" and rows["2"].found_by == "text"
    assert rows["3"].prompt == "first?\nWHALES\n\nnothing" and rows["3"].found_by is None
    assert json.loads(rows["1"].answer)["said"] == rows["1"].prompt


def test_functions_in_sql(spark):
    from quire.functions.registry import measure, register

    assert "quire_outline" in register(spark)
    r = spark.sql("""SELECT quire_nested_size('{"k": 69}') AS s, quire_nested_kind('[[1,2]]') AS k, quire_find('{"a": ["x", "yz"]}', 'z') AS f, quire_find('bad', 'z') AS n""").collect()[0]
    assert (r.s, r.k, r.f, r.n) == (6, "list 1x2", "a,1", None)
    assert [x.line for x in spark.sql("""SELECT * FROM quire_outline('{"a": {"b": 1}}') ORDER BY ord""").collect()] == ["a", "b: 1"]
    assert measure(lambda: None) < 1


def test_rebuild(spark):
    docs = spark.createDataFrame([("a", "A", None, None, 0, 1, 2, None), ("b", "B", None, None, 2, 2, 0, None)], "document_id string, doc_name string, subject string, date_added timestamp_ntz, start_chunk_id bigint, end_chunk_id bigint, chunk_overlap int, file_path string")
    chunks = spark.createDataFrame([("1", 0, "a", "one two "), ("2", 1, "a", "o three"), ("3", 2, "b", "four")], "chunk_id string, chunk_num bigint, document_id string, text string")
    d, c = lib.rebuild(docs, chunks, size=2, overlap=1)
    assert [(r.document_id, r.text) for r in c.orderBy("chunk_num").collect()] == [("a", "one two"), ("a", "two three"), ("b", "four")]
    assert {(r.document_id, r.start_chunk_id, r.end_chunk_id, r.chunk_overlap) for r in d.collect()} == {("a", 0, 1, 1), ("b", 2, 2, 1)}
