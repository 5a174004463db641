from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.operators import chunking as ch
from quire.operators import library as lib

SAMPLE = """The preface stands here.

CHAPTER 1
It begins, as in chapter 2 of another.
to CHAPTER 9 we do not go
notebook chapter 5
CHAPTER 3.
More; then CHAPTER XXXV. goes on.
illustrations: to Chapter IV
x illustrations: to Chapter V here
CHAPTER  18
The end."""


def _one(spark, f, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.y for r in df.select("i", f("t").alias("y")).orderBy("i").collect()]


def test_cleaning(spark):
    e = "\u00e2\u20ac"
    assert _one(spark, tx.clean, f"{e}\u0153Hi{e}\u009d {e}\u2122 {e}\u201c {e}\u201d {e}\u00a6 \u00c3\u00a9", "\u00a0\u201ccaf\u00e9\u201d\u2026 \u00e7\u0085\x1c", "", None) == ["\"Hi\" ' - -- ... e", '"cafe"... \u00e7', "", None]


def test_small_text_functions(spark):
    assert _one(spark, tx.one_line, " a\t\nb\u00a0c ", None) == ["a b c", None]
    assert _one(spark, tx.json_body, '```json\n{"a":1}\n```', "{}") == ['\n{"a":1}\n', "{}"]
    assert _one(spark, tx.document_id, "/a/b.c/Book One.v2.txt", "C:\\x\\y.md", "plain") == ["Book One.v2", "y", "plain"]
    assert _one(spark, tx.unix_path, "C:\\a b\\c.txt") == ["/mnt/c/a\\ b/c.txt"]
    assert _one(spark, lambda c: tx.entity_id(F.lit("Character"), c), "Mr. Dárcy Jr") == ["character_mr_dárcy_jr"]
    assert _one(spark, tx.sentence_start, "ending. The next", "half word", "word", "so.” And") == ["The next", "word", "word", "And"]
    assert _one(spark, lambda c: tx.truncate(c, 12), "short", "One two. Three four") == ["short", "One two."]


def test_truncate_at_word_and_hard(spark):
    assert _one(spark, lambda c: tx.truncate(c, 12), "alphabet betagamma", "abcdefghijklmnop") == ["alphabet", "abcdefghijkl"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("12/01/2019 3:15pm", datetime(2019, 12, 1, 15, 15)), ("2019-1-2 03:04:05AM", datetime(2019, 1, 2, 3, 4, 5)), ("1-12-2019", datetime(2019, 12, 1)), ("20191201", datetime(2019, 12, 1)), ("20191201031500PM", datetime(2019, 12, 1, 15, 15)),
        ("Dec 1, 2019", datetime(2019, 12, 1)), ("December 1, 2019 3:15pm", datetime(2019, 12, 1, 15, 15)), ("2019-12-01 23:59", datetime(2019, 12, 1, 23, 59)), ("12/1/2019 23:59:58", datetime(2019, 12, 1, 23, 59, 58)), ("December 1, 2019 23:59", datetime(2019, 12, 1, 23, 59)),
        ("2019/12/1 3:15pm", None), ("", None), (None, None), ("31/12/2019", None),
    ],
)
def test_datetimes(spark, text, want):
    assert _one(spark, tx.parse_datetime, text) == [want]


def test_structural_blocks(spark):
    df = spark.createDataFrame([("d", SAMPLE, 0), ("plain", "no markers. here", 0), ("first", "CHAPTER 1 only at the beginning", 0), ("n", None, 0), ("e", "", 0)], "key string, text string, i int")
    rows = ch.coarse_blocks(df, "key", "text").orderBy("key", "block_index").collect()
    d = [r for r in rows if r.key == "d"]
    assert [r.ref for r in d] == ["Unit 1", "1", "2", "3", "XXXV", "V", "18"]
    assert d[0].type == "DetectedStructure" and d[1].structural_marker == "Chapter 1"
    assert all(SAMPLE[r.start_char :].startswith(("CHAPTER", "chapter", "Chapter")) for r in d[1:])
    assert {r.key: r.structural_marker for r in rows if r.key != "d"} == {"plain": "FallbackBlock 1", "first": "FallbackBlock 1"}
    assert [r.ref for r in ch.structural_blocks(df, "key", "text", strict=True).where("key = 'd'").orderBy("block_index").collect()] == ["Unit 1", "1", "3", "XXXV", "V", "18"]


def test_fallback_windows_lose_one_sign_a_cut(spark):
    text = ("word " * 30 + "end. ") * 40
    rows = ch.fallback_blocks(spark.createDataFrame([("a", text)], "k string, t string"), "k", "t", tokens=100, least=20).orderBy("block_index").collect()
    assert len(rows) > 3
    assert [r.start_char for r in rows][0] == 0
    for r, s in zip(rows, rows[1:], strict=False):
        assert text[s.start_char - 1] == "." and s.start_char - r.start_char >= 400


def test_scenes_and_paragraphs(spark):
    text = " one\nmore \n\n\n\n two\n \n\n\n"
    df = spark.createDataFrame([(1, text, 10), (2, None, 0)], "k int, t string, s bigint")
    assert [(r.text, r.start_char, r.end_char) for r in ch.scene_pieces(df, "k", "t", "s").orderBy("piece_index").collect()] == [("one\nmore", 11, 19), ("two", 25, 28)]
    assert [(r.paragraph_index, r.text) for r in ch.paragraphs(df, "k", "t").orderBy("paragraph_index").collect()] == [(0, "one"), (1, "more"), (5, "two")]


@pytest.mark.parametrize("overlap", [0, 5, 400])
def test_packing_ends_and_keeps_limits(overlap):
    text = "\n".join(["short line here"] * 50 + ["w" * 3000] + ["a b " * 900] + ["tail " * 40]) + "\n\n\n\n" + "scene two " * 30
    out = list(ch.pack(text, 100, overlap))
    assert out and all(len(c) // 4 <= 250 + 1 for c, *_ in out)
    assert {s for _, s, *_ in out} == {1, 2}
    assert any(split for *_, split in out)
    if overlap == 0:
        assert sum(c.count("short") for c, *_ in out) == 50


def test_adaptive_sequences_run_through_a_document(spark):
    blocks = spark.createDataFrame([("d", i, ("sentence number. \n" * 60), "Chapter", f"Chapter {i}") for i in range(5)] + [("e", 0, None, None, None)], "key string, block_index int, text string, type string, structural_marker string")
    rows = ch.adaptive_chunks(blocks, target=50, overlap=4).orderBy("sequence").collect()
    assert [r.sequence for r in rows] == list(range(len(rows))) and len({r.chunk_id for r in rows}) == len(rows)
    assert rows[0].structure_ref.startswith("Chapter 0 / Scene 1 / Paras 1-") and rows[-1].structure_ref.startswith("Chapter 4")


def test_windows_and_recursive_pieces(spark):
    df = spark.createDataFrame([(1, " ".join(map(str, range(25)))), (2, " "), (3, None)], "k int, t string")
    got = [r.text.split() for r in ch.token_windows(df, "k", "t", size=10, overlap=4).orderBy("chunk_index").collect()]
    assert [g[0] for g in got] == ["0", "6", "12", "18"] and got[-1][-1] == "24" and all(len(g) <= 10 for g in got)
    text = "para one is here.\n\npara two is a bit longer than that.\n\n" + "x" * 70
    pieces = ch.recursive_pieces(text, 30, 8)
    assert all(len(p) <= 30 for p in pieces) and "para one is here." in pieces


def test_reconstruct_takes_overlaps_off(spark):
    text = "abcdefghijklmnopqrstuvwxyz"
    rows = [("d", n, text[max(0, a - 3) : a + 5], 3) for n, a in enumerate(range(0, 26, 5), 7)]
    df = spark.createDataFrame(rows, "key string, chunk_num int, t string, lap int")
    assert ch.reconstruct(df, "key", "chunk_num", "t", "lap").collect()[0].text == text


def test_library_adds_only_new_names(spark):
    docs = spark.createDataFrame([("a", "A", "s", None, 0, 4, 2, "p")], "document_id string, doc_name string, subject string, date_added timestamp_ntz, start_chunk_id bigint, end_chunk_id bigint, chunk_overlap int, file_path string")
    chunks = spark.createDataFrame([("c", 4, "a", "t")], "chunk_id string, chunk_num bigint, document_id string, text string")
    new = spark.createDataFrame([("b", "B", None, None, 1, None, 0), ("x", "A", None, None, 1, None, 1), ("c", "C", None, None, 1, None, 2)], "document_id string, doc_name string, subject string, date_added timestamp_ntz, chunk_overlap int, file_path string, doc_order int")
    more = spark.createDataFrame([(d, o, s, f"{d}{s}") for d, o in (("b", 0), ("x", 1), ("c", 2)) for s in range(3)], "document_id string, doc_order int, sequence int, text string")
    d2, c2 = lib.add_documents(docs, chunks, new, more)
    assert {(r.document_id, r.start_chunk_id, r.end_chunk_id) for r in d2.collect()} == {("a", 0, 4), ("b", 5, 7), ("c", 8, 10)}
    assert sorted(r.chunk_num for r in c2.collect()) == [4, *range(5, 11)]
    assert lib.duplicate_names(d2).isEmpty() and lib.orphans(c2, d2).isEmpty()
    assert lib.name_exists(d2, "B") and not lib.name_exists(d2, "Z")
    assert lib.next_chunk_number(d2.limit(0), "date_added").collect()[0].next_number == 0


def test_context_listing_and_tables(spark):
    c = spark.createDataFrame([("d", 2, "two"), ("d", 1, "one"), ("e", 3, None)], "document_id string, chunk_num int, text string")
    assert {r.document_id: r.context for r in lib.context(c).collect()} == {"d": "Document d:\n1: one\n2: two", "e": "Document e:\n3: "}
    with pytest.raises(ValueError, match="allowed"):
        lib.setup(spark, "t_docs", "t_evil", allowed=("t_docs", "t_chunks"))
    lib.setup(spark, "t_docs", "t_chunks", allowed=("t_docs", "t_chunks"))
    assert {"t_docs", "t_chunks"} <= set(lib.tables(spark))
    with pytest.raises(PermissionError):
        lib.drop_all(spark, "t_docs", allowed=("t_docs",), confirm=False)
    lib.drop_all(spark, "t_docs", "t_chunks", allowed=("t_docs", "t_chunks"), confirm=True)
    assert "t_docs" not in lib.tables(spark)


def test_chunks_by_a_tokenizer(spark):
    encode, decode = lambda s: [ord(c) for c in s], lambda ids: "".join(map(chr, ids))
    df = spark.createDataFrame([("a", "abcdefghij"), ("b", "abc"), ("c", ""), ("d", None)], "k string, t string")
    rows = ch.tokenizer_windows(df, "k", "t", encode, decode, size=4, overlap=1).orderBy("key", "chunk_index").collect()
    assert [(r.key, r.text) for r in rows] == [("a", "abcd"), ("a", "defg"), ("a", "ghij"), ("b", "abc")]
    text = " ".join(f"word{i}" for i in range(60))
    by_words = list(ch.pack(text, 10, 2, size=lambda s: len(s.split())))
    assert by_words and all(len(c.split()) <= 25 for c, *_ in by_words)
    assert len(by_words) != len(list(ch.pack(text, 10, 2)))
    blocks = spark.createDataFrame([("d", 0, text, "Chapter", None)], "key string, block_index int, text string, type string, structural_marker string")
    assert ch.adaptive_chunks(blocks, target=10, overlap=2, size=lambda s: len(s.split())).count() == len(by_words)
