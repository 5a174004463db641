from __future__ import annotations

import math
import os
from functools import lru_cache

import pytest

from quire.llm import mixing as mx
from quire.llm import tokens as tk

pytestmark = pytest.mark.skipif(not os.path.exists(f"{tk.TOKENIZERS}/byte_bpe_50k.tiktoken"), reason="no vocabulary here")

TEXTS = ["Hello  world\n\n don't", "", None, "   ", "<|endoftext|> x", "日本語 текст é é", "a" * 5000, "Hello  world\n\n don't", "\r\n\t12345 x² ", "word " * 3000]


@lru_cache
def _tokenizer(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{tk.TOKENIZERS}/{name}.json")
    t.encode_special_tokens = True
    return t


def _direct(text, name="byte_bpe_50k"):
    return _tokenizer(name).encode(text or "", add_special_tokens=False).ids


def test_ids_equal_those_of_the_whole_text(spark, monkeypatch):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(TEXTS)], "doc_id bigint, text string, block int, word string").repartition(3)
    got = {r.doc_id: r.ids for r in tk.encode(df).collect()}
    assert got == {i: _direct(t) for i, t in enumerate(TEXTS)}
    back = {r.doc_id: r.text for r in tk.decode(tk.encode(df)).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}
    assert {r.doc_id: r.n_tokens for r in tk.encode(df, lengths_only=True).collect()} == {i: len(_direct(t)) for i, t in enumerate(TEXTS)}


@pytest.mark.parametrize("partitions", [2, 7, 40])
def test_each_distinct_word_is_encoded_once(spark, data, monkeypatch, partitions):
    docs = spark.read.parquet(f"{data}/documents.parquet").where("length(text) > 0").repartition(5).selectExpr("doc_id", "text", "source")
    monkeypatch.setattr(tk, "HOT_ROWS", 2)
    monkeypatch.setattr(tk, "HOT_SHARE", 1000)
    seen = []
    made = tk.encoded_words

    def spy(words, path):
        out = made(words, path)
        seen.append((words, out))
        return out

    monkeypatch.setattr(tk, "encoded_words", spy)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {r.doc_id: (r.ids, r.source) for r in tk.encode(docs, carry="source").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    words, encoded = seen[0]
    assert encoded.count() == words.select("word").distinct().count() and encoded.where("n > 2").count() > 0
    assert got == {r.doc_id: (_direct(r.text), r.source) for r in docs.collect()}


def test_empty_table_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b")], "doc_id bigint, text string")
    assert [r.ids for r in tk.encode(df).collect()] == [_direct("a b")] * 2
    assert tk.encode(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(1, [50_300, 64]), (2, None), (3, [])], "doc_id bigint, ids array<int>")
    assert {r.doc_id: r.text for r in tk.decode(odd).collect()} == {1: "�a", 2: None, 3: ""}


def test_blocks_are_cut_by_size(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = {r.doc_id: r.ids for r in tk.encode(docs).collect()}
    assert got == {r.doc_id: _direct(r.text) for r in docs.collect()}


def test_allotment():
    assert mx.allot([0.5, 0.5], [1000, 1000], 100) == pytest.approx([50, 50])
    assert mx.allot([0.5, 0.3, 0.2], [1000, 10, 1000], 100) == pytest.approx([90 * 5 / 7, 10, 90 * 2 / 7])
    assert mx.allot([0.5, 0.5], [10, 0], 100) == [10, 0]
    assert mx.allot([0, 0], [1, 1], 5) == [0, 0] and mx.allot([], [], 5) == []


def test_temperature():
    a, w = mx.temperature([100, 10, 1], 50, [100] * 3, math.log(3) * 0.9)
    assert sum(w) == pytest.approx(1) and -sum(x * math.log(x) for x in w) == pytest.approx(math.log(3) * 0.9) and 0 < a < 1
    a, w = mx.temperature([100, 10, 1], 111, [2] * 3, math.log(3) * 0.99)
    assert all(111 * x <= 2 * t * 1.0001 for x, t in zip(w, [100, 10, 1], strict=True))
    assert mx.temperature([0, 0], 1, [1, 1], 1)[1] == [0, 0]


def test_temperature_gives_no_more_than_there_is():
    got = mx.tempered([0.5, 0.3, 0.2, 0.0], [1000, 10, 0, 50], [2, 3, 3, 3], 500)
    assert got[2:] == [0, 0] and got[1] <= 30.001 and sum(got) <= 500.001
    assert mx.tempered([0.7, 0.3], [700, 300], [1, 1], 1000) == pytest.approx([700, 300], rel=1e-6)
    assert mx.tempered([], [], [], 5) == [] and mx.tempered([0.0], [5], [1], 5) == [0]


def test_repeated_documents_are_sized_each(spark):
    docs = spark.createDataFrame([(1, "s", "a b"), (1, "s", "a b"), (2, None, "c")], "doc_id bigint, source string, text string")
    sized = mx.sized_documents(docs, lambda df, source: tk.encode(df, carry=source, lengths_only=True))
    assert sorted((r.doc_id, r.source or "", r.n_tokens) for r in sized.collect()) == [(1, "s", 2), (1, "s", 2), (2, "", 1)]


def test_draws_meet_their_budgets(spark):
    sized = spark.createDataFrame([(i, "big", 10 + i % 7) for i in range(3000)] + [(10_000 + i, "small", 5) for i in range(40)] + [(20_000, None, 9), (20_001, "big", 0), (20_002, "one", 50)], "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("m", "big", 0.6, 2, 0.5), ("m", "small", 0.3, 3, 0.5), ("m", "gone", 0.1, 5, 0.5), ("m", "small", 0.3, 3, 0.5), ("n", "one", 1.0, 4, 0.001), (None, "big", 1.0, 1, 1.0)], "mix_id string, source string, target_share double, max_repeats int, size_ratio double")
    planned = mx.plan(sized, targets).cache()
    drawn = mx.draw(sized, planned)
    rows = drawn.collect()
    assert len({(r.mix_id, r.doc_id) for r in rows}) == len(rows)
    shares = {(r.mix_id, r.source): r for r in mx.report(drawn, planned).collect()}
    assert shares["m", "small"].tokens == 40 * 5 * 3 and shares["m", "small"].at_limit and shares["m", "small"].most_repeats == 3
    assert shares["m", "gone"].tokens == 0 and shares["m", "gone"].reached_share == 0
    big = shares["m", "big"]
    assert 0 <= planned.where("source = 'big' and mix_id = 'm'").collect()[0].planned - big.tokens < 20 and big.most_repeats <= 2
    assert sum(r.reached_share for r in shares.values() if r.mix_id == "m") == pytest.approx(1)
    even = mx.plan(sized, targets, by="temperature")
    assert {r.source: r.planned for r in even.where("mix_id = 'm'").collect()}["small"] <= 40 * 5 * 3 and mx.draw(sized, even).count() > 0
    assert sorted((r.doc_id, r.copies) for r in rows) == sorted((r.doc_id, r.copies) for r in mx.draw(sized, planned).collect())
    assert mx.plan(sized, targets.limit(0)).count() == 0 and mx.draw(sized.limit(0), planned).count() == 0
