"""Encoding a corpus with a public tokenizer, each distinct word once.

Byte-level BPE splits a text into pre-tokens ("words") and merges bytes within each, so the ids of a text are the ids
of its words in order. Texts are gathered into blocks of bounded size; a block keeps the order of its words as an array
of local word numbers (its skeleton) and lists each distinct word once.

1. Blocks are written once, as a table. Its words are counted; every distinct word of the corpus is encoded once, in one
   row of a table of (word, blocks that hold it, ids).
2. Ids are joined to the words of each block, by word. A word in so many blocks that its rows would crowd a task is
   hot; there are at most ``HOT_SHARE`` of them for each shuffle partition, so they are joined by broadcast, and their
   rows are not shuffled by word. Skeletons are not shuffled by word at all.
3. Ids go back to their block, where the skeleton puts them into place.

What is shuffled is distinct words per block, not occurrences. Tasks hold one block at a time; a text longer than a
block is a block of its own.

Defined results: null and empty texts have the empty list; blank texts are encoded as they stand; strings that look
like special tokens are ordinary text; every row gives one row, repeated rows too.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.plans.session import shuffle_width, written

#: Where the vocabulary files are; a parameter of every operator here.
TOKENIZERS = os.environ.get("QUIRE_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the public pre-token pattern of byte-level BPE.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

BLOCK_CHARS, BLOCK_TEXTS = 1 << 20, 2048
#: A word is hot with more than HOT_ROWS rows and more than 1 / HOT_SHARE of an even partition.
HOT_ROWS, HOT_SHARE = 10_000, 4


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=4)
def _bpe(path: str):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks(path), special_tokens={})


def _file(tokenizer: str, folder: str) -> str:
    return f"{folder}/{tokenizer}.tiktoken"


def word_pieces(path: str):
    """word -> ids, by merging bytes within the word only."""
    bpe = _bpe(path)
    table = ranks(path)

    def encode(word: str) -> list[int]:
        raw = word.encode()
        return [own] if (own := table.get(raw)) is not None else bpe._encode_single_piece(raw)

    return encode


_BLOCK_SCHEMA = "block bigint, idx int, word string, docs array<bigint>, carried array<string>, counts binary, order binary"
_BLOCK = pa.schema([("block", pa.int64()), ("idx", pa.int32()), ("word", pa.string()), ("docs", pa.list_(pa.int64())), ("carried", pa.list_(pa.string())), ("counts", pa.binary()), ("order", pa.binary())])
_WORD_SCHEMA = "word string, n bigint, ids binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import regex

    find = regex.compile(PATTERN).findall
    seq = TaskContext.get().partitionId() << 32
    words: dict[str, int] = {}
    docs: list = []
    carried: list = []
    counts: list[int] = []
    order: list[np.ndarray] = []
    chars = 0

    def flush() -> pa.RecordBatch:
        nonlocal seq, words, docs, carried, counts, order, chars
        n = len(words)
        every = np.concatenate(order) if order else np.empty(0, np.uint32)
        packed = (every.astype(np.uint16) if n <= 1 << 16 else every).tobytes()
        skeleton = (docs, carried, np.array(counts, np.uint32).tobytes(), packed)
        rows = [pa.array([seq] * (n + 1), pa.int64()), pa.array([*range(n), -1], pa.int32()), pa.array([*words, None], pa.string()), *(pa.array([None] * n + [x], f.type) for x, f in zip(skeleton, [_BLOCK.field(i) for i in range(3, 7)], strict=True))]
        seq, words, docs, carried, counts, order, chars = seq + 1, {}, [], [], [], [], 0
        return pa.RecordBatch.from_arrays(rows, schema=_BLOCK)

    for batch in batches:
        for doc, text, more in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if docs and (chars + len(text or "") > BLOCK_CHARS or len(docs) >= BLOCK_TEXTS):
                yield flush()
            found = find(text) if text else []
            new = words.setdefault
            order.append(np.array([new(w, len(words)) for w in found], np.uint32))
            docs.append(doc)
            carried.append(more)
            counts.append(len(found))
            chars += len(text or "")
    if docs:
        yield flush()


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_pieces(path)
        for batch in batches:
            ids = [np.array(encode(word), np.uint32).tobytes() for word in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.binary())], names=["word", "n", "ids"])

    return run


def _assembled(lengths_only: bool, carried: bool):
    value = pa.int32()

    def run(rows: pa.Table) -> pa.Table:
        idx = rows.column("idx").to_numpy()
        at = int(np.flatnonzero(idx == -1)[0])
        docs = rows.column("docs")[at].as_py()
        counts = np.frombuffer(rows.column("counts")[at].as_py(), np.uint32).astype(np.int64)
        ids = rows.column("ids").combine_chunks()
        order_raw = rows.column("order")[at].as_py()
        words = np.flatnonzero(idx >= 0)
        n = len(words)
        order = np.frombuffer(order_raw, np.uint16 if n <= 1 << 16 else np.uint32).astype(np.int64)
        # the ids of all words, one after another, and where each local word's begin
        offsets = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1]
        first, size = np.zeros(n, np.int64), np.zeros(n, np.int64)
        raw = np.frombuffer(ids.buffers()[2], np.uint8) if ids.buffers()[2] is not None else np.empty(0, np.uint8)
        base = int(offsets[0])
        flat = np.frombuffer(raw[base : int(offsets[-1])].tobytes(), np.uint32).astype(np.int32)
        first[idx[words]] = (offsets[words] - base) // 4
        size[idx[words]] = (offsets[words + 1] - offsets[words]) // 4
        each = size[order]
        done = np.concatenate([[0], np.cumsum(each)])
        ends = done[np.concatenate([[0], np.cumsum(counts)])]
        own = {"doc_id": pa.array(docs, pa.int64())} | ({"carried": pa.array(rows.column("carried")[at].as_py(), pa.string())} if carried else {})
        if lengths_only:
            return pa.table(own | {"n_tokens": pa.array(np.diff(ends), pa.int64())})
        take = np.repeat(first[order] - done[:-1], each) + np.arange(int(done[-1]))
        lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32), pa.int32()), pa.array(flat[take], value))
        return pa.table(own | {"ids": lists})

    return run


def encoded_words(words: DataFrame, path: str) -> DataFrame:
    """word, n, ids: every distinct word once, with the number of its rows; written."""
    return written(words.groupBy("word").agg(F.count("*").alias("n")).mapInArrow(_encoded(path), _WORD_SCHEMA))


def encode(df: DataFrame, *, key: str = "doc_id", text: str = "text", carry: str | None = None, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS, lengths_only: bool = False) -> DataFrame:
    """doc_id, ids (array<int>) of every row of ``df``; with ``lengths_only`` doc_id, n_tokens (bigint). carry: a further column to keep, as a string, under its name."""
    width = shuffle_width(df.sparkSession)
    more = (F.col(carry) if carry else F.lit(None)).cast("string").alias("carried")
    blocks = written(df.select(F.col(key).cast("bigint").alias("doc"), F.col(text).cast("string").alias("text"), more).mapInArrow(_blocks, _BLOCK_SCHEMA))
    words = blocks.where("word is not null").select("block", "idx", "word")
    table = encoded_words(words, _file(tokenizer, folder))
    most = max(HOT_ROWS, words.count() // (HOT_SHARE * width))  # at most HOT_SHARE * width words have more rows
    hot = table.where(F.col("n") > most).select("word", "ids")
    seldom = words.join(F.broadcast(hot.select("word")), "word", "left_anti").join(table.where(F.col("n") <= most).select("word", "ids"), "word")
    found = seldom.unionByName(words.join(F.broadcast(hot), "word")).select("block", "idx", "ids")
    parts = found.unionByName(blocks.where("word is null").drop("word"), allowMissingColumns=True)
    done = parts.groupBy("block").applyInArrow(_assembled(lengths_only, carry is not None), "doc_id bigint, " + ("carried string, " if carry else "") + ("n_tokens bigint" if lengths_only else "ids array<int>"))
    return done.withColumnRenamed("carried", carry) if carry else done


def decode(df: DataFrame, *, key: str = "doc_id", ids: str = "ids", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """doc_id, text from ids, by the table of token bytes, whose size is the vocabulary's. Ids outside it and bytes that are no UTF-8 give U+FFFD; a null list gives a null text."""
    path = _file(tokenizer, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = {i: b for b, i in ranks(path).items()}
        unknown = "�".encode()
        for batch in batches:
            texts = [None if x is None else b"".join([table.get(i, unknown) for i in x]).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return df.select(F.col(key).cast("bigint").alias("doc_id"), F.col(ids).cast("array<int>")).mapInArrow(run, "doc_id bigint, text string")
