"""Share of a text that repeats what the same text has said before.

The text is read as words: runs of letters, lower case; digits, punctuation and spacing do not count, so neither do
numbering and layout. In scripts written without word spaces each letter is a word. A word is repeated if it stands
in a run of ``run`` words (``wide_run`` where the run holds letters of such a script) that occurred earlier in the same
text, or between two repeated words with at most ``gap`` others: a changed word inside a repeated phrase does not
break it. The share is that of letters in repeated words.

Counting lines over documents (``line_frequency``, the method named for this problem) finds boilerplate, not this: a text
that repeats itself is no more frequent than others, and its repeats need not be lines. For repeats within a text the
hashes are kept, but of word runs, and their counts are taken within each text. Texts are handled many at once, in one
array; nothing leaves the task, there is no shuffle.

Runs are compared by 64-bit hashes of their word numbers, mixed with the number of the text.

Defined results: null, empty and wordless texts have share 0; texts shorter than a run too; every row gives one row,
repeated rows too; texts are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters of scripts without word spaces (kana, Han, Hangul is spaced and not among them, Thai, Lao, Khmer, Burmese).
WIDE = "぀-ヿㇰ-ㇿ㐀-䶿一-鿿豈-﫿ｦ-ﾝ฀-๿຀-໿ក-៿က-႟\U00020000-\U0003ffff"
_WORD = re.compile(rf"[{WIDE}]|[^\W\d_{WIDE}]+")
_IS_WIDE = re.compile(rf"[{WIDE}]")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
BATCH_CHARS = 4_000_000


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _seen_before(words: np.ndarray, doc: np.ndarray, n: int, usable: np.ndarray) -> np.ndarray:
    """Which words stand in a run of n words of one text that occurred earlier in it. usable: the runs to look at, by first word."""
    m = len(words) - n + 1
    cover = np.zeros(len(words) + 1, np.int32)
    if m <= 0:
        return cover[:-1].astype(bool)
    h = np.zeros(m, np.uint64)
    for k in range(n):
        h = h * _MULTIPLIER + words[k : k + m]
    h = _mixed(h + doc[:m].astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    at = np.flatnonzero(usable[:m] & (doc[:m] == doc[n - 1 :]))
    order = np.argsort(h[at], kind="stable")
    again = np.zeros(len(at), bool)
    keys = h[at][order]
    again[order[1:]] = keys[1:] == keys[:-1]
    starts = at[again]
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + n, -1)
    return np.cumsum(cover[:-1]) > 0


def shares(texts: list[str | None], run: int = 5, wide_run: int = 12, gap: int = 1) -> np.ndarray:
    """The repeated share of each text."""
    numbers: dict[str, int] = {}
    ids, sizes, lengths = [], [], []
    for text in texts:
        found = _WORD.findall(text.lower()) if text else []
        new = numbers.setdefault
        ids.append(np.array([new(w, len(numbers)) for w in found], np.int64))
        lengths.append(len(found))
    words = np.concatenate(ids) if ids else np.empty(0, np.int64)
    if not len(words):
        return np.zeros(len(texts))
    sizes = np.array([len(w) for w in numbers], np.int64)
    wide = np.array([_IS_WIDE.match(w) is not None for w in numbers], bool)[words]
    doc = np.repeat(np.arange(len(texts)), lengths)
    mixed = _mixed(words.astype(np.uint64) + np.uint64(1))
    before = np.concatenate([[0], np.cumsum(wide)])

    def holds_wide(n: int) -> np.ndarray:
        out = np.zeros(len(words), bool)
        out[: len(words) - n + 1] = before[n:] > before[: len(words) - n + 1] if len(words) >= n else False
        return out

    covered = _seen_before(mixed, doc, run, ~holds_wide(run)) | _seen_before(mixed, doc, wide_run, holds_wide(wide_run))
    # close short gaps between repeated words of one text
    at = np.flatnonzero(covered)
    if len(at) > 1:
        space = np.diff(at) - 1
        for g in range(1, gap + 1):
            left = at[:-1][(space == g) & (doc[at[:-1]] == doc[at[1:]])]
            for k in range(1, g + 1):
                covered[left + k] = True
    size = sizes[words].astype(float)
    total = np.bincount(doc, size, len(texts))
    part = np.bincount(doc, size * covered, len(texts))
    return np.divide(part, total, out=np.zeros(len(texts)), where=total > 0)


def repeated_share(df: DataFrame, *, key: str = "doc_id", text: str = "text", run: int = 5, wide_run: int = 12, gap: int = 1) -> DataFrame:
    """doc_id, repeated_share of every row."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            low = chars = 0
            for i, t in enumerate(texts):
                chars += len(t or "")
                if chars > BATCH_CHARS or i == len(texts) - 1:
                    part = shares(texts[low : i + 1], run, wide_run, gap)
                    yield pa.RecordBatch.from_arrays([keys.slice(low, i + 1 - low), pa.array(part, pa.float64())], names=["doc_id", "repeated_share"])
                    low, chars = i + 1, 0

    return df.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string")).mapInArrow(go, "doc_id bigint, repeated_share double")


def line_frequency(df: DataFrame, *, key: str = "doc_id", text: str = "text", host: str = "source", most: int = 5, depleted: float = 0.4) -> DataFrame:
    """doc_id, letters, removed_share, rejected: of each document the share of letters in lines that more than ``most`` documents of its host hold, and whether that is ``depleted`` or more.

    Lines are compared by 64-bit hashes of their letters in lower case, so case, spacing, punctuation and numbering do
    not count; lines without letters are none. A document counts once for each of its lines, so counting needs no
    distinct and is combined within tasks. Frequent lines are joined back by the plan that their number asks for, a
    frequent line of many documents being split by adaptive execution. A null host is a host; null, empty and letterless
    texts have no letters, share 0 and are not rejected; rows of one key are one document.
    """
    letters = F.transform(F.split(F.col(text).cast("string"), "\\R"), lambda x: F.regexp_replace(F.lower(x), r"[^\p{L}]+", ""))
    held = F.transform(F.filter(letters, lambda x: F.length(x) > 0), lambda x: F.struct(F.xxhash64(x).alias("line"), F.length(x).alias("size")))
    docs = df.select(F.col(key).cast("bigint").alias("doc_id"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.coalesce(held, F.array().cast("array<struct<line:bigint,size:int>>")).alias("lines"))
    counts = docs.select("host", F.explode(F.array_distinct("lines")).alias("l")).groupBy("host", F.col("l.line").alias("line")).agg(F.count("*").alias("n"))
    frequent = counts.where(F.col("n") > most).select("host", "line", F.lit(True).alias("removed"))
    each = docs.select("doc_id", "host", F.explode_outer("lines").alias("l")).select("doc_id", "host", F.col("l.line").alias("line"), F.coalesce("l.size", F.lit(0)).alias("size"))
    sums = each.join(frequent, ["host", "line"], "left").groupBy("doc_id").agg(F.sum("size").alias("letters"), F.sum(F.when(F.col("removed"), F.col("size")).otherwise(0)).alias("gone"))
    share = F.when(F.col("letters") > 0, F.col("gone") / F.col("letters")).otherwise(0.0)
    return sums.select("doc_id", "letters", share.alias("removed_share"), (share >= depleted).alias("rejected"))
