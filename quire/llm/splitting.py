"""Cutting oversized texts into overlapping pieces at natural boundaries, by pointer doubling.

Piece k of a text is [start_k, end_k): start_0 = 0, start_{k+1} = end_k - overlap, end_k - start_k <= limit, and the
last end is the length of the text. An end is a cut. Greedy rule: from a cut, the next one is the farthest boundary of
the strongest class found in the admissible window; the classes are paragraph break, line break, sentence end, clause
end and word end, and a class weaker than a paragraph break only has to be considered where no stronger boundary lies
in the last ``1 - reach`` of the window. Without any boundary the cut is hard, at the limit (but not between a letter
and its combining mark). The successor of every possible cut depends on nothing but that cut, so one table of
successors is computed for all boundaries at once and squared (pointer doubling): after j squarings every cut within
2^j steps of the start is marked. Number of rounds: log2 of the most pieces of any text in a batch, whatever the
number and length of the texts.

Defined results: texts within the limit, empty and null texts give no piece; every text is read whole; the pieces of a
text, with their overlaps removed, join to the text exactly; repeated rows are cut each by itself. Lengths and offsets
are code points. ``overlap`` must be less than ``limit``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.plans.session import small

PIECE_SCHEMA = "table_name string, row_id bigint, piece_index int, start_char bigint, end_char bigint, boundary string, text string"
#: Strongest first.
CLASSES = ("paragraph", "line", "sentence", "clause", "word", "hard")
_ARROW = pa.schema([
    ("table_name", pa.string()), ("row_id", pa.int64()), ("piece_index", pa.int32()), ("start_char", pa.int64()),
    ("end_char", pa.int64()), ("boundary", pa.string()), ("text", pa.string()),
])

#: Signs that end a sentence or a clause, closing signs that may follow them, and sentence signs of scripts without word spaces.
SENTENCE = ".!?…"
CLAUSE = ",;:—–"
CLOSERS = "\"'”’»)]」』"
WIDE_SENTENCE = "。！？"
WIDE_CLAUSE = "、，；："


def _in(codes: np.ndarray, signs: str) -> np.ndarray:
    return np.isin(codes, np.array([ord(c) for c in signs], np.uint32))


def boundary_classes(codes: np.ndarray) -> np.ndarray:
    """For each offset 0..n the strongest class of a cut there, as its index in CLASSES. A cut after white space belongs to the boundary before it."""
    n = len(codes)
    cls = np.full(n + 1, 5, np.int8)
    space = _in(codes, " \t 　")
    line = _in(codes, "\n\r")
    white = space | line
    before_white = np.zeros(n + 1, bool)
    before_white[1:n] = white[: n - 1] & ~white[1:]  # offset after a run of white space
    cls[before_white] = 4
    # the last sign before the white space, looking through closing signs
    last = np.where(white, -1, np.arange(n))
    last = np.maximum.accumulate(last) if n else last
    solid = np.where(white | _in(codes, CLOSERS), -1, np.arange(n))
    solid = np.maximum.accumulate(solid) if n else solid
    ends = np.flatnonzero(before_white)
    sign = solid[ends - 1]
    ok = sign >= 0
    near = ok & (ends - sign <= 8)
    sentence, clause = np.zeros(len(ends), bool), np.zeros(len(ends), bool)
    sentence[near] = _in(codes[sign[near]], SENTENCE)
    clause[near] = _in(codes[sign[near]], CLAUSE)
    cls[ends[clause]] = 3
    cls[ends[sentence]] = 2
    wide = np.flatnonzero(_in(codes, WIDE_SENTENCE)) + 1
    closed = wide[(wide < n)]
    closed = np.where(_in(codes[closed], CLOSERS), closed + 1, closed) if len(closed) else closed
    cls[closed] = np.minimum(cls[closed], 2)
    cls[np.flatnonzero(_in(codes, WIDE_CLAUSE)) + 1] = np.minimum(cls[np.flatnonzero(_in(codes, WIDE_CLAUSE)) + 1], 3)
    # line breaks in the run of white space before the offset
    breaks = np.concatenate([[0], np.cumsum(codes == 10)])
    run = ends - np.where(last[ends - 1] >= 0, last[ends - 1] + 1, 0)
    found = breaks[ends] - breaks[ends - run]
    cls[ends[found == 1]] = 1
    cls[ends[found > 1]] = 0
    return cls


def _mark(codes: np.ndarray) -> np.ndarray:
    """Signs that may not begin a piece: combining marks, joiners, variation selectors."""
    return ((codes >= 0x300) & (codes < 0x370)) | ((codes >= 0x200B) & (codes <= 0x200D)) | ((codes >= 0xFE00) & (codes <= 0xFE0F))


def successors(codes: np.ndarray, limit: int, overlap: int, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets that can be cuts (0 and n among them), the index of each one's successor, and its class.

    Hard cuts reached from a boundary are offsets of their own. Up to the next boundary they are ``limit - overlap``
    apart, so all of them are given at once; rounds are needed only where a combining mark moves one.
    """
    n = len(codes)
    cls = boundary_classes(codes)
    marks = np.concatenate([_mark(codes), [False]])
    by_class = [np.flatnonzero(cls[:n] <= k) for k in range(5)]

    def next_cut(at: np.ndarray) -> np.ndarray:
        start = np.where(at == 0, 0, at - overlap)
        high = np.minimum(start + limit, n)
        low = np.maximum(at, start) + 1
        out = np.where(start + limit >= n, n, -1)
        for k in range(5):
            cuts = by_class[k]
            if not len(cuts):
                continue
            i = np.searchsorted(cuts, high, "right") - 1
            cut = np.where(i >= 0, cuts[np.maximum(i, 0)], -1)
            # a class may stop short of the window's end only within its last part, else the next class is asked
            floor = np.maximum(low, start + np.ceil(reach * limit).astype(np.int64))
            out = np.where((out < 0) & (cut >= floor), cut, out)
        if by_class[4].size:  # nothing in the last part: any boundary that makes progress
            i = np.searchsorted(by_class[4], high, "right") - 1
            cut = np.where(i >= 0, by_class[4][np.maximum(i, 0)], -1)
            out = np.where((out < 0) & (cut >= low), cut, out)
        hard = high.copy()
        for _ in range(8):  # off a combining mark, as long as there is progress
            back = marks[hard] & (hard - 1 >= low)
            if not back.any():
                break
            hard = hard - back
        return np.where(out < 0, hard, out)

    words, step = by_class[4], limit - overlap

    def onwards(hard: np.ndarray) -> np.ndarray:
        """Hard cuts and those that follow them before the next boundary comes into reach."""
        i = np.searchsorted(words, hard, "right")
        until = np.where(i < len(words), words[np.minimum(i, len(words) - 1)] if len(words) else n, n)
        count = np.maximum((until - hard - 1) // step, 0) + 1
        first = np.repeat(np.cumsum(count) - count, count)
        return np.repeat(hard, count) + (np.arange(len(first)) - first) * step

    known = np.zeros(n + 1, bool)
    new = np.unique(np.concatenate([[0], words, [n]]))
    cuts, successor = [], []
    while len(new):
        known[new] = True
        cuts.append(new)
        successor.append(next_cut(new))
        fresh = np.unique(successor[-1])
        fresh = fresh[~known[fresh]]
        new = np.unique(onwards(fresh)) if len(fresh) else fresh
        new = new[~known[new]]
    offsets, nxt = np.concatenate(cuts), np.concatenate(successor)
    order = np.argsort(offsets)
    offsets, nxt = offsets[order], nxt[order]
    nxt[-1] = n
    return offsets, np.searchsorted(offsets, nxt), cls[offsets]


def double(succ: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """All nodes reachable from the roots along ``succ``, by squaring the successor table."""
    reached = np.zeros(len(succ), bool)
    reached[roots] = True
    count = 0
    while (now := int(reached.sum())) != count:
        count = now
        reached[succ[reached]] = True
        succ = succ[succ]
    return reached


def pieces_of(texts: list[str], limits: list[int], overlaps: list[int], reach: float = 0.6) -> list[list[tuple[int, int, int]]]:
    """(start, end, class) of the pieces of each text. All texts are doubled together, in one table."""
    offsets, succ, cls, roots, bounds, base = [], [], [], [], [], 0
    for text, limit, overlap in zip(texts, limits, overlaps, strict=True):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        o, s, c = successors(codes, limit, overlap, reach)
        offsets.append(o)
        succ.append(s + base)
        cls.append(c)
        roots.append(base)
        base += len(o)
        bounds.append(base)
    if not texts:
        return []
    reached, o, c = double(np.concatenate(succ), np.array(roots)), np.concatenate(offsets), np.concatenate(cls)
    out, low = [], 0
    for high, overlap, limit in zip(bounds, overlaps, limits, strict=True):
        cuts = np.flatnonzero(reached[low:high]) + low
        ends, kinds = o[cuts[1:]], c[cuts[1:]]
        starts = np.concatenate([[0], ends[:-1] - overlap])
        out.append(list(zip(starts.tolist(), ends.tolist(), kinds.tolist(), strict=True)))
        low = high
    return out


def split(df: DataFrame, limits: DataFrame, *, key: str = "row_id", text: str = "text", table: str = "table_name", reach: float = 0.6) -> DataFrame:
    """Pieces of every text of ``df`` longer than its table's limit.

    df: table, key, text. limits: table_name, max_chars, overlap_chars, one row a table: broadcast if there are at most session.SMALL_ROWS, joined else.
    Texts within the limit never leave the JVM; there is no shuffle. A text stays in one task, as its bytes do in one row.
    """
    each = limits.select(F.col("table_name").alias("_limit_of"), F.col("max_chars").cast("int").alias("_limit"), F.col("overlap_chars").cast("int").alias("_overlap")).where("_limit > 0").dropDuplicates(["_limit_of"])
    over = df.select(F.col(table).alias("_table"), F.col(key).cast("bigint").alias("_key"), F.col(text).alias("_text"))
    over = over.join(small(each), F.col("_table") == F.col("_limit_of")).where(F.length("_text") > F.col("_limit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                names, keys, texts, most, laps = (part.column(i).to_pylist() for i in range(5))
                laps = [min(max(lap or 0, 0), limit - 1) for lap, limit in zip(laps, most, strict=True)]
                columns: list[list] = [[] for _ in _ARROW]
                for name, k, t, pieces in zip(names, keys, texts, pieces_of(texts, most, laps, reach), strict=True):
                    for i, (a, b, c) in enumerate(pieces):
                        row = (name, k, i, a, b, "end" if b == len(t) else CLASSES[c], t[a:b])
                        for column, x in zip(columns, row, strict=True):
                            column.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)

    return over.select("_table", "_key", "_text", "_limit", "_overlap").mapInArrow(run, PIECE_SCHEMA)
