from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as hs

from quire.llm import splitting as sp


def _greedy(text, limit, overlap, reach=0.6):
    """The same cuts one after another, from the class table alone."""
    import numpy as np

    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    cls, n, at, out = sp.boundary_classes(codes), len(text), 0, []
    while True:
        start = 0 if at == 0 else at - overlap
        if start + limit >= n:
            return [*out, (start, n)]
        low, high = max(at, start) + 1, start + limit
        best = None
        for k in range(5):
            fit = [c for c in range(max(low, start + -(-int(reach * limit * 1000) // 1000)), high + 1) if cls[c] <= k]
            if fit:
                best = fit[-1]
                break
        if best is None:
            fit = [c for c in range(low, high + 1) if cls[c] <= 4]
            best = fit[-1] if fit else high
        out.append((start, best))
        at = best


@settings(max_examples=60, deadline=None)
@given(hs.text(alphabet="ab. ,\n!x", min_size=0, max_size=300), hs.sampled_from([(10, 0), (20, 5), (50, 10)]))
def test_doubling_gives_the_greedy_cuts(text, sizes):
    limit, overlap = sizes
    if len(text) <= limit:
        return
    got = [(a, b) for a, b, _ in sp.pieces_of([text], [limit], [overlap])[0]]
    assert got == _greedy(text, limit, overlap)


@settings(max_examples=60, deadline=None)
@given(hs.lists(hs.text(min_size=31, max_size=200), min_size=1, max_size=5))
def test_pieces_keep_the_limit_and_join_to_the_text(texts):
    for text, pieces in zip(texts, sp.pieces_of(texts, [30] * len(texts), [7] * len(texts)), strict=True):
        assert all(b - a <= 30 for a, b, _ in pieces)
        assert text == text[: pieces[0][1]] + "".join(text[a + 7 : b] for a, b, _ in pieces[1:])
        assert all(a2 == b - 7 for (_, b, _), (a2, _, _) in zip(pieces, pieces[1:], strict=False))


def test_natural_boundaries_come_first():
    text = "One sentence here. Another one there.\n\nA new paragraph, with a clause. The end of it all comes now."
    ends = [text[:b] for _, b, _ in sp.pieces_of([text], [60], [0])[0]]
    assert ends[0].endswith("there.\n\n") and ends[1].endswith("it all comes now.") or ends[1].endswith("clause. ")
    wide = "天气很好。他走了。" * 6
    assert all(wide[b - 1] == "。" for _, b, _ in sp.pieces_of([wide], [20], [0])[0])
    marked = "é" * 30
    assert all(b % 2 == 0 for _, b, _ in sp.pieces_of([marked], [11], [0])[0])


def test_cases(spark):
    rows = [("t", 1, None), ("t", 2, ""), ("t", 3, "x" * 10), ("t", 4, "x" * 11), ("t", 4, "x" * 11), ("t", 5, "word " * 40_000), ("u", 6, "y" * 99), (None, 7, "z" * 99)]
    df = spark.createDataFrame(rows, "table_name string, row_id bigint, text string").selectExpr("*", "1 as max_chars", "2 as piece_index", "'x' as boundary")
    limits = spark.createDataFrame([("t", 10, 3), ("t", 10, 3), ("v", None, 1)], "table_name string, max_chars int, overlap_chars int")
    out = sp.split(df, limits).collect()
    assert sorted({r.row_id for r in out}) == [4, 5] and sum(r.row_id == 4 for r in out) == 4
    assert [r.text for r in out if r.row_id == 4][:2] == ["x" * 10, "x" * 4]
    assert sp.split(df.limit(0), limits).count() == 0 and sp.split(df, limits.limit(0)).count() == 0


def test_queries_agree_with_lengths(spark, data):
    import __spark_entry__ as entry

    found = entry.queries()["p5_found"](spark, data)
    limits = {r.table_name: r.max_chars for r in spark.read.parquet(f"{data}/split_limits.parquet").collect()}
    want = {(t, r.row_id) for t in ("chunks", "large_blocks") for r in spark.read.parquet(f"{data}/{t}.parquet").collect() if r.text and len(r.text) > limits[t]}
    assert {(r.table_name, r.row_id) for r in found.collect()} == want


@pytest.mark.parametrize("lap", [-5, 10, 50])
def test_overlap_is_kept_below_the_limit(spark, lap):
    df = spark.createDataFrame([("t", 1, "abc " * 20)], "table_name string, row_id bigint, text string")
    limits = spark.createDataFrame([("t", 10, lap)], "table_name string, max_chars int, overlap_chars int")
    assert all(len(r.text) <= 10 for r in sp.split(df, limits).collect())
