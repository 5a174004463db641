from __future__ import annotations

import json
from collections import Counter
from itertools import combinations

import pyarrow as pa
import pytest

from quire.llm import pairs as pr
from quire.llm import repetition as rp

P = "The quick brown fox jumps over the lazy dog near the river bank every morning."
Q = "Nothing here says anything that has been said in this text before now, friend."


def test_repeats_are_measured():
    texts = [P, f"{P}\n{P}", f"{P} {P.upper()}\n(2) {P.replace('lazy', 'tired')}", f"{P}\n{Q}", "", None, "12 34", "la la", "天気がとても良いので散歩に行きました。" * 4, "buy now " * 50]
    s = rp.shares(texts)
    assert s[0] == s[3] == s[4] == s[5] == s[6] == s[7] == 0
    assert abs(s[1] - 0.5) < 1e-9 and abs(s[2] - 2 / 3) < 0.03 and 0.7 < s[8] <= 0.8 and s[9] > 0.9


def test_texts_do_not_see_each_other():
    assert list(rp.shares([P, P, P])) == [0, 0, 0]


def test_brute_force():
    import random

    rng = random.Random(3)
    for _ in range(40):
        words = [rng.choice(["aa", "bb", "cc"]) for _ in range(rng.randrange(0, 40))]
        seen, cover = set(), [False] * len(words)
        for i in range(len(words) - 4):
            run = tuple(words[i : i + 5])
            if run in seen:
                cover[i : i + 5] = [True] * 5
            seen.add(run)
        want = sum(cover) / len(words) if words else 0
        assert abs(rp.shares([" ".join(words)], gap=0)[0] - want) < 1e-9


def test_rows(spark):
    df = spark.createDataFrame([(1, P * 3, 0.0), (1, P * 3, 0.0), (2, None, 0.0), (3, " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(15_000)), 0.0)], "doc_id bigint, text string, repeated_share double")
    got = [(r.doc_id, round(r.repeated_share, 2)) for r in rp.repeated_share(df).orderBy("doc_id").collect()]
    assert got[0] == got[1] and got[0][1] > 0.6 and got[2:] == [(2, 0.0), (3, 0.0)]
    assert rp.repeated_share(df.limit(0)).count() == 0


def _analysis(*records):
    return json.dumps({"relationships_interactions": [{"participants": p} for p in records]})


def test_pairs_against_brute_force(spark):
    import random

    rng = random.Random(5)
    rows, truth, single, total = [], Counter(), Counter(), Counter()
    for c in range(300):
        book = rng.choice("xxxyz")
        records = [[rng.choice("ABCDE") for _ in range(rng.randrange(0, 5))] for _ in range(rng.randrange(0, 4))]
        for r in records:
            items = sorted(set(r))
            total[book] += 1
            single.update((book, i) for i in items)
            truth.update((book, *p) for p in combinations(items, 2))
        row = (f"c{c}", book, "success", _analysis(*records))
        rows += [row] * rng.choice([1, 1, 2]) + [(f"c{c}", book, "error", _analysis(["A", "B"]))] * (c % 7 == 0)
    rows += [("n", None, "success", _analysis(["A", "B"])), (None, "x", "success", _analysis(["A", "B"])), ("bad", "x", "success", "{"), ("none", "x", "success", None)]
    df = spark.createDataFrame(rows, "chunk_id string, document_id string, analysis_status string, analysis string").selectExpr("*", "'x' as grp", "1 as n").repartition(5)
    got = pr.pair_counts(pr.participant_records(df)).collect()
    assert {(r.grp, r.a, r.b): r.n_ab for r in got} == truth
    for r in got:
        assert (r.n_a, r.n_b, r.n) == (single[r.grp, r.a], single[r.grp, r.b], total[r.grp])
        assert abs(r.lift - r.n_ab * r.n / (r.n_a * r.n_b)) < 1e-9 and r.odds_ratio > 0
    assert {(r.grp, r.a, r.b) for r in pr.pair_counts(pr.participant_records(df), least=20).collect()} == {k for k, n in truth.items() if n >= 20}
    assert pr.pair_counts(pr.participant_records(df.limit(0))).count() == 0


def test_shapes_of_participants(spark):
    record = {"relationships_interactions": [{"participants": ["A", " ", None, "A", {"name": "B"}]}, None, "bare", {"participants": "C"}]}
    df = spark.createDataFrame([("c", "x", "success", json.dumps(json.dumps(record)))], "chunk_id string, document_id string, analysis_status string, analysis string")
    assert pr.participant_records(df).collect()[0]["items"] == [["A", "B"], [], ["C"]]


def _batch(*rows):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.list_(pa.int64()), pa.int32(), pa.int32()), strict=True)], names=["grp", "ids", "low", "high"])


def test_runs_are_bounded_within_a_record(monkeypatch):
    monkeypatch.setattr(pr, "RUN_CODES", 1 << 14)
    m = 1500
    ids = list(range(7, 7 + m))
    whole, total = Counter(), 0
    for run in pr._runs(iter([_batch(("x", ids, 0, m), ("x", [7, 8], 0, 2), ("y", [7, 8], 0, 2))])):
        codes = list(zip(run.column(0).to_pylist(), run.column(1).to_pylist(), strict=True))
        assert len(codes) <= (1 << 14) + m and codes == sorted(set(codes), key=lambda c: (c[0], c[1] % (1 << 64)))
        for code, n in zip(codes, run.column(2).to_pylist(), strict=True):
            total += n
            whole[code] += n if len(whole) < 100 or code in whole else 0
    assert total == m * (m - 1) // 2 + m + 1 + 2 * 4
    parts = sum(n for low in range(0, m, 400) for run in pr._runs(iter([_batch(("x", ids, low, low + 400))])) for n in run.column(2).to_pylist())
    assert parts == m * (m - 1) // 2 + m + 1
    assert whole["x", 7 << 32 | 8] in (0, 2) and [r.num_rows for r in pr._runs(iter([]))] == [0]


def test_sorted_rows_are_counted_over_batches():
    rows = [("x", 1, 2), ("x", 1, 3), ("x", 2, 1), ("y", 2, 1), ("y", 2, 1), ("y", 2, 5)]
    for cut in range(len(rows) + 1):
        parts = [pa.RecordBatch.from_pylist([dict(zip(pr._RUN.names, r, strict=True)) for r in part], schema=pr._RUN) for part in (rows[:cut], rows[cut:])]
        got = [tuple(r.values()) for b in pr._merged(iter(parts)) for r in b.to_pylist()]
        assert got == [("x", 1, 5), ("x", 2, 1), ("y", 2, 7)]
    assert list(pr._merged(iter([]))) == []


@pytest.mark.parametrize("bounds", [{"HASH_BITS": 3}, {"HASH_BITS": 3, "CLASH_ROWS": 2}, {"SPLIT_ITEMS": 3, "RUN_CODES": 10}])
def test_numbers_that_clash_and_large_records(spark, monkeypatch, bounds):
    for k, v in bounds.items():
        monkeypatch.setattr(pr, k, v)
    names = [f"n{i:03d}" for i in range(40)]
    rows = [(g, [names[i : i + k], names[:2], []]) for g in "xy" for i, k in ((0, 40), (3, 6), (3, 1), (0, 2))] + [("x", None), (None, [["a", "b"]]), ("z", [["q", None, " ", "q", "p"]])]
    df = spark.createDataFrame(rows, "grp string, items array<array<string>>")
    truth, total, single = Counter(), Counter(), Counter()
    for g, records in rows:
        for r in records or [] if g else []:
            items = sorted({i for i in r if i and i.strip()})
            total[g] += 1
            single.update((g, i) for i in items)
            truth.update((g, *p) for p in combinations(items, 2))
    got = {(r.grp, r.a, r.b): (r.n_ab, r.n_a, r.n_b, r.n) for r in pr.pair_counts(df).collect()}
    assert got == {(g, a, b): (n, single[g, a], single[g, b], total[g]) for (g, a, b), n in truth.items()}


def test_line_frequency(spark):
    foot = "Printed by A. B., 1901."
    rows = [(i, f"Text number {chr(97 + i) * 9}\n{foot}\r\n\n12\n", "x", 0) for i in range(4)] + [(9, foot.upper(), "x", 0), (10, foot, "y", 0), (11, None, "x", 0), (12, "", None, 0), (13, f"{foot}\n{foot}\nab", None, 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, line int")
    got = {r.doc_id: (r.letters, round(r.removed_share, 3), r.rejected) for r in rp.line_frequency(df, most=4).collect()}
    assert got[9] == (11, 1.0, True) and got[0] == (30, round(11 / 30, 3), False) and got[10] == (11, 0.0, False)
    assert got[11] == (0, 0.0, False) == got[12] and got[13] == (24, 0.0, False) and len(got) == 9
    assert all(not r.rejected for r in rp.line_frequency(df, most=5).collect()) and rp.line_frequency(df.limit(0)).count() == 0
