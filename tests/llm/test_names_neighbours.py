from __future__ import annotations

import json

import numpy as np

from quire.llm import names as nm
from quire.llm import neighbours as nb


def _entities(spark, chunk, block=()):
    c = spark.createDataFrame([(d, json.dumps({"entities": {"characters": list(x)}})) for d, x in chunk] + [("d", None), ("d", "{"), (None, '{"entities": {"characters": ["A B"]}}')], "document_id string, analysis string").selectExpr("*", "1 as n", "'x' as spelling")
    b = spark.createDataFrame([(d, json.dumps({"key_entities_in_block": {"organizations": list(x)}})) for d, x in block] + [("d", "[]")], "document_id string, analysis string")
    rows = nm.link_names(nm.mention_counts(c, b)).collect()
    out: dict = {}
    for r in rows:
        out.setdefault((r.grp, r.entity), set()).add(r.spelling)
    return out


def test_people(spark):
    many = ["Constance Garnerra"] * 20 + ["Philippa Lornbourne"] * 15 + ["Philippa Nollcroft"] * 12 + ["Ambrose Nollcroft"] * 14 + ["Zoë Bréelle"] * 9
    odd = ["Garnerra, Constance", "C. Granerra", "Connie Garnerra", "Miss Constance Garnerra", "CONSTANCE GARNERRA", "Constance  Garnerra", "A. Nollcroft", "Amrbose Nollcroft", "Nollcroft", "Zoe Breelle", "Dr. Bréelle", "Zoë Henry Bréelle", "the narrator", "unknown", "a crowd", "", " ", None, {"name": "Lornbourne"}]
    got = _entities(spark, [("d", many), ("d", odd), ("e", ["Constance Garnera", "Zoë"])])
    assert got["d", "Constance Garnerra"] == {"Constance Garnerra", *odd[:6]}
    assert got["d", "Ambrose Nollcroft"] == {"Ambrose Nollcroft", "A. Nollcroft", "Amrbose Nollcroft"}
    assert got["d", "Philippa Nollcroft"] == {"Philippa Nollcroft"} and got["d", "Nollcroft"] == {"Nollcroft"}
    assert got["d", "Zoë Bréelle"] == {"Zoë Bréelle", "Zoe Breelle", "Dr. Bréelle", "Zoë Henry Bréelle"}
    assert got["d", "Philippa Lornbourne"] == {"Philippa Lornbourne", "Lornbourne"}
    assert all(got["d", x] == {x} for x in ("the narrator", "unknown", "a crowd"))
    assert got["e", "Constance Garnera"] == {"Constance Garnera"}


def test_short_forms_of_any_cast():
    for short, given in (("Dave", "David"), ("Steve", "Stephen"), ("Becky", "Rebecca"), ("Nell", "Eleanor"), ("Walt", "Walter"), ("Sue", "Susan"), ("Vicky", "Victoria"), ("Bill", "William"), ("Jake", "Jacob")):
        assert nm.channel_cost(f"{short} Garnerra", f"{given} Garnerra", False) == nm.COST["nick"]
        assert ("n=" + given.lower(), 0) in nm.name(short, False).typed_keys() & nm.name(f"{given} Garnerra", False).canonical_keys()
        assert _meet(f"{short} Gnarrera", f"{given} Garnerra")
    assert nm.channel_cost("Dave Garnerra", "Daniel Garnerra", False) is None


def _meet(typed, canonical, org=False):
    """Whether the keys of a spelling and a candidate bring them together."""
    right: dict = {}
    for key, mark in nm.name(canonical, org).canonical_keys():
        right.setdefault(key, []).append(mark)
    return any(mark == 0 or mark != other for key, mark in nm.name(typed, org).typed_keys() for other in right.get(key, ()))


def test_keys_bring_likely_spellings_together():
    people = {"Constance Garnerra": ["Garnerra, Constance", "C. Granerra", "Connie", "Const.", "Conie", "GARNERRA", "Constance Granerar", "Miss Constance  Garnerra", "Constanec Garnerra"], "Zoë Bréelle-Østby": ["Zoe Breelle", "Z. stby", "Zo Breelle-Ostby"], "Ann Li": ["A. Li", "Anne Li", "Li, Ann"]}
    for c, typed in people.items():
        for v in typed:
            assert _meet(v, c) and nm.channel_cost(v, c, False) is not None, v
    assert not _meet("Constance Ruskcroft", "Constance Garnerra") and not _meet("the narrator", "Constance Garnerra")
    orgs = {"Vintsby Historical Association": ["VHA", "V.H.A.", "Vintsby Asso.", "Vitnsby Hist. Assn."], "Falknell & Sons Limited": ["Falknell Ltd.", "FSL"], "Royal Society": ["ROYAL SOCIETY", "Royal Socitey"]}
    for c, typed in orgs.items():
        for v in typed:
            assert _meet(v, c, True) and nm.channel_cost(v, c, True) is not None, v
    assert not _meet("Ruskcroft Historical Association", "Vintsby Historical Association", True)


def test_names_of_many_words():
    full = "María del Carmen García López"
    for v in ("Maria del Carmen Garcia Lopez", full.upper(), "María del Carmen Garcai López", "María C. García López", "López, María del Carmen García"):
        assert nm.channel_cost(v, full, False) is not None, v
    assert nm.channel_cost("Maria del Carmen Garcia Lopez", full, False) == nm.COST["accent"]
    assert nm.channel_cost("Maria del Carmen Garcia Ruiz", full, False) is None
    assert nm.channel_cost("Anna Ruth Ruth Lee", "Anna Ruth Lee", False) == nm.COST["middle"]


def test_organisations(spark):
    names = ["University of Haxric"] * 5 + ["Ñorberg Historical Association"] * 6 + ["Vintsby Historical Association"] * 6 + ["Falknell & Sons Ltd"] * 4 + ["Saint Ruskcroft Hospital"] * 4
    odd = ["Haxric Haxr.", "Univ. of Haxric", "ÑHA", "Ñ.H.A.", "Vintsby Asso.", "Vintsby Historical Assn.", "The Vintsby Historical Association", "FSL", "Falknell Ltd.", "falknell & sons ltd", "SRH", "St. Ruscroft Hosp."]
    got = _entities(spark, [("d", ["Haxric Norberg"])], [("d", names), ("d", odd)])
    assert got["d", "University of Haxric"] == {"University of Haxric", "Haxric Haxr.", "Univ. of Haxric"}
    assert got["d", "Ñorberg Historical Association"] == {"Ñorberg Historical Association", "ÑHA", "Ñ.H.A."}
    assert got["d", "Vintsby Historical Association"] == {"Vintsby Historical Association", "Vintsby Asso.", "Vintsby Historical Assn.", "The Vintsby Historical Association"}
    assert got["d", "Falknell & Sons Ltd"] == {"Falknell & Sons Ltd", "FSL", "Falknell Ltd.", "falknell & sons ltd"}
    assert got["d", "Saint Ruskcroft Hospital"] == {"Saint Ruskcroft Hospital", "SRH", "St. Ruscroft Hosp."}


def test_pairs_and_empty_tables(spark):
    linked = spark.createDataFrame([("d", e, s) for e, s in (("x", "b"), ("x", "a"), ("x", "c"), ("y", "z"))], "grp string, entity string, spelling string")
    assert {(r.spelling_a, r.spelling_b) for r in nm.spelling_pairs(linked).collect()} == {("a", "b"), ("a", "c"), ("b", "c")}
    empty = spark.createDataFrame([], "document_id string, analysis string")
    assert nm.link_names(nm.mention_counts(empty, empty)).count() == 0


def test_no_table_passes_through_the_driver(spark, monkeypatch):
    plans, cut = [], nm.cut
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(nm, "cut", lambda df: (plans.append(plan(df)), cut(df))[1])
    counts = spark.createDataFrame([("d", s, False, 2) for s in ("Constance Garnerra", "Connie Garnerra", "Garnerra", "CONSTANCE GARNERRA", "Sue")], "grp string, spelling string, org boolean, n bigint")
    found = nm.spelling_pairs(nm.link_names(counts))
    assert found.count() == 6
    plans.append(plan(found))
    assert len(plans) >= 3 and all("SortMergeJoin" in p and "Broadcast" not in p for p in plans)


def test_distance():
    assert [nm.distance(*p) for p in (("abc", "abc"), ("abc", "acb"), ("abc", "abcd"), ("abc", "xyz"), ("", "ab"))] == [0, 1, 1, 3, 2]


def _vectors(n, seed=1, groups=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 64))
    for g in range(groups):
        x[n - 3 * groups + 3 * g : n - 3 * groups + 3 * g + 3] = x[g] + rng.normal(size=(3, 64)) * 0.15
    return x


def test_graph_recall():
    x = _vectors(4000, groups=100)
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    g = nb.Graph(x, m=16, ef=64)
    ids, sims = g.own()
    true = x @ x.T
    np.fill_diagonal(true, -2)
    top = np.argpartition(-true, 10, axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(ids, top, strict=True)]) > 0.9
    assert np.allclose(sims[5], true[5][ids[5]], atol=1e-5)
    low = nb.Graph(x)
    near = np.argwhere(np.triu(true) > 0.85)
    found = low.own()[0]
    assert len(near) > 200 and np.mean([b in found[a] or a in found[b] for a, b in near]) > 0.98
    q, s = g.query(x[:50], 5, 64)
    assert (q[:, 0] == np.arange(50)).mean() > 0.95 and s[0, 0] > 0.999
    assert nb.Graph(x[:0]).own()[0].shape == (0, 10) and (nb.Graph(x[:1]).own()[0] == -1).all()


def _near(spark, rows, **how):
    df = spark.createDataFrame(rows, "chunk_id string, vector_values array<float>").selectExpr("*", "'x' as key", "0 as shard")
    out: dict = {}
    for r in (how.pop("by", nb.similar))(df, **how).collect():
        out.setdefault(r.key, {})[r.neighbour] = r.similarity
    return out


def test_sharded_search(spark):
    x = _vectors(1500, groups=120)
    rows = [(f"k{i:04d}", v.tolist()) for i, v in enumerate(x)]
    odd = [("null", None), ("short", [1.0]), ("zero", [0.0] * 64), ("nan", [float("nan")] * 64), ("inf", [float("inf")] + [1.0] * 63), ("hole", [None] + [1.0] * 63), (None, x[0].tolist()), rows[7], rows[7], ("copy", (x[3] * 2).tolist())]
    y = np.vstack([x, x[3]])
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    names = [k for k, _ in rows] + ["copy"]
    true = y @ y.T
    np.fill_diagonal(true, -2)
    want = {(names[a], names[b]) for a, b in np.argwhere(true > 0.85)}
    got = _near(spark, rows + odd, least=0.85, shard=400, probes=3)
    pairs = {(a, b) for a, bs in got.items() for b in bs}
    assert pairs <= want and len({tuple(sorted(p)) for p in pairs}) / len({tuple(sorted(p)) for p in want}) > 0.95
    divided = _near(spark, rows + odd, least=0.85, shard=150, probes=3, guests=100)
    pairs = {tuple(sorted((a, b))) for a, bs in divided.items() for b in bs}
    assert pairs <= want and len(pairs) / len({tuple(sorted(p)) for p in want}) > 0.95
    parted = _near(spark, rows + odd, by=nb.exact, cell=150, probes=99, guests=70)
    assert set(parted) == set(names) and all(len(v) == 10 for v in parted.values())
    exact = _near(spark, rows + odd, by=nb.exact, cell=400, probes=8)
    assert set(exact) == set(names) and all(len(v) == 10 for v in exact.values())
    top = np.argsort(-true, axis=1)[:, :10]
    assert np.mean([len({names[j] for j in top[i]} & set(exact[names[i]])) / 10 for i in range(len(names))]) > 0.9
    assert all({names[j] for j in top[i]} == set(parted[names[i]]) for i in range(len(names)) if i not in (3, len(names) - 1))


def test_the_exact_search_keeps_its_share_of_many_cells(spark, monkeypatch):
    monkeypatch.setattr(nb, "CELL_MOST", 16)  # as if the collection were far larger: 250 cells
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2000, 8)) @ rng.normal(size=(8, 64))
    got = _near(spark, [(f"k{i:04d}", v.tolist()) for i, v in enumerate(x)], by=nb.exact, cell=16, probes=4)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    true = x @ x.T
    np.fill_diagonal(true, -2)
    top = np.argsort(-true, axis=1)[:, :10]
    assert np.mean([len({f"k{j:04d}" for j in top[i]} & set(got.get(f"k{i:04d}", ()))) / 10 for i in range(len(x))]) > 0.9


def test_few_vectors(spark):
    v = np.eye(64)[0].tolist()
    assert _near(spark, [("a", v), ("b", v), ("b", v)]) == {"a": {"b": 1.0}, "b": {"a": 1.0}}
    assert _near(spark, [("a", v)]) == {} and _near(spark, [("a", None)]) == {}


def test_two_levels_of_centres():
    x = _vectors(6000)
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    c = nb.Centres(x, 300, flat=50)
    assert c.tops is not None and 250 <= len(c.all) <= 350 and sum(map(len, c.groups)) == len(c.all)
    got, want = c.nearest(x[:500], 5), np.argsort(-(x[:500] @ c.all.T), axis=1)[:, :5]
    assert np.mean([len(set(a) & set(b)) / 5 for a, b in zip(got, want, strict=True)]) > 0.95
    every = c.nearest(x[:3], 10_000)
    assert all(sorted(r) == list(range(len(c.all))) for r in every.tolist())
    plan = nb.Plan.fit(x, 600_000, 300, 3, 3000, 2000, 1.0, 16)
    loads = np.bincount(plan.task, minlength=16)
    assert plan.parts.max() > 1 or plan.divisions.max() > 1
    assert loads.min() > 0 and len(plan.task) == plan.first[-1]


def test_search_of_stated_queries(spark):
    x = _vectors(3000, groups=50)
    rows = [(f"k{i:04d}", v.tolist()) for i, v in enumerate(x)] + [("k0000", x[0].tolist()), ("null", None), ("copy", x[20].tolist())]
    x = np.vstack([x, x[20]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    names = [f"k{i:04d}" for i in range(3000)] + ["copy"]
    true = x @ x.T
    np.fill_diagonal(true, -2)
    for how in ({"shard": 800}, {"shard": 300, "guests": 40, "share": 1}):  # without clusters, no cell may be left out
        got = _near(spark, rows, by=lambda df, **k: nb.search(df, df.chunk_id.endswith("0"), **k), **how)
        asked = [i for i, n in enumerate(names) if n.endswith("0")]
        assert set(got) == {names[i] for i in asked} and all(len(v) == 10 for v in got.values()) and "copy" in got["k0020"]
        assert np.mean([len({names[j] for j in np.argsort(-true[i])[:10]} & set(got[names[i]])) / 10 for i in asked]) > 0.9
    assert _near(spark, rows, by=lambda df, **k: nb.search(df, df.chunk_id == "none", **k)) == {}


def test_recall_of_the_shipped_search(spark):
    """The query as registered, against brute force."""
    from pathlib import Path

    import pytest

    from quire.llm import queries

    where = "/root/testdata/sf0.1"
    if not Path(where).exists():
        pytest.skip("no test data here")
    e = spark.read.parquet(f"{where}/embeddings_dict.parquet")
    held = {r.key: r.vec for r in nb.usable(e, "chunk_id", "vector_values", 64).collect()}
    names = list(held)
    x = np.array([held[n] for n in names], np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got: dict = {}
    for r in queries.p6_search(spark, where).collect():
        got.setdefault(r.chunk_id, set()).add(r.neighbour)
    asked = {r.chunk_id for r in e.where("row_id % 20 = 0").collect()} & set(held)
    assert set(got) == asked
    at = {n: i for i, n in enumerate(names)}
    hits = []
    for n in asked:
        s = x @ x[at[n]]
        s[at[n]] = -2
        hits.append(len({names[j] for j in np.argpartition(-s, 10)[:10]} & got[n]) / 10)
    assert np.mean(hits) >= 0.9
