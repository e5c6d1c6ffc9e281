"""Hard negatives and nearest neighbours against all pairs."""

import math

import duckdb
import numpy as np
import pytest

from parcelflow.llm import collision_search, hard_negatives, vectors
from parcelflow.llm.queries import op11_gnat_negatives, op12_collision_search

SCHEMA = "vec_id long, label int, embedding array<float>, score double, row string, block int, query_id int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, None, "x", 1, 2) for r in rows], SCHEMA)


def broken(v, zero=True):
    return v is None or any(x is None or not math.isfinite(x) for x in v) or (zero and not any(v))


def made(seed, n=700, width=12, values=None):
    """Clusters, equal vectors, repeated ids, null and broken vectors, vectors of another length."""
    r = np.random.default_rng(seed)
    centres = r.standard_normal((6, width))
    rows = []
    for i in range(n):
        v = (centres[r.integers(6)] + r.standard_normal(width) * r.choice([0, 0.1, 1])) / 4 if values is None else r.choice(values, width)
        rows.append((i, int(r.integers(10)), [float(np.float32(x)) for x in v]))
    rows += [(20, 3, rows[5][2]), (100, 3, rows[7][2]), (100, 3, rows[7][2]), (None, 4, rows[20][2]), (300, None, rows[1][2]), (301, 1, None), (302, 1, [1.0, None]), (400, 2, [float("nan")] * width), (500, 2, [float("inf")] * width), (600, 5, [0.0] * width), (700, 5, []), (800, 6, [0.5, 0.25])]
    return rows


def brute_negatives(rows):
    take = [(i, r[0], (r[1] + 1) % 10 if r[0] is not None and r[0] % 7 == 0 else r[1], [math.floor(256 * x) for x in r[2]]) for i, r in enumerate(rows) if r[1] is not None and not broken(r[2], zero=False)]
    width = max(len(t[3]) for t in take)
    m = np.array([t[3] + [0] * (width - len(t[3])) for t in take], dtype=np.int64)
    first = lambda t: (-1 if t[1] is None else t[1], t[0])
    out = []
    for a, (i, vec_id, label, _) in enumerate(take):
        if vec_id is None or vec_id % 100:
            continue
        scores = (m @ m[a]).tolist()
        ranked = sorted((j for j in range(len(take)) if j != a), key=lambda j: (-scores[j], first(take[j])))
        for p in [j for j in ranked if take[j][2] == label][:5]:
            negatives = [j for j in ranked if take[j][2] != label and 80 * scores[p] <= 100 * scores[j] <= 100 * scores[p]][:5]
            out += [(vec_id, take[p][1], k + 1, take[j][1], scores[p], scores[j]) for k, j in enumerate(negatives)]
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("values", [None, [-0.5, 0.0, 0.25, 1.0], [0.001, 2000.0, 3e6, 1e30]])
def test_negatives_equal_all_pairs(spark, monkeypatch, seed, values):
    monkeypatch.setattr(vectors.grid, "__defaults__", ("row", 200, 3))
    rows = made(seed, values=values) if values is None or values[-1] < 1e9 else made(seed, 120, 3, [0.001, -2000.0, 3e6])
    got = hard_negatives.mined(frame(spark, rows), leaf=20)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_negatives(rows)


def test_tree_leaves_subtrees_out():
    """On clustered vectors most leaves are left out, and what is found is what all pairs give."""
    r = np.random.default_rng(1)
    v = np.floor(256 * (r.standard_normal((40, 8))[r.integers(40, size=6000)] + 0.05 * r.standard_normal((6000, 8))))
    ids, none = np.arange(len(v)), np.zeros(len(v), dtype=bool)
    tree = hard_negatives.Tree(v, leaf=64)
    labels = r.integers(10, size=len(v))
    who = np.arange(0, len(v), 100)
    squares = (v[who] * v[who]).sum(axis=1)
    q = hard_negatives.Queries(v[who], np.ceil(0.99 * squares), squares.copy(), labels[who], who, False, (labels, ids, none, ids))
    tree.search(q, 5)
    for i, w in enumerate(who):
        s = v @ v[w]
        fit = np.flatnonzero((labels != labels[w]) & (s <= squares[i]) & (s >= np.ceil(0.99 * squares[i])))
        assert q.best[i].tolist() == sorted(fit, key=lambda j: (-s[j], j))[:5]
    assert tree.looked < 0.7 * len(who) * len(v)


def test_negatives_equal_sql(spark, tiny):
    c = duckdb.connect()
    c.sql(f"create view embeddings as select * from '{tiny}/embeddings.parquet'")
    got = op11_gnat_negatives(spark, tiny)
    want = c.sql(hard_negatives.mined_sql())
    assert got.columns == want.columns
    rows = sorted(tuple(r) for r in got.collect())
    assert rows == sorted(want.fetchall()) and len(rows) > 20


def brute_nearest(rows, every, k):
    take = [(i, r[0], r[2]) for i, r in enumerate(rows) if not broken(r[2])]
    width = max(len(t[2]) for t in take)
    m = np.array([t[2] + [0.0] * (width - len(t[2])) for t in take])
    out = {}
    for a, (i, vec_id, _) in enumerate(take):
        if vec_id is None or vec_id % every:
            continue
        scores = (m * m[a]).sum(axis=1).tolist()
        ranked = sorted((j for j in range(len(take)) if j != a), key=lambda j: (-scores[j], -1 if take[j][1] is None else take[j][1], take[j][0]))[:k]
        out.setdefault(vec_id, []).append([(take[j][1], scores[j]) for j in ranked])
    return out


def by_query(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return out


def test_search_of_small_blocks_is_exact(spark, monkeypatch):
    """Blocks smaller than the probe are verified as a whole: order, ties, repeated and null ids are then the rule's."""
    monkeypatch.setattr(vectors.grid, "__defaults__", ("row", 150, 7))
    rows = made(4)
    got, want = by_query(collision_search.nearest(frame(spark, rows))), brute_nearest(rows, 20, 20)
    assert set(got) == set(want)
    for q, lists in want.items():
        ranks = [r for r, _, _ in got[q]]
        assert sorted(ranks) == sorted(x + 1 for one in lists for x in range(len(one)))
        assert sorted(((i is None, i or 0), s) for _, i, s in got[q]) == sorted(((i is None, i or 0), s) for one in lists for i, s in one)
        if len(lists) == 1:
            assert [(i, s) for _, i, s in got[q]] == lists[0]


@pytest.mark.parametrize("width,spread", [(8, 1.0), (64, 1.0), (64, 0.2), (200, 1.0)])
def test_recall(width, spread):
    """At least nine of ten of the true nearest, for random, clustered and unequally long vectors."""
    r = np.random.default_rng(width)
    v = r.standard_normal((50, width))[r.integers(50, size=4000)] * (spread < 1) + spread * r.standard_normal((4000, width))
    v *= r.choice([1, 1, 3], size=(4000, 1))
    block, found = collision_search.Block(v), 0
    for q in range(0, 4000, 80):
        places, scores = block.near(v[q], 20, q)
        s = (v * v[q]).sum(axis=1)
        s[q] = -np.inf
        assert q not in places and np.array_equal(scores, s[places])
        found += len(set(np.argsort(-s)[:20]) & set(places[np.argsort(-scores)][:20]))
    assert found >= 0.9 * 20 * 50


def test_recall_of_the_query(spark, tiny):
    rows = [tuple(r) for r in spark.read.parquet(f"{tiny}/embeddings.parquet").select("vec_id", "label", "embedding").collect()]
    got, want = by_query(op12_collision_search(spark, tiny)), brute_nearest(rows, 20, 20)
    assert {q: len(x) for q, x in got.items()} == {q: len(x[0]) for q, x in want.items()}
    hits = sum(len({i for _, i, _ in got[q]} & {i for i, _ in want[q][0]}) for q in want)
    assert hits >= 0.9 * sum(len(x[0]) for x in want.values())
    true = {(q, i): s for q, x in want.items() for i, s in x[0]}
    assert all(s == true.get((q, i), s) for q, x in got.items() for _, i, s in x)


def test_few_rows(spark):
    """Fewer candidates than wanted: all of them; none for empty tables or a single row."""
    rows = [(0, 1, [1.0, 0.0]), (20, 1, [1.0, 0.0]), (3, 2, [0.5, 1.0])]
    assert {q: [(k, i) for k, i, _ in x] for q, x in by_query(collision_search.nearest(frame(spark, rows))).items()} == {0: [(1, 20), (2, 3)], 20: [(1, 0), (2, 3)]}
    for few in ([], rows[:1], [(None, None, None)]):
        assert collision_search.nearest(frame(spark, few)).count() == hard_negatives.mined(frame(spark, few)).count() == 0


def test_directions_are_fixed():
    d = collision_search.directions(65)
    assert np.array_equal(d, collision_search.directions(65)) and np.allclose(d.T @ d, 65 * np.eye(64))
