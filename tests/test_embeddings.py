"""node2vec against its definition, computed in one place."""

import numpy as np
import pytest

from lattica import plans
from lattica.operators import embeddings as E
from lattica.operators import graph as G
from lattica.operators import kernels as K
from lattica.sources import projection as P

from .conftest import SF


def cliques(n=12):
    """Two cliques and one edge between them."""
    return [(b + i, b + j) for b in (100, 200) for i in range(n) for j in range(i)] + [(100, 200)]


def test_walks_follow_edges_whole_and_even():
    src, dst = np.array(cliques()).T
    ids, start, near = K._undirected(src, dst)
    places = np.arange(len(ids), dtype=np.int32)
    w = E.walk_arrays(start, near, places, 20, 200, 3)
    assert w.shape == (200 * len(ids), 20) and (w[:, 0] == np.repeat(places, 200)).all()
    both = {(a, b) for a, b in zip(*(np.searchsorted(ids, x) for x in (src, dst)))}
    both |= {(b, a) for a, b in both}
    assert {*zip(w[:, :-1].reshape(-1).tolist(), w[:, 1:].reshape(-1).tolist())} == both
    first = np.bincount(w[:200, 1], minlength=len(ids))[near[start[0] : start[1]]]
    assert first.min() > 0.3 * first.mean() and len(np.unique(w[:200], axis=0)) > 190
    parts = [E.walk_arrays(start, near, places[k : k + 5], 20, 200, 3) for k in range(0, len(ids), 5)]
    assert (np.concatenate(parts) == w).all()


def test_window_pairs_are_those_of_each_place():
    walks = np.arange(60, dtype=np.int32).reshape(3, 20)
    walks[1, 4:] = -1
    keys = E.walk_keys(np.arange(3, dtype=np.int32), 1, 9)
    got = sorted(zip(*(a.tolist() for a in E.window_pairs(walks, keys, 5))))
    want = []
    for i in range(3):
        n = int((walks[i] >= 0).sum())
        for p in range(n):
            wide = int(E._drawn(keys[i : i + 1], 1000 + p, 5)[0]) + 1
            want += [(int(walks[i, p]), int(walks[i, q])) for q in range(max(0, p - wide), min(n, p + wide + 1)) if q != p]
    assert got == sorted(want)


def test_repeated_rows_add_up():
    rng = np.random.default_rng(0)
    at, rows = rng.integers(0, 7, 40), rng.random((40, 3))
    for now in (False, True):
        got = rng.random((9, 3))
        want = got.copy()
        np.add.at(want, at, rows)
        E._add_rows(got, at, rows.copy(), got[at] if now else None, 100)
        assert np.allclose(got, want)
        E._add_rows(want, at, 100 * rows)
        assert np.allclose(np.linalg.norm(want - got, axis=1)[np.unique(at)], E.CLIP)


def test_a_step_is_the_gradient():
    """One step: every pair pulls, and the contexts drawn push with the weight of five negatives."""
    rng = np.random.default_rng(1)
    w, v = rng.standard_normal((2, 64, 4)).astype(np.float32)
    c, x, n = np.array([0, 0, 1, 5], np.int32), np.array([1, 2, 1, 0], np.int32), np.array([1, 3, 2, 20], np.float32)
    noise = np.eye(64, dtype=np.float32)[3]
    sig = lambda t: 1 / (1 + np.exp(-t))
    dw, dv = np.zeros((64, 4)), np.zeros((64, 4))
    for a, b, k in zip(c, x, n):
        dw[a] += k * ((1 - sig(w[a] @ v[b])) * v[b] - 5 * sig(w[a] @ v[3]) * v[3])
        dv[b] += k * (1 - sig(w[a] @ v[b])) * w[a]
        dv[3] -= 5 * k * sig(w[a] @ v[3]) * w[a]
    got_w, got_v = w.copy(), v.copy()
    E.train_block(got_w, got_v, noise, c, x, n, (0.01, 0.01), 5, rng)
    assert np.allclose(got_w, w + 0.01 * dw, atol=1e-5) and np.allclose(got_v, v + 0.01 * dv, atol=1e-5)


def vectors(df):
    return {r["id"]: np.array(r["embedding"]) for r in df.collect()}


def test_the_query_trains_on_every_pair_of_every_walk(spark):
    """Ten walks of twenty nodes from each node, 128 numbers, five epochs, as one computation does it."""
    got = vectors(plans.queries()["node2vec"](spark, SF))
    src, dst = np.array([(r["src"], r["dst"]) for r in P.sparse_calls(spark, SF).collect()]).T
    ids, start, near = K._undirected(src, dst)
    places = np.arange(len(ids), dtype=np.int32)
    walks = E.walk_arrays(start, near, places, 20, 10, 1)
    c, x = E.window_pairs(walks, E.walk_keys(places, 10, 1), 5)
    key, n = np.unique(c.astype(np.int64) * len(ids) + x, return_counts=True)
    noise = np.bincount(walks.reshape(-1)).astype(np.float32) ** 0.75
    w = (2 * np.random.default_rng((1, 0)).random((len(ids), 128), np.float32) - 1) * np.float32(np.sqrt(6 / 256))
    v = np.zeros_like(w)
    rate = lambda k: 0.025 - (0.025 - 0.0001) * k / 5
    for k in range(5):
        E.train_block(w, v, noise, (key // len(ids)).astype(np.int32), (key % len(ids)).astype(np.int32), n.astype(np.float32), (rate(k), rate(k + 1)), 5, np.random.default_rng((1, k, 0)))
    assert sorted(got) == ids.tolist()
    assert np.allclose(np.array([got[i] for i in ids]), w, atol=1e-3)


@pytest.mark.parametrize("buckets", [1, 3])
def test_buckets_lose_no_node_and_tell_cliques_apart(spark, buckets):
    edges = spark.createDataFrame(cliques() + [(7, 7)], "src long, dst long")
    got = vectors(E.skip_gram(edges, buckets=buckets))
    assert sorted(got) == sorted({i for e in cliques() for i in e})
    m = np.array([got[i] / np.linalg.norm(got[i]) for i in sorted(got)])
    cosine, same = m @ m.T, np.arange(24)[:, None] // 12 == np.arange(24) // 12
    assert cosine[same].mean() > cosine[~same].mean() + 0.2


def test_hubs_stay_steady(spark):
    edges = spark.createDataFrame([(0, i) for i in range(1, 1500)] + [(i, i + 1) for i in range(1, 1500, 2)], "src long, dst long")
    got = vectors(E.skip_gram(edges, buckets=2))
    m = np.array([got[i] for i in range(1501)])
    assert np.isfinite(m).all() and np.linalg.norm(m, axis=1).max() < 50


def test_no_edges_no_rows(spark):
    assert E.skip_gram(spark.createDataFrame([], "src long, dst long")).collect() == []


def test_walk_rows(spark):
    edges = spark.createDataFrame(cliques(), "src long, dst long")
    nodes = spark.createDataFrame([(100,), (205,), (999,)], "id long")
    got = [r["walk"] for r in G.walks(edges, nodes).collect()]
    assert sorted(w[0] for w in got) == ["100"] * 10 + ["205"] * 10 and {len(w) for w in got} == {20}
    both = {*cliques(), *((b, a) for a, b in cliques())}
    assert all((int(a), int(b)) in both for w in got for a, b in zip(w, w[1:]))
