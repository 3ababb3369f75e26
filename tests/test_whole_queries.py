"""Queries over whole tables against other ways of counting than their SQL."""

from collections import Counter

import pytest

from lattica import plans
from lattica.operators import similarity as S
from lattica.plans import temporal
from lattica.sources import projection as P

from .conftest import SF, comparable


def run(spark, name):
    return plans.queries()[name](spark, SF)


def test_copies_keep_their_representative(spark):
    rows = [(1, "one two three four"), (2, "One  two three FOUR"), (3, "one two three four"), (4, "five six seven"), (5, "too short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for pairs in (S.jaccard_pairs, S.minhash_pairs):
        assert sorted(tuple(r) for r in pairs(docs).collect()) == [(1, 2, 1.0), (1, 3, 1.0)]
    assert sorted(tuple(r) for r in S.jaccard_classes(docs).collect()) == [(1, 1), (2, 1), (3, 1), (4, 4)]


def test_no_document_of_a_pair_is_lost(spark):
    """Pairs and classes together are all pairs at 0.7, by brute force."""
    docs = P.table(spark, SF, "documents")
    sets = {}
    for r in S.shingles(docs).collect():
        sets.setdefault(r["doc_id"], set()).add(r["shingle"])
    ids = sorted(sets)
    want = {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b])}
    members, got = {}, set()
    for d, r in run(spark, "jaccard_classes").collect():
        members.setdefault(r, []).append(d)
    pairs = [(r["a"], r["b"]) for r in run(spark, "jaccard_pairs").collect()]
    linked = [(r, r) for r in members] + [(a, b) for a, b in pairs if a in members and b in members]
    assert sorted(b for a, b in pairs if b not in members) == sorted(d for r, ds in members.items() for d in ds if d != r)
    for x, y in linked:
        got |= {(min(a, b), max(a, b)) for a in members[x] for b in members[y] if a != b}
    assert got == want


def edges_of(df):
    return sorted((r["src"], r["dst"]) for r in df.select("src", "dst").collect())


def reached(edges, sources, without=None):
    after, seen = {}, {s for s in sources if s != without}
    for a, b in edges:
        after.setdefault(a, []).append(b)
    todo = list(seen)
    while todo:
        for b in after.get(todo.pop(), ()):
            if b not in seen and b != without:
                seen.add(b)
                todo.append(b)
    return seen


@pytest.mark.parametrize("name,table", [("call_cycles", "sparse_calls"), ("import_cycles", "imports")])
def test_cycles_of_all_edges(spark, name, table):
    edges = edges_of(getattr(P, table)(spark, SF))
    reach = {a: reached(edges, [a]) for a in {x for e in edges for x in e}}
    groups = {tuple(sorted(b for b in reach[a] if a in reach[b])) for a in reach}
    want = sorted((g[0], len(g), ",".join(map(str, g))) for g in groups if len(g) > 1)
    assert want and sorted(tuple(r) for r in run(spark, name).collect()) == want


def test_imports_are_all_edges(spark, duck):
    want = duck.execute("SELECT DISTINCT s_nationkey, c_nationkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey <> c_nationkey").fetchall()
    assert edges_of(P.imports(spark, SF)) == sorted(want)


def test_cuts_of_the_sparse_graph(spark):
    edges = edges_of(P.sparse_calls(spark, SF))
    both = sorted({*edges, *((b, a) for a, b in edges)})
    near = {}
    for a, b in both:
        near.setdefault(a, []).append(b)
    points = [n for n, ends in near.items() if not set(ends) <= reached(both, ends[:1], without=n)]
    cut = [(a, b) for a, b in {(min(e), max(e)) for e in edges} if b not in reached([e for e in both if set(e) != {a, b}], [a])]
    assert points and sorted(r["id"] for r in run(spark, "articulation_points").collect()) == sorted(points)
    assert cut and sorted((r["a"], r["b"]) for r in run(spark, "bridges").collect()) == sorted(cut)


def test_dominators_of_the_sparse_graph(spark):
    edges = edges_of(P.sparse_calls(spark, SF))
    roots = {a for a, _ in edges} - {b for _, b in edges} | {edges[0][0]}
    live = reached(edges, roots)
    under = {c: live - reached(edges, roots, without=c) - {c} for c in live}
    above = {v: [c for c in live if v in under[c]] for v in live}
    want = {v: max(above[v], key=lambda c: len(above[c])) if above[v] else -1 for v in live}
    got = {r["id"]: r["idom"] for r in run(spark, "dominators").collect()}
    assert {k: v for k, v in got.items() if k != -1} == want


@pytest.mark.parametrize("name", ["knn_exact", "knn_anomaly", "knn_quantized"])
def test_all_asked_vectors_are_answered(spark, name):
    asked = {r[0] for r in P.table(spark, SF, "embeddings").where("vec_id % 20 = 0").select("vec_id").collect()}
    got = Counter(r["query_id"] for r in run(spark, name).collect())
    assert set(got) == asked and set(got.values()) == {1 if name == "knn_anomaly" else 10}


def test_co_change_takes_commits_of_up_to_30_files(spark, duck):
    r = duck.execute(f"{temporal._counted()} SELECT a, b, round(weight, 6) AS weight, n FROM pairs WHERE weight >= 0.3")
    df = run(spark, "co_change")
    assert comparable(df.columns, df.collect()) == comparable([d[0] for d in r.description], r.fetchall())


def test_taint_paths_of_ten_calls(spark):
    after = {}
    for a, b in edges_of(P.sparse_calls(spark, SF)):
        after.setdefault(a, []).append(b)
    want = []

    def follow(path, sanitized):
        for v in after.get(path[-1], ()) if len(path) <= 10 else ():
            if v not in path:
                clean = sanitized or v % 5 == 0
                if v % 37 == 0:
                    want.append((path[0], v, len(path), clean))
                else:
                    follow([*path, v], clean)

    for r in P.nodes(spark, SF).where("id % 41 = 0").collect():
        follow([r["id"]], False)
    assert max(h for *_, h, _ in want) > 6
    assert Counter(tuple(r) for r in run(spark, "taint_paths").collect()) == Counter(want)


@pytest.mark.parametrize("name", ["betweenness_sampled", "weighted_betweenness"])
def test_betweenness_takes_all_nodes_as_sources(spark, name):
    from lattica.operators import kernels as K

    n, e = P.nodes(spark, SF), P.sparse_calls(spark, SF)
    if name == "weighted_betweenness":
        e = e.selectExpr("src", "dst", "1.0D w").join(n.selectExpr("id AS dst", "1.0D + complexity % 5 AS v"), "dst").selectExpr("src", "dst", "v AS w")
    parts = K._dealt_betweenness(e, n.select("id"), name == "weighted_betweenness", K.MOST_EDGES)
    want = {r[0]: round(r[1], 4) for r in parts.groupBy("id").sum("part").collect()}
    assert want and {r["id"]: round(r["betweenness"], 4) for r in run(spark, name).collect()} == want
