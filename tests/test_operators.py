"""Hand-checkable cases of the library's own operators."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from lattica.operators import findings as O
from lattica.operators import graph as G
from lattica.operators import joins as J
from lattica.operators import kernels as K
from lattica.operators import similarity as S
from lattica.operators import stats
from lattica.operators import temporal as T


def commits(spark, rows):
    return spark.createDataFrame(rows, "hash long, author long, ts string, age_days double, file string")


def test_fresh_commit_has_weight_one(spark):
    c = T.analysed(commits(spark, [(1, 1, "a", 0.0, "x"), (1, 1, "a", 0.0, "y")]))
    assert [tuple(r) for r in T.pairs(c).collect()] == [("x", "y", 1.0, 1)]


def test_decay_over_two_half_lives(spark):
    c = T.analysed(commits(spark, [(1, 1, "a", 180.0, "x"), (1, 1, "a", 180.0, "y")]))
    assert T.pairs(c).count() == 0
    assert abs(T.pairs(c, 0.01).first()["weight"] - 0.25) < 1e-9


def test_large_commits_do_not_count(spark):
    rows = [(1, 1, "a", 0.0, f) for f in "wxyz"]
    assert T.analysed(commits(spark, rows), most_files=3).count() == 0
    assert T.pairs(T.analysed(commits(spark, rows[:3]))).count() == 3


def test_sole_author_is_one_and_weakest_zero(spark):
    o = {(r["file"], r["author"]): r["norm"] for r in T.ownership(commits(spark, [(1, 1, "2001-01-01", 10.0, "x"), (2, 1, "2001-01-02", 9.0, "y"), (3, 2, "2001-01-03", 8.0, "y")])).collect()}
    assert o["x", 1] == 1.0 and o["y", 1] == 1.0 and o["y", 2] == 0.0


def test_module_without_calls(spark):
    n = spark.createDataFrame([(1, "m"), (2, "m")], "id long, module string")
    e = spark.createDataFrame([], "src long, dst long")
    r = G.module_metrics(n, e, "module").first()
    assert (r["coupling"], r["cohesion"]) == (0.0, 1.0)


def test_few_values_keep_the_default(spark):
    v = spark.createDataFrame([("m", float(i)) for i in range(39)], "metric string, value double")
    t = stats.adaptive_threshold(stats.distribution(v), 10.0, 20.0).first()
    assert (t["warn"], t["high"]) == (10.0, 20.0)


def test_percentile_is_nearest_rank(spark):
    v = spark.createDataFrame([("m", float(i)) for i in (1, 2, 3, 4)], "metric string, value double")
    assert stats.distribution(v).first()["p50"] == 3.0


@pytest.mark.parametrize("line,new", [(13, 0), (14, 1)])
def test_fuzzy_match_is_three_lines(spark, line, new):
    a = spark.createDataFrame([("d", "f", line)], "detector string, file string, line long")
    b = spark.createDataFrame([("d", "f", 10)], "detector string, file string, line long")
    assert O.fuzzy_new(a, b).count() == new


def test_innermost_span_wins(spark):
    spans = spark.createDataFrame([(1, "f", 1, 100), (2, "f", 50, 60)], "id long, grp string, s long, e long")
    points = spark.createDataFrame([("f", 55), ("f", 70), ("f", 500)], "grp string, at long")
    got = {r["at"]: r["span_id"] for r in J.innermost(points, spans, "grp", "at", "s", "e").collect()}
    assert got == {55: 2, 70: 1, 500: None}


def test_no_findings_is_a_full_score(spark):
    f = spark.createDataFrame([], "detector string, severity long, pillar string")
    r = O.health(f, F.lit("a"), {"a": 1.0}).first()
    assert (r["a"], r["overall"], r["grade"]) == (100.0, 100.0, "A+")


def test_globs():
    import re

    assert re.match(O.glob_to_regex("src/**/*.py"), "src/a/b.py") and re.match(O.glob_to_regex("src/**/*.py"), "src/b.py")
    assert not re.match(O.glob_to_regex("*.py"), "a/b.py")


def components_by_reachability(edges):
    reach = {}
    nodes = {x for e in edges for x in e}
    for s in nodes:
        seen, todo = set(), [s]
        while todo:
            v = todo.pop()
            for a, b in edges:
                if a == v and b not in seen:
                    seen.add(b)
                    todo.append(b)
        reach[s] = seen
    return {(s, min({s} | {t for t in nodes if t in reach[s] and s in reach[t]})) for s in nodes if any(t in reach[s] and s in reach[t] for t in nodes if t != s)}


@pytest.mark.parametrize("seed", [1, 2])
def test_strong_components(spark, seed):
    rng = random.Random(seed)
    edges = sorted({(rng.randrange(14), rng.randrange(14)) for _ in range(20)})
    got = {tuple(r) for r in G.strong_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == components_by_reachability([e for e in edges if e[0] != e[1]])


def connected(nodes, edges, without=None, cut=None):
    parent = {n: n for n in nodes if n != without}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for e in edges:
        if e != cut and without not in e:
            parent[root(e[0])] = root(e[1])
    return len({root(n) for n in parent})


@pytest.mark.parametrize("seed", range(6))
def test_cuts_by_removal(seed):
    rng = random.Random(seed)
    edges = sorted({tuple(sorted(rng.sample(range(10), 2))) for _ in range(12)})
    nodes = {x for e in edges for x in e}
    whole = connected(nodes, edges)
    points, bridges = K.cuts(edges)
    lone = lambda n: all(n not in e or len(e) == 1 for e in edges)
    assert points == sorted(n for n in nodes if not lone(n) and connected(nodes, edges, without=n) > whole)
    assert bridges == [e for e in edges if connected(nodes, edges, cut=e) > whole]


def test_betweenness_of_a_path(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "src long, dst long")
    s = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "id long")
    assert {r["id"]: r["betweenness"] for r in K.betweenness(e, s).collect()} == {2: 2.0, 3: 2.0}


def test_communities_of_two_cliques():
    edges = [*itertools.combinations(range(5), 2), *itertools.combinations(range(5, 10), 2), (0, 5)]
    found = K.communities(edges)
    assert set(found.values()) == {0, 5} and all(found[i] == 0 for i in range(5))


def test_kernel_refuses_large_graphs(spark):
    with pytest.raises(K.TooLarge):
        K.edge_list(spark.range(20).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")), 10)


def test_minhash_finds_most_pairs(spark):
    from .conftest import SF

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    exact = {(r["a"], r["b"]) for r in S.jaccard_pairs(docs).collect()}
    found = {(r["a"], r["b"]) for r in S.minhash_pairs(docs).collect()}
    assert found <= exact and len(found) >= 0.8 * len(exact)


def test_quantizer_keeps_directions():
    import numpy as np

    x = np.random.default_rng(0).normal(size=(200, 64))
    q = S.Quantizer(64)
    y = q.decode(q.encode(x)[0], 64)
    cos = (x * y).sum(1) / np.linalg.norm(x, axis=1) / np.linalg.norm(y, axis=1)
    assert cos.min() > 0.97


def test_apply_changes(spark, tmp_path):
    from lattica.streaming import changes as C

    source, state, seen = str(tmp_path / "in"), str(tmp_path / "state"), []
    schema = "path string, hash string, deleted boolean, ts long"
    steps = [[("a", "1", False, 1), ("b", "1", False, 1)], [("a", "2", False, 2), ("b", "1", False, 2)], [("b", "", True, 3)]]
    for i, rows in enumerate(steps):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        C.apply_changes(C.read(spark, source, schema), spark, state, "path", lambda df, epoch: seen.append(sorted(tuple(r) for r in df.collect())))
    assert seen == [[("a", "added"), ("b", "added")], [("a", "changed")], [("b", "removed")]]


def test_kernels_take_more_edges_than_the_driver_did(spark):
    """A million and some edges: a chain, whose inner nodes are all cuts, dominators and of one line."""
    n = 1_000_100
    e = spark.range(n).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert K.articulation_points(e).count() == n - 1
    assert K.bridges(e).where("b = a + 1").count() == n
    assert K.dominator_tree(e).where("idom = id - 1").count() == n + 1
    assert K.dominated_counts(e).where(F.col("n") == n - F.col("id")).count() == n


@pytest.mark.parametrize("weighted", [False, True])
def test_betweenness_of_several_components(spark, weighted):
    """Against paths listed one by one; sources outside the graph add nothing."""
    import itertools

    edges = [(0, 1, 1.0), (0, 2, 2.0), (1, 3, 1.0), (2, 3, 2.0), (3, 4, 1.0), (4, 0, 4.0), (10, 11, 1.0), (11, 12, 2.0), (10, 13, 1.0), (13, 12, 2.0)]
    after = {}
    for a, b, w in edges:
        after.setdefault(a, []).append((b, 1 / w if weighted else 1.0))

    def simple(path, length, end):
        if path[-1] == end:
            yield path, length
            return
        for b, w in after.get(path[-1], ()):
            if b not in path:
                yield from simple([*path, b], length + w, end)

    want = {}
    for s, t in itertools.permutations([0, 1, 2, 3, 4, 10, 11, 12, 13], 2):
        found = list(simple([s], 0.0, t))
        best = [p for p, d in found if abs(d - min(x for _, x in found)) < 1e-9]
        for p in best:
            for v in p[1:-1]:
                want[v] = want.get(v, 0.0) + 1 / len(best)
    e = spark.createDataFrame(edges, "src long, dst long, w double")
    s = spark.createDataFrame([(i,) for i in range(20)], "id long")
    got = (K.weighted_betweenness(e, s, 20) if weighted else K.betweenness(e.drop("w"), s)).collect()
    assert {r["id"]: round(r["betweenness"], 9) for r in got} == {k: round(v, 9) for k, v in want.items()}


def test_searches_in_one_task_are_those_in_rounds(spark):
    import random

    draw = random.Random(5)
    e = spark.createDataFrame(sorted({(draw.randrange(60), draw.randrange(60)) for _ in range(90)}), "src long, dst long")
    s = spark.createDataFrame([(3,), (7,), (99,)], "id long")
    for most in (None, 2):
        got = [sorted(tuple(r) for r in G.breadth_first(e, s, most, one_task=n).collect()) for n in (0, 1000)]
        assert got[0] == got[1] and (99, 0) in got[0]
    got = [sorted(tuple(r) for r in G.strong_components(e, one_task=n).collect()) for n in (0, 1000)]
    assert got[0] == got[1] and got[0]


def test_overlaps_in_shares(spark):
    from lattica.operators import joins as J

    spans = spark.range(300).selectExpr("'g' AS k", "id", "id % 90 AS start", "id % 90 + id % 80 AS end")
    got = [sorted(tuple(r) for r in J.overlapping(spans, spans, "k", per_task=n).collect()) for n in (10**9, 500)]
    assert got[0] == got[1] and len(got[0]) == len(set(got[0])) > 1000


def test_trigram_prices_by_key_are_those_by_shuffle(spark):
    from lattica.operators import stats as T

    lines = spark.range(400).selectExpr("id % 40 AS doc_id", "id AS line_no", "transform(sequence(0L, id % 9), i -> cast((id * 7 + i * i) % 13 AS string)) AS tokens")
    got = [{(r[0], r[1]): round(r[2], 9) for r in T.trigram_surprisal(lines, 0.1, 10, most_priced=n).where("bits is not null").collect()} for n in (0, 10**6)]
    assert got[0] == got[1] and len(got[0]) > 200


def test_many_findings_at_few_places(spark):
    """40,000 findings and 40,000 functions at one place are no 1.6 billion pairs."""
    from lattica.operators import roles

    found = spark.range(40_000).selectExpr("id", "'DeadCodeDetector' AS detector", "'f' AS file", "5 AS line")
    functions = spark.range(40_000).selectExpr("id", "'f' AS path", "1 AS line_start", "9 AS line_end")
    last = functions.selectExpr("id", "CASE WHEN id = 39999 THEN 'Test' ELSE 'Core' END AS context")
    assert roles.without_excused(found, functions, last).count() == 0


def test_taint_of_all_categories_is_one_pass(spark):
    from lattica.operators import taint

    files = spark.createDataFrame([("a.py", 'x = request.args\nos.system(x)\ncursor.execute(x)'), ("b.yml", "x = request.args\nos.system(x)")], "path string, content string")
    bodies = files.selectExpr("path", "concat(path, '::f') AS function", "posexplode(split(content, '\\n')) AS (line_no, text)")
    found = taint.central(files, bodies)
    assert sorted((r["function"], r["category"], r["sink_line"]) for r in found.collect()) == [("a.py::f", "command", 2), ("a.py::f", "sql", 3)]
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInPandas") <= 2


def test_shuffles_follow_the_files(spark, tmp_path):
    from lattica import folders

    df = spark.range(20_000).selectExpr("id", "sha2(cast(id AS string), 256) AS x")
    df.write.parquet(str(tmp_path / "t"))
    read = spark.read.parquet(str(tmp_path / "t")).groupBy("id").count()
    assert folders.tasks(read) == 4 and folders.tasks(read, 0.1) > 4
    assert folders.tasks(df.checkpoint()) == 4


def test_nearest_of_many_equal_vectors(spark):
    """Ties go to the smaller ids, and a block's scores are held for a few queries at once."""
    from lattica.operators import similarity as S

    v = spark.range(3_000).selectExpr("id AS vec_id", "array(1.0D, cast(id % 2 AS double)) AS embedding")
    got = sorted(tuple(r)[:3] for r in S.nearest_exact(v.where("vec_id = 100"), v, 3, block=500).collect())
    assert got == [(100, 1, 0), (100, 2, 2), (100, 3, 4)] and S.SLICE <= 100


def test_rank_drift_runs_all_rounds(spark, monkeypatch):
    """Its SQL has twenty rounds; ranks that stop early are ordered otherwise in large graphs."""
    from types import SimpleNamespace

    from lattica.operators import detectors as D

    f = spark.createDataFrame([("a", 1), ("b", 2)], "qualified_name string, complexity int").withColumn("id", F.lit(0))
    ctx = SimpleNamespace(functions=f, edges=spark.createDataFrame([("a", "b")], "src string, dst string"))
    asked = []
    monkeypatch.setattr(D.graph, "page_rank", lambda *a, **k: asked.append(k.get("tolerance", 1e-6)))
    D._ranked(ctx, False)
    D._ranked(ctx, True)
    assert asked == [0.0, 0.0]
