"""Graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import embeddings as E
from ..operators import graph as G
from ..operators import kernels as K
from ..sources import projection as P
from .registry import query, rounded

DEGREE = "degree AS (SELECT id, coalesce(i, 0)::BIGINT AS fan_in, coalesce(o, 0)::BIGINT AS fan_out FROM nodes LEFT JOIN (SELECT dst AS id, count(*) AS i FROM calls GROUP BY 1) USING (id) LEFT JOIN (SELECT src AS id, count(*) AS o FROM calls GROUP BY 1) USING (id))"
WITH = f"WITH RECURSIVE {P.NODES}, {P.CALLS}, {P.SPARSE}"
ENTRY = "entry AS (SELECT id FROM nodes WHERE id NOT IN (SELECT dst FROM sparse))"


@query(f"{WITH} SELECT 'node' AS what, module AS kind, count(*) AS n FROM nodes GROUP BY module UNION ALL SELECT 'edge', 'calls', count(*) FROM calls UNION ALL SELECT 'edge', 'sparse', count(*) FROM sparse")
def graph_stats(spark, sf_dir):
    n = P.nodes(spark, sf_dir).groupBy(F.col("module").alias("kind")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("node").alias("what"), "kind", "n")
    for kind, e in (("calls", P.calls(spark, sf_dir)), ("sparse", P.sparse_calls(spark, sf_dir))):
        n = n.union(e.agg(F.count(F.lit(1)).alias("n")).select(F.lit("edge"), F.lit(kind), "n"))
    return n


@query(f"{WITH}, {DEGREE} SELECT * FROM degree")
def fan_in_out(spark, sf_dir):
    return G.fan_in_out(P.nodes(spark, sf_dir), P.calls(spark, sf_dir))


@query(f"""{WITH}, {DEGREE}, k AS (SELECT *, fan_in + fan_out AS degree, CASE WHEN fan_in >= 25 AND fan_out >= 25 THEN 'hub' WHEN fan_in >= 25 THEN 'sink' WHEN fan_out >= 25 THEN 'source' END AS kind FROM degree)
SELECT id, kind, CASE WHEN degree >= 70 THEN 3 WHEN kind = 'hub' THEN 2 ELSE 1 END::BIGINT AS severity, degree, fan_in, fan_out FROM k WHERE kind IS NOT NULL""")
def degree_centrality(spark, sf_dir):
    return G.degree_findings(P.nodes(spark, sf_dir), P.calls(spark, sf_dir), 70, 25, 25)


def _spread(by):
    return f"{WITH} SELECT dst AS id, count(DISTINCT n.{by}) AS spread FROM calls JOIN nodes n ON src = n.id GROUP BY dst"


@query(_spread("file_path"))
def caller_file_spread(spark, sf_dir):
    return G.caller_spread(P.nodes(spark, sf_dir), P.calls(spark, sf_dir), "file_path")


@query(_spread("module"))
def caller_module_spread(spark, sf_dir):
    return G.caller_spread(P.nodes(spark, sf_dir), P.calls(spark, sf_dir), "module")


@query(f"{WITH} SELECT dst AS id, sum(CASE WHEN a.module <> b.module THEN 1 ELSE 0 END)::BIGINT AS external FROM calls JOIN nodes a ON src = a.id JOIN nodes b ON dst = b.id GROUP BY dst")
def external_callers(spark, sf_dir):
    return G.external_callers(P.nodes(spark, sf_dir), P.calls(spark, sf_dir), "module")


@query(f"""{WITH}, ends AS (SELECT a.file_path AS a, b.file_path AS b FROM calls JOIN nodes a ON src = a.id JOIN nodes b ON dst = b.id), m AS (
  SELECT module, sum(CASE WHEN ends.a = module AND ends.b = module THEN 1 ELSE 0 END)::BIGINT AS internal,
    sum(CASE WHEN ends.a <> module AND ends.b = module THEN 1 ELSE 0 END)::BIGINT AS incoming, sum(CASE WHEN ends.a = module AND ends.b <> module THEN 1 ELSE 0 END)::BIGINT AS outgoing
  FROM (SELECT DISTINCT file_path AS module FROM nodes) LEFT JOIN ends ON ends.a = module OR ends.b = module GROUP BY module)
SELECT module, internal, incoming, outgoing, round(CASE WHEN internal + incoming + outgoing = 0 THEN 0.0 ELSE (incoming + outgoing) / (internal + incoming + outgoing) END, 6) AS coupling,
  round(CASE WHEN internal + incoming + outgoing = 0 THEN 1.0 ELSE internal / (internal + incoming + outgoing) END, 6) AS cohesion FROM m""")
def module_metrics(spark, sf_dir):
    return rounded(G.module_metrics(P.nodes(spark, sf_dir), P.calls(spark, sf_dir), "file_path"), "coupling", "cohesion")


@query(f"{WITH} SELECT id, complexity, loc FROM nodes WHERE nullif(complexity, 0) >= 40")
def complex_nodes(spark, sf_dir):
    return P.nodes(spark, sf_dir).where(F.nullif("complexity", F.lit(0)) >= 40).select("id", "complexity", "loc")


@query(f"{WITH} SELECT id, params FROM nodes WHERE nullif(params, 0) >= 9")
def long_param_nodes(spark, sf_dir):
    return P.nodes(spark, sf_dir).where(F.nullif("params", F.lit(0)) >= 9).select("id", "params")


@query(f"""{WITH}, {ENTRY}, bfs AS (SELECT id, 0::BIGINT AS depth FROM entry UNION SELECT dst, depth + 1 FROM bfs JOIN sparse ON src = bfs.id WHERE depth < 40)
SELECT id, min(depth) AS depth FROM bfs GROUP BY id""")
def call_depth(spark, sf_dir):
    n, e = P.nodes(spark, sf_dir), P.sparse_calls(spark, sf_dir)
    return G.breadth_first(e, G.entry_points(n, e))


@query(f"""{WITH}, src AS (SELECT id FROM nodes WHERE exported), r AS (SELECT id FROM src UNION SELECT dst FROM r JOIN sparse ON src = r.id)
SELECT id, id IN (SELECT id FROM r) AS reachable FROM nodes""")
def reachable(spark, sf_dir):
    n, e = P.nodes(spark, sf_dir), P.sparse_calls(spark, sf_dir)
    hit = G.breadth_first(e, n.where("exported").select("id")).select("id", F.lit(True).alias("hit"))
    return n.select("id").join(hit, "id", "left").select("id", F.coalesce("hit", F.lit(False)).alias("reachable"))


@query(f"""{WITH}, t AS (SELECT id, 0 AS depth FROM nodes WHERE id % 50 = 0 UNION SELECT dst, depth + 1 FROM t JOIN sparse ON src = t.id WHERE depth < 5)
SELECT id, min(depth)::BIGINT AS depth FROM t GROUP BY id""")
def test_reachability(spark, sf_dir):
    return G.breadth_first(P.sparse_calls(spark, sf_dir), P.nodes(spark, sf_dir).where("id % 50 = 0").select("id"), 5)


@query(f"""{WITH}, {ENTRY} SELECT e.id::VARCHAR || '>' || a.dst::VARCHAR || '>' || b.dst::VARCHAR || '>' || c.dst::VARCHAR AS chain
FROM entry e JOIN sparse a ON a.src = e.id JOIN sparse b ON b.src = a.dst JOIN sparse c ON c.src = b.dst
WHERE len(list_distinct([e.id, a.dst, b.dst, c.dst])) = 4""")
def bounded_chains(spark, sf_dir):
    n, e = P.nodes(spark, sf_dir), P.sparse_calls(spark, sf_dir)
    return G.bounded_chains(e, G.entry_points(n, e), 3).select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("chain"))


def _rank_sql(rounds: int, weighted: bool) -> str:
    share = "w / sum(w) OVER (PARTITION BY src)"
    edges = "sparse JOIN nodes ON id = dst" if weighted else "sparse"
    w = "(1 + complexity % 5)::DOUBLE" if weighted else "1.0::DOUBLE"
    steps = [f"shares AS (SELECT src, dst, {share} AS share FROM (SELECT src, dst, {w} AS w FROM {edges}))", "r0 AS (SELECT id, 1.0::DOUBLE / count(*) OVER () AS rank FROM nodes)"]
    for i in range(rounds):
        steps.append(f"r{i + 1} AS MATERIALIZED (SELECT id, 0.15 / (SELECT count(*) FROM nodes) + 0.85 * (SELECT coalesce(sum(rank), 0) FROM r{i} WHERE id NOT IN (SELECT src FROM sparse)) / (SELECT count(*) FROM nodes) + 0.85 * coalesce(got, 0) AS rank FROM r{i} LEFT JOIN (SELECT dst, sum(rank * share) AS got FROM shares JOIN r{i} ON src = id GROUP BY dst) ON id = dst)")
    return f"{WITH}, {', '.join(steps)} SELECT id, round(rank, 9) AS rank FROM r{rounds}"


@query(_rank_sql(20, False))
def pagerank(spark, sf_dir):
    return rounded(G.page_rank(P.nodes(spark, sf_dir), P.sparse_calls(spark, sf_dir), tolerance=0.0), "rank", digits=9)


@query(_rank_sql(20, True))
def weighted_pagerank(spark, sf_dir):
    n = P.nodes(spark, sf_dir)
    e = P.sparse_calls(spark, sf_dir).join(n.select(F.col("id").alias("dst"), (1.0 + F.col("complexity") % 5).alias("w")), "dst")
    return rounded(G.page_rank(n, e, tolerance=0.0, weight="w"), "rank", digits=9)


def _cycles_sql(edges: str) -> str:
    return f"""reach AS (SELECT src AS a, dst AS b FROM {edges} UNION SELECT a, dst FROM reach JOIN {edges} ON src = b),
both_ways AS (SELECT x.a, min(x.b) AS low FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY x.a)
SELECT low AS component, count(*) AS size, string_agg(a::VARCHAR, ',' ORDER BY a) AS members FROM both_ways GROUP BY low HAVING count(*) > 1"""


@query(f"WITH RECURSIVE {P.IMPORTS}, {_cycles_sql('imports')}")
def import_cycles(spark, sf_dir):
    return G.cycles(P.imports(spark, sf_dir)).select("component", "size", "members")


@query(f"{WITH}, {_cycles_sql('sparse')}")
def call_cycles(spark, sf_dir):
    return G.cycles(P.sparse_calls(spark, sf_dir)).select("component", "size", "members")


UNDIRECTED = "und AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM sparse), ids AS (SELECT a AS id FROM und UNION SELECT b FROM und), two AS (SELECT a, b FROM und UNION ALL SELECT b, a FROM und)"


@query(f"""{WITH}, {UNDIRECTED},
start AS (SELECT cut.id AS cut, min(t.b) AS s FROM ids cut JOIN two t ON t.a = cut.id GROUP BY cut.id),
walk AS (SELECT cut, s AS v FROM start UNION SELECT cut, b FROM walk JOIN two ON a = v WHERE b <> cut)
SELECT DISTINCT t.a AS id FROM two t LEFT JOIN walk w ON w.cut = t.a AND w.v = t.b WHERE w.v IS NULL""")
def articulation_points(spark, sf_dir):
    return K.articulation_points(P.sparse_calls(spark, sf_dir))


@query(f"""{WITH}, {UNDIRECTED},
walk AS (SELECT a AS x, b AS y, a AS v FROM und UNION SELECT x, y, b FROM walk JOIN two ON a = v WHERE NOT (a = x AND b = y) AND NOT (a = y AND b = x))
SELECT a, b FROM und LEFT JOIN walk ON x = a AND y = b AND v = b WHERE v IS NULL""")
def bridges(spark, sf_dir):
    return K.bridges(P.sparse_calls(spark, sf_dir))


@query(f"""{WITH}, roots AS (SELECT DISTINCT src AS id FROM sparse WHERE src NOT IN (SELECT dst FROM sparse) UNION SELECT min(src) FROM sparse),
live AS (SELECT id FROM roots UNION SELECT dst FROM live JOIN sparse ON src = live.id),
walk AS (SELECT cut.id AS cut, r.id AS v FROM live cut, roots r WHERE r.id <> cut.id UNION SELECT cut, dst FROM walk JOIN sparse ON src = v WHERE dst <> cut),
dom AS (SELECT c.id AS d, l.id AS v FROM live c, live l WHERE c.id <> l.id EXCEPT SELECT cut, v FROM walk),
deep AS (SELECT v AS d, count(*) AS deep FROM dom GROUP BY v),
ranked AS (SELECT v, dom.d, coalesce(deep, 0) AS deep FROM dom LEFT JOIN deep USING (d))
SELECT l.id, coalesce(max_by(d, deep), -1) AS idom FROM live l LEFT JOIN ranked ON v = l.id GROUP BY l.id""")
def dominators(spark, sf_dir):
    return K.dominator_tree(P.sparse_calls(spark, sf_dir))


@query()
def betweenness_sampled(spark, sf_dir):
    """All nodes are sources: nothing is left to a sample."""
    return rounded(K.betweenness(P.sparse_calls(spark, sf_dir), P.nodes(spark, sf_dir).select("id")), "betweenness")


@query()
def louvain(spark, sf_dir):
    return K.community_table(P.sparse_calls(spark, sf_dir))


@query(f"""{WITH}, und AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM sparse), ends AS (SELECT x.module AS ga, y.module AS gb FROM und JOIN nodes x ON a = x.id JOIN nodes y ON b = y.id),
m AS (SELECT count(*) AS m FROM und), d AS (SELECT g, count(*) AS d FROM (SELECT ga AS g FROM ends UNION ALL SELECT gb FROM ends) GROUP BY g), e AS (SELECT ga AS g, count(*) AS e FROM ends WHERE ga = gb GROUP BY ga)
SELECT round(sum(coalesce(e, 0) / m - pow(d / (2.0 * m), 2)), 9) AS modularity FROM d LEFT JOIN e USING (g), m""")
def modularity(spark, sf_dir):
    return rounded(G.modularity(P.sparse_calls(spark, sf_dir), P.nodes(spark, sf_dir), "module"), "modularity", digits=9)


@query(f"{WITH} SELECT a.module AS src_module, b.module AS dst_module, count(*) AS n FROM calls JOIN nodes a ON src = a.id JOIN nodes b ON dst = b.id WHERE a.module <> b.module GROUP BY ALL")
def module_edges(spark, sf_dir):
    n = P.nodes(spark, sf_dir).select("id", "module")
    j = P.calls(spark, sf_dir).join(n.toDF("src", "src_module"), "src").join(n.toDF("dst", "dst_module"), "dst")
    return j.where("src_module != dst_module").groupBy("src_module", "dst_module").agg(F.count(F.lit(1)).alias("n"))


@query(f"{WITH}, {DEGREE} SELECT id, loc FROM nodes JOIN degree USING (id) WHERE fan_in <= 10 AND NOT exported AND id NOT IN (SELECT src FROM sparse)")
def dead_code_candidates(spark, sf_dir):
    n, e = P.nodes(spark, sf_dir), P.calls(spark, sf_dir)
    used = P.sparse_calls(spark, sf_dir).select(F.col("src").alias("id")).distinct()
    return n.join(G.fan_in_out(n, e).where("fan_in <= 10"), "id").where("not exported").join(used, "id", "left_anti").select("id", "loc")


@query(f"""{WITH}, t AS (SELECT [id] AS path, id AS v, FALSE AS sanitized, FALSE AS sink FROM nodes WHERE id % 41 = 0
UNION ALL SELECT list_append(path, dst), dst, sanitized OR dst % 5 = 0, dst % 37 = 0 FROM t JOIN sparse ON src = t.v WHERE NOT sink AND len(path) <= 10 AND NOT list_contains(path, dst))
SELECT path[1] AS source, v AS sink, (len(path) - 1)::BIGINT AS hops, sanitized FROM t WHERE sink AND len(path) > 1""")
def taint_paths(spark, sf_dir):
    n = P.nodes(spark, sf_dir)
    return G.taint_paths(P.sparse_calls(spark, sf_dir), n.where("id % 41 = 0"), n.where("id % 37 = 0"), n.where("id % 5 = 0"), 10)


@query()
def weighted_betweenness(spark, sf_dir):
    n = P.nodes(spark, sf_dir)
    e = P.sparse_calls(spark, sf_dir).join(n.select(F.col("id").alias("dst"), (1.0 + F.col("complexity") % 5).alias("w")), "dst")
    total = n.count()
    return rounded(K.weighted_betweenness(e, n.select("id"), total), "betweenness")


@query()
def community_misplacement(spark, sf_dir):
    """Nodes whose community isn't that of most nodes of their file."""
    c = K.community_table(P.sparse_calls(spark, sf_dir)).checkpoint()
    n = P.nodes(spark, sf_dir).select("id", "file_path").join(c, "id")
    most = n.groupBy("file_path", "community").agg(F.count(F.lit(1)).alias("n")).groupBy("file_path").agg(F.max(F.struct("n", (-F.col("community")).alias("neg"))).alias("m"))
    return n.join(most, "file_path").where("community != -m.neg and m.n > 1").select("id", "file_path", "community")


@query()
def node2vec(spark, sf_dir):
    """Skip-gram vectors of 128 numbers over ten seeded walks of twenty nodes from each node of the sparse graph."""
    return E.skip_gram(P.sparse_calls(spark, sf_dir))
