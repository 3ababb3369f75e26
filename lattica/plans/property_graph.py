"""Queries of the property graph, of values and of what is derived from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import kernels as K
from ..operators import property_graph as PG
from ..operators import values as V
from ..sources import code
from ..sources import projection as P
from ..sources import sample_code as S
from .registry import ORACLE, QUERIES, query, rounded

WITH = f"WITH RECURSIVE {S.GRAPH}"


def _graph(spark, sf_dir) -> PG.PropertyGraph:
    return S.property_graph(spark, sf_dir)


@query(f"{WITH} SELECT 'node' AS what, kind, count(*) AS n FROM nodes GROUP BY kind UNION ALL SELECT 'edge', kind, count(*) FROM (SELECT DISTINCT * FROM edges) GROUP BY kind")
def graph_kinds(spark, sf_dir):
    return _graph(spark, sf_dir).stats()


@query(f"{WITH} SELECT * FROM nodes WHERE qualified_name IN ('src/p1/m1.py::f1::1', 'src/p2/m2.py::C2', 'src/p3/m3.py', 'nobody')")
def graph_point_lookup(spark, sf_dir):
    return _graph(spark, sf_dir).by_name("src/p1/m1.py::f1::1", "src/p2/m2.py::C2", "src/p3/m3.py", "nobody")


@query(f"{WITH} SELECT 'all' AS what, * FROM nodes WHERE path = 'src/p2/m2.py' UNION ALL SELECT kind, * FROM nodes WHERE path = 'src/p2/m2.py' AND kind IN ('class', 'function')")
def graph_nodes_in_file(spark, sf_dir):
    g = _graph(spark, sf_dir)
    names = [F.lit("all").alias("what"), *g.nodes.columns]
    found = g.in_file("src/p2/m2.py").select(*names)
    for kind in ("class", "function"):
        found = found.union(g.in_file("src/p2/m2.py", kind).select(F.lit(kind), *g.nodes.columns))
    return found


def _near(name: str, kind: str, out: bool) -> None:
    def run(spark, sf_dir):
        return _graph(spark, sf_dir).near(kind, out)

    run.__name__ = f"graph_{name}"
    a, b = ("src", "dst") if out else ("dst", "src")
    QUERIES[run.__name__], ORACLE[run.__name__] = run, f"{WITH} SELECT DISTINCT {a} AS id, {b} AS other FROM edges WHERE kind = '{kind}'"


for _name, _kind, _out in [
    ("callees", "CALLS", True), ("callers", "CALLS", False), ("importees", "IMPORTS", True), ("importers", "IMPORTS", False), ("parent_classes", "INHERITS", True), ("child_classes", "INHERITS", False),
    ("contains_children", "CONTAINS", True), ("contains_parent", "CONTAINS", False), ("uses_targets", "USES", True), ("uses_sources", "USES", False), ("modified_in", "MODIFIED_IN", True),
]:
    _near(_name, _kind, _out)


@query(f"{WITH} SELECT src, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS place, dst FROM sparse")
def graph_call_adjacency(spark, sf_dir):
    return _graph(spark, sf_dir).adjacency()


@query(f"{WITH} SELECT id, kind, name, n_params, decorators, author FROM nodes LEFT JOIN props USING (id)")
def graph_extra_props(spark, sf_dir):
    return _graph(spark, sf_dir).with_props().select("id", "kind", "name", "n_params", "decorators", "author")


FINGERPRINT = "count(*) AS n, coalesce(sum(concat('0x', substring(md5(concat_ws('|', a.qualified_name, b.qualified_name, e.kind)), 1, 12))::BIGINT), 0)::VARCHAR AS fingerprint FROM (SELECT DISTINCT * FROM {edges}) e JOIN {nodes} a ON src = a.id JOIN {nodes} b ON dst = b.id WHERE a.path <> b.path"


@query(f"{WITH} SELECT {FINGERPRINT.format(edges='edges', nodes='nodes')}")
def graph_edge_fingerprint(spark, sf_dir):
    return _graph(spark, sf_dir).edge_fingerprint()


@query(f"""{WITH}, fe AS (SELECT src, dst FROM edges WHERE kind = 'IMPORTS'), reach AS (SELECT src AS a, dst AS b FROM fe UNION SELECT a, dst FROM reach JOIN fe ON src = b)
SELECT id, id IN (SELECT a FROM reach WHERE a = b) AS in_cycle FROM nodes WHERE kind = 'file'""")
def graph_in_import_cycle(spark, sf_dir):
    g = _graph(spark, sf_dir)
    on = G.strong_components(g.near("IMPORTS").toDF("src", "dst")).select("id", F.lit(True).alias("hit"))
    return g.of_kind("file").select("id").join(on, "id", "left").select("id", F.coalesce("hit", F.lit(False)).alias("in_cycle"))


@query(f"""{WITH}, far AS (SELECT DISTINCT a.src, b.dst FROM sparse a JOIN sparse b ON a.dst = b.src WHERE a.src <> b.dst) SELECT * FROM far ANTI JOIN sparse USING (src, dst)""")
def graph_two_hops(spark, sf_dir):
    return PG.two_hops(P.sparse_calls(spark, sf_dir))


UNDIRECTED = "two AS (SELECT src AS a, dst AS b FROM sparse UNION SELECT dst, src FROM sparse), walk AS (SELECT a AS id, a AS v FROM two UNION SELECT id, b FROM walk JOIN two ON a = v)"


@query(f"WITH RECURSIVE {P.SPARSE}, {UNDIRECTED} SELECT id, min(v) AS component, count(*) AS size FROM walk GROUP BY id")
def component_sizes(spark, sf_dir):
    return PG.component_sizes(P.sparse_calls(spark, sf_dir))


@query(f"""{WITH}, m AS (SELECT id, class_id FROM g WHERE class_id IS NOT NULL), inner_calls AS (SELECT src, dst FROM edges JOIN m a ON src = a.id JOIN m b ON dst = b.id WHERE kind IN ('CALLS', 'NEXT') AND a.class_id = b.class_id
  UNION SELECT a.id, b.id FROM m a JOIN m b ON a.class_id = b.class_id WHERE a.id % 3 = 0 AND b.id = a.id + {4 * 5 * S.FILES}),
two AS (SELECT src AS a, dst AS b FROM inner_calls UNION SELECT dst, src FROM inner_calls), walk AS (SELECT id, id AS v FROM m UNION SELECT id, b FROM walk JOIN two ON a = v), low AS (SELECT id, min(v) AS c FROM walk GROUP BY id)
SELECT class_id, count(*) AS methods, round(count(DISTINCT c) / count(*), 6) AS cohesion FROM m JOIN low USING (id) GROUP BY class_id""")
def class_cohesion(spark, sf_dir):
    """LCOM4 over calls between methods; as few calls stay inside a class, every third method also
    calls the next of its class."""
    g = _graph(spark, sf_dir)
    m = g.near("CONTAINS").where("id between -99999 and -1 and other >= 0").select(F.col("other").alias("id"), F.col("id").alias("class_id"))
    chained = m.where("id % 3 = 0").select(F.col("id").alias("src"), (F.col("id") + 4 * 5 * S.FILES).alias("dst"))
    return rounded(PG.class_cohesion(m, g.near("CALLS").toDF("src", "dst").union(chained)), "cohesion")


DOMINATED = """roots AS (SELECT DISTINCT src AS id FROM sparse WHERE src NOT IN (SELECT dst FROM sparse) UNION SELECT min(src) FROM sparse),
live AS (SELECT id FROM roots UNION SELECT dst FROM live JOIN sparse ON src = live.id),
walked AS (SELECT cut.id AS cut, r.id AS v FROM live cut, roots r WHERE r.id <> cut.id UNION SELECT cut, dst FROM walked JOIN sparse ON src = v WHERE dst <> cut),
dom AS (SELECT c.id AS d, l.id AS v FROM live c, live l WHERE c.id <> l.id EXCEPT SELECT cut, v FROM walked)"""


def _idom(spark, sf_dir):
    return K.dominator_tree(P.sparse_calls(spark, sf_dir)).checkpoint()  # used twice


@query(f"WITH RECURSIVE {P.SPARSE}, {DOMINATED} SELECT id, coalesce(depth, 0) AS depth, coalesce(dominated, 0) AS dominated FROM live LEFT JOIN (SELECT v AS id, count(*) AS depth FROM dom GROUP BY v) USING (id) LEFT JOIN (SELECT d AS id, count(*) AS dominated FROM dom GROUP BY d) USING (id)")
def dominator_depth(spark, sf_dir):
    return PG.dominance(_idom(spark, sf_dir))


@query(f"""WITH RECURSIVE {P.SPARSE}, {DOMINATED}, over_ AS (SELECT d, v FROM dom UNION ALL SELECT id, id FROM live)
SELECT DISTINCT o.d AS id, e.dst AS frontier FROM over_ o JOIN sparse e ON o.v = e.src JOIN live l ON l.id = e.dst WHERE (o.d, e.dst) NOT IN (SELECT d, v FROM dom)""")
def dominance_frontier(spark, sf_dir):
    return PG.dominance_frontier(_idom(spark, sf_dir), P.sparse_calls(spark, sf_dir))


CHANGED = "path IN ('src/p1/m1.py', 'src/p2/m2.py')"


@query(f"""{WITH}, gone AS (SELECT id FROM nodes WHERE {CHANGED}), n2 AS (SELECT * FROM nodes WHERE id NOT IN (SELECT id FROM gone) UNION ALL SELECT * REPLACE (line_start + 1 AS line_start, complexity + 1 AS complexity) FROM nodes WHERE path = 'src/p1/m1.py' AND kind = 'function'),
e2 AS (SELECT * FROM edges WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone) UNION SELECT src, dst, kind FROM edges WHERE kind = 'CALLS' AND src IN (SELECT id FROM n2 WHERE path = 'src/p1/m1.py') AND dst IN (SELECT id FROM n2)
  UNION SELECT src, dst, kind FROM edges WHERE src NOT IN (SELECT id FROM gone) AND src IN (SELECT id FROM n2) AND dst IN (SELECT id FROM n2 WHERE path = 'src/p1/m1.py'))
SELECT 'nodes' AS what, count(*) AS n, sum(line_start)::BIGINT AS total FROM n2 UNION ALL SELECT concat('edges ', kind), count(*), sum(src + dst)::BIGINT FROM (SELECT DISTINCT * FROM e2) GROUP BY kind""")
def graph_patch(spark, sf_dir):
    """Two files change: the functions of one come back a line further down, the other is gone."""
    g = _graph(spark, sf_dir)
    changed = spark.createDataFrame([("src/p1/m1.py",), ("src/p2/m2.py",)], "path string")
    again = g.nodes.where("path = 'src/p1/m1.py' and kind = 'function'").withColumns({"line_start": F.col("line_start") + 1, "complexity": F.col("complexity") + 1})
    own = g.edges.where("kind = 'CALLS'").join(again.select(F.col("id").alias("src")), "src", "left_semi").select("src", "dst", "kind")
    p = g.patched(changed, again, own)
    n = p.nodes.agg(F.lit("nodes").alias("what"), F.count(F.lit(1)).alias("n"), F.sum("line_start").cast("long").alias("total"))
    return n.union(p.edges.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("src") + F.col("dst")).cast("long").alias("total")).select(F.concat(F.lit("edges "), "kind"), "n", "total"))


OVERLAY = f"""{S.COMMITS}, decayed AS (SELECT *, exp(-ln(2) * age_days / 90.0) AS decay FROM commit_files), counted AS (SELECT * FROM decayed WHERE decay >= 0.001 QUALIFY count(*) OVER (PARTITION BY hash) <= 30),
pairs AS (SELECT x.file AS a, y.file AS b, sum(x.decay) AS weight FROM counted x JOIN counted y ON x.hash = y.hash AND x.file < y.file GROUP BY x.file, y.file HAVING sum(x.decay) >= 0.3)"""


@query(f"""WITH RECURSIVE {S.GRAPH.replace(P.SPARSE, P.SPARSE)}, {OVERLAY}, imp AS (SELECT DISTINCT src, dst FROM sparse WHERE src % 2 = 0 UNION SELECT dst, src FROM sparse WHERE src % 5 = 0),
base AS (SELECT src, dst, sum(w) AS base FROM (SELECT DISTINCT src, dst, 1.0::DOUBLE AS w FROM sparse UNION ALL SELECT src, dst, 0.5 FROM imp) GROUP BY src, dst)
SELECT src, dst, round(base + least(coalesce(weight, 0), 2.0), 6) AS w FROM base JOIN fn p ON src = p.id JOIN fn q ON dst = q.id LEFT JOIN pairs ON a = least(p.path, q.path) AND b = greatest(p.path, q.path)""")
def overlay_of_calls_and_imports(spark, sf_dir):
    from ..operators import temporal as T

    e = P.sparse_calls(spark, sf_dir)
    imp = e.where("src % 2 = 0").union(e.where("src % 5 = 0").select("dst", "src")).distinct()
    pairs = T.pairs(T.analysed(S.commits(spark, sf_dir)), 0.3)
    return rounded(PG.full_overlay(e, imp, S.functions(spark, sf_dir), pairs), "w")


@query(f"""WITH {S.LINES}, f AS (SELECT DISTINCT CASE WHEN regexp_matches(path, 'm[0-9]*0\\.py$') THEN regexp_replace(path, '[^/]+$', '__init__.py') ELSE path END AS path FROM marked),
k AS (SELECT path, regexp_extract(path, '^(.*)/', 1) AS folder, regexp_extract(path, '([^/]+)$', 1) AS base FROM f)
SELECT DISTINCT least(h.path, k.path) AS a, greatest(h.path, k.path) AS b FROM k h JOIN k USING (folder) WHERE h.base = '__init__.py' AND h.path <> k.path""")
def aggregator_links(spark, sf_dir):
    """Siblings of aggregator files; a file whose number ends in 0 stands for its folder's."""
    f = S.files(spark, sf_dir).select(F.when(F.col("path").rlike(r"m[0-9]*0\.py$"), F.regexp_replace("path", "[^/]+$", "__init__.py")).otherwise(F.col("path")).alias("path"))
    return PG.aggregator_links(f)


METRICS = f"""m AS (SELECT id, regexp_extract(path, '^(.*)/', 1) AS m FROM fn), c AS (SELECT count(*) AS calls, sum((a.m <> b.m)::INT) AS crossing FROM sparse JOIN m a ON src = a.id JOIN m b ON dst = b.id),
fe AS (SELECT src, dst FROM edges WHERE kind = 'IMPORTS'), reach AS (SELECT src AS a, dst AS b FROM fe UNION SELECT a, dst FROM reach JOIN fe ON src = b),
cyc AS (SELECT count(DISTINCT low) AS cycles FROM (SELECT x.a, min(x.b) AS low FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY x.a)),
pm AS (SELECT (SELECT count(DISTINCT m) FROM m) AS modules, crossing / calls AS coupling, 1 - crossing / calls AS cohesion, cycles, (SELECT avg((complexity <= 10)::INT) FROM fn) AS simple_ratio,
  (SELECT avg(regexp_matches(path, '^tests/')::INT) FROM nodes WHERE kind = 'file') AS test_ratio, (SELECT count(*) FROM fn) AS total_functions, (SELECT count(*) FROM nodes WHERE kind = 'file') AS total_files, (SELECT sum(line_end)::BIGINT FROM nodes WHERE kind = 'file') AS total_loc FROM c, cyc)"""
MOST = {"modularity": 10.0, "cohesion": 5.0, "clean_deps": 10.0, "complexity": 5.0, "tests": 5.0}


@query(f"""{WITH}, {METRICS} SELECT modules, round(coupling, 6) AS coupling, round(cohesion, 6) AS cohesion, cycles, round(simple_ratio, 6) AS simple_ratio, round(test_ratio, 6) AS test_ratio, total_functions, total_files, total_loc,
round(10.0 * (1 - greatest(0, least(1, (coupling - 0.3) / 0.4))), 6) AS modularity_bonus, round(5.0 * greatest(0, least(1, (cohesion - 0.3) / 0.4)), 6) AS cohesion_bonus, round(10.0 * (1 - least(1, cycles * 0.2)), 6) AS clean_deps_bonus,
round(5.0 * greatest(0, least(1, (simple_ratio - 0.5) / 0.4)), 6) AS complexity_bonus, round(5.0 * least(1, test_ratio / 0.2), 6) AS tests_bonus FROM pm""")
def project_metrics(spark, sf_dir):
    g = _graph(spark, sf_dir)
    files = g.of_kind("file").select("path", F.col("line_end").alias("loc"), code.is_test(F.col("path")).alias("test"))
    cycles = G.strong_components(g.near("IMPORTS").toDF("src", "dst")).select("component").distinct().count()
    m = PG.bonuses(PG.project_metrics(g.of_kind("function"), files, g.near("CALLS").toDF("src", "dst"), cycles), MOST)
    return rounded(m, "coupling", "cohesion", "simple_ratio", "test_ratio", *(f"{k}_bonus" for k in MOST))


@query(f"""WITH {S.FUNCTIONS} SELECT id, name, CASE WHEN len(decorators) > 0 THEN 'decorated' WHEN NOT starts_with(name, '_') THEN 'public' ELSE 'private' END AS visibility, u.d AS decorator
FROM fn, (SELECT id AS of_id, unnest(CASE WHEN len(decorators) = 0 THEN [NULL] ELSE decorators END) AS d FROM fn) u WHERE u.of_id = id AND NOT (starts_with(name, '_') AND len(decorators) = 0)""")
def public_api(spark, sf_dir):
    """Functions that others may call: public by name or exported by a decorator, one row a decorator."""
    f = S.functions(spark, sf_dir).select("id", "name", "decorators", F.explode_outer("decorators").alias("decorator"))
    decorated = F.size("decorators") > 0
    see = F.when(decorated, "decorated").when(~F.col("name").startswith("_"), "public").otherwise("private")
    return f.where(decorated | ~F.col("name").startswith("_")).select("id", "name", see.alias("visibility"), "decorator")


@query(f"""WITH {S.FUNCTIONS}, k AS (SELECT concat(path, ':', 'complexity:', cast(id AS string)) AS key, complexity::DOUBLE AS value FROM fn UNION ALL SELECT concat(path, ':loc:', cast(id AS string)), (line_end - line_start + 1)::DOUBLE FROM fn)
SELECT * FROM k WHERE starts_with(key, 'src/p1/') OR key = 'src/p2/m2.py:loc:2'""")
def metrics_cache(spark, sf_dir):
    """Cached metrics by key, and all whose key begins so."""
    f = S.functions(spark, sf_dir)
    key = lambda k: F.concat_ws(":", "path", F.lit(k), F.col("id").cast("string")).alias("key")
    k = f.select(key("complexity"), F.col("complexity").cast("double").alias("value")).union(f.select(key("loc"), F.expr("line_end - line_start + 1").cast("double")))
    return k.where(F.col("key").startswith("src/p1/") | (F.col("key") == "src/p2/m2.py:loc:2"))


# values


@query(r"""WITH t AS (SELECT p_partkey AS id, CASE p_partkey % 9 WHEN 0 THEN concat('"', p_name, '"') WHEN 1 THEN concat('f''', p_brand, '\n''') WHEN 2 THEN concat('"a\"', p_type, '"') WHEN 3 THEN concat(p_size, '_000u64') WHEN 4 THEN concat('-', p_size, 'L')
  WHEN 5 THEN concat(p_size, '.5f32') WHEN 6 THEN concat(p_size, '.25') WHEN 7 THEN 'name_' || p_size ELSE '"x\\n"' END AS literal FROM part)
SELECT id, CASE id % 9 WHEN 0 THEN substring(literal, 2, len(literal) - 2) WHEN 1 THEN concat(substring(literal, 3, len(literal) - 5), chr(10)) WHEN 2 THEN concat('a"', substring(literal, 5, len(literal) - 5)) WHEN 8 THEN 'x\n' END AS text,
  CASE id % 9 WHEN 3 THEN replace(replace(literal, '_', ''), 'u64', '')::BIGINT WHEN 4 THEN replace(literal, 'L', '')::BIGINT END AS whole, CASE id % 9 WHEN 5 THEN replace(literal, 'f32', '')::DOUBLE WHEN 6 THEN literal::DOUBLE END AS fraction FROM t""")
def literal_values(spark, sf_dir):
    size, rest = F.col("p_size").cast("string"), F.col("p_partkey") % 9
    forms = {0: F.concat(F.lit('"'), "p_name", F.lit('"')), 1: F.concat(F.lit("f'"), "p_brand", F.lit("\\n'")), 2: F.concat(F.lit('"a\\"'), "p_type", F.lit('"')), 3: F.concat(size, F.lit("_000u64")), 4: F.concat(F.lit("-"), size, F.lit("L")), 5: F.concat(size, F.lit(".5f32")), 6: F.concat(size, F.lit(".25")), 7: F.concat(F.lit("name_"), size), 8: F.lit('"x\\\\n"')}
    literal = F.lit(None)
    for k, v in forms.items():
        literal = F.when(rest == k, v).otherwise(literal)
    t = P.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), literal.alias("l"))
    return t.select("id", V.unquoted(F.col("l")).alias("text"), V.integer(F.col("l")).alias("whole"), V.decimal(F.col("l")).alias("fraction"))


OPS = ["+", "-", "*", "/", "%", "==", "!=", "<", ">", "<=", ">="]


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, (['+', '-', '*', '/', '%', '==', '!=', '<', '>', '<=', '>='])[l_orderkey % 11 + 1] AS op, (l_partkey - 50)::BIGINT AS a, (l_linenumber - 3)::BIGINT AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, op, a, b, CASE op WHEN '+' THEN (a + b)::VARCHAR WHEN '-' THEN (a - b)::VARCHAR WHEN '*' THEN (a * b)::VARCHAR WHEN '/' THEN CASE WHEN b <> 0 THEN (sign(a) * sign(b) * (abs(a) // abs(b)))::BIGINT::VARCHAR END WHEN '%' THEN CASE WHEN b <> 0 THEN (a - b * (sign(a) * sign(b) * (abs(a) // abs(b))))::BIGINT::VARCHAR END
  WHEN '==' THEN (a = b)::VARCHAR WHEN '!=' THEN (a <> b)::VARCHAR WHEN '<' THEN (a < b)::VARCHAR WHEN '>' THEN (a > b)::VARCHAR WHEN '<=' THEN (a <= b)::VARCHAR ELSE (a >= b)::VARCHAR END AS value FROM t""")
def constant_folding(spark, sf_dir):
    op = F.element_at(F.array(*map(F.lit, OPS)), (F.col("l_orderkey") % 11 + 1).cast("int"))
    t = P.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", op.alias("op"), (F.col("l_partkey") - 50).cast("long").alias("a"), (F.col("l_linenumber") - 3).cast("long").alias("b"))
    return t.withColumn("value", V.fold(F.col("op"), F.col("a"), F.col("b")))


@query("""WITH RECURSIVE c AS (SELECT p_partkey AS name, CASE WHEN p_partkey % 5 = 0 THEN p_brand END AS literal, CASE WHEN p_partkey % 5 <> 0 THEN CASE WHEN p_partkey % 97 = 1 THEN p_partkey ELSE p_partkey - p_partkey % 3 - 1 END END AS refers_to FROM part),
r AS (SELECT name, literal AS value, 0::BIGINT AS hops FROM c WHERE literal IS NOT NULL UNION ALL SELECT c.name, value, hops + 1 FROM r JOIN c ON refers_to = r.name WHERE hops < 16)
SELECT * FROM r""")
def constant_propagation(spark, sf_dir):
    k = F.col("p_partkey")
    c = P.table(spark, sf_dir, "part").select(k.alias("name"), F.when(k % 5 == 0, F.col("p_brand")).alias("literal"), F.when(k % 5 != 0, F.when(k % 97 == 1, k).otherwise(k - k % 3 - 1)).alias("refers_to"))
    return V.resolved(c)


@query(f"WITH {P.FINDINGS} SELECT id, lower(trim(coalesce(nullif(split_part(title, ':', 2), ''), split_part(title, ':', 1)))) AS symbol FROM findings")
def title_symbols(spark, sf_dir):
    return P.findings(spark, sf_dir).select("id", V.symbol(F.col("title")).alias("symbol"))


@query(f"""WITH {S.FUNCTIONS}, {P.CALLS}, d AS (SELECT id, (SELECT count(*) FROM calls WHERE dst = fn.id) AS i, (SELECT count(*) FROM calls WHERE src = fn.id) AS o FROM fn)
SELECT id, CASE WHEN i + o >= 60 THEN 1.2 WHEN i >= 30 THEN 0.5 WHEN o <= 20 THEN 0.7 WHEN id % 10 = 9 THEN 0.3 ELSE 1.0 END::DOUBLE AS multiplier FROM d""")
def severity_multipliers(spark, sf_dir):
    d = G.fan_in_out(S.functions(spark, sf_dir).select("id"), P.calls(spark, sf_dir))
    i, o = F.col("fan_in"), F.col("fan_out")
    role = F.when(i + o >= 60, "Hub").when(i >= 30, "Utility").when(o <= 20, "Leaf").when(F.col("id") % 10 == 9, "Test").otherwise("Unknown")
    return d.select("id", V.severity_multiplier(role).alias("multiplier"))


@query(f"WITH {S.FUNCTIONS} SELECT path, k AS name, v AS value FROM (SELECT path, max(complexity)::DOUBLE AS c, avg(line_end - line_start + 1)::DOUBLE AS l FROM fn GROUP BY path), LATERAL (SELECT unnest(['complexity', 'loc']) AS k, unnest([c, round(l, 6)]) AS v)")
def threshold_metadata(spark, sf_dir):
    g = S.functions(spark, sf_dir).groupBy("path").agg(F.max("complexity").cast("double").alias("c"), F.avg(F.expr("line_end - line_start + 1")).alias("l"))
    return g.select("path", F.explode(V.thresholds(["complexity", "loc"], [F.col("c"), F.round("l", 6)])).alias("name", "value"))
