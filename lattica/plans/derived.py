"""Queries of history, roles, flags, taint inside functions and summaries of runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import findings as O
from ..operators import flags as FL
from ..operators import graph as G
from ..operators import history as H
from ..operators import roles as R
from ..operators import taint
from ..operators import temporal as T
from ..sources import projection as P
from ..sources import sample_code as S
from .detect import OWN, _q
from .registry import query, rounded


@query(f"WITH {S.COMMITS} SELECT file, max_by(author, (ts, hash)) AS author, max(ts) AS last_modified, count(DISTINCT hash) AS commit_count FROM commit_files GROUP BY file")
def entity_enrichment(spark, sf_dir):
    return H.enriched(S.commits(spark, sf_dir))


@query(f"WITH {S.COMMITS} SELECT file, sum(hash % 40)::BIGINT AS insertions, sum(hash % 11)::BIGINT AS deletions, count(DISTINCT hash) AS commits, count(DISTINCT author) AS authors, max(ts) AS last_modified FROM commit_files GROUP BY file")
def file_churn(spark, sf_dir):
    return H.churn(S.commits(spark, sf_dir).withColumns({"insertions": F.col("hash") % 40, "deletions": F.col("hash") % 11}))


@query("""WITH b AS (SELECT l_partkey AS file, l_orderkey * 10 + l_linenumber AS line, o_custkey % 5 AS author FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT file, author, round(count(*) / sum(count(*)) OVER (PARTITION BY file), 6) AS share FROM b GROUP BY file, author""")
def blame_ownership(spark, sf_dir):
    li, o = P.table(spark, sf_dir, "lineitem"), P.table(spark, sf_dir, "orders")
    b = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_partkey").alias("file"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"), (F.col("o_custkey") % 5).alias("author"))
    return rounded(H.blame_ownership(b), "share")


@query(f"""{OWN}, w AS (SELECT regexp_extract(file, '^(.*)/', 1) AS module, author, round(sum(norm), 9) AS weight FROM owned GROUP BY 1, 2), r AS (SELECT module, row_number() OVER (PARTITION BY module ORDER BY weight DESC, author) AS rank, author, weight FROM w)
SELECT module, rank, author, round(weight, 5) AS weight FROM r WHERE rank <= 3""")
def module_top_authors(spark, sf_dir):
    owned = T.ownership(S.commits(spark, sf_dir))
    modules = owned.select("file", F.regexp_extract("file", "^(.*)/", 1).alias("module")).distinct()
    return rounded(H.top_authors(owned, modules), "weight", digits=5).withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH {P.FINDINGS}, c AS (SELECT 'f' || (o_custkey % 400)::VARCHAR AS file, CASE WHEN o_orderkey % 50 = 0 THEN 'Fix crash' ELSE 'Add part' END AS message, greatest(0.0, epoch(TIMESTAMP '{P.NOW}' - o_orderdate) / 86400.0) AS age_days FROM orders),
k AS (SELECT file, bool_or(message = 'Fix crash') AS fixed, min(age_days) AS last FROM c GROUP BY file)
SELECT id, fixed AS is_true_positive, CASE WHEN fixed THEN 0.7 ELSE 0.5 END::DOUBLE AS weight, CASE WHEN fixed THEN 'fix_commit' ELSE 'stable_code' END AS source FROM findings JOIN k USING (file) WHERE fixed OR last > 180""")
def weak_labels(spark, sf_dir):
    age = F.greatest(F.lit(0.0), (F.unix_timestamp(F.lit(P.NOW)) - F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))) / 86400.0)
    c = P.table(spark, sf_dir, "orders").select(F.concat(F.lit("f"), (F.col("o_custkey") % 400).cast("string")).alias("file"), F.when(F.col("o_orderkey") % 50 == 0, "Fix crash").otherwise("Add part").alias("message"), age.alias("age_days"))
    return H.weak_labels(P.findings(spark, sf_dir), c)


@query("""WITH k AS (SELECT concat('t', p_partkey) AS name, p_retailprice::DOUBLE AS value, CASE WHEN p_partkey % 6000 = 7 THEN 0.0 ELSE (p_size * 20)::DOUBLE END AS standard FROM part),
r AS (SELECT name, CASE WHEN standard > 0 THEN abs(value - standard) / standard WHEN value > 0 THEN 'inf'::DOUBLE ELSE 0 END AS ratio FROM k ORDER BY ratio DESC, name LIMIT 10) SELECT name, round(ratio, 6) AS ratio FROM r WHERE ratio > 0 AND ratio < 'inf'::DOUBLE""")
def calibration_outliers(spark, sf_dir):
    k = P.table(spark, sf_dir, "part").select(F.concat(F.lit("t"), F.col("p_partkey").cast("string")).alias("name"), F.col("p_retailprice").cast("double").alias("value"), F.when(F.col("p_partkey") % 6000 == 7, 0.0).otherwise((F.col("p_size") * 20).cast("double")).alias("standard"))
    return rounded(H.calibration_outliers(k), "ratio")


@query(f"WITH {P.FINDINGS} SELECT detector, severity, count(*) AS findings, sum((coalesce(confidence, 0) >= 0.5)::INT)::BIGINT AS likely, round(avg(coalesce(confidence, 0)), 6) AS mean FROM findings GROUP BY detector, severity")
def classification_summary(spark, sf_dir):
    c = F.coalesce("confidence", F.lit(0.0))
    return rounded(P.findings(spark, sf_dir).groupBy("detector", "severity").agg(F.count(F.lit(1)).alias("findings"), F.sum((c >= 0.5).cast("long")).alias("likely"), F.avg(c).alias("mean")), "mean")


@query("SELECT event_type || '-' || (user_id % 7)::VARCHAR AS detector, round(sum(value), 4) AS ms, count(*) AS runs FROM events GROUP BY 1 ORDER BY ms DESC, detector LIMIT 10")
def slowest_detectors(spark, sf_dir):
    e = P.table(spark, sf_dir, "events").groupBy(F.concat_ws("-", "event_type", (F.col("user_id") % 7).cast("string")).alias("detector")).agg(F.round(F.sum("value"), 4).alias("ms"), F.count(F.lit(1)).alias("runs"))
    return e.orderBy(F.desc("ms"), "detector").limit(10)


@query(f"""WITH {P.FINDINGS}, d AS (SELECT file, count(*) AS n, sum(severity)::BIGINT AS debt FROM findings WHERE contains(file, '1') GROUP BY file) SELECT * FROM d ORDER BY debt DESC, file LIMIT 20""")
def debt_top(spark, sf_dir):
    d = P.findings(spark, sf_dir).where(F.col("file").contains("1")).groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.sum("severity").alias("debt"))
    return d.orderBy(F.desc("debt"), "file").limit(20)


CONTENT = f"{S.LINES}, f AS (SELECT path, language, string_agg(text, chr(10) ORDER BY line_no) AS content FROM marked GROUP BY path, language)"
BITS = " + ".join(f"CASE WHEN {' OR '.join(f'contains(content, {_q(w)})' for w in words)} THEN {FL.BIT[name]} ELSE 0 END" for name, words in FL.WORDS.items())


@query(f"WITH {CONTENT} SELECT path, regexp_extract(path, '\\.([A-Za-z]+)$', 1) AS extension, ({BITS})::INT AS flags FROM f")
def content_flags(spark, sf_dir):
    return FL.file_index(S.files(spark, sf_dir))


@query(f"WITH {CONTENT}, i AS (SELECT path, regexp_extract(path, '\\.([A-Za-z]+)$', 1) AS extension, ({BITS})::INT AS flags FROM f) SELECT * FROM i WHERE extension IN ('py', 'js') AND flags & {FL.BIT['exec'] | FL.BIT['eval']} <> 0")
def file_index_match(spark, sf_dir):
    return FL.matching(FL.file_index(S.files(spark, sf_dir)), ["py", "js"], "exec", "eval")


@query(f"""WITH {S.FUNCTIONS}, fd AS (SELECT event_id AS id, (['DegreeCentralityDetector', 'DeadCodeDetector', 'FeatureEnvyDetector', 'SecretDetector', 'UnreachableCodeDetector'])[event_id % 5 + 1] AS detector, user_id % {S.FILES} AS x, (event_id % 90 + 1)::INT AS line FROM events),
f2 AS (SELECT fd.*, concat({S.PATH}, cast(x AS string), '.py') AS file FROM fd),
placed AS (SELECT f2.id, detector, max_by(fn.id, (line_start, -line_end, fn.id)) AS fid FROM f2 JOIN fn ON fn.path = file AND line BETWEEN line_start AND line_end WHERE detector <> 'SecretDetector' GROUP BY f2.id, detector),
gone AS (SELECT id FROM placed WHERE (detector IN ('DegreeCentralityDetector', 'FeatureEnvyDetector') AND fid % 5 IN (0, 1, 2)) OR (detector IN ('DeadCodeDetector', 'UnreachableCodeDetector') AND fid % 5 IN (1, 2)))
SELECT id, detector, file, line FROM f2 WHERE id NOT IN (SELECT id FROM gone)""")
def context_filter(spark, sf_dir):
    names = ["DegreeCentralityDetector", "DeadCodeDetector", "FeatureEnvyDetector", "SecretDetector", "UnreachableCodeDetector"]
    e = P.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.element_at(F.array(*map(F.lit, names)), (F.col("event_id") % 5 + 1).cast("int")).alias("detector"), (F.col("user_id") % S.FILES).alias("x"), (F.col("event_id") % 90 + 1).cast("int").alias("line"))
    e = e.select("id", "detector", F.concat(F.expr(S.PATH), F.col("x").cast("string"), F.lit(".py")).alias("file"), "line")
    f = S.functions(spark, sf_dir)
    roles = f.select("id", F.element_at(F.array(*map(F.lit, ["Utility", "Handler", "Test", "Core", "Internal"])), (F.col("id") % 5 + 1).cast("int")).alias("context"))
    return R.without_excused(e, f, roles)


@query(f"""WITH RECURSIVE {S.GRAPH}, m AS (SELECT g.class_id AS id, k.name, count(*) AS methods, avg(g.complexity) AS c, avg((len(g.calls) = 1)::INT) AS delegates FROM g JOIN klass k ON g.class_id = k.id GROUP BY ALL),
x AS (SELECT src AS id, count(*) AS external FROM edges WHERE kind = 'USES' GROUP BY src), u AS (SELECT dst AS id, count(*) AS usages FROM edges WHERE kind = 'USES' GROUP BY dst),
r AS (SELECT id, CASE WHEN id % 11 = 0 THEN 'JobHandler' ELSE name END AS name, methods, c, delegates, coalesce(external, 0) AS external, coalesce(usages, 0) AS usages FROM m LEFT JOIN x USING (id) LEFT JOIN u USING (id)),
k AS (SELECT id, CASE WHEN name = 'JobHandler' THEN 'Orchestrator' WHEN methods >= 5 AND delegates >= 0.6 AND external >= 4 AND c <= 3 THEN 'Orchestrator' WHEN methods >= 10 AND c <= 3 AND delegates >= 0.6 THEN 'Facade' WHEN usages >= 5 AND methods >= 10 THEN 'EntryPoint'
  WHEN c <= 1.5 AND methods <= 20 THEN 'DataClass' WHEN methods <= 15 AND usages >= 3 THEN 'Utility' ELSE 'Application' END AS role FROM r)
SELECT id, role, CASE role WHEN 'Orchestrator' THEN 0.3 WHEN 'Facade' THEN 0.3 WHEN 'EntryPoint' THEN 0.5 WHEN 'Utility' THEN 0.7 WHEN 'DataClass' THEN 0.6 ELSE 1.0 END::DOUBLE AS multiplier FROM k""")
def class_roles(spark, sf_dir):
    g = S.property_graph(spark, sf_dir)
    f = S.functions(spark, sf_dir).select("id", "complexity", F.size("calls").alias("n"))
    member = g.near("CONTAINS").where("id between -99999 and -1 and other >= 0").toDF("class_id", "id")
    m = member.join(f, "id").groupBy("class_id").agg(F.count(F.lit(1)).alias("methods"), F.avg("complexity").alias("c"), F.avg((F.col("n") == 1).cast("int")).alias("delegates")).withColumnRenamed("class_id", "id")
    out = g.near("USES").groupBy("id").agg(F.count(F.lit(1)).alias("external"))
    back = g.near("USES", False).groupBy("id").agg(F.count(F.lit(1)).alias("usages"))
    j = g.of_kind("class").select("id", F.when(F.col("id") % 11 == 0, "JobHandler").otherwise(F.col("name")).alias("name")).join(m, "id").join(out, "id", "left").join(back, "id", "left")
    role = R.class_role(F.col("name"), F.col("methods"), F.col("c"), F.col("delegates"), F.coalesce("external", F.lit(0)), F.coalesce("usages", F.lit(0)))
    weight = F.create_map(*[F.lit(x) for kv in R.CLASS_SEVERITY.items() for x in kv])
    return j.select("id", role.alias("role")).select("id", "role", weight[F.col("role")].alias("multiplier"))


FEATURES = ["fan_in", "fan_out", "cohesion", "coupling", "entities", "smells"]


def profiles(spark, sf_dir):
    """module and its six features: mean degrees, internal and crossing share of edges, entities, and
    kinds of findings."""
    f = S.functions(spark, sf_dir).select("id", F.regexp_extract("path", "^(.*)/", 1).alias("module"), "complexity", "nesting")
    e = P.calls(spark, sf_dir)
    d = G.fan_in_out(f.select("id"), e).join(f, "id").groupBy("module").agg(F.avg("fan_in").alias("fan_in"), F.avg("fan_out").alias("fan_out"), F.count(F.lit(1)).alias("entities"), F.countDistinct(F.when(F.col("nesting") > 5, F.col("complexity"))).alias("smells"))
    m = f.select("id", "module")
    ends = e.join(m.toDF("src", "a"), "src").join(m.toDF("dst", "b"), "dst")
    part = ends.select(F.col("a").alias("module"), (F.col("a") == F.col("b")).cast("int").alias("inner")).union(ends.where("a != b").select("b", F.lit(0)))
    return d.join(part.groupBy("module").agg(F.avg("inner").alias("cohesion")), "module").withColumn("coupling", 1 - F.col("cohesion"))


@query(f"""WITH {S.FUNCTIONS}, {P.CALLS}, f AS (SELECT id, regexp_extract(path, '^(.*)/', 1) AS module, complexity, nesting FROM fn), i AS (SELECT dst AS id, count(*) AS n FROM calls GROUP BY dst), o AS (SELECT src AS id, count(*) AS n FROM calls GROUP BY src),
d AS (SELECT module, avg(coalesce(i.n, 0)) AS fan_in, avg(coalesce(o.n, 0)) AS fan_out, count(*) AS entities, count(DISTINCT CASE WHEN nesting > 5 THEN complexity END) AS smells FROM f LEFT JOIN i USING (id) LEFT JOIN o USING (id) GROUP BY module),
ends AS (SELECT a.module AS a, b.module AS b FROM calls JOIN f a ON src = a.id JOIN f b ON dst = b.id), part AS (SELECT a AS module, (a = b)::INT AS within FROM ends UNION ALL SELECT b, 0 FROM ends WHERE a <> b), c AS (SELECT module, avg(within) AS cohesion FROM part GROUP BY module)
SELECT module, round(fan_in, 6) AS fan_in, round(fan_out, 6) AS fan_out, entities, smells, round(cohesion, 6) AS cohesion, round(1 - cohesion, 6) AS coupling FROM d JOIN c USING (module)""")
def module_profiles(spark, sf_dir):
    return rounded(profiles(spark, sf_dir), "fan_in", "fan_out", "cohesion", "coupling")


@query()
def module_profile_distance(spark, sf_dir):
    return rounded(R.module_distance(profiles(spark, sf_dir), FEATURES), "distance")


def _bodies(spark, sf_dir):
    """Runs of 12 lines of a file stand for its functions."""
    from ..sources import code

    ln = code.lines(S.files(spark, sf_dir)).where("not suppressed")
    return ln.select("path", F.concat_ws("::", "path", F.floor((F.col("line_no") - 1) / 12).cast("string")).alias("function"), "line_no", "text")


@query()
def taint_intra(spark, sf_dir):
    return taint.central(S.files(spark, sf_dir), _bodies(spark, sf_dir))


@query(f"WITH {CONTENT} " + " UNION ALL ".join(f"SELECT path, '{c}' AS category, '{k.cwe}' AS cwe_id FROM f WHERE regexp_extract(path, '\\.([A-Za-z]+)$', 1) IN ({', '.join(map(_q, k.extensions))}) AND ({' OR '.join(f'contains(content, {_q(w)})' for w in k.quick)})" for c, k in taint.CATEGORIES.items()))
def taint_relevant_files(spark, sf_dir):
    files, out = S.files(spark, sf_dir), None
    for c, k in taint.CATEGORIES.items():
        part = taint.relevant(files, c).select("path", F.lit(c).alias("category"), F.lit(k.cwe).alias("cwe_id"))
        out = part if out is None else out.union(part)
    return out


@query(f"""WITH {P.FINDINGS}, s AS (SELECT *, lower(trim(split_part(title, ':', 2))) AS symbol FROM findings), w AS (SELECT DISTINCT file, line, symbol FROM s WHERE detector = 'click')
SELECT id, detector, file, line FROM s WHERE NOT (detector = 'view' AND (file, line, symbol) IN (SELECT * FROM w))""")
def dead_code_overlap_symbol(spark, sf_dir):
    """As `dead_code_overlap`, of findings about the same symbol only."""
    from ..operators import values as V

    f = P.findings(spark, sf_dir).withColumn("symbol", V.symbol(F.col("title")))
    return O.without_overlap(f, "view", "click", "symbol").select("id", "detector", "file", "line")


@query(f"""WITH {S.FUNCTIONS}, a AS (SELECT id, name, path FROM fn WHERE id % 3 <> 0), b AS (SELECT id, name, path FROM fn WHERE id % 3 = 0 OR id % 7 = 0)
SELECT path, count(*) AS functions, count(DISTINCT name) AS names FROM (SELECT * FROM a UNION SELECT * FROM b) GROUP BY path""")
def merged_parse_results(spark, sf_dir):
    """Results of two parse runs as one, an entity that both hold once."""
    f = S.functions(spark, sf_dir).select("id", "name", "path")
    both = f.where("id % 3 != 0").union(f.where("id % 3 = 0 or id % 7 = 0")).distinct()
    return both.groupBy("path").agg(F.count(F.lit(1)).alias("functions"), F.countDistinct("name").alias("names"))


@query(f"""WITH {S.FUNCTIONS}, s AS (SELECT id, [CASE WHEN (id * 7 + i * 13) % 5 < 4 THEN (id % 20) * 1000 + i ELSE id * 1000 + i END FOR i IN range(0, 100)] AS sig FROM fn WHERE id < 400),
p AS (SELECT a.id AS a, b.id AS b, len([i FOR i IN range(1, 101) IF a.sig[i] = b.sig[i]]) AS k FROM s a JOIN s b ON a.id % 20 = b.id % 20 AND a.id < b.id) SELECT a, b, k / 100 AS estimate FROM p""")
def estimated_jaccard(spark, sf_dir):
    """Matching places of two signatures of 100 minima over 100; signatures made up for the purpose."""
    from ..operators import similarity as SM

    s = S.functions(spark, sf_dir).where("id < 400").selectExpr("id", "transform(sequence(0L, 99L), i -> CASE WHEN (id * 7 + i * 13) % 5 < 4 THEN (id % 20) * 1000 + i ELSE id * 1000 + i END) AS sig")
    j = s.toDF("a", "x").join(s.toDF("b", "y"), (F.col("a") % 20 == F.col("b") % 20) & (F.col("a") < F.col("b")))
    return j.select("a", "b", SM.estimated_jaccard("x", "y").alias("estimate"))
