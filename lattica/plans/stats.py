"""Profiles, thresholds, surprise and roles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import rules as R
from ..operators import stats as S
from ..sources import projection as P
from .graph import DEGREE
from .registry import query, rounded

WITH = f"WITH {P.NODES}, {P.CALLS}, {DEGREE}"
VALUES = f"{WITH}, vals AS (SELECT 'complexity' AS metric, complexity::DOUBLE AS value FROM nodes UNION ALL SELECT 'loc', loc FROM nodes UNION ALL SELECT 'fan_in', fan_in FROM degree)"
PROFILE = f"""{VALUES}, r AS (SELECT metric, list_sort(list(value)) AS v, avg(value) AS mean, stddev_pop(value) AS sd, count(*) AS n FROM vals GROUP BY metric),
profile AS (SELECT metric, n, mean, sd, v[floor(0.5 * (n - 1) + 0.5)::INT + 1] AS p50, v[floor(0.75 * (n - 1) + 0.5)::INT + 1] AS p75, v[floor(0.9 * (n - 1) + 0.5)::INT + 1] AS p90, v[floor(0.95 * (n - 1) + 0.5)::INT + 1] AS p95, v[n] AS max FROM r)"""


def _values(spark, sf_dir):
    n = P.nodes(spark, sf_dir)
    d = G.fan_in_out(n, P.calls(spark, sf_dir))
    parts = [n.select(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in ("complexity", "loc")]
    return reduce(lambda a, b: a.union(b), [*parts, d.select(F.lit("fan_in"), F.col("fan_in").cast("double"))])


@query(f"{PROFILE} SELECT metric, n, round(mean, 4) AS mean, round(sd, 4) AS stddev, p50, p75, p90, p95, max FROM profile")
def distribution_profile(spark, sf_dir):
    return rounded(S.distribution(_values(spark, sf_dir)), "mean", "stddev", digits=4)


@query(f"""{PROFILE}, t AS (SELECT metric, CASE WHEN n >= 40 THEN greatest(10.0, p90) ELSE 10.0 END AS warn, CASE WHEN n >= 40 THEN greatest(20.0, p95) ELSE 20.0 END AS high FROM profile)
SELECT metric, count(*) AS outliers, sum((value > high)::INT)::BIGINT AS severe FROM vals JOIN t USING (metric) WHERE value > warn GROUP BY metric""")
def adaptive_threshold_outliers(spark, sf_dir):
    v = _values(spark, sf_dir)
    t = S.adaptive_threshold(S.distribution(v), 10.0, 20.0)
    return v.join(F.broadcast(t), "metric").where("value > warn").groupBy("metric").agg(F.count(F.lit(1)).alias("outliers"), F.sum((F.col("value") > F.col("high")).cast("long")).alias("severe"))


@query("""WITH d AS (SELECT event_type, date_trunc('day', ts)::DATE AS day, count(*)::DOUBLE AS n FROM events GROUP BY ALL), m AS (SELECT event_type, avg(n) AS mu, stddev_pop(n) AS sd FROM d GROUP BY 1)
SELECT event_type, day::VARCHAR AS day, n, round(CASE WHEN sd > 0 THEN (n - mu) / sd ELSE 0 END, 6) AS z FROM d JOIN m USING (event_type) WHERE sd > 0 AND abs((n - mu) / sd) >= 1.5""")
def zscore_spikes(spark, sf_dir):
    d = P.table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    z = S.z_scores(d, "n", ["event_type"]).where("abs(z) >= 1.5")
    return rounded(z.select("event_type", F.col("day").cast("string").alias("day"), "n", "z"), "z")


@query("""WITH m AS (SELECT avg(p_size) AS mx, avg(p_retailprice) AS my, var_pop(p_size) + 1e-6 AS a, var_pop(p_retailprice) + 1e-6 AS d, covar_pop(p_size, p_retailprice) AS b FROM part)
SELECT p_partkey AS id, round(sqrt(greatest(0, (d * (p_size - mx) * (p_size - mx) - 2 * b * (p_size - mx) * (p_retailprice - my) + a * (p_retailprice - my) * (p_retailprice - my)) / (a * d - b * b))), 5) AS distance FROM part, m""")
def mahalanobis(spark, sf_dir):
    p = P.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_size", "p_retailprice")
    return rounded(S.mahalanobis(p, "p_size", "p_retailprice").select("id", "distance"), "distance", digits=5)


@query(f"""{WITH}, i AS (SELECT 1 / var_pop(complexity) AS a, 1 / var_pop(loc) AS b, 1 / var_pop(params) AS c FROM nodes)
SELECT 'complexity' AS signal, round(a / (a + b + c), 8) AS weight FROM i UNION ALL SELECT 'loc', round(b / (a + b + c), 8) FROM i UNION ALL SELECT 'params', round(c / (a + b + c), 8) FROM i""")
def precision_weights(spark, sf_dir):
    return rounded(S.precision_weights(P.nodes(spark, sf_dir), ["complexity", "loc", "params"]), "weight", digits=8)


@query(f"""{WITH}, s AS (SELECT id, complexity::DOUBLE AS x, fan_in::DOUBLE AS y, fan_out::DOUBLE AS w FROM nodes JOIN degree USING (id)), m AS (SELECT avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, stddev_pop(y) AS sy, avg(w) AS mw, stddev_pop(w) AS sw FROM s),
z AS (SELECT id, (x - mx) / sx AS zx, (y - my) / sy AS zy, (w - mw) / sw AS zw FROM s, m)
SELECT id, ((zx >= 1.5)::INT + (zy >= 1.5)::INT + (zw >= 1.5)::INT)::BIGINT AS concordance, round((zx + zy + zw) / 3, 5) AS surprise FROM z WHERE (zx >= 1.5)::INT + (zy >= 1.5)::INT + (zw >= 1.5)::INT >= 1""")
def compound_surprise(spark, sf_dir):
    n = P.nodes(spark, sf_dir)
    s = n.select("id", "complexity").join(G.fan_in_out(n, P.calls(spark, sf_dir)), "id")
    for c, z in (("complexity", "zx"), ("fan_in", "zy"), ("fan_out", "zw")):
        s = S.z_scores(s, c).withColumnRenamed("z", z)
    hits = sum(((F.col(z) >= 1.5).cast("long") for z in ("zx", "zy", "zw")), F.lit(0))
    return rounded(s.select("id", hits.cast("long").alias("concordance"), ((F.col("zx") + F.col("zy") + F.col("zw")) / 3).alias("surprise")).where("concordance >= 1"), "surprise", digits=5)


@query(f"""{WITH}, s AS (SELECT dst AS id, count(DISTINCT module) AS spread FROM calls JOIN nodes n ON src = n.id GROUP BY dst)
SELECT id, CASE WHEN id % 97 = 0 THEN 'Test' WHEN fan_in + fan_out >= 60 THEN 'Hub' WHEN fan_in >= 10 AND module = 'SMALL' OR coalesce(spread, 0) >= 6 AND fan_in >= 24 THEN 'Utility' WHEN exported AND fan_in <= 20 THEN 'EntryPoint' WHEN fan_out >= 24 THEN 'Orchestrator' WHEN fan_in <= 18 AND fan_out <= 18 THEN 'Leaf' ELSE 'Unknown' END AS role
FROM nodes JOIN degree USING (id) LEFT JOIN s USING (id)""")
def role_inference(spark, sf_dir):
    n, e = P.nodes(spark, sf_dir), P.calls(spark, sf_dir)
    j = n.join(G.fan_in_out(n, e), "id").join(G.caller_spread(n, e, "module"), "id", "left")
    i, o, s = F.col("fan_in"), F.col("fan_out"), F.coalesce("spread", F.lit(0))
    role = F.when(F.col("id") % 97 == 0, "Test").when(i + o >= 60, "Hub").when(((i >= 10) & (F.col("module") == "SMALL")) | ((s >= 6) & (i >= 24)), "Utility").when(F.col("exported") & (i <= 20), "EntryPoint").when(o >= 24, "Orchestrator").when((i <= 18) & (o <= 18), "Leaf").otherwise("Unknown")
    return j.select("id", role.alias("role"))


@query(f"""{WITH}, a AS (SELECT id, floor((row_number() OVER (ORDER BY fan_in, id) - 1) * 100 / count(*) OVER ())::BIGINT AS p, floor((row_number() OVER (ORDER BY complexity, id) - 1) * 100 / count(*) OVER ())::BIGINT AS q FROM nodes JOIN degree USING (id))
SELECT id, p, q, p - q AS drift FROM a WHERE abs(p - q) >= 60""")
def rank_drift(spark, sf_dir):
    n = P.nodes(spark, sf_dir)
    j = n.select("id", "complexity").join(G.fan_in_out(n, P.calls(spark, sf_dir)), "id")
    j = S.percentile_bucket(S.percentile_bucket(j, "fan_in", "p"), "complexity", "q")
    return j.select("id", "p", "q", (F.col("p") - F.col("q")).alias("drift")).where("abs(drift) >= 60")


@query("""SELECT c_custkey AS id, round(CASE WHEN x <= 1000 THEN x / 1000 * 25 WHEN x <= 3000 THEN 25 + (x - 1000) / 2000 * 25 WHEN x <= 6000 THEN 50 + (x - 3000) / 3000 * 25 WHEN x <= 9000 THEN 75 + (x - 6000) / 3000 * 15 ELSE least(99, 90 + (x - 9000) / 9000 * 10) END, 6) AS percentile
FROM (SELECT c_custkey, greatest(c_acctbal, 0) AS x FROM customer)""")
def percentile_interpolation(spark, sf_dir):
    c = P.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.greatest("c_acctbal", F.lit(0.0)).alias("x"))
    p = S.interpolated_percentile(F.col("x"), *(F.lit(v) for v in (1000.0, 3000.0, 6000.0, 9000.0)))
    return rounded(c.select("id", p.alias("percentile")), "percentile")


TOKENS = r"[a-z]+|[0-9]+|[^a-z0-9\s]"


@query(rf"""WITH {P.LINES}, tok AS (SELECT doc_id, line_no, [CASE WHEN regexp_full_match(t, '[0-9]+') THEN '<n>' WHEN len(t) > 3 THEN '<w>' ELSE t END FOR t IN regexp_extract_all(lower(line), '{TOKENS}')] AS tokens FROM lines),
flat AS (SELECT doc_id, line_no, tokens[i] AS t, tokens[i - 1] AS p1, tokens[i - 2] AS p2, i FROM tok, unnest(range(1, len(tokens) + 1)) AS u(i)),
w AS (SELECT count(*) AS total, count(DISTINCT t) AS v FROM flat), c3 AS (SELECT p2, p1, t, count(*) AS c3 FROM flat WHERE i >= 3 GROUP BY ALL), c2 AS (SELECT p2, p1, sum(c3) AS c2 FROM c3 GROUP BY ALL),
s AS (SELECT doc_id, line_no, avg(-log2((c3 + 0.1) / (c2 + 0.1 * v))) AS bits FROM flat JOIN c3 USING (p2, p1, t) JOIN c2 USING (p2, p1), w WHERE i >= 3 GROUP BY ALL)
SELECT doc_id, line_no, round(coalesce(CASE WHEN total >= 5000 THEN bits END, 0), 5) AS bits FROM tok LEFT JOIN s USING (doc_id, line_no), w""")
def trigram_surprisal(spark, sf_dir):
    t = F.regexp_extract_all(F.lower("line"), F.lit(TOKENS), F.lit(0))
    t = F.transform(t, lambda x: F.when(x.rlike("^[0-9]+$"), "<n>").when(F.length(x) > 3, "<w>").otherwise(x))
    s = S.trigram_surprisal(P.lines(spark, sf_dir).select("doc_id", "line_no", t.alias("tokens")))
    return rounded(s.select("doc_id", "line_no", F.coalesce("bits", F.lit(0.0)).alias("bits")), "bits", digits=5)


RULES = [
    R.Rule("mail-address", r"[a-z0-9.]+@[a-z0-9.]+\.[a-z]{2,}", "@", 3),
    R.Rule("hex-secret", r"token = \"[0-9a-f]{20,}", "token", 4),
    R.Rule("ip-address", r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b", ".", 2),
    R.Rule("phone", r"\+[0-9]+ \([0-9]{3}\) [0-9]{3}-[0-9]{4}", "(", 2),
    R.Rule("license", r"(?i)licensed? under|mit license", "licen", 1),
]


def _line_rules_sql():
    parts = [f"SELECT doc_id, line_no, '{r.name}' AS rule, {r.severity}::BIGINT AS severity FROM lines WHERE contains(lower(line), '{r.hint}') AND regexp_matches(line, '{r.pattern}')" for r in RULES]
    return f"WITH {P.LINES} " + " UNION ALL ".join(parts)


@query(_line_rules_sql())
def line_rules(spark, sf_dir):
    return R.apply(P.lines(spark, sf_dir), RULES)


@query(f"""WITH {P.LINES}, s AS (SELECT *, contains(lower(line), 'the and') OR coalesce(contains(lag(lower(line)) OVER (PARTITION BY doc_id ORDER BY line_no), 'the and'), FALSE)
 OR max(line_no <= 10 AND contains(lower(line), 'the and-file')) OVER (PARTITION BY doc_id) AS suppressed FROM lines) SELECT doc_id, line_no FROM s WHERE suppressed""")
def suppressed_lines(spark, sf_dir):
    return R.suppressed(P.lines(spark, sf_dir), "the and").where("suppressed").select("doc_id", "line_no")


@query(f"""WITH {P.LINES}, m AS (SELECT doc_id, line_no, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS g FROM lines WHERE regexp_matches(line, '\\.$'))
SELECT doc_id, min(line_no) AS first, max(line_no) AS last, count(*) AS n FROM m GROUP BY doc_id, g HAVING count(*) >= 5""")
def text_gaps_islands(spark, sf_dir):
    return R.runs(P.lines(spark, sf_dir), F.col("line").rlike(r"\.$")).select("doc_id", "first", "last", "n")


@query(f"""WITH {P.LINES}, d AS (SELECT doc_id, sum(len(replace(line, '.', '')) - len(replace(line, ',', ''))) OVER (PARTITION BY doc_id ORDER BY line_no) AS depth FROM lines)
SELECT doc_id, max(depth)::BIGINT AS deepest FROM d GROUP BY doc_id HAVING max(depth) <> 0""")
def bracket_depth(spark, sf_dir):
    return R.depth(P.lines(spark, sf_dir), ",", ".").groupBy("doc_id").agg(F.max("depth").alias("deepest")).where("deepest != 0")


@query(f"""WITH {P.LINES}, w AS (SELECT *, max(contains(line, '@')) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM lines)
SELECT doc_id, line_no FROM w WHERE near AND contains(line, 'token')""")
def nearby_lines(spark, sf_dir):
    rule = R.Rule("near", "token", near="@", window=2)
    return R.apply(P.lines(spark, sf_dir), [rule]).select("doc_id", "line_no")


@query()
def context_states(spark, sf_dir):
    """Decoded states of each user's events, a hidden Markov model fitted on severity bands."""
    from ..operators import sequence

    e = P.table(spark, sf_dir, "events").select("user_id", "event_id", F.log1p("value").alias("x"), (F.col("event_type") == "error").cast("double").alias("y"), F.when(F.col("value") >= 100, 2).when(F.col("value") >= 30, 1).otherwise(0).alias("state0"))
    return sequence.decode(e, sequence.fit(e, "state0", ["x", "y"], 3), "user_id", ["event_id"], ["x", "y"])


@query()
def project_bus_factor(spark, sf_dir):
    """Authors in the order of a greedy cover of half the brands' ownership."""
    from ..operators import kernels as K
    from ..operators import temporal as T

    owned = T.ownership(P.commit_files(spark, sf_dir, "brand")).where("norm > 0.9").select("file", F.col("author").cast("string").alias("author"))
    if owned.limit(K.MOST_EDGES + 1).count() > K.MOST_EDGES:
        raise K.TooLarge("too many owners for the greedy cover")
    lost = K.set_cover([(r["file"], r["author"]) for r in owned.collect()])
    return spark.createDataFrame([(i + 1, a) for i, a in enumerate(lost)], "step int, author string")
