"""Joins, set operations, pagination, voting and scoring over findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import findings as O
from ..operators import joins as J
from ..sources import projection as P
from .registry import query, rounded

WITH = f"WITH {P.FINDINGS}"
SPANS = "spans AS (SELECT p_partkey AS id, p_type AS grp, (p_partkey % 500)::BIGINT AS start, (p_partkey % 500 + p_size)::BIGINT AS \"end\" FROM part)"


def _spans(spark, sf_dir):
    start = (F.col("p_partkey") % 500).cast("long")
    return P.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("grp"), start.alias("start"), (start + F.col("p_size")).cast("long").alias("end"))


@query(f"""WITH {SPANS}, pts AS (SELECT DISTINCT grp, x::BIGINT AS "at" FROM (SELECT DISTINCT p_type AS grp FROM part), unnest(range(0, 560, 3)) AS u(x)),
hit AS (SELECT pts.grp, pts."at", id, start, row_number() OVER (PARTITION BY pts.grp, pts."at" ORDER BY start DESC, id) AS rn FROM pts JOIN spans ON pts.grp = spans.grp AND start <= pts."at" AND pts."at" <= "end")
SELECT pts.grp, pts."at", id AS span_id, start AS span_start FROM pts LEFT JOIN hit ON hit.grp = pts.grp AND hit."at" = pts."at" AND rn = 1""")
def function_at(spark, sf_dir):
    spans = _spans(spark, sf_dir)
    points = spans.select("grp").distinct().select("grp", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(559).cast("long"), F.lit(3).cast("long"))).alias("at"))
    return J.innermost(points, spans, "grp", "at", "start", "end")


@query(f"""WITH {SPANS}, hunks AS (SELECT s_suppkey AS id, CASE s_suppkey % 3 WHEN 0 THEN 'ECONOMY' WHEN 1 THEN 'LARGE' ELSE 'SMALL' END AS grp, (s_suppkey * 7 % 500)::BIGINT AS start, (s_suppkey * 7 % 500 + s_suppkey % 9)::BIGINT AS "end" FROM supplier)
SELECT h.grp, h.id AS l_id, s.id AS r_id FROM hunks h JOIN spans s ON h.grp = s.grp AND h.start <= s."end" AND h."end" >= s.start""")
def hunk_overlap(spark, sf_dir):
    k = F.col("s_suppkey")
    start = (k * 7 % 500).cast("long")
    grp = F.when(k % 3 == 0, "ECONOMY").when(k % 3 == 1, "LARGE").otherwise("SMALL")
    hunks = P.table(spark, sf_dir, "supplier").select(k.alias("id"), grp.alias("grp"), start.alias("start"), (start + k % 9).cast("long").alias("end"))
    return J.overlapping(hunks, _spans(spark, sf_dir), "grp")


@query("""SELECT q.event_id AS query_id, q.user_id, v.event_id AS value_id, v.value AS value
FROM (SELECT * FROM events WHERE event_type = 'error') q ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON q.user_id = v.user_id AND q.ts >= v.ts""")
def resolve_at(spark, sf_dir):
    e = P.table(spark, sf_dir, "events")
    q = e.where("event_type = 'error'").select("user_id", "ts", F.col("event_id").alias("query_id"))
    v = e.where("event_type = 'view'").select("user_id", "ts", "value", F.col("event_id").alias("value_id"))
    return J.as_of(q, v, "user_id", "ts")


@query("""WITH one AS (SELECT p_name, min(p_partkey) AS target FROM part WHERE p_partkey % 40 = 0 GROUP BY p_name HAVING count(*) = 1)
SELECT p_partkey AS id, p_name AS name, target FROM part JOIN one USING (p_name)""")
def unique_name_resolution(spark, sf_dir):
    p = P.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return J.unique_names(p, p.where("id % 40 = 0"), "name").select("id", "name", "target")


@query(f"""WITH {P.CALLS}, changed AS (SELECT p_partkey AS id FROM part WHERE p_partkey % 100 = 3)
SELECT DISTINCT src AS id FROM calls WHERE dst IN (SELECT id FROM changed) AND src NOT IN (SELECT id FROM changed)""")
def callers_of_changed(spark, sf_dir):
    return J.callers_of_changed(P.calls(spark, sf_dir), P.table(spark, sf_dir, "part").where("p_partkey % 100 = 3").select(F.col("p_partkey").alias("id")))


@query(f"""{WITH} SELECT h.id, h.detector, h.file, h.line FROM findings h WHERE half = 'head' AND NOT EXISTS (
  SELECT 1 FROM findings b WHERE b.half = 'base' AND b.detector = h.detector AND b.file = h.file AND abs(b.line - h.line) <= 3)""")
def findings_diff_fuzzy(spark, sf_dir):
    f = P.findings(spark, sf_dir)
    return O.fuzzy_new(f.where("half = 'head'"), f.where("half = 'base'")).select("id", "detector", "file", "line")


@query(f"""{WITH}, h AS (SELECT DISTINCT detector, file, line FROM findings WHERE half = 'head'), b AS (SELECT DISTINCT detector, file, line FROM findings WHERE half = 'base')
(SELECT *, 'new' AS change FROM (FROM h EXCEPT FROM b)) UNION ALL (SELECT *, 'fixed' FROM (FROM b EXCEPT FROM h))""")
def watch_delta(spark, sf_dir):
    f = P.findings(spark, sf_dir)
    return O.watch_delta(f.where("half = 'head'"), f.where("half = 'base'"))


@query("""WITH o AS (SELECT doc_id AS path, md5(text) AS h FROM documents WHERE doc_id % 5 <> 0), n AS (SELECT doc_id AS path, md5(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 6 <> 0)
SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.h IS NULL THEN 'added' WHEN n.h IS NULL THEN 'removed' WHEN o.h <> n.h THEN 'changed' ELSE 'unchanged' END AS change FROM o FULL JOIN n ON o.path = n.path""")
def file_changes(spark, sf_dir):
    d = P.table(spark, sf_dir, "documents").select("doc_id", "text")
    new = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return O.file_changes(d.where("doc_id % 5 != 0").select("doc_id", F.xxhash64("text")), d.where("doc_id % 6 != 0").select("doc_id", F.xxhash64(new)))


@query(f"{WITH} SELECT id, detector, title, file, line FROM findings QUALIFY row_number() OVER (PARTITION BY detector, title, file, line ORDER BY id) = 1")
def dedup_findings(spark, sf_dir):
    return O.deduplicated(P.findings(spark, sf_dir)).select("id", "detector", "title", "file", "line")


@query(f"{WITH} SELECT id, severity, file, line FROM findings ORDER BY severity DESC, file, line, detector, title, id LIMIT 20 OFFSET 40")
def paginate_findings(spark, sf_dir):
    return O.page(P.findings(spark, sf_dir), 3, 20).select("id", "severity", "file", "line")


@query(f"{WITH} SELECT id, detector, severity FROM findings QUALIFY row_number() OVER (PARTITION BY detector ORDER BY severity DESC, id) <= 25")
def per_detector_cap(spark, sf_dir):
    return O.capped(P.findings(spark, sf_dir), 25).select("id", "detector", "severity")


@query(f"""{WITH} SELECT detector, sum((severity = 0)::INT)::BIGINT AS info, sum((severity = 1)::INT)::BIGINT AS low, sum((severity = 2)::INT)::BIGINT AS medium,
sum((severity = 3)::INT)::BIGINT AS high, sum((severity = 4)::INT)::BIGINT AS critical, count(*) AS total FROM findings GROUP BY detector""")
def severity_summary(spark, sf_dir):
    return O.severity_summary(P.findings(spark, sf_dir))


@query(f"{WITH} SELECT id, severity FROM findings WHERE severity >= 2 AND coalesce(confidence, 0.7) >= 0.6 AND detector NOT IN ('click') AND NOT regexp_matches(file, '^f1[^/]*$')")
def filter_findings(spark, sf_dir):
    f = O.by_confidence(O.by_severity(P.findings(spark, sf_dir), 2), 0.6)
    return O.not_excluded(O.enabled(f, ["click"]), ["f1*"]).select("id", "severity")


@query(f"""{WITH} SELECT file, (line // 50)::BIGINT AS bucket, count(DISTINCT detector) AS detectors, count(*) AS n, max(severity) AS severity FROM findings GROUP BY file, line // 50 HAVING count(DISTINCT detector) >= 2""")
def compound_smells(spark, sf_dir):
    return O.compound_smells(P.findings(spark, sf_dir))


@query(f"""{WITH}, e AS (SELECT file, (line // 10)::BIGINT AS place, detector, max(coalesce(confidence, 0.7)) AS c, max(severity) AS severity FROM findings GROUP BY ALL),
g AS (SELECT file, place, count(*) AS detectors, avg(c) AS mean_confidence, sum(c * (severity + 1)) / sum(severity + 1) AS weighted_confidence, 1 - exp(sum(ln(greatest(1 - c, 1e-9)))) AS bayes_confidence, max(severity) AS max_severity FROM e GROUP BY ALL),
m AS (SELECT file, place, severity, row_number() OVER (PARTITION BY file, place ORDER BY count(*) DESC, severity DESC) AS rn FROM e GROUP BY file, place, severity)
SELECT file, place, detectors, round(mean_confidence, 6) AS mean_confidence, round(weighted_confidence, 6) AS weighted_confidence, round(bayes_confidence, 6) AS bayes_confidence, max_severity, severity AS majority_severity
FROM g JOIN m USING (file, place) WHERE rn = 1 AND detectors >= 2 AND mean_confidence >= 0.6""")
def voting_consensus(spark, sf_dir):
    return rounded(O.votes(P.findings(spark, sf_dir)), "mean_confidence", "weighted_confidence", "bayes_confidence")


@query(f"""{WITH}, g AS (SELECT file, max((detector IN ('error'))::INT)::DOUBLE AS defects, max((detector IN ('purchase'))::INT)::DOUBLE AS exposure, max((detector IN ('signup'))::INT)::DOUBLE AS structure FROM findings WHERE severity >= 3 GROUP BY file)
SELECT file, defects, exposure, structure, round(least(1.0, 0.4 * defects + 0.3 * exposure + 0.3 * structure + CASE WHEN defects + exposure + structure >= 3 THEN 0.1 ELSE 0 END), 6) AS risk FROM g""")
def compound_risk(spark, sf_dir):
    f = P.findings(spark, sf_dir).where("severity >= 3")
    return rounded(O.compound_risk(f, {"error": ("defects", 0.4), "purchase": ("exposure", 0.3), "signup": ("structure", 0.3)}), "risk")


@query(f"""{WITH}, d AS (SELECT file, sum(CASE severity WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 4 ELSE 8 END)::DOUBLE AS points FROM findings GROUP BY file),
s AS (SELECT 'f' || c_custkey::VARCHAR AS file, c_custkey % 900 AS loc FROM customer),
m AS (SELECT 'f' || o_custkey::VARCHAR AS file, count(DISTINCT o_orderstatus) AS coupling, count(*) AS churn, count(DISTINCT o_orderpriority) AS authors, max(epoch(TIMESTAMP '{P.NOW}' - o_orderdate)) / 86400.0 AS age_days FROM orders GROUP BY o_custkey)
SELECT file, round(100 * (0.35 * least(1.0, coalesce(points, 0) / greatest(loc / 100.0, 1.0) / 10) + 0.25 * least(1.0, coalesce(coupling, 0) / 20.0) + 0.20 * least(1.0, coalesce(churn, 0) / 20.0) + 0.10 * least(1.0, coalesce(authors, 0) / 10.0) + 0.10 * least(1.0, coalesce(age_days, 0) / 365.0)), 6) AS debt
FROM s LEFT JOIN d USING (file) LEFT JOIN m USING (file)""")
def file_debt(spark, sf_dir):
    sizes = P.table(spark, sf_dir, "customer").select(F.concat(F.lit("f"), F.col("c_custkey").cast("string")).alias("file"), (F.col("c_custkey") % 900).alias("loc"))
    age = (F.unix_timestamp(F.lit(P.NOW)) - F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))) / 86400.0
    metrics = P.table(spark, sf_dir, "orders").groupBy(F.concat(F.lit("f"), F.col("o_custkey").cast("string")).alias("file")).agg(F.countDistinct("o_orderstatus").alias("coupling"), F.count(F.lit(1)).alias("churn"), F.countDistinct("o_orderpriority").alias("authors"), F.max(age).alias("age_days"))
    return rounded(O.file_debt(P.findings(spark, sf_dir), sizes, metrics), "debt")


@query(f"""{WITH}, o AS (SELECT file, line, count(DISTINCT detector) - 1 AS others FROM findings GROUP BY file, line)
SELECT id, round(least(0.99, greatest(0.05, coalesce(confidence, 0.7) - CASE WHEN line < 60 THEN 0.4 ELSE 0 END - CASE WHEN line >= 1300 THEN 0.15 ELSE 0 END - CASE WHEN file LIKE 'f2%' THEN 0.2 ELSE 0 END + 0.1 * least(others, 3))), 6) AS confidence FROM findings JOIN o USING (file, line)""")
def confidence_enrichment(spark, sf_dir):
    f = O.enriched(P.findings(spark, sf_dir), is_test=F.col("file").like("f2%"), is_bundled=F.col("line") < 60, is_non_production=F.col("line") >= 1300)
    return rounded(f.select("id", "confidence"), "confidence")


@query(f"""{WITH}, p AS (SELECT CASE detector WHEN 'error' THEN 'quality' WHEN 'purchase' THEN 'architecture' ELSE 'structure' END AS pillar, CASE severity WHEN 4 THEN 5.0 WHEN 3 THEN 2.0 WHEN 2 THEN 0.5 WHEN 1 THEN 0.1 ELSE 0 END AS penalty, severity FROM findings),
a AS (SELECT sum(CASE WHEN pillar = 'structure' THEN penalty ELSE 0 END) * 0.01 AS s, sum(CASE WHEN pillar = 'quality' THEN penalty ELSE 0 END) * 0.01 AS q, sum(CASE WHEN pillar = 'architecture' THEN penalty ELSE 0 END) * 0.01 AS r, max(severity) AS worst FROM p),
b AS (SELECT least(100, greatest(25, 100 - s)) AS s, least(100, greatest(25, 100 - q)) AS q, least(100, greatest(25, 100 - r)) AS r, worst FROM a),
c AS (SELECT *, greatest(5, least(CASE WHEN worst >= 2 THEN 99.9 ELSE 100 END, 0.4 * s + 0.3 * q + 0.3 * r)) AS o FROM b)
SELECT round(s::DOUBLE, 6) AS structure, round(q::DOUBLE, 6) AS quality, round(r::DOUBLE, 6) AS architecture, round(o::DOUBLE, 6) AS overall,
CASE WHEN o >= 97 THEN 'A+' WHEN o >= 93 THEN 'A' WHEN o >= 90 THEN 'A-' WHEN o >= 87 THEN 'B+' WHEN o >= 83 THEN 'B' WHEN o >= 80 THEN 'B-' WHEN o >= 77 THEN 'C+' WHEN o >= 73 THEN 'C' WHEN o >= 70 THEN 'C-' WHEN o >= 67 THEN 'D+' WHEN o >= 63 THEN 'D' WHEN o >= 60 THEN 'D-' ELSE 'F' END AS grade FROM c""")
def health_score(spark, sf_dir):
    pillar = F.when(F.col("detector") == "error", "quality").when(F.col("detector") == "purchase", "architecture").otherwise("structure")
    return rounded(O.health(P.findings(spark, sf_dir), pillar, {"structure": 0.4, "quality": 0.3, "architecture": 0.3}, size_factor=0.01), "structure", "quality", "architecture", "overall")


@query(f"""{WITH} SELECT id FROM findings WHERE NOT (detector = 'view' AND EXISTS (SELECT 1 FROM findings w WHERE w.detector = 'click' AND w.file = findings.file AND w.line = findings.line))""")
def dead_code_overlap(spark, sf_dir):
    return O.without_overlap(P.findings(spark, sf_dir), "view", "click").select("id")


@query("SELECT lang, count(*) AS files, sum(len(string_split(text, chr(10))))::BIGINT AS lines, max(n_chars) AS longest FROM documents GROUP BY lang")
def language_stats(spark, sf_dir):
    d = P.table(spark, sf_dir, "documents")
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("files"), F.sum(F.size(F.split("text", "\n"))).cast("long").alias("lines"), F.max("n_chars").alias("longest"))


@query(f"""{WITH}, b AS (SELECT DISTINCT detector, file, title FROM findings WHERE half = 'base'), h AS (SELECT detector, file, title FROM findings WHERE half = 'head')
SELECT CASE WHEN b.file IS NULL THEN 'new' ELSE 'baselined' END AS status, count(*) AS n FROM h LEFT JOIN b USING (detector, file, title) GROUP BY 1
UNION ALL SELECT 'fixed', count(*) FROM b WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.detector = b.detector AND h.file = b.file AND h.title = b.title)""")
def baseline_status(spark, sf_dir):
    f = P.findings(spark, sf_dir)
    return O.baseline_split(f.where("half = 'head'"), f.where("half = 'base'"), ["detector", "file", "title"]).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(f"{WITH} SELECT file, count(*) AS n, count(DISTINCT detector) AS detectors, arg_max(detector, (severity, -id)) AS root FROM findings GROUP BY file")
def root_causes(spark, sf_dir):
    f = P.findings(spark, sf_dir)
    return f.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("detector").alias("detectors"), F.max_by("detector", F.struct("severity", (-F.col("id")).alias("k"))).alias("root"))


@query(f"{WITH}, p AS (SELECT detector, sum(CASE severity WHEN 4 THEN 5.0 WHEN 3 THEN 2.0 WHEN 2 THEN 0.5 WHEN 1 THEN 0.1 ELSE 0 END)::DOUBLE AS penalty FROM findings GROUP BY detector) SELECT detector, round(penalty, 6) AS penalty, round(penalty / sum(penalty) OVER (), 6) AS share FROM p")
def fix_impact(spark, sf_dir):
    """What removing each detector's findings would win back."""
    penalty = F.element_at(F.array(*map(F.lit, O.PENALTY)), (F.col("severity") + 1).cast("int"))
    p = P.findings(spark, sf_dir).groupBy("detector").agg(F.sum(penalty).alias("penalty"))
    total = p.agg(F.sum("penalty").alias("total"))  # one row
    return rounded(p.crossJoin(F.broadcast(total)).select("detector", "penalty", (F.col("penalty") / F.col("total")).alias("share")), "penalty", "share")


@query("""WITH d AS (SELECT ts::DATE AS day, avg(value) AS score FROM events GROUP BY 1) SELECT day::VARCHAR AS day, round(score, 5) AS score, round(score - lag(score) OVER (ORDER BY day), 5) AS change FROM d""")
def score_trend(spark, sf_dir):
    from pyspark.sql import Window

    d = P.table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.avg("value").alias("score"))  # a row a day
    d = d.withColumn("change", F.col("score") - F.lag("score").over(Window.orderBy("day")))
    return rounded(d.select(F.col("day").cast("string").alias("day"), "score", "change"), "score", "change", digits=5)


@query(f"""{WITH} SELECT toxic AS label, count(*) AS n, sum((severity >= 2)::INT)::BIGINT AS severe FROM findings JOIN labels ON id = doc_id GROUP BY toxic""")
def training_stats(spark, sf_dir):
    f = P.findings(spark, sf_dir).join(P.table(spark, sf_dir, "labels"), F.col("id") == F.col("doc_id"))
    return f.groupBy(F.col("toxic").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("severity") >= 2).cast("long")).alias("severe"))


@query(f"{WITH} SELECT CASE WHEN c = 0 THEN 'cached' WHEN c * 10 <= n THEN 'delta' ELSE 'cold' END AS mode, c AS changed, n AS total FROM (SELECT count(*) FILTER (WHERE doc_id % 13 = 0) AS c, count(*) AS n FROM documents)")
def incremental_mode(spark, sf_dir):
    """Which of the three modes a re-run takes, by the share of files whose content changed."""
    d = P.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.xxhash64("text").alias("hash"))
    new = d.withColumn("hash", F.when(F.col("path").cast("long") % 13 == 0, F.col("hash") + F.when(F.col("hash") > 0, -1).otherwise(1)).otherwise(F.col("hash")))
    c = O.file_changes(d, new).agg(F.sum((F.col("change") != "unchanged").cast("long")).alias("changed"), F.count(F.lit(1)).alias("total"))
    return c.select(F.when(F.col("changed") == 0, "cached").when(F.col("changed") * 10 <= F.col("total"), "delta").otherwise("cold").alias("mode"), "changed", "total")
