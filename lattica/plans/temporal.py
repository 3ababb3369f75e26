"""Co-change, ownership and churn over commits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import temporal as T
from ..sources import projection as P
from .registry import query, rounded

DECAY = "exp(-ln(2) * age_days / 90.0)"


def _counted(key: str = "part", most: int = 30) -> str:
    return f"""WITH {P.commits_sql(key)}, counted AS (
  SELECT *, {DECAY} AS decay FROM commit_files WHERE {DECAY} >= 0.001 QUALIFY count(*) OVER (PARTITION BY hash) <= {most}),
pairs AS (SELECT x.file AS a, y.file AS b, sum(x.decay) AS weight, count(*) AS n FROM counted x JOIN counted y ON x.hash = y.hash AND x.file < y.file GROUP BY x.file, y.file),
totals AS (SELECT file, sum(decay) AS weight, count(*) AS n FROM counted GROUP BY file)"""


def _spark(spark, sf_dir, key="part", most=30):
    return T.analysed(P.commit_files(spark, sf_dir, key), most_files=most)


@query(f"{_counted()} SELECT a, b, round(weight, 6) AS weight, n FROM pairs WHERE weight >= 0.3")
def co_change(spark, sf_dir):
    return rounded(T.pairs(_spark(spark, sf_dir), 0.3, many=True), "weight")


@query(f"{_counted('brand')} SELECT a, b, round(p.weight, 6) AS weight, p.n, round(least(p.n / x.n, p.n / y.n), 6) AS confidence FROM pairs p JOIN totals x ON a = x.file JOIN totals y ON b = y.file WHERE p.weight >= 0.5")
def co_change_confidence(spark, sf_dir):
    c = _spark(spark, sf_dir, "brand")
    return rounded(T.confidence(T.pairs(c), T.file_totals(c)), "weight", "confidence")


@query(f"""{_counted('brand')}, w AS (SELECT sum(decay) AS t FROM (SELECT DISTINCT hash, decay FROM counted)), k AS (SELECT count(*) AS n FROM totals)
SELECT a, b, round(p.weight, 6) AS weight, round((p.weight + 1) * (t + k.n * k.n) / ((x.weight + k.n) * (y.weight + k.n)), 6) AS lift FROM pairs p JOIN totals x ON a = x.file JOIN totals y ON b = y.file, w, k WHERE p.weight >= 0.5""")
def co_change_lift(spark, sf_dir):
    c = _spark(spark, sf_dir, "brand")
    return rounded(T.lift(T.pairs(c), c), "weight", "lift")


@query(f"{_counted()} SELECT file, count(*) AS degree FROM (SELECT a AS file FROM pairs UNION ALL SELECT b FROM pairs) GROUP BY file")
def coupling_degree(spark, sf_dir):
    return T.coupling_degree(_spark(spark, sf_dir), many=True)


@query(f"""{_counted('brand')}, conf AS (SELECT a, b, p.weight, p.n, least(p.n / x.n, p.n / y.n) AS confidence FROM pairs p JOIN totals x ON a = x.file JOIN totals y ON b = y.file WHERE p.weight >= 0.5),
deg AS (SELECT file, count(*) AS degree FROM (SELECT a AS file FROM pairs UNION ALL SELECT b FROM pairs) GROUP BY file),
known AS (SELECT DISTINCT least(x.p_brand, y.p_brand) AS a, greatest(x.p_brand, y.p_brand) AS b FROM part x JOIN part y ON y.p_partkey = x.p_partkey + 1 WHERE x.p_partkey % 9 = 0)
SELECT a, b, round(weight, 6) AS weight, n, round(confidence, 6) AS confidence FROM conf ANTI JOIN known USING (a, b)
WHERE n >= 3 AND confidence >= 0.1 AND a IN (SELECT file FROM deg WHERE degree <= 40) AND b IN (SELECT file FROM deg WHERE degree <= 40)""")
def hidden_coupling(spark, sf_dir):
    c = _spark(spark, sf_dir, "brand")
    p = P.table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    known = p.where("p_partkey % 9 = 0").select((F.col("p_partkey") + 1).alias("k"), F.col("p_brand").alias("src")).join(p.select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("dst")), "k")
    found = T.confidence(T.pairs(c), T.file_totals(c))
    return rounded(T.hidden_coupling(found, T.coupling_degree(c), known, hub=40, least_confidence=0.1), "weight", "confidence")


@query(f"""{_counted('brand')}, cut AS (SELECT x.file, count(*) AS partners, avg(p.n / x.n) AS rate FROM totals x JOIN (SELECT a AS file, n FROM pairs UNION ALL SELECT b, n FROM pairs) p USING (file) GROUP BY x.file)
SELECT file, partners, round(rate, 6) AS rate FROM cut WHERE partners >= 5 AND rate >= 0.05""")
def shotgun_surgery(spark, sf_dir):
    c = _spark(spark, sf_dir, "brand")
    p = T.pairs(c, 0.0)
    ends = p.select(F.col("a").alias("file"), F.col("n").alias("m")).union(p.select("b", "n"))
    g = T.file_totals(c).join(ends, "file").groupBy("file").agg(F.count(F.lit(1)).alias("partners"), F.avg(F.col("m") / F.col("n")).alias("rate"))
    return rounded(g.where("partners >= 5 and rate >= 0.05"), "rate")


OWN = f"""WITH {P.commits_sql()}, own_by AS (SELECT file, author, sum(exp(-ln(2) * age_days / 150.0)) AS dl, min((ts, hash)) AS first_at, min(age_days) AS last_age FROM commit_files GROUP BY file, author),
d AS (SELECT *, 3.293 + 1.098 * (first_at = min(first_at) OVER w)::INT + 0.164 * dl - 0.321 * ln(1 + greatest(sum(dl) OVER w - dl, 0)) AS doa FROM own_by WINDOW w AS (PARTITION BY file)),
owned AS (SELECT file, author, doa, CASE WHEN max(doa) OVER w = min(doa) OVER w THEN 1.0 ELSE (doa - min(doa) OVER w) / (max(doa) OVER w - min(doa) OVER w) END AS norm, last_age FROM d WINDOW w AS (PARTITION BY file)),
per AS (SELECT file, sum((norm > 0.75 AND doa > 3.293)::INT)::BIGINT AS bus_factor, CASE WHEN sum(norm) <= 0 THEN 1.0 ELSE sum(norm * norm) / (sum(norm) * sum(norm)) END AS hhi FROM owned GROUP BY file)"""


def _owned(spark, sf_dir):
    return T.ownership(P.commit_files(spark, sf_dir))


@query(f"{OWN} SELECT file, author, round(doa, 5) AS doa, round(norm, 5) AS norm FROM owned")
def doa_ownership(spark, sf_dir):
    return rounded(_owned(spark, sf_dir).select("file", "author", "doa", "norm"), "doa", "norm", digits=5)


@query(f"{OWN} SELECT file, bus_factor, round(hhi, 6) AS hhi FROM per")
def bus_factor(spark, sf_dir):
    return rounded(T.bus_factor(_owned(spark, sf_dir)), "hhi")


@query(f"""{OWN}, m AS (SELECT p_type AS module, p.* FROM per p JOIN part ON p_partkey::VARCHAR = file),
a AS (SELECT module, count(*) AS files, avg(bus_factor) AS avg_bus_factor, list_sort(list(bus_factor))[ceil(count(*) * 0.1)::INT] AS p10_bus_factor, avg(hhi) AS avg_hhi, avg((bus_factor <= 1)::INT) AS at_risk FROM m GROUP BY module)
SELECT module, files, round(avg_bus_factor, 6) AS avg_bus_factor, p10_bus_factor, round(avg_hhi, 6) AS avg_hhi, round(at_risk, 6) AS at_risk, round(least(1, greatest(0, greatest(0, 1 - avg_bus_factor / 5) * 0.4 + avg_hhi * 0.3 + at_risk * 0.3)), 6) AS risk FROM a""")
def module_ownership(spark, sf_dir):
    modules = P.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("file"), F.col("p_type").alias("module"))
    return rounded(T.module_ownership(T.bus_factor(_owned(spark, sf_dir)), modules), "avg_bus_factor", "avg_hhi", "at_risk", "risk")


@query(f"{OWN} SELECT file, round(hhi, 6) AS hhi FROM per WHERE bus_factor <= 1 AND hhi >= 0.25")
def knowledge_silo(spark, sf_dir):
    return rounded(T.bus_factor(_owned(spark, sf_dir)).where("bus_factor <= 1 and hhi >= 0.25").select("file", "hhi"), "hhi")


@query(f"{OWN} SELECT file, count(*) AS owners FROM owned WHERE norm > 0.75 GROUP BY file HAVING min(last_age) > 180")
def orphaned_knowledge(spark, sf_dir):
    return _owned(spark, sf_dir).where("norm > 0.75").groupBy("file").agg(F.count(F.lit(1)).alias("owners"), F.min("last_age").alias("least")).where("least > 180").select("file", "owners")


@query(f"WITH {P.commits_sql()} SELECT file, count(*) AS commits, count(DISTINCT author) AS authors, round(min(age_days), 6) AS last_age, count(*) >= 5 AS high FROM commit_files WHERE age_days <= 90 GROUP BY file")
def churn_90d(spark, sf_dir):
    return rounded(T.churn(P.commit_files(spark, sf_dir)), "last_age")


@query(f"""WITH {P.commits_sql('brand')}, g AS (SELECT file, (lag(age_days) OVER (PARTITION BY file ORDER BY ts, hash) - age_days) * 24 AS gap FROM commit_files)
SELECT file, sum((gap <= 24)::INT)::BIGINT AS within_24h, sum((gap <= 48)::INT)::BIGINT AS within_48h, sum((gap <= 72)::INT)::BIGINT AS within_72h FROM g WHERE gap IS NOT NULL GROUP BY file""")
def fix_velocity(spark, sf_dir):
    return T.fix_velocity(P.commit_files(spark, sf_dir, "brand"))


@query(f"""{_counted()}, {P.CALLS}, k AS (SELECT src, dst, 1.0 + least(coalesce(weight, 0), 2.0) AS w FROM calls LEFT JOIN (SELECT a, b, weight FROM pairs WHERE weight >= 0.3 UNION ALL SELECT b, a, weight FROM pairs WHERE weight >= 0.3) ON a = src::VARCHAR AND b = dst::VARCHAR)
SELECT src, round(sum(w), 6) AS strength, count(*) AS degree FROM k GROUP BY src""")
def weighted_overlay(spark, sf_dir):
    p = T.pairs(_spark(spark, sf_dir), 0.3, many=True).select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), "weight")
    w = G.overlay(P.calls(spark, sf_dir), p)
    return rounded(w.groupBy("src").agg(F.sum("w").alias("strength"), F.count(F.lit(1)).alias("degree")), "strength")
