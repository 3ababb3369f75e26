"""The engine's own tables (nodes, edges, commits, findings, lines) as projections of the test
tables, and the same projections as SQL common table expressions for the oracles.

A commit is an order, an author a customer, a file or function a part, a module a part type.
`NOW` stands for the wall clock, so that results repeat.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..folders import tasks

NOW = "2001-08-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark, sf_dir) -> DataFrame:
    """Functions: id, name, file_path, module, complexity (0 is absent), loc, params, exported."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("name"),
        F.concat_ws("/", "p_type", "p_brand").alias("file_path"),
        F.col("p_type").alias("module"),
        F.col("p_size").cast("long").alias("complexity"),
        F.floor("p_retailprice").cast("long").alias("loc"),
        (F.col("p_size") % 12).cast("long").alias("params"),
        (F.col("p_partkey") % 7 == 0).alias("exported"),
    )


NODES = """nodes AS (
  SELECT p_partkey AS id, p_name AS name, p_type || '/' || p_brand AS file_path, p_type AS module, p_size::BIGINT AS complexity,
         floor(p_retailprice)::BIGINT AS loc, (p_size % 12)::BIGINT AS params, p_partkey % 7 = 0 AS exported FROM part)"""


def calls(spark, sf_dir) -> DataFrame:
    """Dense call edges: consecutive items of an order, as a set without self loops."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    n = tasks(items)
    items = items.repartition(n, "l_orderkey")
    after = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    return items.select(F.col("l_partkey").alias("src"), after.alias("dst")).where("dst is not null and src != dst").repartition(n, "src", "dst").distinct()


CALLS = """calls AS (
  SELECT DISTINCT src, dst FROM (
    SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst FROM lineitem)
  WHERE dst IS NOT NULL AND src <> dst)"""


def sparse_calls(spark, sf_dir) -> DataFrame:
    """A sparse digraph: first to second item of urgent orders."""
    urgent = table(spark, sf_dir, "orders").where(F.col("o_orderpriority").startswith("1-")).select("o_orderkey")
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").join(urgent, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    steps = items.select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst"), F.row_number().over(w).alias("rn"))
    return steps.where("rn = 1 and dst is not null and src != dst").select("src", "dst").distinct()


SPARSE = """sparse AS (
  SELECT DISTINCT src, dst FROM (
    SELECT l_partkey AS src, lead(l_partkey) OVER w AS dst, row_number() OVER w AS rn
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND o_orderpriority LIKE '1-%'
    WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey))
  WHERE rn = 1 AND dst IS NOT NULL AND src <> dst)"""


def imports(spark, sf_dir) -> DataFrame:
    """Import edges between nations: supplier's to customer's, of all items of all orders."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    j = li.select("l_orderkey", "l_suppkey").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    j = j.join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return j.select(F.col("s_nationkey").cast("long").alias("src"), F.col("c_nationkey").cast("long").alias("dst")).where("src != dst").distinct()


IMPORTS = """imports AS (
  SELECT DISTINCT s_nationkey::BIGINT AS src, c_nationkey::BIGINT AS dst
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  WHERE s_nationkey <> c_nationkey)"""


def commit_files(spark, sf_dir, key: str = "part") -> DataFrame:
    """hash, author, ts, age_days, file: each file of a commit once. key: part or brand."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    n = tasks(table(spark, sf_dir, "lineitem"))
    # Orders are dealt once, to a number of tasks that follows the files; what is done by commit needs no more.
    o, li = o.repartition(n, "o_orderkey"), li.repartition(n, "l_orderkey")
    file = F.col("l_partkey").cast("string")
    if key == "brand":
        li = li.join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
        file = F.col("p_brand")
    age = F.greatest(F.lit(0.0), (F.unix_timestamp(F.lit(NOW)) - F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))) / 86400.0)
    rows = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(F.col("o_orderkey").alias("hash"), F.col("o_custkey").alias("author"), F.col("o_orderdate").alias("ts"), age.alias("age_days"), file.alias("file")).distinct()


def commits_sql(key: str = "part") -> str:
    file = "l_partkey::VARCHAR" if key == "part" else "p_brand"
    join = "" if key == "part" else "JOIN part ON l_partkey = p_partkey"
    return f"""commit_files AS (
  SELECT DISTINCT o_orderkey AS hash, o_custkey AS author, o_orderdate AS ts,
         greatest(0.0, epoch(TIMESTAMP '{NOW}' - o_orderdate) / 86400.0) AS age_days, {file} AS file
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey {join})"""


def findings(spark, sf_dir) -> DataFrame:
    """Findings from events: id, detector, severity 0..4, file, line, confidence, title, half."""
    e = table(spark, sf_dir, "events")
    ts = F.col("ts")
    return e.select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("detector"),
        F.when(F.col("value") >= 200, 4).when(F.col("value") >= 100, 3).when(F.col("value") >= 50, 2).when(F.col("value") >= 20, 1).otherwise(0).cast("long").alias("severity"),
        F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("file"),
        (F.hour(ts) * 60 + F.minute(ts)).cast("long").alias("line"),
        F.when(F.col("event_id") % 11 == 0, F.lit(None)).otherwise(F.least(F.lit(1.0), F.col("value") / 100.0)).alias("confidence"),
        F.concat(F.col("event_type"), F.lit(": s"), (F.col("event_id") % 5).cast("string")).alias("title"),
        F.when(F.dayofmonth(ts) <= 15, "base").otherwise("head").alias("half"),
    )


FINDINGS = """findings AS (
  SELECT event_id AS id, event_type AS detector,
    CASE WHEN value >= 200 THEN 4 WHEN value >= 100 THEN 3 WHEN value >= 50 THEN 2 WHEN value >= 20 THEN 1 ELSE 0 END::BIGINT AS severity,
    'f' || user_id::VARCHAR AS file, (hour(ts) * 60 + minute(ts))::BIGINT AS line,
    CASE WHEN event_id % 11 = 0 THEN NULL ELSE least(1.0, value / 100.0) END AS confidence,
    event_type || ': s' || (event_id % 5)::VARCHAR AS title, CASE WHEN day(ts) <= 15 THEN 'base' ELSE 'head' END AS half FROM events)"""


def lines(spark, sf_dir) -> DataFrame:
    """Source lines: documents split at newlines, with 1-based numbers."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return d.select("doc_id", (F.col("pos") + 1).cast("long").alias("line_no"), "line")


LINES = """lines AS (
  SELECT doc_id, i::BIGINT AS line_no, parts[i] AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents), unnest(range(1, len(parts) + 1)) AS u(i))"""
