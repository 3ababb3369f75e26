"""Scalar functions."""

from pyspark.sql import functions as F

from lattica import functions as L


def test_paths_and_names(spark):
    r = spark.createDataFrame([("a/b/c.test.py", "LongMethodsDetector"), ("top.RS", "XSSDetector")], "p string, n string").select(L.module_of(F.col("p")).alias("m"), L.stem(F.col("p")).alias("s"), L.extension(F.col("p")).alias("e"), L.kebab(F.col("n")).alias("k")).collect()
    assert [tuple(x) for x in r] == [("a/b", "c.test", "py", "long-methods"), (".", "top", "rs", "xss")]


def test_sizes_and_ages(spark):
    df = spark.createDataFrame([(3, 5), (5, 3)], "a int, b int").select(L.loc(F.col("a"), F.col("b")).alias("n"))
    assert [x.n for x in df.collect()] == [3, 1]
    d = spark.range(1).select(L.age_days(F.lit("2024-01-02 12:00:00"), F.lit("2024-01-04 00:00:00")).alias("a"), L.age_days(F.lit("2024-01-05"), F.lit("2024-01-04")).alias("z"), L.decay(F.lit(90.0), 90.0).alias("h"))
    r = d.first()
    assert r.a == 1.5 and r.z == 0.0 and abs(r.h - 0.5) < 1e-12


def test_fnv1a_known_values(spark):
    got = {x.t: x.h for x in spark.createDataFrame([("",), ("a",), ("foobar",), (None,)], "t string").select("t", L.fnv1a(F.col("t")).alias("h")).collect()}
    assert got == {"": "cbf29ce484222325", "a": "af63dc4c8601ec8c", "foobar": "85944171f73967e8", None: None}
