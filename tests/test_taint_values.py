"""Taint inside functions, literal values, flags, roles and module distance on small cases."""

import numpy as np
from pyspark.sql import functions as F

from lattica.operators import flags, history, roles, taint, values

BODY = '''
def show(conn):
    # user = request.args["x"]
    name = request.args["name"]
    other = name + "!"
    safe = escape(other)
    fixed = "a"
    conn.execute("select " + other)
    conn.execute("select " + safe)
    conn.execute("select " + fixed)
    name = "harmless"
    conn.execute(name)
    os.system(other)
'''.splitlines()


def test_flow():
    got = taint.flow(BODY, "sql")
    assert [(v, s, line, clean) for v, s, _, _, line, clean in got] == [("other", "request.args", 8, False), ("safe", "request.args", 9, True)]
    assert [(v, line) for v, _, _, _, line, _ in taint.flow(BODY, "command")] == [("other", 13)]
    assert taint.flow([], "sql") == [] and taint.flow(["x ="], "xss") == []


def test_intra_and_central(spark):
    files = spark.createDataFrame([("a.py", "\n".join(BODY)), ("b.rs", "\n".join(BODY)), ("c.py", "nothing here")], "path string, content string")
    bodies = spark.createDataFrame([(p, f"{p}::show", i + 1, t) for p in ("a.py", "b.rs", "c.py") for i, t in enumerate(BODY)], "path string, function string, line_no int, text string")
    assert {(r.function, r.category, r.sink_line) for r in taint.central(files, bodies).collect()} == {("a.py::show", "sql", 8), ("a.py::show", "sql", 9), ("a.py::show", "command", 13)}
    assert taint.intra(bodies.limit(0)).count() == 0
    assert {r.path for r in taint.relevant(files, "sql").collect()} == {"a.py"}


def test_literals(spark):
    rows = [('"a\\nb"', "a\nb", None, None), ("'it\\'s'", "it's", None, None), ('f"x"', "x", None, None), ('"\\\\n"', "\\n", None, None), ("10_000u64", None, 10000, None), ("-5L", None, -5, None), ("2.50f32", None, None, 2.5), ("name", None, None, None), ("1.2.3", None, None, None), ("99999999999999999999", None, None, None), (None, None, None, None), ('"open', None, None, None)]
    df = spark.createDataFrame(rows, "l string, text string, whole long, fraction double")
    got = df.select("l", "text", "whole", "fraction", values.unquoted(F.col("l")).alias("a"), values.integer(F.col("l")).alias("b"), values.decimal(F.col("l")).alias("c")).collect()
    assert [(r.a, r.b, r.c) for r in got] == [(r.text, r.whole, r.fraction) for r in got]


def test_folding_has_no_value_where_there_is_none(spark):
    low = -(2**63)
    df = spark.createDataFrame([("/", 7, 0), ("%", 7, 0), ("+", 2**63 - 1, 1), ("/", low, -1), ("/", -7, 2), ("%", -7, 2), ("<", 1, 2), ("?", 1, 2)], "op string, a long, b long")
    assert [r[0] for r in df.select(values.fold(F.col("op"), F.col("a"), F.col("b"))).collect()] == [None, None, None, None, "-3", "-1", "true", None]


def test_constants_in_a_cycle_have_no_value(spark):
    rows = [("a", None, "b"), ("b", None, "c"), ("c", "1", None), ("x", None, "y"), ("y", None, "x"), ("z", None, "nobody")] + [(f"n{i}", None, f"n{i - 1}") for i in range(1, 20)] + [("n0", "0", None)]
    got = {r["name"]: (r["value"], r["hops"]) for r in values.resolved(spark.createDataFrame(rows, "name string, literal string, refers_to string")).collect()}
    assert got["a"] == ("1", 2) and not {"x", "y", "z"} & got.keys() and got["n16"] == ("0", 16) and "n17" not in got


def test_flags(spark):
    files = spark.createDataFrame([("a.py", "import torch\neval(x)"), ("b.JS", "fetch(u)"), ("c.py", "")], "path string, content string")
    index = flags.file_index(files)
    assert {r.path: r.flags for r in index.collect()} == {"a.py": flags.BIT["import"] | flags.BIT["eval"] | flags.BIT["ml"], "b.JS": flags.BIT["http_client"], "c.py": 0}
    assert {r.path for r in flags.matching(index, ["py"], "ml", "sql").collect()} == {"a.py"} and flags.matching(index, ["py", "js"]).count() == 3


def test_module_distance_equals_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(30, 3)) @ rng.normal(size=(3, 3))
    df = spark.createDataFrame([(f"m{i}", *map(float, r)) for i, r in enumerate(x)], "module string, a double, b double, c double")
    d = x - x.mean(0)
    want = np.sqrt(np.einsum("ij,jk,ik->i", d, np.linalg.inv(np.cov(x.T, bias=True) + 1e-6 * np.eye(3)), d))
    got = {r["module"]: r["distance"] for r in roles.module_distance(df, ["a", "b", "c"]).collect()}
    assert np.allclose([got[f"m{i}"] for i in range(30)], want)
    assert [r.distance for r in roles.module_distance(df.limit(2), ["a", "b", "c"]).collect()] == [0.0, 0.0]


def test_weak_labels_and_outliers(spark):
    f = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "id long, file string")
    c = spark.createDataFrame([("a", "Hotfix for login", 500.0), ("a", "x", 1.0), ("b", "tidy", 200.0), ("c", "tidy", 10.0)], "file string, message string, age_days double")
    assert sorted((r.id, r.is_true_positive, r.weight) for r in history.weak_labels(f, c).collect()) == [(1, True, 0.7), (2, False, 0.5)]
    k = spark.createDataFrame([("a", 2.0, 1.0), ("b", 1.0, 0.0), ("c", 1.0, 1.0), ("d", 5.0, None)], "name string, value double, standard double")
    assert [tuple(r) for r in history.calibration_outliers(k, 3).collect()] == [("a", 1.0)]
