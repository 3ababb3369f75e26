"""Sinks, post-processing and sequence decoding."""

import itertools
import json

import numpy as np
import pytest

from lattica.operators import postprocess, reports, sequence

SCHEMA = "id long, detector string, severity int, title string, file string, line_start int, line_end int, category string, cwe_id string, confidence double"
ROWS = [
    (1, "xss", 3, "a", "src/a.js", 4, 4, "security", "CWE-79", 0.8),
    (2, "xss", 3, "a", "src/a.js", 4, 4, "security", "CWE-79", 0.8),
    (3, "long-methods", 1, "b", "src/b.py", 10, 90, "quality", None, None),
    (4, "EvalDetector", 3, "c", "tests/test_c.py", 1, 1, "security", "CWE-95", 0.9),
    (5, "DeadCodeDetector", 1, "d", "src/d.py", 7, 9, "dead-code", None, 0.7),
    (6, "UnreachableCodeDetector", 1, "d", "src/d.py", 7, 7, "dead-code", None, 0.7),
    (7, "debug-code", 0, "e", "vendor/x.py", None, None, "quality", None, 0.7),
]


@pytest.fixture(scope="module")
def found(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_sarif(found, tmp_path):
    path = str(tmp_path / "out.sarif")
    reports.sarif(found, path)
    log = json.loads(open(path).read())
    run = log["runs"][0]
    assert len(run["results"]) == 7 and {r["id"] for r in run["tool"]["driver"]["rules"]} == {r[1] for r in ROWS}
    assert run["results"][0]["level"] == "error" and run["results"][0]["locations"][0]["physicalLocation"]["region"]["startLine"] == 4


def test_json_and_summaries(spark, found, tmp_path):
    reports.json_lines(found, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).where("severity = 'high'").count() == 3
    assert "| xss | 0 | 0 | 0 | 2 | 0 | 2 |" in reports.markdown(found)
    assert reports.text(found).startswith("7 findings")


def test_postprocessing(spark, found):
    got = {r.id: r for r in postprocess.apply(found).collect()}
    assert 2 not in got  # an exact duplicate
    assert 5 not in got  # reported as unreachable already
    assert 7 not in got  # bundled, informational
    assert got[4].severity == 2  # security outside production
    labels = spark.createDataFrame([(1, False), (3, True)], "finding_id long, is_true_positive boolean")
    s = postprocess.Settings(disabled=["EvalDetector"], overrides={"xss": 4}, excludes=["src/b*"], min_confidence=0.5)
    assert {r.id: r.severity for r in postprocess.apply(found, s, labels).collect()} == {2: 4, 6: 1}


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    m = sequence.Model(rng.normal(size=(3, 2)), np.ones((3, 2)), np.array([0.5, 0.3, 0.2]), np.array([[0.8, 0.1, 0.1], [0.1, 0.8, 0.1], [0.2, 0.2, 0.6]]))
    x = rng.normal(size=(5, 2))
    e = m.emissions(x)
    score = lambda p: m.start[p[0]] + e[0, p[0]] + sum(m.step[a, b] + e[t + 1, b] for t, (a, b) in enumerate(zip(p, p[1:])))
    assert m.decode(x).tolist() == list(max(itertools.product(range(3), repeat=5), key=score))


def test_decoding_by_group(spark):
    rows = [(g, i, 5.0 * (i >= 3) + 0.1 * i, int(i >= 3)) for g in range(2) for i in range(6)]
    df = spark.createDataFrame(rows, "g long, i long, x double, y int")
    got = sequence.decode(df, sequence.fit(df, "y", ["x"], 2), "g", ["i"], ["x"])
    assert {(r.g, r.i): r.state for r in got.collect()} == {(g, i): int(i >= 3) for g in range(2) for i in range(6)}
