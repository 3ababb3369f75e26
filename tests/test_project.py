"""Configuration, labels, fixes and the false-positive classifier."""

from lattica.operators import classifier, fixes
from lattica.sources import config

TOML = """
min_confidence = 0.4
[detectors.xss]
enabled = false
[detectors.long-methods]
severity = "high"
max_lines = 40
[exclude]
paths = ["vendor/**"]
[scoring.weights]
structure = 2
quality = 1
architecture = 1
"""


def test_config():
    c = config.load(TOML)
    assert c.settings.disabled == ["xss"] and c.settings.overrides == {"long-methods": 3} and c.options["long-methods"] == {"max_lines": 40}
    assert c.settings.excludes == ["vendor/**"] and c.settings.min_confidence == 0.4 and c.weights == {"structure": 0.5, "quality": 0.25, "architecture": 0.25}
    assert sum(config.load("").weights.values()) == 1.0


def test_labels(spark, tmp_path):
    path = str(tmp_path / "labels")
    for ok, ts in ((True, "2024-01-01"), (False, "2024-01-02")):
        config.append_labels(spark.createDataFrame([("a", "d", ok, "", ts)], "finding_id string, detector string, is_true_positive boolean, reason string, ts string").selectExpr("finding_id", "detector", "is_true_positive", "reason", "cast(ts as timestamp) ts"), path)
    assert [(r.finding_id, r.is_true_positive) for r in config.read_labels(spark, path).collect()] == [("a", False)]


def test_fixes(spark):
    lines = spark.createDataFrame([("a.js", 1, "if (a == b) x()"), ("b.py", 2, "x = torch.load(p)"), ("b.py", 3, "y = 1")], "path string, line_no int, text string")
    found = spark.createDataFrame([("implicit-coercion", "a.js", 1), ("torch-load-unsafe", "b.py", 2), ("magic-numbers", "b.py", 3)], "detector string, file string, line_start int")
    assert {r.after for r in fixes.suggested(found, lines).collect()} == {"if (a === b) x()", "x = torch.load(p, weights_only=True)"}


def test_classifier_learns(spark):
    rows = [(i, f"d{i % 5}", i % 4, "eval of input" if i % 2 else "mock fixture", ("src/" if i % 2 else "tests/") + "a.py", 1, 5, None, 0.7, i % 2) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, detector string, severity int, title string, file string, line_start int, line_end int, cwe_id string, confidence double, label int")
    got = classifier.score(df, classifier.train(df, "label", rounds=30)).collect()
    assert all((r.tp_score > 0.5) == bool(r.label) for r in got)
