"""Incremental analysis, the command line, the worker and its reports."""

import io
import json
import os

import pytest

from lattica import __main__ as cli
from lattica import engine as E
from lattica.operators import detectors, reports, summaries
from lattica.sources import code

FILES = {
    "src/a.py": "import os\n\ndef add(a, b, out=[]):\n    return eval(a) + b\n",
    "src/b.py": "from src.a import add\n\ndef run(x):\n    print(x)\n    return add(x, x)\n",
    "web/c.js": "if (a == b) { x() }\nel.innerHTML = data\n",
}
RULES = ["EvalDetector", "mutable-default-args", "debug-code", "implicit-coercion", "xss", "DeadCodeDetector", "UnusedImportsDetector"]


@pytest.fixture
def tree(tmp_path):
    for path, text in FILES.items():
        p = tmp_path / "tree" / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return tmp_path


def key(df):
    return sorted((r.detector, os.path.basename(r.file), r.line_start) for r in df.collect())


def test_incremental_equals_full(spark, tree):
    read = lambda: code.read_tree(spark, str(tree / "tree"))
    run = E.Engine(spark, str(tree / "store"), only=RULES)
    assert run.latest() is None
    first = run.analyse(read())
    assert first.mode == "full" and ("EvalDetector", "a.py", 4) in key(first.findings) and first.new is None
    assert run.analyse(read()).mode == "cached"
    (tree / "tree/src/b.py").write_text("def run(x):\n    return x\n\ndef more(y=[]):\n    return run(y)\n")
    (tree / "tree/web/c.js").unlink()
    (tree / "tree/web/d.js").write_text("if (a == b) { y() }\n")
    third = run.analyse(read())
    assert third.mode == "incremental" and third.changed == 4  # b.py before and after, c.js gone, d.js new
    fresh = E.Engine(spark, str(tree / "other"), only=RULES).analyse(read())
    assert key(third.findings) == key(fresh.findings)
    assert ("mutable-default-args", "b.py", 4) in key(third.new) and ("xss", "c.js", 2) in key(third.fixed)
    assert {r.path.rsplit("/", 1)[1] for r in E.query(run, "files").collect()} == {"a.py", "b.py", "d.js"}
    assert E.query(run, "stats").first()["functions"] == 3
    for verb in ("functions", "classes", "calls", "imports"):
        assert E.query(run, verb).columns


def test_cached_findings_aren_t_made_again(spark, tree, monkeypatch):
    read = lambda: code.read_tree(spark, str(tree / "tree"))
    run = E.Engine(spark, str(tree / "store"), only=["EvalDetector", "DeadCodeDetector"])
    first, seen = run.analyse(read()), []
    monkeypatch.setitem(detectors.REGISTRY, "DeadCodeDetector", lambda ctx: seen.append(1))
    again = run.analyse(read())
    assert again.mode == "cached" and not seen and key(again.findings) == key(first.findings)


def test_command_line_and_worker(spark, tree):
    def run(*argv, lines=()):
        out = io.StringIO()
        assert cli.main([*argv, "--root", str(tree / "tree"), "--store", str(tree / "store"), "--only", ",".join(RULES)], spark, out, lines) == 0
        return out.getvalue()

    assert "findings" in run("analyze")
    assert "EvalDetector" in run("findings") and "a.py" in run("debt") and "detectors" in run("doctor")
    assert json.loads(run("status"))["version"] == 1 and run("graph", "functions").count("\n") == 2
    assert "min_confidence" in run("init") and "xss" in run("detectors") and "===" in run("fix")
    events = [json.loads(x) for x in run("worker", lines=['{"command": "init", "id": 1}', "nonsense", '{"command": "analyze", "id": 2}', '{"command": "dance"}', '{"command": "shutdown"}', '{"command": "init"}']).splitlines()]
    assert [e["event"] for e in events] == ["progress", "ready", "error", "progress", "unchanged", "error"] and len(events[1]["findings"]) >= 4
    (tree / "tree/src/a.py").write_text("x = 1\n")
    watched = json.loads(run("watch", "--rounds", "1"))
    assert watched["event"] == "delta" and any(f["detector"] == "EvalDetector" for f in watched["fixed_findings"])
    assert run("diff").startswith("-")


def test_reports(spark, tree):
    found = detectors.detect(detectors.Context(code.read_tree(spark, str(tree / "tree"))), RULES)
    page = summaries.render(found, "HTML", score=88.0, grade="B+")
    assert page.count("<svg") == 2 and "88.0" in page and "xss" in page
    assert "findings in" in summaries.render(found, "narrative") and "Severity" in summaries.render(found, "table")
    assert summaries.render(found, "md") == reports.markdown(found)
    assert summaries.render(found, "json", str(tree / "out")) is None and spark.read.json(str(tree / "out")).count() == found.count()
    with pytest.raises(ValueError):
        summaries.render(found, "pdf")
    with pytest.raises(ValueError):
        summaries.render(found, "sarif")
    assert summaries.narrative(found.limit(0)).startswith("No findings")
    assert detectors.detect(detectors.Context(code.read_tree(spark, str(tree / "tree"))), []).count() == 0
    areas = summaries.treemap([("a", 3, 4), ("b", 1, 0)], 100, 100)
    assert 'width="75.0"' in areas and 'height="100.0"' in areas
    assert summaries.architecture_map([("a", "b", 2)]).count("<line") == 1
