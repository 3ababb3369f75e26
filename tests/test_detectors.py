"""Detectors over a small source tree."""

import textwrap

import pytest

from lattica.operators import detectors as D
from lattica.sources import code

FILES = {
    "src/app.py": '''
        import os, json
        from math import *

        DEBUG = True

        def handler(request, a, b, c, d, e, f):
            """Doc."""
            query = f"select * from t where id = {request.args}"
            os.system("ls " + request.args["x"])
            try:
                pass
            except Exception: pass
            return eval(query)
            print("never")

        def helper(items=[]):
            unused = 1
            return json.dumps(items)

        def first(x):
            return second(x)

        def second(x):
            return first(x)

        def quiet(p):
            verify = get(p, verify=False)  # lint:ignore
            return verify
        ''',
    "src/view.js": '''
        el.innerHTML = user;
        if (a == b) { debugger; }
        load().then(x => x);
        ''',
    "src/lib.rs": '''
        pub fn f() -> Result<u8, E> { unsafe { g() } }
        let x = m.lock().unwrap();
        ''',
    "tests/test_app.py": "def test_handler():\n    assert eval('1')\n",
    "notes.txt": "TODO not code",
}
WANT = {
    ("SQLInjectionDetector", "app.py"), ("command-injection", "app.py"), ("EvalDetector", "app.py"), ("django-security", "app.py"), ("wildcard-imports", "app.py"),
    ("empty-catch-block", "app.py"), ("mutable-default-args", "app.py"), ("LongParameterListDetector", "app.py"), ("UnreachableCodeDetector", "app.py"),
    ("DeadStoreDetector", "app.py"), ("MutualRecursionDetector", "app.py"), ("xss", "view.js"), ("implicit-coercion", "view.js"), ("debug-code", "app.py"),
    ("rust-unsafe-without-safety-comment", "lib.rs"), ("rust-missing-must-use", "lib.rs"), ("rust-mutex-poisoning-risk", "lib.rs"), ("rust-unwrap-without-context", "lib.rs"),
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, text in FILES.items():
        p = root / name
        p.parent.mkdir(exist_ok=True)
        p.write_text(textwrap.dedent(text))
    return str(root)


def test_detectors(spark, tree):
    files = code.read_tree(spark, tree)
    assert files.count() == 4
    found = D.detect(D.Context(files)).collect()
    got = {(r.detector, r.file.rsplit("/", 1)[-1]) for r in found}
    assert WANT <= got, WANT - got
    assert not [r for r in found if r.detector == "InsecureTlsDetector"]  # suppressed on its line
    assert not [r for r in found if r.detector == "EvalDetector" and "test_app" in r.file]


def test_selection(spark, tree):
    ctx = D.Context(code.read_tree(spark, tree))
    assert {r.detector for r in D.detect(ctx, only=["xss", "long-methods"], disabled=["long-methods"]).collect()} == {"xss"}
    assert len(D.names()) == len(set(D.names())) == 110


def test_function_facts(spark, tree):
    f = {r.name: r for r in code.functions(code.read_tree(spark, tree)).collect()}
    assert f["handler"].params == ["request", "a", "b", "c", "d", "e", "f"] and f["handler"].has_doc
    assert f["handler"].complexity == 2 and f["helper"].mutable_defaults == 1
    edges = {(r.src.split("::")[1], r.dst.split("::")[1]) for r in code.call_edges(code.functions(code.read_tree(spark, tree))).collect()}
    assert {("first", "second"), ("second", "first")} <= edges


def test_lock_files(spark):
    rows = [("a/requirements.txt", "x==1.2\n# y==3\nz>=1\n"), ("go.sum", "m/n v1.0.0 h1:abc=\nm/n v1.0.0/go.mod h1:d=\n"), ("Cargo.lock", '[[package]]\nname = "serde"\nversion = "1.0"\n'), ("package-lock.json", '{"packages": {"": {"version": "0"}, "node_modules/left-pad": {"version": "1.3.0"}}}')]
    got = {tuple(r) for r in code.lock_entries(spark.createDataFrame(rows, "path string, content string")).collect()}
    assert got == {("PyPI", "x", "1.2"), ("Go", "m/n", "1.0.0"), ("crates.io", "serde", "1.0"), ("npm", "left-pad", "1.3.0")}


def test_cycles_and_advisories(spark, tmp_path):
    (tmp_path / "alpha.py").write_text("from pkg import beta\n\ndef f(x):\n    return x\n")
    (tmp_path / "beta.py").write_text("import alpha\n\ndef g(x):\n    return x\n")
    (tmp_path / "gamma.py").write_text("import alpha\n")
    ctx = D.Context(code.read_tree(spark, str(tmp_path)))
    got = D.detect(ctx, only=["CircularDependencyDetector"]).collect()
    assert [r.title for r in got] == []  # `from pkg import beta` names the package, not the file
    (tmp_path / "alpha.py").write_text("import beta\n\ndef f(x):\n    return x\n")
    ctx = D.Context(code.read_tree(spark, str(tmp_path)))
    assert [r.title for r in D.detect(ctx, only=["CircularDependencyDetector"]).collect()] == ["Import cycle of 2 files"]
    locks = spark.createDataFrame([("requirements.txt", "x==1.2\ny==2\n")], "path string, content string")
    bad = spark.createDataFrame([("PyPI", "x", "1.2", "ADV-1")], "ecosystem string, name string, version string, advisory string")
    ctx = D.Context(code.read_tree(spark, str(tmp_path)), options={"DepAuditDetector": {"advisories": bad, "lock_files": locks}})
    assert [r.title for r in D.detect(ctx, only=["DepAuditDetector"]).collect()] == ["Known vulnerability: ADV-1"]


def test_commit_rules(spark, tree):
    files = code.read_tree(spark, tree)
    rows = [(h, 1, f"2024-01-{h:02d}", 400.0 - h, f) for h in range(1, 9) for f in ("src/a.py", "src/b.py", "src/c.py")]
    commits = spark.createDataFrame(rows, "hash long, author long, ts string, age_days double, file string")
    got = {r.detector for r in D.detect(D.Context(files, commits), only=["SingleOwnerModuleDetector", "OrphanedKnowledgeDetector", "KnowledgeSiloDetector"]).collect()}
    assert got == {"SingleOwnerModuleDetector", "OrphanedKnowledgeDetector", "KnowledgeSiloDetector"}
