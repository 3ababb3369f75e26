"""The repository reader against the Git program, loose and packed."""

import os
import shutil
import subprocess

import pytest
from pyspark.sql import functions as F

from lattica.operators import history
from lattica.sources import git

pytestmark = pytest.mark.skipif(shutil.which("git") is None, reason="no Git program to compare with")


@pytest.fixture(scope="module", params=["loose", "packed"])
def repo(request, tmp_path_factory):
    root = tmp_path_factory.mktemp(request.param)

    def run(*argv, when=0, who="Ann"):
        env = os.environ | {f"GIT_{x}_{k}": v for x in ("AUTHOR", "COMMITTER") for k, v in (("NAME", who), ("EMAIL", f"{who}@x.org"), ("DATE", f"{1_700_000_000 + when} +0000"))}
        return subprocess.run(["git", "-c", "init.defaultBranch=main", "-c", "gc.auto=0", "-C", str(root), *argv], check=True, capture_output=True, text=True, env=env).stdout

    run("init", "-q")
    body = [f"line {i} of a file that is long enough for deltas" for i in range(200)]
    for step, who in enumerate(["Ann", "Bob", "Ann", "Cem"]):
        body[step * 10 : step * 10 + 2] = [f"new {step}", f"more {step}", f"third {step}"]
        (root / "src").mkdir(exist_ok=True)
        (root / "src/a.txt").write_text("\n".join(body) + "\n")
        (root / f"b{step}.txt").write_text(f"b {step}\n")
        if step == 2:
            (root / "b0.txt").unlink()
        run("add", "-A", when=step * 100, who=who)
        run("commit", "-q", "-m", f"step {step}\n\nfix the crash" if step == 1 else f"step {step}", when=step * 100, who=who)
    run("checkout", "-q", "-b", "side", "HEAD~1")
    (root / "side.txt").write_text("s\n")
    run("add", "-A")
    run("commit", "-q", "-m", "side", when=350, who="Dee")
    run("checkout", "-q", "main")
    run("merge", "-q", "--no-ff", "-m", "merge", "side", when=500, who="Ann")
    if request.param == "packed":
        run("gc", "-q", "--aggressive", "--prune=now")
    return root, run


def test_log_and_trees(repo):
    root, run = repo
    r = git.Repo(str(root))
    assert [c.hash for c in r.log()] == run("log", "--format=%H", "--date-order").split()
    assert [c.hash for c in r.log(first_parent=True)] == run("log", "--format=%H", "--first-parent").split()
    assert r.resolve("main") == run("rev-parse", "HEAD").strip() and r.resolve("nobody") is None
    assert r.merge_base("main", "side") == run("merge-base", "main", "side").strip()
    assert bool(r.packs) == (root.name.startswith("packed"))
    head = r.commit(r.resolve())
    assert head.message == "merge" and head.author == "Ann" and len(head.parents) == 2
    assert b"\n".join(r.lines(r.blob_at(head, "src/a.txt"))) + b"\n" == (root / "src/a.txt").read_bytes()
    assert r.blob_at(head, "src") is None and r.blob_at(head, "none/x") is None


def test_blame(repo):
    root, run = repo
    want = [x.split()[0] for x in run("blame", "-l", "--root", "--first-parent", "src/a.txt").splitlines()]
    assert [c.hash for c in git.Repo(str(root)).blame("src/a.txt")] == want
    assert git.Repo(str(root)).blame("missing") == []


def test_tables(spark, repo):
    root, run = repo
    found = git.commits(spark, str(root))
    assert found.count() == 6 and git.commits(spark, str(root), most=2).count() == 2
    changed = git.changes(found, str(root))
    got = {(r.hash, r.file): (r.insertions, r.deletions) for r in changed.collect()}
    for c in found.where(F.size("parents") <= 1).collect():
        stat = [x.split("\t") for x in run("show", "--numstat", "--format=", "--no-renames", c.hash).splitlines() if x]
        assert {f: (int(a), int(b)) for a, b, f in stat} == {f: v for (h, f), v in got.items() if h == c.hash}
    files = git.commit_files(found, changed, F.lit("2023-11-20 00:00:00").cast("timestamp"))
    assert files.where("file = 'src/a.txt'").count() == 4 and files.where("age_days < 0").count() == 0
    assert {r.file: r.commits for r in history.churn(changed).collect()}["src/a.txt"] >= 4
    lines = git.blame(spark.createDataFrame([("src/a.txt",)], "path string"), str(root))
    owned = {r.author: r.share for r in history.blame_ownership(lines).collect()}
    assert abs(sum(owned.values()) - 1) < 1e-9 and owned["Ann"] > 0.5 > owned["Cem"]


def test_empty_repository(tmp_path):
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True, capture_output=True)
    assert list(git.Repo(str(tmp_path)).log()) == []
