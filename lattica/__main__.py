"""python -m lattica VERB: analyse a source tree and ask about it."""

from __future__ import annotations

import argparse
import json
import sys

VERBS = ("analyze", "findings", "graph", "debt", "diff", "status", "fix", "label", "watch", "worker", "init", "doctor", "benchmark", "detectors")
EXAMPLE = 'min_confidence = 0.5\n\n[detectors.magic-numbers]\nenabled = false\n\n[exclude]\npaths = ["vendor/**", "node_modules/**"]\n'


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lattica")
    p.add_argument("verb", choices=VERBS)
    p.add_argument("what", nargs="?", default=None, help="a query of graph, a finding's id for label, a path")
    p.add_argument("--root", default=".", help="the source tree, any URL that Spark reads")
    p.add_argument("--store", default=".lattica", help="folder of versions")
    p.add_argument("--config", default=None, help="a TOML file")
    p.add_argument("--format", default="text")
    p.add_argument("--out", default=None)
    p.add_argument("--top", type=int, default=20)
    p.add_argument("--page", type=int, default=1)
    p.add_argument("--severity", default=None, choices=("info", "low", "medium", "high", "critical"))
    p.add_argument("--filter", default=None, help="part of a path")
    p.add_argument("--only", default=None, help="detectors, joined by commas")
    p.add_argument("--rounds", type=int, default=None)
    p.add_argument("--false-positive", action="store_true")
    p.add_argument("--fail-under", type=float, default=None)
    return p


def main(argv: list[str] | None = None, spark=None, out=sys.stdout, lines=sys.stdin) -> int:
    a = parser().parse_args(argv)
    say = lambda x: print(x, file=out, flush=True)
    if a.verb == "init":
        say(EXAMPLE)
        return 0
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from . import engine as E
    from . import ship
    from .operators import detectors, findings, fixes, reports, summaries
    from .sources import code, config

    if a.verb == "detectors":
        for name in detectors.names():
            say(name)
        return 0
    spark = spark or SparkSession.builder.appName("lattica").getOrCreate()
    ship(spark)
    settings = config.Config()
    if a.config:
        settings = config.load("\n".join(r[0] for r in spark.read.text(a.config).collect()))
    run = E.Engine(spark, a.store, settings, only=a.only.split(",") if a.only else None)
    read = lambda: code.read_tree(spark, a.root)

    def shown(df):
        for r in df.limit(a.top).collect():
            say("  ".join("" if v is None else str(v) for v in r))

    def chosen(f):
        if a.severity:
            f = f.where(F.col("severity") >= config.SEVERITY[a.severity])
        return f.where(F.col("file").contains(a.filter)) if a.filter else f

    if a.verb in ("analyze", "benchmark"):
        r = run.analyse(read())
        if a.verb == "benchmark":
            say(json.dumps({"seconds": round(r.seconds, 3), "mode": r.mode, "findings": r.findings.count()}))
            return 0
        options = {"score": r.score, "grade": r.grade} if a.format in ("html", "narrative") else {}
        if (text := summaries.render(chosen(r.findings), a.format, a.out, **options)) is not None:
            say(text)
        say(f"score {r.score:.1f} ({r.grade}), {r.mode}, {r.changed} changed files")
        return int(a.fail_under is not None and r.score < a.fail_under)
    if a.verb == "findings":
        shown(findings.page(chosen(run.load("findings")).withColumn("line", F.coalesce("line_start", F.lit(0))), a.page, a.top).select(reports.severity_name().alias("severity"), "file", "line_start", "detector", "title"))
    elif a.verb == "graph":
        shown(E.query(run, a.what or "stats"))
    elif a.verb == "debt":
        shown(chosen(run.load("findings")).groupBy("file").agg(F.sum(F.col("severity") + 1).alias("debt"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("debt"), "file"))
    elif a.verb == "diff":
        for sign, name in (("+", "new"), ("-", "fixed")):
            if run.latest() is not None and run.latest()["version"] > 1:
                shown(run.load(name).select(F.lit(sign), "file", "line_start", "detector", "title").orderBy("file", "line_start"))
    elif a.verb == "status":
        last = run.latest()
        say("nothing analysed" if last is None else json.dumps(last.asDict()))
    elif a.verb == "fix":
        shown(fixes.suggested(run.load("findings"), code.lines(read())))
    elif a.verb == "label":
        row = spark.createDataFrame([(a.what, "", not a.false_positive, "")], "finding_id string, detector string, is_true_positive boolean, reason string").withColumn("ts", F.current_timestamp())
        config.append_labels(row, f"{a.store.rstrip('/')}/labels")
    elif a.verb == "watch":
        for r in run.watch(read, a.rounds):
            say(summaries.event("delta" if r.new is not None else "ready", findings=r.findings if r.new is None else r.new, fixed=r.fixed, score=r.score, grade=r.grade))
    elif a.verb == "worker":
        worker(run, read, lines, say)
    elif a.verb == "doctor":
        say(json.dumps({"spark": spark.version, "detectors": len(detectors.names()), "checkpoint": spark.conf.get("spark.checkpoint.dir", None), "analysed": run.latest() is not None}))
    return 0


def worker(run, read, lines, say) -> None:
    """Commands as lines of JSON (init, analyze, shutdown) and an event for each."""
    from .operators import summaries

    before = None
    for line in lines:
        try:
            said = json.loads(line)
            command, id = said["command"], said.get("id")
        except (ValueError, KeyError, TypeError) as wrong:
            say(summaries.event("error", message=f"not a command: {wrong}"))
            continue
        if command == "shutdown":
            return
        if command not in ("init", "analyze"):
            say(summaries.event("error", id, message=f"unknown command {command}"))
            continue
        say(summaries.event("progress", id, stage="analyse", done=0, total=1))
        r = run.analyse(read())
        if command == "init" or r.new is None:
            say(summaries.event("ready", id, r.findings, score=r.score, grade=r.grade, elapsed_ms=int(r.seconds * 1000)))
        elif r.mode == "cached":
            say(summaries.event("unchanged", id, score=r.score, elapsed_ms=int(r.seconds * 1000)))
        else:
            say(summaries.event("delta", id, r.new, r.fixed, score=r.score, grade=r.grade, score_delta=None if before is None else r.score - before, total_findings=r.findings.count(), elapsed_ms=int(r.seconds * 1000)))
        before = r.score


if __name__ == "__main__":
    sys.exit(main())
