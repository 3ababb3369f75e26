"""Analysis of a source tree with memory: what didn't change isn't looked at again.

A store is a folder of versions, each with the files' content hashes, findings, functions and call
edges as Parquet. Rules that see one file at a time run on changed files only; findings of the
others are taken over. Rules that see the whole graph run again if its edges between files, any
function or any commit changed, which one fingerprint tells; else their findings are taken over.
A version counts once its row is in `versions`, so a run that is lost half way leaves the one before."""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import detectors as D
from .operators import findings as O
from .operators import postprocess
from .sources import code, config

#: Registered rules, beside the line rules, that only need the file they report.
LOCAL = {
    "long-methods", "deep-nesting", "LongParameterListDetector", "mutable-default-args", "inconsistent-returns", "missing-docstrings", "GeneratorMisuseDetector", "AINamingPatternDetector", "DeadStoreDetector",
    "UnusedImportsDetector", "UnreachableCodeDetector", "commented-code", "large-files", "rust-panic-density", "GodClassDetector", "MiddleManDetector",
}
VERSIONS = "version long, mode string, fingerprint string, files long, changed long, findings long, score double, grade string"


@dataclass
class Result:
    findings: DataFrame
    version: int
    mode: str
    changed: int
    score: float
    grade: str
    new: DataFrame | None = None
    fixed: DataFrame | None = None
    seconds: float = 0.0


@dataclass
class Engine:
    spark: SparkSession
    store: str
    settings: config.Config = field(default_factory=config.Config)
    commits: DataFrame | None = None
    only: list[str] | None = None

    def _table(self, version: int, name: str) -> str:
        return f"{self.store.rstrip('/')}/v{version}/{name}"

    def latest(self):
        """The row of the last whole version, or None."""
        path = f"{self.store.rstrip('/')}/versions"
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if not fs_path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(fs_path):
            return None
        return self.spark.read.schema(VERSIONS).parquet(path).orderBy(F.desc("version")).first()

    def load(self, name: str) -> DataFrame:
        """files, raw, findings, functions or edges of the last version."""
        last = self.latest()
        if last is None:
            raise FileNotFoundError(f"nothing was analysed in {self.store}")
        return self.spark.read.parquet(self._table(last["version"], name))

    def _kept(self, df: DataFrame, version: int, name: str) -> DataFrame:
        path = self._table(version, name)
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def _fingerprint(self, functions: DataFrame, edges: DataFrame) -> str:
        def of(df, *columns):
            return df.agg(F.concat_ws(":", F.count(F.lit(1)).cast("string"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).cast("string"))).first()[0]

        parts = [of(functions, *functions.columns), of(edges, "src", "dst")]
        if self.commits is not None:
            parts.append(of(self.commits, *self.commits.columns))
        return "/".join(parts)

    def analyse(self, files: DataFrame) -> Result:
        """files: path, language, content. Full at first, then only what changed."""
        began, last = time.time(), self.latest()
        version = last["version"] + 1 if last else 1
        chosen = [n for n in (D.names() if self.only is None else self.only) if n not in set(self.settings.settings.disabled)]
        local = [n for n in chosen if n in LOCAL or any(r.name == n for r in D.LINE_RULES)]
        whole = [n for n in chosen if n not in local]

        hashes = files.select("path", F.md5(F.col("content").cast("binary")).alias("hash"))
        if last is None:
            changed, gone = files, None
        else:
            old = self.load("files")
            same = hashes.join(old, ["path", "hash"], "left_semi").select("path")
            changed = files.join(same, "path", "left_anti").select(*files.columns)
            gone = old.select("path").join(same, "path", "left_anti")
        changed = self._kept(changed, version, "changed")
        n_changed = changed.count()
        n_gone = gone.count() if gone is not None else 0
        now = self._kept(hashes, version, "files")
        own = D.Context(changed, options=self.settings.options)
        functions, raw = code.functions(changed), D.detect(own, local)
        if gone is not None:
            functions = self.load("functions").join(gone, "path", "left_anti").unionByName(functions)
            raw = self.load("raw").where(F.col("detector").isin(*local)).join(gone.withColumnRenamed("path", "file"), "file", "left_anti").select(*raw.columns).unionByName(raw)
        functions = self._kept(functions, version, "functions")
        edges = self._kept(code.call_edges(functions), version, "edges")
        fingerprint = self._fingerprint(functions, edges)
        again = last is None or fingerprint != last["fingerprint"] or n_changed + n_gone > 0
        if whole and again:
            ctx = D.Context(files, self.commits, self.settings.options)
            ctx.__dict__.update(functions=functions, edges=edges)
            raw = raw.unionByName(D.detect(ctx, whole))
        elif whole:
            raw = raw.unionByName(self.load("raw").where(F.col("detector").isin(*whole)).select(*raw.columns))
        raw = self._kept(raw, version, "raw")
        found = self._kept(postprocess.apply(raw, self.settings.settings), version, "findings")
        n = found.count()
        n_files = now.count()
        pillar = F.when(F.col("category") == "architecture", "architecture").when(F.col("category").isin("security", "quality", "ml", "performance"), "quality").otherwise("structure")
        graded = O.health(found.withColumn("detector", F.col("category")), pillar, self.settings.weights, size_factor=10 / (10 + n_files)).first()
        score, grade = graded["overall"], graded["grade"]
        new = fixed = None
        if last is not None:
            before, key = self.load("findings"), ["detector", "file", "line_start", "title"]
            equal = [found[c].eqNullSafe(before[c]) for c in key]
            new, fixed = found.join(before, equal, "left_anti"), before.join(found, equal, "left_anti")
        mode = "full" if last is None else "cached" if n_changed + n_gone == 0 and fingerprint == last["fingerprint"] else "incremental"
        row = [(version, mode, fingerprint, n_files, n_changed + n_gone, n, float(score), grade)]
        if new is not None:
            new, fixed = self._kept(new, version, "new"), self._kept(fixed, version, "fixed")
        self.spark.createDataFrame(row, VERSIONS).coalesce(1).write.mode("append").parquet(f"{self.store.rstrip('/')}/versions")
        return Result(found, version, mode, n_changed + n_gone, float(score), grade, new, fixed, time.time() - began)

    def watch(self, read, rounds: int | None = None, every: float = 2.0) -> Iterator[Result]:
        """Analyses what `read()` returns again and again, `every` seconds apart, and yields the results
        of rounds in which something changed. Changes within a round are one."""
        turn = 0
        while rounds is None or turn < rounds:
            result = self.analyse(read())
            if result.mode != "cached":
                yield result
            turn += 1
            if rounds is None or turn < rounds:
                time.sleep(every)


def module_edges(functions: DataFrame, edges: DataFrame) -> DataFrame:
    """src_module, dst_module, n of calls between folders."""
    m = functions.select("qualified_name", F.regexp_extract("path", "^(.*)/", 1).alias("m"))
    j = edges.join(m.toDF("src", "src_module"), "src").join(m.toDF("dst", "dst_module"), "dst").where("src_module != dst_module")
    return j.groupBy("src_module", "dst_module").agg(F.count(F.lit(1)).alias("n"))


def query(engine: Engine, verb: str) -> DataFrame:
    """functions, classes, files, calls, imports or stats of the last version."""
    f, e = engine.load("functions"), engine.load("edges")
    if verb == "functions":
        return f.select("qualified_name", "path", "line_start", "line_end", "complexity").orderBy("path", "line_start")
    if verb == "classes":
        return f.where("class_name is not null").groupBy("path", "class_name").agg(F.count(F.lit(1)).alias("methods"), F.min("line_start").alias("line_start")).orderBy("path", "class_name")
    if verb == "files":
        return engine.load("files").orderBy("path")
    if verb == "calls":
        return e.orderBy("src", "dst")
    if verb == "imports":
        at = f.select("qualified_name", "path")
        return e.join(at.toDF("src", "a"), "src").join(at.toDF("dst", "b"), "dst").where("a != b").select("a", "b").distinct().orderBy("a", "b")
    if verb == "stats":
        one = f.agg(F.count(F.lit(1)).alias("functions"), F.countDistinct("path").alias("files"), F.countDistinct("path", "class_name").alias("classes"))
        return one.crossJoin(e.agg(F.count(F.lit(1)).alias("calls")))  # one row each
    raise ValueError(f"unknown query {verb!r}")


