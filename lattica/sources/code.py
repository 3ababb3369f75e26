"""Source trees as tables: files, lines, functions and calls.

Files are read by Spark's binary source with a size cap. Python is parsed with its own syntax
tree in Arrow batches, brace languages by headers and matching braces (`braces`). Names of calls
are resolved by equi joins (same file first, then a name that is unique in the tree)."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import braces

MOST_BYTES = 2 * 1024 * 1024
#: Language of each file extension.
LANGUAGES = {"py": "python", "pyi": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "ts": "typescript", "tsx": "typescript", "rs": "rust", "go": "go", "java": "java", "cs": "csharp", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "hpp": "cpp", "yml": "yaml", "yaml": "yaml"}
FUNCTIONS = "path string, name string, qualified_name string, class_name string, line_start int, line_end int, params array<string>, mutable_defaults int, complexity int, nesting int, returns int, bare_returns int, yields int, yields_in_loop int, is_async boolean, has_doc boolean, decorators array<string>, calls array<string>, reads array<string>, stores array<string>"


def language(path):
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))
    return F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[ext]


def read_tree(spark: SparkSession, root: str, globs: str = "*") -> DataFrame:
    """path, language, content of known source files up to the size cap, below root."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", globs).load(root)
    return raw.where(F.col("length") <= MOST_BYTES).select("path", language(F.col("path")).alias("language"), F.decode("content", "UTF-8").alias("content")).where("language is not null")


def changed_only(files: DataFrame, changed: DataFrame) -> DataFrame:
    return files.join(changed.select("path").distinct(), "path", "left_semi")


def is_test(path):
    return path.rlike(r"(^|/)(tests?|__tests__|spec|fixtures)/|(^|/)test_[^/]*$|_test\.[a-z]+$|\.(test|spec)\.[a-z]+$|(^|/)conftest\.py$")


def lines(files: DataFrame, marker: str = "lint:ignore") -> DataFrame:
    """path, language, line_no, text, code (without strings and comments), suppressed, test."""
    d = files.select("path", "language", F.posexplode(F.split("content", "\n")).alias("pos", "text"))
    no_text = F.regexp_replace("text", r""""(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'""", "''")
    code = F.when(F.col("language").isin("python", "yaml"), F.regexp_replace(no_text, r"#.*$", "")).otherwise(F.regexp_replace(no_text, r"//.*$|/\*.*?\*/", ""))
    w = Window.partitionBy("path").orderBy("line_no")
    d = d.select("path", "language", (F.col("pos") + 1).alias("line_no"), "text", code.alias("code"))
    own = F.col("text").contains(marker)
    whole = F.max(own & (F.col("line_no") <= 10) & F.col("text").contains(f"{marker}-file")).over(Window.partitionBy("path"))
    return d.withColumn("suppressed", own | F.coalesce(F.lag(own).over(w), F.lit(False)) | whole).withColumn("test", is_test(F.col("path")))


class _Facts(ast.NodeVisitor):
    """Facts of one function, not of those inside it."""

    BRANCH = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.With, ast.IfExp, ast.comprehension, ast.Assert)
    BLOCK = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.With, ast.Try)

    def __init__(self, node):
        self.node = node
        self.complexity, self.nesting, self.deepest, self.loop = 1, 0, 0, 0
        self.returns = self.bare = self.yields = self.loop_yields = 0
        self.calls, self.reads, self.stores = [], [], []
        for child in node.body:
            self.visit(child)

    def visit(self, node):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Lambda)):
            return
        if isinstance(node, self.BRANCH):
            self.complexity += 1
        if isinstance(node, ast.BoolOp):
            self.complexity += len(node.values) - 1
        if isinstance(node, ast.Return):
            self.returns += node.value is not None
            self.bare += node.value is None
        if isinstance(node, (ast.Yield, ast.YieldFrom)):
            self.yields += 1
            self.loop_yields += self.loop > 0
        if isinstance(node, ast.Call):
            f = node.func
            self.calls.append(f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else "")
        if isinstance(node, ast.Name):
            (self.stores if isinstance(node.ctx, ast.Store) else self.reads).append(node.id)
        block, loop = isinstance(node, self.BLOCK), isinstance(node, (ast.For, ast.AsyncFor, ast.While))
        self.nesting += block
        self.loop += loop
        self.deepest = max(self.deepest, self.nesting)
        self.generic_visit(node)
        self.nesting -= block
        self.loop -= loop


def _parse(path: str, content: str) -> list[dict]:
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError, RecursionError):
        return []
    out = []

    def walk(node, prefix, owner):
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.ClassDef):
                walk(child, f"{prefix}{child.name}.", child.name)
            elif isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                f, a = _Facts(child), child.args
                names = [x.arg for x in (*a.posonlyargs, *a.args, *a.kwonlyargs) if x.arg not in ("self", "cls")]
                mutable = sum(isinstance(d, (ast.List, ast.Dict, ast.Set)) or (isinstance(d, ast.Call) and isinstance(d.func, ast.Name) and d.func.id in ("list", "dict", "set")) for d in (*a.defaults, *filter(None, a.kw_defaults)))
                out.append({"path": path, "name": child.name, "qualified_name": f"{path}::{prefix}{child.name}", "class_name": owner, "line_start": child.lineno, "line_end": child.end_lineno, "params": names, "mutable_defaults": mutable, "complexity": f.complexity, "nesting": f.deepest, "returns": f.returns, "bare_returns": f.bare, "yields": f.yields, "yields_in_loop": f.loop_yields, "is_async": isinstance(child, ast.AsyncFunctionDef), "has_doc": ast.get_docstring(child) is not None, "decorators": [ast.unparse(d) for d in child.decorator_list], "calls": [c for c in f.calls if c], "reads": f.reads, "stores": f.stores})
                walk(child, f"{prefix}{child.name}.", owner)
            else:
                walk(child, prefix, owner)

    walk(tree, "", None)
    return out


def functions(files: DataFrame) -> DataFrame:
    """Facts of functions, as FUNCTIONS: of Python by its syntax tree, of brace languages by their
    headers; a file that doesn't parse gives none."""
    names = [x.split()[0] for x in FUNCTIONS.split(", ")]

    def run(frames):
        for frame in frames:
            rows = []
            for path, language, text in zip(frame["path"], frame["language"], frame["content"]):
                rows += _parse(path, text or "") if language == "python" else braces.parse(path, text or "", language)
            yield pd.DataFrame(rows, columns=names)

    return files.where(F.col("language").isin("python", *braces.LANGUAGES)).select("path", "language", "content").mapInPandas(run, FUNCTIONS)


def call_edges(functions: DataFrame) -> DataFrame:
    """src, dst qualified names: a callee of the same file, else one whose name is unique."""
    c = functions.select(F.col("qualified_name").alias("src"), "path", F.explode(F.array_distinct("calls")).alias("name"))
    local = functions.groupBy("path", "name").agg(F.min("qualified_name").alias("here"))
    unique = functions.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("qualified_name").alias("there")).where("n = 1").drop("n")
    j = c.join(local, ["path", "name"], "left").join(unique, "name", "left").withColumn("dst", F.coalesce("here", "there"))
    return j.where("dst is not null and src != dst").select("src", "dst").distinct()


def lock_entries(files: DataFrame) -> DataFrame:
    """ecosystem, name, version of pinned dependencies in common lock files (path, content)."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    ln = files.select(name.alias("file"), F.explode(F.split("content", "\n")).alias("l"), "content")
    pip = ln.where("file like '%requirements%.txt'").select(F.lit("PyPI").alias("ecosystem"), F.regexp_extract("l", r"^\s*([A-Za-z0-9_.\-]+)==([^\s;#]+)", 1).alias("name"), F.regexp_extract("l", r"^\s*([A-Za-z0-9_.\-]+)==([^\s;#]+)", 2).alias("version"))
    gosum = ln.where("file = 'go.sum'").select(F.lit("Go"), F.regexp_extract("l", r"^(\S+) v([^\s/]+) h1:", 1), F.regexp_extract("l", r"^(\S+) v([^\s/]+) h1:", 2))
    block = r'(?s)name = "([^"]+)"\s+version = "([^"]+)"'
    toml = files.where(name.isin("Cargo.lock", "poetry.lock")).select(F.when(name == "Cargo.lock", "crates.io").otherwise("PyPI").alias("e"), F.explode(F.arrays_zip(F.regexp_extract_all("content", F.lit(block), F.lit(1)).alias("n"), F.regexp_extract_all("content", F.lit(block), F.lit(2)).alias("v"))).alias("z")).select("e", "z.n", "z.v")
    npm = files.where(name == "package-lock.json").select(F.explode(F.map_entries(F.from_json(F.get_json_object("content", "$.packages"), "map<string, struct<version: string>>"))).alias("m")).where("m.key != ''").select(F.lit("npm"), F.regexp_replace("m.key", r"^.*node_modules/", ""), "m.value.version")
    yarn = files.where(name == "yarn.lock").select(F.explode(F.regexp_extract_all("content", F.lit(r'(?m)^"?@?[^@"\s#]+@[^\n]*:\s*\n\s+version:?\s+"?[^"\s]+'), F.lit(0))).alias("b"))
    yarn = yarn.select(F.lit("npm"), F.regexp_extract("b", r'^"?(@?[^@"\s]+)@', 1), F.regexp_extract("b", r'version:?\s+"?([^"\s]+)$', 1))
    packages = "map<string, struct<version: string>>"
    pipfile = files.where(name == "Pipfile.lock").select(F.from_json("content", f"default {packages}, develop {packages}").alias("j")).select(F.explode(F.array(F.coalesce("j.default", F.expr(f"cast(map() as {packages})")), F.coalesce("j.develop", F.expr(f"cast(map() as {packages})")))).alias("m")).select(F.explode(F.map_entries("m")).alias("m"))
    pipfile = pipfile.select(F.lit("PyPI"), "m.key", F.regexp_replace("m.value.version", "^==", ""))
    return pip.union(gosum).union(toml).union(npm).union(yarn).union(pipfile).where("name != '' and version is not null").distinct()
