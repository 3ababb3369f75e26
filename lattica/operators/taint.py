"""Taint inside a function: which variables hold outside input, line by line, and which sinks they
reach. A function's lines are one group, walked in order; functions are dealt over tasks.

Categories, CWE numbers, extensions and quick-reject strings are fixed values."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WEB = ("py", "js", "ts", "jsx", "tsx", "go", "java", "rb")


@dataclass(frozen=True)
class Category:
    cwe: str
    quick: tuple[str, ...]
    sinks: tuple[str, ...]
    sanitizers: tuple[str, ...]
    extensions: tuple[str, ...] = WEB


SOURCES = ("request.args", "request.form", "request.json", "request.get", "req.body", "req.query", "req.params", "input(", "sys.argv", "process.argv", "getparameter(")
CATEGORIES = {
    "sql": Category("CWE-89", ("execute", "cursor", "query", "SELECT", "INSERT", "UPDATE", "DELETE", "sql", "SQL", "db."), ("execute(", "executemany(", ".query(", ".raw("), ("escape", "parameterize", "quote_ident")),
    "command": Category("CWE-78", ("exec", "spawn", "system", "popen", "subprocess", "shell", "Process"), ("os.system(", "os.popen(", "subprocess.run(", "subprocess.call(", "child_process.exec("), ("shlex.quote", "escapeshellarg")),
    "xss": Category("CWE-79", ("innerHTML", "document.write", "dangerouslySetInnerHTML", "render", "template", "html"), ("innerhtml", "document.write(", "render_template_string("), ("escape", "sanitize", "dompurify"), ("js", "ts", "jsx", "tsx", "py", "rb", "java")),
    "ssrf": Category("CWE-918", ("fetch", "request", "http", "urllib", "requests.get", "curl", "urlopen"), ("requests.get(", "requests.post(", "urlopen(", "fetch(", "axios.get("), ("is_safe_url", "allowlist")),
    "path": Category("CWE-22", ("open(", "readFile", "readdir", "path.join", "os.path", "file_get_contents"), ("open(", "readfile(", "send_file("), ("secure_filename", "basename", "realpath")),
    "code": Category("CWE-94", ("eval(", "exec(", "compile(", "Function(", "setInterval(", "setTimeout("), ("eval(", "exec(", "compile("), ("literal_eval",)),
    "log": Category("CWE-117", ("log(", "logger", "logging", "console.log", "print(", "warn(", "error("), ("logger.info(", "logging.info(", "console.log(", "print("), ("replace('\\n'", "strip(")),
}
SCHEMA = "function string, category string, cwe_id string, variable string, source string, source_line int, sink string, sink_line int, sanitized boolean"
ASSIGNED = re.compile(r"^(?:(?:let|const|var|final|auto|String|int)\s+)?([A-Za-z_]\w*)\s*(?::\s*[\w\[\], .]+)?(?::=|=)(?!=)\s*(.+)$")


def relevant(files: DataFrame, category: str) -> DataFrame:
    """Files (path, content) whose extension and words let the category's sinks be there."""
    c = CATEGORIES[category]
    words = F.lit(False)
    for w in c.quick:
        words = words | F.col("content").contains(w)
    return files.where(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1).isin(*c.extensions) & words)


def relevant_kinds(files: DataFrame) -> DataFrame:
    """path, kinds: the categories that a file is relevant to, of files with any."""
    extension, word = F.regexp_extract("path", r"\.([A-Za-z]+)$", 1), lambda w: F.col("content").contains(w)
    said = [F.when(extension.isin(*c.extensions) & reduce(lambda a, b: a | b, map(word, c.quick)), F.lit(name)) for name, c in CATEGORIES.items()]
    return files.select("path", F.array_compact(F.array(*said)).alias("kinds")).where("size(kinds) > 0")


def flow(lines: list[str], category: str) -> list[tuple]:
    """(variable, source, source line, sink, sink line, sanitized) of one function's lines."""
    c = CATEGORIES[category]
    tainted: dict[str, tuple[str, int]] = {}
    clean: set[str] = set()
    found = []
    for at, line in enumerate(lines, 1):
        text = line.strip()
        if not text or text.startswith(("#", "//", "*", "/*")):
            continue
        if said := ASSIGNED.match(text):
            name, value = said.group(1), said.group(2)
            low = value.lower()
            source = next((s for s in SOURCES if s in low), None)
            held = sorted(v for v in tainted if re.search(rf"\b{re.escape(v)}\b", value))
            washed = any(s in low for s in c.sanitizers)
            if source:
                tainted[name] = (source, at)
                clean.add(name) if washed else clean.discard(name)
            elif held:
                tainted[name] = tainted[held[0]]
                clean.add(name) if washed or held[0] in clean else clean.discard(name)
            elif name in tainted:  # assigned anew from something harmless
                del tainted[name]
                clean.discard(name)
        low = text.lower()
        for sink in c.sinks:
            if (place := low.find(sink)) >= 0:
                rest = text[place + len(sink) :]
                for v in sorted(tainted):
                    if re.search(rf"\b{re.escape(v)}\b", rest):
                        found.append((v, *tainted[v], sink, at, v in clean or any(s in rest.lower() for s in c.sanitizers)))
    return found


def intra(bodies: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """Flows inside functions, as SCHEMA. bodies: function, line_no, text. All categories are taken in
    one walk over a function."""
    chosen = list(categories or CATEGORIES)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("line_no")
        lines, name = frame["text"].fillna("").tolist(), frame["function"].iloc[0]
        rows = [(name, c, CATEGORIES[c].cwe, *hit) for c in chosen for hit in flow(lines, c)]
        return pd.DataFrame(rows, columns=[x.split()[0] for x in SCHEMA.split(", ")])

    return bodies.select("function", "line_no", "text").groupBy("function").applyInPandas(run, SCHEMA)


def central(files: DataFrame, bodies: DataFrame) -> DataFrame:
    """All categories, each over the functions of the files that are relevant to it. files: path,
    content; bodies: path, function, line_no, text."""
    kinds = relevant_kinds(files).groupBy("path").agg(F.flatten(F.collect_set("kinds")).alias("kinds"))
    told = bodies.join(kinds, "path").groupBy("function").agg(F.sort_array(F.collect_list(F.struct("line_no", F.coalesce("text", F.lit("")).alias("text"), "kinds"))).alias("body"))
    # Nothing is tainted without a source.
    low = F.lower(F.array_join("body.text", "\n"))
    told = told.where(reduce(lambda a, b: a | b, (low.contains(s) for s in SOURCES)))

    def run(frames):
        for frame in frames:
            rows = []
            for name, body in zip(frame["function"], frame["body"]):
                for c in CATEGORIES:
                    lines = [x["text"] for x in body if c in x["kinds"]]
                    rows += [(name, c, CATEGORIES[c].cwe, *hit) for hit in flow(lines, c)]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in SCHEMA.split(", ")])

    return told.mapInPandas(run, SCHEMA)
