"""The rule registry: each detector is a function of a context to finding rows.

A context holds tables that a plan reads only if a chosen detector needs them. Line rules are
data; all chosen ones run in one pass over the lines. Thresholds are parameters with defaults."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import code
from . import graph, kernels, similarity, stats

COLUMNS = ["detector", "severity", "title", "file", "line_start", "line_end", "category", "cwe_id", "confidence"]
SCHEMA = "detector string, severity int, title string, file string, line_start int, line_end int, category string, cwe_id string, confidence double"
#: Default confidence by category.
CONFIDENCE = {"architecture": 0.85, "security": 0.75, "design": 0.65, "dead-code": 0.70, "ai": 0.60}
INPUT = r"(?i)\b(req(uest)?\.(body|query|params|args|form|json|cookies|headers|GET|POST)|sys\.argv|input\(|user_?input|params\[)"
PY, JS, RS = ("python",), ("javascript", "typescript"), ("rust",)
ANY: tuple[str, ...] = ()


@dataclass(frozen=True)
class LineRule:
    name: str
    languages: tuple[str, ...]
    pattern: str
    severity: int = 1
    category: str = "quality"
    cwe: str | None = None
    unless: str = ""
    near: tuple[str, int, int] | None = None
    lacks: tuple[str, int, int] | None = None
    masked: bool = True
    tests: bool = False


def _r(name, languages, pattern, severity=1, category="quality", cwe=None, **more):
    return LineRule(name, languages, pattern, severity, category, cwe, **more)


LINE_RULES = [
    _r("SQLInjectionDetector", ANY, r"(?i)(f\"|f'|`|\"|').*\b(select\s.+\sfrom|insert\s+into|update\s.+\sset|delete\s+from)\b.*(\{\w|\$\{|\"\s*\+|'\s*\+|%s?\"\s*%|\.format\()", 4, "security", "CWE-89", masked=False),
    _r("xss", JS, r"\.(innerHTML|outerHTML)\s*=[^=]|dangerouslySetInnerHTML|document\.write\(", 3, "security", "CWE-79", unless=r"(?i)sanitize|purify|escape"),
    _r("command-injection", ANY, r"(?i)\b(os\.system|os\.popen|subprocess\.\w+|child_process\.exec\w*|\bexecSync|Runtime\.getRuntime\(\)\.exec)\(", 4, "security", "CWE-78", near=(INPUT + r"|shell\s*=\s*True|\$\{|f\"|f'", 5, 2), masked=False),
    _r("ssrf", ANY, r"(?i)\b(requests\.(get|post|put|delete|head)|urllib\.request\.urlopen|axios(\.\w+)?|fetch|http\.Get)\(", 3, "security", "CWE-918", near=(INPUT, 20, 0)),
    _r("path-traversal", ANY, r"(?i)\b(open|readFile(Sync)?|createReadStream|os\.path\.join|path\.join|send_file|sendFile)\(", 3, "security", "CWE-22", near=(INPUT, 8, 1), unless=r"(?i)secure_filename|basename|realpath|normalize"),
    _r("SecretDetector", ANY, r"(?i)(api[_-]?key|secret|token|passw(or)?d)\s*[:=]\s*[\"'][A-Za-z0-9+/_\-]{12,}[\"']|AKIA[0-9A-Z]{16}|-----BEGIN [A-Z ]*PRIVATE KEY", 4, "security", "CWE-798", unless=r"(?i)example|placeholder|your[_-]|environ|getenv", masked=False),
    _r("insecure-crypto", ANY, r"(?i)\b(md5|sha1|des|rc4)\s*\(|createHash\(|hashlib\.(md5|sha1)|MODE_ECB|\bECB\b", 2, "security", "CWE-327", unless=r"(?i)checksum|etag|usedforsecurity\s*=\s*False|sha256|sha512"),
    _r("xxe", ANY, r"(?i)\b(etree\.(parse|fromstring|XMLParser)|minidom\.parse\w*|DocumentBuilderFactory|SAXParser|XmlReader)\b", 3, "security", "CWE-611", lacks=(r"(?i)resolve_entities\s*=\s*False|defusedxml|disallow-doctype|DtdProcessing\.Prohibit", 10, 2)),
    _r("prototype-pollution", JS, r"__proto__|\bconstructor\s*\[|(Object\.assign|_\.merge|\bmerge|\bextend)\(", 3, "security", "CWE-1321", near=(INPUT, 15, 0)),
    _r("InsecureTlsDetector", ANY, r"(?i)verify\s*=\s*False|rejectUnauthorized\s*:\s*false|InsecureSkipVerify\s*:\s*true|CERT_NONE|check_hostname\s*=\s*False", 3, "security", "CWE-295"),
    _r("CleartextCredentialsDetector", ANY, r"(?i)\b(log(ger)?\.\w+|print|console\.\w+|println!?)\(.*\b(password|passwd|secret|token|credential)", 3, "security", "CWE-312", unless=r"(?i)redact|mask|\*\*\*", masked=False),
    _r("nosql-injection", ANY, r"\.(find|findOne|aggregate|update(One|Many)?|deleteOne)\(|\$where|\$regex", 3, "security", "CWE-943", near=(INPUT, 10, 1)),
    _r("log-injection", ANY, r"(?i)\b(log(ger|ging)?|console)\.\w+\(", 1, "security", "CWE-117", near=(INPUT, 0, 0)),
    _r("insecure-deserialize", ANY, r"(?i)\b(pickle|marshal|shelve)\.loads?\(|yaml\.load\(|unserialize\(|ObjectInputStream", 3, "security", "CWE-502", near=(INPUT, 10, 1)),
    _r("cors-misconfig", ANY, r"(?i)access-control-allow-origin.{0,8}\*|origin\s*[:=]\s*[\"']\*[\"']|allow_origins\s*=\s*\[\s*[\"']\*", 2, "security", "CWE-942", masked=False),
    _r("jwt-weak", ANY, r"(?i)alg(orithm)?s?[\"']?\s*[:=]\s*\[?\s*[\"']none[\"']|verify(_signature)?[\"']?\s*[:=]\s*False", 4, "security", "CWE-347", near=(r"(?i)jwt|jose", 5, 5), masked=False),
    _r("django-security", PY, r"^\s*DEBUG\s*=\s*True|@csrf_exempt|ALLOWED_HOSTS\s*=\s*\[\s*[\"']\*|\.raw\(|\.extra\(", 2, "security", "CWE-16", masked=False),
    _r("GHActionsInjectionDetector", ("yaml",), r"\$\{\{\s*github\.(event\.[\w.]*(title|body|ref|message|name|email)|head_ref)", 3, "security", "CWE-78", near=(r"^\s*(-\s*)?run\s*:", 12, 0), masked=False),
    _r("EvalDetector", (*PY, *JS), r"(?<![\w.])(eval|exec)\(|new Function\(|shell\s*=\s*True", 3, "security", "CWE-95", unless=r"(?<![\w.])(eval|exec)\(\s*(''|\"\")\s*\)|literal_eval"),
    _r("PickleDeserializationDetector", PY, r"\b(pickle|cPickle|dill|joblib|cloudpickle)\.loads?\(|yaml\.load\((?!.*Safe)|np\.load\(.*allow_pickle\s*=\s*True", 3, "security", "CWE-502"),
    _r("UnsafeTemplateDetector", ANY, r"(?i)render_template_string\(|Markup\(|autoescape\s*=\s*False|\|\s*safe\b|v-html|mark_safe\(", 3, "security", "CWE-1336", masked=False),
    _r("insecure-cookie", ANY, r"(?i)\.(set_cookie|cookie)\(|set-cookie", 1, "security", "CWE-614", lacks=(r"(?i)http_?only|secure|samesite", 3, 15)),
    _r("insecure-random", ANY, r"(?i)\brandom\.(random|randint|choice|randrange)\(|Math\.random\(", 2, "security", "CWE-330", near=(r"(?i)token|password|secret|session|nonce|otp|salt", 5, 5), masked=False),
    _r("regex-dos", ANY, r"\([^()]*[+*][^()]*\)[+*]", 2, "security", "CWE-1333", near=(r"(?i)re\.(compile|match|search|sub|findall)|new RegExp|\.test\(|\.match\(", 1, 1), masked=False),
    _r("hardcoded-ips", ANY, r"\b(?!0\.0\.0\.0|127\.|255\.)(\d{1,3}\.){3}\d{1,3}\b|[\"']localhost:\d+", 0, "security", "CWE-1051", unless=r"(?i)version|mask|example", masked=False),
    _r("unhandled-promise", JS, r"\.then\(", 1, lacks=(r"\.catch\(|\btry\b|await\b|\breturn\b", 3, 20)),
    _r("empty-catch-block", ANY, r"except\b[^:]*:\s*(pass|\.\.\.)\s*$|catch\s*(\([^)]*\))?\s*\{\s*\}", 2),
    _r("broad-exception", PY, r"except\s*(\(?\s*(Base)?Exception\b[^:]*)?:", 1, lacks=(r"^\s*raise\b|log(ger|ging)?\.(exception|error)", 0, 4)),
    _r("implicit-coercion", JS, r"(?<![=!<>])(==|!=)(?!=)", 0, unless=r"(==|!=)\s*(null|undefined)|typeof"),
    _r("wildcard-imports", (*PY, "java", *RS), r"^\s*from\s+\S+\s+import\s+\*|^\s*import\s+[\w.]+\.\*;", 0, unless=r"prelude"),
    _r("string-concat-loop", (*PY, *JS), r"\w+\s*\+=\s*(''|f''|str\(|\w+\s*\+\s*'')", 1, near=(r"^\s*(for|while)\b", 6, 0)),
    _r("regex-in-loop", ANY, r"\bre\.(compile|match|search|sub|findall)\(|new RegExp\(|Regex::new\(|regexp\.MustCompile\(", 1, "performance", near=(r"^\s*(for|while|loop)\b", 5, 0)),
    _r("rust-unwrap-without-context", RS, r"\.unwrap\(\)|\.expect\(''\)", 1),
    _r("rust-unsafe-without-safety-comment", RS, r"\bunsafe\s*(\{|fn|impl)", 2, lacks=(r"(?i)//.*safety", 3, 0)),
    _r("rust-mutex-poisoning-risk", RS, r"\.lock\(\)\s*\.(unwrap|expect)\(", 1),
    _r("test-in-production", ANY, r"^\s*(import|from)\s+(unittest|pytest|mock)\b|\bdescribe\(|\bassertThat\(|require\(['\"](chai|jest)", 1, masked=False),
    _r("torch-load-unsafe", PY, r"torch\.load\((?!.*weights_only\s*=\s*True)", 3, "security", "CWE-502"),
    _r("nan-equality", ANY, r"(==|!=)\s*(np\.nan|float\(''\)|math\.nan|NaN|Number\.NaN)\b|\b(np\.nan|NaN)\s*(==|!=)", 2),
    _r("missing-zero-grad", PY, r"\.backward\(", 2, "ml", lacks=(r"zero_grad\(", 15, 15)),
    _r("forward-method", PY, r"(?<!super\(\))\.forward\(", 1, "ml"),
    _r("chain-indexing", PY, r"\w\[''\]\[''\]\s*=|\.loc\[[^\]]*\]\[''\]\s*=", 2, "ml"),
    _r("require-grad-typo", PY, r"\brequire_grad\b", 3, "ml"),
    _r("deprecated-torch-api", PY, r"torch\.(autograd\.Variable|symeig|qr|lstsq|ger|svd)\(|\.volatile\b|torch\.nn\.functional\.(tanh|sigmoid)\(", 1, "ml"),
    _r("hardcoded-timeout", ANY, r"(?i)\b(timeout|sleep|delay|wait)\w*\s*[=:(]\s*\d{4,}", 0),
    _r("rust-missing-must-use", RS, r"^\s*pub\s+fn\b.*->\s*(\w+::)*Result<", 0, lacks=(r"#\[must_use", 3, 0)),
    _r("todo-scanner", ANY, r"\b(TODO|FIXME|HACK|XXX)\b", 0, masked=False, tests=True),
    _r("single-char-names", ANY, r"^\s*(let\s+|const\s+|var\s+)?[a-hl-wyz]\s*=[^=]", 0, unless=r"lambda|\bfor\b"),
    _r("debug-code", ANY, r"^\s*(print|pprint|console\.(log|debug)|breakpoint|dbg!|println!)\s*\(|^\s*debugger\b|pdb\.set_trace", 0),
    _r("magic-numbers", ANY, r"(?<![\w.])(?!10\b|100\b|1000\b|60\b|24\b)\d{2,}(?![\w.])", 0, unless=r"^\s*([A-Z_]+\s*[:=]|const\s|#define|import|@)"),
    _r("boolean-trap", ANY, r"\((?=[^()]*\b(true|false|True|False)\b[^()]*\b(true|false|True|False)\b)", 0, unless=r"\w+\s*=\s*(True|False|true|false)"),
    _r("rust-box-dyn-trait", RS, r"Box<\s*dyn\b", 0),
    _r("react-hooks", JS, r"\buse[A-Z]\w*\(", 2, near=(r"^\s*(if|for|while|switch)\b", 3, 0)),
    _r("express-security", JS, r"\bexpress\(\)", 1, "security", "CWE-693", lacks=(r"helmet|rateLimit|csurf|cors\(", 60, 60)),
    _r("missing-await", (*PY, *JS), r"^\s*(?!return|await|const|let|var|yield)\w*(fetch|_async|Async)\w*\(", 1, unless=r"await|\.then|create_task|gather|async def|async function"),
    _r("sync-in-async", PY, r"\btime\.sleep\(|\brequests\.\w+\(|\bopen\(", 2, "performance", near=(r"^\s*async\s+def\b", 30, 0)),
    _r("n-plus-one", (*PY, *JS), r"\.(objects\.(get|filter)|query|execute|find_?[oO]ne|fetch_?[oO]ne)\(", 2, "performance", near=(r"^\s*(for|while)\b|\.(map|forEach)\(", 5, 0)),
    _r("infinite-loop", ANY, r"^\s*while\s*\(?\s*(True|true|1)\s*\)?\s*[:{]|^\s*loop\s*\{|^\s*for\s*\(\s*;\s*;\s*\)", 2, lacks=(r"\b(break|return|raise|throw|exit|panic!)\b", 0, 40)),
    _r("global-variables", (*PY, *JS), r"^\s*global\s+\w|^(var|let)\s+\w+\s*=|^[a-z_]\w*\s*=\s*(\[|\{|dict\(|list\(|set\()", 0, unless=r"^__"),
    _r("callback-hell", JS, r"^\s{12,}.*(function\s*\(|=>\s*\{|\.then\()", 1),
    _r("rust-clone-in-hot-path", RS, r"\.clone\(\)", 0, "performance", near=(r"^\s*(for|while|loop)\b|\.iter\(\)", 6, 0)),
    _r("missing-random-seed", PY, r"\.fit\(|train_test_split\(|DataLoader\(", 0, "ml", lacks=(r"(?i)seed|random_state", 400, 400)),
    _r("message-chain", ANY, r"(\.\w+\([^()]*\)){5,}", 1, "design", masked=True),
]


@dataclass
class Context:
    """Tables that detectors read. commits: hash, author, ts, age_days, file (may be missing)."""

    files: DataFrame
    commits: DataFrame | None = None
    options: dict = field(default_factory=dict)

    @cached_property
    def lines(self) -> DataFrame:
        return code.lines(self.files).where("not suppressed")

    @cached_property
    def functions(self) -> DataFrame:
        return code.functions(self.files)

    @cached_property
    def edges(self) -> DataFrame:
        return code.call_edges(self.functions)

    @cached_property
    def degree(self) -> DataFrame:
        ids = self.functions.select(F.col("qualified_name").alias("id"))
        return graph.fan_in_out(ids, self.edges).withColumnRenamed("id", "qualified_name")

    def option(self, detector: str, name: str, default):
        return self.options.get(detector, {}).get(name, default)


Detector = Callable[[Context], DataFrame]
REGISTRY: dict[str, Detector] = {}


def row(df: DataFrame, name: str, severity, title, line="line_start", end="line_end", path="path", category="quality", cwe=None) -> DataFrame:
    sev = severity if not isinstance(severity, int) else F.lit(severity)
    return df.select(F.lit(name).alias("detector"), sev.cast("int").alias("severity"), title.alias("title"), F.col(path).alias("file"), F.col(line).cast("int").alias("line_start"), F.col(end).cast("int").alias("line_end"), F.lit(category).alias("category"), F.lit(cwe).cast("string").alias("cwe_id"), F.lit(CONFIDENCE.get(category, 0.7)).alias("confidence"))


def detector(name: str):
    def add(f: Detector) -> Detector:
        REGISTRY[name] = f
        return f

    return add


def line_findings(lines: DataFrame, rules: list[LineRule]) -> DataFrame:
    """All matches of the rules in one pass; neighbourhoods share the lines' one ordering."""
    w = Window.partitionBy("path").orderBy("line_no")
    around: dict[tuple, str] = {}
    for r in rules:
        for n in (r.near, r.lacks):
            if n and n not in around:
                around[n] = f"_w{len(around)}"
    flagged = lines.withColumns({c: F.max(F.col("text").rlike(p)).over(w.rowsBetween(-a, b)) for (p, a, b), c in around.items()})
    hits = []
    for r in rules:
        test = F.col("code" if r.masked else "text").rlike(r.pattern)
        if r.unless:
            test = test & ~F.col("text").rlike(r.unless)
        if r.languages:
            test = F.col("language").isin(*r.languages) & test
        if not r.tests:
            test = ~F.col("test") & test
        if r.near:
            test = test & F.col(around[r.near])
        if r.lacks:
            test = test & ~F.col(around[r.lacks])
        hits.append(F.when(test, F.struct(F.lit(r.name).alias("detector"), F.lit(r.severity).alias("severity"), F.lit(r.category).alias("category"), F.lit(r.cwe).cast("string").alias("cwe_id"), F.lit(CONFIDENCE.get(r.category, 0.7)).alias("confidence"))))
    found = flagged.select("path", "line_no", F.substring(F.trim("text"), 1, 120).alias("text"), F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())).alias("h"))
    return found.select("h.detector", "h.severity", F.concat_ws(": ", "h.detector", "text").alias("title"), F.col("path").alias("file"), F.col("line_no").alias("line_start"), F.col("line_no").alias("line_end"), "h.category", "h.cwe_id", "h.confidence")


def loc():
    return F.expr("line_end - line_start + 1")


def _over(name, condition, title, severity=1, category="quality"):
    """A rule over one function row; a severity that depends on the row is given as a function."""
    REGISTRY[name] = lambda ctx: row(ctx.functions.where(condition(ctx)), name, severity if isinstance(severity, int) else severity(), F.concat(F.lit(f"{title}: "), F.col("name")), category=category)


_over("long-methods", lambda c: loc() > c.option("long-methods", "max_lines", 100), "Long function", lambda: F.when(loc() > 300, 3).when(loc() > 200, 2).otherwise(1))
_over("deep-nesting", lambda c: F.col("nesting") > c.option("deep-nesting", "max_depth", 5), "Deep nesting", 2)
_over("LongParameterListDetector", lambda c: F.size("params") > c.option("LongParameterListDetector", "max_params", 5), "Many parameters", lambda: F.when(F.size("params") > 10, 3).otherwise(1), "design")
_over("mutable-default-args", lambda c: F.col("mutable_defaults") > 0, "Mutable default argument", 2)
_over("inconsistent-returns", lambda c: (F.col("returns") > 0) & (F.col("bare_returns") > 0) & (loc() >= 3), "Inconsistent returns", 1)
_over("missing-docstrings", lambda c: ~F.col("has_doc") & ~F.col("name").rlike("^(_|test_)") & (loc() >= 5), "No docstring", 0)
_over("GeneratorMisuseDetector", lambda c: (F.col("yields") == 1) & (F.col("yields_in_loop") == 0) & ~F.exists("decorators", lambda d: d.rlike("contextmanager|fixture")), "Generator with a single yield", 0)


@detector("AIComplexitySpikeDetector")
def complexity_spike(ctx):
    z = stats.z_scores(ctx.functions, "complexity")
    return row(z.where("z >= 3 and complexity >= 20"), "AIComplexitySpikeDetector", 3, F.concat(F.lit("Complexity spike: "), F.col("name")), category="ai")


@detector("AINamingPatternDetector")
def generic_names(ctx):
    f = ctx.functions.withColumn("ids", F.array_distinct(F.concat("params", "stores"))).where("size(ids) >= 5")
    generic = F.size(F.filter("ids", lambda x: x.rlike(r"^(data|result|item|value|temp|tmp|obj|res|output|input|info|element|response|helper|handler)\d*$"))) / F.size("ids")
    return row(f.where(generic >= 0.4), "AINamingPatternDetector", 0, F.concat(F.lit("Generic names: "), F.col("name")), category="ai")


@detector("DeadStoreDetector")
def dead_stores(ctx):
    f = ctx.functions.select("path", "line_start", "line_end", "name", F.explode(F.array_except("stores", "reads")).alias("v")).where("not v rlike '^_'")
    return row(f, "DeadStoreDetector", 0, F.concat(F.lit("Assigned but never read: "), F.col("v")), category="dead-code")


@detector("UnusedImportsDetector")
def unused_imports(ctx):
    """Imported names that occur on no other line of their file."""
    py = ctx.lines.where("language = 'python'")
    names = py.where("code rlike '^\\\\s*(import|from)\\\\s'").select("path", "line_no", F.explode(F.regexp_extract_all(F.regexp_replace("code", r"^\s*from\s+\S+\s+import|^\s*import|\b\w+(\.\w+)*\s+as\b", ""), F.lit(r"[A-Za-z_]\w*"), F.lit(0))).alias("v"))
    used = py.where("not code rlike '^\\\\s*(import|from)\\\\s'").select("path", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Za-z_]\w*"), F.lit(0)))).alias("v")).distinct()
    return row(names.join(used, ["path", "v"], "left_anti"), "UnusedImportsDetector", 0, F.concat(F.lit("Unused import: "), F.col("v")), "line_no", "line_no", category="dead-code")


@detector("UnreachableCodeDetector")
def unreachable(ctx):
    """A line after return, raise, break or continue at the same or deeper indent."""
    w = Window.partitionBy("path").orderBy("line_no")
    ind = F.length(F.regexp_extract("text", r"^(\s*)", 1))
    py = ctx.lines.where("language = 'python' and trim(code) != ''").withColumn("ind", ind)
    py = py.withColumn("before", F.lag("code").over(w)).withColumn("was", F.lag("ind").over(w))
    return row(py.where(r"before rlike '^\\s*(return|raise|break|continue)\\b' and not before rlike '[\\[({,]\\s*$' and ind = was and not code rlike '^\\s*(elif|else|except|finally|case|[\\])}])'"), "UnreachableCodeDetector", 1, F.concat(F.lit("Unreachable: "), F.trim("text")), "line_no", "line_no", category="dead-code")


@detector("commented-code")
def commented_code(ctx):
    w = Window.partitionBy("path").orderBy("line_no")
    m = ctx.lines.where(r"text rlike '^\\s*(#|//)\\s*(if|for|while|return|import|from|def|let|const|var|\\w+\\s*=|\\w+\\()'")
    g = m.withColumn("g", F.col("line_no") - F.row_number().over(w)).groupBy("path", "g").agg(F.min("line_no").alias("line_start"), F.max("line_no").alias("line_end"), F.count(F.lit(1)).alias("n"))
    return row(g.where("n >= 5"), "commented-code", 0, F.lit("Commented-out code"))


@detector("large-files")
def large_files(ctx):
    g = ctx.lines.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    return row(g.where(F.col("n") > ctx.option("large-files", "max_lines", 800)).withColumn("one", F.lit(1)), "large-files", 1, F.concat(F.lit("Large file: "), F.col("n").cast("string")), "one", "n")


@detector("rust-panic-density")
def panic_density(ctx):
    m = ctx.lines.where("language = 'rust' and not test").withColumn("k", F.size(F.regexp_extract_all("code", F.lit(r"\.unwrap\(\)|\.expect\(|panic!"), F.lit(0))))
    g = m.groupBy("path").agg(F.sum("k").alias("k"), F.max("line_no").alias("n")).where("k >= 10").withColumn("one", F.lit(1))
    return row(g, "rust-panic-density", 1, F.concat(F.lit("Panics: "), F.col("k").cast("string")), "one", "n")


@detector("duplicate-code")
def duplicate_code(ctx):
    w = Window.partitionBy("path").orderBy("line_no")
    kept = ctx.lines.where("trim(code) != ''").withColumn("code", F.trim("code"))
    runs = kept.withColumn("run", F.array_join(F.collect_list("code").over(w.rowsBetween(0, 5)), "\n")).withColumn("last", F.lead("line_no", 5).over(w)).where("last is not null and length(run) > 80")
    many = runs.groupBy("run").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    hit = runs.join(many, "run")
    # Of runs that continue each other only the first is reported.
    gap = hit.withColumn("before", F.lag("line_no").over(w)).where("before is null or line_no > before + 1")
    return row(gap, "duplicate-code", 1, F.lit("Duplicated block"), "line_no", "last")


@detector("AIDuplicateBlockDetector")
def similar_functions(ctx):
    """Functions whose sets of calls, reads and stores are at least 0.7 alike."""
    f = ctx.functions.withColumn("text", F.array_join(F.concat("calls", "reads", "stores"), " ")).where("size(reads) >= 8")
    ids = f.select(F.xxhash64("qualified_name").alias("doc_id"), "text", "path", "name", "line_start", "line_end")
    pairs = similarity.minhash_pairs(ids.select("doc_id", "text"), 0.7, 1)
    j = pairs.join(ids.select(F.col("doc_id").alias("b"), "path", "name", "line_start", "line_end"), "b")
    return row(j, "AIDuplicateBlockDetector", 1, F.concat(F.lit("Near-identical function: "), F.col("name")), category="ai")


def _with_degree(ctx):
    return ctx.functions.join(ctx.degree, "qualified_name")


@detector("DegreeCentralityDetector")
def degree(ctx):
    d = _with_degree(ctx)
    total = F.col("fan_in") + F.col("fan_out")
    hit = d.where(((total >= 100) & (F.col("fan_in") >= 25) & (F.col("fan_out") >= 25)) | (total >= 70))
    return row(hit, "DegreeCentralityDetector", F.when(total >= 100, 3).otherwise(2), F.concat(F.lit("Hub: "), F.col("name")), category="architecture")


@detector("DeadCodeDetector")
def dead_code(ctx):
    d = _with_degree(ctx).where("fan_in = 0 and size(decorators) = 0 and not name rlike '^(__.*__|main|test_.*|setup|teardown|handle.*|on_.*)$'")
    said = ctx.lines.select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Za-z_]\w*"), F.lit(0)))).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    hit = d.join(said, "name", "left_anti").where(~code.is_test(F.col("path")))
    return row(hit, "DeadCodeDetector", 1, F.concat(F.lit("Unused function: "), F.col("name")), category="dead-code")


@detector("AIMissingTestsDetector")
def missing_tests(ctx):
    tests = ctx.functions.where(code.is_test(F.col("path")) | F.col("name").rlike("^test_")).select(F.col("qualified_name").alias("id"))
    seen = graph.breadth_first(ctx.edges, tests, 5).select(F.col("id").alias("qualified_name"))
    hit = ctx.functions.where((F.col("complexity") >= 5) & ~F.col("name").rlike("^_") & ~code.is_test(F.col("path"))).join(seen, "qualified_name", "left_anti")
    return row(hit, "AIMissingTestsDetector", 1, F.concat(F.lit("Not reached by tests: "), F.col("name")), category="ai")


def _numbered(ctx):
    """Call edges with numeric ids for the kernels, and the ids' functions."""
    ids = ctx.functions.drop("id").select(F.xxhash64("qualified_name").alias("id"), "*")
    return ctx.edges.select(F.xxhash64("src").alias("src"), F.xxhash64("dst").alias("dst")), ids


@detector("MutualRecursionDetector")
def mutual_recursion(ctx):
    e, ids = _numbered(ctx)
    c = graph.strong_components(e)
    size = c.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    hit = ids.join(c, "id").join(size, "component").where("n >= 4 or complexity >= 20 or n >= 2 and complexity >= 1")
    return row(hit, "MutualRecursionDetector", F.when(F.col("n") >= 6, 2).otherwise(1), F.concat(F.lit("Mutual recursion: "), F.col("name")), category="architecture")


@detector("StructuralBridgeRiskDetector")
def bridge_risk(ctx):
    e, ids = _numbered(ctx)
    return row(ids.join(kernels.articulation_points(e), "id"), "StructuralBridgeRiskDetector", 1, F.concat(F.lit("Articulation point: "), F.col("name")), category="architecture")


@detector("SinglePointOfFailureDetector")
def single_point(ctx):
    e, ids = _numbered(ctx)
    t = kernels.dominated_counts(e).where("n >= 50 or n >= 0.05 * live and n >= 3")
    return row(ids.join(t, "id"), "SinglePointOfFailureDetector", 2, F.concat(F.lit("Dominates "), F.col("n").cast("string"), F.lit(" functions: "), F.col("name")), category="architecture")


@detector("InfluentialCodeDetector")
def influential(ctx):
    e, ids = _numbered(ctx)
    rank = graph.page_rank(ids.select("id"), e, tolerance=0.0)
    p = stats.percentile_bucket(rank, "rank", "p")
    hit = ids.join(p.where("p >= 90"), "id").where((F.col("complexity") >= 15) | (loc() >= 100))
    return row(hit, "InfluentialCodeDetector", 1, F.concat(F.lit("Influential and complex: "), F.col("name")), category="architecture")


@detector("GodClassDetector")
def god_class(ctx):
    g = ctx.functions.where("class_name is not null").groupBy("path", "class_name").agg(F.count(F.lit(1)).alias("methods"), F.sum("complexity").alias("complexity"), F.min("line_start").alias("line_start"), F.max("line_end").alias("line_end"))
    hit = g.where((F.col("methods") > 20) | (loc() > 500) | (F.col("complexity") > 100))
    return row(hit, "GodClassDetector", F.when(F.col("methods") > 30, 4).otherwise(3), F.concat(F.lit("God class: "), F.col("class_name")), category="design")


@detector("MiddleManDetector")
def middle_man(ctx):
    g = ctx.functions.where("class_name is not null and not name rlike '^__'").groupBy("path", "class_name").agg(F.count(F.lit(1)).alias("methods"), F.avg(((F.size("calls") == 1) & (F.col("complexity") <= 2) & (loc() <= 4)).cast("int")).alias("share"), F.min("line_start").alias("line_start"), F.max("line_end").alias("line_end"))
    return row(g.where("methods >= 3 and share >= 0.7"), "MiddleManDetector", 1, F.concat(F.lit("Delegates most methods: "), F.col("class_name")), category="design")


@detector("DataClumpsDetector")
def data_clumps(ctx):
    """Groups of four parameter names that at least five functions share: an inverted index of the
    4-subsets of those names that five functions have at all."""
    p = ctx.functions.select("qualified_name", "path", "line_start", "line_end", F.explode(F.array_distinct("params")).alias("p"))
    common = p.groupBy("p").agg(F.count(F.lit(1)).alias("n")).where("n >= 5").select("p")
    f = p.join(common, "p").groupBy("qualified_name", "path", "line_start", "line_end").agg(F.array_sort(F.collect_list("p")).alias("p")).where("size(p) >= 4")
    four = "flatten(flatten(flatten(transform(p, (a, i) -> transform(slice(p, i + 2, size(p)), (b, j) -> transform(slice(p, i + j + 3, size(p)), (c, k) -> transform(slice(p, i + j + k + 4, size(p)), d -> concat_ws(',', a, b, c, d))))))))"
    x = f.select("path", "line_start", "line_end", F.explode(F.expr(four)).alias("clump"))
    g = x.groupBy("clump").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("path", "line_start", "line_end")).alias("m")).where("n >= 5")
    return row(g.select("clump", "m.path", "m.line_start", "m.line_end"), "DataClumpsDetector", 1, F.concat(F.lit("Parameters that travel together: "), F.col("clump")), category="design")


def _temporal(name, build, severity=1, title="", category="architecture"):
    """A rule over commit tables; empty without commits."""

    def run(ctx):
        from . import temporal

        if ctx.commits is None:
            return ctx.files.sparkSession.createDataFrame([], SCHEMA)
        df = build(ctx, temporal).withColumn("none", F.lit(None).cast("int"))
        return row(df, name, severity, F.concat(F.lit(f"{title}: "), F.col("file")), "none", "none", "file", category)

    REGISTRY[name] = run


_temporal("OrphanedKnowledgeDetector", lambda c, t: t.ownership(c.commits).where("norm > 0.75 and doa > 3.293").groupBy("file").agg(F.min("last_age").alias("a")).where("a > 180"), 1, "No active owner")
_temporal("KnowledgeSiloDetector", lambda c, t: t.bus_factor(t.ownership(c.commits)).withColumn("m", F.regexp_extract("file", "^(.*)/", 1)).groupBy("m").agg(F.avg("hhi").alias("h"), F.count(F.lit(1)).alias("n")).where("h > 0.65 and n >= 2").withColumnRenamed("m", "file"), 1, "Concentrated ownership")
_temporal("SingleOwnerModuleDetector", lambda c, t: t.bus_factor(t.ownership(c.commits)).withColumn("m", F.regexp_extract("file", "^(.*)/", 1)).groupBy("m").agg(F.max("bus_factor").alias("b"), F.count(F.lit(1)).alias("n")).where("b <= 1 and n >= 3").withColumnRenamed("m", "file"), 1, "One owner for all files")
_temporal("AIChurnDetector", lambda c, t: t.fix_velocity(c.commits).where("within_48h >= 3"), 2, "Fixed again and again", "ai")
_temporal("HiddenCouplingDetector", lambda c, t: t.confidence(t.pairs(t.analysed(c.commits)), t.file_totals(t.analysed(c.commits))).where("n >= 3 and confidence >= 0.15 and weight >= 1.0").withColumnRenamed("a", "file"), 1, "Changes together with another file")
_temporal("ShotgunSurgeryDetector", lambda c, t: t.coupling_degree(t.analysed(c.commits)).where("degree >= 10"), 2, "Changes spread widely")


@detector("CircularDependencyDetector")
def circular_imports(ctx):
    """Strong components of imports between Python files; a module name is matched by its last part
    where only one file has it. Imports under a type-checking guard don't count."""
    stem = F.regexp_extract("path", r"([^/]+)\.py$", 1)
    py = ctx.lines.where("language = 'python'")
    one = py.select("path", stem.alias("module")).distinct().where("module not in ('', '__init__')").groupBy("module").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("target")).where("n = 1").drop("n")
    guarded = F.coalesce(F.lag("code").over(Window.partitionBy("path").orderBy("line_no")).rlike(r"^\s*if\s+(typing\.)?TYPE_CHECKING"), F.lit(False))
    said = py.withColumn("guarded", guarded).where(r"not guarded and code rlike '^\\s*(import|from)\\s'").select("path", F.regexp_extract("code", r"^\s*(?:import|from)\s+(?:[\w.]*\.)?(\w+)", 1).alias("module"))
    e = said.join(one, "module").where("path != target").select(F.xxhash64("path").alias("src"), F.xxhash64("target").alias("dst"), "path").distinct()
    c = graph.strong_components(e.select("src", "dst").distinct())
    g = e.join(c, F.col("src") == F.col("id")).groupBy("component").agg(F.countDistinct("path").alias("n"), F.min("path").alias("path")).withColumn("none", F.lit(None).cast("int"))
    return row(g, "CircularDependencyDetector", F.when(F.col("n") >= 10, 4).when(F.col("n") >= 5, 3).otherwise(2), F.concat(F.lit("Import cycle of "), F.col("n").cast("string"), F.lit(" files")), "none", "none", category="architecture")


def _ranked(ctx, weighted):
    e, ids = _numbered(ctx)
    if weighted:
        e = e.join(ids.select(F.col("id").alias("dst"), (1.0 + F.col("complexity")).alias("w")), "dst")
    return graph.page_rank(ids.select("id"), e, tolerance=0.0, weight="w" if weighted else None), ids


@detector("PageRankDriftDetector")
def rank_drift(ctx):
    plain, ids = _ranked(ctx, False)
    heavy, _ = _ranked(ctx, True)
    p, q = stats.percentile_bucket(plain, "rank", "p").select("id", "p"), stats.percentile_bucket(heavy, "rank", "q").select("id", "q")
    return row(ids.join(p, "id").join(q, "id").where("abs(p - q) > 60 and (p >= 50 or q >= 50)"), "PageRankDriftDetector", 1, F.concat(F.lit("Rank drift: "), F.col("name")), category="architecture")


def _central(ctx, weighted):
    e, ids = _numbered(ctx)
    total = ids.count()
    if weighted:
        e = e.join(ids.select(F.col("id").alias("dst"), (1.0 + F.col("complexity")).alias("w")), "dst")
        return kernels.weighted_betweenness(e, ids.select("id").orderBy("id").limit(200), total), ids
    return kernels.betweenness(e, ids.select("id").orderBy("id").limit(min(total, max(64, total // 4)))), ids


@detector("ArchitecturalBottleneckDetector")
def bottleneck(ctx):
    b, ids = _central(ctx, False)
    hit = ids.join(stats.percentile_bucket(b, "betweenness", "p").where("p >= 95"), "id").where("complexity > 20")
    return row(hit, "ArchitecturalBottleneckDetector", 2, F.concat(F.lit("Bottleneck: "), F.col("name")), category="architecture")


@detector("TemporalBottleneckDetector")
def temporal_bottleneck(ctx):
    w, ids = _central(ctx, True)
    b, _ = _central(ctx, False)
    p, q = stats.percentile_bucket(w, "betweenness", "p").select("id", "p"), stats.percentile_bucket(b, "betweenness", "q").select("id", "q")
    hit = ids.join(p, "id").join(q, "id", "left").where("p >= 97 and p - coalesce(q, 0) >= 20")
    return row(hit, "TemporalBottleneckDetector", 2, F.concat(F.lit("On the path of change: "), F.col("name")), category="architecture")


def _communities(ctx):
    e, ids = _numbered(ctx)
    c = kernels.community_table(e).checkpoint()
    return e, ids.withColumn("folder", F.regexp_extract("path", "^(.*)/", 1)).join(c, "id")


@detector("CommunityMisplacementDetector")
def misplaced(ctx):
    _, n = _communities(ctx)
    most = n.groupBy("folder", "community").agg(F.count(F.lit(1)).alias("k")).groupBy("folder").agg(F.max(F.struct("k", "community")).alias("m"), F.sum("k").alias("total"))
    hit = n.join(most, "folder").where("community != m.community and m.k * 2 > total")
    return row(hit, "CommunityMisplacementDetector", 1, F.concat(F.lit("Belongs elsewhere: "), F.col("name")), category="architecture")


@detector("ModuleCohesionDetector")
def module_cohesion(ctx):
    e, n = _communities(ctx)
    q = graph.modularity(e, n, "folder").where("modularity < 0.2").withColumn("none", F.lit(None).cast("int")).withColumn("path", F.lit("."))
    return row(q, "ModuleCohesionDetector", 1, F.concat(F.lit("Folders don't match calls: modularity "), F.round("modularity", 3).cast("string")), "none", "none", category="architecture")


_temporal("CriticalPathSingleOwnerDetector", lambda c, t: _single_owner_critical(c, t), 2, "One owner on a critical path")


def _single_owner_critical(ctx, t):
    rank, ids = _ranked(ctx, False)
    top = stats.percentile_bucket(rank, "rank", "p").where("p >= 90").select("id")
    files = ids.join(top, "id").select(F.col("path").alias("file")).distinct()
    return t.bus_factor(t.ownership(ctx.commits)).where("bus_factor <= 1").join(files, "file", "left_semi")


@detector("DepAuditDetector")
def dependency_audit(ctx):
    """Pinned dependencies listed in an advisory table (ecosystem, name, version, advisory) that the
    caller gives as option `advisories`, with `lock_files` (path, content); empty without."""
    known, files = ctx.option("DepAuditDetector", "advisories", None), ctx.option("DepAuditDetector", "lock_files", None)
    empty = ctx.files.limit(0).select("path", F.lit("").alias("advisory"), F.lit(None).cast("int").alias("none"))
    if known is None or files is None:
        return row(empty, "DepAuditDetector", 3, F.col("advisory"), "none", "none", category="security", cwe="CWE-1104")
    hit = code.lock_entries(files).join(known, ["ecosystem", "name", "version"]).select(F.concat_ws("@", "name", "version").alias("path"), "advisory", F.lit(None).cast("int").alias("none"))
    return row(hit, "DepAuditDetector", 3, F.concat(F.lit("Known vulnerability: "), F.col("advisory")), "none", "none", category="security", cwe="CWE-1104")


def _class_calls(ctx):
    f = ctx.functions
    own = f.select(F.col("qualified_name").alias("src"), F.col("class_name").alias("a"), F.col("path").alias("from_path"))
    to = f.select(F.col("qualified_name").alias("dst"), F.col("class_name").alias("b"), F.col("path").alias("to_path"))
    return ctx.edges.join(own, "src").join(to, "dst")


@detector("FeatureEnvyDetector")
def feature_envy(ctx):
    g = _class_calls(ctx).where("a is not null").groupBy("src").agg(F.sum((F.col("b").isNotNull() & (F.col("a") != F.col("b"))).cast("int")).alias("away"), F.sum((F.col("a") == F.col("b")).cast("int")).alias("home"))
    hit = ctx.functions.join(g.where("away >= 15 and away >= 3 * greatest(coalesce(home, 0), 1)").withColumnRenamed("src", "qualified_name"), "qualified_name")
    return row(hit, "FeatureEnvyDetector", 2, F.concat(F.lit("Uses other classes more than its own: "), F.col("name")), category="design")


@detector("InappropriateIntimacyDetector")
def intimacy(ctx):
    g = _class_calls(ctx).where("from_path != to_path").groupBy(F.least("from_path", "to_path").alias("path"), F.greatest("from_path", "to_path").alias("other")).agg(F.sum((F.col("from_path") < F.col("to_path")).cast("int")).alias("there"), F.sum((F.col("from_path") > F.col("to_path")).cast("int")).alias("back"))
    total = F.col("there") + F.col("back")
    hit = g.where((F.least("there", "back") >= 8) | (total >= 20)).withColumn("none", F.lit(None).cast("int"))
    return row(hit, "InappropriateIntimacyDetector", F.when(total >= 40, 3).otherwise(2), F.concat(F.lit("Tightly coupled with "), F.col("other")), "none", "none", category="design")


@detector("LazyClassDetector")
def lazy_class(ctx):
    m = ctx.functions.where("class_name is not null and not name rlike '^__'").select("path", "class_name", "name", F.size("params").alias("arity"), "line_start", "line_end")
    small = m.groupBy("path", "class_name").agg(F.count(F.lit(1)).alias("methods"), F.min("line_start").alias("line_start"), F.max("line_end").alias("line_end")).where("methods <= 5")
    own = m.join(small.select("path", "class_name"), ["path", "class_name"], "left_semi")
    other = m.select(F.col("path").alias("p2"), F.col("class_name").alias("c2"), "name", "arity").distinct()
    same = own.join(other, ["name", "arity"]).where("path != p2 or class_name != c2").groupBy("path", "class_name", "p2", "c2").agg(F.countDistinct("name").alias("k")).where("k >= 3").groupBy("path", "class_name").agg(F.min("c2").alias("c2"))
    return row(small.join(same, ["path", "class_name"]), "LazyClassDetector", 0, F.concat(F.lit("Overlaps with "), F.col("c2"), F.lit(": "), F.col("class_name")), category="design")


@detector("RefusedBequestDetector")
def refused_bequest(ctx):
    head = r"^\s*class\s+(\w+)\s*\(\s*([\w.]+)"
    child = ctx.lines.where("language = 'python'").select("path", F.regexp_extract("code", head, 1).alias("class_name"), F.regexp_extract("code", head, 2).alias("parent")).where("class_name != '' and not parent rlike '(?i)base|abstract|mixin|^object$|enum|exception|error'")
    g = ctx.functions.where("class_name is not null").groupBy("path", "class_name").agg(F.count(F.lit(1)).alias("methods"), F.sum(((F.col("complexity") <= 2) & (loc() <= 5) & (F.size("calls") == 0)).cast("int")).alias("trivial"), F.min("line_start").alias("line_start"), F.max("line_end").alias("line_end"))
    return row(g.where("methods >= 3 and trivial >= 2").join(child, ["path", "class_name"]), "RefusedBequestDetector", 1, F.concat(F.lit("Inherits but overrides with little: "), F.col("class_name")), category="design")


@detector("AIBoilerplateDetector")
def boilerplate(ctx):
    shape = ["complexity", "nesting", "returns", "bare_returns", "yields", F.size("params").alias("arity"), F.array_sort(F.array_distinct("calls")).alias("called")]
    f = ctx.functions.where("complexity >= 2 and size(calls) >= 2").select("path", "line_start", "line_end", "name", *shape)
    g = f.groupBy("complexity", "nesting", "returns", "bare_returns", "yields", "arity", "called").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("path", "line_start", "line_end", "name")).alias("m")).where("n >= 3")
    return row(g.select("n", "m.*"), "AIBoilerplateDetector", 1, F.concat(F.col("n").cast("string"), F.lit(" functions like "), F.col("name")), category="ai")


@detector("surprisal")
def surprisal(ctx):
    """Functions whose mean bits a token under a trigram model of the tree are 2 deviations up."""
    t = F.regexp_extract_all(F.lower("code"), F.lit(r"[a-z_]\w*|\d+|[^\s\w]"), F.lit(0))
    d = ctx.lines.select(F.xxhash64("path").alias("doc_id"), F.col("line_no").cast("long").alias("line_no"), t.alias("tokens"))
    bits = stats.trigram_surprisal(d).where("bits > 0")
    named = ctx.functions.select("path", "name", "line_start", "line_end").distinct()
    # Each span once, whatever the number of its functions; merged, as repeats compress well below their size in memory.
    spans = named.select("path", "line_start", "line_end").distinct().select(F.xxhash64("path").alias("doc_id"), "*", F.explode(F.sequence(F.col("line_start").cast("long"), F.col("line_end").cast("long"))).alias("line_no"))
    mean = spans.hint("merge").join(bits.hint("merge"), ["doc_id", "line_no"]).groupBy("path", "line_start", "line_end").agg(F.avg("bits").alias("bits"))
    g = named.hint("merge").join(mean.hint("merge"), ["path", "line_start", "line_end"])
    z = stats.z_scores(g, "bits").where("z >= 2")
    return row(z, "surprisal", F.when(F.col("z") >= 3.5, 2).when(F.col("z") >= 2.5, 1).otherwise(0), F.concat(F.lit("Unusual code: "), F.col("name")))


@detector("hierarchical-surprisal")
def hierarchical(ctx):
    """Functions that stand out on at least two of four levels; more agreement is more severe."""
    f = _with_degree(ctx).withColumn("loc", loc())
    if f.limit(20).count() < 20:
        f = f.limit(0)
    levels = {"complexity": 2.5, "loc": 2.0, "fan_in": 2.0, "fan_out": 2.0}
    for c in levels:
        f = stats.z_scores(f, c).withColumnRenamed("z", f"z_{c}")
    agree = sum(((F.col(f"z_{c}") >= t).cast("int") for c, t in levels.items()), F.lit(0))
    return row(f.withColumn("k", agree).where("k >= 2"), "hierarchical-surprisal", F.least(F.lit(3), F.col("k") - 1), F.concat(F.lit("Stands out on several levels: "), F.col("name")))


def names() -> list[str]:
    return sorted({r.name for r in LINE_RULES} | set(REGISTRY))


def detect(ctx: Context, only: list[str] | None = None, disabled: list[str] | None = None) -> DataFrame:
    """Findings of the chosen detectors (all if `only` is None), one union; all line rules share a pass.
    A rule whose graph is beyond its kernel's limit reports that instead of its findings."""
    chosen = [n for n in (names() if only is None else only) if n not in set(disabled or ())]
    parts = [ctx.files.sparkSession.createDataFrame([], SCHEMA)]
    if rules := [r for r in LINE_RULES if r.name in chosen]:
        parts.append(line_findings(ctx.lines, rules))
    for n in chosen:
        if n in REGISTRY:
            try:
                parts.append(REGISTRY[n](ctx))
            except kernels.TooLarge as beyond:
                parts.append(ctx.files.sparkSession.createDataFrame([(n, 0, f"Not run: {beyond}", None, None, None, "architecture", None, 1.0)], SCHEMA))
    found = reduce(lambda a, b: a.unionByName(b), [p.select(*COLUMNS) for p in parts])
    return found.select(F.xxhash64("detector", "file", F.coalesce("line_start", F.lit(0)), "title").alias("id"), *COLUMNS)
