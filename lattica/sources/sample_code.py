"""A code base as projections of the test tables: source files built line by line from documents,
facts of functions from parts, call edges from line items and commits from orders, each with the
same projection as SQL. Detectors run on these whole tables where no source tree is at hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import projection as P

#: Lines that files are made of, by language. They hold what rules look for, and near misses.
POOLS = {
    "python": [
        "import os", "import json, sys", "from utils import *", "from typing import List, Dict", "import numpy as np", "def load(path):", "class C1(Widget):", "class C3(Shape):", "class C2(BaseThing):", "class C3(Shape):",
        '    query = f"select name from users where id = {uid}"', '    rows = conn.execute("select 1")', '    os.system("rm " + request.args["p"])', "    subprocess.run(cmd, shell=True)", '    subprocess.run(["ls"])',
        "    r = requests.get(url)", '    url = request.args.get("u")', "    f = open(name)", "    f = open(secure_filename(name))", '    api_key = "sk_live_ABCDEF1234567890"', '    token = "your_token_placeholder_x"',
        "    h = hashlib.md5(data)", "    h = md5(data)  # etag", "    tree = etree.parse(src)", "    parser = XMLParser(resolve_entities=False)", "    requests.post(url, verify=False)", '    logger.info("password %s", password)',
        '    print("token ***", token)', "    db.find(q)", "    obj = pickle.loads(body)", "    obj = yaml.load(text, Loader=SafeLoader)", "    obj = yaml.load(text)", '    resp.headers["Access-Control-Allow-Origin"] = "*"',
        '    jwt.decode(t, options={"verify_signature": False})', "    DEBUG = True", "@csrf_exempt", "    q = Model.objects.raw(sql)", "    result = eval(expr)", "    value = ast.literal_eval(expr)", "    model = torch.load(path)",
        "    model = torch.load(path, weights_only=True)", "    html = render_template_string(t)", '    resp.set_cookie("a", b)', '    resp.set_cookie("a", b, secure=True)', "    x = random.randint(1, 6)", "    session_token = make()",
        '    p = re.compile(r"(a+)+b")', '    host = "192.168.10.5"', '    host = "127.0.0.1"', '    version = "1.2.3.4"', "    try:", "    except: pass", "    except Exception as e:", "    except ValueError:", "        raise", "        logger.exception(e)",
        "    for i in range(10):", "    while True:", "        break", '        s += str(i)', "        m = re.match(p, s)", "import pytest", "    if x == np.nan:", "    loss.backward()", "    opt.zero_grad()", "    y = layer.forward(x)",
        "    y = super().forward(x)", '    df["a"]["b"] = 1', "    w.require_grad = True", "    v = torch.autograd.Variable(x)", "    time.sleep(5000)", "    # TODO: tidy up", "    b = 3", "    print(value)", "    pdb.set_trace()",
        "    retries = 42", "    LIMIT = 77", "    call(True, False)", "    call(a=True, b=False)", "    fetch_async(job)", "    await fetch_async(job)", "async def run():", "    time.sleep(1)", "    user = User.objects.get(id=i)", "    global state",
        "cache = {}", "    clf.fit(x, y)", "    random_state = 7", "    a.b().c().d().e().f()", "    return value", "    # x = compute(1)", "    # if ready:", "    # return x", "    # for a in b:", "    # import os", "    logging.info(request.args)",
        "    x = 1  # lint:ignore", "# lint:ignore-file", "from p1.m8 import load", "import p2.m9", "import p3.m10", "from p2.m16 import run", "import p3.m17", "from p4.m18 import x", "    return None", "    total = add(total, value)",
    ],
    "javascript": [
        "el.innerHTML = data", "el.innerHTML = sanitize(data)", "document.write(x)", "child_process.exec(`ls ${dir}`)", "child_process.exec(cmd)", "const u = req.query.url", "fetch(u)", "fs.readFile(path.join(a, b))", "Object.assign(t, req.body)",
        "obj.__proto__ = x", "tls.connect({ rejectUnauthorized: false })", 'console.log("secret", secret)', "users.findOne({ name: req.body.name })", "logger.info(req.query.q)", "const c = { origin: '*' }", "jwt.verify(t, k, { algorithms: ['none'] })",
        "const f = new Function(code)", "eval(code)", "eval('')", 'res.cookie("a", b)', "const o = { httpOnly: true }", "const id = Math.random()", "const nonce = id", 'new RegExp("(a+)+")', 'const host = "localhost:3000"', "p.then(x => y)",
        "p.then(x => y).catch(e)", "try {", "} catch (e) {}", "} catch (e) { log(e) }", "if (a == b) {", "if (a == null) {", "if (a === b) {", "for (const x of xs) {", "  s += f(x) + 'a'", "  new RegExp(x)", "describe('x', () => {",
        "const chai = require('chai')", "if (v !== 3) {", "if (v == NaN) {", "setTimeout(f, 5000)", "wait(30000)", "// FIXME later", "let b = 3", "console.log(x)", "debugger", "const size = 1234", "run(true, false)", "useEffect(() => {}, [])",
        "  if (ok) {", "const app = express()", "app.use(helmet())", "loadAsync(x)", "await loadAsync(x)", "  db.query(sql)", "xs.map(x => x.id)", "while (true) {", "  break", "var state = 1", "               cb(function (err) {",
        "a.b().c().d().e().f()", "// const x = 1", "// if (x) {", "// return x", "import x from './x'", "}", "  return 1", "x = 24 + y", "x = y + 365", "// lint:ignore", "const w = a * b", "export default w",
    ],
    "rust": [
        "let v = map.get(k).unwrap();", 'let v = map.get(k).expect("");', "let v = m.lock().unwrap();", "unsafe { f() }", "// SAFETY: checked", "unsafe fn g() {", "pub fn f() -> Result<u8, E> {", "#[must_use]", "for x in xs.iter() {",
        "let y = x.clone();", "fn h(b: Box<dyn Error>) {", "loop {", "break;", 'panic!("no")', "use std::io::prelude::*;", 'Regex::new("a+").unwrap();', 'println!("{}", x);', "dbg!(x);", "let n = 250;", "// TODO fix", "return x;", "}", "let z = n + 1;",
    ],
    "yaml": ["name: ci", "    - run: echo ${{ github.event.issue.title }}", "      run: |", "        echo ${{ github.head_ref }}", "  TOKEN: abc", "  # FIXME", "  # on = push", "  # if ready", "  # import base", "  # run(x)", "  # let a", "  # var = 2"],
    "java": [
        "import java.util.*;", 'Runtime.getRuntime().exec(cmd + "${x}");', "DocumentBuilderFactory f = x;", "ObjectInputStream in = s;", "assertThat(x).isTrue();", 'String h = request.params("x");', "int size = 4096;", "while (true) {", "break;",
        "catch (Exception e) {}", "return x;", "int total = 0;", "for (;;) {", "s.md5(x);", "run(true, false);", "}",
    ],
}
#: Language of a file by doc_id % 8, and the file extension.
BY_REST = ["python", "python", "python", "javascript", "typescript", "rust", "yaml", "java"]
ENDING = {"python": "py", "javascript": "js", "typescript": "ts", "rust": "rs", "yaml": "yml", "java": "java"}
POOLS["typescript"] = POOLS["javascript"]
#: Function files, and the names that parameters, reads and stores take.
FILES = 35
PARAMS = ["alpha", "beta", "gamma", "delta", "data", "count", "limit", "path", "mode", "key", "value", "flag"]
NAMES = ["data", "result", "item", "total", "value", "tmp", "score", "obj", "res", "count", "_skip", "index", "width", "height", "info"]


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _case(values: dict) -> str:
    return "CASE " + " ".join(f"WHEN {k} THEN {v}" for k, v in values.items()) + " END"


PATH = "CASE WHEN x % 20 = 19 THEN 'tests/test_m' ELSE concat('src/p', cast(x % 7 AS string), '/m') END"


def files(spark, sf_dir):
    """path, language, content: one source file for each document."""
    d = P.table(spark, sf_dir, "documents").where("doc_id is not null").select(F.col("doc_id").alias("x")).distinct()
    language = F.element_at(F.array(*map(F.lit, BY_REST)), (F.col("x") % 8 + 1).cast("int"))
    d = d.withColumn("language", language).withColumn("path", F.concat(F.expr(PATH), F.col("x").cast("string"), F.lit("."), F.create_map(*[F.lit(v) for kv in ENDING.items() for v in kv])[F.col("language")]))
    place = F.transform(F.expr("sequence(0L, 5 + x % 40)"), lambda i: F.col("x") * 7 + i * 11 + (F.col("x") % 13) * i * i)

    def lines_of(pool):
        return F.transform(place, lambda k: F.element_at(F.array(*map(F.lit, pool)), (k % len(pool) + 1).cast("int")))

    line = None
    for name, pool in POOLS.items():
        own = lines_of(pool)
        line = F.when(F.col("language") == name, own) if line is None else line.when(F.col("language") == name, own)
    return d.select("path", "language", F.array_join(line, "\n").alias("content"))


_TEXT = _case({f"language = '{n}'": f"([{', '.join(map(_quoted, p))}])[(x * 7 + i * 11 + (x % 13) * i * i) % {len(p)} + 1]" for n, p in POOLS.items()})
LINES = rf"""docs AS (SELECT DISTINCT doc_id AS x, ([{', '.join(map(_quoted, BY_REST))}])[doc_id % 8 + 1] AS language FROM documents WHERE doc_id IS NOT NULL),
raw AS (SELECT concat({PATH}, cast(x AS string), '.', {_case({f"language = '{k}'": f"'{v}'" for k, v in ENDING.items()})}) AS path, language, (i + 1)::INT AS line_no, {_TEXT} AS text FROM docs, unnest(range(0, 6 + x % 40)) AS u(i)),
plain AS (SELECT *, regexp_replace(text, '"(?:\\.|[^"\\])*"|''(?:\\.|[^''\\])*''', '''''', 'g') AS bare FROM raw),
marked AS (SELECT path, language, line_no, text, CASE WHEN language IN ('python', 'yaml') THEN regexp_replace(bare, '#.*$', '', 'g') ELSE regexp_replace(bare, '//.*$|/\*.*?\*/', '', 'g') END AS code,
  contains(text, 'lint:ignore') AS own, regexp_matches(path, '(^|/)(tests?|__tests__|spec|fixtures)/|(^|/)test_[^/]*$|_test\.[a-z]+$|\.(test|spec)\.[a-z]+$|(^|/)conftest\.py$') AS test FROM plain),
lines AS (SELECT * FROM (SELECT *, own OR coalesce(lag(own) OVER (PARTITION BY path ORDER BY line_no), FALSE) OR bool_or(own AND line_no <= 10 AND contains(text, 'lint:ignore-file')) OVER (PARTITION BY path) AS suppressed FROM marked) WHERE NOT suppressed)"""

#: Facts of functions, written once for both dialects. tiny and same: short and equally shaped ones.
_KEY = f"p_partkey AS id, p_partkey % {FILES} AS x, p_partkey % {FILES} % 10 = 3 AS tiny, p_partkey % {FILES} % 10 = 7 AS same, p_size AS size, floor(p_partkey / {FILES}.0) AS m"
_FACTS = {
    "id": "id",
    "path": f"concat({PATH}, cast(x AS string), '.py')",
    "name": "CASE WHEN same THEN concat('op', cast(cast(m % 4 AS int) AS string)) WHEN id % 31 = 0 THEN '__init__' WHEN id % 29 = 0 THEN concat('_hidden', cast(id AS string)) WHEN id % 23 = 0 THEN concat('test_f', cast(id AS string)) ELSE concat('f', cast(id % 300 AS string)) END",
    "class_name": "CASE WHEN same THEN concat('B', cast(cast(floor(m / 4) % 20 AS int) AS string)) WHEN id % 4 = 0 THEN NULL ELSE concat('C', cast(id % 5 AS string)) END",
    "line_start": "cast(id * 37 % 30 + 1 AS int)",
    "line_end": "cast(id * 37 % 30 + 1 + CASE WHEN tiny THEN 2 ELSE size * (1 + id % 8) END AS int)",
    "mutable_defaults": "CASE WHEN id % 41 = 0 THEN 1 ELSE 0 END",
    "complexity": "cast(CASE WHEN same THEN 5 WHEN tiny THEN 1 + id % 2 WHEN id % 199 = 0 THEN 250 ELSE size END AS int)",
    "nesting": "cast(CASE WHEN same THEN 2 ELSE size % 8 END AS int)",
    "returns": "cast(CASE WHEN same THEN 1 ELSE id % 4 END AS int)",
    "bare_returns": "CASE WHEN id % 5 = 0 AND NOT same THEN 1 ELSE 0 END",
    "yields": "CASE WHEN id % 6 = 0 AND NOT same THEN 1 ELSE 0 END",
    "yields_in_loop": "CASE WHEN id % 12 = 0 AND NOT same THEN 1 ELSE 0 END",
    "has_doc": "id % 2 = 0",
}
_LISTS = {  # how many, and the element for each i
    "params": ("CASE WHEN same THEN 2 ELSE id % 12 END", PARAMS, "CASE WHEN same THEN i ELSE id % 3 + i END"),
    "reads": ("id % 11", NAMES, "id + i"),
    "stores": ("id % 7", NAMES, "id * 3 + i * 2"),
}
_CALLS = ("CASE WHEN same THEN 2 WHEN tiny THEN CASE WHEN x % 20 = 3 THEN 1 ELSE 0 END ELSE id % 4 END", "concat('f', cast((CASE WHEN same THEN 0 ELSE id END + i * 7) % 300 AS string))")


def functions(spark, sf_dir):
    """Facts as `code.FUNCTIONS`, with a numeric id."""
    def listed(many, element):
        return f"CASE WHEN {many} = 0 THEN cast(array() AS array<string>) ELSE transform(sequence(0L, cast({many} AS bigint) - 1), i -> {element}) END"

    p = P.table(spark, sf_dir, "part").selectExpr(*_KEY.split(", "))
    lists = {c: listed(n, f"element_at(array({', '.join(map(_quoted, names))}), cast(({at}) % {len(names)} AS int) + 1)") for c, (n, names, at) in _LISTS.items()}
    lists["calls"] = listed(*_CALLS)
    lists["decorators"] = "CASE WHEN id % 8 = 0 THEN array('contextmanager') WHEN id % 9 = 0 THEN array('route') ELSE cast(array() AS array<string>) END"
    d = p.selectExpr(*(f"{e} AS {c}" for c, e in (_FACTS | lists).items()), "false AS is_async")
    return d.withColumn("qualified_name", F.concat_ws("::", "path", "name", F.col("id").cast("string")))


FUNCTIONS = f"fn AS (SELECT *, concat(path, '::', name, '::', cast(id AS string)) AS qualified_name FROM (SELECT {', '.join(f'{e} AS {c}' for c, e in _FACTS.items())}, " + ", ".join(
    [f"[([{', '.join(map(_quoted, names))}])[(({at}) % {len(names)})::INT + 1] FOR i IN range(0, ({n})::BIGINT)] AS {c}" for c, (n, names, at) in _LISTS.items()]
    + [f"[{_CALLS[1]} FOR i IN range(0, ({_CALLS[0]})::BIGINT)] AS calls", "CASE WHEN id % 8 = 0 THEN ['contextmanager'] WHEN id % 9 = 0 THEN ['route'] ELSE [] END AS decorators"]
) + f" FROM (SELECT {_KEY} FROM part)))"


def edges(spark, sf_dir):
    """src, dst qualified names of the dense call edges."""
    f = functions(spark, sf_dir).select("id", "qualified_name")
    e = P.calls(spark, sf_dir).withColumnsRenamed({"src": "a", "dst": "b"})
    return e.join(f.toDF("a", "src"), "a").join(f.toDF("b", "dst"), "b").select("src", "dst")


def commits(spark, sf_dir):
    """hash, author, ts, age_days, file: few authors a folder, one folder left alone for 200 days, and
    two files that follow two others."""
    c = P.commit_files(spark, sf_dir).withColumn("id", F.col("file").cast("long")).withColumn("x", F.col("id") % FILES).drop("file")
    c = c.where("not (x % 7 = 4 and age_days <= 200)").withColumn("author", F.col("author") % (1 + F.col("x") % 7 % 4))
    c = c.union(c.where("x in (10, 20)").withColumn("x", F.col("x") + 7).withColumn("author", F.col("author") % (1 + F.col("x") % 7 % 4)))
    return c.select("hash", "author", "ts", "age_days", F.concat(F.expr(PATH), F.col("x").cast("string"), F.lit(".py")).alias("file")).distinct()


COMMITS = f"""{P.commits_sql().replace('commit_files AS', 'by_part AS')},
of_file AS (SELECT hash, author % (1 + x % 7 % 4) AS author, ts, age_days, x FROM (SELECT *, file::BIGINT % {FILES} AS x FROM by_part) WHERE NOT (x % 7 = 4 AND age_days <= 200)),
commit_files AS (SELECT DISTINCT hash, author, ts, age_days, concat({PATH}, cast(x AS string), '.py') AS file FROM (SELECT * FROM of_file UNION ALL SELECT hash, author % (1 + (x + 7) % 7 % 4), ts, age_days, x + 7 FROM of_file WHERE x IN (10, 20)))"""


def context(spark, sf_dir, options: dict | None = None):
    """A detectors' context over the projections."""
    from ..operators import detectors

    ctx = detectors.Context(files(spark, sf_dir), commits(spark, sf_dir), options or {})
    ctx.__dict__.update(functions=functions(spark, sf_dir), edges=edges(spark, sf_dir))
    return ctx


#: A class label's number: B0..B19 are themselves, C0..C4 follow from 50.
_CLASS = "CASE WHEN class_name LIKE 'B%' THEN cast(substring(class_name, 2) AS int) ELSE 50 + cast(substring(class_name, 2) AS int) END"
_CLASS_ID = f"-(1 + x * 100 + {_CLASS})"


def property_graph(spark, sf_dir):
    """The code base as one graph: functions, classes (ids below 0) and files (below -100000)."""
    from ..operators.property_graph import PropertyGraph

    f = functions(spark, sf_dir).withColumn("x", F.col("id") % FILES)
    f = f.withColumn("class_id", F.expr(f"CASE WHEN class_name IS NOT NULL THEN cast({_CLASS_ID} AS bigint) END")).withColumn("file_id", (-100_000 - F.col("x")).cast("bigint"))
    fn = f.select("id", F.lit("function").alias("kind"), "name", "qualified_name", "path", "line_start", "line_end", "complexity")
    klass = f.where("class_id is not null").groupBy("class_id", "class_name", "path").agg(F.min("line_start").alias("line_start"), F.max("line_end").alias("line_end"), F.sum("complexity").cast("int").alias("complexity"))
    klass = klass.select(F.col("class_id").alias("id"), F.lit("class").alias("kind"), F.col("class_name").alias("name"), F.concat_ws("::", "path", "class_name").alias("qualified_name"), "path", "line_start", "line_end", "complexity")
    file = f.groupBy("file_id", "path").agg(F.max("line_end").alias("line_end")).select(F.col("file_id").alias("id"), F.lit("file").alias("kind"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("path").alias("qualified_name"), "path", F.lit(1).alias("line_start"), "line_end", F.lit(0).alias("complexity"))
    near = P.sparse_calls(spark, sf_dir)
    ends = near.join(f.select(F.col("id").alias("src"), F.col("class_id").alias("ca"), F.col("file_id").alias("fa")), "src").join(f.select(F.col("id").alias("dst"), F.col("class_id").alias("cb"), F.col("file_id").alias("fb")), "dst")
    up = klass.select("id", F.expr(f"-(1 + ((((-id - 1) div 100) * 2) % {FILES}) * 100 + (-id - 1) % 100)").alias("to")).where("id != to")
    parts = [
        near.select("src", "dst", F.lit("CALLS").alias("kind")),
        ends.where("fa != fb").select("fa", "fb", F.lit("IMPORTS")).distinct(),
        up.join(klass.select(F.col("id").alias("to")), "to", "left_semi").select("id", "to", F.lit("INHERITS")),
        klass.select(F.expr("-100000 - (-id - 1) div 100"), "id", F.lit("CONTAINS")),
        f.select(F.coalesce("class_id", "file_id"), "id", F.lit("CONTAINS")),
        ends.where("ca is not null and cb is not null and ca != cb").select("ca", "cb", F.lit("USES")).distinct(),
        P.table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", F.lit("MODIFIED_IN")).distinct(),
    ]
    edges = parts[0]
    for p in parts[1:]:
        edges = edges.union(p)
    props = f.where("id % 2 = 0").select("id", F.size("params").alias("n_params"), F.array_join("decorators", ",").alias("decorators"), F.concat(F.lit("a"), (F.col("id") % 9).cast("string")).alias("author"))
    return PropertyGraph(fn.union(klass).union(file), edges, props)


GRAPH = f"""{FUNCTIONS}, {P.SPARSE}, f AS (SELECT *, id % {FILES} AS x, -100000 - id % {FILES} AS file_id FROM fn), g AS (SELECT *, CASE WHEN class_name IS NOT NULL THEN {_CLASS_ID} END AS class_id FROM f),
klass AS (SELECT class_id AS id, class_name AS name, path, min(line_start) AS line_start, max(line_end) AS line_end, sum(complexity)::INT AS complexity FROM g WHERE class_id IS NOT NULL GROUP BY ALL),
nodes AS (SELECT id, 'function' AS kind, name, qualified_name, path, line_start, line_end, complexity FROM fn UNION ALL SELECT id, 'class', name, concat(path, '::', name), path, line_start, line_end, complexity FROM klass
  UNION ALL SELECT file_id, 'file', regexp_extract(path, '([^/]+)$', 1), path, path, 1, max(line_end), 0 FROM g GROUP BY file_id, path),
ends AS (SELECT a.class_id AS ca, a.file_id AS fa, b.class_id AS cb, b.file_id AS fb FROM sparse JOIN g a ON src = a.id JOIN g b ON dst = b.id),
up AS (SELECT id, -(1 + ((((-id - 1) // 100) * 2) % {FILES}) * 100 + (-id - 1) % 100) AS upper_id FROM klass),
edges AS (SELECT src, dst, 'CALLS' AS kind FROM sparse UNION ALL SELECT DISTINCT fa, fb, 'IMPORTS' FROM ends WHERE fa <> fb UNION ALL SELECT id, upper_id, 'INHERITS' FROM up WHERE id <> upper_id AND upper_id IN (SELECT id FROM klass)
  UNION ALL SELECT -100000 - (-id - 1) // 100, id, 'CONTAINS' FROM klass UNION ALL SELECT coalesce(class_id, file_id), id, 'CONTAINS' FROM g
  UNION ALL SELECT DISTINCT ca, cb, 'USES' FROM ends WHERE ca <> cb UNION ALL SELECT DISTINCT l_partkey, l_orderkey, 'MODIFIED_IN' FROM lineitem),
props AS (SELECT id, len(params)::INT AS n_params, array_to_string(decorators, ',') AS decorators, concat('a', cast(id % 9 AS string)) AS author FROM fn WHERE id % 2 = 0)"""
