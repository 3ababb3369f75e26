"""A property graph as two tables and the questions a caller asks of it.

nodes: id, kind, name, qualified_name, path, line_start, line_end, complexity.
edges: src, dst, kind (CALLS, IMPORTS, INHERITS, CONTAINS, USES, MODIFIED_IN).
Answers are tables of rows; nothing gathers a node's neighbours into one value."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graph

#: Edge kinds and what a row of `near` means from either end.
KINDS = ("CALLS", "IMPORTS", "INHERITS", "CONTAINS", "USES", "MODIFIED_IN")


@dataclass(frozen=True)
class PropertyGraph:
    nodes: DataFrame
    edges: DataFrame
    props: DataFrame | None = None

    def of_kind(self, kind: str) -> DataFrame:
        return self.nodes.where(F.col("kind") == kind)

    def by_name(self, *qualified_names: str) -> DataFrame:
        return self.nodes.where(F.col("qualified_name").isin(*qualified_names))

    def in_file(self, path: str, kind: str | None = None) -> DataFrame:
        """Nodes of a file; all of them, or of one kind."""
        found = self.nodes.where(F.col("path") == path)
        return found if kind is None else found.where(F.col("kind") == kind)

    def near(self, kind: str, out: bool = True) -> DataFrame:
        """id, other: the ends of edges of a kind (callees, parents, children ...), or with out=False
        what points at a node (callers, child classes, containers ...)."""
        e = self.edges.where(F.col("kind") == kind)
        return e.select(F.col("src" if out else "dst").alias("id"), F.col("dst" if out else "src").alias("other")).distinct()

    def adjacency(self, kind: str = "CALLS") -> DataFrame:
        """src, place, dst: neighbours numbered from 0 in order of their id."""
        e = self.near(kind).toDF("src", "dst")
        return e.select("src", (F.row_number().over(Window.partitionBy("src").orderBy("dst")) - 1).cast("long").alias("place"), "dst")

    def with_props(self) -> DataFrame:
        """Nodes with their optional properties, null where a node has none."""
        return self.nodes.join(self.props, "id", "left")

    def edge_fingerprint(self) -> DataFrame:
        """One row: edges between files, and a fingerprint of their set. Sums of hashes don't depend on
        an order, so nothing is sorted."""
        n = self.nodes.select("id", "qualified_name", "path")
        e = self.edges.distinct().join(n.toDF("src", "a", "pa"), "src").join(n.toDF("dst", "b", "pb"), "dst").where("pa != pb")
        part = F.conv(F.substring(F.md5(F.concat_ws("|", "a", "b", "kind")), 1, 12), 16, 10).cast("decimal(38,0)")
        return e.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(part), F.lit(0)).cast("string").alias("fingerprint"))

    def stats(self) -> DataFrame:
        """what, kind, n of nodes and edges."""
        count = F.count(F.lit(1)).alias("n")
        return self.nodes.groupBy("kind").agg(count).select(F.lit("node").alias("what"), "kind", "n").union(self.edges.distinct().groupBy("kind").agg(count).select(F.lit("edge"), "kind", "n"))

    def without_files(self, paths: DataFrame) -> PropertyGraph:
        """The graph without the entities of some files (path) and without edges at them."""
        gone = paths.select("path").distinct()
        kept = self.nodes.join(gone, "path", "left_anti").select(*self.nodes.columns)
        ids = self.nodes.join(gone, "path", "left_semi").select("id")
        edges = self.edges.join(ids.toDF("src"), "src", "left_anti").join(ids.toDF("dst"), "dst", "left_anti").select("src", "dst", "kind")
        return PropertyGraph(kept, edges, self.props if self.props is None else self.props.join(ids, "id", "left_anti"))

    def with_nodes(self, nodes: DataFrame) -> PropertyGraph:
        """Nodes added, or replaced where their id is there."""
        kept = self.nodes.join(nodes.select("id"), "id", "left_anti").select(*self.nodes.columns)
        return PropertyGraph(kept.unionByName(nodes), self.edges, self.props)

    def with_edges(self, edges: DataFrame) -> PropertyGraph:
        """Edges added; those without both ends are left out, as are ones that are there."""
        ids = self.nodes.select("id")
        new = edges.join(ids.toDF("src"), "src", "left_semi").join(ids.toDF("dst"), "dst", "left_semi").select("src", "dst", "kind")
        return PropertyGraph(self.nodes, self.edges.union(new).distinct(), self.props)

    def patched(self, changed: DataFrame, nodes: DataFrame, edges: DataFrame) -> PropertyGraph:
        """The graph after files changed: their old entities go, with the edges at them; new nodes and
        edges come. Edges from files that didn't change to an entity that is still there, under its
        qualified name, are kept."""
        old = self.nodes.join(changed.select("path").distinct(), "path", "left_semi").select(F.col("id").alias("old"), "qualified_name")
        again = old.join(nodes.select("qualified_name", F.col("id").alias("new")), "qualified_name").select("old", "new")
        into = self.edges.join(again, F.col("dst") == F.col("old")).join(old.select(F.col("old").alias("src")), "src", "left_anti").select("src", F.col("new").alias("dst"), "kind")
        return self.without_files(changed).with_nodes(nodes).with_edges(edges.select("src", "dst", "kind").union(into))


def two_hops(edges: DataFrame) -> DataFrame:
    """src, dst: nodes two steps apart and not linked already."""
    e = edges.select("src", "dst").distinct()
    far = e.select("src", F.col("dst").alias("mid")).join(e.select(F.col("src").alias("mid"), "dst"), "mid").where("src != dst").select("src", "dst").distinct()
    return far.join(e, ["src", "dst"], "left_anti")


def connected(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """id, component (smallest id) of the undirected graph; with `nodes`, lone ones too. A node takes
    the least label around it, then that label's own label, so paths shorten as labels meet."""
    graph.checkpoint_folder(edges.sparkSession)
    both = edges.select("src", "dst").union(edges.select("dst", "src")).where("src != dst").distinct().checkpoint()
    ids = both.select(F.col("src").alias("id")).distinct() if nodes is None else nodes.select("id").distinct()
    now = ids.select("id", F.col("id").alias("c")).checkpoint()
    while True:
        around = both.join(now.toDF("dst", "c"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("c").alias("g"))
        low = now.join(around, "id", "left").select("id", F.least("c", F.coalesce("g", "c")).alias("m"), "c")
        far = now.select(F.col("id").alias("m"), F.col("c").alias("further"))
        new = low.join(far, "m", "left").select("id", F.least("m", F.coalesce("further", "m")).alias("c"), F.col("c").alias("was")).checkpoint()
        if new.where("c != was").isEmpty():
            return new.select("id", F.col("c").alias("component"))
        now = new.select("id", "c")


def component_sizes(edges: DataFrame) -> DataFrame:
    c = connected(edges)
    return c.join(c.groupBy("component").agg(F.count(F.lit(1)).alias("size")), "component").select("id", "component", "size")


def class_cohesion(methods: DataFrame, calls: DataFrame) -> DataFrame:
    """class_id, methods, cohesion: components of a class's methods under calls between them, over
    their number; 1 for a class of one method. methods: id, class_id."""
    m = methods.select("id", "class_id")
    inner = calls.join(m.toDF("src", "a"), "src").join(m.toDF("dst", "b"), "dst").where("a = b").select("src", "dst")
    found = m.join(connected(inner, m), "id")
    return found.groupBy("class_id").agg(F.count(F.lit(1)).alias("methods"), (F.countDistinct("component") / F.count(F.lit(1))).alias("cohesion"))


def dominance(idom: DataFrame) -> DataFrame:
    """id, depth, dominated of an immediate-dominator table (id, idom; -1: a root): how many nodes
    dominate a node, and how many it does. Ancestor sets double their reach in each round."""
    graph.checkpoint_folder(idom.sparkSession)
    step = idom.where("idom != -1").select("id", F.col("idom").alias("up")).checkpoint()
    above = step
    while True:
        more = above.join(step.toDF("up", "next"), "up").select("id", F.col("next").alias("up")).union(above).distinct().checkpoint()
        if more.count() == above.count():
            break
        above = more
    depth = above.groupBy("id").agg(F.count(F.lit(1)).alias("depth"))
    below = above.groupBy(F.col("up").alias("id")).agg(F.count(F.lit(1)).alias("dominated"))
    zero = F.lit(0).cast("long")
    return idom.select("id").join(depth, "id", "left").join(below, "id", "left").select("id", F.coalesce("depth", zero).alias("depth"), F.coalesce("dominated", zero).alias("dominated"))


def dominance_frontier(idom: DataFrame, edges: DataFrame) -> DataFrame:
    """id, frontier: nodes where a node's dominance ends. From each edge into y, walk up from its
    source until y's immediate dominator."""
    live = idom.select(F.col("id").alias("dst"), F.col("idom").alias("stop"))
    at = edges.select("src", "dst").distinct().join(live, "dst").join(idom.select(F.col("id").alias("src"), F.col("idom").alias("up")), "src")
    at, found = at.select(F.col("src").alias("id"), "up", "dst", "stop").where("id != stop").checkpoint(), None
    while not at.isEmpty():
        new = at.select("id", F.col("dst").alias("frontier"))
        found = new if found is None else found.union(new)
        at = at.where("up != -1").select(F.col("up").alias("id"), "dst", "stop").distinct().where("id != stop").join(idom.select("id", F.col("idom").alias("up")), "id").select("id", "up", "dst", "stop").checkpoint()
    return edges.sparkSession.createDataFrame([], "id long, frontier long") if found is None else found.distinct()


def full_overlay(calls: DataFrame, imports: DataFrame, files: DataFrame, cochange: DataFrame, cap: float = 2.0) -> DataFrame:
    """src, dst, w: 1 for a call, 0.5 for an import, 1.5 for both, plus the co-change weight of the two
    files up to a cap. files: id, path."""
    c, i = calls.select("src", "dst").distinct().withColumn("call", F.lit(1.0)), imports.select("src", "dst").distinct().withColumn("import", F.lit(0.5))
    base = c.join(i, ["src", "dst"], "full").select("src", "dst", (F.coalesce("call", F.lit(0.0)) + F.coalesce("import", F.lit(0.0))).alias("base"))
    f = files.select("id", "path")
    pairs = cochange.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "weight")
    j = base.join(f.toDF("src", "p"), "src").join(f.toDF("dst", "q"), "dst").withColumns({"a": F.least("p", "q"), "b": F.greatest("p", "q")}).join(pairs, ["a", "b"], "left")
    return j.select("src", "dst", (F.col("base") + F.least(F.coalesce("weight", F.lit(0.0)), F.lit(cap))).alias("w"))


def aggregator_links(files: DataFrame) -> DataFrame:
    """a, b: files that an aggregator file of their folder joins with each other through it."""
    f = files.select("path", F.regexp_extract("path", "^(.*)/", 1).alias("folder"), F.regexp_extract("path", r"([^/]+)$", 1).alias("base")).distinct()
    hub = f.where(F.col("base").isin("mod.rs", "__init__.py", "index.ts", "index.js", "index.tsx", "index.jsx")).select("folder", F.col("path").alias("hub"))
    return hub.join(f.select("folder", "path"), "folder").where("hub != path").select(F.least("hub", "path").alias("a"), F.greatest("hub", "path").alias("b")).distinct()


def project_metrics(functions: DataFrame, files: DataFrame, calls: DataFrame, cycles: int) -> DataFrame:
    """One row of measures of a whole project. functions: id, path, complexity; files: path, loc, test."""
    folder = lambda c: F.regexp_extract(c, "^(.*)/", 1)
    m = functions.select("id", folder("path").alias("m"))
    crossing = calls.join(m.toDF("src", "a"), "src").join(m.toDF("dst", "b"), "dst").agg(F.count(F.lit(1)).alias("calls"), F.coalesce(F.sum((F.col("a") != F.col("b")).cast("long")), F.lit(0)).alias("cross"))
    f = functions.agg(F.count(F.lit(1)).alias("total_functions"), F.coalesce(F.avg((F.coalesce("complexity", F.lit(1)) <= 10).cast("double")), F.lit(1.0)).alias("simple_ratio"))
    t = files.agg(F.count(F.lit(1)).alias("total_files"), F.countDistinct(folder("path")).alias("modules"), F.coalesce(F.avg(F.col("test").cast("double")), F.lit(0.0)).alias("test_ratio"), F.coalesce(F.sum("loc"), F.lit(0)).alias("total_loc"))
    coupling = F.when(F.col("calls") > 0, F.col("cross") / F.col("calls")).otherwise(0.0)
    cohesion = F.when(F.col("calls") > 0, 1 - F.col("cross") / F.col("calls")).otherwise(1.0)
    one = crossing.crossJoin(f).crossJoin(t)  # one row each
    return one.select("modules", coupling.alias("coupling"), cohesion.alias("cohesion"), F.lit(cycles).cast("long").alias("cycles"), "simple_ratio", "test_ratio", "total_functions", "total_files", F.col("total_loc").cast("long").alias("total_loc"))


def bonuses(metrics: DataFrame, most: dict[str, float], coupling: float = 1.0, complexity: float = 1.0) -> DataFrame:
    """metrics with a bonus for each quality, up to `most` points: modularity, cohesion, clean_deps,
    complexity, tests. The multipliers are of the project's type."""
    def clamp(x) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))

    low, high = min(0.3 * coupling, 1.0), min(0.7 * coupling, 1.0)
    full, zero = max(0.7 / coupling, 0.15), max(0.3 / coupling, 0.05)
    simple, none = max(0.9 / complexity, 0.3), max(0.5 / complexity, 0.1)
    share = {
        "modularity": 1 - clamp((F.col("coupling") - low) / max(high - low, 0.01)),
        "cohesion": clamp((F.col("cohesion") - zero) / max(full - zero, 0.01)),
        "clean_deps": 1 - clamp(F.col("cycles") * 0.2),
        "complexity": clamp((F.col("simple_ratio") - none) / max(simple - none, 0.01)),
        "tests": clamp(F.col("test_ratio") / 0.2),
    }
    return metrics.withColumns({f"{k}_bonus": share[k] * v for k, v in most.items()})
