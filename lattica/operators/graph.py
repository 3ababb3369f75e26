"""Graph queries over `nodes(id, ...)` and `edges(src, dst)` as DataFrames.

Edges are a set: callers pass them without repeats. Degree, coupling and spread queries are
joins and aggregations. Iterations are driver loops over small state tables (a row a node)
that cut their lineage with reliable checkpoints.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..folders import shared
from . import kernels

#: Edges up to which a search is one task's (about 60 bytes each); more of them are searched in rounds.
ONE_TASK = 20_000_000


def checkpoint_folder(spark) -> None:
    """Sees to it that there is a folder for checkpoints."""
    shared(spark)


def fan_in_out(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, fan_in, fan_out; nodes without edges count 0."""
    ends = edges.select(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(edges.select("dst", F.lit(1), F.lit(0)))
    degree = ends.groupBy("id").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))
    return nodes.select("id").join(degree, "id", "left").select("id", F.coalesce("fan_in", F.lit(0)).cast("long").alias("fan_in"), F.coalesce("fan_out", F.lit(0)).cast("long").alias("fan_out"))


def degree_findings(nodes: DataFrame, edges: DataFrame, total: int, inward: int, outward: int) -> DataFrame:
    """Hubs by tiers of total, inward and outward degree, ranked by severity and degree."""
    d = fan_in_out(nodes, edges).withColumn("degree", F.col("fan_in") + F.col("fan_out"))
    kind = F.when((F.col("fan_in") >= inward) & (F.col("fan_out") >= outward), "hub").when(F.col("fan_in") >= inward, "sink").when(F.col("fan_out") >= outward, "source")
    severity = F.when(F.col("degree") >= total, 3).when(kind == "hub", 2).otherwise(1).cast("long")
    return d.withColumn("kind", kind).where("kind is not null").select("id", "kind", severity.alias("severity"), "degree", "fan_in", "fan_out")


def neighbours(edges: DataFrame, node_ids: DataFrame, direction: str = "in") -> DataFrame:
    """Callers (in) or callees (out) of given ids: id, neighbour."""
    near, far = ("dst", "src") if direction == "in" else ("src", "dst")
    return edges.join(node_ids.select(F.col("id").alias(near)).distinct(), near).select(F.col(near).alias("id"), F.col(far).alias("neighbour"))


def caller_spread(nodes: DataFrame, edges: DataFrame, by: str) -> DataFrame:
    """id, spread: distinct `by` values among a node's callers."""
    callers = edges.join(nodes.select(F.col("id").alias("src"), F.col(by).alias("group")), "src")
    return callers.groupBy(F.col("dst").alias("id")).agg(F.countDistinct("group").alias("spread"))


def external_callers(nodes: DataFrame, edges: DataFrame, by: str) -> DataFrame:
    """id, external: callers from outside the node's own group."""
    ends = edges.join(nodes.select(F.col("id").alias("src"), F.col(by).alias("from_group")), "src").join(nodes.select(F.col("id").alias("dst"), F.col(by).alias("to_group")), "dst")
    return ends.groupBy(F.col("dst").alias("id")).agg(F.sum(F.when(F.col("from_group") != F.col("to_group"), 1).otherwise(0)).cast("long").alias("external"))


def module_metrics(nodes: DataFrame, edges: DataFrame, by: str) -> DataFrame:
    """module, internal, incoming, outgoing, coupling (0 without calls), cohesion (1 without)."""
    ends = edges.join(nodes.select(F.col("id").alias("src"), F.col(by).alias("a")), "src").join(nodes.select(F.col("id").alias("dst"), F.col(by).alias("b")), "dst")
    rolled = ends.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    inside = (F.col("a") == F.col("b")).cast("long")
    flow = rolled.select(F.col("a").alias("module"), (F.col("n") * inside).alias("internal"), (F.col("n") * (1 - inside)).alias("outgoing"), F.lit(0).cast("long").alias("incoming"))
    flow = flow.union(rolled.where("a != b").select("b", F.lit(0).cast("long"), F.lit(0).cast("long"), "n"))
    m = nodes.select(F.col(by).alias("module")).distinct().join(flow.groupBy("module").agg(*(F.sum(c).alias(c) for c in ("internal", "incoming", "outgoing"))), "module", "left").na.fill(0)
    total = F.col("internal") + F.col("incoming") + F.col("outgoing")
    return m.select("module", "internal", "incoming", "outgoing", F.when(total == 0, 0.0).otherwise((F.col("incoming") + F.col("outgoing")) / total).alias("coupling"), F.when(total == 0, 1.0).otherwise(F.col("internal") / total).alias("cohesion"))


def modularity(edges: DataFrame, nodes: DataFrame, by: str) -> DataFrame:
    """One row: the modularity of a fixed partition, edges taken as undirected."""
    und = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    g = nodes.select("id", F.col(by).alias("g"))
    ends = und.join(g.toDF("a", "ga"), "a").join(g.toDF("b", "gb"), "b")
    inside = ends.where("ga = gb").groupBy(F.col("ga").alias("g")).agg(F.count(F.lit(1)).alias("e"))
    degree = ends.select(F.col("ga").alias("g")).union(ends.select("gb")).groupBy("g").agg(F.count(F.lit(1)).alias("d"))
    m = und.agg(F.count(F.lit(1)).alias("m"))
    parts = degree.join(inside, "g", "left").crossJoin(F.broadcast(m))  # one row on the right
    return parts.agg(F.sum(F.coalesce("e", F.lit(0)) / F.col("m") - F.pow(F.col("d") / (2.0 * F.col("m")), 2)).alias("modularity"))


def breadth_first(edges: DataFrame, sources: DataFrame, most: int | None = None, one_task: int = ONE_TASK) -> DataFrame:
    """id, depth: fewest steps from any source. Up to `one_task` edges are shuffled once, to one task; of
    more, or of edges between strings, the frontier alone is expanded in each round."""
    checkpoint_folder(edges.sparkSession)
    edges = edges.select("src", "dst")
    if {t for _, t in edges.dtypes + sources.select("id").dtypes} <= {"bigint", "int"}:
        edges = edges.checkpoint()
        if edges.count() <= one_task:
            run = lambda src, dst, ids: kernels.depth_arrays(src, dst, ids, most)
            return kernels.in_one_task(edges, run, "id long, depth long", sources.select("id").distinct(), None)
    seen = sources.select("id", F.lit(0).cast("long").alias("depth")).distinct().checkpoint()
    frontier, depth = seen, 0
    while most is None or depth < most:
        depth += 1
        step = frontier.select(F.col("id").alias("src")).join(edges, "src").select(F.col("dst").alias("id")).distinct()
        frontier = step.join(seen, "id", "left_anti").select("id", F.lit(depth).cast("long").alias("depth")).checkpoint()
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
        if depth % 8 == 0:
            seen = seen.checkpoint()
    return seen


def entry_points(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.select("id").join(edges.select(F.col("dst").alias("id")).distinct(), "id", "left_anti")


def page_rank(nodes: DataFrame, edges: DataFrame, rounds: int = 20, damping: float = 0.85, tolerance: float = 1e-6, weight: str | None = None) -> DataFrame:
    """id, rank. Dangling mass is spread evenly; stops when the L1 change is under tolerance.

    Nodes and edge shares are kept co-partitioned by a checkpoint and one join a round."""
    spark = nodes.sparkSession
    checkpoint_folder(spark)
    n = nodes.select("id").distinct().count()
    if not n:
        return spark.createDataFrame([], "id long, rank double")
    w = F.col(weight) if weight else F.lit(1.0)
    out = edges.groupBy("src").agg(F.sum(w).alias("total"))
    shares = edges.join(out, "src").select("src", "dst", (w / F.col("total")).alias("share")).checkpoint()
    state = nodes.select("id").distinct().join(out.select(F.col("src").alias("id"), F.lit(True).alias("has")), "id", "left").select("id", F.coalesce("has", F.lit(False)).alias("has"), F.lit(1.0 / n).alias("rank")).checkpoint()
    for _ in range(rounds):
        loose = state.where("not has").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        given = shares.join(state.select(F.col("id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        new = state.withColumnRenamed("rank", "old").join(given, "id", "left").select("id", "has", "old", (F.lit((1 - damping) / n + damping * loose / n) + damping * F.coalesce("got", F.lit(0.0))).alias("rank")).checkpoint()
        change = new.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0]
        state = new.drop("old")
        if change < tolerance:
            break
    return state.select("id", "rank")


def strong_components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """id, component (smallest id) of every node on a cycle of more than one node.

    Up to `one_task` edges are one task's. Of more, nodes without in- or out-edges are trimmed, then the largest label that reaches a node
    colours it, and what reaches back to the label inside its colour is a component."""
    checkpoint_folder(edges.sparkSession)
    edges = edges.select("src", "dst").where("src != dst").distinct().checkpoint()
    if edges.count() <= one_task:
        return kernels.in_one_task(edges, lambda src, dst, _: kernels.strong_arrays(src, dst), "id long, component long", None, None).checkpoint()
    found = None
    while True:
        while True:
            before = edges.count()
            edges = edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
            edges = edges.join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst").checkpoint()
            if edges.count() == before:
                break
        if not before:
            break
        colour = edges.select(F.col("src").alias("id")).distinct().withColumn("c", F.col("id")).checkpoint()
        while True:
            got = edges.join(colour.select(F.col("id").alias("src"), "c"), "src").groupBy(F.col("dst").alias("id")).agg(F.max("c").alias("g"))
            new = colour.join(got, "id", "left").select("id", F.greatest("c", F.coalesce("g", "c")).alias("c"), "c").toDF("id", "c", "old").checkpoint()
            moved = new.where("c != old").isEmpty()
            colour = new.select("id", "c")
            if moved:
                break
        inner = edges.join(colour.toDF("src", "c"), "src").join(colour.toDF("dst", "d"), "dst").where("c = d").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        roots = colour.where("id = c").select("id")
        back = breadth_first(inner, roots).select("id")
        group = colour.join(back, "id").select("id", "c").checkpoint()
        found = group if found is None else found.union(group)
        edges = edges.join(group.select(F.col("id").alias("src")), "src", "left_anti").join(group.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst").checkpoint()
    if found is None:
        return edges.sparkSession.createDataFrame([], "id long, component long")
    named = found.groupBy("c").agg(F.min("id").alias("component"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return found.join(named, "c").select("id", "component")


def cycles(edges: DataFrame) -> DataFrame:
    """component, size, members (sorted) of each cycle, a cycle being a strong component."""
    return strong_components(edges).groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.array_join(F.array_sort(F.collect_list("id")), ",").alias("members"))


def bounded_chains(edges: DataFrame, sources: DataFrame, length: int) -> DataFrame:
    """Simple paths of exactly `length` steps from the sources, as id arrays."""
    paths = sources.select(F.array("id").alias("path"))
    for _ in range(length):
        paths = paths.withColumn("src", F.element_at("path", -1)).join(edges.select("src", "dst"), "src").where(~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path"))
    return paths


def overlay(calls: DataFrame, cochange: DataFrame, cap: float = 2.0) -> DataFrame:
    """Weighted edges: 1 for a call plus the pair's co-change weight, capped."""
    pairs = cochange.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight")
    both = pairs.union(pairs.select("dst", "src", "weight"))
    return calls.join(both, ["src", "dst"], "left").select("src", "dst", (1.0 + F.least(F.coalesce("weight", F.lit(0.0)), F.lit(cap))).alias("w"))


def taint_paths(edges: DataFrame, sources: DataFrame, sinks: DataFrame, sanitizers: DataFrame, most: int) -> DataFrame:
    """source, sink, hops, sanitized for each simple path of up to `most` calls. Paths stop at the
    sink they reach."""
    checkpoint_folder(edges.sparkSession)
    ends = sinks.select(F.col("id").alias("at"), F.lit(True).alias("is_sink")).distinct()
    clean = sanitizers.select(F.col("id").alias("at"), F.lit(True).alias("is_clean")).distinct()
    paths = sources.select(F.array("id").alias("path"), F.lit(False).alias("sanitized"))
    found = None
    for hops in range(1, most + 1):
        step = paths.withColumn("src", F.element_at("path", -1)).join(edges.select("src", F.col("dst").alias("at")), "src").where(~F.array_contains("path", F.col("at")))
        step = step.join(ends, "at", "left").join(clean, "at", "left").select(F.concat("path", F.array("at")).alias("path"), (F.col("sanitized") | F.coalesce("is_clean", F.lit(False))).alias("sanitized"), F.coalesce("is_sink", F.lit(False)).alias("is_sink"), "at").checkpoint()
        hit = step.where("is_sink").select(F.element_at("path", 1).alias("source"), F.col("at").alias("sink"), F.lit(hops).cast("long").alias("hops"), "sanitized")
        found = hit if found is None else found.union(hit)
        paths = step.where("not is_sink").select("path", "sanitized")
    return found


def walks(edges: DataFrame, nodes: DataFrame, length: int = 20, per_node: int = 10, seed: int = 0) -> DataFrame:
    """walk: node names of seeded uniform random walks from nodes with edges, over edges in both directions.
    The graph's arrays are broadcast; a task draws the walks of its nodes, so hubs need no task of their own."""
    import numpy as np
    import pyarrow as pa

    from . import embeddings

    graph = edges.sparkSession.sparkContext.broadcast(kernels.undirected_arrays(edges))

    def task(batches):
        ids, start, near = graph.value
        for batch in batches:
            asked = batch.column(0).to_numpy(zero_copy_only=False)
            places = np.searchsorted(ids, asked[np.isin(asked, ids)]).astype(np.int32)
            for at in range(0, len(places), embeddings.STARTS):
                w = embeddings.walk_arrays(start, near, places[at : at + embeddings.STARTS], length, per_node, seed)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, length, dtype=np.int32)), pa.array(ids[w.reshape(-1)].astype(str)))
                yield pa.RecordBatch.from_arrays([flat], ["walk"])

    return nodes.select(F.col("id").cast("long")).mapInArrow(task, "walk array<string>")
