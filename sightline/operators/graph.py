"""Reachability over edge tables (src, dst): semi-naive rounds, each written to the shared folder."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import Steps

#: Rows up to which a step of a round is broadcast.
FEW = 100_000


def _sized(table: DataFrame, n: int) -> DataFrame:
    """table, marked for broadcast if it has few rows and for a join by shuffle otherwise: what goes through the driver in a
    round is bounded, whatever Spark makes of the sizes of files."""
    return F.broadcast(table) if n <= FEW else table.hint("merge")


def _folded(steps: Steps, parts: list[DataFrame], depth: int) -> None:
    """Every eight parts become one, and every eight of these, so plans stay short and a row is written few times."""
    every = 8
    while depth % every == 0:
        parts[-8:] = [steps.put(reduce(DataFrame.unionByName, parts[-8:]))]
        every *= 8


def reach(edges: DataFrame, seeds: DataFrame, most: int | None = None) -> DataFrame:
    """vertex, depth: all vertices that seeds (vertex) reach, with the least number of edges; at most `most` edges.

    Cycles end by the anti-join with what was seen. Null ends never match. Empty seeds give no rows.
    """
    steps = Steps(edges.sparkSession)
    edges = steps.put(edges.select("src", "dst").where("src is not null and dst is not null and src <> dst").distinct())
    seen = steps.put(seeds.select("vertex").where("vertex is not null").distinct().withColumn("depth", F.lit(0).cast("long")))
    frontier, depth = seen, 0
    total = n = frontier.count()
    while (most is None or depth < most) and n:
        depth += 1
        found = _sized(frontier, n).join(edges, F.col("vertex") == F.col("src")).select(F.col("dst").alias("vertex")).distinct()
        frontier = steps.put(found.join(_sized(seen.select("vertex"), total), "vertex", "left_anti").withColumn("depth", F.lit(depth).cast("long")))
        n = frontier.count()
        total += n
        seen = seen.unionByName(frontier)
        if depth % 8 == 0:
            seen = steps.put(seen)
    return steps.result(seen)


def reach_scoped(edges: DataFrame, seeds: DataFrame, most: int | None = None) -> DataFrame:
    """scope, vertex, depth: what the seeds (scope, vertex) of each scope reach, for all scopes in one run of rounds. Rows of
    seeds and edges with nulls are left out.

    A vertex with one edge into it that is no seed is found once in a scope, from that edge's source: it is free of the
    check against what was seen. Only vertices with several edges, and seeds, go through it.
    """
    steps = Steps(edges.sparkSession)
    edges = edges.select("src", "dst").where("src is not null and dst is not null and src <> dst").distinct()
    start = steps.put(seeds.select("scope", "vertex").where("scope is not null and vertex is not null").distinct().withColumn("depth", F.lit(0).cast("long")))
    into = edges.groupBy("dst").agg((F.count(F.lit(1)) > 1).alias("several"))
    begun = start.select(F.col("vertex").alias("dst")).distinct().withColumn("begun", F.lit(True))
    kinds = into.join(begun, "dst", "left").select("dst", "several", (~F.col("several") & F.col("begun").isNull()).alias("free"))
    edges = steps.put(edges.join(kinds, "dst"))
    frontier, depth, n = start, 0, start.count()
    total, parts, again = n, [start], [start.select("scope", "vertex")]
    while (most is None or depth < most) and n:
        depth += 1
        found = _sized(frontier, n).join(edges, F.col("vertex") == F.col("src")).select("scope", F.col("dst").alias("vertex"), "several", "free")
        seen = _sized(reduce(DataFrame.unionByName, again), total)
        checked = found.where("not free").distinct().join(seen, ["scope", "vertex"], "left_anti")
        going = steps.put(found.where("free").unionByName(checked).select("scope", "vertex", "several", F.lit(depth).cast("long").alias("depth")))
        counts = going.groupBy("several").count().collect()
        n, repeated = sum(r["count"] for r in counts), sum(r["count"] for r in counts if r["several"])
        frontier = going.drop("several")
        parts.append(frontier)
        _folded(steps, parts, depth)
        if repeated:
            total += repeated
            again.append(going.where("several").select("scope", "vertex"))
            _folded(steps, again, len(again) - 1)
    return steps.result(reduce(DataFrame.unionByName, parts))


def reach_back(edges: DataFrame, targets: DataFrame, most: int) -> DataFrame:
    """vertex, depth: the vertices from which targets are reached within so many edges."""
    return reach(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), targets, most)


def rooted(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """vertex, root: for each reached vertex the smallest root that reaches it."""
    steps = Steps(edges.sparkSession)
    edges = steps.put(edges.select("src", "dst").where("src is not null and dst is not null and src <> dst").distinct())
    best = steps.put(roots.select("vertex", F.col("vertex").alias("root")).where("vertex is not null").distinct())
    changed = best
    while not changed.isEmpty():
        offered = changed.join(edges, F.col("vertex") == F.col("src")).groupBy(F.col("dst").alias("vertex")).agg(F.min("root").alias("offer"))
        changed = steps.put(offered.join(best, "vertex", "left").where("root is null or offer < root").select("vertex", F.col("offer").alias("root")))
        best = steps.put(best.join(changed, "vertex", "left_anti").unionByName(changed))
    return steps.result(best)


def tree(edges: DataFrame, entry: DataFrame, depth_limit: int = 8, node_limit: int = 500) -> tuple[DataFrame, str | None]:
    """Breadth-first nodes (vertex, depth), and why growth ended early: node_limit, depth_limit or None.

    The level in progress is finished, so there may be more nodes than the limit. A tree that has nodes of the last level
    allowed counts as ended by it, since these are not looked at.
    """
    steps = Steps(edges.sparkSession)
    edges = steps.put(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    seen = steps.put(entry.select("vertex", F.lit(0).cast("long").alias("depth")))
    frontier, depth = seen, 0
    while depth < depth_limit:
        found = frontier.join(edges, F.col("vertex") == F.col("src")).select(F.col("dst").alias("vertex")).distinct().join(seen, "vertex", "left_anti")
        depth += 1
        frontier = steps.put(found.withColumn("depth", F.lit(depth).cast("long")))
        if frontier.isEmpty():
            return steps.result(seen), None
        seen = seen.unionByName(frontier)
        if seen.count() >= node_limit:
            return steps.result(seen), "node_limit"
    return steps.result(seen), "depth_limit"


def tree_relations(nodes: DataFrame, ended: str | None, calls: DataFrame) -> DataFrame:
    """src, relation, dst of a tree (vertex, depth) and why it ended: an edge for each different resolved call of a node that
    was looked at, and a gap for each of its calls with several targets. The nodes of the last level of a tree that ended
    early were not looked at. calls: src, dst, status, name (what a gap is called)."""
    last = nodes.agg(F.max("depth")).first()[0]
    asked = (nodes if ended is None or last is None else nodes.where(F.col("depth") < last)).select(F.col("vertex").alias("src"))
    edges = calls.where("status = 'resolved' and dst is not null").select("src", F.lit("edge").alias("relation"), F.col("dst").cast("string").alias("dst")).distinct()
    gaps = calls.where("status = 'ambiguous'").select("src", F.lit("gap").alias("relation"), F.col("name").cast("string").alias("dst"))
    return edges.unionByName(gaps).join(asked.distinct(), "src", "left_semi")


def walk_up(parents: DataFrame, most: int = 8) -> DataFrame:
    """vertex, top, steps, gap: from each vertex (vertex, parent) along its parents, at most so many steps. gap says why
    the walk ended early: cycle (the next vertex was passed already, wherever the walk began), depth_limit or none
    (null). Vertices must be unique. The path of a walk, at most `most` long, goes along in its row."""
    steps = Steps(parents.sparkSession)
    parents = steps.put(parents.select("vertex", "parent"))
    up = parents.select(F.col("vertex").alias("next"), F.col("parent").alias("above"))
    going = parents.select("vertex", F.col("parent").alias("next"), F.array("vertex").alias("path"))
    again = F.array_contains("path", F.col("next"))
    ended = []
    for step in range(most + 1):
        stop = F.col("next").isNull() | again
        gap = F.when(F.col("next").isNull(), None).when(again, "cycle").otherwise("depth_limit")
        done = going.where(F.coalesce(stop, F.lit(True))) if step < most else going
        ended.append(done.select("vertex", F.element_at("path", -1).alias("top"), (F.size("path") - 1).cast("long").alias("steps"), gap.alias("gap")))
        if step == most:
            break
        moved = going.where(~F.coalesce(stop, F.lit(True))).join(up, "next", "left")
        going = steps.put(moved.select("vertex", F.col("above").alias("next"), F.concat("path", F.array("next")).alias("path")))
        if going.isEmpty():
            break
    out = ended[0]
    for part in ended[1:]:
        out = out.unionByName(part)
    return steps.result(out)
