"""Parent-child links to full hierarchies: level-wise frontier joins from the roots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackweave.runtime import BROADCAST_ROWS, cut

#: Levels joined in one job while the links are few enough to be broadcast.
LEVELS = 32
#: Path entries of a frontier up to which it is broadcast.
ENTRIES = 1_000_000
PATH = T.ArrayType(T.LongType())


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def clean_links(nodes: DataFrame, node: str, parent: str) -> DataFrame:
    """(node, parent) per node of `nodes`: a parent that is null, negative, the node itself or no node becomes null.

    `nodes` holds one row per node; rows without a node are left out.
    """
    n = nodes.where(F.col(node).isNotNull()).select(F.col(node).cast("long").alias("node"), F.col(parent).cast("long").alias("parent"))
    known = n.select(F.col("node").alias("parent"), F.lit(True).alias("_known"))
    wanted = n.where((F.col("parent") >= 0) & (F.col("parent") != F.col("node")))
    kept = wanted.join(known, "parent", "left").where("_known").select("node", "parent")
    return n.select("node").join(kept, "node", "left")


def hierarchy(
    links: DataFrame,
    paths: bool = True,
    broadcast_rows: int = BROADCAST_ROWS,
    levels: int = LEVELS,
    trace: list[tuple[int, int]] | None = None,
    start: DataFrame | None = None,
) -> DataFrame:
    """(node, root, depth, path) of every node of `links` (node, parent; null parent = root).

    From the roots (depth 0) each level joins the frontier with the links whose parent it holds, extending path
    (root first, node last) and depth, until a frontier is empty. The size of the data decides only how a level is
    joined: where the links not reached yet are counted to be at most broadcast_rows, their children are broadcast once
    and `levels` levels are joined before the next cut; else every level is cut, by a broadcast of a counted small
    frontier or by a shuffle, and the links are written anew once half of them were reached. Nodes that no level
    reaches lie on a cycle or lead into one: root = depth = -1 and a null path. No links: no rows. With paths=False
    path is null. `trace` collects (levels joined, nodes found) of every job. With `start` (node) only the trees below these
    nodes are walked, as if they were roots, and only their nodes come out.
    """
    links = links if start is None else links.join(start.select("node", F.lit(True).alias("_start")).distinct(), "node", "left")
    links = cut(links if start is None else links.withColumn("parent", F.when(F.col("_start").isNull(), F.col("parent"))))
    path = F.array("node") if paths else F.lit(None).cast(PATH)
    frontier = links.where("parent IS NULL" if start is None else "_start").select(
        "node", F.col("node").alias("root"), F.lit(0).cast("long").alias("depth"), path.alias("path")
    )
    grown = F.concat("path", F.array("node")) if paths else F.col("path")
    rest = links.where("parent IS NOT NULL").select("node", "parent")
    n_links, n = rest.count(), frontier.count()
    left, stale, level, found, kids = n_links, 0, 0, [frontier], None
    while n and left:
        if n_links - stale <= broadcast_rows:
            kids = kids or cut(_firsts(rest))
            reached = cut(_join_levels(frontier, kids, paths, levels))
            frontier = reached.where("open").drop("open")
            got, n = reached.agg(F.count("*"), F.count_if("open")).first()
            found.append(reached.drop("open"))
            level += levels
        else:
            level += 1
            f = frontier.select(F.col("node").alias("parent"), "root", "depth", "path")
            f = F.broadcast(f) if n <= broadcast_rows and n * level <= ENTRIES else f
            frontier = cut(rest.join(f, "parent").select("node", "root", (F.col("depth") + 1).alias("depth"), grown.alias("path")))
            got = n = frontier.count()
            found.append(frontier)
        left -= got
        if trace is not None:
            trace.append((level, got))
        if left and n_links - stale > broadcast_rows and left * 2 <= n_links - stale:
            rest = cut(rest.join(_union(found[1:]).select("node"), "node", "left_anti"))
            stale = n_links - left
    every = _union(found)
    if not left or start is not None:
        return every
    minus = F.lit(-1).cast("long")
    lost = rest.join(_union([f.select("node") for f in found[1:]]), "node", "left_anti") if len(found) > 1 else rest
    return every.unionByName(lost.select("node", minus.alias("root"), minus.alias("depth"), F.lit(None).cast(PATH).alias("path")))


def _firsts(rest: DataFrame) -> DataFrame:
    """(of, node, first) of every link; first marks one child of each parent."""
    least = rest.groupBy("parent").agg(F.min("node").alias("_least"))
    return rest.join(least, "parent").select(F.col("parent").alias("of"), "node", (F.col("node") == F.col("_least")).alias("first"))


def _join_levels(frontier: DataFrame, kids: DataFrame, paths: bool, levels: int) -> DataFrame:
    """(node, root, depth, path, open) of the nodes up to `levels` levels below the frontier; open: the lowest of them.

    Every level joins the nodes of the one before with their children, by one broadcast that all levels share. A node
    with several children then stands in several rows; it comes out of the one that goes on with first children only.
    """
    names = [f"k{i}" for i in range(1, levels + 1)]
    on = " ".join(f"LEFT JOIN {{kids}} {k} ON {k}.of = {before}.node" for before, k in zip(["f", *names], names))
    other = ", ".join(f"CASE WHEN NOT {k}.first THEN {i} END" for i, k in enumerate(names, 1))
    at = frontier.sparkSession.sql(  # one statement, as Spark analyses every step of a chain of frames anew
        f"""SELECT /*+ BROADCAST({", ".join(names)}) */ f.root, f.depth, f.path,
          array_compact(array({", ".join(f"{k}.node" for k in names)})) AS _below, greatest(0, 0, {other}) AS _other
        FROM {{frontier}} f {on}""",
        frontier=frontier,
        kids=kids,
    )
    at = at.select("root", "depth", "path", "_below", "_other", F.posexplode("_below").alias("_at", "node")).where("_at + 1 >= _other")
    path = F.concat("path", F.slice("_below", 1, F.col("_at") + 1)) if paths else F.col("path")
    return at.select("node", "root", (F.col("depth") + F.col("_at") + 1).alias("depth"), path.alias("path"), (F.col("_at") + 1 == levels).alias("open"))


def ancestor_pairs(tree: DataFrame) -> DataFrame:
    """(ancestor, node, distance) for every node and each of its ancestors, from the paths of `hierarchy`.

    Read from the ancestor's side these are all descendants. The rows are the result itself: one per pair asked for.
    Nodes without a path (cycles) have none.
    """
    return (
        tree.where("depth > 0")
        .select("node", "depth", F.posexplode("path").alias("at", "ancestor"))
        .where("at < depth")
        .select("ancestor", "node", (F.col("depth") - F.col("at")).alias("distance"))
    )


def cycles(links: DataFrame, tree: DataFrame) -> DataFrame:
    """(node, on_cycle) of the unreached nodes: those left after peeling off, level by level, what nothing points at.

    on_cycle is false for nodes that only lead into a cycle.
    """
    lost = tree.where("depth = -1").select("node")
    left = cut(links.join(lost, "node", "left_semi").select("node", "parent"))
    n = left.count()
    every = left
    while n:
        kept = cut(left.join(left.select(F.col("parent").alias("node")).distinct(), "node", "left_semi"))
        m = kept.count()
        left = kept
        if m == n:
            break
        n = m
    on = left.select("node", F.lit(True).alias("on_cycle"))
    return every.select("node").join(on, "node", "left").select("node", F.coalesce("on_cycle", F.lit(False)).alias("on_cycle"))
