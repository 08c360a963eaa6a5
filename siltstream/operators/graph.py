"""Connected components over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstream.plans.shared import stage


def _state(edges: DataFrame) -> tuple:
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(h.cast("decimal(20,0)"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge; root is the smallest node of its component.

    Alternates two star contractions, so that chains of any length shrink in a number of rounds
    that grows with the logarithm of their length. Each round is two aggregations and two joins
    on the nodes and is written to the shared folder. Null ends and loops don't count.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    pairs = stage(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    before = _state(pairs)
    if not before[0]:
        return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for _ in range(max_rounds):
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        pairs = stage(small.where("a <> b").distinct(), "cc")
        now = _state(pairs)
        if now == before:
            roots = pairs.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
        before = now
    raise RuntimeError(f"no fixed point in {max_rounds} rounds")


def component_changes(roots: DataFrame, added: DataFrame, removed: DataFrame | None = None, edges: DataFrame | None = None) -> DataFrame:
    """(node, root): nodes whose component the edges added and removed (a, b) have changed, new nodes among them.

    roots (node, root) is what is stored, of the edges before. Only the roots at the ends of new edges are united, by a graph that
    has a node for each of them. A component that has lost an edge is taken apart and put together again from its own part of
    ``edges``, all edges that there are now. A node without edges is its own root. Null ends and loops don't count.
    """
    ends = lambda d: d.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    real = lambda d: d.select("a", "b").where("a is not null and b is not null and a <> b")
    links, loose = real(added), None
    if removed is not None:
        torn = roots.join(ends(real(removed)), "node").select("root").distinct()
        loose = stage(roots.join(torn, "root").select("node"), "loose")
        inside = real(edges).join(loose.select(F.col("node").alias("a")), "a", "left_semi").join(loose.select(F.col("node").alias("b")), "b", "left_semi")
        links = links.unionByName(inside).distinct()
    links = stage(links, "links")
    # the roots of all ends: nodes that are loose or new stand for themselves
    known = roots if loose is None else roots.join(loose, "node", "left_anti")
    found = ends(links).join(known, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    if loose is not None:
        found = found.unionByName(loose.join(ends(links), "node", "left_anti").select("node", F.col("node").alias("root")))
    found = stage(found, "ends")
    of = lambda side: found.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}"))
    between = links.join(of("a"), "a").join(of("b"), "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
    joined = connected_components(between).select(F.col("node").alias("root"), F.col("root").alias("_new"))
    moved = known.join(joined.where("root <> _new"), "root").select("node", F.col("_new").alias("root"))
    fresh = found.join(known.select("node"), "node", "left_anti").join(joined, "root", "left").select("node", F.coalesce("_new", "root").alias("root"))
    changes = moved.unionByName(fresh)
    if loose is None:
        return changes
    # what was taken apart and came together as it was has not changed
    was = roots.select("node", F.col("root").alias("_was"))
    return changes.join(was, "node", "left").where("_was is null or _was <> root").select("node", "root")
