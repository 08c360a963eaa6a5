"""Campaigns kept up to date: stored groups are changed by new and vanished links only (ST8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstream.operators import campaigns as C
from siltstream.operators.graph import component_changes
from siltstream.plans.shared import stage
from siltstream.streaming.buckets import Buckets, Part
from siltstream.streaming.mapped import MappedLog


class Groups:
    """Edges and the root of each node, bucketed by node; an update rewrites the buckets of what has changed."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.store = Buckets(spark, path, buckets)

    def update(self, edges: DataFrame) -> DataFrame:
        """Take ``edges`` (a, b) as all that there are now; (node, root) of the nodes whose group has changed.

        Finding which edges are new or gone compares both tables once; the rounds of contraction run on the roots at
        their ends, not on the graph. An edge that vanishes (a key has become too common) can split a group.
        """
        now = stage(edges.select("a", "b").where("a is not null and b is not null and a <> b").distinct(), "edges")
        old = self.store.read("edges", now)
        roots = self.store.read("roots", now.select(F.col("a").alias("node"), F.col("b").alias("root")))
        added, removed = stage(now.join(old, ["a", "b"], "left_anti"), "added"), stage(old.join(now, ["a", "b"], "left_anti"), "removed")
        some = bool(removed.head(1))
        changes = stage(component_changes(roots, added, removed if some else None, now if some else None), "changes")
        parts = {}
        if touched := self.store.touched(added.unionByName(removed), "a"):
            here = self.store.of("a").isin(touched)
            parts["edges"] = Part(now.where(here), "a", touched)
        if touched := self.store.touched(changes, "node"):
            kept = self.store.read("roots", roots, touched).join(changes.select("node"), "node", "left_anti")
            parts["roots"] = Part(kept.unionByName(changes), "node", touched)
        if parts:
            self.store.write(parts)
            self.store.commit()
        return changes

    def read(self) -> DataFrame:
        """(node, root) of all nodes in groups of two or more."""
        roots = self.store.read("roots")
        several = roots.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("root")
        return roots.join(several, "root", "left_semi").select("node", "root")


def regroup(log: MappedLog, groups: Groups) -> DataFrame:
    """(session_id, campaign) after the log has changed: the same as a full build's."""
    tables = {n: log.read(n) for n in ("sessions", "logins", "commands", "downloads", "uploads", "tunnels")}
    features = C.session_features(tables, log.read("fetches"))
    order = C.start_order(tables["sessions"])
    groups.update(C.link_edges(features, order))
    return C.named_members(groups.read(), order)
