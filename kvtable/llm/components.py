"""Connected components of a graph of links, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame) -> DataFrame:
    """node, component (a node of it, the same for all) for every node of edges (left, right: of one orderable type).

    The graph is contracted: every node points to the smallest among itself and its neighbours, and
    then to what that one points to; edges go on between the nodes pointed to, without loops and
    repeats. At least half of the nodes go in a round, so the rounds grow with the logarithm of a
    component's width, and each costs no more than the edges that are left. Nulls and loops are no links.
    """
    work = edges.filter("left != right").select(F.least("left", "right").alias("a"), F.greatest("left", "right").alias("b")).distinct()
    work = materialize(work, "component-edges")
    labels = None
    while labels is None or work.limit(1).count():
        both = work.select(F.col("a").alias("node"), F.col("b").alias("other")).union(work.select("b", "a"))
        to = materialize(both.groupBy("node").agg(F.least("node", F.min("other")).alias("to")), "component-steps")
        beyond = to.select(F.col("node").alias("to"), F.col("to").alias("beyond"))
        to = materialize(to.join(beyond, "to").select("node", F.col("beyond").alias("to")), "component-steps")
        if labels is None:
            labels = to.select("node", F.col("to").alias("component"))
        else:
            moved = to.select(F.col("node").alias("component"), "to")
            labels = labels.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
            labels = materialize(labels, "component-labels")
        step = lambda end: to.select(F.col("node").alias(end), F.col("to").alias(f"{end}_to"))  # noqa: E731, B023
        work = work.join(step("a"), "a").join(step("b"), "b").filter("a_to != b_to")
        work = materialize(work.select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct(), "component-edges")
    return labels
