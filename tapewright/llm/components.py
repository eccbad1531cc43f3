"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.llm.common import drop_table, written


def components(edges: DataFrame) -> DataFrame:
    """edges (a long, b long) -> (node, label): label is the least node of its component. Nodes without an edge have no row.

    In a round every node joins its least neighbour, or that one's own choice, and edges are drawn anew between the nodes that are left: what a round
    reads shrinks by a factor, where nodes are in no particular order as hashes are. Then labels are carried back, round by
    round. Every round is a table in the shared folder; nothing is collected but a flag."""
    both = edges.filter("a <> b").select("a", "b").union(edges.filter("a <> b").select("b", "a")).distinct()
    both = written(both, "edges")
    rounds: list[DataFrame] = []
    while not both.isEmpty():
        to = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("up")).withColumnRenamed("a", "node")
        to = written(to, "steps")
        jump = to.select(F.col("node").alias("up"), F.col("up").alias("jump"))
        step = written(to.join(jump, "up").select("node", F.col("jump").alias("up")), "steps")
        drop_table(to)
        rounds.append(step)
        a, b = (step.select(F.col("node").alias(c), F.col("up").alias(f"up_{c}")) for c in "ab")
        left = both.filter("a < b").join(a, "a").join(b, "b").filter("up_a <> up_b").select(F.least("up_a", "up_b").alias("a"), F.greatest("up_a", "up_b").alias("b")).distinct()
        left = written(left.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*"), "edges")
        drop_table(both)
        both = left
    if not rounds:
        return both.select(F.col("a").alias("node"), F.col("b").alias("label"))
    labels = rounds[-1].select("node", F.col("up").alias("label"))
    for step in reversed(rounds[:-1]):
        later = labels.select(F.col("node").alias("up"), F.col("label").alias("later"))
        labels = step.join(later, "up", "left").select("node", F.coalesce("later", "up").alias("label"))
    labels = written(labels, "labels")
    for step in rounds:
        drop_table(step)
    return labels
