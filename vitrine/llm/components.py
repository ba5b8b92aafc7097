"""Connected components of an edge table, as Spark joins with every round written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.tables import few_rows
from vitrine.session import stage


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` of every node of ``a, b`` edges; a component is its smallest node.

    Each round hooks every component to its smallest neighbour, follows that pointer once more
    and writes the labels, so paths shorten by a factor in each round. Only components that
    still have an edge between them are shuffled after the first round.
    """
    edges = stage(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    ends = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).toDF("node", "other")
    labels = stage(ends.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("component")), "labels")
    while True:
        at_a, at_b = labels.toDF("a", "ca"), labels.toDF("b", "cb")
        crossing = (
            edges.join(at_a, "a").join(at_b, "b").filter("ca <> cb")
            .groupBy(F.greatest("ca", "cb").alias("high")).agg(F.min(F.least("ca", "cb")).alias("low"))
        )
        hooks = stage(crossing, "hooks")
        if hooks.isEmpty():
            return labels
        further = hooks.toDF("low", "lower")
        jumped = stage(hooks.join(further, "low", "left").select(F.col("high").alias("component"), F.coalesce("lower", "low").alias("to")), "jumps")
        labels = stage(
            labels.join(few_rows(jumped), "component", "left").select("node", F.coalesce("to", "component").alias("component")), "labels"
        )
