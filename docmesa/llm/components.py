"""Connected components of a distributed list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmesa.llm.common import materialise


def components(edges: DataFrame) -> DataFrame:
    """edges: columns a, b. Returns a row for each node that has an edge: node, root (the smallest node of its component).

    Each round hooks every root to the smallest root beside it and then jumps along the hooks, so
    a chain of n nodes takes about log n rounds. Rounds end in tables of the shared folder;
    nothing but a count comes to the driver. Edges with a null end are left out; loops only name their node.
    """
    edges = edges.select("a", "b").filter("a is not null and b is not null")
    edges = materialise(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = materialise(edges.select(F.explode(F.array("a", "b")).alias("node"), F.col("a").alias("low")).groupBy("node").agg(F.min("low").alias("root")), "labels")
    while True:
        # edges between roots; the first rounds leave few of them
        left = edges.join(labels.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a")
        both = left.join(labels.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        hooks = both.filter("ra != rb").groupBy(F.greatest("ra", "rb").alias("node")).agg(F.min(F.least("ra", "rb")).alias("root"))
        chain = labels.filter("node != root").select("node", "root")  # a root may itself have been hooked
        hooks = materialise(hooks.unionByName(chain).groupBy("node").agg(F.min("root").alias("root")), "hooks")
        up = hooks.select(F.col("node").alias("root"), F.col("root").alias("up"))
        moved = labels.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved"))
        moved = materialise(moved, "labels")
        if moved.filter("moved").limit(1).count() == 0:
            return labels
        labels = moved.drop("moved")
