"""Connected components of a graph given by its edges, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of ``edges`` (u, v): label is its component's smallest node.

    In each step a node goes to the smallest of itself and its neighbours, and every edge goes
    with its ends, so no connection is lost; the smallest node of a component stays where it is,
    and at the end all others have come to it. Each step is written to the shared folder.
    """
    edges = written(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        to = written(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("to")), "contraction")
        if labels is None:
            labels = to.select(F.col("u").alias("node"), F.col("to").alias("label"))
        else:
            labels = written(labels.join(to, F.col("label") == F.col("u"), "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
        a, b = to.select(F.col("u"), F.col("to").alias("u2")), to.select(F.col("u").alias("v"), F.col("to").alias("v2"))
        moved = edges.join(a, "u").join(b, "v").where("u2 <> v2")
        edges = written(moved.select(F.least("u2", "v2").alias("u"), F.greatest("u2", "v2").alias("v")).distinct(), "edges")
    return labels if labels is not None else edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
