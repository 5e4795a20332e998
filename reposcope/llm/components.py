"""Connected components of a table of links, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reposcope.llm.common import forget, written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): for each node of a link the smallest node it reaches.

    Every round takes the smallest label among the neighbours and then follows
    the label's own label, so chains shorten by half; it ends when no label
    changes. Minima are combined on the map side, so a hub of many links is no
    large group. Links with a null end are ignored.
    """
    one = links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    both = written(one.unionByName(one.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    # the first step needs no join: a node's label is its smallest neighbour or itself
    step = written(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("label"), F.lit(True).alias("moved")))
    while not step.filter("moved").isEmpty():
        labels, last = step.select("node", "label"), step
        near = both.join(labels.select(F.col("node").alias("v"), "label"), "v").select(F.col("u").alias("node"), "label")
        # the labels of the neighbours and, from the label's own row, the label's label
        told = near.unionByName(labels.select("node", "label"))
        lower = told.groupBy("node").agg(F.min("label").alias("least"))
        above = labels.select(F.col("node").alias("least"), F.col("label").alias("up"))
        new = lower.join(above, "least").select("node", F.least("least", "up").alias("label"))
        step = written(new.join(labels.withColumnRenamed("label", "old"), "node").select("node", "label", (F.col("label") != F.col("old")).alias("moved")))
        forget(last)
    forget(both)
    return step.select("node", "label")
