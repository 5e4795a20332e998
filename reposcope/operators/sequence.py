"""Ranks and neighbours within groups, without a group becoming the work of one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reposcope.sources.tables import written


def ranked(rows: DataFrame, group: list[str], by: list[str], name: str = "rank") -> DataFrame:
    """`rows` with their number (from 1) within the group in the order of `by`.

    Rows are sorted by a range exchange, so a large group lies in many
    partitions. A row's number is its place in its partition plus the group's
    rows in earlier partitions, of which there are no more sums than partitions
    and groups together. Rows equal in `by` are numbered in any order.
    """
    placed = rows.repartitionByRange(*group, *by).sortWithinPartitions(*group, *by).withColumn("row_at", F.monotonically_increasing_id())
    placed = written(placed.withColumn("row_piece", F.shiftright("row_at", 33).cast("int")).withColumn("row_at", F.col("row_at").bitwiseAND(F.lit((1 << 33) - 1))))
    counts = placed.groupBy("row_piece", *group).agg(F.count(F.lit(1)).alias("row_count"), F.min("row_at").alias("row_first"))
    earlier = Window.partitionBy(*group).orderBy("row_piece").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("row_count").over(earlier), F.lit(0)) - F.col("row_first") + 1
    offsets = counts.select(F.col("row_piece").alias("of_piece"), *[F.col(g).alias(f"of_{g}") for g in group], before.alias("row_before"))
    # groups may be null, and every row finds the offset of its own partition and group
    same = F.col("row_piece") == F.col("of_piece")
    for g in group:
        same &= F.col(g).eqNullSafe(F.col(f"of_{g}"))
    return placed.join(offsets, same).select(*rows.columns, (F.col("row_at") + F.col("row_before")).cast("int").alias(name))


def following(rows: DataFrame, group: list[str], by: list[str], key: str, name: str) -> DataFrame:
    """(group, key, name): each row's key with the key of the next row of its group in the order of `by`; the last row has none and is left out."""
    numbered = written(ranked(rows.select(*dict.fromkeys([*group, *by, key])).distinct(), group, by).select(*group, key, "rank"))
    after = numbered.select(*group, F.col(key).alias(name), (F.col("rank") - 1).alias("rank"))
    return numbered.join(after, [*group, "rank"]).select(*group, key, name)


def sorted_routes(routes: DataFrame) -> DataFrame:
    """(repo_id, route, position): static routes first, then those with parameters, then catch-alls, each by name."""
    kind = F.when(F.col("route").contains("*"), 2).when(F.col("route").contains(":"), 1).otherwise(0)
    return ranked(routes.distinct().withColumn("kind", kind), ["repo_id"], ["kind", "route"], "position").select("repo_id", "route", "position")
