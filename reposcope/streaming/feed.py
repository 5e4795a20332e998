"""The change feed: file changes into mutations, mutations into a node table, presence.

Every stream job has a batch twin that runs the same code.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from reposcope.functions.paths import node_label, node_type


def mutations(changes: DataFrame) -> DataFrame:
    """Changes with action (add, delete, update) and the type and label of the file's node."""
    action = F.when(F.col("change") == "added", "add").when(F.col("change") == "deleted", "delete").otherwise("update")
    return changes.withColumns({"action": action, "type": node_type(F.col("path")), "label": node_label(F.col("path"))})


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row per key; maxima combine before the shuffle."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    last = F.max(F.struct(*order, *rest)).alias("last")
    return rows.groupBy(*keys).agg(last).select(*keys, *[f"last.{c}" for c in [*order, *rest]])


def apply_mutations(nodes: DataFrame, batch: DataFrame) -> DataFrame:
    """The node table (repo_id, node_id, type, label) after a batch of mutations; the last one per node decides."""
    last = latest(batch, ["repo_id", "node_id"], ["ts", "event_id"])
    stay = nodes.join(last, ["repo_id", "node_id"], "left_anti")
    return stay.unionByName(last.filter("action <> 'delete'").select("repo_id", "node_id", "type", "label"))


def follow(changes: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Keeps a node table up to date from a stream of changes: `read` gives it, `write` replaces it."""

    def fold(batch: DataFrame, _: int) -> None:
        write(apply_mutations(read(), mutations(batch)))

    return changes.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def touched_repositories(changes: DataFrame) -> DataFrame:
    """(repo_id, changes): repositories whose graph has to be computed again."""
    return changes.groupBy("repo_id").agg(F.count(F.lit(1)).alias("changes"))


def presence(pings: DataFrame, seconds: float = 10.0) -> DataFrame:
    """(project_id, user_id, kind, ts): the last ping of each user, unless it is a leave or older than the newest of the project."""
    last = latest(pings.select("project_id", "user_id", "ts", "kind"), ["project_id", "user_id"], ["ts", "kind"])
    newest = pings.groupBy("project_id").agg(F.max("ts").alias("newest"))
    fresh = F.col("newest").cast("timestamp").cast("double") - F.col("ts").cast("timestamp").cast("double") <= seconds
    return last.join(newest, "project_id").filter((F.col("kind") != "leave") & fresh).select("project_id", "user_id", "kind", "ts")


def subscription_state(events: DataFrame) -> DataFrame:
    """(user_id, tier, status, ts): the state of each subscription after its billing events (user_id, kind, status, ts, event_id), in order.

    The latest event that says a tier and the latest that says a status count;
    other kinds change nothing.
    """
    said = F.when(F.col("status").isin("active", "trialing"), "active").when(F.col("status") == "past_due", "past_due").otherwise("canceled")
    status = F.when(F.col("kind").isin("checkout.session.completed", "invoice.paid"), "active").when(F.col("kind") == "customer.subscription.updated", said).when(F.col("kind") == "customer.subscription.deleted", "canceled")
    tier = F.when(F.col("kind") == "checkout.session.completed", "pro").when(F.col("kind") == "customer.subscription.updated", F.when(said == "canceled", "free").otherwise("pro")).when(F.col("kind") == "customer.subscription.deleted", "free")
    rows = events.select("user_id", "ts", "event_id", status.alias("status"), tier.alias("tier")).filter("status IS NOT NULL")
    order = F.struct("ts", "event_id")
    return rows.groupBy("user_id").agg(F.max_by("tier", F.when(F.col("tier").isNotNull(), order)).alias("tier"), F.max_by("status", order).alias("status"), F.max("ts").alias("ts"))
