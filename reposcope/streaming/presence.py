"""Who is present: a stream with state and timers, and the batch job that tells the same events.

A user is present from a ping on, until a leave or until no ping has come for
some seconds of event time. The stream holds a user's pings back until the
watermark has passed them and then takes them in the order of their times, so
what it tells does not depend on the order or the batches in which they arrive.
"""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from reposcope.sources.tables import shared_folder

KEYS = ["project_id", "user_id"]
STALE_SECONDS = 10.0
_EVENTS = "project_id string, user_id string, event string, micros long"
#: Pings that the watermark has not passed yet, the last one that it has, and whether the user is present.
_STATE = "times array<long>, kinds array<string>, last long, present boolean"


def _told(rows: DataFrame) -> DataFrame:
    return rows.select(*KEYS, "event", F.timestamp_micros("micros").alias("ts"))


def presence_stream(pings: DataFrame, delay: str, seconds: float = STALE_SECONDS) -> DataFrame:
    """(project_id, user_id, event, ts): join, leave and expire of users, from a stream of pings (project_id, user_id, kind, ts).

    `delay` is how late a ping may come; later ones are dropped. A kind other
    than leave is a sign of life; pings without a project, user or time are
    dropped. Events are told when the watermark has passed them; a user's state
    is the pings of the delay, and is removed when the user is gone.
    """
    stale = round(seconds * 1_000_000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, kinds, last, present = state.get if state.exists else ([], [], None, False)
        waiting = list(zip(times, kinds))
        for batch in batches:
            waiting += zip(batch["micros"].tolist(), batch["kind"].tolist())
        waiting.sort()
        mark, out = state.getCurrentWatermarkMs() * 1000, []
        passed = [p for p in waiting if p[0] <= mark]
        for at, kind in passed:
            if present and at - last > stale:
                out.append(("expire", last + stale))
                present = False
            if kind == "leave":
                if present:
                    out.append(("leave", at))
                present = False
            else:
                if not present:
                    out.append(("join", at))
                present, last = True, at
        if present and mark - last > stale:
            out.append(("expire", last + stale))
            present = False
        waiting = waiting[len(passed) :]
        if waiting or present:
            state.update(([t for t, _ in waiting], [k for _, k in waiting], last, present))
            due = [at for at, _ in waiting[:1]] + ([last + stale] if present else [])
            state.setTimeoutTimestamp(max(min(due) // 1000, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"project_id": key[0], "user_id": key[1], "event": [e for e, _ in out], "micros": pd.array([m for _, m in out], "int64")})

    rows = pings.select("project_id", "user_id", F.when(F.col("kind") == "leave", "leave").otherwise("move").alias("kind"), F.col("ts").cast("timestamp").alias("ts"))
    rows = rows.filter("project_id IS NOT NULL AND user_id IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", delay).withColumn("micros", F.unix_micros("ts"))
    return _told(rows.groupBy(*KEYS).applyInPandasWithState(step, _EVENTS, _STATE, "append", GroupStateTimeout.EventTimeTimeout))


def presence_events(pings: DataFrame, clock: Column, seconds: float = STALE_SECONDS) -> DataFrame:
    """The same events from a table of pings, at a clock (a timestamp) that the pings up to it have."""
    stale = round(seconds * 1_000_000)
    rows = pings.select("project_id", "user_id", F.when(F.col("kind") == "leave", "leave").otherwise("move").alias("kind"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.unix_micros(clock).alias("clock"))
    w = Window.partitionBy(*KEYS).orderBy("at", "kind")
    rows = rows.filter("project_id IS NOT NULL AND user_id IS NOT NULL AND at <= clock")
    rows = rows.select("*", F.lag("at").over(w).alias("before"), F.lag("kind").over(w).alias("was"), F.lead("at").over(w).isNull().alias("newest"))
    alive = (F.col("was") == "move") & (F.col("at") - F.col("before") <= stale)
    event = lambda ask, name, at: F.when(ask, F.struct(F.lit(name).alias("event"), at.alias("micros")))
    found = F.array(
        event((F.col("was") == "move") & ~alive, "expire", F.col("before") + stale),
        event((F.col("kind") == "leave") & alive, "leave", F.col("at")),
        event((F.col("kind") == "move") & ~F.coalesce(alive, F.lit(False)), "join", F.col("at")),
        event(F.col("newest") & (F.col("kind") == "move") & (F.col("clock") - F.col("at") > stale), "expire", F.col("at") + stale),
    )
    return _told(rows.select(*KEYS, F.explode(F.array_compact(found)).alias("e")).select(*KEYS, "e.*"))


def present(events: DataFrame) -> DataFrame:
    """(project_id, user_id): who has joined last and not gone since."""
    # an expire or leave at the time of a join comes before it
    last = events.groupBy(*KEYS).agg(F.max(F.struct("ts", (F.col("event") == "join").alias("joined"))).alias("last"))
    return last.filter("last.joined").select(*KEYS)


def told_so_far(pings: DataFrame, delay: str, seconds: float = STALE_SECONDS) -> DataFrame:
    """What `presence_stream` tells of all that a stream holds now, as a table in the shared folder.

    The events are appended as Parquet by Spark's own sink, whose log makes a
    batch that is told again count once.
    """
    spark = pings.sparkSession
    folder = f"{shared_folder(spark)}/presence/{uuid4().hex}"
    out = presence_stream(pings, delay, seconds)
    query = out.writeStream.format("parquet").option("path", f"{folder}/events").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/events")
