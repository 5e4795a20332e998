"""Presence as a stream: the same events as the batch job, whatever the order and batches of arrival."""

import random
from collections import Counter

from pyspark.sql import functions as F
from test_reference import spark  # noqa: F401

from reposcope.streaming.presence import presence_events, presence_stream, present

PINGS = "project_id string, user_id string, kind string, ts timestamp"


def pings(spark, rows):  # noqa: F811
    made = spark.createDataFrame([(p, u, k, int(t * 1_000_000)) for p, u, k, t in rows], "project_id string, user_id string, kind string, m long")
    return made.select("project_id", "user_id", "kind", F.timestamp_micros("m").alias("ts"))


def events(df):
    return Counter((r["project_id"], r["user_id"], r["event"], round(r["ts"].timestamp(), 6)) for r in df.collect())


class Feed:
    """A folder that a stream reads, one file a batch, and what it has told so far."""

    def __init__(self, spark, folder, delay):  # noqa: F811
        self.spark, self.folder, self.delay, self.told = spark, folder, delay, Counter()

    def put(self, k, rows):
        pings(self.spark, rows).coalesce(1).write.mode("append").parquet(f"{self.folder}/in/{k:03d}")

    def run(self):
        """Starts from the checkpoint, takes all there is and stops."""
        stream = self.spark.readStream.schema(PINGS).option("maxFilesPerTrigger", 1).parquet(f"{self.folder}/in/*")

        def keep(batch, _):
            self.told += events(batch)

        out = presence_stream(stream, self.delay).writeStream.foreachBatch(keep).outputMode("append").option("checkpointLocation", f"{self.folder}/c")
        out.trigger(availableNow=True).start().awaitTermination(300)


def clock(t):
    return F.timestamp_micros(F.lit(int(t * 1_000_000)))


def test_stream_equals_batch_over_a_restart(spark, tmp_path):  # noqa: F811
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    rng = random.Random(3)
    rows = [(f"p{rng.randrange(2)}", f"u{rng.randrange(4)}", rng.choice(["move", "move", "move", "leave"]), 1000 + k + rng.choice([0, 0.5])) for k in range(0, 150, 2)]
    rows += [("p0", "edge", "move", 1010), ("p0", "edge", "move", 1020), ("p0", "edge", "move", 1030.001), ("p1", "edge", "move", 1010), ("p1", "edge", "move", 1019.999), (None, "x", "move", 1015), ("p0", None, "leave", 1016)]
    arrival = sorted(rows, key=lambda r: r[3] + rng.random() * 8)  # up to eight seconds out of order
    feed = Feed(spark, str(tmp_path), "20 seconds")
    files = [arrival[k : k + 20] for k in range(0, len(arrival), 20)]
    for k, part in enumerate(files[:2]):
        feed.put(k, part)
    feed.run()
    for k, part in enumerate([*files[2:], [("p9", "end", "move", 1300)]]):
        feed.put(10 + k, part)
    feed.run()
    want = events(presence_events(pings(spark, rows), clock(1280)))
    assert feed.told == want and sum(want.values()) > 30
    edge = sorted((e, t) for p, u, e, t in want if (p, u) == ("p0", "edge"))
    assert edge == [("expire", 1030), ("expire", 1040.001), ("join", 1010), ("join", 1030.001)]
    feed.put(30, [("p0", "u0", "move", 1270), ("p0", "late", "move", 1279), ("p9", "end", "leave", 1301), ("p9", "end", "move", 1330)])
    feed.run()
    after = feed.told - want
    assert after == Counter([("p9", "end", "join", 1300.0), ("p9", "end", "leave", 1301.0)])  # those before the watermark are dropped


def test_batch_cases(spark):  # noqa: F811
    rows = [("p", "a", "move", 0), ("p", "a", "move", 5), ("p", "b", "move", 14), ("p", "b", "leave", 15), ("p", "c", "move", 4.999), ("p", "d", "move", 15), ("p", "d", "move", 15), ("p", "e", "leave", 3), ("p", "f", "leave", 6), ("p", "f", "move", 6)]
    told = presence_events(pings(spark, rows), clock(15))
    assert sorted(r["user_id"] for r in present(told).collect()) == ["a", "d", "f"]
    assert presence_events(pings(spark, []), clock(15)).count() == 0 and events(told)["p", "c", "expire", 14.999] == 1
