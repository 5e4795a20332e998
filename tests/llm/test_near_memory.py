"""Near-dedup holds no table in the driver or a worker that grows with the documents."""

import random

import pyarrow as pa
from pyspark.sql import functions as F
from test_dedup import prose

from reposcope.llm import common, minhash_dedup


def test_signatures_are_not_broadcast(spark, documents):
    rng = random.Random(3)
    rows = [(i, prose(rng, 40, 60)) for i in range(50)]
    keyed = common.with_fingerprint(common.keyed_text(documents(rows)))
    nodes = minhash_dedup.nodes_of(minhash_dedup.document_signatures(keyed, 2))
    pairs = nodes.select(F.col("node").alias("a"), (F.col("node") + 1).alias("b"), F.col("node").alias("la"), F.col("node").alias("lb"))
    for made in (minhash_dedup.postings(nodes, 80), minhash_dedup.colliding(pairs, nodes)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_small_batches(spark):
    texts = spark.range(6000).repartition(1).select("id", F.repeat(F.lit("x"), 2000).alias("text"))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes], pa.int64())], ["bytes"])

    before = spark.conf.get(common.BATCH_LIMIT)
    with common.small_batches(spark):
        most = texts.mapInArrow(run, "bytes long").agg(F.max("bytes")).first()[0]
    assert most < 2 * common.BATCH_BYTES
    assert spark.conf.get(common.BATCH_LIMIT) == before
