"""Exact dedup by a tree-merge of sorted digest runs, in DataFrame operations only.

Input partitions are dealt to runs of (digest, check value, smallest id, rows),
each sorted by digest. Runs are merged in binomial rounds: with a stride of 1, 2,
4, ... run i takes in run i + stride by a sorted merge join on the digest; where
both hold it the smaller identifier is retained and the rows add up. Entries
meet only if digest and an independent check value agree, at every level. A run
is spread over all tasks by digest, so no merge is the work of one; a digest
that a third of all rows share is one entry of a run from the start, because
partitions combine their rows first. After the last round one run is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reposcope.llm.common import NO_ID, forget, keep_rows, keyed_text, read, real_id, written

#: Runs at the leaves of the tree at most; input partitions share them.
RUNS = 64


def normalised(c):
    """A text with each run of ASCII white space replaced by one space."""
    return F.regexp_replace(c, r"[\x20\x09-\x0D]+", " ")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, sha, proof): digest of the normalised text and an independent check value."""
    rows = keyed_text(docs, id_col, text_col).select("id", normalised(F.col("text")).alias("text"))
    return rows.select(
        "id",
        F.sha2("text", 256).alias("sha"),
        F.xxhash64("text", F.length("text")).alias("proof"),
    )


def sorted_runs(rows: DataFrame, runs: int) -> DataFrame:
    """(run, sha, proof, keep, n): the entries of each run, sorted by digest."""
    level = rows.select((F.spark_partition_id() % runs).alias("run"), "sha", "proof", F.col("id").alias("keep"), F.lit(1).cast("long").alias("n"))
    level = level.groupBy("run", "sha", "proof").agg(F.min("keep").alias("keep"), F.sum("n").alias("n"))
    return written(level.sortWithinPartitions("run", "sha"))


def merge_pairs(level: DataFrame, stride: int) -> DataFrame:
    """The round in which run i takes in run i + stride."""
    takes = level.filter(F.col("run") % (2 * stride) == 0)
    gives = level.filter(F.col("run") % (2 * stride) == stride)
    gives = gives.select((F.col("run") - stride).alias("run"), "sha", "proof", F.col("keep").alias("other"), F.col("n").alias("more"))
    merged = takes.join(gives.hint("merge"), ["run", "sha", "proof"], "full_outer")
    zero = F.lit(0).cast("long")
    return merged.select("run", "sha", "proof", F.least("keep", "other").alias("keep"), (F.coalesce("n", zero) + F.coalesce("more", zero)).alias("n"))


def merge_runs(rows: DataFrame, runs: int = RUNS) -> DataFrame:
    """One entry (sha, proof, keep, n) per text, merged through the rounds of a binomial tree."""
    level, stride = sorted_runs(rows, runs), 1
    while stride < runs:
        before, level = level, written(merge_pairs(level, stride).sortWithinPartitions("run", "sha"))
        forget(before)
        stride *= 2
    return level.drop("run")


def leaves(rows: DataFrame) -> int:
    """Runs for a table: a power of two, as many as it has partitions but RUNS at most."""
    return min(RUNS, 1 << max(rows.rdd.getNumPartitions() - 1, 0).bit_length())


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null and empty texts are equal to each other. A null id counts as the
    largest, so it stays only if the whole group has none (keep_id is then
    null). Rows that repeat an id and its text are all marked kept and all
    counted; `drop_copies` leaves one of them. An empty table gives no rows.
    """
    rows = written(digests(docs, id_col, text_col))
    groups = merge_runs(rows, leaves(rows))
    return rows.join(groups, ["sha", "proof"]).select(
        real_id("id").alias("doc_id"),
        real_id("keep").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("id") == F.col("keep")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's columns and rows without exact copies: of equal texts the smallest id stays.

    Rows that repeat both id and text are reduced to one of them.
    """
    rows = written(digests(docs, id_col, text_col))
    kept = merge_runs(rows, leaves(rows)).select("sha", "proof", F.col("keep").alias("id"))
    stay = kept.join(rows.groupBy("sha", "proof", "id").agg(F.count(F.lit(1)).alias("times")), ["sha", "proof", "id"])
    text = normalised(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    key = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID))
    return keep_rows(docs, {"sha": F.sha2(text, 256), "id": key}, stay.select("sha", "id", "times"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read(spark, sf_dir, "documents"))


OP3_SQL = """
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256
)
SELECT t.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, t.doc_id = g.keep_id AS kept, t.text_sha256
FROM t JOIN g USING (text_sha256)
"""
