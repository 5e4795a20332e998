"""Pushes as mutations, and results that are computed again for the repositories that a feed touches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from reposcope.functions.contain import contained
from reposcope.functions.paths import node_label
from reposcope.sources.tables import forget, written
from reposcope.streaming.feed import latest

REPO = "repo_id"
Job = Callable[[DataFrame], DataFrame]

# --- commits ----------------------------------------------------------------------


def pushed_files(pushes: DataFrame) -> DataFrame:
    """(repo_id, event_id, commit_no, file_no, path, change): the files of each push (repo_id, event_id, commits[files[path, change]]), in order.

    Works on a stream as on a table. Pushes without commits, commits without
    files and files without a path give nothing.
    """
    commits = pushes.select(REPO, "event_id", F.posexplode("commits").alias("commit_no", "commit"))
    files = commits.select(REPO, "event_id", "commit_no", F.posexplode("commit.files").alias("file_no", "file"))
    return files.select(REPO, "event_id", "commit_no", "file_no", "file.path", "file.change").filter("path IS NOT NULL")


def commit_mutations(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """(repo_id, event_id, commit_no, file_no, action, node_id, label): what pushed files do to a node table (repo_id, node_id, label).

    An added file makes a node. A deleted or modified one deletes or updates the
    first node whose label holds the file's name or whose label its path holds,
    in any case; one that fits no node does nothing. A file without a name fits
    every node, a node without a label every file. `files` may be a micro-batch
    of a stream, `nodes` is a table.
    """
    key = [REPO, "event_id", "commit_no", "file_no"]
    low = F.lower("path")
    rows = files.select(*key, "path", "change", low.alias("where"), F.substring_index(F.substring_index(low, "/", -1), ".", 1).alias("stem"))
    made = rows.filter("change = 'added'")
    node = F.concat(F.lit("node:"), F.sha2(F.concat_ws("|", *key), 256).substr(1, 16))
    added = made.select(*key, F.lit("add").alias("action"), node.alias("node_id"), node_label(F.col("path")).alias("label"))
    asked = written(rows.filter("change IN ('deleted', 'modified')"))
    known = nodes.select(REPO, "node_id", F.lower(F.coalesce("label", F.lit(""))).alias("low"))
    by_stem = contained(known, "low", asked.select(REPO, "stem"), "stem").groupBy(REPO, "stem").agg(F.min("node_id").alias("a"))
    paths = asked.select(REPO, "where").distinct().withColumn("text", F.col("where"))
    by_path = contained(paths, "text", known.select(REPO, "low"), "low").join(known.groupBy(REPO, "low").agg(F.min("node_id").alias("node_id")), [REPO, "low"]).groupBy(REPO, "where").agg(F.min("node_id").alias("b"))
    ends = known.groupBy(REPO).agg(F.min("node_id").alias("any_node"), F.min(F.when(F.col("low") == "", F.col("node_id"))).alias("blank_node"))
    met = asked.join(by_stem, [REPO, "stem"], "left").join(by_path, [REPO, "where"], "left").join(ends, REPO, "left")
    first = F.least("a", "b", "blank_node", F.when(F.col("stem") == "", F.col("any_node")))
    met = met.withColumn("node_id", first).filter("node_id IS NOT NULL").join(nodes.groupBy(REPO, "node_id").agg(F.min("label").alias("label")), [REPO, "node_id"])
    action = F.when(F.col("change") == "deleted", "delete").otherwise("update")
    return added.unionByName(met.select(*key, action.alias("action"), "node_id", "label"))


# --- tables by repository -----------------------------------------------------------


def replace_repositories(path: str, rows: DataFrame, touched: DataFrame) -> None:
    """Writes the rows of the touched repositories (repo_id) over what a table had of them; the others stay as they are.

    A repository that has no rows any more is written as one empty row, so that
    its old ones go. Writing the same again changes nothing.
    """
    staged = written(rows.join(touched, REPO, "left_semi").withColumn("row_there", F.lit(True)))
    gone = touched.join(staged.select(REPO).distinct(), REPO, "left_anti")
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema if f.name != REPO]
    both = staged.unionByName(gone.select(REPO, *nothing, F.lit(False).alias("row_there")))
    both.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(REPO).parquet(path)
    forget(staged)


def read_repositories(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows that `replace_repositories` has written; none before the first time."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema)
    whole = T.StructType([*schema.fields, T.StructField("row_there", T.BooleanType())])
    return spark.read.schema(whole).parquet(path).filter("row_there").select(*[f.name for f in schema.fields])


FILES = T.StructType([T.StructField(n, T.StringType()) for n in (REPO, "path", "source")])


def recompute(spark: SparkSession, folder: str, changes: DataFrame, jobs: dict[str, Job]) -> None:
    """Applies changes (repo_id, path, source, ts, event_id; a null source deletes) to the files in `folder` and computes the jobs of the touched repositories again.

    Of several changes of a file the last one counts, so applying a batch twice
    is applying it once. Each job's table lies beside the files by its name.
    """
    last = written(latest(changes.filter("repo_id IS NOT NULL AND path IS NOT NULL"), [REPO, "path"], ["ts", "event_id"]).select(REPO, "path", "source"))
    touched = written(last.select(REPO).distinct())
    old = read_repositories(spark, f"{folder}/files", FILES).join(touched, REPO, "left_semi").join(last, [REPO, "path"], "left_anti")
    files = written(old.unionByName(last.filter("source IS NOT NULL")))
    replace_repositories(f"{folder}/files", files, touched)
    for name, job in jobs.items():
        replace_repositories(f"{folder}/{name}", job(files), touched)
    forget(last)
    forget(touched)
    forget(files)


def follow_files(changes: DataFrame, folder: str, jobs: dict[str, Job], checkpoint: str) -> StreamingQuery:
    """`recompute` for each batch of a stream of changes; a batch that comes again after a failure gives the same tables."""

    def fold(batch: DataFrame, _: int) -> None:
        recompute(batch.sparkSession, folder, batch, jobs)

    return changes.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

