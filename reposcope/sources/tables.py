"""Tables in the folder that all executors share, and upserts into tables."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator
from uuid import uuid4

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reposcope.functions.text import keep_first


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one where none is named on a single machine."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoints-"))
    return context.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """`df` as a Parquet table in the shared folder; lineage and size estimates start anew."""
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(table: DataFrame) -> None:
    """Deletes the files of a table that `written` has made; it can't be read any more."""
    spark = table.sparkSession
    for file in table.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of a file from which it is reported and not read.
MOST_BYTES = 1 << 20
#: Files that a task writes or reads, and entries of folders that it lists before it gives the others back.
FILES = 2_000
#: Bytes of texts that a task reads, and those of one batch for Spark.
TASK_BYTES, PIECE_BYTES = 128 << 20, 4 << 20


def read_modules(spark: SparkSession, folder: str, repo_id: str | None = None, most: int = MOST_BYTES) -> DataFrame:
    """(repo_id, path, source, problem) of all files below a folder, with paths relative to it.

    Without a repo_id the first folder of a path is the repository and left out
    of the path. Files of over `most` bytes (too large) and those that are no
    UTF-8 (not text) are rows with a problem and without a source. Large files
    are told by their size and not opened. Files without
    a byte and those whose names begin with _ or . are left out, as Spark does.
    """
    files, root = _found_files(spark, folder)
    below = F.substr("path", F.locate(root, "path") + len(root))
    first = F.substring_index("below", "/", 1)
    own = [F.lit(repo_id).alias("repo_id"), F.col("below").alias("path")] if repo_id is not None else [first.alias("repo_id"), F.substr("below", F.length(first) + 2).alias("path")]
    text = F.col("content").cast("string")
    valid = F.is_valid_utf8(text)
    nothing = F.lit(None).cast("string")
    small = _contents(files.filter(F.col("length") <= most), folder).withColumn("below", below).select(*own, F.when(valid, text).alias("source"), F.when(~valid, "not text").alias("problem"))
    large = files.filter(F.col("length") > most).withColumn("below", below).select(*own, nothing.alias("source"), F.lit("too large").alias("problem"))
    return small.unionByName(large)


def _opened(folder: str) -> tuple[FileSystem, str]:
    """Arrow's filesystem of a folder and its path there."""
    system, root = FileSystem.from_uri(folder if ":" in folder else f"file://{folder}")
    return system, re.sub(r"/+$", "", root)


def _left_out(name: str) -> bool:
    """Whether Spark's listing passes a file or folder of this name over."""
    return (name.startswith("_") and "=" not in name and not name.startswith(("_metadata", "_common_metadata"))) or name.startswith(".") or name.endswith("._COPYING_")


def _found_files(spark: SparkSession, folder: str) -> tuple[DataFrame, str]:
    """(path, length), and content where Spark reads it, of all files below a folder, and what their paths begin with.

    Tasks list the folders: each goes down from those it has until it has listed
    enough, and what is left is dealt anew, so no process holds all files. Where
    Arrow can't open the folder, Spark's reader lists it, which holds them on the driver.
    """
    try:
        system, root = _opened(folder)
        listed = system.get_file_info(root or "/").type == FileType.Directory
    except (OSError, ValueError, NotImplementedError):
        listed = False
    if not listed:
        return _read_by_spark(spark, folder), re.sub(r"/+$", "", folder) + "/"

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = _opened(folder)
        out = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], names=["path", "length"])
        for batch in batches:
            for at in batch.column(0).to_pylist():
                todo, n = [at], 0
                while todo and n < FILES:
                    infos = [i for i in system.get_file_info(FileSelector(todo.pop() or "/")) if not _left_out(i.base_name)]
                    n += 1 + len(infos)
                    todo += [i.path for i in infos if i.type == FileType.Directory]
                    found = [(i.path, i.size) for i in infos if i.type == FileType.File and i.size]
                    for k in range(0, len(found), FILES):
                        yield out(found[k : k + FILES])
                yield out([(path, None) for path in todo])

    front, parts = spark.createDataFrame([(root,)], "path string"), []
    while True:
        table = written(front.mapInArrow(go, "path string, length long"))
        parts.append(table.filter("length IS NOT NULL"))
        left = table.filter("length IS NULL").select("path")
        n = left.count()
        if not n:
            break
        front = left.repartition(max(min(n, 4 * spark.sparkContext.defaultParallelism), -(-n // FILES)))
    files = parts[0]
    for part in parts[1:]:
        files = files.unionByName(part)
    return files, root + "/"


def _contents(files: DataFrame, folder: str) -> DataFrame:
    """(path, content) of files (path, length), read by tasks of some files and bytes each."""
    if "content" in files.columns:
        return files

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = _opened(folder)
        out = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], names=["path", "content"])
        rows, size = [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with system.open_input_stream(path) as f:
                    rows.append((path, f.read()))
                size += len(rows[-1][1])
                if size > PIECE_BYTES or len(rows) >= FILES:
                    yield out(rows)
                    rows, size = [], 0
        if rows:
            yield out(rows)

    sizes = files.agg(F.count("path").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).first()
    tasks = max(-(-sizes["n"] // FILES), -(-sizes["bytes"] // TASK_BYTES), 1)
    return files.select("path").repartition(tasks, "path").mapInArrow(read, "path string, content binary")


def _read_by_spark(spark: SparkSession, folder: str) -> DataFrame:
    # many folders are listed by a few tasks; Spark would start one for each
    tasks = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(tasks)
    spark.conf.set(tasks, str(4 * spark.sparkContext.defaultParallelism))
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    finally:
        spark.conf.set(tasks, before)
    return files


def write_modules(files: DataFrame, folder: str) -> None:
    """Writes each text (repo_id, path, source) to its own file below `folder`, as `read_modules` reads it.

    The tasks write the files where they belong; a task that runs again writes
    the same. Spark's writer makes a folder and a commit for each file instead,
    which takes some processes a file on local disks. Paths must stay in the folder.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = FileSystem.from_uri(folder if ":" in folder else f"file://{folder}")
        made, n = set(), 0
        for batch in batches:
            for repo, path, source in zip(*(column.to_pylist() for column in batch.columns)):
                parts = f"{repo}/{path}".split("/")
                if {"", ".", ".."} & set(parts):
                    raise ValueError(f"no path inside of a folder: {repo}/{path}")
                home = "/".join([root, *parts[:-1]])
                if home not in made:
                    system.create_dir(home)
                    made.add(home)
                with system.open_output_stream(f"{home}/{parts[-1]}") as out:
                    out.write(source.encode())
                n += 1
        yield pa.RecordBatch.from_pydict({"n": [n]})

    texts = files.select("repo_id", "path", "source").filter("source IS NOT NULL")
    texts.repartition(-(-texts.count() // FILES) or 1, "repo_id", "path").mapInArrow(write, "n long").agg(F.sum("n")).collect()


def filter_source_files(files: DataFrame, extensions: list[str], include: str | None = None, exclude: str | None = None) -> DataFrame:
    """Files with one of the extensions whose path fits `include` and not `exclude` (regular expressions)."""
    kept = files.filter(F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).isin(extensions))
    kept = kept.filter(F.col("path").rlike(include)) if include else kept
    return kept.filter(~F.col("path").rlike(exclude)) if exclude else kept


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """`old` with the rows of `new` put over those of the same keys; of equal keys in `new` the first in `order` counts."""
    first = keep_first(new, keys, order)
    return old.join(first, keys, "left_anti").unionByName(first.select(*old.columns))


def cap_files(files: DataFrame, most: int = 100) -> DataFrame:
    """(repo_id, path): the first files of each repository by path; Spark cuts each task's part before the shuffle."""
    once = files.select("repo_id", "path").distinct()
    return once.withColumn("k", F.expr("row_number() OVER (PARTITION BY repo_id ORDER BY path)")).filter(F.col("k") <= most).drop("k")


def load_graph(rows: DataFrame, age: str, key: list[str], most: int) -> DataFrame:
    """The oldest rows of each repository, `most` at most; nodes and edges alike."""
    order = ", ".join([age, *key])
    return rows.withColumn("k", F.expr(f"row_number() OVER (PARTITION BY repo_id ORDER BY {order})")).filter(F.col("k") <= most).drop("k")


# What a file's path says of its node, in order: part of the path, subtitle, shape.
FILE_KINDS = [
    ("/api/|/routes/", "Endpoint · Route", "rectangle"), ("component|Component", "UI · Component", "pill"), ("hook|use", "Hook · Logic", "hexagon"), ("util|lib", "Utility · Helper", "parallelogram"),
    (r"test|\.spec\.", "Test · Coverage", "diamond"), (r"\.s?css$", "Style · CSS", "document"), (r"\.md$", "Docs · Markdown", "rectangle"),
]


def file_nodes(files: DataFrame) -> DataFrame:
    """(repo_id, label, sub, shape): a node for each file name of a repository, of the first path that has it."""
    pick = lambda i, other: F.coalesce(*[F.when(F.col("path").rlike(k[0]), F.lit(k[i])) for k in FILE_KINDS], F.lit(other))
    rows = files.select("repo_id", F.substring_index("path", "/", -1).alias("label"), "path", pick(1, "File · Source").alias("sub"), pick(2, "rectangle").alias("shape"))
    return keep_first(rows, ["repo_id", "label"], ["path"]).select("repo_id", "label", "sub", "shape")


def graph_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo_id, kind, json): a JSON line for each node and edge, so that no row holds a whole repository."""
    n = nodes.select("repo_id", F.lit("node").alias("kind"), F.to_json(F.struct("node_id", "type", "label")).alias("json"))
    return n.unionByName(edges.select("repo_id", F.lit("edge").alias("kind"), F.to_json(F.struct("src", "dst", F.col("kind").alias("kind"))).alias("json")))


def export_graph(nodes: DataFrame, edges: DataFrame, folder: str, blocks: int = 200) -> None:
    """Writes `graph_lines` by repository, a large one in several files that different tasks write."""
    lines = graph_lines(nodes, edges).withColumn("block", F.pmod(F.xxhash64("json"), F.lit(blocks)))
    lines.repartition("repo_id", "block").drop("block").write.partitionBy("repo_id", "kind").mode("overwrite").text(folder)


def read_graph(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of (repo_id, kind, json) lines; lines that are no such JSON are left out."""

    def part(kind: str, shape: str, key: str) -> DataFrame:
        read = lines.filter(F.col("kind") == kind).select("repo_id", F.from_json("json", shape).alias("g"))
        return read.select("repo_id", "g.*").filter(F.col(key).isNotNull())

    return part("node", "node_id STRING, type STRING, label STRING", "node_id"), part("edge", "src STRING, dst STRING, kind STRING", "src")


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo_id, json): one document of nodes and edges per repository."""
    n = nodes.groupBy("repo_id").agg(F.sort_array(F.collect_list(F.struct("node_id", "type"))).alias("nodes"))
    e = edges.groupBy("repo_id").agg(F.sort_array(F.collect_list(F.struct("src", "dst", "kind"))).alias("edges"))
    return n.join(e, "repo_id", "full_outer").select("repo_id", F.to_json(F.struct("nodes", "edges")).alias("json"))


def read_graph_json(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of documents (repo_id, json) as `graph_json` writes them."""
    shape = "nodes ARRAY<STRUCT<node_id STRING, type STRING>>, edges ARRAY<STRUCT<src STRING, dst STRING, kind STRING>>"
    read = documents.select("repo_id", F.from_json("json", shape).alias("g"))
    nodes = read.select("repo_id", F.explode("g.nodes").alias("n")).select("repo_id", "n.*")
    return nodes, read.select("repo_id", F.explode("g.edges").alias("e")).select("repo_id", "e.*")
