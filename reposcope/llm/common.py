"""Helpers shared by the text operators: row preparation, lineage cuts, hashing.

The numpy helpers work on Arrow string buffers directly, many documents at a
time, so that a Python worker never loops over single characters.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands in for a null document id inside a job: a document without an id
#: counts as the largest one and is turned back into null in the result.
NO_ID = 2**63 - 1

#: Bytes of text that one numpy pass holds; a single longer text is one pass.
PASS_BYTES = 1 << 18

#: Spark's limit for the bytes of a batch that goes to a Python worker, and the one in `small_batches`.
BATCH_LIMIT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20

#: ASCII white space, the separator set of most contracts (space, \t to \r).
BLANK = " \t\n\x0b\f\r"

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Only where none is named, as in tests on one machine, a temporary one is set.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoints-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` with its lineage cut by a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def keyed_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) of any table: null ids become NO_ID, null texts become empty.

    Only these two columns are read, so extra columns cannot clash.
    """
    return docs.select(
        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )


def with_fingerprint(rows: DataFrame) -> DataFrame:
    """Adds fp, so that (id, fp) tells rows apart when an id occurs with two texts."""
    return rows.withColumn("fp", F.xxhash64("text"))


def real_id(column: str | Column = "id") -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.when(c != F.lit(NO_ID), c)


def fresh(name: str, taken: list[str]) -> str:
    """`name`, lengthened until no column has it in any case."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def column_index(df: DataFrame, name: str) -> int:
    """Where a table has a column; names are compared without case, as Spark does."""
    return [c.lower() for c in df.columns].index(name.lower())


def keep_rows(docs: DataFrame, keys: dict[str, Column], stay: DataFrame) -> DataFrame:
    """The rows of `docs` whose keys are in `stay`, one of each; its columns unchanged.

    `keys` makes each key from the columns of `docs`; `stay` has the same keys,
    each once, and times, how many rows of `docs` have them. Only rows that
    repeat are compared with each other.
    """
    names = {k: fresh(f"key_{k}", docs.columns) for k in keys}
    times = fresh("key_times", docs.columns)
    tagged = docs.withColumns({names[k]: c for k, c in keys.items()})
    found = tagged.join(stay.select(*[F.col(k).alias(names[k]) for k in keys], F.col("times").alias(times)), list(names.values()))
    own = [F.col(f"`{c}`") for c in docs.columns]
    single = found.filter(F.col(times) == 1).select(*own)
    several = found.filter(F.col(times) > 1).dropDuplicates(list(names.values())).select(*own)
    return single.unionByName(several)


def written(df: DataFrame) -> DataFrame:
    """`df` as a Parquet table in the shared folder, which cuts its lineage.

    Loops use it rather than `checkpointed`: a checkpoint inherits the size that
    Spark has estimated, and estimates of joins multiply from round to round.
    """
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def forget(*tables: DataFrame) -> None:
    """Deletes what `written` wrote; the tables can't be read any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Tables written inside give texts to Python workers in batches of BATCH_BYTES; a single longer row is one batch.

    A batch lies in the memory of the JVM and of the worker at once, and by
    default has up to 64 MB. Whatever the session has set is set again behind.
    """
    before = spark.conf.get(BATCH_LIMIT)
    spark.conf.set(BATCH_LIMIT, f"{BATCH_BYTES}b")
    try:
        yield
    finally:
        spark.conf.set(BATCH_LIMIT, before)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- numpy over Arrow strings -------------------------------------------------


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets into them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def passes(offs: np.ndarray, limit: int = PASS_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes each, at least one row."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def find_words(data: np.ndarray, offs: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and for each text the index of its first word (n + 1).

    `inside` is a table of 256 booleans: the bytes that belong to words.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    word = inside[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = word[:-1]
    cuts = offs[:-1][offs[:-1] < n]
    before[cuts] = False
    starts = np.flatnonzero(word & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = word[1:]
    cuts = offs[1:][offs[1:] > 0] - 1
    after[cuts] = False
    ends = np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


#: Words of more bytes are hashed by BLAKE2.
LONG_WORD = 256
_ODD = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes, eight bytes at a time with a full mix after each.

    Hashes of two seeds are independent of each other.
    """
    size = ends - starts
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))  # the eight bytes from any place
    start = np.uint64(int.from_bytes(hashlib.blake2b(b"word%d" % seed, digest_size=8).digest(), "little"))
    hashes = mixed(size.astype(np.uint64) * _ODD + start)
    open_, at = np.flatnonzero(size <= LONG_WORD), 0
    while len(open_):
        left = size[open_] - at
        part = eight[starts[open_] + at]
        short = left < 8
        part[short] &= (np.uint64(1) << (left[short] * 8).astype(np.uint64)) - np.uint64(1)
        hashes[open_] = mixed((hashes[open_] ^ part) * _ODD + start)
        open_, at = open_[left > 8], at + 8
    for i in np.flatnonzero(size > LONG_WORD):
        whole = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, salt=b"%d" % seed)
        hashes[i] = int.from_bytes(whole.digest(), "little")
    return hashes


def combined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a run from those of its beginning and its end."""
    return mixed(mixed(a * _ODD + _MIX1) + b * _MIX2)


class Spans:
    """Hash of any run of up to `longest` words, from those of all runs of 1, 2, 4, ... words.

    A run is covered by two runs whose length is a power of two; every step mixes
    all bits, so no arrangement of words cancels out as in a polynomial.
    """

    def __init__(self, values: np.ndarray, longest: int):
        self.levels, span = [values], 1
        while 2 * span <= longest:
            values = combined(values[: max(len(values) - span, 0)], values[span:])
            self.levels.append(values)
            span *= 2

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        size = ends - starts
        level = np.frexp(size.astype(np.float64))[1] - 1
        out = np.empty(len(size), np.uint64)
        for k, values in enumerate(self.levels):
            i = np.flatnonzero(level == k)
            out[i] = combined(values[starts[i]], values[ends[i] - (1 << k)])
        return mixed(out + size.astype(np.uint64))


def byte_table(*ranges: tuple[int, int]) -> np.ndarray:
    """256 booleans, true outside the given inclusive byte ranges."""
    table = np.ones(256, bool)
    for lo, hi in ranges:
        table[lo : hi + 1] = False
    return table


#: Words are runs of everything but ASCII white space.
UNBLANK = byte_table((0x20, 0x20), (0x09, 0x0D))
#: Words are runs of ASCII letters, digits and everything beyond ASCII.
ALNUM = byte_table((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
#: Lower-cases A to Z and leaves other bytes.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))
