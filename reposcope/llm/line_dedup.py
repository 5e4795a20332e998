"""Line dedup over levelled sorted runs of line hashes.

Lines arrive in batches of documents. The index is a list of runs, each sorted
by line hash and holding one entry (hash, documents, largest id) per hash, and
every hash lies in exactly one run. A new batch is merge-anti-joined with the
runs: hashes that no run holds yet become a run of their own on level 0, the
others an update, a small table of what the batch adds to their entries.
Whenever a level holds FAN_IN runs they are compacted into one run of the next
level, which takes in the updates of its hashes; so the number of runs grows
with the logarithm of the batches and every entry is rewritten once per level.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reposcope.llm.common import BLANK, ascii_lower, forget, keyed_text, read, real_id, with_fingerprint, written

#: Batches of documents, and runs of one level that are compacted into the next.
BATCHES, FAN_IN = 4, 3
#: Keys of at least so many code points, found in at least so many documents, are dropped.
MIN_CHARS, MIN_DOCS = 40, 5


def line_key(line: Column) -> Column:
    """A line without ASCII white space at both ends, A to Z lower-cased."""
    bare = F.btrim(line, F.lit(BLANK))
    # lower() has a fast path for text that is all ASCII, and there it does the same
    return F.when(F.length(bare) == F.octet_length(bare), F.lower(bare)).otherwise(ascii_lower(bare))


def line_hashes(rows: DataFrame, min_chars: int) -> DataFrame:
    """(id, fp, pos, h1, h2): two independent 64-bit hashes of each long key, and the line's place in its document."""
    lines = rows.select("id", "fp", F.posexplode(F.split("text", "\n")).alias("pos", "line")).filter(F.octet_length("line") >= min_chars)
    keys = lines.select("id", "fp", "pos", line_key(F.col("line")).alias("key")).filter(F.length("key") >= min_chars)
    return keys.select("id", "fp", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(29), "key").alias("h2"))


def _summed(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables).groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("last").alias("last"))


class LevelledRuns:
    """The index: levels of runs of (h1, h2, n, last), each sorted by hash, and updates of the same columns."""

    def __init__(self, fan_in: int = FAN_IN):
        self.levels: list[list[DataFrame]] = []
        self.updates: list[DataFrame] = []
        self.fan_in = fan_in

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def add(self, batch: DataFrame) -> None:
        """Merge-anti-joins a batch (h1, h2, n, last), each hash once, with the runs."""
        if known := self.runs():
            batch = written(batch)
            seen = reduce(DataFrame.unionByName, known).select("h1", "h2").hint("merge")
            self.updates.append(_sorted(batch.join(seen, ["h1", "h2"], "left_semi")))
            self._put(0, _sorted(batch.join(seen, ["h1", "h2"], "left_anti")))
            forget(batch)
        else:
            self._put(0, _sorted(batch))

    def _put(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fan_in:
            full, self.levels[level] = self.levels[level], []
            self._put(level + 1, self._compacted(full))

    def _compacted(self, full: list[DataFrame]) -> DataFrame:
        """One sorted run of several; updates of other runs' hashes stay updates."""
        tagged = [t.withColumn("own", F.lit(own)) for tables, own in ((full, True), (self.updates, False)) for t in tables]
        both = reduce(DataFrame.unionByName, tagged).groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("last").alias("last"), F.max("own").alias("own"))
        both = written(both)
        run, old = _sorted(both.filter("own").drop("own")), self.updates
        self.updates = [_sorted(both.filter("NOT own").drop("own"))]
        forget(both, *full, *old)
        return run

    def entries(self) -> DataFrame:
        """(h1, h2, n, last) of every hash: the runs' entries with the updates not yet taken in."""
        runs = reduce(DataFrame.unionByName, self.runs())
        if not self.updates:
            return runs
        more = _summed(self.updates).select("h1", "h2", F.col("n").alias("more"), F.col("last").alias("later"))
        return runs.join(more, ["h1", "h2"], "left").select("h1", "h2", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"), F.greatest("last", "later").alias("last"))


def _sorted(run: DataFrame) -> DataFrame:
    return written(run.sortWithinPartitions("h1", "h2"))


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
    batches: int = BATCHES,
) -> DataFrame:
    """Per input row: doc_id, n_lines, n_dropped, kept_text.

    A null or empty text is one empty line. A key of at least `min_chars` code
    points found in at least `min_docs` documents loses all its lines except
    those of the largest doc_id that holds it. Rows with a null id count as one
    document with the largest id of all; rows that repeat an id count as one
    document too, each giving its own result row. An empty table gives no rows.
    """
    rows = with_fingerprint(keyed_text(docs, id_col, text_col))
    lines = written(line_hashes(rows, min_chars).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(batches))))
    index = LevelledRuns()
    for k in range(batches):
        batch = lines.filter(F.col("part") == k).select("id", "h1", "h2").distinct()
        index.add(batch.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last")))
    # keyed by ~h1, so that both sides of the join are dealt anew and a hot line can be split
    frequent = index.entries().filter(F.col("n") >= min_docs).select(F.bitwise_not("h1").alias("key"), "h2", "last")
    drops = (
        lines.withColumn("key", F.bitwise_not("h1"))
        .join(frequent, ["key", "h2"])
        .filter(F.col("id") != F.col("last"))
        .groupBy("id", "fp")
        .agg(F.collect_list("pos").alias("drops"))
    )
    split = rows.join(drops, ["id", "fp"], "left").select("id", "drops", F.split("text", "\n").alias("lines"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "drops")
    kept = F.when(F.col("drops").isNull(), F.col("lines")).otherwise(F.transform(stay, lambda i: F.get("lines", i)))
    return split.withColumn("kept", kept).select(
        real_id("id").alias("doc_id"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"),
        F.array_join("kept", "\n").alias("kept_text"),
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP5_SQL = """
WITH l AS (
  SELECT doc_id, generate_subscripts(a, 1) AS pos, unnest(a) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), f AS (
  SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), m AS (
  SELECT k.*, f.key IS NOT NULL AND k.doc_id <> f.last AS gone FROM k LEFT JOIN f USING (key)
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
