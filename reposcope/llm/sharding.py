"""Sharding by proportional stratified interleaving.

Within each source (stratum) rows are shuffled by a seeded hash and ranked; a
row's fractional rank (2 rank + 1) / (2 n) says how far into its source it
lies. Sorted by fractional rank, every stretch of the table holds each source
in proportion, so cutting the sorted table into equal pieces gives shards of
the table's own mixture.

Both sorts are range exchanges of narrow rows (no text), and both ranks are a
row's place in its partition plus the rows before that partition: no source and
no shard is the work of one task, however many of all rows it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reposcope.llm.common import NO_ID, forget, read, real_id, written

#: Bytes that a row counts besides its text.
ROW_BYTES = 8
SHARDS, SEED = 24, 20


def seeded(seed: int, *columns: Column) -> Column:
    """A hash of some columns and a seed, by which rows are shuffled."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in columns]))


def narrow_rows(docs: DataFrame, seed: int, source_col: str, id_col: str, text_col: str) -> DataFrame:
    """(id, stratum, size, crc, draw, tie) of every row; what is sorted and dealt.

    tie tells rows apart that agree in id and text, so that many of them do not
    fall into one range; their order among themselves is of no effect.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(
        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("id"),
        # a null source is a stratum of its own, before all others
        F.coalesce(F.concat(F.lit("="), F.col(f"`{source_col}`").cast("string")), F.lit("")).alias("stratum"),
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("crc"),
    )
    return rows.withColumns({"draw": seeded(seed, F.col("id"), F.col("crc"), F.col("size")), "tie": F.monotonically_increasing_id()})


def placed(rows: DataFrame, by: list[str]) -> DataFrame:
    """`rows` sorted over all partitions and written, with the partition (piece) and the place in it (at)."""
    rows = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id())
    return written(rows.withColumn("piece", F.shiftright("at", 33).cast("int")).withColumn("at", F.col("at").bitwiseAND(F.lit((1 << 33) - 1))))


def ranked(rows: DataFrame, stratum: str, by: list[str]) -> DataFrame:
    """Adds the rank (from 0) of each row within its stratum in the order of `by`, and n, the stratum's rows.

    Sorting keeps a stratum together, so the counts by partition and stratum are
    no more than partitions and strata together. A row finds its offsets by
    partition and stratum: a large stratum lies in many partitions.
    """
    rows = placed(rows, [stratum, *by])
    counts = rows.groupBy("piece", stratum).agg(F.count(F.lit(1)).alias("here"), F.min("at").alias("first"))
    whole = Window.partitionBy(stratum)
    earlier = whole.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("piece", stratum, "first", F.coalesce(F.sum("here").over(earlier), F.lit(0)).alias("before"), F.sum("here").over(whole).alias("n"))
    return rows.join(offsets, ["piece", stratum]).withColumn("rank", F.col("at") - F.col("first") + F.col("before")).drop("at", "piece", "first", "before")


def positions(rows: DataFrame, by: list[str]) -> tuple[DataFrame, int]:
    """Adds the position (from 0) of each row in the order of `by`, and says how many rows there are.

    The driver takes one count a partition.
    """
    rows = placed(rows, by)
    counts = sorted((r["piece"], r["count"]) for r in rows.groupBy("piece").count().collect())
    before, starts = 0, []
    for piece, n in counts:
        starts.append((piece, before))
        before += n
    offsets = rows.sparkSession.createDataFrame(starts or [(0, 0)], "piece int, before long")
    return rows.join(F.broadcast(offsets), "piece").withColumn("position", F.col("at") + F.col("before")).drop("at", "piece", "before"), before


def interleaved(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, source, size, text_crc32, shard, slot: every row in one of `shards` shards.

    Shards differ by one row at most. Slots count the rows of a shard from 0 in
    the order of fractional ranks (ties by source, then as shuffled). A source of
    n rows has n / shards of them in each shard, up to rounding. size is the
    text's UTF-8 bytes plus 8.

    A null source is a source of its own. A null text counts no bytes and has the
    checksum of an empty one; a null id stays null. Rows that repeat id and text
    are dealt as different rows. Fewer rows than shards leave shards empty; an
    empty table gives no rows. Other columns are not read.
    """
    rows = written(narrow_rows(docs, seed, source_col, id_col, text_col))
    within = ranked(rows, "stratum", ["draw", "id", "tie"])
    within = within.select("id", "stratum", "size", "crc", "rank", ((F.col("rank") * 2 + 1) / (F.col("n") * 2)).alias("share"))
    order, total = positions(within, ["share", "stratum", "rank"])
    forget(rows)
    shard = F.expr(f"position * {shards} div {max(total, 1)}")
    first = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")  # the position at which a shard begins
    return order.withColumn("shard", shard).select(
        real_id("id").alias("doc_id"),
        F.expr("CASE WHEN stratum <> '' THEN substr(stratum, 2) END").alias("source"),
        "size",
        F.col("crc").alias("text_crc32"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("position") - first).alias("slot"),
    )


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The law that holds is `rows`: shards differ by one row at most, so equal texts are not kept together."""
    out = interleaved(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: The checksum is a fold over the bytes; its table follows from the polynomial 0xEDB88320.
OP12_SQL = f"""
WITH entries AS (
  SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS crc_of FROM (SELECT unnest(range(256)) AS b)
), t AS (
  SELECT coalesce(doc_id, {NO_ID}) AS id, coalesce('=' || source, '') AS stratum, octet_length(encode(coalesce(text, ''))) + {ROW_BYTES} AS size,
    xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT))),
      lambda c, b: xor(c >> 8, crc_of[(xor(c, b) & 255) + 1])), 4294967295) AS crc
  FROM documents, entries
), r AS (
  SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('{SEED}:' || id || ':' || crc || ':' || size), id) - 1 AS rank, count(*) OVER (PARTITION BY stratum) AS n FROM t
), p AS (
  SELECT *, row_number() OVER (ORDER BY (2 * rank + 1) / (2 * n), stratum, rank) - 1 AS position, count(*) OVER () AS total FROM r
), s AS (SELECT *, position * {SHARDS} // total AS shard FROM p)
SELECT CASE WHEN id <> {NO_ID} THEN id END AS doc_id, CASE WHEN stratum <> '' THEN substr(stratum, 2) END AS source, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'rows' AS law,
  CAST(shard AS INTEGER) AS shard, CAST(position - (shard * total + {SHARDS - 1}) // {SHARDS} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM s
"""
