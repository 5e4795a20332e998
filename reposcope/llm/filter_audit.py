"""Interaction audit of filters: what every order of applying them removes at every step.

A document is known by the set of filters it fails. `removal_steps` finds at
which step each set leaves in each order as a min-plus product: the mask matrix
(a row per set: 0 where the filter fails, infinity elsewhere) times the position
matrix (a column per order: the inverse permutation, the position of each
filter), with minimum for the sum and plus for the product. The documents of a
part are counted by set; those weights are scattered over the removal steps of
all orders at once, and everything else follows from the same matrix.

Spark does the counting: a document becomes a digest and a set of failures, and
documents are added up by part and set, so what the product reads has at most
2^k rows a part however many documents there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reposcope.llm.common import NO_ID, forget, read, written

INF = np.int64(1 << 30)
#: Filters at most: k! orders of k steps are reported for each part.
MOST_FILTERS = 7
#: The measures of the documents removed at a step, besides their number.
LOSSES = ("good_lost", "toxic_lost")
_SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


# --- the filters of the registered query --------------------------------------


def words(text: Column) -> Column:
    """The maximal runs of everything but ASCII white space."""
    return F.array_remove(F.split(F.translate(text, "\t\n\x0b\f\r", " " * 5), " "), "")


def document_filters(text: Column) -> dict[str, Column]:
    """Failure conditions on one text: A too short, B repetitive, C shouting, D with signs of markup."""
    found, capitals = words(text), F.length(F.regexp_replace(text, "[^A-Z]++", ""))
    return {
        "A": F.size(found) < 200,
        "B": F.size(F.array_distinct(found)) * 100 < F.size(found) * 50,
        "C": capitals * 100 > F.length(text) * 3,
        "D": text.rlike("[#$%&*|]"),
    }


# --- the product ----------------------------------------------------------------


def min_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The min-plus product of two matrices, one inner index at a time."""
    out = np.full((a.shape[0], b.shape[1]), INF)
    for k in range(a.shape[1]):
        np.minimum(out, a[:, k, None] + b[None, k, :], out=out)
    return np.minimum(out, INF)


def mask_matrix(k: int) -> np.ndarray:
    """2^k rows: 0 where bit f of the row's number is set, that is filter f fails, INF elsewhere."""
    bits = (np.arange(1 << k)[:, None] >> np.arange(k)) & 1
    return np.where(bits == 1, np.int64(0), INF)


def position_matrix(orders: np.ndarray) -> np.ndarray:
    """The position of each filter (row) in each order (column), from 0: the inverse permutations."""
    return np.argsort(orders, axis=1).T.astype(np.int64)


def removal_steps(orders: np.ndarray) -> np.ndarray:
    """For each failure set (row) and order (column) the step from 0 that removes it, INF for never."""
    return min_plus(mask_matrix(orders.shape[1]), position_matrix(orders))


class Audit:
    """All orders of k filters, ready to be weighted by counts of failure sets."""

    def __init__(self, names: list[str]):
        k = len(names)
        self.orders = np.array(list(permutations(range(k))))
        self.labels = ["".join(names[f] for f in o) for o in self.orders]
        self.rank = removal_steps(self.orders)
        self.fails = ((np.arange(1 << k)[:, None] >> np.arange(k)) & 1).astype(bool)

    def counts(self, weights: np.ndarray) -> dict[str, np.ndarray]:
        """Tables of (order, step) from weights of shape (2^k sets, 1 + losses)."""
        n_orders, k = self.orders.shape
        hit = self.rank < INF
        column = np.broadcast_to(np.arange(n_orders), self.rank.shape)
        cell = (column * k + np.where(hit, self.rank, 0))[hit]

        def scattered(w: np.ndarray) -> np.ndarray:
            out = np.zeros(n_orders * k, np.int64)
            np.add.at(out, cell, np.broadcast_to(w[:, None], self.rank.shape)[hit])
            return out.reshape(n_orders, k)

        removed = scattered(weights[:, 0])
        failing = self.fails.T.astype(np.int64) @ weights[:, 0]  # documents that fail each filter
        by_filter = np.zeros(k, np.int64)
        np.add.at(by_filter, self.orders, removed)
        return {
            "kept": weights[:, 0].sum() - np.cumsum(removed, axis=1),
            "removed": removed,
            # a document that fails a step's filter leaves at that step or has left before
            "redundant": failing[self.orders] - removed,
            "unique_fails": weights[1 << np.arange(k), 0][self.orders],
            **{name: scattered(weights[:, 1 + j]) for j, name in enumerate(LOSSES)},
            "shapley": by_filter[self.orders],
        }


def audited(sets: DataFrame, names: list[str]) -> DataFrame:
    """The audit of a table (part, mask, n, good, toxic) of failure sets counted by part.

    One row per part, order and step, zeros included. Bit f of a mask is set
    where filter f fails. A null part is the empty string; an empty table gives
    no rows; masks that repeat add up.
    """
    if not 1 <= len(names) <= MOST_FILTERS:
        raise ValueError(f"from 1 to {MOST_FILTERS} filters can be audited")
    once = sets.groupBy(F.coalesce("part", F.lit("")).alias("part"), F.col("mask").cast("int").alias("mask")).agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])
    rows = once.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("sets"))  # 2^k entries at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit = Audit(names)
        n_orders, k = audit.orders.shape
        order = pa.array(np.repeat(audit.labels, k), pa.string())
        step = pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n_orders))
        for batch in batches:
            for part, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                weights = np.zeros((1 << k, 3), np.int64)
                for s in found:
                    weights[s["mask"]] += (s["n"], s["good"], s["toxic"])
                tables = {name: pa.array(t.ravel()) for name, t in audit.counts(weights).items()}
                columns = {"part": pa.array([part] * len(step), pa.string()), "filter_order": order, "step": step, **tables}
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return rows.mapInArrow(run, _SCHEMA)


# --- counting -------------------------------------------------------------------


Filters = Callable[[Column], dict[str, Column]]


def failure_sets(docs: DataFrame, labels: DataFrame, filters: Filters = document_filters, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic) of documents: a bit for each filter and a last one for exact copies.

    A document is a copy where a smaller id has the same text anywhere in the table. Rows
    that repeat id and text are equally large, so none is a copy of the other,
    and all are counted. A null text is empty, a null id counts as the largest
    and has no labels. A document is good or toxic if any of its labels says so.

    Texts are read once and become digests. Rows that repeat are added up before
    they are shuffled. Copies are no group anywhere: the smallest id of a
    digest is a minimum, combined on the map side, and the documents that have
    it are found by digest and id together, so a text that a third of all rows
    share is spread over all tasks.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    mask = F.lit(0)
    for bit, condition in enumerate(filters(F.col("text")).values()):
        mask = mask + F.when(condition, 1 << bit).otherwise(0)
    rows = docs.select(
        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("id"),
        F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"),
        text.alias("text"),
    ).select("id", "part", F.unhex(F.sha2("text", 256)).alias("sha"), mask.alias("mask"))
    rows = rows.groupBy("id", "part", "sha", "mask").agg(F.count(F.lit(1)).alias("n"))
    # rows without an id find no label; they are dealt by digest, so that they don't meet in one task
    marks = (
        labels.select(F.col("doc_id").cast("long").alias("id"), (F.col("quality") == 1).alias("is_good"), (F.col("toxic") == 1).alias("is_toxic"))
        .filter(F.col("id").isNotNull() & (F.col("id") != NO_ID))
        .groupBy("id")
        .agg(F.coalesce(F.max("is_good"), F.lit(False)).alias("is_good"), F.coalesce(F.max("is_toxic"), F.lit(False)).alias("is_toxic"))
        .withColumn("salt", F.lit(0).cast("long"))
    )
    rows = rows.withColumn("salt", F.when(F.col("id") == NO_ID, F.xxhash64("sha", "part")).otherwise(0).cast("long"))
    no = F.lit(False)
    rows = written(rows.join(marks, ["id", "salt"], "left").select("id", "part", "sha", "mask", "n", F.coalesce("is_good", no).alias("is_good"), F.coalesce("is_toxic", no).alias("is_toxic")))
    firsts = rows.groupBy("sha").agg(F.min("id").alias("id"))
    of = ["part", "mask", "is_good", "is_toxic"]
    everything = rows.groupBy(*of).agg(F.sum("n").alias("n"))
    own = rows.join(firsts, ["sha", "id"], "left_semi").groupBy(*of).agg(F.sum("n").alias("n"))
    copy = F.lit(1 << len(filters(F.col("text"))))
    signed = own.unionByName(everything.withColumn("mask", F.col("mask") + copy)).unionByName(own.select("part", (F.col("mask") + copy).alias("mask"), "is_good", "is_toxic", (-F.col("n")).alias("n")))
    zero = F.lit(0).cast("long")
    sets = signed.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("is_good"), F.col("n")).otherwise(zero)).alias("good"), F.sum(F.when(F.col("is_toxic"), F.col("n")).otherwise(zero)).alias("toxic")
    )
    out = written(sets.filter("n > 0"))
    forget(rows)
    return out


def filter_audit(docs: DataFrame, labels: DataFrame, filters: Filters = document_filters, copies: str = "E", id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    `filters` makes named failure conditions of a text; `copies` names the one of
    exact copies. One row per part, each order of all filters and each step; see
    `failure_sets` for nulls, copies and repeated rows. An empty table gives no
    rows. Only the named columns are read, so others cannot clash.
    """
    return audited(failure_sets(docs, labels, filters, id_col, text_col, part_col), [*filters(F.col("text")), copies])


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


OP11_SQL = """
WITH t AS (
  SELECT coalesce(doc_id, 9223372036854775807) AS id, coalesce(lang, '') AS part, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents
), m AS (SELECT doc_id AS id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS (SELECT t.part, coalesce(m.good, 0) AS good, coalesce(m.toxic, 0) AS toxic,
    CASE WHEN len(words) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN t.id > min(t.id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS fails
  FROM t LEFT JOIN m USING (id)),
s AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM d GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
g AS (SELECT filter_order, step, substr(filter_order, step, 1) AS letter FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT DISTINCT fails, filter_order, coalesce((SELECT min(position(x IN filter_order)) FROM f WHERE contains(fails, x)), 99) AS leaves FROM (SELECT DISTINCT fails FROM s), o),
c AS (
  SELECT part, filter_order, step, letter,
    coalesce(sum(n) FILTER (leaves > step), 0) AS kept, coalesce(sum(n) FILTER (leaves = step), 0) AS removed,
    coalesce(sum(n) FILTER (contains(fails, letter) AND leaves < step), 0) AS redundant, coalesce(sum(n) FILTER (fails = letter), 0) AS unique_fails,
    coalesce(sum(good) FILTER (leaves = step), 0) AS good_lost, coalesce(sum(toxic) FILTER (leaves = step), 0) AS toxic_lost
  FROM s JOIN r USING (fails) JOIN g USING (filter_order) GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM c
"""
