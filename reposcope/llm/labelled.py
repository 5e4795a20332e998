"""Bounded samples of labelled documents and a small logistic fit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reposcope.llm.common import passes, text_buffers
from reposcope.llm.minhash_dedup import shingle_sets, signatures

#: Bands of minima by which copies within a sample are told: all minima of one band agree for 99 % of the pairs
#: of a similarity of 0.8, 1 % of those of 0.2.
BANDS, BAND = 8, 4


def held_out(id_col: Column) -> Column:
    """True for the documents that no model learns from: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 3 == 1, F.lit(False))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label_col: str, per_class: tuple[int, int], max_chars: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, text, label) of labelled documents outside the held-out part, a bounded number per class.

    `per_class` bounds the rows of class 0 and 1, taken in the order of a hash
    of the id; texts of over `max_chars` characters and null texts are left out.
    An id with several labels has the largest; null ids and labels are ignored.
    """
    known = (
        labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label"))
        .filter(F.col("id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("id")))
        .groupBy("id")
        .agg(F.max("label").alias("label"))
    )
    order = [F.xxhash64("id"), F.col("id")]
    parts = [known.filter(F.col("label") == c).orderBy(*order).limit(n) for c, n in enumerate(per_class)]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))  # at most sum(per_class) rows
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return texts.join(chosen, "id").filter(F.length("text") <= max_chars).select("id", "text", "label")


def without_copies(sample: DataFrame) -> DataFrame:
    """A bounded sample (id, text, label) with one document of each group of likely copies.

    Copies would pass for independent evidence. Documents that agree in all
    minima of any band over their five-word shingles count as copies; the sample
    is bounded, so its sketches are joined into groups here.
    """

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = text_buffers(batch.column(1))
            for a, b in passes(offs):
                sets = shingle_sets(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], 5)
                rows = [signatures([s])[0][: BANDS * BAND] if len(s) else [] for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(rows, pa.list_(pa.int32()))], ["id", "sketch"])

    rows = sample.select("id", "text").mapInArrow(sketch, "id long, sketch array<int>").collect()
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for r in sorted(rows, key=lambda r: r["id"]):
        for k in range(0, len(r["sketch"]), BAND):
            a, b = root(("doc", r["id"])), root((k, *r["sketch"][k : k + BAND]))
            parent[a] = b
    first: dict = {}
    for r in sorted(rows, key=lambda r: r["id"]):
        first.setdefault(root(("doc", r["id"])), r["id"])
    kept = sample.sparkSession.createDataFrame([(i,) for i in first.values()], "id long")
    return sample.join(F.broadcast(kept), "id", "left_semi")


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights (the last is the intercept) by Newton's method; classes weigh alike."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    if not len(y):
        return w
    share = max(y.mean(), 1e-6), max(1 - y.mean(), 1e-6)
    weight = np.where(y == 1, 0.5 / share[0], 0.5 / share[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) / len(y) + ridge * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x / len(y) + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(curve, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def logistic(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
