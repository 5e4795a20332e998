"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. A line's features are shares counted over its bytes
and words, and the same of the line before and after it; two weights per pair
of neighbouring labels make the chain. Forward and backward products of the
lines' 2 x 2 matrices give each line's marginal, in a number of numpy steps
that is logarithmic in the longest document. The marginals, weighted by line
length, make the share of bad text, and a logistic curve turns it into a score.

The field is trained on a bounded sample of labelled documents. Lines of good
documents are good. Lines of bad documents start as bad; the trained field then
relabels those that it holds to be good, except the worst line of each
document, and is trained again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reposcope.llm.common import UNBLANK, column_index, find_words, passes, read, text_buffers, word_hashes
from reposcope.llm.labelled import fit_logistic, held_out, labelled_sample, logistic

#: Bounds of the training sample: rows of class 0 (bad) and 1 (good), characters and lines of a text.
SAMPLE, SAMPLE_CHARS, SAMPLE_LINES = (2000, 2000), 20_000, 200
#: Steps of the rounds of training (relabelling between them), and L2 penalty.
STEPS, PENALTY = (150, 40, 40), 1e-4
THRESHOLD = 0.5

#: Byte classes whose shares are features; the rest of ASCII is in none of them.
CLASSES = ("upper", "lower", "digit", "sign", "stop", "beyond")
N_FEATURES = len(CLASSES) + 7


def _byte_classes() -> np.ndarray:
    table = np.full(256, len(CLASSES), np.uint8)
    for name, bytes_ in (
        ("upper", range(65, 91)),
        ("lower", range(97, 123)),
        ("digit", range(48, 58)),
        ("sign", b"!\"#$%&*+/<=>@[\\]^_`{|}~"),
        ("stop", b".,;:?'()-"),
        ("beyond", range(128, 256)),
    ):
        table[list(bytes_)] = CLASSES.index(name)
    return table


_CLASS_OF = _byte_classes()


def line_features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, bytes, index of each text's first line) of all lines of a pass; a text has one line at least."""
    n = len(data)
    breaks = np.flatnonzero(data == 10)
    first = np.searchsorted(breaks, offs) + np.arange(len(offs))
    count = int(first[-1])
    begin = np.zeros(count, np.int64)
    begin[first[:-1]] = offs[:-1]
    inner = np.ones(count, bool)
    inner[first[:-1]] = False
    begin[inner] = breaks + 1
    end = np.append(begin[1:], n)
    end[np.flatnonzero(inner) - 1] -= 1
    size = np.maximum(end - begin, 1)
    x = np.zeros((count, N_FEATURES), np.float64)
    kinds = _CLASS_OF[data]
    for c in range(len(CLASSES)):
        sums = np.concatenate([[0], np.cumsum(kinds == c)])
        x[:, c] = (sums[end] - sums[begin]) / size
    starts, ends, _ = find_words(data, offs, UNBLANK)
    of_line = np.searchsorted(begin, starts, side="right") - 1
    words = np.bincount(of_line, minlength=count)
    some = np.maximum(words, 1)
    hashes = word_hashes(data, starts, ends)
    again = np.zeros(len(starts), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (of_line[1:] == of_line[:-1])
    signs = kinds == CLASSES.index("sign")
    ends_in_sign = signs[ends - 1] if len(ends) else np.zeros(0, bool)
    alone = ends_in_sign & (ends - starts == 1)
    k = len(CLASSES)
    x[:, k] = np.bincount(of_line, again, count) / some
    x[:, k + 1] = np.bincount(of_line, ends_in_sign & ~alone, count) / some
    x[:, k + 2] = np.bincount(of_line, alone, count) / some
    x[:, k + 3] = np.minimum(np.bincount(of_line, ends - starts, count) / some / 20, 2)
    x[:, k + 4] = np.log1p(words) / 5
    x[:, k + 5] = words == 0
    letters = x[:, 0] + x[:, 1]
    x[:, k + 6] = x[:, 0] / np.maximum(letters, 1e-9) * (letters > 0)
    return x, (end - begin).astype(np.float64), first


def with_neighbours(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Features of each line, of the line before and after it (zeros at a text's ends), and a constant."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[first[:-1]] = 0
    after[first[1:] - 1] = 0
    return np.hstack([x, before, after, np.ones((len(x), 1))])


@dataclass
class Field:
    """Unary weights (positive: bad), weights of label pairs [before, now], and the score's curve."""

    unary: np.ndarray
    pairs: np.ndarray
    curve: np.ndarray

    def chains(self, x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of each line's labels (n x 2) and of the label pairs before it (n x 2 x 2).

        Products of the lines' matrices are built by doubling: after step d a
        line's product spans up to 2d lines of its text.
        """
        n = len(x)
        bad = np.exp(np.clip(x @ self.unary, -30, 30))
        local = np.column_stack([np.ones(n), bad])
        step = np.exp(self.pairs)[None] * local[:, None, :]
        is_first = np.zeros(n, bool)
        is_first[first[:-1]] = True
        step[is_first] = local[is_first][:, None, :]
        where = np.arange(n) - np.repeat(first[:-1], np.diff(first))
        rest = np.repeat(first[1:], np.diff(first)) - 1 - np.arange(n)
        forward = _scaled(step)
        backward = np.broadcast_to(np.eye(2), (n, 2, 2)).copy()
        backward[:-1][rest[:-1] > 0] = forward[1:][rest[:-1] > 0]
        d, longest = 1, int(where.max()) + 1 if n else 0
        while d < longest:
            late = np.flatnonzero(where >= d)
            forward[late] = _scaled(np.einsum("nij,njk->nik", forward[late - d], forward[late]))
            early = np.flatnonzero(rest > d)
            backward[early] = _scaled(np.einsum("nij,njk->nik", backward[early], backward[early + d]))
            d *= 2
        alpha = forward[:, 0, :]
        beta = backward.sum(axis=2)
        single = alpha * beta
        single /= single.sum(axis=1, keepdims=True)
        pair = np.zeros((n, 2, 2))
        inner = np.flatnonzero(~is_first)
        pair[inner] = alpha[inner - 1][:, :, None] * step[inner] * beta[inner][:, None, :]
        pair[inner] /= pair[inner].sum(axis=(1, 2), keepdims=True)
        return single, pair

    def bad_share(self, x: np.ndarray, sizes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Per text the share of bad bytes: marginals weighted by line length (an empty line weighs one)."""
        bad = self.chains(with_neighbours(x, first), first)[0][:, 1]
        weight = np.maximum(sizes, 1)
        return np.add.reduceat(bad * weight, first[:-1]) / np.add.reduceat(weight, first[:-1])

    def scores(self, share: np.ndarray) -> np.ndarray:
        return logistic(_curved(share), self.curve)


def _scaled(m: np.ndarray) -> np.ndarray:
    return m / m.max(axis=(1, 2), keepdims=True)


def _curved(share: np.ndarray) -> np.ndarray:
    return np.log((share + 1e-3) / (1 - share + 1e-3))[:, None]


def train(x: np.ndarray, sizes: np.ndarray, first: np.ndarray, good: np.ndarray) -> Field:
    """A field from the lines of some documents and the documents' labels."""
    wide = with_neighbours(x, first)
    of_text = np.repeat(np.arange(len(good)), np.diff(first))
    y = (~good[of_text]).astype(np.int64)
    field = Field(np.zeros(wide.shape[1]), np.zeros((2, 2)), np.array([-1.0, 0.0]))
    is_first = np.zeros(len(x), bool)
    is_first[first[:-1]] = True
    for steps in STEPS:
        _climb(field, wide, first, y, is_first, steps)
        marginal = field.chains(wide, first)[0][:, 1]
        worst = np.maximum.reduceat(marginal, first[:-1])[of_text]
        y = ((~good[of_text]) & ((marginal > 0.5) | (marginal == worst))).astype(np.int64)
    share = field.bad_share(x, sizes, first)
    field.curve = fit_logistic(_curved(share), good.astype(float))
    return field


def _climb(field: Field, wide: np.ndarray, first: np.ndarray, y: np.ndarray, is_first: np.ndarray, steps: int) -> None:
    """Gradient steps (Adam) on the likelihood of the labels y."""
    inner = np.flatnonzero(~is_first)
    seen_pairs = np.zeros((2, 2))
    np.add.at(seen_pairs, (y[inner - 1], y[inner]), 1)
    seen = wide.T @ y
    size = len(field.unary)
    m, v = np.zeros(size + 4), np.zeros(size + 4)
    for t in range(1, steps + 1):
        single, pair = field.chains(wide, first)
        g = np.concatenate([seen - wide.T @ single[:, 1], (seen_pairs - pair.sum(axis=0)).ravel()]) / len(y)
        g -= PENALTY * np.concatenate([field.unary, field.pairs.ravel()])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        field.unary = field.unary + move[:size]
        field.pairs = field.pairs + move[size:].reshape(2, 2)


def learn_field(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Field | None:
    """A field learned from a bounded sample outside the held-out part; None without both classes."""
    sample = labelled_sample(docs, labels, label_col, SAMPLE, SAMPLE_CHARS, id_col, text_col)
    sample = sample.filter(F.regexp_count("text", F.lit("\n")) < SAMPLE_LINES)  # so the driver gets a bounded number of lines

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = text_buffers(batch.column(1))
            for a, b in passes(offs):
                x, sizes, first = line_features(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                cut = [x[i:j].astype(np.float32).ravel() for i, j in zip(first[:-1], first[1:])]
                widths = [sizes[i:j].astype(np.float32) for i, j in zip(first[:-1], first[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(cut, pa.list_(pa.float32())), pa.array(widths, pa.list_(pa.float32())), batch.column(2).slice(a, b - a)], ["x", "sizes", "label"])

    rows = sample.mapInArrow(run, "x array<float>, sizes array<float>, label int").toArrow()
    good = rows["label"].to_numpy() == 1
    if not len(good) or good.all() or not good.any():
        return None
    x = rows["x"].combine_chunks().flatten().to_numpy().astype(float).reshape(-1, N_FEATURES)
    lengths = np.array(rows["sizes"].combine_chunks().value_lengths())
    sizes = rows["sizes"].combine_chunks().flatten().to_numpy().astype(float)
    return train(x, sizes, np.concatenate([[0], np.cumsum(lengths)]), good)


def quality(docs: DataFrame, field: Field | None, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All columns of `docs` and the score: 1 for good, 0 for bad.

    A null or empty text is one empty line. Without a field every text scores
    0.5. Rows are scored one by one, so nulls elsewhere, repeated rows and
    extra columns do not matter; a column that has the score's name is replaced, and
    names are compared without case. An empty table gives no rows.
    """
    docs = docs.drop(score_col)
    where = column_index(docs, text_col)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = text_buffers(batch.column(where))
            for a, b in passes(offs):
                if field is None:
                    scores = np.full(b - a, 0.5)
                else:
                    scores = field.scores(field.bad_share(*line_features(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])))
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns), pa.array(scores)], [*batch.schema.names, score_col])

    return docs.mapInArrow(run, f"{kinds}, `{score_col}` double")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality(docs, learn_field(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
