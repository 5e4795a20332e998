"""Alignment of two tokenizers over the bytes of each document, by sparse incidence products.

Tokens of one text by one tokenizer are the rows of an incidence matrix over
the text's bytes, in CSR form built by hand; many documents lie in one matrix,
block by block. The product A Bᵀ, row by row after Gustavson, has an entry for
each pair of tokens that share bytes, and its value is how many. Bytes at which
tokens of both tokenizers end cut the tokens into groups; the product of the two
token-group incidences has an entry for each pair that shares a group.

How often an id pair is linked is counted over the corpus by Spark: documents
give their different pairs, counts add up on the map side. The scores of a
document then need the count of each of its pairs. Frequent pairs are in nearly
every document, so the most frequent ones, of a fixed number, are broadcast; the
rest, which are rare each, meet their counts in a join by pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reposcope.llm.bpe import Encoder, Merges, tokenizer_path
from reposcope.llm.common import forget, keyed_text, passes, read, real_id, written

#: Pairs whose counts are broadcast: 17 bytes each, 1.1 MB in all.
FREQUENT = 1 << 16
#: Products of nonzeros that one step of a matrix product holds.
STEP = 1 << 19
#: An id pair is one number; ids of both vocabularies are below this.
ID_BASE = 1 << 31


# --- sparse matrices --------------------------------------------------------------


@dataclass
class CSR:
    """A sparse matrix by rows: row i has columns indices[indptr[i]:indptr[i + 1]] with as many values."""

    indptr: np.ndarray
    indices: np.ndarray
    values: np.ndarray
    n_cols: int

    @property
    def n_rows(self) -> int:
        return len(self.indptr) - 1

    def rows(self) -> np.ndarray:
        """The row of each entry."""
        return np.repeat(np.arange(self.n_rows), np.diff(self.indptr))

    def transposed(self) -> CSR:
        """By counting columns; entries of a new row keep the order of the old rows."""
        indptr = np.concatenate([[0], np.cumsum(np.bincount(self.indices, minlength=self.n_cols))])
        order = np.argsort(self.indices, kind="stable")
        return CSR(indptr, self.rows()[order], self.values[order], self.n_rows)

    def products(self, other: CSR) -> Iterator[CSR]:
        """The product self · other, some rows at a time (at least one).

        Row i is the sum of the rows of `other` at the columns of row i: their
        entries are laid out one after another and those of equal column added.
        """
        sizes = np.diff(other.indptr)[self.indices]
        work = np.concatenate([[0], np.cumsum(sizes)])[self.indptr]
        lo = 0
        while lo < self.n_rows:
            hi = min(max(lo + 1, int(np.searchsorted(work, work[lo] + STEP, side="right")) - 1), self.n_rows)
            a, b = self.indptr[lo], self.indptr[hi]
            take, many = self.indices[a:b], sizes[a:b]
            ends = np.cumsum(many)
            total = int(ends[-1]) if len(ends) else 0
            at = np.arange(total) + np.repeat(other.indptr[take] - (ends - many), many)
            row = np.repeat(np.repeat(np.arange(hi - lo), np.diff(self.indptr[lo : hi + 1])), many)
            key = row * other.n_cols + other.indices[at]
            value = np.repeat(self.values[a:b], many) * other.values[at]
            if len(key) and (key[1:] < key[:-1]).any():
                order = np.argsort(key, kind="stable")
                key, value = key[order], value[order]
            new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            added = np.add.reduceat(value, new) if len(new) else value
            key = key[new]
            counts = np.bincount(key // max(other.n_cols, 1), minlength=hi - lo)
            yield CSR(np.concatenate([[0], np.cumsum(counts)]), key % max(other.n_cols, 1), added, other.n_cols)
            lo = hi

    def dot(self, other: CSR) -> CSR:
        parts = list(self.products(other))
        if not parts:
            return CSR(np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), other.n_cols)
        indptr = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p.indptr) for p in parts]))])
        return CSR(indptr, np.concatenate([p.indices for p in parts]), np.concatenate([p.values for p in parts]), other.n_cols)


def runs_matrix(sizes: np.ndarray, n_cols: int) -> CSR:
    """Rows that cover the columns one after another, `sizes` of them each: tokens over bytes."""
    indptr = np.concatenate([[0], np.cumsum(sizes)])
    return CSR(indptr, np.arange(n_cols), np.ones(n_cols, np.int64), n_cols)


def member_matrix(group: np.ndarray, n_groups: int) -> CSR:
    """One entry a row: the token's group."""
    return CSR(np.arange(len(group) + 1), group, np.ones(len(group), np.int64), n_groups)


@dataclass
class Alignment:
    """Tokens of two tokenizers over the same bytes; documents lie one after another."""

    a: CSR  # tokens of A over bytes
    b: CSR
    group_a: np.ndarray  # the group of each token of A
    group_b: np.ndarray
    n_groups: int

    @classmethod
    def of(cls, size_a: np.ndarray, size_b: np.ndarray) -> Alignment:
        """From the bytes of each token; both cover the same bytes."""
        end_a, end_b = np.cumsum(size_a), np.cumsum(size_b)
        n_bytes = int(end_a[-1]) if len(end_a) else 0
        both = np.zeros(n_bytes + 1, np.uint8)
        both[end_a] += 1
        both[end_b] += 1
        cuts = np.flatnonzero(both == 2)  # where tokens of both end
        return cls(runs_matrix(size_a, n_bytes), runs_matrix(size_b, n_bytes), np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b), len(cuts))

    def overlaps(self) -> CSR:
        """Links: a row for each token of A, its entries the tokens of B that share bytes with it, and how many."""
        return self.a.dot(self.b.transposed())

    def shared_groups(self) -> Iterator[CSR]:
        """Pairs of tokens in the same group, some tokens of A at a time, since a group of p and q tokens has p q pairs."""
        yield from member_matrix(self.group_a, self.n_groups).products(member_matrix(self.group_b, self.n_groups).transposed())

    def shared_pairs(self) -> np.ndarray:
        """How many pairs share each group."""
        return np.bincount(self.group_a, minlength=self.n_groups) * np.bincount(self.group_b, minlength=self.n_groups)


# --- the two tokenizers -------------------------------------------------------------


def _flat(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(pieces), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)


class ByteLevel:
    """A byte-level BPE file; strings of its special tokens inside texts are plain text."""

    def __init__(self, path: str):
        merges = Merges(path)
        merges.special = {}
        self.encoder = Encoder(merges)
        self.bytes = merges.bytes
        self.bounds = np.concatenate([[0], merges.ends]).astype(np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return list(self.encoder.encode([" " + t for t in texts]))


class Pieces:
    """A sentencepiece model that puts a space before a text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        names = [self.model.id_to_piece(i) for i in range(size)]
        self.bytes, self.bounds = _flat([bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, np.int64) for ids in self.model.encode(texts, num_threads=1)]


def spelled(tokenizer: ByteLevel | Pieces, ids: np.ndarray) -> np.ndarray:
    """The bytes of a sequence of ids."""
    starts, sizes = tokenizer.bounds[ids], np.diff(tokenizer.bounds)[ids]
    total = np.cumsum(sizes)
    at = np.arange(int(total[-1]) if len(total) else 0) + np.repeat(starts - (total - sizes), sizes)
    return tokenizer.bytes[at]


class Aligner:
    """Both tokenizers and the written form of their groups."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteLevel(path_a), Pieces(path_b)
        self.n_a = len(self.a.bounds) - 1
        a, b = [str(i) for i in range(self.n_a)], [str(i) for i in range(len(self.b.bounds) - 1)]
        #: an id of A inside and at the end of its group's part, then those of B
        self.names = [*(n + "," for n in a), *(n + "|" for n in a), *(n + "," for n in b), *(n + ";" for n in b)]

    def tokens(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The ids of each text by both; none of either where a text is empty or not spelled alike."""
        none = np.zeros(0, np.int64)
        out = []
        for text, a, b in zip(texts, self.a.encode(texts), self.b.encode(texts)):
            want = np.frombuffer(b" " + text.encode("utf-8", "replace"), np.uint8)
            same = text != "" and np.array_equal(spelled(self.a, a), want) and np.array_equal(spelled(self.b, b), want)
            out.append((a, b) if same else (none, none))
        return out

    def align(self, a: np.ndarray, b: np.ndarray) -> Alignment:
        return Alignment.of(np.diff(self.a.bounds)[a], np.diff(self.b.bounds)[b])

    def written_groups(self, ids_a: np.ndarray, ids_b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray) -> str:
        """a1,a2|b1;a3|b2,b3: the ids of each group, A before B."""
        last_a, last_b = np.append(group_a[1:] != group_a[:-1], True), np.append(group_b[1:] != group_b[:-1], True)
        out = np.empty(len(ids_a) + len(ids_b), np.int64)
        out[np.arange(len(ids_a)) + np.searchsorted(group_b, group_a)] = ids_a + last_a * self.n_a
        out[np.arange(len(ids_b)) + np.searchsorted(group_a, group_b, side="right")] = 2 * self.n_a + ids_b + last_b * (len(self.b.bounds) - 1)
        return "".join([self.names[i] for i in out.tolist()])[:-1]


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """This worker's pair of tokenizers."""
    if (path_a, path_b) not in _aligners:
        _aligners.clear()
        _aligners[path_a, path_b] = Aligner(path_a, path_b)
    return _aligners[path_a, path_b]


# --- documents ------------------------------------------------------------------------

_ALIGNED = "id long, n_a long, n_b long, n_groups long, n_links long, n_shared long, groups_sha256 string, pairs array<long>, times array<long>"


def _aligned_pass(al: Aligner, texts: list[str]) -> list[tuple]:
    """What `_ALIGNED` says after id, for some texts; their tokens are one matrix."""
    found = al.tokens(texts)
    ids_a, ids_b = np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])
    at_a, at_b = np.cumsum([0, *(len(a) for a, _ in found)]), np.cumsum([0, *(len(b) for _, b in found)])
    whole = al.align(ids_a, ids_b)
    links, shared = whole.overlaps(), whole.shared_pairs()
    pair = ids_a[links.rows()] * ID_BASE + ids_b[links.indices]
    out = []
    for k in range(len(texts)):
        a, b = slice(at_a[k], at_a[k + 1]), slice(at_b[k], at_b[k + 1])
        if a.start == a.stop:
            out.append((0, 0, 0, 0, 0, "", [], []))
            continue
        group_a, group_b = whole.group_a[a], whole.group_b[b]
        pairs, times = np.unique(pair[links.indptr[a.start] : links.indptr[a.stop]], return_counts=True)
        sha = hashlib.sha256(al.written_groups(ids_a[a], ids_b[b], group_a, group_b).encode()).hexdigest()
        first, end = int(group_a[0]), int(group_a[-1]) + 1
        out.append((a.stop - a.start, b.stop - b.start, end - first, int(times.sum()), int(shared[first:end].sum()), sha, pairs, times))
    return out


def aligned(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row: id, n_a, n_b, n_groups, n_links, n_shared, groups_sha256, its different id pairs and how often each is linked.

    A pair is A's id times 2^31 plus B's. Texts that are null, empty or not
    spelled alike by both have no tokens: zeros, '' and empty arrays.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al = aligner(path_a, path_b)
        schema = pa.schema([("id", pa.int64()), *[(n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links", "n_shared")], ("groups_sha256", pa.string()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))])
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
            for lo, hi in passes(offsets):
                columns = zip(*_aligned_pass(al, texts[lo:hi]))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([ids[lo:hi], *columns], schema)], schema=schema)

    return keyed_text(docs, id_col, text_col).mapInArrow(run, _ALIGNED)


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n, best): in how many rows an id pair occurs, and whether that is the most of its A id."""
    counts = rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")).withColumn("a", F.shiftright("pair", 31))
    # A's ids are no more than its vocabulary; nothing here is larger than the different pairs
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    return counts.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def scored(rows: DataFrame, counts: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """(row, n_best, count_sum): over a row's links, those whose count is their A id's highest, and the sum of counts.

    The `frequent` most frequent pairs are broadcast; the others are joined.
    """
    spark = rows.sparkSession
    top = counts.orderBy(F.desc("n"), "pair").limit(frequent).toArrow()
    pair = top.column("pair").to_numpy()
    order = np.argsort(pair)
    known = spark.sparkContext.broadcast((pair[order], top.column("n").to_numpy()[order], top.column("best").to_numpy(zero_copy_only=False)[order].astype(np.int64)))
    least = int(top.column("n").to_numpy().min()) if len(pair) else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, best = known.value
        for batch in batches:
            pairs, times = batch.column(1), batch.column(2)
            flat = pairs.flatten().to_numpy(zero_copy_only=False)
            often = times.flatten().to_numpy(zero_copy_only=False)
            bounds = np.concatenate([[0], np.cumsum(pairs.value_lengths().to_numpy(zero_copy_only=False))])
            at = np.minimum(np.searchsorted(keys, flat), max(len(keys) - 1, 0))
            hit = keys[at] == flat if len(keys) else np.zeros(len(flat), bool)
            weight = np.where(hit, often, 0)
            sums = [np.concatenate([[0], np.cumsum(w)]) for w in ((weight * best[at], weight * n[at]) if len(keys) else (weight, weight))]
            rest = np.concatenate([[0], np.cumsum(~hit)])[bounds].astype(np.int32)
            left = [pa.ListArray.from_arrays(pa.array(rest), pa.array(v[~hit])) for v in (flat, often)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(s[bounds[1:]] - s[bounds[:-1]]) for s in sums], *left], ["row", "n_best", "count_sum", "pairs", "times"])

    known_part = written(rows.select("row", "pairs", "times").mapInArrow(run, "row long, n_best long, count_sum long, pairs array<long>, times array<long>"))
    rest = known_part.filter(F.size("pairs") > 0).select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    # pairs beyond the most frequent ones are no more frequent than the least of those
    found = rest.join(counts.filter(F.col("n") <= least), "pair")
    more = found.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    zero = F.lit(0).cast("long")
    return known_part.join(more, "row", "left").select("row", (F.col("n_best") + F.coalesce("more_best", zero)).alias("n_best"), (F.col("count_sum") + F.coalesce("more_sum", zero)).alias("count_sum"))


def token_alignment(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """Per input row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, n_shared, groups_sha256.

    An id pair's count is the number of rows that hold it linked, so rows that
    repeat count each. n_shared is the number of token pairs that share a group.
    A null id stays null; an empty table gives no rows; texts without tokens
    (see `aligned`) have zeros. Only id and text are read. Both files must be on
    every executor.
    """
    rows = written(aligned(docs, path_a, path_b, id_col, text_col).withColumn("row", F.monotonically_increasing_id()))
    counts = written(pair_counts(rows))
    scores = scored(rows, counts, frequent)
    return rows.join(scores, "row").select(real_id("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "n_shared", "groups_sha256")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment(read(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))
