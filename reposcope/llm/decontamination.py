"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The symbols of the search are words. A pattern is a window of consecutive
words of a benchmark item. For all patterns of one length, a shift table tells
from the block of the last three words in the search window how far the window
may move without missing an occurrence; a shift of zero leads to the bucket of
the patterns that end in that block (the suffix hash), whose members are
compared with the text byte by byte.

One numpy pass searches many documents: texts are cut into segments that
overlap by a window, each segment has its own cursor, and all cursors move in
step. Patterns are broadcast in blocks of bounded size; each block is one pass
over the documents, so a large benchmark costs passes and not memory.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reposcope.llm.common import ALNUM, LOWER, column_index, find_words, fresh, passes, read, text_buffers, word_hashes

WINDOW = 10
#: Words of a block of the shift table.
BLOCK_WORDS = 3
#: Bytes of item text whose patterns are sent to the executors at once.
BLOCK_BYTES = 8_000_000
#: Words of a segment, the unit that one cursor walks through.
SEGMENT = 128


class WuManber:
    """Patterns of one length, in words: `texts` are their words joined by one space."""

    def __init__(self, hashes: np.ndarray, texts: list[bytes], items: list[list[int]]):
        self.m = hashes.shape[1]
        self.b = min(BLOCK_WORDS, self.m)
        self.texts, self.items = texts, items
        far = self.m - self.b
        shift: dict[int, int] = {}
        blocks = _blocks(hashes.ravel(), self.b)
        self.bucket: dict[int, list[int]] = defaultdict(list)
        for p in range(len(hashes)):
            for j in range(far + 1):
                key = int(blocks[p * self.m + j])
                shift[key] = min(shift.get(key, far), far - j)
            self.bucket[int(blocks[p * self.m + far])].append(p)
        self.keys = np.array(sorted(shift), np.uint64)
        self.shifts = np.array([shift[int(k)] for k in self.keys], np.int64)
        self.skip = far + 1

    def search(self, blocks: np.ndarray, lo: np.ndarray, hi: np.ndarray, at: Callable[[int, int], bytes]) -> Iterator[tuple[int, int]]:
        """(first word, pattern) of every occurrence that starts in one of the ranges lo to hi.

        `blocks` has the hash of the block that starts at each word; at(i, n)
        gives the bytes of n words from word i, joined by one space.
        """
        lo, hi = lo[lo < hi].copy(), hi[lo < hi]
        far = self.m - self.b
        while len(lo):
            seen = blocks[lo + far]
            where = np.searchsorted(self.keys, seen)
            where[where == len(self.keys)] = 0
            known = self.keys[where] == seen
            move = np.where(known, self.shifts[where], self.skip)
            for k in np.flatnonzero(move == 0):
                start = int(lo[k])
                text = at(start, self.m)
                for p in self.bucket[int(seen[k])]:
                    if self.texts[p] == text:
                        yield start, p
            lo += np.maximum(move, 1)
            alive = lo < hi
            lo, hi = lo[alive], hi[alive]


def _blocks(words: np.ndarray, b: int) -> np.ndarray:
    """Hash of the block of b words that starts at each word; the last few are not whole blocks."""
    out = words.copy()
    for k in range(1, b):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out[:-k] += words[k:]
    return out


class Patterns:
    """The windows of some items, by length, ready to be searched for."""

    def __init__(self, items: list[tuple[str | None, str]], window: int = WINDOW):
        self.names = [name for name, _ in items]
        found: dict[int, dict[bytes, set[int]]] = defaultdict(lambda: defaultdict(set))
        for k, (_, text) in enumerate(items):
            words = _split(text)
            size = min(window, len(words))
            for i in range(len(words) - size + 1 if size else 0):
                found[size][b" ".join(words[i : i + size])].add(k)
        self.machines = []
        for size, by_text in sorted(found.items()):
            texts = list(by_text)
            data, offs = text_buffers(pa.array([t.decode() for t in texts]))
            starts, ends, _ = find_words(data, offs, ALNUM)
            hashes = word_hashes(data, starts, ends).reshape(len(texts), size)
            self.machines.append(WuManber(hashes, texts, [sorted(by_text[t]) for t in texts]))

    def hits(self, column: pa.Array) -> Iterator[tuple[np.ndarray, set[int]]]:
        """For each text: which of its words are hit, and the indexes of the items found."""
        data, offs = text_buffers(column)
        for lo, hi in passes(offs):
            part = LOWER[data[offs[lo] : offs[hi]]]
            yield from self._pass(part, offs[lo : hi + 1] - offs[lo])

    def _pass(self, data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, set[int]]]:
        starts, ends, first = find_words(data, offs, ALNUM)
        hashes = word_hashes(data, starts, ends)
        raw = data.tobytes()

        def at(i: int, n: int) -> bytes:
            return b" ".join(raw[starts[j] : ends[j]] for j in range(i, i + n))

        cover = np.zeros(len(starts) + 1, np.int64)
        items: dict[int, set[int]] = defaultdict(set)
        blocks: dict[int, np.ndarray] = {}
        for machine in self.machines:
            if machine.b not in blocks:
                blocks[machine.b] = _blocks(hashes, machine.b)
            lo, hi = _segments(first, machine.m)
            for start, p in machine.search(blocks[machine.b], lo, hi, at):
                cover[start] += 1
                cover[start + machine.m] -= 1
                items[int(np.searchsorted(first, start, side="right")) - 1].update(machine.items[p])
        hit = np.cumsum(cover)[:-1] > 0
        for k in range(len(offs) - 1):
            yield hit[first[k] : first[k + 1]], items.get(k, set())


def _segments(first: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranges of start positions, SEGMENT at most, in which a window of m words fits its text."""
    lo, hi = first[:-1], np.maximum(first[1:] - m + 1, first[:-1])
    pieces = -(-(hi - lo) // SEGMENT)
    number = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = np.repeat(lo, pieces) + SEGMENT * number
    return begin, np.minimum(begin + SEGMENT, np.repeat(hi, pieces))


def _split(text: str) -> list[bytes]:
    data, offs = text_buffers(pa.array([text]))
    data = LOWER[data]
    starts, ends, _ = find_words(data, offs, ALNUM)
    raw = data.tobytes()
    return [raw[s:e] for s, e in zip(starts, ends)]


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[str | None, str]]]:
    """The items in blocks of about `block_bytes` bytes of text, each fetched by itself."""
    items = benchmark.select(
        F.col(f"`{id_col}`").cast("string").alias("item"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")
    )
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = math.ceil(2 * size / block_bytes) if size > block_bytes else 1
    for k in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
        yield [(r[0], r[1]) for r in part.collect()]


#: Pattern machines that this Python worker has built, the last few.
_built: dict[str, Patterns] = {}


def _patterns(key: str, items: list[tuple[str | None, str]], window: int) -> Patterns:
    if key not in _built:
        while len(_built) >= 2:
            _built.pop(next(iter(_built)))
        _built[key] = Patterns(items, window)
    return _built[key]


def searched(docs: DataFrame, text: int, items: list[tuple[str | None, str]], window: int) -> DataFrame:
    """`docs` after one block of items: its last three columns n_words, cover, items are brought up to date.

    cover has a bit for each word that any block has hit, or is empty, so hits
    of several blocks unite by position.
    """
    sent, key = docs.sparkSession.sparkContext.broadcast(items), uuid4().hex

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = _patterns(key, sent.value, window)
        for batch in batches:
            *rest, _, covers, names = batch.columns
            words, new_covers, new_names = [], [], []
            for (hit, found), cover, listed in zip(patterns.hits(batch.column(text)), covers.to_pylist(), names.to_pylist()):
                words.append(len(hit))
                bits = np.packbits(hit) if found else np.zeros(0, np.uint8)
                if cover:
                    bits = np.frombuffer(cover, np.uint8) | (bits if found else np.uint8(0))
                new_covers.append(bits.tobytes())
                listed = set(listed) | {patterns.names[i] for i in found}
                new_names.append(sorted(i for i in listed if i is not None))
            new = [pa.array(words, pa.int64()), pa.array(new_covers, pa.binary()), pa.array(new_names, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*rest, *new], names=batch.schema.names)

    return docs.mapInArrow(search, docs.schema)


def with_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
    names: tuple[str, str, str] = ("n_words", "n_hit", "items"),
) -> DataFrame:
    """All columns of `docs` and n_words, n_hit and items (the item ids found, sorted as strings).

    Null texts and null items' texts have no words. An item of fewer words than
    the window, but not none, is one window; a repeated item is found once; the
    words of an item without id are hit but the item is not listed. An empty
    benchmark hits nothing, an empty table gives no rows. `names` names the new
    columns; columns that have these names are replaced.
    """
    docs = docs.drop(*names)
    cover = fresh("cover", [*docs.columns, *names])
    n_words, n_hit, items = names
    text = column_index(docs, text_col)
    out = docs.withColumns({n_words: F.lit(0).cast("long"), cover: F.lit(b""), items: F.array().cast("array<string>")})
    for block in item_blocks(benchmark, item_col, item_text_col, block_bytes):
        out = searched(out, text, block, window)
    return out.withColumn(n_hit, _bits(cover)).drop(cover)


def _bits(column: str):
    """The number of bits set in a binary column."""
    digits = F.hex(F.col(column))
    ones = F.lit(0).cast("long")
    for value in range(1, 16):
        digit = f"{value:X}"
        ones = ones + bin(value).count("1") * (F.length(digits) - F.length(F.replace(digits, F.lit(digit), F.lit(""))))
    return ones.cast("long")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The input's columns and rows without those that hold any window of an item."""
    names = tuple(fresh(c, docs.columns) for c in ("n_words", "n_hit", "items"))
    found = with_hits(docs, benchmark, text_col, window=window, names=names)
    return found.filter(F.col(names[1]) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_hits(docs, read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP6_SQL = """
WITH lower_docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), patterns AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS p
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM items WHERE len(w) > 0)
), sizes AS (
  SELECT DISTINCT m FROM patterns
), windows AS (
  SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS p
  FROM (SELECT doc_id, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM lower_docs, sizes WHERE len(w) >= m)
), found AS (
  SELECT w.doc_id, w.i, w.m, p.item_id FROM windows w JOIN patterns p ON w.m = p.m AND w.p = p.p
), words_hit AS (
  SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + m - 1)) AS k FROM found) GROUP BY doc_id
), by_doc AS (
  SELECT doc_id, count(*) AS n, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(b.n, 0) AS BIGINT) AS n_items, sha256(coalesce(b.ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM lower_docs d LEFT JOIN words_hit h USING (doc_id) LEFT JOIN by_doc b USING (doc_id)
"""
