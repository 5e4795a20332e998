"""Which texts contain which needles, without pairing them and without moving a text.

The needles make an index: the beginnings of three bytes that any of them has,
the lengths that occur, and a bitmap of hashes of (repository, needle). A text
is passed over once by numpy: where a needle could begin, the hash of each
occurring length is looked up in the bitmap, and what is found goes on as the
piece of text itself, once per text, to be joined with the needles by equality.
So the rows that leave a task are the matches (and a share of chance hits that
the join drops), not the text and not its parts.

Needles of over `WHOLE` bytes are looked up by their first `WHOLE` bytes and
compared to their end afterwards. An index holds `BLOCK` needles; for more of
them there are more indexes, and the texts are passed over once for each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reposcope.sources.tables import written

#: Needles of an index: two 8-byte hashes each on their way to the driver.
BLOCK = 1 << 20
#: Bits of an index's bitmap as a power of two; 4 MB, which a full block fills to 6 %.
BITS = 25
#: Bytes of a needle that are hashed.
WHOLE = 64
#: Bytes of text that a pass holds, at least one text.
PASS = 1 << 18

_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


_BYTES = _mixed(np.arange(1, 257, dtype=np.uint64) * _ODD)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out)


class Sums:
    """Hashes of any run of bytes from sums of powers: a run's hash does not depend on where it lies."""

    def __init__(self, data: np.ndarray):
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * _powers(_BASE, len(data)))])
        self.back = _powers(_INVERSE, len(data) + 1)

    def of(self, start: np.ndarray, size: int | np.ndarray, repo: np.ndarray) -> np.ndarray:
        h = (self.sums[start + size] - self.sums[start]) * self.back[start]
        return _mixed(_mixed(h + np.asarray(size).astype(np.uint64) * _ODD) ^ repo)


def _strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets of its values."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def _uint64(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).view(np.uint64)


def _bits(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = np.uint64(64 - BITS)
    return (keys >> cut).astype(np.int64), ((keys * _ODD) >> cut).astype(np.int64)


class Index:
    """What a block of needles leaves for the passes over texts; its size does not depend on theirs."""

    def __init__(self, keys: np.ndarray, begins: np.ndarray, sizes: np.ndarray, longest: int):
        flags = np.zeros(1 << BITS, bool)
        for at in _bits(keys):
            flags[at] = True
        self.bitmap = np.packbits(flags, bitorder="little")
        three = np.zeros((256, 256, 256), bool)
        short = np.minimum(sizes, 3)
        a, b, c = begins & 255, begins >> 8 & 255, begins >> 16
        three[a[short == 3], b[short == 3], c[short == 3]] = True
        three[a[short == 2], b[short == 2]] = True
        three[a[short == 1]] = True
        self.three = np.packbits(three.ravel(), bitorder="little")
        self.sizes = np.unique(np.minimum(sizes, WHOLE))
        self.longest = longest

    def holds(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), bool)
        for at in _bits(keys):
            found &= (self.bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return found

    def begins(self, data: np.ndarray) -> np.ndarray:
        """Places where three bytes stand with which some needle begins."""
        padded = np.concatenate([data, np.zeros(2, np.uint8)]).astype(np.int64)
        at = (padded[:-2] << 16) | (padded[1:-1] << 8) | padded[2:]
        return np.flatnonzero(self.three[at >> 3] >> (at & 7).astype(np.uint8) & 1)

    def find(self, data: np.ndarray, offs: np.ndarray, repo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, start, size) of what may be needles, each once per text where it is not cut at WHOLE."""
        place = self.begins(data)
        text = np.searchsorted(offs, place, side="right") - 1
        room = offs[text + 1] - place
        sums, rows, starts, sizes, keys = Sums(data), [], [], [], []
        for size in self.sizes.tolist():
            fits = np.flatnonzero(room >= size)
            key = sums.of(place[fits], size, repo[text[fits]])
            hit = self.holds(key)
            rows.append(text[fits][hit])
            starts.append(place[fits][hit])
            sizes.append(np.full(len(rows[-1]), size))
            keys.append(key[hit])
        row, start, size, key = np.concatenate(rows), np.concatenate(starts), np.concatenate(sizes), np.concatenate(keys)
        order = np.lexsort((key, row))
        row, start, size, key = row[order], start[order], size[order], key[order]
        first = np.ones(len(row), bool)
        first[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
        if self.longest > WHOLE:
            first |= size == WHOLE
        return row[first], start[first], size[first]


def _read_index(needles: DataFrame, block: int, blocks: int) -> Index:
    """The index of one block of (repo_id, needle)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = _strings(batch.column(1))
            sizes = np.diff(offs)
            key = Sums(data).of(offs[:-1], np.minimum(sizes, WHOLE), _uint64(batch.column(0)))
            padded = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int64)
            begin = padded[offs[:-1]] | padded[offs[:-1] + 1] << 8 | padded[offs[:-1] + 2] << 16
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(begin), pa.array(sizes)], ["key", "begin", "size"])

    mine = needles.filter(F.pmod(F.xxhash64("needle", F.lit(7)), F.lit(blocks)) == block) if blocks > 1 else needles
    found = mine.select(F.xxhash64("repo_id"), "needle").mapInArrow(run, "key long, begin long, size long").toArrow()
    columns = [found.column(k).to_numpy() for k in range(3)]
    return Index(columns[0].view(np.uint64), columns[1], columns[2], int(columns[2].max(initial=0)))


def contained(texts: DataFrame, text: str, needles: DataFrame, needle: str) -> DataFrame:
    """(the columns of `texts` but the text, needle): each text with the needles of its repository that it contains.

    Both tables have a repo_id. Rows come once, also where texts or needles
    repeat. A needle that is empty or null is in no text; a null text contains
    nothing; a null repository meets nothing. Letters are compared as they are.
    """
    spark, keys = texts.sparkSession, [c for c in texts.columns if c != text]
    asked = needles.select("repo_id", F.col(needle).alias("needle")).filter("needle <> '' AND repo_id IS NOT NULL").distinct()
    asked = written(asked)
    blocks = max(1, -(-asked.count() // BLOCK))
    rows = texts.filter(F.col(text).isNotNull() & F.col("repo_id").isNotNull()).select(F.xxhash64("repo_id").alias("text_repo"), F.col(text).alias("text_searched"), *keys)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.select(*keys).schema.fields) + ", piece binary, tail binary"
    parts = []
    for block in range(blocks):
        index = spark.sparkContext.broadcast(_read_index(asked, block, blocks))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            ix: Index = index.value
            for batch in batches:
                repo = _uint64(batch.column(0))
                data, offs = _strings(batch.column(1))
                lo = 0
                while lo < len(repo) and len(ix.sizes):
                    hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + PASS, side="right")) - 1)
                    here = data[offs[lo] : offs[hi]]
                    own = offs[lo : hi + 1] - offs[lo]
                    row, start, size = ix.find(here, own, repo[lo:hi])
                    raw, end = here.tobytes(), own[row + 1]
                    spans = list(zip(start.tolist(), size.tolist(), end.tolist()))
                    pieces = pa.array([raw[a : a + n] for a, n, _ in spans], pa.binary())
                    tails = pa.array([raw[a + n : min(a + ix.longest, e)] if n == WHOLE else b"" for a, n, e in spans], pa.binary())
                    kept = [batch.column(k).take(pa.array(row + lo)) for k in range(2, batch.num_columns)]
                    yield pa.RecordBatch.from_arrays([*kept, pieces, tails], [*keys, "piece", "tail"])
                    lo = hi

        parts.append(rows.mapInArrow(run, schema))
    hits = parts[0]
    for part in parts[1:]:
        hits = hits.unionByName(part)
    raw = F.encode("needle", "UTF-8")
    heads = asked.withColumn("piece", F.substring(raw, 1, WHOLE))
    found = hits.join(heads, ["repo_id", "piece"]).filter((F.octet_length("needle") <= F.octet_length("piece")) | F.startswith(F.concat("piece", "tail"), raw))
    return found.select(*keys, F.col("needle").alias(needle)).distinct()
