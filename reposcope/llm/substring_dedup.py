"""Substring dedup over a compacted De Bruijn graph of token k-mers.

Edges of the graph are k-mers of words. A text contributes the edges that are
minimal in some window of WINDOW words (the leftmost smallest hash of its
k-mers), so equal windows always contribute the same edge at the same place,
while only a few edges per window length travel. The node between an edge and
its neighbour is named by the hash of the words from one to the other; the
text's own beginning and end count as neighbours.

An edge whose occurrences all lead to the same node is nonbranching on that
side. Two edges that meet in a node which is nonbranching from both sides belong
to one path. A repeated edge has source coordinates, the smallest document that
holds it and its place there, so the edges of a path lie one after the other in
their source; paths are numbered there and joined back to their edges. A second
join brings the paths to the occurrences, and a run of edges of one path in a
document becomes one row.

Windows within such a run are claimed as one long span, whose words are compared
with those at the source coordinates; windows that reach over a branching end are
compared one by one. Both comparisons use hashes that are independent of the
graph's. A word is thus removed only if it is covered by a window that a smaller
document has, word by word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reposcope.llm.common import UNBLANK, Spans, find_words, keyed_text, passes, read, real_id, signed, text_buffers, word_hashes, written

#: Words of a window, and of a k-mer edge.
WINDOW, K = 50, 12

EDGE = np.uint64(0x5851F42D4C957F2D)
EDGES = "id long, fp int, pos int, lo int, hi int, h long, prev long, next long, near int"
#: Bits of each of the two distances that `near` packs; a window and an edge have fewer words.
NEAR = 12


def leftmost_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """For each i the index of the leftmost smallest of values[i : i + width], by doubling."""
    n = len(values) - width + 1
    best, index, span = values, np.arange(len(values)), 1
    levels = []
    while True:
        levels.append((span, best, index))
        if 2 * span > width:
            break
        take = best[span:] < best[:-span]
        best, index = np.where(take, best[span:], best[:-span]), np.where(take, index[span:], index[:-span])
        span *= 2
    shift = width - span
    a, b = slice(0, n), slice(shift, shift + n)
    return np.where(best[b] < best[a], index[b], index[a])


class Words:
    """The words of the texts of one pass; hashes of runs of up to `longest` words, and independent ones as proofs."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, longest: int):
        self.data = data
        self.starts, self.ends, self.first = find_words(data, offs, UNBLANK)
        self.spans = Spans(word_hashes(data, self.starts, self.ends), longest)

    def prove(self, longest: int) -> None:
        self.second = word_hashes(self.data, self.starts, self.ends, seed=1)
        self.proofs = Spans(self.second, longest)

    def digest(self, begin: int, end: int) -> bytes:
        return hashlib.blake2b(self.second[begin:end].tobytes(), digest_size=12).digest()

    def windows(self, window: int) -> np.ndarray:
        """Start of every window that lies within one text."""
        sizes = np.maximum(np.diff(self.first) - window + 1, 0)
        return np.arange(int(sizes.sum())) + np.repeat(self.first[:-1] - (np.cumsum(sizes) - sizes), sizes)


def edges(words: Words, window: int, k: int) -> dict[str, np.ndarray]:
    """The minimal edges of the texts of a pass; positions count words of their text."""
    n = len(words.starts)
    starts = words.windows(window)
    if not len(starts):
        return {}
    at = np.arange(n - k + 1)
    kmers = words.spans.of(at, at + k)
    chosen = leftmost_minimum(kmers, window - k + 1)[starts]
    text = np.searchsorted(words.first, starts, side="right") - 1
    fresh = np.flatnonzero(np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (text[1:] != text[:-1])]))
    last = np.append(fresh[1:], len(chosen)) - 1
    pos, text = chosen[fresh], text[fresh]
    begin, end = words.first[text], words.first[text + 1]
    same = text[1:] == text[:-1]
    from_prev = begin.copy()
    from_prev[1:][same] = pos[:-1][same]
    to_next = end.copy()
    to_next[:-1][same] = pos[1:][same] + k
    prev = words.spans.of(from_prev, pos + k)
    prev[np.concatenate([[True], ~same])] ^= EDGE
    after = words.spans.of(pos, to_next)
    after[np.concatenate([~same, [True]])] ^= EDGE
    return {
        "text": text,
        "pos": pos - begin,
        "lo": starts[fresh] - begin,
        "hi": starts[last] - begin,
        "h": kmers[pos],
        "prev": prev,
        "next": after,
        "near": (pos - from_prev) << NEAR | (to_next - pos),
    }


def edge_table(rows: DataFrame, window: int, k: int) -> DataFrame:
    """Occurrences of minimal edges: see EDGES; lo and hi are the first and last window of the edge."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, prints = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            data, offs = text_buffers(batch.column(2))
            for a, b in passes(offs):
                found = edges(Words(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], window + k), window, k)
                if found:
                    text = found["text"] + a
                    small = [pa.array(found[c].astype(np.int32)) for c in ("pos", "lo", "hi")]
                    wide = [signed(found[c]) for c in ("h", "prev", "next")]
                    columns = [pa.array(ids[text]), pa.array(prints[text]), *small, *wide, pa.array(found["near"].astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, ["id", "fp", "pos", "lo", "hi", "h", "prev", "next", "near"])

    return rows.select("id", "fp", "text").mapInArrow(run, EDGES)


def repeated_edges(found: DataFrame) -> DataFrame:
    """Edges of two or more documents: h, source coordinates (sid, sfp, spos), back, ahead, and the nodes on both sides.

    A node is null where the occurrences lead to different ones. Two edges that
    share a 64-bit hash by chance differ in their nodes, whose hashes cover the
    edge itself, so they branch on both sides.
    """
    stats = found.groupBy("h").agg(
        F.min(F.struct("id", "fp", "pos", "near")).alias("s"), F.max("id").alias("other"),
        F.min("prev").alias("p1"), F.max("prev").alias("p2"), F.min("next").alias("n1"), F.max("next").alias("n2"),
    )
    return stats.filter("s.id < other").select(
        "h", F.col("s.id").alias("sid"), F.col("s.fp").alias("sfp"), F.col("s.pos").alias("spos"),
        F.shiftright("s.near", NEAR).alias("back"), F.col("s.near").bitwiseAND(F.lit((1 << NEAR) - 1)).alias("ahead"),
        F.when(F.col("p1") == F.col("p2"), F.col("p1")).alias("prev"), F.when(F.col("n1") == F.col("n2"), F.col("n1")).alias("next"),
    )


def path_edges(found: DataFrame, k: int) -> DataFrame:
    """(key = ~h, sid, sfp, spos, begin, end): each repeated edge with the words of its path, in source coordinates."""
    place = Window.partitionBy("sid", "sfp").orderBy("spos")
    meets = F.coalesce(F.lag("next").over(place) == F.col("prev"), F.lit(False))
    numbered = repeated_edges(found).withColumn("starts", (~meets).cast("int")).withColumn("path", F.sum("starts").over(place))
    paths = numbered.groupBy("sid", "sfp", "path").agg(
        # a nonbranching side reaches to the neighbour edge, or the text's end, beyond the path
        F.min(F.col("spos") - F.when(F.col("prev").isNotNull(), F.col("back")).otherwise(0)).alias("begin"),
        F.max(F.col("spos") + F.when(F.col("next").isNotNull(), F.col("ahead")).otherwise(k)).alias("end"),
    )
    # keyed by ~h, so that both sides of the next join are dealt anew and a hot edge can be split
    return numbered.join(paths, ["sid", "sfp", "path"]).select(F.bitwise_not("h").alias("key"), "sid", "sfp", "spos", "begin", "end")


def path_runs(found: DataFrame, window: int, k: int) -> DataFrame:
    """(id, fp, sid, sfp, shift, lo, hi, first, last): a row for each run of a path's edges in a document.

    lo and hi are the first and last window of the edges, first to last the
    windows that lie within the path (none if first > last); shift leads from
    the document's words to those of the source.
    """
    occurrences = found.select(F.bitwise_not("h").alias("key"), "id", "fp", "pos", "lo", "hi")
    runs = occurrences.join(path_edges(found, k), "key").withColumn("shift", F.col("spos") - F.col("pos"))
    runs = runs.groupBy("id", "fp", "sid", "sfp", "shift", "begin", "end").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    first = F.greatest("lo", F.col("begin") - F.col("shift"))
    last = F.least("hi", F.col("end") - F.col("shift") - window)
    return runs.select("id", "fp", "sid", "sfp", "shift", "lo", "hi", first.alias("first"), last.alias("last"))


def marks(runs: DataFrame) -> DataFrame:
    """Per document its runs, and the spans that others claim to have from it."""
    own = runs.groupBy("id", "fp").agg(F.collect_list(F.struct("lo", "hi", "first", "last", (F.col("sid") < F.col("id")).alias("smaller"))).alias("runs"))
    wanted = runs.filter("sid < id AND first <= last").select("sid", "sfp", (F.col("first") + F.col("shift")).alias("start"), (F.col("last") - F.col("first")).alias("more"))
    spans = wanted.distinct().groupBy("sid", "sfp").agg(F.collect_list(F.struct("start", "more")).alias("wanted"))
    return own.join(spans.select(F.col("sid").alias("id"), F.col("sfp").alias("fp"), "wanted"), ["id", "fp"], "left")


def _ranges(owner: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All integers from lo to hi of each range, with the range's owner."""
    sizes = np.maximum(hi - lo + 1, 0)
    total = int(sizes.sum())
    at = np.arange(total) + np.repeat(lo - (np.cumsum(sizes) - sizes), sizes)
    return np.repeat(owner, sizes), at


def _fields(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """For each element of a list column its row, and the fields of the structs."""
    sizes = np.array(column.value_lengths().fill_null(0), np.int64)
    flat = column.flatten()
    return np.repeat(np.arange(len(sizes)), sizes), [flat.field(i).to_numpy(zero_copy_only=False) for i in range(flat.type.num_fields)]


CLAIMS = "id long, at long, more int, w long, p int"


def claims(marked: DataFrame, window: int) -> DataFrame:
    """A 96-bit hash (w, p) of each span to be compared; at packs fp and the span's first word.

    more is the number of windows after the first that the span has: 0 for a
    window that reaches over a branching end, -1 for the source's side of a
    longer span, which is not removed itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, prints = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64) << 32
            data, offs = text_buffers(batch.column(2))
            for a, b in passes(offs):
                words = Words(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], window)
                words.prove(window)
                text, (lo, hi, first, last, smaller) = _fields(batch.column(3).slice(a, b - a))
                whole = first <= last
                parts = [_ranges(text, lo, np.where(whole, first - 1, hi)), _ranges(text[whole], last[whole] + 1, hi[whole])]
                owner, s = (np.concatenate([p[i] for p in parts]) for i in range(2))
                at = words.first[owner] + s
                proof = (words.proofs.of(at, at + window) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                columns = [ids[a + owner], prints[a + owner] | s, np.zeros(len(s), np.int32), words.spans.of(at, at + window).view(np.int64), proof]
                # long spans: those that this document claims, and those that are claimed of it
                take = np.flatnonzero(whole & smaller.astype(bool))
                by, (start, more) = _fields(batch.column(4).slice(a, b - a))
                owner = np.concatenate([text[take], by])
                s, length = np.concatenate([first[take], start]).astype(np.int64), np.concatenate([last[take] - first[take], more]).astype(np.int64)
                digests = np.zeros((len(owner), 3), np.int32)
                for i, (x, n) in enumerate(zip((words.first[owner] + s).tolist(), length.tolist())):
                    digests[i] = np.frombuffer(words.digest(x, x + n + window), np.int32)
                told = np.concatenate([length[: len(take)], np.full(len(by), -1)]).astype(np.int32)
                spans = [ids[a + owner], prints[a + owner] | s, told, np.ascontiguousarray(digests[:, :2]).view(np.int64).ravel(), digests[:, 2]]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(columns, spans)], ["id", "at", "more", "w", "p"])

    return marked.select("id", "fp", "text", "runs", "wanted").mapInArrow(run, CLAIMS)


def verified(spans: DataFrame) -> DataFrame:
    """Per document the spans that a smaller document has too, word for word."""
    sources = spans.groupBy("w", "p").agg(F.min("id").alias("source"), F.max("id").alias("other")).filter("source < other")
    sources = sources.select(F.bitwise_not("w").alias("key"), "p", "source")
    found = spans.filter("more >= 0").withColumn("key", F.bitwise_not("w")).drop("w").join(sources, ["key", "p"]).filter("source < id")
    place = found.select("id", F.shiftright("at", 32).cast("int").alias("fp"), F.col("at").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("s"), "more")
    return place.groupBy("id", "fp").agg(F.collect_list(F.struct("s", "more")).alias("spans"))


RESULT = "id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def without_repeats(rows: DataFrame, window: int, with_text: bool) -> DataFrame:
    """Removes the covered words of each document; its columns: id, text, spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = text_buffers(batch.column(1))
            for a, b in passes(offs):
                part = data[offs[a] : offs[b]]
                starts, ends, first = find_words(part, offs[a : b + 1] - offs[a], UNBLANK)
                text, (s, more) = _fields(batch.column(2).slice(a, b - a))
                n, at = len(starts), first[text] + s
                cover = np.bincount(at, minlength=n + 1) - np.bincount(at + more + window, minlength=n + 1)[: n + 1]
                gone = np.cumsum(cover)[:n] > 0
                kept = _joined(part, starts, ends, first, ~gone)
                removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[first])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array(np.diff(first)),
                        pa.array(removed.astype(np.int64)),
                        pa.array([hashlib.sha256(t).hexdigest() for t in kept]),
                        pa.array([t.decode("utf-8", "replace") if with_text else None for t in kept], pa.string()),
                    ],
                    ["id", "n_words", "n_removed", "kept_sha256", "kept_text"],
                )

    return rows.select("id", "text", "spans").mapInArrow(run, RESULT)


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, keep: np.ndarray) -> list[bytes]:
    """The kept words of each text joined by one space."""
    starts, ends = starts[keep], ends[keep]
    sizes = ends - starts + 1
    stop = np.cumsum(sizes)
    at = np.arange(int(stop[-1]) if len(stop) else 0) + np.repeat(starts - (stop - sizes), sizes)
    out = data[np.minimum(at, len(data) - 1)] if len(at) else np.zeros(0, np.uint8)
    out[stop - 1] = 32
    count = np.concatenate([[0], np.cumsum(keep)])[first]
    bounds = np.concatenate([[0], stop])[count]
    raw = memoryview(out.tobytes())
    return [bytes(raw[lo : max(hi - 1, lo)]) for lo, hi in zip(bounds[:-1], bounds[1:])]


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, k: int = K, with_text: bool = True) -> DataFrame:
    """Per input row: doc_id, n_words, n_removed, kept_sha256 and kept_text.

    Words are runs of everything but ASCII white space. A word is removed if a
    window of `window` words that covers it also starts in a document with a
    smaller id; windows are judged on the input. Null and empty texts have no
    words. A null id counts as the largest; rows that repeat an id count as one
    document, so they do not remove each other's words, and each gives a row.
    An empty table gives no rows.
    """
    if window + k >= 1 << NEAR or not 0 < k <= window:
        raise ValueError(f"window + k must be below {1 << NEAR}, and k at most the window")
    rows = keyed_text(docs, id_col, text_col).select("id", F.hash("text").alias("fp"), "text")
    runs = written(path_runs(edge_table(rows, window, k), window, k))
    spans = claims(rows.join(marks(runs), ["id", "fp"]), window)
    out = without_repeats(rows.join(verified(spans), ["id", "fp"], "left"), window, with_text)
    return out.select(real_id("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256", *(["kept_text"] if with_text else []))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(read(spark, sf_dir, "documents"), with_text=False)


OP1_SQL = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM d WHERE len(w) >= 50)
), first AS (
  SELECT h, min(doc_id) AS source FROM s GROUP BY h
), gone AS (
  SELECT DISTINCT doc_id, unnest(generate_series(i, i + 49)) AS i FROM s JOIN first USING (h) WHERE source < doc_id
), words AS (
  SELECT doc_id, unnest(generate_series(1, len(w))) AS i, unnest(w) AS word FROM d
), kept AS (
  SELECT words.*, gone.i IS NULL AS stays FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.i = gone.i
), told AS (
  SELECT doc_id, count(*) FILTER (NOT stays) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (stays) AS kept FROM kept GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(t.n_removed, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(t.kept, '')) AS kept_sha256
FROM d LEFT JOIN told t USING (doc_id)
"""
