"""MinHash near-dedup by an inverted join over signature coordinates.

Documents with the same shingle set are one node. A node is posted under each
(coordinate, value) pair of its MinHash signature. A pair of nodes is a
candidate if it collides in MATCHES or more of the COORDINATES; at the
similarity threshold a true pair has fewer collisions with a chance of about
1e-6. Two bounds keep the join small without losing such a pair:

- prefix: of a node's pairs, ordered from rare to frequent, all but MATCHES - 1
  suffice, since any MATCHES collisions include one of them. Values that no
  other node has are counted in, so most nodes have no posting left at all;
- skip: once a posting's members are known to be linked, they are not paired
  any more. In a few rounds every member meets only the pivot of its posting;
  the members that are then still in different components are paired, so a
  group of copies costs rows in proportion to its size.

Collisions are counted on whole signatures and links confirmed on full sets,
made anew from the texts of the pair.
Because pairs are skipped only inside one component, components are exact.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reposcope.llm.common import (
    LOWER,
    NO_ID,
    UNBLANK,
    Spans,
    find_words,
    forget,
    keep_rows,
    keyed_text,
    passes,
    read,
    real_id,
    small_batches,
    text_buffers,
    with_fingerprint,
    word_hashes,
    written,
)
from reposcope.llm.components import components

#: Similarity from which documents are linked, in hundredths.
SIMILAR = 80
COORDINATES, MATCHES = 32, 14
#: Bits of the bitmap by which rows are chosen before their texts are dealt.
BITS = 1 << 21
#: Rounds in which the members of a posting meet only its pivot.
STAR_ROUNDS = 2
#: Nodes of a posting that are paired with each other; those of larger ones meet by their rarest shingles.
CROWD = 64
#: Longs of the parity bitmap of a set.
PARITY_WORDS = 16

_rng = np.random.default_rng(8)
_FACTORS = _rng.integers(0, 2**63, COORDINATES, np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _rng.integers(0, 2**63, COORDINATES, np.uint64)


def shingle_sets(data: np.ndarray, offs: np.ndarray, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a pass.

    A text of fewer words than `size` has its whole word sequence as the only
    shingle; a text without words has none.
    """
    data = LOWER[data]
    starts, ends, first = find_words(data, offs, UNBLANK)
    spans = Spans(word_hashes(data, starts, ends), size)
    at = np.arange(max(len(starts) - size + 1, 0))
    every = spans.of(at, at + size)
    sets = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= size:
            sets.append(np.unique(every[a : b - size + 1]))
        elif b > a:
            sets.append(spans.of(np.array([a]), np.array([b])))
        else:
            sets.append(every[:0])
    return sets


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of COORDINATES minima (32 bits) for each set that is not empty."""
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    begin = np.cumsum(sizes) - sizes
    out = np.empty((len(sets), COORDINATES), np.int32)
    for c in range(COORDINATES):
        least = np.minimum.reduceat(flat * _FACTORS[c] + _SHIFTS[c], begin)
        out[:, c] = (least >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return out


def document_signatures(rows: DataFrame, size: int) -> DataFrame:
    """(id, fp, n, digest, sig): size, digest and signature of each document's set; empty sets have no digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = text_buffers(batch.column(2))
            for a, b in passes(offs):
                sets = shingle_sets(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], size)
                full = [i for i, s in enumerate(sets) if len(s)]
                sig: list = [None] * len(sets)
                if full:
                    for i, row in zip(full, signatures([sets[i] for i in full])):
                        sig[i] = row
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        batch.column(1).slice(a, b - a),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.md5(s.tobytes()).digest() if len(s) else None for s in sets], pa.binary()),
                        pa.array(sig, pa.list_(pa.int32())),
                    ],
                    ["id", "fp", "n", "digest", "sig"],
                )

    return rows.select("id", "fp", "text").mapInArrow(run, "id long, fp long, n long, digest binary, sig array<int>")


def nodes_of(documents: DataFrame) -> DataFrame:
    """One row per different set: node (a number), id and fp of its smallest document, n, digest, sig."""
    rows = documents.filter("digest IS NOT NULL")
    found = rows.groupBy("digest").agg(F.min(F.struct("id", "fp")).alias("least"), F.any_value("n").alias("n"), F.any_value("sig").alias("sig"))
    return written(found.select(F.monotonically_increasing_id().alias("node"), "digest", "least.id", "least.fp", "n", "sig"))


def postings(nodes: DataFrame, similar: int) -> DataFrame:
    """(token, node, n, weight): the prefix of each node's signature, from its rarest values.

    weight adds up how often the node's values occur, which is most for the
    text that others were copied from.

    A set so small that only an equal one is similar is not posted. Spark sizes
    an exploded table like the one before it, so the counts of the values must
    not be broadcast by that size.
    """
    least = math.ceil(similar / (100 - similar))
    values = F.transform("sig", lambda v, c: F.shiftleft(c.cast("long"), 32).bitwiseOR(v.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))))
    tokens = nodes.filter(F.col("n") >= least).select("node", "n", F.explode(values).alias("token"))
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1").select(F.bitwise_not("token").alias("key"), "df")
    mine = (
        tokens.select("node", "n", F.bitwise_not("token").alias("key"))
        .join(shared.hint("merge"), "key")
        .groupBy("node")
        .agg(F.any_value("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", F.bitwise_not("key").alias("token")))).alias("tokens"))
        .filter(F.size("tokens") >= MATCHES)
    )
    prefix = F.slice("tokens", F.lit(1), F.size("tokens") - (MATCHES - 1))
    weight = F.aggregate("tokens", F.lit(0).cast("long"), lambda s, t: s + t["df"])
    return mine.select("node", "n", weight.alias("weight"), F.explode(prefix).alias("t")).select(F.col("t.token").alias("token"), "node", "n", "weight")


def _fits(similar: int) -> str:
    """SQL: sets of n and m shingles can be similar enough."""
    return f"least(n, m) * 100 >= greatest(n, m) * {similar}"


def relabelled(posted: DataFrame, moved: DataFrame) -> DataFrame:
    """`posted` with the labels that `moved` (node, label) gives, without postings of one component."""
    moved = moved.select(F.col("node").alias("label"), F.col("label").alias("new"))
    labelled = posted.join(moved, "label", "left").withColumn("label", F.coalesce("new", "label")).drop("new")
    mixed = labelled.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high")
    keyed = labelled.withColumn("key", F.bitwise_not("token")).join(mixed.select(F.bitwise_not("token").alias("key")), "key")
    return keyed.select("token", "node", "n", "weight", "label")


def pivot_pairs(posted: DataFrame, similar: int, order: list) -> DataFrame:
    """(a, b, la, lb): each posting's members with its pivot, the last in `order`, unless one component holds both."""
    pivot = F.max_by(F.struct("node", "n", "label"), F.struct(*order, F.col("node"))).alias("p")
    pivots = posted.groupBy("token").agg(pivot).select(F.bitwise_not("token").alias("key"), F.col("p.node").alias("a"), F.col("p.n").alias("m"), F.col("p.label").alias("la"))
    met = posted.withColumn("key", F.bitwise_not("token")).join(pivots, "key").filter(f"label <> la AND {_fits(similar)}")
    return met.select("a", F.col("node").alias("b"), "la", F.col("label").alias("lb")).distinct()


def shingle_rows(found: DataFrame, size: int) -> DataFrame:
    """(node, n, label, s): a row for each shingle of each text; `found` has node, label, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, label = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            data, offs = text_buffers(batch.column(2))
            for a, b in passes(offs):
                made = shingle_sets(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], size)
                sizes = np.array([len(s) for s in made])
                columns = [np.repeat(x, sizes) for x in (node[a:b], sizes, label[a:b])]
                yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), pa.array(np.concatenate(made).view(np.int64))], ["node", "n", "label", "s"])

    return found.select("node", "label", "text").mapInArrow(run, "node long, n long, label long, s long")


def _parity(s: Column) -> list[Column]:
    """PARITY_WORDS longs: a bit for each of 64 times as many classes of shingles, set if their number is odd."""
    bit, word = F.expr("shiftleft(1L, cast(s & 63 AS INT))"), F.shiftright(s, 6).bitwiseAND(F.lit(PARITY_WORDS - 1))
    return [F.coalesce(F.bit_xor(F.when(word == i, bit)), F.lit(0).cast("long")).alias(f"bits{i}") for i in range(PARITY_WORDS)]


def crossing_pairs(posted: DataFrame, nodes: DataFrame, rows: DataFrame, size: int, similar: int) -> DataFrame:
    """(a, b, la, lb): nodes of open postings, of different components, whose sets can be similar enough.

    The members of a posting of up to CROWD nodes are paired. A posting of
    boilerplate may hold very many nodes of which hardly two are similar, so
    those of a larger one are not paired but posted once more, under the rarest shingles of their full sets. Similar sets share one of the
    smaller set's n - ceil(2 s n / (1 + s)) + 1 rarest shingles, which is also
    among the n - ceil(s n) + 1 rarest of the larger set, and the first that
    they share leaves enough places behind it in both. A parity bitmap of each
    set bounds the overlap further: sets differ in at least as many shingles as
    their bitmaps differ in bits. Nothing is lost by these bounds.
    """
    crowds = posted.groupBy("token").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > CROWD).select(F.bitwise_not("token").alias("key"))
    keyed = written(posted.withColumn("key", F.bitwise_not("token")).join(crowds.withColumn("crowd", F.lit(True)), "key", "left"))
    small = keyed.filter("crowd IS NULL").select("key", F.col("node").alias("b"), F.col("n").alias("m"), F.col("label").alias("lb"))
    paired = keyed.filter("crowd IS NULL").select("key", F.col("node").alias("a"), "n", F.col("label").alias("la")).join(small, "key")
    paired = paired.filter(f"a < b AND la <> lb AND {_fits(similar)}").select("a", "b", "la", "lb").distinct()
    open_ = keyed.filter("crowd").groupBy("node").agg(F.any_value("label").alias("label"))
    docs = nodes.select("node", F.struct("id", "fp").alias("doc")).join(open_, "node")
    found = docs.join(texts_of(docs.select("doc"), rows), "doc")
    with small_batches(rows.sparkSession):
        made = written(shingle_rows(found, size))
    shared = made.groupBy("s").agg(F.count(F.lit(1)).alias("df")).filter("df > 1").select(F.bitwise_not("s").alias("key"), "df")
    mine = (
        made.withColumn("key", F.bitwise_not("s"))
        .join(shared, "key")
        .groupBy("node", "n", "label")
        .agg(F.sort_array(F.collect_list(F.struct("df", "s"))).alias("tokens"), *_parity(F.col("s")))
    )
    bits = [f"bits{i}" for i in range(PARITY_WORDS)]
    probe = F.col("n") - F.ceil(F.col("n") * similar / 100) + 1
    index = F.col("n") - F.ceil(F.col("n") * 2 * similar / (100 + similar)) + 1
    # shingles that no other node has come first in the order, they only take places
    alone = F.col("n") - F.size("tokens")
    placed = (
        mine.withColumn("alone", alone)
        .filter(F.col("alone") < probe)
        .select("node", "n", "label", "alone", *bits, index.alias("index"), F.posexplode(F.slice("tokens", F.lit(1), (probe - F.col("alone")).cast("int"))))
        .select("node", "n", "label", "alone", *bits, "index", F.col("col.s").alias("s"), (F.col("alone") + F.col("pos")).alias("place"))
    )
    posts = written(placed)
    mixed = posts.groupBy("s").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select(F.bitwise_not("s").alias("key"))
    live = written(posts.withColumn("key", F.bitwise_not("s")).join(mixed, "key").drop("s"))
    x = live.filter("place < index").select("key", F.col("node").alias("a"), F.col("n").alias("m"), F.col("label").alias("la"), F.col("place").alias("at"), F.col("alone").alias("ma"), *(F.col(c).alias(f"a_{c}") for c in bits))
    y = live.select("key", F.col("node").alias("b"), "n", F.col("label").alias("lb"), "place", F.col("alone").alias("na"), *bits)
    apart = " + ".join(["ma", "na", *(f"bit_count({c} ^ a_{c})" for c in bits)])
    first = f"la <> lb AND (m < n OR m = n AND a < b) AND m * 100 >= n * {similar} AND least(m - at, n - place) * {100 + similar} >= (m + n) * {similar}"
    fit = f"{first} AND (m + n - ({apart})) * {100 + similar} >= (m + n) * {2 * similar}"
    found = x.join(y, "key").filter(fit)
    ordered = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(F.col("a") < F.col("b"), F.col("la")).otherwise(F.col("lb")).alias("la"), F.when(F.col("a") < F.col("b"), F.col("lb")).otherwise(F.col("la")).alias("lb"))
    pairs = written(ordered.unionByName(paired).distinct())
    forget(made, posts, live, keyed)
    return pairs


def colliding(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """`pairs` with MATCHES or more collisions of their whole signatures, and the document (id, fp) of each side.

    Spark takes an array for one element, so the signatures must not be broadcast by its size either.
    """
    left = nodes.select(F.col("node").alias("a"), F.col("sig").alias("sa"), F.struct("id", "fp").alias("doc_a"))
    right = nodes.select(F.col("node").alias("b"), F.col("sig").alias("sb"), F.struct("id", "fp").alias("doc_b"))
    hits = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    found = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").withColumn("hits", hits)
    return found.filter(F.col("hits") >= MATCHES).select("a", "b", "la", "lb", "doc_a", "doc_b", "hits")


def likely_among(rows: DataFrame, needs: DataFrame) -> DataFrame:
    """Rows (id, fp, …) that may be in `needs`, by a bitmap of BITS bits; what it lets through wrongly is harmless.

    The bitmap has the same size whatever the number of rows, so it can be
    broadcast; with very many needs it is full and lets every row through.
    """
    at = F.pmod(F.xxhash64("id", "fp"), F.lit(BITS))
    bitmaps = needs.select((F.shiftright(at, 15)).alias("bucket"), at.bitwiseAND(F.lit(32767)).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bitmap"))
    placed = rows.withColumns({"bucket": F.shiftright(at, 15), "bit": at.bitwiseAND(F.lit(32767))})
    byte = F.conv(F.hex(F.expr("substring(bitmap, cast(bit div 8 AS INT) + 1, 1)")), 16, 10).cast("int")
    kept = placed.join(F.broadcast(bitmaps), "bucket").filter(F.getbit(byte, (F.col("bit") % 8).cast("int")) == 1)
    return kept.select(*rows.columns)


def texts_of(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(doc, text): the texts of documents (id, fp), each once however often its row repeats."""
    needs = docs.select("doc.*")
    found = likely_among(rows, needs).groupBy("id", "fp").agg(F.any_value("text").alias("text"))
    return found.select(F.struct("id", "fp").alias("doc"), "text")


def confirmed(pairs: DataFrame, rows: DataFrame, size: int, similar: int) -> DataFrame:
    """(a, b, la, lb, linked): whether the full shingle sets of each pair are similar enough.

    The texts of the compared documents are read again. The side that may be
    the pivot of many is keyed anew, so that Spark can split it.
    """
    texts = texts_of(pairs.select(F.explode(F.array("doc_a", "doc_b")).alias("doc")), rows)
    hub = pairs.select("a", "doc_a").distinct().join(texts.withColumnRenamed("doc", "doc_a"), "doc_a").select(F.bitwise_not("a").alias("key"), F.col("text").alias("ta"))
    member = pairs.join(texts.withColumnRenamed("doc", "doc_b"), "doc_b").select("a", "b", "la", "lb", F.bitwise_not("a").alias("key"), F.col("text").alias("tb"))
    both = member.join(hub, "key").select("a", "b", "la", "lb", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, x = None, np.zeros(0, np.uint64)  # rows of one hub follow each other
        for batch in batches:
            hubs = batch.column(0).to_numpy()
            left, right = text_buffers(batch.column(4)), text_buffers(batch.column(5))
            linked = []
            for lo, hi in passes(right[1]):
                made = shingle_sets(right[0][right[1][lo] : right[1][hi]], right[1][lo : hi + 1] - right[1][lo], size)
                for i, y in zip(range(lo, hi), made):
                    if hubs[i] != last:
                        part = left[0][left[1][i] : left[1][i + 1]]
                        last, x = hubs[i], shingle_sets(part, np.array([0, len(part)]), size)[0]
                    same = len(np.intersect1d(x, y, assume_unique=True))
                    linked.append(100 * same >= similar * (len(x) + len(y) - same))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(linked, pa.bool_())], ["a", "b", "la", "lb", "linked"])

    return both.mapInArrow(run, "a long, b long, la long, lb long, linked boolean")


def link_table(nodes: DataFrame, rows: DataFrame, size: int, similar: int) -> list[DataFrame]:
    """Tables (node, label), to be followed one after the other, that lead each node to its component of all links.

    In the first round each posting's pivot is its heaviest member, in the next
    ones a member in the order of a hash; a node is compared with the pivot of
    most collisions. At the end every candidate that still joins two components
    is compared, so none is left out. Each round works on the components of
    the one before, and deletes what that one has written.
    """
    posted = written(postings(nodes, similar).withColumn("label", F.col("node")))
    steps: list[DataFrame] = []
    failed = None
    for k in range(STAR_ROUNDS + 1):
        if k < STAR_ROUNDS:
            order = [F.col("weight")] if not k else [F.xxhash64("node", F.lit(k))]
            found = colliding(pivot_pairs(posted, similar, order), nodes)
            one = found.groupBy("b").agg(F.max_by(F.struct("a", "la", "lb", "doc_a", "doc_b"), F.struct("hits", "a")).alias("p"))
            chosen = one.select("b", "p.*")
        else:
            crossing = crossing_pairs(posted, nodes, rows, size, similar)
            chosen = colliding(crossing, nodes)
        if failed is not None:
            chosen = chosen.join(failed, ["a", "b"], "left_anti")
        chosen = written(chosen)
        with small_batches(rows.sparkSession):
            checked = written(confirmed(chosen, rows, size, similar))
        forget(chosen)
        if k == STAR_ROUNDS:
            forget(crossing)
        moved = components(checked.filter("linked"), "la", "lb")
        steps.append(moved)
        if k < STAR_ROUNDS:
            before, posted = posted, written(relabelled(posted, moved))
            forget(before)
            apart = checked.filter("NOT linked").select("a", "b")
            failed = apart if failed is None else failed.unionByName(apart)
            if posted.isEmpty():
                break
    forget(posted)
    return steps


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similar: int = SIMILAR) -> DataFrame:
    """Per input row: doc_id, n_shingles, component_id, kept; and the row's
    key (id, fp) and whether it is the first row of its component (first).

    Sets are the distinct shingles of `shingle` words, A to Z lower-cased.
    Documents are linked if 100 * intersection >= `similar` * union. Null and
    empty texts have no shingles and are linked with nothing. A null id counts
    as the largest; a component of only such rows has a null component_id and
    its rows are kept. Rows that repeat an id and a text get equal results. An
    empty table gives no rows.
    """
    rows = with_fingerprint(keyed_text(docs, id_col, text_col))
    with small_batches(rows.sparkSession):
        documents = written(document_signatures(rows, shingle))
    nodes = nodes_of(documents)
    named = nodes.select("digest", F.col("node").alias("label"), "id", F.col("fp").alias("print"))
    for step in link_table(nodes, rows, shingle, similar):
        step = step.select(F.col("node").alias("old"), F.col("label").alias("new"))
        named = named.join(step, named["label"] == step["old"], "left").withColumn("label", F.coalesce("new", "label")).drop("old", "new")
    least = named.groupBy("label").agg(F.min(F.struct("id", "print")).alias("component"))
    found = named.withColumn("key", F.bitwise_not("label")).join(least.select(F.bitwise_not("label").alias("key"), "component"), "key").select("digest", "component")
    out = documents.drop("sig").join(found, "digest", "left")
    out = out.withColumn("print", F.coalesce("component.print", "fp")).withColumn("component", F.coalesce("component.id", "id"))
    return out.select(
        real_id("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        real_id("component").alias("component_id"),
        (F.col("id") == F.col("component")).alias("kept"),
        "id",
        "fp",
        (F.col("fp") == F.col("print")).alias("first"),
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similar: int = SIMILAR) -> DataFrame:
    """The input's columns and rows with one document of each group of near copies, that of the smallest id.

    Documents without words stay, but rows that repeat both id and text are
    reduced to one. Rows of one id and different texts of one group leave one.
    """
    stay = near_groups(docs, id_col, text_col, shingle, similar).filter("kept AND first").groupBy("id", "fp").agg(F.count(F.lit(1)).alias("times"))
    key = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID))
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return keep_rows(docs, {"id": key, "fp": F.xxhash64(text)}, stay)


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(read(spark, sf_dir, "documents"), shingle=2).drop("id", "fp", "first")


OP8_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 1], ' ') AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 1, 1))) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 80 * (na.n + nb.n - k)
), both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM d
  UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, r.component_id, d.doc_id = r.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) r USING (doc_id)
"""
