"""Exact, substring, line and near dedup against brute force on small fixtures."""

import hashlib
import random
import re

import pytest

from reposcope.llm import exact_dedup, line_dedup, minhash_dedup, substring_dedup
from reposcope.llm.components import components

BLANK = re.compile(r"[\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def words_of(text):
    return [w for w in BLANK.split(text or "") if w]


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def corpus(seed=1):
    rng = random.Random(seed)
    base = [prose(rng, rng.choice([5, 40, 60, 120, 300])) for _ in range(25)]
    rows = list(enumerate(base))
    passage = prose(rng, 70)
    for i in range(25, 45):
        words = base[rng.randrange(25)].split()
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = "edit"
        if i % 3 == 0:
            words[1:1] = passage.split()
        rows.append((i, " ".join(words)))
    line = "This very line is long enough to be counted, surely."
    rows += [(50 + i, f"start {i}\n  {line.upper() if i % 2 else line}\t\nend\n{line}") for i in range(6)]
    rows += [(60, None), (61, ""), (62, " \t\n "), (63, "é  ü\n日本"), (64, "é ü 日本"), (65, "one"), (66, "One"), (67, "x " * 3000)]
    return rows


EDGE_ROWS = [(None, "a b"), (None, "a b"), (7, "a  b"), (7, "a  b"), (7, "other"), (8, None)]


def expected_exact(rows):
    key = [BLANK.sub(" ", t or "") for _, t in rows]
    out = []
    for (i, _), k in zip(rows, key):
        ids = [j for (j, _), other in zip(rows, key) if other == k]
        least = min((j for j in ids if j is not None), default=None)
        out.append((i, least, len(ids), i == least, sha(k)))
    return out


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.parametrize("rows", [corpus(), EDGE_ROWS, []])
@pytest.mark.parametrize("extra", [False, True])
def test_exact_groups(documents, rows, extra):
    got = exact_dedup.exact_groups(documents(rows, extra)).collect()
    assert ordered(got) == ordered(expected_exact(rows))


def test_merge_of_many_runs(spark):
    rows = spark.range(0, 500, 1, 20).selectExpr("cast(id % 37 as string) AS sha", "id % 37 AS proof", "id")
    got = exact_dedup.merge_runs(rows, runs=16).collect()
    assert ordered((r["sha"], r["keep"], r["n"]) for r in got) == ordered((str(k), k, len(range(k, 500, 37))) for k in range(37))


def test_drop_copies_keeps_columns_and_one_of_repeats(documents):
    got = exact_dedup.drop_copies(documents(EDGE_ROWS, True))
    assert got.columns == documents(EDGE_ROWS, True).columns
    assert ordered((r["doc_id"], r["text"]) for r in got.collect()) == ordered([(7, "a  b"), (7, "other"), (8, None)])


def expected_substring(rows, window):
    words = [words_of(t) for _, t in rows]
    rank = [2**62 if i is None else i for i, _ in rows]
    first = {}
    for r, w in zip(rank, words):
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            first[k] = min(first.get(k, r), r)
    out = []
    for (i, _), r, w in zip(rows, rank, words):
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < r:
                gone.update(range(s, s + window))
        out.append((i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return out


@pytest.mark.parametrize("rows", [corpus(1), corpus(2), []])
@pytest.mark.parametrize(("window", "k"), [(50, 12), (20, 5)])
def test_substring(documents, rows, window, k):
    got = substring_dedup.dedup_substrings(documents(rows, True), window=window, k=k, with_text=False).collect()
    assert ordered(got) == ordered(expected_substring(rows, window))


def test_substring_repeated_and_null_ids(documents):
    text = prose(random.Random(3), 60)
    rows = [(4, text), (4, text), (4, "x " + text), (None, text), (None, text), (9, f"{text} tail"), (1, "few words"), (2, "a " * 200), (3, "a " * 150)]
    got = substring_dedup.dedup_substrings(documents(rows)).collect()
    assert ordered(r[:4] for r in got) == ordered(expected_substring(rows, 50))
    assert {r["kept_text"] for r in got if r["doc_id"] == 9} == {"tail"}


def expected_lines(rows, chars=40, docs=5):
    def key(line):
        return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\f\r"))

    seen = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            seen.setdefault(key(line), set()).add(2**62 if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        own = 2**62 if i is None else i
        kept = [x for x in lines if len(key(x)) < chars or len(seen[key(x)]) < docs or max(seen[key(x)]) == own]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("rows", [corpus(), []])
@pytest.mark.parametrize("batches", [1, 7])
def test_lines(documents, rows, batches):
    rows = rows + [(None, rows[-10][1]), (50, rows[-12][1])] if rows else rows
    got = line_dedup.dedup_lines(documents(rows, True), batches=batches).collect()
    assert ordered(got) == ordered(expected_lines(rows))


def shingles(text, n):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words_of(text)]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if len(words) >= n else frozenset([tuple(words)])


def expected_near(rows, n, similar=80):
    sets = [shingles(t, n) for _, t in rows]
    group = list(range(len(rows)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= similar * (len(sets[a]) + len(sets[b]) - both):
                group[root(a)] = root(b)
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(k) and rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((i, len(sets[k]), least, i == least))
    return out


@pytest.mark.parametrize("n", [2, 5])
def test_near_groups(documents, n):
    rows = corpus(4) + [(70 + i, prose(random.Random(9), 80) + f" t{i} u{i // 2} v{i // 3}" + " z" * i) for i in range(12)]
    got = minhash_dedup.near_groups(documents(rows, True), shingle=n).collect()
    assert ordered(r[:4] for r in got) == ordered(expected_near(rows, n))


def test_near_chain_is_one_component(documents):
    words = [f"w{i}" for i in range(100)]
    rows = []
    for step in range(8):
        changed = [f"x{j}" if j < 4 * step else w for j, w in enumerate(words)]
        rows.append((step, " ".join(changed)))
    got = minhash_dedup.near_groups(documents(rows), shingle=2).collect()
    assert ordered(r[:4] for r in got) == ordered(expected_near(rows, 2))
    assert {r["component_id"] for r in got} == {0}


def test_near_edges(documents):
    rows = [(None, "a b c"), (5, "A b  c"), (5, "A b  c"), (5, "q"), (6, ""), (6, None), (3, "Q")]
    got = minhash_dedup.near_groups(documents(rows), shingle=2).collect()
    assert ordered(r[:4] for r in got) == ordered(
        [(None, 2, 5, False), (5, 2, 5, True), (5, 2, 5, True), (5, 1, 3, False), (6, 0, 6, True), (6, 0, 6, True), (3, 1, 3, True)]
    )
    kept = minhash_dedup.drop_near_copies(documents(rows, True), shingle=2)
    assert ordered((r["doc_id"], r["text"] or "") for r in kept.collect()) == ordered([(5, "A b  c"), (3, "Q"), (6, "")])
    assert minhash_dedup.near_groups(documents([])).count() == 0


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 20)] + [(30, 31), (40, 40), (None, 3)], "a long, b long")
    got = {r["node"]: r["label"] for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(21)}, 30: 30, 31: 30}


def thue_morse(a, b, n=1024):
    """Two different words that collide in every polynomial hash modulo a power of two."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join((a, b)[k] for k in bits), "".join((b, a)[k] for k in bits)


def test_contrived_words_do_not_collide(documents):
    x, y = thue_morse("a", "b")
    rows = [(1, f"{x} " * 60), (2, f"{y} " * 60), (3, " ".join(f"{x} p{i}" for i in range(30))), (4, " ".join(f"{y} p{i}" for i in range(30)))]
    long_a, long_b = thue_morse("left", "right")
    rows += [(5, long_a.replace("left", "left ").replace("right", "right ")), (6, long_b.replace("left", "left ").replace("right", "right "))]
    got = substring_dedup.dedup_substrings(documents(rows), with_text=False).collect()
    assert ordered(got) == ordered(expected_substring(rows, 50))
    near = minhash_dedup.near_groups(documents(rows), shingle=2).collect()
    assert ordered(r[:4] for r in near) == ordered(expected_near(rows, 2))


def test_very_long_texts(documents):
    rng = random.Random(11)
    text = prose(rng, 30_000, 5000)
    rows = [(1, text), (2, f"start {text} end"), (3, "y" * 200_000), (4, f"{'y' * 200_000} z"), (5, text[:90_000]), (6, "\n".join([text[:60]] * 4000))]
    rows += [(10 + i, f"{text[:60]}\n{i}") for i in range(5)]
    assert ordered(exact_dedup.exact_groups(documents(rows)).collect()) == ordered(expected_exact(rows))
    assert ordered(substring_dedup.dedup_substrings(documents(rows), with_text=False).collect()) == ordered(expected_substring(rows, 50))
    assert ordered(line_dedup.dedup_lines(documents(rows)).collect()) == ordered(expected_lines(rows))
    assert ordered(r[:4] for r in minhash_dedup.near_groups(documents(rows)).collect()) == ordered(expected_near(rows, 5))


def test_paths_have_source_coordinates(documents):
    """A passage is one path of its source document, and a run of it in a copy leads to the words there."""
    from reposcope.llm.common import keyed_text
    from pyspark.sql import functions as F

    rng = random.Random(5)
    passage = prose(rng, 300, 10**6).split()
    rows = [(3, " ".join(["s"] * 7 + passage)), (8, " ".join(prose(rng, 40, 10**6).split() + passage + ["t"])), (9, prose(rng, 200, 10**6))]
    table = keyed_text(documents(rows)).select("id", F.hash("text").alias("fp"), "text")
    found = substring_dedup.edge_table(table, 50, 12)
    runs = [r for r in substring_dedup.path_runs(found, 50, 12).collect() if r["id"] == 8]
    assert {(r["sid"], r["shift"]) for r in runs} == {(3, 7 - 40)}
    assert max(r["last"] - r["first"] for r in runs) > 150
    edges = substring_dedup.path_edges(found, 12).filter("sid = 3").select("begin", "end").distinct().collect()
    assert len(edges) < len(found.filter("id = 3").collect()) / 2


def test_levelled_runs_hold_each_hash_once(spark):
    index = line_dedup.LevelledRuns(fan_in=3)
    total = {}
    for k in range(8):
        rows = [(h, -h, 1 + h % 3, 100 * k + h) for h in range(k, 3 * k + 4)]
        for h, _, n, last in rows:
            old = total.get(h, (0, 0))
            total[h] = (old[0] + n, max(old[1], last))
        index.add(spark.createDataFrame(rows, "h1 long, h2 long, n long, last long"))
        held = [r["h1"] for run in index.runs() for r in run.collect()]
        assert sorted(held) == sorted(total), "a hash lies in one run only"
    assert len(index.runs()) <= 4
    assert {r["h1"]: (r["n"], r["last"]) for r in index.entries().collect()} == total


def test_rounds_merge_by_stride(spark):
    rows = spark.range(0, 64, 1, 8).selectExpr("cast(id % 5 as string) AS sha", "id % 5 AS proof", "id")
    level = exact_dedup.sorted_runs(rows, 8)
    assert {r["run"] for r in level.collect()} == set(range(8))
    for stride, left in ((1, {0, 2, 4, 6}), (2, {0, 4}), (4, {0})):
        level = exact_dedup.merge_pairs(level, stride)
        assert {r["run"] for r in level.collect()} == left
    assert ordered((r["sha"], r["keep"], r["n"]) for r in level.collect()) == ordered((str(k), k, len(range(k, 64, 5))) for k in range(5))
    other = rows.withColumn("proof", rows["id"])  # equal digests of different texts stay apart
    assert exact_dedup.merge_runs(other, 8).count() == 64


def near_family():
    """A template with many members of which hardly two are similar enough, and some that are."""
    rng = random.Random(12)
    base = prose(rng, 100, 10**6).split()
    rows = []
    for i in range(120):
        words = list(base)
        for j in rng.sample(range(100), 12 if i % 10 else 3):
            words[j] = f"e{i}x{j}" if i % 7 else f"e{j}"
        rows.append((i, " ".join(words)))
    return rows


def test_near_family_with_common_template(documents):
    rows = near_family()
    got = minhash_dedup.near_groups(documents(rows), shingle=2).collect()
    assert ordered(r[:4] for r in got) == ordered(expected_near(rows, 2))
