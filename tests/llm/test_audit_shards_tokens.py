"""Filter audit, sharding and token alignment against plain versions over small tables."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from reposcope.llm import filter_audit, sharding, token_alignment
from reposcope.llm.bpe import tokenizer_path

WIDE = "doc_id long, text string, lang string, source string, id string, part string, n string, mask string, sha string, at string, piece string, row string, pairs string, size string, shard string"


def table(spark, rows):
    """A documents table of (doc_id, text, lang, source) with columns that clash with inner names."""
    return spark.createDataFrame([(*r, *["x"] * 11) for r in rows], WIDE)


# --- filter audit -------------------------------------------------------------------


def failing(rows):
    first = {}
    for i, text, _, _ in rows:
        key = 2**63 - 1 if i is None else i
        first[text or ""] = min(first.get(text or "", key), key)
    out = []
    for i, text, lang, _ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        bad = "A" if len(words) < 200 else ""
        bad += "B" if 100 * len(set(words)) < 50 * len(words) else ""
        bad += "C" if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text) else ""
        bad += "D" if re.search("[#$%&*|]", text) else ""
        bad += "E" if (2**63 - 1 if i is None else i) > first[text] else ""
        out.append((i, lang or "", bad))
    return out


def slow_audit(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    docs, out = failing(rows), {}
    for part in {p for _, p, _ in docs}:
        mine = [(i, bad) for i, p, bad in docs if p == part]
        shapley = Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = list(mine)
            for step, f in enumerate(order, 1):
                gone, left = [d for d in left if f in d[1]], [d for d in left if f not in d[1]]
                earlier = sum(1 for _, bad in mine if f in bad) - len(gone)
                shapley[f] += len(gone)
                out[part, order, step] = [len(left), len(gone), earlier, sum(1 for _, bad in mine if bad == f), sum(1 for i, _ in gone if i in good), sum(1 for i, _ in gone if i in toxic)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def audit_rows(df):
    return {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]) for r in df.collect()}


def some_documents(seed=3, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)] + ["BIG", "a#b", "é", "ß"]
    rows = []
    for i in range(n):
        few = rng.random() < 0.4
        words = [rng.choice(vocabulary[:20] if few else vocabulary[: rng.choice([400, 404])]) for _ in range(rng.choice([0, 5, 199, 200, 260]))]
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(words), rng.choice(["en", "fr", "", None]), rng.choice(["s1", "s2"])))
    rows += [(100 + i, rows[i][1], "de", "s1") for i in range(0, n, 3)] + [(None, rows[0][1], "en", "s1"), (None, None, "en", None), (200, None, None, None), (201, "", "en", "s"), rows[4], rows[4]]
    return rows


def test_audit_equals_applying_every_order(spark):
    rows = some_documents()
    labels = [(i, i % 2, i % 3 % 2) for i in range(0, 140, 2)] + [(4, 0, 1), (None, 1, 1), (300, 1, 1), (6, None, None)]
    label_table = spark.createDataFrame([(*x, "x") for x in labels], "doc_id long, quality int, toxic int, id string")
    got = audit_rows(filter_audit.filter_audit(table(spark, rows), label_table))
    assert got == slow_audit(rows, [x for x in labels if x[0] is not None])
    assert len(got) == 600 * len({r[2] or "" for r in rows})


def test_audit_of_nothing_and_of_one_text(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.filter_audit(table(spark, []), none).count() == 0
    rows = [(i, "UP " * 300_000, "en", "s") for i in range(5)]
    assert audit_rows(filter_audit.filter_audit(table(spark, rows), none)) == slow_audit(rows, [])


def test_min_plus_product_and_other_filters(spark):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 50, (7, 4)), rng.integers(0, 50, (4, 9))
    assert (filter_audit.min_plus(a, b) == (a[:, :, None] + b[None]).min(axis=1)).all()
    orders = np.array(list(itertools.permutations(range(3))))
    rank = filter_audit.removal_steps(orders)
    for mask, (j, order) in itertools.product(range(8), enumerate(orders.tolist())):
        hits = [s for s, f in enumerate(order) if mask >> f & 1]
        assert rank[mask, j] == (hits[0] if hits else filter_audit.INF)
    sets = spark.createDataFrame([("p", 1, 5, 1, 0), ("p", 3, 2, 0, 2), ("p", 3, 1, 0, 0), (None, 0, 4, 4, 4)], "part string, mask int, n long, good long, toxic long")
    got = audit_rows(filter_audit.audited(sets, ["X", "Y"]))
    assert got["p", "XY", 1] == (0, 8, 0, 5, 1, 2, 13) and got["p", "XY", 2] == (0, 0, 3, 0, 0, 0, 3)
    assert got["p", "YX", 1] == (5, 3, 0, 0, 0, 2, 3) and got["", "XY", 2] == (4, 0, 0, 0, 0, 0, 0)
    with pytest.raises(ValueError):
        filter_audit.audited(sets, list("ABCDEFGH"))


def test_own_filters(spark):
    own = lambda text: {"long": F.length(text) > 3, "x": text.contains("x")}
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    got = audit_rows(filter_audit.filter_audit(table(spark, [(1, "xxxx", "e", "s"), (2, "x", "e", "s"), (3, "x", "e", "s")]), labels, own, copies="copy"))
    assert len(got) == 18 and got["e", "longxcopy", 1][:2] == (2, 1) and got["e", "copylongx", 1][:2] == (2, 1) and got["e", "xlongcopy", 1][4] == 1


# --- sharding -------------------------------------------------------------------------


def slow_shards(rows, shards, seed):
    strata = defaultdict(list)
    for i, text, _, source in rows:
        raw = (text or "").encode()
        key, crc = 2**63 - 1 if i is None else i, zlib.crc32(raw)
        draw = hashlib.md5(f"{seed}:{key}:{crc}:{len(raw) + 8}".encode()).hexdigest()
        strata["" if source is None else "=" + source].append((draw, key, i, len(raw) + 8, crc))
    line = []
    for stratum, members in strata.items():
        for rank, (_, _, i, size, crc) in enumerate(sorted(members, key=lambda m: m[:2])):
            line.append((Fraction(2 * rank + 1, 2 * len(members)), stratum, rank, i, size, crc))
    line.sort(key=lambda x: x[:3])
    out, used = [], Counter()
    for position, (_, stratum, _, i, size, crc) in enumerate(line):
        shard = position * shards // len(line)
        out.append((i, stratum[1:] if stratum else None, size, crc, shard, used[shard]))
        used[shard] += 1
    return out


def shard_rows(df):
    return sorted(map(str, ((r["doc_id"], r["source"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in df.collect())))


@pytest.mark.parametrize("shards", [1, 5, 24])
def test_shards_equal_a_plain_version(spark, shards):
    rng = random.Random(shards)
    rows = [(i, "é" * rng.randrange(9), None, rng.choice(["big"] * 8 + ["a", "b", "", None])) for i in range(150)]
    rows += [(None, None, None, "big")] * 20 + [rows[7]] * 30 + [(900, "long" * 100_000, None, "one")]
    got = shard_rows(sharding.interleaved(table(spark, rows), shards, seed=7))
    assert got == sorted(map(str, slow_shards(rows, shards, 7)))


def test_shards_match_the_mixture(spark):
    rows = [(i, "t", None, f"s{min(i % 10, 4)}") for i in range(600)]
    counts = Counter((r["shard"], r["source"]) for r in sharding.interleaved(table(spark, rows), 24).collect())
    assert all(counts[k, s] in ((2, 3) if s != "s4" else (14, 15, 16)) for k in range(24) for s in ("s0", "s1", "s2", "s3", "s4"))
    other = sharding.interleaved(table(spark, rows), 24, seed=1).filter("shard = 0").select("doc_id")
    assert other.subtract(sharding.interleaved(table(spark, rows), 24, seed=2).filter("shard = 0").select("doc_id")).count() > 5


def test_few_rows_and_none(spark):
    assert sharding.interleaved(table(spark, [])).count() == 0
    got = sharding.interleaved(table(spark, [(1, "a", None, "s"), (2, "b", None, "s")]), 24).collect()
    assert sorted((r["shard"], r["slot"]) for r in got) == [(0, 0), (12, 0)]


# --- token alignment --------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(tokenizer_path())
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))


def slow_tokens(tokenizers, text):
    """((id, first byte, byte after) of each token) of both, or none."""
    a, b = tokenizers
    want = (" " + text).encode()
    back = {s: i for i, s in enumerate(token_alignment.Merges(tokenizer_path()).of_byte)}
    assert len(back) == 256
    decode = {c: k for k, c in enumerate(__import__("reposcope.llm.bpe", fromlist=["x"]).byte_symbols())}
    pieces_a = [(i, bytes(decode[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    pieces_b = []
    for i in b.encode(text):
        p = b.id_to_piece(i)
        pieces_b.append((i, bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()))
    if not text or any(b"".join(p for _, p in x) != want for x in (pieces_a, pieces_b)):
        return [], []
    out = []
    for pieces in (pieces_a, pieces_b):
        at, spans = 0, []
        for i, p in pieces:
            spans.append((i, at, at + len(p)))
            at += len(p)
        out.append(spans)
    return tuple(out)


def slow_alignment(tokenizers, rows):
    docs = []
    for i, text, *_ in rows:
        a, b = slow_tokens(tokenizers, text or "")
        links = [(x[0], y[0]) for x in a for y in b if max(x[1], y[1]) < min(x[2], y[2])]
        cuts = sorted({x[2] for x in a} & {y[2] for y in b})
        groups, low = [], 0
        for c in cuts:
            inside = [[str(t[0]) for t in side if low <= t[1] and t[2] <= c] for side in (a, b)]
            groups.append(inside)
            low = c
        listed = ";".join(",".join(x) + "|" + ",".join(y) for x, y in groups)
        shared = sum(len(x) * len(y) for x, y in groups)
        docs.append((i, len(a), len(b), len(groups), links, shared, hashlib.sha256(listed.encode()).hexdigest() if a else ""))
    counts = Counter(p for d in docs for p in set(d[4]))
    most = defaultdict(int)
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    return [(i, n_a, n_b, g, len(links), sum(1 for p in links if counts[p] == most[p[0]]), sum(counts[p] for p in links), shared, sha) for i, n_a, n_b, g, links, shared, sha in docs]


TEXTS = [
    "Hello world, hello  worlds!", "the the the thethe", " leading and trailing ", "naïve café déjà-vu — “quotes”", "日本語のテキスト と 한국어", "emoji 👩‍👩‍👧‍👦 and 🇩🇪",
    "<|endoftext|> is text, <0x41> </s> <s> <unk> too", "tab\tand\nnewline\r\n\x00end", "U+2581 ▁ loses", "12345678901234567890 3.14159", "", None, "a", "\n", "x" * 3000, "aé" * 500,
    "Ünïcödé zalgo Z̸̛͔a̴l̸g̵o̸", "def f(x):\n    return x**2  # code\n", "the the the thethe", "ﬁ ligature ½ ²",
]


@pytest.mark.parametrize("frequent", [1, 20, 1 << 16])
def test_alignment_equals_a_plain_version(spark, tokenizers, frequent):
    rows = [(i, t, None, None) for i, t in enumerate(TEXTS)] + [(None, "Hello no id", None, None), (3, TEXTS[3], None, None), (5, "another text of five", None, None)]
    out = token_alignment.token_alignment(table(spark, rows), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"), frequent=frequent)
    got = [tuple(r) for r in out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "n_shared", "groups_sha256").collect()]
    assert sorted(map(str, got)) == sorted(map(str, slow_alignment(tokenizers, rows)))


def test_alignment_of_none_and_of_long_texts(spark, tokenizers):
    paths = tokenizer_path(), tokenizer_path("piece_bpe_32k.model")
    assert token_alignment.token_alignment(table(spark, []), *paths).count() == 0
    assert token_alignment.token_alignment(table(spark, [(1, None, None, None), (2, "", None, None)]), *paths).filter("n_a + n_b + n_links + count_sum = 0 and groups_sha256 = ''").count() == 2
    rng = random.Random(5)
    long_text = " ".join("".join(rng.choice("abcdeé ß\n") for _ in range(rng.randrange(1, 12))) for _ in range(100_000))
    row = token_alignment.token_alignment(table(spark, [(1, long_text, None, None)]), *paths).collect()[0]
    a, b = slow_tokens(tokenizers, long_text)
    ends_a, ends_b = {x[2] for x in a}, {x[2] for x in b}
    assert (row["n_a"], row["n_b"], row["n_groups"], row["n_links"]) == (len(a), len(b), len(ends_a & ends_b), len(ends_a | ends_b))
    assert row["n_best"] == row["n_links"] == row["count_sum"]


def dense(m):
    out = np.zeros((m.n_rows, m.n_cols), np.int64)
    out[m.rows(), m.indices] = m.values
    return out


@pytest.mark.parametrize("step", [1, 7, 1 << 19])
def test_sparse_products(monkeypatch, step):
    monkeypatch.setattr(token_alignment, "STEP", step)
    rng = np.random.default_rng(step)
    for shape in [(5, 6, 7), (1, 1, 1), (8, 3, 8), (4, 0, 4), (0, 3, 2)]:
        a, b = (rng.integers(0, 3, s) * (rng.random(s) < 0.5) for s in ((shape[0], shape[1]), (shape[1], shape[2])))
        made = [token_alignment.CSR(np.concatenate([[0], np.cumsum((m != 0).sum(axis=1))]).astype(np.int64), np.nonzero(m)[1], m[m != 0], m.shape[1]) for m in (a, b)]
        assert (dense(made[0].dot(made[1])) == a @ b).all()
        assert (dense(made[0].transposed()) == a.T).all()
    al = token_alignment.Alignment.of(np.array([2, 1, 1, 3]), np.array([1, 2, 1, 3]))
    assert dense(al.overlaps()).tolist() == [[1, 1, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 3]]
    shared = np.concatenate([dense(m) for m in al.shared_groups()])
    assert shared.tolist() == [[1, 1, 0, 0], [1, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1]] and al.shared_pairs().tolist() == [4, 1, 1]
