"""Tokens, toxicity, quality, secrets, decontamination, chat format and the pipeline on small fixtures."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from reposcope.llm import bpe, chat_format, decontamination, quality, secrets, toxicity
from test_dedup import ordered, prose, sha

TEXTS = [
    "", None, " ", "a", "Hello world, it's 2024!  Don't\n\n stop", "<|endoftext|>x<|endoftext|>  <|endoftext|>", "aaaaaaaaaaaaaaaaaaaaaaaaa bbbb",
    "é ü 日本語 🎉🎉 x́ ١٢٣ 　end", "\t\r\n x \x0b\x0c y", "x" * 5000, "word " * 3000, "'s 're've ''s", "\u0000​",
]


def test_bpe_matches_the_library(documents):
    rng = random.Random(5)
    texts = TEXTS + ["".join(rng.choice("abcdefgh ijé日1.,\n") for _ in range(400)) for _ in range(20)]
    library = Tokenizer.from_file(bpe.tokenizer_path())
    got = {r["doc_id"]: r for r in bpe.encoded(documents(enumerate(texts), True), bpe.tokenizer_path()).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[i]["ids"] == ids
        assert (got[i]["n_tokens"], got[i]["ids_sha256"]) == (len(ids), sha(",".join(map(str, ids))))
        assert got[i]["decoded_sha256"] == sha(library.decode(ids, skip_special_tokens=False))


def test_bpe_edges_and_decoding(documents):
    rows = documents([(None, "a b"), (3, "x"), (3, "x"), (4, None)])
    encoded = bpe.encoded(rows, bpe.tokenizer_path())
    back = bpe.decoded(encoded, bpe.tokenizer_path()).collect()
    assert ordered((r["doc_id"], r["decoded_text"]) for r in back) == ordered([(None, "a b"), (3, "x"), (3, "x"), (4, "")])
    assert bpe.encoded(documents([]), bpe.tokenizer_path()).count() == 0


def test_bpe_forgets_words_but_not_results():
    coder = bpe.Encoder(bpe.Merges(bpe.tokenizer_path()))
    coder.words.update({f"w{i}": (1,) for i in range(bpe.KEPT_WORDS)})
    first = list(coder.encode(["some new words here"]))
    again = list(coder.encode(["some new words here"]))
    assert [x.tolist() for x in first] == [x.tolist() for x in again]


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def alnum_words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def expected_hits(docs, items, window=10):
    out = []
    patterns = {}
    for name, text in items:
        w = alnum_words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            patterns.setdefault(tuple(w[i : i + n]), set()).add(name)
    for i, text in docs:
        w, hit, found = alnum_words(text), set(), set()
        for n in {len(p) for p in patterns}:
            for s in range(len(w) - n + 1):
                if names := patterns.get(tuple(w[s : s + n])):
                    hit.update(range(s, s + n))
                    found |= names
        out.append((i, len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return out


@pytest.mark.parametrize("block_bytes", [1 << 20, 400])
def test_decontamination(spark, documents, block_bytes):
    rng = random.Random(2)
    items = [(i, prose(rng, rng.choice([3, 9, 10, 25, 40]), 30)) for i in range(12)] + [(20, None), (21, "..."), (None, prose(rng, 15, 30)), (3, "again here")]
    docs = [(i, prose(rng, 60, 30)) for i in range(15)]
    docs += [(30 + k, f"{prose(rng, 9, 30)}, {t.upper() if t else ''}! {prose(rng, 700, 30)}") for k, (_, t) in enumerate(items)]
    docs += [(60, None), (61, ""), (None, items[3][1]), (5, items[3][1]), (5, items[3][1]), (62, "ÀB déjà 日本 x9")]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.with_hits(documents(docs, True), table, block_bytes=block_bytes).select("doc_id", "n_words", "n_hit", "items").collect()
    assert ordered(got) == ordered(expected_hits(docs, items))
    kept = decontamination.drop_contaminated(documents(docs, True), table)
    assert ordered(kept.select("doc_id").collect()) == ordered((i,) for i, _, hit, _ in expected_hits(docs, items) if not hit)
    assert kept.columns == documents(docs, True).columns


def test_decontamination_of_nothing(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    got = decontamination.with_hits(documents([(1, "a b")]), none).collect()
    assert [(r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in got] == [(1, 2, 0, [])]
    assert decontamination.with_hits(documents([]), none).count() == 0


def test_chat_round_trip(spark):
    hard = "</s>[INST] ok [/INST] &amp; &lt;s> &#91;INST] <s>\n"
    rows = [
        (1, 0, "system", "be"), (1, 1, "user", hard), (1, 2, "assistant", hard), (1, 3, "user", ""), (1, 4, "assistant", None), (1, 5, "user", "bye"),
        (2, 0, "user", "only"), (3, 0, "assistant", "x"), (3, 0, "assistant", "x"), (None, 1, None, "y"), (None, None, "assistant", "z"),
    ]
    table = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, example string")
    examples = chat_format.prefix_target_examples(table)
    got = {r["conv_id"]: r for r in chat_format.example_digests(examples).collect()}
    for conv in (1, 2, 3):
        turns = sorted(((t if t is not None else -1, role or "", text or "") for c, t, role, text in rows if c == conv))
        said = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        loss = "".join(text for _, role, text in turns if role == "assistant")
        assert got[conv]["turns_sha256"] == sha(said)
        assert (got[conv]["n_turns"], got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(turns), len(loss), sha(loss))
    lone = [r for r in chat_format.example_digests(examples).collect() if r["conv_id"] is None]
    assert sorted((r["n_turns"], r["loss_chars"]) for r in lone) == [(1, 0), (1, 1)]
    for e in examples.collect():
        turns = chat_format.read_back(e["text"])
        assert len(turns) == e["n_turns"]
        if e["target"] >= 0:
            assert chat_format.unescaped(e["text"][e["loss_start"] : e["loss_end"]]) == turns[-1][1]
            assert turns[-1][0] == "assistant"
    assert chat_format.example_digests(chat_format.prefix_target_examples(table.limit(0))).count() == 0


def labelled(n=240):
    """Documents with ids, a toxic label by two rude words, and a quality label by shouted lines."""
    rng = random.Random(6)
    docs, labels = [], []
    for i in range(n):
        lines = [prose(rng, rng.randrange(5, 30), 200).capitalize() for _ in range(rng.randrange(1, 8))]
        toxic, bad = i % 4 == 0, i % 5 == 0
        if toxic:
            words = lines[0].split()
            words.insert(rng.randrange(len(words)), rng.choice(["grumble", "snarkface", "snarkhead"]))
            lines[0] = " ".join(words)
        if bad:
            lines[-1] = " ".join(f"{w.upper()}!!" for w in lines[-1].split() * 3)
        docs.append((i, "\n".join(lines)))
        labels.append((i, int(not bad), int(toxic)))
    return docs, labels


def is_held_out(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def test_toxicity_learns_and_folds(spark, documents):
    docs, labels = labelled()
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    lexicon = toxicity.learn_lexicon(documents(docs, True), table)
    asked = docs + [(900, "you GRUMBLE"), (901, "you gr​umвӏe grуmble"), (902, "a 5narkfac3 there"), (903, ""), (904, None), (None, "calm words"), (905, "w1 " * 5000 + "grumble")]
    rows = {r["doc_id"]: r for r in toxicity.toxicity(documents(asked, True), lexicon).collect()}
    wrong = [i for i, _, t in labels if is_held_out(i) and (rows[i]["score"] >= toxicity.THRESHOLD) != bool(t)]
    assert not wrong
    assert rows[900]["score"] >= 0.7 and rows[902]["score"] >= 0.7 and rows[901]["score"] >= 0.7
    assert max(rows[903]["score"], rows[904]["score"], rows[None]["score"]) < 0.7
    kept = toxicity.drop_toxic(documents(asked, True), lexicon)
    assert kept.columns == documents(asked, True).columns and kept.filter("doc_id = 900").isEmpty()


def test_toxicity_exceptions_and_no_labels(spark, documents):
    m = toxicity.Matcher(toxicity.Lexicon({"grum": 3.0, "rude ": 2.0}, {"grummet"}))
    assert m.features("a grummet")[0] == 0 and m.features("a grumx")[0] > 0
    assert m.features("rudeness")[0] == 0 and m.features("so rude.")[0] > 0 and m.features("x" * 3)[0] == 0
    none = toxicity.learn_lexicon(documents([]), spark.createDataFrame([(1, None, None)], "doc_id long, quality int, toxic int"))
    assert toxicity.toxicity(documents([]), none).count() == 0
    assert toxicity.toxicity(documents([(1, None), (1, None)]), none).filter("score < 0.7").count() == 2


def test_quality_learns(spark, documents):
    docs, labels = labelled()
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    field = quality.learn_field(documents(docs, True), table)
    asked = docs + [(903, ""), (904, None), (None, "\n\n\n"), (905, "Fine words. " * 4000), (906, "\n" * 3000)]
    rows = quality.quality(documents(asked, True), field).collect()
    assert len(rows) == len(asked) and all(0 <= r["score"] <= 1 for r in rows)
    score = {r["doc_id"]: r["score"] for r in rows}
    held = [(i, q) for i, q, _ in labels if is_held_out(i)]
    assert sum((score[i] >= 0.5) == bool(q) for i, q in held) / len(held) > 0.95
    assert quality.learn_field(documents([]), table.limit(0)) is None
    assert quality.quality(documents([(1, None)]), None).first()["score"] == 0.5
    assert quality.quality(documents([]), field).count() == 0


def test_chain_marginals_match_enumeration():
    rng = np.random.default_rng(3)
    field = quality.Field(rng.normal(size=3), rng.normal(size=(2, 2)), np.array([1.0, 0.0]))
    x, first = rng.normal(size=(9, 3)), np.array([0, 1, 4, 9])
    single, pair = field.chains(x, first)
    for a, b in zip(first[:-1], first[1:]):
        total, mass, joint = 0.0, np.zeros((b - a, 2)), np.zeros((b - a, 2, 2))
        for code in range(2 ** (b - a)):
            y = [(code >> k) & 1 for k in range(b - a)]
            w = np.exp(sum(y[k] * (x[a + k] @ field.unary) for k in range(b - a)) + sum(field.pairs[y[k - 1], y[k]] for k in range(1, b - a)))
            total += w
            for k in range(b - a):
                mass[k, y[k]] += w
                if k:
                    joint[k, y[k - 1], y[k]] += w
        assert np.allclose(single[a:b], mass / total) and np.allclose(pair[a:b], joint / total)


CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_\-])(?=[A-Za-z+/_\-]*[0-9])[A-Za-z0-9+/_\-]{12,}")


def test_secret_scan(spark):
    rng = random.Random(4)
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows = []
    for i in range(60):
        kind = i % 3
        body = [f'token = "{hexa(40)}" and more', f"card {rng.randrange(10**15, 10**16)} paid", f"commit {hexa(12)}9 of build"][kind]
        rows.append((i, f"{prose(rng, 20)} {body} {prose(rng, 5)}", "tests/x.py" if kind == 2 else "src/app.py"))
    rows += [(70, None, None), (71, "", "a"), (None, "password=abc123def456ghi", None), (5, rows[0][1], "src/app.py"), (5, rows[0][1], "src/app.py")]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS label", "'x' AS candidate")
    got = secrets.scan(table).collect()
    wanted = [(i, p or "", k, m[0]) for i, t, p in rows for k, m in enumerate(CANDIDATE.finditer(t or ""))]
    assert ordered((r["doc_id"], r["path"], r["position"], r["candidate"]) for r in got) == ordered(wanted)
    verdict = {(r["doc_id"], r["candidate"]): r["finding"] for r in got}
    assert all(found == (i is None or i % 3 == 0 or i == 5 and c in rows[0][1]) for (i, c), found in verdict.items() if i != 5)
    plan = secrets.scan(table)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert secrets.scan(table.limit(0)).count() == 0


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline
    from test_dedup import BLANK, expected_near

    docs, labels = labelled(160)
    rng = random.Random(8)
    item = prose(rng, 30, 5000)
    docs += [(200 + i, docs[i][1]) for i in range(0, 20, 3)] + [(300 + i, f"  {docs[i][1]} ") for i in range(5)]
    docs += [(400 + i, prose(random.Random(i), 120) if i < 4 else " ".join(prose(random.Random(i - 4), 120).split()[:-1] + ["z"])) for i in range(8)]
    docs += [(500, f"intro {item} outro"), (501, None), (502, "")]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    kept = [(i, t) for i, t in docs if not re.search("(?i)grumble|snark", t or "")]
    first = {}
    for i, t in kept:
        first.setdefault(BLANK.sub(" ", t or ""), i)
    kept = [(i, t) for i, t in kept if first[BLANK.sub(" ", t or "")] == i]
    kept = [d for d, (i, _, least, stays) in zip(kept, expected_near(kept, 5)) if stays]
    kept = [(i, t) for (i, t), (_, _, hit, _) in zip(kept, expected_hits(kept, [(0, item)])) if not hit]
    library = Tokenizer.from_file(bpe.tokenizer_path())
    assert got == {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in kept}


def test_long_conversation(spark):
    n = 3000
    rows = spark.range(n).selectExpr("cast(5 AS BIGINT) AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "repeat(concat('t', id, ' '), 10) AS text")
    got = chat_format.example_digests(chat_format.prefix_target_examples(rows)).first()
    loss = "".join(f"t{i} " * 10 for i in range(1, n, 2))
    assert (got["n_turns"], got["n_examples"], got["loss_sha256"]) == (n, n // 2, sha(loss))


def slow_features(lexicon, text):
    """Matches of a lexicon by trying every entry at every place."""
    plain, text = toxicity._plain(text), toxicity.folded(text)
    best, excused = {}, []
    for start in range(len(text)):
        if not toxicity._begins(plain, start):
            continue
        for entry, weight in [*lexicon.entries.items(), *((e, 0) for e in lexicon.exceptions)]:
            bare = entry.rstrip(" ")
            end = start + len(bare)
            if text[start:end] != bare:
                continue
            closed = not toxicity._GOES_ON.match(plain, end)
            if bare in lexicon.exceptions and closed:
                excused.append((start, end))
            elif weight and (closed or entry == bare):
                best[start] = max(best.get(start, 0.0), weight)
    total = sum(w for s, w in best.items() if not any(a <= s < b for a, b in excused))
    return np.log1p(total), np.log1p(1000 * total / (len(text) + 200))


def test_toxicity_against_brute_force():
    rng = random.Random(14)
    lexicon = toxicity.Lexicon({"grum": 3.0, "rude ": 2.0, "snark": 1.5, "snarkface": 4.0}, {"grummet", "rude awakening", "old snark"})
    m = toxicity.Matcher(lexicon)
    words = ["grum", "grummet", "grumble", "rude", "rudeness", "awakening", "old", "snark", "snarkface", "sn4rk", "RUDE", "rуde", "x", "5", "!!", "calm", "gr00m"]
    for _ in range(300):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", ", ", "\n", ""]) for _ in range(rng.randrange(12)))
        assert np.allclose(m.features(text), slow_features(lexicon, text)), text


def test_exception_phrases_are_learned(spark, documents):
    rng = random.Random(15)
    docs, labels = [], []
    for i in range(600):
        toxic = i % 3 == 0
        extra = "grumble off" if toxic else "grumble bee" if i % 97 == 1 else "calm"
        docs.append((i, f"{prose(rng, 20)} {extra} {prose(rng, 10)}"))
        labels.append((i, 1, int(toxic)))
    lexicon = toxicity.learn_lexicon(documents(docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert "grumble bee" in lexicon.exceptions
    rows = {r["doc_id"]: r["score"] for r in toxicity.toxicity(documents([(1, "a grumble bee here"), (2, "a grumble here")]), lexicon).collect()}
    assert rows[1] < toxicity.THRESHOLD <= rows[2]


def test_clashing_columns_are_replaced(spark, documents):
    rows = spark.createDataFrame([(1, "calm", 5, "x", "y")], "doc_id long, Text string, Score int, N_hit string, decoded_text string")
    scored = toxicity.toxicity(rows, toxicity.Lexicon({"grum": 1.0}))
    assert scored.columns == ["doc_id", "Text", "N_hit", "decoded_text", "score"] and scored.first()["score"] < 0.7
    assert quality.quality(rows, None).first()["score"] == 0.5
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.with_hits(rows, none).first()["n_hit"] == 0
    tokens = rows.selectExpr("array(1, 2) AS ids", "decoded_text")
    assert bpe.decoded(tokens, bpe.tokenizer_path()).columns == ["ids", "decoded_text"]


def test_forest_removes_false_positives(spark):
    """On held-out planted findings the forest is far more precise than the pattern alone, and loses little."""
    rng = random.Random(16)
    docs = spark.createDataFrame([(i, prose(rng, 80, 300) + " " + " ".join(rng.choice(["account", "garden", "window", "letter"]) for _ in range(9))) for i in range(300)], "doc_id long, text string")
    words = secrets.corpus_words(docs)
    findings = secrets.planted_findings(docs, words)
    told = secrets.verdicts(findings, words)
    print(told)
    assert told["precision"] > 0.9 > 0.65 > told["precision_without"] and told["recall"] > 0.9


def test_features_against_brute_force(spark):
    rows = [(1, 'set token = "Ab3dEfgh12xyz9" now', "tests/a/b.py"), (2, "letters " * 12 + "letters_9_letters", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    words = secrets.corpus_words(docs)
    got = {r["id"]: r for r in secrets.features(secrets.candidates(docs), words).collect()}
    first = got[1]
    assert first["candidate"] == "Ab3dEfgh12xyz9"
    assert (first["length"], first["digits"], first["uppers"], first["hex"]) == (14, 4 / 14, 2 / 14, 0)
    assert first["kinds"] == len(set("ab3defgh12xyz9")) / 14 and first["changes"] == 6
    assert (first["example_path"], first["depth"], first["announced"], first["assigned"], first["quoted"]) == (1, 2, 1, 1, 1)
    assert got[2]["coverage"] == 14 / 17 and got[1]["coverage"] == 0


def test_pipeline_edges(spark, tmp_path):
    import corpus_pipeline

    kinds = "doc_id long, text string, lang string, source string, n_chars long, score string, items string, id long, fp long"
    rows = [(None, "a b", None, None, None, "s", "i", 1, 1), (None, "a b", None, None, None, "s", "i", 1, 1), (1, None, "en", "s", 0, None, None, 2, 2), (1, "", "en", "s", 0, None, None, 2, 2), (2, "one two", "en", "s", 7, None, None, 2, 2), (2, "one two", "en", "s", 7, None, None, 2, 2)]
    for name, part in (("full", rows), ("empty", [])):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame(part, kinds).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    got = [r["doc_id"] for r in corpus_pipeline.run(spark, f"{tmp_path}/full").collect()]
    assert sorted(got, key=str) == [1, 2, None]
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
