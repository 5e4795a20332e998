"""Toxicity by a weighted lexicon and an Aho-Corasick automaton.

Texts are folded first: lower case, look-alike letters of other scripts to
Latin ones, invisible characters away, and digits or signs that stand for
letters, in a token with a letter, back to letters. Lexicon entries match at the beginning
of a word (or as a whole word), and every word counts once, by its heaviest
entry; a match inside an exception phrase does not count. The score is a
logistic function of the summed weights and of their density, the sum
normalised by the length of the text.

Entries and weights are learned from labelled documents: word beginnings that
are closed (no extension is about as frequent) and more frequent in toxic
documents, by a log-likelihood ratio that so many candidates would not reach by
chance. Further rounds look only at toxic documents without an entry so far.
Words of clean documents that begin like an entry become exceptions, and so do
phrases of two words around a match that only clean documents hold.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from uuid import uuid4

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reposcope.llm.common import checkpointed, column_index, fresh, read
from reposcope.llm.labelled import fit_logistic, held_out, labelled_sample, logistic, without_copies

#: Bounds of the sample that lexicon and weights are learned from: clean and toxic rows, characters of a text.
SAMPLE, SAMPLE_CHARS = (4000, 2500), 20_000
#: Shortest and longest word beginning that is counted; a longer entry can only be a whole word.
SHORTEST, LONGEST = 4, 12
#: Entries by chance that are tolerated, documents an entry needs, and rounds over documents not yet explained.
CHANCE, LEAST_DOCS, ROUNDS = 0.5, 4, 3
#: What the ratio of word counts must exceed that of documents by, as words of one document are not independent.
WORDS_MARGIN = 12.0
#: How many times as frequent an entry is in toxic documents, at least.
PURITY = 20
THRESHOLD = 0.7

#: Letters of other scripts that look like Latin ones, and signs that stand for letters.
LOOKALIKES = {
    "а": "a", "в": "b", "г": "r", "е": "e", "ё": "e", "з": "3", "и": "u", "к": "k", "м": "m", "н": "h", "о": "o", "п": "n",
    "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w",
    "α": "a", "β": "b", "γ": "y", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ω": "w", "μ": "u", "ı": "i", "ɑ": "a", "ɡ": "g", "ӏ": "l",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i"}

_FOREIGN = re.compile("[ıɑ-ɡͰ-ԯ！-～]")
_HIDDEN = re.compile("[­​-‏⁠﻿]")
_LETTERS = {ord(k): v for k, v in LOOKALIKES.items()} | {0xFF01 + i: chr(0x21 + i).lower() for i in range(94)}
_FOLDS = str.maketrans(SUBSTITUTES)
_SIGNS = "".join(SUBSTITUTES)
#: A token of letters and substitutes with both in it; several ! in a row end a token.
_TOKEN = re.compile(r"(?<![^\W_])(?:[^\W\d_]++(?:[0-9@$]|!(?!!))|[0-9@$]++[^\W\d_])(?:[^\W_]|[@$]|(?<!!)!(?!!))*+")
#: What is punctuation at a token's end.
_TAIL = re.compile(r"(?:!|(?<!\$)\${3,})+$")
_GOES_ON = re.compile(rf"[{_SIGNS}]?[^\W\d_]")
_WORD = re.compile(r"[^\W\d_]+")


def _plain(text: str) -> str:
    """`text` in lower case, with Latin letters, before substitutes are folded."""
    text = text.lower()
    if not text.isascii():
        if _HIDDEN.search(text):
            text = _HIDDEN.sub("", text)
        if _FOREIGN.search(text):
            text = text.translate(_LETTERS)
    return text


def _fold(m: re.Match) -> str:
    tail = _TAIL.search(m[0])
    end = tail.start() if tail else len(m[0])
    return m[0][:end].translate(_FOLDS) + m[0][end:]


def folded(text: str) -> str:
    """`text` as it is matched; every substitute in a token with a letter is folded, place by place."""
    return _TOKEN.sub(_fold, _plain(text))


def _begins(plain: str, start: int) -> bool:
    """Whether a word may begin here: no letter before it, nor a single substitute behind a letter."""
    if not start or plain[start - 1].isalpha():
        return not start
    return not (plain[start - 1] in _SIGNS and start > 1 and plain[start - 2].isalpha())


@dataclass
class Lexicon:
    """Weights of word beginnings (an entry that ends in a space is a whole word), exceptions, and the score's weights."""

    entries: dict[str, float]
    exceptions: set[str] = field(default_factory=set)
    weights: list[float] = field(default_factory=lambda: [1.0, 0.5, -2.0])
    key: str = field(default_factory=lambda: uuid4().hex)


class Matcher:
    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.automaton = ahocorasick.Automaton()
        for entry, weight in lexicon.entries.items():
            self.automaton.add_word(entry.rstrip(" "), (entry, weight))
        for phrase in lexicon.exceptions:
            if phrase not in self.automaton:
                self.automaton.add_word(phrase, (phrase, 0.0))
        if len(self.automaton):
            self.automaton.make_automaton()

    def features(self, text: str) -> tuple[float, float]:
        """(log of the summed weights + 1, log of their density + 1) of one text."""
        as_written = _plain(text)
        text = _TOKEN.sub(_fold, as_written)
        best: dict[int, float] = {}
        excused: list[tuple[int, int]] = []
        if len(self.automaton):
            for end, (entry, weight) in self.automaton.iter(text):
                plain = entry.rstrip(" ")
                start = end + 1 - len(plain)
                # a run of digits or signs beside a word may also be a number or punctuation
                if not _begins(as_written, start):
                    continue
                closed = not _GOES_ON.match(as_written, end + 1)
                if plain in self.lexicon.exceptions and closed:
                    excused.append((start, end))
                elif weight and (closed or not entry.endswith(" ")):
                    best[start] = max(best.get(start, 0.0), weight)
        for lo, hi in excused:
            for start in [s for s in best if lo <= s <= hi]:
                del best[start]
        total = sum(best.values())
        return math.log1p(total), math.log1p(1000 * total / (len(text) + 200))


    def phrases(self, text: str) -> set[tuple[str, str]]:
        """(phrase, word): each word of a text that matches by itself, with the word before and after it."""
        text = folded(text)
        words = [(w[0], w.start(), w.end()) for w in _WORD.finditer(text)]
        known: dict[str, bool] = {}
        found = set()
        for i, (word, start, end) in enumerate(words):
            if word not in known:
                known[word] = self.features(word)[0] > 0
            if known[word]:
                if i and text[words[i - 1][2] : start] == " ":
                    found.add((f"{words[i - 1][0]} {word}", word))
                if i + 1 < len(words) and text[end : words[i + 1][1]] == " ":
                    found.add((f"{word} {words[i + 1][0]}", word))
        return found


_matchers: dict[str, Matcher] = {}


def matcher(lexicon: Lexicon) -> Matcher:
    """This worker's automaton for a lexicon."""
    if lexicon.key not in _matchers:
        _matchers.clear()
        _matchers[lexicon.key] = Matcher(lexicon)
    return _matchers[lexicon.key]


def beginning_counts(sample: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(entry, bad, good, bad_words, good_words) of word beginnings and (with a space at its end) words.

    bad and good count the toxic and clean documents that hold the entry, the
    others the different words with it, summed over documents. Toxic documents
    in which the lexicon matches already are left out; the empty entry has the
    totals of those that are not.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list[int]] = {}
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if label and matcher(lexicon).features(text)[0]:
                    continue
                entries: Counter[str] = Counter()
                for w in set(_WORD.findall(folded(text))):
                    entries.update(w[:k] for k in range(SHORTEST, min(len(w), LONGEST) + 1))
                    entries[f"{w} "] += 1
                    entries[""] += 1
                for entry, words in entries.items():
                    row = found.setdefault(entry, [0, 0, 0, 0])
                    row[1 - label] += 1
                    row[3 - label] += words
            if len(found) > 200_000:
                yield _counts(found)
                found = {}
        yield _counts(found)

    names = ["bad", "good", "bad_words", "good_words"]

    def _counts(found: dict[str, list[int]]) -> pa.RecordBatch:
        columns = [pa.array([row[i] for row in found.values()], pa.int64()) for i in range(4)]
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), *columns], ["entry", *names])

    parts = sample.mapInArrow(count, "entry string, bad long, good long, bad_words long, good_words long")
    return parts.groupBy("entry").agg(*(F.sum(c).alias(c) for c in names))


def _ratio(bad: str, good: str, share: float) -> Column:
    """Log-likelihood ratio of two counts against a common rate."""
    b, g = F.col(bad), F.col(good)
    n = b + g
    return 2 * (b * F.log(b / (n * share)) + F.when(g > 0, g * F.log(g / (n * (1 - share)))).otherwise(0.0))


def learn_lexicon(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> Lexicon:
    """A lexicon learned from a bounded sample of labelled documents outside the held-out part.

    Without labelled documents of both classes the lexicon is empty and every
    text scores low.
    """
    sample = checkpointed(labelled_sample(docs, labels, label_col, SAMPLE, SAMPLE_CHARS, id_col, text_col))
    sample = checkpointed(without_copies(sample).select("text", "label"))
    lexicon = Lexicon({})
    for _ in range(ROUNDS):
        counts = checkpointed(beginning_counts(sample, lexicon))
        every = counts.filter("entry = ''").first()
        if every is None or every["bad"] < LEAST_DOCS or not every["good"]:
            break
        n_bad, n_good = every["bad"], every["good"]
        counts = counts.filter("entry <> ''")
        least = 2 * math.log(max(counts.filter(F.col("bad") + F.col("good") >= LEAST_DOCS).count(), 1) / CHANCE)
        by_docs = _ratio("bad", "good", n_bad / (n_bad + n_good))
        by_words = _ratio("bad_words", "good_words", every["bad_words"] / (every["bad_words"] + every["good_words"]))
        rows = (
            counts.filter((F.col("bad") >= LEAST_DOCS) & (F.col("bad") * n_good > PURITY * F.col("good") * n_bad))
            .withColumn("g", F.greatest(by_docs, by_words - WORDS_MARGIN))
            .filter(F.col("g") >= least)
            .collect()  # words of the bounded sample that pass the test
        )
        entries = _closed({r["entry"]: (r["bad"], r["good"]) for r in rows}, n_bad, n_good)
        if not entries:
            break
        lexicon = Lexicon({**entries, **lexicon.entries}, lexicon.exceptions | _exceptions(counts, entries))
    if lexicon.entries:
        lexicon = Lexicon(lexicon.entries, lexicon.exceptions | _phrases(sample, lexicon))
    points = _sample_features(sample, lexicon)
    if lexicon.entries:
        lexicon.weights = fit_logistic(points[:, :2], points[:, 2]).tolist()
    return lexicon


def _closed(found: dict[str, tuple[int, int]], n_bad: int, n_good: int) -> dict[str, float]:
    """The entries that no extension replaces and no shorter entry covers, with their weights.

    An extension by one character replaces an entry if it is about as frequent
    in toxic documents, or most often there and purer.
    """
    replaced = set()
    for entry, (bad, good) in found.items():
        less, clean = found.get(entry[:-1], (0, 0))
        if less and (bad >= 0.95 * less or (bad >= 0.6 * less and 2 * good * less < clean * bad)):
            replaced.add(entry[:-1])
    kept: dict[str, float] = {}
    for entry in sorted(found, key=len):
        if entry in replaced or any(entry[:k] in kept for k in range(SHORTEST, len(entry))):
            continue
        bad, good = found[entry]
        kept[entry] = math.log((bad + 0.5) / n_bad) - math.log((good + 0.5) / n_good)
    return kept


def _exceptions(counts: DataFrame, entries: dict[str, float]) -> set[str]:
    """Whole words of two or more clean documents and no toxic one that begin like an entry."""
    starts = sorted({e.rstrip(" ")[:SHORTEST] for e in entries})
    if not starts:
        return set()
    words = counts.filter(F.col("entry").endswith(" ") & (F.col("bad") == 0) & (F.col("good") >= 2))
    words = words.filter(F.substring("entry", 1, SHORTEST).isin(starts))
    plain = [e for e in entries if not e.endswith(" ")]
    found = (r["entry"].rstrip(" ") for r in words.collect())
    return {w for w in found if any(w.startswith(e) for e in plain)}


def _phrases(sample: DataFrame, lexicon: Lexicon) -> set[str]:
    """Phrases of a matched word and the word beside it, of two or more clean documents and no toxic one, where
    the word itself occurs in toxic documents too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = matcher(lexicon)
        for batch in batches:
            found = [(phrase, word, label) for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for phrase, word in m.phrases(text)]
            columns = list(zip(*found)) if found else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32()))], ["phrase", "word", "label"])

    told = sample.mapInArrow(run, "phrase string, word string, label int")
    bad = F.sum("label").alias("bad")
    phrases = told.groupBy("phrase", "word").agg(bad, F.count(F.lit(1)).alias("n")).filter("bad = 0 AND n >= 2")
    words = told.groupBy("word").agg(bad).filter("bad > 0").select("word")
    return {r["phrase"] for r in phrases.join(words, "word").collect()}


def _sample_features(sample: DataFrame, lexicon: Lexicon) -> np.ndarray:
    """(features, label) of the bounded sample's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [matcher(lexicon).features(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in x], pa.float64()), pa.array([b for _, b in x], pa.float64()), batch.column(1)], ["a", "b", "label"])

    rows = sample.mapInArrow(run, "a double, b double, label int").collect()
    return np.array([tuple(r) for r in rows], float).reshape(-1, 3)


def toxicity(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All columns of `docs` and the score, 0 to 1; a null text scores as an empty one.

    Rows are scored one by one, so nulls elsewhere, repeated rows and extra
    columns do not matter; a column that has the score's name is replaced, and
    names are compared without case. An empty table gives no rows.
    """
    docs = docs.drop(score_col)
    where = column_index(docs, text_col)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.array(lexicon.weights)
        for batch in batches:
            x = np.array([matcher(lexicon).features(t or "") for t in batch.column(where).to_pylist()], float).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(logistic(x, weights))], [*batch.schema.names, score_col])

    return docs.mapInArrow(run, f"{kinds}, `{score_col}` double")


def drop_toxic(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The input's columns and rows that score below the threshold."""
    score = fresh("score", docs.columns)
    return toxicity(docs, lexicon, text_col, score).filter(F.col(score) < threshold).drop(score)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = learn_lexicon(docs, read(spark, sf_dir, "labels"))
    scored = toxicity(docs, lexicon)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
