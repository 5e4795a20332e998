"""Byte-level BPE encoding and decoding with batched numpy merge rounds.

A text is cut at the tokenizer's special tokens and by its word pattern. The
different words of a batch that are not known yet are encoded together: their
symbols lie in one flat array, and a round finds the rank of every adjacent
pair by binary search over the sorted pair keys, takes each word's lowest rank
and merges its occurrences from left to right, in all words at once. Rounds go
on until no word has a pair left to merge. Words are kept in a table of bounded
size per Python worker, since most words of a corpus repeat.

Decoding gathers the bytes of all ids of a batch from one flat table.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from reposcope.llm.common import column_index, keyed_text, read, real_id

#: The word pattern of byte-level BPE; a fixed value.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words that a Python worker keeps, and the longest it keeps, in characters.
KEPT_WORDS, KEPT_CHARS = 400_000, 40
#: Texts of a batch that are Python strings at a time.
LISTED = 500
#: Characters of text whose words are gathered before a call of the merge rounds.
GATHER_CHARS = 2_000_000

NO_RANK = np.int64(1 << 40)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(extra)) for b in range(256)]


class Merges:
    """A byte-level BPE vocabulary read from a tokenizers JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        symbols = byte_symbols()
        to_byte = {s: b for b, s in enumerate(symbols)}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        size = 1 + max([*vocab.values(), *(t["id"] for t in spec.get("added_tokens", []))])
        self.of_byte = np.array([vocab[s] for s in symbols], np.int64)
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.base = size
        keys = left * size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order.astype(np.int64)
        self.result = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        whole = {i: bytes(to_byte[c] for c in s) for s, i in vocab.items()}
        whole |= {i: s.encode() for s, i in self.special.items()}
        pieces = [whole.get(i, b"") for i in range(size)]
        self.ends = np.cumsum([len(p) for p in pieces])
        self.starts = self.ends - np.array([len(p) for p in pieces])
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.names = [str(i) for i in range(size)]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NO_RANK where the vocabulary does not merge it."""
        key = left * self.base + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.rank[at], NO_RANK)

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """Token ids of each word (its bytes), all words merged in common rounds."""
        flat = np.frombuffer(b"".join(words), np.uint8)
        symbols = self.of_byte[flat]
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        done_symbols, done_words = [], []
        rank = self._pair_ranks(symbols, word, np.arange(len(symbols)))
        while len(symbols):
            begin = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            sizes = np.diff(np.append(begin, len(word)))
            lowest = np.repeat(np.minimum.reduceat(rank, begin), sizes)
            active = lowest < NO_RANK
            if not active.all():
                done_symbols.append(symbols[~active])
                done_words.append(word[~active])
                symbols, word, rank, lowest = symbols[active], word[active], rank[active], lowest[active]
                if not len(symbols):
                    break
            hit = rank == lowest
            # of touching occurrences every second one merges, from the left
            where = np.flatnonzero(hit)
            fresh = np.ones(len(where), bool)
            fresh[1:] = (where[1:] != where[:-1] + 1) | (word[where[1:]] != word[where[:-1]])
            if not fresh.all():
                number = np.arange(len(where))
                where = where[(number - np.maximum.accumulate(np.where(fresh, number, 0))) % 2 == 0]
            symbols = symbols.copy()
            symbols[where] = self.result[rank[where]]
            keep = np.ones(len(symbols), bool)
            keep[where + 1] = False
            touched = np.cumsum(keep)[where] - 1
            symbols, word, rank = symbols[keep], word[keep], rank[keep]
            touched = np.concatenate([touched, touched[touched > 0] - 1])
            rank[touched] = self._pair_ranks(symbols, word, touched)
        if done_symbols:
            symbols, word = np.concatenate(done_symbols), np.concatenate(done_words)
        order = np.argsort(word, kind="stable")
        counts = np.bincount(word, minlength=len(words)) if len(word) else np.zeros(len(words), np.int64)
        return np.split(symbols[order], np.cumsum(counts)[:-1])

    def _pair_ranks(self, symbols: np.ndarray, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The ranks of the pairs that start at some symbols; a word's last symbol has no pair."""
        rank = np.full(len(at), NO_RANK)
        inner = np.flatnonzero(at < len(symbols) - 1)
        inner = inner[word[at[inner]] == word[at[inner] + 1]]
        left = at[inner]
        rank[inner] = self.ranks(symbols[left], symbols[left + 1])
        return rank

    def listed(self, ids: np.ndarray) -> str:
        """The ids as decimal numbers joined by commas."""
        names = self.names
        return ",".join([names[i] for i in ids.tolist()])

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of a sequence of ids."""
        starts, ends = self.starts[ids], self.ends[ids]
        sizes = ends - starts
        total = np.cumsum(sizes)
        at = np.arange(int(total[-1]) if len(total) else 0) + np.repeat(starts - (total - sizes), sizes)
        return self.bytes[at].tobytes()


class Encoder:
    """Encodes texts, keeping the ids of frequent words as the bytes of 32-bit numbers, which take less memory than tuples of numbers."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.words: dict[str, bytes] = {}
        self.pattern = regex.compile(WORD_PATTERN)
        cut = "|".join(map(regex.escape, sorted(merges.special, key=len, reverse=True)))
        self.cut = regex.compile(f"({cut})") if cut else None

    def _pieces(self, text: str) -> list[str]:
        """Words of a text; a special token is a piece of its own."""
        if self.cut is None or not any(s in text for s in self.merges.special):
            return self.pattern.findall(text)
        out: list[str] = []
        for part in self.cut.split(text):
            out += [part] if part in self.merges.special else self.pattern.findall(part)
        return out

    def encode(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        held: list[list[str]] = []
        chars = 0
        for text in texts:
            held.append(self._pieces(text))
            chars += len(text)
            if chars >= GATHER_CHARS:
                yield from self._flush(held)
                held, chars = [], 0
        yield from self._flush(held)

    def _flush(self, held: list[list[str]]) -> Iterator[np.ndarray]:
        new = {w for pieces in held for w in pieces}.difference(self.words)
        fresh: dict[str, bytes] = {}
        if new:
            special = self.merges.special
            plain = [w for w in new if w not in special]
            for w, ids in zip(plain, self.merges.encode_words([w.encode("utf-8", "replace") for w in plain])):
                fresh[w] = ids.astype(np.int32).tobytes()
            fresh |= {w: np.array([special[w]], np.int32).tobytes() for w in new if w in special}
        table = self.words
        for pieces in held:
            ids = b"".join([table[w] if w in table else fresh[w] for w in pieces])
            yield np.frombuffer(ids, np.int32).astype(np.int64)
        if len(table) + len(fresh) > KEPT_WORDS:
            table.clear()
        table.update((w, ids) for w, ids in fresh.items() if len(w) <= KEPT_CHARS)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(Merges(path))
    return _encoders[path]


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Per input row: doc_id, ids (array<int>), n_tokens, ids_sha256, decoded_sha256.

    A null text is an empty one, with no tokens. Special tokens written in a
    text become their ids and decode to their text. Repeated rows and ids give
    a row each, a null id stays null, an empty table gives no rows. `path` is
    the tokenizer file, present on every executor. ids is left out on request.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            texts = (text for a in range(0, batch.num_rows, LISTED) for text in batch.column(1).slice(a, LISTED).to_pylist())
            counts, id_shas, text_shas, all_ids = [], [], [], []
            for ids in coder.encode(texts):
                counts.append(len(ids))
                id_shas.append(hashlib.sha256(coder.merges.listed(ids).encode()).hexdigest())
                text = coder.merges.decode(ids).decode("utf-8", "replace")
                text_shas.append(hashlib.sha256(text.encode()).hexdigest())
                if with_ids:
                    all_ids.append(ids.astype(np.int32))
            columns = [batch.column(0), *([pa.array(all_ids, pa.list_(pa.int32()))] if with_ids else []), pa.array(counts, pa.int64()), pa.array(id_shas), pa.array(text_shas)]
            yield pa.RecordBatch.from_arrays(columns, ["id", *(["ids"] if with_ids else []), "n_tokens", "ids_sha256", "decoded_sha256"])

    ids = "ids array<int>, " if with_ids else ""
    out = keyed_text(docs, id_col, text_col).mapInArrow(run, f"id long, {ids}n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.select(real_id("id").alias("doc_id"), *out.columns[1:])


def decoded(rows: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """All columns of `rows` and decoded_text, the text of its array of ids (null: empty).

    A column of that name is replaced.
    """
    rows = rows.drop("decoded_text")
    where = column_index(rows, ids_col)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = encoder(path).merges
        for batch in batches:
            texts = [merges.decode(np.array(ids or [], np.int64)).decode("utf-8", "replace") for ids in batch.column(where).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded_text"])

    return rows.mapInArrow(run, f"{kinds}, decoded_text string")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(read(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)
