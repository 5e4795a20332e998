"""A corpus pipeline: toxicity, exact dedup, near-dedup, decontamination, tokens.

Each stage works on all documents that the stage before it kept. All but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reposcope.llm.bpe import encoded, tokenizer_path
from reposcope.llm.common import forget, read, small_batches, written
from reposcope.llm.decontamination import drop_contaminated
from reposcope.llm.exact_dedup import drop_copies
from reposcope.llm.minhash_dedup import drop_near_copies
from reposcope.llm.toxicity import drop_toxic, learn_lexicon


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold, by a lexicon learned from those with labels."""
    return drop_toxic(docs, learn_lexicon(docs, read(spark, sf_dir, "labels")))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest doc_id."""
    return drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a similarity of 0.8 on five-word shingles the smallest doc_id."""
    return drop_near_copies(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten consecutive words of a benchmark item."""
    return drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of token ids and decoded text, a table in the shared folder."""
    with small_batches(spark):
        return written(encoded(docs, tokenizer_path(), with_ids=False))


STAGES = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("minhash_near_dedup", without_near_copies),
    ("benchmark_decontamination", without_benchmark),
    ("bpe", tokens),
]

#: Learned scores and merge rounds have no SQL form; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`; between stages the documents are a table in the shared folder."""
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, written(stage(spark, docs, sf_dir))
        if k:
            forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
