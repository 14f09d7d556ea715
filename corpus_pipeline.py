"""A training corpus in five stages, from documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. run() writes each stage's result to the shared folder and reads it as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docmesa.llm import jaccard_join, packing, pii, quality, suffix_dedup
from docmesa.llm.common import materialise, prepare, read_table
from docmesa.llm.queries import tokenizer_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold go."""
    prepare(spark)
    return quality.keep_good(docs, quality.train(docs, read_table(spark, sf_dir, "labels")))


def jaccard_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, Jaccard 0.8 or more."""
    return jaccard_join.one_of_each(docs_ready(spark, docs), words=5, top=8, bottom=10)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes in strings of 50 bytes that begin in a smaller document too are cut out."""
    return suffix_dedup.without_repeats(docs_ready(spark, docs), length=50)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are masked."""
    return pii.mask_personal_data(docs_ready(spark, docs), pii.train())


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as pieces of sequences of at most 4096 tokens."""
    with open(tokenizer_path("word_bpe_49k.json"), encoding="utf-8") as f:
        return packing.pack_documents(docs_ready(spark, docs), f.read(), end_id=2)


def docs_ready(spark: SparkSession, docs: DataFrame) -> DataFrame:
    prepare(spark)
    return docs


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", jaccard_groups),
    ("suffix-array dedup", repeated_passages),
    ("PII", personal_data),
    ("packing", packed_sequences),
]

#: The classifier, the spans and the packing have no SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
