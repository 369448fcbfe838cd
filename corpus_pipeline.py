"""From raw documents to packed sequences of tokens, in five stages.

Each stage works on all that the one before it kept, is written as Parquet and
read again, so a lost executor costs at most the stage that runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismlake.llm import bayes_quality, exact_dedup, feistel_pii, near_dedup, packing
from prismlake.llm.common import Scratch, prepare, read_table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; it is fitted on the labelled ones among docs."""
    prepare(spark)
    return bayes_quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without white space, one stays."""
    return exact_dedup.keep_first_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at a similarity of 0.8, the document with the smallest id stays."""
    prepare(spark)
    return near_dedup.keep_one_of_each(docs, width=5, percent=80)


def pseudonymise_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to keyed pseudonyms of the same format; n_chars follows the new text."""
    new = feistel_pii.pseudonymise(docs, key=feistel_pii.session_key(spark))
    if "n_chars" in new.columns:
        new = new.withColumn("n_chars", F.char_length("text").cast(dict(docs.dtypes)["n_chars"]))
    return new


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences of at most 1024, as pieces with their places and ids."""
    prepare(spark)
    # Workers of the stages before are still there for a minute: this stage keeps little in its own.
    return packing.pack_documents(docs, kept=100_000)


STAGES = [
    ("quality_classifier", keep_quality),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("pii", pseudonymise_personal_data),
    ("packing", pack_sequences),
]

#: SQL can't express the classifier, the signatures or the packing; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the last stage's rows."""
    scratch = Scratch(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"{k}-{name}")
    return docs
