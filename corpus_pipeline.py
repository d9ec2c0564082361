"""Corpus pipeline over ``documents``: quality rules, near-duplicates,
benchmark decontamination, secret removal, token ids.

Every stage takes (spark, docs, sf_dir) and works on all its predecessor
kept; all but the last return the columns of ``documents``.  ``run`` writes
each stage's result as Parquet to the shared folder and reads it back, so a
lost executor never repeats an earlier stage.  Texts go to Python in batches
of bounded bytes.

Defined cases are those of the operators: a null text has no words and goes
at the first stage; repeated rows are near-duplicates, of which one stays;
extra columns of the input are dropped; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modspark.llm import bpe, decontam, quality_rules, secrets, simhash
from modspark.llm.common import read_table, stored
from modspark.session import bound_batches

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def bounded(stage: Stage) -> Stage:
    """The stage, with its texts in batches of bounded bytes."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bound_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


@bounded
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: rejected documents go.  The model learns from the
    labelled ones among the documents at hand."""
    docs = docs.select(*COLUMNS)
    model = quality_rules.fit(docs, read_table(spark, sf_dir, "labels"))
    return quality_rules.judge(docs, model).filter("kept").select(*COLUMNS)


@bounded
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash: of every near-duplicate class the document with the smallest
    id stays (4-word shingles, up to 4 differing bits)."""
    return simhash.keep_one(docs.select(*COLUMNS), shingle=4, max_bits=4)


@bounded
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.drop_leaks(docs.select(*COLUMNS), read_table(spark, sf_dir, "benchmark"))


@bounded
def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; the documents stay."""
    out = secrets.redact(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


@bounded
def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE: texts become token ids, with counts and digests."""
    return bpe.encode(docs.select(*COLUMNS), bpe.vocabulary())


STAGES = [
    ("quality_rules", quality),
    ("simhash_dedup", near_duplicates),
    ("decontaminate", decontaminate),
    ("secrets", remove_secrets),
    ("bpe", token_ids),
]

#: The trained quality model and the latent space cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{name}")
    return docs
