"""From raw documents to token files: toxic documents go, one of each group of near copies stays, benchmark leaks go,
sources are mixed to their weights, and what remains is written as token ids.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept. All but the last return the columns of
documents; the last returns the index of the token files, read back from them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainspan.llm import decontamination, jaccard, mixing, tokens, toxicity
from chainspan.llm.common import table
from chainspan.llm.queries import TOKENIZER
from chainspan.session import checkpoint_root, recorded, remove


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half."""
    field = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.annotate(docs, field).filter(F.col("__score") < 0.5).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar ones, and all without words."""
    return jaccard.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.cleaned(docs, table(spark, sf_dir, "benchmark"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources meet their target weights."""
    return mixing.mixed(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the token files of all documents."""
    return tokens.index(spark, tokens.write(docs, TOKENIZER))


STAGES = [
    ("toxicity", without_toxic),
    ("jaccard_join", without_near_copies),
    ("decontamination", without_benchmark),
    ("mixing", mixed_sources),
    ("tokens", token_files),
]

# Learned scores, MinHash groups and tokens have no SQL form; tests check each stage by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again by the next."""
    folder = f"{checkpoint_root(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    before = []
    for name, stage in STAGES:
        with recorded() as made:
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        remove(spark, [*made, *before])
        before = [f"{folder}/{name}"]
        docs = spark.read.parquet(*before)
    return docs
