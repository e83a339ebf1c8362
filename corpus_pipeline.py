"""The corpus pipeline: five stages, each one operator over all rows its predecessor kept.

Every stage but the last returns the columns of ``documents``; each is written as Parquet
in the shared folder and read again as the next one's input. The last packs the texts that
are left.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import common, exact_dedup, packing, repeats, simhash, toxicity


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return toxicity.reject(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest doc_id stays."""
    return exact_dedup.keep_first(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the smallest doc_id stays."""
    return simhash.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut from texts."""
    return repeats.without_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become sequences of at most 4096 tokens."""
    import public_tokenizers

    return packing.pack_documents(docs, str(public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_exact),
    ("near_dedup", drop_near),
    ("repeats", cut_repeats),
    ("packing", pack),
]

#: Training a network, and tokenizing, can't be said in SQL. Tests hold the operators of stages 2 to 5 against brute force or
#: the tokenizer itself, and the first by held-out accuracy; the stages together are tested by what must stay and go.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; intermediate tables lie under spark.checkpoint.dir, in one
    folder a run (the last of them is what the result reads, so it outlives this call)."""
    common.ensure_checkpoint_dir(spark)
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{base}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
