"""From raw documents to token ids, in five stages.

Each stage is written as Parquet and read again as the next one's input, so a stage never repeats the
work of those before it and a lost executor costs at most the stage it was busy with.  All stages but
the last return the columns of ``documents``; each works on all that the one before kept.

Edge cases: null and empty texts are judged like any other text (equal to each other, linked with
nothing, clean, no tokens); rows without doc_id are never dropped as copies; texts that share a doc_id
are judged one by one, but as near copies they are one document; further columns pass through all
stages but the last, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, exact_dedup, near_dedup, quality
from tessera.llm.common import read, shared_dir

TOKENIZER = "byte_bpe_50k.json"
#: Words that a worker of the last stage remembers: its executors' memory is still full of the stages before.
TOKENIZER_WORDS = 50_000


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose quality score is below the acceptance threshold."""
    model = quality.learned(spark, docs.select("doc_id", "text"), sf_dir)
    return quality.accepted(docs, model)


def no_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts keep the row with the largest doc_id."""
    return exact_dedup.keep_one(docs)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate class (five words, similarity 0.8 or more)."""
    return near_dedup.keep_one(docs, words=5, percent=80)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold benchmark items."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document left."""
    out = bpe.encode(docs, TOKENIZER, most=TOKENIZER_WORDS)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality", good_quality),
    ("exact_dedup", no_copies),
    ("near_dedup", no_near_copies),
    ("decontaminate", no_benchmark),
    ("bpe", token_ids),
]

#: Training, MinHash and template matching are not SQL's; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    root = f"{shared_dir(spark)}/tessera/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{root}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{root}/{name}")
    return docs
