"""Cosine similarity and top-k retrieval."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import RetrievalConfig
from ..llm.common import small_batches


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, norm_a: Column, norm_b: Column, epsilon: float = 1e-10) -> Column:
    """Zero vectors give 0; both vectors need the same dimension."""
    return dot(a, b) / (norm_a * norm_b + F.lit(epsilon))


def embed_chunks(chunks: DataFrame, embed: Callable[[list[str]], list[list[float]]], text: str = "text") -> DataFrame:
    """``chunks`` with ``embedding``; ``embed`` is called with batches of texts inside the workers, which hold
    one of bounded bytes at a time."""
    small_batches(chunks.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(embedding=list(embed(frame[text].tolist())))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema.fields if f.name != "embedding")
    return chunks.drop("embedding").mapInPandas(run, kinds + ", embedding array<float>")


def cosine_topk(chunks: DataFrame, queries: DataFrame, order: list[str], cfg: RetrievalConfig = RetrievalConfig(), most: int | None = None) -> DataFrame:
    """The ``top_k`` chunks of each query (query_id, vector) by falling score, ties in ``order``.

    Chunks without a vector are left out, and so are scores that are no number.  Queries are dealt into
    blocks of about ``broadcast_rows``, each broadcast, so chunks stay where they are and each task keeps
    its best k of each query.  ``most`` is a bound of the number of queries, which are counted without it."""
    kept = chunks.where(F.col("embedding").isNotNull()).withColumn("__n", norm(F.col("embedding")))
    asked = queries.select("query_id", "vector", norm(F.col("vector")).alias("__m"))
    blocks = max(1, -(-(asked.count() if most is None else most) // cfg.broadcast_rows))
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    found = [_best(kept, asked.where(block == k) if blocks > 1 else asked, order, cfg) for k in range(blocks)]
    return reduce(DataFrame.unionByName, found)


def _best(kept: DataFrame, asked: DataFrame, order: list[str], cfg: RetrievalConfig) -> DataFrame:
    scored = kept.crossJoin(F.broadcast(asked)).withColumn("score", cosine(F.col("embedding"), F.col("vector"), F.col("__n"), F.col("__m"), cfg.epsilon))
    scored = scored.drop("embedding", "vector", "__n", "__m").where(F.col("score").isNotNull() & ~F.isnan("score"))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), *order)
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= cfg.top_k)
