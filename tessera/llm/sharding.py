"""Reproducible shuffle into shards (operator 2), with DataFrame functions only.

Rows get global row numbers in the order of their key, whatever the file layout: a hash deals them
into buckets, the buckets' counts give each bucket's first number, and a window numbers the rows
inside.  A Feistel network over the pair (number div b, number mod b) permutes the numbers; values
past the row count walk on along their cycle until they fall inside.  Shard and slot are then the
remainder and quotient by the shard count, so both can be computed from a row's number alone, shard
sizes differ by at most one and slots have no gaps.

Rows with one and the same key are dealt over several tasks where they are more than a thousandth of
the table.  The number of buckets follows the table's size.

Edge cases: a null text has size 1 and the checksum of the empty text; a null key sorts first; rows
that tie in all key columns are interchangeable; input columns named like the two outputs are
replaced, all others are kept, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import HOT_SHARE, SALTS, read, text_or_empty, unused

#: Rows of a bucket, about; a bucket's rows are sorted in one task.
BUCKET_ROWS = 100_000
ROUNDS = 4
#: Walks tried. Domains have fewer than sqrt(N) values too many, so for N <= 1024 this always
#: suffices, and beyond that the odds against it are below N * N**-16.
WALKS = 32


def number_rows(df: DataFrame, order: list[str], number: str, total: str, buckets: int | None = None) -> DataFrame:
    """``df`` with ``number`` (from 0) and ``total`` rows, numbered by hash bucket and then ``order``."""
    name = lambda x: unused(df, f"__{x}")
    bucket, many, salt, start = name("bucket"), name("many"), name("salt"), name("start")
    n_rows = df.count()
    buckets = buckets or max(1, -(-n_rows // BUCKET_ROWS))
    key = F.xxhash64(*order)
    # a key of more than a thousandth of the rows is a bucket of its own, dealt in salts
    often = df.groupBy(key.alias(many)).agg(F.count(F.lit(1)).alias(start)).where(F.col(start) * HOT_SHARE > n_rows).where(F.col(start) > buckets)
    dealt = df.withColumn(salt, key).join(F.broadcast(often.select(many)), F.col(salt) == F.col(many), "left")
    dealt = dealt.withColumn(bucket, F.pmod(F.col(salt), F.lit(buckets)).cast("int"))
    dealt = dealt.withColumn(salt, F.when(F.col(many).isNull(), 0).otherwise(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS))).cast("int"))
    dealt = dealt.withColumn(many, F.coalesce(many, F.lit(0)))
    parts = [bucket, many, salt]
    counts = dealt.groupBy(*parts).agg(F.count(F.lit(1)).alias(start))
    # a row for each bucket, and for each salt of fewer than a thousand keys
    before = Window.orderBy(*parts).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(c).alias(f"{c}_") for c in parts], F.coalesce(F.sum(start).over(before), F.lit(0)).alias(start))
    numbered = dealt.withColumn(number, F.row_number().over(Window.partitionBy(*parts).orderBy(*order)) - 1)
    same = [F.col(c) == F.col(f"{c}_") for c in parts]
    joined = numbered.join(F.broadcast(starts), reduce(and_, same))
    joined = joined.withColumns({number: F.col(start) + F.col(number), total: F.lit(n_rows).cast("long")})
    return joined.drop(*parts, *[f"{c}_" for c in parts], start)


def permuted(number: Column, n_rows: Column, seed: int) -> Column:
    """Image of ``number`` under the seed's permutation of 0 .. n_rows - 1."""
    a = F.ceil(F.sqrt(n_rows.cast("double"))).cast("long")
    b = F.floor((n_rows + a - 1) / a).cast("long")

    def network(x: Column) -> Column:
        left, right = F.floor(x / b).cast("long"), F.pmod(x, b)
        pair = F.struct(left.alias("l"), right.alias("r"))
        keys = F.array(*[F.lit(seed * 1009 + k).cast("long") for k in range(ROUNDS)])

        def turn(p: Column, k: Column) -> Column:
            mixed = F.pmod(p["l"] + F.pmod(F.xxhash64(k, p["r"]), a), a)
            return F.struct(mixed.alias("l"), F.pmod(p["r"] + F.pmod(F.xxhash64(k, F.lit("r"), mixed), b), b).alias("r"))

        return F.aggregate(keys, pair, turn, lambda p: p["l"] * b + p["r"])

    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALKS)),
        network(number),
        lambda x, _: F.when(x < n_rows, x).otherwise(network(x)),
    )
    return F.when(walked < n_rows, walked).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("long"))


def shard_rows(df: DataFrame, key: list[str], shards: int = 16, seed: int = 17, buckets: int | None = None) -> DataFrame:
    """``df`` with ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard)."""
    place, total = unused(df, "__place"), unused(df, "__total")
    numbered = number_rows(df, key, place, total, buckets)
    placed = numbered.withColumn(place, permuted(F.col(place), F.col(total), seed))
    return placed.withColumns({
        "shard": F.pmod(F.col(place), F.lit(shards)).cast("int"),
        "slot": F.floor(F.col(place) / shards).cast("long"),
    }).drop(place, total)


def op2_shards(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(text_or_empty().cast("binary")).alias("text_crc32"),
    )
    return shard_rows(docs, ["doc_id", "size", "text_crc32"]).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
