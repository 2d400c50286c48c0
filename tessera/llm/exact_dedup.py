"""Exact deduplication (operator 3), with DataFrame functions only.

Each text is merged three times, and the whole text is part of the grouping key each time: inside its
task (the partial aggregate), over digest and salt (so a text with very many copies is spread over
``salts`` tasks), and finally over the digest among the salts' winners.  Rows then look up their
winner by digest.  Groups above a thousandth of all rows - fewer than a thousand by that very
definition - are broadcast, so no lookup key holds more than a thousandth of the rows.  Should two
texts share a digest, their rows are looked up by the text as well.

Edge cases: null and empty texts are equal; among equal texts the largest id stays (null ids lose to
any other; if all are null ``keep_id`` is null and nothing of the group is kept); rows repeated with
the same id and text are all kept or all dropped; texts that share an id are judged one by one; other
columns are not looked at, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut, read, text_or_empty, unused

SALTS = 8
HOT_SHARE = 1000


def _digest(c: Column) -> Column:
    return F.unhex(F.sha2(c, 256))


def winners(df: DataFrame, doc_id: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = _digest, salts: int = SALTS) -> DataFrame:
    """One row per distinct normalised text: digest ``d``, ``norm``, ``keep_id``, ``group_size``."""
    rows = df.select(F.col(doc_id).alias("id"), ascii_lower(text_or_empty(text)).alias("norm")).select("id", "norm", digest(F.col("norm")).alias("d"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("byte"))
    local = salted.groupBy("d", "salt", "norm").agg(F.max("id").alias("id"), F.count(F.lit(1)).alias("n"))
    return local.groupBy("d", "norm").agg(F.max("id").alias("keep_id"), F.sum("n").alias("group_size"))


def dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = _digest, salts: int = SALTS) -> DataFrame:
    """Every row of ``df`` as doc_id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``."""
    found = winners(df, doc_id, text, digest, salts)
    # the text is carried on only where its digest is not its own
    shared = found.groupBy("d").agg(
        F.count(F.lit(1)).alias("texts"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size")
    )
    shared = cut(shared, "dedup-groups")
    single = shared.where("texts = 1").select("d", "keep_id", "group_size")
    # read once more, for digests alone, which both ways of looking up then share
    rows = df.select(F.col(doc_id).alias("doc_id"), ascii_lower(text_or_empty(text)).alias("norm"))
    rows = cut(rows.select("doc_id", digest(F.col("norm")).alias("d"), F.unhex(F.sha2("norm", 256)).alias("sha")), "dedup-rows")
    rows = rows.select("doc_id", "d", F.lower(F.hex("sha")).alias("text_sha256"))
    n_rows = rows.count()
    hot = single.where(F.col("group_size") * HOT_SHARE > n_rows).select(
        F.col("d").alias("hot_d"), F.col("keep_id").alias("hot_id"), F.col("group_size").alias("hot_size")
    )
    marked = rows.join(F.broadcast(hot), rows["d"] == hot["hot_d"], "left")
    done = marked.where("hot_d is not null").select("doc_id", F.col("hot_id").alias("keep_id"), F.col("hot_size").alias("group_size"), "text_sha256")
    rest = marked.where("hot_d is null").select("doc_id", "d", "text_sha256").join(single.where(F.col("group_size") * HOT_SHARE <= n_rows), "d")
    out = done.unionByName(rest.select("doc_id", "keep_id", "group_size", "text_sha256"))
    if not shared.where("texts > 1").isEmpty():
        clash = shared.where("texts > 1").select("d")
        again = df.select(F.col(doc_id).alias("doc_id"), ascii_lower(text_or_empty(text)).alias("norm"))
        again = again.withColumn("d", digest(F.col("norm"))).join(clash, "d", "left_semi")
        held = found.join(clash, "d", "left_semi").select("norm", "keep_id", "group_size")
        out = out.unionByName(again.join(held, "norm").select("doc_id", "keep_id", "group_size", F.sha2("norm", 256).alias("text_sha256")))
    kept = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False))
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def keep_one(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with all their columns; rows without an id stay.

    What goes is a row, named by its id and its text: another text under the same id stays."""
    by_id, by_text = unused(df, "__gone"), unused(df, "__gone_text")
    gone = dedup(df, doc_id, text).where("not kept and doc_id is not null").select(F.col("doc_id").alias(by_id), F.unhex("text_sha256").alias(by_text)).distinct()
    same = (F.col(doc_id) == F.col(by_id)) & (F.unhex(F.sha2(ascii_lower(text_or_empty(text)), 256)) == F.col(by_text))
    return df.join(gone, same, "left_anti")


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(read(spark, sf_dir, "documents"))


OP3_SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
), g AS (
  SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm
)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g USING (norm)
"""
