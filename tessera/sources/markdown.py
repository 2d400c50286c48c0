"""Markdown trees as documents, and snapshots of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import is_folder, list_tree, read_files

SCHEMA = "rel string, content string"


def resolve_source(folders: list[str], bundled: str | None, name: str = ".rag") -> str | None:
    """The first folder's ``name`` directory that exists, else the bundled one, else None."""
    for folder in folders:
        if is_folder(at := f"{folder.rstrip('/')}/{name}"):
            return at
    return bundled if bundled and is_folder(bundled) else None


def read_markdown(spark: SparkSession, root: str | None, partial: bool = False) -> DataFrame:
    """Documents (rel, content) of the ``.md`` files below a folder; a missing folder has none.

    Spark's own file sources skip names that begin with a dot or underscore, so tasks list the tree,
    hidden folders included and links not followed, and other tasks read it.  The folder is a path or
    URI of any file system that Arrow opens and all executors see.  Files named ``_*`` are no
    documents; ``partial`` reads them too."""
    if root is None or not is_folder(root):
        return spark.createDataFrame([], SCHEMA)
    found = list_tree(spark, root, ".md")
    if not partial:
        found = found.where(~F.substring_index("rel", "/", -1).startswith("_"))
    return read_files(found, root)


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """``rel, change`` (created, changed, deleted) between two snapshots (rel, content)."""
    a = old.select(F.col("rel").alias("a"), F.sha2("content", 256).alias("da"))
    b = new.select(F.col("rel").alias("b"), F.sha2("content", 256).alias("db"))
    change = F.when(F.col("a").isNull(), "created").when(F.col("b").isNull(), "deleted").when(F.col("da") != F.col("db"), "changed")
    return a.join(b, F.col("a") == F.col("b"), "full").select(F.coalesce("a", "b").alias("rel"), change.alias("change")).where("change is not null")
