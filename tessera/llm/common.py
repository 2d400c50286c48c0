"""Column helpers and small plumbing shared by the training-data operators."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
BLANKS = r"[\x20\x09-\x0D]+"
#: Keys of more than one in so many rows get salted, and over so many tasks.
HOT_SHARE, SALTS = 1000, 64
#: Bytes of an Arrow batch, whatever the length of its texts.
BATCH_BYTES = 16 << 20


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` is called so (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken or f"{name}_".lower() in taken:
        name += "_0"
    return name


def words(c: Column) -> Column:
    """Array of the maximal runs of characters that are not blanks (space, tab, line ends)."""
    return F.filter(F.split(c, BLANKS, -1), lambda w: w != "")


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the decimal doc_id, modulo ``modulus``; a null id counts as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


#: Where steps are written in a local session that names no folder.
_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.  Where it is unset, a session whose
    executors are threads of the driver gets a temp folder; a cluster must name one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if context.applicationId not in _local:
            _local[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="spark-tessera-")
        root = _local[context.applicationId]
    return root.rstrip("/")


def cut(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back.

    Used where one result feeds several later steps: it is computed once, its lineage ends there,
    and a lost executor costs nothing that was already written.  What is written lies below
    ``shared_dir(spark)/tessera``; results read from it until they are consumed, so whoever has
    consumed them calls ``clear``.
    """
    path = f"{shared_dir(df.sparkSession)}/tessera/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Remove all written steps.  For callers that are through with every result made so far."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tessera")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def salted_join(left: DataFrame, right: DataFrame, key: list[str], by: list[str], how: str = "inner", hot: DataFrame | None = None) -> DataFrame:
    """``left`` joined with ``right`` on ``key``, keys of very many left rows dealt over SALTS tasks.

    Those are the keys of more than one in HOT_SHARE of left's rows - fewer than HOT_SHARE by that
    definition, so their hashes are told by a list and no row is joined to be marked; ``hot`` gives them
    where they are known already.  Their left rows are dealt by the hash of ``by``, their right rows
    repeated for each salt; a key of the same hash is dealt alike on both sides.  ``left`` is read twice."""
    if hot is None:
        n = left.count()
        hot = left.groupBy(*key).agg(F.count(F.lit(1)).alias("__c")).where(F.col("__c") * HOT_SHARE > n).select(*key)
    kinds = dict(left.dtypes)
    named = F.xxhash64(*[F.col(k).cast(kinds[k]) for k in key])
    found = [r[0] for r in hot.select(named).collect()]
    if not found:
        return left.join(right, key, how)
    salt = F.when(named.isin(found), F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    salts = F.when(named.isin(found), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return left.withColumn("__salt", salt).join(right.withColumn("__salt", F.explode(salts)), [*key, "__salt"], how).drop("__salt")


def small_batches(spark: SparkSession, rows: int = 500, most: int = BATCH_BYTES) -> None:
    """Keep Arrow batches small: documents may be long, and a worker holds a whole batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))


#: Of this worker: whose tables it holds, what they were made of, and the tables.
_held: tuple[str, object, object] = ("", None, None)


def worker_holds(name: str, of=None, make: Callable[[], object] = lambda: None):
    """What ``make`` makes of ``of`` for the step ``name``, once in a worker for all its tasks.

    Workers outlive a step, so they hold the tables of one step at a time: those of another are given up."""
    global _held
    if _held[0] != name or _held[1] != of:
        _held = ("", None, None)  # before the new ones are made
        gc.collect()  # tables may refer to themselves
        pa.default_memory_pool().release_unused()
        _held = (name, of, make())
    return _held[2]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def asset(path: str) -> str:
    """Name of a data file inside the installed tokenizer package."""
    import public_tokenizers

    return path if os.path.isabs(path) else public_tokenizers.path(path)
