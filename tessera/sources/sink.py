"""Writing planned files, inside one folder only, and events, each once."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .files import opened


def inside(path: str) -> str:
    """``path`` without empty and ``.`` parts; absolute paths, and those that lead out, are refused."""
    parts = [p for p in path.split("/") if p not in ("", ".")]
    if path.startswith("/") or ".." in parts or not parts:
        raise ValueError(f"{path!r} leads out of the folder")
    return "/".join(parts)


def plain(path: Column) -> Column:
    """``inside`` for columns: different spellings of one file become one."""
    parts = F.filter(F.split(path, "/", -1), lambda p: ~p.isin("", "."))
    bad = path.startswith("/") | F.array_contains(parts, "..") | (F.size(parts) == 0)
    return F.when(bad, F.raise_error(F.concat(path, F.lit(" leads out of the folder"))).cast("string")).otherwise(F.array_join(parts, "/"))


def write_planned(plan: DataFrame, root: str, order: list[str] | None = None) -> None:
    """Write planned (path, content) below ``root``, a path or URI that all executors see.

    Of several contents for one file the last by ``order`` is written, and no other.  Each file is
    written under a name of its own and then renamed, so readers see the whole file or none, and a task
    that is run twice leaves one file."""
    rows = plan.where("path is not null and content is not null").withColumn("path", plain(F.col("path")))
    last = F.max_by("content", F.struct(*order)) if order else F.max("content")
    once = rows.groupBy("path").agg(last.alias("content"))

    def write(rows: Iterator) -> None:
        system, at = opened(root)
        for row in rows:
            *folder, name = row.path.split("/")
            folder = "/".join([at.rstrip("/"), *folder])
            system.create_dir(folder, recursive=True)
            waiting = f"{folder}/.{name}.{uuid.uuid4().hex}"
            try:
                with system.open_output_stream(waiting) as f:
                    f.write(row.content.encode("utf-8", "replace"))
                system.move(waiting, f"{folder}/{name}")
            except BaseException:
                if system.get_file_info(waiting).type != fs.FileType.NotFound:
                    system.delete_file(waiting)
                raise

    once.foreachPartition(write)


def write_events(events: DataFrame, path: str, batch_id: int = 0) -> None:
    """Events as lines of JSON, each (session, seq) of a batch once.

    A batch has a folder of its own, which a retried batch replaces; ``read_events`` reads them all."""
    events.dropDuplicates(["session", "seq"]).write.mode("overwrite").json(f"{path.rstrip('/')}/batch={batch_id}")


def event_sink(path: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: a batch that is run again after a failure leaves its events once."""
    return lambda events, batch_id: write_events(events, path, batch_id)


def read_events(spark, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema + ", batch long").json(path).drop("batch")
