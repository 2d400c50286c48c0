"""User-interface events folded into messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: File events and the kinds of system message they leave.
SUBTYPES = {"fileCreated": "file-created", "fileUpdated": "file-updated", "fileError": "file-error", "fileCancelled": "file-cancelled"}


def reduce_events(events: DataFrame) -> DataFrame:
    """Messages of events (session, seq, type, content, message, file_path).

    A token opens an answer if none is open, else adds to it; ``done`` closes it; ``error`` turns the
    open answer into an error, or adds one; file events add system messages and leave the answer open.
    Rows: ``session, start_seq, role, subtype, content, is_error, streaming``."""
    w = Window.partitionBy("session").orderBy("seq")
    talk = events.where(F.col("type").isin("token", "done", "error"))
    before = F.lag("type").over(w)
    opens = (F.col("type") == "token") & (before.isNull() | (before != "token"))
    lone = (F.col("type") == "error") & (before.isNull() | (before != "token"))
    talk = talk.withColumn("no", F.sum(F.when(opens | lone, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    talk = talk.withColumn("idle", (F.col("type") == "done") & (before.isNull() | (before != "token")))
    ordered = F.array_sort(F.collect_list(F.when(F.col("type") == "token", F.struct("seq", "content"))))
    answers = talk.where("not idle").groupBy("session", "no").agg(
        F.min("seq").alias("start_seq"),
        F.array_join(F.transform(ordered, lambda x: F.coalesce(x["content"], F.lit(""))), "").alias("said"),
        F.max(F.when(F.col("type") == "error", F.concat(F.lit("오류: "), F.coalesce("message", F.lit(""))))).alias("failed"),
        F.bool_or(F.col("type") != "token").alias("closed"),
    )
    answers = answers.select(
        "session", "start_seq", F.lit("assistant").alias("role"), F.lit(None).cast("string").alias("subtype"),
        F.coalesce("failed", "said").alias("content"), F.col("failed").isNotNull().alias("is_error"), (~F.col("closed")).alias("streaming"),
    )
    kinds = F.create_map(*[F.lit(x) for kv in SUBTYPES.items() for x in kv])
    files = events.where(F.col("type").isin(*SUBTYPES)).select(
        "session", F.col("seq").alias("start_seq"), F.lit("system").alias("role"), F.element_at(kinds, F.col("type")).alias("subtype"),
        F.when(F.col("type") == "fileError", F.col("message")).when(F.col("type") == "fileCancelled", F.lit("")).otherwise(F.col("file_path")).alias("content"),
        (F.col("type") == "fileError").alias("is_error"), F.lit(False).alias("streaming"),
    )
    return answers.unionByName(files)


#: What the status line says while a model answers, and after an error.
ANSWERING, FAILED = " 응답 중…", "오류 발생"


def exchange_events(tokens: DataFrame, outcomes: DataFrame) -> DataFrame:
    """``resp_id, seq, type, text`` of what a user interface is told of each response.

    ``tokens`` (resp_id, seq, token); ``outcomes`` (resp_id, model, outcome, message): an ``error`` ends
    in its message, ``ok`` and ``aborted`` answers in ``done``; the status line is set before and after."""
    failed = F.col("outcome") == "error"
    said = tokens.select("resp_id", F.lit(1).alias("step"), F.col("seq").cast("long").alias("at"), F.lit("token").alias("type"), F.col("token").alias("text"))
    row = lambda step, kind, text: F.struct(F.lit(step).alias("step"), F.lit(0).cast("long").alias("at"), kind.alias("type"), text.alias("text"))
    frame = F.array(
        row(0, F.lit("status"), F.concat("model", F.lit(ANSWERING))),
        row(2, F.when(failed, "error").otherwise("done"), F.when(failed, F.col("message"))),
        row(3, F.lit("status"), F.when(failed, F.lit(FAILED)).otherwise(F.col("model"))),
    )
    told = said.unionByName(outcomes.select("resp_id", F.inline(frame)))
    seq = F.row_number().over(Window.partitionBy("resp_id").orderBy("step", "at")) - 1
    return told.select("resp_id", seq.alias("seq"), "type", "text")


def last_status(events: DataFrame) -> DataFrame:
    return events.where("type = 'status'").groupBy("session").agg(F.max_by("text", "seq").alias("status"))


def after_clear(events: DataFrame) -> DataFrame:
    """Events after their session's last ``clear``."""
    last = events.where("type = 'clear'").groupBy(F.col("session").alias("s")).agg(F.max("seq").alias("cleared"))
    return events.join(last, F.col("session") == F.col("s"), "left").where("cleared is null or seq > cleared").drop("s", "cleared")


def until_abort(tokens: DataFrame, aborts: DataFrame) -> DataFrame:
    """Tokens (resp_id, seq) before their response's ``aborted_at_seq``, if it was aborted."""
    a = aborts.select(F.col("resp_id").alias("r"), "aborted_at_seq")
    return tokens.join(a, F.col("resp_id") == F.col("r"), "left").where("aborted_at_seq is null or seq < aborted_at_seq").drop("r", "aborted_at_seq")
