"""What becomes of each message a user sends while answers arrive: dropped, superseded, stopped or answered."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import trimmed

OUTCOMES = "session string, seq long, outcome string, ended_seq long"


def turn(current: int, begun: bool, seq: int, kind: str, reply_to: int, blank: bool) -> tuple[int, bool, int, str | None]:
    """One event's effect: the message being answered after it (-1: none), whether its answer has begun,
    and the message that ends by it (if one does) with how.

    A message is ignored if it is blank or while an answer is being told; a message before an answer's
    first token ends the wait for that answer.  Tokens of any other message than the current one are late."""
    if kind == "send":
        if blank or begun:
            return current, begun, seq, "ignored"
        return seq, False, current, "superseded" if current >= 0 else None
    if kind == "stop":
        return -1, False, current, "stopped" if current >= 0 else None
    if current < 0 or reply_to != current:
        return current, begun, -1, None
    return (current, True, -1, None) if kind == "token" else (-1, False, current, kind)


def _walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in order of session and seq; nothing but the current message is kept."""
    session, current, begun = None, -1, False
    columns = [f.split()[0] for f in OUTCOMES.split(", ")]
    for frame in frames:
        out = []
        for who, seq, kind, reply_to, blank in frame[["session", "seq", "type", "reply_to", "blank"]].itertuples(index=False, name=None):
            if who != session:
                if current >= 0:
                    out.append((session, current, "open", None))
                session, current, begun = who, -1, False
            current, begun, ended, how = turn(current, begun, seq, kind, reply_to, blank)
            if how:
                out.append((who, ended, how, seq))
        yield pd.DataFrame(out, columns=columns).astype({"ended_seq": "Int64"})
    if current >= 0:
        yield pd.DataFrame([(session, current, "open", None)], columns=columns).astype({"ended_seq": "Int64"})


def message_outcomes(events: DataFrame) -> DataFrame:
    """``session, seq, outcome, ended_seq, answer`` of every message sent.

    ``events`` (session, seq, type, reply_to, content), numbered uniquely in a session: the user's
    ``send`` and ``stop``, and the model's ``token``, ``done`` and ``error``, each in reply to the number
    of a ``send``.  Outcomes: ``ignored``, ``superseded``, ``stopped``, ``done``, ``error``, or ``open`` (no
    end yet).  ``answer`` is what was told until then, null of an ignored message.  Rows without session,
    number or type, and replies to nothing, say nothing; a null content is empty.

    Of an answer only its first token and its ends decide anything, so texts aren't moved for the walk
    through a session, which sorts its rows and keeps one message's state, however long it is."""
    rows = events.where("session is not null and seq is not null and type is not null")
    user = rows.where("type in ('send', 'stop')").select("session", "seq", "type", F.lit(-1).cast("long").alias("reply_to"), (trimmed(F.coalesce("content", F.lit(""))) == "").alias("blank"))
    model = rows.where("type in ('token', 'done', 'error') and seq > reply_to")
    firsts = model.groupBy("session", "reply_to", "type").agg(F.min("seq").alias("seq")).select("session", "seq", "type", "reply_to", F.lit(False).alias("blank"))
    ordered = user.unionByName(firsts).repartition("session").sortWithinPartitions("session", "seq")
    outcomes = ordered.mapInPandas(_walk, OUTCOMES)
    tokens = model.where("type = 'token'").select("session", F.col("reply_to").alias("of"), F.col("seq").alias("at"), F.coalesce("content", F.lit("")).alias("said"))
    # one pass over the outcomes: each message and its tokens meet by their key
    both = outcomes.select("session", F.col("seq").alias("of"), F.lit(None).cast("long").alias("at"), F.lit(None).cast("string").alias("said"), "outcome", "ended_seq")
    both = both.unionByName(tokens, allowMissingColumns=True)
    met = both.groupBy("session", "of").agg(
        F.max("outcome").alias("outcome"), F.max("ended_seq").alias("ended_seq"), F.array_sort(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "said")))).alias("parts"),
    ).where("outcome is not null")
    told = F.filter("parts", lambda p: F.col("ended_seq").isNull() | (p["at"] < F.col("ended_seq")))
    answer = F.when(F.col("outcome") != "ignored", F.array_join(F.transform(told, lambda p: p["said"]), ""))
    return met.select("session", F.col("of").alias("seq"), "outcome", "ended_seq", answer.alias("answer"))
