"""Messages and answers as they arrive, with typed state that ends with its session."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import BLANKS
from ..operators.turns import turn

OUTPUT = "session string, seq long, outcome string, ended_seq long, answer string"
#: Next number, current message, whether its answer has begun, that answer's parts, and events ahead of
#: one that is not there yet.
STATE = "due long, current long, begun boolean, said array<string>, waiting array<struct<seq: long, type: string, reply_to: long, content: string>>"
COLUMNS = [f.split()[0] for f in OUTPUT.split(", ")]
#: A session that is silent for so long is forgotten.
IDLE_MS = 24 * 3600 * 1000


def walk(idle_ms: int | None) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """The step of one session: its state and the events that came, to the messages that have ended."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        if state.hasTimedOut:
            state.remove()
        else:
            due, current, begun, said, held = state.get if state.exists else (0, -1, False, [], [])
            said, waiting = list(said), {r[0]: tuple(r[1:]) for r in held}
            for frame in frames:
                for seq, kind, reply_to, content in frame[["seq", "type", "reply_to", "content"]].itertuples(index=False, name=None):
                    if seq >= due:
                        waiting[int(seq)] = (kind, int(reply_to), content or "")
            while due in waiting:
                kind, reply_to, content = waiting.pop(due)
                before = current
                current, begun, ended, how = turn(current, begun, due, kind, reply_to, content.strip(BLANKS) == "")
                if how:
                    out.append((key[0], ended, how, due, None if how == "ignored" else "".join(said)))
                if current != before:
                    said = []
                elif kind == "token" and reply_to == current:
                    said.append(content)
                due += 1
            state.update((due, current, begun, ["".join(said)] if said else [], [(k, *v) for k, v in sorted(waiting.items())]))
            if idle_ms is not None:
                state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=COLUMNS)

    return run


def outcomes_stream(events: DataFrame, idle_ms: int | None = IDLE_MS) -> DataFrame:
    """``message_outcomes`` of messages that have ended, for a stream of events numbered from 0 in each
    session, in any order.  A session's state goes once it has been silent for ``idle_ms``.  A stream that is
    to end by itself (``availableNow``) has to be given None, as timers always ask for another batch."""
    rows = events.where("session is not null and seq is not null").select(
        "session", F.col("seq").cast("long").alias("seq"), F.coalesce("type", F.lit("")).alias("type"), F.coalesce(F.col("reply_to").cast("long"), F.lit(-1)).alias("reply_to"), "content",
    )
    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return rows.groupBy("session").applyInPandasWithState(walk(idle_ms), OUTPUT, STATE, "append", timeout)
