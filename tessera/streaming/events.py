"""User-interface events folded as they arrive, with typed state that ends with its session."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.events import SUBTYPES
from .turns import IDLE_MS

OUTPUT = "session string, start_seq long, role string, subtype string, content string, is_error boolean"
#: Next number, where the open answer began (-1: none), its parts, and events ahead of one that is not there yet.
STATE = "next_seq long, start long, said array<string>, waiting array<struct<seq: long, type: string, content: string, message: string, file_path: string>>"
COLUMNS = [f.split()[0] for f in OUTPUT.split(", ")]


def reduce(idle_ms: int | None) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """The step of one session: messages, once they are closed; events wait for those numbered before them."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        if state.hasTimedOut:
            state.remove()
        else:
            next_seq, start, said, waiting = state.get if state.exists else (0, -1, [], [])
            said, held = list(said), {r[0]: tuple(r[1:]) for r in waiting}
            for frame in frames:
                rows = frame[["seq", "type", "content", "message", "file_path"]].astype(object).where(frame.notna(), None)
                held.update({int(r[0]): r[1:] for r in rows.itertuples(index=False, name=None) if r[0] >= next_seq})
            while next_seq in held:
                kind, content, message, path = held.pop(next_seq)
                if kind == "token":
                    start = next_seq if start < 0 else start
                    said.append(content or "")
                elif kind in ("done", "error", "clear"):  # what a clear finds open is gone; closed messages are out already
                    if kind == "error":
                        out.append((key[0], start if start >= 0 else next_seq, "assistant", None, f"오류: {message or ''}", True))
                    elif kind == "done" and start >= 0:
                        out.append((key[0], start, "assistant", None, "".join(said), False))
                    start, said = -1, []
                elif kind in SUBTYPES:
                    shown = message if kind == "fileError" else "" if kind == "fileCancelled" else path
                    out.append((key[0], next_seq, "system", SUBTYPES[kind], shown, kind == "fileError"))
                next_seq += 1
            state.update((next_seq, start, ["".join(said)] if said else [], [(k, *v) for k, v in sorted(held.items())]))
            if idle_ms is not None:
                state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=COLUMNS)

    return run


def reduce_stream(events: DataFrame, idle_ms: int | None = IDLE_MS) -> DataFrame:
    """Closed messages of a stream of events numbered from 0 in each session.  A session's state goes once it
    has been silent for ``idle_ms``; a stream that is to end by itself (``availableNow``) has to be given None."""
    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return events.groupBy("session").applyInPandasWithState(reduce(idle_ms), OUTPUT, STATE, "append", timeout)
