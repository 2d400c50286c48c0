"""Server-sent events decoded as they arrive, with typed state that ends with its response."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import BLANKS
from .turns import IDLE_MS

OUTPUT = "resp_id long, seq long, token string"
#: Next chunk and token, whether the terminator came, the bytes of an open line, and chunks ahead of a missing one.
STATE = "next_no long, seq long, done boolean, carry binary, waiting array<struct<no: long, data: binary>>"


def _refused(constant: str) -> float:
    raise ValueError(f"{constant} is no JSON")


def frame_token(payload: str) -> str | None:
    """The first delta's content, or None where the frame is no strict JSON, or the content no string or empty."""
    try:
        content = json.loads(payload, parse_constant=_refused)["choices"][0]["delta"]["content"]
    except (ValueError, LookupError, TypeError, RecursionError):
        return None
    # half a surrogate pair is no character: a question mark, as in the batch form
    return content.encode("utf-8", "replace").decode() if isinstance(content, str) and content else None


def decode(idle_ms: int | None) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """The step of one response: its chunks, in whatever order they come, wait until those before are there.

    After the terminator nothing is kept but that it came."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        if state.hasTimedOut:
            state.remove()
        else:
            next_no, seq, done, carry, waiting = state.get if state.exists else (0, 0, False, b"", [])
            held = {r[0]: bytes(r[1]) for r in waiting}
            for frame in frames:
                held.update({int(no): bytes(data) for no, data in zip(frame["chunk_no"], frame["bytes"], strict=True) if no >= next_no})
            while next_no in held and not done:
                *lines, carry = (bytes(carry) + held.pop(next_no)).split(b"\n")
                next_no += 1
                for line in lines:
                    text = line.decode("utf-8", "replace").strip(BLANKS)
                    if done or not text.startswith("data:"):
                        continue
                    payload = text[5:].strip(BLANKS)
                    if payload == "[DONE]":
                        done = True
                    elif (token := frame_token(payload)) is not None:
                        out.append((key[0], seq, token))
                        seq += 1
            state.update((next_no, seq, done, b"" if done else bytes(carry), [] if done else sorted(held.items())))
            if idle_ms is not None:
                state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["resp_id", "seq", "token"])

    return run


def decode_stream(chunks: DataFrame, idle_ms: int | None = IDLE_MS) -> DataFrame:
    """Tokens of a stream of chunks (resp_id, chunk_no, bytes); ``seq`` counts within a response.  A response's
    state goes once it has been silent for ``idle_ms``; a stream that is to end by itself has to be given None."""
    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return chunks.groupBy("resp_id").applyInPandasWithState(decode(idle_ms), OUTPUT, STATE, "append", timeout)
