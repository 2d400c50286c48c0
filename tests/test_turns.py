"""What becomes of messages sent while answers arrive: by hand, as a stream, and the stream's forgotten sessions."""

import time

import pytest

from tessera.operators import turns
from tessera.streaming import turns as turn_stream
from tessera.streaming.run import replay, shared

SCHEMA = "session string, seq long, type string, reply_to long, content string"
EVENTS = [
    ("a", 0, "send", None, "one"), ("a", 1, "send", None, "two"), ("a", 2, "token", 0, "late"), ("a", 3, "token", 1, "x"), ("a", 4, "send", None, "three"),
    ("a", 5, "token", 4, "no"), ("a", 6, "token", 1, None), ("a", 7, "token", 1, "y"), ("a", 8, "done", 1, None), ("a", 9, "token", 1, "after"), ("a", 10, "stop", None, None),
    ("a", 11, "send", None, " \n　"), ("a", 12, "send", None, "four"), ("a", 13, "token", 12, "z"), ("a", 14, "stop", None, None), ("a", 15, "token", 12, "w"),
    ("a", 16, "send", None, "five"), ("a", 17, "error", 16, "bad"), ("a", 18, "send", None, "six"), ("a", 19, "token", 18, "q"),
    ("b", 0, "token", None, "x"), ("b", 1, "token", 2, "too early"), ("b", 2, "send", None, "hi"), ("b", 3, "done", 2, None), ("b", 4, "send", None, None), ("c", 0, "stop", None, None),
]
WANT = {
    ("a", 0, "superseded", 1, ""), ("a", 1, "done", 8, "xy"), ("a", 4, "ignored", 4, None), ("a", 11, "ignored", 11, None), ("a", 12, "stopped", 14, "z"),
    ("a", 16, "error", 17, ""), ("a", 18, "open", None, "q"), ("b", 2, "done", 3, ""), ("b", 4, "ignored", 4, None),
}


def test_outcomes_by_hand(spark):
    odd = [(None, 0, "send", None, "x"), ("d", None, "send", None, "x"), ("d", 1, None, None, "x")]
    got = turns.message_outcomes(spark.createDataFrame(EVENTS + odd, SCHEMA).repartition(5)).collect()
    assert {tuple(r) for r in got} == WANT and len(got) == len(WANT)
    assert turns.message_outcomes(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("back", [False, True])
def test_stream_in_any_order(spark, back):
    """One event a file, three to a batch, in order or backwards."""
    rows = spark.createDataFrame(sorted(EVENTS, key=lambda r: r[1], reverse=back), SCHEMA).coalesce(1)
    got = replay(rows.repartition(9), lambda e: turn_stream.outcomes_stream(e, None)).collect()
    assert {tuple(r) for r in got} == {w for w in WANT if w[2] != "open"} and len(got) == len(WANT) - 1


def test_silent_sessions_are_forgotten(spark):
    root = shared(spark)
    write = lambda who: spark.createDataFrame([(who, 0, "send", None, "x"), (who, 1, "token", 0, "y"), (who, 3, "done", 0, None)], SCHEMA).coalesce(1).write.mode("append").parquet(f"{root}/in")
    write("a")
    out = turn_stream.outcomes_stream(spark.readStream.schema(SCHEMA).parquet(f"{root}/in"), idle_ms=1)
    query = out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/log").trigger(processingTime="200 milliseconds").start()
    try:
        until, kept = time.time() + 60, set()
        while time.time() < until and not {0, 1} <= kept:
            kept |= {s.numRowsTotal for p in query.recentProgress for s in p.stateOperators if kept or s.numRowsTotal}
            time.sleep(0.2)
        assert kept == {0, 1}  # its state was there and is gone
    finally:
        query.stop()
