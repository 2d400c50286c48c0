"""Decoder and reducer as streams: chunks and events in any order, and state that goes after silence."""

import time

import pytest

from tessera.operators import events, sse
from tessera.streaming import events as event_stream
from tessera.streaming import sse as sse_stream
from tessera.streaming.run import replay, shared

CHUNK = "resp_id long, chunk_no long, bytes binary"
EVENT = "session string, seq long, type string, content string, message string, file_path string"
LINES = "".join(f'data: {{"choices":[{{"delta":{{"content":"{t}"}}}}]}}\n\n' for t in ("é", "b", "이", "d")).encode()
EVENTS = [
    ("a", 0, "token", "x", None, None), ("a", 1, "token", None, None, None), ("a", 2, "fileCreated", None, None, "p.md"), ("a", 3, "token", "y", None, None), ("a", 4, "done", None, None, None),
    ("a", 5, "done", None, None, None), ("a", 6, "error", None, "bad", None), ("a", 7, "token", "z", None, None), ("a", 8, "error", None, None, None), ("a", 9, "fileCancelled", None, None, "q"),
    ("b", 0, "fileError", None, "no", "r"), ("b", 1, "token", "open", None, None),
]


def chunks():
    cut = lambda r, text, k: [(r, i, text[i * k : (i + 1) * k]) for i in range(-(-len(text) // k))]
    return cut(1, LINES + b"data: [DONE]\n" + LINES, 17) + cut(2, LINES, 29) + [(3, 0, b"")]


@pytest.mark.parametrize("back", [False, True])
def test_any_order(spark, back):
    sse_rows = spark.createDataFrame(sorted(chunks(), key=lambda r: r[1], reverse=back), CHUNK).coalesce(1).repartition(9)
    got = sorted(map(tuple, replay(sse_rows, lambda c: sse_stream.decode_stream(c, None)).collect()))
    assert got == sorted(map(tuple, sse.decode_sse(sse_rows).collect())) and len(got) == 8
    told = spark.createDataFrame(sorted(EVENTS, key=lambda r: r[1], reverse=back), EVENT).coalesce(1).repartition(9)
    columns = ["session", "start_seq", "role", "subtype", "content", "is_error"]
    want = events.reduce_events(told).where("not streaming").select(*columns).collect()
    got = replay(told, lambda e: event_stream.reduce_stream(e, None)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, map(tuple, want))) and len(got) == 6


@pytest.mark.parametrize("kind", ["chunks", "events"])
def test_state_goes_after_silence(spark, kind):
    """Of responses with and without a terminator and a chunk that never comes; of open and closed answers."""
    rows, schema, through = (chunks() + [(4, 1, b"x")], CHUNK, sse_stream.decode_stream) if kind == "chunks" else (EVENTS + [("c", 3, "done", None, None, None)], EVENT, event_stream.reduce_stream)
    root = shared(spark)
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{root}/in")
    out = through(spark.readStream.schema(schema).parquet(f"{root}/in"), idle_ms=1)
    query = out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/log").trigger(processingTime="200 milliseconds").start()
    try:
        until, kept, keys = time.time() + 60, set(), len({r[0] for r in rows})
        while time.time() < until and not {0, keys} <= kept:
            kept |= {s.numRowsTotal for p in query.recentProgress for s in p.stateOperators if kept or s.numRowsTotal}
            time.sleep(0.2)
        assert {0, keys} <= kept  # every key's state was there and is gone
    finally:
        query.stop()
