"""Server-sent events: bytes to tokens to answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import trimmed

DONE = "[DONE]"
#: Keys that close the object a payload is put in; one that the payload doesn't hold shows where it ended.
ENDS = ("end0", "end1")
FRAME = "a struct<choices: array<struct<delta: struct<content: variant>>>>, {0} boolean"
#: JSON as the web has it: no constants like NaN, no single quotes; of a key's values the last counts.
STRICT = {"allowNonNumericNumbers": "false", "allowSingleQuotes": "false"}


def payloads(text: Column) -> Column:
    """Array of the data lines' payloads before the terminator; an unended last line is dropped."""
    lines = F.split(text, "\n", -1)
    ended = F.transform(F.slice(lines, 1, F.size(lines) - 1), trimmed)
    data = F.transform(F.filter(ended, lambda x: x.startswith("data:")), lambda x: trimmed(F.substring(x, F.lit(6), F.length(x))))
    return data


def until_done(data: Column) -> Column:
    at = F.array_position(data, DONE).cast("int")
    return F.when(at > 0, F.slice(data, 1, at - 1)).otherwise(data)


def token(payload: Column) -> Column:
    """The frame's first delta, or null where the payload is no JSON or more than one value, or the delta no string or empty.

    A lenient parser stops where the first value ends, so the payload is put in the middle of an object
    whose last key must be found again behind it.  Half a surrogate pair becomes a question mark."""

    def parsed(end: str) -> Column:
        frame = F.from_json(F.concat(F.lit('{"a":'), payload, F.lit(f',"{end}":true}}')), FRAME.format(end), STRICT)
        content = F.get(frame["a"]["choices"], 0)["delta"]["content"]
        said = F.when(F.schema_of_variant(content) == "STRING", F.try_variant_get(content, "$", "string"))
        return F.when(frame[end], F.nullif(said, F.lit("")))

    one, other = ENDS
    return F.when(~F.contains(payload, F.lit(one)), parsed(one)).when(~F.contains(payload, F.lit(other)), parsed(other))


def joined_bytes(chunks: DataFrame) -> DataFrame:
    """``resp_id, text``: a response's chunks (resp_id, chunk_no, bytes) in order, as UTF-8."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", F.hex("bytes").alias("x")))), lambda c: c["x"])
    return chunks.groupBy("resp_id").agg(F.make_valid_utf8(F.unhex(F.array_join(parts, "")).cast("string")).alias("text"))


def decode_sse(chunks: DataFrame) -> DataFrame:
    """``resp_id, seq, token`` of recorded responses, whatever the bounds of their chunks."""
    data = joined_bytes(chunks).select("resp_id", payloads(F.col("text")).alias("data"))
    tokens = data.select("resp_id", F.posexplode_outer(until_done(F.col("data"))).alias("line", "payload")).select("resp_id", "line", token(F.col("payload")).alias("token"))
    from pyspark.sql import Window

    seq = F.row_number().over(Window.partitionBy("resp_id").orderBy("line")) - 1
    return tokens.where(F.col("token").isNotNull()).select("resp_id", seq.alias("seq"), "token")


def fold_tokens(tokens: DataFrame) -> DataFrame:
    """``resp_id, response``: tokens put together in order."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("seq", "token"))), lambda t: t["token"])
    return tokens.groupBy("resp_id").agg(F.array_join(parts, "").alias("response"))
