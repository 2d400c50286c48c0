"""Inputs of the registered queries, derived from the given tables over all their rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.routing import IMPORT_RULES, PATH_RULES

#: Documents that rules point to; the first document ids stand for them.
TARGETS = tuple(dict.fromkeys([t for _, t in PATH_RULES] + [t for _, t in IMPORT_RULES]))[:-2]
INDEX = """# index
- keywords: [Tion, NTHE]
  files: [patterns/router.md, docs/20.md]
- keywords: [ , ]
  files: [docs/21.md]
- keywords: [ment, que]
  files: [docs/22.md, missing.md,
    patterns/api-call.md]
- keywords: [UNG]
  files: [docs/23.md, patterns/router.md]
- keywords: [qwxz]
  files: [docs/24.md]
"""
FOLDERS = ("src\\Domains\\a", "src/pages/", "x/router/", "x/hooks/", "x/providers/", "platform", "misc")
#: Folders of a written tree; hidden ones and those that begin with an underscore are read too.
TREE = ("", "a/b/", "_in/", ".h/")
#: Endpoints as settings may have them; the last is none.
ENDPOINTS = ("http://Localhost:11434", "https://h.example:443/base/x?y", " HTTP://a:80#z", "nothing")
IMPORTS = ("import { Button } from 'ui';", "  import { useApi } from '@core/hooks';\nimport x from 'zod';", "const a = 1; // Table", "import { MyTable, Label } from 'ui';\nimport create from 'zustand'; // create( store", "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rel(doc_id: Column) -> Column:
    names = F.array(*[F.lit(t) for t in TARGETS])
    return F.when(doc_id < len(TARGETS), F.get(names, doc_id.cast("int"))).otherwise(F.concat(F.lit("docs/"), doc_id.cast("string"), F.lit(".md")))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(rel(F.col("doc_id")).alias("rel"), F.col("text").alias("content"))


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with headers: lines that begin with A to M become second-level headers."""
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", "(^|\n)([A-M])", "$1## $2").alias("text"))


def pick(values: tuple[str, ...], at: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), at.cast("int"))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of a user, whole; the conversation and the turn make its key."""
    turns = table(spark, sf_dir, "conversations").where("role = 'user'")
    return turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "conv_id", "turn", "text")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's turn, with an open file and the vector of its conversation's number, if there is one."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    out = asked(spark, sf_dir).select(
        "query_id", "conv_id", F.col("text").alias("query"),
        F.concat(pick(FOLDERS, F.col("conv_id") % len(FOLDERS)), F.lit("/f.tsx")).alias("file_path"),
        pick(IMPORTS, F.col("conv_id") % len(IMPORTS)).alias("file_content"),
    )
    return out.join(vectors, F.col("conv_id") == F.col("vec_id"), "left").drop("conv_id", "vec_id")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk for each vector: the document of its number, an odd one with the separator at its end."""
    docs = table(spark, sf_dir, "documents")
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    text = F.concat(F.col("text"), F.when(F.col("doc_id") % 2 == 1, F.lit("\n\n---")).otherwise(F.lit("")))
    return docs.join(vectors, F.col("doc_id") == F.col("vec_id")).select(
        rel(F.col("doc_id")).alias("source"), F.lit(0).alias("sec_pos"), F.lit(0).alias("piece_pos"), text.alias("text"), "embedding", "vec_id",
    )


def sse_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn's text as a recorded response: frames of up to 40 characters, a comment, a broken and an
    empty frame, the terminator, a frame after it and an unended line; cut into chunks of 100 bytes."""
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("resp_id"), "text")
    frame = lambda x: F.concat(F.lit("data: "), F.to_json(F.struct(F.array(F.struct(F.struct(x.alias("content")).alias("delta"))).alias("choices"))), F.lit("\n"))
    parts = F.transform(F.sequence(F.lit(0), F.length("text") - 1, F.lit(40)), lambda i: frame(F.substring(F.col("text"), i + 1, F.lit(40))))
    tail = F.concat(F.lit(": note\ndata: {\n"), frame(F.lit("")), F.lit("data:[DONE]\n"), frame(F.lit("late")), F.lit("data: cut"))
    stream = turns.select("resp_id", F.concat(F.array_join(parts, ""), tail).cast("binary").alias("b"))
    cuts = F.transform(F.sequence(F.lit(0), F.length("b") - 1, F.lit(100)), lambda i: F.substring(F.col("b"), i + 1, F.lit(100)))
    return stream.select("resp_id", F.posexplode(cuts).alias("chunk_no", "bytes")).withColumn("chunk_no", F.col("chunk_no").cast("long"))


#: Kinds of event by event_id modulo 13.
KINDS = ("token", "token", "token", "done", "token", "fileCreated", "token", "error", "status", "done", "fileError", "fileCancelled", "error")


def ui_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as user-interface events, one session for each user, numbered by event_id."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("session"),
        (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).cast("long").alias("seq"),
        pick(KINDS, F.col("event_id") % len(KINDS)).alias("type"),
        F.concat("event_type", F.lit(" ")).alias("content"), F.col("event_type").alias("message"), F.col("event_type").alias("text"),
        F.concat(F.lit("src/"), F.col("event_id").cast("string")).alias("file_path"),
    )
    return e


#: Kinds of event by event_id modulo 11, where users send messages while models answer.
TALK = ("send", "token", "token", "send", "token", "done", "stop", "token", "error", "token", "send")


def talk_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as messages and answers, one session for each user: some messages are blank, and every
    seventh event replies to a message that is three events old at least."""
    from pyspark.sql import Window

    n = F.col("event_id")
    w = Window.partitionBy("user_id").orderBy("event_id")
    kind = pick(TALK, n % len(TALK)).alias("type")
    e = table(spark, sf_dir, "events").select("user_id", n, kind, (F.row_number().over(w) - 1).cast("long").alias("seq"), F.when(n % 5 == 0, F.lit(" \n")).otherwise(F.concat("event_type", F.lit(" "))).alias("content"))
    sent = F.when(F.col("type") == "send", F.col("seq"))
    last, older = (F.max(sent).over(w.rowsBetween(Window.unboundedPreceding, -k)) for k in (1, 3))
    reply = F.when(F.col("type").isin("token", "done", "error"), F.when(n % 7 == 0, older).otherwise(last))
    return e.select(F.col("user_id").cast("string").alias("session"), "seq", "type", reply.alias("reply_to"), "content")


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers made of parts: blocks good and bad, with and without code."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    meta = lambda action, kind: F.concat(F.lit('{"action":"' + action + '","templateType":"' + kind + '","domain":"d","componentName":"C'), k.cast("string"), F.lit('","filePath":"src/'), k.cast("string"), F.lit('.tsx"}'))
    code = F.concat(F.lit("\n```tsx\nconst n = '"), F.col("p_name"), F.lit("';  \n\n```\n"))
    block = lambda body: F.concat(F.lit("<file-action>\n"), body, F.lit("</file-action>"))
    one = block(F.concat(meta("createFile", "page"), F.when(k % 2 == 0, code).otherwise(F.lit("\n"))))
    two = block(F.when(k % 5 == 0, F.lit("no metadata")).when(k % 5 == 1, F.lit('{"a":{"b":1}}')).otherwise(F.concat(meta("updateFile", "router"), code)))
    return p.select(k.alias("resp_id"), F.concat(F.lit(" Here: "), "p_name", F.lit("\n"), one, F.lit("\nand\n"), two, F.when(k % 7 == 0, F.lit("\n<file-action>open")).otherwise(F.lit("\n"))).alias("text"))


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The user's answers: some cancel, some edit the path, some files exist."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        k.alias("resp_id"), F.lit(0).alias("action_no"),
        F.when(k % 3 != 0, F.concat(F.lit(" src/"), k.cast("string"), F.lit(".tsx "))).alias("edited_path"),
        (k % 4 == 0).alias("file_exists"), (k % 8 == 0).alias("overwrite_ok"),
    )
