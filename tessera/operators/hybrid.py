"""Hybrid retrieval: keyword and context documents first, similarity only where they are too few."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import RetrievalConfig
from ..functions.text import first_by, header, small, split_literal, titled, trimmed
from .nearest import pruned_topk, written
from .routing import RULE_TARGETS, context_targets, keyword_route

#: Bytes of routed documents' texts up to which they are broadcast.
BROADCAST_BYTES = 64 << 20
#: Ways that questions of one document are dealt into beyond that.
SALTS = 64


def named_documents(entries: DataFrame, docs: DataFrame, cfg: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """``rel, header, content`` of the documents that keyword entries or rules can name, one of each name
    (of several the first text), read once."""
    rules = docs.sparkSession.createDataFrame([(t,) for t in RULE_TARGETS], "rel string")
    names = entries.select(F.explode("files").alias("rel")).unionByName(rules).distinct()
    found = docs.select("rel", "content").join(small(names, cfg.broadcast_rows), "rel", "left_semi").groupBy("rel").agg(F.min("content").alias("content"))
    return written(found.select("rel", header(titled(F.col("rel"), F.lit(""))).alias("header"), "content"), "named")


def routed_names(queries: DataFrame, entries: DataFrame, named: DataFrame, cfg: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """``query_id, chosen, n_kw, n_ctx``: names of up to ``max_docs`` documents of each question, those of keywords first,
    and how many either way named.  No text is read: a document's header follows from its name."""
    known = small(named.select("rel", "header", F.col("content").isNotNull().alias("has")), cfg.broadcast_rows)
    targets = queries.select("query_id", F.posexplode(context_targets(F.col("file_path"), F.col("file_content"))).alias("ord", "rel"))
    asked = keyword_route(queries, entries, cfg).withColumn("way", F.lit(0)).unionByName(targets.withColumn("way", F.lit(1)))
    lists = asked.join(known, "rel").groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("way", "ord", "rel", "header", "has"))).alias("all"),
        F.count_if(F.col("way") == 0).alias("n_kw"), F.count_if(F.col("way") == 1).alias("n_ctx"),
    )
    held = F.filter("all", lambda x: x["has"])
    lists = lists.withColumn("held", held).withColumn("heads", F.transform("held", lambda x: x["header"]))
    chosen = F.transform(F.slice(first_by(F.col("held"), F.col("heads")), 1, cfg.max_docs), lambda x: x["rel"])
    return written(lists.select("query_id", chosen.alias("chosen"), "n_kw", "n_ctx"), "routed")


def _with_texts(routed: DataFrame, named: DataFrame) -> DataFrame:
    """``query_id, combined``: the chosen documents' texts, which are broadcast if they are small, else dealt in salts
    as many questions ask for the same few documents."""
    wanted = routed.select("query_id", F.posexplode("chosen").alias("pos", "rel"))
    texts = named.select("rel", titled(F.col("rel"), F.col("content")).alias("doc"))
    size = named.agg(F.sum(F.octet_length("content")).alias("n")).first()["n"] or 0
    if size <= BROADCAST_BYTES:
        met = wanted.join(F.broadcast(texts), "rel")
    else:
        dealt = texts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = wanted.withColumn("salt", F.pmod(F.xxhash64("query_id"), F.lit(SALTS)).cast("int")).join(dealt, ["rel", "salt"])
    return met.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "doc"))), lambda x: x["doc"]).alias("combined"))


def dedupe_first(docs: DataFrame, key: str, order: list[str], doc: str = "doc") -> DataFrame:
    """Rows whose document header is the first of its kind for ``key``."""
    from pyspark.sql import Window

    w = Window.partitionBy(key, "header").orderBy(*order)
    return docs.withColumn("header", header(F.col(doc))).withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def hybrid_context(queries: DataFrame, entries: DataFrame, docs: DataFrame, chunks: DataFrame | None, cfg: RetrievalConfig = RetrievalConfig(), mode: str = "compat") -> DataFrame:
    """One row per query (query_id, query, file_path, file_content, vector): ``docs`` and ``methods``.

    ``compat`` joins the retrieved chunks with the separator and splits them again, so that a chunk
    which holds or ends with the separator's rule comes apart, as the semantics have it; ``clean``
    keeps chunks whole and takes one of each source.  Without ``chunks`` (no index yet) there is no
    similarity search.  Only queries that are short of documents reach that search, which ranks vectors
    alone; source, sec_pos and piece_pos name a chunk, and bring the found ones' texts.  Routing goes by
    names, written once; texts come for the chosen documents only."""
    none = F.array().cast("array<string>")
    named = named_documents(entries, docs, cfg)
    names = routed_names(queries, entries, named, cfg)
    routed = queries.select("query_id").join(names, "query_id", "left").join(_with_texts(names, named), "query_id", "left")
    routed = routed.select("query_id", F.coalesce("combined", none).alias("combined"), F.coalesce("n_kw", F.lit(0)).alias("n_kw"), F.coalesce("n_ctx", F.lit(0)).alias("n_ctx"))
    if chunks is None:
        found = routed.withColumn("parts", none)
    else:
        full = names.where(F.size("chosen") >= cfg.max_docs).select("query_id")
        asked = queries.select("query_id", "vector").join(full, "query_id", "left_anti")
        name = ["source", "sec_pos", "piece_pos"]
        top = pruned_topk(chunks.select(*name, "embedding"), asked, name, cfg).join(chunks.select(*name, "text"), name)
        pieces = F.transform(F.array_sort(F.collect_list(F.struct("rank", titled(F.col("source"), F.col("text")).alias("doc")))), lambda x: x["doc"])
        top = top.groupBy("query_id").agg(pieces.alias("pieces"))
        if mode == "compat":
            again = split_literal(F.array_join("pieces", cfg.separator), cfg.separator)
            top = top.select("query_id", F.filter(again, lambda p: trimmed(p) != "").alias("parts"))
        else:
            top = top.select("query_id", first_by(F.col("pieces"), F.transform("pieces", header)).alias("parts"))
        found = routed.join(top, "query_id", "left").withColumn("parts", F.coalesce("parts", none))
    left = cfg.max_docs - F.size("combined")
    out = found.withColumn("docs", F.concat("combined", F.slice("parts", 1, left))).withColumn("heads", F.transform("docs", header))
    methods = F.array_compact(F.array(
        F.when(F.col("n_kw") > 0, "keyword"), F.when(F.col("n_ctx") > 0, "context"), F.when(F.size("parts") > 0, "embedding"),
    ))
    return out.select("query_id", first_by(F.col("docs"), F.col("heads")).alias("docs"), methods.alias("methods"))
