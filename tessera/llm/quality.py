"""Supervised subword embeddings for document quality (operator 4).

Every word, every character n-gram of it and every pair of words in a row has a learned vector in a
hashed table; a document is the average of the vectors of all its features, and a softmax layer turns
it into class probabilities.  Table and layer are trained by numpy stochastic gradient descent on a
bounded sample of labelled documents.  As the softmax of an average needs only each feature's inner
product with the layer's weights, scoring folds the layer into the table and remembers a sum for each
word.

Edge cases: null and empty texts, and those of blanks only, have no features and score what the
layer's bias says; without labelled rows of both classes the score is the share of class 1 (0.5 if
there are none); labels repeated for a document with the same value count once, contradicting ones
are left out of training; of several texts with one labelled doc_id the largest is learned from; kept
columns named like the score are replaced by it; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, read, small_batches, unused, worker_holds

BUCKETS = 1 << 16
DIM = 8
GRAMS = (3, 4)
EPOCHS = 5
RATE = 0.5
#: Steps that even a small sample is trained for.
LEAST_STEPS = 6000
#: Bound of the training sample: about so many documents of each class, none longer than so many characters.
SAMPLE_PER_CLASS = 1000
SAMPLE_CHARS = 50_000
#: Score from which a document counts as good.
ACCEPT = 0.3
MEMO_WORDS = 200_000


def features(word: bytes) -> list[int]:
    """Buckets of a word and of its character n-grams (over its bytes, with word bounds)."""
    marked = b"<" + word + b">"
    found = [zlib.crc32(marked)]
    for n in GRAMS:
        found += [zlib.crc32(marked[i : i + n]) for i in range(len(marked) - n + 1)]
    return [x % BUCKETS for x in found]


def pairs(h: np.ndarray) -> np.ndarray:
    """Buckets of the word bigrams, from the hashes of the words in turn."""
    mixed = (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[1:] * np.uint64(0xC2B2AE3D27D4EB4F))
    return ((mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x165667B19E3779F9) >> np.uint64(64 - (BUCKETS - 1).bit_length())).astype(np.int64)


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.uint64, len(words))


def document(text: str | None) -> np.ndarray:
    out: list[int] = []
    memo: dict[bytes, list[int]] = {}
    found = (text or "").encode("utf-8", "replace").split()
    for w in found:
        if (f := memo.get(w)) is None:
            f = memo[w] = features(w)
        out += f
    return np.concatenate([np.array(out, dtype=np.int64), pairs(hashes(found))])


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, seed: int = 1) -> dict:
    """Model from documents (doc_id, text) and labels (doc_id, label)."""
    marks = labels.where("doc_id is not null and label is not null").groupBy("doc_id")
    marks = marks.agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").drop("other")
    # ids are chosen from the labels alone, and number about twice `per_class`; only their texts are read out
    sizes = marks.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    share = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1 << 20)) / float(1 << 20)
    chosen = marks.join(F.broadcast(sizes), "label").where(share * F.col("n") < per_class).select("doc_id", "label")
    pool = docs.where(F.length("text") <= SAMPLE_CHARS).select("doc_id", "text")
    read_out = pool.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("label").alias("label"))
    rows = sorted(read_out.collect(), key=lambda r: (r.doc_id, r.text))
    y = np.array([int(r.label == 1) for r in rows])
    if not len(y) or y.min() == y.max():
        p = float(y.mean()) if len(y) else 0.5
        return {"table": np.zeros(BUCKETS, np.float64), "bias": float(np.log((p + 1e-3) / (1 - p + 1e-3)))}
    bags = []
    for r in rows:
        u, n = np.unique(document(r.text), return_counts=True)
        bags.append((u, (n / max(1, n.sum())).astype(np.float32)))
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    layer, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    # the classes take turns, each in a new order whenever it is through
    steps = max(EPOCHS * len(bags), LEAST_STEPS)
    of = [np.flatnonzero(y == c) for c in (0, 1)]
    turns = [np.concatenate([rng.permutation(x) for _ in range(steps // (2 * len(x)) + 1)]) for x in of]
    for done in range(steps):
        i = turns[done % 2][done // 2]
        rate = RATE * (1 - done / steps)
        u, w = bags[i]
        mean = w @ table[u] if len(u) else np.zeros(DIM, np.float32)
        z = layer @ mean + bias
        p = np.exp(z - z.max())
        g = p / p.sum()
        g[y[i]] -= 1
        if len(u):
            table[u] -= rate * 20 * np.outer(w, g @ layer)
        layer -= rate * np.outer(g, mean)
        bias -= rate * 0.1 * g
    return {"table": table.astype(np.float64) @ (layer[1] - layer[0]).astype(np.float64), "bias": float(bias[1] - bias[0])}


def score(df: DataFrame, model: dict, keep: tuple[str, ...] = ("doc_id",), out: str = "score") -> DataFrame:
    """``keep`` columns with ``out``: the softmax probability of class 1."""
    small_batches(df.sparkSession)
    held = df.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers
    keep = tuple(c for c in keep if c != out)
    source = df.select(*keep, F.col("text").alias(unused(df, "__text")))
    schema = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep) + f", `{out}` double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_holds("quality")
        table, bias = held.value["table"], held.value["bias"]
        sums: dict[bytes, tuple[float, int]] = {}
        for batch in batches:
            found_scores = []
            for text in batch.column(len(keep)).to_pylist():
                found = (text or "").encode("utf-8", "replace").split()
                if len(sums) > MEMO_WORDS:
                    sums.clear()
                for w in set(found).difference(sums):
                    f = features(w)
                    sums[w] = (float(table[f].sum()), len(f))
                n = max(0, len(found) - 1)
                total = float(table[pairs(hashes(found))].sum())
                for s, k in map(sums.__getitem__, found):
                    total += s
                    n += k
                z = bias + (total / n if n else 0.0)
                found_scores.append(float(1 / (1 + np.exp(-min(50.0, max(-50.0, z))))))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), pa.array(found_scores, pa.float64())], [*keep, out])

    return source.mapInArrow(run, schema)


def accepted(df: DataFrame, model: dict, least: float = ACCEPT) -> DataFrame:
    """The rows of ``df`` that score ``least`` or more, with all their columns."""
    name = unused(df, "__score")
    return score(df, model, tuple(df.columns), name).where(F.col(name) >= least).select(df.columns)


def learned(spark, docs: DataFrame, sf_dir: str) -> dict:
    """The model as op4 and the pipeline train it: only from rows outside the held-out fold."""
    labels = read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return train(docs.where(fold(F.col("doc_id"), 5) != 0), labels)


def op4_quality(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, learned(spark, docs, sf_dir))
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
