"""Language identification by nearest centroid (operator 9).

A text is the TF-IDF vector of the hashed byte bigrams and trigrams of its words, of unit length.  Each language
has several centroids, found by spherical k-means over a bounded sample of labelled documents; the
language of the centroid with the largest cosine is predicted.  ``rejected`` marks texts farther
from every centroid than ``REJECT``: they look like none of the learned languages.

Edge cases: a null text, or one without any letter, is ``und`` with score 0; documents without a
language are never learned from; if nothing can be learned every text is ``und``; kept columns named
like an output are replaced by it; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, read, small_batches, unused

DIM = 8192
CENTROIDS = 3
#: Bound of the sample: about so many documents of each language, and of all together (which many
#: languages share), none longer than so many characters.
SAMPLE_PER_LANG, SAMPLE_IN_ALL = 800, 80_000
SAMPLE_CHARS = 50_000
#: Cosine distance beyond which a text counts as rejected.
REJECT = 0.9
#: Bytes of ASCII that are no letters count as blanks.
LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
LETTER = regex.compile(r"\p{L}")


def counts(text: str) -> np.ndarray:
    """Occurrences of the text's hashed byte bigrams (lower half) and trigrams (upper half)."""
    plain = b" ".join(text.lower().encode("utf-8", "replace").translate(LETTERS).split())
    b = np.frombuffer(b" " + plain + b" ", dtype=np.uint8).astype(np.uint32)
    half = DIM // 2
    shift = np.uint32(32 - (half - 1).bit_length())
    two = b[:-1] * np.uint32(256) + b[1:]
    three = two[:-1] * np.uint32(256) + b[2:]
    at = np.concatenate([(two * np.uint32(2654435761)) >> shift, half + ((three * np.uint32(2246822519)) >> shift)])
    return np.bincount(at, minlength=DIM).astype(np.float32)


def vectors(texts: list[str], idf: np.ndarray) -> np.ndarray:
    m = np.stack([counts(t) for t in texts])
    m = np.log1p(m) * idf
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)


def clustered(m: np.ndarray, k: int, seed: int = 0, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; starts from points far from those taken before."""
    rng = np.random.default_rng(seed)
    centres = m[[int(rng.integers(len(m)))]]
    while len(centres) < min(k, len(m)):
        centres = np.vstack([centres, m[np.argmin((m @ centres.T).max(axis=1))]])
    for _ in range(rounds):
        near = (m @ centres.T).argmax(axis=1)
        for j in range(len(centres)):
            if (near == j).any():
                c = m[near == j].sum(axis=0)
                centres[j] = c / max(float(np.linalg.norm(c)), 1e-9)
    return centres


def sample(df: DataFrame, label: str, per_label: int, max_chars: int, in_all: int = SAMPLE_IN_ALL) -> DataFrame:
    """About ``per_label`` rows of each label, chosen by hash of doc_id, whatever the table's size; fewer
    where there are so many labels that they would be more than ``in_all``."""
    pool = df.where(F.col(label).isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (F.length("text") <= max_chars))
    sizes = pool.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    labels = sizes.count()
    each = min(per_label, in_all / max(1, labels))
    share = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1 << 20)) / float(1 << 20)
    return pool.join(F.broadcast(sizes) if labels <= in_all else sizes, label).where(share * F.col("__n") < each).select("doc_id", "text", label)


def train(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG) -> dict:
    """idf, centroids and their languages, from rows with text and lang."""
    rows = sorted(sample(docs, "lang", per_lang, SAMPLE_CHARS).collect(), key=lambda r: (r.doc_id, r.text))
    rows = [r for r in rows if LETTER.search(r.text)]
    if not rows:
        return {"idf": np.ones(DIM, np.float32), "centres": np.zeros((0, DIM), np.float32), "langs": []}
    df = np.zeros(DIM)
    for r in rows:
        df += counts(r.text) > 0
    idf = (np.log((1 + len(rows)) / (1 + df)) + 0.1).astype(np.float32)
    centres, langs = [], []
    for lang in sorted({r.lang for r in rows}):
        c = clustered(vectors([r.text for r in rows if r.lang == lang], idf), CENTROIDS)
        centres.append(c)
        langs += [lang] * len(c)
    return {"idf": idf, "centres": np.vstack(centres).astype(np.float32), "langs": langs}


def predict(df: DataFrame, model: dict, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with ``lang_pred``, ``score`` (0 to 1) and ``rejected``."""
    small_batches(df.sparkSession)
    held = df.sparkSession.sparkContext.broadcast(model)  # DIM floats for each centroid
    keep = tuple(c for c in keep if c not in ("lang_pred", "score", "rejected"))
    source = df.select(*keep, F.col("text").alias(unused(df, "__text")))
    schema = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep) + ", lang_pred string, score double, rejected boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            lang, score = ["und"] * len(texts), np.zeros(len(texts))
            known = [i for i, t in enumerate(texts) if t and m["langs"] and LETTER.search(t)]
            for at in range(0, len(known), 128):
                part = known[at : at + 128]
                near = vectors([texts[i] for i in part], m["idf"]) @ m["centres"].T
                best = near.argmax(axis=1)
                for i, j, s in zip(part, best, near[np.arange(len(part)), best], strict=True):
                    lang[i], score[i] = m["langs"][j], min(1.0, max(0.0, float(s)))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(len(keep))), pa.array(lang), pa.array(score), pa.array(1 - score > REJECT)],
                [*keep, "lang_pred", "score", "rejected"],
            )

    return source.mapInArrow(run, schema)


def op9_langid(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(fold(F.col("doc_id"), 3) != 1))
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score", "rejected")
