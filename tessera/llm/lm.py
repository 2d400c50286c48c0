"""Hashed maximum-entropy language model (operator 7).

The next token's probability is factored as P(class | context) * P(token | class, context).

- The class is a softmax over hashed features of the context: previous token, previous two, two skips.
  The weight table has a fixed size and is broadcast.
- Inside a class of frequent tokens the token is a softmax too, of its log count and a feature for each
  pair (previous token, token) ever seen.  Pairs grow with the corpus, so they are a Spark table, dealt
  by hash.  The scaling update that fits a pair's weight to the n(p,t) times it was seen is
  ``log(1 + n(p,t) / (PRIOR q_t))``, q_t being the token's share of its class; the normaliser then is
  ``1 + n(p,c) / PRIOR`` with the n(p,c) times that class followed p, a feature of the same table.
- Tokens of the other classes (all that are not frequent, classed by how they end) follow their counts.

Frequent tokens are those of more than one in ``FREQUENT`` of all, so there are fewer than that.
Counts are taken over all training documents.  The class weights are trained by distributed updates:
each round every task sums the gradient over its documents at the current weights, the sums are added
up block by block, and the driver takes one step, damped and scaled by the curvature at zero weights.
Both rounds see all training documents; the first, at zero weights, needs no more than counts of
features and classes, and collects the pairs on the way.

Features and counts that can't be broadcast are looked up in blobs: a task packs what a stretch of its
documents asks for into one array for each part of the tables, the parts answer with a sum for each
document, and the answers are added up.  So a key that stands in every document costs one entry for
each document, and no row of Spark's is as small as a token.

Edge cases: null and empty texts are one end token; with nothing to learn from all counts are zero;
rows repeated are each scored (and each counted), with or without doc_id; only doc_id and text are
read, so other columns may have any name; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Collection, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fold, read, small_batches

#: Weight rows (at most 2**16), and classes of frequent and of other tokens.
ROWS, HOT_CLASSES, TAIL_CLASSES = 1 << 15, 12, 4
CLASSES = HOT_CLASSES + TAIL_CLASSES
#: Frequent tokens, and tokens whose counts are broadcast, have more than one in so many of all tokens.
FREQUENT, KNOWN = 60_000, 500_000
SMOOTH = 0.1
#: Weight of the class's own shares against what was seen after the previous token.
PRIOR = 5.0
#: Tokens for each part of the dealt tables, and entries that a task gathers before it sends them on.
PART_TOKENS, PACK = 4_000_000, 1_200_000
LEAST_BITS = 5
#: Steps of a stored share's logarithm.
SHARE = 2048
BLOCK = 128
STEP, DAMP = 0.3, 20.0
CHUNK = 16_384
FLUSH = 200_000
END = xxhash.xxh3_64_intdigest(b"")
SALT = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def key(word: bytes) -> int:
    x = xxhash.xxh3_64_intdigest(word)
    return x - (1 << 64) if x >> 63 else x


def tail_class(word: bytes) -> int:
    return HOT_CLASSES + zlib.crc32(word[-1:]) % TAIL_CLASSES


#: ``tail_class`` by a word's last byte, at 256 of a word without bytes.
TAILS = np.array([tail_class(bytes([b])) for b in range(256)] + [tail_class(b"")])


def keys_of(found: Collection[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found)).view(np.int64)


def tails_of(found: Collection[bytes]) -> np.ndarray:
    return TAILS[np.fromiter((w[-1] if w else 256 for w in found), np.int64, len(found))]


def tokens(text: str | bytes | None) -> list[bytes]:
    """Words, then the end token (which no word equals)."""
    found = (text.encode("utf-8", "replace") if isinstance(text, str) else text or b"").lower().split()
    found.append(b"")
    return found


def counts(docs: DataFrame) -> DataFrame:
    """``key``, ``cls`` (were it rare) and count ``c`` of every token in ``docs``."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array(keys_of(seen)), pa.array(tails_of(seen), pa.int32()), pa.array(seen.values(), pa.int64(), size=len(seen))],
                ["key", "cls", "c"],
            )
            seen.clear()
            return out

        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                seen.update(tokens(text))
            if len(seen) > FLUSH:
                yield flush()
        yield flush()

    partial = docs.select("text").mapInArrow(run, "key long, cls int, c long")
    return partial.groupBy("key").agg(F.min("cls").alias("cls"), F.sum("c").alias("c"))


class Index(dict):
    """Numbers words as they come, and lists the new ones."""

    def __init__(self):
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class Vocabulary:
    """Numbers of tokens in a batch: their keys, classes and, where broadcast, counts."""

    def __init__(self, model: dict):
        self.model = model
        self.index = Index()
        self.keys, self.classes, self.known = np.zeros(FLUSH, np.int64), np.zeros(FLUSH, np.int64), np.zeros(FLUSH)

    def __call__(self, found: list[bytes]) -> np.ndarray:
        index, m = self.index, self.model
        ids = np.fromiter(map(index.__getitem__, found), np.int64, len(found))
        if new := index.new:
            a, b = len(index) - len(new), len(index)
            while b > len(self.keys):
                self.keys, self.classes, self.known = (np.concatenate([x, np.zeros_like(x)]) for x in (self.keys, self.classes, self.known))
            keys = keys_of(new)
            self.keys[a:b] = keys
            self.classes[a:b] = tails_of(new)
            self.known[a:b] = 0.0
            if len(m["keys"]):
                at = np.minimum(np.searchsorted(m["keys"], keys), len(m["keys"]) - 1)
                here = np.flatnonzero(m["keys"][at] == keys)
                self.known[a + here] = m["counts"][at[here]]
                self.classes[a + here] = m["classes"][at[here]]
            index.new = []
        return ids


def mixed(x: np.ndarray) -> np.ndarray:
    return (x ^ (x >> np.uint64(31))) * SALT[0]


def pair_keys(keys: np.ndarray, place: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of tokens in frequent classes: where they are, and their keys (previous, token), (previous, class)."""
    k = keys.view(np.uint64)
    before = np.zeros_like(k)
    before[1:] = k[:-1]
    before[place == 0] = np.uint64(1)
    at = np.flatnonzero(cls < HOT_CLASSES)
    p = before[at]
    return at, mixed(mixed((p * SALT[1]) ^ (k[at] * SALT[2]))), mixed(mixed(p * SALT[3] + cls[at].astype(np.uint64) * SALT[1] + SALT[2]))


def part_bits(n_tokens: int) -> int:
    """The tables have 2 ** bits parts, of which a task holds one at a time."""
    return min(16, max(LEAST_BITS, (n_tokens // PART_TOKENS).bit_length()))


def short(keys: np.ndarray, bits: int) -> np.ndarray:
    """What is left of hashed keys inside their part."""
    return ((keys << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)


def features(keys: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Weight rows of each token's context, shape (4, tokens); ``place`` is its number in its document."""
    k = keys.view(np.uint64)

    def back(j: int) -> np.ndarray:
        out = np.zeros_like(k)
        out[j:] = k[:-j]
        out[place < j] = np.uint64(j)
        return out

    one, two, three = back(1), back(2), back(3)
    contexts = (one * SALT[0], (one * SALT[1]) ^ (two * SALT[2]), two * SALT[3], three * SALT[1] + SALT[0])
    shift = np.uint64(64 - (ROWS - 1).bit_length())
    return np.stack([(mixed(c) >> shift).astype(np.int64) for c in contexts])


def batches_of(texts: list[bytes | None], vocabulary: Vocabulary) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts in stretches of some CHUNK tokens or more: first text, lengths, token numbers, places."""
    at, first, lengths, found = 0, 0, [], []
    for i, text in enumerate(texts):
        words = tokens(text)
        found += words
        lengths.append(len(words))
        if len(found) >= CHUNK or i == len(texts) - 1:
            if len(vocabulary.index) > FLUSH:
                vocabulary.index.clear()
            n = np.array(lengths)
            ids = vocabulary(found)
            yield first, n, ids, np.arange(len(ids)) - np.repeat(np.cumsum(n) - n, n)
            first, lengths, found = i + 1, [], []


def probabilities(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> np.ndarray:
    z = weights.take(rows[0], axis=0)
    for r in rows[1:]:
        z += weights.take(r, axis=0)
    z += bias
    z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    z /= (z @ np.ones(CLASSES, np.float32))[:, None]
    return z


PAIRS = "part int, keys binary, shares binary, counts binary"
TABLE = "part int, kind int, flush long, a binary, b binary, c binary, d binary"
#: Kinds of rows in the exchange, in the order in which a part reads them.
GRADIENT, PAIR_TABLE, COUNT_TABLE, OWN, PAIR_ASKED, COUNT_ASKED = range(6)
LOW = np.uint64((1 << 16) - 1)


def packed(rows: list[tuple], schema: str) -> pa.RecordBatch:
    """A batch of rows whose arrays become binaries."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays(
        [pa.array([x.tobytes() if isinstance(x, np.ndarray) else x for x in c], kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields]
    )


def blocks(x: np.ndarray) -> list[tuple]:
    """Rows for the exchange: the blocks of weight rows in which anything is not zero."""
    parts = x.reshape(ROWS // BLOCK, -1)
    return [(-1 - int(i), parts[i].astype(np.float32), None, None) for i in np.flatnonzero(parts.any(axis=1))]


def gathered(sums: DataFrame) -> np.ndarray:
    """The summed blocks as an array: ROWS x CLASSES, whatever the corpus."""
    out = np.zeros((ROWS // BLOCK, BLOCK * CLASSES), np.float32)
    for r in sums.where(F.col("kind") == GRADIENT).select("part", "a").toLocalIterator():
        out[-1 - r.part] = np.frombuffer(r.a, np.float32)
    return out.reshape(ROWS, CLASSES)


def at_zero(seen: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature at zero weights, where all probabilities are the prior's, from how often
    each feature was seen with each class."""
    prior = np.exp(bias.astype(np.float64))
    prior /= prior.sum()
    total = seen.sum(axis=1, keepdims=True)
    return seen - total * prior, total * (prior * (1 - prior))


def gradients(docs: DataFrame, model) -> np.ndarray:
    """Gradient of the classes' log-likelihood over ``docs`` at the model's weights: ROWS x CLASSES.

    Only sums of blocks of weight rows leave a task, and they are added up where they arrive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        vocabulary = Vocabulary(m)
        total = np.zeros((CLASSES, ROWS))
        for batch in batches:
            for _, _, ids, place in batches_of(batch.column(0).cast(pa.binary()).to_pylist(), vocabulary):
                cls = vocabulary.classes[ids]
                rows = features(vocabulary.keys[ids], place)
                for a in range(0, len(ids), CHUNK):
                    part = rows[:, a : a + CHUNK]
                    each = -probabilities(m["weights"], m["bias"], part)
                    each[np.arange(len(each)), cls[a : a + CHUNK]] += 1
                    spots = part.reshape(-1)
                    for c, x in enumerate(each.T.astype(np.float64, order="C")):  # class by class, the sums stay in cache
                        total[c] += np.bincount(spots, np.concatenate([x] * len(part)), ROWS)
        found = blocks(np.ascontiguousarray(total.T))
        for at in range(0, len(found), 64):
            yield packed(found[at : at + 64], PAIRS)

    flat = docs.select("text").mapInArrow(run, PAIRS)
    return gathered(flat.repartition("part").sortWithinPartitions("part").mapInArrow(added, TABLE))


def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each part its pairs' gains, for each block its sum; a part's rows come together."""
    part, held = None, []

    def close() -> pa.RecordBatch:
        if part < 0:
            total = sum(np.frombuffer(k, np.float32).astype(np.float64) for k, _, _ in held)
            return packed([(part, GRADIENT, None, total.astype(np.float32), None, None, None)], TABLE)
        keys = np.concatenate([np.frombuffer(k, np.uint32) for k, _, _ in held])
        shares = np.concatenate([np.frombuffer(s, np.uint16) for _, s, _ in held])
        counts = np.concatenate([np.frombuffer(c, np.uint32) for _, _, c in held])
        order = np.argsort(keys)
        keys = keys[order]
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        total = np.add.reduceat(counts[order].astype(np.float64), starts)
        share = shares[order[starts]].astype(np.float64)
        gain = np.where(share > 0, np.log10(1 + total * np.exp2((share - 1) / SHARE) / PRIOR), -np.log10(1 + total / PRIOR))
        return packed([(part, PAIR_TABLE, None, keys[starts], gain.astype(np.float32), None, None)], TABLE)

    for batch in batches:
        for p, *arrays in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if p != part:
                if held:
                    yield close()
                part, held = p, []
            held.append(arrays)
    if held:
        yield close()


def collected(docs: DataFrame, model, bits: int) -> DataFrame:
    """What the first round gathers from ``docs``: how often features were seen with classes (a row for
    each block), and the pairs' keys (``a``) and gains (``b``), a row for each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        vocabulary = Vocabulary(m)
        seen = np.zeros(ROWS * CLASSES, np.int64)
        held: list[np.ndarray] = []
        spots: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal size, seen
            if spots:
                seen += np.bincount(np.concatenate(spots), minlength=ROWS * CLASSES)
            # the upper 48 bits are the key's, the lower 16 its share, so one plain sort does for both
            both = np.sort(np.concatenate([*held, np.zeros(0, np.uint64)]))
            held.clear()
            spots.clear()
            size = 0
            starts = np.flatnonzero(np.r_[True, both[1:] != both[:-1]]) if len(both) else np.zeros(0, np.int64)
            counts = np.diff(np.r_[starts, len(both)]).astype(np.uint32)
            both = both[starts]
            keys, shares = short(both, bits), (both & LOW).astype(np.uint16)
            cuts = np.searchsorted(both >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
            rows = [(i, keys[a:b], shares[a:b], counts[a:b]) for i, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]
            for at in range(0, len(rows), 64):
                yield packed(rows[at : at + 64], PAIRS)

        for batch in batches:
            for _, _, ids, place in batches_of(batch.column(0).cast(pa.binary()).to_pylist(), vocabulary):
                cls, keys = vocabulary.classes[ids], vocabulary.keys[ids]
                spots.append((features(keys, place) * CLASSES + cls).reshape(-1))
                at, pairs, classes = pair_keys(keys, place, cls)
                q = (vocabulary.known[ids[at]] + SMOOTH) / m["z"][cls[at]]
                held.append((pairs & ~LOW) | (1.5 - np.log2(np.minimum(q, 1.0)) * SHARE).astype(np.uint64))
                held.append(classes & ~LOW)
                size += 2 * len(at) + len(ids)
                if size > PACK:
                    yield from flush()
        yield from flush()
        found = blocks(seen)
        for at in range(0, len(found), 64):
            yield packed(found[at : at + 64], PAIRS)

    small_batches(docs.sparkSession, 200)
    flat = docs.select("text").mapInArrow(run, PAIRS)
    return cut(flat.repartition("part").sortWithinPartitions("part").mapInArrow(added, TABLE), "lm-pairs")


def count_table(rare: DataFrame, bits: int) -> DataFrame:
    """Counts (``key``, ``c``) as sorted arrays, a row for each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, keys, counts = -1, [], []

        def close() -> pa.RecordBatch:
            k, c = np.concatenate(keys), np.concatenate(counts)
            order = np.argsort(k)
            return packed([(part, COUNT_TABLE, None, k[order], c[order], None, None)], TABLE)

        for batch in batches:
            p, k, c = (batch.column(i).to_numpy() for i in range(3))
            for at in np.flatnonzero(np.r_[len(p) > 0, p[1:] != p[:-1]]) if len(p) else ():
                same = p == p[at]
                if p[at] != part:
                    if keys:
                        yield close()
                    part, keys, counts = int(p[at]), [], []
                keys.append(k[same].view(np.uint64))
                counts.append(c[same])
        if keys:
            yield close()

    parted = rare.select(F.shiftrightunsigned("key", 64 - bits).cast("int").alias("part"), "key", "c")
    return parted.repartition("part").sortWithinPartitions("part").mapInArrow(run, TABLE)


def train(docs: DataFrame) -> dict:
    """Counts, classes and weights from all rows of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    table = cut(counts(docs), "lm-counts")
    n, v = (int(x or 0) for x in table.agg(F.sum("c"), F.count(F.lit(1))).head())
    # fewer than KNOWN rows, whatever the corpus
    known = table.where(F.col("c") * KNOWN > n).toArrow()
    keys, tails, c = (known.column(x).to_numpy() for x in ("key", "cls", "c"))
    order = np.lexsort((keys, -c))
    order = order[: int((c * FREQUENT > n).sum())]
    before = np.cumsum(c[order]) - c[order]
    classes = tails.astype(np.int64)
    classes[order] = np.minimum(HOT_CLASSES - 1, before * HOT_CLASSES // max(1, int(c[order].sum())))
    z, share = (np.bincount(classes, x, CLASSES).astype(np.float64) for x in (c + SMOOTH, c))
    rare = table.where(F.col("c") * KNOWN <= n)
    z[HOT_CLASSES:] += SMOOTH  # one unknown token in each class of rare ones
    for r in rare.groupBy("cls").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect():
        z[r.cls] += r.c + SMOOTH * r.v
        share[r.cls] += r.c
    bias = np.log((share + 1) / (share + 1).sum()).astype(np.float32)
    by_key = np.argsort(keys)
    model = {
        "keys": keys[by_key], "counts": c[by_key].astype(np.float64), "classes": classes[by_key], "bias": bias, "z": np.maximum(z, SMOOTH),
        "weights": np.zeros((ROWS, CLASSES), np.float32), "n": n, "v": v,
    }
    bits = part_bits(n)
    first = collected(docs, spark.sparkContext.broadcast(model), bits)
    gradient, curvature = at_zero(gathered(first), bias)
    step = STEP / (curvature + DAMP)
    model |= {"weights": (step * gradient).astype(np.float32)}
    gradient = gradients(docs, spark.sparkContext.broadcast(model))
    model |= {"weights": model["weights"] + (step * gradient).astype(np.float32)}
    pairs = first.where(F.col("kind") == PAIR_TABLE)
    return model | {"bits": bits, "tables": pairs.unionByName(count_table(rare, bits))}


def asked(part: np.ndarray, doc: np.ndarray, keys: np.ndarray, kind: int, flush: int) -> list[tuple]:
    """A row for each part: keys by document, how often each, the documents and their numbers of keys."""
    if not len(keys):
        return []
    if keys.dtype == np.uint32 and part.max() < 1 << 12 and doc.max() < 1 << 20:  # one plain sort of all three
        one = np.sort((part.astype(np.uint64) << np.uint64(52)) | (doc.astype(np.uint64) << np.uint64(32)) | keys)
        part, doc, keys = (one >> np.uint64(52)).astype(np.int32), ((one >> np.uint64(32)) & np.uint64((1 << 20) - 1)).astype(np.int32), one.astype(np.uint32)
    else:
        order = np.lexsort((keys, doc, part))
        part, doc, keys = part[order], doc[order], keys[order]
    starts = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (doc[1:] != doc[:-1]) | (keys[1:] != keys[:-1])])
    times = np.diff(np.r_[starts, len(keys)]).astype(np.uint32)
    part, doc, keys = part[starts], doc[starts], keys[starts]
    firsts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    rows = []
    for a, b in zip(firsts, np.r_[firsts[1:], len(part)], strict=True):
        own = np.flatnonzero(np.r_[True, doc[a + 1 : b] != doc[a : b - 1]])
        rows.append((int(part[a]), kind, flush, keys[a:b], times[a:b], doc[a:b][own].astype(np.uint32), np.diff(np.r_[own, b - a]).astype(np.uint32)))
    return rows


def looked_up(table: np.ndarray, values: np.ndarray, keys: np.ndarray, missing: float) -> np.ndarray:
    if not len(table):
        return np.full(len(keys), missing)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, values[at], missing)


def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each request its documents' sums: of gains, or of logarithms of counts and known tokens."""
    nothing = (np.zeros(0, np.uint64), np.zeros(0))
    part, pairs, counts = -1, nothing, nothing
    for batch in batches:
        for p, kind, flush, a, b, c, d in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
            if p != part:
                part, pairs, counts = p, nothing, nothing
            if kind == PAIR_TABLE:
                pairs = (np.frombuffer(a, np.uint32), np.frombuffer(b, np.float32).astype(np.float64))
            elif kind == COUNT_TABLE:
                counts = (np.frombuffer(a, np.uint64), np.frombuffer(b, np.int64))
            elif kind == OWN:
                yield packed([(p, kind, flush, a, b, c, d)], TABLE)
            else:
                times, lengths = np.frombuffer(b, np.uint32).astype(np.float64), np.frombuffer(d, np.uint32).astype(np.int64)
                starts = np.cumsum(lengths) - lengths
                if kind == PAIR_ASKED:
                    sums = np.add.reduceat(times * looked_up(*pairs, np.frombuffer(a, np.uint32), 0.0), starts)
                    yield packed([(p, kind, flush, c, sums.astype(np.float32), None, None)], TABLE)
                else:
                    found = looked_up(*counts, np.frombuffer(a, np.uint64), 0)
                    sums = np.add.reduceat(times * np.log10(found + SMOOTH), starts)
                    yield packed([(p, kind, flush, c, sums, np.add.reduceat(times * (found > 0), starts).astype(np.uint32), None)], TABLE)


SCORED = "doc_id long, n_tokens long, n_known long, base double, model double"


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with all their sums; a stretch's rows come together, its own first."""
    state: list[np.ndarray] | None = None

    def close() -> pa.RecordBatch:
        ids, gone, lengths, known, base, model = state
        columns = [pa.array(ids, mask=gone.astype(bool)), pa.array(lengths), pa.array(known.round().astype(np.int64)), pa.array(base), pa.array(model)]
        return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in SCORED.split(", ")])

    for batch in batches:
        for kind, a, b, c, d in zip(*(batch.column(k).to_pylist() for k in (1, 3, 4, 5, 6)), strict=True):
            if kind == OWN:
                if state is not None:
                    yield close()
                sums = np.frombuffer(d, np.float64).reshape(3, -1).copy()
                state = [np.frombuffer(a, np.int64), np.frombuffer(b, np.uint8), np.frombuffer(c, np.int64), *sums]
                continue
            at, x = np.frombuffer(a, np.uint32), np.frombuffer(b, np.float64 if kind == COUNT_ASKED else np.float32)
            state[5][at] += x
            if kind == COUNT_ASKED:
                state[4][at] += x
                state[3][at] += np.frombuffer(c, np.uint32)
    if state is not None:
        yield close()


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` (unigram) and ``score``."""
    spark = docs.sparkSession
    small_batches(spark, 200)
    held = spark.sparkContext.broadcast({k: v for k, v in model.items() if k != "tables"})
    n, v, bits = model["n"], model["v"], model["bits"]
    whole = float(np.log10(n + SMOOTH * (v + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        vocabulary = Vocabulary(m)
        lz = np.log10(m["z"])
        task, number = TaskContext.get().partitionId() << 32, 0
        own: list[tuple] = []
        pairs: list[tuple] = []
        rare: list[tuple] = []
        size = n_docs = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal size, n_docs, number
            me = task + number
            number += 1
            ids, gone, lengths = (np.concatenate([o[k] for o in own]) for k in range(3))
            sums = np.concatenate([o[3] for o in own], axis=1)
            rows = [(me % (1 << bits), OWN, me, ids, gone, lengths, sums)]
            for found, kind in ((pairs, PAIR_ASKED), (rare, COUNT_ASKED)):
                keys, doc = (np.concatenate([f[k] for f in found]) for k in (0, 1))
                part = (keys >> np.uint64(64 - bits)).astype(np.int32)
                rows += asked(part, doc, short(keys, bits) if kind == PAIR_ASKED else keys, kind, me)
            for found in (own, pairs, rare):
                found.clear()
            size = n_docs = 0
            for at in range(0, len(rows), 64):
                yield packed(rows[at : at + 64], TABLE)

        for batch in batches:
            names = batch.column(0)
            for first, lengths, ids, place in batches_of(batch.column(1).cast(pa.binary()).to_pylist(), vocabulary):
                cls, keys, known = vocabulary.classes[ids], vocabulary.keys[ids], vocabulary.known[ids]
                rows = features(keys, place)
                lp = np.empty(len(ids))
                for a in range(0, len(ids), CHUNK):
                    p = probabilities(m["weights"], m["bias"], rows[:, a : a + CHUNK])
                    lp[a : a + CHUNK] = np.log10(np.maximum(p[np.arange(len(p)), cls[a : a + CHUNK]], 1e-30))
                lp -= lz[cls]
                here = known > 0
                lc = np.where(here, np.log10(known + SMOOTH), 0.0)
                starts = np.cumsum(lengths) - lengths
                per = lambda x: np.add.reduceat(x, starts)  # noqa: B023, E731
                doc = np.repeat(np.arange(n_docs, n_docs + len(lengths), dtype=np.int32), lengths)
                named = names.slice(first, len(lengths))
                own.append((
                    named.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), named.is_null().to_numpy(zero_copy_only=False).astype(np.uint8), lengths.astype(np.int64),
                    np.stack([per(here.astype(np.float64)), per(lc) - lengths * whole, per(lp + lc)]),
                ))
                at, by_token, by_class = pair_keys(keys, place, cls)
                pairs.append((np.concatenate([by_token, by_class]), np.tile(doc[at], 2)))
                away = np.flatnonzero(~here)
                rare.append((keys[away].view(np.uint64), doc[away]))
                n_docs += len(lengths)
                size += 2 * len(at) + len(away)
                if size > PACK:
                    yield from flush()
        if own:
            yield from flush()

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = model["tables"].unionByName(source.mapInArrow(run, TABLE))
    answers = rows.repartition("part").sortWithinPartitions("part", "kind").mapInArrow(answer, TABLE)
    scored = answers.repartition("flush").sortWithinPartitions("flush", "kind").mapInArrow(summed, SCORED)
    return scored.select("doc_id", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), F.col("model").alias("score"))


def op7_lm(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs.where(fold(F.col("doc_id"), 10) != 0))
    out = score(docs, model)
    return out.select("doc_id", (fold(F.col("doc_id"), 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
