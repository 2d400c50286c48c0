"""Near-duplicate classes by SimHash with a Gray-order hierarchical index (operator 12).

A document's fingerprint has a bit for each position: 1 if more than half of its shingles' hashes have
it.  Equal fingerprints are one entry of the index from the start, so copies cost nothing.

Entries are sorted by Gray rank, which puts fingerprints that agree in their leading bits side by side.
``LEAF`` consecutive ones make a leaf, ``FAN`` consecutive nodes an upper node; a node keeps the bits
that all below have (``lo``) and those that any has (``hi``), which is the masked pattern they share.
Where one node's pattern has a 1 and another's a 0, all their fingerprints differ.  So the index is held
against itself from its few topmost nodes down: a pair of nodes is dropped, with everything below, as
soon as its patterns differ in more than ``bits`` places; of the others the children are paired.  Only
pairs of leaves that are left are compared fingerprint by fingerprint.

For the patterns to tell much apart, the index is made ``bits`` + 1 times, with the fingerprint turned
so that another of ``bits`` + 1 stretches leads.  Fingerprints that differ in at most ``bits`` places
agree in one stretch, so in each index pairs of nodes that differ in the leading stretch are dropped too.
This is exact, and keeps the pairs of leaves near the number of leaves whatever the corpus' size.

Links are reduced where they are found: a leaf's fingerprints are labelled by their components inside
the leaf, and two leaves give no more links than they have labels, so a group of many near copies never
has its pairs spelled out.  Connected components run over what is left.

Edge cases: fewer words than a shingle give one shingle of them all; null texts and texts without words
have the fingerprint zero, linked like any other; rows with the same doc_id are answered each by its own
fingerprint; a row without doc_id takes part like any other and is named by the least doc_id it is
linked with, if there is one; only doc_id and text are read, so other columns may have any name; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, read, salted_join, small_batches
from .near_dedup import components
from .ordered import numbered

WIDTH = 64
#: Fingerprints of a leaf, children of an upper node, and nodes up to which a level is the topmost.
LEAF, FAN, TOP = 256, 16, 16
#: Shingles voted on at a time, so that a long text needs no more memory than a short one.
VOTES = 1 << 15


def fingerprint(text: str | None, words: int, seed: int = 42) -> int:
    """The SimHash of a text's word shingles, repeats included; 0 without words."""
    found = (text or "").encode("utf-8", "replace").lower().split()
    if not found:
        return 0
    k = min(words, len(found))
    n, ones, digest = len(found) - k + 1, np.zeros(WIDTH, np.int64), xxhash.xxh64_intdigest
    for a in range(0, n, VOTES):
        hashes = np.array([digest(b" ".join(found[i : i + k]), seed) for i in range(a, min(n, a + VOTES))], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, doc_id: str, text: str, words: int) -> DataFrame:
    """``id`` and ``f``, the fingerprint's 64 bits as a long."""
    small_batches(df.sparkSession)
    source = df.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["id", "f"])

    return source.mapInArrow(run, "id long, f long")


def turned(f: Column, by: int) -> Column:
    """The bits of ``f`` turned left."""
    return F.shiftleft(f, by).bitwiseOR(F.shiftrightunsigned(f, WIDTH - by)) if by else f


def gray_rank(f: Column) -> Column:
    """Where ``f`` stands in the order of Gray codes; as a signed long that sorts like an unsigned one."""
    for s in (1, 2, 4, 8, 16, 32):
        f = f.bitwiseXOR(F.shiftrightunsigned(f, s))
    return f.bitwiseXOR(F.lit(-(1 << 63)))


def apart(lo_a: str, hi_a: str, lo_b: str, hi_b: str) -> Column:
    """The bits in which every fingerprint below a differs from every one below b."""
    return F.col(lo_a).bitwiseAND(F.bitwise_not(hi_b)).bitwiseOR(F.col(lo_b).bitwiseAND(F.bitwise_not(hi_a)))


def stretches(bits: int) -> list[tuple[int, int]]:
    """For each turn of the index: by how many bits it turns, and the mask of its leading stretch, as a long."""
    cuts = [WIDTH * k // (bits + 1) for k in range(bits + 2)]
    masks = [((1 << (b - a)) - 1) << (WIDTH - (b - a)) for a, b in zip(cuts, cuts[1:])]
    return [(a, m - (1 << 64)) for a, m in zip(cuts, masks)]


def near(x: np.ndarray, y: np.ndarray, bits: int) -> np.ndarray:
    return np.bitwise_count(x[:, None] ^ y[None, :]) <= bits


def labelled(leaves: DataFrame, bits: int) -> DataFrame:
    """``leaves`` with ``labels``: each fingerprint's component inside the leaf, named by one of its fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, out = batch.column("f"), []
            for i in range(batch.num_rows):
                f = column[i].values.to_numpy().view(np.uint64)
                linked, label = near(f, f, bits), np.arange(len(f))
                while True:
                    new = np.where(linked, label[None, :], len(f)).min(axis=1)
                    if (new == label).all():
                        break
                    label = new
                out.append(f[label].view(np.int64))
            ends = pa.array(np.cumsum([0, *map(len, out)]).astype(np.int32))
            labels = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*out, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([*batch.columns, labels], [*batch.schema.names, "labels"])

    kinds = ", ".join(f"{n} {t}" for n, t in leaves.dtypes)
    return leaves.mapInArrow(run, f"{kinds}, labels array<bigint>")


def compared(pairs: DataFrame, bits: int) -> DataFrame:
    """Links (turn, a, b) of labels, for pairs of leaves (turn, f, labels, g, marks): what holds the labels of the two together."""

    def spanning(one: np.ndarray, other: np.ndarray) -> Iterator[tuple[int, int]]:
        root: dict[int, int] = {}

        def top(x: int) -> int:
            while (up := root.get(x, x)) != x:
                root[x] = root.get(up, up)
                x = up
            return x

        for x, y in zip(one.tolist(), other.tolist(), strict=True):
            if (a := top(x)) != (b := top(y)):
                root[a] = b
                yield x, y

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[str, int, int]] = []
            turn, f, labels, g, marks = batch.columns
            for i in range(batch.num_rows):
                at, to = np.nonzero(near(f[i].values.to_numpy().view(np.uint64), g[i].values.to_numpy().view(np.uint64), bits))
                if len(at):
                    met = np.unique(np.stack([labels[i].values.to_numpy()[at], marks[i].values.to_numpy()[to]]), axis=1)
                    found.extend((turn[i].as_py(), x, y) for x, y in spanning(met[0], met[1]))
            turns, a, b = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(turns, pa.string()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["turn", "a", "b"])

    return pairs.mapInArrow(run, "turn string, a long, b long")


def index(entries: DataFrame, bits: int) -> tuple[DataFrame, list[DataFrame]]:
    """The leaves (turn, id, f) and the levels of nodes (turn, id, lo, hi), leaves first."""
    turns = [F.struct(F.lit(str(k)).alias("turn"), turned(F.col("f"), by).alias("f")) for k, (by, _) in enumerate(stretches(bits))]
    rows = entries.select(F.inline(F.array(*turns))).withColumn("rank", gray_rank(F.col("f")))
    placed, sizes = numbered(rows, "turn", ["rank"], "simhash")
    of = placed.select("turn", F.floor(F.col("idx") / LEAF).alias("id"), "f")
    leaves = of.groupBy("turn", "id").agg(F.collect_list("f").alias("f"), F.bit_and("f").alias("lo"), F.bit_or("f").alias("hi"))
    leaves = cut(leaves, "simhash-leaves")
    levels = [leaves.select("turn", "id", "lo", "hi")]
    n = -(-(sizes.agg(F.max("n")).head()[0] or 0) // LEAF)
    while n > TOP:
        up = levels[-1].groupBy("turn", F.floor(F.col("id") / FAN).alias("up")).agg(F.bit_and("lo").alias("lo"), F.bit_or("hi").alias("hi"))
        levels.append(cut(up.withColumnRenamed("up", "id"), f"simhash-level-{len(levels)}"))
        n = -(-n // FAN)
    return leaves.select("turn", "id", "f"), levels


def leaf_pairs(levels: list[DataFrame], bits: int) -> DataFrame:
    """Pairs of leaves (turn, a, b), a <= b, that may hold linked fingerprints, from the topmost level down."""
    leading = F.element_at(F.array(*[F.lit(m) for _, m in stretches(bits)]), F.col("turn").cast("int") + 1)
    named = lambda df, x: df.select("turn", F.col("id").alias(x), F.col("lo").alias(f"lo_{x}"), F.col("hi").alias(f"hi_{x}"))

    def kept(df: DataFrame) -> DataFrame:
        diff = apart("lo_a", "hi_a", "lo_b", "hi_b")
        return df.where((F.bit_count(diff) <= bits) & (diff.bitwiseAND(leading) == 0)).select("turn", "a", "b")

    top = named(levels[-1], "a").join(named(levels[-1], "b"), "turn").where("a <= b")  # TOP nodes of a turn at most
    pairs = cut(kept(top), "simhash-pairs")
    for k in range(len(levels) - 2, -1, -1):
        below = lambda x: named(levels[k], x).withColumn(f"up_{x}", F.floor(F.col(x) / FAN))  # noqa: B023, E731
        up = pairs.select("turn", F.col("a").alias("up_a"), F.col("b").alias("up_b"))
        pairs = cut(kept(up.join(below("a"), ["turn", "up_a"]).join(below("b"), ["turn", "up_b"]).where("a <= b")), "simhash-pairs")
    return pairs


def links(entries: DataFrame, bits: int) -> DataFrame:
    """Links (a, b) that connect all of ``entries`` (f) which differ in at most ``bits`` places, directly or through others."""
    spark = entries.sparkSession
    leaves, levels = index(entries, bits)
    leaves = cut(labelled(leaves, bits), "simhash-labelled")
    inside = leaves.select("turn", F.inline(F.zip_with("f", "labels", lambda x, y: F.struct(x.alias("a"), y.alias("b"))))).where("a <> b")
    pairs = leaf_pairs(levels, bits).where("a < b")
    one = leaves.select("turn", F.col("id").alias("a"), "f", "labels")
    other = leaves.select("turn", F.col("id").alias("b"), F.col("f").alias("g"), F.col("labels").alias("marks"))
    small_batches(spark)
    across = compared(pairs.join(one, ["turn", "a"]).join(other, ["turn", "b"]).select("turn", "f", "labels", "g", "marks"), bits)
    found = inside.unionByName(across)
    # back to the fingerprint as it was before it was turned
    back = lambda x: F.coalesce(*[F.when(F.col("turn") == str(k), turned(F.col(x), (WIDTH - by) % WIDTH)) for k, (by, _) in enumerate(stretches(bits))])
    return found.select(back("a").alias("a"), back("b").alias("b")).distinct()


def classes(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, bits: int = 2) -> DataFrame:
    """``doc_id``, ``f`` (the fingerprint as a long) and ``component_id``: a row for each row of ``df``."""
    docs = cut(fingerprints(df, doc_id, text, words), "simhash-docs")
    entries = cut(docs.groupBy("f").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("rows")), "simhash-entries")
    comp = components(cut(links(entries.select("f"), bits), "simhash-links"), "simhash-comp")
    of = entries.join(comp.select(F.col("id").alias("f"), "comp"), "f", "left").withColumn("comp", F.coalesce("comp", "f"))
    of = cut(of, "simhash-of")
    names = of.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = salted_join(of.select("f", "comp", "rows"), names, ["comp"], ["f"])
    named = cut(named, "simhash-named")
    hot = named.where(F.col("rows") * 1000 > docs.count()).select("f")
    out = salted_join(docs, named.select("f", "component_id"), ["f"], ["id"], hot=hot)
    return out.select(F.col("id").alias("doc_id"), "f", "component_id")


def op12_simhash(spark, sf_dir: str) -> DataFrame:
    out = classes(read(spark, sf_dir, "documents").select("doc_id", "text"), words=3, bits=2)
    return out.select("doc_id", F.lpad(F.lower(F.hex("f")), 16, "0").alias("fingerprint"), "component_id")
