"""Near-duplicate classes by circulant MinHash (operator 8).

A document is its set of distinct word shingles.  One permutation (``spot``) scatters the shingles
over ``RING`` places; the other (``ring``) orders the places, and shifting it by 1, 2, ... gives all
further signature coordinates, so a whole signature is the minimum over contiguous slices of one
table.  Coordinates are banded; documents that share a band are candidates.

Equal sets are one class from the start, so copies cost nothing.  Of the rest only candidates are
looked at again:

1. A document's *shared* shingles are those that another candidate has too.  No partner can meet it
   in more, so documents - and later pairs - that could not reach the threshold by that bound are
   left out.  This is exact, and clears the groups that only share a passage.
2. In every band each document is held against one leader, the document with the largest shared part;
   links are confirmed on the full sets, and connected components are taken.
3. What is left are documents in bands whose components differ.  Linked sets share one of their few
   rarest shingles (of n shingles one of the n - ceil(0.8 n) + 1 rarest, by one order for all, and in
   the smaller set even one of the n - ceil(8/9 n) + 1 rarest, as it must share 8/9 of its own), and
   the larger has at most 1.25 times the shingles of the smaller.  So they are joined by rare shingle
   and size, not by band: a passage that very many unlike documents share is rare in none of them.
   Letters of one form, each with some words of its own, have only those among the rarest of the
   smaller, and so aren't paired by the form.
   Within such a group only documents outside its most frequent component are held against the
   others.  Each pair is confirmed too, unless the bound or the sets' parities rule it out.  Parity bit
   j of a set tells whether an odd number of its shingles fall on j, so the bits in which two sets
   differ are no more than the shingles in which they do: all of this is exact.

Pairs inside a component are never spelled out, and no partner is left out.  Only banding itself can
miss a link: a pair at the threshold shares none of 64 bands with probability below 1e-6.  Joins on
bands, leaders, labels and shingles deal out keys of very many rows over several tasks.

Edge cases: fewer words than a shingle give one shingle of them all; null texts and texts without
words have an empty set and are linked with nothing; rows with the same doc_id are one document, the
union of their sets; rows without doc_id can't be named, so they are answered with a null component,
linked with nothing and kept; only doc_id and text are read, so other columns may have any name; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_SHARE, cut, read, salted_join, small_batches, unused, worker_holds

BANDS, ROWS = 64, 7
SLOTS = BANDS * ROWS
RING = 1 << 20
#: Words of 64 parity bits for each candidate's set.
PARITY = 8
#: Shingles whose number of documents is told to all tasks, at most.
OFTEN = 1 << 19
#: Bytes of an Arrow batch: it holds sets of hashes, two in a row where pairs are confirmed.
SET_BYTES = 4 << 20
#: Words whose hash a task remembers; making one again costs little.
MEMO_WORDS = 50_000
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], dtype=np.uint64)


class Shingler:
    """Sets of 64-bit shingle hashes of whole texts."""

    def __init__(self, words: int):
        self.words = words
        self.memo: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        found = (text or "").encode("utf-8", "replace").lower().split()
        if not found:
            return np.zeros(0, np.uint64)
        memo = self.memo
        if len(memo) > MEMO_WORDS:
            memo.clear()
        for w in set(found).difference(memo):
            memo[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(memo.__getitem__, found), np.uint64, len(found))
        k = min(self.words, len(h))
        n = len(h) - k + 1
        s = np.full(n, k, np.uint64)
        for j in range(k):
            s = (s ^ h[j : j + n]) * MIX[j % 5]
            s ^= s >> np.uint64(29)
        return np.unique(s)


def ring(seed: int) -> np.ndarray:
    """The second permutation, continued past its end so that shifts are slices."""
    order = np.random.default_rng(seed).permutation(RING).astype(np.int32)
    return np.concatenate([order, order[:SLOTS]])


def bands(shingles: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Hash of each band of the signature."""
    spot = ((shingles * np.uint64(0x9FB21C651E98DF25)) >> np.uint64(44)).astype(np.int64)  # the first permutation: 20 bits
    shifted = np.lib.stride_tricks.sliding_window_view(table, SLOTS)
    least = np.full(SLOTS, RING, np.int32)
    for a in range(0, len(spot), 2048):
        np.minimum(least, shifted[spot[a : a + 2048]].min(axis=0), out=least)
    rows = least.reshape(BANDS, ROWS).astype(np.uint64)
    out = np.zeros(BANDS, np.uint64)
    for r in range(ROWS):
        out = (out ^ rows[:, r]) * MIX[r % 5]
        out ^= out >> np.uint64(31)
    return out.view(np.int64)


def signatures(df: DataFrame, doc_id: str, text: str, words: int, seed: int) -> DataFrame:
    """``id``, ``n_shingles``, two 64-bit halves of the set's digest, and ``bands``."""
    small_batches(df.sparkSession, most=SET_BYTES)
    source = df.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, table = Shingler(words), worker_holds("near_dedup", seed, lambda: ring(seed))
        for batch in batches:
            sizes, digests, found = [], [], []
            for text in batch.column(1).to_pylist():
                s = shingle(text)
                sizes.append(len(s))
                d = xxhash.xxh3_128_intdigest(s.tobytes()) if len(s) else 0
                digests.append(d)
                found.append(bands(s, table) if len(s) else np.zeros(0, np.int64))
            signed = lambda x: x - (1 << 64) if x >> 63 else x
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(sizes, pa.int64()),
                    pa.array([signed(d >> 64) for d in digests], pa.int64()), pa.array([signed(d & ((1 << 64) - 1)) for d in digests], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*found, np.zeros(0, np.int64)]))),
                ],
                ["id", "n_shingles", "d1", "d2", "bands"],
            )

    return source.mapInArrow(run, "id long, n_shingles long, d1 long, d2 long, bands array<long>")


def sets(df: DataFrame, doc_id: str, text: str, words: int) -> DataFrame:
    """``id`` and its sorted shingle hashes ``s``."""
    source = df.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(words)
        for batch in batches:
            found = [shingle(t).view(np.int64) for t in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*found, np.zeros(0, np.int64)])))], ["id", "s"])

    return source.mapInArrow(run, "id long, s array<long>")


def with_parity(held: DataFrame) -> DataFrame:
    """``held`` (id, s) with ``p``: PARITY words of 64 parity bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            found = np.zeros((batch.num_rows, PARITY), np.int64)
            for i in range(batch.num_rows):
                at = column[i].values.to_numpy().view(np.uint64) >> np.uint64(40)
                odd = np.bincount((at % np.uint64(64 * PARITY)).astype(np.int64), minlength=64 * PARITY) & 1
                found[i] = np.packbits(odd.astype(np.uint8)).view(np.int64)
            ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * PARITY)
            yield pa.RecordBatch.from_arrays([batch.column(0), column, pa.ListArray.from_arrays(ends, pa.array(found.reshape(-1)))], ["id", "s", "p"])

    return held.mapInArrow(run, "id long, s array<long>, p array<long>")


def confirmed(pairs: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """``a``, ``b``, ``met`` (size of the intersection) and ``link``, for pairs (a, b) of ids in ``held``;
    b may be a leader of very many."""
    sets_a, sets_b = held.select(F.col("id").alias("a"), "s"), held.select(F.col("id").alias("b"), F.col("s").alias("t"))
    joined = salted_join(pairs, sets_b, ["b"], ["a"]).join(sets_a, "a").select("a", "b", "s", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            met, link = [], []
            left, right = batch.column(2), batch.column(3)
            for i in range(batch.num_rows):
                x, y = left[i].values.to_numpy(), right[i].values.to_numpy()
                k = len(np.intersect1d(x, y, assume_unique=True))
                met.append(k)
                link.append(100 * k >= percent * (len(x) + len(y) - k))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(met, pa.int64()), pa.array(link, pa.bool_())], ["a", "b", "met", "link"])

    return joined.mapInArrow(run, "a long, b long, met long, link boolean")


def components(links: DataFrame, name: str) -> DataFrame:
    """``id`` and ``comp``, the smallest id it is connected to, for every id in ``links`` (a, b).

    Every node takes over the least label around it, and nodes then follow their labels' labels;
    rounds go on until nothing changes, each written to the shared folder."""
    ends = cut(links.select("a", "b").union(links.select("b", "a")).distinct(), f"{name}-ends")
    n = ends.count()
    hot = cut(ends.groupBy("b").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") * HOT_SHARE > n).select("b"), f"{name}-hot")
    label = cut(ends.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("comp")), f"{name}-0")
    k = 0
    while True:
        k += 1
        l1 = label.select(F.col("id").alias("b"), F.col("comp").alias("c"))
        around = salted_join(ends, l1, ["b"], ["a"], hot=hot).groupBy(F.col("a").alias("id")).agg(F.min("c").alias("c"))
        hooked = cut(label.join(around, "id").select("id", F.col("comp").alias("was"), F.least("comp", "c").alias("comp")), f"{name}-h{k}")
        # whoever pointed at a label that has moved on follows it
        moved = hooked.where("comp < was").groupBy(F.col("was").alias("comp")).agg(F.min("comp").alias("to"))
        new = salted_join(hooked, moved, ["comp"], ["id"], "left").select("id", "was", F.least("comp", F.coalesce("to", "comp")).alias("comp"))
        new = cut(new, f"{name}-{k}")
        if new.where("comp < was").isEmpty():
            return new.select("id", "comp")
        label = new.select("id", "comp")


def could(u1: str, n1: str, u2: str, n2: str, percent: int):
    """Whether two sets could be linked, given how many shingles each shares with any other at all."""
    most = F.least(u1, u2)
    return most * 100 >= (F.col(n1) + F.col(n2) - most) * percent


def alike(p1: str, n1: str, p2: str, n2: str, percent: int):
    """Whether two sets' parities allow a link: they differ in no more bits than linked sets may in shingles."""
    bits = [F.bit_count(F.get(p1, k).bitwiseXOR(F.get(p2, k))) for k in range(PARITY)]
    return sum(bits[1:], bits[0]) * (100 + percent) <= (F.col(n1) + F.col(n2)) * (100 - percent)


def often(docs: DataFrame, held: DataFrame) -> tuple[np.ndarray, np.ndarray, bool]:
    """Shingles of more than one in OFTEN of those of ``docs``, sorted, and how many documents have each;
    and whether these are all that more than one has.  Fewer than OFTEN by that definition."""
    total = docs.agg(F.sum("n")).head()[0] or 0
    flat = held.join(docs.select("id"), "id", "left_semi").select(F.explode("s").alias("x"))
    counts = flat.groupBy("x").agg(F.count(F.lit(1)).alias("c")).where((F.col("c") > 1) & (F.col("c") * OFTEN > total))
    found = counts.toArrow()
    x, c = (found.column(k).to_numpy() for k in ("x", "c"))
    order = np.argsort(x)
    return x[order], c[order], total < 2 * OFTEN


def rarest(docs: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """``docs`` (id, comp, u, n, p) with each of their rarest shingles ``x``, and whether it also leads from
    the smaller set (``short``).  The order is one for all: by the number of documents, as far as ``often``
    tells it, then by hash.  Those that no other document has lead nowhere and are left out where they are known."""
    small_batches(docs.sparkSession, most=SET_BYTES)
    known = docs.sparkSession.sparkContext.broadcast(often(docs, held))
    columns = ["id", "comp", "u", "n", "p"]
    rows = docs.select(*columns).join(held.select("id", "s"), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xs, counts, every = known.value
        for batch in batches:
            column, at, found, short = batch.column(5), [], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
            for i in range(batch.num_rows):
                s = column[i].values.to_numpy()
                c = np.ones(len(s), np.int64)
                if len(xs):
                    k = np.minimum(np.searchsorted(xs, s), len(xs) - 1)
                    c = np.where(xs[k] == s, counts[k], 1)
                order = np.lexsort((s, c))
                order = order[: len(s) + len(s) * -percent // 100 + 1]
                less = np.arange(len(order)) < len(s) + len(s) * -2 * percent // (100 + percent) + 1
                if every:
                    less, order = less[c[order] > 1], order[c[order] > 1]
                at += [i] * len(order)
                found.append(s[order])
                short.append(less)
            kept = [x.take(pa.array(at, pa.int64())) for x in batch.columns[:5]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(np.concatenate(found)), pa.array(np.concatenate(short))], [*columns, "x", "short"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in columns) + ", x long, short boolean")


def meetings(docs: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """Pairs of ``docs`` (id, comp, u, n, p; the columns with ``_a`` and ``_b``) that meet in a rare shingle.

    Joined by rare shingle, size class and which of the two is smaller; see the module's text for why
    no link is lost."""
    step = F.lit(math.log(100 / percent) * (1 + 1e-9))  # rounding must not move sets two classes apart
    keyed = rarest(docs, held, percent).withColumn("size", F.floor(F.log(F.col("n").cast("double")) / step).cast("int"))
    keyed = cut(keyed, "near-keyed")
    # the component that most of a shingle's documents are in
    most = keyed.groupBy("x", "comp").agg(F.count(F.lit(1)).alias("c")).groupBy("x").agg(F.max_by("comp", "c").alias("most"), F.count(F.lit(1)).alias("comps"))
    keyed = cut(salted_join(keyed, most.where("comps > 1").select("x", "most"), ["x"], ["id"]), "near-mixed")
    columns = ("id", "comp", "u", "n", "p")
    # where each of the two may stand: as the smaller by its rarest shingles only, as the larger by all its keys
    small = lambda *sizes: F.array(*[F.struct(F.lit(True).alias("a_small"), x.alias("size")) for x in sizes])
    large = lambda *sizes: F.array(*[F.struct(F.lit(False).alias("a_small"), x.alias("size")) for x in sizes])
    size, none = F.col("size"), F.array().cast("array<struct<a_small:boolean,size:int>>")
    places = F.concat(F.when(F.col("short"), small(size, size + 1)).otherwise(none), large(size, size - 1))
    one = keyed.where("comp <> most").withColumn("at", F.explode(places)).select("x", "at.a_small", "at.size", "most", *[F.col(c).alias(f"{c}_a") for c in columns])
    places = F.concat(small(size), F.when(F.col("short"), large(size)).otherwise(none))
    other = keyed.withColumn("at", F.explode(places)).select("x", "at.a_small", "at.size", *[F.col(c).alias(f"{c}_b") for c in columns])
    pairs = salted_join(other, one, ["x", "a_small", "size"], ["id_b"])
    return pairs.where(F.col("a_small") == (F.struct("n_a", "id_a") < F.struct("n_b", "id_b")))


def residual(docs: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """Pairs (``a``, ``b``) of ``docs`` (id, comp, u, n, p) of different components that may be linked."""
    pairs = meetings(docs, held, percent)
    once = (F.col("comp_b") == F.col("most")) | (F.col("id_b") < F.col("id_a"))
    pairs = pairs.where((F.col("comp_a") != F.col("comp_b")) & once & could("u_a", "n_a", "u_b", "n_b", percent) & alike("p_a", "n_a", "p_b", "n_b", percent))
    return pairs.select(F.greatest("id_a", "id_b").alias("a"), F.least("id_a", "id_b").alias("b")).distinct()


def classes(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80, seed: int = 11) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id``: one row per document."""
    sigs = cut(signatures(df, doc_id, text, words, seed), "near-signatures")
    docs = sigs.where("id is not null").select("id", "n_shingles", "d1", "d2")
    full = docs.where("n_shingles > 0")
    reps = full.groupBy("d1", "d2").agg(F.min("id").alias("rep"), F.max("n_shingles").alias("n"))
    reps = cut(reps, "near-reps")
    chosen = sigs.join(reps.select(F.col("rep").alias("id")), "id", "left_semi").select("id", F.posexplode("bands").alias("band", "h"))
    shared = cut(chosen.groupBy("band", "h").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "near-shared")
    n = reps.count() * BANDS
    hot = shared.where(F.col("c") * HOT_SHARE * BANDS > n).select("band", "h")
    hot = cut(hot, "near-hot")  # bands of a thousandth of the sets: fewer than 1000 of each number
    members = cut(salted_join(chosen, shared.select("band", "h"), ["band", "h"], ["id"], hot=hot), "near-members")
    candidates = members.select("id").distinct()
    texts = df.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).join(candidates, "id", "left_semi")
    whole = sets(texts, "id", "text", words).groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("s")))).alias("s"))
    held = cut(with_parity(whole), "near-sets")
    # the bound: shingles that no other candidate has can't be met
    flat = held.select("id", F.explode("s").alias("x"))
    lone = flat.groupBy("x").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("id")).where("c = 1")
    lone = lone.groupBy("id").agg(F.count(F.lit(1)).alias("lone"))
    sizes = held.select("id", "p", F.size("s").alias("n")).join(lone, "id", "left")
    sizes = sizes.select("id", "p", "n", (F.col("n") - F.coalesce("lone", F.lit(0))).alias("u"))
    sizes = cut(sizes.where(F.col("u") * 100 >= F.col("n") * percent), "near-sizes")
    members = cut(members.join(sizes, "id"), "near-left")
    # every document against the leader of each of its bands
    rank = F.struct((-F.col("u") / F.col("n")).alias("r"), F.col("id").alias("id"), F.col("u").alias("u"), F.col("n").alias("n"), F.col("p").alias("p"))
    leaders = members.groupBy("band", "h").agg(F.min(rank).alias("l"), F.count(F.lit(1)).alias("c")).where("c > 1")
    leaders = leaders.select("band", "h", F.col("l.id").alias("lead"), F.col("l.u").alias("lead_u"), F.col("l.n").alias("lead_n"), F.col("l.p").alias("lead_p"))
    led = salted_join(members, leaders, ["band", "h"], ["id"], hot=hot).where(F.col("id") != F.col("lead"))
    led = led.where(could("u", "n", "lead_u", "lead_n", percent) & alike("p", "n", "lead_p", "lead_n", percent)).select(F.col("id").alias("a"), F.col("lead").alias("b")).distinct()
    first = cut(confirmed(cut(led, "near-led"), held, percent), "near-first")
    links = first.where("link").select("a", "b")
    comp = components(links, "near-comp1")
    # what is left: documents in bands of different components
    known = cut(members.select("id", "band", "h", "u", "n", "p").join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id")), "near-known")
    apart = known.groupBy("band", "h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("band", "h")
    open_ = salted_join(known, apart, ["band", "h"], ["id"], hot=hot).groupBy("id").agg(*[F.first(c).alias(c) for c in ("comp", "u", "n", "p")])
    rest = cut(residual(cut(open_, "near-open"), held, percent), "near-rest")
    more = cut(confirmed(rest, held, percent).where("link").select("a", "b"), "near-second")
    if not more.isEmpty():
        comp = components(links.unionByName(more), "near-comp2")
    # classes of sets, named by the smallest id of all their documents
    of_rep = reps.join(comp, F.col("rep") == F.col("id"), "left").select("d1", "d2", "rep", F.coalesce("comp", "rep").alias("comp"))
    own = docs.where("n_shingles = 0").select("id", "n_shingles", F.col("id").alias("component_id"))
    hot = full.groupBy("d1", "d2").count().where(F.col("count") * HOT_SHARE > full.count()).select(F.col("d1").alias("e1"), F.col("d2").alias("e2"))
    named_hot = of_rep.join(F.broadcast(hot), (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2"))).select("e1", "e2", F.col("comp").alias("c"))
    marked = full.join(F.broadcast(named_hot), (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2")), "left")
    many = marked.where("c is not null").select("id", "n_shingles", F.col("c").alias("component_id"))
    few = marked.where("c is null").select("id", "n_shingles", "d1", "d2").join(of_rep, ["d1", "d2"]).select("id", "n_shingles", F.col("comp").alias("component_id"))
    unnamed = sigs.where("id is null").select("id", "n_shingles", F.lit(None).cast("long").alias("component_id"))
    out = own.unionByName(many).unionByName(few).unionByName(unnamed)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def keep_one(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``df`` that stay, one document of each class, with all their columns; rows without an id stay."""
    name = unused(df, "__gone")
    gone = classes(df, doc_id, text, words, percent).where("doc_id <> component_id").select(F.col("doc_id").alias(name))
    return df.join(gone, F.col(doc_id) == F.col(name), "left_anti")


def op8_near_dedup(spark, sf_dir: str) -> DataFrame:
    out = classes(read(spark, sf_dir, "documents").select("doc_id", "text"), words=4, percent=80)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
