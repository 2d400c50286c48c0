"""Two tokenizers' tokens aligned by bytes, and how often which two go together (operator 13).

Both tokenizers code the same bytes: a space and the text.  Offsets where a token of each ends cut the
tokens into groups, and the two tokens that end there are linked.  A link's key is one int64, the second
tokenizer's id above the first's.

How often each key occurs in the corpus is counted in three steps: every partition of documents counts
its own keys with ``np.unique`` (in rounds of bounded size), the partial counts are sorted by ranges of
keys over all tasks, and each task sums the runs of equal keys of its range.  A key of a third of all
links comes as one row for each partition and round, like any other.  The sorted counts are written.

No token of either tokenizer goes on past a space, so a text is coded as its stretches between single
spaces, each with the space before it, and a worker remembers what stretches were coded and aligned as.
Where that could depend on the text around (two spaces in a row, other white space behind a space, the
second tokenizer's own sign for a space) the text is coded whole.

For the documents' figures the counts go back to the partitions whose keys they are: each partition gets
the sorted counts of its own keys, keeps them in a file without a name that it maps into memory, and looks
its documents' links up by ``searchsorted``.  So no task holds the counts of the whole corpus, and the
documents' links move once, packed.  Only the highest count of each id of the second tokenizer is
broadcast: a row for each entry of its vocabulary at most.

Edge cases: null and empty texts, and texts that one of the tokenizers doesn't give back byte by byte,
have no tokens: zeros and an empty digest; tokens are never empty, so where two end together there is
one pair; special tokens' strings in a text are plain text; repeated rows and rows without doc_id are
answered each; only doc_id and text are read, so other columns may have any name; an empty table gives
an empty result.  Texts of over ``LONG`` characters are coded stretch by stretch, cut at a space between
two ASCII letters or digits, where neither tokenizer has tokens across; texts without such a space stay whole.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import tempfile
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_alphabet
from .common import asset, cut, read, small_batches

LONG = 1 << 18
#: Different keys that a task counts before it hands them on.
HELD = 1 << 21
#: Links that are looked up at a time.
AT_ONCE = 1 << 19
#: Bytes of remembered stretches' keys, names and links; each has some 300 more.  And stretches coded at a time.
MEMO_BYTES, MEMO_STRETCHES, CODED = 20 << 20, 250_000, 4096
SPLIT = re.compile("(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")

#: What is said of a text without tokens.
NONE = (0, 0, 0, "", b"")
ALIGNED = "part int, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links binary"


def stretches(text: str) -> Iterator[str]:
    """The text in parts that a space joins again, each of about ``LONG`` characters."""
    at = 0
    while len(text) - at > LONG and (found := SPLIT.search(text, at + LONG)):
        yield text[at : found.start()]
        at = found.end()
    yield text[at:]


def pack(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (b.astype(np.int64) << 32) | a.astype(np.int64)


class Pair:
    """The two tokenizers, and their tokens' bytes and decimal names."""

    def __init__(self, a: str, b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores out
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        with open(a, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        vocab = spec["model"]["vocab"] | {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.bytes_a = [b""] * (1 + max(vocab.values()))
        for token, i in vocab.items():
            self.bytes_a[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.length_a, self.length_b = (np.array([len(x) for x in t]) for t in (self.bytes_a, self.bytes_b))
        # a name and what follows it (inside a group, then at its end) in eight bytes, moved as one number
        self.names = [np.array([f"{i}{end}" for end in ends for i in range(len(t))], "S8").view(np.uint64) for t, ends in ((self.bytes_a, ",|"), (self.bytes_b, ",;"))]
        self.memo: dict[str, tuple[int, bytes, bytes] | None] = {}
        self.held = 0

    def learn(self, words: list[str]) -> None:
        """Remember each of ``words`` as (number of A's tokens, groups' names, links), or as None if texts with
        it are to be coded whole."""
        if self.held > MEMO_BYTES or len(self.memo) > MEMO_STRETCHES:
            self.memo.clear()
            self.held = 0
        alone = [w for w in words if w[:1].isprintable() and w and "▁" not in w]
        self.memo.update(dict.fromkeys(words))
        for at in range(0, len(alone), CODED):
            self._learn(alone[at : at + CODED])

    def _learn(self, words: list[str]) -> None:
        ends = np.cumsum([len(w.encode("utf-8", "replace")) + 1 for w in words])
        if (coded := next(self.coded([" ".join(words)]))) is not None:
            a, b = coded
            cuts_a, cuts_b = (np.searchsorted(e, ends) for e in (np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])))
            if np.array_equal(np.cumsum(self.length_a[a])[cuts_a], ends) and np.array_equal(np.cumsum(self.length_b[b])[cuts_b], ends):
                said, last_a, last_b = self.groups(a, b)
                names = said.tobytes().translate(None, b"\0")
                links = np.stack([a[last_a], b[last_b]], 1).astype("<u4").tobytes()
                past_a, past_b = cuts_a + 1, cuts_b + 1
                written = np.cumsum((said.view(np.uint8).reshape(-1, 8) != 0).sum(axis=1))[past_a + past_b - 1].tolist()
                linked = (8 * np.cumsum(last_a)[cuts_a]).tolist()
                for w, n, x, y, u, v in zip(words, np.diff(past_a, prepend=0).tolist(), [0, *written], written, [0, *linked], linked):
                    self.memo[w] = n, names[x:y], links[u:v]
                self.held += len(names) + len(links) + int(ends[-1])
                return
        if len(words) > 1:  # one of them is not given back: which?
            self._learn(words[: len(words) // 2])
            self._learn(words[len(words) // 2 :])

    def coded(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
        """Both tokenizers' ids of each text, or None if one doesn't give the bytes back."""
        parts = [list(stretches(t)) for t in texts]
        flat = list(chain.from_iterable(parts))
        ids_a = iter(self.a.encode_batch_fast([f" {p}" for p in flat], add_special_tokens=False))
        ids_b = iter(self.b.encode(flat, num_threads=1))
        for text, own in zip(texts, parts, strict=True):
            a = next(ids_a).ids if len(own) == 1 else list(chain.from_iterable(next(ids_a).ids for _ in own))
            b = next(ids_b) if len(own) == 1 else list(chain.from_iterable(next(ids_b) for _ in own))
            want = f" {text}".encode("utf-8", "replace")
            same = b"".join(map(self.bytes_a.__getitem__, a)) == want and b"".join(map(self.bytes_b.__getitem__, b)) == want
            yield (np.array(a), np.array(b)) if same else None

    def __call__(self, texts: Iterable[str | None]) -> Iterator[tuple[int, int, int, str, bytes]]:
        """For each text the numbers of tokens and groups, the groups' digest, and the links packed."""
        waiting: list[str | None] = []

        def done() -> Iterator[tuple[int, int, int, str, bytes]]:
            split = [t.split(" ") if t else [] for t in waiting]
            # learning may forget first, so all that is asked for is learned at once then
            asked = set(chain.from_iterable(split))
            if new := asked.difference(self.memo):
                full = self.held > MEMO_BYTES or len(self.memo) > MEMO_STRETCHES
                self.learn(list(asked if full else new))
            for t, words in zip(waiting, split, strict=True):
                found = list(map(self.memo.__getitem__, words))
                if not t:
                    yield NONE
                elif None in found:
                    yield self.aligned(next(self.coded([t])))
                else:
                    n_a, names, links = zip(*found, strict=True)
                    said, both, n = b"".join(names), np.frombuffer(b"".join(links), "<u4").reshape(-1, 2), sum(n_a)
                    tokens = sum(map(said.count, (b",", b"|", b";")))
                    yield n, tokens - n, len(both), hashlib.sha256(said[:-1]).hexdigest(), packed(both[:, 0], both[:, 1])

        for text in texts:
            waiting.append(text)
            if sum(len(t or "") for t in waiting) > LONG:
                yield from done()
                waiting = []
        yield from done()

    def aligned(self, coded: tuple[np.ndarray, np.ndarray] | None) -> tuple[int, int, int, str, bytes]:
        if coded is None:
            return NONE
        a, b = coded
        said, last_a, last_b = self.groups(a, b)
        digest = hashlib.sha256(said.tobytes().translate(None, b"\0")[:-1]).hexdigest()
        return len(a), len(b), int(last_a.sum()), digest, packed(a[last_a], b[last_b])

    def groups(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The tokens' names as they are written down, eight bytes each, and which of both end a group."""
        end_a, end_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        at = np.searchsorted(end_b, end_a)
        last_a = end_b[at] == end_a
        last_b = np.zeros(len(b), bool)
        last_b[at[last_a]] = True
        # where each group's tokens stand when all are written down: A's, then B's
        past_a, past_b = np.flatnonzero(last_a) + 1, np.flatnonzero(last_b) + 1
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        names_a, names_b = self.names
        said = np.empty(len(a) + len(b), np.uint64)
        said[np.arange(len(a)) + np.r_[0, past_b[:-1]][group_a]] = names_a[a + last_a * len(self.bytes_a)]
        said[np.arange(len(b)) + past_a[group_b]] = names_b[b + last_b * len(self.bytes_b)]
        return said, last_a, last_b


def packed(a: np.ndarray, b: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.concatenate([a, b]).astype("<u4").tobytes())


def unpacked(blob: bytes) -> np.ndarray:
    """The keys of a document's links."""
    if not blob:
        return np.zeros(0, np.int64)
    ids = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), "<u4").reshape(2, -1)
    return pack(ids[0], ids[1])


_pairs: dict[tuple[str, str], Pair] = {}


def align(df: DataFrame, a: str, b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of ``df``: ``part`` (of which partition), ``doc_id``, numbers, digest and packed links."""
    small_batches(df.sparkSession)
    source = df.select(F.spark_partition_id().alias("part"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    paths = asset(a), asset(b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if paths not in _pairs:
            _pairs[paths] = Pair(*paths)
        for batch in batches:
            found = list(_pairs[paths](t.as_py() for t in batch.column(2)))
            columns = zip(*found, strict=True) if found else ((),) * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], [x.split()[0] for x in ALIGNED.split(", ")])

    return source.mapInArrow(run, ALIGNED)


def partial_counts(aligned: DataFrame) -> DataFrame:
    """``part, key, n``: each partition's own counts, in rounds of about ``HELD`` different keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, keys, counts, waiting = -1, np.zeros(0, np.int64), np.zeros(0, np.int64), []

        def merged() -> None:
            nonlocal keys, counts, waiting
            fresh, n = np.unique(np.concatenate(waiting), return_counts=True) if waiting else (keys[:0], counts[:0])
            both, weights, waiting = np.concatenate([keys, fresh]), np.concatenate([counts, n]), []
            keys, at = np.unique(both, return_inverse=True)
            counts = np.zeros(len(keys), np.int64)
            np.add.at(counts, at, weights)

        def handed() -> pa.RecordBatch:
            nonlocal keys, counts
            merged()
            out = pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), part, np.int32)), pa.array(keys), pa.array(counts)], ["part", "key", "n"])
            keys, counts = keys[:0], counts[:0]
            return out

        held = 0
        for batch in batches:
            for of, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if of != part:
                    if part >= 0:
                        yield handed()
                    part, held = of, 0
                waiting.append(unpacked(blob.as_py()))
                held += len(waiting[-1])
                if held > HELD:
                    merged()
                    held = 0
                    if len(keys) > HELD:
                        yield handed()
        if part >= 0:
            yield handed()

    return aligned.select("part", "links").mapInArrow(run, "part int, key long, n long")


def summed_runs(partial: DataFrame) -> DataFrame:
    """``key, n`` of the whole corpus, sorted by range: each task sums the runs of equal keys of its range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n = np.zeros(0, np.int64), np.zeros(0, np.int64)  # the last run, which may go on
        for batch in batches:
            keys = np.concatenate([key, batch.column(0).to_numpy()])
            if not len(keys):
                continue
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            sums = np.add.reduceat(np.concatenate([n, batch.column(1).to_numpy()]), starts)
            key, n = keys[starts[-1:]], sums[-1:]
            yield pa.RecordBatch.from_arrays([pa.array(keys[starts[:-1]]), pa.array(sums[:-1])], ["key", "n"])
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["key", "n"])

    return partial.select("key", "n").repartitionByRange("key").sortWithinPartitions("key").mapInArrow(run, "key long, n long")


class Shard:
    """A partition's keys, sorted, with a value each: written to a nameless file and mapped into memory."""

    def __init__(self):
        self.keys, self.values = tempfile.TemporaryFile(), tempfile.TemporaryFile()
        self.mapped: tuple[np.ndarray, np.ndarray] | None = None
        self.size = 0

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.keys.write(keys.tobytes())
        self.values.write(values.tobytes())
        self.size += len(keys)

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        if not len(keys):
            return keys
        if self.mapped is None:
            for f in (self.keys, self.values):
                f.flush()
            self.mapped = np.memmap(self.keys, np.int64, "r", shape=(self.size,)), np.memmap(self.values, np.int64, "r", shape=(self.size,))
        asked, back = np.unique(keys, return_inverse=True)
        at = np.searchsorted(self.mapped[0], asked)
        return self.mapped[1][at][back]

    def close(self) -> None:
        self.mapped = None
        self.keys.close()
        self.values.close()


def looked_up(rows: DataFrame) -> DataFrame:
    """Documents' figures; in each partition of ``rows`` a part's counts stand before its documents."""
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")

    def figures(shard: Shard, docs: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found, sizes, a = [], [], 0
        blobs = docs.column("links")

        def flush(upto: int) -> pa.RecordBatch:
            nonlocal found, sizes, a
            values = shard[np.concatenate(found)]
            ends = np.cumsum(sizes)
            total = lambda x: np.diff(np.r_[0, np.r_[0, np.cumsum(x)][ends]])
            part = docs.slice(a, upto - a)
            own = {"n_links": pa.array(np.array(sizes, np.int64)), "n_best": pa.array(total(values & 1)), "count_sum": pa.array(total(values >> 1))}
            found, sizes, a = [], [], upto
            return pa.RecordBatch.from_arrays([own[n] if n in own else part.column(n) for n in names], list(names))

        for i in range(docs.num_rows):
            found.append(unpacked(blobs[i].as_py()))
            sizes.append(len(found[-1]))
            if sum(sizes) > AT_ONCE:
                yield flush(i + 1)
        if found:
            yield flush(docs.num_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, part = Shard(), -1
        for batch in batches:
            parts, kinds = batch.column("part").to_numpy(), batch.column("kind").to_numpy()
            cuts = np.flatnonzero((parts[1:] != parts[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, len(parts)], strict=True):
                if a == b:
                    continue
                if parts[a] != part:
                    shard.close()
                    shard, part = Shard(), parts[a]
                some = batch.slice(a, b - a)
                if kinds[a]:
                    yield from figures(shard, some)
                else:
                    shard.add(some.column("key").to_numpy(), some.column("value").to_numpy())
        shard.close()

    return rows.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def aligned_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    """Per row of ``df`` (doc_id, text): numbers of tokens, groups and links, and what the corpus says of the links.

    ``n_best`` links are, of all that hold their second token, a most frequent one; ``count_sum`` adds up
    how often each link's pair is linked in the corpus."""
    aligned = cut(align(df, a, b), "align-links", "zstd")
    partial = cut(partial_counts(aligned), "align-partial", "zstd")
    counts = cut(summed_runs(partial), "align-counts", "zstd")
    of = F.shiftright("key", 32)
    best = counts.groupBy(of.alias("id_b")).agg(F.max("n").alias("most"))  # a row for each token of the vocabulary
    marked = counts.withColumn("id_b", of).join(F.broadcast(best), "id_b").select("key", (F.col("n") * 2 + (F.col("n") == F.col("most")).cast("long")).alias("value"))
    back = partial.select("part", "key").join(marked, "key").select("part", F.lit(0).alias("kind"), "key", "value")
    docs = aligned.withColumn("kind", F.lit(1))
    rows = back.unionByName(docs, allowMissingColumns=True)
    parts = 1 + (aligned.agg(F.max("part")).head()[0] or 0)
    rows = rows.repartitionById(parts, "part").sortWithinPartitions("part", "kind", "key")
    small_batches(df.sparkSession, 10_000)
    return looked_up(rows)


def op13_align(spark, sf_dir: str) -> DataFrame:
    return aligned_counts(read(spark, sf_dir, "documents").select("doc_id", "text"), "byte_bpe_50k.json", "piece_bpe_32k.model")
