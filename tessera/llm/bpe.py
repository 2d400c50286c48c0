"""Byte-level BPE encoding and decoding (operator 1).

Encoding never replays merges.  One Aho-Corasick pass over a pre-token finds every vocabulary token
in it (single bytes by a table); the longest one at each offset is tried first and backtracked to shorter prefixes until each
neighbouring pair is *compatible*, i.e. merging their joined bytes would give back that very pair.
Such a chain is unique and equals the merge result, and each offset is abandoned at most once, so the
work is linear in the text.  Decoding gathers slices of one byte blob through an offset table.

Edge cases: null and empty texts give no ids and an empty decoded text; repeated rows are encoded
independently; an empty table gives an empty result; other columns of the input are left out unless
named in ``keep``, where those named like an output are replaced by it.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import asset, read, small_batches, worker_holds

#: Fixed value: how byte-level BPE splits text before merging, for classes L (letters), N (numbers) and
#: S (white space) of characters.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"
#: Stretches between spaces, pre-tokens of longer stretches, and seams remembered by one worker; of what is
#: full, the half used last stays.  An entry takes about 200 bytes, and an executor has a worker for each core.
MEMO_WORDS, MEMO_SEAMS = 150_000, 150_000
#: Words for a query that shares its workers' memory with no other step: rare words come again, and coding one costs ten look-ups.
MEMO_ALONE = 400_000


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of byte-level vocabularies, mapped to bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@cache
def split_pattern() -> str:
    """``PATTERN`` with the classes of the tokenizers library, whose Unicode tables are of its own version.

    Its splitter is shown every character behind a letter, a digit and a sign; where it doesn't split,
    the two are of one class.  What is of none of the three is white space."""
    from tokenizers.pre_tokenizers import ByteLevel

    splitter = ByteLevel(add_prefix_space=False, use_regex=True)
    # planes 4 to 13 hold no characters
    points = [*range(0xD800), *range(0xE000, 0x40000), *range(0xE0000, 0xE1000)]
    classes: dict[str, list[int]] = {"L": [], "N": [], "O": []}
    for name, before in (("L", "a"), ("N", "1"), ("O", "!")):
        for at in range(0, len(points), 4096):
            part = points[at : at + 4096]
            pieces = splitter.pre_tokenize_str("".join(f"x {before}{chr(p)}" for p in part))
            starts = {a for _, (a, _) in pieces}
            classes[name] += [p for i, p in enumerate(part) if 4 * i + 3 not in starts]
    known = set().union(*classes.values())
    classes["S"] = [p for p in points if p not in known]

    def ranges(points: list[int]) -> str:
        a = np.array(points)
        cuts = np.flatnonzero(np.diff(a) > 1)
        firsts, lasts = np.r_[a[:1], a[cuts + 1]], np.r_[a[cuts], a[-1:]]
        return "".join(f"\\U{x:08X}" if x == y else f"\\U{x:08X}-\\U{y:08X}" for x, y in zip(firsts, lasts, strict=True))

    return PATTERN.replace("{L}", ranges(classes["L"])).replace("{N}", ranges(classes["N"])).replace("{S}", ranges(classes["S"]))


class Tables:
    """Everything the coder looks up, built from a tokenizer file's vocabulary and merges."""

    def __init__(self, spec: dict):
        alphabet = byte_alphabet()
        model = spec["model"]
        raw = lambda token: "".join(chr(alphabet[ch]) for ch in token)
        vocab = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.ids = {raw(t): i for t, i in vocab.items() if t not in self.special}
        size = self.start = 1 + max([*vocab.values(), *self.special.values()])
        self.parts = np.full((size, 2), -1, dtype=np.int64)
        self.rank = [-1] * size
        self.pairs: dict[tuple[int, int], int] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = (self.ids[raw(x)] for x in (merge.split(" ") if isinstance(merge, str) else merge))
            made = vocab["".join(merge.split(" ") if isinstance(merge, str) else merge)]
            self.pairs[left, right] = rank
            if self.rank[made] < 0:
                self.rank[made] = rank
                self.parts[made] = left, right
        self.left = self.parts[:, 0].tolist()
        self.right = self.parts[:, 1].tolist()
        pieces = [b""] * size
        for token, i in self.ids.items():
            pieces[i] = token.encode("latin-1")
        for token, i in self.special.items():
            pieces[i] = token.encode()
        self.offsets = np.zeros(size + 1, dtype=np.int64)
        np.cumsum([len(p) for p in pieces], out=self.offsets[1:])
        self.blob = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        # Tokens that merging would never leave whole are no candidates.
        self.ids = {t: i for t, i in self.ids.items() if self.left[i] < 0 or self._whole(i)}
        self.length = [0] * size
        self.shorter = [-1] * size
        for token, i in self.ids.items():
            self.length[i] = len(token)
            for k in range(len(token) - 1, 0, -1):
                if (j := self.ids.get(token[:k])) is not None:
                    self.shorter[i] = j
                    break

    def _whole(self, token: int) -> bool:
        left, right = self.left[token], self.right[token]
        return self._stays_apart(left, right, self.rank[token])

    def _stays_apart(self, a: int, b: int, until: int) -> bool:
        """Whether no merge of rank below ``until`` joins the two sides of the seam between a and b.

        The seam's history is walked backwards: whichever neighbour was merged last is undone first,
        and the pair that stood there before must not have been merged while it lasted.
        """
        alive = until
        while True:
            joined = self.pairs.get((a, b))
            if joined is not None and joined < alive:
                return False
            ra, rb = self.rank[a], self.rank[b]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                a, alive = self.right[a], ra
            else:  # equal merges happen left to right, so the pair still stood at that rank
                b, alive = self.left[b], rb + 1

    def compatible(self, a: int, b: int) -> bool:
        return self._stays_apart(a, b, 1 << 60)


class Remembered(dict):
    """What ``make`` gives for a key, remembered for the ``most`` keys at most; those not asked for since the
    last half of them came are forgotten first."""

    def __init__(self, make: Callable, most: int):
        self.make, self.half, self.old = make, most // 2, {}

    def __missing__(self, key):
        if (found := self.old.pop(key, None)) is None:
            found = self.make(key)
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found


class Coder:
    """Encodes and decodes whole texts; one per worker.  Ids are bytes of int32 inside, as these are joined fast."""

    def __init__(self, tables: Tables, pattern: str, most: int | None = None):
        import ahocorasick

        self.t = tables
        self.automaton = ahocorasick.Automaton()
        for token, i in tables.ids.items():
            if len(token) > 1:
                self.automaton.add_word(token, (len(token) - 1, i))
        self.automaton.make_automaton()
        self.single = [tables.ids.get(chr(b), -1) for b in range(256)]
        # re looks a character up in a table, where regex walks the ranges of a class
        self.split = re.compile(pattern).findall
        parts = pattern.split("|")
        self.letters, self.blank = re.compile(parts[-5].removeprefix(" ?")).match, re.compile(parts[-1]).match
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(tables.special, key=len, reverse=True))) + ")") if tables.special else None
        self.memo = Remembered(self.word, most or MEMO_WORDS)
        self.stretches = Remembered(self._stretch, most or MEMO_WORDS)
        self.seams = Remembered(self._fits, MEMO_SEAMS)

    def _fits(self, seam: int) -> int:
        """Of a token and its shorter prefixes the longest that may stand behind another; -1 if none may."""
        before, token = seam >> 32, seam & 0xFFFFFFFF
        while before != self.t.start and token >= 0 and not self.t.compatible(before, token):
            token = self.t.shorter[token]
        return token

    def word(self, word: str) -> bytes:
        """Ids of one pre-token."""
        t, data = self.t, word.encode()
        raw = data.decode("latin-1")
        if (whole := t.ids.get(raw)) is not None:
            return whole.to_bytes(4, "little")
        n, length, shorter, seams = len(raw), t.length, t.shorter, self.seams
        longest = [self.single[b] for b in data]
        for end, (back, token) in self.automaton.iter(raw):
            longest[end - back] = token  # ends ascend, so the last is the longest
        dead = bytearray(n + 1)
        out: list[int] = []
        at, token, before = 0, longest[0], t.start
        while at < n:
            while token >= 0:
                token = seams[before << 32 | token]
                if token < 0 or not dead[at + length[token]]:
                    break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += length[token]
                before = token
                token = longest[at] if at < n else -1
            elif out:
                dead[at] = 1
                token = out.pop()
                at -= length[token]
                token = shorter[token]
                before = out[-1] if out else t.start
            else:
                raise ValueError("the vocabulary lacks a byte of the text")
        return struct.pack(f"<{len(out)}i", *out)

    def _spaced(self, text: str) -> bytes:
        """Ids of a stretch, pre-token by pre-token."""
        return b"".join(map(self.memo.__getitem__, self.split(text)))

    def _stretch(self, w: str) -> bytes:
        """Ids of a space and ``w``; none if that depends on the text around it.

        Letters at its beginning are a pre-token with the space, whatever follows."""
        if head := self.letters(w):
            if (at := head.end()) == len(w):
                return self.word(" " + w)
            return self.stretches[w[:at]] + (self.memo[w[at:]] if at + 1 == len(w) else self._spaced(w[at:]))
        return b"" if not w or self.blank(w) else self._spaced(" " + w)

    def _plain(self, text: str) -> bytes:
        """A pre-token holds a space only as its first character, so a text is coded stretch by stretch
        between its spaces, each stretch once; white space after a space needs the text around it."""
        first, *found = text.split(" ")
        parts = list(map(self.stretches.__getitem__, found))
        if b"" in parts:
            return self._spaced(text)
        return self._spaced(first) + b"".join(parts)

    def coded(self, text: str | None) -> bytes:
        """The ids of ``text`` as bytes of int32, least byte first."""
        if not text:
            return b""
        if self.special is None or not any(s in text for s in self.t.special):
            return self._plain(text)
        specials = self.t.special
        return b"".join(specials[p].to_bytes(4, "little") if p in specials else self._plain(p) for p in self.special.split(text))

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.coded(text), "<i4").tolist()

    def decode(self, ids: np.ndarray) -> str:
        """Bytes of all ids, gathered by offset; invalid UTF-8 becomes the replacement character."""
        ids = np.asarray(ids, dtype=np.int64)
        if not len(ids):
            return ""
        starts = self.t.offsets[ids]
        lengths = self.t.offsets[ids + 1] - starts
        ends = np.cumsum(lengths)
        at = np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1])
        return self.t.blob[at].tobytes().decode("utf-8", "replace")


def _worker(spec) -> Coder:
    return worker_holds("bpe", spec.value, lambda: Coder(Tables(json.loads(spec.value[0])), *spec.value[1:]))


def _spec(df: DataFrame, tokenizer: str, most: int | None = None):
    """The tokenizer file's text, read by the driver, the splitting pattern and how much to remember; their
    size is that of the vocabulary."""
    with open(asset(tokenizer), encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast((f.read(), split_pattern(), most))


def encode(df: DataFrame, tokenizer: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), decoded: bool = False, most: int | None = None) -> DataFrame:
    """``keep`` columns, then ``ids`` (array of int) and, if asked for, ``decoded`` (text made of the ids); a
    worker remembers ``most`` words (``MEMO_WORDS`` unless given)."""
    small_batches(df.sparkSession)
    spec = _spec(df, tokenizer, most)
    keep = tuple(c for c in keep if c not in ("ids", "decoded"))
    source = df.select(*[F.col(c) for c in keep], F.col(text).cast("string").alias("__text"))
    fields = [source.schema[c] for c in keep] + [T.StructField("ids", T.ArrayType(T.IntegerType()))]
    fields += [T.StructField("decoded", T.StringType())] * decoded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _worker(spec)
        for batch in batches:
            found = [coder.coded(x) for x in batch.column(len(keep)).to_pylist()]
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32) // 4
            flat = np.frombuffer(b"".join(found), "<i4")
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))
            columns = [*(batch.column(k) for k in range(len(keep))), ids]
            if decoded:
                columns.append(pa.array([coder.decode(flat[a:b]) for a, b in zip(ends, ends[1:])], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    return source.mapInArrow(run, T.StructType(fields))


def decode(df: DataFrame, tokenizer: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``decoded``; null ids count as none."""
    small_batches(df.sparkSession)
    spec = _spec(df, tokenizer)
    keep = tuple(c for c in keep if c != "decoded")
    source = df.select(*[F.col(c) for c in keep], F.col(ids).alias("__ids"))
    fields = [source.schema[c] for c in keep] + [T.StructField("decoded", T.StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _worker(spec)
        for batch in batches:
            texts = [coder.decode(x or []) for x in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), pa.array(texts, pa.string())], [f.name for f in fields])

    return source.mapInArrow(run, T.StructType(fields))


def op1_bpe(spark, sf_dir: str) -> DataFrame:
    out = encode(read(spark, sf_dir, "documents"), "byte_bpe_50k.json", decoded=True, most=MEMO_ALONE)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(listed, 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
