"""Operators 11 to 13 against brute force, on small tables with odd rows."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import align, merkle, ordered, queries, simhash

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 97}" for i in range(20_000))
ODD = [
    (1, None, "en", "s", None), (2, "", "en", "s", 0), (3, " \n\t", None, None, 3), (4, "one two", "de", "s", 7), (5, "one two", "", "s", 7), (6, LONG, "en", "s", 5),
    (7, "été 😀 naïve <|endoftext|> <s> x  y\n\n z ", "fr", "", 9), (8, "a" * 3000, "en", "s", 3000), (9, "one two", "de", "s", 7), (9, "one two", "de", "s", 7),
    (9, "other", "de", "s", 5), (None, "one two three", "de", "s", 13), (None, None, None, None, None), (10, "ONE TWO", "en", "t", 7), (11, "ab　c ﬁ ① \u0000 d", "en", "s", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    extra = {"g": F.lit("x"), "idx": F.lit(1), "n": F.lit("y"), "proof": F.lit(0), "f": F.lit(1.5), "id": F.lit("i"), "part": F.lit(0), "links": F.lit(""), "turn": F.lit(2)}
    return spark.createDataFrame(ODD, DOC).withColumns(extra).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def folded(nodes, fan):
    """The last node over ``nodes``, and each node's path: lists of (digests left, digests right)."""
    paths, level, where = [[] for _ in nodes], list(nodes), [[i] for i in range(len(nodes))]
    while len(level) > 1:
        up, below = [], []
        for a in range(0, len(level), fan):
            run = level[a : a + fan]
            for k in range(len(run)):
                for i in where[a + k]:
                    paths[i].append((run[:k], run[k + 1 :]))
            up.append(sha("".join(run)))
            below.append(sum(where[a : a + fan], []))
        level, where = up, below
    return level[0], paths


def whole_manifest(rows, fan):
    """(doc_id, leaf, subroot, root, proof digest, folded root) of every row (doc_id, source, lang, n_chars, text)."""
    leaf = lambda r: sha("".join(map(field, r)))
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        groups[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[lang] = folded([leaf(r) for r in groups[lang]], fan)
    root, tops = folded([trees[x][0] for x in langs], fan)
    out = []
    for lang, top in zip(langs, tops, strict=True):
        for r, path in zip(groups[lang], trees[lang][1], strict=True):
            path = path + top
            changed = zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 == 0 and r[3] is not None
            at = leaf((*r[:3], r[3] + 1, r[4])) if changed else leaf(r)
            for left, right in path:
                at = sha("".join(left) + at + "".join(right))
            out.append((r[0], leaf(r), trees[lang][0], root, sha("".join("".join(a + b) for a, b in path)), at))
    return out


@pytest.mark.parametrize("fan", [2, 3, 5])
def test_merkle(odd, spark, fan):
    docs = odd.select("doc_id", "source", "lang", "n_chars", "text")
    fields = [F.col(c) for c in docs.columns]
    changed = (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    other = F.when(changed, merkle.leaf(*fields[:3], F.col("n_chars") + 1, F.col("text"))).otherwise(merkle.leaf(*fields))
    leaves = docs.select(merkle.group_key(F.col("lang")).alias("g"), "doc_id", merkle.leaf(*fields).alias("digest"), other.alias("other"))
    out = merkle.manifest(leaves, ["doc_id"], fan)
    hexed = lambda c: merkle.shown(F.col(c))
    got = out.select("doc_id", hexed("digest"), hexed("subroot"), hexed("root"), F.sha2(hexed("proof"), 256), merkle.shown(merkle.fold(F.col("other"), F.col("proof"), F.col("shape"), fan)))
    rows = [(i, s, lang, n, t) for i, t, lang, s, n in ODD]
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(whole_manifest(rows, fan))


@pytest.mark.parametrize("n", [0, 1, 2, 7, 33])
def test_merkle_of_one_group(spark, n):
    leaves = spark.range(n).select(F.lit("").alias("g"), "id", merkle.leaf(F.col("id")).alias("digest"))
    out = merkle.manifest(leaves, ["id"], 2).select("id", merkle.shown(F.col("root")).alias("root"), (merkle.fold(F.col("digest"), F.col("proof"), F.col("shape"), 2) == F.col("root")).alias("ok"), F.size("shape").alias("k")).collect()
    assert len(out) == n and all(r.ok for r in out)
    if n:
        assert {r.root for r in out} == {folded([sha(field(i)) for i in range(n)], 2)[0]} and {r.k for r in out} == {(n - 1).bit_length()}


def test_merkle_of_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = queries.QUERIES["op11_merkle"](spark, SF).collect()
    assert sorted((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root) for r in got) == sorted(whole_manifest(rows, 2))
    assert all(r.verified == (r.folded_root == r.root) for r in got) and {r.verified for r in got} == {True, False}


def test_numbering(spark):
    """A group of almost all rows, and order keys that tie."""
    df = spark.range(3000).select(F.when(F.col("id") % 50 == 0, F.concat(F.lit("k"), (F.col("id") % 7).cast("string"))).otherwise("hot").alias("g"), (F.col("id") % 11).alias("o"), "id").repartition(9)
    rows = ordered.numbered(df, "g", ["o", "id"], "test")[0].collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.g].append((r.idx, r.o, r.id, r.n))
    assert len(rows) == 3000
    for v in by.values():
        v.sort()
        assert [x[0] for x in v] == list(range(len(v))) and [x[1:3] for x in v] == sorted(x[1:3] for x in v) and {x[3] for x in v} == {len(v)}


def plain_fingerprint(text, words=3):
    w = (text or "").encode().lower().split()
    k = min(words, len(w))
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(len(w) - k + 1)] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints, bits=2):
    top = list(range(len(prints)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= bits and find(i) != find(j):
                top[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def named(ids, comps):
    """For each row the least id of its component, None if no row of it has one."""
    least = {}
    for i, c in zip(ids, comps, strict=True):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    return [least.get(c) for c in comps]


def test_simhash(odd, spark):
    prints = [plain_fingerprint(r[1]) for r in ODD]
    ids = [r[0] for r in ODD]
    want = collections.Counter(zip(ids, prints, named(ids, plain_components(prints)), strict=True))
    got = collections.Counter((r.doc_id, r.f % (1 << 64), r.component_id) for r in simhash.classes(odd).collect())
    assert got == want


def test_simhash_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    prints = [plain_fingerprint(r.text) for r in docs]
    ids = [r.doc_id for r in docs]
    want = set(zip(ids, [f"{x:016x}" for x in prints], named(ids, plain_components(prints)), strict=True))
    assert {tuple(r) for r in queries.QUERIES["op12_simhash"](spark, SF).collect()} == want


def test_simhash_index(spark, monkeypatch):
    """Many levels, crowded balls of fingerprints and lone ones; links connect what pairs within two bits connect."""
    monkeypatch.setattr(simhash, "LEAF", 4)
    monkeypatch.setattr(simhash, "FAN", 3)
    monkeypatch.setattr(simhash, "TOP", 2)
    rng = random.Random(3)
    prints = {0, (1 << 64) - 1} | {rng.getrandbits(64) for _ in range(60)}
    for centre in (rng.getrandbits(64), 0):
        for _ in range(120):
            x = centre
            for _ in range(rng.randrange(6)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    prints = sorted(prints)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    found = simhash.links(spark.createDataFrame([(x,) for x in signed], "f long").repartition(3), 2).collect()
    pairs = {(r.a % (1 << 64), r.b % (1 << 64)) for r in found}
    at = {x: i for i, x in enumerate(prints)}
    top = list(range(len(prints)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in pairs:
        top[find(at[a])] = find(at[b])
    ours, want = [find(i) for i in range(len(prints))], plain_components(prints)
    same = lambda c: {frozenset(i for i in range(len(c)) if c[i] == k) for k in set(c)}
    assert same(ours) == same(want) and len(same(want)) < len(prints)


def test_gray_rank(spark):
    codes = [(i ^ i >> 1) for i in range(300)] + [(i ^ i >> 1) % (1 << 64) for i in range((1 << 64) - 5, 1 << 64)]
    signed = [x - (1 << 64) if x >> 63 else x for x in codes]
    ranks = [r[0] for r in spark.createDataFrame([(x,) for x in signed], "f long").select(simhash.gray_rank(F.col("f"))).collect()]
    assert ranks == [i - (1 << 63) for i in [*range(300), *range((1 << 64) - 5, 1 << 64)]]


def plain_align(texts):
    import public_tokenizers as p
    import sentencepiece
    from tokenizers import Tokenizer

    from tessera.llm.bpe import byte_alphabet

    a = Tokenizer.from_file(p.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=p.path("piece_bpe_32k.model"))
    letters = byte_alphabet()
    of_a = lambda i: bytes(letters[c] for c in a.id_to_token(i))
    of_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    out, links, count = [], [], collections.Counter()
    for text in texts:
        links.append([])
        out.append((0, 0, 0, ""))
        if not text:
            continue
        x, y, want = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text), (" " + text).encode()
        if b"".join(map(of_a, x)) != want or b"".join(map(of_b, y)) != want:
            continue
        ends = lambda ids, of: {int(e): k for k, e in enumerate(np.cumsum([len(of(i)) for i in ids]))}
        at, to, k, m, groups = ends(x, of_a), ends(y, of_b), 0, 0, []
        for e in sorted(set(at) & set(to)):
            groups.append(",".join(map(str, x[k : at[e] + 1])) + "|" + ",".join(map(str, y[m : to[e] + 1])))
            k, m = at[e] + 1, to[e] + 1
            links[-1].append((x[at[e]], y[to[e]]))
        count.update(links[-1])
        out[-1] = (len(x), len(y), len(groups), sha(";".join(groups)))
    best = collections.Counter()
    for (_, j), n in count.items():
        best[j] = max(best[j], n)
    return [(*o[:3], len(s), sum(count[x] == best[x[1]] for x in s), sum(count[x] for x in s), o[3]) for o, s in zip(out, links, strict=True)]


def rows_of(df):
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return collections.Counter(tuple(r[n] for n in names) for r in df.collect())


def test_align(odd, spark, monkeypatch):
    want = collections.Counter((r[0], *x) for r, x in zip(ODD, plain_align([r[1] for r in ODD]), strict=True))
    assert rows_of(align.aligned_counts(odd, "byte_bpe_50k.json", "piece_bpe_32k.model")) == want
    # texts in stretches, counts handed on again and again, and few lookups at a time change nothing
    monkeypatch.setattr(align, "LONG", 50)
    monkeypatch.setattr(align, "HELD", 3)
    monkeypatch.setattr(align, "AT_ONCE", 2)
    assert rows_of(align.aligned_counts(odd.coalesce(1), "byte_bpe_50k.json", "piece_bpe_32k.model")) == want


def test_align_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = collections.Counter((r.doc_id, *x) for r, x in zip(docs, plain_align([r.text for r in docs]), strict=True))
    assert rows_of(queries.QUERIES["op13_align"](spark, SF)) == want


def test_stretches_are_coded_once(monkeypatch):
    from tessera.llm.common import asset

    rng = random.Random(7)
    signs = [*"ab12.,  \n\t▁'é\u0301\u200b\xa0\u180e\x00中<s>|;", "the", "<|im_end|>"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 30))) for _ in range(1500)]
    pair = align.Pair(asset("byte_bpe_50k.json"), asset("piece_bpe_32k.model"))
    alone = [(*x[:4], align.unpacked(x[4]).tolist()) for x in map(pair.aligned, pair.coded(texts))]
    for most in (100_000, 5):  # forgotten again and again
        monkeypatch.setattr(align, "MEMO_STRETCHES", most)
        for _ in range(2):
            assert [(*x[:4], align.unpacked(x[4]).tolist()) for x in pair(texts)] == alone
    asked = []
    coded = pair.coded
    monkeypatch.setattr(align, "MEMO_STRETCHES", 100_000)
    monkeypatch.setattr(pair, "coded", lambda x: (asked.extend(x), coded(x))[1])
    assert len(list(pair(["it was so"] * 5 + [None, "so it was"]))) == 7 and len(asked) <= 1


def test_stretches():
    text = "ab cd  ef\n gh ij" * 50
    for long in (1, 7, 100):
        align.LONG, before = long, align.LONG
        parts = list(align.stretches(text))
        align.LONG = before
        assert " ".join(parts) == text and (long > 50 or len(parts) > 20)


def test_empty(empty):
    assert simhash.classes(empty).count() == 0
    assert align.aligned_counts(empty, "byte_bpe_50k.json", "piece_bpe_32k.model").count() == 0
