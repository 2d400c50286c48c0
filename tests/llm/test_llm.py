"""The training-data operators against brute force, on small tables with odd rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import bpe, chat, common, decontaminate, exact_dedup, langid, lm, near_dedup, pii, quality, queries, sharding

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and alpha beta gamma delta epsilon zeta eta theta iota kappa lambda".split()


def prose(n, seed):
    x, out = seed, []
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(x >> 8) % len(WORDS)] + str((x >> 20) % 37))
    return " ".join(out)


BASE = prose(120, 1)
ODD = [
    (1, None), (2, ""), (3, " \n\t"), (4, BASE), (5, BASE.upper()), (6, BASE + " tail"), (7, "x " + BASE), (8, prose(5000, 3)),
    (9, "a" * 50_000), (10, "été 😀 naïve <|endoftext|> x  y\n\n z "), (11, BASE), (12, "one two"), (13, "one two"), (13, "one two"), (None, BASE), (14, "don't 12,5 !!")
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in ODD]
    return spark.createDataFrame(rows, DOC).withColumns({"score": F.lit(1), "shard": F.lit("x"), "ids": F.lit(0)})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").toPandas()


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        ours, theirs = queries.QUERIES[name](spark, SF).toPandas(), con.execute(sql).df()
        columns = sorted(theirs.columns)
        assert sorted(map(str, ours[columns].values.tolist())) == sorted(map(str, theirs[columns].values.tolist()))


def test_bpe(spark, odd, empty, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = collections.Counter((r.doc_id, tuple(r.ids), r.decoded) for r in bpe.encode(odd, "byte_bpe_50k.json", decoded=True).collect())
    want = collections.Counter((i, tuple(t.encode(x or "", add_special_tokens=False).ids), x or "") for i, x in ODD)
    assert got == want
    again = bpe.decode(bpe.encode(odd, "byte_bpe_50k.json"), "byte_bpe_50k.json")
    assert collections.Counter(r.decoded for r in again.collect()) == collections.Counter(x or "" for _, x in ODD)
    assert bpe.encode(empty, "byte_bpe_50k.json").count() == 0
    for r in queries.QUERIES["op1_bpe"](spark, SF).collect():
        text = docs.text[docs.doc_id == r.doc_id].iloc[0]
        ids = t.encode(text, add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(text))


@pytest.mark.parametrize("text", [" ", "  a", "a  ", "a \n b", "\n\na\n \nb  c", "a b  c", "'s it's", "aaaa" * 300, "\x1c \x85 x", " \U000146d4 \U00018e08蹜 \U000131c5 櫵", "a\u200bb \u3000c \u0378d 1²½Ⅷ①x"])
def test_bpe_white_space(text):
    import json

    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    coder = bpe._coder_for_tests if hasattr(bpe, "_coder_for_tests") else bpe.Coder(bpe.Tables(json.load(open(path, encoding="utf-8"))), bpe.split_pattern())
    bpe._coder_for_tests = coder
    assert coder.encode(text) == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_bpe_remembers_little(monkeypatch):
    import json

    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    monkeypatch.setattr(bpe, "MEMO_WORDS", 20)
    monkeypatch.setattr(bpe, "MEMO_SEAMS", 10)
    coder = bpe.Coder(bpe.Tables(json.load(open(path, encoding="utf-8"))), bpe.split_pattern())
    text = " ".join(f"quorblin{chr(97 + i % 26)}x{i} zätt,{chr(97 + i // 26)} it's\nNo" for i in range(200))
    assert coder.encode(text) == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert len(coder.stretches) <= 20 and len(coder.memo) <= 20 and len(coder.seams) <= 10
    coder.memo.clear()
    assert coder.encode("a unquestionably shorn wordling") and set(coder.memo) == {"a"}  # no stretch of one word is held twice


def test_bpe_codes_words_once(monkeypatch):
    """Letters before signs are the word that stands alone elsewhere; what is asked for again is not forgotten."""
    import json

    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    monkeypatch.setattr(bpe, "MEMO_WORDS", 40)
    coder, asked = bpe.Coder(bpe.Tables(json.load(open(path, encoding="utf-8"))), bpe.split_pattern()), collections.Counter()
    word = coder.word
    coder.word = lambda w: (asked.update([w]), word(w))[1]
    coder.memo.make = coder.word
    text = "zätté, zätté zätté's so quorblin, quorblin's quorblin quorblin.\nNo quorblin1 quorblin&&& 'quorblin"
    assert coder.encode(text) == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert asked[" quorblin"] == 1
    for i in range(0, 90, 3):
        coder.encode(f"a quorblin {' '.join(f'wobble{chr(97 + k % 26)}{chr(97 + k // 26)}' for k in (i, i + 1, i + 2))}")
    assert asked[" quorblin"] == 1 and len(coder.stretches) + len(coder.stretches.old) <= 40


def test_worker_holds_one_step():
    made = []
    make = lambda x: lambda: (made.append(x), x)[1]
    assert [common.worker_holds("a", 1, make(1)), common.worker_holds("a", 1, make(2)), common.worker_holds("a", 3, make(3))] == [1, 1, 3]
    assert common.worker_holds("b") is None and common._held == ("b", None, None)
    assert common.worker_holds("a", 3, make(4)) == 4 and made == [1, 3, 4]


def test_worker_gives_up_the_coder():
    """A coder refers to itself, so giving it up must not wait for Python's collector."""
    import gc
    import json
    import weakref

    import public_tokenizers

    spec = json.load(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8"))
    gc.disable()
    try:
        coder = weakref.ref(common.worker_holds("bpe", 1, lambda: bpe.Coder(bpe.Tables(spec), bpe.split_pattern())))
        was = coder() is not None  # pytest keeps what it compares
        common.worker_holds("quality")
        assert was and coder() is None
    finally:
        gc.enable()


@pytest.mark.parametrize("n, shards", [(0, 4), (1, 4), (2, 3), (97, 16), (1000, 7)])
def test_sharding(spark, n, shards):
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("keep").alias("shard_name"))
    rows = sharding.shard_rows(df, ["doc_id"], shards, buckets=8).collect()
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert len(rows) == n and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert n == 0 or max(map(len, slots.values())) - (min(map(len, slots.values())) if len(slots) == shards else 0) <= 1
    other = sharding.shard_rows(df.repartition(5), ["doc_id"], shards, buckets=8).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in rows} == {(r.doc_id, r.shard, r.slot) for r in other}


def test_sharding_of_repeated_rows(spark):
    df = spark.createDataFrame([(None,), (None,), (1,), (1,)], "doc_id long")
    assert sorted(r.slot for r in sharding.shard_rows(df, ["doc_id"], 2).collect()) == [0, 0, 1, 1]


def test_sharding_of_a_hot_key(spark):
    """Very many equal rows are dealt in salts; the others' places don't depend on the layout."""
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"))
    one, two = (sharding.shard_rows(d, ["doc_id"], 4, buckets=8).collect() for d in (df, df.repartition(7)))
    assert sorted((r.shard, r.slot) for r in one) == [(i, k) for i in range(4) for k in range(750)]
    assert collections.Counter(map(tuple, one)) == collections.Counter(map(tuple, two)) or {tuple(r) for r in one if r.doc_id != 7} == {tuple(r) for r in two if r.doc_id != 7}


def permuted(number, n, seed):
    """The Feistel network with cycle walking, in plain Python."""
    import xxhash

    def mix(*parts):
        h = 42
        for p in parts:
            h = xxhash.xxh64_intdigest(p.encode() if isinstance(p, str) else p.to_bytes(8, "little", signed=True), h)
        return h - (1 << 64) if h >> 63 else h

    a = math.isqrt(n - 1) + 1
    b = (n + a - 1) // a
    x = number
    while True:
        left, right = divmod(x, b)
        for k in range(sharding.ROUNDS):
            left = (left + mix(seed * 1009 + k, right) % a) % a
            right = (right + mix(seed * 1009 + k, "r", left) % b) % b
        x = left * b + right
        if x < n:
            return x


def test_op2_shards(spark, docs, odd, empty):
    keys = [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in zip(docs.doc_id, docs.text, strict=True)]
    want = set()
    for number, k in enumerate(sorted(keys)):
        place = permuted(number, len(keys), 17)
        want.add((*k, "rows", place % 16, place // 16, None))
    assert set(map(tuple, queries.QUERIES["op2_shards"](spark, SF).collect())) == want
    named = odd.withColumns({c: F.lit(5) for c in ("n_rows", "row_no", "__b", "__bucket", "__n", "slot", "id")})
    rows = sharding.shard_rows(named, ["doc_id"], 4)
    assert rows.columns == [c for c in named.columns] and {r.row_no for r in rows.collect()} == {5}
    assert sorted((r.shard, r.slot) for r in rows.collect()) == [(i, k) for i in range(4) for k in range(len(ODD) // 4)]
    assert sharding.shard_rows(empty, ["doc_id"]).count() == 0


@pytest.mark.parametrize("digest", [exact_dedup._digest, lambda c: F.unhex(F.sha2((F.length(c) % 2).cast("string"), 256))])
def test_exact_dedup(spark, odd, empty, digest):
    """Also with a digest that most texts share."""
    groups = collections.defaultdict(list)
    for i, t in ODD:
        groups[(t or "").translate({c: c + 32 for c in range(65, 91)})].append(i)
    want = collections.Counter()
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            want[i, keep, len(ids), i is not None and i == keep, sha(t)] += 1
    got = exact_dedup.dedup(odd, digest=digest)
    assert collections.Counter(map(tuple, got.collect())) == want
    assert exact_dedup.dedup(empty, digest=digest).count() == 0
    three = spark.createDataFrame([(13, "one two"), (13, "other"), (20, "other"), (None, "other")], "doc_id long, text string")
    assert sorted(map(str, exact_dedup.keep_one(three).collect())) == sorted(map(str, [(three.collect()[k]) for k in (0, 2, 3)]))
    kept = exact_dedup.keep_one(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {i for i, *_, k, _ in want if k or i is None}


def test_quality(spark, odd, empty):
    rows = queries.QUERIES["op4_quality"](spark, SF).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().merge(rows)
    held = labels[labels.held_out]
    assert len(rows) == 200 and ((held.predicted == held.quality).mean() > 0.8)
    model = quality.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", F.col("quality").alias("label")))
    scored = quality.score(odd, model, ("doc_id", "text"), out="quality").collect()
    assert len(scored) == len(ODD) and all(0 <= r.quality <= 1 for r in scored)
    assert quality.score(empty, model).count() == 0
    assert quality.score(odd, model, ("doc_id", "score", "ids")).columns == ["doc_id", "ids", "score"]
    clash = odd.withColumns({"__score": F.lit(2), "__text": F.lit(3)})
    assert quality.accepted(clash, model, 0.0).count() == len(ODD) and quality.accepted(clash, model).columns == clash.columns
    h = quality.hashes(b"a b c a b".split())
    assert len(set(quality.pairs(h))) == 3 and quality.pairs(h)[0] == quality.pairs(h)[3] and len(quality.pairs(h[:1])) == 0
    none = quality.train(empty, spark.createDataFrame([], "doc_id long, label int"))
    assert quality.score(odd, none).head().score == pytest.approx(0.5)


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    luhn = sum(x - 9 * (x > 9) for x in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(d)))) % 10 == 0
    return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m.split(".")), "card": 16 <= len(d) <= 19 and luhn, "phone": 8 <= len(d) <= 15}[kind]


def base_spans(t):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, t or "") if valid(k, m[0])]


PRIVATE = [
    "a@b.c_d@e.f x@y.z", "😀 1.2.3.4.5.6.7.8 and 001.002.003.0255, 1.2.3.400", "4111 1111 1111 1111 or 4111-1111-1111-1112", "+1 (234) 567-8901 +1 +12 34", "x@y",
    "a@b.c" * 200, "1" * 30_000, "a." * 20_000 + "@b.c", None, "", "+((((1", "00000000001.1.1.1",
]


def test_pii(spark, odd, empty):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(PRIVATE)], "doc_id long, text string")
    for r in pii.find(df).collect():
        assert [tuple(s) for s in r.base] == base_spans(PRIVATE[r.doc_id])
    assert pii.find(odd).count() == len(ODD) and pii.find(empty).count() == 0


def test_pii_terms(spark):
    """A name that stands only with one address gives it away; words said elsewhere too don't."""
    texts = [f"note {i}: zorblax wrote from me@corp.org about wares" for i in range(4)] + [f"nothing about wares and note {i}" for i in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    marked = {r.doc_id: [texts[r.doc_id][s.start : s.end] for s in r.terms] for r in pii.find(df).collect()}
    assert all("zorblax" in marked[i] and "wares" not in marked[i] for i in range(4)) and not any(marked[i] for i in range(4, 64))
    clean = {r.doc_id: r.clean_text for r in pii.sanitise(df).collect()}
    assert "zorblax" not in clean[0] and "[EMAIL]" in clean[0] and clean[10] == texts[10]


def test_pii_terms_far_from_their_entity(spark):
    """A flagged term is marked wherever it stands, and counts in whole documents: most of zorblax's and
    all but two of quuxley's stand far from the address; Null has no doc_id."""
    far = " and so on" * 20
    texts = [f"note {i}: Zorblax, quuxley wrote from me@corp.org about wares{far} zorblax" for i in range(2)]
    texts += [f"memo {i} by me@corp.org{far} quuxley" for i in range(6)] + ["zorblax alone", "Null zorblax"] + [f"nothing about wares and note {i}" for i in range(300)]
    rows = [(None if t.startswith("Null") else i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: [texts[9 if r.doc_id is None else r.doc_id][s.start : s.end] for s in r.terms] for r in pii.find(df).collect()}
    marked = {i: [w for w in found[i] if w.lower() in ("zorblax", "quuxley")] for i in found}
    # of 309 documents 8 hold the address, 8 quuxley and 3 zorblax: shares 1 and 0.89 (2 of 3)
    assert marked[0] == ["Zorblax", "quuxley", "zorblax"] and marked[2] == ["quuxley"] and marked[8] == marked[None] == ["zorblax"]
    assert not any(found[i] for i in range(10, len(texts)))
    clean = {r.doc_id: r.clean_text for r in pii.sanitise(df).collect()}
    assert clean[8] == "[TERM] alone" and "quuxley" not in clean[2] and clean[20] == texts[20]


def shares(texts):
    """The flagged terms by definition: every (entity, term) of two contexts, over all rows."""
    word = lambda t: [(m[0].lower(), m.start(), m.end()) for m in re.finditer(r"[^\W]+", t)]
    spans = [base_spans(t) for t in texts]
    said = [{w for w, *_ in word(t)} for t in texts]
    contexts, holds = collections.defaultdict(set), collections.defaultdict(set)
    for i, t in enumerate(texts):
        for k, a, b in spans[i]:
            e = (k, t[a:b].lower())
            holds[e].add(i)
            lo, hi = max(0, a - pii.REACH), min(len(t), b + pii.REACH)
            for w, x, y in word(t):
                if lo <= x and y <= hi and len(w) >= 3 and not any(p < y and x < q for _, p, q in spans[i]):
                    contexts[e, w].add(t[lo:hi])
    n, out = len(texts), {}
    for (e, w), c in contexts.items():
        with_w = {i for i in range(n) if w in said[i]}
        if len(c) > 1 and len(holds[e]) < n:
            share = math.log2(n * len(with_w & holds[e]) / (len(holds[e]) * len(with_w))) / math.log2(n / len(holds[e]))
            if share >= pii.DISCLOSURE:
                out[w] = max(share, out.get(w, 0))
    return out


def test_pii_shares(spark):
    """All term spans and texts made of them against the definition; İ lower-cases to two characters."""
    names = "wares Quuxley of İzor 4711x".split()
    texts = [f"{prose(9, i)} {names[i % 5]} and {names[i % 3]}: mail u{i % 5}@corp.org{' so' * (i % 50)} {names[i * 2 % 5] if i % 4 == 0 else ''} {prose(5, i + 99)}" for i in range(60)]
    texts += [prose(30, i) + (" wares" if i % 2 else "") for i in range(200)] + ["", "İzor alone and 4711x", "a u1@corp.org b"]
    df = spark.createDataFrame([(i % 7 or None, t, i, "x") for i, t in enumerate(texts)], "doc_id long, text string, row_no long, term string")
    flagged = shares(texts)
    assert {"i̇zor", "4711x"} <= set(flagged) and not {"wares", "quuxley"} & set(flagged)
    want = collections.Counter()
    for t in texts:
        base = base_spans(t)
        terms = [(m.start(), m.end()) for m in re.finditer(r"[^\W]+", t) if m[0].lower() in flagged and not any(a < m.end() and m.start() < b for _, a, b in base)]
        want[t, tuple(base), tuple(sorted(terms))] += 1
    rows = pii.find(df).collect()
    assert collections.Counter((r["__text"], tuple(map(tuple, r.base)), tuple((s.start, s.end) for s in r.terms)) for r in rows) == want
    for r in pii.sanitise(df).collect():
        assert not [w for w in re.findall(r"[^\W]+", r.clean_text) if w.lower() in flagged] and "@" not in r.clean_text


def test_op5_pii(spark, docs):
    """The query's digests, from the texts by definition."""
    texts = dict(zip(docs.doc_id, docs.text, strict=True))
    flagged = shares(list(texts.values()))
    for r in queries.QUERIES["op5_pii"](spark, SF).collect():
        t, base = texts[r.doc_id], base_spans(texts[r.doc_id])
        listed = [f"{k}:{a}:{b}" for k, a, b in base]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for k, *_ in base) for x in pii.KINDS)
        assert r.base_sha256 == sha(",".join(listed)) and r.spans.split(",")[: len(base)] == (listed or r.spans.split(",")[:0])
        terms = [f"term:{m.start()}:{m.end()}" for m in re.finditer(r"[^\W]+", t) if m[0].lower() in flagged and not any(a < m.end() and m.start() < b for _, a, b in base)]
        assert r.spans == ",".join(listed + terms) and r.n_spans == len(listed + terms)
        if not listed + terms:
            assert r.clean_sha256 == sha(t)


ITEM = "Tom bought 12 apples, then Tom gave Ann seven of the ripe ones before lunch at home."


def test_decontamination(spark, odd, empty):
    bench = spark.createDataFrame([(1, ITEM), (2, "Fresh bread is sold every morning near the old stone bridge in town."), (3, None), (4, "two words")], "item_id long, text string")
    texts = [
        (1, "Intro. " + ITEM.lower() + " End."), (2, "So Bob bought 37 apples, then Bob gave Sue seven of the ripe ones before lunch at home."),
        (3, "Tom bought apples."), (4, "one fresh### bread*** is!! sold every morning near the old stone bridge in town"), (5, None), (6, ""), (7, "Two words!"), (1, ITEM),
    ]
    got = collections.Counter((r.doc_id, r.contaminated, r.item_ids) for r in decontaminate.report(spark.createDataFrame(texts, "doc_id long, text string"), bench).collect())
    assert got[2, True, "1"] and got[4, True, "2"] and got[3, False, ""] and got[5, False, ""] and got[7, True, "4"] and sum(got.values()) == len(texts)
    assert decontaminate.report(odd, bench).where("contaminated").count() == 0
    assert decontaminate.report(empty, bench).count() == 0 and decontaminate.report(odd, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.clean(odd, bench).columns == odd.columns


def test_decontamination_of_odd_items(spark):
    """Items of numbers and units only; lines that many items share; null and repeated ids, told by text."""
    measures = "12 km 13 kg 14 cm 15 g 16 lb 17 oz 18 days"
    rule = "answer the question below in one short sentence and give your reasons in full for each step taken "
    items = [(1, measures)] + [(10 + i, rule + prose(9, i)) for i in range(40)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [(1, f"so {measures}!"), (None, f"so {measures}!"), (1, "clean text of a plain kind"), (2, rule), (3, "x " + rule.upper() + prose(9, 4)), (None, None)]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumns({"ident": F.lit(1), "h": F.lit(2), "item_id": F.lit(3)})
    got = sorted((str(r.doc_id), r.item_ids) for r in decontaminate.report(df, bench).collect())
    with_rule = ",".join(sorted((str(i) for i, t in items[1:] if 2 * len(rule.split()) - 8 >= len(t.split()) - 4), key=int))
    assert got == sorted([("1", "1"), ("None", "1"), ("1", ""), ("2", with_rule), ("3", with_rule), ("None", "")])
    kept = decontaminate.clean(df, bench)
    assert kept.columns == df.columns and sorted(str(r.text) for r in kept.collect()) == ["None", "clean text of a plain kind"]


def test_decontamination_of_items_asked_again(spark):
    """Against brute force over all alignments: other numbers and names, put in one for one or at random."""
    people, made = "Tom Ann Bob Sue Max Eve Joe Kim".split(), []
    stem = "yesterday {0} gave {1} about 1{2} of the old red boxes before {0} went home and then {1} sold 2{3} boxes near the river".split()
    put = lambda v: " ".join(stem).format(people[v[0]], people[v[1]], v[2], v[3])
    for i in range(60):
        v = ((i * 3) % 8, (i * 5 + 1) % 8, i % 7, (i * i) % 5)
        t = put(v).split()
        if i % 3 == 2:  # one slot of each pair says something else
            t = [people[(i + k * 3) % 8] if w in people else w for k, w in enumerate(t)]
        made.append((i, "so it was " + " ".join(t[: 10 + i % 15]) + " indeed"))
    item = put((0, 1, 2, 3))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")

    def template(t):
        raw = re.findall(r"\w+", t)
        kinds = ["#num" if w.isdigit() else "#name" if w in people else w for w in raw]
        return [w.lower() for w in kinds], [w.lower() if k[0] == "#" else None for w, k in zip(raw, kinds, strict=True)]

    def hit(text):
        (a, x), (b, y) = template(item), template(text)
        searched = [i for i in range(len(a) - 4) if sum(s is None for s in x[i : i + 5]) >= 3]
        found = set()
        for shift in range(-len(a), len(b)):
            at = [i for i in searched if 0 <= i + shift and a[i : i + 5] == b[i + shift : i + shift + 5] and i + shift + 5 <= len(b)]
            pairs = {(x[i + k], y[i + shift + k]) for i in at for k in range(5) if x[i + k]}
            matched = min(len({p for p, _ in pairs}), len({q for _, q in pairs}))
            if len(pairs) - matched <= len(pairs) * decontaminate.SLIPS:
                found.update(at)
        return len(found) >= len(searched) * decontaminate.COVERAGE

    got = {r.doc_id for r in decontaminate.report(spark.createDataFrame(made, "doc_id long, text string"), bench).where("contaminated").collect()}
    assert got == {i for i, t in made if hit(t)} and 5 < len(got) < 55


SHAPES = [
    "{A} has {n} red apples. {B} takes {m} of them away. How many are left?", "Solve for x: {n}x + {m} = {k}", "{A} has {w} apples and eats {v} of them",
    "A train leaves the station at {n} km per hour. {A} boards it after {m} hours. How far has it gone by then?",
    "{A} and {B} share {n} marbles in the ratio {m} to {k}. How many marbles does {A} get?", "If {A} reads {w} pages each evening, how many pages has {A} read after {v} evenings?",
    "{B} buys {n} pens at {m} cents each. What does {B} pay in all for them?", "Find the area of a garden that is {n} m long and {m} m wide.",
    "{A} was born in {k}. In which year did {A} turn {n} if the birthday had already passed?", "A tank holds {k} l of water. Every minute {m} l drain out of it. When is the tank half empty?",
]
CLEAN = [
    "{A} wrote {n} letters to {B} last summer. They were never answered.", "Solve your own problems first, said {A}, and then mine, all {n} of them.", "{A} has a red bicycle and {w} old chairs.",
    "The train to the coast was {n} minutes late. {A} waited with {B}.", "{A} and {B} went to see {n} paintings in the gallery.", "How many people live here? About {k}, says {A}, or {w} more.",
    "{B} sells pens in {n} colours. What a fine shop!", "The garden of {A} is long and narrow, with {m} trees in it.", "{A} came back in {k}. In spring {B} left for {n} days.", "Every minute counts. {A} had {m} left.",
]


@pytest.mark.parametrize("literal", [False, True])
def test_decontamination_hashes_alone(spark, odd, literal):
    texts = [None, "", "Ann", "In 3 km Bob met Carl. Then Dora had four apples, said Eve. Fine", "one two Three four Five six. Seven eight", "x 3x y z w v u"]
    df = odd.select("doc_id", "text").union(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    want = decontaminate.windows(df, "doc_id", "text", literal).select("ident", "h")
    assert sorted(decontaminate.window_hashes(df, "doc_id", "text", literal).collect(), key=str) == sorted(want.collect(), key=str)


def test_decontamination_of_other_parameters(spark):
    """Items of ten shapes asked again with other names, numbers and number words, also where a sentence
    begins: of 500 at least nine in ten are found, and none of 500 texts of like words."""
    rng = random.Random(5)
    people, number = "Tom Ann Bob Sue Max Eve Joe Kim Lea Ian".split(), "two three four five six seven eight nine eleven twelve".split()

    def put(shape):
        (a, b), (w, v), (n, m, k) = rng.sample(people, 2), rng.sample(number, 2), rng.sample(range(2, 2000), 3)
        return shape.format(A=a, B=b, w=w, v=v, n=n, m=m, k=k)

    bench = spark.createDataFrame([(i, put(t)) for i, t in enumerate(SHAPES)], "item_id long, text string")
    asked = [(i, f"{prose(20, i)}. {put(SHAPES[i % 10])} {prose(20, i + 7)}") for i in range(500)]
    clean = [(1000 + i, f"{prose(20, i)}. {put(CLEAN[i % 10])} {prose(20, i + 7)}") for i in range(500)]
    got = {r.doc_id: r.item_ids for r in decontaminate.report(spark.createDataFrame(asked + clean, "doc_id long, text string"), bench).where("contaminated").collect()}
    assert sum(got.get(i) == str(i % 10) for i, _ in asked) >= 450
    assert not [i for i in got if i >= 1000]


def test_decontamination_finds_all_whole_items(spark, docs):
    plain = lambda t: " ".join(re.findall(r"\w+", t.lower()))
    items = {r.item_id: plain(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    want = {d for d, t in zip(docs.doc_id, docs.text, strict=True) if any(x in plain(t) for x in items.values())}
    got = {r.doc_id for r in queries.QUERIES["op6_decontaminate"](spark, SF).where("contaminated").collect()}
    assert got == want


def check_lm(rows, texts, train):
    tok = lambda t: (t or "").encode().lower().split() + [b""]
    c = collections.Counter(w for i, t in texts if train(i) for w in tok(t))
    n, v = sum(c.values()), len(c)
    base = lambda t: sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tok(t))
    want = sorted((str(i), len(tok(t)), sum(w in c for w in tok(t)), round(base(t), 6)) for i, t in texts)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in rows) == want
    assert all(r.train_tokens == n and math.isfinite(r.score) and r.score < 0 for r in rows)


def test_lm(spark, odd, empty, docs):
    rows = queries.QUERIES["op7_lm"](spark, SF).collect()
    check_lm(rows, list(zip(docs.doc_id, docs.text, strict=True)), lambda i: zlib.crc32(str(i).encode()) % 10)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    two = odd.select("doc_id", "text")
    check_lm(lm.score(two, lm.train(two)).collect(), ODD, lambda i: True)
    model = lm.train(empty)
    assert lm.score(empty, model).count() == 0 and lm.score(two, model).count() == len(ODD)


def trained_on(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return df, lm.train(df)


@pytest.mark.parametrize("times", [1, 1000, 110_000, 1_000_000, 1_000_000_000, 4_000_000_000])
def test_lm_gains_of_any_size(times):
    """A pair's gain against its formula, however often it was seen; and of a class without such a pair."""
    for stored in (1, 1 + 3 * lm.SHARE, 1 + 12 * lm.SHARE, 0):
        arrays = [lm.np.array([7], t).tobytes() for t in (lm.np.uint32,)] + [lm.np.array([stored], lm.np.uint16).tobytes(), lm.np.array([times], lm.np.uint32).tobytes()]
        class Column(list):
            def to_pylist(self):
                return list(self)
        batch = type("Batch", (), {"column": lambda self, k: Column([0] if k == 0 else [arrays[k - 1]])})()
        table = next(lm.added(iter([batch])))
        got = lm.np.frombuffer(table.column(4)[0].as_py(), lm.np.float32)[0]
        want = math.log10(1 + times * 2.0 ** ((stored - 1) / lm.SHARE) / lm.PRIOR) if stored else -math.log10(1 + times / lm.PRIOR)
        assert got == pytest.approx(want, rel=1e-5)


def test_lm_keys_of_many():
    found = [b"", b"a", b"\xff", b"abc!", "zö".encode(), b"x" * 300]
    assert lm.keys_of(found).tolist() == [lm.key(w) for w in found]
    assert lm.tails_of(found).tolist() == [lm.tail_class(w) for w in found]


def test_lm_probabilities_sum_to_one(spark):
    """Inside every frequent class, after every token, over all tokens; and of the classes, after any context."""
    texts = [prose(40, i) for i in range(30)] + ["a b a b a c"]
    _, m = trained_on(spark, texts)
    pairs = {r.part: (lm.np.frombuffer(r.a, lm.np.uint32), lm.np.frombuffer(r.b, lm.np.float32)) for r in m["tables"].where(F.col("kind") == lm.PAIR_TABLE).collect()}
    rows = m["tables"].where(F.col("kind") == lm.COUNT_TABLE).count()
    assert rows == 0 and len(m["keys"]) == m["v"]  # all counts of so small a corpus are broadcast
    seen = {(x, y) for t in texts for x, y in zip([None, *lm.tokens(t)], lm.tokens(t))}

    def gains(before, keys, cls):
        head = [] if before is None else [lm.key(before)]
        stream = lm.np.array([x for k in keys for x in (*head, k)], lm.np.int64)
        place = lm.np.tile(lm.np.arange(len(head) + 1), len(keys))
        at, by_token, by_class = lm.pair_keys(stream, place, lm.np.repeat(cls, len(head) + 1))
        last = lm.np.isin(at, lm.np.flatnonzero(place == len(head)))
        out = []
        for found in (by_token[last], by_class[last]):
            part, short = (found >> lm.np.uint64(64 - m["bits"])).astype(int), lm.short(found, m["bits"])
            out.append(lm.np.array([lm.looked_up(*pairs.get(p, (lm.np.zeros(0), lm.np.zeros(0))), lm.np.array([k]), 0.0)[0] for p, k in zip(part, short)]))
        return sum(out)

    for before in [None, b"a", b"b", b"never"] + [x for x, _ in list(seen)[:20]]:
        for c in range(lm.HOT_CLASSES):
            mine = m["classes"] == c
            if mine.any():
                q = (m["counts"][mine] + lm.SMOOTH) / m["z"][c]
                assert (q * 10 ** gains(before, m["keys"][mine], m["classes"][mine])).sum() == pytest.approx(1, abs=2e-3)
    for c in range(lm.HOT_CLASSES, lm.CLASSES):
        mine = m["classes"] == c
        assert ((m["counts"][mine] + lm.SMOOTH).sum() + lm.SMOOTH) / m["z"][c] == pytest.approx(1)
    p = lm.probabilities(m["weights"], m["bias"], lm.features(m["keys"], lm.np.arange(len(m["keys"]))))
    assert p.sum(axis=1) == pytest.approx(lm.np.ones(len(p)), abs=1e-5)


@pytest.mark.parametrize("first", [True, False])
def test_lm_gradient(spark, first):
    """Against finite differences of the log-likelihood of the classes."""
    texts = [prose(25, i) for i in range(5)] + ["", "a a a"]
    df, m = trained_on(spark, texts)
    w = lm.np.zeros_like(m["weights"]) if first else m["weights"]
    held = spark.sparkContext.broadcast({k: x for k, x in m.items() if k != "tables"} | {"weights": w})
    if first:
        gradient, curvature = lm.at_zero(lm.gathered(lm.collected(df, held, m["bits"])), m["bias"])
    else:
        gradient, curvature = lm.gradients(df, held), None
    vocabulary = lm.Vocabulary(m)
    parts = list(lm.batches_of(texts, vocabulary))

    def likelihood(weights):
        total = 0.0
        for _, _, ids, place in parts:
            z = sum(weights[r] for r in lm.features(vocabulary.keys[ids], place)) + m["bias"].astype(float)
            z -= lm.np.log(lm.np.exp(z).sum(axis=1, keepdims=True))
            total += z[lm.np.arange(len(ids)), vocabulary.classes[ids]].sum()
        return total

    rows = lm.features(vocabulary.keys[parts[0][2]], parts[0][3])
    for row, c in [(rows[k, i], (i * 5 + k) % lm.CLASSES) for k in range(4) for i in (0, 3, 11)]:
        step = lm.np.zeros(w.shape)
        step[row, c] = 1e-4
        slope = (likelihood(w + step) - likelihood(w - step)) / 2e-4
        curve = -(likelihood(w + step) - 2 * likelihood(w.astype(float)) + likelihood(w - step)) / 1e-8
        assert gradient[row, c] == pytest.approx(slope, abs=1e-2)
        assert curvature is None or curvature[row, c] == pytest.approx(curve, rel=0.05, abs=0.05)


def test_lm_learns_pairs(spark, odd):
    """Counts that are looked up, not broadcast; and what was seen together scores higher than apart."""
    pairs = [f"{a}{i % 7} {b}{i % 7}" for i in range(400) for a, b in (("left", "right"),)]
    df, m = trained_on(spark, pairs)
    got = {r.doc_id: r.score for r in lm.score(spark.createDataFrame([(1, "left1 right1"), (2, "left1 right2")], "doc_id long, text string"), m).collect()}
    assert got[1] > got[2] + 0.5
    clash = odd.withColumns({"part": F.lit(1), "flush": F.lit(2), "key": F.lit("x")})
    assert lm.score(clash, m).count() == len(ODD)


def test_lm_counts_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(lm, "KNOWN", 20)
    monkeypatch.setattr(lm, "FREQUENT", 10)
    monkeypatch.setattr(lm, "PACK", 50)
    texts = [(i, prose(30 + i, i)) for i in range(40)] + [(40, None), (41, "")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    check_lm(lm.score(df, lm.train(df)).collect(), texts, lambda i: True)


def shingles(t, k):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def classes(texts, k):
    s = {i: shingles(t, k) for i, t in texts}
    top = {i: i for i in s}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in s:
        for b in s:
            met = len(s[a] & s[b])
            if a < b and s[a] and s[b] and 100 * met >= 80 * (len(s[a]) + len(s[b]) - met):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return sorted((i, len(s[i]), find(i)) for i in s)


def test_lm_steps_see_all_documents(spark, odd, monkeypatch):
    seen = []
    for name in ("collected", "gradients"):
        real = getattr(lm, name)
        monkeypatch.setattr(lm, name, lambda docs, *rest, real=real: seen.append(docs.count()) or real(docs, *rest))
    lm.train(odd.select("doc_id", "text"))
    assert seen == [len(ODD)] * 2


@pytest.mark.parametrize("k", [4, 5])
def test_near_dedup(spark, odd, empty, docs, k):
    words = BASE.split()
    near = [(100 + i, " ".join(w if (j * 7 + i) % (11 + i) else f"edit{i}" for j, w in enumerate(words))) for i in range(40)]
    chain = [(200 + i, " ".join(words[i * 8 : i * 8 + 60] + ["z"])) for i in range(6)]
    texts = [(i, t) for i, t in ODD if i is not None and i != 13] + [(13, "one two")] + near + chain
    df = spark.createDataFrame(texts + [(None, BASE)], "doc_id long, text string").withColumns({c: F.lit(1) for c in ("id", "n", "s", "comp", "band")})
    rows = list(map(tuple, near_dedup.classes(df, words=k).collect()))
    assert [r for r in rows if r[0] is None] == [(None, len(shingles(BASE, k)), None)]
    assert sorted(r for r in rows if r[0] is not None) == classes(texts, k)
    assert near_dedup.keep_one(df, words=k).where("doc_id is null").count() == 1
    assert near_dedup.classes(empty).count() == 0 and near_dedup.keep_one(odd).columns == odd.columns
    if k == 4:
        all_docs = list(zip(docs.doc_id, docs.text, strict=True))
        rows = sorted((r.doc_id, r.n_shingles, r.component_id) for r in queries.QUERIES["op8_near_dedup"](spark, SF).collect())
        assert rows == classes(all_docs, 4)


def test_near_dedup_of_one_band(spark):
    """Documents that share a long passage, in groups of near copies: what leaders leave is found too."""
    passage = prose(300, 5)
    texts = [(i * 100 + j, f"{prose(70, i + 7)} {passage} {'x' * j}") for i in range(12) for j in range(4)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert sorted(map(tuple, near_dedup.classes(df, words=4).collect())) == classes(texts, 4)
    held = spark.createDataFrame([(i, sorted(hash(x) for x in shingles(t, 4))) for i, t in texts], "id long, s array<long>")
    parity = near_dedup.with_parity(held)
    loose = parity.select("id", F.col("id").alias("comp"), F.size("s").alias("u"), F.size("s").alias("n"), "p")
    found = near_dedup.confirmed(near_dedup.residual(loose, parity, 80), parity, 80).where("link")
    s = {i: shingles(t, 4) for i, t in texts}
    assert {(r.a, r.b) for r in found.collect()} == {(a, b) for a in s for b in s if a > b and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b])}


def loose_sets(spark, given):
    """Sets as documents of a component each."""
    held = near_dedup.with_parity(spark.createDataFrame([(i, sorted(s)) for i, s in given.items()], "id long, s array<long>"))
    return held.select("id", F.col("id").alias("comp"), F.size("s").alias("u"), F.size("s").alias("n"), "p"), held


def test_near_dedup_of_one_form(spark):
    """Sets that share eight of ten shingles with all others are never linked, and hardly meet."""
    rng = random.Random(2)
    docs, held = loose_sets(spark, {i: {*range(8), 100 + rng.randrange(300), 1000 + rng.randrange(300)} for i in range(600)})
    assert near_dedup.meetings(docs, held, 80).count() < 20 * 600


def test_near_dedup_pairs_by_rare_shingles_only(spark):
    """Only the rarest shingles become rows of a join; the others are counted, and joined with nothing."""
    docs, held = loose_sets(spark, {i: {*range(80), *range(1000 + i // 2 * 20, 1020 + i // 2 * 20)} for i in range(200)})
    keys = near_dedup.rarest(docs, held, 80)
    assert keys.count() <= 21 * 200 and keys.where("x < 1000").groupBy("id").count().where("count > 1").isEmpty()
    plan = near_dedup.meetings(docs, held, 80)._jdf.queryExecution().optimizedPlan().toString()
    assert "__hot" not in plan and "explode(s" not in plan


@pytest.mark.parametrize("often", [1 << 19, 50])
def test_near_dedup_residual_of_all_sizes(spark, monkeypatch, often):
    """Against all pairs: sets of one to sixty shingles that differ about as much as they may; the shingles'
    counts are known for all or for few of them."""
    monkeypatch.setattr(near_dedup, "OFTEN", often)
    rng, given = random.Random(4), {}
    for i in range(260):
        base = set(rng.sample(range(i // 20 * 40, i // 20 * 40 + 75), rng.choice([1, 2, 4, 5, 9, 10, 18, 30, 45, 60])))
        given[2 * i] = base
        drop, more = rng.randrange(len(base) // 5 + 1), rng.randrange(len(base) // 5 + 1)
        given[2 * i + 1] = set(rng.sample(sorted(base), len(base) - drop)) | {5000 + rng.randrange(40) for _ in range(more)}
    docs, held = loose_sets(spark, given)
    found = near_dedup.confirmed(near_dedup.residual(docs, held, 80), held, 80).where("link")
    want = {(a, b) for a in given for b in given if a > b and 100 * len(given[a] & given[b]) >= 80 * len(given[a] | given[b])}
    assert len(want) > 200 and {(r.a, r.b) for r in found.collect()} == want


def test_langid(spark, odd, empty, docs):
    rows = queries.QUERIES["op9_langid"](spark, SF).toPandas().merge(docs)
    held = rows[rows.held_out]
    assert len(rows) == 200 and (held.lang == held.lang_pred).mean() > 0.95 and rows.score.between(0, 1).all()
    model = langid.train(spark.read.parquet(f"{SF}/documents.parquet"))
    got = {r.doc_id: r.lang_pred for r in langid.predict(odd, model).collect()}
    assert [got[i] for i in (1, 2, 3)] == ["und"] * 3 and langid.predict(empty, model).count() == 0
    assert {r.lang_pred for r in langid.predict(odd, langid.train(empty)).collect()} == {"und"}
    signs = spark.createDataFrame([(1, "²½ Ⅷ ①"), (2, "12 !")], "doc_id long, text string").withColumns({"lang_pred": F.lit("x"), "__text": F.lit(1)})
    rows = langid.predict(signs, model, ("doc_id", "lang_pred"))
    assert rows.columns == ["doc_id", "lang_pred", "score", "rejected"] and {r.lang_pred for r in rows.collect()} == {"und"}
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), (F.col("id") % 300).cast("string").alias("lang"))
    assert langid.sample(many, "lang", 800, 100).count() == 3000 and 400 < langid.sample(many, "lang", 800, 100, in_all=900).count() < 1500


def test_chat(spark):
    rows = [
        (1, 0, "user", "hi\\"), (1, 1, "assistant", "<|im_end|>\\n"), (1, 2, "user", None), (1, 3, "assistant", "b"), (2, 0, None, "x"), (2, 0, "a\nb", "y"), (None, 1, "assistant", "z"), (1, 4, "assistant", ""),
    ]
    expanded = chat.expand(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r for r in chat.read_back(expanded).collect()}
    assert got[1].turns_sha256 == sha("user\nhi\\\nassistant\n<|im_end|>\\n\nuser\n\nassistant\nb\nassistant\n\n")
    assert got[1].loss_sha256 == sha("<|im_end|>\\nb") and got[1].n_examples == 3 and got[None].loss_chars == 1 and got[2].n_turns == 2
    full = {(r.conv_id, r.example): r for r in chat.materialise(expanded).collect()}
    r = full[1, 1]
    assert (r.context + r.reply)[r.loss_start : r.loss_end] == "b" and r.context.count(chat.START) == 3 and len(full) == 4
    assert all(sha(full[r.conv_id, r.example].context) == r.context_sha256 for r in expanded.where("example is not null").collect())
    for column, wrong in (("context_chars", F.col("context_chars") + 1), ("context_sha256", F.lit("0")), ("example", F.col("example") + 1)):
        with pytest.raises(Exception, match="context isn't the turns before it"):
            chat.read_back(expanded.withColumn(column, wrong)).collect()
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.expand(empty)).count() == 0


def test_chat_examples_are_spelled_out(spark):
    """Each example holds its whole context; what no assistant turn follows comes once, without an example."""
    rows = [(1, i, "assistant" if i % 3 == 2 else "user", f"<|im_end|>\n{i}") for i in range(10)] + [(2, 0, "user", "u")]
    expanded = chat.expand(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    form = lambda i: f"<|im_start|>{'assistant' if i % 3 == 2 else 'user'}\n<\\|im_end|>\n{i}<|im_end|>\n"
    got = {(r.conv_id, r.example): r for r in expanded.collect()}
    assert len(got) == 5 and {k: r.context for k, r in got.items() if k[1] is not None} == {(1, e): "".join(map(form, range(3 * e + 2))) for e in range(3)}
    assert all((r.context + r.reply)[r.loss_start : r.loss_end] == f"<\\|im_end|>\n{3 * e + 2}" for (c, e), r in got.items() if e is not None)
    assert got[1, None].reply == form(9) and got[2, None].reply == "<|im_start|>user\nu<|im_end|>\n" and got[1, None].context is None
    # a context of the right length and digest, but of other turns, is told
    other = F.when(F.col("example") == 1, F.replace("context", F.lit("user"), F.lit("usEr"))).otherwise(F.col("context"))
    with pytest.raises(Exception, match="context isn't the turns before it"):
        chat.read_back(expanded.withColumn("context", other)).collect()


def test_chat_order_of_ties(spark):
    """As the SQL has it: by turn, role and text, before escaping; with a long text and other columns."""
    rows = [(1, 0, "assistant", t) for t in ("x!", "x", "x<|", "x\\", "x\n")] + [(1, 0, None, "y"), (1, None, "user", "z"), (2, 0, "assistant", "a<|" * 50_000), (2, 0, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"segment": F.lit(1), "position": F.lit(2)})
    con = duckdb.connect()
    con.register("conversations", df.toPandas()[["conv_id", "turn", "role", "text"]].astype({"turn": "Int64"}))
    want = con.execute(chat.OP10_SQL.replace("ORDER BY turn, role", "ORDER BY turn NULLS FIRST, role")).df()
    got = chat.read_back(chat.expand(df)).toPandas()
    want = want[want.conv_id >= 0]
    assert sorted(map(str, got[sorted(want.columns)].values.tolist())) == sorted(map(str, want[sorted(want.columns)].values.tolist()))


def test_pipeline(spark, docs):
    kept, before = spark.read.parquet(f"{SF}/documents.parquet"), None
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in kept.collect()}
        out = stage(spark, kept, SF)
        kept = spark.createDataFrame(out.collect(), out.schema)
        seen[name] = (before, {r.doc_id for r in kept.collect()})
        assert name == "bpe" or kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    before, after = seen["exact_dedup"]
    best = {}
    for i, t in before.items():
        best[t.lower()] = max(i, best.get(t.lower(), -1))
    assert after == set(best.values())
    before, after = seen["near_dedup"]
    assert after == {c for _, _, c in classes(list(before.items()), 5)}
    before, after = seen["bpe"]
    assert after == set(before) and after == {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()}
    junk = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 0").collect()}
    assert len(seen["quality"][1] & junk) <= len(junk) / 4


def test_pipeline_of_odd_rows(spark, odd, empty):
    """Nulls, empty texts, repeated ids, clashing names and an empty table through every stage."""
    named = odd.withColumns({c: F.lit(1) for c in ("id", "h", "__score", "__gone", "norm", "n_rows")})
    bench = {i for i, t in ODD if t and ITEM in t}
    for name, stage in corpus_pipeline.STAGES:
        out, none = stage(spark, named, SF), stage(spark, empty, SF)
        assert none.count() == 0 and (name == "bpe" or out.columns == named.columns)
        rows = collections.Counter((r.doc_id, r.text) for r in out.collect()) if name != "bpe" else out.count()
        if name == "exact_dedup":
            best = {}
            for i, t in ODD:
                best[(t or "").lower()] = max(-1 if i is None else i, best.get((t or "").lower(), -1))
            assert rows == collections.Counter((i, t) for i, t in ODD if i is None or best[(t or "").lower()] == i)
        if name == "near_dedup":
            firsts = {c for _, _, c in classes([(i, t) for i, t in ODD if i is not None], 5)}
            assert rows == collections.Counter((i, t) for i, t in ODD if i is None or i in firsts)
        if name == "decontaminate":
            assert not bench and rows == collections.Counter(ODD)
        if name == "bpe":
            assert rows == len(ODD)
