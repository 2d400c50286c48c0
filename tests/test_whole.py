"""Registered queries over whole inputs, against brute force on a small fixture."""

import math

import pytest

from tessera.config import RetrievalConfig
from tessera.plans import inputs, registry

SEP = RetrievalConfig().separator
#: No keyword and no open file leads these conversations anywhere: only similarity does.
ASKING = (34, 69)
FILLER = "plain words about a garden. " * 12
DOCS = [(i, f"doc {i}\n{FILLER}late {i}" + (f"{SEP}second part of {i}\n{FILLER}" if i % 3 == 0 else "")) for i in range(80)]
VECTORS = [(i, [math.cos(i * 1.7), math.sin(i * 1.7), 0.1 * (i % 11) + 0.003 * i]) for i in range(80)]
TURNS = [
    (34, 0, "system", "be kind"), (34, 1, "user", "hello " + FILLER + "late-1 domain"), (34, 2, "assistant", "yes"), (34, 3, "user", "more"),
    (69, 0, "user", "hi"), (69, 1, "assistant", "yes"),
]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    root = f"file://{tmp_path_factory.mktemp('whole')}"
    spark.createDataFrame(DOCS, "doc_id long, text string").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(VECTORS, "vec_id long, embedding array<float>").write.parquet(f"{root}/embeddings.parquet")
    spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").write.parquet(f"{root}/conversations.parquet")
    return root


def rel(i):
    return inputs.TARGETS[i] if i < len(inputs.TARGETS) else f"docs/{i}.md"


def nearest(conv):
    """The parts of the five nearest whole documents: the first three, of each header the first."""
    norm = lambda v: math.sqrt(sum(x * x for x in v))
    mine = VECTORS[conv][1]
    score = lambda v: sum(a * b for a, b in zip(v, mine, strict=True)) / (norm(v) * norm(mine) + 1e-10)
    best = sorted(range(80), key=lambda i: -score(VECTORS[i][1]))[:5]
    pieces = [f"## [{rel(i)}]\n\n{DOCS[i][1]}" + "\n\n---" * (i % 2) for i in best]
    parts = [p for p in SEP.join(pieces).split(SEP) if p.strip()][:3]
    heads = [p.split("\n")[0].strip() for p in parts]
    return [p for i, p in enumerate(parts) if heads.index(heads[i]) == i]


def test_hybrid_context_retrieves_whole_documents(spark, made):
    got = registry.QUERIES["hybrid_context"](spark, made).collect()
    assert got and all(r.docs == SEP.join(nearest(69)) for r in got if r.query_id == 69_000)
    assert any("second part" in r.docs for r in got) and all("late" in r.docs for r in got)


def test_hybrid_clean_index_is_whole(spark, made):
    assert {r.text.removesuffix("\n\n---") for r in inputs.chunks(spark, made).collect()} == {t for _, t in DOCS}
    for r in registry.QUERIES["hybrid_clean"](spark, made).collect():
        assert len(r.headers.split("|")) == 3


def test_every_user_turn_is_asked_whole(spark, made):
    """The system prompt is no question, the turns after the first are, and a domain named late is found."""
    ids = {c * 1000 + t for c, t, role, _ in TURNS if role == "user"}
    assert ids == {34_001, 34_003, 69_000}
    said = {r.query_id: r.query for r in inputs.questions(spark, made).collect()}
    assert said == {c * 1000 + t: x for c, t, role, x in TURNS if role == "user"}
    for name in ("hybrid_context", "hybrid_clean", "domain_section"):
        assert {r.query_id for r in registry.QUERIES[name](spark, made).collect()} == ids
    # of the eight forms conversations 34 and 69 have number 2 ("pay_ment 도메인에") and 5 ("stock domain")
    assert {r.query_id: r.domain for r in registry.QUERIES["domain_extract"](spark, made).collect()} == {34_001: "late-1", 34_003: "pay_ment", 69_000: "stock"}
    assert registry.QUERIES["context_route"](spark, made).count() == 0


def test_prompts_hold_the_documents_retrieved_for_each(spark, made):
    docs = {r.query_id: r.docs for r in registry.QUERIES["hybrid_context"](spark, made).collect()}
    got = {r.query_id: r.prompt for r in registry.QUERIES["prompt_assemble"](spark, made).collect()}
    assert set(got) == set(docs) == {34_001, 34_003, 69_000}
    assert all(docs[q] in got[q] for q in got) and SEP.join(nearest(69)) in got[69_000] and SEP.join(nearest(69)) not in got[34_001]


def test_nearest_of_all_stated_questions(spark, made):
    got = {(r.query_id, r["rank"]): r.vec_id for r in registry.QUERIES["cosine_topk"](spark, made).collect()}
    norm = lambda v: math.sqrt(sum(x * x for x in v))
    for q in (0, 50):
        mine = VECTORS[q][1]
        best = sorted(range(80), key=lambda i: -sum(a * b for a, b in zip(VECTORS[i][1], mine, strict=True)) / (norm(VECTORS[i][1]) * norm(mine) + 1e-10))
        assert [got[q, k + 1] for k in range(5)] == best[:5]
    assert len(got) == 10


def test_texts_dealt_in_salts_are_the_same(spark, monkeypatch):
    """Documents named twice, without text, and asked for by every question; broadcast or not."""
    from tessera.operators import hybrid

    docs = spark.createDataFrame([("a", "x"), ("a", "b"), ("n", None), ("a\nb", "first line as a\nc"), ("a\nc", "lost"), ("r", "z")], "rel string, content string")
    entries = spark.createDataFrame([(0, ["k"], ["n", "a", "none", "a\nb"]), (1, ["q"], ["a\nc", "r", "a"])], "entry_id int, keywords array<string>, files array<string>")
    queries = spark.createDataFrame([(i, "K" if i % 3 else "kq", None, None) for i in range(30)] + [(30, "no", None, None)], "query_id int, query string, file_path string, file_content string")
    want = {i: (["## [a]\n\nb", "## [a\nb]\n\nfirst line as a\nc"] + ([] if i % 3 else ["## [r]\n\nz"]), ["keyword"]) for i in range(30)} | {30: ([], [])}
    for most in (hybrid.BROADCAST_BYTES, 0):
        monkeypatch.setattr(hybrid, "BROADCAST_BYTES", most)
        got = hybrid.hybrid_context(queries, entries, docs, None).collect()
        assert {r.query_id: (r.docs, r.methods) for r in got} == want and len(got) == 31
