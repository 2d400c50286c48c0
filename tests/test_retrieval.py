"""Index build, pruned search, many keywords, file trees, sinks, action sequences and odd frames, by hand and by brute force."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.config import RetrievalConfig
from tessera.operators import actions, embedding, keywords, nearest, routing, similarity, sse
from tessera.plans import registry
from tessera.sources import files, markdown, sink
from tessera.streaming import sse as sse_stream
from tessera.streaming.run import replay


def vectors(seed, n, clusters, width=8):
    rng = np.random.default_rng(seed)
    centres = np.random.default_rng(0).normal(size=(clusters, width))
    rows = [[float(x) for x in centres[i % clusters] + rng.normal(size=width) * 0.05] for i in range(n)]
    rows[3], rows[4], rows[5], rows[6] = [0.0] * width, None, [float("nan")] * width, [1.0]
    rows[7] = rows[8] = rows[9] = rows[10] = rows[11] = rows[12] = rows[13]
    return rows


@pytest.mark.parametrize("n, clusters", [(900, 12), (40, 3)])
def test_pruned_search_finds_the_same(spark, monkeypatch, n, clusters):
    monkeypatch.setattr(nearest, "VECTORS", 16)
    monkeypatch.setattr(nearest, "QUESTIONS", 4)
    chunks = spark.createDataFrame([(i, v) for i, v in enumerate(vectors(1, n, clusters))], "no int, embedding array<float>")
    asked = [(i, v) for i, v in enumerate(vectors(2, n, clusters)[:60]) if v and len(v) == 8] + [(1000, [0.0] * 8), (1001, vectors(1, n, clusters)[13])]
    queries = spark.createDataFrame(asked, "query_id int, vector array<float>").repartition(3)
    whole = chunks.where("size(embedding) = 8")
    want = {(r.query_id, r["rank"]): (r.no, r.score) for r in similarity.cosine_topk(whole, queries, ["no"]).collect()}
    work = {}
    got = {(r.query_id, r["rank"]): (r.no, r.score) for r in nearest.pruned_topk(chunks, queries, ["no"], work=work).collect()}
    assert got == want and len(got) > 100
    if n > 100:
        assert work["dots"] * 3 < work["pairs"]


def test_pruned_search_in_blocks(spark, monkeypatch):
    """Questions in many blocks, vectors in many runs, more equal vectors than a question keeps, names of text."""
    for name, value in (("VECTORS", 16), ("QUESTIONS", 4), ("ASKED", 64)):
        monkeypatch.setattr(nearest, name, value)
    rows = vectors(4, 300, 6) + [[0.0] * 8] * 20 + vectors(4, 300, 6)[20:60] * 3
    chunks = spark.createDataFrame([(f"n{i * 7 % 1000 // 10}", i % 10, v) for i, v in enumerate(rows)], "name string, no int, embedding array<double>").repartition(5)
    asked = [(f"q{i}", v) for i, v in enumerate(rows[:60]) if v and len(v) == 8]
    queries = spark.createDataFrame(asked, "query_id string, vector array<double>")
    told = lambda top: sorted(tuple(r) for r in top.select("query_id", "rank", "name", "no", "score").collect())
    got = told(nearest.pruned_topk(chunks, queries, ["name", "no"]))
    whole = chunks.where("size(embedding) = 8 and forall(embedding, x -> not isnan(x))")
    assert got == told(similarity.cosine_topk(whole, queries.where("forall(vector, x -> not isnan(x))"), ["name", "no"])) and len(got) > 250


def test_search_shuffles_no_pairs(spark, monkeypatch):
    """Where bounds leave nothing out, no question is shuffled to each cell of vectors."""
    monkeypatch.setattr(nearest, "VECTORS", 16)
    rng = np.random.default_rng(5)
    made = lambda n: [(i, [float(x) for x in row]) for i, row in enumerate(rng.normal(size=(n, 16)))]
    chunks, queries = spark.createDataFrame(made(4000), "no int, embedding array<double>"), spark.createDataFrame(made(500), "query_id int, vector array<double>")
    executors = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False)
    bytes_out = lambda: sum(found.apply(i).totalShuffleWrite() for found in [executors()] for i in range(found.size()))
    before = bytes_out()
    assert nearest.pruned_topk(chunks, queries, ["no"]).count() == 2500
    assert bytes_out() - before < 2_000_000


def test_tokens_are_added_in_parts(monkeypatch):
    monkeypatch.setattr(embedding.HashedTokens, "MEMO", 3)
    monkeypatch.setattr(embedding.HashedTokens, "AT_ONCE", 4)
    texts = ["a b c d e f", None, "", "A a", " \n", "x", "a b c"]
    one = embedding.HashedTokens()
    assert np.array_equal(embedding.HashedTokens()(texts), np.concatenate([one([t]) for t in texts]))
    assert not embedding.HashedTokens()(texts)[[1, 2, 4]].any() and np.array_equal(one(["A a"]), one(["a"]))


def test_pruned_search_of_nothing(spark):
    none = spark.createDataFrame([], "no int, embedding array<float>")
    queries = spark.createDataFrame([(1, [1.0])], "query_id int, vector array<float>")
    assert nearest.pruned_topk(none, queries, ["no"]).count() == 0
    one = spark.createDataFrame([(1, [2.0])], "no int, embedding array<float>")
    assert [tuple(r) for r in nearest.pruned_topk(one, queries, ["no"]).select("query_id", "rank", "no").collect()] == [(1, 1, 1)]
    assert nearest.pruned_topk(one, queries.where("false"), ["no"]).count() == 0


def test_index_build(spark):
    docs = spark.createDataFrame([("a", "# One\nx y\n## Two\nz"), ("b", None), ("c", "  ")], "rel string, content string")
    made = embedding.build_index(docs, embedding.HashedTokens).orderBy("source", "sec_pos").collect()
    assert [(r.source, r.sec_pos, r.text) for r in made] == [("a", 0, "# One\nx y"), ("a", 1, "## Two\nz"), ("c", 0, "")]
    same = embedding.HashedTokens()(["Y # one X", "", None])
    assert np.allclose(made[0].embedding, same[0]) and made[2].embedding == [0.0] * 32 == same[1].tolist() == same[2].tolist()
    assert np.linalg.norm(same[0]) == pytest.approx(1, abs=1e-6)
    asked = embedding.embed(spark.createDataFrame([(1, "ONE # x y")], "query_id int, text string"), embedding.HashedTokens, vector="vector")
    found = nearest.retrieved(spark.createDataFrame(made), asked, RetrievalConfig(top_k=2)).head()
    assert found.n_chunks == 2 and found.context.startswith("## [a]\n\n# One\nx y\n\n---\n\n## [")


def test_many_keywords(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdé😀 ") for _ in range(n))
    rows = [(i, [word(rng.randrange(1, 7)), word(9)]) for i in range(300)]
    texts = [(i, word(rng.randrange(0, 60)).upper() if i % 2 else word(rng.randrange(0, 60))) for i in range(50)] + [(50, None), (51, "")]
    entries = spark.createDataFrame(rows, "entry_id int, keywords array<string>")
    queries = spark.createDataFrame(texts, "query_id int, query string")
    got = {tuple(r) for r in routing.keyword_hits(queries, entries).collect()}
    assert got == {(q, e) for q, t in texts for e, words in rows if t is not None and any(w in t.lower() for w in words)} and got
    assert routing.keyword_hits(queries, entries.where("false")).count() == 0
    # the route is the same whichever way it takes
    full = entries.withColumn("files", F.array(F.concat(F.lit("f"), (F.col("entry_id") % 20).cast("string"))))
    routed = lambda: sorted(map(tuple, routing.keyword_route(queries, full).collect()))
    by_grams, few = routed(), routing.FEW_KEYWORDS
    routing.FEW_KEYWORDS = 10_000
    by_loop = routed()
    routing.FEW_KEYWORDS = few
    assert by_grams == by_loop


def test_keyword_counts(spark):
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    rows = [(i, [word(rng.randrange(1, 5)) for _ in range(rng.randrange(0, 5))]) for i in range(400)] + [(400, ["a", "a"]), (401, [])]
    texts = [(i, word(rng.randrange(0, 30))) for i in range(60)] + [(60, None), (61, "")]
    want = {}
    for q, t in texts:
        found = [e for e, words in rows if t is not None and any(w in t for w in words)]
        if found:
            want[q] = (len(found), min(found), sum(found))
    got = routing.keyword_counts(spark.createDataFrame(texts, "query_id int, query string"), spark.createDataFrame(rows, "entry_id int, keywords array<string>"))
    assert {r.query_id: tuple(r)[1:] for r in got.collect()} == want and len(want) > 40
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("block", [1 << 20, 3000])
def test_keyword_counts_in_blocks(spark, monkeypatch, block):
    """Keywords with blanks and empty ones, questions and entries that share an id, in one block and in many."""
    monkeypatch.setattr(keywords, "BLOCK", block)
    monkeypatch.setattr(keywords, "MEMO", 20)
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abcdé😀 \n") for _ in range(n))
    rows = [(i // 2, [word(rng.randrange(1, 7)) for _ in range(rng.randrange(0, 4))]) for i in range(200)] + [(500, [None, "ab"]), (501, ["  "])]
    texts = [(i // 2, word(rng.randrange(0, 80)).upper()) for i in range(80)] + [(60, None), (61, "")]
    for more in ([], [(502, [""])]):
        want = {}
        for q, t in texts:
            for e in [e for e, words in rows + more if t is not None and any(w is not None and w in t.lower() for w in words)]:
                n, least, total = want.get(q, (0, e, 0))
                want[q] = (n + 1, min(least, e), total + e)
        got = routing.keyword_counts(spark.createDataFrame(texts, "query_id int, query string"), spark.createDataFrame(rows + more, "entry_id int, keywords array<string>"))
        assert {r.query_id: tuple(r)[1:] for r in got.collect()} == want and len(want) > 30
    kinds = keywords.numbered(spark.createDataFrame([(w,) for _, words in rows for w in words], "keyword string"))
    assert (len(keywords.keyword_blocks(kinds)) > 1) == (block == 3000)


def test_keyword_counts_shuffle_little(spark):
    """Less is shuffled than the questions' texts; a row for each stretch of a question was far more."""
    words = [f"{i:05x}w" for i in range(3000)]
    texts = [(i, " ".join(random.Random(i).sample(words, 200))) for i in range(300)]
    questions = spark.createDataFrame(texts, "query_id int, query string")
    entries = spark.createDataFrame([(i, [w, "w"]) for i, w in enumerate(words[::2])], "entry_id int, keywords array<string>")
    executors = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False)
    bytes_out = lambda: sum(found.apply(i).totalShuffleWrite() for found in [executors()] for i in range(found.size()))
    before = bytes_out()
    got = routing.keyword_counts(questions, entries, RetrievalConfig(broadcast_rows=10)).collect()
    assert {r.query_id: r.n_entries for r in got} == {i: 1500 for i, _ in texts}
    assert bytes_out() - before < sum(len(t) for _, t in texts)


def test_many_keywords_need_no_nested_loop(spark):
    entries = spark.range(100_000).select(F.col("id").alias("entry_id"), F.array(F.concat(F.lit("key"), F.hex("id"), F.lit("word"))).alias("keywords"), F.array(F.lit("f")).alias("files"))
    queries = spark.createDataFrame([(1, "a KEY1869Fword b"), (2, "key1869Gword")], "query_id int, query string")
    low = entries.withColumn("keywords", F.transform("keywords", F.lower))
    route = routing.keyword_route(queries, low)
    plan = route._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert [tuple(r) for r in route.collect()] == [(1, 0, "f")]


def test_tree(spark, tmp_path, monkeypatch):
    names = [f"{d}{f}" for d in ("", "a/", "a/b/c/", ".h/", "_d/") for f in ("x.md", ".y.md", "_z.md", "n.txt")]
    for n in names:
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_bytes(n.encode() + b"\r\n\xff")
    for dealt in (1, 3, 128):
        monkeypatch.setattr(files, "DEALT", dealt)
        for root in (str(tmp_path), f"file://{tmp_path}"):
            assert sorted(r.rel for r in files.list_tree(spark, root).collect()) == sorted(names)
    got = {r.rel: r.content for r in markdown.read_markdown(spark, f"file://{tmp_path}").collect()}
    assert got == {n: n + "\r\n�" for n in names if n.endswith(".md") and not n.rsplit("/", 1)[-1].startswith("_")}
    listed = files.list_tree(spark, str(tmp_path), ".md").collect()
    (tmp_path / "x.md").unlink()
    assert files.read_files(spark.createDataFrame(listed), str(tmp_path)).count() == len(listed) - 1


def test_last_write_wins(spark, tmp_path):
    rows = [(1, "a/b.txt", "one"), (3, "a//./b.txt", "three"), (2, "a/b.txt", "two"), (1, "c.txt", "é")]
    plan = spark.createDataFrame(rows, "no int, path string, content string").repartition(4)
    for _ in range(2):  # a second run leaves the same
        sink.write_planned(plan, f"file://{tmp_path}", ["no"])
    assert sorted(p.name for p in tmp_path.rglob("*") if p.is_file()) == ["b.txt", "c.txt"]
    assert (tmp_path / "a/b.txt").read_text() == "three" and (tmp_path / "c.txt").read_text() == "é"
    with pytest.raises(Exception, match="leads out"):
        sink.write_planned(plan.withColumn("path", F.lit("a/../../x")), str(tmp_path))


def test_events_are_written_once(spark, tmp_path):
    rows = [("s", i, "token", f"t{i}") for i in range(20)]
    spark.createDataFrame(rows, "session string, seq long, type string, content string").repartition(5).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema("session string, seq long, type string, content string").option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
    write, failed = sink.event_sink(f"{tmp_path}/out"), []

    def once_lost(batch, batch_id):
        write(batch, batch_id)
        if batch_id == 1 and not failed:
            failed.append(batch_id)
            raise RuntimeError("lost after it had written")

    def run():
        stream().writeStream.foreachBatch(once_lost).option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start().awaitTermination()

    with pytest.raises(Exception, match="lost after"):
        run()
    run()
    got = sink.read_events(spark, f"{tmp_path}/out", "session string, seq long, type string, content string").collect()
    assert failed and sorted(map(tuple, got)) == sorted(rows)


def meta(**fields):
    return "<file-action>" + json.dumps(fields) + "</file-action>"


def folded(spark, text, answers=(), existing=(), workspace=True):
    found = actions.extract_actions(spark.createDataFrame([(1, text)], "resp_id int, text string"))
    decisions = spark.createDataFrame([(1, *a) for a in answers], "resp_id int, action_no int, edited_path string, overwrite_ok boolean")
    templates = spark.createDataFrame([("page", "{{ComponentName}}")], "templateType string, template string")
    there = spark.createDataFrame([(p,) for p in existing], "path string")
    r = actions.fold_actions(found, decisions, templates, there, workspace).head()
    return [(e.type, e.message or e.file_path) for e in r.events], {w.path: w.content for w in r.writes}


def test_actions_in_sequence(spark):
    page = lambda name, **more: meta(action="createFile", templateType="page", componentName=name, filePath="p", **more)
    router = meta(action="updateFile", templateType="router", filePath="p", generatedCode="r")
    # the second page meets the first one's file
    assert folded(spark, page("A") + page("B") + page("C"), [(0, " p ", None), (1, "p", True), (2, "q", None)]) == ([("fileCreated", "p"), ("fileCreated", "p"), ("fileCreated", "q")], {"p": "B", "q": "C"})
    assert folded(spark, page("A") + page("B") + router, [(0, "p", None), (1, "p", False)]) == ([("fileCreated", "p"), ("fileCancelled", None)], {"p": "A"})
    assert folded(spark, page("A") + router, [(0, "p", None)], ["p"]) == ([("fileCancelled", None)], {})
    assert folded(spark, page("A") + router + "<file-action>{</file-action><file-action>{\"a\":NaN}</file-action>", [(0, "p", True)], ["p"]) == (
        [("fileError", actions.NO_META), ("fileError", actions.BAD_META), ("fileCreated", "p"), ("fileUpdated", "p")], {"p": "r"})
    store = meta(action="createFile", templateType="store", filePath="s")
    empty = meta(action="updateFile", templateType="page", filePath="u")
    assert folded(spark, store + empty + page("A"), [(0, "s", None), (2, "p", None)]) == (
        [("fileError", "템플릿 파일을 찾을 수 없습니다: store.template.txt"), ("fileError", "u: 수정할 코드가 없습니다."), ("fileCreated", "p")], {"p": "A"})
    assert folded(spark, page("A") + store, [(0, "p", None)], workspace=False) == ([("fileError", actions.NO_WORKSPACE)] * 2, {})


@pytest.mark.parametrize("constant", ["NaN", "Infinity", "-Infinity", "01", "'x'", "undefined"])
def test_metadata_is_strict(spark, constant):
    text = '<file-action>{"action":"createFile","n":' + constant + "}</file-action>"
    assert actions.extract_actions(spark.createDataFrame([(1, text)], "resp_id int, text string")).head().error == actions.BAD_META


def delta(content):
    return '{"choices":[{"delta":{"content":' + content + "}}]}"


#: Payloads and the tokens they give.
FRAMES = [
    (delta('"a"'), "a"), (delta('"x","content":"last"'), "last"), ('{"choices":[],"choices":[{"delta":{"content":"dup"}}]}', "dup"), (delta('"b"') + " late", None), (delta('"b"') + delta('"c"'), None),
    (delta('"b"') + "]", None), (delta('"b"') + '},"end0":true,"x":{', None), (delta("NaN"), None), (delta("5"), None), (delta("null"), None), (delta('{"x":1}'), None), (delta('""'), None), (delta('"\\ud83d"'), "?"),
    (delta('"\\ud83d\\ude00"'), "😀"), ('{"n":NaN,' + delta('"d"')[1:], None), ("{'choices':[]}", None), ("[]", None), ("5", None), ('{"choices":{}}', None), ('{"choices":[5]}', None), ("{", None),
    ('{"id":{"a":[1,2,{"b":null}]},' + delta('"e"')[1:], "e"), (delta('"end0"'), "end0"), (delta('"end1"'), "end1"), (delta('"tab\\t\\u0041"'), "tab\tA"), (delta('"raw\ttab"'), None),
]


def test_odd_frames(spark):
    rows = [(i, 0, f"data: {p}\n".encode()) for i, (p, _) in enumerate(FRAMES)]
    df = spark.createDataFrame(rows, "resp_id long, chunk_no long, bytes binary")
    want = {i: t for i, (_, t) in enumerate(FRAMES) if t is not None}
    assert {r.resp_id: r.token for r in sse.decode_sse(df).collect()} == want
    assert {r.resp_id: r.token for r in replay(df, lambda c: sse_stream.decode_stream(c, None)).collect()} == want


@pytest.mark.parametrize("size", [1, 7, 400])
def test_cells_score_as_all_pairs(size):
    rng = np.random.default_rng(3)
    held, asked = rng.normal(size=(400, 8)), rng.normal(size=(40, 8))
    held[5], held[6:9], held[9], held[10], held[11] = 0, held[20], held[20] * 3, held[21] * 1e-7, held[22] * 1e-70
    asked[0], asked[1], asked[2], asked[3] = 0, held[20], held[21] * 1e-6, held[22] * 1e-80
    want = []
    for q, x in enumerate(asked):
        score = [sum(a * b for a, b in zip(x, y, strict=True)) / (np.sqrt(sum(a * a for a in x)) * np.sqrt(sum(b * b for b in y)) + 1e-10) for y in held]
        want.append(sorted(range(400), key=lambda i: (-score[i], i))[:5])
        for least in (np.nan, score[want[q][4]]):
            got = []
            for a in range(0, 400, size):
                _, to, found = nearest.Cell(held[a : a + size], 5, 1e-10).best(asked[q : q + 1], np.array([least]))
                got += list(zip(-found, to + a, strict=True))
            assert [i for _, i in sorted(got)[:5]] == want[q]


def test_registered_searches_send_no_question_to_all(spark):
    plan = registry.QUERIES["cosine_topk_batch"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
