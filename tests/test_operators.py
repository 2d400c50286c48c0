"""Small cases with results worked out by hand."""

import os

import pytest
from pyspark.sql import functions as F

from tessera.config import RetrievalConfig
from tessera.functions.text import trimmed
from tessera.operators import actions, chunking, events, hybrid, prompt, routing, similarity, sse
from tessera.sources import markdown, sink
from tessera.streaming import events as event_stream
from tessera.streaming import sse as sse_stream
from tessera.streaming.run import replay


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).head().x


@pytest.mark.parametrize("n, starts", [(600, [0]), (601, [0, 500]), (1050, [0, 500, 1000])])
def test_windows(spark, n, starts):
    text = "".join(chr(97 + i % 26) for i in range(n))
    pieces = one(spark, chunking.windows(F.col("t"), 600, 100), t=text)
    assert pieces == [text[s : s + 600] for s in starts]
    assert "".join(p[:500] for p in pieces[:-1]) + pieces[-1] == text


@pytest.mark.parametrize("text, parts", [
    ("# a\nx\n## b\n#### c\n### d\n", ["# a\nx\n", "## b\n#### c\n", "### d\n"]), ("pre\n# a", ["pre\n", "# a"]), (" \n", [" \n"]), ("", [""]), ("a\u0085# b", ["a\u0085# b"]),
])
def test_sections(spark, text, parts):
    assert one(spark, chunking.sections(F.col("t")), t=text) == parts


def test_trim_takes_every_blank(spark):
    assert one(spark, trimmed(F.col("t")), t="\ufeff\u3000\n a b\t\u00a0") == "a b"


def test_keyword_index_pairs_lists_by_position(spark):
    text = "- keywords: [A, b]\n- keywords: [c]\n  files: [x.md,\n y.md]\n"
    got = routing.parse_keyword_index(spark.createDataFrame([(1, text)], "index_id int, text string")).collect()
    assert [(r.entry_id, r.keywords, r.files) for r in got] == [(0, ["a", "b"], ["x.md", "y.md"])]


def test_context_rules(spark):
    q = spark.createDataFrame([(1, "C:\\app\\Domains\\platform\\x", "import { Table가 } from 'a'\nimport MyTable\n  import create from 'zustand' // STORE"), (2, None, None)], "query_id int, file_path string, file_content string")
    docs = spark.createDataFrame([(t,) for t in ("patterns/domain-structure.md", "patterns/form-handling.md", "components/Table.md", "patterns/state-management.md")], "rel string")
    got = {(r.query_id, r.rel) for r in routing.context_route(q, docs).collect()}
    assert got == {(1, t) for t in ("patterns/domain-structure.md", "patterns/form-handling.md", "components/Table.md", "patterns/state-management.md")}


def hybrid_case(spark, chunks, entries, content=None, mode="compat"):
    q = spark.createDataFrame([(1, "find alpha", "f", content, [1.0, 0.0])], "query_id int, query string, file_path string, file_content string, vector array<float>")
    e = spark.createDataFrame(entries, "entry_id int, keywords array<string>, files array<string>")
    docs = spark.createDataFrame([(x, "text") for x in ("A", "B", "C", "components/Table.md")], "rel string, content string")
    c = spark.createDataFrame([(s, 0, i, t, [1.0, float(i)]) for i, (s, t) in enumerate(chunks)], "source string, sec_pos int, piece_pos int, text string, embedding array<float>")
    r = hybrid.hybrid_context(q, e, docs, c, mode=mode).head()
    return [d.split("\n")[0] for d in r.docs], r.methods


def test_hybrid(spark):
    five = [("A", "1"), ("A", "2"), ("B", "3"), ("C", "4"), ("D", "5")]
    assert hybrid_case(spark, five, [(0, ["alpha"], ["A"])]) == (["## [A]"], ["keyword", "embedding"])
    assert hybrid_case(spark, five, [(0, ["zz"], ["A"])]) == (["## [A]", "## [B]"], ["embedding"])
    assert hybrid_case(spark, five, [(0, ["alpha"], ["A", "B"])], "import Table") == (["## [A]", "## [B]", "## [components/Table.md]"], ["keyword", "context"])
    assert hybrid_case(spark, [("s", "A\n\n---"), ("t", "B")], [(0, ["zz"], ["A"])]) == (["## [s]", "---"], ["embedding"])
    assert hybrid_case(spark, [("s", "A\n\n---"), ("t", "B")], [(0, ["zz"], ["A"])], mode="clean") == (["## [s]", "## [t]"], ["embedding"])


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    got = [r[0] for r in df.select(similarity.cosine(F.col("a"), F.col("b"), similarity.norm(F.col("a")), similarity.norm(F.col("b")))).collect()]
    assert got[0] == pytest.approx(0.9999999999, abs=1e-12) and got[1] == 0


def test_embedder_runs_in_tasks_and_ties_keep_order(spark):
    chunks = spark.createDataFrame([(i, "x" * (i % 2)) for i in range(8)], "no int, text string")
    c = similarity.embed_chunks(chunks, lambda texts: [[1.0, float(len(t))] for t in texts])
    q = spark.createDataFrame([(1, [1.0, 1.0])], "query_id int, vector array<float>")
    assert [r.no for r in similarity.cosine_topk(c, q, ["no"], RetrievalConfig(top_k=3)).orderBy("rank").collect()] == [1, 3, 5]


def frame(content):
    return 'data: {"choices":[{"delta":{"content":"' + content + '"}}]}\n'


STREAM = (frame("Hé") + ": note\ndata: {bad\n" + frame("") + "data:" + frame("l이")[6:] + "data: [DONE]\n" + frame("X") + frame("tail")[:-1]).encode()


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_sse(spark, size):
    chunks = [(1, i, STREAM[a : a + size]) for i, a in enumerate(range(0, len(STREAM), size))]
    df = spark.createDataFrame(chunks[::-1], "resp_id long, chunk_no long, bytes binary")
    assert sse.fold_tokens(sse.decode_sse(df)).head().response == "Hél이"
    if size != 1:
        streamed = replay(df.repartition(3), lambda c: sse_stream.decode_stream(c, None)).orderBy("seq").collect()
        assert [r.token for r in streamed] == ["Hé", "l이"]


UI = [("token", "a"), ("fileCreated", "p"), ("token", "b"), ("done", None), ("done", None), ("token", "c"), ("error", "e"), ("error", "f"), ("status", "s"), ("token", "d")]


def test_events(spark):
    df = spark.createDataFrame([("s", i, t, x, x, x, x) for i, (t, x) in enumerate(UI)], "session string, seq long, type string, content string, message string, text string, file_path string")
    got = sorted((r.start_seq, r.role, r.content, r.is_error, r.streaming) for r in events.reduce_events(df).collect())
    assert got == [
        (0, "assistant", "ab", False, False), (1, "system", "p", False, False), (5, "assistant", "오류: e", True, False),
        (7, "assistant", "오류: f", True, False), (9, "assistant", "d", False, True),
    ]
    streamed = sorted((r.start_seq, r.role, r.content, r.is_error) for r in replay(df, lambda e: event_stream.reduce_stream(e, None)).collect())
    assert streamed == [x[:4] for x in got if not x[4]]
    assert events.last_status(df).head().status == "s"
    tokens = spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "resp_id int, seq int, token string")
    assert events.until_abort(tokens, spark.createDataFrame([(1, 1)], "resp_id int, aborted_at_seq int")).count() == 1


def test_actions(spark):
    text = 'x <file-action>{"action":"createFile","templateType":"page","componentName":"AbC","filePath":"p"}\n```TSX\nno```</file-action> y <file-action>{"a":{}}</file-action> <file-action>none</file-action>'
    df = spark.createDataFrame([(1, text)], "resp_id int, text string")
    got = actions.extract_actions(df).orderBy("action_no").collect()
    assert [(r.filePath, r.generatedCode, r.error) for r in got] == [("p", None, None), (None, None, actions.BAD_META), (None, None, actions.NO_META)]
    assert one(spark, actions.strip_actions(F.col("t")), t=text) == "x  y"
    templates = spark.createDataFrame([("page", "{{ComponentName}} {{componentName}}")], "templateType string, template string")
    asked = spark.createDataFrame([(1, 0, " q ", False, None)], "resp_id int, action_no int, edited_path string, file_exists boolean, overwrite_ok boolean")
    plan = actions.plan_writes(actions.extract_actions(df), asked, templates)
    assert [(r.path, r.content, r.outcome) for r in plan.collect()] == [("q", "AbC abC", "created")]
    rows = [(1, 0, "page", "cancelled"), (1, 1, "router", "updated"), (2, 0, "router", "cancelled"), (2, 1, "page", "created")]
    left = actions.action_outcomes(spark.createDataFrame(rows, "resp_id int, action_no int, templateType string, outcome string"))
    assert {(r.resp_id, r.action_no) for r in left.collect()} == {(1, 0), (2, 0), (2, 1)}


def test_prompt_parts(spark):
    cap = lambda n: one(spark, prompt.cap_lines(F.col("t"), 200), t="\n".join("x" * n))
    assert cap(200).count("\n") == 199 and cap(201).endswith("\n\n... (1줄 생략됨)")
    domain = lambda q: one(spark, prompt.extract_domain(F.col("q")), q=q)
    assert [domain(q) for q in ("Account 업무에", "a DOMAIN", "b 도메인 c 업무", "account에", "subdomain", "the orderDomain")] == ["account", "a", "c", None, "sub", "order"]
    assert one(spark, prompt.file_section(F.col("p"), F.col("l"), F.col("c"), F.col("s")), p="f", l="ts", c="x", s="").endswith("x\n```\n")
    assert one(spark, prompt.selection(F.col("s")), s=" \n") is None


def test_markdown_tree(spark, tmp_path):
    for name in ("a.md", "_index.md", "d/_x.md", "_d/b.md", ".h/d.md", "UP.MD"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x\r\n")
    os.symlink(tmp_path / "a.md", tmp_path / "link.md")
    got = {r.rel: r.content for r in markdown.read_markdown(spark, str(tmp_path)).collect()}
    assert got == {k: "x\r\n" for k in ("a.md", "_d/b.md", ".h/d.md")}
    assert markdown.read_markdown(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / ".rag").mkdir()
    assert markdown.resolve_source(["/nowhere", str(tmp_path)], None) == str(tmp_path / ".rag")
    assert markdown.resolve_source([], "/nowhere") is None


def test_sink_stays_inside(spark, tmp_path):
    plan = spark.createDataFrame([("a/b.txt", "x")], "path string, content string")
    sink.write_planned(plan, str(tmp_path))
    assert (tmp_path / "a/b.txt").read_text() == "x"
    for bad in ("../x", "/etc/x"):
        with pytest.raises(ValueError, match="leads out"):
            sink.inside(bad)


def test_top_k_plan_limits_before_the_shuffle(spark):
    c = spark.createDataFrame([(1, [1.0])], "vec_id int, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0])], "query_id int, vector array<float>")
    plan = similarity.cosine_topk(c, q, ["vec_id"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "BroadcastNestedLoopJoin" in plan


@pytest.mark.parametrize("endpoint, url", [
    ("http://Host:8080/base?x", "http://host:8080/v1/chat/completions"), ("HTTPS://h:443", "https://h/v1/chat/completions"), ("http://h:443/", "http://h:443/v1/chat/completions"), ("h:80", None), ("", None),
])
def test_chat_url(spark, endpoint, url):
    assert one(spark, prompt.chat_url(F.col("t")), t=endpoint) == url


def test_requests_and_errors(spark):
    names = lambda k: [h.name for h in one(spark, prompt.chat_headers(F.col("t")), t=k)]
    assert names("") == names(None) == ["Content-Type", "Accept", "User-Agent"] and names("k")[3:] == ["Authorization"]
    rows = spark.createDataFrame([(200, "OK", "x"), (204, None, None), (500, None, None), (None, "lost", "x")], "s int, m string, b string")
    got = [r[0] for r in rows.select(prompt.response_error(F.col("s"), F.col("m"), F.col("b"))).collect()]
    assert got == [None, prompt.NO_BODY, prompt.BAD_STATUS + "500 ", prompt.BAD_STATUS + " lost"]


def test_rebuild_leaves_what_stayed(spark):
    index = spark.createDataFrame([("stays", 0, 0, "as it was"), ("goes", 0, 0, "x"), ("new", 0, 0, "x")], "source string, sec_pos int, piece_pos int, text string")
    changes = spark.createDataFrame([("goes", "deleted"), ("new", "changed"), ("more", "created")], "rel string, change string")
    docs = spark.createDataFrame([("stays", "not read"), ("new", "# a\n# b"), ("more", "y")], "rel string, content string")
    got = sorted(tuple(r) for r in chunking.rebuild_index(index, changes, docs).collect())
    assert got == [("more", 0, 0, "y"), ("new", 0, 0, "# a"), ("new", 1, 0, "# b"), ("stays", 0, 0, "as it was")]


def test_trimming_leaves_what_is_no_white_space(spark):
    rows = [(" 　a b \x85", "a b \x85"), ("﻿\n", ""), ("x\t \n", "x"), ("é", "é")]
    from tessera.functions.text import said, trimmed, trimmed_end

    c = F.col("t")
    for t, want in rows:
        got = spark.createDataFrame([(t,)], "t string").select(trimmed(c).alias("both"), trimmed_end(F.concat(F.lit(" "), c)).alias("end"), said(c).alias("said")).head()
        assert (got.both, got.said) == (want, want != "") and got.end.strip(" 　") == want


def test_answers_of_one_file_are_dealt_over_tasks(spark):
    answers = spark.range(100).coalesce(1).select(F.col("id").alias("resp_id"), F.lit("<file-action>{}</file-action>").alias("text"))
    assert actions.extract_actions(answers).rdd.getNumPartitions() > 4


def test_embedders_get_small_batches(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    texts = spark.range(3000).coalesce(1).select(F.lit("x" * 100).alias("text"))
    out = similarity.embed_chunks(texts, lambda t: [[float(len(t))]] * len(t)).agg(F.max(F.get("embedding", F.lit(0))).alias("n")).head()
    assert out.n <= 500
