"""File actions inside answers: extraction, routing, rendering and outcomes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import trimmed, trimmed_end

TAG = "file-action"
FIELDS = "action string, templateType string, domain string, componentName string, filePath string, generatedCode string"
#: How kinds of file are called when their path is asked for.
LABELS = {"page": "페이지 컴포넌트", "component": "컴포넌트", "store": "스토어", "api": "API 모듈", "router": "라우터"}
OTHER_LABEL = "파일"
#: What is said of a block without metadata, and of one whose metadata is no JSON.
NO_META, BAD_META = "JSON 메타데이터를 찾을 수 없습니다.", "JSON 파싱에 실패했습니다."
#: Why a file isn't written; {path} and {kind} stand for the action's own.
NO_WORKSPACE = "열린 워크스페이스가 없습니다."
NO_CODE = "{path}: 수정할 코드가 없습니다."
NO_TEMPLATE = "템플릿 파일을 찾을 수 없습니다: {kind}.template.txt"


def _block(tag: str) -> str:
    return rf"<{tag}>([\s\S]*?)</{tag}>"


def strip_actions(text: Column, tag: str = TAG) -> Column:
    """Without action blocks, trimmed; a block without its end stays."""
    return trimmed(F.regexp_replace(text, _block(tag), ""))


def extract_actions(responses: DataFrame, tag: str = TAG) -> DataFrame:
    """Rows for each block of (resp_id, text): the action's fields, or ``error``.

    The metadata is the first brace to the first closing one without a back tick between; the first
    fenced code, if not empty, replaces ``generatedCode``.  Answers are dealt over all tasks first: a small
    file of very many answers would be parsed by one."""
    tasks = 2 * responses.sparkSession.sparkContext.defaultParallelism
    blocks = responses.select("resp_id", "text").repartition(tasks, "resp_id").select("resp_id", F.posexplode(F.regexp_extract_all("text", F.lit(_block(tag)), F.lit(1))).alias("action_no", "block"))
    meta = F.regexp_extract("block", r"(\{[^`]*?\})", 1)
    code = F.regexp_extract("block", r"```(?:[a-z]*)\n([\s\S]*?)```", 1)
    parsed = blocks.select("resp_id", "action_no", meta.alias("meta"), code.alias("code"), F.from_json(meta, FIELDS + ", _bad string", {"columnNameOfCorruptRecord": "_bad", "allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}).alias("a"))
    ok = (F.col("meta") != "") & F.col("a").isNotNull() & F.col("a._bad").isNull()
    error = F.when(F.col("meta") == "", NO_META).when(~ok, BAD_META)
    fields = [F.when(ok, F.col(f"a.{n}")).alias(n) for n in ("action", "templateType", "domain", "componentName", "filePath")]
    own = F.when(F.col("code") != "", trimmed_end(F.col("code"))).otherwise(F.col("a.generatedCode"))
    return parsed.select("resp_id", "action_no", *fields, F.when(ok, own).alias("generatedCode"), error.alias("error"))


def is_update(action: Column, kind: Column) -> Column:
    """Written without asking: updates, and routers of any action."""
    return F.coalesce(action == "updateFile", F.lit(False)) | F.coalesce(kind == "router", F.lit(False))


def label(kind: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    return F.coalesce(F.element_at(known, kind), F.lit(OTHER_LABEL))


def render_template(template: Column, name: Column) -> Column:
    lower_first = F.concat(F.lower(F.substring(name, 1, 1)), F.substring(name, F.lit(2), F.length(name)))
    return F.replace(F.replace(template, F.lit("{{ComponentName}}"), name), F.lit("{{componentName}}"), lower_first)


def plan_writes(actions: DataFrame, decisions: DataFrame, templates: DataFrame) -> DataFrame:
    """What would be written: ``path``, ``content`` and ``outcome`` of every parsed action.

    ``decisions`` (resp_id, action_no, edited_path, file_exists, overwrite_ok) are the user's answers;
    a null path cancels.  ``templates`` (templateType, template) fill in for missing code."""
    parsed = actions.where("error is null").join(decisions, ["resp_id", "action_no"], "left").join(templates, "templateType", "left")
    has_code = F.coalesce(F.col("generatedCode") != "", F.lit(False))
    update = is_update(F.col("action"), F.col("templateType"))
    path = F.when(update, F.col("filePath")).otherwise(trimmed(F.col("edited_path")))
    content = F.when(has_code, F.col("generatedCode")).when(~update, render_template(F.col("template"), F.col("componentName")))
    refused = F.coalesce(F.col("file_exists"), F.lit(False)) & ~F.coalesce(F.col("overwrite_ok"), F.lit(False))
    outcome = (
        F.when(update & ~has_code, "error").when(update, F.when(F.col("action") == "updateFile", "updated").otherwise("created"))
        .when(F.col("edited_path").isNull() | refused, "cancelled").when(content.isNull(), "error")
        .when(F.col("action") == "updateFile", "updated").otherwise("created")
    )
    done = outcome.isin("created", "updated")
    return parsed.select("resp_id", "action_no", "templateType", F.when(done, path).alias("path"), F.when(done, content).alias("content"), outcome.alias("outcome"))


def action_outcomes(plan: DataFrame) -> DataFrame:
    """The part of ``plan`` that happens: a cancelled action, unless of a router, stops those after it."""
    w = Window.partitionBy("resp_id").orderBy("action_no").rowsBetween(Window.unboundedPreceding, -1)
    stops = (F.col("outcome") == "cancelled") & ~F.coalesce(F.col("templateType") == "router", F.lit(False))
    stopped = F.coalesce(F.max(stops.cast("int")).over(w), F.lit(0)) == 1
    return plan.withColumn("__s", stopped).where("not __s").drop("__s")


def fold_actions(actions: DataFrame, decisions: DataFrame, templates: DataFrame, existing: DataFrame, workspace: bool = True) -> DataFrame:
    """Each response's actions one after the other: ``resp_id``, ``events`` and ``writes``.

    ``actions`` as extracted; ``decisions`` (resp_id, action_no, edited_path, overwrite_ok) are the
    user's answers, a null or missing path cancels; ``existing`` (path) are the files there before.
    A file that an action has made exists for those after it, so making it again needs the user's
    consent.  A cancelled action, unless of a router, ends the sequence; an error does not.

    ``events`` (type, message, file_path) in order: first an error for each block without usable
    metadata, then what became of each action.  ``writes`` (path, content): of each file what was
    written to it last."""
    fill = lambda text, **c: F.concat(*[x for p in re.split(r"(\{\w+\})", text) for x in ([c[p[1:-1]]] if p[:1] == "{" else [F.lit(p)] if p else [])])
    update = is_update(F.col("action"), F.col("templateType"))
    has_code = F.coalesce(F.col("generatedCode") != "", F.lit(False))
    edited = trimmed(F.col("edited_path"))
    content = F.when(has_code, F.col("generatedCode")).when(~update, render_template(F.col("template"), F.col("componentName")))
    failed = F.when(F.col("error").isNotNull(), F.col("error"))
    if not workspace:
        failed = failed.otherwise(F.lit(NO_WORKSPACE))
    failed = failed.when(update & ~has_code, fill(NO_CODE, path=F.coalesce("filePath", F.lit("undefined")))) if workspace else failed
    missing = F.when(~update & content.isNull(), fill(NO_TEMPLATE, kind=F.coalesce("templateType", F.lit("undefined"))))
    rows = actions.join(decisions.select("resp_id", "action_no", "edited_path", "overwrite_ok"), ["resp_id", "action_no"], "left").join(templates, "templateType", "left")
    rows = rows.select(
        "resp_id", "action_no", F.col("error").isNull().alias("parsed"), update.alias("update"), F.when(update, F.col("filePath")).otherwise(edited).alias("path"),
        content.alias("content"), failed.alias("failed"), missing.alias("missing"), F.coalesce("overwrite_ok", F.lit(False)).alias("ok"),
        F.coalesce(F.col("action") == "updateFile", F.lit(False)).alias("updates"), F.coalesce(F.col("templateType") == "router", F.lit(False)).alias("router"),
    )
    there = existing.select(F.col("path").alias("__path"), F.lit(True).alias("exists")).distinct()
    rows = rows.join(there, F.col("path") == F.col("__path"), "left").drop("__path").withColumn("exists", F.coalesce("exists", F.lit(False)))
    names = ("parsed", "action_no", "update", "path", "content", "failed", "missing", "ok", "updates", "router", "exists")
    folded = rows.groupBy("resp_id").agg(F.array_sort(F.collect_list(F.struct(*names))).alias("a"))  # those without metadata come first

    event, write = "array<struct<type: string, message: string, file_path: string>>", "array<struct<path: string, content: string>>"
    start = F.struct(F.array().cast(event).alias("events"), F.array().cast(write).alias("writes"), F.lit(False).alias("stopped"))
    none = F.lit(None).cast("string")

    def step(s: Column, x: Column) -> Column:
        made = x["exists"] | F.exists(s["writes"], lambda w: w["path"] == x["path"])
        cancelled = x["failed"].isNull() & ~x["update"] & (x["path"].isNull() | (made & ~x["ok"]))
        why = F.when(x["failed"].isNotNull(), x["failed"]).when(~cancelled, x["missing"])
        kind = F.when(why.isNotNull(), "fileError").when(cancelled, "fileCancelled").when(x["updates"], "fileUpdated").otherwise("fileCreated")
        written = why.isNull() & ~cancelled
        told = F.struct(kind.alias("type"), why.alias("message"), F.when(written, x["path"]).otherwise(none).alias("file_path"))
        others = F.filter(s["writes"], lambda w: w["path"] != x["path"])
        now = F.when(written, F.concat(others, F.array(F.struct(x["path"].alias("path"), x["content"].alias("content"))))).otherwise(s["writes"])
        after = F.struct(F.concat(s["events"], F.array(told)).alias("events"), now.alias("writes"), (cancelled & ~x["router"]).alias("stopped"))
        return F.when(s["stopped"], s).otherwise(after)

    out = folded.select("resp_id", F.aggregate("a", start, step).alias("s"))
    return out.select("resp_id", "s.events", "s.writes")
