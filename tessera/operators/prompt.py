"""Prompt, request and conversation assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ChatConfig, RetrievalConfig
from ..functions.text import BLANK, trimmed
from .actions import TAG, strip_actions

#: What in a question names a domain; the first pattern that matches counts.
DOMAIN = "([a-zA-Z][a-zA-Z0-9\\-_]*)"
DOMAIN_PATTERNS = (f"{DOMAIN}{BLANK}*업무", f"(?i){DOMAIN}{BLANK}*domain", f"{DOMAIN}{BLANK}*도메인")
#: Fixed value: said in place of documents when there is no document folder.
NO_DOCUMENTS = "(scaffold 지식 문서를 찾을 수 없습니다.)"


def cap_lines(text: Column, cap: int = RetrievalConfig().max_file_lines) -> Column:
    """The first ``cap`` lines, and how many were left out."""
    lines = F.split(text, "\n", -1)
    more = F.concat(F.array_join(F.slice(lines, 1, cap), "\n"), F.lit("\n\n... ("), (F.size(lines) - cap).cast("string"), F.lit("줄 생략됨)"))
    return F.when(F.size(lines) > cap, more).otherwise(text)


def selection(text: Column) -> Column:
    return F.nullif(trimmed(text), F.lit(""))


def given(queries: DataFrame, query: str = "query") -> DataFrame:
    """``queries`` that say anything at all: blank ones are not sent."""
    return queries.where(F.coalesce(trimmed(F.col(query)) != "", F.lit(False)))


def extract_domain(query: Column) -> Column:
    return F.lower(F.coalesce(*[F.nullif(F.regexp_extract(query, p, 1), F.lit("")) for p in DOMAIN_PATTERNS]))


def resolve_domains(queries: DataFrame, domains: DataFrame, root_router: str | None) -> DataFrame:
    """``queries`` with ``domain``, ``domain_exists``, ``domain_router``, ``root_router``.

    ``domains`` has (domain, router_content); a domain without a router has a null there."""
    named = queries.withColumn("domain", extract_domain(F.col("query")))
    known = domains.select(F.col("domain").alias("__d"), F.col("router_content").alias("domain_router"))
    joined = named.join(known, F.col("domain") == F.col("__d"), "left").withColumn("domain_exists", F.col("__d").isNotNull())
    root = F.when(F.col("domain").isNotNull() & ~F.col("domain_exists"), F.lit(root_router))
    return joined.withColumn("root_router", root.cast("string")).drop("__d")


def _fenced(title: Column, code: Column, advice: str) -> Column:
    return F.concat_ws("\n", title, F.lit("```tsx"), code, F.lit("```"), F.lit(advice))


def domain_section() -> Column:
    """Of the columns of ``resolve_domains``; empty text without a domain. Empty contents count as missing."""
    router, root = F.nullif(F.col("domain_router"), F.lit("")), F.nullif(F.col("root_router"), F.lit(""))
    state = F.when(F.col("domain_exists"), "존재함 (시나리오 A 적용)").otherwise("없음 (시나리오 B 적용)")
    advice = "\n위 파일에 신규 {} 배열 항목을 추가하여 updateFile 블록의 generatedCode를 작성하세요."
    body = (
        F.when(F.col("domain_exists") & router.isNotNull(), _fenced(F.concat(F.lit("\n### 현재 도메인 라우터 파일 (src/domains/"), F.col("domain"), F.lit("/router/index.tsx)")), router, advice.format("페이지 loadable import와 routes")))
        .when(F.col("domain_exists"), F.lit("\n도메인 폴더는 존재하지만 router/index.tsx 파일이 없습니다. createFile로 라우터도 새로 생성하세요 (시나리오 B 적용)."))
        .when(root.isNotNull(), _fenced(F.lit("\n### 현재 루트 라우터 파일 (src/shared/router/index.tsx)"), root, advice.format("도메인 import와 routes")))
        .otherwise(F.lit("\nsrc/shared/router/index.tsx 파일을 찾을 수 없습니다. 루트 라우터 파일 경로를 확인하세요."))
    )
    lines = F.concat_ws(
        "\n", F.lit("\n---\n\n## 페이지 생성 컨텍스트"),
        F.concat(F.lit("- 요청 도메인: **"), F.col("domain"), F.lit("**")),
        F.concat(F.lit("- 도메인 존재 여부: **"), state, F.lit("**")), body, F.lit("\n---\n"),
    )
    return F.when(F.col("domain").isNull(), F.lit("")).otherwise(lines)


def file_section(path: Column, language: Column, content: Column, selected: Column) -> Column:
    """The open file; empty text without one. No selection leaves an empty last line."""
    chosen = F.coalesce(F.concat(F.lit("\n### 선택된 텍스트\n```\n"), F.nullif(selected, F.lit("")), F.lit("\n```")), F.lit(""))
    shown = F.concat_ws("\n", F.concat(F.lit("\n\n---\n\n## 현재 열린 파일: "), path), F.concat(F.lit("```"), F.coalesce(language, F.lit(""))), F.coalesce(content, F.lit("")), F.lit("```"), chosen)
    return F.when(path.isNull(), F.lit("")).otherwise(shown)


def document_section(docs: Column, separator: str = RetrievalConfig().separator) -> Column:
    """Null ``docs``: there is no document folder."""
    return F.when(docs.isNull(), F.lit(NO_DOCUMENTS)).when(F.size(docs) == 0, F.lit("")).otherwise(F.concat(F.lit("## Scaffold 문서 (관련 항목)\n"), F.array_join(docs, separator)))


def assemble_prompts(rows: DataFrame, preamble: str = "") -> DataFrame:
    """``query_id, prompt`` of rows with docs, domain columns and (nullable) file columns."""
    prompt = F.concat(
        F.lit(preamble), domain_section(), document_section(F.col("docs")),
        file_section(F.col("file_path"), F.col("language"), F.col("file_content"), F.col("selected")),
    )
    return rows.select("query_id", prompt.alias("prompt"))


def stored(turns: DataFrame, outcomes: DataFrame, tag: str = TAG) -> DataFrame:
    """Turns (conv_id, turn, role, text) that enter a history: an assistant's only where its answer ended
    well by ``outcomes`` (conv_id, turn, outcome), and without its action blocks; all others as they are."""
    known = outcomes.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), "outcome")
    joined = turns.join(known, (F.col("conv_id") == F.col("c")) & (F.col("turn") == F.col("t")), "left")
    answer = F.coalesce(F.col("role") == "assistant", F.lit(False))
    kept = joined.where(~answer | F.coalesce(F.col("outcome") == "ok", F.lit(False)))
    return kept.select("conv_id", "turn", "role", F.when(answer, strip_actions(F.col("text"), tag)).otherwise(F.col("text")).alias("text"))


def since_clear(turns: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text) after their conversation's last row of role ``clear``."""
    last = turns.where("role = 'clear'").groupBy(F.col("conv_id").alias("c")).agg(F.max("turn").alias("cleared"))
    joined = turns.join(last, F.col("conv_id") == F.col("c"), "left")
    return joined.where((F.col("role") != "clear") & (F.col("cleared").isNull() | (F.col("turn") > F.col("cleared")))).drop("c", "cleared")


def history(turns: DataFrame) -> DataFrame:
    """``conv_id, messages``: the ordered array of (role, text), cleared parts left out."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return since_clear(turns).groupBy("conv_id").agg(F.transform(ordered, lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content"))).alias("messages"))


def build_requests(histories: DataFrame, system: Column, cfg: ChatConfig = ChatConfig()) -> DataFrame:
    """``conv_id, body``: the chat request's JSON, the system prompt before the history."""
    messages = F.concat(F.array(F.struct(F.lit("system").alias("role"), system.alias("content"))), F.col("messages"))
    body = F.struct(
        F.lit(cfg.model).alias("model"), messages.alias("messages"), F.lit(True).alias("stream"),
        F.lit(cfg.temperature).alias("temperature"), F.lit(cfg.max_tokens).alias("max_tokens"),
    )
    return histories.select("conv_id", F.to_json(body).alias("body"))


#: Where chats are completed, how requests name themselves, what is said when no answer comes.
CHAT_PATH = "/v1/chat/completions"
AGENT = "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36"
BAD_STATUS, NO_BODY = "sLLM 서버 오류: ", "응답 스트림을 받을 수 없습니다"


def chat_url(endpoint: Column) -> Column:
    """The chat path at the endpoint's origin, whatever its own path; null where it has no origin.
    The origin is in lower case and without its scheme's own port."""
    origin = F.lower(F.regexp_extract(trimmed(endpoint), r"^((?i)https?://[^/?#\\]+)", 1))
    origin = F.regexp_replace(F.regexp_replace(origin, "^(http://.*):80$", "$1"), "^(https://.*):443$", "$1")
    return F.concat(F.nullif(origin, F.lit("")), F.lit(CHAT_PATH))


def chat_headers(api_key: Column) -> Column:
    """The request's headers in order, (name, value); a bearer only if there is a key."""
    pair = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    bearer = F.when(F.coalesce(api_key != "", F.lit(False)), pair("Authorization", F.concat(F.lit("Bearer "), api_key)))
    fixed = [pair("Content-Type", F.lit("application/json")), pair("Accept", F.lit("text/event-stream")), pair("User-Agent", F.lit(AGENT))]
    return F.array_compact(F.array(*fixed, bearer))


def response_error(status: Column, status_text: Column, body: Column) -> Column:
    """What is wrong with a response, or null: any status but 2xx (an unknown one too), then a missing body."""
    bad = ~F.coalesce(status.between(200, 299), F.lit(False))
    said = F.concat(F.lit(BAD_STATUS), F.coalesce(status.cast("string"), F.lit("")), F.lit(" "), F.coalesce(status_text, F.lit("")))
    return F.when(bad, said).when(body.isNull(), F.lit(NO_BODY))
