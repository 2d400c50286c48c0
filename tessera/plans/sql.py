"""The registered queries in SQL, written for DuckDB; no pattern here needs look-around."""

from __future__ import annotations

from ..operators.prompt import AGENT, BAD_STATUS, NO_BODY
from ..operators.routing import IMPORT_RULES, PATH_RULES
from . import inputs

BLANK = r"[\t-\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
SEP = "chr(10) || chr(10) || '---' || chr(10) || chr(10)"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^{BLANK}+|{BLANK}+$', '', 'g')"


def first_line(x: str) -> str:
    return trim(f"string_split({x}, chr(10))[1]")


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def listed(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(map(quoted, values)) + "]"


REL = f"CASE WHEN doc_id < {len(inputs.TARGETS)} THEN {listed(inputs.TARGETS)}[doc_id + 1] ELSE 'docs/' || doc_id || '.md' END"
MARKED = r"regexp_replace(text, '(^|\n)([A-M])', '\1## \2', 'g')"
#: Sections: a sentinel is put before each header, as RE2 has no look-ahead.
PARTS = rf"list_filter(string_split(regexp_replace(regexp_replace({MARKED}, '^(#{{1,3}} )', chr(1) || '\1'), '(\n)(#{{1,3}} )', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda p: {trim('p')} <> '')"
ENTRIES = """(VALUES (0, ['tion', 'nthe'], ['patterns/router.md', 'docs/20.md']), (2, ['ment', 'que'], ['docs/22.md', 'missing.md', 'patterns/api-call.md']),
  (3, ['ung'], ['docs/23.md', 'patterns/router.md']), (4, ['qwxz'], ['docs/24.md'])) e(entry_id, keywords, files)"""


def pieces(x: str, size: int = 600, step: int = 500) -> str:
    return f"CASE WHEN length({x}) <= {size} THEN [{x}] ELSE list_transform(range(0, length({x}), {step}), lambda i: substr({x}, i + 1, {size})) END"


def ascii_rule(rule: str) -> str:
    """The rule in RE2, where a word bound is ASCII's; the last rule needs two tests."""
    return rule.replace(r"(?<![A-Za-z0-9_])", r"\b").replace(r"(?![A-Za-z0-9_])", r"\b")


def rule_list(x: str, rules: tuple[tuple[str, str], ...]) -> str:
    def test(rule: str) -> str:
        if "?=" in rule:
            return rf"regexp_matches({x}, 'zustand|create\(') AND regexp_matches({x}, '(?i)store')"
        return f"regexp_matches({x}, {quoted(ascii_rule(rule))})"

    return "list_filter([" + ", ".join(f"CASE WHEN {test(r)} THEN {quoted(t)} END" for r, t in rules) + "], lambda t: t IS NOT NULL)"


def path_list(x: str) -> str:
    return rule_list(f"lower(replace({x}, '\\', '/'))", PATH_RULES)


def import_list(x: str) -> str:
    lines = f"list_filter(string_split({x}, chr(10)), lambda l: regexp_matches(l, '^{BLANK}*import{BLANK}'))"
    return f"flatten(list_transform({lines}, lambda l: {rule_list('l', IMPORT_RULES)}))"


def first_seen(x: str) -> str:
    return f"list_filter({x}, lambda t, i: list_position({x}, t) = i)"


def dot(a: str, b: str) -> str:
    return f"list_reduce(list_transform(list_zip({a}, {b}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE), lambda s, x: s + x, 0.0::DOUBLE)"


def cosine(a: str, b: str) -> str:
    return f"{dot(a, b)} / (sqrt({dot(a, a)}) * sqrt({dot(b, b)}) + 1e-10)"


def topk(of: str) -> str:
    return f"""
WITH q AS (SELECT vec_id AS query_id, embedding AS v FROM embeddings WHERE {of}),
s AS (SELECT query_id, vec_id, {cosine('embedding', 'v')} AS score FROM embeddings, q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, round(score, 9) AS score FROM r WHERE rank <= 5"""


FOUND = f"""
WITH docs AS (SELECT {REL} AS rel, text AS content, '## [' || ({REL}) || ']' || chr(10) || chr(10) || text AS doc FROM documents),
q AS (
  SELECT conv_id * 1000 + turn AS query_id, text AS query, {listed(inputs.FOLDERS)}[conv_id % {len(inputs.FOLDERS)} + 1] || '/f.tsx' AS file_path,
    {listed(inputs.IMPORTS)}[conv_id % {len(inputs.IMPORTS)} + 1] AS file_content, embedding AS v
  FROM conversations LEFT JOIN embeddings ON vec_id = conv_id WHERE role = 'user'
), kw AS (
  SELECT query_id, rel, min((entry_id, pos)) AS best FROM (
    SELECT query_id, entry_id, unnest(files) AS rel, unnest(range(len(files))) AS pos FROM q, {ENTRIES}
    WHERE len(list_filter(keywords, lambda k: contains(lower(query), k))) > 0) GROUP BY ALL
), ctx AS (
  SELECT query_id, unnest(t) AS rel, unnest(range(len(t))) AS pos FROM (SELECT query_id, {first_seen('u')} AS t FROM (SELECT query_id, list_concat({path_list('file_path')}, {import_list('file_content')}) AS u FROM q))
), kwd AS (SELECT query_id, list(doc ORDER BY best) AS d FROM kw JOIN docs USING (rel) GROUP BY ALL
), ctxd AS (SELECT query_id, list(doc ORDER BY pos) AS d FROM ctx JOIN docs USING (rel) GROUP BY ALL
), c AS (
  SELECT q.query_id, coalesce(kwd.d, []) AS kw, coalesce(ctxd.d, []) AS ctx, list_concat(coalesce(kwd.d, []), coalesce(ctxd.d, [])) AS a
  FROM q LEFT JOIN kwd USING (query_id) LEFT JOIN ctxd USING (query_id)
), d AS (SELECT *, list_transform(a, lambda x: {first_line('x')}) AS h FROM c
), e AS (SELECT query_id, kw, ctx, list_filter(a, lambda x, i: list_position(h, h[i]) = i)[1:3] AS combined FROM d
), s AS (
  SELECT e.query_id, ({REL}) AS source, text || CASE WHEN doc_id % 2 = 1 THEN chr(10) || chr(10) || '---' ELSE '' END AS t, {cosine('m.embedding', 'q.v')} AS score
  FROM e JOIN q USING (query_id), embeddings m JOIN documents ON doc_id = m.vec_id WHERE len(combined) < 3 AND v IS NOT NULL
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source) AS rank FROM s
), j AS (SELECT query_id, string_agg('## [' || source || ']' || chr(10) || chr(10) || t, {SEP} ORDER BY rank) AS x FROM r WHERE rank <= 5 GROUP BY ALL
), p AS (SELECT query_id, list_filter(string_split(x, {SEP}), lambda y: {trim('y')} <> '') AS parts FROM j
), f AS (SELECT query_id, kw, ctx, coalesce(parts, []) AS parts, list_concat(combined, coalesce(parts, [])[1:3 - len(combined)]) AS al FROM e LEFT JOIN p USING (query_id)
), g AS (SELECT *, list_transform(al, lambda x: {first_line('x')}) AS h FROM f
), o AS (SELECT *, list_filter(al, lambda x, i: list_position(h, h[i]) = i) AS ds FROM g)"""
HYBRID = f"""{FOUND}
SELECT query_id, CAST(len(ds) AS BIGINT) AS n_docs, array_to_string(ds, {SEP}) AS docs,
  array_to_string(list_filter([CASE WHEN len(kw) > 0 THEN 'keyword' END, CASE WHEN len(ctx) > 0 THEN 'context' END, CASE WHEN len(parts) > 0 THEN 'embedding' END], lambda m: m IS NOT NULL), ',') AS methods
FROM o"""

FORMS = ("Account 업무", "about Order-2 Domain", "pay_ment 도메인에", "x 도메인 y 업무", "nothing", "stock domain", "a subdomain", "the orderDomain")
ASKED = f"SELECT conv_id * 1000 + turn AS query_id, text || ' ' || {listed(FORMS)}[conv_id % {len(FORMS)} + 1] AS query FROM conversations WHERE role = 'user'"
NAME = "([a-zA-Z][a-zA-Z0-9_-]*)"
DOMAIN = f"lower(coalesce(nullif(regexp_extract(query, '{NAME}{BLANK}*업무', 1), ''), nullif(regexp_extract(query, '(?i){NAME}{BLANK}*domain', 1), ''), nullif(regexp_extract(query, '{NAME}{BLANK}*도메인', 1), '')))"
ADVICE = "chr(10) || '위 파일에 신규 {} 배열 항목을 추가하여 updateFile 블록의 generatedCode를 작성하세요.'"
SECTION = f"""
  SELECT query_id, query, CASE WHEN domain IS NULL THEN '' ELSE concat_ws(chr(10), chr(10) || '---' || chr(10) || chr(10) || '## 페이지 생성 컨텍스트',
    '- 요청 도메인: **' || domain || '**',
    '- 도메인 존재 여부: **' || CASE WHEN domain IN ('account', 'order-2', 'y') THEN '존재함 (시나리오 A 적용)' ELSE '없음 (시나리오 B 적용)' END || '**',
    CASE WHEN domain = 'account' THEN concat_ws(chr(10), chr(10) || '### 현재 도메인 라우터 파일 (src/domains/account/router/index.tsx)', '```tsx', 'const r = [];', '```', {ADVICE.format('페이지 loadable import와 routes')})
      WHEN domain IN ('order-2', 'y') THEN chr(10) || '도메인 폴더는 존재하지만 router/index.tsx 파일이 없습니다. createFile로 라우터도 새로 생성하세요 (시나리오 B 적용).'
      ELSE concat_ws(chr(10), chr(10) || '### 현재 루트 라우터 파일 (src/shared/router/index.tsx)', '```tsx', 'const root = [];', '```', {ADVICE.format('도메인 import와 routes')}) END,
    chr(10) || '---' || chr(10)) END AS section FROM (SELECT *, {DOMAIN} AS domain FROM ({ASKED}))"""

#: The recorded responses carry each text in frames; decoded, they give its stretches of 40 characters.
TOKENS = """
SELECT conv_id * 1000 + turn AS resp_id, CAST(i AS INTEGER) AS seq, substr(text, CAST(i * 40 + 1 AS BIGINT), 40) AS token
FROM conversations, unnest(range(CAST(ceil(length(text) / 40.0) AS BIGINT))) u(i)"""

UI = f"""
SELECT CAST(user_id AS VARCHAR) AS session, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq,
  {listed(inputs.KINDS)}[event_id % {len(inputs.KINDS)} + 1] AS type, event_type || ' ' AS content, event_type AS message, 'src/' || event_id AS file_path FROM events"""
REDUCED = f"""
WITH e AS ({UI}), t AS (
  SELECT *, lag(type) OVER w AS before FROM e WHERE type IN ('token', 'done', 'error') WINDOW w AS (PARTITION BY session ORDER BY seq)
), u AS (SELECT *, sum(CASE WHEN type IN ('token', 'error') AND (before IS NULL OR before <> 'token') THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY seq) AS no FROM t),
a AS (
  SELECT session, no, min(seq) AS start_seq, coalesce(string_agg(content, '' ORDER BY seq) FILTER (type = 'token'), '') AS said,
    max('오류: ' || message) FILTER (type = 'error') AS failed, bool_or(type <> 'token') AS closed
  FROM u WHERE NOT (type = 'done' AND (before IS NULL OR before <> 'token')) GROUP BY ALL
), m AS (
  SELECT session, start_seq, 'assistant' AS role, CAST(NULL AS VARCHAR) AS subtype, coalesce(failed, said) AS content, failed IS NOT NULL AS is_error, NOT closed AS streaming FROM a
  UNION ALL SELECT session, seq, 'system', CASE type WHEN 'fileCreated' THEN 'file-created' WHEN 'fileError' THEN 'file-error' ELSE 'file-cancelled' END,
    CASE type WHEN 'fileError' THEN message WHEN 'fileCancelled' THEN '' ELSE file_path END, type = 'fileError', false
  FROM e WHERE type IN ('fileCreated', 'fileError', 'fileCancelled'))
"""

#: Messages and answers event by event: the current message, whether its answer has begun, what ends.
TURNS = f"""
WITH RECURSIVE k AS (
  SELECT user_id, CAST(user_id AS VARCHAR) AS session, event_id, {listed(inputs.TALK)}[event_id % {len(inputs.TALK)} + 1] AS type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq,
    CASE WHEN event_id % 5 = 0 THEN ' ' || chr(10) ELSE event_type || ' ' END AS content FROM events
), e AS MATERIALIZED (
  SELECT session, seq, type, content, CASE WHEN type IN ('token', 'done', 'error') THEN
    CASE WHEN event_id % 7 = 0 THEN max(CASE WHEN type = 'send' THEN seq END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 3 PRECEDING)
    ELSE max(CASE WHEN type = 'send' THEN seq END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END END AS reply_to FROM k
), run AS (
  SELECT DISTINCT session, CAST(-1 AS BIGINT) AS seq, CAST(-1 AS BIGINT) AS cur, false AS begun, CAST(-1 AS BIGINT) AS ended, CAST(NULL AS VARCHAR) AS how FROM e
  UNION ALL
  SELECT run.session, e.seq,
    CASE WHEN sent THEN CASE WHEN refused THEN cur ELSE e.seq END WHEN type = 'stop' OR (mine AND type <> 'token') THEN -1 ELSE cur END,
    CASE WHEN sent THEN refused AND begun WHEN type = 'stop' OR (mine AND type <> 'token') THEN false ELSE begun OR mine END,
    CASE WHEN sent AND refused THEN e.seq ELSE cur END,
    CASE WHEN sent AND refused THEN 'ignored' WHEN cur < 0 THEN NULL WHEN sent THEN 'superseded' WHEN type = 'stop' THEN 'stopped' WHEN mine AND type <> 'token' THEN type END
  FROM run JOIN e ON e.session = run.session AND e.seq = run.seq + 1,
    LATERAL (SELECT type = 'send' AS sent, begun OR trim(replace(content, chr(10), '')) = '' AS refused, cur >= 0 AND coalesce(reply_to = cur, false) AS mine)
), ends AS (
  SELECT session, ended AS seq, how AS outcome, seq AS ended_seq FROM run WHERE how IS NOT NULL
  UNION ALL SELECT session, cur, 'open', NULL FROM run r WHERE cur >= 0 AND seq = (SELECT max(seq) FROM e WHERE e.session = r.session)
), told AS (
  SELECT ends.session, ends.seq, string_agg(content, '' ORDER BY e.seq) AS said FROM ends JOIN e ON e.session = ends.session AND e.reply_to = ends.seq AND type = 'token'
  WHERE ended_seq IS NULL OR e.seq < ended_seq GROUP BY ALL
)
SELECT session, seq, outcome, ended_seq, CASE WHEN outcome <> 'ignored' THEN coalesce(said, '') END AS answer FROM ends LEFT JOIN told USING (session, seq)"""

META = """'{"action":"' || a || '","templateType":"' || t || '"}'"""
CODE = "'const n = ''' || p_name || ''';'"
ACTIONS = f"""
WITH p AS (SELECT p_partkey AS k, p_name FROM part), x AS (
  SELECT k AS resp_id, 0 AS action_no, 'createFile' AS action, 'page' AS templateType, CASE WHEN k % 2 = 0 THEN {CODE} END AS code, CAST(NULL AS VARCHAR) AS error, p_name FROM p
  UNION ALL SELECT k, 1, CASE WHEN k % 5 > 1 THEN 'updateFile' END, CASE WHEN k % 5 > 1 THEN 'router' END, CASE WHEN k % 5 > 1 THEN {CODE} END,
    CASE k % 5 WHEN 0 THEN 'JSON 메타데이터를 찾을 수 없습니다.' WHEN 1 THEN 'JSON 파싱에 실패했습니다.' END, p_name FROM p
)"""
PLANNED = f"""{ACTIONS}, y AS (
  SELECT *, CASE WHEN action = 'updateFile' THEN 'updated' WHEN resp_id % 3 = 0 OR (resp_id % 4 = 0 AND resp_id % 8 <> 0) THEN 'cancelled' ELSE 'created' END AS outcome FROM x WHERE error IS NULL
)"""

#: Chunks stay whole, and of each header the first one counts.
CLEAN = FOUND.replace(f"SELECT query_id, list_filter(string_split(x, {SEP}), lambda y: {trim('y')} <> '') AS parts FROM j", "SELECT query_id, list_filter(x, lambda y, i: list_position(list_transform(x, lambda z: " + first_line("z") + "), " + first_line("y") + ") = i) AS parts FROM j")
CLEAN = CLEAN.replace(f"string_agg('## [' || source || ']' || chr(10) || chr(10) || t, {SEP} ORDER BY rank) AS x", "list('## [' || source || ']' || chr(10) || chr(10) || t ORDER BY rank) AS x")
CLEAN += f" SELECT query_id, array_to_string(list_transform(ds, lambda x: {first_line('x')}), '|') AS headers FROM o"

#: Before there is an index: what keywords and the open file lead to.
UNINDEXED = FOUND.partition("\n), s AS (")[0] + f"""
)
SELECT query_id, CAST(len(combined) AS BIGINT) AS n_docs, array_to_string(combined, {SEP}) AS docs,
  array_to_string(list_filter([CASE WHEN len(kw) > 0 THEN 'keyword' END, CASE WHEN len(ctx) > 0 THEN 'context' END], lambda m: m IS NOT NULL), ',') AS methods
FROM e"""

#: Every twentieth event of a session clears it.
CLEARED = REDUCED.replace(f"WITH e AS ({UI})", f"""WITH f AS (SELECT * REPLACE (CASE WHEN seq % 20 = 7 THEN 'clear' ELSE type END AS type) FROM ({UI})),
e AS (SELECT * FROM f QUALIFY seq > coalesce(max(CASE WHEN type = 'clear' THEN seq END) OVER (PARTITION BY session), -1))""")

#: The documents after the changes of ``snapshot_changes``.
LATER = f"""
SELECT rel, CASE WHEN rel LIKE '%3.md' THEN text || '!' ELSE text END AS text FROM (SELECT {REL} AS rel, text FROM documents) WHERE rel NOT LIKE '%7.md'
UNION ALL SELECT 'new/' || ({REL}), text FROM documents WHERE ({REL}) LIKE '%9.md'"""

CHUNKED = f"""
SELECT source, sec_pos, CAST(unnest(range(len(w))) AS INTEGER) AS piece_pos, {trim('unnest(w)')} AS text FROM (
  SELECT source, sec_pos, {pieces('section')} AS w FROM (
    SELECT {REL} AS source, CAST(unnest(range(len(l))) AS INTEGER) AS sec_pos, unnest(l) AS section
    FROM (SELECT doc_id, CASE WHEN len({PARTS}) > 0 THEN {PARTS} ELSE [{MARKED}] END AS l FROM documents)))"""


def tokens(text: str = "text") -> str:
    return rf"list_filter(regexp_split_to_array(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'), lambda y: y <> '')"


def embedded(of: str, key: str) -> str:
    """Sum of the tokens' digests' bytes, of length one, in single precision; ``words`` has (t, d, x)."""
    return f"""
SELECT {key}, list(CAST(CASE WHEN len2 > 0 THEN s / sqrt(len2) ELSE 0 END AS FLOAT) ORDER BY d) AS v FROM (
  SELECT *, sum(s * s) OVER (PARTITION BY {key}) AS len2 FROM (
    SELECT {key}, d, CAST(sum(2 * x - 255) AS DOUBLE) AS s FROM (SELECT {key}, unnest({tokens()}) AS t FROM {of}) JOIN words USING (t) GROUP BY ALL
    UNION ALL SELECT {key}, d, 0.0 FROM {of}, range(32) r(d) WHERE len({tokens()}) = 0)) GROUP BY ALL"""


RETRIEVED = f"""
WITH chunks AS MATERIALIZED ({CHUNKED}), asked AS (SELECT conv_id * 1000 + turn AS query_id, text FROM conversations WHERE role = 'user'),
words AS MATERIALIZED (SELECT t, d, ('0x' || substr(h, 2 * d + 1, 2))::INTEGER AS x FROM (
  SELECT t, sha256(t) AS h FROM (SELECT DISTINCT unnest({tokens()}) AS t FROM (SELECT text FROM chunks UNION ALL SELECT text FROM asked))), range(32) r(d)),
m AS MATERIALIZED (SELECT *, {dot('v', 'v')} AS vv FROM ({embedded('chunks', 'source, sec_pos, piece_pos')})),
q AS MATERIALIZED (SELECT query_id, v AS qv, {dot('v', 'v')} AS qq FROM ({embedded('asked', 'query_id')})),
s AS (SELECT query_id, source, sec_pos, piece_pos, {dot('qv', 'v')} / (sqrt(vv) * sqrt(qq) + 1e-10) AS score FROM q, m),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source, sec_pos, piece_pos) AS rank FROM s)
SELECT query_id, count(*) AS n_chunks, string_agg('## [' || source || ']' || chr(10) || chr(10) || text, {SEP} ORDER BY rank) AS context
FROM r JOIN chunks USING (source, sec_pos, piece_pos) WHERE rank <= 5 GROUP BY ALL"""

#: Actions 0 to 3 of each answer in turn: 0 makes a page, 1 updates its file if it can be read, 2 makes it again, 3 has no template.
FOLDED = f"""
WITH RECURSIVE p AS (SELECT p_partkey AS k, {CODE} AS code, 'src/' || p_partkey || '.tsx' AS path FROM part), run AS (
  SELECT k, -1 AS no, k % 4 = 0 AS there, false AS stopped, CAST(NULL AS VARCHAR) AS type, CAST(NULL AS VARCHAR) AS message, CAST(NULL AS VARCHAR) AS file_path, CAST(NULL AS VARCHAR) AS content FROM p
  UNION ALL
  SELECT k, no + 1, there OR made, type = 'fileCancelled', type, CASE WHEN type = 'fileError' THEN '템플릿 파일을 찾을 수 없습니다: store.template.txt' END,
    CASE WHEN made THEN path END, CASE WHEN made THEN CASE no + 1 WHEN 0 THEN CASE WHEN k % 2 = 0 THEN code ELSE page('C' || k) END WHEN 1 THEN code ELSE page('D') END END
  FROM (
    SELECT *, type IN ('fileCreated', 'fileUpdated') AS made FROM (
      SELECT run.k, no, there, code, path, CASE no + 1
        WHEN 0 THEN CASE WHEN run.k % 3 = 0 OR (there AND run.k % 8 <> 0) THEN 'fileCancelled' ELSE 'fileCreated' END
        WHEN 1 THEN CASE WHEN run.k % 5 > 1 THEN 'fileUpdated' ELSE 'none' END
        WHEN 2 THEN CASE WHEN there AND run.k % 2 = 1 THEN 'fileCancelled' ELSE 'fileCreated' END
        ELSE 'fileError' END AS type
      FROM run JOIN p USING (k) WHERE NOT stopped AND no < 3))
)"""
for _name in ("'C' || k", "'D'"):
    FOLDED = FOLDED.replace(f"page({_name})", f"'export function ' || {_name} || '() {{ return ''' || lower({_name}) || '''; }}' || chr(10)")

ORACLE_SQL = {
    "message_outcomes": f"SELECT * REPLACE (coalesce(ended_seq, -1) AS ended_seq) FROM ({TURNS})",
    "stream_message_outcomes": f"SELECT * FROM ({TURNS}) WHERE outcome <> 'open'",
    "index_retrieve": RETRIEVED,
    "keyword_gram_route": """
WITH e AS (SELECT doc_id AS entry_id, list_filter([lower(string_split(text, ' ')[1]), lower(right(text, 2))], lambda w: w <> '') AS keywords FROM documents WHERE text IS NOT NULL)
SELECT doc_id AS query_id, count(*) AS n_entries, min(entry_id) AS first_entry, CAST(sum(entry_id) AS BIGINT) AS sum_entries
FROM documents, e WHERE len(list_filter(keywords, lambda w: contains(lower(text), w))) > 0 GROUP BY ALL""",
    "action_fold": f"""{FOLDED}
SELECT k AS resp_id, CAST(row_number() OVER (PARTITION BY k ORDER BY no) - 1 AS INTEGER) AS seq, type, message, file_path FROM (
  SELECT k, no, type, message, file_path FROM run WHERE no >= 0 AND type <> 'none'
  UNION ALL SELECT p_partkey, -1, 'fileError', CASE p_partkey % 5 WHEN 0 THEN 'JSON 메타데이터를 찾을 수 없습니다.' ELSE 'JSON 파싱에 실패했습니다.' END, NULL FROM part WHERE p_partkey % 5 < 2)""",
    "action_writes": f"{FOLDED} SELECT k AS resp_id, file_path AS path, arg_max(content, no) AS content FROM run WHERE file_path IS NOT NULL GROUP BY ALL",
    "context_without_index": UNINDEXED,
    "snapshot_rebuild": f"""
SELECT source, sec_pos, CAST(unnest(range(len(w))) AS INTEGER) AS piece_pos, {trim('unnest(w)')} AS text FROM (
  SELECT source, sec_pos, {pieces('section')} AS w FROM (
    SELECT rel AS source, CAST(unnest(range(len(l))) AS INTEGER) AS sec_pos, unnest(l) AS section
    FROM (SELECT rel, CASE WHEN len({PARTS}) > 0 THEN {PARTS} ELSE [{MARKED}] END AS l FROM ({LATER}))))""",
    "markdown_tree": f"SELECT {listed(inputs.TREE)}[doc_id % {len(inputs.TREE)} + 1] || 'd' || doc_id || '.md' AS rel, text AS content FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 7 <> 0 AND text IS NOT NULL",
    "embed_seam": "SELECT doc_id, length(coalesce(text, '')) AS n_chars, length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) AS n_breaks FROM documents",
    "abort_truncate": f"SELECT * FROM ({TOKENS}) WHERE resp_id // 1000 % 5 <> 1 OR seq < 2",
    "events_after_clear": CLEARED + "SELECT * FROM m",
    "request_call": f"""
SELECT DISTINCT conv_id, ['http://localhost:11434/v1/chat/completions', 'https://h.example/v1/chat/completions', 'http://a/v1/chat/completions'][conv_id % 4 + 1] AS url,
  'Content-Type: application/json' || chr(10) || 'Accept: text/event-stream' || chr(10) || 'User-Agent: {AGENT}'
    || CASE WHEN conv_id % 2 = 0 THEN chr(10) || 'Authorization: Bearer k' || conv_id ELSE '' END AS headers FROM conversations""",
    "response_errors": f"SELECT conv_id * 1000 + turn AS resp_id, CASE conv_id % 4 WHEN 1 THEN {quoted(BAD_STATUS)} || '404 Not Found' WHEN 2 THEN {quoted(BAD_STATUS)} || '500 ' WHEN 3 THEN {quoted(NO_BODY)} END AS error FROM conversations",
    "hybrid_context": HYBRID,
    "chunk_sliding_window": f"SELECT doc_id, CAST(unnest(range(len(l))) AS INTEGER) AS piece_pos, {trim('unnest(l)')} AS piece FROM (SELECT doc_id, {pieces('text')} AS l FROM documents)",
    "split_by_headers": f"SELECT doc_id, CAST(unnest(range(len(l))) AS INTEGER) AS sec_pos, unnest(l) AS section FROM (SELECT doc_id, CASE WHEN len({PARTS}) > 0 THEN {PARTS} ELSE [{MARKED}] END AS l FROM documents)",
    "header_chunks": f"""
SELECT source, sec_pos, CAST(unnest(range(len(w))) AS INTEGER) AS piece_pos, {trim('unnest(w)')} AS text FROM (
  SELECT source, sec_pos, {pieces('section')} AS w FROM (
    SELECT 'd' || doc_id AS source, CAST(unnest(range(len(l))) AS INTEGER) AS sec_pos, unnest(l) AS section
    FROM (SELECT doc_id, CASE WHEN len({PARTS}) > 0 THEN {PARTS} ELSE [{MARKED}] END AS l FROM documents)))""",
    "doc_header": f"SELECT doc_id, {first_line('text')} AS header FROM documents",
    "dedupe_first_by_header": f"SELECT lang, header, min(doc_id) AS doc_id FROM (SELECT doc_id, lang, {first_line('text')} AS header FROM documents) GROUP BY ALL",
    "keyword_index_parse": f"SELECT CAST(entry_id AS INTEGER) AS entry_id, array_to_string(keywords, '|') AS keywords, array_to_string(files, '|') AS files FROM {ENTRIES}",
    "keyword_route": f"""
WITH f AS (SELECT doc_id AS query_id, entry_id, unnest(files) AS rel, unnest(range(len(files))) AS pos FROM documents, {ENTRIES} WHERE len(list_filter(keywords, lambda k: contains(lower(text), k))) > 0),
g AS (SELECT query_id, rel, min((entry_id, pos)) AS best FROM f GROUP BY ALL)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY best) - 1 AS INTEGER) AS ord, rel FROM g""",
    "path_rule_route": f"SELECT page_id, CAST(unnest(range(len(t))) AS INTEGER) AS ord, unnest(t) AS rel FROM (SELECT page_id, {first_seen('u')} AS t FROM (SELECT page_id, {path_list('p')} AS u FROM (SELECT page_id, url || '\\' || {listed(inputs.FOLDERS)}[page_id % {len(inputs.FOLDERS)} + 1] || '\\x' AS p FROM pages)))",
    "import_rule_route": f"SELECT doc_id, len(u) AS n_hits, array_to_string({first_seen('u')}, '|') AS targets FROM (SELECT doc_id, " + import_list(r"regexp_replace(text, '(^|\n)([A-M])', '\1import Table Button; \2', 'g')") + " AS u FROM documents)",
    "context_route": f"""
WITH q AS (SELECT conv_id * 1000 + turn AS query_id, {listed(inputs.FOLDERS)}[conv_id % {len(inputs.FOLDERS)} + 1] || '/f.tsx' AS p, {listed(inputs.IMPORTS)}[conv_id % {len(inputs.IMPORTS)} + 1] AS c FROM conversations WHERE role = 'user'),
u AS (SELECT query_id, list_concat({path_list('p')}, {import_list('c')}) AS u FROM q), t AS (SELECT query_id, {first_seen('u')} AS t FROM u)
SELECT * FROM (SELECT query_id, CAST(unnest(range(len(t))) AS INTEGER) AS ord, unnest(t) AS rel FROM t) WHERE rel IN (SELECT {REL} FROM documents)""",
    "readfiles_lookup": f"SELECT l.doc_id AS query_id, d.rel, '## [' || d.rel || ']' || chr(10) || chr(10) || d.text AS doc FROM labels l JOIN (SELECT {REL} AS rel, text FROM documents) d ON d.rel = 'docs/' || (l.doc_id * 2) || '.md'",
    "cosine_pair": f"SELECT a.vec_id, round({cosine('a.embedding', 'b.embedding')}, 9) AS score FROM embeddings a JOIN embeddings b ON a.vec_id = b.vec_id + 1",
    "cosine_topk": topk("vec_id % 50 = 0"),
    "cosine_topk_batch": topk("vec_id % 10 = 0"),
    "line_cap": "SELECT doc_id, CASE WHEN len(l) > 5 THEN array_to_string(l[1:5], chr(10)) || chr(10) || chr(10) || '... (' || (len(l) - 5) || '줄 생략됨)' ELSE text END AS capped FROM (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents)",
    "domain_extract": f"SELECT query_id, {DOMAIN} AS domain FROM ({ASKED})",
    "domain_section": f"SELECT query_id, section FROM ({SECTION})",
    "prompt_assemble": f"""{FOUND}, x AS ({SECTION})
SELECT query_id, 'PRE' || chr(10) || section || CASE WHEN len(ds) = 0 THEN '' ELSE '## Scaffold 문서 (관련 항목)' || chr(10) || array_to_string(ds, {SEP}) END
  || CASE WHEN query_id % 3 = 0 THEN '' ELSE concat_ws(chr(10), chr(10) || chr(10) || '---' || chr(10) || chr(10) || '## 현재 열린 파일: src/' || query_id, '```tsx', query, '```',
    CASE WHEN query_id % 2 = 0 THEN chr(10) || '### 선택된 텍스트' || chr(10) || '```' || chr(10) || 'sel' || chr(10) || '```' ELSE '' END) END AS prompt
FROM x JOIN o USING (query_id)""",
    "hybrid_clean": CLEAN,
    "blank_input_filter": f"SELECT conv_id, turn, text AS query FROM conversations WHERE turn % 3 <> 0 AND {trim('text')} <> ''",
    "history_on_success": f"SELECT conv_id, string_agg(role || ': ' || CASE WHEN role = 'assistant' THEN {trim('text')} ELSE text END, chr(10) ORDER BY turn) AS history FROM conversations WHERE role <> 'assistant' OR conv_id % 5 > 1 GROUP BY ALL",
    "exchange_messages": f"""
WITH e AS (SELECT conv_id * 1000 + turn AS resp_id, conv_id % 5 = 0 AS bad FROM conversations WHERE role = 'assistant'), m AS (
  SELECT resp_id, 1 AS step, seq, 'token' AS type, token AS text FROM ({TOKENS}) JOIN e USING (resp_id)
  UNION ALL SELECT resp_id, 0, 0, 'status', 'm 응답 중…' FROM e
  UNION ALL SELECT resp_id, 2, 0, CASE WHEN bad THEN 'error' ELSE 'done' END, CASE WHEN bad THEN 'no answer' END FROM e
  UNION ALL SELECT resp_id, 3, 0, 'status', CASE WHEN bad THEN '오류 발생' ELSE 'm' END FROM e)
SELECT resp_id, CAST(row_number() OVER (PARTITION BY resp_id ORDER BY step, seq) - 1 AS INTEGER) AS seq, type, text FROM m""",
    "chat_history": "SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS history FROM conversations GROUP BY ALL",
    "history_after_clear": "SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS history FROM conversations WHERE conv_id % 2 = 1 OR turn > 0 OR conv_id NOT IN (SELECT conv_id FROM conversations WHERE turn = 1) GROUP BY ALL",
    "request_json": """
SELECT conv_id, '{"model":"local-model","messages":[{"role":"system","content":"be \\"brief\\"\\n"},' || string_agg('{"role":' || to_json(role) || ',"content":' || to_json(text) || '}', ',' ORDER BY turn)
  || '],"stream":true,"temperature":0.2,"max_tokens":4096}' AS body FROM conversations GROUP BY ALL""",
    "sse_decode": TOKENS,
    "token_fold": "SELECT conv_id * 1000 + turn AS resp_id, text AS response FROM conversations WHERE text <> ''",
    "event_reduce": REDUCED + "SELECT * FROM m",
    "event_status": f"SELECT session, arg_max(message, seq) AS status FROM ({UI}) WHERE type = 'status' GROUP BY ALL",
    "action_extract": f"{ACTIONS} SELECT resp_id, action_no, action, templateType, CASE WHEN error IS NULL THEN 'd' END AS domain, CASE WHEN error IS NULL THEN 'C' || resp_id END AS componentName, CASE WHEN error IS NULL THEN 'src/' || resp_id || '.tsx' END AS filePath, code AS generatedCode, error FROM x",
    "action_strip": f"SELECT p_partkey AS resp_id, {trim('x')} AS stripped FROM (SELECT p_partkey, ' Here: ' || p_name || chr(10) || chr(10) || 'and' || chr(10) || CASE WHEN p_partkey % 7 = 0 THEN chr(10) || '<file-action>open' ELSE chr(10) END AS x FROM part)",
    "action_route": f"{ACTIONS} SELECT resp_id, action_no, action = 'updateFile' AS auto_write, CASE templateType WHEN 'page' THEN '페이지 컴포넌트' ELSE '라우터' END AS label FROM x WHERE error IS NULL",
    "action_plan": f"{PLANNED} SELECT resp_id, action_no, templateType, CASE WHEN outcome <> 'cancelled' THEN 'src/' || resp_id || '.tsx' END AS path, CASE WHEN outcome <> 'cancelled' THEN coalesce(code, 'export function C' || resp_id || '() {{ return ''c' || resp_id || '''; }}' || chr(10)) END AS content, outcome FROM y",
    "action_outcomes": f"{PLANNED} SELECT resp_id, action_no, outcome FROM y a WHERE action_no = 0 OR NOT EXISTS (SELECT 1 FROM y b WHERE b.resp_id = a.resp_id AND b.action_no = 0 AND b.outcome = 'cancelled')",
    "template_apply": """
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'export function ' || n || '() { return ''' || lower(n[1]) || n[2:] || '''; }' || chr(10) END AS content, CASE WHEN p_partkey % 2 = 1 THEN 'no template' END AS error
FROM (SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS n FROM part)""",
    "stream_sse_decode": TOKENS.replace("CAST(i AS INTEGER)", "i"),
    "stream_event_reduce": REDUCED + "SELECT session, start_seq, role, subtype, content, is_error FROM m WHERE NOT streaming",
    "snapshot_changes": f"""
WITH d AS (SELECT {REL} AS rel FROM documents)
SELECT rel, 'deleted' AS change FROM d WHERE rel LIKE '%7.md' UNION ALL SELECT rel, 'changed' FROM d WHERE rel LIKE '%3.md' UNION ALL SELECT 'new/' || rel, 'created' FROM d WHERE rel LIKE '%9.md'""",
}
