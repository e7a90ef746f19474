"""The queries' results as SQL for DuckDB, where SQL can express them."""

from __future__ import annotations

#: Whitespace that op4 ignores, as a character class of DuckDB's regular expressions.
_SPACE = r"[\x20\x09-\x0D]"

OP4 = f"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '{_SPACE}', '', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id
  FROM d
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""

#: Control strings of the chat template, as a regular expression.
_CONTROL = r"(<\|im_start\|>|<\|im_sep\|>|<\|im_end\|>|<\|endoftext\|>|</?s>|\[/?INST\]|<</?SYS>>)"


def _escaped_length(column: str) -> str:
    doubled = f"replace({column}, '\\', '\\\\')"
    return f"length(regexp_replace({doubled}, '{_CONTROL}', '\\1+', 'g'))"


OP1 = f"""
WITH t AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum({len('<|im_start|><|im_sep|><|im_end|>')} + {_escaped_length('role')} + {_escaped_length('text')}) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""

OP10 = r"""
WITH p AS (
  SELECT page_id, lower(url) AS u, timestamp '2024-01-01 00:00:00' + to_hours(CAST(((page_id % 720) + 720) % 720 AS INTEGER)) AS fetched_at FROM pages
), c AS (
  SELECT page_id, fetched_at,
         nullif(regexp_replace(regexp_extract(u, '^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1), '\.+$', ''), '') AS host FROM p
), hosts AS (SELECT DISTINCT host FROM c WHERE host IS NOT NULL),
named AS (
  SELECT 'hosts' AS list, host AS name FROM hosts
  UNION SELECT 'domains', array_to_string(list_slice(string_split(host, '.'), greatest(len(string_split(host, '.')) - 1, 1), len(string_split(host, '.'))), '.') FROM hosts
), made AS (
  SELECT list, name, h, CASE WHEN list = 'hosts' AND h % 5 = 0 THEN 'allow' ELSE 'block' END AS action
  FROM (SELECT list, name, ('0x' || substr(md5(name), 1, 8))::BIGINT AS h FROM named)
  WHERE (list = 'domains' AND h % 2 = 0) OR (list = 'hosts' AND h % 3 = 0)
), spans AS (
  SELECT list, name, action, timestamp '2024-01-01 00:00:00' + to_days(CAST(h % 20 AS INTEGER)) AS valid_from,
         CASE WHEN h % 4 = 1 THEN timestamp '2024-01-01 00:00:00' + to_days(CAST(h % 20 + 5 AS INTEGER)) ELSE timestamp '9999-12-31 00:00:00' END AS valid_to FROM made
  UNION ALL
  SELECT list, name, action, timestamp '2024-01-01 00:00:00' + to_days(CAST(h % 20 + 9 AS INTEGER)), timestamp '9999-12-31 00:00:00' FROM made WHERE h % 8 = 1
), hit AS (
  SELECT c.page_id, s.*, row_number() OVER (PARTITION BY c.page_id ORDER BY length(s.name) DESC, s.action DESC, s.list DESC) AS nth
  FROM c JOIN spans s ON (c.host = s.name OR ends_with(c.host, '.' || s.name)) AND c.fetched_at >= s.valid_from AND c.fetched_at < s.valid_to
)
SELECT c.page_id, c.host, c.fetched_at, hit.action, hit.name AS matched_name, hit.list, hit.valid_from
FROM c LEFT JOIN hit ON hit.page_id = c.page_id AND hit.nth = 1
"""

#: The crc32 of an ASCII string, eight shifts a byte, as a macro-free expression.
_BIT = "CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END"


def _crc32(column: str) -> str:
    step = "xor(c, b)"
    for _ in range(8):
        step = f"list_transform([{step}], lambda r: {_BIT})[1]"
    codes = f"list_transform(string_split({column}, ''), lambda x: CAST(ord(x) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: {step}), 4294967295)"


#: Costs and audits of the four last roles ('cost|audit' strings, so that the least is the best)
#: after each turn; ~ is none.  An inserted or reroled turn leads from none and system to user,
#: from user to assistant and from assistant to user.
def _add(value: str, cost: str, edit: str) -> str:
    return f"CASE WHEN {value} = '~' THEN '~' ELSE lpad(CAST(CAST({value}[1:9] AS BIGINT) + {cost} AS VARCHAR), 9, '0') || '|' || {value}[11:] || '{edit}' END"


def _inserted(values: list[str]) -> list[str]:
    n, s, u, a = values
    return [n, s, f"least({u}, {_add(n, '3', 'I')}, {_add(s, '3', 'I')}, {_add(a, '3', 'I')})", f"least({a}, {_add(u, '3', 'I')})"]


_AFTER = [
    f"{_add('n', '4', 'D')}",
    f"least({_add('s', '4', 'D')}, CASE WHEN ok AND m = 's' THEN {_add('n', 'more', 'K')} ELSE '~' END)",
    f"least({_add('u', '4', 'D')}, CASE WHEN ok AND m = 'u' THEN least({_add('n', 'more', 'K')}, {_add('s', 'more', 'K')}, {_add('a', 'more', 'K')}) ELSE '~' END,"
    f" CASE WHEN ok THEN least({_add('n', 'more + 3', 'R')}, {_add('s', 'more + 3', 'R')}, {_add('a', 'more + 3', 'R')}) ELSE '~' END)",
    f"least({_add('a', '4', 'D')}, CASE WHEN ok AND m = 'a' THEN {_add('u', 'more', 'K')} ELSE '~' END, CASE WHEN ok THEN {_add('u', 'more + 3', 'R')} ELSE '~' END)",
]
_ONE = ", ".join(f"{v} AS {c}" for v, c in zip(_inserted(list("nsua")), "nsua"))

OP11 = f"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS hit FROM conversations
), d AS (
  SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
         CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM k, LATERAL (SELECT unnest(range(CASE hit WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END))) c
), r AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), nth) AS i, nth > 1 AS again,
         NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\\z') AS cut, left(role, 1) AS m
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS nth FROM d)
), f AS (
  SELECT *, NOT blank AND NOT again AS ok, CASE WHEN cut THEN 3 ELSE 0 END AS more,
         CASE WHEN lag(m) OVER w IS NOT NULL AND NOT (lag(m) OVER w || m IN ('su', 'ua', 'au')) THEN 1 ELSE 0 END AS illegal FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY i)
), c AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(again AND NOT blank) AS duplicate,
         count_if(cut AND NOT again AND NOT blank) AS truncated, sum(illegal) AS illegal, max(i) AS rows FROM f GROUP BY 1
), walk(conv_id, i, n, s, u, a) AS (
  SELECT conv_id, 0::BIGINT, '000000000|', '~', '000000003|I', '000000006|II' FROM c
  UNION ALL
  SELECT conv_id, i, {_ONE} FROM (SELECT f.conv_id, f.i, {", ".join(f"{v} AS {c}" for v, c in zip(_AFTER, ("n1", "s1", "u1", "a1")))} FROM walk w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1) t(conv_id, i, n, s, u, a)
), best AS (
  SELECT c.*, CAST(least(n, a)[1:9] AS BIGINT) AS cost, least(n, a)[11:] AS audit FROM c JOIN walk w ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.i = c.rows
), e AS (
  SELECT conv_id, p, audit[p] AS edit, count_if(audit[p] <> 'I') OVER (PARTITION BY conv_id ORDER BY p) AS i FROM best, LATERAL (SELECT unnest(range(1, length(audit) + 1)) AS p) x
), o AS (
  SELECT e.conv_id, e.p, e.edit, f.role, f.text, row_number() OVER (PARTITION BY e.conv_id ORDER BY e.p) AS nth, first_value(e.edit = 'K' AND f.m = 's') OVER (PARTITION BY e.conv_id ORDER BY e.p) AS led
  FROM e LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM e.conv_id AND f.i = e.i AND e.edit <> 'I' WHERE e.edit <> 'D'
), h AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (nth % 2 = 1) <> led THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY p)) AS repaired_sha256 FROM o GROUP BY 1
)
SELECT v.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
       coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) v LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM v.conv_id LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM v.conv_id
"""

_SHARE = "1 + (1000000000 * ({count} + 5)::HUGEINT) // ({total} + 5 * v)"
OP12 = f"""
WITH d AS (
  SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ts FROM documents
), w AS (SELECT i, lang, source, unnest(ts) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS c, count(DISTINCT i) AS docs FROM w GROUP BY 1, 2, 3),
k AS (SELECT lang, term, sum(c) AS c FROM c GROUP BY 1, 2 HAVING sum(docs) >= 30),
v AS (SELECT lang, count(*) AS v, sum(c) AS total FROM k GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT lang, source, sum(c.c) AS n FROM c SEMI JOIN k USING (lang, term) GROUP BY 1, 2),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, {_SHARE.format(count="coalesce(c.c, 0)", total="coalesce(n.n, 0)")} AS p, {_SHARE.format(count="k.c", total="v.total")} AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN n USING (lang, source) LEFT JOIN c USING (lang, source, term)
), s AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3
), r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE c > 0 AND p > q
), z AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM z WHERE part = 'pair' OR rank <= 50
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_formatting": OP1, "op4_exact_dedup": OP4, "op10_url_filter": OP10, "op11_conversation_repair": OP11, "op12_source_divergence": OP12}
