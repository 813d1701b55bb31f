"""DuckDB SQL for the operators that SQL can express on whole tables."""

from __future__ import annotations

from fumble.llm import quality_rules as Q
from fumble.llm.url_filter import LOWER, RULES, UPPER
from fumble.llm.warc import LEAST

SPACES = r"[\x20\x09-\x0D]+"
WORDS = f"list_filter(regexp_split_to_array(%s, '{SPACES}'), lambda x: x <> '')"


def lower(text: str) -> str:
    return f"translate({text}, '{UPPER}', '{LOWER}')"


def url_filter() -> str:
    host = lower(r"coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')")
    path = r"coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"
    query = r"regexp_replace(regexp_replace(coalesce(regexp_extract(url, '(?s)^[^?#]*\?([^#]*)', 1), ''), '(^|&)(utm_[a-z]+|ref)=[^&]*', '', 'g'), '^&', '')"
    bare = r"regexp_replace(regexp_replace(host, '^(www|m)\.', ''), ':(80|443)$', '')"
    rules = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    case = lambda value: "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{value(h, p, v)}'" for h, p, v in rules) + " END"
    return f"""
WITH parts AS (SELECT page_id, html, {host} AS host, {path} AS path, {query} AS query FROM pages),
named AS (SELECT *, concat({bare}, regexp_replace(path, '/+$', ''), CASE WHEN query <> '' THEN concat('?', query) ELSE '' END) AS canonical FROM parts),
listed AS (SELECT DISTINCT canonical FROM named
    WHERE len(regexp_extract_all(coalesce(html, ''), '(#{{3}}|\\*{{3}}|\\${{3}}|%{{3}})')) >= 5 AND canonical <> ''),
judged AS (SELECT page_id, host, path, {case(lambda h, p, v: h + p)} AS rule, {case(lambda h, p, v: v)} AS verdict, canonical IN (SELECT canonical FROM listed) AS listed FROM named)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict, listed FROM judged"""


def exact_dedup() -> str:
    return f"""
WITH norm AS (SELECT doc_id, sha256({lower("coalesce(text, '')")}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM norm WINDOW g AS (PARTITION BY text_sha256)"""


def quality_rules() -> str:
    place = {step: i for i, step in enumerate(Q.sequence())}
    steps = {name: f"CASE {' '.join(f'WHEN floor({sql}) > {cut} THEN {place[name, i]}' for i, cut in enumerate(cuts))} END" for name, (sql, cuts) in Q.RULES.items()}
    tail = lambda n, k: f"""CASE WHEN {k} > {n} * {Q.RISK} THEN 1.0 ELSE list_sum(list_transform(range(({k} + 1)::BIGINT),
    lambda i: exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) + i * ln({Q.RISK}) + ({n} - i) * ln(1 - {Q.RISK})))) END"""  # noqa: E731
    share = f"{Q.ALPHA} / (SELECT count(DISTINCT stratum) FROM held)"
    rejects = ", ".join(f"CASE WHEN {name}_step <= last_step THEN '{name}' END" for name in Q.RULES)
    return f"""
WITH docs AS (SELECT doc_id, coalesce(concat('=', lang), 'null') AS stratum, coalesce(text, '') AS t, {WORDS % "coalesce(text, '')"} AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM documents),
windows AS (SELECT doc_id, i, array_to_string(ws[i:i + {Q.WINDOW - 1}], ' ') AS g FROM docs, unnest(generate_series(1, len(ws) - {Q.WINDOW - 1})) AS s(i)),
repeated AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1),
gaps AS (SELECT doc_id, least({Q.WINDOW}, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, {Q.WINDOW})) AS gap FROM repeated),
covered AS (SELECT doc_id, sum(gap)::BIGINT AS n FROM gaps GROUP BY doc_id),
base AS (SELECT d.doc_id, stratum, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '{SPACES}', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')))::BIGINT AS n_symbols, (length(t) - length(regexp_replace(t, '[!|]+', '', 'g')))::BIGINT AS n_marks,
    len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
    FROM docs d LEFT JOIN covered c USING (doc_id)),
judged AS (SELECT *, n_words < {Q.MIN_WORDS} OR 100 * n_repeat_words > {Q.MAX_REPEAT_PERCENT} * n_words AS base_failed, {', '.join(f'{c} AS {name}_step' for name, c in steps.items())} FROM base),
held AS (SELECT j.stratum, l.good, least({', '.join(f'{name}_step' for name in Q.RULES)}) AS step FROM judged j
    JOIN (SELECT doc_id, min(quality) > 0 AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id) l USING (doc_id) WHERE NOT base_failed),
grouped AS (SELECT stratum AS g, good, step FROM held UNION ALL SELECT NULL, good, step FROM held),
counts AS (SELECT g, step, sum(count_if(good)) OVER (PARTITION BY g) AS n, sum(count_if(good)) OVER w AS k, sum(count_if(NOT good)) OVER w AS bad FROM grouped GROUP BY g, step
    WINDOW w AS (PARTITION BY g ORDER BY step NULLS LAST)),
certified AS (SELECT g, n, CASE WHEN step IS NOT NULL AND n > 0 AND bad > 0 AND {tail('n', 'k')} <= {share} THEN bad END AS gain, step FROM counts),
limits AS (SELECT g, any_value(n) AS n, arg_max(step, (gain, -step)) FILTER (gain IS NOT NULL) AS last_step FROM certified GROUP BY g),
own AS (SELECT * FROM limits WHERE g IS NOT NULL AND n * ln(1 - {Q.RISK}) <= ln({share})),
named AS (SELECT j.*, list_filter([{rejects}], lambda x: x IS NOT NULL) AS failed FROM (SELECT j.*, CASE WHEN o.g IS NOT NULL THEN o.last_step ELSE (SELECT last_step FROM limits WHERE g IS NULL) END AS last_step
    FROM judged j LEFT JOIN own o ON o.g = j.stratum) j)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND len(failed) = 0 AS kept,
    coalesce(array_to_string(failed, ','), '') AS rejected_by FROM named"""


def chat_formatting() -> str:
    bare = r"(2 * length(%s) - length(regexp_replace(%s, '[\\#<%s]', '', 'g')))"
    said = r"\### Assistant: </turn> ok"
    return f"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, 'null') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '{said}'), (-7, 1, 'assistant', '{said}'))),
convs AS (SELECT conv_id, count(*)::BIGINT AS n_turns, string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn NULLS FIRST, role, text) AS read,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum(14 + {bare % ("role", "role", ":")} + {bare % ("text", "text", "")})::BIGINT AS formatted_chars FROM turns GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(read) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars, false AS rewrites FROM convs"""


def jaccard_join() -> str:
    return f"""
WITH RECURSIVE docs AS (SELECT doc_id, {WORDS % lower("coalesce(text, '')")} AS ws FROM documents),
sets AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM docs, unnest(generate_series(1, greatest(len(ws) - 4, 1))) AS s(i) WHERE len(ws) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM sets a JOIN sets b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared s JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * s.n >= 80 * (x.n + y.n - s.n)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN both_ways l ON l.a = r.other)
SELECT doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(other) AS component_id FROM reach LEFT JOIN sizes USING (doc_id) GROUP BY doc_id"""


def warc_archives() -> str:
    return f"""
WITH payloads AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
grouped AS (SELECT *, CASE WHEN payload_bytes >= {LEAST} THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM payloads)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN first_id <> page_id THEN first_id END AS refers_to FROM grouped"""
