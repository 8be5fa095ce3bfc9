"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from stainloom.llm.quality import BOILERPLATE
from stainloom.llm.licenses import GAP, RULES, SENTENCES
from stainloom.llm.urls import TRACKING

SQL = {}

SQL["op2_exact_dedup"] = """WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)"""

_W = "[^\\x20\\x09-\\x0D]+"
SQL["op9_quality_rules"] = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{_W}') AS w, string_split(t, chr(10)) AS l FROM d),
tri AS (SELECT doc_id, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS s FROM (SELECT doc_id, w, unnest(range(1, len(w)-1)) AS i FROM w)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM tri) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM rep, range(3) r(o) GROUP BY 1),
lines AS (SELECT doc_id, unnest(l) AS x, unnest(l[2:] || ['']) AS nx FROM w),
lf AS (SELECT doc_id, x, nx, len(regexp_extract_all(x, '{_W}')) AS n, ' ' || regexp_replace(lower(x), '[^\p{{L}}\p{{N}}]+', ' ', 'g') || ' ' AS y FROM lines),
lr AS (SELECT doc_id, x, n, CASE WHEN n = 0 THEN false
  WHEN len(regexp_extract_all(x, '[|>\x{{00bb}}\x{{2022}}]')) >= 3 AND len(regexp_extract_all(x, '[|>\x{{00bb}}\x{{2022}}]')) * 3 >= n THEN true
  WHEN n <= 40 AND ({" OR ".join(f"contains(y, ' {x} ')" for x in BOILERPLATE)}) THEN true
  WHEN len(list_filter(regexp_extract_all(x, '{_W}'), lambda u: u <> translate(u, '#*$%&|<>', ''))) * 5 > n THEN true
  WHEN n >= 10 AND NOT regexp_matches(rtrim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[.!?\x{{2026}}:;\x{{3002}}\x{{ff01}}\x{{ff1f}}]["''\x{{201d}}\x{{2019}}\x{{bb}}\x{{201c}})\]]*([\x20\x09-\x0D]+[^\x20\x09-\x0D]+){{0,9}}$')
    AND NOT regexp_matches(ltrim(nx, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '^\p{{Ll}}') THEN true ELSE false END AS bad FROM lf),
ls AS (SELECT doc_id, count(*) FILTER (n > 0) - count(DISTINCT x) FILTER (n > 0) AS dup, count(*) FILTER (bad) AS nb,
  CAST(coalesce(sum(n) FILTER (bad), 0) AS BIGINT) AS wb FROM lr GROUP BY 1),
r AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, dup AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words,
  nb AS n_lines_removed, wb AS words_removed FROM w JOIN ls USING (doc_id) LEFT JOIN cov USING (doc_id))
SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 2 * words_removed <= n_words AS kept FROM r"""

# The ends of paragraphs are found line by line, and both ways of cutting mark the ends of sentences
# before the text is cut, as this engine's expressions have no look-ahead.
_ID = {name: i for i, name in enumerate(SENTENCES, 1)}
_RULES = sorted(RULES, key=lambda r: len(r[2]), reverse=True)
_RULE = ["".join(f";{_ID[x]}," + ("" if k == len(r[2]) - 1 else "(?:;\\d+,)??" * GAP) for k, x in enumerate(r[2])) for r in _RULES]
SQL["op3_license_scan"] = rf"""WITH k(s, k) AS (VALUES {", ".join(f"('{s}', {_ID[n]})" for n, of in SENTENCES.items() for s in of)}),
d AS (SELECT doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
p AS (SELECT doc_id, list_transform(range(1, len(l) + 1), lambda i: l[i] || CASE WHEN i = len(l) THEN '' WHEN ends_with(l[i], ':') OR ends_with(l[i], ': ') OR NOT regexp_matches(l[i + 1], '[\p{{L}}\p{{N}}]') THEN chr(1) ELSE ' ' END) AS a, l FROM d),
c AS (SELECT doc_id, unnest([array_to_string(a, ''), array_to_string(l, chr(1))]) AS x FROM p),
e AS (SELECT doc_id, string_split(regexp_replace(x, '([.!?;])\s', '\1' || chr(1), 'g'), chr(1)) AS s FROM c),
u AS (SELECT doc_id, unnest(s) AS s, unnest(list_transform(range(len(s)), lambda i: i + coalesce(list_sum(list_transform(s[1:i], lambda y: length(y))), 0))) AS pos FROM e),
h AS (SELECT DISTINCT doc_id, k, CAST(pos + length(u.s) - length(regexp_replace(u.s, '^[^\p{{L}}\p{{N}}]+', '')) AS INTEGER) AS pos FROM u JOIN k ON k.s = trim(regexp_replace(lower(u.s), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))),
g AS (SELECT doc_id, string_agg(CAST(k AS VARCHAR), ',' ORDER BY pos, k) AS ids, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos, k) AS places FROM h GROUP BY 1),
f AS (SELECT doc_id, coalesce(ids, '') AS sentence_ids, coalesce(places, '') AS sentence_places, regexp_extract_all(CASE WHEN ids IS NULL THEN '' ELSE ';' || replace(ids, ',', ',;') || ',' END, '{"|".join(f"(?:{x})" for x in _RULE)}') AS m FROM documents LEFT JOIN g USING (doc_id)),
w AS (SELECT *, list_transform(m, lambda x: CASE {" ".join(f"WHEN regexp_full_match(x, '{x}') THEN {i}" for i, x in enumerate(_RULE, 1))} END) AS r FROM f),
n AS (SELECT *, list_transform(r, lambda x: [{", ".join(f"'{x[0]}'" for x in _RULES)}][x]) AS n, list_transform(r, lambda x: [{", ".join(f"'{x[1]}'" for x in _RULES)}][x]) AS q FROM w)
SELECT doc_id, sentence_ids, sentence_places, coalesce(array_to_string(list_filter(n, lambda x, i: list_position(n, x) = i), ','), '') AS licenses,
  CASE WHEN list_contains(q, 'restricted') THEN 'restricted' WHEN list_contains(q, 'copyleft') THEN 'copyleft' WHEN list_contains(q, 'permissive') THEN 'permissive' ELSE 'none' END AS kind FROM n"""

SQL["op4_url_filter"] = rf"""WITH u AS (SELECT page_id, url, coalesce(url LIKE '%://%', false) AS ok,
    CASE WHEN url LIKE '%://%' THEN translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN url LIKE '%://%' THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path,
    CASE WHEN url LIKE '%://%' THEN regexp_extract(url, '(?s)^.*?://[^?#]*\?([^#]*)', 1) ELSE '' END AS q FROM pages),
r(what, ru, h, p) AS (VALUES ('block','com/en/','com','/en/'), ('allow','example.com/en/7','example.com','/en/7'), ('allow','net/de/','net','/de/'), ('block','example.net/de/8','example.net','/de/8'), ('block','org/es/','org','/es/')),
m AS (SELECT page_id, url, arg_max(ru, length(ru)) AS rule, arg_max(what, length(ru)) AS v FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY 1, 2),
qq AS (SELECT *, list_sort(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^({TRACKING})(=|$)'))) AS k FROM u),
c AS (SELECT *, CASE WHEN ok THEN regexp_replace(regexp_replace(host, '^(www|m)\.', ''), ':\d+$', '') || regexp_replace(path, '(/|/index\.html?|\.html?)$', '') || CASE WHEN len(k) > 0 THEN '?' || array_to_string(k, '&') ELSE '' END END AS canonical FROM qq),
bad AS (SELECT DISTINCT canonical FROM c WHERE regexp_matches(host, '(^|\.)spam-farm\.'))
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN bad.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, c.canonical, bad.canonical IS NOT NULL AS listed
FROM c LEFT JOIN m USING (page_id, url) LEFT JOIN bad ON c.canonical = bad.canonical"""

_LINES = rf"""l0 AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS line_no FROM documents),
l AS (SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, doc_id * 1000000 + line_no AS place, regexp_extract_all(x, '{_W}') AS w FROM l0),
f AS (SELECT *, array_to_string(w, ' ') AS s, len(w) AS n FROM l WHERE len(w) > 0),
u AS (SELECT s, min(place) AS place, any_value(CASE WHEN n >= 5 THEN w ELSE string_split(s, '') END) AS w, any_value(n >= 5) AS kd FROM f GROUP BY s),
v AS (SELECT place, kd, 0 AS gap, array_to_string(w, chr(1)) AS v FROM u WHERE len(w) >= 5 UNION ALL
  SELECT place, kd, i, array_to_string(list_concat(w[1:i-1], w[i+1:]), chr(1)) FROM (SELECT place, kd, w, unnest(range(1, len(w) + 1)) AS i FROM u WHERE len(w) >= 5)),
e AS (SELECT DISTINCT a.place FROM v a JOIN v b ON a.v = b.v AND a.kd = b.kd AND b.place < a.place AND (a.gap = b.gap AND a.gap > 0 OR a.gap = 0 AND b.gap > 0 OR a.gap > 0 AND b.gap = 0)),
k AS (SELECT f.doc_id, f.line_no, e.place IS NULL AS kept FROM f JOIN u ON f.place = u.place LEFT JOIN e ON e.place = f.place),
g AS (SELECT doc_id, count(*) FILTER (kept) AS n_kept, count(*) FILTER (NOT kept) AS n_edited, string_agg(CAST(line_no AS VARCHAR), ',' ORDER BY line_no) FILTER (kept) AS kept_lines FROM k GROUP BY 1),
c AS (SELECT doc_id, count(*) AS n FROM f GROUP BY 1)"""
SQL["op1_line_dedup"] = f"""WITH {_LINES}
SELECT d.doc_id, coalesce(c.n, 0) AS n_lines, coalesce(n_kept, 0) AS n_kept, coalesce(n_edited, 0) AS n_edited,
  coalesce(c.n, 0) - coalesce(n_kept, 0) - coalesce(n_edited, 0) AS n_repeated, coalesce(kept_lines, '') AS kept_lines
FROM documents d LEFT JOIN c USING (doc_id) LEFT JOIN g USING (doc_id)"""

_B32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(h, {5 * k + 1}, 5) AS INTEGER) >> {s}) & 31) + 1 AS BIGINT), 1)" for k in range(8) for s in (15, 10, 5, 0))
SQL["op6_warc"] = f"""WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
q AS (SELECT page_id, payload_bytes, {_B32} AS payload_digest, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM q"""


def _weights(of: str, weights: dict[str, int]) -> str:
    cases = " ".join(f"WHEN {of} = '{k}' THEN {v}" for k, v in weights.items() if k != "*")
    return f"CASE {cases} ELSE {weights.get('*', 1)} END"


def _share(name: str, source: str, parent: list[str], level: str, weights: dict[str, int]) -> str:
    part = f"PARTITION BY {', '.join(parent)}" if parent else ""
    by = f"({part} ORDER BY CAST(cap AS DOUBLE) / w, {level}"
    return f"""{name}0 AS (SELECT *, {_weights(level, weights)} AS w FROM {source}),
{name}1 AS (SELECT *, coalesce(sum(cap) OVER {by} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef, sum(w) OVER {by} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wr FROM {name}0 WHERE w > 0),
{name}2 AS (SELECT *, CAST(cap AS HUGEINT) * wr <= CAST(w AS HUGEINT) * (budget - bef) AS isfull FROM {name}1),
{name} AS (SELECT *, CAST(CASE WHEN isfull THEN cap ELSE (CAST(w AS HUGEINT) * max(CASE WHEN NOT isfull THEN budget - bef END) OVER ({part})) // max(CASE WHEN NOT isfull THEN wr END) OVER ({part}) END AS BIGINT) AS alloc FROM {name}2)"""


def mixing(share: float, weights: dict[str, dict[str, int]], domains: dict[str, str], seed: int = 7, epochs: int = 2) -> str:
    domain = f"CASE {' '.join(f'''WHEN coalesce(source, 'unknown') = '{k}' THEN '{v}' ''' for k, v in domains.items())} ELSE 'other' END"
    a = _share("a", "a_in", [], "domain", weights["domain"])
    b = _share("b", "b_in", ["domain"], "lang", weights["lang"])
    c = _share("c", "c_in", ["domain", "lang"], "source", weights["source"])
    return f"""WITH d AS (SELECT doc_id, {domain} AS domain, coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source,
  len(regexp_extract_all(coalesce(text, ''), '{_W}')) AS n_tokens FROM documents),
leaf AS (SELECT domain, lang, source, sum(n_tokens) AS lt, sum(n_tokens) * {epochs} AS cap FROM d WHERE n_tokens > 0 GROUP BY ALL),
total AS (SELECT CAST(floor(sum(lt) * CAST({share} AS DOUBLE)) AS BIGINT) AS b, sum(cap) AS c FROM leaf),
a_in AS (SELECT domain, sum(cap) AS cap, any_value(least(b, c)) AS budget FROM leaf, total GROUP BY 1), {a},
b_in AS (SELECT l.domain, l.lang, sum(l.cap) AS cap, any_value(a.alloc) AS budget FROM leaf l JOIN a USING (domain) GROUP BY 1, 2), {b},
c_in AS (SELECT l.domain, l.lang, l.source, l.cap, b.alloc AS budget FROM leaf l JOIN b USING (domain, lang)), {c},
t AS (SELECT d.*, c.alloc, leaf.lt, unnest(range({epochs})) AS epoch FROM d JOIN c USING (domain, lang, source) JOIN leaf USING (domain, lang, source) WHERE n_tokens > 0),
o AS (SELECT *, epoch * lt + coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source, epoch ORDER BY md5('{seed}:' || epoch || ':' || doc_id), doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM t)
SELECT doc_id, domain, lang, source, CAST(epoch AS INTEGER) AS epoch, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(least(n_tokens, alloc - s) AS BIGINT) AS take_tokens FROM o WHERE s < alloc"""
