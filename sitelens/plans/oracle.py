"""DuckDB twins of the fixture views and of the native expressions.

These strings are only used by ``oracle_sql()``: the driver runs them in
DuckDB over the same parquet files to check the Spark results.  They follow
FIXTURES.md §3 and mirror ``sitelens.sources.fixtures`` and
``sitelens.functions`` one to one.
"""

from __future__ import annotations

from sitelens.functions import html as H
from sitelens.functions import text as T

WS = T.WS

VIEWS = {
    "site_pages": r"""
SELECT page_id AS seq, url, regexp_extract(url, '^https?://([^/?#:]+)', 1) AS host,
  regexp_replace(regexp_extract(url, '^https?://([^/?#:]+)', 1), '^www[.]', '') AS domain, html
FROM pages""",
    "registry": r"""
SELECT c.c_custkey AS seq,
  CASE WHEN c.c_custkey % 97 = 0 THEN '' ELSE concat(lpad(CAST(c.c_custkey - (CASE WHEN c.c_custkey % 11 = 0 THEN 1 ELSE 0 END) AS VARCHAR), 7, '0'), '-1') END AS business_id,
  c.c_name AS name,
  CASE WHEN c.c_custkey % 3 = 0 THEN NULL WHEN c.c_custkey % 7 = 0 THEN '  ' WHEN c.c_custkey % 5 = 0 THEN regexp_replace(p.url, '^https?://', '') ELSE p.url END AS website,
  CASE WHEN c.c_custkey % 4 = 0 THEN NULL ELSE c.c_mktsegment END AS company_form,
  CASE WHEN c.c_custkey % 13 = 0 THEN 'Deregistered' ELSE 'Registered' END AS status
FROM customer c JOIN pages p ON p.page_id = (c.c_custkey * 7) % (SELECT count(*) FROM pages)""",
    "probe_log": r"""
SELECT page_id AS seq, domain, a.attempt_no, a.ctx, a.method,
  CAST(CASE WHEN a.attempt_no = 1 AND page_id % 6 = 1 THEN 200 WHEN a.attempt_no = 1 AND page_id % 6 = 2 THEN 405
       WHEN a.attempt_no = 1 AND page_id % 6 = 3 THEN 404 WHEN a.attempt_no = 1 AND page_id % 6 = 4 THEN 503
       WHEN a.attempt_no = 2 AND page_id % 6 = 2 THEN 200 WHEN a.attempt_no = 3 AND page_id % 12 = 5 THEN 200 END AS INTEGER) AS http_status,
  CASE WHEN a.attempt_no = 1 AND page_id % 6 = 0 THEN 'dns_error' WHEN a.attempt_no = 1 AND page_id % 6 = 5 THEN 'tls_error'
       WHEN a.attempt_no = 3 AND page_id % 6 = 0 THEN 'dns_error' WHEN a.attempt_no = 3 AND page_id % 12 = 11 THEN 'timeout' END AS error_kind
FROM (SELECT min(page_id) AS page_id, regexp_replace(regexp_extract(url, '^https?://([^/?#:]+)', 1), '^www[.]', '') AS domain FROM pages GROUP BY 2) d
JOIN (SELECT 1 AS attempt_no, 'secure' AS ctx, 'HEAD' AS method UNION ALL SELECT 2, 'secure', 'GET' UNION ALL SELECT 3, 'relaxed', 'HEAD') a
  ON a.attempt_no = 1 OR (a.attempt_no = 2 AND d.page_id % 6 = 2) OR (a.attempt_no = 3 AND d.page_id % 6 IN (0, 5))""",
    "scrape_log": r"""
SELECT doc_id AS seq, concat('d', CAST(doc_id AS VARCHAR), '.example') AS domain,
  CASE WHEN doc_id % 10 = 7 THEN 'False' WHEN doc_id % 10 = 8 THEN 'True ' ELSE 'True' END AS ok,
  CASE WHEN doc_id % 30 = 7 THEN 'Error:Page.goto: net::ERR_NAME_NOT_RESOLVED' WHEN doc_id % 30 = 17 THEN 'nav_timeout' WHEN doc_id % 10 = 7 THEN 'empty_extract' ELSE 'ok' END AS reason,
  CASE WHEN doc_id % 10 = 7 THEN 0 ELSE n_chars END AS chars
FROM documents""",
    "scrape_text": r"""
SELECT concat('d', CAST(doc_id AS VARCHAR), '.example') AS domain, doc_id AS seq, text FROM documents""",
    "translated": r"""
SELECT concat('d', CAST(doc_id AS VARCHAR), '.example') AS domain, doc_id AS seq,
  CASE WHEN doc_id % 6 = 0 THEN 'error' ELSE 'ok' END AS status,
  CASE WHEN doc_id % 8 = 0 THEN '' ELSE concat('[en] ', text) END AS text
FROM documents WHERE doc_id % 2 = 0""",
    "batch_results": r"""
SELECT conv_id % 3 AS batch_id, concat('r', CAST(conv_id AS VARCHAR), '-', CAST(turn AS VARCHAR)) AS custom_id,
  conv_id AS domain_id, turn AS part, n_parts,
  CASE WHEN conv_id % 17 = 3 AND turn = 1 THEN 'errored' ELSE 'succeeded' END AS result_type, text
FROM (SELECT *, CAST(count(*) OVER (PARTITION BY conv_id) AS BIGINT) AS n_parts FROM conversations) x
WHERE NOT (conv_id % 19 = 5 AND turn = 0)""",
    "batch_requests_log": r"""
SELECT conv_id % 3 AS batch_id, concat('r', CAST(conv_id AS VARCHAR), '-', CAST(turn AS VARCHAR)) AS custom_id,
  conv_id AS domain_id, turn AS part, n_parts
FROM (SELECT *, CAST(count(*) OVER (PARTITION BY conv_id) AS BIGINT) AS n_parts FROM conversations) x""",
    "manifest_status_log": r"""
SELECT b.batch_id, e.event_seq, e.status
FROM (SELECT DISTINCT conv_id % 3 AS batch_id FROM conversations) b
JOIN (SELECT 1 AS event_seq, 'submitted' AS status UNION ALL SELECT 2, 'collected') e
  ON e.event_seq = 1 OR b.batch_id <> 2""",
    "verdict_feed": r"""
SELECT l.doc_id,
  CASE WHEN l.doc_id % 23 = 4 THEN 'expired' ELSE 'succeeded' END AS result_type,
  CASE WHEN l.doc_id % 29 = 6 THEN '{"innovative": true,' WHEN l.doc_id % 31 = 8 THEN '{"innovative": false}'
       ELSE concat('{"innovative": ', CASE WHEN l.quality = 1 THEN 'true' ELSE 'false' END, ', "confidence": 0.', CAST(5 + l.doc_id % 5 AS VARCHAR), ', "rationale": " line one\nline two "}') END AS body
FROM labels l""",
    "rater_codes": r"""
SELECT l.doc_id, r.rater, CASE WHEN (l.doc_id * 3 + r.rater * r.rater) % 5 = 0 THEN 1 - l.quality ELSE l.quality END AS code
FROM labels l, (SELECT unnest(range(1, 6)) AS rater) r""",
    "dimension_codes": r"""
SELECT l.doc_id, l.quality AS label, d.dim, CASE WHEN (l.doc_id * 7 + d.dim * 13) % 11 < (CASE WHEN l.quality = 1 THEN 4 ELSE 1 END) THEN 1 ELSE 0 END AS signalled
FROM labels l, (SELECT unnest(range(1, 11)) AS dim) d""",
    "evidence_feed": r"""
SELECT d.doc_id, CASE WHEN d.doc_id % 4 = 0 THEN concat(substring(d.text, 1, 20), ' made up') ELSE substring(d.text, 1, 20) END AS quote,
  concat('O-', CAST(1 + d.doc_id % 10 AS VARCHAR), 'd') AS dimension FROM documents d WHERE d.doc_id % 3 = 0""",
}
VIEWS["done_log"] = "SELECT * FROM scrape_log WHERE seq % 5 = 0"

# views that reference other views
_DEPENDS = {"done_log": ["scrape_log"]}


def with_views(body: str, *names: str, extra: str | None = None) -> str:
    """Prefix ``body`` with the named fixture views as CTEs (dependencies first),
    followed by ``extra`` CTE text (``name AS (...), ...``)."""
    order: list[str] = []

    def add(n):
        for d in _DEPENDS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    parts = [f"{n} AS ({VIEWS[n].strip()})" for n in order]
    if extra:
        parts.append(extra.strip().strip(",").strip())
    if not parts:
        return body.strip()
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + body.strip()


# ---- expression twins --------------------------------------------------------

def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def trim_ws(e: str) -> str:
    return f"regexp_replace({e}, {q('^' + WS + '+|' + WS + '+$')}, '', 'g')"


def is_blank(e: str) -> str:
    return f"coalesce({trim_ws(e)} = '', true)"


def text_true(e: str) -> str:
    return f"coalesce(lower({trim_ws(e)}) = 'true', false)"


def clean_text(e: str) -> str:
    out = f"lower({e})"
    for pat, rep in T.CLEAN_STEPS:
        out = f"regexp_replace({out}, {q(pat)}, {q(rep)}, 'g')"
    return out


def word_count(e: str) -> str:
    t = trim_ws(e)
    return f"CAST(CASE WHEN {t} = '' THEN 0 ELSE len(regexp_split_to_array({t}, {q(WS + '+')})) END AS BIGINT)"


def line_count(e: str) -> str:
    return (f"CAST(length({e}) - length(replace({e}, chr(10), '')) + "
            f"CASE WHEN length({e}) > 0 AND NOT ends_with({e}, chr(10)) THEN 1 ELSE 0 END AS BIGINT)")


def is_junk(e: str) -> str:
    head = f"lower(substring({e}, 1, {T.JUNK_HEAD_CHARS}))"
    return "(" + " OR ".join(f"contains({head}, {q(m)})" for m in T.JUNK_MARKERS) + ")"


def clean_url(e: str) -> str:
    scheme = f"lower(regexp_extract({e}, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1))"
    auth = f"lower(regexp_extract({e}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"
    tail = f"regexp_extract({e}, '(?s)^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(.*)$', 1)"
    auth2 = (f"(CASE WHEN {scheme} = 'http' THEN regexp_replace({auth}, ':80$', '') "
             f"WHEN {scheme} = 'https' THEN regexp_replace({auth}, ':443$', '') ELSE {auth} END)")
    path = f"regexp_extract({tail}, '(?s)^([^?#]*)', 1)"
    query = f"regexp_extract({tail}, '(?s)^[^?#]*\\?([^#]*)', 1)"
    kept = (f"array_to_string(list_filter(string_split({query}, '&'), "
            f"lambda p: p <> '' AND NOT starts_with(p, 'utm_')), '&')")
    rebuilt = (f"concat({scheme}, '://', {auth2}, {path}, "
               f"CASE WHEN {kept} <> '' THEN concat('?', {kept}) ELSE '' END)")
    return f"(CASE WHEN {scheme} <> '' THEN {rebuilt} ELSE {e} END)"


def normalise_homepage(e: str) -> str:
    raw = trim_ws(e)
    with_scheme = (f"(CASE WHEN starts_with({raw}, 'http://') OR starts_with({raw}, 'https://') THEN {raw} "
                   f"ELSE concat('https://', regexp_replace({raw}, '^/+', '')) END)")
    return f"(CASE WHEN coalesce({raw}, '') = '' THEN NULL ELSE {clean_url(with_scheme)} END)"


def site_key(e: str) -> str:
    h = f"lower(regexp_extract({e}, '^https?://([^/?#:]+)', 1))"
    return f"regexp_replace((CASE WHEN {h} = '' THEN lower({e}) ELSE {h} END), '^www[.]', '')"


def url_path(e: str) -> str:
    return f"regexp_extract({e}, '(?s)^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"


def url_depth(e: str) -> str:
    return f"CAST(len(list_filter(string_split({url_path(e)}, '/'), lambda s: s <> '')) AS INTEGER)"


def _in(e: str, names) -> str:
    return f"{e} IN ({', '.join(q(n) for n in names)})"


#: ``page_text(seq, text)``: main text by a walk over the pieces between '<', one row a page and step.
PAGE_TEXT = f"""parts AS MATERIALIZED (SELECT seq, string_split(html, '<') AS p FROM site_pages WHERE html IS NOT NULL),
walk AS (
  SELECT seq, 1 AS i, '' AS raw, '' AS skip, 0 AS depth, []::VARCHAR[] AS inside, []::VARCHAR[] AS around, p[1] AS shown FROM parts
  UNION ALL
  SELECT seq, i + 1,
    CASE WHEN quiet THEN raw WHEN opens_comment THEN '!--' WHEN opens_raw THEN n ELSE '' END,
    CASE WHEN quiet OR plain THEN skip WHEN body THEN '' WHEN starts THEN n WHEN free OR leaves THEN '' ELSE skip END,
    CASE WHEN quiet OR plain THEN depth WHEN body OR leaves THEN 0 WHEN starts THEN 1 WHEN same AND opens THEN depth + 1
         WHEN same AND closes THEN depth - 1 ELSE depth END,
    CASE WHEN quiet OR plain THEN inside WHEN body OR starts OR leaves THEN [] WHEN held AND opens THEN list_prepend(n, inside)
         WHEN held AND closes AND list_contains(inside, n) THEN inside[list_position(inside, n) + 1:] ELSE inside END,
    CASE WHEN quiet OR plain THEN around WHEN body THEN [] WHEN starts THEN around
         WHEN (held AND leaves) OR (free AND holds AND closes AND list_contains(around, n)) THEN around[list_position(around, n) + 1:]
         WHEN free AND holds AND opens THEN list_prepend(n, around) ELSE around END,
    CASE WHEN quiet OR opens_comment OR opens_raw THEN shown WHEN plain THEN CASE WHEN skip = '' THEN shown || after ELSE shown END
         WHEN body THEN after WHEN starts THEN shown || chr(10)
         WHEN free OR leaves THEN shown || CASE WHEN {_in('n', H.BREAKS)} THEN chr(10) ELSE '' END || after ELSE shown END
  FROM (SELECT *, held AND closes AND NOT list_contains(inside, n) AND list_contains(around, n) OR same AND closes AND depth = 1 AS leaves, drops AND free AS starts
    FROM (SELECT *, NOT free AND n = skip AS same, NOT free AND n <> skip AND holds AS held
      FROM (SELECT *, skip = '' OR (skip = 'head' AND opens AND NOT {_in('n', H.HEAD_TAGS)}) AS free, opens AND n = 'body' AS body
        FROM (SELECT *, n <> '' AND NOT closes AS opens, {_in('n', H.CONTAINERS)} AS holds,
            n <> '' AND NOT closes AND ({_in('n', H.DROPPED)} OR ({_in('n', H.AD_TAGS)} AND list_has_any(string_split(
              lower(split_part(split_part(tag, 'class="', 2), '"', 1)), ' '), [{', '.join(q(c) for c in H.AD_CLASSES)}]))) AS drops
          FROM (SELECT *, raw <> '' AND NOT ends_raw AS quiet, raw = '' AND starts_with(x, '!--') AND NOT contains(x, '-->') AS opens_comment,
              raw = '' AND NOT closes AND {_in('n', H.RAW)} AS opens_raw, (raw <> '' AND ends_raw) OR n = '' AS plain
            FROM (SELECT *, split_part(x, '>', 1) AS tag, starts_with(x, '/') AS closes,
                CASE WHEN raw = '!--' THEN contains(x, '-->') ELSE starts_with(lower(x), '/' || raw) END AS ends_raw,
                CASE WHEN contains(x, '-->') AND (raw = '!--' OR starts_with(x, '!--')) THEN substr(x, strpos(x, '-->') + 3)
                     WHEN contains(x, '>') THEN substr(x, strpos(x, '>') + 1) ELSE '' END AS after,
                lower(regexp_extract(x, '^/?([A-Za-z][A-Za-z0-9]*)', 1)) AS n
              FROM (SELECT w.*, e.p[i + 1] AS x FROM walk w JOIN parts e USING (seq) WHERE i < len(e.p))))))))
),
page_text AS (SELECT seq, regexp_replace(regexp_replace(t, ' *\\n[ \\n]*', chr(10), 'g'), '^[ \\n]+|[ \\n]+$', '', 'g') AS text FROM (
  SELECT seq, replace(replace(replace(replace(replace(replace(replace(shown, '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&nbsp;', ' '),
    '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS t FROM walk JOIN parts USING (seq) WHERE i = len(p)))"""


def page_title(e: str) -> str:
    return f"nullif({trim_ws(f'regexp_extract({e}, {q(H.TITLE_RE)}, 1)')}, '')"


def page_language(e: str) -> str:
    return f"nullif(regexp_extract({e}, {q(H.LANG_RE)}, 1), '')"


def resolve_link(h: str, b: str) -> str:
    scheme = f"regexp_extract({b}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)"
    origin = f"regexp_extract({b}, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)"
    base_noquery = f"regexp_extract({b}, '(?s)^([^?#]*)', 1)"
    bp = url_path(b)
    base_dir = (f"(CASE WHEN contains({bp}, '/') THEN concat({origin}, regexp_extract({bp}, '(?s)^(.*/)', 1)) "
                f"ELSE concat({origin}, '/') END)")
    return (f"(CASE WHEN regexp_matches({h}, '(?i)^https?://') THEN {h} "
            f"WHEN starts_with({h}, '//') THEN concat({scheme}, ':', {h}) "
            f"WHEN starts_with({h}, '/') THEN concat({origin}, {h}) "
            f"WHEN {h} = '' OR starts_with({h}, '#') THEN NULL "
            f"WHEN regexp_matches({h}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL "
            f"WHEN starts_with({h}, '?') THEN concat({base_noquery}, {h}) "
            f"ELSE concat({base_dir}, {h}) END)")


def format_duration(e: str) -> str:
    s = f"CAST(greatest(floor(CAST({e} AS DOUBLE)), 0) AS BIGINT)"
    h = f"({s} // 3600)"
    m = f"(({s} % 3600) // 60)"
    sec = f"({s} % 60)"
    return (f"(CASE WHEN {h} > 0 THEN printf('%d:%02d:%02d', {h}, {m}, {sec}) "
            f"ELSE printf('%d:%02d', {m}, {sec}) END)")
