"""SQL of the registered queries for an independent engine (DuckDB dialect)."""

from __future__ import annotations

import re

from pathloom.operators.gate import DENIED, ESCAPES
from pathloom.plans.queries import SCRIPTS, payload_samples

#: Events by the rules of ``sources/derived.py``.
EV = r"""
ev AS (
  SELECT event_id::VARCHAR AS event_id, event_id AS seq, user_id::VARCHAR AS session_id, ts,
    strftime(ts, '%Y%m%d') || '-' || (event_id % 2)::VARCHAR AS tab_id, k,
    CASE event_type WHEN 'view' THEN 'scroll' WHEN 'signup' THEN 'navigation' WHEN 'purchase' THEN 'fill' WHEN 'error' THEN 'api_error' ELSE event_type END AS kind,
    '/' || event_type || '/' || k::VARCHAR AS url, '/' || event_type || '/:id' AS norm, trunc(value * 20)::INT AS width,
    CASE event_type WHEN 'click' THEN 'getByRole("button", { name: "Go ' || (k % 3)::VARCHAR || '" })' WHEN 'purchase' THEN 'getByTestId("f' || (k % 2)::VARCHAR || '")' END AS loc,
    CASE event_type WHEN 'click' THEN 'BUTTON|role:button|name:Go ' || (k % 3)::VARCHAR WHEN 'purchase' THEN 'INPUT|testid:f' || (k % 2)::VARCHAR ELSE '' END AS fp
  FROM (SELECT *, json_extract_string(props, '$.k')::INT AS k FROM events) e0),
nd AS (
  SELECT *, CASE WHEN kind IN ('scroll', 'api_error') THEN NULL WHEN kind = 'navigation' THEN 'nav:' || norm ELSE norm || '||' || kind || '||' || loc END AS node FROM ev)
"""


def split(source: str = "nd", gap: str = "12 hours", name: str = "sp") -> str:
    """Tab and idle split of ``source``."""
    return f"""
{name}_t AS (SELECT session_id, tab_id, min(ts) AS a, max(ts) AS b FROM {source} GROUP BY ALL),
{name}_c AS (SELECT DISTINCT x.session_id, x.tab_id FROM {name}_t x JOIN {name}_t y ON x.session_id = y.session_id AND x.tab_id <> y.tab_id AND x.a < y.b AND y.a < x.b),
{name}_g AS (SELECT e.*, c.tab_id IS NOT NULL AS is_concurrent, c.tab_id AS group_tab FROM {source} e LEFT JOIN {name}_c c ON e.session_id = c.session_id AND e.tab_id = c.tab_id),
{name}_l AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY session_id, is_concurrent, group_tab ORDER BY ts, seq) > INTERVAL '{gap}' THEN 1 ELSE 0 END AS brk FROM {name}_g),
{name} AS (SELECT *, sum(brk) OVER (PARTITION BY session_id, is_concurrent, group_tab ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)::BIGINT AS sub_idx FROM {name}_l)"""


def subs(source: str = "sp", name: str = "su") -> str:
    """Sub-sessions with pattern, fingerprint, page set and counts; ``o`` orders them."""
    key = "session_id, is_concurrent, group_tab, sub_idx"
    return f"""
{name}_n AS (SELECT *, lag(norm) OVER (PARTITION BY {key} ORDER BY ts, seq) AS before FROM {source} WHERE node IS NOT NULL),
{name}_p AS (SELECT {key}, string_agg(norm, ' → ' ORDER BY ts, seq) FILTER (WHERE norm IS DISTINCT FROM before) AS plain, count(*) AS n_nodes,
    count(*) FILTER (WHERE kind <> 'navigation') AS n_actions, list(node ORDER BY ts, seq) AS nodes,
    array_to_string(list_sort(list(DISTINCT norm)), ' + ') AS page_set FROM {name}_n GROUP BY ALL HAVING count(*) >= 3),
{name}_f AS (SELECT {key}, coalesce(md5(to_json(list({{'t': kind, 'e': fp}} ORDER BY ts, seq) FILTER (WHERE kind IN ('click', 'fill')))::VARCHAR), '') AS fingerprint,
    count(*) FILTER (WHERE width < 768) > count(width) / 2 AS mobile, list({{'t': kind, 'u': url, 'e': fp}} ORDER BY ts, seq) AS evs FROM {source} GROUP BY ALL),
{name} AS (SELECT p.*, f.fingerprint, f.evs, CASE WHEN mobile THEN '[mobile] ' ELSE '' END || plain AS pattern,
    row_number() OVER (ORDER BY p.session_id, p.is_concurrent, p.group_tab NULLS FIRST, p.sub_idx) AS o
  FROM {name}_p p JOIN {name}_f f ON p.session_id = f.session_id AND p.is_concurrent = f.is_concurrent AND p.group_tab IS NOT DISTINCT FROM f.group_tab AND p.sub_idx = f.sub_idx)"""


#: Visits as sessions of their own: more than 24 hours without an event begin another one.
VISITS = """
quiet AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY session_id ORDER BY ts, seq) > INTERVAL '24 hours' THEN 1 ELSE 0 END AS new FROM ev),
visit AS (SELECT * EXCLUDE (session_id, new), session_id || '#' || (sum(new) OVER (PARTITION BY session_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING))::VARCHAR AS session_id FROM quiet)"""

SUB = f"WITH {EV},{split()},{subs()}"

NODES = """
big AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY session_id, is_concurrent, group_tab, sub_idx) AS c FROM sp) x WHERE c >= 2 AND node IS NOT NULL),
ordered AS (SELECT *, row_number() OVER (ORDER BY session_id, is_concurrent, group_tab NULLS FIRST, sub_idx, ts, seq) AS o,
    lag(node) OVER (PARTITION BY session_id, is_concurrent, group_tab, sub_idx ORDER BY ts, seq) AS src FROM big),
nodes AS (SELECT node, count(*)::BIGINT AS "count", arg_min(url, o) AS url, arg_min(kind, o) AS event_type, min(o) AS first FROM ordered GROUP BY node),
edges AS (SELECT src, node AS dst, count(*)::BIGINT AS weight FROM ordered WHERE src IS NOT NULL AND src <> node GROUP BY ALL)"""
GRAPH = f"WITH {EV},{split()},{NODES}"
ENDS = """
src0 AS (SELECT node, first FROM nodes WHERE node NOT IN (SELECT dst FROM edges)),
tops AS (SELECT node, "count", first FROM nodes WHERE node LIKE 'nav:%' ORDER BY "count" DESC, first LIMIT 5),
starts AS (SELECT node, row_number() OVER (ORDER BY first) AS entry_ord FROM src0
  UNION ALL SELECT node, row_number() OVER (ORDER BY "count" DESC, first) FROM tops WHERE NOT EXISTS (SELECT 1 FROM src0)
  UNION ALL (SELECT node, 1 FROM nodes WHERE NOT EXISTS (SELECT 1 FROM src0) AND NOT EXISTS (SELECT 1 FROM tops) ORDER BY first LIMIT 1)),
snk AS (SELECT node FROM nodes WHERE node NOT IN (SELECT src FROM edges)),
stops AS (SELECT node FROM snk UNION ALL (SELECT node FROM nodes WHERE NOT EXISTS (SELECT 1 FROM snk) ORDER BY first DESC LIMIT 1))"""
PATHS = f"""WITH RECURSIVE {EV},{split()},{NODES},{ENDS},
ranked AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst DESC) AS r FROM edges),
walk AS (
  SELECT node AS last, [node] AS path, [entry_ord] AS ranks, 0::BIGINT AS weight, NULL::BIGINT AS low FROM starts
  UNION ALL
  SELECT e.dst, list_append(w.path, e.dst), list_append(w.ranks, e.r), w.weight + e.weight, least(w.low, e.weight)
  FROM walk w JOIN ranked e ON w.last = e.src WHERE NOT list_contains(w.path, e.dst) AND len(w.path) < 12),
paths AS (SELECT row_number() OVER (ORDER BY ranks) AS path_ord, path, weight, low AS min_weight
  FROM walk WHERE last IN (SELECT node FROM stops) AND len(path) >= 3 QUALIFY path_ord <= 500)"""

FLOW_SET = f"""{SUB},
fs0 AS (SELECT *, regexp_replace(split_part(pattern, ' → ', 1), '^\\[mobile\\] ', '') AS page FROM su),
fs AS (SELECT page, fingerprint, count(*) % 7 AS score, arg_min(evs, o) AS evs, row_number() OVER (ORDER BY min(o)) AS flow_ord FROM fs0 GROUP BY page, fingerprint),
ev1 AS (SELECT flow_ord, unnest(evs) AS e, generate_subscripts(evs, 1) AS i FROM fs),
ev2 AS (SELECT flow_ord, i, e.t AS t, e.u AS u, e.e AS el, lead(CASE WHEN e.t NOT IN ('scroll', 'api_error') THEN e.t END IGNORE NULLS) OVER (PARTITION BY flow_ord ORDER BY i) AS nxt FROM ev1),
act AS (SELECT * FROM ev2 WHERE t = 'fill' OR (t = 'click' AND nxt IS DISTINCT FROM 'navigation')),
facts AS (SELECT flow_ord, md5(to_json(list({{'t': t, 'e': el}} ORDER BY i))::VARCHAR) AS afp, arg_min(u, i) AS page_url, count(DISTINCT u) <= 1 AS single FROM act GROUP BY flow_ord),
ff AS (SELECT fs.flow_ord, page AS pattern, score, coalesce(afp, md5('nav-only:' || page)) AS afp, afp IS NOT NULL AS has, page_url, coalesce(single, true) AS single,
    coalesce(evs[1].u <> page_url, false) AS prefix FROM fs LEFT JOIN facts ON fs.flow_ord = facts.flow_ord),
rk AS (SELECT *, row_number() OVER (PARTITION BY afp ORDER BY score DESC, flow_ord) AS fr, count(*) OVER (PARTITION BY afp) AS fn, min(flow_ord) OVER (PARTITION BY afp) AS fo FROM ff)"""


def ranked_out(body: str, order: str) -> str:
    return f"{FLOW_SET}, o AS ({body}) SELECT row_number() OVER (ORDER BY {order}) AS out_ord, flow_ord, pattern AS canonical_pattern, test_mode, page AS interaction_page_url, behaviors FROM o"


SMART = """
SELECT flow_ord, pattern, CASE WHEN pn > 1 THEN 'smart_grouped' ELSE 'full' END AS test_mode, NULL::VARCHAR AS page, CASE WHEN pn > 1 THEN members END AS behaviors, 0 AS part, po AS o1, 0 AS o2
FROM (SELECT *, row_number() OVER w AS pr, count(*) OVER (PARTITION BY pattern) AS pn, min(fo) OVER (PARTITION BY pattern) AS po FROM rk WHERE fr = 1 WINDOW w AS (PARTITION BY pattern ORDER BY score DESC, fo)) k
JOIN (SELECT pattern AS p2, string_agg(flow_ord::VARCHAR, ',' ORDER BY score DESC, fo) AS members FROM rk WHERE fr = 1 GROUP BY pattern) m ON p2 = pattern WHERE pr = 1
UNION ALL SELECT flow_ord, pattern, 'nav_only', NULL, NULL, 1, fo, fr FROM rk WHERE fr > 1"""
MODULAR = """
SELECT flow_ord, pattern, CASE WHEN pn = 1 THEN CASE WHEN io THEN 'interaction_only' ELSE 'full' END WHEN single THEN 'interaction_only' ELSE 'full' END AS test_mode,
  CASE WHEN (pn > 1 AND single) OR io THEN page_url END AS page, NULL::VARCHAR AS behaviors, 0 AS part, po AS o1, pr AS o2
FROM (SELECT *, has AND single AS io, row_number() OVER (PARTITION BY pattern ORDER BY score DESC, fo) AS pr, count(*) OVER (PARTITION BY pattern) AS pn, min(fo) OVER (PARTITION BY pattern) AS po FROM rk WHERE fr = 1) k
UNION ALL
SELECT flow_ord, pattern, 'nav_only', NULL, NULL, 1, fo, fr FROM (
  SELECT r.*, row_number() OVER (PARTITION BY r.pattern ORDER BY r.fo, r.fr) AS u
  FROM rk r JOIN (SELECT afp AS a2, has AND fn > 1 AS many, single AS s1 FROM rk WHERE fr = 1) h ON a2 = r.afp
  WHERE (many AND s1) OR (many AND r.fr > 1) OR (r.fn = 1 AND r.has AND r.single AND r.prefix)) x WHERE u = 1"""

TOTAL = "(SELECT count(DISTINCT user_id) FROM events)"
FLOWS = f"""{SUB},
pat AS (SELECT pattern, count(*) AS n, min(o) AS po FROM su GROUP BY pattern),
sx AS (SELECT su.*, pat.po, pat.n / {TOTAL} * 100 >= 0.5 AS high FROM su JOIN pat USING (pattern)),
pop AS (SELECT pattern, fingerprint, count(*) AS c, min(po) AS so, min(o) AS o2, first(nodes ORDER BY n_actions DESC, n_nodes DESC, o) AS nodes FROM sx WHERE high GROUP BY pattern, fingerprint HAVING count(*) / {TOTAL} * 100 >= 0.5),
lo AS (SELECT *, row_number() OVER (ORDER BY po, o) AS ro FROM sx WHERE NOT high),
sets AS (SELECT page_set, min(ro) AS so FROM lo GROUP BY page_set HAVING count(*) >= 2),
gr AS (SELECT page_set, fingerprint, count(*) AS c, min(ro) AS o2, first(nodes ORDER BY n_actions DESC, n_nodes DESC, ro) AS nodes, first(pattern ORDER BY n_actions DESC, n_nodes DESC, ro) AS pattern
       FROM lo WHERE fingerprint <> '' GROUP BY page_set, fingerprint HAVING count(*) >= 2),
resc AS (SELECT gr.*, so FROM gr JOIN sets USING (page_set) WHERE fingerprint NOT IN (SELECT fingerprint FROM pop) AND EXISTS (SELECT 1 FROM pop)
         QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY so) = 1),
fl AS (SELECT pattern, fingerprint, c, so, o2, nodes, false AS rescued FROM pop UNION ALL SELECT pattern, fingerprint, c, so, o2, nodes, true FROM resc),
fo AS (SELECT *, round_even(c / {TOTAL} * 100, 2) AS score FROM fl)"""

SEGMENT = r"""CASE WHEN s = '' THEN s WHEN regexp_full_match(lower(s), '[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}') THEN ':uuid'
 WHEN regexp_full_match(lower(s), '[0-9a-f]{24}') THEN ':objectId' WHEN regexp_full_match(s, '[0-9]+') THEN ':id'
 WHEN regexp_full_match(s, '[a-z0-9]+(-[a-z0-9]+)+') AND length(s) >= 5 THEN ':slug' ELSE s END"""
PATH = r"regexp_extract(url, '^https?://[^/?#]*([^?#;]*)', 1)"
PG = rf"""pg AS (SELECT page_id, url, html, {PATH} AS path, regexp_extract(url, '^https?://([^/]*)', 1) AS host,
  regexp_extract(url, '^(https?://[^/?#]*)', 1) AS origin FROM pages),
pn AS (SELECT *, array_to_string(list_transform(string_split(path, '/'), lambda s: {SEGMENT}), '/') AS npath FROM pg)"""
NAME = "CASE WHEN {t} = '' THEN 'home' ELSE string_split(replace(replace(replace({t}, ':uuid', 'item'), ':id', 'item'), ':slug', 'page'), '/')[-1] END"


def page_name(path: str) -> str:
    return NAME.format(t=f"trim({path}, '/')")


LINKS = rf"""WITH {PG}, lk0 AS (SELECT page_id, url, origin, path, host, regexp_extract_all(html, '<a[^>]*href="([^"]*)"', 1) AS h FROM pg),
lk AS (SELECT page_id, url, origin, path, host, unnest(h) AS href, generate_subscripts(h, 1) - 1 AS n FROM lk0)"""
SEQ = f"""WITH {PG}, sq AS (SELECT *, origin || npath AS norm, lag(origin || npath) OVER (PARTITION BY origin ORDER BY page_id) AS before FROM pn),
seqs AS (SELECT origin AS host, string_agg(norm, ' → ' ORDER BY page_id) AS pattern, list(CASE WHEN {page_name('norm')} IS NULL THEN '' ELSE {page_name('norm')} END ORDER BY page_id) AS names FROM sq WHERE norm IS DISTINCT FROM before GROUP BY origin)"""
DIFF = """, last AS (SELECT page_id, href, max(n) AS n FROM lk GROUP BY ALL),
cp AS (SELECT page_id, host, lag(page_id) OVER (PARTITION BY host ORDER BY page_id) AS before FROM (SELECT DISTINCT page_id, host FROM lk) x),
df AS (SELECT cp.page_id, lk.n, CASE WHEN b.href IS NULL THEN 'await expect(page.getByTestId("' || lk.href || '")).toBeVisible()'
       WHEN b.n <> lk.n THEN 'await expect(page.getByTestId("' || lk.href || '")).toContainText("link ' || lk.n::VARCHAR || '")' END AS a
       FROM cp JOIN lk ON cp.page_id = lk.page_id LEFT JOIN last b ON b.page_id = cp.before AND b.href = lk.href WHERE cp.before IS NOT NULL),
d3 AS (SELECT page_id, string_agg(a, ' | ' ORDER BY n) AS a FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY n) AS r FROM df WHERE a IS NOT NULL) x WHERE r <= 3 GROUP BY page_id)"""

#: Elements by number with what differs from page to page, and the page before of the same host.
CHANGES = """, cp AS (SELECT page_id, host, lag(page_id) OVER (PARTITION BY host ORDER BY page_id) AS before FROM (SELECT DISTINCT page_id, host FROM lk) x),
ce AS (SELECT page_id, n, CASE WHEN n % 5 = 4 THEN 'text ' || (page_id % 4)::VARCHAR ELSE 'same' END AS text, CASE WHEN n % 5 = 0 THEN (page_id % 7)::VARCHAR WHEN n % 5 < 3 THEN CASE WHEN page_id % 2 = 0 THEN 'true' ELSE 'false' END WHEN n % 5 = 3 THEN (page_id % 9 * 10)::VARCHAR END AS v,
  'await expect(page.' || CASE WHEN n % 2 = 0 THEN 'getByRole("link", { name: "go ' || n::VARCHAR || '" })' ELSE 'getByTestId("e' || n::VARCHAR || '")' END || ')' AS spot FROM lk)"""


def camel(c: str) -> str:
    words = f"list_filter(string_split(regexp_replace({c}, '[^a-zA-Z0-9]', ' ', 'g'), ' '), lambda x: x <> '')"
    return f"CASE WHEN len({words}) = 0 THEN 'unnamed' ELSE lower({words}[1]) || coalesce(array_to_string(list_transform({words}[2:], lambda x: upper(x[1]) || lower(x[2:])), ''), '') END"


def short(c: str) -> str:
    s = f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"
    return f"CASE WHEN length({s}) > 50 THEN substr({s}, 1, 50) || '...' ELSE {s} END"


PART = f"""WITH t AS (SELECT *, p_partkey % 8 AS k, '"' || replace({short('p_name')}, '"', '\\"') || '"' AS q, '"' || p_brand || '"' AS b, '"' || p_type || '"' AS ty FROM part),
l AS (SELECT *, CASE k WHEN 0 THEN 'getByRole("button", {{ name: ' || q || ' }})' WHEN 1 THEN CASE WHEN p_size > 25 THEN 'getByRole("navigation")' ELSE 'locator("div")' END
  WHEN 2 THEN 'getByTestId(' || b || ')' WHEN 3 THEN 'getByLabel(' || q || ')' WHEN 4 THEN 'getByPlaceholder(' || q || ')' WHEN 5 THEN CASE WHEN length(p_name) <= 50 THEN 'getByText(' || q || ')' ELSE 'locator("a")' END
  WHEN 6 THEN 'locator(' || ty || ')' END AS locator FROM t)"""
LITERAL = r"""to_json(substr(html, 1, 250))::VARCHAR"""


def plain_regex(p: str) -> str:
    """A pattern for an engine whose word boundaries know ASCII only, quoted for SQL."""
    p = re.sub(r"\\b(?=\w)", lambda _: r"(?:^|[^\p{L}\p{N}_])", p)
    return re.sub(r"(?<=\w)\\b", lambda _: r"(?:$|[^\p{L}\p{N}_])", p).replace("'", "''")


KEY = "session_id, is_concurrent, group_tab, sub_idx"


def runs(which: str) -> str:
    """Steps of the events that ``which`` selects: three and more clicks in a row on one locator are one step."""
    return f"""WITH {EV},{split()},
acted AS (SELECT *, count(*) FILTER (WHERE kind IN ('click', 'fill')) OVER (PARTITION BY {KEY} ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM sp),
picked AS (SELECT * FROM acted WHERE {which}),
cut AS (SELECT *, CASE WHEN kind = 'click' AND lag(kind) OVER w = 'click' AND lag(loc) OVER w = loc THEN 0 ELSE 1 END AS new FROM picked WINDOW w AS (PARTITION BY {KEY} ORDER BY ts, seq)),
run AS (SELECT *, sum(new) OVER (PARTITION BY {KEY} ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS run FROM cut),
sized AS (SELECT *, count(*) OVER (PARTITION BY {KEY}, run) AS n, row_number() OVER (PARTITION BY {KEY}, run ORDER BY ts, seq) AS r FROM run),
steps AS (SELECT {KEY}, row_number() OVER (PARTITION BY {KEY} ORDER BY ts, seq) AS step_no, kind AS type, loc AS locator, CASE WHEN kind = 'navigation' THEN url END AS url,
    CASE WHEN kind = 'fill' THEN '"' || k::VARCHAR || '"' END AS value, CASE WHEN n >= 3 THEN n ELSE 1 END AS repeat_count,
    CASE kind WHEN 'fill' THEN 'await expect(page.' || loc || ').toHaveValue("' || k::VARCHAR || '")' WHEN 'navigation' THEN 'await expect(page).toHaveURL(/' || replace(url, '/', '\\/') || '/)' END AS assertion
  FROM sized WHERE n < 3 OR r = 1)"""


STEPS = runs("kind IN ('click', 'fill') OR (kind = 'navigation' AND before > 0)")
#: Navigation up to the first interaction: clicks that a navigation follows, with a wait only where a navigation stands that no such click has taken.
ROUTES = f"""WITH {EV},{split()},
look AS (SELECT *, lead(CASE WHEN kind NOT IN ('scroll', 'api_error') THEN kind END IGNORE NULLS) OVER w AS nk, lead(CASE WHEN kind NOT IN ('scroll', 'api_error') THEN url END IGNORE NULLS) OVER w AS nu,
    lag(CASE WHEN kind NOT IN ('scroll', 'api_error') THEN kind END IGNORE NULLS) OVER w AS pk FROM sp WINDOW w AS (PARTITION BY {KEY} ORDER BY ts, seq)),
stop AS (SELECT {KEY}, min(ts) AS st, arg_min(seq, (ts, seq)) AS ss FROM look WHERE kind = 'fill' OR (kind = 'click' AND nk IS DISTINCT FROM 'navigation') GROUP BY ALL),
open AS (SELECT l.* FROM look l LEFT JOIN stop s ON l.session_id = s.session_id AND l.is_concurrent = s.is_concurrent AND l.group_tab IS NOT DISTINCT FROM s.group_tab AND l.sub_idx = s.sub_idx
    WHERE s.st IS NULL OR (l.ts, l.seq) < (s.st, s.ss)),
route AS (SELECT {KEY}, ts, seq, 0 AS part, kind AS type, loc AS locator, NULL AS url, 'await expect(page).toHaveURL(/' || replace(nu, '/', '\\/') || '/)' AS assertion FROM open WHERE kind = 'click'
  UNION ALL SELECT {KEY}, ts, seq, 1, kind, NULL, url, 'await expect(page).toHaveURL(/' || replace(url, '/', '\\/') || '/)' FROM (SELECT *, count(*) FILTER (WHERE kind = 'click') OVER (PARTITION BY {KEY} ORDER BY ts, seq) AS clicks FROM open) x WHERE kind = 'navigation' AND pk IS DISTINCT FROM 'click' AND clicks > 0)"""
SCRIPT_TEXT = f""",
entry AS (SELECT {KEY}, coalesce(first(url ORDER BY ts, seq) FILTER (WHERE kind = 'navigation'), first(url ORDER BY ts, seq)) AS entry FROM sp GROUP BY ALL),
said AS (SELECT *, CASE type WHEN 'click' THEN 'Click ' || locator || CASE WHEN repeat_count > 1 THEN ' (' || repeat_count::VARCHAR || ' times)' ELSE '' END WHEN 'fill' THEN 'Fill ' || locator ELSE 'Wait for navigation to ' || url END AS description,
    CASE type WHEN 'click' THEN 'await page.' || locator || '.click();' WHEN 'fill' THEN 'await page.' || locator || '.fill(' || value || ');' ELSE 'await page.waitForURL("' || url || '");' END AS call FROM steps),
body AS (SELECT {KEY}, string_agg(chr(10) || '    // Step ' || step_no::VARCHAR || ': ' || description || chr(10)
    || CASE WHEN repeat_count > 1 THEN '    for (let i = 0; i < ' || repeat_count::VARCHAR || '; i++) {{' || chr(10) || '      ' || call || chr(10) || '    }}' ELSE '    ' || call END || chr(10)
    || CASE WHEN assertion IS NULL THEN '' ELSE '    ' || assertion || ';' || chr(10) END, '' ORDER BY step_no) AS body FROM said GROUP BY ALL)
SELECT e.session_id, e.is_concurrent, e.group_tab, e.sub_idx, md5('import {{ test, expect }} from ''@playwright/test'';' || chr(10) || chr(10) || '/**' || chr(10) || ' * Flow: item to done' || chr(10) || ' * Pattern: /session/:id → /done' || chr(10)
    || ' * Popularity: 5% of sessions' || chr(10) || ' *' || chr(10) || ' * Generated by pathloom' || chr(10) || ' */' || chr(10) || 'test.describe("item to done", () => {{' || chr(10) || '  test("should complete item to done", async ({{ page }}) => {{' || chr(10)
    || '    // Navigate to entry point' || chr(10) || '    await page.goto("' || entry || '");' || chr(10) || coalesce(body, '') || '  }});' || chr(10) || '}});' || chr(10)) AS content
FROM entry e LEFT JOIN body b ON e.session_id = b.session_id AND e.is_concurrent = b.is_concurrent AND e.group_tab IS NOT DISTINCT FROM b.group_tab AND e.sub_idx = b.sub_idx"""


def at(which) -> str:
    """The places of the event types that ``which`` holds for, as a list in SQL."""
    return ", ".join(str(i) for i, x in enumerate(payload_samples()) if which(x)) or "-1"


def oracle_sql() -> dict[str, str]:
    idle = lambda gap: f"WITH {EV}, l AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL '{gap}' THEN 1 ELSE 0 END AS b FROM ev WINDOW w AS (PARTITION BY session_id ORDER BY ts, seq)), s AS (SELECT *, sum(b) OVER (PARTITION BY session_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)::BIGINT AS sub_idx FROM l) SELECT session_id, sub_idx, count(*) AS n_events, min(seq) AS first_event FROM s GROUP BY ALL"
    key = "session_id, is_concurrent, group_tab, sub_idx"
    half = lambda n, lo, hi: f"nd{n} AS (SELECT * FROM nd WHERE day(ts) > {lo} AND day(ts) <= {hi}),{split(f'nd{n}', name=f'sp{n}')},{subs(f'sp{n}', f'su{n}')}, h{n} AS (SELECT pattern, arg_min(nodes, o) AS nodes, count(*) AS c, row_number() OVER (ORDER BY min(o)) AS ord FROM su{n} GROUP BY pattern)"
    return {
        "idle_sessions_30m": idle("30 minutes"),
        "idle_sessions_12h": idle("12 hours"),
        "concurrent_tabs": f"WITH {EV}, t AS (SELECT session_id, tab_id, min(ts) AS a, max(ts) AS b FROM ev GROUP BY ALL) SELECT x.session_id, x.tab_id, count(y.a) AS n_overlaps FROM t x LEFT JOIN t y ON x.session_id = y.session_id AND x.tab_id <> y.tab_id AND x.a < y.b AND y.a < x.b GROUP BY ALL",
        "full_session_split": f"WITH {EV},{split()} SELECT event_id, is_concurrent, group_tab, sub_idx FROM sp",
        "exclusion_segments": f"WITH {EV}, x AS (SELECT *, url LIKE '/error/%' AS x FROM ev), s AS (SELECT *, sum(x::INT) OVER (PARTITION BY session_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)::BIGINT AS segment FROM x) SELECT session_id, segment, count(*) AS n_events, min(seq) AS first_event FROM s WHERE NOT x GROUP BY ALL HAVING count(*) >= 3",
        "url_normalise": rf"WITH {PG} SELECT page_id, origin || npath AS norm, path, regexp_replace(url, '([.*+?^${{}}()|\[\]\\/])', '\\\1', 'g') AS escaped, {page_name('path')} AS name FROM pn",
        "url_pattern_topk": f"WITH {PG} SELECT origin || npath AS norm, count(*) AS n FROM pn GROUP BY ALL ORDER BY n DESC, norm LIMIT 10",
        "url_sequences": f"{SEQ} SELECT host, pattern FROM seqs",
        "url_origin_mode": f"WITH {PG}, f AS (SELECT page_id % 50 AS flow, arg_min(origin, page_id) AS o FROM pg GROUP BY flow) SELECT o AS base_url FROM f GROUP BY o ORDER BY count(*) DESC, min(flow) LIMIT 1",
        "link_destination": f"""{LINKS}, dirs AS (SELECT *, CASE WHEN path = '' THEN '/' ELSE regexp_replace(path, '[^/]*$', '') END AS dir, substr(href, 2) AS rest, CASE WHEN href NOT LIKE '/%' THEN 0 ELSE n % 4 END AS kind FROM lk),
            r AS (SELECT *, CASE kind WHEN 0 THEN CASE WHEN href = '' OR href LIKE '#%' OR href LIKE 'javascript:%' THEN NULL WHEN href LIKE '/%' THEN origin || href ELSE href END
                WHEN 1 THEN origin || dir || rest WHEN 2 THEN origin || regexp_replace(dir, '[^/]+/$', '') || rest ELSE origin || dir || rest || '?a=1#b' END AS dest FROM dirs)
            SELECT page_id, n, coalesce(regexp_extract(dest, '^https?://[^/?#]*([^?#;]*)', 1) <> path, false) AS is_nav, dest FROM r""",
        "glob_exclude_filter": rf"WITH {PG}, q AS (SELECT *, CASE WHEN path = '' THEN '/' ELSE path END AS p FROM pg) SELECT page_id, (regexp_full_match(p, '.*/[0-9].*') OR regexp_full_match(p, '/blog/.*') OR regexp_full_match(p, 'https://.*\.example/p.ge.*') OR regexp_full_match(url, 'https://.*\.example/p.ge.*')) AS excluded FROM q",
        "event_nodes": f"WITH {EV} SELECT event_id, node FROM nd",
        "flow_nodes": f'{GRAPH} SELECT node, "count", url, event_type FROM nodes',
        "flow_edges": f"{GRAPH} SELECT src, dst, weight FROM edges",
        "merged_nodes": f'{GRAPH} SELECT node, "count", url, event_type FROM nodes',
        "merged_edges": f"{GRAPH} SELECT src, dst, weight FROM edges",
        "streamed_splits": f"WITH {EV},{VISITS},{split('visit', '12 hours')} SELECT event_id, is_concurrent, group_tab, sub_idx, strftime(min(ts) OVER v, '%Y-%m-%d %H:%M:%S') AS visit_start FROM sp WINDOW v AS (PARTITION BY session_id) QUALIFY max(ts) OVER v + INTERVAL '24 hours 10 minutes' < (SELECT max(ts) FROM ev)",
        "flow_sources_sinks": f"{GRAPH},{ENDS} SELECT 'entry' AS kind, node, entry_ord FROM starts UNION ALL SELECT 'exit', node, 0 FROM stops",
        "flow_paths": f"{PATHS} SELECT path_ord, array_to_string(path, ' > ') AS path, weight, min_weight FROM paths",
        "path_popularity": f"""{PATHS}, u AS (SELECT path_ord, path, weight, min_weight, list_transform(path, lambda x: CASE WHEN x LIKE 'nav:%' THEN x[5:] ELSE split_part(x, '||', 1) END) AS urls FROM paths),
            g AS (SELECT path_ord, path, weight, min_weight, array_to_string(list_transform(list_filter(list_zip(urls, list_prepend(NULL, urls)), lambda z: z[1] IS NOT NULL AND z[1] IS DISTINCT FROM z[2]), lambda z: z[1]), ' → ') AS pattern FROM u),
            f AS (SELECT pattern, max(min_weight) AS c, arg_min(path, weight * -100000 + path_ord) AS path, min(path_ord) AS po FROM g GROUP BY pattern)
            SELECT row_number() OVER (ORDER BY round_even(c / {TOTAL} * 100, 2) DESC, po) AS ord, pattern AS canonical_pattern, c AS session_count, round_even(c / {TOTAL} * 100, 2) AS popularity_score, array_to_string(path, ' > ') AS path, len(path) AS n_actions FROM f WHERE c / {TOTAL} * 100 >= 5""",
        "viewport_class": f"WITH {EV},{split()} SELECT {key}, CASE WHEN count(*) FILTER (WHERE width < 768) > count(width) / 2 THEN 'mobile' ELSE 'desktop' END AS viewport FROM sp GROUP BY ALL",
        "canonical_patterns": f"{SUB} SELECT pattern, count(*) AS n FROM su GROUP BY pattern",
        "session_fingerprints": f"{SUB} SELECT {key}, fingerprint, page_set, n_actions, n_nodes FROM su",
        "popular_flows": f"{FLOWS} SELECT row_number() OVER (ORDER BY score DESC, rescued, so, o2) AS ord, pattern AS canonical_pattern, fingerprint, c AS session_count, score AS popularity_score, array_to_string(nodes, ' > ') AS path, rescued FROM fo",
        "flows_and_rescued": f"{FLOWS.replace('>= 0.5', '>= 5.0')} SELECT row_number() OVER (ORDER BY score DESC, rescued, so, o2) AS ord, pattern AS canonical_pattern, fingerprint, c AS session_count, score AS popularity_score, array_to_string(nodes, ' > ') AS path, rescued FROM fo",
        "rescued_flows": f"{FLOWS} SELECT pattern AS canonical_pattern, fingerprint, c AS session_count, score AS popularity_score FROM fo WHERE rescued",
        "flow_facts": f"{FLOW_SET} SELECT flow_ord, pattern AS canonical_pattern, score::DOUBLE AS popularity_score, afp AS action_fingerprint, has AS has_interactions, page_url, single AS single_page, prefix AS nav_prefix FROM ff",
        "dedup_full": ranked_out("SELECT flow_ord, pattern, 'full' AS test_mode, NULL::VARCHAR AS page, NULL::VARCHAR AS behaviors FROM rk", "flow_ord"),
        "dedup_lean": ranked_out("SELECT flow_ord, pattern, 'full' AS test_mode, NULL::VARCHAR AS page, NULL::VARCHAR AS behaviors, fo FROM rk WHERE fr = 1", "fo"),
        "dedup_smart": ranked_out(SMART, "part, o1, o2"),
        "dedup_modular": ranked_out(MODULAR, "part, o1, o2"),
        "compare_flows": f"WITH {EV},{half(1, 15, 31)},{half(2, 0, 15)} SELECT coalesce(h1.pattern, h2.pattern) AS canonical_pattern, CASE WHEN h2.pattern IS NULL THEN 'new' WHEN h1.pattern IS NULL THEN 'inactive' WHEN h1.nodes = h2.nodes THEN 'unchanged' ELSE 'changed' END AS status, h1.ord AS new_ord, h2.ord AS existing_ord FROM h1 FULL JOIN h2 ON h1.pattern = h2.pattern WHERE h1.pattern IS NOT NULL OR h2.c > 1",
        "flow_library": f"WITH {EV},{half(1, 0, 10)},{half(2, 10, 20)},{half(3, 20, 31)}, h AS (SELECT 1 AS run, * FROM h1 UNION ALL SELECT 2, * FROM h2 UNION ALL SELECT 3, * FROM h3), g AS (SELECT *, lag(nodes) OVER (PARTITION BY pattern ORDER BY run) IS DISTINCT FROM nodes AS differs FROM h), z AS (SELECT pattern, arg_max(ord, run) AS ord, min(run) AS first_run, max(run) FILTER (differs) AS changed_run, max(run) AS seen_run FROM g GROUP BY pattern) SELECT pattern AS canonical_pattern, ord, CASE seen_run WHEN 3 THEN 'active' ELSE 'inactive' END AS status, CASE WHEN first_run = 3 THEN 'new' WHEN changed_run = 3 THEN 'changed' WHEN seen_run = 3 THEN 'unchanged' WHEN seen_run = 2 THEN 'inactive' ELSE 'kept' END AS result, first_run, changed_run, seen_run FROM z",
        "next_significant_event": f"WITH {EV},{split()} SELECT event_id, lead(CASE WHEN kind NOT IN ('scroll', 'api_error') THEN url END IGNORE NULLS) OVER w AS next_url, coalesce(lead(CASE WHEN kind NOT IN ('scroll', 'api_error') THEN kind END IGNORE NULLS) OVER w = 'navigation', false) AS to_navigation FROM sp WINDOW w AS (PARTITION BY {key} ORDER BY ts, seq)",
        "flow_steps": f"{STEPS} SELECT {key}, step_no, type, locator, url, value, repeat_count, coalesce(assertion, '') AS assertions FROM steps",
        "route_steps": f"{ROUTES} SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY ts, seq, part) AS step_no, type, locator, url, assertion AS assertions FROM route",
        "interaction_steps": f"{runs("kind IN ('click', 'fill')")} SELECT {key}, step_no, type, locator, repeat_count, coalesce(assertion, '') AS assertions FROM steps",
        "collapse_pairs": f"WITH {EV}, a AS (SELECT session_id, ts, seq, k, CASE kind WHEN 'fill' THEN 'check' ELSE kind END AS type, kind = 'click' AND coalesce(lead(kind) OVER w = 'fill' AND lead(k) OVER w % 3 = k % 3, false) AS gone FROM ev WHERE kind IN ('click', 'fill') WINDOW w AS (PARTITION BY session_id ORDER BY ts, seq)) SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY ts, seq) AS step_no, type, 'getByRole(\"button\", {{ name: \"Go ' || (k % 3)::VARCHAR || '\" }})' AS locator FROM a WHERE NOT gone",
        "render_scripts": f"{STEPS}{SCRIPT_TEXT}",
        "script_files": f"SELECT session_id || '/' || CASE WHEN is_concurrent THEN 'c' ELSE 's' END || coalesce(group_tab, '') || '-' || sub_idx::VARCHAR || '.spec.ts' AS file_name, length(content) AS n_chars, md5(content) AS content FROM ({STEPS}{SCRIPT_TEXT.replace('md5(', '(', 1)}) x",
        "structural_gate": "SELECT p_partkey, CASE p_partkey % " + str(len(SCRIPTS)) + " " + " ".join(f"WHEN {i} THEN {x[2]}" for i, x in enumerate(SCRIPTS)) + " END AS acceptable, CASE p_partkey % " + str(len(SCRIPTS)) + " " + " ".join(f"WHEN {i} THEN {x[1]}" for i, x in enumerate(SCRIPTS)) + " END AS ok FROM part",
        "checkpoint_prev_diff": f"{LINKS}{DIFF} SELECT cp.page_id::VARCHAR AS checkpoint_id, before::VARCHAR AS before_id, coalesce(a, '') AS assertions FROM cp LEFT JOIN d3 ON cp.page_id = d3.page_id",
        "context_changes": f"""{LINKS}{CHANGES}, ch AS (SELECT a.page_id, a.n, CASE WHEN b.page_id IS NULL THEN a.spot || '.toBeVisible()' WHEN a.text <> b.text THEN a.spot || '.toContainText("' || a.text || '")'
            WHEN a.v <> b.v THEN CASE a.n % 5 WHEN 0 THEN a.spot || '.toHaveAttribute("aria-valuenow", "' || a.v || '")' WHEN 1 THEN a.spot || '.toHaveAttribute("aria-expanded", "' || a.v || '")' WHEN 2 THEN a.spot || CASE a.v WHEN 'true' THEN '.toBeHidden()' ELSE '.toBeVisible()' END ELSE a.spot || '.toHaveCSS("width", /' || a.v || '%/)' END END AS a
            FROM (SELECT ce.*, cp.before FROM ce JOIN cp USING (page_id)) a LEFT JOIN ce b ON b.page_id = a.before AND b.n = a.n),
            c3 AS (SELECT page_id, string_agg(a, ' | ' ORDER BY n) AS a FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY n) AS r FROM ch WHERE a IS NOT NULL) x WHERE r <= 3 GROUP BY page_id)
            SELECT cp.page_id::VARCHAR AS checkpoint_id, coalesce(a, '') AS assertions FROM cp LEFT JOIN c3 USING (page_id)""",
        "page_assertions": rf"""{LINKS}{CHANGES}, el AS (SELECT page_id, string_agg('await expect(page.' || CASE WHEN n % 2 = 0 THEN 'getByRole("link", {{ name: "go ' || n::VARCHAR || '" }})' ELSE 'getByText("' || text || '")' END || ').toBeVisible()', ' | ' ORDER BY n) AS a FROM ce WHERE n < 3 GROUP BY page_id)
            SELECT page_id::VARCHAR AS checkpoint_id, concat_ws(' | ', CASE WHEN page_id % 2 = 0 THEN 'await expect(page).toHaveURL(/' || regexp_replace(url, '([.*+?^${{}}()|\[\]\\/])', '\\\1', 'g') || '/)' END, a, CASE WHEN page_id % 3 > 0 THEN 'await expect(page).toHaveTitle(/Page \(no\. ' || page_id::VARCHAR || '\)/)' END) AS assertions
            FROM (SELECT DISTINCT page_id, url FROM lk) u JOIN el USING (page_id)""",
        "click_assertions": f"{LINKS}{DIFF}, nb AS (SELECT page_id, string_agg('await expect(page.getByTestId(\"' || href || '\")).toBeVisible()', ' | ' ORDER BY n) AS a FROM lk WHERE n < 3 GROUP BY page_id) SELECT cp.page_id::VARCHAR AS event_id, CASE WHEN before IS NULL THEN nb.a ELSE coalesce(d3.a, '') END AS assertions FROM cp LEFT JOIN d3 ON cp.page_id = d3.page_id LEFT JOIN nb ON cp.page_id = nb.page_id",
        "global_elements": f"{LINKS}, f AS (SELECT host, min(page_id) AS page_id FROM lk GROUP BY host), s AS (SELECT DISTINCT f.host, n FROM f JOIN lk ON f.page_id = lk.page_id) SELECT 'text:link ' || n::VARCHAR AS signature FROM s GROUP BY n HAVING count(*) = (SELECT count(*) FROM f) AND count(*) >= 2",
        "checkpoint_kth_assignment": f"{LINKS}, p AS (SELECT page_id, host, row_number() OVER (PARTITION BY host ORDER BY page_id) AS k, count(*) OVER (PARTITION BY host) AS n FROM (SELECT DISTINCT page_id, host FROM lk) z), c AS (SELECT page_id % 3 AS flow_id, page_id AS call_ord, host AS url, row_number() OVER (PARTITION BY page_id % 3, host ORDER BY page_id) AS call_no FROM pg) SELECT flow_id, call_ord, url, call_no, p.page_id::VARCHAR AS checkpoint_id FROM c LEFT JOIN p ON c.url = p.host AND p.k = least(c.call_no, p.n)",
        "element_locator": f"{PART}, v AS (SELECT *, CASE WHEN k = 0 THEN regexp_extract(locator, 'name: \"([^\"]*)\"', 1) WHEN locator SIMILAR TO 'getBy(Role|TestId|Label|Placeholder).*' THEN regexp_extract(locator, '\"([^\"]*)\"', 1) END AS w FROM l) SELECT p_partkey, locator, CASE WHEN w IS NOT NULL THEN {camel('w')} END AS variable FROM v",
        "element_fingerprint": f"{PART} SELECT p_partkey, CASE k WHEN 0 THEN 'DIV|role:button|name:' || p_name WHEN 1 THEN 'DIV|role:' || CASE WHEN p_size > 25 THEN 'navigation' ELSE 'textbox' END WHEN 2 THEN 'DIV|testid:' || p_brand WHEN 5 THEN 'A' WHEN 6 THEN 'DIV|css:' || p_type WHEN 7 THEN '' ELSE 'DIV' END AS fp, CASE k WHEN 0 THEN 'role:button:' || p_name WHEN 1 THEN 'role:' || CASE WHEN p_size > 25 THEN 'navigation' ELSE 'textbox' END || ':' WHEN 2 THEN 'testid:' || p_brand WHEN 5 THEN 'css:A' WHEN 6 THEN 'css:' || p_type WHEN 7 THEN 'css:' ELSE 'css:DIV' END AS identity FROM l",
        "selector_priority": "SELECT CASE p_partkey % 8 WHEN 0 THEN 1 WHEN 1 THEN CASE WHEN p_size > 25 THEN 1 ELSE 7 END WHEN 7 THEN 99 WHEN 5 THEN CASE WHEN length(p_name) <= 50 THEN 5 ELSE 7 END ELSE p_partkey % 8 END AS priority, count(*) AS n FROM part GROUP BY 1",
        "camel_case": f"SELECT p_partkey, {camel('p_type')} AS type_name, {camel('p_brand')} AS brand_name, {short(chr(39).join(['concat_ws(', '  ', ', p_name, p_type, p_name)']))} AS short FROM part",
        "url_variables": f"WITH {PG}, z AS (SELECT page_id, npath, string_split(trim(npath, '/'), '/') AS s FROM pn), y AS (SELECT *, list_position(list_transform(s, lambda x: x LIKE ':%'), true) AS i FROM z) SELECT page_id, CASE WHEN i > 0 THEN CASE WHEN i > 1 THEN s[i - 1] ELSE 'resource' END || '_' || s[i][2:] END AS variable, CASE WHEN contains(npath, ':uuid') THEN '00000000-0000-4000-8000-000000000001' WHEN contains(npath, ':id') THEN '1' WHEN contains(npath, ':slug') THEN 'example-item' ELSE '' END AS example FROM y",
        "flow_names": rf"""{SEQ}, nm AS (SELECT *, (row_number() OVER (ORDER BY host) - 1) % 3 AS i, list_transform(list_filter(list_zip(names, list_prepend(NULL, names)), lambda z: z[1] IS NOT NULL AND z[1] IS DISTINCT FROM z[2]), lambda z: z[1]) AS d FROM seqs),
            sl AS (SELECT *, trim(regexp_replace(lower(array_to_string(d, '-to-')), '[^a-z0-9]+', '-', 'g'), '-') AS b FROM nm)
            SELECT host, CASE WHEN len(names) < 2 THEN names[1] ELSE names[1] || ' to ' || names[-1] END AS name, CASE WHEN length(b) > 180 THEN substr(b, 1, 180) || '-' || substr(md5(pattern), 1, 8) ELSE b END || CASE WHEN i > 0 THEN '-' || (i + 1)::VARCHAR ELSE '' END || '.spec.ts' AS file FROM sl""",
        "comment_escape": "WITH t AS (SELECT doc_id, translate(coalesce(text, ''), chr(13) || chr(10) || chr(8232) || chr(8233), '    ') AS a, translate(replace(coalesce(text, ''), '*/', '* /'), chr(13) || chr(10) || chr(8232) || chr(8233), '    ') AS b FROM documents) SELECT doc_id, md5(substr(a, 1, 250)) AS line, md5(b) AS block FROM t",
        "string_literal": f"SELECT page_id, replace(replace(replace(replace(replace({LITERAL}, '<', chr(92) || 'u003c'), '`', chr(92) || 'u0060'), chr(8232), chr(92) || 'u2028'), chr(8233), chr(92) || 'u2029'), '${{', chr(92) || 'u0024{{') AS literal FROM pages",
        "variables_first": f"WITH {EV} SELECT 'f' || (k % 2)::VARCHAR AS name, 'Form value for ' || first(loc ORDER BY session_id, ts, seq) AS description, first(k::VARCHAR ORDER BY session_id, ts, seq) AS example FROM ev WHERE kind = 'fill' GROUP BY 1",
        "event_validation": f"WITH {EV}, t AS (SELECT seq, k % 6 AS defect, seq % {len(payload_samples())} AS i FROM ev), o AS (SELECT seq, CASE defect WHEN 0 THEN i IN ({at(lambda x: x[3] == '{}')}) WHEN 1 THEN i NOT IN ({at(lambda x: x[2])}) WHEN 2 THEN i NOT IN ({at(lambda x: x[1])}) WHEN 3 THEN i IN ({at(lambda x: x[5] == '{}')}) ELSE true END AS ok FROM t) SELECT seq // 3 AS flow_id, count(*) AS n_events, bool_and(ok) AS valid FROM o GROUP BY 1",
        "deny_pattern_scan": "SELECT page_id, (" + " OR ".join(f"regexp_matches(html, '{plain_regex(p)}')" for p in DENIED) + f") AS denied, regexp_matches(html, '{ESCAPES}') AS escapes FROM pages",
        "variable_map": f"WITH {EV} SELECT loc AS locator, 'f' || (k % 2)::VARCHAR AS name FROM ev WHERE kind = 'fill' GROUP BY 1, 2",
    }
