"""SQL counterparts of the registered queries, for DuckDB over the same tables."""

from __future__ import annotations

from ..functions import content, urls
from ..functions.tables import TWO_LABEL_SUFFIXES
from . import inputs
from .inputs import CONFIG


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _multiline(value: str) -> str:
    return " || chr(10) || ".join(_text(line) for line in value.split("\n"))


def _list(values) -> str:
    return ", ".join(_text(v) for v in values)


_SUFFIX = "|".join(s.replace(".", r"\.") for s in TWO_LABEL_SUFFIXES)
_LANGS = _list(inputs.LANGS)
_WANTED = _list(CONFIG.langs_of_interest)


def _norm(url: str) -> str:
    """Normalised form of an absolute or bare URL without brackets."""
    bare = f"trim(regexp_replace({url}, '#[^#]*$', ''))"
    schemed = f"CASE WHEN regexp_matches({bare}, '^(?i)https?://') THEN {bare} ELSE 'http://' || {bare} END"
    return f"regexp_replace({schemed}, '^([^?#;]*)[?;]$', '\\1')"


def _host(norm: str) -> str:
    return f"regexp_extract({norm}, '^https?://(?:[^/?#]*@)?([^:/?#]*)', 1)"


def _parts(source: str, norm: str, extra: str = "*") -> str:
    """Rows of a source with ``host``, ``suffix``, ``name``, ``subdomain`` and ``site`` of a normalised URL."""
    return f"""
    SELECT * EXCLUDE (known), CASE WHEN name = '' THEN host ELSE name || '.' || suffix END AS site,
      CASE WHEN length(host) > length(name || '.' || suffix)
           THEN left(host, length(host) - length(name || '.' || suffix) - 1) ELSE '' END AS subdomain
    FROM (
      SELECT *, CASE WHEN length(host) > length(suffix)
                     THEN string_split(left(host, length(host) - length(suffix) - 1), '.')[-1] ELSE '' END AS name
      FROM (
        SELECT *, CASE WHEN known <> '' THEN known ELSE string_split(host, '.')[-1] END AS suffix
        FROM (
          SELECT *, regexp_extract(host, '(?:^|\\.)({_SUFFIX})$', 1) AS known
          FROM (SELECT {extra}, {_host(norm)} AS host FROM {source}))))"""


FETCHED = f"""fetched AS (
  SELECT page_id AS fetch_seq, url, html,
    CASE WHEN page_id % 17 = 3 THEN 301 WHEN page_id % 19 = 4 THEN 404 WHEN page_id % 23 = 5 THEN 408
         WHEN page_id % 29 = 6 THEN 428 WHEN page_id % 31 = 7 THEN 429 ELSE 200 END AS status,
    CASE WHEN page_id % 13 = 1 THEN 'application/pdf' WHEN page_id % 37 = 2 THEN NULL
         ELSE 'text/html; charset=utf-8' END AS content_type,
    CASE WHEN page_id % 2 = 0 THEN '120' END AS retry_after,
    TIMESTAMP '{inputs.START}' + to_seconds(7 * page_id) AS fetch_ts
  FROM pages)"""
ACTION = """CASE WHEN status BETWEEN 200 AND 226 THEN 'process' WHEN status BETWEEN 301 AND 308 THEN 'redirect'
  WHEN status = 408 THEN 'retry' WHEN status IN (413, 428) THEN 'wait' ELSE 'fail' END"""
NORMED = f"normed AS (SELECT *, {_norm('url')} AS norm_url, {ACTION} AS action FROM fetched)"
SITED = f"{FETCHED}, {NORMED}, sited AS ({_parts('normed', 'norm_url')})"
TYPE_OK = "(content_type IS NULL OR regexp_matches(content_type, '(text/html)'))"

HREF = _text(content.HREF)
_ROOT = "regexp_extract(parent_url, '^https?://[^/?#]*')"
_PAGE_PATH = "regexp_extract(parent_url, '^[^?#]*')"
_FOLDER = "CASE WHEN regexp_matches(parent_url, '^https?://[^/?#]+$') THEN parent_url || '/' " \
          "ELSE regexp_replace(regexp_extract(parent_url, '^[^?#]*'), '[^/]*$', '') END"
RESOLVED = f"""regexp_replace(CASE
  WHEN href = '' OR starts_with(href, '#') THEN parent_url
  WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href
  WHEN starts_with(href, '//') THEN regexp_extract(parent_url, '^https?:') || href
  WHEN starts_with(href, '/') THEN {_ROOT} || href
  WHEN starts_with(href, '?') THEN {_PAGE_PATH} || href
  ELSE {_FOLDER} || href END, '#[^#]*$', '')"""
CANDIDATES = f"""{SITED}, page_links AS (
  SELECT fetch_seq, parent_url, parent_site, href, regexp_replace({RESOLVED}, '^([^?#;]*)[?;]$', '\\1') AS link
  FROM (SELECT fetch_seq, norm_url AS parent_url, site AS parent_site,
          unnest(list_distinct(regexp_extract_all(html, {HREF}, 1))) AS href FROM sited)),
candidates AS (
  SELECT * FROM page_links
  UNION ALL
  SELECT s.fetch_seq, s.norm_url, s.site, p.url, regexp_replace(p.url, '#[^#]*$', '')
  FROM sited s JOIN pages p ON p.page_id = s.fetch_seq + 1)"""
LINKS = f"""{CANDIDATES}, normed_links AS (SELECT *, {_norm('link')} AS norm_url FROM candidates),
links AS ({_parts('normed_links', 'norm_url')})"""


def _problem(prefixes) -> str:
    pattern = _text("|".join(f"(?:{p})" for p in prefixes))
    return f"""CASE WHEN length(link) > {urls.MAX_URL_LENGTH} THEN 'too_long'
      WHEN regexp_matches(link, {pattern}) THEN 'prefix'
      WHEN NOT regexp_matches(link, '^(?i)https?:') THEN 'scheme' ELSE 'ok' END"""


def _depth(norm: str) -> str:
    path = f"regexp_extract({norm}, '^https?://[^/?#]*([^?#;]*)', 1)"
    return f"len(string_split(regexp_replace({path}, '/+$', ''), '/')) - 1"


def _class(tlds) -> str:
    return f"""CASE WHEN site = parent_site THEN 'same_site' WHEN suffix IN ({_list(tlds)}) THEN 'other_site'
      ELSE 'rejected' END"""


_BLACK = _text("|".join(CONFIG.url_blacklist))
ADMISSION = f"""{LINKS}, admission AS (
  SELECT *, CASE WHEN problem <> 'ok' THEN problem WHEN {_depth('norm_url')} > {CONFIG.max_folder_tree_depth} THEN 'depth'
      WHEN regexp_matches(norm_url, {_BLACK}) THEN 'blacklist' WHEN link_class = 'rejected' THEN 'tld'
      ELSE link_class END AS reason
  FROM (SELECT *, {_problem(CONFIG.prefix_filter)} AS problem, {_class(CONFIG.accepted_tlds)} AS link_class FROM links)),
admitted AS (SELECT * FROM admission WHERE reason IN ('same_site', 'other_site')),
visited AS (SELECT DISTINCT norm_url FROM sited WHERE action = 'process')"""
DEDUP = """deduped AS (
  SELECT norm_url, min(site) AS site, min(fetch_seq) AS first_seq,
    min(parent_url) FILTER (WHERE fetch_seq = lowest) AS parent_url, count(*) AS n_found
  FROM (SELECT *, min(fetch_seq) OVER (PARTITION BY norm_url) AS lowest FROM admitted) GROUP BY norm_url)"""
SEEDS = """seeds AS (SELECT site, norm_url, min(fetch_seq) AS first_seq FROM admission WHERE reason = 'other_site'
  GROUP BY site, norm_url)"""

TEXT = f"""texts AS (
  SELECT page_id AS fetch_seq, trim(regexp_replace(t, '{content.BLANKS}', ' ', 'g')) AS text
  FROM (SELECT page_id, replace(regexp_replace(replace(replace(replace(replace(replace(replace(
      regexp_replace(html, {_text(content.NOT_TEXT)}, ' ', 'g'),
      '&amp;', chr(2)), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&middot;', '·'), '&copy;', '©'),
      '&#?[A-Za-z0-9]+;', ' ', 'g'), chr(2), '&') AS t FROM pages))"""
# A word, said here once more: a letter of any script with the letters and marks behind it.
WORD = r"\p{L}[\p{L}\p{M}]*"
PROFILES = f"""profiles AS (
  SELECT * FROM (
    SELECT lang, word, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS place
    FROM (SELECT lang, word, count(*) AS n
          FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '{WORD}')) AS word
                FROM documents WHERE lang IN ({_LANGS}))
          GROUP BY lang, word))
  WHERE place <= 200)"""
SCORES = f"""{TEXT}, {PROFILES},
split AS (SELECT fetch_seq, regexp_extract_all(lower(text), '{WORD}') AS words FROM texts),
page_words AS (SELECT fetch_seq, len(words) AS n_words, unnest(words) AS word FROM split),
hits AS (SELECT fetch_seq, any_value(n_words) AS n_words, lang, count(*) AS hits
  FROM page_words JOIN profiles USING (word) GROUP BY fetch_seq, lang),
ranked AS (SELECT *, row_number() OVER (PARTITION BY fetch_seq ORDER BY hits DESC, lang) AS place FROM hits),
picked AS (SELECT fetch_seq, any_value(n_words) AS n_words, any_value(lang) FILTER (WHERE place = 1) AS best_lang,
    any_value(hits) FILTER (WHERE place = 1) AS best_hits,
    coalesce(any_value(hits) FILTER (WHERE place = 2), 0) AS second_hits FROM ranked GROUP BY fetch_seq),
detected AS (SELECT s.fetch_seq, len(s.words) AS n_words, best_lang, coalesce(best_hits, 0) AS best_hits,
    coalesce(second_hits, 0) AS second_hits,
    CASE WHEN best_hits * 20 >= len(s.words) AND second_hits * 10 <= best_hits * 9 THEN best_lang END AS lang
  FROM split s LEFT JOIN picked USING (fetch_seq))"""
READABLE = f"action = 'process' AND {TYPE_OK} AND length(html) > 0"
KEPT = f"""{SITED}, {SCORES}, kept AS (
  SELECT fetch_seq, norm_url, host, site, lang, strlen(html)::BIGINT AS n_bytes, html
  FROM sited JOIN detected USING (fetch_seq) WHERE {READABLE} AND lang IN ({_WANTED}))"""


def _scout(prefix: str = "") -> str:
    """Steps and decisions of the scout over the table ``<prefix>kept``."""
    c = CONFIG
    return f"""{prefix}steps AS (
  SELECT * FROM (SELECT site, lang, fetch_seq, row_number() OVER (PARTITION BY site ORDER BY fetch_seq) AS step
    FROM {prefix}kept) WHERE step <= {c.scout_steps}),
{prefix}counted AS (SELECT site, count(*) AS n_steps, count(DISTINCT lang) AS n_langs,
    count(*) FILTER (WHERE lang = '{c.mandatory_lang}') AS n_mandatory, max(fetch_seq) AS last_seq
  FROM {prefix}steps GROUP BY site),
{prefix}decisions AS (
  SELECT *, CASE WHEN keep THEN NULL ELSE last_seq END AS stop_seq FROM (
    SELECT *, n_steps >= {c.scout_steps} AS judged,
      n_steps < {c.scout_steps} OR (n_langs >= {c.min_langs_in_site} AND n_mandatory > 0
        AND n_mandatory * 100 // {c.scout_steps} >= {c.min_percent_mandatory_lang}) AS keep FROM {prefix}counted))"""


SCOUT = f"{KEPT}, {_scout()}"
SIZE = f"""sizes AS (
  SELECT site, min(fetch_seq) AS stop_seq FROM (
    SELECT site, fetch_seq, sum(n_bytes) OVER (PARTITION BY site ORDER BY fetch_seq) AS total FROM kept)
  WHERE total > {round(inputs.SIZE_BUDGET_MB * 1_000_000)} GROUP BY site)"""
TIME = f"""times AS (
  SELECT site, min(fetch_seq) AS stop_seq FROM (
    SELECT site, fetch_seq, fetch_ts, min(fetch_ts) OVER (PARTITION BY site) AS begun FROM sited)
  WHERE fetch_ts > begun + to_seconds({inputs.TIME_BUDGET_S}) GROUP BY site)"""

_ROBOTS_STATUS = " ".join(f"WHEN {i} THEN {status}" for i, (status, _) in enumerate(inputs.ROBOTS_FILES))
_ROBOTS_BODY = " ".join(f"WHEN {i} THEN {_multiline(body)}" for i, (_, body) in enumerate(inputs.ROBOTS_FILES))
_TOKEN = CONFIG.user_agent.split("/")[0].lower()
ROBOTS = f"""hosts AS (SELECT {_host(_norm('url'))} AS host, min(page_id) % {len(inputs.ROBOTS_FILES)} AS kind
  FROM pages GROUP BY 1),
files AS (SELECT host, CASE kind {_ROBOTS_STATUS} END AS status, CASE kind {_ROBOTS_BODY} END AS body FROM hosts),
policies AS (SELECT host, CASE WHEN status IN (400, 404, 406, 410) THEN 'allow' WHEN status BETWEEN 200 AND 299 THEN 'rules'
  ELSE 'deny' END AS policy FROM files),
lines AS (SELECT host, unnest(string_split(body, chr(10))) AS raw,
    unnest(range(len(string_split(body, chr(10))))) AS line_no FROM files WHERE status BETWEEN 200 AND 299),
fields AS (SELECT host, line_no, raw, trim(regexp_replace(raw, '#.*$', '')) AS line FROM lines),
kinds AS (SELECT host, line_no, trim(regexp_replace(line, '^[^:]*:', '')) AS value,
    CASE WHEN raw = '' THEN 'blank' WHEN NOT contains(line, ':') THEN NULL
      ELSE CASE lower(trim(split_part(line, ':', 1))) WHEN 'user-agent' THEN 'agent' WHEN 'allow' THEN 'allow'
        WHEN 'disallow' THEN 'disallow' WHEN 'crawl-delay' THEN 'delay' WHEN 'request-rate' THEN 'rate' END END AS kind
  FROM fields),
marked AS (SELECT *, CASE WHEN kind = 'agent' AND
      coalesce(lag(kind) OVER (PARTITION BY host ORDER BY line_no), 'blank') <> 'agent' THEN 1 ELSE 0 END AS starts
  FROM kinds WHERE kind IS NOT NULL),
runs AS (SELECT *, sum(starts) OVER (PARTITION BY host ORDER BY line_no) AS group_no,
    max(line_no) FILTER (WHERE kind = 'agent') OVER (PARTITION BY host ORDER BY line_no) AS agent_line,
    coalesce(max(line_no) FILTER (WHERE kind = 'blank') OVER (PARTITION BY host ORDER BY line_no), -1) AS blank_line
  FROM marked),
inside AS (SELECT * FROM runs WHERE kind <> 'blank' AND group_no > 0 AND blank_line < agent_line),
rules AS (SELECT host, group_no::BIGINT AS group_no, line_no::BIGINT AS line_no, kind, url_decode(value) AS value FROM inside
  WHERE (host, group_no) IN (SELECT host, group_no FROM inside WHERE kind <> 'agent')),
groups AS (SELECT host, group_no, bool_or(kind = 'agent' AND value = '*') AS for_all,
    bool_or(kind = 'agent' AND contains('{_TOKEN}', lower(value))) AS named FROM rules GROUP BY host, group_no),
chosen AS (SELECT host, group_no FROM (
    SELECT host, group_no, row_number() OVER (PARTITION BY host ORDER BY for_all, group_no) AS place
    FROM groups WHERE for_all OR named) WHERE place = 1),
delays AS (SELECT host, arg_max(value::INTEGER, line_no) AS delay FROM rules JOIN chosen USING (host, group_no)
  WHERE kind = 'delay' AND regexp_matches(value, '^[0-9]+$') GROUP BY host)"""
ALLOWED = f"""targets AS (SELECT fetch_seq, host, CASE WHEN t = '' THEN '/' ELSE url_decode(t) END AS target
  FROM (SELECT fetch_seq, host, regexp_extract(norm_url, '^https?://[^/?#]*(.*)$', 1) AS t FROM sited)),
matched AS (SELECT fetch_seq, arg_min(kind = 'allow' OR value = '', line_no) AS verdict
  FROM targets JOIN chosen USING (host) JOIN rules USING (host, group_no)
  WHERE kind IN ('allow', 'disallow') AND starts_with(target, value) GROUP BY fetch_seq),
allowed AS (SELECT fetch_seq, host, CASE policy WHEN 'allow' THEN true WHEN 'rules' THEN coalesce(verdict, true)
    ELSE false END AS allowed
  FROM targets LEFT JOIN policies USING (host) LEFT JOIN matched USING (fetch_seq))"""
SITE_DELAYS = f"""site_delays AS (SELECT site, coalesce(max(delay), {CONFIG.crawl_delay})::INTEGER AS delay
  FROM (SELECT DISTINCT host, site FROM sited) LEFT JOIN delays USING (host) GROUP BY site)"""


def _outcome(robots: bool) -> str:
    first = "WHEN NOT allowed THEN 'robots'" if robots else ""
    return f"""CASE {first} WHEN action <> 'process' THEN 'status' WHEN NOT {TYPE_OK} THEN 'content_type'
      WHEN length(html) = 0 THEN 'no_text' WHEN lang IS NULL THEN 'no_language'
      WHEN lang NOT IN ({_WANTED}) THEN 'other_language' ELSE 'kept' END"""


JUDGED = f"""{SITED}, {SCORES}, {ROBOTS}, {ALLOWED}, judged AS (
  SELECT fetch_seq, norm_url, site, status, fetch_ts, html, lang, strlen(html)::BIGINT AS n_bytes,
    {_outcome(True)} AS outcome
  FROM sited JOIN detected USING (fetch_seq) JOIN allowed USING (fetch_seq))"""
REPORT = """SELECT site, count(*) AS n_pages, count(*) FILTER (WHERE outcome = 'kept') AS n_kept,
    coalesce(sum(n_bytes) FILTER (WHERE outcome = 'kept'), 0)::BIGINT AS kept_bytes,
    coalesce(string_agg(DISTINCT lang, ',' ORDER BY lang) FILTER (WHERE outcome = 'kept'), '') AS langs"""
# The run: pages and links up to the stop of their site.
RUN = f"""{JUDGED}, answers AS (SELECT *, min(CASE WHEN outcome <> 'robots' AND status NOT IN (408, 413, 428) THEN fetch_seq END)
    OVER (PARTITION BY norm_url) AS final_seq FROM judged),
run_judged AS (SELECT * REPLACE (CASE WHEN fetch_seq > final_seq THEN 'repeated' ELSE outcome END AS outcome) FROM answers),
run_kept AS (SELECT * FROM run_judged WHERE outcome = 'kept'), {_scout('run_')},
before_stop AS (SELECT j.* FROM run_judged j LEFT JOIN run_decisions d USING (site)
  WHERE d.stop_seq IS NULL OR j.fetch_seq <= d.stop_seq)"""
RUN_FRESH = f"""{RUN},
run_links AS (SELECT fetch_seq, parent_url, parent_site, href, regexp_replace({RESOLVED}, '^([^?#;]*)[?;]$', '\\1') AS link
  FROM (SELECT fetch_seq, norm_url AS parent_url, site AS parent_site,
      unnest(list_distinct(regexp_extract_all(html, {HREF}, 1))) AS href
    FROM before_stop WHERE outcome NOT IN ('repeated', 'robots', 'status', 'content_type', 'no_text'))
  UNION ALL
  SELECT b.fetch_seq, b.norm_url, b.site, p.url, regexp_replace(p.url, '#[^#]*$', '')
  FROM before_stop b JOIN pages p ON p.page_id = b.fetch_seq + 1
  WHERE outcome NOT IN ('repeated', 'robots') AND b.status = 301),
run_normed AS (SELECT *, {_norm('link')} AS norm_url FROM run_links), run_parts AS ({_parts('run_normed', 'norm_url')}),
run_admitted AS (SELECT site, norm_url, parent_site, fetch_seq, suffix FROM run_parts
  WHERE {_problem(CONFIG.prefix_filter)} = 'ok' AND NOT regexp_matches(norm_url, {_BLACK})
    AND {_depth('norm_url')} <= {CONFIG.max_folder_tree_depth}
    AND norm_url NOT IN (SELECT norm_url FROM judged)),
fresh_urls AS (SELECT site, norm_url, min(fetch_seq) AS added FROM run_admitted WHERE site = parent_site GROUP BY site, norm_url),
run_seeds AS (SELECT site, norm_url, min(fetch_seq) AS added FROM run_admitted
  WHERE site <> parent_site AND suffix IN ({_list(CONFIG.accepted_tlds)}) GROUP BY site, norm_url)"""

# languages of the documents, said here once more
_ISO = "('eng', 'en'), ('fra', 'fr'), ('deu', 'de'), ('spa', 'es')"
_CODE = r"regexp_extract(label, '^(?:__label__)?([a-z]{2,3})(?:_[A-Za-z]{4})?$', 1)"
_QUOTED = (
    "replace(replace(replace(replace(replace(url_encode(path), '%3F', '?'), '%3D', '='), '%26', '&'), '%2F', '/'), "
    "'%25', '%')"
)

POLICY = f"""hosted AS (SELECT host AS site, fetch_seq, lang, n_bytes FROM kept),
folded AS (
  SELECT site, fetch_seq, count(*) OVER w AS n_docs, CAST(sum(n_bytes) OVER w AS BIGINT) AS bytes, CAST(sum(new) OVER w AS BIGINT) AS n_langs,
    max(n_bytes) OVER w AS longest, min(fetch_seq) OVER w AS first_fetch
  FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY site, lang ORDER BY fetch_seq) = 1 THEN 1 ELSE 0 END AS new FROM hosted)
  WINDOW w AS (PARTITION BY site ORDER BY fetch_seq)),
ready AS (SELECT *, bytes >= {inputs.POLICY_BYTES} AND longest >= {inputs.POLICY_LONGEST} AS judged FROM folded),
decided AS (
  SELECT *, row_number() OVER (PARTITION BY site ORDER BY judged DESC, CASE WHEN judged THEN fetch_seq ELSE -fetch_seq END) AS place,
    NOT judged OR n_langs >= 3 OR (n_langs >= 2 AND longest * 2 <= bytes) AS keep
  FROM ready),
verdicts AS (SELECT site, n_docs, bytes, n_langs, longest, first_fetch, judged, keep, CASE WHEN keep THEN -1 ELSE fetch_seq END AS stop_seq
  FROM decided WHERE place = 1)"""

ORACLE_SQL: dict[str, str] = {
    "pages_scan": f"WITH {FETCHED} SELECT fetch_seq, url, status, content_type, strlen(html)::BIGINT AS n_bytes FROM fetched",
    "page_headers": f"WITH {FETCHED} SELECT fetch_seq, content_type, retry_after FROM fetched",
    "seed_sites": f"""WITH {SITED} SELECT site, n_seeds, first_seed, row_number() OVER (ORDER BY first_seed) - 1 AS priority
        FROM (SELECT site, count(*) AS n_seeds, min(fetch_seq) AS first_seed FROM sited GROUP BY site)""",
    "seed_frontier": f"WITH {SITED} SELECT norm_url, min(site) AS site, min(fetch_seq) AS added FROM sited GROUP BY norm_url",
    "doc_metadata": f"WITH {KEPT} SELECT norm_url AS url, 'utf-8' AS encoding, lang FROM kept",
    "metadata_sink": f"WITH {KEPT} SELECT norm_url AS url, 'utf-8' AS encoding, lang FROM kept",
    "document_sink": f"WITH {KEPT} SELECT 1 AS run_id, site, fetch_seq, norm_url, lang, md5(html) AS html_md5 FROM kept",
    "state_tables": f"""WITH {SITED}
        SELECT DISTINCT 'visited' AS state, site, norm_url, 0::BIGINT AS n FROM sited WHERE action = 'process'
        UNION ALL SELECT DISTINCT 'pending', site, norm_url, 0 FROM sited WHERE action IN ('retry', 'wait')
        UNION ALL SELECT 'attempts', site, norm_url, count(*) FROM sited WHERE action IN ('retry', 'wait') GROUP BY 2, 3""",
    "state_versions": f"""WITH {SITED}, part AS (
        SELECT *, (fetch_seq - min(fetch_seq) OVER ()) * 3 // (max(fetch_seq) OVER () - min(fetch_seq) OVER () + 1) AS part FROM sited),
      visited AS (SELECT DISTINCT site, norm_url FROM sited WHERE action = 'process'),
      failed AS (SELECT site, norm_url, part, max(fetch_seq) AS added, count(*) AS n FROM part WHERE action IN ('retry', 'wait')
        AND norm_url NOT IN (SELECT norm_url FROM visited) GROUP BY ALL),
      last AS (SELECT * FROM failed QUALIFY row_number() OVER (PARTITION BY norm_url ORDER BY part DESC) = 1)
      SELECT 'visited' AS state, site, norm_url, 0::BIGINT AS n FROM visited UNION ALL SELECT 'pending', site, norm_url, added FROM last
      UNION ALL SELECT 'attempts', site, norm_url, n FROM last UNION ALL SELECT 'sites', site, '', max(fetch_seq) FROM sited GROUP BY site""",
    "url_strip_fragment": "SELECT page_id AS fetch_seq, regexp_replace(url, '#[^#]*$', '') AS stripped FROM pages",
    "url_normalise": f"""SELECT page_id AS fetch_seq, {_norm('url')} AS norm_url,
        {_norm("regexp_replace(url, '^https?://', '')")} AS from_bare FROM pages""",
    "url_parts": f"""WITH {CANDIDATES} SELECT fetch_seq, link, regexp_extract(u, '^(https?)://', 1) AS scheme,
        regexp_extract(u, '^https?://([^/?#]*)', 1) AS netloc,
        regexp_extract(u, '^https?://[^/?#]*((?:[^?#]*/)?[^/?#;]*)', 1) AS path,
        regexp_extract(u, '^https?://[^/?#]*(?:[^?#]*/)?[^/?#;]*;([^/?#]*)', 1) AS params,
        regexp_extract(u, '[?]([^#]*)', 1) AS query, regexp_extract(u, '#(.*)$', 1) AS fragment
        FROM (SELECT fetch_seq, link, {_norm('link')} AS u FROM candidates)""",
    "link_absolute": f"""WITH {CANDIDATES} SELECT fetch_seq, href, regexp_matches(href, '^([a-zA-Z][a-zA-Z0-9_+.-]*:)?//[^/?#]+')
        AS absolute FROM candidates""",
    "link_resolve": f"WITH {CANDIDATES} SELECT fetch_seq, parent_url, href, link FROM candidates",
    "host_parts": f"WITH {LINKS} SELECT fetch_seq, link, host, subdomain, name, suffix FROM links",
    "host_parts_by_rules": f"WITH {SITED} SELECT fetch_seq, host, subdomain, name, suffix, site FROM sited",
    "site_domain": f"WITH {SITED} SELECT fetch_seq, site FROM sited",
    "tld_counts": f"""WITH {LINKS} SELECT suffix, count(*) AS n_links, count(DISTINCT norm_url) AS n_urls FROM links
        GROUP BY suffix""",
    "url_root": f"SELECT page_id AS fetch_seq, regexp_extract({_norm('url')}, '^https?://[^/?#]*') AS root FROM pages",
    "url_depth": f"WITH {LINKS} SELECT fetch_seq, link, ({_depth('norm_url')})::INTEGER AS depth FROM links",
    "link_validity": f"""WITH {CANDIDATES} SELECT fetch_seq, link, {_problem(("/the$", "utm_source", "[^a-z]$"))} AS problem
        FROM candidates""",
    "url_request_path": f"""WITH {CANDIDATES} SELECT fetch_seq, link, {_QUOTED} AS request_path FROM (
        SELECT fetch_seq, link, regexp_extract({_norm('link')}, '^https?://[^/?#]*((?:[^?#]*/)?[^/?#;]*)', 1) AS path
        FROM candidates)""",
    "status_actions": f"WITH {FETCHED} SELECT status, {ACTION} AS action, count(*) AS n FROM fetched GROUP BY 1, 2",
    "content_filter": f"WITH {FETCHED} SELECT fetch_seq, content_type FROM fetched WHERE {TYPE_OK}",
    "doc_encoding": r"""SELECT page_id AS fetch_seq, CASE WHEN page_id % 10 = 2 THEN 'utf-16le' WHEN page_id % 10 = 3 THEN 'utf-16be'
          WHEN page_id % 10 = 4 THEN 'utf-32' WHEN regexp_matches(html, '[^\x00-\x{ff}]') THEN 'utf-8'
          WHEN page_id % 10 = 0 AND regexp_matches(html, '[^\x00-\x7f]') THEN 'iso-8859-1' WHEN page_id % 10 = 1 THEN 'iso-8859-1'
          WHEN page_id % 10 = 5 THEN 'windows-1252' WHEN page_id % 10 = 6 THEN 'iso-8859-15'
          WHEN page_id % 10 = 7 THEN 'windows-1254' ELSE 'utf-8' END AS encoding, md5(html) AS html_md5
        FROM pages""",
    "doc_charsets": f"""SELECT page_id AS fetch_seq, CASE page_id % {len(inputs.CHARSETS)} {
        " ".join(f"WHEN {i} THEN '{name}'" for i, (name, *_) in enumerate(inputs.CHARSETS))} END AS encoding,
      md5(translate(lower(regexp_replace(html, '[^\\x00-\\x7F]', '', 'g')), '{inputs.LATIN}', CASE page_id % {len(inputs.CHARSETS)} {
        " ".join(f"WHEN {i} THEN '{letters}'" for i, (*_, letters) in enumerate(inputs.CHARSETS))} END)) AS html_md5 FROM pages""",
    "link_extract": f"SELECT page_id AS fetch_seq, url, unnest(regexp_extract_all(html, {HREF}, 1)) AS href FROM pages",
    "link_distinct": f"""SELECT page_id AS fetch_seq, url, unnest(list_distinct(regexp_extract_all(html, {HREF}, 1))) AS href
        FROM pages""",
    "page_text": f"WITH {TEXT} SELECT fetch_seq, length(text) AS n_chars, md5(text) AS text_md5 FROM texts",
    "lang_profiles": f"WITH {PROFILES} SELECT lang, word, n, place::INTEGER AS place FROM profiles",
    "lang_scores": f"WITH {SCORES} SELECT fetch_seq, n_words, best_lang, best_hits, second_hits, lang FROM detected",
    "lang_grams": f"""WITH clean AS (SELECT doc_id, lang,
          ' ' || trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{M}}]+', ' ', 'g')) || ' ' AS t FROM documents),
        coded AS (SELECT doc_id, lang, list_transform(string_split(t, ''), lambda c: ord(c)::BIGINT) AS c FROM clean),
        gram AS (SELECT doc_id, lang, unnest(list_transform(range(1, len(c) - 1), lambda i: (c[i] * 961 + c[i + 1] * 31 + c[i + 2]) % 4093)) AS bin FROM coded),
        counted AS (SELECT lang AS code, bin, count(*) AS n FROM gram WHERE lang IN ({_LANGS}) GROUP BY lang, bin),
        total AS (SELECT code, sum(n) + 4093 AS whole FROM counted GROUP BY code),
        of_doc AS (SELECT doc_id, bin, count(*) AS k FROM gram GROUP BY doc_id, bin),
        score AS (SELECT doc_id, code, sum(k * round(1000 * ln((coalesce(n, 0) + 1) / whole))::BIGINT)::BIGINT AS s, sum(k)::BIGINT AS n_grams
          FROM of_doc CROSS JOIN total LEFT JOIN counted USING (code, bin) GROUP BY doc_id, code),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, code) AS place FROM score)
        SELECT d.doc_id, d.lang AS label, CASE WHEN a.s - b.s >= 2996 THEN a.code END AS lang, a.code AS lang_best,
          coalesce(a.s - b.s, 0) AS lang_margin, coalesce(a.n_grams, 0) AS lang_grams
        FROM documents d LEFT JOIN (SELECT * FROM ranked WHERE place = 1) a USING (doc_id)
        LEFT JOIN (SELECT * FROM ranked WHERE place = 2) b USING (doc_id)""",
    "lang_scripts": f"""WITH written AS (SELECT doc_id, lang, CASE lang
            WHEN 'en' THEN translate(lower(text), '{inputs.LATIN}', '{inputs.SCRIPTS["en"]}')
            WHEN 'fr' THEN translate(lower(text), '{inputs.LATIN}', '{inputs.SCRIPTS["fr"]}') ELSE lower(text) END AS text
          FROM documents),
        split AS (SELECT doc_id, lang, text, regexp_extract_all(text, '{WORD}') AS words FROM written),
        counted AS (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(words) AS word FROM split) GROUP BY lang, word),
        profile AS (SELECT lang AS code, word FROM (
          SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS place FROM counted WHERE lang IN ({_LANGS}))
          WHERE place <= 200),
        hit AS (SELECT doc_id, code, count(*) AS hits FROM (SELECT doc_id, unnest(words) AS word FROM split) JOIN profile USING (word)
          GROUP BY doc_id, code),
        best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, code) AS place FROM hit)
        SELECT doc_id, lang, length(text) AS n_chars, CASE WHEN b.hits * 20 >= len(words)
          AND coalesce(r.hits, 0) * 10 <= b.hits * 9 THEN b.code END AS found
        FROM split LEFT JOIN (SELECT * FROM best WHERE place = 1) b USING (doc_id)
        LEFT JOIN (SELECT * FROM best WHERE place = 2) r USING (doc_id)""",
    "page_lang": f"WITH {SCORES} SELECT fetch_seq, lang FROM detected",
    "lang_labels": f"""WITH labelled AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '__label__' || three || '_Latn'
          WHEN 1 THEN '__label__' || three WHEN 2 THEN lang WHEN 3 THEN '__label__' || lang ELSE '__label__xyz' END AS label
        FROM (SELECT doc_id, lang, CASE lang WHEN 'en' THEN 'eng' WHEN 'fr' THEN 'fra' WHEN 'de' THEN 'deu'
          WHEN 'es' THEN 'spa' ELSE 'zzz' END AS three FROM documents))
        SELECT doc_id, label, CASE WHEN length({_CODE}) = 2 THEN {_CODE} ELSE alpha2 END AS lang
        FROM labelled LEFT JOIN (VALUES {_ISO}) iso(alpha3, alpha2) ON alpha3 = {_CODE}""",
    "kept_documents": f"WITH {KEPT} SELECT fetch_seq, norm_url, site, lang, n_bytes FROM kept",
    "page_outcomes": f"WITH {JUDGED} SELECT site, outcome, count(*) AS n FROM judged GROUP BY site, outcome",
    "link_blacklist": f"WITH {LINKS} SELECT fetch_seq, norm_url FROM links WHERE NOT regexp_matches(norm_url, {_BLACK})",
    "link_classify": f"""WITH {LINKS} SELECT fetch_seq, parent_site, norm_url, site, {_class(('com', 'net'))} AS link_class
        FROM links""",
    "link_admission": f"WITH {ADMISSION} SELECT fetch_seq, parent_url, link, reason FROM admission",
    "frontier_new": f"""WITH {ADMISSION} SELECT fetch_seq, norm_url FROM admitted
        WHERE norm_url NOT IN (SELECT norm_url FROM visited)""",
    "frontier_dedup": f"WITH {ADMISSION}, {DEDUP} SELECT norm_url, site, first_seq, parent_url, n_found FROM deduped",
    "frontier_extend": f"""WITH {ADMISSION}, {DEDUP} SELECT norm_url, min(site) AS site, min(added) AS added FROM (
        SELECT norm_url, site, fetch_seq AS added FROM sited WHERE action IN ('retry', 'wait')
        UNION ALL SELECT norm_url, site, first_seq FROM deduped WHERE norm_url NOT IN (SELECT norm_url FROM visited))
        GROUP BY norm_url""",
    "redirect_links": f"""WITH {SITED}, moved AS (
          SELECT s.fetch_seq, s.norm_url AS parent_url, s.site AS parent_site, regexp_replace(p.url, '#[^#]*$', '') AS link
          FROM sited s JOIN pages p ON p.page_id = s.fetch_seq + 1 WHERE s.action = 'redirect'),
        moved_normed AS (SELECT *, {_norm('link')} AS norm_url FROM moved), moved_parts AS ({_parts('moved_normed', 'norm_url')})
        SELECT fetch_seq, parent_url, link, site, CASE WHEN problem <> 'ok' THEN problem
          WHEN {_depth('norm_url')} > {CONFIG.max_folder_tree_depth} THEN 'depth'
          WHEN regexp_matches(norm_url, {_BLACK}) THEN 'blacklist' WHEN link_class = 'rejected' THEN 'tld'
          ELSE link_class END AS reason
        FROM (SELECT *, {_problem(CONFIG.prefix_filter)} AS problem, {_class(CONFIG.accepted_tlds)} AS link_class
              FROM moved_parts)""",
    "discovered_seeds": f"WITH {ADMISSION}, {SEEDS} SELECT site, norm_url, first_seq FROM seeds",
    "expand_sites": f"""WITH {ADMISSION}, {SEEDS},
        known AS (SELECT site, row_number() OVER (ORDER BY first_page) - 1 AS priority, site = 'example.org' AS stopped FROM (
          SELECT site, min(fetch_seq) AS first_page FROM sited GROUP BY site)),
        found AS (SELECT name AS site, count(*) AS n_seeds, min(first_seq) AS first_seq FROM (
          SELECT CASE WHEN first_seq % 2 = 0 THEN 'new-' || site ELSE site END AS name, first_seq FROM seeds) GROUP BY name)
        SELECT site, n_seeds, CASE WHEN stopped THEN 'ignore' ELSE 'extend' END AS action, priority
        FROM found JOIN known USING (site)
        UNION ALL
        SELECT site, n_seeds, 'new', (SELECT max(priority) FROM known) + row_number() OVER (ORDER BY first_seq, site)
        FROM found WHERE site NOT IN (SELECT site FROM known)""",
    "seed_file": """SELECT row_number() OVER (ORDER BY page_id) - 1 + skipped AS seed_seq, url FROM (
          SELECT page_id, url, count(*) FILTER (WHERE page_id % 9 = 4) OVER (ORDER BY page_id) AS skipped FROM pages)
        WHERE page_id % 9 <> 4""",
    "pages_with_text": """SELECT page_id AS fetch_seq, url FROM pages WHERE page_id % 7 <> 0 AND page_id % 11 <> 1 AND html <> ''""",
    "page_prolog": "SELECT page_id AS fetch_seq, md5(html) AS html_md5 FROM pages",
    "link_blacklist_table": f"""WITH {LINKS}, bad AS (
          SELECT string_agg(DISTINCT '://' || split_part(host, '.', 1) || '\\.[^/]*/de/', '|') AS pattern FROM sited)
        SELECT fetch_seq, norm_url FROM links, bad WHERE NOT regexp_matches(norm_url, pattern)""",
    "link_reasons": f"""WITH {SITED}, roots AS (SELECT *, regexp_extract(norm_url, '^https?://[^/?#]*') AS root FROM sited)
        SELECT fetch_seq, CASE fetch_seq % 9 WHEN 0 THEN 7 WHEN 1 THEN length(root) + 3001 WHEN 2 THEN length(host) + 9
            WHEN 3 THEN length(host) + 6 WHEN 4 THEN length(root) + 50 WHEN 5 THEN length(root) + 10 WHEN 6 THEN length(site) + 11
            WHEN 7 THEN length(site) + 14 ELSE length(norm_url) END AS n_chars,
          CASE fetch_seq % 9 WHEN 0 THEN 'empty' WHEN 1 THEN 'too_long' WHEN 2 THEN 'prefix' WHEN 3 THEN 'scheme' WHEN 4 THEN 'depth'
            WHEN 5 THEN 'blacklist' WHEN 6 THEN 'tld' WHEN 7 THEN 'other_site' ELSE 'same_site' END AS reason
        FROM roots WHERE fetch_seq % 9 <> 8 OR NOT regexp_matches(norm_url, {_BLACK})
        UNION ALL SELECT fetch_seq, length(norm_url), 'blacklist' FROM roots WHERE fetch_seq % 9 = 8 AND regexp_matches(norm_url, {_BLACK})""",
    "robots_latest": f"WITH {ROBOTS} SELECT host, policy FROM policies",
    "robots_allowed_any_case": f"WITH {SITED}, {ROBOTS}, {ALLOWED} SELECT fetch_seq, host, allowed FROM allowed",
    "stop_causes": f"""WITH {SITED}, h AS (SELECT host AS site, min(fetch_seq) % 5 AS n, max(fetch_seq) AS last_seq FROM sited GROUP BY host)
        SELECT site, CASE n WHEN 0 THEN 'scout' WHEN 1 THEN 'size' WHEN 2 THEN 'time' WHEN 3 THEN 'running' ELSE 'exhausted' END AS cause,
          CASE WHEN n <> 3 THEN last_seq END AS stop_seq FROM h""",
    "next_urls": f"""WITH {SITED},
        ordered AS (SELECT site, row_number() OVER (ORDER BY first_page) - 1 AS priority FROM (
          SELECT site, min(fetch_seq) AS first_page FROM sited GROUP BY site)),
        pending AS (SELECT site, norm_url, fetch_seq AS added, CASE WHEN action = 'wait'
            THEN fetch_ts + to_seconds(coalesce(try_cast(retry_after AS INTEGER), 500)) END AS wait_until FROM sited)
        SELECT site, priority, place::INTEGER AS place, norm_url, added FROM (
          SELECT *, row_number() OVER (PARTITION BY site ORDER BY added DESC, norm_url) AS place FROM pending
          WHERE wait_until IS NULL OR wait_until <= TIMESTAMP '{inputs.NOW}')
        JOIN ordered USING (site) WHERE place <= 5 AND priority < 2""",
    "reachable_pages": f"""WITH RECURSIVE {SITED},
        edges AS (SELECT a.norm_url AS src, b.norm_url AS dst FROM sited a JOIN sited b
          ON b.fetch_seq = a.fetch_seq + 1 OR b.fetch_seq = 2 * a.fetch_seq),
        reached AS (SELECT arg_min(norm_url, fetch_seq) AS norm_url FROM sited GROUP BY site
          UNION SELECT dst FROM reached JOIN edges ON src = norm_url)
        SELECT DISTINCT norm_url FROM reached""",
    "robots_policy": f"WITH {ROBOTS} SELECT host, policy FROM policies",
    "robots_rules": f"WITH {ROBOTS} SELECT host, group_no, line_no, kind, value FROM rules",
    "robots_allowed": f"WITH {SITED}, {ROBOTS}, {ALLOWED} SELECT fetch_seq, host, allowed FROM allowed",
    "robots_delay": f"WITH {ROBOTS} SELECT host, delay FROM delays",
    "site_delay": f"WITH {SITED}, {ROBOTS}, {SITE_DELAYS} SELECT site, delay FROM site_delays",
    "scout_steps": f"WITH {SCOUT} SELECT site, step, fetch_seq, lang FROM steps",
    "lang_evidence": f"WITH {SCOUT} SELECT site, lang, count(*) AS n FROM steps GROUP BY site, lang",
    "scout_percent": f"WITH {SCOUT} SELECT site, n_mandatory * 100 // {CONFIG.scout_steps} AS percent FROM decisions",
    "scout_decision": f"""WITH {SCOUT} SELECT site, n_steps, n_langs, n_mandatory, judged, keep,
        coalesce(stop_seq, -1) AS stop_seq FROM decisions""",
    "scout_apply": f"""WITH {SCOUT} SELECT fetch_seq, site, norm_url FROM sited LEFT JOIN decisions USING (site)
        WHERE stop_seq IS NULL OR fetch_seq <= stop_seq""",
    "scout_policy": f"""WITH {KEPT}, {POLICY} SELECT site, n_docs, bytes, n_langs, longest, first_fetch, judged, keep, stop_seq FROM verdicts""",
    "stream_policy": f"""WITH {KEPT}, {POLICY} SELECT h.site, lang, fetch_seq, n_bytes FROM hosted h JOIN verdicts v USING (site)
      WHERE stop_seq = -1 OR fetch_seq <= stop_seq""",
    "scout_links": f"""WITH {CANDIDATES}, {SCORES}, kept AS (
          SELECT fetch_seq, norm_url, site, lang FROM sited JOIN detected USING (fetch_seq)
          WHERE {READABLE} AND lang IN ({_WANTED})), {_scout()}
        SELECT l.fetch_seq, parent_site, link FROM page_links l JOIN sited s USING (fetch_seq)
        LEFT JOIN decisions d ON d.site = parent_site
        WHERE {READABLE} AND (stop_seq IS NULL OR l.fetch_seq <= stop_seq)""",
    "size_budget": f"WITH {KEPT}, {SIZE} SELECT site, stop_seq FROM sizes",
    "time_budget": f"WITH {SITED}, {TIME} SELECT site, stop_seq FROM times",
    "exhausted_sites": f"""WITH {SITED} SELECT DISTINCT host AS site FROM sited
        WHERE host NOT IN (SELECT host FROM sited WHERE action IN ('retry', 'wait'))""",
    "site_status": f"""WITH {SCOUT}, {SIZE}, {TIME},
        ends AS (SELECT site, max(fetch_seq) AS last_seq FROM sited GROUP BY site),
        causes AS (SELECT site, stop_seq, 0 AS place, 'scout' AS cause FROM decisions WHERE stop_seq IS NOT NULL
          UNION ALL SELECT site, stop_seq, 1, 'size' FROM sizes UNION ALL SELECT site, stop_seq, 2, 'time' FROM times
          UNION ALL SELECT site, last_seq, 3, 'exhausted' FROM ends
            WHERE site NOT IN (SELECT site FROM sited WHERE action IN ('retry', 'wait'))),
        firsts AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY stop_seq, place) AS n FROM causes)
        SELECT e.site, coalesce(cause, 'running') AS cause, coalesce(stop_seq, -1) AS stop_seq
        FROM ends e LEFT JOIN (SELECT * FROM firsts WHERE n = 1) f USING (site)""",
    "attempt_state": f"""WITH log AS (SELECT {_norm('url')} AS norm_url, page_id, unnest(range(1, page_id % 7 + 2)) AS attempt
          FROM pages),
        acted AS (SELECT *, CASE WHEN attempt = 2 AND page_id % 7 = 1 THEN 'fail' ELSE 'retry' END AS action FROM log),
        seen AS (SELECT norm_url, count(*) AS n_failures, arg_max(action, (attempt, action)) AS last FROM acted GROUP BY norm_url)
        SELECT norm_url, n_failures, CASE WHEN last = 'fail' THEN 'failed'
          WHEN n_failures >= {CONFIG.max_attempts + 2} THEN 'given_up' ELSE 'retry' END AS state FROM seen""",
    "retry_wait": f"""WITH {FETCHED} SELECT fetch_seq,
        (fetch_ts + to_seconds(coalesce(try_cast(retry_after AS INTEGER), 500)))::VARCHAR AS wait_until
        FROM fetched WHERE {ACTION} = 'wait'""",
    "fetch_slots": f"""WITH {ADMISSION}, {DEDUP}, {ROBOTS}, {SITE_DELAYS},
        slots AS (SELECT site, norm_url, row_number() OVER (PARTITION BY site ORDER BY first_seq DESC, norm_url) AS slot
          FROM deduped WHERE norm_url NOT IN (SELECT norm_url FROM visited))
        SELECT site, norm_url, slot, (TIMESTAMP '{inputs.NOW}' + to_seconds((slot - 1) * delay))::VARCHAR AS fetch_at
        FROM slots JOIN site_delays USING (site)""",
    "delay_audit": f"""WITH {SITED}, {ROBOTS}, {SITE_DELAYS},
        gaps AS (SELECT site, fetch_seq, date_diff('second', lag(fetch_ts) OVER (PARTITION BY site ORDER BY fetch_seq), fetch_ts)
          AS gap FROM sited)
        SELECT site, fetch_seq, gap, delay FROM gaps JOIN site_delays USING (site) WHERE gap < delay""",
    "site_report": f"""WITH {SITED}, {SCORES}, judged AS (
          SELECT *, strlen(html)::BIGINT AS n_bytes, {_outcome(False)} AS outcome FROM sited JOIN detected USING (fetch_seq))
        {REPORT} FROM judged GROUP BY site""",
    "crawl_report": f"""WITH {RUN_FRESH},
        fresh AS (SELECT site, count(*) AS n_pending FROM fresh_urls GROUP BY site),
        report AS ({REPORT} FROM before_stop GROUP BY site)
        SELECT r.*, CASE WHEN stop_seq IS NULL THEN 'running' ELSE 'scout' END AS cause, coalesce(n_pending, 0) AS n_pending
        FROM report r LEFT JOIN run_decisions USING (site) LEFT JOIN fresh USING (site)""",
    "crawl_state": f"""WITH {RUN_FRESH},
        failed AS (SELECT site, norm_url, max(fetch_seq) AS added, count(*) FILTER (WHERE status IN (408, 413, 428)) AS n
          FROM before_stop WHERE outcome NOT IN ('robots', 'repeated') GROUP BY site, norm_url
          HAVING arg_max(status, fetch_seq) IN (408, 413, 428)),
        arrived AS (SELECT site, min(added) AS first_seq FROM (
          SELECT site, fetch_seq AS added FROM judged UNION ALL SELECT site, added FROM run_seeds) GROUP BY site),
        open AS (SELECT site, norm_url, min(added) AS added FROM (
          SELECT site, norm_url, added FROM fresh_urls UNION ALL SELECT site, norm_url, added FROM failed
          UNION ALL SELECT site, norm_url, added FROM run_seeds
            WHERE site NOT IN (SELECT site FROM run_decisions WHERE stop_seq IS NOT NULL)) GROUP BY site, norm_url)
        SELECT 'attempts' AS state, site, norm_url, n FROM failed
        UNION ALL SELECT 'pending', site, norm_url, added FROM open
        UNION ALL SELECT DISTINCT 'visited', site, norm_url, 0 FROM judged
          WHERE norm_url NOT IN (SELECT norm_url FROM failed)
        UNION ALL SELECT 'sites', site, CASE WHEN site IN (SELECT site FROM run_decisions WHERE stop_seq IS NOT NULL) THEN 'scout'
          WHEN site NOT IN (SELECT site FROM open) THEN 'exhausted' ELSE 'running' END,
          row_number() OVER (ORDER BY first_seq, site) - 1 FROM arrived""",
    "crawl_documents": f"""WITH {RUN} SELECT fetch_seq, norm_url, site, 'utf-8' AS encoding, lang, md5(html) AS html_md5
        FROM before_stop WHERE outcome = 'kept'""",
    "stream_links": f"""WITH {ADMISSION} SELECT DISTINCT norm_url, site FROM admitted
        WHERE (fetch_seq, href) IN (SELECT fetch_seq, href FROM page_links)""",
    "stream_scouted": f"""WITH {SCOUT} SELECT site, lang, fetch_seq, norm_url FROM kept LEFT JOIN decisions USING (site)
        WHERE stop_seq IS NULL OR fetch_seq <= stop_seq""",
    "stream_lang_evidence": f"WITH {KEPT} SELECT site, lang, count(*) AS n FROM kept GROUP BY site, lang",
}
