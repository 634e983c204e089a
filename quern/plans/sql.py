"""The operators in DuckDB SQL, as common table expressions over the driver's tables."""

from __future__ import annotations

from pathlib import Path

from quern.functions import constants as K
from quern.plans import inputs as N

WS = r"\t-\r\x1c-\x1f\x{85}\p{Z}"
EOL = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
STOP = ", ".join(f"'{w}'" for w in K.STOP_WORDS)


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[{WS}]+|[{WS}]+\z', '', 'g')"


def words(x: str) -> str:
    return f"len(regexp_extract_all({x}, '[^{WS}]+'))"


def tokens(x: str) -> str:
    return rf"list_filter(regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]+'), lambda x: regexp_full_match(x, '[a-z]{{2,}}') AND x NOT IN ({STOP}))"


def lines(x: str) -> str:
    return rf"string_split_regex(regexp_replace({x}, '(?:{EOL})\z', ''), '{EOL}')"


def unquote(x: str) -> str:
    return f"trim(trim({x}, '\"'), '''')"


def slug(x: str) -> str:
    a = rf"regexp_replace({strip(f'lower({x})')}, '[^\p{{L}}\p{{N}}_{WS}-]', '', 'g')"
    return f"trim(regexp_replace({a}, '[{WS}_]+', '-', 'g'), '-')"


def key_points(x: str) -> str:
    return f"array_to_string(list_filter(list_transform({lines(x)}, lambda l: {strip('l')}), lambda l: starts_with(l, '- '))[1:5], chr(10))"


def values(rows: list[tuple[int, str]]) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, '{q}')" for i, q in rows) + ") v(qid, question)"


def typed(v: str) -> str:
    return f"CASE WHEN {v} LIKE '[%]' AND length({v}) > 1 THEN list_filter(list_transform(string_split(substr({v}, 2, length({v}) - 2), ','), lambda x: {unquote(strip('x'))}), lambda x: x <> '') WHEN {v} IS NOT NULL THEN [{v}] END"


def gate_list(v: str) -> str:
    s = strip(f"coalesce({v}, '')")
    return f"list_transform(list_filter(string_split(CASE WHEN {s} LIKE '[%]' AND length({s}) > 1 THEN substr({s}, 2, length({s}) - 2) ELSE {s} END, ','), lambda x: {strip('x')} <> ''), lambda x: {unquote(strip('x'))})"


def gate_columns(mode: str) -> str:
    """reject and messages of the scored articles under a mode."""
    w, wr, f, need, s, sr = K.MODES[mode]
    needed = "[" + ", ".join(f"'{x}'" for x in need) + "]"
    missing = f"list_filter({needed}, lambda x: NOT list_contains(keys, x))"
    reject = f"CASE WHEN words < {wr} THEN 'word count ' || words || ' below reject threshold {wr}' WHEN len({missing}) > 0 THEN 'missing required frontmatter: ' || array_to_string({missing}, ', ') WHEN score <= {sr} THEN 'quality score ' || score::VARCHAR || ' at or below reject threshold {sr}' END"
    warn = f"list_filter([CASE WHEN words < {w} THEN 'word count ' || words || ' below minimum {w}' END, CASE WHEN nk < {f} THEN 'only ' || nk || ' frontmatter fields (minimum {f})' END, CASE WHEN score < {s} THEN 'quality score ' || score::VARCHAR || ' below minimum {s}' END], lambda x: x IS NOT NULL)"
    return f"{reject} AS reject, {warn} AS warnings"


def gate(mode: str) -> str:
    return f"SELECT path, reject IS NULL AS accepted, coalesce(reject, array_to_string(warnings, '; ')) AS messages FROM (SELECT path, {gate_columns(mode)} FROM scored)"


def _actions(force: bool) -> str:
    skip = "FALSE" if force else "TRUE"
    return f"""
SELECT coalesce(a.path, s.path) AS path, a.path IS NOT NULL AS on_disk, s.path IS NOT NULL AS known, a.score AS now_score, a.hash AS now_hash, a.mtime AS now_mtime, a.stem, a.title AS now_title, a.warnings, s.title AS old_title, s.hash AS old_hash, s.mtime AS old_mtime, s.score AS old_score, s.source_version AS old_version, a.reject,
    CASE WHEN a.path IS NULL THEN 'delete' WHEN s.path IS NOT NULL AND {skip} AND s.mtime = a.mtime THEN 'skip' WHEN s.path IS NOT NULL AND {skip} AND s.hash = a.hash THEN 'skip'
         WHEN a.reject IS NOT NULL THEN 'reject' WHEN s.path IS NOT NULL THEN 'update' ELSE 'insert' END AS action
FROM gated a FULL JOIN state s ON a.path = s.path"""


_SHOWN = """
SELECT path, action, CASE action WHEN 'delete' THEN 'file_removed' WHEN 'skip' THEN CASE WHEN old_mtime = now_mtime THEN 'mtime_match' ELSE 'same_hash' END WHEN 'reject' THEN reject END AS reason,
    CASE WHEN action IN ('insert', 'update', 'reject') THEN now_score END AS score, CASE WHEN action IN ('insert', 'update') THEN coalesce(old_version, 0) + 1 END AS source_version, warnings"""

NEXT_STATE = f"""
SELECT path, CASE WHEN action = 'skip' THEN old_title ELSE coalesce(now_title, stem) END AS title, CASE WHEN action = 'skip' THEN old_hash ELSE now_hash END AS hash, now_mtime AS mtime,
    CASE WHEN action = 'skip' THEN old_score ELSE now_score END AS score, CASE WHEN action = 'skip' THEN '2026-04-01T00:00:00+00:00' ELSE '{N.RUN_TS}' END AS ingested_at,
    CASE WHEN action = 'skip' THEN old_version ELSE coalesce(old_version, 0) + 1 END AS source_version, CASE WHEN action = 'skip' THEN '' ELSE array_to_string(warnings, '; ') END AS warnings
FROM acted WHERE action IN ('insert', 'update', 'skip')"""

SUMMARY = """
SELECT count(*) FILTER (action <> 'delete') AS scanned, count(*) FILTER (action = 'insert') AS inserted, count(*) FILTER (action = 'update') AS updated, count(*) FILTER (action = 'skip') AS skipped, count(*) FILTER (action = 'delete') AS deleted,
    0::BIGINT AS errors, count(*) FILTER (action = 'reject') AS rejected, count(*) FILTER (action IN ('insert', 'update') AND len(warnings) > 0) AS warned FROM actions"""

#: Written out by hand, not made of the engine's own tables.
MODES = """SELECT * FROM (VALUES
    ('developer', 50, 10, 2, 'title', 0.2::DOUBLE, 0.0::DOUBLE), ('research', 30, 5, 1, 'title', 0.1, 0.0), ('review', 100, 20, 4, 'title,type,tags', 0.4, 0.1),
    ('ops', 30, 5, 2, 'title', 0.2, 0.0), ('personal', 10, 1, 1, 'title', 0.0, 0.0)
) v(mode, min_words, min_words_reject, min_frontmatter_fields, required_frontmatter, min_quality_score, reject_quality_score)"""
#: As they stood when they were last agreed on: a change of the rules has to be made here, too.
RULES = Path(__file__).with_name("rules.sql").read_text(encoding="utf-8")
DOMAINS_JOINED = """
    SELECT project, domain, round(s, 2) AS domain_confidence FROM (
        SELECT project, domain, k, count(DISTINCT word) / any_value(size) AS s
        FROM (SELECT project, string_agg(CASE WHEN length <= 50000 THEN lower(content) ELSE '' END, ' ' ORDER BY n) AS t FROM picked GROUP BY project) JOIN keywords ON contains(t, word) GROUP BY project, domain, k)
    QUALIFY row_number() OVER (PARTITION BY project ORDER BY s DESC, k) = 1"""

CONTENTS = f"""
SELECT slug, CASE WHEN known THEN 'known before' ELSE {strip("heading")} END AS summary, CASE WHEN known THEN 'daily/old.md' ELSE 'daily/' || log_name END AS compiled_from, '{N.RUN_DATE}' AS updated
FROM (SELECT regexp_replace(path, '\\.md$', '') AS slug, bool_or(action = 'update') AS known, arg_min(heading, (log_name, pos)) AS heading, arg_min(log_name, (log_name, pos)) AS log_name FROM upserts WHERE action <> 'skip' GROUP BY path)"""


def search(questions: str, k: int = 5, least: int | None = None, most: int | None = None) -> str:
    keep = " AND ".join([*([f"source_version >= {least}"] if least is not None else []), *([f"source_version <= {most}"] if most is not None else [])]) or "TRUE"
    return f"""
SELECT qid, rank, path, title, summary, round(score, 6) AS score, source_version FROM (
    WITH questions AS ({questions}),
    pool AS (SELECT records.*, norm FROM records LEFT JOIN norms USING (path) WHERE {keep}),
    qt AS (SELECT qid, unnest({tokens("question")}) AS term FROM questions),
    qn AS (SELECT qid, count(*) AS total FROM qt GROUP BY qid),
    qw AS (SELECT qid, term, count(*) / any_value(total) * any_value(idf) AS qw FROM qt JOIN qn USING (qid) JOIN idf USING (term) GROUP BY qid, term),
    qnorm AS (SELECT qid, sqrt(sum(qw * qw)) AS qnorm FROM qw GROUP BY qid),
    dots AS (SELECT qid, path, sum(qw * w) AS dot FROM qw JOIN post USING (term) GROUP BY qid, path),
    every AS (SELECT q.qid, p.path, p.title, p.summary, p.source_version, CASE WHEN coalesce(qnorm, 0) * norm = 0 THEN 0.0::DOUBLE ELSE coalesce(dot, 0) / (qnorm * norm) END AS score
              FROM questions q CROSS JOIN pool p LEFT JOIN dots d ON d.qid = q.qid AND d.path = p.path LEFT JOIN qnorm n ON n.qid = q.qid WHERE p.norm IS NOT NULL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, path) AS rank FROM every),
    good AS (SELECT qid FROM every GROUP BY qid HAVING max(score) >= {K.MIN_SCORE}),
    fresh AS (SELECT *, row_number() OVER (ORDER BY updated DESC, path) AS rank FROM pool)
    SELECT qid, rank, path, title, summary, score, source_version FROM ranked WHERE rank <= {k} AND qid IN (SELECT qid FROM good)
    UNION ALL SELECT qid, rank, path, title, summary, 0.0, NULL::INT FROM questions CROSS JOIN fresh WHERE rank <= {k} AND qid NOT IN (SELECT qid FROM good))"""


def context(searched: str, most: int = K.CONTEXT_CHARS) -> str:
    return f"""
SELECT qid, string_agg(part, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context FROM (
    SELECT qid, rank, CASE WHEN rank = over_rank THEN substr(part, 1, ({most} - before)::BIGINT) || chr(10) || chr(10) || '...(truncated)' ELSE part END AS part, before, over_rank FROM (
        SELECT *, total - length(part) AS before, min(CASE WHEN total > {most} THEN rank END) OVER (PARTITION BY qid) AS over_rank FROM (
            SELECT *, sum(length(part)) OVER (PARTITION BY qid ORDER BY rank) AS total FROM (
                SELECT qid, rank, '## ' || replace(s.path, '.md', '') || CASE WHEN s.score > 0 THEN ' (relevance: ' || printf('%.2f', round(s.score, 2)) || ')' ELSE '' END || chr(10) || chr(10) || content AS part
                FROM ({searched}) s JOIN arts a ON a.path = s.path)))
    WHERE over_rank IS NULL OR rank < over_rank OR (rank = over_rank AND {most} - before > 200)) GROUP BY qid"""


def _issue(severity: str, check: str, file: str, detail: str, fixable: bool, rest: str) -> str:
    return f"SELECT '{severity}' AS severity, '{check}' AS \"check\", {file} AS file, {detail} AS detail, {str(fixable).upper()} AS auto_fixable FROM {rest}"


_ISSUES = " UNION ALL ".join(
    [
        _issue("error", "broken_link", "path", "'Broken link: [[' || link || ']] has no target'", False, "links WHERE link NOT LIKE 'daily/%' AND NOT CASE WHEN contains(link, '/') THEN link IN (SELECT src_link FROM named_arts) ELSE link IN (SELECT stem FROM arts) END"),
        _issue("warning", "orphan_page", "path", "'Orphan page: nothing links to [[' || src_link || ']]'", False, "named_arts WHERE src_link NOT IN (SELECT link FROM links WHERE link NOT LIKE 'daily/%')"),
        _issue("warning", "orphan_source", "'daily/' || log_name", "'Uncompiled log: no article refers to ' || log_name", False, "logs WHERE log_name NOT IN (SELECT log_name FROM refs)"),
        _issue("warning", "stale_article", "'daily/' || log_name", "'Stale: ' || log_name || ' changed after it was compiled'", False, "logs WHERE conv_id % 3 = 2"),
        _issue("suggestion", "missing_backlink", "path", "'[[' || src_link || ']] links to [[' || link || ']], which doesn''t link back'", True, "(SELECT l.*, t.path AS target FROM links l JOIN (SELECT path, src_link AS name FROM named_arts UNION ALL SELECT arg_min(path, list_position(['concepts', 'connections', 'mechanisms', 'outcomes', 'references'], subdir)), stem FROM arts GROUP BY stem) t ON t.name = l.link WHERE l.link NOT LIKE 'daily/%' AND NOT contains(l.link, '..') AND NOT starts_with(l.link, '/')) e WHERE NOT EXISTS (SELECT 1 FROM links b WHERE b.path = e.target AND b.link = e.src_link)"),
        _issue("suggestion", "sparse_article", "path", f"'Sparse article: ' || n || ' words of {K.SPARSE_WORDS} recommended'", False, f"(SELECT path, {words('content')} AS n FROM arts) WHERE n < {K.SPARSE_WORDS}"),
    ]
)

_KEYWORDS = ", ".join(f"('{d}', {k}, '{w}', {len(ws)})" for k, (d, ws) in enumerate(K.DOMAINS.items()) for w in ws)
_LEVELS = ", ".join(f"({k}, '{level}', '{i}')" for k, (level, names) in enumerate(K.MATURITY.items()) for i in names)
_STACK = ", ".join(f"('{n}', '{s}')" for s, names in K.STACK.items() for n in names)
_in = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"


def _type(h: str) -> str:
    return f"CASE WHEN contains({h}, 'connection') OR contains({h}, 'link') THEN 'connection' WHEN contains({h}, 'mechanism') OR contains({h}, 'pattern') THEN 'mechanism' WHEN contains({h}, 'outcome') OR contains({h}, 'result') OR contains({h}, 'validation') THEN 'outcome' WHEN contains({h}, 'reference') OR contains({h}, 'resource') THEN 'reference' ELSE 'concept' END"


CTES = {
    "files": N.FILES_SQL,
    "cut": "SELECT *, split_part(path, '/', 1) AS subdir, regexp_replace(split_part(path, '/', -1), '\\.md$', '') AS stem, CASE WHEN starts_with(content, '---') AND strpos(substr(content, 4), '---') > 0 THEN strpos(substr(content, 4), '---') + 3 ELSE 0 END AS e FROM files",
    "heads": f"SELECT *, CASE WHEN e > 0 THEN substr(content, 4, e - 4) END AS head, CASE WHEN e > 0 THEN {strip('substr(content, e + 3)')} ELSE content END AS body, substr(sha256(content), 1, 16) AS hash FROM cut",
    "kv0": f"SELECT path, unnest({lines(strip('head'))}) AS l, generate_subscripts({lines(strip('head'))}, 1) AS n FROM heads WHERE head IS NOT NULL",
    "kv1": f"SELECT path, n, {strip('l')} AS l FROM kv0 WHERE contains(l, ':')",
    "kv": f"SELECT path, {strip("split_part(l, ':', 1)")} AS k, {unquote(strip("substr(l, strpos(l, ':') + 1)"))} AS v, n FROM kv1 QUALIFY row_number() OVER (PARTITION BY path, {strip("split_part(l, ':', 1)")} ORDER BY n DESC) = 1",
    "fm": "SELECT path, count(*)::INT AS nk, list(k) AS keys, " + ", ".join(f"max(v) FILTER (k = '{c}') AS {c}" for c in ("title", "tags", "aliases", "sources", "updated", "source_version", "summary")) + " FROM kv GROUP BY path",
    "arts": "SELECT h.path, h.doc_id, h.subdir, h.stem, h.content, h.mtime, h.head, h.body, h.hash, coalesce(nk, 0) AS nk, coalesce(keys, []) AS keys, title, tags, aliases, sources, updated, source_version, summary FROM heads h LEFT JOIN fm USING (path)",
    "lists": f"SELECT path, {typed('tags')} AS typed_tags, {gate_list('tags')} AS gate_tags, {gate_list('sources')} AS gate_sources FROM arts",
    "rec0": f"SELECT path, coalesce(title, stem) AS title, coalesce(summary, '') AS summary, coalesce({typed('tags')}, []) AS tags, coalesce({typed('aliases')}, []) AS aliases, coalesce({typed('sources')}, []) AS sources, coalesce(updated, '') AS updated, coalesce(TRY_CAST(coalesce(source_version, '1') AS INT), 1) AS source_version, content FROM arts",
    "records": "SELECT *, concat_ws(' ', title, CASE WHEN len(tags) > 0 THEN array_to_string(tags, ' ') END, CASE WHEN len(aliases) > 0 THEN array_to_string(aliases, ' ') END, CASE WHEN len(sources) > 0 THEN array_to_string(sources, ' ') END, content) AS searchable FROM rec0",
    "links": r"SELECT path, replace(path, '.md', '') AS src_link, unnest(regexp_extract_all(content, '\[{2}([^\]]+)\]{2}', 1)) AS link, generate_subscripts(regexp_extract_all(content, '\[{2}([^\]]+)\]{2}', 1), 1) - 1 AS pos FROM arts",
    "toks": f"SELECT path, {tokens('searchable')} AS ts FROM records",
    "terms": "SELECT path, len(ts) AS total, unnest(ts) AS term FROM toks",
    "tf": "SELECT path, term, count(*) AS n, any_value(total) AS total, count(*) / any_value(total) AS tf FROM terms GROUP BY path, term",
    "idf": "SELECT term, count(*) AS df, ln((SELECT count(*) FROM records) / count(*)) AS idf FROM tf GROUP BY term",
    "post": "SELECT path, term, tf * idf AS w FROM tf JOIN idf USING (term)",
    "norms": "SELECT path, sqrt(sum(w * w)) AS norm FROM post GROUP BY path",
    "scored": rf"SELECT *, {words('body')} AS words, round(((coalesce(title, '') <> '')::INT + (len({gate_list('tags')}) > 0)::INT + (len({gate_list('sources')}) > 0)::INT + ({words('body')} >= 100)::INT + regexp_matches(body, '\[{{2}}([^\]]+)\]{{2}}')::INT) * 0.2::DOUBLE, 1) AS score FROM arts",
    "gated": f"SELECT *, {gate_columns('developer')} FROM scored",
    "state": N.STATE_SQL,
    "acted": _actions(False),
    "actions": f"{_SHOWN} FROM acted",
    "forced": _actions(True),
    "actions_forced": f"{_SHOWN} FROM forced",
    "compared": "SELECT coalesce(a.path, s.path) AS path, CASE WHEN s.path IS NULL THEN 'new' WHEN a.path IS NULL THEN 'orphaned' WHEN a.mtime IS DISTINCT FROM s.mtime THEN 'stale' ELSE 'synced' END AS status FROM arts a FULL JOIN state s ON a.path = s.path",
    "logs": N.LOGS_SQL,
    "hashed_logs": "SELECT *, substr(sha256(content), 1, 16) AS hash FROM logs",
    "parts": f"SELECT log_name, unnest(string_split(chr(10) || array_to_string({lines('content')}, chr(10)), chr(10) || '## ')[2:]) AS part, generate_subscripts(string_split(chr(10) || array_to_string({lines('content')}, chr(10)), chr(10) || '## ')[2:], 1) - 1 AS pos FROM logs",
    "sections": f"SELECT log_name, pos, {strip('split_part(part, chr(10), 1)')} AS heading, {strip('substr(part, CASE WHEN strpos(part, chr(10)) > 0 THEN strpos(part, chr(10)) + 1 ELSE length(part) + 1 END)')} AS body FROM parts",
    "classed": f"SELECT *, {_type('lower(heading)')} AS article_type, {_type('lower(heading)')} || 's' AS subdir, {slug('heading')} AS slug FROM sections WHERE {words('body')} >= {K.SECTION_WORDS}",
    "rendered": f"""SELECT *, subdir || '/' || slug || '.md' AS path, concat_ws(chr(10), '---', 'title: "' || heading || '"', 'type: ' || article_type, 'tags: [' || article_type || ']', 'sources: [daily/' || log_name || ']', 'created: {N.RUN_DATE}', 'updated: {N.RUN_DATE}', 'source_version: 1', 'ingest_date: {N.RUN_DATE}', 'historical_context: "Compiled from daily log ' || log_name || '"', '---') || chr(10) || chr(10) || '## Key Points' || chr(10) || chr(10) || {key_points('body')} || chr(10) || chr(10) || '## Details' || chr(10) || chr(10) || body || chr(10) AS content FROM classed""",
    "there": "SELECT path, arg_max(substr(sha256(content), 1, 16), (log_name, pos)) AS there FROM rendered WHERE log_name IN (SELECT log_name FROM logs WHERE conv_id % 3 = 1) GROUP BY path",
    "up0": "SELECT *, substr(sha256(content), 1, 16) AS hash, coalesce(lag(substr(sha256(content), 1, 16)) OVER (PARTITION BY path ORDER BY log_name, pos), there) AS before, row_number() OVER (PARTITION BY path ORDER BY log_name DESC, pos DESC) = 1 AS final FROM rendered LEFT JOIN there USING (path)",
    "upserts": "SELECT *, CASE WHEN before IS NULL THEN 'create' WHEN before = hash THEN 'skip' ELSE 'update' END AS action FROM up0",
    "named_arts": "SELECT *, replace(path, '.md', '') AS src_link FROM arts",
    "refs": rf"SELECT DISTINCT unnest(regexp_extract_all(l, 'daily/([^\x5D]+)\x5D', 1)) AS log_name FROM (SELECT unnest(list_filter(list_transform({lines('head')}, lambda x: {strip('x')}), lambda x: starts_with(x, 'sources:'))) AS l FROM arts WHERE head IS NOT NULL)",
    "issues": _ISSUES,
    "topics": f"SELECT DISTINCT topic FROM (SELECT title AS topic FROM arts UNION ALL SELECT unnest(CASE WHEN tags LIKE '[%' THEN {typed('tags')} END) FROM arts) WHERE topic IS NOT NULL",
    "pfiles": N.PROJECTS_SQL,
    "projects": f"SELECT project FROM pfiles WHERE NOT contains(rel_path, '/') AND NOT starts_with(project, '.') GROUP BY project HAVING bool_or(name IN {_in(K.MARKERS)} OR name LIKE '%.ipynb') OR count(*) FILTER (name LIKE '%.py') >= 2 ORDER BY project LIMIT 50",
    "picked": f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY rel_path) AS n FROM pfiles WHERE suffix IN {_in(K.SUFFIXES)}) WHERE n <= 200",
    "keywords": f"SELECT * FROM (VALUES {_KEYWORDS}) v(domain, k, word, size)",
    "dom0": "SELECT project, domain, k, count(DISTINCT word) / any_value(size) AS s FROM picked JOIN keywords ON contains(CASE WHEN length <= 50000 THEN lower(content) ELSE '' END, word) GROUP BY project, domain, k",
    "domains": "SELECT project, domain, round(s, 2) AS domain_confidence FROM dom0 QUALIFY row_number() OVER (PARTITION BY project ORDER BY s DESC, k) = 1",
    "levels": f"SELECT * FROM (VALUES {_LEVELS}) v(k, level, name)",
    "mat0": "SELECT project, min(k) AS k FROM pfiles JOIN levels ON CASE WHEN levels.name LIKE '%/' THEN contains('/' || rel_path || CASE WHEN contains(rel_path, '/') THEN '' ELSE '/' END, '/' || levels.name) ELSE contains('/' || rel_path || '/', '/' || levels.name || '/') END GROUP BY project",
    "maturity": f"SELECT project, coalesce(({list(K.MATURITY)!r})[k + 1], 'unknown') AS maturity FROM (SELECT DISTINCT project FROM pfiles) LEFT JOIN mat0 USING (project)",
    "stacks": f"SELECT p.project, coalesce(s, ['unknown']) AS tech_stack FROM (SELECT DISTINCT project FROM pfiles) p LEFT JOIN (SELECT project, list_sort(list(DISTINCT stack)) AS s FROM pfiles JOIN (VALUES {_STACK}) v(n, stack) ON n = name AND NOT contains(rel_path, '/') GROUP BY project) q ON p.project = q.project",
    "modified": "SELECT project, strftime(to_timestamp(max(mtime)) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S+00:00') AS last_modified FROM pfiles GROUP BY project",
    "summaries": f"SELECT project, split_part(substr(CASE WHEN length <= 2000 THEN content ELSE '' END, 1, 500), chr(10), 1) AS summary FROM pfiles WHERE NOT contains(rel_path, '/') AND name IN {_in(K.READMES)} QUALIFY row_number() OVER (PARTITION BY project ORDER BY list_position({K.READMES!r}, name)) = 1",
    "over0": "SELECT project, count(DISTINCT topic) AS hits FROM picked JOIN topics ON contains(CASE WHEN length <= 10000 THEN lower(content) ELSE '' END, lower(topic)) WHERE n <= 100 GROUP BY project",
    "shares": "SELECT project, round(coalesce(hits, 0) / (SELECT count(*) FROM topics), 2) AS topic_overlap FROM (SELECT DISTINCT project FROM picked) LEFT JOIN over0 USING (project)",
    "meta": "SELECT p.project AS name, coalesce(domain, 'unknown') AS domain, coalesce(domain_confidence, 0.0) AS domain_confidence, maturity, tech_stack, last_modified, coalesce(topic_overlap, 0.0) AS topic_overlap, coalesce(c.n, 0)::INT AS file_count, coalesce(summary, '') AS summary FROM projects p LEFT JOIN domains USING (project) LEFT JOIN maturity USING (project) LEFT JOIN stacks USING (project) LEFT JOIN modified USING (project) LEFT JOIN shares USING (project) LEFT JOIN summaries USING (project) LEFT JOIN (SELECT project, count(*) AS n FROM picked GROUP BY project) c USING (project)",
    "pointed": "SELECT *, CASE WHEN domain_confidence >= 0.3 THEN 2 WHEN domain_confidence > 0 THEN 1 ELSE 0 END + CASE WHEN maturity IN ('production', 'beta') THEN 2 WHEN maturity = 'alpha' THEN 1 ELSE 0 END + (tech_stack <> ['unknown'])::INT + (topic_overlap >= 0.2)::INT + (file_count >= 20)::INT AS points FROM meta",
    "scanned": "SELECT *, CASE WHEN points >= 6 THEN 1 WHEN points >= 4 THEN 2 WHEN points >= 2 THEN 3 WHEN points >= 1 THEN 4 ELSE 5 END AS suggested_priority, coalesce(nullif(concat_ws('; ', CASE WHEN domain_confidence >= 0.3 THEN 'strong domain signal (' || domain || ')' WHEN domain_confidence > 0 THEN 'weak domain signal (' || domain || ')' END, CASE WHEN maturity IN ('production', 'beta', 'alpha') THEN maturity || '-level maturity' END, CASE WHEN tech_stack <> ['unknown'] THEN 'known stack: ' || array_to_string(tech_stack, ', ') END, CASE WHEN topic_overlap >= 0.2 THEN 'high topic overlap with existing KB' END, CASE WHEN file_count >= 20 THEN 'substantial file count' END), ''), 'no strong signals') AS priority_rationale FROM pointed",
}


def whole(sql: str) -> str:
    """The statement with all expressions that it may use before it."""
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in CTES.items()) + "\n" + sql
