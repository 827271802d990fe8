"""SQL for DuckDB that must give the same rows as the queries of the same name."""

from __future__ import annotations

from hirelake.functions import predicates as P
from hirelake.functions import text as T
from hirelake.plans import instants as I
from hirelake.plans.funnel import TOTALS
from hirelake.plans.queries import FUNNEL_KEYS, NOW, ROLE_WORDS, SCANNED, SKILLS, SUMMARY_STEPS

_LIST = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_TS = f"TIMESTAMPTZ '{NOW}+00'"
_NOW_US = f"epoch_us({_TS})"
_DAY = 86_400_000_000


_STRIP = lambda c: f"regexp_replace({c}, '^{T.SPACE}+|{T.SPACE}+$', '', 'g')"
_COLLAPSE = lambda c: f"trim(regexp_replace({c}, '{T.SPACE}+', ' ', 'g'))"


def _company(c: str) -> str:
    suffix = rf",?\s*\b({'|'.join(T.LEGAL_SUFFIXES)})\.?(\s|$)"
    # white space doubled first, so that two suffixes in a row do not share the space between them
    return f"lower({_COLLAPSE(f"regexp_replace(regexp_replace(coalesce({c}, ''), '{T.SPACE}+', '  ', 'g'), '{suffix}', '\\2', 'gi')")})"


def _title(c: str) -> str:
    return "lower(" + _COLLAPSE(rf"regexp_replace(regexp_replace(coalesce({c}, ''), '\(.*?\)', '', 'g'), '\s*[-–|].*$', '')") + ")"


_KEY = f"{_company('company')} || '|' || {_title('title')}"
_POST = "p AS (SELECT ord, url, title, company, location, description_snippet AS description, sources[1] AS source, date_posted FROM job_cache)"
_TOKENS = rf"list_distinct(regexp_split_to_array(lower(coalesce(title, '')), '{T.TITLE_SPLIT}'))"
_CACHE = (
    f"{I.of_boards('expires_at')}, c AS (SELECT j.ord, dedup_key, url, fetched_at, description_snippet, i.utc_us AS expires_us, assessment IS NOT NULL AS assessed, coalesce(assessment.is_relevant, true) AS relevant, assessment.score::BIGINT AS score "
    "FROM job_cache j JOIN instant i ON i.id.ord = j.ord)"
)
_EXPIRED = f"CASE WHEN expires_us IS NOT NULL THEN {_NOW_US} > expires_us ELSE ({_NOW_US} - epoch_us(fetched_at)) // {_DAY} > 14 END"
_YEARS = "regexp_extract_all(coalesce(description, ''), '" + T.YEARS.removeprefix("(?i)") + "', 1, 'i')"
_CLOSED = "regexp_matches(coalesce(description, ''), '" + P.CLOSED_PATTERN.removeprefix("(?i)") + "', 'i')"
_PRESENT = f"CASE WHEN lower({_STRIP("coalesce(company, '')")}) = 'nan' THEN '' ELSE {_STRIP("coalesce(company, '')")} END"
_SKILL = "(" + " OR ".join(f"contains(lower(coalesce(description, '')), '{s}')" for s in SKILLS) + ")"
_RELEVANT = f"list_has_any({_TOKENS}, {_LIST(ROLE_WORDS)})"
_MORE_YEARS = lambda n: f"coalesce(list_bool_or([try_cast(y AS HUGEINT) > {n} FOR y IN {_YEARS}]), false)"


def _level(level: str) -> str:
    ok = f"NOT list_has_any({_TOKENS}, {_LIST(P.REJECTED[level])})"
    if level == "mid":
        ok += "".join(f" AND NOT contains(lower(coalesce(title, '')), '{x}')" for x in P.MID_PHRASES)
    return ok


def _value(expression: str) -> str:
    return f"WITH {_POST} SELECT ord, {expression} AS value FROM p"


def _kept(condition: str) -> str:
    return f"WITH {_POST} SELECT ord FROM p WHERE {condition}"


_SQUEEZE = lambda c: _STRIP(rf"regexp_replace({c}, '\n{{3,}}', chr(10) || chr(10), 'g')")


def _references(c: str) -> str:
    """Character references read: numbers first, then names, the ampersand last."""
    numbers = f"list_distinct([n FOR n IN regexp_extract_all({c}, '&#(0{{0,4}}[1-9]\\d{{0,5}});', 1) IF n::BIGINT <= 1114111 AND n::BIGINT NOT BETWEEN 55296 AND 57343 AND n::BIGINT <> 38])"
    text = f"list_reduce(list_prepend({c}, {numbers}), lambda t, n: replace(t, '&#' || n || ';', chr(n::INTEGER)))"
    for name, char in T.ENTITIES.items():
        text = f"replace({text}, '&{name};', '{char.replace(chr(39), chr(39) * 2)}')"
    return f"CASE WHEN contains({c}, '&') THEN replace(replace({text}, '&#38;', '&amp;'), '&amp;', '&') ELSE {c} END"


_DROPPED = r"(?is)<!--.*?-->|" + "|".join(rf"<{t}\b[^>]*>.*?</{t}\s*>" for t in ("script", "style", "template"))
_TAGLESS = rf"regexp_replace(regexp_replace(regexp_replace(description, '{_DROPPED}', '', 'g'), '<(?:p|li|br|h[1-4])\b[^>]*>', chr(10), 'gi'), '</?[a-zA-Z][^>]*>', '', 'g')"
_HTML = f"(SELECT {_SQUEEZE(_references('h'))} FROM (SELECT {_TAGLESS} AS h))"
_CASED = lambda c: rf"array_to_string([upper(w[1]) || w[2:] FOR w IN regexp_extract_all(lower({c}), '\p{{L}}+|\P{{L}}+')], '')"
_PLACE = rf"regexp_replace(regexp_replace(coalesce(location, ''), ',\s*[A-Z]{{2}}\s*$', ', Ireland'), ',\s*[A-Z]\s*(,)', '\1', 'g')"
_RATE = lambda a, b: f"CASE WHEN coalesce({b}, 0) = 0 THEN 0.0::DOUBLE ELSE round(CAST({a} AS DOUBLE) * 100.0 / {b}, 1) END"
_FUNNEL = "f AS (SELECT id, " + ", ".join(f"coalesce(try_cast(json_extract_string(funnel, '$.{k}') AS BIGINT), 0) AS {k}" for k in FUNNEL_KEYS) + " FROM search_stats)"
_RATES = {
    "filter_rate": _RATE("scraped_total - saved", "scraped_total"),
    "llm_pass_rate": _RATE("llm_assessed - llm_rejected", "llm_assessed"),
    "llm_title_pass_rate": _RATE("title_filter_passed", "title_filter_in"),
}
_SEEN = (
    f"{_POST}, k AS (SELECT *, {_KEY} AS key FROM p), u AS (SELECT *, coalesce(url, '') <> '' AND row_number() OVER (PARTITION BY url ORDER BY ord) = 1 AND {_STRIP("coalesce(title, '')")} <> '' AS ok FROM k), "
    "m AS (SELECT *, NOT ok OR row_number() OVER (PARTITION BY ok, key ORDER BY ord) > 1 AS dup FROM u)"
)
_MATCHED_IN = lambda c: " + ".join(f"contains(lower(coalesce({c}, '')), '{s}')::BIGINT" for s in SKILLS)
_GAP_IN = lambda c, n: f"greatest(coalesce(list_max([CASE WHEN length(y) <= 4 THEN y::BIGINT ELSE 9999 END FOR y IN {_YEARS.replace('description', c)}]), 0) - {n}, 0)"
# a record of the store is found by the url of the posting, the first of several; live it is a hit if assessed, else it is assessed anew
_REASONS = (
    f"{_SEEN}, {_CACHE}, hit AS (SELECT url AS hit_url, expires_us, fetched_at, assessed, relevant, description_snippet AS cached FROM c WHERE url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY url ORDER BY ord) = 1), "
    f"a AS (SELECT m.*, hit.assessed, hit.relevant, hit.cached, coalesce(NOT ({_EXPIRED}), false) AND hit_url IS NOT NULL AS live FROM m LEFT JOIN hit ON hit_url = m.url), "
    f"r0 AS (SELECT *, CASE WHEN dup THEN 'dup' WHEN NOT ({_level('mid')}) THEN 'seniority' WHEN NOT {_RELEVANT} THEN 'irrelevant' "
    f"WHEN live AND assessed THEN 'cache_hit' WHEN live THEN 'cache_patch' WHEN {_STRIP("coalesce(description, '')")} = '' THEN 'no_desc' "
    f"WHEN {_CLOSED} THEN 'closed' WHEN {_MORE_YEARS(10)} THEN 'exp' WHEN NOT {_SKILL} THEN 'skill' ELSE 'pending' END AS reason FROM a), "
    "r1 AS (SELECT *, CASE reason WHEN 'pending' THEN description WHEN 'cache_patch' THEN cached END AS scored FROM r0), "
    f"r2 AS (SELECT *, {_MATCHED_IN('scored')} AS hits, {_GAP_IN('scored', 10)} AS gap FROM r1), "
    "r AS (SELECT *, CASE WHEN reason IN ('pending', 'cache_patch') THEN CASE WHEN hits > 0 AND gap <= 5 THEN 'saved' ELSE 'llm_rejected' END WHEN reason = 'cache_hit' AND relevant THEN 'saved' ELSE reason END AS outcome, "
    "CASE WHEN reason IN ('pending', 'cache_patch') THEN least(hits * 2 + 2, CASE WHEN gap > 5 THEN 3 WHEN gap > 2 THEN 5 ELSE 10 END)::BIGINT END AS new_score FROM r2)"
)
_STEPS = ["dup", "seniority", "irrelevant", "cache_hit", "no_desc", "closed", "exp", "skill"]
_BY_SOURCE = (
    "s AS (SELECT CASE WHEN grouping(src) = 1 THEN '*' ELSE src END AS source, count(*) AS n_in, " + ", ".join(f"count_if(reason = '{s}')::BIGINT AS {s}" for s in _STEPS)
    + ", count_if(reason = 'pending' AND outcome = 'llm_rejected')::BIGINT AS llm_rejected, count_if(reason = 'pending' AND outcome = 'saved')::BIGINT AS saved "
    "FROM (SELECT *, coalesce(nullif(source, ''), 'unknown') AS src FROM r) GROUP BY GROUPING SETS ((src), ()))"
)
_SESSION_KEYS = "(SELECT unnest(job_dedup_keys) AS k FROM search_sessions)"
_URLS = f"x AS (SELECT {_KEY} AS key, unnest(list_concat([url], coalesce([s.url FOR s IN raw_sources], []))) AS url FROM job_cache), v AS (SELECT url, count(DISTINCT key) AS n_keys FROM x WHERE coalesce(url, '') <> '' GROUP BY url HAVING count(DISTINCT key) > 1)"
# the store after its rows and then those of the batch were saved one after another; the batch are rows of ord % 3 = 0
_SAVED = (
    "o AS (SELECT *, row_number() OVER (PARTITION BY dedup_key ORDER BY ord % 3 = 0, ord) AS rn, count(*) OVER (PARTITION BY dedup_key) AS n FROM job_cache WHERE dedup_key IS NOT NULL), "
    "s1 AS (SELECT dedup_key, s, min((rn, p)) AS pos FROM (SELECT dedup_key, rn, unnest(sources) AS s, generate_subscripts(sources, 1) AS p FROM o) GROUP BY 1, 2), s2 AS (SELECT dedup_key, list(s ORDER BY pos) AS all_sources FROM s1 GROUP BY 1), "
    "e1 AS (SELECT dedup_key, rn, unnest(raw_sources) AS e, generate_subscripts(raw_sources, 1) AS p FROM o), e2 AS (SELECT *, coalesce(e.source, '') AS s, min(rn) OVER (PARTITION BY dedup_key, coalesce(e.source, '')) AS opens FROM e1), "
    "e3 AS (SELECT dedup_key, string_agg(s, '|' ORDER BY rn, p) AS entries FROM e2 WHERE rn = opens GROUP BY 1), "
    "f1 AS (SELECT dedup_key, arg_max(expires_at, rn) FILTER (expires_at IS NOT NULL) AS expires_at, arg_max(assessment.score, rn) FILTER (assessment IS NOT NULL) AS score FROM o GROUP BY 1)"
)
_NEWEST = f"{_CACHE}, w AS (SELECT * FROM (SELECT * FROM c ORDER BY fetched_at DESC, ord DESC LIMIT 200) WHERE NOT ({_EXPIRED}))"
_BASE = r"trim(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(lower(canonical), '\(.*?\)', '', 'g'), '\s*[-–|,/].*$', ''), '" + T.SPACE + r"+', ' ', 'g')), '^(?:(?:senior|sr\.?|snr|junior|jr\.?|lead|principal|graduate|trainee|interim) )+', ''))"
_NOISY = r"(regexp_matches(canonical, '^.+,\s*.+\s+(?:&|and)\s+.+', 'i') OR len(regexp_split_to_array(trim(canonical), '\s+')) > 8 OR cnt <= 1)"
_BATCHED = f"{_POST}, b AS (SELECT *, (row_number() OVER (ORDER BY ord) - 1) // 8 AS batch, (row_number() OVER (ORDER BY ord) - 1) % 8 + 1 AS slot FROM p)"
_DOMAIN = r"regexp_replace(regexp_extract(coalesce(url, ''), '^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)', 1), '^www\.', '')"
_TOKENS_OF = lambda c: rf"list_sort(list_distinct([w FOR w IN regexp_split_to_array(lower(array_to_string(coalesce({c}, []), ',')), '[\s/\-,]+') IF length(w) > 1]))"
# a text as a JSON string of ASCII letters
_ASCII = lambda c: (
    "'\"' || list_reduce(list_prepend(replace(replace(replace(replace(replace(" + c + ", '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t'), "
    "list_distinct(regexp_extract_all(" + c + ", '[^\\x{20}-\\x{7f}\\n\\r\\t]'))), lambda t, ch: replace(t, ch, CASE WHEN unicode(ch) < 65536 THEN printf('\\u%04x', unicode(ch)) "
    "ELSE printf('\\u%04x\\u%04x', 55296 + (unicode(ch) - 65536) // 1024, 56320 + (unicode(ch) - 65536) % 1024) END)) || '\"'"
)
_SCAN = (
    f"{_POST}, q AS (SELECT * FROM p WHERE coalesce(url, '') <> '' AND source IN ('{SCANNED[0]}', '{SCANNED[1]}')), v AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY url ORDER BY source <> '{SCANNED[0]}', ord) = 1), "
    f"z AS (SELECT *, len(list_intersect({_TOKENS}, {_LIST(ROLE_WORDS)})) > 0 AS passed FROM v)"
)
_REPORT = lambda rows: (
    f"g AS ({rows}), gx AS (SELECT {_KEY} AS key, unnest(list_concat([url], coalesce([s.url FOR s IN raw_sources], []))) AS url FROM g), gv AS (SELECT url FROM gx WHERE coalesce(url, '') <> '' GROUP BY url HAVING count(DISTINCT key) > 1), "
    f"gd AS (SELECT {_KEY} AS key FROM g GROUP BY 1 HAVING count(*) > 1), rep AS (SELECT (SELECT count(*) FROM g) AS total, (SELECT count(*) FROM gd) AS l1, (SELECT count(*) FROM gv) AS l2)"
)
_LEFT = lambda kept: " UNION ALL ".join(
    f"SELECT '{t}' AS store, " + (f"(SELECT count(*) FROM {t})" if t in kept else "0::BIGINT") + " AS n" for t in ("job_cache", "search_sessions", "failed_urls", "title_groups", "url_visits", "search_stats")
)

_DISTINCT = lambda a: f"[x FOR x, i IN {a} IF list_position({a}, x) = i]"
_MATCHED = " + ".join(f"contains(lower(coalesce(description, '')), '{s}')::BIGINT" for s in SKILLS)
_GAP = f"greatest(coalesce(list_max([CASE WHEN length(y) <= 4 THEN y::BIGINT ELSE 9999 END FOR y IN {_YEARS}]), 0) - 5, 0)"
_SCORE = f"least(({_MATCHED}) * 2 + 2, CASE WHEN {_GAP} > 5 THEN 3 WHEN {_GAP} > 2 THEN 5 ELSE 10 END)"

_WORDS = lambda r: rf"list_distinct([w FOR w IN regexp_split_to_array(lower({r}), '\s+') IF w <> ''])"
_WITHIN = lambda a, b: f"list_has_all({_WORDS(b)}, {_WORDS(a)})"
_CONDENSED = (
    r"WITH o AS (SELECT session_key, list_sort([{'n': len(regexp_split_to_array(trim(r), '\s+')), 'i': i, 'r': r} FOR r, i IN coalesce(roles, []) IF r IS NOT NULL]) AS l FROM search_sessions), "
    f"c AS (SELECT session_key, list_reduce(list_prepend(CAST([] AS VARCHAR[]), [[x.r] FOR x IN l]), lambda acc, x: CASE WHEN len(acc) >= 3 OR len([s FOR s IN acc IF {_WITHIN('x[1]', 's')} OR {_WITHIN('s', 'x[1]')}]) > 0 THEN acc ELSE list_concat(acc, x) END) AS w FROM o) "
    "SELECT session_key, array_to_string(w, '|') AS words FROM c"
)

ORACLES: dict[str, str] = {
    "fn12_skill_tokens": r"SELECT session_key, array_to_string(list_sort(list_distinct([w FOR w IN regexp_split_to_array(lower(array_to_string(coalesce(roles, []), ',')), '[\s/\-,]+') IF length(w) > 1])), ' ') AS tokens FROM search_sessions",
    "fn16_lenient_dates": "WITH " + I.instants(r"SELECT ord AS id, date_posted AS value, 'UTC' AS tz, CASE WHEN regexp_matches(date_posted, '^\s*(?:1[3-9]|2\d|3[01])[/-]\d{1,2}[/-]') THEN 'en-IE' ELSE 'en-US' END AS locale, fetched_at AS anchor FROM job_cache") + " SELECT id AS ord, utc_us FROM instant",
    "fn20_cache_key": "SELECT group_id, split_part(cache_key, '::', 1) || '::' || array_to_string(list_sort(string_split(split_part(cache_key, '::', 2), ',')), '_') AS own_key FROM title_groups",
    "fn24_json_arrays": "SELECT id, array_to_string(roles, '|') AS roles, len(roles)::BIGINT AS n FROM search_stats",
    "fn26_flat_assessment": "SELECT ord, assessment.score::BIGINT AS score, assessment.is_relevant AS is_relevant, " + ", ".join(f"array_to_string(assessment.{c}, '|') AS {c}" for c in ("matched_keywords", "strengths", "weaknesses")) + " FROM job_cache",
    "fn27_score_bars": "SELECT ord, repeat('#', assessment.score) || repeat('.', 10 - assessment.score) AS bar FROM job_cache WHERE assessment IS NOT NULL",
    "fn31_funnel_rates": f"WITH {_FUNNEL} SELECT id, " + ", ".join(f"{v} AS {k}" for k, v in _RATES.items()) + " FROM f",
    "fn32_summary_lines": f"WITH {_FUNNEL}, t AS (SELECT *, " + ", ".join(f"{v} AS {k}" for k, v in _RATES.items()) + ", concat_ws(' | ', " + ", ".join(f"CASE WHEN {k} > 0 THEN '{label}:' || {k} END" for k, label in SUMMARY_STEPS.items()) + ") AS steps FROM f) SELECT id, concat_ws(chr(10), 'Scan: ' || scraped_first || ' + ' || scraped_second || ' = ' || scraped_total, CASE WHEN title_filter_in > 0 THEN 'Titles: ' || title_filter_in || ' -> ' || title_filter_passed || ', out ' || title_filter_out || printf(' (%.1f%%)', llm_title_pass_rate) END, 'Prefilter: ' || prefilter_in || ' in' || CASE WHEN steps <> '' THEN ' (' || steps || ')' ELSE '' END, 'Assessed: ' || llm_assessed || ', rejected ' || llm_rejected || CASE WHEN llm_assessed > 0 THEN printf(', passed %.1f%%', llm_pass_rate) ELSE '' END, 'Saved: ' || saved || ' of ' || scraped_total || printf(', filtered %.1f%%', filter_rate)) AS lines FROM t",
    "fn36_card_lines": "SELECT ord, 'id=' || ord || ' | title=' || coalesce(title, '') || ' | company=' || coalesce(company, '') || ' | location=' || coalesce(location, '') AS value FROM job_cache",
    "pred_11_expired_sessions": f"SELECT session_key FROM search_sessions WHERE {_NOW_US} - epoch_us(created_at) > 24 * 3600000000",
    "pred_14_threshold": f"WITH {_POST} SELECT ord FROM p WHERE {_SCORE} >= 6",
    "pred_18_models": "SELECT id FROM search_stats WHERE coalesce(model, '') <> '' AND NOT regexp_matches(model, '" + "|".join(P.NOT_CHAT_IDS) + "', 'i') AND NOT regexp_matches(concat_ws(' ', provider, model), '" + "|".join(P.NOT_CHAT_NAMES) + "', 'i')",
    "jn02_own_or_collected": f"WITH {_POST}, k AS (SELECT *, {_KEY} AS key FROM p), g AS (SELECT key, source, min(ord) AS o FROM k WHERE source IS NOT NULL GROUP BY 1, 2), a AS (SELECT key, string_agg(source, '|' ORDER BY o) AS s FROM g GROUP BY 1) SELECT ord, coalesce(a.s, source) AS sources FROM k LEFT JOIN a USING (key)",
    "jn08_passing_ids": f"WITH {_POST} SELECT ord FROM p WHERE {_MATCHED} > 0 AND {_GAP} <= 5",
    "a08_tokens_of_named": "SELECT sum(tokens_in)::BIGINT AS tokens_in, sum(tokens_out)::BIGINT AS tokens_out FROM search_stats WHERE coalesce(provider, '') <> ''",
    "a11_rejection_alarm": "SELECT sources[1] AS board, count(*) AS n, count_if(NOT assessment.is_relevant)::BIGINT AS rejected, count(*) >= 5 AND count_if(NOT assessment.is_relevant) >= 0.9 * count(*) AS alarm FROM job_cache WHERE assessment IS NOT NULL GROUP BY 1",
    "a12_distinct_words": rf"SELECT DISTINCT w AS word FROM (SELECT unnest(regexp_split_to_array(lower(canonical), '[\s/\-]+')) AS w FROM title_groups) WHERE length(w) > 1 AND NOT list_contains({_LIST(T.ROLE_STOPWORDS)}, w)",
    "a14_affected": f"SELECT count(*) AS n FROM job_cache WHERE dedup_key IN {_SESSION_KEYS}",
    "l04_assessed_view": f"WITH {_NEWEST} SELECT row_number() OVER (ORDER BY score DESC, fetched_at DESC, ord DESC) AS place, ord, score FROM w WHERE assessed",
    "l06_top_models": "SELECT row_number() OVER (ORDER BY model DESC) AS place, model FROM (SELECT DISTINCT model FROM search_stats WHERE coalesce(model, '') <> '' ORDER BY model DESC LIMIT 6)",
    "l10_groups_by_count": "SELECT group_id, dense_rank() OVER (PARTITION BY cache_key ORDER BY cnt DESC) AS place FROM title_groups",
    "l13_slices": "SELECT ord, array_to_string(coalesce(sources, [])[1:2], '|') AS sources, array_to_string(coalesce(assessment.matched_keywords, [])[1:4], '|') AS keywords, array_to_string(coalesce(assessment.strengths, [])[1:10], '|') AS strengths FROM job_cache",
    "u02_union_of_roles": "WITH h AS (" + " UNION ALL ".join(f"SELECT {i} AS part, url, ord FROM job_cache WHERE url IS NOT NULL AND contains(lower(coalesce(title, '')), '{w}')" for i, w in enumerate(ROLE_WORDS[:3])) + ") SELECT url, ord FROM h QUALIFY row_number() OVER (PARTITION BY url ORDER BY part, ord) = 1",
    "u05_shared_words": f"SELECT ord, array_to_string(list_sort(list_intersect({_TOKENS}, {_LIST(ROLE_WORDS)})), ' ') AS words FROM job_cache",
    "u06_first_keys": "SELECT dedup_key, min(ord) AS ord FROM job_cache GROUP BY 1",
    "u08_added_roles": f"SELECT session_key, array_to_string({_DISTINCT("list_append(coalesce(roles, []), 'Barista')")}, '|') AS roles FROM search_sessions",
    "snk03_merge_source": f"SELECT ord, array_to_string(CASE WHEN dedup_key IN {_SESSION_KEYS} AND NOT list_contains(coalesce(sources, []), 'archive.example') THEN list_append(coalesce(sources, []), 'archive.example') ELSE sources END, '|') AS sources FROM job_cache",
    "snk04_session_upsert": "SELECT session_key, location, CASE WHEN coalesce(len(job_dedup_keys), 0) > 2 THEN 0 ELSE coalesce(len(job_dedup_keys), 0) END::BIGINT AS n, epoch_us(created_at) + (coalesce(len(job_dedup_keys), 0) > 2)::BIGINT AS at FROM search_sessions",
    "snk09_write_assessments": "WITH f AS (SELECT dedup_key, min(ord) % 11 AS fresh FROM job_cache WHERE assessment IS NULL GROUP BY 1) SELECT ord, coalesce(fresh, assessment.score::BIGINT) AS score FROM job_cache LEFT JOIN f USING (dedup_key)",
    "t02_live_by_ttl": f"SELECT cache_key, max(epoch_us(cached_at)) >= {_NOW_US} - 7 * {_DAY} AS live FROM title_groups GROUP BY 1",
    "fn01_company_key": _value(_company("company")),
    "fn02_title_key": _value(_title("title")),
    "fn03_posting_key": _value(_KEY),
    "fn04_clean_location": _value(_STRIP(_CASED(_PLACE))),
    "fn05_first_word": _value(r"lower(coalesce(nullif(regexp_split_to_array(trim(coalesce(location, '')), '\s+')[1], ''), 'ireland'))"),
    "fn06_html_text": _value(f"md5({_HTML})"),
    "fn07_squeeze_lines": _value(f"md5({_SQUEEZE('description')})"),
    "fn08_prefixes": f"WITH {_POST} SELECT ord, " + ", ".join(f"md5(substring(description, 1, {n})) AS p{n}" for n in (70, 1000, 8000, 15000)) + " FROM p",
    "fn09_present_company": _value(_PRESENT),
    "fn10_title_tokens": _value(f"array_to_string(list_sort({_TOKENS}), ' ')"),
    "fn11_role_words": rf"SELECT role_id, array_to_string(list_sort(list_distinct([w FOR w IN regexp_split_to_array(lower(role), '[\s/\-]+') IF length(w) > 1 AND NOT list_contains({_LIST(T.ROLE_STOPWORDS)}, w)])), ' ') AS words FROM role_list",
    "fn13_required_years": _value(f"array_to_string({_YEARS}, ' ')"),
    "fn14_deadline": "SELECT ord, CASE WHEN coalesce(expires_at, '') <> '' THEN expires_at ELSE nullif(regexp_extract(substring(" + _STRIP("coalesce(description_snippet, '')") + ", 1, 1000), '" + T.DEADLINE.removeprefix("(?i)") + "', 1, 'i'), '') END AS value FROM job_cache",
    "fn15_domain": _value(r"regexp_replace(regexp_extract(coalesce(url, ''), '^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)', 1), '^www\.', '')"),
    "fn17_json_in_text": "SELECT id, try_cast(json_extract_string(funnel, '$.saved') AS BIGINT) AS saved FROM search_stats",
    "fn18_session_key": "SELECT session_key, md5('{\"location\": ' || " + _ASCII(_STRIP("lower(coalesce(location, ''))")) + " || ', \"roles\": [' || array_to_string([" + _ASCII("x") + " FOR x IN list_sort([y FOR y IN coalesce(roles, []) IF y IS NOT NULL])], ', ') || '], \"seniority\": ' || " + _ASCII("coalesce(seniority, '')") + " || ', \"sources\": [" + ", ".join(f'\"{x}\"' for x in sorted(SCANNED)) + "]}') AS own_key FROM search_sessions",
    "fn19_text_hash": "SELECT doc_id, sha256(text) AS sha FROM documents",
    "fn21_rates": f"WITH {_FUNNEL} SELECT id, {_RATES['filter_rate']} AS filter_rate FROM f",
    "fn28_bars": "SELECT group_id, repeat('#', CAST(least(floor(cnt / 5), 20) AS BIGINT)) AS bar FROM title_groups",
    "fn29_file_name": _value(r"substring(regexp_replace(title, '[^\p{L}\p{N} _-]', '_', 'g'), 1, 50)"),
    "fn33_shortened": _value("CASE WHEN length(title) > 20 THEN substring(title, 1, 20) || '...' ELSE title END"),
    "fn34_status": f"SELECT ord, CASE WHEN {_CLOSED.replace('description', 'description_snippet')} THEN 'closed' WHEN coalesce(is_complete, false) THEN 'complete' ELSE 'incomplete' END AS value FROM job_cache",
    **{f"pred_01_{level}": _kept(_level(level)) for level in ("new_grad", "junior", "mid", "senior")},
    "pred_02_relevant": _kept(_RELEVANT),
    "pred_03_more_years": _kept(_MORE_YEARS(10)),
    "pred_04_closed": _kept(_CLOSED),
    "pred_05_inactive": _kept("regexp_matches(coalesce(description, ''), '" + P.INACTIVE_PATTERN.removeprefix("(?i)") + "', 'i')"),
    "pred_06_verification": _kept("length(coalesce(description, '')) < 200 OR " + " + ".join(f"contains(lower(substring(coalesce(description, ''), 1, 1000)), '{s}')::INT" for s in P.VERIFY_SIGNS) + " >= 2"),
    "pred_07_skill": _kept(_SKILL),
    "pred_08_description": _kept(f"{_STRIP("coalesce(description, '')")} <> ''"),
    "pred_09_valid": _kept(f"{_STRIP("coalesce(title, '')")} <> '' AND {_STRIP("coalesce(url, '')")} <> '' AND {_PRESENT} <> ''"),
    "pred_10_expired": f"WITH {_CACHE} SELECT ord FROM c WHERE {_EXPIRED}",
    "pred_12_fresh_visits": f"SELECT visit_id FROM url_visits WHERE trunc(({_NOW_US} - epoch_us(visited_at)) / {_DAY}.0) <= 7",
    "pred_13_fresh_titles": f"SELECT group_id FROM title_groups WHERE trunc(({_NOW_US} - epoch_us(cached_at)) / {_DAY}.0) <= 7",
    "pred_15_shown": "SELECT ord FROM job_cache WHERE coalesce(assessment.is_relevant, true)",
    "pred_16_unassessed": f"WITH {_CACHE} SELECT ord FROM (SELECT * FROM c WHERE NOT assessed ORDER BY fetched_at DESC, ord DESC LIMIT 200) WHERE NOT ({_EXPIRED})",
    "pred_17_clean_titles": f"SELECT group_id FROM title_groups WHERE NOT {_NOISY}",
    "pred_20_possibly_closed": _kept(f"coalesce(description, '') <> '' AND {_CLOSED}"),
    "jn01_cached_postings": f"WITH {_REASONS} SELECT ord FROM r WHERE reason = 'cache_hit'",
    "jn03_jobs_by_keys": f"WITH {_CACHE} SELECT ord FROM c WHERE dedup_key IN {_SESSION_KEYS} AND NOT ({_EXPIRED})",
    "jn04_failed_urls": "SELECT ord FROM job_cache WHERE url IN (SELECT url FROM failed_urls WHERE url IS NOT NULL)",
    "jn05_not_failed": "SELECT ord FROM job_cache j WHERE NOT EXISTS (SELECT 1 FROM failed_urls f WHERE f.url = j.url)",
    "jn06_title_counts": "SELECT role_id, coalesce(n, 0)::BIGINT AS n FROM role_list r LEFT JOIN (SELECT canonical, arg_max(cnt, group_id) AS n FROM title_groups GROUP BY 1) t ON t.canonical = r.role",
    "jn09_roles_by_country": "SELECT role_id, country_code FROM role_list CROSS JOIN (SELECT DISTINCT country_code FROM place_list)",
    "jn12_session_jobs": "WITH s AS (SELECT DISTINCT session_key, unnest(job_dedup_keys) AS k FROM search_sessions), j AS (SELECT dedup_key, count(*) AS n FROM job_cache GROUP BY 1) SELECT session_key, count(*) AS n_keys, sum(n)::BIGINT AS n_rows FROM s JOIN j ON j.dedup_key = s.k GROUP BY 1",
    "a01_title_counts": "SELECT title, count(*) AS n FROM job_cache GROUP BY 1",
    "a02_funnel_totals": f"WITH {_REASONS} SELECT reason, count(*) AS n FROM r GROUP BY 1",
    "a03_funnel_by_source": f"WITH {_REASONS}, {_BY_SOURCE} SELECT * FROM s",
    "a04_sources_of_key": f"WITH {_POST}, k AS (SELECT *, {_KEY} AS key FROM p), g AS (SELECT key, source, min(ord) AS o FROM k GROUP BY 1, 2) SELECT key, coalesce(string_agg(source, '|' ORDER BY o), '') AS sources, count(*) AS n FROM g GROUP BY 1",
    "a05_repeated_keys": f"SELECT {_KEY} AS key, count(*) AS n FROM job_cache GROUP BY 1 HAVING count(*) > 1",
    "a06_url_conflicts": f"WITH {_URLS} SELECT url, n_keys FROM v",
    "a07_stats_totals": "SELECT count(*) AS n, coalesce(sum(tokens_in), 0)::BIGINT AS tokens_in, coalesce(sum(tokens_out), 0)::BIGINT AS tokens_out, coalesce(sum(jobs_found), 0)::BIGINT AS jobs, round(coalesce(sum(elapsed::DECIMAL(18,3)), 0), 1)::DOUBLE AS elapsed FROM search_stats",
    "a09_latest_search": "SELECT cv_hash, id FROM search_stats WHERE cv_hash IS NOT NULL QUALIFY row_number() OVER (PARTITION BY cv_hash ORDER BY created_at DESC, id DESC) = 1",
    "a10_by_provider": "SELECT coalesce(nullif(provider, ''), 'none') AS provider, count(*) AS n, sum(tokens_in)::BIGINT AS tokens_in, sum(tokens_out)::BIGINT AS tokens_out, round(sum(elapsed::DECIMAL(18,3)), 1)::DOUBLE AS elapsed FROM search_stats GROUP BY 1",
    "a13_canonical_titles": f"WITH b AS (SELECT cnt, {_BASE} AS t FROM title_groups WHERE canonical IS NOT NULL) SELECT t AS canonical_title, sum(cnt)::BIGINT AS total, count(*) AS n_variants FROM b WHERE t <> '' GROUP BY 1",
    "a15_dedup_report": f"WITH {_CACHE}, {_REPORT(f'SELECT * FROM job_cache WHERE ord IN (SELECT ord FROM c WHERE dedup_key IN {_SESSION_KEYS} AND NOT ({_EXPIRED}))')} SELECT * FROM rep",
    "w01_first_per_url": "SELECT url, min(ord) AS ord FROM job_cache WHERE url IS NOT NULL GROUP BY 1",
    "w02_duplicates": f"WITH {_SEEN} SELECT ord FROM m WHERE dup",
    "w03_first_per_key_source": f"WITH {_POST} SELECT {_KEY} AS key, source, min(ord) AS ord FROM p GROUP BY 1, 2",
    "w06_numbered_append": "WITH o AS (SELECT id, id AS was FROM search_stats WHERE id % 4 <> 0), n AS (SELECT id AS was FROM search_stats WHERE id % 4 = 0) SELECT id, was FROM o UNION ALL SELECT (SELECT max(id) FROM o) + row_number() OVER (ORDER BY was) AS id, was FROM n",
    "w07_latest_visit": "SELECT url, visit_id, status FROM url_visits WHERE url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY url ORDER BY visited_at DESC, visit_id DESC) = 1",
    "l01_recent_live": f"WITH {_NEWEST} SELECT ord FROM w",
    "l02_ranked": f"WITH {_NEWEST}, s AS (SELECT *, coalesce(score, -1) AS sc FROM w WHERE NOT assessed OR relevant) SELECT row_number() OVER (ORDER BY sc DESC, fetched_at DESC, ord DESC) AS place, ord, sc AS score, epoch_us(fetched_at) AS fetched_us FROM s",
    "l05_top_titles": "SELECT row_number() OVER (ORDER BY n DESC, title) AS place, title, n FROM (SELECT title, count(*) AS n FROM job_cache WHERE title IS NOT NULL GROUP BY 1 ORDER BY n DESC, title LIMIT 80)",
    "l08_history": "SELECT row_number() OVER (ORDER BY id DESC) AS place, id, provider, len(roles)::BIGINT AS n_roles FROM search_stats ORDER BY id DESC LIMIT 50",
    "u01_left_priority": "SELECT url, ord FROM job_cache WHERE url IS NOT NULL AND sources[1] IS NOT NULL QUALIFY row_number() OVER (PARTITION BY url ORDER BY (sources[1] <> 'workmesa.example')::INT, ord) = 1",
    "u07_missing_keys": f"SELECT DISTINCT k AS dedup_key FROM {_SESSION_KEYS} WHERE k IS NOT NULL AND k NOT IN (SELECT dedup_key FROM job_cache WHERE dedup_key IS NOT NULL)",
    "snk05_first_failure": "SELECT url, min(failed_id) AS failed_id FROM failed_urls WHERE url IS NOT NULL GROUP BY 1",
    "snk11_delete": f"SELECT ord FROM job_cache WHERE dedup_key IS NULL OR dedup_key NOT IN (SELECT k FROM {_SESSION_KEYS} WHERE k IS NOT NULL)",
    "snk14_vacuum": f"WITH {_CACHE}, n AS (SELECT (SELECT count_if(coalesce(expires_us < {_NOW_US}, epoch_us(fetched_at) < {_NOW_US} - 7 * {_DAY})) FROM c)::BIGINT AS jobs, (SELECT count_if(epoch_us(created_at) < {_NOW_US} - {_DAY}) FROM search_sessions)::BIGINT AS sessions, (SELECT count_if(epoch_us(visited_at) < {_NOW_US} - 7 * {_DAY}) FROM url_visits)::BIGINT AS visits) SELECT *, jobs + sessions + visits AS total FROM n",
    "snk20_markdown": "SELECT ord, md5('# ' || coalesce(title, '') || chr(10) || 'Company: ' || coalesce(company, '') || chr(10) || 'Location: ' || coalesce(nullif(location, ''), '-') || chr(10) || 'Sources: ' || array_to_string(coalesce(sources, []), ', ') || chr(10) || 'Url: ' || coalesce(url, '') || chr(10) || 'Fetched: ' || coalesce(strftime(fetched_at AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M'), '') || CASE WHEN coalesce(expires_at, '') = '' THEN '' ELSE chr(10) || 'Expires: ' || expires_at END || chr(10) || chr(10) || '---' || chr(10) || chr(10) || coalesce(nullif(description_snippet, ''), '(no text)') || chr(10) || chr(10) || '---' || chr(10) || chr(10) || CASE WHEN assessment IS NULL THEN 'Not assessed.' ELSE 'Score: ' || assessment.score || '/10 ' || repeat('#', assessment.score) || repeat('.', 10 - assessment.score) || chr(10) || 'Keywords: ' || array_to_string(coalesce(assessment.matched_keywords, []), ', ') || chr(10) || 'Strengths' || chr(10) || array_to_string(['- ' || x FOR x IN coalesce(assessment.strengths, [])], chr(10)) || chr(10) || 'Weaknesses' || chr(10) || array_to_string(['- ' || x FOR x IN coalesce(assessment.weaknesses, [])], chr(10)) END) AS md FROM job_cache",
    "x02_scores": f"WITH {_POST}, s AS (SELECT ord, {' + '.join(f'contains(lower(coalesce(description, ' + chr(39) * 2 + f')), {chr(39)}{s}{chr(39)})::BIGINT' for s in SKILLS)} AS n_matched, greatest(coalesce(list_max([CASE WHEN length(y) <= 4 THEN y::BIGINT ELSE 9999 END FOR y IN {_YEARS}]), 0) - 5, 0)::BIGINT AS year_gap FROM p) SELECT ord, n_matched, year_gap, least(n_matched * 2 + 2, CASE WHEN year_gap > 5 THEN 3 WHEN year_gap > 2 THEN 5 ELSE 10 END)::BIGINT AS score, n_matched > 0 AND year_gap <= 5 AS relevant FROM s",
    "t01_stream_distinct": "SELECT DISTINCT url FROM url_visits WHERE url IS NOT NULL",
    "t05_fresh": f"SELECT ord FROM job_cache WHERE epoch_us(fetched_at) >= {_NOW_US} - 72 * 3600000000",
    "snk02_upsert_merge": f"WITH {_SAVED} SELECT o.dedup_key, o.ord, array_to_string([coalesce(x, '') FOR x IN CASE WHEN o.n > 1 THEN coalesce(s2.all_sources, []) ELSE o.sources END], '|') AS sources, coalesce(e3.entries, '') AS entries, f1.expires_at, f1.score::BIGINT AS score FROM o LEFT JOIN s2 USING (dedup_key) LEFT JOIN e3 USING (dedup_key) LEFT JOIN f1 USING (dedup_key) WHERE o.rn = 1",
    "p5_found": I.P5,
    "fn22_pass_rate": f"WITH {_FUNNEL} SELECT id, {_RATES['llm_pass_rate']} AS llm_pass_rate FROM f",
    "fn23_title_pass_rate": f"WITH {_FUNNEL} SELECT id, {_RATES['llm_title_pass_rate']} AS llm_title_pass_rate FROM f",
    "l03_sliced_then_sorted": f"WITH {_CACHE}, s AS (SELECT * FROM c WHERE dedup_key IN {_SESSION_KEYS} AND NOT ({_EXPIRED}) ORDER BY dedup_key, ord LIMIT 50) SELECT row_number() OVER (ORDER BY coalesce(score, -1) DESC, dedup_key, ord) AS place, ord, coalesce(score, -1) AS score FROM s",
    "fn06b_references": _value(f"md5({_references('description')})"),
    "fn25_repaired_sources": "SELECT ord, array_to_string(coalesce(sources, []), '|') AS value FROM job_cache",
    "fn30_keywords": f"SELECT session_key, array_to_string(list_concat(coalesce(roles, [])[1:3], {_TOKENS_OF('roles')}[1:3]), '|') AS words FROM search_sessions",
    "fn34_shown": "SELECT ord, array_to_string(coalesce(assessment.matched_keywords, [])[1:4], ', ') AS keywords, array_to_string(coalesce(sources, [])[1:2], ', ') AS sources FROM job_cache",
    "fn35_prompts": f"WITH {_BATCHED} SELECT batch, count(*) AS n, md5(string_agg('[' || slot || '] ' || coalesce(title, '') || chr(10) || '<posting>' || chr(10) || substring(coalesce(description, ''), 1, 8000) || chr(10) || '</posting>', chr(10) || chr(10) ORDER BY slot)) AS prompt FROM b GROUP BY 1",
    "pred_01_intern": _kept(_level("intern")),
    "pred_01_lead": _kept(_level("lead")),
    "pred_19_error_lines": "SELECT visit_id FROM url_visits WHERE contains('x [' || upper(status) || ']', '[ERROR]')",
    "pred_22_has_profile": "SELECT session_key FROM search_sessions WHERE coalesce(location, '') <> '' AND len(coalesce(roles, [])) > 0",
    "pred_23_link_state": "SELECT ord, CASE WHEN coalesce(description_snippet, '') = '' THEN 'fetch_failed' WHEN regexp_matches(description_snippet, '" + P.INACTIVE_PATTERN.removeprefix("(?i)") + "', 'i') THEN 'posting_closed' ELSE 'ok' END AS state FROM job_cache WHERE coalesce(expires_at, '') = ''",
    "src06_scan": f"WITH {_SCAN} SELECT url, ord, source FROM z WHERE passed",
    "src06_counters": f"WITH {_SCAN} SELECT (SELECT count(DISTINCT url) FROM q WHERE source = '{SCANNED[0]}') AS scraped_1, (SELECT count(DISTINCT url) FROM q WHERE source = '{SCANNED[1]}') AS scraped_2, (SELECT count(*) FROM z) AS scraped_total, (SELECT count(*) FROM z) AS title_filter_in, (SELECT count(*) FROM z WHERE passed) AS title_filter_passed, (SELECT count(*) FROM z WHERE NOT passed) AS title_filter_out",
    "src08_titles": f"WITH h AS (SELECT j.title, j.ord, w, c.country FROM job_cache j, (SELECT unnest({_LIST(ROLE_WORDS[:4])}) AS w), (SELECT DISTINCT country FROM place_list) c WHERE coalesce(title, '') <> '' AND contains(lower(title), w) AND trim(string_split(location, ',')[-1]) = c.country QUALIFY row_number() OVER (PARTITION BY w, c.country ORDER BY j.ord) <= 50) SELECT title, count(*) AS n FROM h GROUP BY 1",
    "src10_job": "SELECT ord, dedup_key, title FROM job_cache WHERE dedup_key = (SELECT min(dedup_key) FROM job_cache)",
    "src11_catalogue": "WITH m AS (SELECT DISTINCT provider, model FROM search_stats WHERE coalesce(provider, '') <> '' AND coalesce(model, '') <> '' AND NOT regexp_matches(model, '" + "|".join(P.NOT_CHAT_IDS) + "', 'i') AND NOT regexp_matches(provider, '" + "|".join(P.NOT_CHAT_NAMES) + "', 'i')) SELECT provider, model, row_number() OVER (PARTITION BY provider ORDER BY model DESC) AS place FROM m QUALIFY place <= 6",
    "src16_assessed_keys": f"SELECT DISTINCT {_KEY} AS key FROM job_cache WHERE assessment IS NOT NULL",
    "src18_session": f"SELECT session_key, to_json(roles)::VARCHAR AS roles, epoch_us(created_at) AS at FROM search_sessions WHERE session_key = (SELECT min(session_key) FROM search_sessions) AND {_NOW_US} - epoch_us(created_at) <= 24 * 3600000000",
    "src19_profile": "SELECT id, cv_hash FROM search_stats WHERE cv_hash = (SELECT min(cv_hash) FROM search_stats)",
    "jn01_patched": f"WITH {_REASONS} SELECT ord FROM r WHERE reason = 'cache_patch'",
    "jn07_by_position": f"WITH {_BATCHED} SELECT ord, batch, slot, CASE WHEN batch % 5 = 4 OR batch % 3 = 1 AND slot > 6 THEN 0 ELSE {_SCORE} END::BIGINT AS score, batch % 5 = 4 OR batch % 3 = 1 AND slot > 6 OR ({_MATCHED} > 0 AND {_GAP} <= 5) AS relevant FROM b",
    "a16_defaults": f"WITH {_BATCHED} SELECT slot, count(*) AS n, count_if(batch % 5 = 4 OR batch % 3 = 1 AND slot > 6)::BIGINT AS defaults FROM b GROUP BY 1",
    "w05_batches": f"WITH {_BATCHED} SELECT batch, count(*) AS n, min(ord) AS first_ord, max(slot) AS last_slot FROM b GROUP BY 1",
    "a02_counters": f"WITH {_REASONS} SELECT count(*) AS prefilter_in, " + ", ".join(f"count_if(reason = '{s}')::BIGINT AS {n}" for n, s in TOTALS.items()) + ", count_if(reason IN ('pending', 'cache_patch'))::BIGINT AS llm_assessed, count_if(outcome = 'llm_rejected')::BIGINT AS llm_rejected, count_if(outcome = 'saved')::BIGINT AS saved FROM r",
    "l12_source_lines": f"WITH {_REASONS}, {_BY_SOURCE}, d AS (SELECT *, concat_ws(', ', " + ", ".join(f"CASE WHEN {s} > 0 THEN '{s}=' || {s} END" for s in [*_STEPS, "llm_rejected"]) + ") AS parts FROM s WHERE source <> '*') SELECT row_number() OVER (ORDER BY source) AS place, 'Source [' || source || ']: ' || n_in || ' in, ' || saved || ' saved' || CASE WHEN parts <> '' THEN ' (' || parts || ')' ELSE '' END AS line FROM d",
    "x13_outcomes": f"WITH {_REASONS} SELECT ord, reason, outcome, new_score AS score FROM r",
    "a06_conflict_keys": f"WITH {_REPORT('SELECT * FROM job_cache WHERE assessment IS NOT NULL')} SELECT url, count(DISTINCT key) AS n_keys FROM gx WHERE coalesce(url, '') <> '' GROUP BY 1 HAVING count(DISTINCT key) > 1",
    "a09_latest_profile": "SELECT arg_max(cv_hash, (created_at, id)) AS cv_hash FROM search_stats WHERE cv_hash IS NOT NULL",
    "a13_variants": f"WITH b AS (SELECT cnt, canonical, {_BASE} AS t FROM title_groups WHERE canonical IS NOT NULL) SELECT t AS canonical_title, canonical AS variant, sum(cnt)::BIGINT AS n FROM b WHERE t <> '' GROUP BY 1, 2",
    "a15_assessed_report": f"WITH {_REPORT('SELECT * FROM job_cache WHERE assessment IS NOT NULL')} SELECT *, CASE WHEN l1 = 0 THEN 'PASS' ELSE 'FAIL ' || l1 END AS l1_badge, CASE WHEN l2 = 0 THEN 'PASS' ELSE 'WARN ' || l2 END AS l2_badge, CASE WHEN l1 = 0 AND l2 = 0 THEN 'ALL PASS' ELSE 'ISSUES FOUND' END AS verdict FROM rep",
    "l07_log_tail": "SELECT row_number() OVER (ORDER BY visit_id) AS place, visit_id, line FROM (SELECT visit_id, strftime(visited_at AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') || ' [' || upper(status) || '] ' || coalesce(url, '') AS line FROM url_visits WHERE upper(status) = 'ERROR' ORDER BY visit_id DESC LIMIT 200)",
    "l09_final_titles": f"WITH b AS (SELECT {_BASE} AS t, cnt FROM title_groups WHERE canonical IS NOT NULL AND NOT {_NOISY}), g AS (SELECT t AS title, sum(cnt)::BIGINT AS n, len(list_intersect(string_split(t, ' '), {_LIST(ROLE_WORDS)})) AS hits FROM b WHERE t <> '' GROUP BY ALL) SELECT row_number() OVER (ORDER BY hits DESC, n DESC, title) AS place, title, n FROM g WHERE hits > 0 ORDER BY place LIMIT 5",
    "l11_first_conflicts": f"WITH {_REPORT('SELECT * FROM job_cache')}, t AS (SELECT url FROM gv ORDER BY url LIMIT 10), kk AS (SELECT {_KEY} AS key, ord, unnest(list_concat([url], coalesce([s.url FOR s IN raw_sources], []))) AS url FROM job_cache), f AS (SELECT url, key, min(ord) AS o FROM kk WHERE url IN (SELECT url FROM t) GROUP BY 1, 2) SELECT url, string_agg(key, ' || ' ORDER BY o, key) AS keys, row_number() OVER (ORDER BY url) AS place FROM f GROUP BY 1",
    "snk07_title_cache": "SELECT cache_key, group_id, canonical FROM title_groups QUALIFY row_number() OVER (PARTITION BY cache_key ORDER BY cached_at DESC, group_id DESC) = 1",
    "snk08_profiles": "SELECT cv_hash, id, model FROM search_stats WHERE cv_hash IS NOT NULL QUALIFY row_number() OVER (PARTITION BY cv_hash ORDER BY created_at DESC, id DESC) = 1",
    "snk10_search_log": "WITH b AS (SELECT id AS was, round(elapsed::DECIMAL(18,3), 1)::DOUBLE AS elapsed, CASE WHEN trim(funnel) IN ('', '{}') THEN NULL ELSE funnel END AS funnel FROM search_stats) SELECT was AS id, was, elapsed, funnel FROM b WHERE was % 4 <> 0 UNION ALL SELECT (SELECT max(was) FROM b WHERE was % 4 <> 0) + row_number() OVER (ORDER BY was) AS id, was, elapsed, funnel FROM b WHERE was % 4 = 0",
    "snk12_clear_all": _LEFT(("search_stats",)),
    "snk13_clear_log": _LEFT(("job_cache", "search_sessions", "failed_urls", "title_groups", "url_visits")),
    "snk17_export": f"WITH {_NEWEST}, s AS (SELECT row_number() OVER (ORDER BY coalesce(score, -1) DESC, fetched_at DESC, ord DESC) AS place, ord, coalesce(score, -1) AS sc FROM w WHERE NOT assessed OR relevant) SELECT '[' || coalesce(string_agg('{{\"place\":' || place || ',\"ord\":' || ord || ',\"score\":' || sc || '}}', ',' ORDER BY place), '') || ']' AS json FROM s",
    "snk18_normalised": f"WITH x AS (SELECT 'j' || ord AS id, title, company, url, date_posted, sources, CASE WHEN ord % 2 = 0 THEN raw_sources END AS raw_sources, is_complete FROM job_cache UNION ALL SELECT 'v' || visit_id, title, NULL, url, NULL, NULL, NULL, NULL FROM url_visits), y AS (SELECT *, CASE WHEN len(coalesce(sources, [])) > 0 THEN sources WHEN {_DOMAIN} <> '' THEN [{_DOMAIN}] ELSE [] END AS src FROM x) SELECT id, {_KEY} AS dedup_key, array_to_string([coalesce(z, '') FOR z IN src], '|') AS sources, CASE WHEN len(coalesce(raw_sources, [])) > 0 THEN array_to_string([coalesce(e.source, '') || ' ' || coalesce(e.url, '') || ' ' || coalesce(e.date_posted, '') FOR e IN raw_sources], '|') WHEN len(src) > 0 THEN coalesce(src[1], '') || ' ' || coalesce(url, '') || ' ' || coalesce(date_posted, '') ELSE '' END AS entries, coalesce(is_complete, true) AS is_complete FROM y",
    "t08_short_circuit": f"SELECT session_key, {_NOW_US} - epoch_us(created_at) <= 24 * 3600000000 AS hit, CASE WHEN {_NOW_US} - epoch_us(created_at) <= 24 * 3600000000 THEN coalesce(len(job_dedup_keys), 0) END::BIGINT AS saved FROM search_sessions",
    "pred_24_condensed": _CONDENSED,
    "u03_ordered_union": "SELECT ord, array_to_string([x FOR x, i IN list_append(sources, 'archive.example') IF list_position(list_append(sources, 'archive.example'), x) = i], '|') AS value FROM job_cache",
}
