"""SQL for DuckDB that reads an instant from text: the counterpart of :mod:`hirelake.functions.timestamps`.

Formats are tried one after another, each with its own pattern; days come from casts to DATE and zone rules from DuckDB's
own zone data, so neither the alternation nor the day arithmetic of the Spark side is shared, only the fixed lists.
"""

from __future__ import annotations

from hirelake.functions.timestamps import ABBREVIATIONS, MONTHS

_DAY, _HOUR = 86_400_000_000, 3_600_000_000
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9})\d*)?)?"
_CLOCK_PARTS = ["h", "mi", "s", "f"]
_HALF = r"(?:\s*([ap])\.?m\.?)?"
_ZONE = r"(?:\s*((?:utc|gmt)?[+-]\d{1,2}(?::?\d{2})?|[a-z]{1,5}))?"
_MONTH = r"(\p{L}{3,10}\.?)"
_SAID = r"(?:posted\s+|publicado\s+|veröffentlicht\s+)?"
_SINCE = r"(?:vor|hace|il\sy\sa)\s+"

# (pattern, parts of its groups), in order of trial
_FORMS = [
    (rf"(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}})(?:(?:[T ]|,\s*){_CLOCK}{_HALF}{_ZONE})?", ["y", "mo", "d", *_CLOCK_PARTS, "ap", "z"]),
    (rf"(\d{{4}})(\d{{2}})(\d{{2}})(?:T(\d{{2}})(\d{{2}})(?:(\d{{2}})(?:[.,](\d{{1,9}})\d*)?)?{_ZONE})?", ["y", "mo", "d", *_CLOCK_PARTS, "z"]),
    (rf"(\d{{1,2}})[/-](\d{{1,2}})[/-](\d{{4}}|\d{{2}})(?:(?:[T ]|,\s*){_CLOCK}{_HALF}(?:\s+uhr)?{_ZONE})?", ["a", "b", "y", *_CLOCK_PARTS, "ap", "z"]),
    (rf"(\d{{1,2}})\.\s?(\d{{1,2}})\.\s?(\d{{4}}|\d{{2}})(?:(?:[T ]|,\s*){_CLOCK}(?:\s+uhr)?{_ZONE})?", ["d", "mo", "y", *_CLOCK_PARTS, "z"]),
    (rf"(?:\p{{L}}{{2,10}}\.?,?\s+)?(\d{{1,2}})(?:\.|st|nd|rd|th|er)?[\s-](?:(?:de|of)\s)?{_MONTH},?[\s-](?:(?:de|del)\s)?(\d{{4}}|\d{{2}})(?:(?:,?\s+(?:(?:at|um|a las|à)\s+)?){_CLOCK}{_HALF}(?:\s+uhr)?{_ZONE})?", ["d", "mn", "y", *_CLOCK_PARTS, "ap", "z"]),
    (rf"(?:\p{{L}}{{2,10}}\.?,\s+)?{_MONTH}\s(\d{{1,2}})(?:st|nd|rd|th)?,?\s(\d{{4}})(?:,?\s+(?:at\s+)?{_CLOCK}{_HALF}{_ZONE})?", ["mn", "d", "y", *_CLOCK_PARTS, "ap", "z"]),
    (r"(\d{9,10})(?:\.(\d{1,9})\d*)?", ["es", "f"]),
    (r"(\d{12,13})", ["em"]),
    (rf"{_SAID}(\d{{1,6}})\s?(?:h|hr|hrs|hour|hours|hour\(s\))(?:\s+ago)?", ["rh"]),
    (rf"{_SAID}{_SINCE}(\d{{1,6}})\s+(?:stunden?|std\.?|horas?|heures?|h)", ["rh"]),
    (rf"{_SAID}(\d{{1,6}})\s?(?:d|day|days|day\(s\))(?:\s+ago)?", ["rd"]),
    (rf"{_SAID}{_SINCE}(\d{{1,6}})\s+(?:tage?n?|días?|dias?|jours?)", ["rd"]),
    (rf"{_SAID}(\d{{1,5}})\s?(?:w|week|weeks|week\(s\))(?:\s+ago)?", ["rw"]),
    (rf"{_SAID}{_SINCE}(\d{{1,5}})\s+(?:wochen?|semanas?|semaines?)", ["rw"]),
    (rf"{_SAID}(today|heute|hoy|aujourd''hui)", ["rt"]),
    (rf"{_SAID}(yesterday|gestern|ayer|hier)", ["ry"]),
]
_PARTS = ["y", "mo", "d", "a", "b", "mn", *_CLOCK_PARTS, "ap", "z", "es", "em", "rh", "rd", "rw", "rt", "ry"]


def _struct(pattern: str, names: list[str]) -> str:
    return "{" + ", ".join(f"'{p}': " + (f"nullif(regexp_extract(t, '^(?:{pattern})$', {names.index(p) + 1}, 'i'), '')" if p in names else "NULL::VARCHAR") for p in _PARTS) + "}"


def _offset(us: str) -> str:
    """Offset of the zone ``tz`` at an instant, in microseconds."""
    return f"(epoch_us(timezone(tz, make_timestamptz({us}))) - ({us}))"


def instants(rows: str) -> str:
    """CTEs over ``rows`` (a query of id, value, tz, locale, anchor TIMESTAMPTZ), the last ``instant`` (id, utc_us): one row for each row."""
    months = ", ".join(f"'{n.rstrip('.')}': {m}" for m, line in MONTHS.items() for n in dict.fromkeys(w.rstrip(".") for w in line.split()))
    zones = ", ".join(f"'{z.lower()}': {v}" for z, v in ABBREVIATIONS.items())
    cases = " ".join(f"WHEN regexp_full_match(t, '{p}', 'i') THEN {_struct(p, names)}" for p, names in _FORMS)
    number = lambda p: f"try_cast(p.{p} AS BIGINT)"
    first, second = f"coalesce({number('d')}, {number('a')})", f"coalesce({number('mo')}, {number('b')})"
    swap = "(locale = 'en-US' AND p.a IS NOT NULL)"
    return (
        f"i0 AS ({rows}), i1 AS (SELECT id, regexp_replace(value, '^\\s+|\\s+$', '', 'g') AS t, coalesce(tz, 'UTC') AS tz, coalesce(locale, '') AS locale, anchor FROM i0), "
        f"i2 AS (SELECT *, CASE {cases} END AS p FROM i1), "
        f"i3 AS (SELECT *, CASE WHEN length(p.y) = 2 THEN {number('y')} + 2000 ELSE {number('y')} END AS y, "
        f"coalesce(MAP {{{months}}}[rtrim(lower(p.mn), '.')], CASE WHEN p.mn IS NULL THEN CASE WHEN {swap} THEN {first} ELSE {second} END END) AS m, "
        f"CASE WHEN {swap} THEN {second} ELSE {first} END AS d, coalesce({number('h')}, 0) AS h0, coalesce({number('mi')}, 0) AS mi, coalesce({number('s')}, 0) AS s, "
        "coalesce(CAST(left(rpad(p.f, 6, '0'), 6) AS BIGINT), 0) AS us, lower(p.z) AS z FROM i2), "
        "i4 AS (SELECT *, CASE WHEN p.ap IS NULL THEN CASE WHEN h0 <= 23 THEN h0 END WHEN h0 BETWEEN 1 AND 12 THEN h0 % 12 + CASE WHEN lower(p.ap) = 'p' THEN 12 ELSE 0 END END AS h, "
        "regexp_extract(z, '([+-])', 1) AS sign, try_cast(regexp_extract(z, '[+-](\\d{1,2}?):?(?:\\d{2})?$', 1) AS BIGINT) AS oh, coalesce(try_cast(nullif(regexp_extract(z, '[+-]\\d{1,2}?:?(\\d{2})$', 1), '') AS BIGINT), 0) AS om FROM i3), "
        f"i5 AS (SELECT *, CASE WHEN z IS NULL THEN NULL WHEN sign <> '' THEN CASE WHEN oh <= 14 AND om <= 59 THEN (oh * 60 + om) * CASE WHEN sign = '-' THEN -1 ELSE 1 END END WHEN z = 'ist' THEN CASE WHEN tz = 'Europe/Dublin' THEN 60 ELSE 330 END ELSE MAP {{{zones}}}[z] END AS zone_min, "
        f"try_cast(printf('%04d-%02d-%02d', y, m, d) AS DATE) AS day, epoch_us(anchor) AS anchor_us, coalesce({number('rd')}, {number('rw')} * 7, CASE WHEN p.rt IS NOT NULL THEN 0 WHEN p.ry IS NOT NULL THEN 1 END) AS back FROM i4), "
        f"i6 AS (SELECT *, CASE WHEN day IS NOT NULL AND y BETWEEN 1 AND 9999 AND h IS NOT NULL AND mi <= 59 AND s <= 59 AND (z IS NULL OR zone_min IS NOT NULL) THEN epoch_us(day::TIMESTAMP) + ((h * 60 + mi) * 60 + s) * 1000000 + us "
        f"WHEN back IS NOT NULL THEN (epoch_us(date_trunc('day', timezone(tz, anchor))) - back * {_DAY}) END AS wall FROM i5), "
        f"i7 AS (SELECT *, {_offset(f'wall - {_DAY}')} AS before, {_offset(f'wall + {_DAY}')} AS after FROM i6), "
        f"i8 AS (SELECT *, CASE WHEN before = after OR {_offset('wall - before')} = before THEN before WHEN {_offset('wall - after')} = after THEN after ELSE before END AS own FROM i7), "
        f"instant AS (SELECT id, coalesce({number('es')} * 1000000 + us, {number('em')} * 1000, anchor_us - {number('rh')} * {_HOUR}, CASE WHEN zone_min IS NOT NULL THEN wall - zone_min * 60000000 ELSE wall - own END) AS utc_us FROM i8)"
    )


#: One row for each date_posted and expires_at, read for the row's board.
OF_BOARDS = "SELECT {{'field': field, 'ord': ord}} AS id, value, tz, locale, anchor FROM (SELECT ord, unnest([{fields}]) AS field, unnest([{columns}]) AS value, b.time_zone AS tz, b.locale, j.fetched_at AS anchor FROM job_cache j LEFT JOIN board_list b ON b.board = j.sources[1])"


def of_boards(*fields: str) -> str:
    """CTEs as of :func:`instants` whose id is a struct of field and ord."""
    return instants(OF_BOARDS.format(fields=", ".join(f"'{f}'" for f in fields), columns=", ".join(fields)))


P5 = f"WITH {of_boards('date_posted', 'expires_at')} SELECT id.field AS field, id.ord AS ord, utc_us FROM instant WHERE utc_us IS NOT NULL"
