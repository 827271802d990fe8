"""Mixed timestamp formats and zones, normalised to one UTC instant.

All accepted formats are compiled into one regular expression with named groups.
A single ``regexp_replace`` per value copies the named groups into fixed slots, so
the components of a value are extracted once, inside whole-stage codegen and without
Python. Calendar ranges are checked on the components, and the instant is assembled
by integer day arithmetic (days since 1970 from year, month and day). Only values
without a zone of their own need the zone rules of their board.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.functions.plan import fenced
from hirelake.sources.tables import broadcast_small, spread, table

SLOT = "\u0001"

# Month names and their common short forms, in en, de, es and fr.
MONTHS = {
    1: "january jan januar jän jänner jan. enero ene janvier janv",
    2: "february feb februar febr febrero février fevrier févr fevr fév",
    3: "march mar märz maerz mär marzo mars",
    4: "april apr abril abr avril avr",
    5: "may mai mayo",
    6: "june jun juni junio juin",
    7: "july jul juli julio juillet juil",
    8: "august aug agosto ago août aout",
    9: "september sep sept septiembre setiembre septembre",
    10: "october oct oktober okt octubre octobre",
    11: "november nov noviembre novembre",
    12: "december dec dezember dez diciembre dic décembre decembre déc",
}

# Zone abbreviations and their own offsets in minutes. IST is two zones,
# Irish and Indian; it is resolved by the zone of the board.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120,
    "EET": 120, "EEST": 180, "MSK": 180, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360,
    "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600, "AWST": 480, "ACST": 570, "ACDT": 630,
    "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780, "JST": 540, "SGT": 480, "HKT": 480,
}
IST_BY_ZONE = {"Europe/Dublin": 60}
IST_ELSEWHERE = 330

#: Locales that write the month before the day.
MONTH_FIRST = ("en-US",)

MINUTE_US, HOUR_US, DAY_US = 60_000_000, 3_600_000_000, 86_400_000_000

_TIME = r"(?<h{k}>\d{{1,2}}):(?<mi{k}>\d{{2}})(?::(?<s{k}>\d{{2}})(?:[.,](?<f{k}>\d{{1,9}})\d*)?)?"
_ZONE = r"(?:(?:UTC|GMT)?(?<os{k}>[+-])(?<oh{k}>\d{{1,2}})(?::?(?<om{k}>\d{{2}}))?|(?<zn{k}>[A-Z]{{1,5}}))"
_AMPM = r"(?<ap{k}>[ap])\.?m\.?"
_MONTH = r"(?<mn{k}>\p{{L}}{{3,10}}\.?)"
_AGO = r"(?:posted\s+|publicado\s+|veröffentlicht\s+)?"

# Each format by its own key k, so that every named group has one name in the alternation.
_FORMATS = [
    # 2025-01-31, 2025/01/31T10:00, 2025-01-31 10:00:00.123+01:00, 2025-01-31 10:00 CET
    rf"(?<y{{k}}>\d{{{{4}}}})[-/.](?<mo{{k}}>\d{{{{1,2}}}})[-/.](?<d{{k}}>\d{{{{1,2}}}})(?:(?:[T ]|,\s*){_TIME}(?:\s*{_AMPM})?(?:\s*{_ZONE})?)?",
    # 20250131, 20250131T101500Z
    r"(?<y{k}>\d{{4}})(?<mo{k}>\d{{2}})(?<d{k}>\d{{2}})(?:T(?<h{k}>\d{{2}})(?<mi{k}>\d{{2}})(?:(?<s{k}>\d{{2}})(?:[.,](?<f{k}>\d{{1,9}})\d*)?)?(?:" + _ZONE + r")?)?",
    # 31/01/2025, 1/31/25 10:15 PM, 31.1.2025 10:15 Uhr: the order a, b follows the locale, with dots it is day first
    rf"(?<a{{k}}>\d{{{{1,2}}}})[/-](?<b{{k}}>\d{{{{1,2}}}})[/-](?<y{{k}}>\d{{{{4}}}}|\d{{{{2}}}})(?:(?:[T ]|,\s*){_TIME}(?:\s*{_AMPM})?(?:\s+Uhr)?(?:\s*{_ZONE})?)?",
    rf"(?<d{{k}}>\d{{{{1,2}}}})\.\s?(?<mo{{k}}>\d{{{{1,2}}}})\.\s?(?<y{{k}}>\d{{{{4}}}}|\d{{{{2}}}})(?:(?:[T ]|,\s*){_TIME}(?:\s+Uhr)?(?:\s*{_ZONE})?)?",
    # 31 January 2025, 31. Januar 2025, 10:15 Uhr, 31 de enero de 2025, Fri, 31 Jan 2025 10:15:00 +0100
    rf"(?:\p{{{{L}}}}{{{{2,10}}}}\.?,?\s+)?(?<d{{k}}>\d{{{{1,2}}}})(?:\.|st|nd|rd|th|er)?[\s-](?:(?:de|of)\s)?{_MONTH},?[\s-](?:(?:de|del)\s)?(?<y{{k}}>\d{{{{4}}}}|\d{{{{2}}}})(?:(?:,?\s+(?:(?:at|um|a las|à)\s+)?){_TIME}(?:\s*{_AMPM})?(?:\s+Uhr)?(?:\s*{_ZONE})?)?",
    # January 31, 2025 at 10:15 pm, Fri, Jan 31 2025
    rf"(?:\p{{{{L}}}}{{{{2,10}}}}\.?,\s+)?{_MONTH}\s(?<d{{k}}>\d{{{{1,2}}}})(?:st|nd|rd|th)?,?\s(?<y{{k}}>\d{{{{4}}}})(?:,?\s+(?:at\s+)?{_TIME}(?:\s*{_AMPM})?(?:\s*{_ZONE})?)?",
    # seconds or milliseconds since 1970
    r"(?<es{k}>\d{{9,10}})(?:\.(?<f{k}>\d{{1,9}})\d*)?",
    r"(?<em{k}>\d{{12,13}})",
    # 3 hours ago, 3h ago, vor 3 Stunden, hace 3 horas, il y a 3 heures
    _AGO + r"(?<rh{k}>\d{{1,6}})\s?(?:h|hr|hrs|hour|hours|hour\(s\))(?:\s+ago)?",
    _AGO + r"(?:vor|hace|il\sy\sa)\s+(?<rh{k}>\d{{1,6}})\s+(?:stunden?|std\.?|horas?|heures?|h)",
    # 3 days ago, 3 day(s) ago, 3d, vor 3 Tagen, hace 3 días, 2 weeks ago
    _AGO + r"(?<rd{k}>\d{{1,6}})\s?(?:d|day|days|day\(s\))(?:\s+ago)?",
    _AGO + r"(?:vor|hace|il\sy\sa)\s+(?<rd{k}>\d{{1,6}})\s+(?:tage?n?|días?|dias?|jours?)",
    _AGO + r"(?<rw{k}>\d{{1,5}})\s?(?:w|week|weeks|week\(s\))(?:\s+ago)?",
    _AGO + r"(?:vor|hace|il\sy\sa)\s+(?<rw{k}>\d{{1,5}})\s+(?:wochen?|semanas?|semaines?)",
    _AGO + r"(?<rt{k}>today|heute|hoy|aujourd'hui)",
    _AGO + r"(?<ry{k}>yesterday|gestern|ayer|hier)",
]

_NUMBERS = ("y", "mo", "d", "a", "b", "h", "mi", "s", "oh", "om", "es", "em", "rh", "rd", "rw")
_TEXTS = ("mn", "f", "ap", "os", "zn", "rt", "ry")
_PARTS = (*_NUMBERS, *_TEXTS)


def _compile() -> tuple[str, str]:
    """The alternation over all formats, and the replacement that lays its groups into slots."""
    groups: dict[str, list[str]] = {p: [] for p in _PARTS}
    alternatives = []
    for i, form in enumerate(_FORMATS):
        key = f"x{i}"
        text = form.format(k=key)
        alternatives.append(text)
        for p in _PARTS:
            if f"(?<{p}{key}>" in text:
                groups[p].append("${" + p + key + "}")
    # only one alternative matches; groups that took no part are empty in the replacement
    return r"(?iuU)^\s*(?:" + "|".join(alternatives) + r")\s*$", SLOT + SLOT.join("".join(groups[p]) for p in _PARTS)


PATTERN, SLOTS = _compile()


def _lookup(pairs: dict[str, int], key: Column) -> Column:
    """The number of ``key`` in a small fixed table, or NULL. The table is one text searched for
    the key; a map literal would be compared entry by entry through a generic ordering."""
    text = "".join(f"\u0002{k}\u0003{v:+05d}" for k, v in pairs.items())
    at = F.position(F.concat(F.lit("\u0002"), key, F.lit("\u0003")), F.lit(text))
    return F.when(at > 0, F.substring(F.lit(text), at + F.length(key) + 2, F.lit(5)).cast("int"))


def _apart(c: Column) -> Column:
    """``c`` itself, through a higher-order function. A projection that holds one stays out of
    whole-stage codegen: the chain below would become one method larger than the JIT compiles,
    where a projection's own generated code is split into small methods."""
    return F.transform(F.array(c), lambda x: x).getItem(0)


def days_from_civil(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a proleptic Gregorian date of year 1 or later, by integers only."""
    year = y - F.when(m <= 2, 1).otherwise(0)  # years begin in March, so a leap day comes last
    idiv = lambda a, n: F.floor(a / n)
    in_year = idiv((m + 9) % 12 * 153 + 2, 5) + d - 1
    return (year * 365 + idiv(year, 4) - idiv(year, 100) + idiv(year, 400) + in_year - 719468).cast("bigint")


def with_utc(df: DataFrame, value: str, zone: str, locale: str, anchor: str, out: str = "utc_us") -> DataFrame:
    """``df`` with ``out`` BIGINT: microseconds since 1970-01-01 UTC named by text ``value``.

    ``zone`` and ``locale`` are columns (IANA zone and locale of the row's board) used for
    values without a zone and for the order of day and month; a NULL zone counts as UTC, a
    NULL locale as day first. ``anchor`` is the timestamp from which relative values count
    back. NULL, blank, unreal (30 February) and non-date values give NULL; so do relative
    values with a NULL anchor. Fractions finer than a microsecond are dropped. A local time
    that occurs twice means the first; one that never occurs is read with the offset before
    the change. Rows are neither dropped nor repeated; other columns stay. Columns of ``df``
    must not begin with ``__ts_``.
    """
    parts = F.split(F.regexp_replace(F.translate(F.col(value), SLOT, ""), PATTERN, SLOTS), SLOT)
    df = df.withColumn("__ts_parts", parts)
    df = df.withColumn("__ts_parts", F.when(F.size("__ts_parts") == len(_PARTS) + 1, F.col("__ts_parts")))
    df = df.withColumn("__ts_n", F.transform(F.slice("__ts_parts", 2, len(_NUMBERS)), lambda x: F.when(x != "", x.cast("bigint"))))
    num = {p: F.col("__ts_n").getItem(i) for i, p in enumerate(_NUMBERS)}
    text = {p: F.col("__ts_parts").getItem(i + 1 + len(_NUMBERS)) for i, p in enumerate(_TEXTS)}
    names = {name: m for m, line in MONTHS.items() for name in line.split()}
    month_first = F.coalesce(F.col(locale).isin(*MONTH_FIRST), F.lit(False))
    first, second = F.coalesce(num["d"], num["a"]), F.coalesce(num["mo"], num["b"])
    swap = month_first & num["a"].isNotNull()
    named = F.when(text["mn"] != "", _lookup(names, F.rtrim(F.lower(text["mn"]), F.lit("."))))
    hour = F.when(text["ap"] == "", F.coalesce(num["h"], F.lit(0))).when(num["h"].between(1, 12), num["h"] % 12 + F.when(F.lower(text["ap"]) == "p", 12).otherwise(0))
    ist = F.when(F.col(zone).isin(*IST_BY_ZONE), _lookup(IST_BY_ZONE, F.col(zone))).otherwise(F.lit(IST_ELSEWHERE))
    abbreviated = F.when(F.upper(text["zn"]) == "IST", ist).otherwise(_lookup(ABBREVIATIONS, F.upper(text["zn"])))
    om = F.coalesce(num["om"], F.lit(0))
    written = F.when((num["oh"] <= 14) & (om <= 59), F.when(text["os"] == "-", -1).otherwise(1) * (num["oh"] * 60 + om))
    df = df.withColumns({
        "__ts_y": F.when(num["y"] < 100, F.when(F.length(F.col("__ts_parts").getItem(1)) == 2, num["y"] + 2000)).otherwise(num["y"]),
        "__ts_m": F.coalesce(named, F.when(swap, first).otherwise(second)),
        "__ts_d": F.when(swap, second).otherwise(first),
        "__ts_h": _apart(hour),
        "__ts_mi": F.coalesce(num["mi"], F.lit(0)),
        "__ts_s": F.coalesce(num["s"], F.lit(0)),
        "__ts_f": F.rpad(text["f"], 6, "0").cast("bigint"),
        "__ts_off": F.when(text["os"] != "", written).when(text["zn"] != "", abbreviated),
        "__ts_zoned": (text["os"] != "") | (text["zn"] != ""),
    })
    y, m, d, h, mi, s, micros, off, zoned = (F.col(f"__ts_{c}") for c in ("y", "m", "d", "h", "mi", "s", "f", "off", "zoned"))
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    month_days = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    real = y.between(1, 9999) & m.between(1, 12) & (d >= 1) & (d <= month_days) & h.between(0, 23) & (mi <= 59) & (s <= 59) & (~zoned | off.isNotNull())
    home = F.coalesce(F.col(zone), F.lit("UTC"))
    at = F.unix_micros(F.col(anchor).cast("timestamp"))
    back = F.coalesce(num["rd"], num["rw"] * 7, F.when(text["rt"] != "", 0), F.when(text["ry"] != "", 1))
    local_day = F.floor(F.unix_micros(F.from_utc_timestamp(F.col(anchor).cast("timestamp"), home)) / DAY_US)
    # a date written with a real calendar day, or the board's calendar day so many days before the anchor
    df = df.withColumns({
        "__ts_y": F.when(real, y),
        "__ts_abs": F.coalesce(num["es"] * 1_000_000 + micros, num["em"] * 1000, at - num["rh"] * HOUR_US),
        "__ts_back": _apart(local_day - back),
    })
    time_us = ((h * 60 + mi) * 60 + s) * 1_000_000 + micros
    df = df.withColumn("__ts_day", _apart(F.coalesce(days_from_civil(y, m, d), F.col("__ts_back"))))
    df = df.withColumn("__ts_local", F.col("__ts_day") * DAY_US + F.when(y.isNotNull(), time_us).otherwise(0))
    local = F.col("__ts_local")
    by_zone = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(local), home))
    utc = F.coalesce(F.col("__ts_abs"), F.when(off.isNotNull(), local - off * MINUTE_US).otherwise(by_zone)).cast("bigint")
    # fenced: a later filter on ``out`` would otherwise inline, and so repeat, the whole chain
    df = df.withColumn(out, fenced(utc))
    return df.drop(*(c for c in df.columns if c.startswith("__ts_")))


def p5_found(spark, sf_dir: str) -> DataFrame:
    """(field, ord, utc_us) of every date_posted and expires_at that names a day or instant."""
    boards = table(spark, sf_dir, "board_list").select("board", "locale", "time_zone")
    rows = spread(table(spark, sf_dir, "job_cache").select("ord", F.element_at("sources", 1).alias("board"), "fetched_at", "date_posted", "expires_at"))
    rows = rows.join(broadcast_small(boards), "board", "left")
    long = rows.select("ord", "locale", "time_zone", "fetched_at", F.stack(F.lit(2), F.lit("date_posted"), "date_posted", F.lit("expires_at"), "expires_at").alias("field", "value"))
    return with_utc(long.where(F.col("value").isNotNull()), "value", "time_zone", "locale", "fetched_at").where(F.col("utc_us").isNotNull()).select("field", "ord", "utc_us")
