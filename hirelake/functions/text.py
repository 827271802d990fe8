"""Scalar functions over posting text: keys, cleaning, tokens and extraction. Columns in, columns out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Legal suffixes that do not tell companies apart.
LEGAL_SUFFIXES = ["llc", "inc", "ltd", "co", "corp", "group", "gmbh", "ag", "sa", "sas", "bv", "nv", "plc"]
# Words too common in role names to tell roles apart.
ROLE_STOPWORDS = [
    "engineer", "senior", "junior", "lead", "staff", "graduate", "intern", "associate", "principal", "manager", "director", "developer", "specialist",
    "analyst", "architect", "consultant", "officer", "head", "founding", "and", "or", "the", "of", "in", "at", "ii", "iii", "i",
]
# What splits a title into words, and how a text asks for years of experience.
TITLE_SPLIT = r"[\s/\-,|@().]+"
YEARS = r"(?i)(\d+)\+?\s*years?\s*(?:of\s+)?(?:experience|exp\b)"
# Phrases that announce a closing date, and the shapes of the date.
DEADLINE_TRIGGERS = [
    r"closing\s+date", r"apply\s+by", r"applied\s+by", r"deadline", r"applications?\s+close[sd]?", r"closes?\s+on", r"expir(?:es?|ing)\s+on",
    r"last\s+(?:date\s+to\s+apply|day\s+to\s+apply|application\s+date)", r"position\s+closes?", r"vacancy\s+closes?", r"accepting\s+applications?\s+until",
    r"applications?\s+accepted\s+until", r"submit\s+(?:your\s+)?application\s+by",
]
DEADLINE_DATES = [r"\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4}", r"\d{1,2}\s+\w+\s+\d{4}", r"\w+\s+\d{1,2},?\s+\d{4}"]
# White space as Unicode has it, as a class for regular expressions of Java and of DuckDB, and as characters.
SPACE = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
BLANKS = "".join(map(chr, [*range(0x9, 0xE), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
# Named character references, by what they stand for.
ENTITIES = {
    "nbsp": "\u00a0", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "ndash": "–", "mdash": "—", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "bull": "•",
    "hellip": "…", "middot": "·", "euro": "€", "pound": "£", "copy": "©", "reg": "®", "trade": "™", "deg": "°", "eacute": "é", "egrave": "è", "agrave": "à",
    "ccedil": "ç", "auml": "ä", "ouml": "ö", "uuml": "ü", "szlig": "ß", "ntilde": "ñ", "iacute": "í", "oacute": "ó", "aacute": "á", "uacute": "ú",
}
DEADLINE = rf"(?i)(?:{'|'.join(DEADLINE_TRIGGERS)})[\s:–\-]*({'|'.join(DEADLINE_DATES)})"


def strip(c: Column) -> Column:
    """``c`` without outer white space of any kind."""
    return F.btrim(c, F.lit(BLANKS))


def collapse(c: Column) -> Column:
    """Runs of white space of any kind become one space; outer ones go."""
    return F.btrim(F.regexp_replace(c, f"{SPACE}+", " "))


def company_key(name: Column) -> Column:
    """Legal suffixes deleted, white space collapsed, lower case; NULL as ''."""
    suffix = rf"(?iU),?\s*\b(?:{'|'.join(LEGAL_SUFFIXES)})\.?(?=\s|$)"
    return F.lower(collapse(F.regexp_replace(F.coalesce(name, F.lit("")), suffix, "")))


def title_key(title: Column) -> Column:
    """Brackets deleted, cut at the first dash or bar, collapsed, lower case; NULL as ''."""
    t = F.regexp_replace(F.coalesce(title, F.lit("")), r"\(.*?\)", "")
    return F.lower(collapse(F.regexp_replace(t, r"\s*[-–|].*$", "")))


def posting_key(company: Column, title: Column) -> Column:
    return F.concat(company_key(company), F.lit("|"), title_key(title))


def title_case(c: Column) -> Column:
    """Every run of letters begins with a capital, also behind an apostrophe or a dash."""
    parts = F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000_000))), "")


def clean_location(c: Column, country: str = "Ireland") -> Column:
    """A closing two-letter code becomes ``country``, a lone letter before a comma goes; title case."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r",\s*[A-Z]{2}\s*$", f", {country}")
    return strip(title_case(F.regexp_replace(c, r",\s*[A-Z]\s*(?=,)", "")))


def first_word(c: Column, default: str) -> Column:
    return F.lower(F.coalesce(F.nullif(F.split(F.btrim(F.coalesce(c, F.lit(""))), r"\s+").getItem(0), F.lit("")), F.lit(default)))


def squeeze_lines(c: Column) -> Column:
    """Three or more line ends become two; outer white space goes."""
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def unescaped(c: Column) -> Column:
    """Character references, by name (``ENTITIES``) or number, as the characters they stand for; others stay. References
    made by the replacement itself are not read again: ``&amp;`` comes last."""
    numbers = F.array_distinct(F.regexp_extract_all(c, F.lit(r"&#(0{0,4}[1-9]\d{0,5});"), F.lit(1)))
    code = lambda n: F.decode(F.unhex(F.lpad(F.hex(n.cast("int")), 8, "0")), "UTF-32")
    usable = lambda n: (n.cast("int") <= 0x10FFFF) & ~n.cast("int").between(0xD800, 0xDFFF) & (n.cast("int") != 38)
    text = F.aggregate(F.filter(numbers, usable), c, lambda t, n: F.replace(t, F.concat(F.lit("&#"), n, F.lit(";")), code(n)))
    for name, char in ENTITIES.items():
        text = F.replace(text, F.lit(f"&{name};"), F.lit(char))
    return F.when(F.contains(c, F.lit("&")), F.replace(F.replace(text, F.lit("&#38;"), F.lit("&amp;")), F.lit("&amp;"), F.lit("&"))).otherwise(c)


def html_text(c: Column) -> Column:
    """Text of HTML: comments, scripts and styles go, block tags begin a line, other tags go, references are read."""
    c = F.regexp_replace(c, r"(?is)<!--.*?-->|<(script|style|template)\b[^>]*>.*?</\1\s*>", "")
    c = F.regexp_replace(F.regexp_replace(c, r"(?i)<(?:p|li|br|h[1-4])\b[^>]*>", "\n"), r"</?[a-zA-Z][^>]*>", "")
    return squeeze_lines(unescaped(c))


def present(c: Column) -> Column:
    """Trimmed text; NULL and the literal 'nan' count as missing and give ''."""
    t = strip(F.coalesce(c, F.lit("")))
    return F.when(F.lower(t) == "nan", "").otherwise(t)


def title_tokens(title: Column) -> Column:
    return F.array_distinct(F.split(F.lower(F.coalesce(title, F.lit(""))), TITLE_SPLIT))


def role_words(role: Column) -> Column:
    """Words of a role that tell it apart."""
    return F.filter(F.split(F.lower(role), r"[\s/\-]+"), lambda w: (F.length(w) > 1) & ~w.isin(*ROLE_STOPWORDS))


def required_years(text: Column) -> Column:
    """All numbers of years of experience that a text asks for, as text."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(YEARS), F.lit(1))


def deadline(text: Column) -> Column:
    """The first date behind a phrase that announces a closing date, or NULL."""
    return F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), DEADLINE, 1), F.lit(""))


def domain(url: Column) -> Column:
    """Host of an absolute url without a leading 'www.', or ''."""
    return F.regexp_replace(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)", 1), r"^www\.", "")


def json_in_text(text: Column) -> Column:
    """The JSON object inside model output: a code fence goes, then from the first '{' to the last '}'; NULL without one."""
    bare = F.regexp_replace(text, r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", "")
    return F.nullif(F.regexp_extract(bare, r"(?s)(\{.*\})", 1), F.lit(""))


def repaired_sources(json: Column) -> Column:
    """A JSON array of names, where an entry may be an object with a 'source'; NULL gives an empty array, repeats stay."""
    items = F.coalesce(F.from_json(json, "array<string>"), F.array().cast("array<string>"))
    return F.transform(items, lambda x: F.when(F.startswith(x, F.lit("{")), F.coalesce(F.get_json_object(x, "$.source"), F.lit(""))).otherwise(x))


def json_string(c: Column) -> Column:
    """``c`` as a JSON string of ASCII letters only: others as ``\\u`` and four hexadecimal digits, in pairs beyond them."""
    text = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for char, code in (("\n", "n"), ("\r", "r"), ("\t", "t"), ("\b", "b"), ("\f", "f")):
        text = F.replace(text, F.lit(char), F.lit("\\" + code))
    wide = F.array_distinct(F.regexp_extract_all(c, F.lit(r"([^\x{20}-\x{7f}\n\r\t\x{8}\f])"), F.lit(1)))
    hexed = lambda ch: F.regexp_replace(F.lower(F.hex(F.encode(ch, "UTF-16BE"))), "(.{4})", "\\\\u$1")
    return F.concat(F.lit('"'), F.aggregate(wide, text, lambda t, ch: F.replace(t, ch, hexed(ch))), F.lit('"'))


def session_key(roles: Column, location: Column, seniority: Column, sources: list[str]) -> Column:
    """MD5 of the JSON object of a search with sorted keys: location, roles, seniority and sources; roles and sources sorted.
    NULL counts as empty; language and limits are no part of it."""
    names = lambda a: F.concat(F.lit("["), F.array_join(F.transform(a, json_string), ", "), F.lit("]"))
    roles = F.array_sort(F.array_compact(F.coalesce(roles, F.array().cast("array<string>"))))
    parts = [
        F.lit('{"location": '), json_string(strip(F.lower(F.coalesce(location, F.lit(""))))), F.lit(', "roles": '), names(roles),
        F.lit(', "seniority": '), json_string(F.coalesce(seniority, F.lit(""))), F.lit(', "sources": '), names(F.array(*(F.lit(x) for x in sorted(sources)))), F.lit("}"),
    ]
    return F.md5(F.concat(*parts))


def shortened(c: Column, n: int = 60) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def file_name(c: Column) -> Column:
    """Letters, digits, space, dash and underscore stay, others become '_'; at most 50 characters."""
    return F.substring(F.regexp_replace(c, r"[^\p{L}\p{N} _-]", "_"), 1, 50)


def bar(n: Column, full: str = "#", top: int = 20, per: int = 5) -> Column:
    return F.repeat(F.lit(full), F.least(F.floor(n / per), F.lit(top)).cast("int"))


def rate(part: Column, whole: Column) -> Column:
    """part / whole in percent, half up to one decimal; 0 without a whole."""
    return F.when(F.coalesce(whole, F.lit(0)) == 0, F.lit(0.0)).otherwise(F.round(part * 100.0 / whole, 1))


def condensed(roles: Column, most: int = 3) -> Column:
    """The search words that stand for ``roles``: fewer words first, then in order; a role is left out if the words of a chosen one
    hold its own, or are all among them; at most ``most`` stay."""
    tokens = lambda r: F.array_distinct(F.filter(F.split(F.lower(r), r"\s+"), lambda w: w != ""))
    within = lambda a, b: F.size(F.array_except(tokens(a), tokens(b))) == 0
    clean = F.array_compact(F.coalesce(roles, F.array().cast("array<string>")))
    order = F.array_sort(F.transform(clean, lambda r, i: F.struct(F.size(F.split(strip(r), r"\s+")).alias("n"), i.alias("i"), r.alias("r"))))
    taken = lambda acc, x: F.exists(acc, lambda s: within(x["r"], s) | within(s, x["r"]))
    return F.aggregate(order, F.array().cast("array<string>"), lambda acc, x: F.when((F.size(acc) >= most) | taken(acc, x), acc).otherwise(F.concat(acc, F.array(x["r"]))))
