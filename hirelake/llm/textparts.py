"""Parts of a posting's text: page clutter, stand-ins for a missing text, markers of a cut, sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.functions.plan import fenced

WHITE = " \t\r\n\u00a0\u200b\ufeff"

# What boards write where a description is missing.
STAND_INS = [
    "n/a", "na", "nan", "none", "null", "nil", "tbc", "tba", "unknown", "not available", "description not available", "no description",
    "no description provided", "no description available", "see company site", "see company website", "see website", "see link",
    "details on application", "details on request", "keine beschreibung", "keine angabe", "sin descripción", "sin descripcion", "no disponible",
    "aucune description", "non disponible", "无", "暂无描述",
]

# Words of page furniture (menus, notices, share links) around a posting, in lower case.
FURNITURE = [
    "we use cookies", "accept all", "cookie policy", "cookie settings", "cookie notice", "skip to content", "skip to main content", "sign in |",
    "post a job", "home > jobs", "home » jobs", "save this job", "share this job", "report this job", "similar jobs", "sign up for job alerts",
    "| terms", "| privacy", "all rights reserved", "back to results", "people viewed this", "wir verwenden cookies", "alle akzeptieren",
    "diesen job teilen", "datenschutz |", "usamos cookies", "compartir este empleo", "nous utilisons des cookies",
]
#: Longer texts are no stand-ins, whatever dots and blanks follow one.
STAND_IN_CHARS = 200
MARKUP = r"</?[a-zA-Z][a-zA-Z0-9]*(?:\s[^<>]*)?/?>|<!--|&(?:nbsp|amp|lt|gt|quot|#\d{1,6});"

# Beginnings of furniture that follows a text on its last line, in lower case.
TAILS = [
    "share this job", "report this job", "similar jobs near", "sign up for job alerts", "powered by", "all rights reserved", "back to results",
    "diesen job teilen", "compartir este empleo",
]
_TAIL = rf"(?iu)(?:{'|'.join(TAILS)})[^\n]*$"
_TAIL_MARKUP = r"(?iu)(?:</?[a-z][a-z0-9]*(?:\s[^<>\n]*)?/?>|<!--[^\n]*?-->)$"

ELLIPSIS = r"(?:\.\.\.+|…)"
#: A marker that only a cut leaves: [...], (more), "See full ad >", a broken last character.
HARD_MARK = rf"(?iu)(?:\[\s*{ELLIPSIS}\s*\]|(?:{ELLIPSIS}\s*)?[(\[](?:more|read more|show more|mehr|ver más|leer más|lire la suite|更多)[)\]]|(?:{ELLIPSIS}\s*)?(?:see|read|show|view) (?:full|more|the full)\b[^\n.!?]{{0,30}}|(?:{ELLIPSIS}\s*)?(?:read|show) more|weiterlesen|leer más|�)$"
#: Each marker of ``HARD_MARK`` holds one of these.
MARK_PARTS = ["...", "…", "more", "mehr", "más", "suite", "更多", "full", "weiterlesen", "�"]
#: Characters in which the last end of a sentence mostly lies.
NEAR_CHARS = 300
#: The beginning of a tag or of an entity, whose rest is missing.
BROKEN_MARKUP = r"(?:&(?:#\d{0,6}|n(?:b(?:sp?)?)?|a(?:mp?)?|[lg]t?|q(?:u(?:ot?)?)?)|</?[a-zA-Z][a-zA-Z0-9]{0,10}(?:\s[^<>\n]{0,60})?|<[!/]?)$"
#: No marker of a cut is longer; endings are matched against so many last characters.
MARK_CHARS = 80
LABEL = r"(?iu)^[\p{L} ]{3,30}:\s*(?:\S+@\S+\.\p{L}{2,}|https?://\S+|[\p{Lu}\d/-]*\d{3,})$"
SENTENCE_END = r"(?<=[.!?])\s+|(?<=[。！？])|\s*\n\s*|\s*<br\s*/?>\s*"


def rtrim(c: Column) -> Column:
    return F.rtrim(c, F.lit(WHITE))


def is_missing(text: Column) -> Column:
    """NULL, blank, without any letter or digit, or a stand-in for a missing description."""
    bare = F.btrim(text, F.lit(WHITE))
    stand_in = F.when(F.length(bare) <= STAND_IN_CHARS, F.rtrim(F.lower(bare), F.lit(". ")).isin(*STAND_INS)).otherwise(F.lit(False))
    return F.coalesce(stand_in | ~F.rlike(text, F.lit(r"[\p{L}\p{N}]")), F.lit(True))


def _any_of(low: Column, words: list[str]) -> Column:
    """One of the words occurs in a text of lower case. Plain searches; far cheaper than an alternation."""
    found = F.contains(low, F.lit(words[0]))
    for w in words[1:]:
        found = found | F.contains(low, F.lit(w))
    return found


def has_clutter(text: Column) -> Column:
    """The text carries menus, notices, share links or markup beside the posting itself."""
    markup = (F.contains(text, F.lit("<")) | F.contains(text, F.lit("&"))) & F.rlike(text, F.lit(MARKUP))
    return F.coalesce(markup | _any_of(F.lower(text), FURNITURE), F.lit(False))


def with_body(df: DataFrame, text: str, body: str) -> DataFrame:
    """``df`` with ``body``: the text without page furniture and markup that follow its end (markup, furniture, markup).

    Each step is a column of its own behind a fence, so that none is computed more than once.
    """
    t, low = F.col(body), F.col("__low")
    bare = F.when(F.endswith(t, F.lit(">")), rtrim(F.regexp_replace(t, _TAIL_MARKUP, ""))).otherwise(t)
    df = df.withColumn(body, fenced(rtrim(F.col(text)))).withColumn(body, fenced(bare))
    df = df.withColumn("__low", fenced(F.lower(F.substring_index(t, "\n", -1))))  # furniture goes with its own line only
    df = df.withColumn(body, fenced(F.when(_any_of(low, TAILS), rtrim(F.regexp_replace(t, _TAIL, ""))).otherwise(t)))
    return df.withColumn(body, fenced(bare)).drop("__low")


def last_sentence(body: Column) -> Column:
    """What stands behind the last end of a sentence or line. The last characters are looked at first, the whole text where they hold no end."""
    near = F.split(F.right(body, F.lit(NEAR_CHARS)), SENTENCE_END)
    return F.when(F.size(near) > 1, F.try_element_at(near, F.lit(-1))).otherwise(F.try_element_at(F.split(body, SENTENCE_END), F.lit(-1)))


def is_cut_mark(tail: Column) -> Column:
    """``tail``, the last ``MARK_CHARS`` characters of a text, ends in a marker that only a cut leaves, or inside a tag or entity."""
    hard = F.when(_any_of(F.lower(tail), MARK_PARTS), F.rlike(tail, F.lit(HARD_MARK))).otherwise(F.lit(False))
    broken = F.when(F.contains(tail, F.lit("<")) | F.contains(tail, F.lit("&")), F.rlike(tail, F.lit(BROKEN_MARKUP))).otherwise(F.lit(False))
    return hard | broken


def is_dots(text: Column) -> Column:
    """The text ends in an ellipsis."""
    return F.endswith(text, F.lit("...")) | F.endswith(text, F.lit("…"))
