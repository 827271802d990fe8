"""Predicates over postings, cached records and pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hirelake.functions import text as T

# Title words that do not suit a candidate, by level of the candidate.
_UPPER = (
    "senior", "sr", "staff", "lead", "principal", "director", "head", "vp", "vice", "president", "distinguished", "fellow", "manager", "architect", "cto", "cio", "cso", "founding",
)
_TRAINEE = ("intern", "internship", "placement", "apprentice", "trainee")
REJECTED = {
    "intern": (*_UPPER, "ii", "iii", "iv", "v"),
    "new_grad": (*_UPPER, "ii", "iii", "iv", "v"),
    "junior": (*_UPPER, "iii", "iv", "v"),
    "mid": ("staff", "principal", "director", "vp", "vice", "head", "distinguished", "fellow", "cto", "cio", "cso", "iv", "v", *_TRAINEE, "i"),
    "senior": (*_TRAINEE, "junior", "jr", "associate", "entry", "i", "ii"),
    "lead": (*_TRAINEE, "junior", "jr", "associate", "entry", "i", "ii"),
}
MID_PHRASES = ["graduate programme", "graduate program", "entry level"]
# Phrases of a posting that takes no more applications.
CLOSED = [
    r"applications?\s+(?:are\s+)?(?:now\s+)?(?:closed|ended|no longer accepted)", r"no longer (?:accepting|available|open)", r"position (?:has been |is )?(?:filled|closed|removed)",
    r"this (?:job|position|vacancy|role) (?:is|has been|has) (?:closed|expired|filled|removed)", r"job (?:is\s+)?no longer available", r"vacancy (?:is\s+)?(?:closed|filled)",
    r"(?:posting|listing|advert|advertisement)\s+(?:has\s+)?(?:expired|been removed)", r"expired on indeed", r"this exact role may not be open",
    r"posting is to advertise potential job opportunities",
]
CLOSED_PATTERN = rf"(?i)\b(?:{'|'.join(CLOSED)})\b"
# Lower-case signs of a page that asks for verification.
VERIFY_SIGNS = ["just a moment", "enable javascript and cookies", "checking your browser", "please wait", "cloudflare", "ddos protection", "ray id"]
# Phrases of a page whose posting is no longer active.
INACTIVE = [
    r"(?:this\s+)?(?:job|position|vacancy|role|listing|posting)\s+(?:is\s+)?(?:no longer|not)\s+(?:available|accepting|open|active)",
    r"applications?\s+(?:are\s+)?(?:now\s+)?(?:closed|no longer being accepted)", r"no longer (?:accepting|taking)\s+applications?",
    r"(?:position|vacancy|role)\s+(?:has been\s+)?(?:filled|closed|removed)", r"this\s+(?:role|position|job)\s+has\s+(?:been\s+)?(?:filled|closed|expired)",
    r"sorry[^.]*no longer available", r"recruitment\s+(?:for\s+this\s+(?:role|position)\s+)?(?:has\s+)?(?:closed|ended|finished)", r"expired on indeed",
    r"this exact role may not be open", r"posting is to advertise potential job opportunities",
]
INACTIVE_PATTERN = rf"(?i)\b(?:{'|'.join(INACTIVE)})\b"
# Parts of model ids and of model names that are no chat models.
NOT_CHAT_IDS = [
    r"\bgemma-", "lyria-", "robotics", "nano-banana", r"-tts\b", r"-image\b", "-latest$", "-computer-use", "-base", "-pretrain", r"-codex\b", "safeguard", "-moderat", "whisper",
    "-embed", "-search", "deep-research",
]
NOT_CHAT_NAMES = ["image", "text-to-image", "embedding", "moderation", "audio", "music", "banana", "robotics", "TTS", "computer use"]


def suits_level(title: Column, level: str) -> Column:
    """The title holds no word that rules it out for a candidate of ``level``; unknown levels rule out nothing."""
    words = REJECTED.get(level)
    if not words:
        return F.lit(True)
    ok = ~F.coalesce(F.arrays_overlap(T.title_tokens(title), F.array(*(F.lit(w) for w in words))), F.lit(False))
    if level == "mid":
        for p in MID_PHRASES:
            ok = ok & ~F.contains(F.lower(F.coalesce(title, F.lit(""))), F.lit(p))
    return ok


def relevant(title: Column, words: list[str]) -> Column:
    """Some title word is among ``words``; always true without words."""
    if not words:
        return F.lit(True)
    return F.coalesce(F.arrays_overlap(T.title_tokens(title), F.array(*(F.lit(w) for w in words))), F.lit(False))


def asks_more_years(text: Column, years: int) -> Column:
    return F.exists(T.required_years(text), lambda x: x.try_cast("decimal(38,0)") > years)


def closed(text: Column) -> Column:
    return F.rlike(F.coalesce(text, F.lit("")), F.lit(CLOSED_PATTERN))


def is_verification_page(text: Column, least: int = 200) -> Column:
    """Empty or short pages, or two signs of verification among the first 1000 characters."""
    head = F.lower(F.substring(F.coalesce(text, F.lit("")), 1, 1000))
    signs = sum((F.contains(head, F.lit(s)).cast("int") for s in VERIFY_SIGNS), F.lit(0))
    return (F.length(F.coalesce(text, F.lit(""))) < least) | (signs >= 2)


def has_skill(text: Column, skills: list[str]) -> Column:
    """Some skill is a part of the text, letter case aside; always true without skills."""
    if not skills:
        return F.lit(True)
    low = F.lower(F.coalesce(text, F.lit("")))
    found = F.lit(False)
    for s in skills:
        found = found | F.contains(low, F.lit(s))
    return found


def expired(expires: Column, fetched: Column, now: Column, days: int = 14) -> Column:
    """Past its own expiry, or without one more than ``days`` whole days old."""
    return F.when(expires.isNotNull(), now > expires).otherwise(F.timestamp_diff("DAY", fetched, now) > days)


def noisy_title(title: Column, count: Column, words: int = 8) -> Column:
    """Lists of several roles ("X, Y & Z", "X, Y and Z"), titles of more than ``words`` words and titles seen once."""
    listed = F.rlike(title, F.lit(r"(?i)^.+,\s*.+\s+(?:&|and)\s+.+"))
    return listed | (F.size(F.split(F.btrim(title), r"\s+")) > words) | (count <= 1)


def inactive_page(text: Column) -> Column:
    return F.rlike(F.coalesce(text, F.lit("")), F.lit(INACTIVE_PATTERN))


def chat_model(model_id: Column, name: Column) -> Column:
    """Neither the id nor the name tells of another kind of model; a NULL name is not asked."""
    bad_name = F.coalesce(F.rlike(name, F.lit(f"(?i){'|'.join(NOT_CHAT_NAMES)}")), F.lit(False))
    return ~F.coalesce(F.rlike(model_id, F.lit(f"(?i){'|'.join(NOT_CHAT_IDS)}")), F.lit(False)) & ~bad_name


def has_profile(summary: Column, skills: Column) -> Column:
    """A candidate can be assessed: a summary and at least one skill."""
    return (F.coalesce(summary, F.lit("")) != "") & (F.coalesce(F.size(skills), F.lit(0)) > 0)


def link_state(page: Column) -> Column:
    """'fetch_failed' for a page without text, 'posting_closed' for one no longer active, else 'ok'."""
    return F.when(F.coalesce(page, F.lit("")) == "", "fetch_failed").when(inactive_page(page), "posting_closed").otherwise("ok")
