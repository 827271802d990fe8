"""The ordered filter funnel and its score-and-write half: each posting gets the step that stops it and what becomes of it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.functions import predicates as P
from hirelake.functions import text as T
from hirelake.operators.dedup import mark_duplicates
from hirelake.operators.scoring import scored

STEPS = ["dup", "seniority", "irrelevant", "cache_hit", "cache_patch", "no_desc", "closed", "exp", "skill", "pending"]
#: Steps that are counted for each source; a patched record is counted in the totals only.
BY_SOURCE = ["dup", "seniority", "irrelevant", "cache_hit", "no_desc", "closed", "exp", "skill", "llm_rejected", "saved"]
TOTALS = {
    "skip_dup": "dup", "skip_seniority": "seniority", "skip_irrelevant": "irrelevant", "cache_hit": "cache_hit", "cache_patch": "cache_patch", "skip_no_desc": "no_desc",
    "skip_closed": "closed", "skip_exp": "exp", "skip_skill": "skill",
}


@dataclass(frozen=True)
class Candidate:
    """What a search is for; a frozen literal, never joined."""

    level: str = "mid"
    years: int = 10
    role_words: list[str] = field(default_factory=list)
    skills: list[str] = field(default_factory=list)
    summary: str = "a candidate"

    @property
    def assessable(self) -> bool:
        """Records can be scored for the candidate; without that a live record counts as a hit, assessed or not."""
        return bool(self.summary and self.skills)


def with_reason(postings: DataFrame, who: Candidate, cache: DataFrame | None, now: Column) -> DataFrame:
    """``postings`` (ord, url, title, company, description, source) with key, ``reason`` and ``kept``.

    ``cache`` (ord, url, expires_ts, fetched_at, assessed, relevant) is reduced to its first row for each url by
    ``ord`` before the join. A live assessed record stops a posting as 'cache_hit'; a live one that is not assessed yet is
    to be patched ('cache_patch') and its posting is looked at no further. The step order is
    fixed; the first that applies wins. ``kept``: the record behind a 'cache_hit' was not rejected.
    """
    rows = mark_duplicates(postings.withColumn("key", T.posting_key(T.strip(F.col("company")), T.strip(F.col("title")))))
    hit = patch = kept = F.lit(False)
    if cache is not None:
        live = cache.where(F.col("url").isNotNull()).groupBy("url").agg(F.min_by(F.struct("expires_ts", "fetched_at", "assessed", "relevant"), "ord").alias("c"))
        rows = rows.join(live, "url", "left")
        alive = F.col("c").isNotNull() & ~P.expired(F.col("c.expires_ts"), F.col("c.fetched_at"), now)
        done = F.col("c.assessed") if who.assessable else F.lit(True)
        hit, patch = F.coalesce(alive & done, F.lit(False)), F.coalesce(alive & ~done, F.lit(False))
        kept = ~F.coalesce(F.col("c.assessed") & ~F.col("c.relevant"), F.lit(False))
    text = T.strip(F.coalesce("description", F.lit("")))
    reason = (
        F.when(F.col("dup"), "dup")
        .when(~P.suits_level(T.strip(F.col("title")), who.level), "seniority")
        .when(~P.relevant(T.strip(F.col("title")), who.role_words), "irrelevant")
        .when(hit, "cache_hit")
        .when(patch, "cache_patch")
        .when(text == "", "no_desc")
        .when(P.closed(text), "closed")
        .when(P.asks_more_years(text, who.years), "exp")
        .when(~P.has_skill(text, who.skills), "skill")
        .otherwise("pending")
    )
    return rows.withColumns({"reason": reason, "kept": kept}).drop("c", "dup")


def assessed(rows: DataFrame, who: Candidate, cached_text: DataFrame | None = None) -> DataFrame:
    """Rows of :func:`with_reason` with ``outcome``: 'saved', 'llm_rejected', or the step that stopped the row.

    Pending rows are scored on their own text, patched ones on that of the first record of their url in ``cached_text`` (ord, url,
    description). A hit is saved unless its record was rejected. Scores are columns, so input and result need no zip.
    """
    to_score = F.col("reason").isin("pending", "cache_patch")
    text = F.when(F.col("reason") == "pending", F.col("description"))
    if cached_text is not None:
        asked = rows.where("reason = 'cache_patch'").select("url").distinct()
        texts = cached_text.join(asked, "url", "left_semi").groupBy("url").agg(F.min_by("description", "ord").alias("__cached"))
        rows = rows.join(texts, "url", "left")
        text = F.coalesce(text, F.col("__cached"))
    if who.assessable:
        rows = scored(rows.withColumn("__text", text), "__text", who.skills, who.years)
    else:
        rows = rows.withColumns({"relevant": F.lit(True), "score": F.lit(0)})
    outcome = F.when(to_score, F.when(F.col("relevant"), "saved").otherwise("llm_rejected")).when((F.col("reason") == "cache_hit") & F.col("kept"), "saved").otherwise(F.col("reason"))
    return rows.withColumn("outcome", outcome).withColumn("score", F.when(to_score, F.col("score")).cast("bigint"))


def totals(rows: DataFrame) -> DataFrame:
    """One row with the counters of a search, from rows of :func:`assessed`."""
    counts = [F.count_if(F.col("reason") == step).alias(name) for name, step in TOTALS.items()]
    rejected = F.col("outcome") == "llm_rejected"
    return rows.agg(
        F.count("*").alias("prefilter_in"), *counts, F.count_if(F.col("reason").isin("pending", "cache_patch")).alias("llm_assessed"),
        F.count_if(rejected).alias("llm_rejected"), F.count_if(F.col("outcome") == "saved").alias("saved"),
    )


def by_source(rows: DataFrame) -> DataFrame:
    """(source, n_in, one count per step of ``BY_SOURCE``), zero-filled, with a total row whose source is '*'.

    Of each source only its own new rows count as rejected or saved; keys that come from hits and patches do not.
    """
    own = F.col("reason") == "pending"
    counts = [F.count_if(own & (F.col("outcome") == s) if s in ("llm_rejected", "saved") else F.col("reason") == s).alias(s) for s in BY_SOURCE]
    grouped = rows.withColumn("source", F.coalesce(F.nullif(F.col("source"), F.lit("")), F.lit("unknown"))).groupingSets([["source"], []], "source")
    return grouped.agg(F.grouping("source").alias("g"), F.count("*").alias("n_in"), *counts).withColumn("source", F.when(F.col("g") == 1, "*").otherwise(F.col("source"))).drop("g")


def report_lines(counts: DataFrame) -> DataFrame:
    """(place, line) of each source of :func:`by_source`, in order of the sources' names; steps that stopped nothing are left out."""
    from pyspark.sql import Window

    parts = [F.when(F.col(s) > 0, F.concat(F.lit(f"{s}="), F.col(s).cast("string"))) for s in BY_SOURCE if s != "saved"]
    detail = F.concat_ws(", ", *parts)
    line = F.concat(F.lit("Source ["), "source", F.lit("]: "), F.col("n_in").cast("string"), F.lit(" in, "), F.col("saved").cast("string"), F.lit(" saved"), F.when(detail != "", F.concat(F.lit(" ("), detail, F.lit(")"))).otherwise(""))
    rows = counts.where("source <> '*'")  # one row for each board
    return rows.select(F.row_number().over(Window.orderBy("source")).alias("place"), line.alias("line"))
