"""A deterministic batch scorer. The definition is this project's own; a model can take its place."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hirelake.functions import text as T
from hirelake.operators.dedup import positions
from hirelake.session import cut

BATCH = 8


def scored(rows: DataFrame, text: str, skills: list[str], years: int) -> DataFrame:
    """``rows`` with n_matched, year_gap, score 0..10 and relevant.

    Two points for each skill found and two to begin with, at most 10. Years asked for beyond ``years`` cap the score:
    a gap of 3 to 5 at 5, a larger one at 3. Relevant: a skill found and a gap of at most 5.
    """
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    matched = sum((F.contains(low, F.lit(s)).cast("int") for s in skills), F.lit(0))
    asked = F.array_max(F.transform(T.required_years(F.col(text)), lambda y: F.when(F.length(y) <= 4, y.cast("int")).otherwise(F.lit(9999))))
    rows = rows.withColumn("n_matched", matched).withColumn("year_gap", F.greatest(F.coalesce(asked, F.lit(0)) - years, F.lit(0)))
    cap = F.when(F.col("year_gap") > 5, 3).when(F.col("year_gap") > 2, 5).otherwise(10)
    return rows.withColumn("score", F.least(F.col("n_matched") * 2 + 2, cap)).withColumn("relevant", (F.col("n_matched") > 0) & (F.col("year_gap") <= 5))


def batches(rows: DataFrame, order: str, size: int = BATCH) -> DataFrame:
    """``rows`` with ``batch`` 0.. and ``slot`` 1..size: by position in ``order``, ``size`` rows a batch."""
    rows = positions(rows, order, "__pos")
    return rows.withColumns({"batch": F.floor(F.col("__pos") / size), "slot": F.col("__pos") % size + 1}).drop("__pos")


def padded(asked: DataFrame, results: DataFrame, defaults: dict) -> DataFrame:
    """``asked`` (batch, slot, ...) with the columns of ``results`` (batch, slot, ...), joined by position in the batch.

    A batch that failed or came back short is filled with ``defaults``; results beyond the batch are cut off.
    """
    out = asked.join(results, ["batch", "slot"], "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def prompt_blocks(rows: DataFrame, title: str, text: str, chars: int = 8000) -> DataFrame:
    """(batch, n, prompt): the postings of a batch as numbered blocks, texts cut to what a call may hold; at most ``BATCH`` rows each."""
    block = F.concat(F.lit("["), F.col("slot").cast("string"), F.lit("] "), F.coalesce(title, F.lit("")), F.lit("\n<posting>\n"), F.substring(F.coalesce(text, F.lit("")), 1, chars), F.lit("\n</posting>"))
    blocks = rows.groupBy("batch").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("slot", block.alias("b")))).alias("bs"))
    return blocks.select("batch", "n", F.array_join(F.transform("bs", lambda x: x["b"]), "\n\n").alias("prompt"))


def ranked_titles(groups: DataFrame, words: list[str], most: int = 5, spare: int = 2) -> DataFrame:
    """(place, title, n): the titles a scorer keeps, best first: more of ``words``, then more often seen, then by name.

    ``groups`` (title, n). The scorer is asked for ``most`` + ``spare`` titles, of which the first ``most`` are kept.
    """
    hits = F.size(F.array_intersect(F.split(F.col("title"), " "), F.array(*(F.lit(w) for w in words))))
    best = groups.withColumn("hits", hits).where("hits > 0").orderBy(F.desc("hits"), F.desc("n"), "title").limit(most + spare)
    place = F.row_number().over(Window.orderBy(F.desc("hits"), F.desc("n"), "title"))  # at most ``most`` + ``spare`` rows
    return best.select(place.cast("bigint").alias("place"), "title", "n").where(F.col("place") <= most)


def keywords(roles: Column, terms: Column, n: int = 6) -> Column:
    """Half role phrases, then half terms, of each at least two."""
    half = max(n // 2, 2)
    return F.concat(F.slice(roles, 1, half), F.slice(terms, 1, half))


RESULT = "batch bigint, slot int, relevant boolean, reason string, score int, matched_keywords array<string>"
DEFAULT = {"relevant": True, "reason": "kept: no assessment", "score": 0}


def assessed_by(call: Callable[[list[tuple[str, str]]], list[dict]], rows: DataFrame, order: str, title: str, text: str, chars: int = 8000) -> DataFrame:
    """``rows`` with batch, slot, relevant, reason, score and matched_keywords by a model behind ``call``.

    ``call`` gets up to ``BATCH`` (title, text) pairs and returns one result for each, in order. A batch whose call fails is kept as
    relevant with a score of 0; a short answer is filled likewise, a long one cut.
    """
    asked = cut(batches(rows, order))

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values("slot")
        try:
            found = call([(t or "", (x or "")[:chars]) for t, x in zip(pdf["title"], pdf["text"], strict=True)])
        except Exception:  # noqa: BLE001 - a failed batch is kept
            found = []
        out = [(int(b), int(s), r.get("relevant"), r.get("reason"), r.get("score"), list(r.get("matched_keywords") or [])) for b, s, r in zip(pdf["batch"], pdf["slot"], found, strict=False)]
        return pd.DataFrame(out, columns=["batch", "slot", "relevant", "reason", "score", "matched_keywords"])

    small = asked.select("batch", "slot", F.col(title).alias("title"), F.col(text).alias("text"))
    return padded(asked, small.groupBy("batch").applyInPandas(run, RESULT), DEFAULT)


def kept_cards(rows: DataFrame, key: str, scores: Callable[[DataFrame], DataFrame] | None, least: float = 0.6) -> DataFrame:
    """The rows whose card scores at least ``least``: ``scores`` gives (key, score). Rows it does not name go, unknown keys are
    ignored; without a scorer, or if it fails, all rows stay."""
    if scores is None:
        return rows
    try:
        passing = cut(scores(rows).where(F.col("score") >= least).select(key))
    except Exception:  # noqa: BLE001 - a filter that fails filters nothing
        return rows
    return rows.join(passing, key, "left_semi")
