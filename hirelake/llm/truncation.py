"""Texts cut off by field limits or in transfer.

The length of a text is treated as a discrete survival time. For each source, window functions
give the hazard of every length (rows that end there, of those at least as long) and the hazard of
its neighbours; lengths whose hazard is far above are found under false-discovery control
(Benjamini-Hochberg). At such a length any ending without a closing mark is a cut. Cuts in transfer lie at
any length; there an ending without a closing mark is judged by what its last words do in all texts: how often
they go on and how often they end a sentence or a line (:mod:`hirelake.llm.continuation`), under the same control of false
discoveries. A finished last line that lacks only its full stop ends like others do, or is seen nowhere
else, and stays. Counts cover all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hirelake.functions.plan import fenced
from hirelake.llm import textparts as T
from hirelake.llm.continuation import asked_keys, evidence, flat
from hirelake.session import cut as materialised
from hirelake.sources.tables import broadcast_small, table

FDR = 0.01
NEIGHBOURS, CLOSE = 25, 3
#: Of finished phrases, the share of their occurrences that are ends is taken as Beta(ENDS, 1): high, but not always 1.
ENDS = 3


def length_hazards(lengths: DataFrame, neighbours: int = NEIGHBOURS, fdr: float = FDR) -> DataFrame:
    """(source, n_chars, n, at_risk, neighbour_hazard, log_p, significant) of (source, n_chars) rows.

    ``neighbour_hazard`` is the larger of those of the lengths up to ``neighbours`` and up to ``CLOSE`` away, without the length
    itself: texts of like build crowd at lengths side by side, a field limit cuts at one.
    ``log_p`` is the logarithm of a Chernoff bound on the Poisson probability of at least ``n`` ends.
    ``significant`` controls the false-discovery rate within a source. The table has at most one row
    for each source and length, so its windows stay small whatever the number of texts.
    """
    hist = lengths.groupBy("source", "n_chars").agg(F.count("*").alias("n"))
    by_len = Window.partitionBy("source").orderBy("n_chars")
    hist = hist.withColumn("at_risk", F.sum("n").over(Window.partitionBy("source").orderBy(F.desc("n_chars")).rowsBetween(Window.unboundedPreceding, 0)))
    # lengths that no text has have no row; their share of the risk is that of the rows around
    hazard = lambda k: (F.sum("n").over(w := by_len.rangeBetween(-k, k)) - F.col("n") + 0.5) / (F.avg("at_risk").over(w) * (2 * k))
    hist = hist.withColumn("neighbour_hazard", F.greatest(hazard(neighbours), hazard(CLOSE)))
    lam = F.col("at_risk") * F.col("neighbour_hazard")
    hist = hist.withColumn("log_p", F.when(F.col("n") > lam, -(F.col("n") * F.log(F.col("n") / lam) - F.col("n") + lam)).otherwise(F.lit(0.0)))
    by_p = Window.partitionBy("source").orderBy("log_p", "n_chars")
    hist = hist.withColumn("__rank", F.row_number().over(by_p)).withColumn("__m", F.count("*").over(Window.partitionBy("source")))
    passed = F.when(F.col("log_p") <= F.log(F.lit(fdr) * F.col("__rank") / F.col("__m")), F.col("__rank"))
    hist = hist.withColumn("significant", F.coalesce(F.col("__rank") <= F.max(passed).over(Window.partitionBy("source")), F.lit(False)))
    return hist.drop("__rank", "__m")


def _closed(sentence: Column) -> Column:
    """The sentence has a closing mark, and no ellipsis."""
    end = F.rtrim(sentence, F.lit("\"'”’») "))
    return F.right(end, F.lit(1)).isin(*".!?。！？") & ~F.endswith(end, F.lit("..."))


def features(df: DataFrame, text: str, source: str, keep: list[str]) -> DataFrame:
    """One narrow row for each row of ``df``: ``keep``, the source, length, kind of ending and its keys.

    ``ending``: 'missing' (NULL, blank or a stand-in), 'mark' (a marker that only a cut leaves, a broken tag or entity),
    'dots' (an ellipsis), 'whole' (a closing mark or a labelled reference), 'open' (none of them). ``last`` is the flat last
    sentence of 'dots' and 'open' endings.
    """
    t, body, last, kind = F.col("__text"), F.col("__body"), F.col("__last"), F.col("__kind")
    df = df.select(*keep, F.coalesce(F.col(source), F.lit("unknown")).alias("source"), F.col(text).alias("__text"))
    df = T.with_body(df.withColumns({"n_chars": F.length(t), "__missing": T.is_missing(t)}), "__text", "__body")
    df = df.withColumn("__tail", fenced(F.right(body, F.lit(T.MARK_CHARS))))
    df = df.withColumn("__kind", fenced(F.when(F.col("__missing"), "missing").when(T.is_cut_mark(F.col("__tail")), "mark").when(T.is_dots(body), "dots")))
    df = df.withColumn("__last", fenced(T.last_sentence(body)))
    whole = (last == "") | _closed(last) | F.rlike(last, F.lit(T.LABEL))
    df = df.withColumn("ending", fenced(F.when(kind.isNotNull(), kind).when(F.coalesce(whole, F.lit(True)), "whole").otherwise("open")))
    return df.select(*keep, "source", "n_chars", "ending", F.xxhash64(F.substring("__text", 1, 40)).alias("opening"), F.when(F.col("ending").isin("dots", "open"), flat(last)).alias("last"))


def flat_bodies(df: DataFrame, text: str) -> DataFrame:
    """(flat) of each text that is not missing, without what follows its end."""
    rows = df.select(F.col(text).alias("__text")).where(~T.is_missing(F.col("__text")))
    return T.with_body(rows, "__text", "__body").select(flat(F.col("__body")).alias("flat"))


def _ends_seldom(n_on: Column, n_end: Column) -> Column:
    """Logarithm of the probability that a finished phrase ends at most ``n_end`` times of all: a Beta-binomial tail."""
    term = lambda n: sum((F.log(n + i) for i in range(1, ENDS + 1)), F.lit(0.0))
    return term(n_end) - term(n_on + n_end)


def discoveries(rows: DataFrame, group: str, log_p: str, fdr: float = FDR) -> DataFrame:
    """``rows`` with ``found``: under control of the false-discovery rate within ``group`` (Benjamini-Hochberg).

    Ranks come from counts of tenths of ``log_p``, rounded to the safe side, so no window holds the rows of a group.
    """
    rows = rows.withColumn("__b", F.least(F.floor(F.coalesce(F.col(log_p), F.lit(0.0)) * -10), F.lit(5000)).cast("int"))
    hist = rows.groupBy(group, "__b").agg(F.count("*").alias("__n"))
    up = Window.partitionBy(group).orderBy(F.desc("__b")).rowsBetween(Window.unboundedPreceding, 0)
    passed = F.col("__b") / -10 <= F.log(F.lit(fdr) * F.sum("__n").over(up) / F.sum("__n").over(Window.partitionBy(group)))
    least = hist.select(group, F.when(passed, F.col("__b")).alias("__b")).groupBy(group).agg(F.min("__b").alias("__least"))
    return rows.join(broadcast_small(least), group, "left").withColumn("found", F.coalesce(F.col("__b") >= F.col("__least"), F.lit(False))).drop("__b", "__least")


def truncated(df: DataFrame, text: str, source: str, keep: list[str], formula_share: float = 0.5, least: int = 3) -> DataFrame:
    """``keep``, source, n_chars, ending and ``cut`` (never NULL) for each row of ``df``.

    A text ends cut if it holds a marker that only a cut leaves; if it ends in an ellipsis, unless
    its last sentence is a closing formula (at least ``least`` texts that open differently end so, and
    they are ``formula_share`` of all sentences that begin like it); or if it has no closing mark and its last letters behind
    the words before them go on elsewhere and end there far less often than finished phrases do, or its length is one at
    which its source cuts. NULL, blank and
    stand-in texts are not cut. Repeated rows and ties are judged alike; an empty table gives none.
    ``keep`` must hold a column that names the row. A NULL source counts as 'unknown'.
    """
    # used several times below; narrow, and costly to make
    rows = materialised(features(df, text, source, keep))
    hazards = length_hazards(rows.where(F.col("ending") != "missing").select("source", "n_chars")).where("significant").select("source", "n_chars", F.lit(True).alias("at_limit"))
    asked = F.col("ending").isin("dots", "open")
    open_rows = materialised(asked_keys(rows.where(asked).withColumn("whole_key", F.xxhash64(F.translate("last", "123456789", "000000000"))), "last"))
    # an ellipsis asks for its beginning, another ending for its last words
    keys = F.when(F.col("ending") == "dots", F.array("key_start")).otherwise(F.array("key_two", "key_one"))
    known = materialised(evidence(flat_bodies(df, text), "flat", open_rows.select(F.explode(keys).alias("key"))))
    dots = open_rows.where(F.col("ending") == "dots")
    equal = dots.groupBy("whole_key").agg(F.count_distinct("opening").alias("n_equal"))
    dots = dots.join(equal, "whole_key").join(known.select(F.col("key").alias("key_start"), F.col("n_on").alias("n_start")), "key_start", "left")
    formula = F.col("key_start").isNotNull() & (F.col("n_equal") >= least) & (F.col("n_equal") >= formula_share * F.coalesce(F.col("n_start"), F.lit(1)))
    out = [*keep, "source", "n_chars", "ending"]
    ends = open_rows.where(F.col("ending") == "open")
    for k in ("two", "one"):
        zero = {f"n_on_{k}": 0, f"n_end_{k}": 0}
        ends = ends.join(known.select(F.col("key").alias(f"key_{k}"), F.col("n_on").alias(f"n_on_{k}"), F.col("n_end").alias(f"n_end_{k}")), f"key_{k}", "left").fillna(zero)
    two, one = _ends_seldom(F.col("n_on_two"), F.col("n_end_two")), _ends_seldom(F.col("n_on_one"), F.col("n_end_one"))
    # seldom two words: the word before alone may tell more; of two tests the better counts half
    log_p = F.when(F.col("n_end_two") == 0, F.least(F.lit(0.0), F.least(two, one) + F.log(F.lit(2.0)))).otherwise(two)
    ends = discoveries(ends.withColumn("log_p", log_p), "source", "log_p").join(broadcast_small(hazards), ["source", "n_chars"], "left")
    cut = F.col("found") | F.coalesce(F.col("at_limit"), F.lit(False))
    judged = ends.select(*out, cut.alias("cut")).unionByName(dots.select(*out, (~formula).alias("cut")))
    return judged.unionByName(rows.where(~asked).select(*out, (F.col("ending") == "mark").alias("cut")))


def _job_cache(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "job_cache").select("ord", F.element_at("sources", 1).alias("board"), "description_snippet")


def p1_found(spark, sf_dir: str) -> DataFrame:
    """(ord) of each row whose description ends inside a word or sentence because the rest was lost."""
    return truncated(_job_cache(spark, sf_dir), "description_snippet", "board", ["ord"]).where("cut").select("ord")


def p1_rates(spark, sf_dir: str) -> DataFrame:
    """(board, n_texts, n_cut, cut_share): how often each board truncates its descriptions."""
    rows = truncated(_job_cache(spark, sf_dir), "description_snippet", "board", ["ord"]).where(F.col("ending") != "missing")
    return rows.groupBy(F.col("source").alias("board")).agg(F.count("*").alias("n_texts"), F.count_if("cut").alias("n_cut")).withColumn("cut_share", F.round(F.col("n_cut") / F.col("n_texts"), 4))


def p1_limits(spark, sf_dir: str) -> DataFrame:
    """(board, n_chars, n, at_risk): lengths at which more texts of a board end than chance explains."""
    rows = _job_cache(spark, sf_dir).where(~T.is_missing(F.col("description_snippet")))
    hazards = length_hazards(rows.select(F.coalesce("board", F.lit("unknown")).alias("source"), F.length("description_snippet").alias("n_chars")))
    return hazards.where("significant").select(F.col("source").alias("board"), "n_chars", "n", "at_risk")


def _p1_limits_sql() -> str:
    """The windows of :func:`length_hazards` for DuckDB; written out, with the same lists of stand-ins and blanks."""
    blanks = "chr(32) || chr(9) || chr(13) || chr(10) || chr(160) || chr(8203) || chr(65279)"
    stand_ins = ", ".join("'" + x.replace("'", "''") + "'" for x in T.STAND_INS)
    hazard = lambda k: f"(sum(n) OVER (PARTITION BY source ORDER BY n_chars RANGE BETWEEN {k} PRECEDING AND {k} FOLLOWING) - n + 0.5) / (avg(at_risk) OVER (PARTITION BY source ORDER BY n_chars RANGE BETWEEN {k} PRECEDING AND {k} FOLLOWING) * {2 * k})"
    return f"""
WITH t AS (SELECT coalesce(sources[1], 'unknown') AS source, description_snippet AS d, trim(description_snippet, {blanks}) AS b FROM job_cache WHERE description_snippet IS NOT NULL),
     l AS (SELECT source, length(d) AS n_chars FROM t WHERE regexp_matches(d, '[\\p{{L}}\\p{{N}}]') AND NOT (length(b) <= {T.STAND_IN_CHARS} AND rtrim(lower(b), '. ') IN ({stand_ins}))),
     h AS (SELECT source, n_chars, count(*) AS n FROM l GROUP BY 1, 2),
     r AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY n_chars DESC ROWS UNBOUNDED PRECEDING)::BIGINT AS at_risk FROM h),
     z AS (SELECT *, greatest({hazard(NEIGHBOURS)}, {hazard(CLOSE)}) AS hazard FROM r),
     p AS (SELECT *, CASE WHEN n > at_risk * hazard THEN -(n * ln(n / (at_risk * hazard)) - n + at_risk * hazard) ELSE 0 END AS log_p FROM z),
     k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY log_p, n_chars) AS rank, count(*) OVER (PARTITION BY source) AS m FROM p),
     s AS (SELECT *, max(CASE WHEN log_p <= ln({FDR} * rank / m) THEN rank END) OVER (PARTITION BY source) AS last FROM k)
SELECT source AS board, n_chars::INTEGER AS n_chars, n, at_risk FROM s WHERE rank <= last
"""


P1_LIMITS_SQL = _p1_limits_sql()
