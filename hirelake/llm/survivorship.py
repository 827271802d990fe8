"""One surviving record for each group of duplicates, its best values taken field by field.

Fields are unpivoted into long rows (group, field, value). Each row votes for its normalised value
with the trust of its source times a decay of its age; votes are summed per value, the winner of each
field is chosen by ``max_by``, and winners are pivoted back to one record. Fields with an
order of merit of their own are settled by it alone, without votes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.functions.plan import fenced
from hirelake.functions.timestamps import with_utc
from hirelake.llm import textparts as T
from hirelake.llm.truncation import truncated
from hirelake.sources.tables import broadcast_small, table

ABSOLUTE_URL = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/\s]+"
HALF_LIFE_DAYS = 30.0


def winners(long: DataFrame, order: list[str]) -> DataFrame:
    """(key, field, n_rows, ord) of the best row of each key and field by the columns in ``order``.

    Rows whose first order column is NULL cannot win but count in ``n_rows``; ``ord`` is NULL where
    no row can. The last order column must be unique, which settles every tie.
    """
    rank = F.when(F.col(order[0]).isNotNull(), F.struct(*order))
    return long.groupBy("key", "field").agg(F.count("*").alias("n_rows"), F.max_by("ord", rank).alias("ord"))


def description_merit(rows: DataFrame) -> DataFrame:
    """(ord, merit, size) of (ord, source, description): whole 3, whole with clutter 2, cut 1, missing NULL.

    ``size`` orders cut texts by their characters and is 0 for whole ones.
    """
    judged = truncated(rows, "description", "source", ["ord", "cluttered"])
    merit = F.when(F.col("ending") == "missing", None).when(F.col("cut"), 1).when(F.col("cluttered"), 2).otherwise(3)
    return judged.select("ord", merit.cast("bigint").alias("merit"), F.when(F.col("cut"), F.col("n_chars")).otherwise(0).cast("bigint").alias("size"))


def source_list_merit(rows: DataFrame, boards: DataFrame) -> DataFrame:
    """(ord, merit) of (ord, raw_sources, time_zone, locale, fetched_at): how many different sources
    have an entry with an absolute url and a date that names a day or instant; rows with none are left out.

    Sources are compared without letter case and outer spaces; dates are read in the zone and locale
    of the entry's own board where it is known.
    """
    e = rows.select("ord", "time_zone", "locale", "fetched_at", F.explode("raw_sources").alias("e"))
    e = e.select("ord", "time_zone", "locale", "fetched_at", F.lower(F.btrim("e.source")).alias("board"), F.col("e.url").alias("url"), F.col("e.date_posted").alias("date_posted"))
    e = e.where((F.col("board") != "") & F.rlike("url", F.lit(ABSOLUTE_URL)) & F.col("date_posted").isNotNull())
    own = boards.select("board", F.col("time_zone").alias("own_zone"), F.col("locale").alias("own_locale"))
    e = e.join(broadcast_small(own), "board", "left").withColumns({"time_zone": F.coalesce("own_zone", "time_zone"), "locale": F.coalesce("own_locale", "locale")})
    e = with_utc(e, "date_posted", "time_zone", "locale", "fetched_at").where(F.col("utc_us").isNotNull())
    return e.groupBy("ord").agg(F.count_distinct("board").alias("merit"))


def _rows(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    boards = table(spark, sf_dir, "board_list")
    rows = table(spark, sf_dir, "job_cache").withColumn("board", F.element_at("sources", 1))
    return rows.join(broadcast_small(boards.select("board", "time_zone", "locale", "trust")), "board", "left"), boards


def _long(spark, sf_dir: str, least_rows: int = 1) -> DataFrame:
    """(key, field, ord, merit, size, fetched_at) for the fields with an order of merit of their own,
    for keys of at least ``least_rows`` rows. Whether a text is cut is judged against all texts."""
    rows, boards = _rows(spark, sf_dir)
    texts = rows.select("ord", F.col("board").alias("source"), F.col("description_snippet").alias("description"), T.has_clutter(F.col("description_snippet")).alias("cluttered"))
    rows = rows.where(F.col("dedup_key").isNotNull())
    if least_rows > 1:
        rows = rows.join(rows.groupBy("dedup_key").agg(F.count("*").alias("__n")).where(F.col("__n") >= least_rows), "dedup_key", "left_semi")
    base = rows.select("ord", F.col("dedup_key").alias("key"), "fetched_at")
    d = description_merit(texts).withColumnsRenamed({"merit": "d_merit", "size": "d_size"})
    s = source_list_merit(rows, boards).withColumnRenamed("merit", "s_merit")
    wide = base.join(d, "ord", "left").join(s, "ord", "left")
    fields = F.array(
        F.struct(F.lit("description_snippet").alias("field"), F.col("d_merit").alias("merit"), F.col("d_size").alias("size")),
        F.struct(F.lit("raw_sources").alias("field"), F.col("s_merit").alias("merit"), F.lit(0).cast("bigint").alias("size")),
    )
    return wide.select("key", "ord", "fetched_at", F.inline(fields))


def p3_found(spark, sf_dir: str) -> DataFrame:
    """(dedup_key, field, ord): the row whose description and source list survive, for each key of two or more rows.

    By the order of merit alone: it ends in the unique ``ord``, so no votes are computed here and nothing is pivoted."""
    best = winners(_long(spark, sf_dir, least_rows=2), ["merit", "size", "fetched_at", "ord"])
    return best.where((F.col("n_rows") > 1) & F.col("ord").isNotNull()).select(F.col("key").alias("dedup_key"), "field", "ord")


def survivors(rows: DataFrame, key: str, fields: list[str], source_trust: str, seen_at: str, order: str, half_life_days: float = HALF_LIFE_DAYS) -> DataFrame:
    """(key, n_rows, one column per field): the value with the largest vote for each key and field.

    Values are text columns, compared without letter case, outer and repeated spaces; the form kept
    is that of the newest row with the winning value, then the one of largest ``order``. Votes decay
    with the age of a row against the newest row of all. NULL and blank values do not vote; a field
    without any is NULL. Rows with a NULL key form no group. An empty table gives no rows.
    """
    newest = rows.agg(F.max(seen_at).alias("__newest"))
    base = rows.where(F.col(key).isNotNull()).crossJoin(F.broadcast(newest))  # one row
    entries = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields))
    long = base.select(F.col(key).alias("key"), F.col(source_trust).alias("trust"), F.col(seen_at).alias("seen"), F.col(order).alias("ord"), ((F.unix_micros("__newest") - F.unix_micros(seen_at)) / 86_400_000_000).alias("age_days"), F.inline(entries))
    norm = F.regexp_replace(F.lower(F.btrim("value")), r"\s+", " ")
    long = long.withColumn("value_key", fenced(F.when(norm != "", norm)))
    weight = F.coalesce(F.col("trust"), F.lit(1)) * F.pow(F.lit(0.5), F.coalesce(F.col("age_days"), F.lit(0.0)) / half_life_days)
    per_value = long.groupBy("key", "field", "value_key").agg(
        F.round(F.sum(weight), 6).alias("vote"), F.count("*").alias("n"), F.max_by("value", F.struct("seen", "ord")).alias("value"), F.max(F.struct("seen", "ord")).alias("last")
    )
    best = F.max_by("value", F.when(F.col("value_key").isNotNull(), F.struct("vote", "last", "value_key")))
    per_field = per_value.groupBy("key", "field").agg(best.alias("value"), F.sum("n").alias("n"))
    return per_field.groupBy("key").pivot("field", fields).agg(F.first("value")).join(rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n_rows")), "key").select(F.col("key").alias(key), "n_rows", *fields)


def p3_survivors(spark, sf_dir: str) -> DataFrame:
    """One record for each dedup_key: title, company, location, is_complete by votes; description and
    source list from the rows that :func:`p3_found` names (their ord)."""
    rows, _ = _rows(spark, sf_dir)
    voted = survivors(rows.withColumn("is_complete", F.col("is_complete").cast("string")), "dedup_key", ["title", "company", "location", "is_complete"], "trust", "fetched_at", "ord")
    best = winners(_long(spark, sf_dir), ["merit", "size", "fetched_at", "ord"])
    picked = best.groupBy(F.col("key").alias("dedup_key")).pivot("field", ["description_snippet", "raw_sources"]).agg(F.first("ord"))
    return voted.join(picked.withColumnsRenamed({"description_snippet": "description_ord", "raw_sources": "raw_sources_ord"}), "dedup_key", "left").withColumn("is_complete", F.col("is_complete").cast("boolean"))


P3_VOTES_SQL = """
WITH r AS (
  SELECT j.dedup_key, j.ord, j.title, j.company, j.location, CAST(j.is_complete AS VARCHAR) AS is_complete, j.fetched_at, COALESCE(b.trust, 1) AS trust,
         (epoch_us((SELECT MAX(fetched_at) FROM job_cache)) - epoch_us(j.fetched_at)) / 86400000000.0 AS age_days
  FROM job_cache j LEFT JOIN board_list b ON b.board = j.sources[1] WHERE j.dedup_key IS NOT NULL
), l AS (
  SELECT dedup_key, ord, fetched_at, trust, age_days, 'title' AS field, title AS value FROM r
  UNION ALL SELECT dedup_key, ord, fetched_at, trust, age_days, 'company', company FROM r
  UNION ALL SELECT dedup_key, ord, fetched_at, trust, age_days, 'location', location FROM r
  UNION ALL SELECT dedup_key, ord, fetched_at, trust, age_days, 'is_complete', is_complete FROM r
), n AS (
  SELECT *, NULLIF(regexp_replace(lower(trim(value, ' ')), '\\s+', ' ', 'g'), '') AS k FROM l
), v AS (
  SELECT dedup_key, field, k, round(SUM(trust * pow(0.5, COALESCE(age_days, 0) / 30.0)), 6) AS vote,
         arg_max(value, (epoch_us(fetched_at), ord)) AS value, MAX((epoch_us(fetched_at), ord)) AS last
  FROM n WHERE k IS NOT NULL GROUP BY ALL
), w AS (
  SELECT dedup_key, field, value FROM v QUALIFY row_number() OVER (PARTITION BY dedup_key, field ORDER BY vote DESC, last DESC, k DESC) = 1
)
SELECT r.dedup_key, COUNT(DISTINCT r.ord) AS n_rows,
       MAX(CASE WHEN w.field = 'title' THEN w.value END) AS title, MAX(CASE WHEN w.field = 'company' THEN w.value END) AS company,
       MAX(CASE WHEN w.field = 'location' THEN w.value END) AS location, MAX(CASE WHEN w.field = 'is_complete' THEN w.value END) AS is_complete
FROM r LEFT JOIN w ON w.dedup_key = r.dedup_key GROUP BY r.dedup_key
"""


def p3_votes(spark, sf_dir: str) -> DataFrame:
    """The voted fields alone, one record for each dedup_key."""
    rows, _ = _rows(spark, sf_dir)
    return survivors(rows.withColumn("is_complete", F.col("is_complete").cast("string")), "dedup_key", ["title", "company", "location", "is_complete"], "trust", "fetched_at", "ord")
