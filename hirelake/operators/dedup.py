"""First-occurrence rules, source collection and duplicate reports over ordered postings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hirelake.functions import text as T
from hirelake.session import cut
from hirelake.sources.tables import broadcast_small


def positions(df: DataFrame, order: str, name: str = "pos") -> DataFrame:
    """``df`` with ``name``: 0, 1, ... without gaps in the order of ``order``, which must be unique.

    Rows are dealt to ranges and their partition is fixed by a checkpoint; counts of the partitions, of which there are few,
    give where each begins, so no single task numbers all rows.
    """
    parts = cut(df.repartitionByRange(order).withColumn("__p", F.spark_partition_id()))
    sizes = parts.groupBy("__p").agg(F.count("*").alias("__c")).withColumn("__before", F.sum("__c").over(Window.orderBy("__p")) - F.col("__c"))
    local = F.row_number().over(Window.partitionBy("__p").orderBy(order))
    rows = parts.withColumn("__i", local).join(broadcast_small(sizes.drop("__c")), "__p")
    return rows.withColumn(name, F.col("__before") + F.col("__i") - 1).drop("__p", "__i", "__before")


def first_per(df: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """The first row of each key by ``order``; rows with a NULL key form a group too. Combined before the shuffle, so a hot
    key is no burden."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("__r"))
    return best.select(*(c if c in keys else F.col(f"__r.{c}").alias(c) for c in df.columns))


def mark_duplicates(df: DataFrame, url: str = "url", title: str = "title", key: str = "key", order: str = "ord") -> DataFrame:
    """``df`` with ``dup``: no or seen url, empty title, or seen key among rows that passed before.

    A url counts as seen even where its title is empty; a row rejected later still blocks its key.
    ``order`` must be unique.
    """
    has_url = F.coalesce(F.col(url), F.lit("")) != ""
    titled = T.strip(F.coalesce(F.col(title), F.lit(""))) != ""
    # least positions by aggregation, joined back on the position: no group of rows goes to one task
    first_url = df.where(has_url).groupBy(url).agg(F.min(order).alias(order)).select(order, F.lit(True).alias("__first"))
    df = df.join(first_url, order, "left").withColumn("__ok", F.coalesce(F.col("__first"), F.lit(False)) & titled).drop("__first")
    first_key = df.where("__ok").groupBy(key).agg(F.min(order).alias(order)).select(order, F.lit(True).alias("__first"))
    return df.join(first_key, order, "left").withColumn("dup", F.col("__first").isNull()).drop("__ok", "__first")


def union_first(parts: list[DataFrame], key: str, order: str = "ord") -> DataFrame:
    """Left-priority union: of rows with one ``key`` the one of the earliest part stays, then of least ``order``."""
    both = None
    for i, p in enumerate(parts):
        p = p.withColumn("__part", F.lit(i))
        both = p if both is None else both.unionByName(p, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (key, "__part")]
    best = both.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct("__part", order)).alias("__r"))
    return best.select(*(c if c == key else F.col(f"__r.{c}").alias(c) for c in both.columns if c != "__part"))


def sources_of_keys(df: DataFrame, key: str = "key", source: str = "source", order: str = "ord", payload: list[str] | None = None) -> DataFrame:
    """(key, entries): for each key its first entry per source, in order of first appearance.

    The number of entries of a key is bounded by the number of sources, whatever its number of rows.
    """
    fields = payload or ["url", "date_posted"]
    per = df.groupBy(key, source).agg(F.min(F.struct(order, *fields)).alias("e"))
    entry = F.struct(F.col(f"e.{order}").alias("at"), F.col(source).alias("source"), *(F.col(f"e.{f}").alias(f) for f in fields))
    return per.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("entries"))


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def urls_under_several_keys(df: DataFrame, key: str = "key", url: str = "url", more: str = "raw_sources") -> DataFrame:
    """(url, n_keys): urls, of the row or of its source entries, that stand under more than one key."""
    urls = F.array_distinct(F.concat(F.array(F.col(url)), F.coalesce(F.transform(more, lambda s: s["url"]), F.array().cast("array<string>"))))
    long = df.select(key, F.explode(urls).alias("url")).where(F.coalesce(F.col("url"), F.lit("")) != "")
    return long.groupBy("url").agg(F.count_distinct(key).alias("n_keys")).where("n_keys > 1")


def keys_of_urls(df: DataFrame, urls: DataFrame, key: str = "key", url: str = "url", more: str = "raw_sources", order: str = "ord") -> DataFrame:
    """(url, keys): for each of a few ``urls`` its different keys in order of first appearance."""
    all_urls = F.array_distinct(F.concat(F.array(F.col(url)), F.coalesce(F.transform(more, lambda s: s["url"]), F.array().cast("array<string>"))))
    long = df.select(key, order, F.explode(all_urls).alias("url")).join(broadcast_small(urls.select("url")), "url", "left_semi")
    first = long.groupBy("url", key).agg(F.min(order).alias("o"))
    return first.groupBy("url").agg(F.array_sort(F.collect_list(F.struct("o", F.col(key).alias("k")))).alias("ks")).select("url", F.transform("ks", lambda x: x["k"]).alias("keys"))
