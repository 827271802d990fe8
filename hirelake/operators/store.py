"""Keyed stores as pure functions: old table and new rows in, whole resulting table out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hirelake.functions import text as T
from hirelake.operators.dedup import first_per, positions


def first_write_wins(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Insert if absent: the old row of a key stays; of several new ones the first by ``order``."""
    return old.unionByName(first_per(new.join(old.select(key), key, "left_anti"), [key], order).select(*old.columns))


def last_write_wins(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The newest row of each key; ``order`` must end in a unique column."""
    rest = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return best.select(key, *(F.col(f"r.{c}").alias(c) for c in rest))


def folded(df: DataFrame, key: str = "dedup_key", order: str = "ord") -> DataFrame:
    """One row for each key: what saving its rows one after another in ``order`` leaves.

    Plain fields stay those of the first row. Of several rows the sources are joined without repeats; of source entries those of a row
    are kept in which their source comes first; expiry and assessment are those of the last row that has them. A key of one row
    keeps it as it is. Only (key, source) pairs are gathered, never the rows of a key. NULL keys form no row.
    """
    df = df.where(F.col(key).isNotNull())
    entries = df.schema["raw_sources"].dataType
    special = ("sources", "raw_sources", "expires_at", "assessment")
    plain = [c for c in df.columns if c not in (*special, key)]
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c)
    best = df.groupBy(key).agg(F.min_by(F.struct(*plain, *(F.col(c).alias(f"__{c}") for c in ("sources", "raw_sources"))), order).alias("__r"), F.count("*").alias("__n"), last("expires_at"), last("assessment"))
    repeated = df.join(best.where("__n > 1").select(key), key, "left_semi")
    src = repeated.select(key, F.col(order).alias("o"), F.posexplode("sources").alias("p", "s"))
    first = src.groupBy(key, "s").agg(F.min(F.struct("o", "p")).alias("at"))
    joined = first.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "s"))).alias("l")).select(key, F.transform("l", lambda x: x["s"]).alias("sources"))
    raw = repeated.select(key, F.col(order).alias("o"), F.posexplode("raw_sources").alias("p", "e")).withColumn("s", F.coalesce("e.source", F.lit("")))
    opens = raw.groupBy(key, "s").agg(F.min("o").alias("o"))
    kept = raw.join(opens, [key, "s", "o"], "left_semi").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("o", "p", "e"))).alias("l"))
    kept = kept.select(key, F.transform("l", lambda x: x["e"]).cast(entries).alias("raw_sources"))
    rows = best.join(joined, key, "left").join(kept, key, "left")
    many = F.col("__n") > 1
    none = {"sources": F.array().cast("array<string>"), "raw_sources": F.array().cast(entries)}
    merged = {c: F.when(many, F.coalesce(c, none[c])).otherwise(F.col(f"__r.__{c}")).alias(c) for c in none}
    return rows.select(*(merged.get(c, F.col(c) if c in (key, *special) else F.col(f"__r.{c}").alias(c)) for c in df.columns))


def upsert_merge(old: DataFrame, new: DataFrame, key: str = "dedup_key") -> DataFrame:
    """Upsert of job records. Both sides hold one row for each key.

    Of a known key the sources are joined in order without repeats, source entries are added whose
    source is not there yet, expiry and assessment are taken from the new row if it has them, and all
    else stays as it was. An unknown key is inserted.
    """
    o, n = old.alias("o"), new.alias("n")
    known = F.col(f"o.{key}").isNotNull()
    names = F.transform(F.coalesce("o.raw_sources", F.array().cast(old.schema["raw_sources"].dataType)), lambda s: s["source"])
    extra = F.filter(F.coalesce("n.raw_sources", F.array().cast(old.schema["raw_sources"].dataType)), lambda s: ~F.coalesce(F.array_contains(names, F.coalesce(s["source"], F.lit(""))), F.lit(False)))
    special = {
        key: F.coalesce(f"o.{key}", f"n.{key}"),
        "sources": F.array_distinct(F.concat(F.coalesce("o.sources", F.array().cast("array<string>")), F.coalesce("n.sources", F.array().cast("array<string>")))),
        "raw_sources": F.concat(F.coalesce("o.raw_sources", F.array().cast(old.schema["raw_sources"].dataType)), extra),
        "expires_at": F.coalesce("n.expires_at", "o.expires_at"),
        "assessment": F.coalesce("n.assessment", "o.assessment"),
    }
    keep = {c: F.when(known, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")) for c in old.columns if c not in special}
    joined = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    return joined.select(*(special.get(c, keep.get(c)).alias(c) for c in old.columns))


def without_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key), key, "left_anti")


def with_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key), key, "left_semi")


def append_numbered(old: DataFrame, new: DataFrame, id_column: str, order: str) -> DataFrame:
    """Append with ids that go on from the largest old one, in the order of ``order``; dense over the batch of new rows."""
    top = old.agg(F.coalesce(F.max(id_column), F.lit(0)).alias("__top"))
    numbered = positions(new, order, "__pos").crossJoin(F.broadcast(top))  # one row
    return old.unionByName(numbered.withColumn(id_column, F.col("__top") + F.col("__pos") + 1).drop("__pos", "__top"))


def source_appended(df: DataFrame, keys: DataFrame, key: str, source: str) -> DataFrame:
    """``source`` appended to the sources of the rows of ``keys`` that lack it; all other rows, and unknown keys, change nothing."""
    known = df.join(keys.select(key).distinct().withColumn("__known", F.lit(True)), key, "left")
    have = F.coalesce("sources", F.array().cast("array<string>"))
    appended = F.when(F.array_contains(have, source), have).otherwise(F.concat(have, F.array(F.lit(source))))
    return known.withColumn("sources", F.when(F.col("__known"), appended).otherwise(F.col("sources"))).drop("__known")


def normalised_jobs(rows: DataFrame) -> DataFrame:
    """Incoming records (title, company, location, url, description, date_posted, sources, raw_sources, expires_ts, is_complete, and
    others) in the form of the store, with their ``dedup_key``.

    Without sources the domain of the url is the source; without source entries the first source makes one, with the url and date.
    A NULL completeness counts as complete, NULL texts as empty.
    """
    empty = F.array().cast("array<string>")
    domain = T.domain(F.col("url"))
    sources = F.when(F.size(F.coalesce("sources", empty)) > 0, F.col("sources")).when(domain != "", F.array(domain)).otherwise(empty)
    rows = rows.withColumns({c: F.coalesce(c, F.lit("")) for c in ("title", "company", "location", "url", "description", "date_posted")}).withColumn("sources", sources)
    kind = "array<struct<source: string, url: string, date_posted: string>>"
    entry = F.array(F.struct(F.get("sources", F.lit(0)).alias("source"), F.col("url"), F.col("date_posted"))).cast(kind)
    have = F.coalesce(F.col("raw_sources").cast(kind), F.array().cast(kind))
    rows = rows.withColumn("raw_sources", F.when((F.size(have) == 0) & (F.size("sources") > 0), entry).otherwise(have))
    return rows.withColumns({"is_complete": F.coalesce("is_complete", F.lit(True)), "dedup_key": T.posting_key(F.col("company"), F.col("title"))})


def cleared(tables: dict[str, DataFrame], keep: tuple[str, ...] = ("search_stats",)) -> dict[str, DataFrame]:
    """All tables emptied but those of ``keep``."""
    return {name: df if name in keep else df.limit(0) for name, df in tables.items()}


def conformed(df: DataFrame, schema: StructType, defaults: dict | None = None) -> DataFrame:
    """``df`` in the columns of ``schema``: columns that an older table lacks are added, NULL or from ``defaults``; others are kept as
    far as the schema knows them."""
    value = lambda f: F.col(f.name) if f.name in df.columns else F.lit((defaults or {}).get(f.name))
    return df.select(*(value(f).cast(f.dataType).alias(f.name) for f in schema.fields))
