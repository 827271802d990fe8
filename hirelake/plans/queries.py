"""Queries over the project's tables, one for each operator; all read whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hirelake.functions import predicates as P
from hirelake.functions import text as T
from hirelake.functions.timestamps import with_utc
from hirelake.operators import dedup as D
from hirelake.operators import scoring as S
from hirelake.operators import store as K
from hirelake.plans import funnel
from hirelake.session import cut
from hirelake.sources.files import log_tail
from hirelake.sources.tables import broadcast_small, spread, table

NOW = "2025-07-01 00:00:00"
SKILLS = ["python", "kotlin", "spreadsheets", "static analysis", "forklift", "exam", "rust"]
ROLE_WORDS = ["backend", "data", "platform", "nurse", "teacher", "chef", "chemist", "clerk", "driver", "coach", "paralegal", "planner"]
WHO = funnel.Candidate("mid", 10, ROLE_WORDS, SKILLS)
#: The boards of a composite scan; rows of the first go before those of the second.
SCANNED = ["jobharbour.example", "workmesa.example"]
Query = Callable[[SparkSession, str], DataFrame]


def now() -> Column:
    return F.to_timestamp(F.lit(NOW))


def postings(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "job_cache")
    return spread(j.select("ord", "url", "title", "company", "location", F.col("description_snippet").alias("description"), F.element_at("sources", 1).alias("source"), "date_posted"))


def cache(spark: SparkSession, d: str) -> DataFrame:
    """The store as the funnel asks it: every expiry that names a day or instant, in zone and locale of the row's board."""
    boards = table(spark, d, "board_list").select("board", "locale", "time_zone")
    shown = F.coalesce("assessment.is_relevant", F.lit(True)).alias("relevant")
    j = table(spark, d, "job_cache").select("ord", "dedup_key", "url", "fetched_at", "expires_at", F.col("assessment").isNotNull().alias("assessed"), _c("assessment.score").cast("bigint").alias("score"), shown, F.element_at("sources", 1).alias("board"))
    j = with_utc(spread(j).join(broadcast_small(boards), "board", "left"), "expires_at", "time_zone", "locale", "fetched_at", "expires_us")
    return j.select("ord", "dedup_key", "url", "fetched_at", F.timestamp_micros("expires_us").alias("expires_ts"), "assessed", "score", "relevant")


def _live(spark: SparkSession, d: str) -> DataFrame:
    return cache(spark, d).where(~P.expired(_c("expires_ts"), _c("fetched_at"), now()))


def _value(make: Callable[[DataFrame], Column], name: str = "value") -> Query:
    return lambda spark, d: postings(spark, d).select("ord", make(None).alias(name))


def _c(name: str) -> Column:
    return F.col(name)


def _kept(condition: Callable[[], Column]) -> Query:
    return lambda spark, d: postings(spark, d).where(condition()).select("ord")


def _reasons(spark: SparkSession, d: str) -> DataFrame:
    return funnel.with_reason(postings(spark, d), WHO, cache(spark, d), now())


def _outcomes(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "job_cache").select("ord", "url", F.col("description_snippet").alias("description"))
    return funnel.assessed(_reasons(spark, d), WHO, texts)


def _raw(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "job_cache").withColumn("key", T.posting_key(_c("company"), _c("title")))


def _old_new(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The store and a batch of arrivals, two thirds and one third of the rows, each saved row by row; together all rows."""
    j = table(spark, d, "job_cache")
    return K.folded(j.where("ord % 3 <> 0")), K.folded(j.where("ord % 3 = 0"))


def _text(c: str) -> Column:
    return F.array_join(c, "|", "")


def _merged(spark: SparkSession, d: str) -> DataFrame:
    m = K.upsert_merge(*_old_new(spark, d))
    names = F.transform("raw_sources", lambda s: F.coalesce(s["source"], F.lit("")))
    return m.select("dedup_key", "ord", _text("sources").alias("sources"), F.array_join(names, "|").alias("entries"), "expires_at", _c("assessment.score").cast("bigint").alias("score"))


FUNNEL_KEYS = [
    "scraped_first", "scraped_second", "scraped_total", "title_filter_in", "title_filter_passed", "title_filter_out", "prefilter_in", *funnel.TOTALS, "llm_assessed", "llm_rejected", "saved",
]


def _funnel_json(spark: SparkSession, d: str) -> DataFrame:
    """The counters of each search; what its report does not name, or no report at all, counts as 0."""
    s = table(spark, d, "search_stats")
    return s.select("id", *(F.coalesce(F.get_json_object("funnel", f"$.{k}").try_cast("bigint"), F.lit(0)).alias(k) for k in FUNNEL_KEYS))


RATES = {
    "filter_rate": lambda: T.rate(_c("scraped_total") - _c("saved"), _c("scraped_total")),
    "llm_pass_rate": lambda: T.rate(_c("llm_assessed") - _c("llm_rejected"), _c("llm_assessed")),
    "llm_title_pass_rate": lambda: T.rate(_c("title_filter_passed"), _c("title_filter_in")),
}


def _rates(*names: str) -> Query:
    return lambda spark, d: _funnel_json(spark, d).select("id", *(RATES[n]().alias(n) for n in names))


def _placed(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows``, of which there are few, with their place in ``order``."""
    return rows.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("bigint"))


def _recent(spark: SparkSession, d: str) -> DataFrame:
    """The 200 newest records, of which expired ones then go."""
    return cache(spark, d).orderBy(F.desc("fetched_at"), F.desc("ord")).limit(200).where(~P.expired(_c("expires_ts"), _c("fetched_at"), now()))


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    """The newest records but rejected ones, best score first; without a score last, ties newest first."""
    shown = _recent(spark, d).where(~(_c("assessed") & ~_c("relevant"))).withColumn("score", F.coalesce("score", F.lit(-1)))
    return _placed(shown, F.desc("score"), F.desc("fetched_at"), F.desc("ord")).select("place", "ord", "score", F.unix_micros("fetched_at").alias("fetched_us"))


def _assessed_view(spark: SparkSession, d: str) -> DataFrame:
    return _placed(_recent(spark, d).where("assessed"), F.desc("score"), F.desc("fetched_at"), F.desc("ord")).select("place", "ord", "score")


def _session_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "search_sessions").select(F.explode("job_dedup_keys").alias("dedup_key"))


def _sliced_then_sorted(spark: SparkSession, d: str) -> DataFrame:
    """Of the live records of the sessions' keys the first 50 by key, then those by score: the slice comes before the sort."""
    first = K.with_keys(_live(spark, d), _session_keys(spark, d), "dedup_key").orderBy("dedup_key", "ord").limit(50).withColumn("score", F.coalesce("score", F.lit(-1)))
    return _placed(first, F.desc("score"), _c("dedup_key"), _c("ord")).select("place", "ord", "score")


def _latest_visits(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "url_visits").where("url is not null")
    return K.last_write_wins(v, "url", ["visited_at", "visit_id"]).select("url", "visit_id", "status")


def _canonical_names(spark: SparkSession, d: str) -> DataFrame:
    """Each group with the title that its name is a variant of: brackets, levels and what follows a dash or comma go."""
    t = table(spark, d, "title_groups").where("canonical is not null")
    base = T.collapse(F.regexp_replace(F.regexp_replace(F.lower("canonical"), r"\(.*?\)", ""), r"\s*[-–|,/].*$", ""))
    base = F.btrim(F.regexp_replace(base, r"^(?:(?:senior|sr\.?|snr|junior|jr\.?|lead|principal|graduate|trainee|interim) )+", ""))
    return t.withColumn("canonical_title", base).where("canonical_title <> ''")


def _canonical_titles(spark: SparkSession, d: str) -> DataFrame:
    """Variants of a title counted together."""
    return _canonical_names(spark, d).groupBy("canonical_title").agg(F.sum("cnt").alias("total"), F.count("*").alias("n_variants"))


def _title_variants(spark: SparkSession, d: str) -> DataFrame:
    return _canonical_names(spark, d).groupBy("canonical_title", F.col("canonical").alias("variant")).agg(F.sum("cnt").alias("n"))


def _final_titles(spark: SparkSession, d: str) -> DataFrame:
    """Title discovery: noise goes, variants are counted together, a scorer ranks, the first five stay."""
    groups = _canonical_names(spark, d).where(~P.noisy_title(_c("canonical"), _c("cnt"))).groupBy(F.col("canonical_title").alias("title")).agg(F.sum("cnt").alias("n"))
    return S.ranked_titles(groups, ROLE_WORDS)


def _title_scan(spark: SparkSession, d: str) -> DataFrame:
    """The first page, of 50 titles, for each search word in each country, counted by title."""
    countries = table(spark, d, "place_list").select("country").distinct()
    j = table(spark, d, "job_cache").where("coalesce(title, '') <> ''").select("ord", "title", F.btrim(F.element_at(F.split("location", ","), -1)).alias("country"))
    words = F.array_compact(F.array(*(F.when(F.contains(F.lower("title"), F.lit(w)), w) for w in ROLE_WORDS[:4])))
    hits = j.join(broadcast_small(countries), "country").select("ord", "title", "country", F.explode(words).alias("word"))
    page = F.row_number().over(Window.partitionBy("word", "country").orderBy("ord"))
    return hits.withColumn("n", page).where("n <= 50").groupBy("title").agg(F.count("*").alias("n"))


def _composite(spark: SparkSession, d: str) -> DataFrame:
    """Two boards as one scan: rows of the first go before those of the second with one url; each has its place and a score of its title."""
    p = postings(spark, d).where("coalesce(url, '') <> ''").select("ord", "url", "title", "company", "location", "source")
    both = D.union_first([D.first_per(p.where(_c("source") == b), ["url"]) for b in SCANNED], "url")
    words = F.size(F.array_intersect(T.title_tokens(_c("title")), F.array(*(F.lit(w) for w in ROLE_WORDS))))
    return both.withColumn("score", F.least(F.lit(1.0), 0.4 + 0.4 * words))


def _scan_counters(spark: SparkSession, d: str) -> DataFrame:
    p = postings(spark, d).where("coalesce(url, '') <> ''")
    per = [F.count_distinct(F.when(_c("source") == b, _c("url"))).alias(f"scraped_{i + 1}") for i, b in enumerate(SCANNED)]
    passed = F.count_if(_c("score") >= 0.6).alias("title_filter_passed")
    merged = _composite(spark, d).agg(F.count("*").alias("scraped_total"), F.count("*").alias("title_filter_in"), passed, F.count_if(_c("score") < 0.6).alias("title_filter_out"))
    return p.agg(*per).crossJoin(merged)  # two one-row frames


def _catalogue(spark: SparkSession, d: str) -> DataFrame:
    """The six last names, in falling order, of the chat models of each provider."""
    m = table(spark, d, "search_stats").where("coalesce(provider, '') <> '' and coalesce(model, '') <> ''").where(P.chat_model(_c("model"), _c("provider"))).select("provider", "model").distinct()
    place = F.row_number().over(Window.partitionBy("provider").orderBy(F.desc("model"))).cast("bigint")
    return m.withColumn("place", place).where("place <= 6")


def _positioned(spark: SparkSession, d: str) -> DataFrame:
    return S.batches(postings(spark, d).select("ord", "title", "description"), "ord")


def _assessments_by_position(spark: SparkSession, d: str) -> DataFrame:
    """Results zipped to postings by batch and slot. Each fifth batch fails, and of each third the last two results are missing: they
    are kept as relevant, with a score of 0."""
    asked = cut(_positioned(spark, d))
    results = S.scored(asked, "description", SKILLS, 5).where("batch % 5 <> 4 and not (batch % 3 = 1 and slot > 6)").select("batch", "slot", F.col("score").cast("bigint").alias("score"), "relevant")
    return S.padded(asked.select("ord", "batch", "slot"), results, {"score": 0, "relevant": True})


def _prompts(spark: SparkSession, d: str) -> DataFrame:
    return S.prompt_blocks(_positioned(spark, d), "title", "description").select("batch", "n", F.md5("prompt").alias("prompt"))


def _stream_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Distinct urls of the visit log by the streaming operator, over the whole table as one available batch."""
    import uuid

    from hirelake.session import ensure_checkpoint_dir
    from hirelake.streaming.postings import distinct_stream, each_batch

    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{uuid.uuid4().hex}"
    schema = table(spark, d, "url_visits").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/url_visits.parquet*").where("url is not null")
    write = lambda df, n: df.select("url").write.mode("append").parquet(f"{base}/out")
    each_batch(distinct_stream(stream, ["url"], "visited_at", "3650 days"), write, f"{base}/state").awaitTermination()
    return spark.read.schema("url string").parquet(f"{base}/out")


def _conflicts(spark: SparkSession, d: str) -> DataFrame:
    return D.urls_under_several_keys(_raw(spark, d))


def _report_on(rows: DataFrame) -> DataFrame:
    total, l1 = rows.agg(F.count("*").alias("total")), D.repeated_keys(rows, "key").agg(F.count("*").alias("l1"))
    l2 = D.urls_under_several_keys(rows).agg(F.count("*").alias("l2"))
    return total.crossJoin(l1).crossJoin(l2)  # three one-row frames


def _dedup_report(spark: SparkSession, d: str) -> DataFrame:
    """The report on the live records of the sessions' keys."""
    live = K.with_keys(_live(spark, d), _session_keys(spark, d), "dedup_key").select("ord")
    return _report_on(K.with_keys(_raw(spark, d), live, "ord"))


def _assessed_report(spark: SparkSession, d: str) -> DataFrame:
    """The report on all assessed records, with its verdicts."""
    r = _report_on(_raw(spark, d).where("assessment is not null"))
    badge = lambda c, word: F.when(_c(c) == 0, "PASS").otherwise(F.concat(F.lit(f"{word} "), _c(c).cast("string")))
    return r.select("*", badge("l1", "FAIL").alias("l1_badge"), badge("l2", "WARN").alias("l2_badge"), F.when((_c("l1") == 0) & (_c("l2") == 0), "ALL PASS").otherwise("ISSUES FOUND").alias("verdict"))


def _first_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """The first ten urls, by name, that stand under several keys, with all their keys."""
    rows = _raw(spark, d)
    first = D.urls_under_several_keys(rows).orderBy("url").limit(10)
    return _placed(D.keys_of_urls(rows, first).select("url", F.array_join("keys", " || ").alias("keys")), _c("url"))


def _sources_of_keys(spark: SparkSession, d: str) -> DataFrame:
    p = postings(spark, d).withColumn("key", T.posting_key(_c("company"), _c("title")))
    e = D.sources_of_keys(p)
    return e.select("key", F.array_join(F.transform("entries", lambda x: x["source"]), "|").alias("sources"), F.size("entries").cast("bigint").alias("n"))


def _union_first(spark: SparkSession, d: str) -> DataFrame:
    p = postings(spark, d).where("url is not null")
    return D.union_first([p.where("source = 'workmesa.example'"), p.where("source <> 'workmesa.example'")], "url").select("url", "ord")


def _vacuum(spark: SparkSession, d: str) -> DataFrame:
    """How many rows of three stores have outlived their time."""
    ago = lambda c, days: F.unix_micros(c) < F.unix_micros(now()) - days * 86_400_000_000
    j = cache(spark, d).agg(F.count_if(F.coalesce(F.col("expires_ts") < now(), ago("fetched_at", 7))).alias("jobs"))
    s = table(spark, d, "search_sessions").agg(F.count_if(ago("created_at", 1)).alias("sessions"))
    v = table(spark, d, "url_visits").agg(F.count_if(ago("visited_at", 7)).alias("visits"))
    all_ = j.crossJoin(s).crossJoin(v)  # three one-row frames
    return all_.withColumn("total", _c("jobs") + _c("sessions") + _c("visits"))


def _numbered(spark: SparkSession, d: str) -> DataFrame:
    """Searches appended to the log: ids go on, seconds are kept to one decimal, an empty report is none."""
    s = table(spark, d, "search_stats").select("id", F.col("id").alias("was"), F.round(_c("elapsed").cast("decimal(18,3)"), 1).cast("double").alias("elapsed"), F.when(F.trim("funnel").isin("", "{}"), None).otherwise(_c("funnel")).alias("funnel"))
    old, new = s.where("was % 4 <> 0"), s.where("was % 4 = 0")
    return K.append_numbered(old, new.withColumn("id", F.lit(None).cast("bigint")), "id", "was")


def _export(spark: SparkSession, d: str) -> DataFrame:
    """The ranked list as one JSON array."""
    one = F.array_sort(F.collect_list(F.struct("place", "ord", "score")))
    return _ranked(spark, d).agg(F.to_json(one).alias("json"))  # at most 200 rows


def _normalised(spark: SparkSession, d: str) -> DataFrame:
    """Visits and store as incoming records, in the form of the store."""
    v = table(spark, d, "url_visits").select(F.concat(F.lit("v"), F.col("visit_id").cast("string")).alias("id"), "title", "url")
    j = table(spark, d, "job_cache").select(F.concat(F.lit("j"), F.col("ord").cast("string")).alias("id"), "title", "company", "location", "url", "date_posted", "sources", F.when(_c("ord") % 2 == 0, _c("raw_sources")).alias("raw_sources"), "is_complete")
    rows = K.normalised_jobs(j.withColumn("description", F.lit("")).unionByName(v, allowMissingColumns=True))
    entries = F.transform("raw_sources", lambda e: F.concat_ws(" ", F.coalesce(e["source"], F.lit("")), F.coalesce(e["url"], F.lit("")), F.coalesce(e["date_posted"], F.lit(""))))
    return rows.select("id", "dedup_key", _text("sources").alias("sources"), F.array_join(entries, "|").alias("entries"), "is_complete")


def _cleared(keep: tuple[str, ...]) -> Query:
    """Rows that are left in each store."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        stores = {n: table(spark, d, n) for n in ("job_cache", "search_sessions", "failed_urls", "title_groups", "url_visits", "search_stats")}
        left = [df.agg(F.count("*").alias("n")).select(F.lit(n).alias("store"), "n") for n, df in K.cleared(stores, keep).items()]
        return reduce(DataFrame.unionByName, left)

    return run


def _lookup(name: str, key: str, *columns: str) -> Query:
    """A point lookup: the key is a literal in the plan, so the filter reaches the scan. Asked for is the least key there is."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = table(spark, d, name)
        least = rows.agg(F.min(key)).first()[0]
        return rows.where(_c(key) == F.lit(least)).select(*columns)

    return run


def _short_circuit(spark: SparkSession, d: str) -> DataFrame:
    """Each session: a fresh one answers a search with its keys, and nothing is scanned."""
    s = table(spark, d, "search_sessions")
    fresh = F.unix_micros(now()) - F.unix_micros("created_at") <= 24 * 3_600_000_000
    n = F.coalesce(F.size(F.coalesce("job_dedup_keys", F.array().cast("array<string>"))), F.lit(0))
    return s.select("session_key", fresh.alias("hit"), F.when(fresh, n).cast("bigint").alias("saved"))


def _log_tail(spark: SparkSession, d: str) -> DataFrame:
    """The last 200 lines of a level, oldest first."""
    line = F.concat(F.date_format("visited_at", "yyyy-MM-dd HH:mm:ss"), F.lit(" ["), F.upper("status"), F.lit("] "), F.coalesce("url", F.lit("")))
    lines = table(spark, d, "url_visits").select("visit_id", line.alias("line"))
    return _placed(log_tail(lines, "visit_id", "line", "error", 200), _c("visit_id"))


def _card(spark: SparkSession, d: str) -> DataFrame:
    """A record as Markdown; the text of the result by its MD5."""
    j = table(spark, d, "job_cache")
    text = lambda c: F.coalesce(c, F.lit(""))
    a = _c("assessment")
    bullets = lambda c: F.array_join(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.concat(F.lit("- "), x)), "\n")
    score = F.concat(
        F.lit("Score: "), a["score"].cast("string"), F.lit("/10 "), F.repeat(F.lit("#"), a["score"]), F.repeat(F.lit("."), 10 - a["score"]),
        F.lit("\nKeywords: "), F.array_join(F.coalesce(a["matched_keywords"], F.array().cast("array<string>")), ", "), F.lit("\nStrengths\n"), bullets(a["strengths"]), F.lit("\nWeaknesses\n"), bullets(a["weaknesses"]),
    )
    lines = F.concat(
        F.lit("# "), text(_c("title")), F.lit("\nCompany: "), text(_c("company")), F.lit("\nLocation: "), F.when(text(_c("location")) == "", "-").otherwise(_c("location")),
        F.lit("\nSources: "), F.array_join(F.coalesce("sources", F.array().cast("array<string>")), ", "), F.lit("\nUrl: "), text(_c("url")), F.lit("\nFetched: "), text(F.date_format("fetched_at", "yyyy-MM-dd HH:mm")),
        F.when(text(_c("expires_at")) == "", "").otherwise(F.concat(F.lit("\nExpires: "), _c("expires_at"))), F.lit("\n\n---\n\n"), F.when(text(_c("description_snippet")) == "", "(no text)").otherwise(_c("description_snippet")),
        F.lit("\n\n---\n\n"), F.coalesce(score, F.lit("Not assessed.")),
    )
    return j.select("ord", F.md5(lines).alias("md"))


def _session_jobs(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "search_sessions").select("session_key", F.explode(F.array_distinct("job_dedup_keys")).alias("dedup_key"))
    j = table(spark, d, "job_cache").groupBy("dedup_key").agg(F.count("*").alias("n"))
    return s.join(j, "dedup_key").groupBy("session_key").agg(F.count("*").alias("n_keys"), F.sum("n").alias("n_rows"))


def _lenient_dates(spark: SparkSession, d: str) -> DataFrame:
    """Every date_posted as UTC, month first unless the first number can only be a day; NULL where none is named."""
    p = spread(table(spark, d, "job_cache").select("ord", "date_posted", "fetched_at"))
    day_first = F.rlike("date_posted", F.lit(r"^\s*(?:1[3-9]|2\d|3[01])[/-]\d{1,2}[/-]"))
    p = p.withColumns({"zone": F.lit("UTC"), "locale": F.when(day_first, "en-IE").otherwise("en-US")})
    return with_utc(p, "date_posted", "zone", "locale", "fetched_at").select("ord", "utc_us")


SUMMARY_STEPS = {"skip_dup": "duplicates", "skip_seniority": "level", "skip_irrelevant": "irrelevant", "cache_hit": "known", "skip_no_desc": "no text", "skip_closed": "closed", "skip_exp": "years", "skip_skill": "skills"}


def _summary(spark: SparkSession, d: str) -> DataFrame:
    """The lines of a search's summary; steps that stopped nothing are left out."""
    n = lambda c: _c(c).cast("string")
    rows = _funnel_json(spark, d)
    rows = rows.withColumns({k: make() for k, make in RATES.items()})
    steps = F.concat_ws(" | ", *(F.when(_c(k) > 0, F.concat(F.lit(f"{label}:"), n(k))) for k, label in SUMMARY_STEPS.items()))
    rate = lambda c: F.concat(F.format_string("%.1f", _c(c)), F.lit("%"))
    lines = F.concat_ws(
        "\n",
        F.concat(F.lit("Scan: "), n("scraped_first"), F.lit(" + "), n("scraped_second"), F.lit(" = "), n("scraped_total")),
        F.when(_c("title_filter_in") > 0, F.concat(F.lit("Titles: "), n("title_filter_in"), F.lit(" -> "), n("title_filter_passed"), F.lit(", out "), n("title_filter_out"), F.lit(" ("), rate("llm_title_pass_rate"), F.lit(")"))),
        F.concat(F.lit("Prefilter: "), n("prefilter_in"), F.lit(" in"), F.when(steps != "", F.concat(F.lit(" ("), steps, F.lit(")"))).otherwise("")),
        F.concat(F.lit("Assessed: "), n("llm_assessed"), F.lit(", rejected "), n("llm_rejected"), F.when(_c("llm_assessed") > 0, F.concat(F.lit(", passed "), rate("llm_pass_rate"))).otherwise("")),
        F.concat(F.lit("Saved: "), n("saved"), F.lit(" of "), n("scraped_total"), F.lit(", filtered "), rate("filter_rate")),
    )
    return rows.select("id", lines.alias("lines"))


def _own_or_collected_sources(spark: SparkSession, d: str) -> DataFrame:
    """Each posting with the sources collected for its key; its own source where none are."""
    p = postings(spark, d).withColumn("key", T.posting_key(_c("company"), _c("title")))
    collected = D.sources_of_keys(p.where("source is not null")).select("key", F.array_join(F.transform("entries", lambda x: x["source"]), "|").alias("all"))
    return p.join(collected, "key", "left").select("ord", F.coalesce("all", "source").alias("sources"))


def _merged_source(spark: SparkSession, d: str) -> DataFrame:
    """One source appended to the listed keys, if absent; all other rows stay as they are."""
    return K.source_appended(table(spark, d, "job_cache"), _session_keys(spark, d), "dedup_key", "archive.example").select("ord", F.array_join("sources", "|").alias("sources"))


def _assessments(spark: SparkSession, d: str) -> DataFrame:
    """A score for each key with an unassessed row is written to all rows of the key; it takes the place of an older one."""
    j = table(spark, d, "job_cache").select("ord", "dedup_key", "assessment")
    fresh = j.where("assessment is null").groupBy("dedup_key").agg((F.min("ord") % 11).alias("fresh"))
    return j.join(fresh, "dedup_key", "left").select("ord", F.coalesce("fresh", F.col("assessment.score").cast("bigint")).alias("score"))


def _rejection_alarm(spark: SparkSession, d: str) -> DataFrame:
    """Boards of whose assessed rows, five at least, nine tenths are rejected."""
    j = table(spark, d, "job_cache").where("assessment is not null").groupBy(F.element_at("sources", 1).alias("board"))
    r = j.agg(F.count("*").alias("n"), F.count_if(~F.col("assessment.is_relevant")).alias("rejected"))
    return r.select("board", "n", "rejected", ((F.col("n") >= 5) & (F.col("rejected") >= 0.9 * F.col("n"))).alias("alarm"))


def _sessions_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Two states of the sessions merged: keys and time of the later, all else of the earlier."""
    s = table(spark, d, "search_sessions").select("session_key", "location", F.size(F.coalesce("job_dedup_keys", F.array().cast("array<string>"))).cast("bigint").alias("n"), F.unix_micros("created_at").alias("at"))
    old, new = s, s.where("n > 2").withColumns({"location": F.lit("changed"), "n": F.lit(0).cast("bigint"), "at": F.col("at") + 1})
    o, n = old.alias("o"), new.alias("n")
    return o.join(n, "session_key", "full_outer").select("session_key", F.coalesce("o.location", F.when(F.col("o.at").isNull(), F.col("n.location"))).alias("location"), F.coalesce("n.n", "o.n").alias("n"), F.coalesce("n.at", "o.at").alias("at"))


QUERIES: dict[str, Query] = {
    "fn12_skill_tokens": lambda s, d: table(s, d, "search_sessions").select("session_key", F.array_join(F.array_sort(F.array_distinct(F.filter(F.split(F.lower(F.array_join(F.coalesce("roles", F.array().cast("array<string>")), ",")), r"[\s/\-,]+"), lambda w: F.length(w) > 1))), " ").alias("tokens")),
    "fn16_lenient_dates": _lenient_dates,
    "fn20_cache_key": lambda s, d: table(s, d, "title_groups").select("group_id", F.concat(F.split("cache_key", "::").getItem(0), F.lit("::"), F.array_join(F.array_sort(F.split(F.split("cache_key", "::").getItem(1), ",")), "_")).alias("own_key")),
    "fn24_json_arrays": lambda s, d: table(s, d, "search_stats").select("id", F.array_join(F.from_json(F.to_json("roles"), "array<string>"), "|").alias("roles"), F.size(F.from_json(F.to_json("roles"), "array<string>")).cast("bigint").alias("n")),
    "fn26_flat_assessment": lambda s, d: table(s, d, "job_cache").select("ord", _c("assessment.score").cast("bigint").alias("score"), "assessment.is_relevant", *(F.array_join(f"assessment.{c}", "|").alias(c) for c in ("matched_keywords", "strengths", "weaknesses"))),
    "fn27_score_bars": lambda s, d: table(s, d, "job_cache").where("assessment is not null").select("ord", F.concat(F.repeat(F.lit("#"), F.col("assessment.score")), F.repeat(F.lit("."), 10 - F.col("assessment.score"))).alias("bar")),
    "fn31_funnel_rates": _rates("filter_rate", "llm_pass_rate", "llm_title_pass_rate"),
    "fn32_summary_lines": _summary,
    "fn36_card_lines": _value(lambda _: F.concat(F.lit("id="), F.col("ord").cast("string"), *(x for c in ("title", "company", "location") for x in (F.lit(f" | {c}="), F.coalesce(c, F.lit("")))))),
    "pred_11_expired_sessions": lambda s, d: table(s, d, "search_sessions").where(F.unix_micros(now()) - F.unix_micros("created_at") > 24 * 3_600_000_000).select("session_key"),
    "pred_14_threshold": lambda s, d: S.scored(postings(s, d), "description", SKILLS, 5).where(F.col("score") / 10 >= 0.6).select("ord"),
    "pred_18_models": lambda s, d: table(s, d, "search_stats").where(F.coalesce("model", F.lit("")) != "").where(P.chat_model(_c("model"), F.concat_ws(" ", "provider", "model"))).select("id"),
    "jn02_own_or_collected": _own_or_collected_sources,
    "jn08_passing_ids": lambda s, d: K.with_keys(postings(s, d).select("ord", "title"), S.scored(postings(s, d), "description", SKILLS, 5).where("relevant"), "ord").select("ord"),
    "a08_tokens_of_named": lambda s, d: table(s, d, "search_stats").where("coalesce(provider, '') <> ''").agg(F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out")),
    "a11_rejection_alarm": _rejection_alarm,
    "a12_distinct_words": lambda s, d: table(s, d, "title_groups").select(F.explode(T.role_words(_c("canonical"))).alias("word")).distinct(),
    "a14_affected": lambda s, d: K.with_keys(table(s, d, "job_cache"), table(s, d, "search_sessions").select(F.explode("job_dedup_keys").alias("dedup_key")), "dedup_key").agg(F.count("*").alias("n")),
    "l04_assessed_view": _assessed_view,
    "l06_top_models": lambda s, d: _placed(table(s, d, "search_stats").where("coalesce(model, '') <> ''").select("model").distinct().orderBy(F.desc("model")).limit(6), F.desc("model")),
    "l10_groups_by_count": lambda s, d: table(s, d, "title_groups").select("group_id", F.dense_rank().over(Window.partitionBy("cache_key").orderBy(F.desc("cnt"))).cast("bigint").alias("place")),
    "l13_slices": lambda s, d: table(s, d, "job_cache").select("ord", *(F.array_join(F.slice(F.coalesce(c, F.array().cast("array<string>")), 1, n), "|").alias(name) for c, n, name in (("sources", 2, "sources"), ("assessment.matched_keywords", 4, "keywords"), ("assessment.strengths", 10, "strengths")))),
    "u02_union_of_roles": lambda s, d: D.union_first([postings(s, d).where(f"url is not null and contains(lower(coalesce(title, '')), '{w}')") for w in ROLE_WORDS[:3]], "url").select("url", "ord"),
    "u05_shared_words": lambda s, d: postings(s, d).select("ord", F.array_join(F.array_sort(F.array_intersect(T.title_tokens(_c("title")), F.array(*(F.lit(w) for w in ROLE_WORDS)))), " ").alias("words")),
    "u06_first_keys": lambda s, d: table(s, d, "job_cache").groupBy("dedup_key").agg(F.min("ord").alias("ord")),
    "u08_added_roles": lambda s, d: table(s, d, "search_sessions").select("session_key", F.array_join(F.array_union(F.coalesce("roles", F.array().cast("array<string>")), F.array(F.lit("Barista"))), "|").alias("roles")),
    "snk03_merge_source": _merged_source,
    "snk04_session_upsert": _sessions_upsert,
    "snk09_write_assessments": _assessments,
    "t02_live_by_ttl": lambda s, d: table(s, d, "title_groups").groupBy("cache_key").agg(F.max(F.unix_micros("cached_at")).alias("at")).select("cache_key", (F.col("at") >= F.unix_micros(now()) - 7 * 86_400_000_000).alias("live")),
    "fn01_company_key": _value(lambda _: T.company_key(_c("company"))),
    "fn02_title_key": _value(lambda _: T.title_key(_c("title"))),
    "fn03_posting_key": _value(lambda _: T.posting_key(_c("company"), _c("title"))),
    "fn04_clean_location": _value(lambda _: T.clean_location(_c("location"))),
    "fn05_first_word": _value(lambda _: T.first_word(_c("location"), "ireland")),
    "fn06_html_text": _value(lambda _: F.md5(T.html_text(_c("description")))),
    "fn07_squeeze_lines": _value(lambda _: F.md5(T.squeeze_lines(_c("description")))),
    "fn08_prefixes": lambda s, d: postings(s, d).select("ord", *(F.md5(F.substring("description", 1, n)).alias(f"p{n}") for n in (70, 1000, 8000, 15000))),
    "fn09_present_company": _value(lambda _: T.present(_c("company"))),
    "fn10_title_tokens": _value(lambda _: F.array_join(F.array_sort(T.title_tokens(_c("title"))), " ")),
    "fn11_role_words": lambda s, d: table(s, d, "role_list").select("role_id", F.array_join(F.array_sort(F.array_distinct(T.role_words(_c("role")))), " ").alias("words")),
    "fn13_required_years": _value(lambda _: F.array_join(T.required_years(_c("description")), " ")),
    "fn14_deadline": lambda s, d: table(s, d, "job_cache").select("ord", F.when(F.coalesce("expires_at", F.lit("")) != "", _c("expires_at")).otherwise(T.deadline(F.substring(T.strip(_c("description_snippet")), 1, 1000))).alias("value")),
    "fn15_domain": _value(lambda _: T.domain(_c("url"))),
    "fn17_json_in_text": lambda s, d: table(s, d, "search_stats").select("id", F.get_json_object(T.json_in_text(F.concat(F.lit("```json\n"), F.col("funnel"), F.lit("\n```"))), "$.saved").try_cast("bigint").alias("saved")),
    "fn18_session_key": lambda s, d: table(s, d, "search_sessions").select("session_key", T.session_key(_c("roles"), _c("location"), _c("seniority"), SCANNED).alias("own_key")),
    "fn19_text_hash": lambda s, d: table(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha")),
    "fn21_rates": _rates("filter_rate"),
    "fn25_repaired_sources": lambda s, d: table(s, d, "job_cache").select("ord", F.array_join(T.repaired_sources(F.concat(F.lit("["), F.array_join(F.transform("sources", lambda x, i: F.when(i % 2 == 1, F.concat(F.lit('{"source": '), T.json_string(x), F.lit("}"))).otherwise(T.json_string(x))), ", "), F.lit("]"))), "|").alias("value")),
    "fn28_bars": lambda s, d: table(s, d, "title_groups").select("group_id", T.bar(_c("cnt")).alias("bar")),
    "fn29_file_name": _value(lambda _: T.file_name(_c("title"))),
    "fn33_shortened": _value(lambda _: T.shortened(_c("title"), 20)),
    "fn34_status": lambda s, d: table(s, d, "job_cache").select("ord", F.when(P.closed(_c("description_snippet")), "closed").when(F.coalesce("is_complete", F.lit(False)), "complete").otherwise("incomplete").alias("value")),
    **{f"pred_01_{level}": _kept(lambda level=level: P.suits_level(_c("title"), level)) for level in ("new_grad", "junior", "mid", "senior")},
    "pred_02_relevant": _kept(lambda: P.relevant(_c("title"), ROLE_WORDS)),
    "pred_03_more_years": _kept(lambda: P.asks_more_years(_c("description"), 10)),
    "pred_04_closed": _kept(lambda: P.closed(_c("description"))),
    "pred_05_inactive": _kept(lambda: P.inactive_page(_c("description"))),
    "pred_06_verification": _kept(lambda: P.is_verification_page(_c("description"))),
    "pred_07_skill": _kept(lambda: P.has_skill(_c("description"), SKILLS)),
    "pred_08_description": _kept(lambda: T.strip(F.coalesce("description", F.lit(""))) != ""),
    "pred_09_valid": _kept(lambda: (T.strip(F.coalesce("title", F.lit(""))) != "") & (T.strip(F.coalesce("url", F.lit(""))) != "") & (T.present(_c("company")) != "")),
    "pred_10_expired": lambda s, d: cache(s, d).where(P.expired(_c("expires_ts"), _c("fetched_at"), now())).select("ord"),
    "pred_12_fresh_visits": lambda s, d: table(s, d, "url_visits").where(F.timestamp_diff("DAY", _c("visited_at"), now()) <= 7).select("visit_id"),
    "pred_13_fresh_titles": lambda s, d: table(s, d, "title_groups").where(F.timestamp_diff("DAY", _c("cached_at"), now()) <= 7).select("group_id"),
    "pred_15_shown": lambda s, d: table(s, d, "job_cache").where(F.coalesce("assessment.is_relevant", F.lit(True))).select("ord"),
    "pred_16_unassessed": lambda s, d: cache(s, d).where("not assessed").orderBy(F.desc("fetched_at"), F.desc("ord")).limit(200).where(~P.expired(_c("expires_ts"), _c("fetched_at"), now())).select("ord"),
    "pred_17_clean_titles": lambda s, d: table(s, d, "title_groups").where(~P.noisy_title(_c("canonical"), _c("cnt"))).select("group_id"),
    "pred_20_possibly_closed": _kept(lambda: (F.coalesce("description", F.lit("")) != "") & P.closed(_c("description"))),
    "jn01_cached_postings": lambda s, d: _reasons(s, d).where("reason = 'cache_hit'").select("ord"),
    "jn03_jobs_by_keys": lambda s, d: K.with_keys(_live(s, d), _session_keys(s, d), "dedup_key").select("ord"),
    "jn04_failed_urls": lambda s, d: K.with_keys(table(s, d, "job_cache").select("ord", "url"), table(s, d, "failed_urls"), "url").select("ord"),
    "jn05_not_failed": lambda s, d: K.without_keys(table(s, d, "job_cache").select("ord", "url"), table(s, d, "failed_urls"), "url").select("ord"),
    "jn06_title_counts": lambda s, d: table(s, d, "role_list").join(table(s, d, "title_groups").groupBy(F.col("canonical").alias("role")).agg(F.max_by("cnt", "group_id").alias("n")), "role", "left").select("role_id", F.coalesce("n", F.lit(0)).alias("n")),
    "jn09_roles_by_country": lambda s, d: table(s, d, "role_list").select("role_id").crossJoin(broadcast_small(table(s, d, "place_list").select("country_code").distinct())),
    "jn12_session_jobs": _session_jobs,
    "a01_title_counts": lambda s, d: postings(s, d).groupBy("title").agg(F.count("*").alias("n")),
    "a02_funnel_totals": lambda s, d: _reasons(s, d).groupBy("reason").agg(F.count("*").alias("n")),
    "a02_counters": lambda s, d: funnel.totals(_outcomes(s, d)),
    "a03_funnel_by_source": lambda s, d: funnel.by_source(_outcomes(s, d)),
    "a04_sources_of_key": _sources_of_keys,
    "a05_repeated_keys": lambda s, d: D.repeated_keys(_raw(s, d), "key"),
    "a06_url_conflicts": _conflicts,
    "a06_conflict_keys": lambda s, d: D.urls_under_several_keys(_raw(s, d).where("assessment is not null")),
    "a07_stats_totals": lambda s, d: table(s, d, "search_stats").agg(F.count("*").alias("n"), F.coalesce(F.sum("tokens_in"), F.lit(0)).alias("tokens_in"), F.coalesce(F.sum("tokens_out"), F.lit(0)).alias("tokens_out"), F.coalesce(F.sum("jobs_found"), F.lit(0)).alias("jobs"), F.round(F.coalesce(F.sum(F.col("elapsed").cast("decimal(18,3)")), F.lit(0)), 1).cast("double").alias("elapsed")),
    "a09_latest_search": lambda s, d: K.last_write_wins(table(s, d, "search_stats").where("cv_hash is not null").select("cv_hash", "id", "created_at"), "cv_hash", ["created_at", "id"]).select("cv_hash", "id"),
    "a10_by_provider": lambda s, d: table(s, d, "search_stats").groupBy(F.coalesce(F.nullif(F.col("provider"), F.lit("")), F.lit("none")).alias("provider")).agg(F.count("*").alias("n"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.round(F.sum(F.col("elapsed").cast("decimal(18,3)")), 1).cast("double").alias("elapsed")),
    "a13_canonical_titles": _canonical_titles,
    "a15_dedup_report": _dedup_report,
    "w01_first_per_url": lambda s, d: D.first_per(postings(s, d).where("url is not null"), ["url"]).select("url", "ord"),
    "w02_duplicates": lambda s, d: D.mark_duplicates(postings(s, d).withColumn("key", T.posting_key(_c("company"), _c("title")))).where("dup").select("ord"),
    "w03_first_per_key_source": lambda s, d: D.first_per(postings(s, d).withColumn("key", T.posting_key(_c("company"), _c("title"))), ["key", "source"]).select("key", "source", "ord"),
    "w06_numbered_append": lambda s, d: _numbered(s, d).select("id", "was"),
    "w07_latest_visit": _latest_visits,
    "l01_recent_live": lambda s, d: cache(s, d).orderBy(F.desc("fetched_at"), F.desc("ord")).limit(200).where(~P.expired(_c("expires_ts"), _c("fetched_at"), now())).select("ord"),
    "l02_ranked": _ranked,
    "l05_top_titles": lambda s, d: _placed(postings(s, d).where("title is not null").groupBy("title").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "title").limit(80), F.desc("n"), _c("title")),
    "l08_history": lambda s, d: _placed(table(s, d, "search_stats").orderBy(F.desc("id")).limit(50).select("id", "provider", F.size("roles").cast("bigint").alias("n_roles")), F.desc("id")),
    "u01_left_priority": _union_first,
    "u03_ordered_union": lambda s, d: table(s, d, "job_cache").select("ord", F.array_join(F.array_union("sources", F.array(F.lit("archive.example"))), "|").alias("value")),
    "u07_missing_keys": lambda s, d: table(s, d, "search_sessions").select(F.explode("job_dedup_keys").alias("dedup_key")).distinct().join(table(s, d, "job_cache"), "dedup_key", "left_anti"),
    "snk02_upsert_merge": _merged,
    "snk05_first_failure": lambda s, d: D.first_per(table(s, d, "failed_urls").where("url is not null"), ["url"], "failed_id").select("url", "failed_id"),
    "snk11_delete": lambda s, d: K.without_keys(table(s, d, "job_cache").select("ord", "dedup_key"), table(s, d, "search_sessions").select(F.explode("job_dedup_keys").alias("dedup_key")), "dedup_key").select("ord"),
    "snk14_vacuum": _vacuum,
    "snk20_markdown": _card,
    "x02_scores": lambda s, d: S.scored(postings(s, d), "description", SKILLS, 5).select("ord", F.col("n_matched").cast("bigint").alias("n_matched"), F.col("year_gap").cast("bigint").alias("year_gap"), F.col("score").cast("bigint").alias("score"), "relevant"),
    "w05_batches": lambda s, d: _positioned(s, d).groupBy("batch").agg(F.count("*").alias("n"), F.min("ord").alias("first_ord"), F.max("slot").cast("bigint").alias("last_slot")),
    "t01_stream_distinct": _stream_distinct,
    "fn06b_references": _value(lambda _: F.md5(T.unescaped(F.col("description")))),
    "fn22_pass_rate": _rates("llm_pass_rate"),
    "fn23_title_pass_rate": _rates("llm_title_pass_rate"),
    "fn30_keywords": lambda s, d: table(s, d, "search_sessions").select("session_key", F.array_join(S.keywords(F.coalesce("roles", F.array().cast("array<string>")), F.array_sort(F.array_distinct(F.filter(F.split(F.lower(F.array_join(F.coalesce("roles", F.array().cast("array<string>")), ",")), r"[\s/\-,]+"), lambda w: F.length(w) > 1)))), "|").alias("words")),
    "fn34_shown": lambda s, d: table(s, d, "job_cache").select("ord", *(F.array_join(F.slice(F.coalesce(c, F.array().cast("array<string>")), 1, n), ", ").alias(name) for c, n, name in (("assessment.matched_keywords", 4, "keywords"), ("sources", 2, "sources")))),
    "fn35_prompts": _prompts,
    **{f"pred_01_{level}": _kept(lambda level=level: P.suits_level(_c("title"), level)) for level in ("intern", "lead")},
    "pred_19_error_lines": lambda s, d: table(s, d, "url_visits").where(F.contains(F.concat(F.lit("x ["), F.upper("status"), F.lit("]")), F.lit("[ERROR]"))).select("visit_id"),
    "pred_22_has_profile": lambda s, d: table(s, d, "search_sessions").where(P.has_profile(_c("location"), _c("roles"))).select("session_key"),
    "pred_23_link_state": lambda s, d: table(s, d, "job_cache").where("coalesce(expires_at, '') = ''").select("ord", P.link_state(_c("description_snippet")).alias("state")),
    "pred_24_condensed": lambda s, d: table(s, d, "search_sessions").select("session_key", F.array_join(T.condensed(_c("roles")), "|").alias("words")),
    "src06_scan": lambda s, d: _composite(s, d).where("score >= 0.6").select("url", "ord", "source"),
    "src06_counters": _scan_counters,
    "src08_titles": _title_scan,
    "src10_job": _lookup("job_cache", "dedup_key", "ord", "dedup_key", "title"),
    "src11_catalogue": _catalogue,
    "src16_assessed_keys": lambda s, d: _raw(s, d).where("assessment is not null").select("key").distinct(),
    "src18_session": lambda s, d: _lookup("search_sessions", "session_key", "session_key", F.to_json("roles").alias("roles"), F.unix_micros("created_at").alias("at"))(s, d).where(F.unix_micros(now()) - F.col("at") <= 24 * 3_600_000_000),
    "src19_profile": _lookup("search_stats", "cv_hash", "id", "cv_hash"),
    "jn01_patched": lambda s, d: _reasons(s, d).where("reason = 'cache_patch'").select("ord"),
    "jn07_by_position": _assessments_by_position,
    "a09_latest_profile": lambda s, d: table(s, d, "search_stats").where("cv_hash is not null").agg(F.max_by("cv_hash", F.struct("created_at", "id")).alias("cv_hash")),
    "a13_variants": _title_variants,
    "a15_assessed_report": _assessed_report,
    "a16_defaults": lambda s, d: _assessments_by_position(s, d).groupBy("slot").agg(F.count("*").alias("n"), F.count_if(_c("score") == 0).alias("defaults")),
    "l03_sliced_then_sorted": _sliced_then_sorted,
    "l07_log_tail": _log_tail,
    "l09_final_titles": _final_titles,
    "l11_first_conflicts": _first_conflicts,
    "l12_source_lines": lambda s, d: funnel.report_lines(funnel.by_source(_outcomes(s, d))).select(_c("place").cast("bigint").alias("place"), "line"),
    "snk07_title_cache": lambda s, d: K.last_write_wins(table(s, d, "title_groups").select("cache_key", "group_id", "canonical", "cached_at"), "cache_key", ["cached_at", "group_id"]).select("cache_key", "group_id", "canonical"),
    "snk08_profiles": lambda s, d: K.last_write_wins(table(s, d, "search_stats").where("cv_hash is not null").select("cv_hash", "id", "model", "created_at"), "cv_hash", ["created_at", "id"]).select("cv_hash", "id", "model"),
    "snk10_search_log": _numbered,
    "snk12_clear_all": _cleared(("search_stats",)),
    "snk13_clear_log": _cleared(("job_cache", "search_sessions", "failed_urls", "title_groups", "url_visits")),
    "snk17_export": _export,
    "snk18_normalised": _normalised,
    "t08_short_circuit": _short_circuit,
    "x13_outcomes": lambda s, d: _outcomes(s, d).select("ord", "reason", "outcome", "score"),
    "t05_fresh": lambda s, d: table(s, d, "job_cache").where(F.unix_micros("fetched_at") >= F.unix_micros(now()) - 72 * 3_600_000_000).select("ord"),
}


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """The funnel by source: keys, two ordered windows, cache join and predicates in one plan."""
    return funnel.by_source(_outcomes(spark, d))
