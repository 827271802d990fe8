"""A posting board as a Python data source, with limits pushed into the scan.

``spark.read.format("board").option("path", ...).option("roles", "a,b").option("limit", 20).option("hours_old", 72).load()``
reads postings from JSON lines, one input partition for each file, all roles in one pass. A network reader takes the place of
``lines_of``. The path must be one that all executors reach.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from hirelake.functions import text as T
from hirelake.operators.dedup import union_first

SCHEMA = "role string, file long, pos long, title string, job_url string, company string, description string, location string, date_posted string, is_remote boolean"
#: Characters of a description that are stored.
STORED = 15_000


class _File(InputPartition):
    def __init__(self, number: int, path: str) -> None:
        self.number, self.path = number, path


def lines_of(path: str) -> Iterator[str]:
    """Lines of a file, one after another; a file that cannot be read has none."""
    try:
        with open(path, encoding="utf-8", errors="replace") as f:
            yield from f
    except OSError:
        return


class BoardReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.limit, self.hours = options["path"], int(options.get("limit", 20)), float(options.get("hours_old", 0))
        self.roles = [r.strip() for r in options.get("roles", "").split(",") if r.strip()]
        self.now = options.get("now")

    def partitions(self) -> list[InputPartition]:
        root = Path(self.path)
        files = sorted(str(p) for p in root.iterdir() if p.is_file()) if root.is_dir() else [self.path]
        return [_File(i, p) for i, p in enumerate(files)]

    def read(self, partition: _File) -> Iterator[tuple]:
        """Rows of one file for each role, at most ``limit`` each; broken lines are left out."""
        words, found = {role: role.lower().split() for role in self.roles}, dict.fromkeys(self.roles, 0)
        since = dt.datetime.fromisoformat(self.now) - dt.timedelta(hours=self.hours) if self.now and self.hours else None
        for pos, line in enumerate(lines_of(partition.path)):
            try:
                r = json.loads(line)
            except ValueError:
                continue
            try:
                if since and dt.datetime.fromisoformat(r.get("date_posted") or "") < since:
                    continue
            except ValueError:
                pass
            title = (r.get("title") or "").lower()
            for role, ws in words.items():
                if found[role] < self.limit and all(w in title for w in ws):
                    found[role] += 1
                    yield (role, partition.number, pos, r.get("title"), r.get("job_url"), r.get("company"), r.get("description"), r.get("location"), r.get("date_posted"), r.get("is_remote"))
            if found and all(n >= self.limit for n in found.values()):
                return


class Board(DataSource):
    @classmethod
    def name(cls) -> str:
        return "board"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BoardReader:
        return BoardReader(self.options)


def read_board(spark: SparkSession, path: str, roles: list[str], limit: int = 20, hours_old: float = 0, now: str | None = None, markup: str = "html") -> DataFrame:
    """Valid postings of one board, one row for each url: title, url and company present; the text of HTML, or with ``markup``
    'markdown' the text as it is but for runs of line ends.

    Of each role the first ``limit`` postings in the order of files and lines count; a url that several roles found stays with
    the first of them.
    """
    spark.dataSource.register(Board)
    reader = spark.read.format("board").option("path", path).option("roles", ",".join(roles)).option("limit", limit).option("hours_old", hours_old)
    if now:
        reader = reader.option("now", now)
    first = F.row_number().over(Window.partitionBy("role").orderBy("file", "pos"))  # at most files x limit rows of a role
    rows = reader.load().withColumn("__n", first).where(F.col("__n") <= limit).drop("__n")
    said = F.coalesce("description", F.lit(""))
    text = T.html_text(said) if markup == "html" else T.squeeze_lines(said)
    clean = rows.select("role", "file", "pos", T.present(F.col("title")).alias("title"), T.present(F.col("job_url")).alias("url"), T.present(F.col("company")).alias("company"), T.clean_location(F.col("location")).alias("location"), F.substring(text, 1, STORED).alias("description"), "date_posted", "is_remote")
    clean = clean.where((F.col("title") != "") & (F.col("url") != "") & (F.col("company") != ""))
    if not roles:
        return clean
    order = F.create_map(*(F.lit(x) for i, r in enumerate(roles) for x in (r, i)))
    at = F.struct(F.element_at(order, F.col("role")).alias("r"), "file", "pos")
    rest = [c for c in clean.columns if c != "url"]
    return clean.groupBy("url").agg(F.min_by(F.struct(*rest), at).alias("x")).select("url", *(F.col(f"x.{c}").alias(c) for c in rest))


#: The first word of a location, and the place a second board knows it by; an empty one has no such board.
SECOND_PLACES = {
    "ireland": "Dublin, Ireland", "uk": "London, United Kingdom", "usa": "United States", "canada": "Toronto, Canada", "australia": "Sydney, Australia", "singapore": "Singapore", "remote": "",
}


def second_place(location: str) -> str:
    """The place to ask a second board for: by the first word of ``location``, else the location itself in title case."""
    words = location.split()
    return SECOND_PLACES.get(words[0].lower() if words else "ireland", location.title())


def scan_boards(spark: SparkSession, first: str, second: str, roles: list[str], location: str, limits: tuple[int, int] = (200, 30), hours_old: float = 72, now: str | None = None) -> tuple[DataFrame, dict[str, int]]:
    """(postings, counters) of two boards: rows of the first go before those of the second with one url.

    A board with limit 0 is skipped; so is the second where it has no place for the location.
    """
    parts = []
    for source, path, limit, markup in (("first", first, limits[0], "html"), ("second", second, limits[1] if second_place(location) else 0, "markdown")):
        rows = read_board(spark, path, roles, limit, hours_old, now, markup) if limit > 0 else None
        parts.append(None if rows is None else rows.withColumn("source", F.lit(source)))
    live = [p for p in parts if p is not None]
    counters = {f"scraped_{name}": 0 if p is None else p.count() for name, p in zip(("first", "second"), parts, strict=True)}
    if not live:
        return spark.createDataFrame([], "url string, title string"), counters | {"scraped_total": 0}
    both = union_first([p.withColumn("at", F.concat_ws("-", F.lpad("file", 9, "0"), F.lpad("pos", 12, "0"))) for p in live], "url", "at").drop("at")
    return both, counters | {"scraped_total": both.count()}
