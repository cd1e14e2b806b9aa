"""Stream items from webhooks, logs, feeds and generators.

All give rows of one shape: id, content, content_type, ts, source, title,
priority, level.  They work on batch and streaming frames alike.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from siftstone.functions.text import strip_tags

LEVELS = ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL")
ITEM = ("id", "content", "content_type", "ts", "source", "title", "priority", "level")
TYPES = ("news", "log", "social", "alert", "generic")


def webhook_items(payloads: DataFrame, as_of: Column, column: str = "value") -> DataFrame:
    """JSON payloads; those without content are rejected, a bad time is ``as_of``."""
    parsed = F.from_json(column, "id string, content string, content_type string, timestamp string, source string, title string, priority int")
    p = payloads.withColumn("p", parsed).where(F.length(F.trim("p.content")) > 0)
    kind = F.lower(F.col("p.content_type"))
    return p.select(
        F.coalesce("p.id", F.substring(F.md5(column), 1, 16)).alias("id"), F.col("p.content").alias("content"), F.when(kind.isin(*TYPES), kind).otherwise("generic").alias("content_type"),
        F.coalesce(F.try_to_timestamp("p.timestamp"), as_of).alias("ts"), F.coalesce("p.source", F.lit("webhook")).alias("source"), F.col("p.title").alias("title"),
        F.least(F.greatest(F.coalesce("p.priority", F.lit(3)), F.lit(1)), F.lit(5)).alias("priority"), F.lit(None).cast("string").alias("level"))


def log_level(line: Column) -> Column:
    """The first of the levels, in their order, that the line contains."""
    upper, out = F.upper(line), None
    for level in LEVELS:
        out = F.when(upper.contains(level), level) if out is None else out.when(upper.contains(level), level)
    return out.otherwise("INFO")


def log_items(lines: DataFrame, as_of: Column, column: str = "value", path: Column | None = None, place: Column | None = None) -> DataFrame:
    """Lines of logs; equal lines at different places are different items."""
    where = F.coalesce(path, F.lit("")) if path is not None else F.lit("")
    at = place.cast("string") if place is not None else F.lit("")
    level = log_level(F.col(column))
    priority = F.when(level == "CRITICAL", 5).when(level == "ERROR", 4).when(level == "WARNING", 3).when(level == "INFO", 2).otherwise(1)
    return lines.where(F.length(F.trim(column)) > 0).select(
        F.substring(F.md5(F.concat_ws("|", where, at, F.col(column))), 1, 16).alias("id"), F.trim(column).alias("content"), F.lit("log").alias("content_type"), as_of.alias("ts"),
        F.when(where == "", "log").otherwise(where).alias("source"), F.lit(None).cast("string").alias("title"), priority.alias("priority"), level.alias("level"))


def parse_feed(xml: str) -> list[tuple[str, str, str, str | None]]:
    """(entry id, title, summary, time) of an RSS or Atom document; broken
    documents have none."""
    try:
        root = ET.fromstring(xml)
    except ET.ParseError:
        return []
    plain = lambda e: e.tag.rsplit("}", 1)[-1]
    out = []
    for entry in root.iter():
        if plain(entry) not in ("item", "entry"):
            continue
        have = {}
        for child in entry:
            have.setdefault(plain(child), (child.text or child.get("href") or "").strip())
        out.append((have.get("guid") or have.get("id") or have.get("link") or have.get("title", ""), have.get("title", ""), have.get("description") or have.get("summary") or have.get("content") or "", have.get("pubDate") or have.get("published") or have.get("updated")))
    return out


def feed_items(entries: DataFrame, as_of: Column, source: str = "rss") -> DataFrame:
    """Rows (entry_id, title, summary, time) to items: tags stripped, at most
    2000 characters, published or updated time, else ``as_of``."""
    day = F.regexp_replace("time", "^[A-Za-z]{3}, +", "")
    time = F.coalesce(F.try_to_timestamp("time"), F.try_to_timestamp(day, F.lit("d MMM yyyy HH:mm:ss Z")), as_of)
    text = F.substring(F.trim(strip_tags(F.concat_ws("\n", "title", "summary"))), 1, 2000)
    return entries.select(F.substring(F.md5("entry_id"), 1, 16).alias("id"), text.alias("content"), F.lit("news").alias("content_type"), time.alias("ts"), F.lit(source).alias("source"), "title", F.lit(3).alias("priority"), F.lit(None).cast("string").alias("level"))


class Poll(InputPartition):
    """One feed at one poll (milliseconds); 0: what the feed holds now."""

    def __init__(self, url: str, poll: int):
        self.url, self.poll = url, poll


def fetch(url: str) -> str:
    """A feed's text from an address or a file."""
    import urllib.request
    from pathlib import Path

    if "://" in url:
        with urllib.request.urlopen(url, timeout=30) as r:
            return r.read().decode("utf-8", "replace")
    return Path(url).read_text(encoding="utf-8")


def snapshot(archive: str, url: str, poll: int) -> tuple[str, str | None]:
    """A feed's text at a poll and at the one before it.  The first to ask fetches
    it and keeps it in the archive, a folder that all executors see; whoever asks again for that
    poll, as after a failed task or a restart, is given the same text."""
    import hashlib
    import uuid

    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(archive if ":" in archive else f"file://{archive}")
    home = f"{root}/{hashlib.sha256(url.encode()).hexdigest()[:16]}"
    system.create_dir(home)
    polls = {int(f.base_name[:-4]): f.path for f in system.get_file_info(fs.FileSelector(home)) if f.base_name.endswith(".xml") and f.base_name[:-4].isdigit()}
    if poll not in polls:
        draft, polls[poll] = f"{home}/{uuid.uuid4().hex}.draft", f"{home}/{poll}.xml"
        with system.open_output_stream(draft) as f:
            f.write(fetch(url).encode())
        system.move(draft, polls[poll])
    text = lambda n: system.open_input_stream(polls[n]).read().decode()
    before = max((n for n in polls if n < poll), default=None)
    return text(poll), None if before is None else text(before)


class FeedSource(DataSource):
    """``spark.readStream.format("feed").option("urls", "a,b").option("archive", folder)``: polls
    feeds, a task a feed, on the executors.  Each batch is one poll, named by its time, which
    is the offset; its rows are the entries that the poll before did not have.  A url may be
    a file path, which is also how it is tested.  As a table it is what the feeds hold now."""

    @classmethod
    def name(cls) -> str:
        return "feed"

    def schema(self) -> str:
        return "entry_id string, title string, summary string, time string"

    def _urls(self) -> list[str]:
        return [u for u in self.options.get("urls", "").split(",") if u]

    def reader(self, schema) -> DataSourceReader:
        urls = self._urls()

        class Reader(DataSourceReader):
            def partitions(self):
                return [Poll(u, 0) for u in urls]

            def read(self, partition):
                return iter(parse_feed(fetch(partition.url)))

        return Reader()

    def streamReader(self, schema) -> DataSourceStreamReader:
        urls, archive = self._urls(), self.options.get("archive")
        if not archive:
            raise ValueError("a stream of feeds needs the option archive, a folder that all executors see")

        class Reader(DataSourceStreamReader):
            def initialOffset(self):
                return {"poll": 0}

            def latestOffset(self):
                import time

                return {"poll": int(time.time() * 1000)}

            def partitions(self, start, end):
                return [Poll(u, end["poll"]) for u in urls]

            def read(self, partition):
                now, before = snapshot(archive, partition.url, partition.poll)
                known = {e[0] for e in parse_feed(before)} if before else set()
                return iter([e for e in parse_feed(now) if e[0] not in known])

        return Reader()


#: Words of made-up items.
PHRASES = ("Just read about {}", "Thoughts on {}?", "Big day for {}", "Can't believe the news on {}")
HEADLINES = ("Markets close higher", "New chip announced", "Storm warning issued", "Team wins final", "Study finds link")
TOPICS = ("technology", "science", "sports", "politics", "health")


def simulated_news(spark: SparkSession, rows_per_second: int = 1, seed: int = 42) -> DataFrame:
    """An endless stream of made-up items, a function of the row number."""
    rate = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    return simulated(rate.select("value", F.col("timestamp").alias("ts")), seed)


def simulated(numbered: DataFrame, seed: int = 42) -> DataFrame:
    h = F.abs(F.xxhash64("value", F.lit(seed)))
    pick = lambda xs, salt: F.element_at(F.array(*map(F.lit, xs)), (F.shiftright(h, salt) % len(xs) + 1).cast("int"))
    title = pick(HEADLINES, 3)
    return numbered.select(F.concat(F.lit("sim-"), F.col("value").cast("string")).alias("id"), F.concat(title, F.lit(" in "), pick(TOPICS, 17)).alias("content"), F.lit("news").alias("content_type"), "ts", F.lit("simulated").alias("source"), title.alias("title"), (F.shiftright(h, 29) % 5 + 1).cast("int").alias("priority"), F.lit(None).cast("string").alias("level"))


def simulated_posts(numbered: DataFrame, seed: int = 42) -> DataFrame:
    """Like ``simulated``, for short posts with made-up reactions."""
    h = F.abs(F.xxhash64("value", F.lit(seed + 1)))
    pick = lambda xs, salt: F.element_at(F.array(*map(F.lit, xs)), (F.shiftright(h, salt) % len(xs) + 1).cast("int"))
    return numbered.select(
        F.concat(F.lit("post-"), F.col("value").cast("string")).alias("id"), F.replace(pick(PHRASES, 5), F.lit("{}"), pick(TOPICS, 11)).alias("content"), F.lit("social").alias("content_type"), "ts", F.lit("simulated").alias("source"),
        F.lit(None).cast("string").alias("title"), (F.shiftright(h, 29) % 5 + 1).cast("int").alias("priority"), F.lit(None).cast("string").alias("level"),
        (F.shiftright(h, 20) % 1000).alias("likes"), (F.shiftright(h, 31) % 100).alias("shares"), (F.shiftright(h, 40) % 50).alias("replies"))
