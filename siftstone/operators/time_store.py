"""A stored table of timed rows, by day.

Every append writes one segment: a folder a day, rows sorted by time, and one log
entry with the rows of each day.  Late rows are a further segment of an old day, seen
at once; ``compact`` writes days of several segments as one and leaves the other days
alone; ``expire`` drops whole days by an entry, ``vacuum`` removes their folders.

Days are UTC days of the stored instant, whatever the session's time zone.  Rows
without a time are kept in a folder of their own: no range holds them and they do not
expire.  Repeated rows are each kept.  The log, with a number for every day of a
segment, is what the driver holds; rows never pass through it.
"""

from __future__ import annotations

import datetime
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from siftstone.operators.segments import Segments

DAY = 86_400_000_000
UNTIMED = -(10**9)
OWN = ("utc_day", "segment")
EPOCH = datetime.datetime(1970, 1, 1, tzinfo=datetime.UTC)


def day_of(ts: Column) -> Column:
    """Days since 1970 of an instant; ``UNTIMED`` for null."""
    return F.coalesce(F.floor(F.unix_micros(ts) / F.lit(DAY)).cast("long"), F.lit(UNTIMED))


def day_number(at: datetime.datetime) -> int:
    """The same of a Python time; one without a zone is taken as UTC."""
    return ((at if at.tzinfo else at.replace(tzinfo=datetime.UTC)) - EPOCH) // datetime.timedelta(days=1)


def instant(at: datetime.datetime) -> Column:
    at = at if at.tzinfo else at.replace(tzinfo=datetime.UTC)
    return F.timestamp_micros(F.lit((at - EPOCH) // datetime.timedelta(microseconds=1)))


class TimeStore:
    def __init__(self, spark: SparkSession, path: str):
        self.segments = Segments(spark, path)
        base = self.segments.live()[0]
        self.ts, self.schema = base["ts"], StructType.fromJson(json.loads(base["schema"]))

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: StructType, ts: str = "ts") -> TimeStore:
        """An empty store of rows of this schema; the time column is kept as a timestamp."""
        clash = [f.name for f in schema.fields if f.name.lower() in OWN]
        if clash or ts not in schema.names:
            raise ValueError(f"needs a column {ts} and none named {' or '.join(OWN)}")
        empty = spark.createDataFrame([], schema)
        schema = empty.withColumn(ts, F.col(f"`{ts}`").cast("timestamp")).schema
        segments = Segments(spark, path)
        segments.commit(segments.begin("base") | {"ts": ts, "schema": schema.json(), "pairs": []})
        return cls(spark, path)

    def _write(self, entry: dict, rows: DataFrame) -> None:
        """Write rows that have their day, and note how many each day holds."""
        spread = rows.repartitionByRange(F.col("utc_day"), F.col(f"`{self.ts}`"))  # a large day takes several tasks
        self.segments.write(entry, "rows", spread.sortWithinPartitions("utc_day", f"`{self.ts}`"), "utc_day")
        written = self.segments.read("rows", "utc_day long", [entry])
        entry["days"] = {str(r["utc_day"]): r["n"] for r in written.groupBy("utc_day").agg(F.count(F.lit(1)).alias("n")).collect()}

    def append(self, rows: DataFrame) -> None:
        """Add rows, late ones included; columns are found by name."""
        fields = [F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.schema.fields]
        entry = self.segments.begin("append")
        self._write(entry, rows.select(*fields).withColumn("utc_day", day_of(F.col(f"`{self.ts}`"))))
        self.segments.commit(entry)

    def pairs(self) -> list[tuple[str, int, int]]:
        """(folder, day, rows) of everything alive, oldest segment first."""
        entries = self.segments.live()
        alive = [tuple(p) for p in entries[0]["pairs"]]
        for e in entries[1:]:
            if e["kind"] == "expire":
                alive = [p for p in alive if p[1] == UNTIMED or p[1] >= e["before"]]
            days = {int(d): n for d, n in e.get("days", {}).items()}
            if e["kind"] == "compact":
                alive = [p for p in alive if p[1] not in days]
            alive += [(e["folder"], d, n) for d, n in sorted(days.items())]
        return alive

    def _open(self, pairs: list[tuple[str, int, int]]) -> DataFrame:
        spark, root = self.segments.spark, f"{self.segments.path}/rows"
        whole = StructType([*self.schema.fields, StructField("segment", StringType()), StructField("utc_day", LongType())])
        folders = [f"{root}/segment={folder}/utc_day={day}" for folder, day, _ in pairs]
        if not folders:
            return spark.createDataFrame([], whole).drop("segment")
        return spark.read.schema(whole).option("basePath", root).parquet(*folders).drop("segment")

    def rows(self) -> DataFrame:
        return self._open(self.pairs()).drop("utc_day")

    def in_range(self, start: datetime.datetime, end: datetime.datetime) -> DataFrame:
        """Inclusive at both ends; folders of other days are not listed, nor read."""
        first, last = day_number(start), day_number(end)
        held = self._open([p for p in self.pairs() if first <= p[1] <= last])
        return held.where(F.col("utc_day").between(first, last) & F.col(f"`{self.ts}`").between(instant(start), instant(end))).drop("utc_day")

    def newest(self, n: int, id_col: str = "id") -> DataFrame:
        """The n newest rows, ties by the greatest id: only as many days are opened, from the
        last on, as hold n rows by the log."""
        per_day: dict[int, int] = {}
        for _, day, count in self.pairs():
            per_day[day] = per_day.get(day, 0) + count
        wanted, held = set(), 0
        for day in sorted(set(per_day) - {UNTIMED}, reverse=True):
            if held >= n:
                break
            wanted.add(day)
            held += per_day[day]
        return self._open([p for p in self.pairs() if p[1] in wanted]).drop("utc_day").orderBy(F.col(f"`{self.ts}`").desc(), F.col(f"`{id_col}`").desc()).limit(n)

    def compact(self, most: int = 1) -> list[int]:
        """Write every day of more than ``most`` segments as one; returns these days."""
        entry = self.segments.begin("compact")
        alive = self.pairs()
        counts: dict[int, int] = {}
        for _, day, _ in alive:
            counts[day] = counts.get(day, 0) + 1
        days = sorted(d for d, n in counts.items() if n > most)
        if days:
            self._write(entry, self._open([p for p in alive if p[1] in set(days)]))
            self.segments.commit(entry)
        return days

    def expire(self, before: datetime.datetime) -> None:
        """Drop the days that end before this time; the day it falls in stays whole.
        Rows of dropped days that come later are kept until the next call."""
        self.segments.commit(self.segments.begin("expire") | {"before": day_number(before)})

    def vacuum(self) -> int:
        """Remove what no reader opens any more, and fold the log into one entry; returns
        how many day folders went.  Nothing may be reading or writing them."""
        entry = self.segments.begin("base")
        alive = self.pairs()
        self.segments.commit(entry | {"ts": self.ts, "schema": self.schema.json(), "pairs": alive})
        named = {(folder, day) for folder, day, _ in alive}
        system, root = self.segments._at("rows")
        gone = 0
        for segment in system.listStatus(root) if system.exists(root) else []:
            folder, left = segment.getPath().getName().removeprefix("segment="), 0
            for part in system.listStatus(segment.getPath()):
                name = part.getPath().getName()
                if name.startswith("utc_day="):
                    if (folder, int(name.removeprefix("utc_day="))) in named:
                        left += 1
                    else:
                        gone += bool(system.delete(part.getPath(), True))
            if not left:
                system.delete(segment.getPath(), True)
        for e in self.segments.log():
            if e["seq"] < entry["seq"]:
                system.delete(self.segments._at(f"log/{e['seq']:08d}.json")[1], False)
        return gone
