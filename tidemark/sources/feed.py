"""Minute bars of a remote provider as a Spark source: one partition per symbol and month, fetched where it is read.

The provider is a function (symbol, first day, last day) -> rows, so no address or key lives here. A failed fetch is tried
again after a pause that doubles; what still fails is left to Spark's retry of the task. Finished months are kept by
writing them; `extend` adds new rows to old ones.
"""

from __future__ import annotations

import time
from calendar import monthrange
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double"
Fetch = Callable[[str, date, date], Iterable[tuple]]


def months(start: date, end: date) -> list[tuple[date, date]]:
    """(first, last) of each month from start's to end's; whole months but for the last, which stops at end."""
    out, first = [], start.replace(day=1)
    while first <= end:
        last = first.replace(day=monthrange(first.year, first.month)[1])
        out.append((first, min(last, end)))
        first = last + timedelta(days=1)
    return out


def month_ranges(rows: DataFrame, start: Column, end: Column) -> DataFrame:
    """The same on columns: rows with first and last, one per month."""
    each = rows.withColumn("first", F.explode(F.sequence(F.trunc(start, "MM"), end, F.expr("interval 1 month"))))
    return each.withColumn("last", F.least(F.last_day("first"), end))


@dataclass
class Month(InputPartition):
    symbol: str
    first: date
    last: date


def patient(call: Callable, tries: int, pause: float):
    """What call gives, tried again after pauses that double."""
    for left in range(tries - 1, -1, -1):
        try:
            return call()
        except Exception:
            if not left:
                raise
            time.sleep(pause * 2 ** (tries - 1 - left))


def register(spark: SparkSession, fetch: Fetch, name: str = "minute_feed", tries: int = 3, pause: float = 1.0) -> None:
    """Make spark.read.format(name) read bars; options symbols (by commas), start and end (dates, both included)."""

    class Reader(DataSourceReader):
        def __init__(self, options: dict[str, str]):
            self.symbols = sorted({s.strip() for s in options["symbols"].split(",") if s.strip()})
            self.range = date.fromisoformat(options["start"]), date.fromisoformat(options["end"])

        def partitions(self) -> list[Month]:
            return [Month(s, *m) for s in self.symbols for m in months(*self.range)]

        def read(self, part: Month) -> Iterator[tuple]:
            for row in patient(lambda: list(fetch(part.symbol, part.first, part.last)), tries, pause):
                yield (part.symbol, *row)

    class Feed(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> Reader:
            return Reader(self.options)

    spark.dataSource.register(Feed)


def download(spark: SparkSession, path: str, symbols: list[str], start: date, end: date, name: str = "minute_feed") -> list[date]:
    """Write the bars of a range under path, a folder per month; gives the months that were written now.

    A month that is complete (the writer's commit marks it) and whose range hasn't grown is left alone, so a run that broke
    off goes on at the month it was at. A month that was cut short by `end` is read again when the end has moved.
    """
    jvm, written = spark._jvm, []
    for first, last in months(start, end):
        folder = f"{path.rstrip('/')}/{first}_{last}"
        done = jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
        if done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
            continue
        bars = spark.read.format(name).options(symbols=",".join(symbols), start=str(first), end=str(last)).load()
        bars.write.mode("overwrite").parquet(folder)
        written.append(first)
    return written


def extend(old: DataFrame, new: DataFrame, key: tuple[str, ...] = ("symbol", "ts")) -> DataFrame:
    """Old rows, and of the new ones those whose key is not there yet, once each."""
    fresh = new.dropDuplicates(list(key)).join(old.select(*key), list(key), "left_anti")
    return old.unionByName(fresh)
