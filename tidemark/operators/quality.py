"""Data quality of minute bars: sessions against the calendar, gaps, duplicates, conflicts, listing intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OPEN = 570


def regular_hours(rows: DataFrame, calendar: DataFrame) -> DataFrame:
    """Rows of trading days from 09:30 to the session's end."""
    minute = F.hour("ts") * 60 + F.minute("ts")
    joined = rows.withColumn("date", F.to_date("ts")).join(F.broadcast(calendar), "date")
    return joined.where((minute >= OPEN) & (minute < F.col("session_end")))


def session_quality(rows: DataFrame, calendar: DataFrame) -> DataFrame:
    """By symbol, over the calendar's sessions: full, partial and empty ones, stale rows, gap rate and longest gap."""
    counts = rows.groupBy("symbol", F.to_date("ts").alias("date")).agg(F.count("*").alias("bars"), F.count_if(F.col("volume") == 0).alias("stale"))
    stale = counts.groupBy("symbol").agg(F.sum("stale").alias("stale_bar_count"))
    grid = stale.select("symbol").crossJoin(F.broadcast(calendar))  # symbols by days of the calendar
    day = grid.join(counts, ["symbol", "date"], "left").withColumn("bars", F.coalesce("bars", F.lit(0)))
    by_day = Window.partitionBy("symbol").orderBy("date")
    run = F.sum((F.col("bars") > 0).cast("int")).over(by_day)
    day = day.withColumn("run", run)
    gaps = day.where("bars = 0").groupBy("symbol", "run").count().groupBy("symbol").agg(F.max("count").alias("max_consecutive_gaps"))
    found = day.groupBy("symbol").agg(
        F.count("*").alias("total_sessions"), F.count_if(F.expr(f"bars >= session_end - {OPEN}")).alias("full_bar_sessions"),
        F.count_if(F.expr(f"bars > 0 AND bars < session_end - {OPEN}")).alias("partial_sessions"), F.count_if(F.col("bars") == 0).alias("zero_bar_sessions"),
    )
    out = found.join(stale, "symbol").join(gaps, "symbol", "left")
    rate = F.round(F.col("zero_bar_sessions") / F.col("total_sessions") * 100, 4)
    return out.withColumn("max_consecutive_gaps", F.coalesce("max_consecutive_gaps", F.lit(0))).withColumn("gap_rate_pct", rate).withColumn("has_warning", rate > 1.0)


def report_lines(found: DataFrame) -> DataFrame:
    """(symbol, line): the table of session_quality as text, a line per symbol, to be read in order of the symbol."""
    counts = ("total_sessions", "full_bar_sessions", "partial_sessions", "zero_bar_sessions")
    cells = [F.rpad("symbol", 10, " "), *(F.lpad(F.col(c).cast("string"), 9, " ") for c in counts)]
    cells += [F.format_string("%9.2f", "gap_rate_pct"), *(F.lpad(F.col(c).cast("string"), 9, " ") for c in ("max_consecutive_gaps", "stale_bar_count"))]
    return found.select("symbol", F.concat(*cells, F.when(F.col("has_warning"), "  gaps over 1 %").otherwise("")).alias("line"))


def report(found: DataFrame, start: str, end: str, at: str) -> dict:
    """session_quality as a document; it has one entry per symbol, so it comes to the driver."""
    symbols = [r.asDict() for r in found.orderBy("symbol").toLocalIterator()]
    warned = [r["symbol"] for r in symbols if r["has_warning"]]
    return {"generated_at": at, "start": start, "end": end, "symbols": symbols, "summary": {"any_warnings": bool(warned), "warned_symbols": warned}}


def out_of_order(rows: DataFrame, file: str, line: str) -> DataFrame:
    """(file, first_bad): the first line of each file whose timestamp doesn't follow the one before."""
    before = F.lag("ts").over(Window.partitionBy(file).orderBy(line))
    return rows.withColumn("_before", before).where("ts <= _before").groupBy(file).agg(F.min(line).alias("first_bad"))


def conflicts(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys that stand for more than one different row."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.count_distinct(F.struct(*(F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in rest))).alias("n")).where("n > 1")


def overlaps(intervals: DataFrame) -> DataFrame:
    """Intervals [listed_from, listed_to) of an instrument that begin before the one before has ended."""
    w = Window.partitionBy("instrument_id").orderBy("listed_from", "listed_to")
    before = intervals.withColumn("_n", F.row_number().over(w)).withColumn("_end", F.lag("listed_to").over(w))
    return before.where("_n > 1 AND (_end IS NULL OR listed_from < _end)").drop("_n", "_end")


def instrument_at(asked: DataFrame, intervals: DataFrame) -> DataFrame:
    """For each (symbol, date) asked: how many instruments have the symbol that day, and the instrument if it is one."""
    inside = (F.col("a.symbol") == F.col("i.symbol")) & (F.col("i.listed_from") <= F.col("a.date")) & (F.col("i.listed_to").isNull() | (F.col("a.date") < F.col("i.listed_to")))
    pairs = asked.select("symbol", "date").distinct().alias("a").join(intervals.alias("i"), inside, "left")
    return pairs.groupBy("a.symbol", "a.date").agg(F.count_distinct("i.instrument_id").alias("n"), F.min("i.instrument_id").alias("_id")).select("symbol", "date", "n", F.when(F.col("n") == 1, F.col("_id")).alias("instrument_id"))


def listed_on(intervals: DataFrame, days: DataFrame) -> DataFrame:
    """Members of the universe on each day; days are few and broadcast."""
    inside = (intervals.listed_from <= days.date) & (intervals.listed_to.isNull() | (days.date < intervals.listed_to))
    return intervals.join(F.broadcast(days), inside).select("date", "instrument_id", "symbol")
