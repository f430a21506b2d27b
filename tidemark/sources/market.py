"""Market data from tables and files: ticks, daily trades, pseudo-trades, minute bars and trade logs."""

from __future__ import annotations

import gzip
import json
import zlib
from datetime import date

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY = ("candidate_id", "symbol", "entry_time")
MINUTE_SCHEMA = T.StructType([T.StructField("ts", T.StringType())] + [T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume")])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as ticks: symbol, ts, price, volume, tick_id."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"), F.get_json_object("props", "$.k").cast("double").alias("volume"), F.col("event_id").alias("tick_id"))


def daily_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as ticks of a brand's day; (k1, k2, k3, k4) orders them."""
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    joined = line.join(part, line.l_partkey == part.p_partkey)
    return joined.select(
        F.col("p_brand").alias("symbol"), F.to_date("l_shipdate").alias("date"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("volume"),
        F.col("l_orderkey").alias("k1"), F.col("l_linenumber").alias("k2"), F.col("l_partkey").alias("k3"), F.col("l_suppkey").alias("k4"),
    )


def pseudo_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as closed trades: candidate (supplier), symbol, exit_date, gross_pnl and notionals."""
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    gross = F.col("l_extendedprice") * (F.col("l_discount") - F.col("l_tax"))
    return line.join(part, line.l_partkey == part.p_partkey).select(
        F.col("l_suppkey").alias("candidate"), F.col("p_brand").alias("symbol"), F.to_date("l_shipdate").alias("exit_date"),
        gross.alias("gross_pnl"), F.col("l_extendedprice").alias("entry_notional"), (F.col("l_extendedprice") + gross).alias("exit_notional"),
    )


def minute_rows(spark: SparkSession, path: str) -> DataFrame:
    """(path, and the six fields as text): rows of minute files as they are written, repeats and broken ones included."""
    fields = T.StructType([T.StructField(c, T.StringType()) for c in MINUTE_SCHEMA.names])
    return spark.read.schema(fields).option("header", True).csv(path).select(F.col("_metadata.file_path").alias("path"), *MINUTE_SCHEMA.names)


def minute_csv_between(spark: SparkSession, path: str, first: date, last: date, zone: str = "America/New_York") -> DataFrame:
    """Bars of exchange days first to last, both included; files of a store by symbol and date are pruned by name.

    A file `SYMBOL_START_END_1min.csv.gz` whose days lie outside isn't opened; any other name is read and its rows tested.
    """
    name = F.regexp_extract("path", r"_(\d{4}-\d{2}-\d{2})_(\d{4}-\d{2}-\d{2})_1min", 0)
    begin, end = (F.try_to_date(F.regexp_extract("path", r"_(\d{4}-\d{2}-\d{2})_(\d{4}-\d{2}-\d{2})_1min", k)) for k in (1, 2))
    files = spark.read.format("binaryFile").load(path).select("path")
    inside = files.where((name == "") | ((begin <= F.lit(last)) & (end >= F.lit(first))))
    paths = [r.path for r in inside.toLocalIterator()]  # file names, not rows
    bars = minute_csv(spark, paths, zone) if paths else spark.createDataFrame([], "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double")
    return bars.where(F.to_date("ts").between(F.lit(first), F.lit(last)))


def minute_csv(spark: SparkSession, path: str | list[str], zone: str = "America/New_York") -> DataFrame:
    """Gzip CSV files `SYMBOL_..._1min.csv.gz` of minute bars, in exchange time, duplicates of (symbol, ts) removed."""
    raw = spark.read.schema(MINUTE_SCHEMA).option("header", True).csv(path).withColumn("_file", F.input_file_name())
    symbol = F.regexp_extract(F.regexp_extract("_file", r"([^/]+)$", 1), r"^([^_]+)_", 1)
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.to_utc_timestamp(F.to_timestamp("ts"), F.current_timezone()).cast("timestamp_ntz"))
    return raw.select(symbol.alias("symbol"), local.alias("ts"), "open", "high", "low", "close", "volume").dropDuplicates(["symbol", "ts"])


def latest_files(spark: SparkSession, folder: str) -> DataFrame:
    """(symbol, path, end): of files `SYMBOL_START_END_1min.csv.gz`, the one with the latest end of each symbol; empty files don't count."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*_1min.csv.gz").load(folder).select("path")
    name = F.regexp_extract("path", r"([^/]+)_1min\.csv\.gz$", 1)
    rows = files.select(F.split(name, "_")[0].alias("symbol"), F.element_at(F.split(name, "_"), -1).alias("end"), "path")
    newest = Window.partitionBy("symbol").orderBy(F.desc("end"), F.desc("path"))
    return rows.withColumn("n", F.row_number().over(newest)).where("n = 1").drop("n")


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def write_minute_csv(df: DataFrame, path: str) -> None:
    """Gzip CSV with a header; the writer's commit makes it atomic, an existing target is an error."""
    df.write.mode("errorifexists").option("header", True).csv(path, compression="gzip")


def write_trades(trades: DataFrame, path: str, rows_per_file: int = 5000) -> None:
    """JSON files of at most rows_per_file trades; an existing target is an error."""
    trades.write.mode("errorifexists").option("maxRecordsPerFile", rows_per_file).json(path)


def read_trades(spark: SparkSession, path: str, key: tuple[str, ...] = KEY) -> DataFrame:
    """A trade log; a repeated key is an error."""
    trades = spark.read.option("multiLine", False).json(path)
    twice = trades.groupBy(*key).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"duplicate trade: {twice[0][:-1]}")
    return trades


def merge_trades(old: DataFrame, new: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """Old trades and those new ones whose key isn't among them."""
    return old.unionByName(new.join(old.select(*key), list(key), "left_anti").dropDuplicates(list(key)))


def minute_file_state(spark: SparkSession, path: str) -> DataFrame:
    """(path, n_rows, first, last, problem) of gzip minute files: readable, right header, times that rise, and rows at all.

    A file is one row of the plan and tested in one task; lines are counted from 1, the header included.
    """
    header = ",".join(MINUTE_SCHEMA.names)

    def state(content: bytes) -> tuple:
        try:
            lines = gzip.decompress(content).decode().splitlines()
        except (OSError, EOFError, ValueError, zlib.error) as e:
            return 0, None, None, f"gzip: {type(e).__name__}"
        if not lines or lines[0] != header:
            return 0, None, None, "header"
        kept = [(n, line.partition(",")[0]) for n, line in enumerate(lines[1:], 2) if line]
        if not kept:
            return 0, None, None, "no rows"
        number, text = zip(*kept, strict=True)
        times = pd.to_datetime(pd.Series(text), utc=True, errors="coerce", format="ISO8601")
        wrong = (times.isna() | (times.diff() <= pd.Timedelta(0))).to_numpy()
        n = int(wrong.argmax()) if wrong.any() else len(kept)
        why = None if n == len(kept) else f"line {number[n]}: " + ("no time" if pd.isna(times[n]) else "repeated time" if times[n] == times[n - 1] else "earlier time")
        return n, text[0] if n else None, text[n - 1] if n else None, why

    def run(batches):
        for b in batches:
            yield pd.DataFrame([(p, *state(c)) for p, c in zip(b["path"], b["content"], strict=True)], columns=["path", "n_rows", "first", "last", "problem"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, n_rows long, first string, last string, problem string")


def _whole(trades: DataFrame, metas: DataFrame, key: tuple[str, ...] | None) -> DataFrame:
    """Trades without `_shard`; ValueError if a shard has no meta, grids differ, shards are lacking or (with key) one is repeated."""
    held = metas.collect()  # one row per shard
    if lacking := trades.select("_shard").distinct().join(metas.select("_shard"), "_shard", "left_anti").collect():
        raise ValueError(f"no meta in {', '.join(sorted(r[0] for r in lacking))}")
    if len({m.grid_spec_hash for m in held}) != 1:
        raise ValueError("the shards' grids differ")
    if len(held) > 1 and ({m.candidate_shards for m in held} != {len(held)} or sorted(m.candidate_shard for m in held) != list(range(len(held)))):
        raise ValueError("the set of shards is not complete")
    twice = trades.groupBy(*key).count().where("count > 1").limit(1).collect() if key else []
    if twice:
        raise ValueError(f"duplicate trade: {twice[0][:-1]}")
    return trades.drop("_shard")


def read_trade_shards(spark: SparkSession, folder: str, key: tuple[str, ...] = KEY) -> DataFrame:
    """Trades of all shards `shard*/trades_*.json` (arrays) with their `meta.json`.

    Errors: a shard without meta, grids that differ, a set of shards that isn't complete, a repeated key.
    """
    shard = F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1).alias("_shard")
    read = spark.read.option("multiLine", True)
    metas = read.json(f"{folder}/shard*/meta.json").select("grid_spec_hash", "candidate_shards", "candidate_shard", shard)
    return _whole(read.json(f"{folder}/shard*/trades_*.json").select("*", shard), metas, key)


META = "schema_version int, grid_spec_hash string, candidate_shard int, candidate_shards int, universe array<string>, start string, end string, trade_count long, rolled_from string, schema string"


def write_run(trades: DataFrame, folder: str, grid_hash: str, universe: list[str], start: str, end: str, shard: int = 0, shards: int = 1, files: DataFrame | None = None, rolled_from: str | None = None) -> None:
    """One shard of a run: `trades` (JSON lines), `cache_manifest.json` (the hashes of its input files), and last `meta.json`.

    All are folders that Spark writes, so any file system will do. Without meta a run isn't whole; nothing is overwritten.
    """
    spark, out = trades.sparkSession, f"{folder}/shard{shard}of{shards}"
    write_trades(trades, f"{out}/trades")
    if files is not None:
        files.write.mode("errorifexists").json(f"{out}/cache_manifest.json")
    count = spark.read.schema(trades.schema).json(f"{out}/trades").count()
    meta = (1, grid_hash, shard, shards, universe, start, end, count, rolled_from, trades.schema.json())
    spark.createDataFrame([meta], META).coalesce(1).write.mode("errorifexists").json(f"{out}/meta.json")


def read_run(spark: SparkSession, folder: str, key: tuple[str, ...] | None = KEY) -> tuple[DataFrame, DataFrame]:
    """Trades and metas of all shards of a run, tested as in read_trade_shards; without key repeated trades are let through."""
    shard = F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+/[^/]+$", 1).alias("_shard")
    metas = spark.read.schema(META).json(f"{folder}/shard*/meta.json").select("*", shard)
    schema = T.StructType.fromJson(json.loads(metas.select("schema").first()[0]))
    return _whole(spark.read.schema(schema).json(f"{folder}/shard*/trades").select("*", shard), metas, key), metas.drop("_shard")


def extend_run(spark: SparkSession, old: str, new: DataFrame, folder: str, grid_hash: str, start: str, end: str, key: tuple[str, ...] = KEY) -> None:
    """A run with the trades of a further period: a trade that the old run has stays as it was. Another grid is an error."""
    trades, metas = read_run(spark, old, None)
    was = metas.agg(F.first("grid_spec_hash"), F.min("start"), F.max("end"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("universe"))))).first()
    if was[0] != grid_hash:
        raise ValueError(f"the run's grid is {was[0]}, not {grid_hash}")
    write_run(merge_trades(trades.dropDuplicates(list(key)), new, key), folder, grid_hash, was[3], min(was[1], start), max(was[2], end), rolled_from=old)


def export_panel(bars: DataFrame, path: str) -> None:
    """A panel as CSV by (datetime, instrument) with $-columns, in order of both; an existing target is an error."""
    columns = [F.col("date").alias("datetime"), F.col("symbol").alias("instrument"), *(F.col(c).alias(f"${c}") for c in ("open", "high", "low", "close", "volume"))]
    bars.select(*columns).orderBy("datetime", "instrument").write.mode("errorifexists").option("header", True).csv(path)
