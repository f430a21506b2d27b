"""Consistent-hash sharding with virtual nodes and bounded loads, in DataFrame operations.

Each shard has REPLICAS points on a ring of 64-bit hashes; a document starts at the first point clockwise from the
hash of its doc_id. The bound of a shard is its equal share, so counts differ by one at most; documents that meet a
full shard go on clockwise, arc by arc. Which ones overflow follows from counts by arc alone: at most
n_shards * REPLICAS counts reach the driver, which returns intervals of ranks within an arc.

Law: `rows`. Defined results: null text has size 8 and crc32 of no bytes; null doc_ids share one arc; repeated rows
take a slot each; an empty table gives no rows; other columns are not carried.
"""

from __future__ import annotations

import bisect
import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidemark.llm.common import cut, table

REPLICAS, CELLS = 64, 4096
#: Documents of one arc are ranked in parts of about SALT_ROWS, or of a SALTS-th of all.
SALT_ROWS, SALTS = 20_000, 1 << 17


def ring(n_shards: int, replicas: int = REPLICAS) -> list[tuple[int, int]]:
    """(point, shard) sorted by point, a signed 64-bit integer."""
    made = {int.from_bytes(hashlib.sha256(f"{s}:{r}".encode()).digest()[:8], "big", signed=True): s for s in range(n_shards) for r in range(replicas)}
    return sorted(made.items())


def flow(counts: list[int], owners: list[int], n_shards: int) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, last rank + 1, shard, first slot) when the keys of each arc go clockwise past full shards."""
    total = sum(counts)
    room = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    filled, out = [0] * n_shards, []
    waiting = [(a, 0, c, a) for a, c in enumerate(counts) if c]  # arc, ranks, arc at which they stand now
    while waiting:
        later = []
        for arc, lo, hi, at in waiting:
            s = owners[at]
            take = min(hi - lo, room[s] - filled[s])
            if take:
                out.append((arc, lo, lo + take, s, filled[s]))
                filled[s] += take
            if lo + take < hi:
                later.append((arc, lo + take, hi, (at + 1) % len(owners)))
        waiting = later
    return out


def _literal(rows: list, schema: str):
    return F.from_json(F.lit(json.dumps(rows)), schema)


def shard(docs: DataFrame, n_shards: int = 24, replicas: int = REPLICAS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document."""
    points = ring(n_shards, replicas)
    at = [p for p, _ in points]
    width = 2**64 // CELLS
    cells = []
    for c in range(CELLS):
        lo = -(2**63) + c * width
        first = bisect.bisect_left(at, lo)
        cells.append({"f": first, "p": at[first : bisect.bisect_left(at, lo + width)]})
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.xxhash64(F.col("doc_id").cast("long"))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), key.alias("_key"))
    cell = F.get(_literal(cells, "array<struct<f:int,p:array<bigint>>>"), (F.shiftright("_key", 52) + CELLS // 2).cast("int"))
    base = base.withColumn("_cell", cell).select(
        "doc_id", "size", "text_crc32",
        F.pmod(F.col("_cell.f") + F.size(F.filter("_cell.p", lambda p: p < F.col("_key"))), F.lit(len(points))).alias("arc"),
    )
    base = cut(base).withColumn("at", F.monotonically_increasing_id())  # stable, as it numbers what is written
    by_arc = cut(base.groupBy("arc").agg(F.count("*").alias("docs")))
    counts = [0] * len(points)
    for row in by_arc.collect():  # len(points) rows at most
        counts[row.arc] = row.docs
    each = max(SALT_ROWS, sum(counts) // SALTS)
    salt = F.pmod(F.xxhash64("at"), F.ceil(F.col("docs") / F.lit(each))).cast("int").alias("salt")
    salted = base.join(F.broadcast(by_arc), "arc").select(*base.columns, salt)
    parts = cut(salted.groupBy("arc", "salt").agg(F.count("*").alias("n")))
    spans = [{"arc": a, "lo": lo, "hi": hi, "shard": s, "first": f} for a, lo, hi, s, f in flow(counts, [s for _, s in points], n_shards)]
    spans_of: list[list] = [[] for _ in points]
    for x in spans:
        spans_of[x.pop("arc")].append(x)
    before = Window.partitionBy("arc").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("arc", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))  # len(points) + SALTS rows at most
    own = Window.partitionBy("arc", "salt").orderBy("at")
    ranked = salted.withColumn("k", F.row_number().over(own) - 1).join(F.broadcast(starts), ["arc", "salt"]).withColumn("rank", F.col("k") + F.col("start"))
    span = F.get(_literal(spans_of, "array<array<struct<lo:bigint,hi:bigint,shard:int,first:bigint>>>"), F.col("arc"))
    found = F.get(F.filter(span, lambda x: (x["lo"] <= F.col("rank")) & (F.col("rank") < x["hi"])), F.lit(0))
    return ranked.withColumn("_s", found).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("_s.shard").alias("shard"),
        (F.col("_s.first") + F.col("rank") - F.col("_s.lo")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_sharding(spark, sf_dir):
    """Every document's place in 24 shards."""
    return shard(table(spark, sf_dir, "documents"))
