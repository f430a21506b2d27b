"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

A rotation of the principal components is learned on a bounded sample (SAMPLE vectors) so that the signs make balanced
codes. A code is cut into bands that keep a bucket near `bucket_rows` vectors; as wider bands meet less often, further
rotations give further codes until a pair at cosine 0.9 meets with probability MEETS. In each band's table a vector is
at home in the bucket of its band; if a band bit is 0 it also visits the bucket with that bit set, so any two vectors
that differ in at most one bit of a band meet in exactly one bucket of that table. A pair is counted in the first
table in which it meets, after its cosine is computed from the original vectors in double precision. Equal vectors are
one row until the end. Buckets larger than `bucket_cap` are cut into blocks and every two blocks meet in a task of
their own; so are those of which many rows have a partner (`sifted_cap`). Only counts per vector and the members of
local components leave a task, never pairs. Of pairs at cosine 0.9 that meet, fewer than 1 in 1000 differ in more than
WITHIN bits and are lost.

Defined results: vectors that are null, empty, zero or hold a null or non-finite component link with nothing and are
their own component; vectors of different lengths don't link, those of each length are compared among themselves; a
null vec_id counts as a vector but can't name a component; repeated rows link with each other; an empty table gives no
rows; other columns are not carried.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import by_batch, cut, ship, table
from tidemark.llm.components import forest, merge

SAMPLE, ROUNDS, TASK_ROWS = 8192, 30, 50_000
#: Of 64 bits: vectors at cosine 0.9 differ in 9 on average, with a deviation under 3.
WITHIN = 17
#: Chance that a bit differs at cosine 0.9 (its angle over pi), and that such a pair has a table to meet in, at any total.
BIT, MEETS = 0.1436, 0.99


def learn(sample: np.ndarray, bits: int = 64, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection whose signs are the code: principal components, then the learned rotation."""
    dim = sample.shape[1]
    bits = min(bits, dim)
    mean = sample.mean(0) if len(sample) else np.zeros(dim)
    centred = sample - mean
    axes = np.linalg.eigh(centred.T @ centred)[1][:, ::-1][:, :bits] if len(sample) else np.eye(dim, bits)
    v = centred @ axes
    rotation = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))[0]
    for _ in range(ROUNDS):
        u, _, w = np.linalg.svd(np.where(v @ rotation >= 0, 1.0, -1.0).T @ v)
        rotation = w.T @ u.T
    return mean, axes @ rotation


def codes(x: np.ndarray, learned: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """64-bit codes of unit vectors, a column for each rotation."""
    out = np.empty((len(x), len(learned)), np.uint64)
    for k, (mean, projection) in enumerate(learned):
        on = np.zeros((len(x), 64), np.uint8)
        on[:, : projection.shape[1]] = (x - mean) @ projection >= 0
        out[:, k] = np.packbits(on, axis=1).view(">u8")[:, 0]
    return out


def bands(total: int, bits: int, bucket_rows: int = 32) -> list[tuple[int, int, int]]:
    """(rotation, shift, width) of each band."""
    width = min(bits, int(np.clip(np.ceil(np.log2(max(2, total) / bucket_rows)), 4, 20)))
    apart = 1 - (1 - BIT) ** width - width * BIT * (1 - BIT) ** (width - 1)
    each = bits // width
    n = max(each, int(np.ceil(np.log(1 - MEETS) / np.log(apart))) if apart > 1e-9 else 1)
    return [(k // each, 64 - width * (k % each + 1), width) for k in range(n)]


def in_band(code: np.ndarray, part: tuple[int, int, int]) -> np.ndarray:
    rotation, shift, width = part
    return (code[:, rotation] >> np.uint64(shift)) & np.uint64((1 << width) - 1)


def met(a: np.ndarray, b: np.ndarray, parts: list[tuple[int, int, int]]) -> np.ndarray:
    """Whether two codes meet in one of the tables."""
    x = a ^ b
    out = np.zeros(len(x), bool)
    for part in parts:
        out |= np.bitwise_count(in_band(x, part)) <= 1
    return out


def unit(rows: np.ndarray) -> np.ndarray:
    x = rows.astype(np.float64)
    x /= np.maximum(np.abs(x).max(1, keepdims=True), 5e-324)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def candidates(at_home: np.ndarray, code: np.ndarray, earlier: list, within: int, sides: list[np.ndarray]):
    """Index pairs of one bucket, in blocks: at least one at home, not met in an earlier table, codes near enough.

    sides: with two blocks, which one a row is of; then only pairs across are compared.
    """
    home = np.flatnonzero(at_home)
    step = max(1, (1 << 20) // max(len(code), 1))
    for i in range(0, len(home), step):
        own = home[i : i + step]
        a, b = np.nonzero(np.bitwise_count(code[own, 0][:, None] ^ code[None, :, 0]) <= within)
        a = own[a]
        ok = ~at_home[b] | (a < b)  # two at home meet once, two visitors never
        for side in sides:
            ok &= side[a] != side[b]
        a, b = a[ok], b[ok]
        if earlier and len(a):
            ok = ~met(code[a], code[b], earlier)
            a, b = a[ok], b[ok]
        if len(a):
            yield a, b


def segments(table: pa.Table):
    """Each bucket (or two blocks of one) of a task's rows: table number, row indices, at home, codes, sides."""
    cells = [c for c in ("key", "lo", "hi", "lo2", "hi2") if c in table.column_names]
    cell = [table.column(c).to_numpy() for c in cells]
    order = np.lexsort((table.column("rep").to_numpy(), *cell[::-1]))
    edge = np.flatnonzero(np.any([np.diff(c[order]) != 0 for c in cell], axis=0)) + 1
    home, block = table.column("home").to_numpy(), [table.column(c).to_numpy() for c in ("b", "b2") if c in table.column_names]
    code = np.stack([table.column(c).to_numpy() for c in table.column_names if c.startswith("code")], 1).view(np.uint64)
    for at in np.split(order, edge):
        if len(at) > 1:
            one = at[0]
            sides = [b[at] for b, lo, hi in zip(block, cell[1::2], cell[2::2], strict=True) if lo[one] != hi[one]]
            yield int(cell[0][one] % 64), at, home[at], code[at], sides


def in_blocks(rows: DataFrame, cell: list[str], cap: int, names: tuple[str, str, str]) -> DataFrame:
    """Rows of a cell of k blocks, to the k pairs of blocks (lo, hi) that a row's own block b takes part in."""
    b, lo, hi = names
    sizes = cut(rows.groupBy(*cell).agg(F.count("*").alias("n")).where("n > 1"))
    sized = rows.join(sizes.select(*cell, F.ceil(F.col("n") / F.lit(cap)).cast("int").alias("k")), cell)
    own = sized.withColumn(b, F.pmod(F.xxhash64("rep", F.lit(b)), F.col("k").cast("long")).cast("int"))
    every = own.select(*rows.columns, b, F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("o"))
    return every.select(*rows.columns, b, F.least(b, "o").alias(lo), F.greatest(b, "o").alias(hi))


def near_duplicates(vectors: DataFrame, least: float = 0.9, bucket_rows: int = 32, bucket_cap: int = 4096, sifted_cap: int = 256, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    ship(vectors.sparkSession)
    v = F.col(column).cast("array<double>")
    usable = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) & F.exists(v, lambda e: e != 0)
    rows = cut(vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.when(F.coalesce(usable, F.lit(False)), v).alias("v")))
    out = rows.where("v IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    for row in rows.where("v IS NOT NULL").select(F.size("v").alias("d")).distinct().orderBy("d").collect():  # different lengths
        out = out.union(_of_one_length(rows.where(F.size("v") == row.d), row.d, least, bucket_rows, bucket_cap, sifted_cap))
    return out.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _of_one_length(rows: DataFrame, dim: int, least: float, bucket_rows: int, bucket_cap: int, sifted_cap: int) -> DataFrame:
    spark = rows.sparkSession
    distinct = rows.groupBy("v").agg(F.min("vec_id").alias("low"), F.count("*").alias("weight"))
    distinct = cut(distinct.select(F.monotonically_increasing_id().alias("rep"), "v", "low", "weight"))
    total = distinct.count()
    sample = distinct.select("v").orderBy(F.xxhash64("v")).limit(SAMPLE).toPandas()["v"]
    sample = unit(np.stack(sample.to_numpy())) if len(sample) else np.zeros((0, dim))
    parts = bands(total, min(64, dim), bucket_rows)
    learned = [learn(sample, 64, 5 + k) for k in range(parts[-1][0] + 1)]
    model = spark.sparkContext.broadcast((learned, parts))
    names = [f"code{k}" for k in range(len(learned))]
    longs = ", ".join(f"{c} long" for c in names)

    def deal(b: pa.RecordBatch) -> pa.RecordBatch:
        learned, parts = model.value
        x = unit(b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
        code = codes(x, learned)
        at, key, home = [], [], []
        every = np.arange(len(x))
        for t, part in enumerate(parts):
            band = in_band(code, part)
            at.append(every)
            key.append(band.astype(np.int64) * 64 + t)
            home.append(np.ones(len(x), bool))
            for bit in range(part[2]):
                off = np.flatnonzero(~(band >> np.uint64(bit)) & np.uint64(1))
                at.append(off)
                key.append((band[off] | np.uint64(1 << bit)).astype(np.int64) * 64 + t)
                home.append(np.zeros(len(off), bool))
        at, key, home = map(np.concatenate, (at, key, home))
        return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(key), pa.array(home), *map(pa.array, code[at].view(np.int64).T.copy()), b.column(2).take(pa.array(at))], ["rep", "key", "home", *names, "weight"])

    dealt = cut(by_batch(distinct.select("rep", "v", "weight"), deal, f"rep long, key long, home boolean, {longs}, weight long"))
    homes = dealt.groupBy("key").agg(F.max("home").alias("any")).where("any").select("key")
    placed = in_blocks(dealt.join(homes, "key"), ["key"], bucket_cap, ("b", "lo", "hi"))
    n_tasks = max(64, total * len(parts) * (2 + parts[0][2] // 2) // TASK_ROWS)
    task = F.pmod(F.xxhash64("key", "lo", "hi"), F.lit(n_tasks)).alias("task")

    def sift(group: pa.Table) -> pa.Table:
        """Rows with a partner whose code is near enough."""
        group = group.combine_chunks()
        _, parts = model.value
        used = np.zeros(group.num_rows, bool)
        for t, at, home, code, sides in segments(group):
            for a, b in candidates(home, code, parts[:t], WITHIN, sides):
                used[at[a]] = used[at[b]] = True
        return group.filter(pa.array(used)).drop_columns(["task"])

    def link(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        _, parts = model.value
        rep, weight = group.column("rep").to_numpy(), group.column("weight").to_numpy()
        x = unit(group.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
        out = [(np.empty(0, np.int64),) * 3]
        for t, at, home, code, sides in segments(group):
            links, label = np.zeros(len(at), np.int64), np.arange(len(at))
            for a, b in candidates(home, code, parts[:t], WITHIN, sides):
                for i in range(0, len(a), 1 << 16):
                    p, q = a[i : i + (1 << 16)], b[i : i + (1 << 16)]
                    near = np.einsum("ij,ij->i", x[at[p]], x[at[q]]) >= least
                    p, q = p[near], q[near]
                    np.add.at(links, p, weight[at[q]])
                    np.add.at(links, q, weight[at[p]])
                    label = forest(p, q, label)
            own = np.flatnonzero(links)
            out.append((rep[at[own]], links[own], rep[at[label[own]]]))
        return pa.table(dict(zip(("rep", "links", "part"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    columns = f"rep long, key long, home boolean, {longs}, weight long, b int, lo int, hi int"
    near = placed.select("*", task).groupBy("task").applyInArrow(sift, columns)
    near = in_blocks(cut(near), ["key", "lo", "hi"], sifted_cap, ("b2", "lo2", "hi2"))
    task = F.pmod(F.xxhash64("key", "lo", "hi", "lo2", "hi2"), F.lit(n_tasks)).alias("task")
    near = near.join(distinct.select("rep", "v"), "rep").select("*", task)
    near = near.groupBy("task").applyInArrow(link, "rep long, links long, part long")
    counted = cut(near)
    links = counted.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = merge(counted.select(F.col("rep").alias("node"), "part"))
    named = cut(distinct.select("rep", "low").join(roots, distinct.rep == roots.node, "left").select("rep", "low", F.coalesce("root", "rep").alias("root")))
    least_id = named.groupBy("root").agg(F.min("low").alias("component_id"))
    known = distinct.select("rep", "v", "weight").join(links, "rep", "left").join(named.select("rep", "root").join(least_id, "root"), "rep")
    known = cut(known.select("v", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id"))
    return rows.join(known, "v").select("vec_id", "n_links", "component_id")


def op9_embeddings(spark, sf_dir):
    """Links at cosine 0.9 and components of all vectors."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))
