"""SimHash near-duplicates through a vantage-point tree over Hamming space.

fingerprints() makes one 64-bit fingerprint per document. Distinct fingerprints are dealt to the leaves of a
vantage-point tree: a node has a vantage fingerprint and a radius, points within the radius go inside, the others
outside. By the triangle inequality a point outside can have a partner inside only if its distance to the vantage
point is at most radius + 3, so only those boundary points are also sent inside, and every linked pair meets in a
leaf. In a leaf a tree of the same kind finds the exact pairs. Splits are chosen by what their whole subtrees cost
(Costs), most often a small ball against all the rest. The tree is fitted on a bounded sample (SAMPLE fingerprints);
every fingerprint is routed through it. Leaves have SHARD_ROWS fingerprints or a LEAVES-th of all.

Defined results: null or blank text has fingerprint 0 and links like any other; null doc_id is ignored in the
component's least id (null if no member has one); repeated rows are each returned; other columns are not carried;
an empty table gives no rows; texts of any length are read whole, in blocks of BLOCK words.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import by_batch, cut, ship
from tidemark.llm.components import forest, merge, min_label

SEED = 42
SAMPLE, SHARD_ROWS, LEAVES = 40_000, 8192, 1024
LEAF = 1024
BLOCK = 1 << 15


def fingerprint(text: str | None, size: int = 3) -> int:
    """SimHash of the text's word shingles, as a signed 64-bit integer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < size:
        words, size = [b" ".join(words)], 1
    n = len(words) - size + 1
    ones = np.zeros(64, np.int64)
    for i in range(0, n, BLOCK):
        part = words[i : i + BLOCK + size - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(size)), strict=False))
        raw = b"".join(map(xxhash.xxh64_digest, shingles, repeat(SEED)))
        ones += np.unpackbits(np.frombuffer(raw, np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">i8")[0])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, fp) with fp as a signed long."""
    ship(docs.sparkSession)

    def make(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t, size) for t in b.column(1).to_pylist()], pa.int64())], ["doc_id", "fp"])

    return by_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), make, "doc_id long, fp long")


def distance(points: np.ndarray, one: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ one)


def shares(points: np.ndarray, reach: int, vantages: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points inside and outside for every vantage point (rows) and radius from 0 to 64 (columns)."""
    count = np.stack([np.bincount(distance(points, v), minlength=65 + reach).cumsum() for v in vantages])
    return count[:, reach : 65 + reach].astype(float), len(points) - count[:, :65].astype(float)


class Costs:
    """What it costs to deal n points to leaves of at most `rows`: the copies of points in all leaves of the subtree.

    The table is made from small to large n under the assumption that the shares which vantage points of the sample
    leave inside and outside recur at every size, so a split is judged by all the splits that follow it. Without
    a split, n points are ceil(n / rows) blocks of which every two meet.
    """

    GRID = 1.01

    def __init__(self, sample: np.ndarray, rows: int, most: float, reach: int, rng: np.random.Generator):
        self.rows, self.factor = rows, np.ones(2)
        if not len(sample):
            return
        inside, outside = (x.ravel() / len(sample) for x in shares(sample, reach, rng.choice(sample, 12)))
        real = (inside > 0) & (inside < 0.98) & (outside > 0) & (outside < 0.98)
        inside, outside = inside[real], outside[real]
        factor = [1.0]
        for k in range(1, 2 + int(np.ceil(np.log(max(1.0, most / rows)) / np.log(self.GRID)))):
            n = rows * self.GRID**k
            self.factor = np.array(factor)
            cheapest = ((self.of(inside * n) + self.of(outside * n)) / n).min(initial=np.inf)
            factor.append(min(cheapest, np.ceil(n / rows)))
        self.factor = np.array(factor)

    def of(self, n: np.ndarray) -> np.ndarray:
        at = np.log(np.maximum(n, self.rows) / self.rows) / np.log(self.GRID)
        return n * np.interp(at, np.arange(len(self.factor)), self.factor)


def split(points: np.ndarray, reach: int, rng: np.random.Generator, costs: Costs, scale: float = 1.0) -> tuple[np.uint64, int] | None:
    """The vantage point and radius whose whole subtree costs least, or None if blocks cost no more."""
    vantages = rng.choice(points, min(6, len(points)), replace=False)
    inside, outside = shares(points, reach, vantages)
    cost = costs.of(scale * inside) + costs.of(scale * outside)
    cost[(inside == 0) | (outside == 0) | (np.maximum(inside, outside) > 0.98 * len(points))] = np.inf
    v, r = np.unravel_index(cost.argmin(), cost.shape)
    whole = scale * len(points)
    return (vantages[v], int(r)) if cost[v, r] < whole * np.ceil(whole / costs.rows) else None


class VantageTree:
    """Nodes in a list, as (vantage, radius, inside, outside) or (first shard, blocks)."""

    def __init__(self, sample: np.ndarray, total: int, shard_rows: int, reach: int = 3):
        self.reach, self.shards, self.depth, self.nodes = reach, 0, 0, [()]
        sample, rng = np.asarray(sample, np.uint64), np.random.default_rng(7)
        scale = max(1.0, total / max(1, len(sample)))
        costs = Costs(sample, shard_rows, total, reach, rng)
        todo = [(0, sample, 0)]
        while todo:
            at, points, depth = todo.pop()
            self.depth = max(self.depth, depth)
            if len(points) * scale > shard_rows and len(points) > 8 and (s := split(points, reach, rng, costs, scale)):
                d, n = distance(points, s[0]), len(self.nodes)
                self.nodes[at] = (*s, n, n + 1)
                self.nodes += [(), ()]
                todo += [(n, points[d <= s[1] + reach], depth + 1), (n + 1, points[d > s[1]], depth + 1)]
            else:
                blocks = max(1, int(np.ceil(len(points) * scale / shard_rows)))
                self.nodes[at] = (self.shards, blocks)
                self.shards += blocks * (blocks + 1) // 2

    def route(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of a point and a shard in which it is needed, for all points.

        A leaf that no split makes cheaper has one shard for each two of its blocks.
        """
        rows, shards = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        todo = [(0, np.arange(len(points)))]
        while todo:
            k, at = todo.pop()
            if not len(at):
                continue
            if len(node := self.nodes[k]) == 2:
                first, blocks = node
                own = ((points[at] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % blocks
                for other in range(blocks):
                    a, b = np.minimum(own, other), np.maximum(own, other)
                    rows.append(at)
                    shards.append(first + b * (b + 1) // 2 + a)
            else:
                v, radius, inside, outside = node
                d = distance(points[at], v)
                todo += [(inside, at[d <= radius + self.reach]), (outside, at[d > radius])]
        return np.concatenate(rows), np.concatenate(shards)


def local_parts(points: np.ndarray, reach: int = 3) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Members and the least member of their part, for parts of two and more; parts of different leaves may overlap."""
    rng = np.random.default_rng(11)
    whole = np.unique(np.asarray(points, np.uint64))
    costs = Costs(whole, LEAF, len(whole), reach, rng)
    todo = [whole]
    while todo:
        x = todo.pop()
        if len(x) > LEAF and (s := split(x, reach, rng, costs)):
            d = distance(x, s[0])
            todo += [x[d <= s[1] + reach], x[d > s[1]]]
        elif len(x) > LEAF:
            yield from flood(x, reach)
        elif len(x) > 1:
            near = np.bitwise_count(x[:, None] ^ x[None, :]) <= reach
            label = min_label(near)
            own = np.flatnonzero(np.bincount(label, minlength=len(x))[label] > 1)
            if len(own):
                yield x[own], x[label[own]]


def flood(x: np.ndarray, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Parts of a dense leaf by breadth-first search over what isn't reached yet."""
    left = x
    while len(left):
        part, front, left = [left[:1]], left[:1], left[1:]
        while len(front) and len(left):
            step = max(1, (1 << 21) // len(left))
            now, front = front[:step], front[step:]
            hit = (np.bitwise_count(left[None, :] ^ now[:, None]) <= reach).any(0)
            if hit.any():
                part.append(left[hit])
                front, left = np.concatenate([front, left[hit]]), left[~hit]
        if len(part) > 1:
            whole = np.concatenate(part)
            yield whole, np.repeat(whole.min(), len(whole))


def near_duplicates(docs: DataFrame, size: int = 3, reach: int = 3, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(doc_id, fp, component_id): documents whose fingerprints are linked at `reach` or fewer bits, transitively."""
    prints = cut(fingerprints(docs, size))
    spark = docs.sparkSession
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("low")))
    total = distinct.count()
    sample = distinct.select("fp").orderBy(F.xxhash64("fp")).limit(SAMPLE).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    tree = spark.sparkContext.broadcast(VantageTree(sample, total, max(shard_rows, total // LEAVES), reach))

    def deal(b: pa.RecordBatch) -> pa.RecordBatch:
        fp = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        at, shard = tree.value.route(fp.view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(fp[at]), pa.array(shard)], ["fp", "shard"])

    def link(group: pa.Table) -> pa.Table:
        node, part = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
        for m, p in local_parts(group.column("fp").to_numpy().astype(np.int64).view(np.uint64), reach):
            node.append(m)
            part.append(p)
        # a fingerprint leaves a shard once, with the least member of its component there
        own, at = np.unique(np.concatenate([*node, *part]), return_inverse=True)
        a, b = np.split(at, 2)
        label = forest(a, b, np.arange(len(own)))
        return pa.table({"node": own.view(np.int64), "part": own[label].view(np.int64)})

    dealt = by_batch(distinct.select("fp"), deal, "fp long, shard long")
    members = merge(dealt.groupBy("shard").applyInArrow(link, "node long, part long"))
    joined = distinct.join(members, distinct.fp == members.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    joined = cut(joined)
    least = joined.groupBy("root").agg(F.min("low").alias("component_id"))
    named = cut(joined.select("fp", "root").join(least, "root").select("fp", "component_id"))
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def op2_simhash(spark, sf_dir):
    """Every document's fingerprint and near-duplicate component."""
    from tidemark.llm.common import table

    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
