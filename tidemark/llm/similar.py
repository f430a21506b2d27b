"""Near-duplicate texts by five-word shingles: SimHash through vantage-point trees, then the exact similarity.

A text's set of shingles has a SimHash of 448 bits, cut into 28 fingerprints of 16. Each of these has a vantage-point
tree of its own (simhash.VantageTree, boundary points sent to both sides), so all pairs that differ in at most one bit
of a fingerprint meet in a leaf, where a tree of the same kind finds them. A bit of a pair at similarity 0.8 differs with
probability acos(8 / 9) / pi = 0.15, so such a pair has 0.28 to meet in one tree and 0.9999 in any. One long fingerprint
would need a reach near the distance of unrelated texts, which makes nearly all points boundary points. Pairs of a leaf
whose first 192 bits are near too join candidate groups; in these the sets of shingles themselves decide, with links
from 0.8 on and none below. Equal sets are one node throughout.

Defined results: words are told apart by ASCII white space and compared in lower case; a text of fewer than five words
is one shingle; null and blank texts are equal to each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import by_batch, cut, ship
from tidemark.llm.components import forest, merge
from tidemark.llm.simhash import SAMPLE, Costs, VantageTree, distance, split

SIZE, SEED = 5, 42
WORDS, REACH = 7, 1
TREES = 4 * WORDS
#: A tree's leaves have SHARD_ROWS fingerprints or a SHARDS-th of all; the trees within leaves go on to LEAF.
SHARD_ROWS, SHARDS, LEAF = 8192, 32, 512
TASK_ROWS = 20_000
ROWS, BLOCK = 500, 1 << 13  # of which texts or sets, or hashes of one set, are held at a time
#: Of 192 bits; at similarity 0.8 29 differ on average, with a deviation of 5, and 96 of unrelated texts, with 7.
CHECK, FAR = 3, 56
RECORD = np.dtype([("node", "<i8"), ("check", "<u8", CHECK), ("fp", "<u2")])
_STEP = np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    size = min(SIZE, len(words))
    each = map(b" ".join, zip(*(words[k:] for k in range(size)), strict=False))
    return np.unique(np.frombuffer(b"".join(map(xxhash.xxh64_digest, each, repeat(SEED))), ">u8").astype(np.uint64))


def signature(own: np.ndarray) -> np.ndarray:
    """SimHash of a set as WORDS numbers of 64 bits: a bit is 1 if set in over half of the hashes."""
    ones = np.zeros(64 * WORDS, np.int64)
    for lo in range(0, len(own), BLOCK):
        z = own[lo : lo + BLOCK, None] + _STEP
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        ones += np.unpackbits((z ^ (z >> np.uint64(31))).view(np.uint8), axis=1).sum(0, dtype=np.int32)
    return np.packbits(2 * ones > len(own)).view(np.uint64)


def binary(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def parts(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> Iterator[np.ndarray]:
    """Connected parts of two and more of 0 .. n - 1; near(i, left) says which of `left` are linked with i."""
    left = np.arange(n)
    while len(left) > 1:
        front, part, left = [left[0]], [left[0]], left[1:]
        while front and len(left):
            hit = near(front.pop(), left)
            front += left[hit].tolist()
            part += left[hit].tolist()
            left = left[~hit]
        if len(part) > 1:
            yield np.array(part)


def leaf_links(rec: np.ndarray, costs: Costs) -> tuple[np.ndarray, np.ndarray]:
    """Rows linked in a leaf: pairs with near fingerprints and near check bits, as many as join their group."""
    fp, check, rng = rec["fp"].astype(np.uint64), np.ascontiguousarray(rec["check"]), np.random.default_rng(11)
    out = [(np.empty(0, np.int64),) * 2]

    def near(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.bitwise_count(check[i] ^ check[j]).sum(1) <= FAR

    todo = [np.arange(len(rec))]
    while todo:
        at = todo.pop()
        if len(at) > LEAF and (s := split(fp[at], REACH, rng, costs)):
            d = distance(fp[at], s[0])
            todo += [at[d <= s[1] + REACH], at[d > s[1]]]
        elif len(at) > LEAF:  # dense: a tight group takes about one comparison a member

            def reached(i: int, left: np.ndarray, at: np.ndarray = at) -> np.ndarray:
                ok = distance(fp[at[left]], fp[at[i]]) <= REACH
                ok[ok] = near(at[left[ok]], at[i])
                return ok

            for part in parts(len(at), reached):
                out.append((at[part], np.repeat(at[part[0]], len(part))))
        else:
            own = rec["fp"][at]
            i, j = np.nonzero(np.bitwise_count(own[:, None] ^ own[None, :]) <= REACH)
            i, j = at[i[i < j]], at[j[i < j]]
            ok = near(i, j)
            out.append((i[ok], j[ok]))
    return tuple(map(np.concatenate, zip(*out, strict=True)))


def alike(sets: list[np.ndarray]) -> Callable[[int, np.ndarray], np.ndarray]:
    """Pairs whose sets have a similarity of 0.8 or more."""
    sizes = np.array([len(x) for x in sets])

    def near(i: int, left: np.ndarray) -> np.ndarray:
        ok = (5 * sizes[left] >= 4 * sizes[i]) & (5 * sizes[i] >= 4 * sizes[left])
        at = np.flatnonzero(ok)
        for lo in range(0, len(at), 256):
            now = at[lo : lo + 256]
            size = sizes[left[now]]
            both = np.concatenate([sets[j] for j in left[now]])
            found = sets[i][np.minimum(np.searchsorted(sets[i], both), len(sets[i]) - 1)] == both
            common = np.add.reduceat(found.astype(np.int64), np.concatenate([[0], size.cumsum()[:-1]]))
            ok[now] = 5 * common >= 4 * (size + len(sets[i]) - common)
        return ok

    return near


def digest() -> list[Column]:
    """Two hashes of the text, as columns low and high."""
    text = F.col("text").cast("string")
    return [F.xxhash64(text).alias("low"), F.xxhash64(F.lit(1), text).alias("high")]


def components(docs: DataFrame) -> DataFrame:
    """(doc_id, low, high, node, root): digest of the text and near-duplicate component of every row."""
    ship(docs.sparkSession)

    def sign(b: pa.RecordBatch) -> pa.RecordBatch:
        node, sig = [], []
        for t in b.column("text").to_pylist():
            own = shingles(t)
            node.append(xxhash.xxh64_intdigest(own.tobytes(), SEED) - 2**63 if len(own) else 0)
            sig.append(signature(own).tobytes())
        return pa.RecordBatch.from_arrays([*map(b.column, names), pa.array(node, pa.int64()), binary(sig)], [*names, "node", "sig"])

    names = ["doc_id", "low", "high"]
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *digest(), F.col("text").cast("string").alias("text"))
    signed = cut(by_batch(text, sign, "doc_id long, low long, high long, node long, sig binary", ROWS))
    distinct = cut(signed.groupBy("node").agg(F.min(F.struct("low", "high")).alias("one"), F.min("sig").alias("sig")))
    total = distinct.count()
    sample = distinct.select("sig").orderBy(F.xxhash64("sig")).limit(SAMPLE).toArrow().column("sig").to_pylist()
    prints = np.frombuffer(b"".join(sample), np.uint16).reshape(-1, TREES).T.astype(np.uint64)
    rows = max(SHARD_ROWS, total // SHARDS)
    trees = [VantageTree(own, total, rows, REACH) for own in prints]
    first = np.cumsum([0, *(t.shards for t in trees)])
    costs = Costs(prints[0], LEAF, 4 * rows, REACH, np.random.default_rng(7))
    known = docs.sparkSession.sparkContext.broadcast((trees, first, costs))

    def deal(b: pa.RecordBatch) -> pa.RecordBatch:
        trees, first, _ = known.value
        raw = b"".join(b.column(1).to_pylist())
        fp, rec = np.frombuffer(raw, np.uint16).reshape(-1, TREES), np.empty(b.num_rows, RECORD)
        rec["node"], rec["check"] = b.column(0).to_numpy(), np.frombuffer(raw, np.uint64).reshape(-1, WORDS)[:, :CHECK]
        shards, rows = [], []
        for k, tree in enumerate(trees):
            rec["fp"] = fp[:, k]
            at, shard = tree.route(rec["fp"].astype(np.uint64))
            order = shard.argsort(kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
                shards.append(first[k] + shard[own[0]])
                rows.append(rec[at[own]].tobytes())
        return pa.RecordBatch.from_arrays([pa.array(shards, pa.int64()), binary(rows)], ["shard", "rows"])

    def search(group: pa.Table) -> pa.Table:
        rec = np.frombuffer(b"".join(group.column("rows").to_pylist()), RECORD)
        a, b = leaf_links(rec, known.value[2])
        label = forest(a, b, np.arange(len(rec)))
        used = np.unique(np.concatenate([a, b]))
        return pa.table({"node": rec["node"][used], "part": rec["node"][label[used]]})

    def link(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        node, root, own = group.column("node").to_numpy(), group.column("root").to_numpy(), group.column("own")
        order = np.lexsort((node, root))
        out = [(np.empty(0, np.int64),) * 2]
        for at in np.split(order, np.flatnonzero(np.diff(root[order])) + 1):
            sets = [np.frombuffer(own[int(j)].as_py(), np.uint64) for j in at]
            for part in parts(len(at), alike(sets)):
                ids = node[at[part]]
                out.append((ids, np.repeat(ids.min(), len(ids))))
        return pa.table(dict(zip(("node", "part"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    def whole(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(0), binary([shingles(t).tobytes() for t in b.column(1).to_pylist()])], ["node", "own"])

    dealt = by_batch(distinct.select("node", "sig"), deal, "shard long, rows binary")
    near = cut(merge(dealt.groupBy("shard").applyInArrow(search, "node long, part long")))
    ones = near.join(distinct, "node").select("node", "one.low", "one.high")
    # equal texts leave a partition once
    texts = text.join(ones, ["low", "high"]).groupBy("node").agg(F.first("text").alias("text"))
    sets = by_batch(texts, whole, "node long, own binary", ROWS)
    task = F.pmod(F.xxhash64("root"), F.lit(max(64, total // TASK_ROWS))).alias("task")
    found = near.join(sets, "node").select("*", task).groupBy("task").applyInArrow(link, "node long, part long")
    roots = distinct.select("node").join(found, "node", "left").select("node", F.coalesce("part", "node").alias("root"))
    return signed.drop("sig").join(cut(roots), "node")
