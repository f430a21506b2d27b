"""Minimum-bin-slack packing of token sequences.

Only how many pieces there are of each length (one count per length up to the capacity) reaches the driver. There,
for bin after bin, the longest piece left is taken and a subset-sum over the lengths left, held as the bits of an
integer, finds the fullest bin that goes with it; the combination is used as often as its lengths last, so that each
step uses up a length. Pieces then find their places by their rank within their length.

Special tokens' strings in a text get their ids, as by the tokenizer's defaults. Defined results: null text is empty
and is one piece of the end id alone; equal doc_ids and repeated rows are pieces
of their own; an empty table gives no rows; texts of any length are encoded whole; other columns are not carried.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm.common import by_batch, cut, ship, table

VOCABULARY, CAPACITY, END_ID = "word_bpe_49k.json", 2048, 0
CACHE, LONG, ROWS = 150_000, 48, 2500
#: Pieces of one length are ranked in parts of about SALT_ROWS, or of a SALTS-th of all.
SALT_ROWS, SALTS = 20_000, 1 << 17
#: Beyond these letters, or at this one, lower-casing and composing may depend on each other; with these
#: marks special tokens begin, which are told apart by case.
_other = "[^\\x00-\u024f]|\u0130|<\\|"
_plain = re.compile("[\x00-\u012f\u0131-\u024f]*")
_made: dict[str, "Cutter"] = {}


class Cutter:
    """Token ids of whole texts.

    The tokenizer splits at white space, so ids of the chunks between blanks are put together. Chunks seen lately are
    kept in two generations of bounded size. Latin text is lower-cased first, which the tokenizer does anyway.
    """

    def __init__(self, path: str):
        self.tokenizer, self.young, self.old = Tokenizer.from_file(path), {}, {}

    def raw(self, chunks: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def known(self, chunks: list[str]) -> list[bytes]:
        """Ids of different chunks."""
        young, old, out = self.young, self.old, {}
        new: dict[str, None] = {}
        ends: list[str] = []
        for c in chunks:
            if (got := young.get(c)) is None and (got := old.get(c)) is not None:
                young[c] = got
            if got is not None:
                out[c] = got
            elif c[-1:] in (".", ",") and c[:-1].isalpha() and _plain.fullmatch(c):  # a letter's run and one mark are two words
                ends.append(c)
                if (base := young.get(c[:-1]) or old.get(c[:-1])) is None:
                    new[c[:-1]] = None
                else:
                    out[c[:-1]] = base
            else:
                new[c] = None
        out.update(zip(new, self.raw(list(new)), strict=True))
        marks = dict(zip(".,", self.raw([".", ","]), strict=True))
        for c in ends:
            out[c] = out[c[:-1]] + marks[c[-1]]
        young.update((c, out[c]) for c in (*new, *ends) if len(c) <= LONG)
        if len(young) > CACHE:
            self.young, self.old = {}, young
        return [out[c] for c in chunks]

    def ids(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text; null is empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        texts = pc.if_else(pc.match_substring_regex(texts, _other), texts, pc.utf8_lower(texts))
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        parts = self.known(coded.dictionary.to_pylist())
        size = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        first, pool = np.cumsum(size) - size, np.frombuffer(b"".join(parts), "<u4")
        at, edge = coded.indices.to_numpy(), split.offsets.to_numpy() - split.offsets[0].as_py()
        for lo, hi in zip(edge, edge[1:], strict=False):
            own = at[lo:hi]
            n = size[own]
            yield pool[np.repeat(first[own] - np.cumsum(n) + n, n) + np.arange(n.sum())]


def grouped(texts: pa.Array, most: int = 1 << 24) -> Iterator[pa.Array]:
    """Slices of the texts of bounded size, or of one text."""
    bytes_ = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy())])
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(bytes_, bytes_[lo] + most, side="right")) - 1)
        yield texts.slice(lo, hi - lo)
        lo = hi


def cutter(path: str) -> Cutter:
    if path not in _made:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _made[path] = Cutter(path)
    return _made[path]


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): every document's ids and the end id, cut at the capacity."""
    ship(docs.sparkSession)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def make(b: pa.RecordBatch) -> pa.RecordBatch:
        c = cutter(path or public_tokenizers.path(VOCABULARY))
        at, rows, ids = [], [], []
        every = (x for group in grouped(b.column(1)) for x in c.ids(group))
        for i, x in enumerate(every):
            whole = np.append(x, np.uint32(END_ID)).astype("<u4")
            for k, s in enumerate(range(0, len(whole), capacity)):
                part = whole[s : s + capacity]
                at.append(i)
                rows.append((k, s, len(part), zlib.crc32(part.tobytes())))
                if with_ids:
                    ids.append(part.astype(np.int64))
        doc = b.column(0).take(pa.array(at, pa.int64()))
        cols = [pa.array([r[i] for r in rows], pa.int32() if i == 0 else pa.int64()) for i in range(4)]
        if with_ids:
            return pa.RecordBatch.from_arrays([doc, *cols, pa.array(ids, pa.list_(pa.int64()))], [*names, "ids"])
        return pa.RecordBatch.from_arrays([doc, *cols], names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    return by_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), make, schema, ROWS)


def fullest(left: dict[int, int], room: int) -> dict[int, int]:
    """Of the lengths left, the combination with the largest sum up to `room`; long ones come first among equals."""
    reach, stages = 1, []
    mask = (1 << (room + 1)) - 1
    for length in sorted(left, reverse=True):
        times, step = min(left[length], room // length), 1
        while times:
            step = min(step, times)
            stages.append((length, step, reach))
            reach |= (reach << (length * step)) & mask
            times -= step
            step *= 2
        if reach >> room & 1:
            break
    target, out = reach.bit_length() - 1, {}
    for length, step, before in reversed(stages):
        if not before >> target & 1:
            out[length] = out.get(length, 0) + step
            target -= length * step
    return out


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(times, {length: pieces in the bin}) in the order in which bins are filled; every piece is used once."""
    left, bins = {k: v for k, v in counts.items() if v}, []
    while left:
        longest = max(left)
        left[longest] -= 1
        rest = fullest({k: v for k, v in left.items() if v}, capacity - longest)
        left[longest] += 1
        rest[longest] = rest.get(longest, 0) + 1
        times = min(left[k] // v for k, v in rest.items())
        bins.append((times, rest))
        for k, v in rest.items():
            left[k] -= v * times
            if not left[k]:
                del left[k]
    return bins


def places(bins: list[tuple[int, dict[int, int]]], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, pieces in a bin, first sequence, offset), sorted; at most a few per bin of the plan."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for times, bin_ in bins:
        offset = 0
        for length in sorted(bin_, reverse=True):
            rows.append((length, used.get(length, 0), bin_[length], sequence, offset))
            used[length] = used.get(length, 0) + times * bin_[length]
            offset += length * bin_[length]
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of pieces() with sequence_id and offset."""
    found = cut(found).withColumn("at", F.monotonically_increasing_id())  # stable, as it numbers what is written
    by_length = cut(found.groupBy("length").agg(F.count("*").alias("pieces")))
    counts = {r.length: r.pieces for r in by_length.collect()}  # `capacity` rows at most
    where = found.sparkSession.sparkContext.broadcast(places(plan(counts, capacity), capacity))
    each = max(SALT_ROWS, sum(counts.values()) // SALTS)
    salt = F.pmod(F.xxhash64("at"), F.ceil(F.col("pieces") / F.lit(each))).cast("int").alias("salt")
    salted = found.join(F.broadcast(by_length), "length").select(*found.columns, salt)
    groups = cut(salted.groupBy("length", "salt").agg(F.count("*").alias("n")))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = groups.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("length", "salt").orderBy("at")
    ranked = salted.withColumn("k", F.row_number().over(own) - 1).join(F.broadcast(starts), ["length", "salt"])  # capacity + SALTS rows at most
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def make(b: pa.RecordBatch) -> pa.RecordBatch:
        t = where.value
        length, rank = (b.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
        at = np.searchsorted(t[:, 0] * (1 << 48) + t[:, 1], length * (1 << 48) + rank, side="right") - 1
        _, first, per, sequence, offset = t[at].T
        k = rank - first
        return pa.RecordBatch.from_arrays([*(b.column(i) for i in range(5)), pa.array(sequence + k // per), pa.array(offset + k % per * length)], [*names, "sequence_id", "offset"])

    return by_batch(ranked.select(*names, (F.col("k") + F.col("first")).alias("rank")), make, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def sequences(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves."""
    parts = cut(pieces(docs, capacity, path, with_ids=True))
    packed = pack(parts.drop("ids"), capacity)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    twin = Window.partitionBy(*key).orderBy(*key)
    a = parts.withColumn("twin", F.row_number().over(twin)).select(*(F.col(c).alias(f"_{c}") for c in (*key, "twin")), "ids")
    b = packed.withColumn("twin", F.row_number().over(twin))
    joined = b.join(a, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*key, "twin")]).select("sequence_id", "offset", "ids")
    return joined.groupBy("sequence_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))


def op6_packing(spark, sf_dir):
    """Every document's pieces and their places in sequences of 2048 tokens."""
    return pack(pieces(table(spark, sf_dir, "documents")))
