"""Masked pseudo-likelihood of documents under a bidirectional window network.

Vocabulary: the words of all documents are counted; the FREQUENT most frequent ones have ids of their own, all others
share ids by a hash of their last letters. The network predicts each token from the REACH tokens on either side:
embeddings, weighted by position, are summed to a hidden layer that feeds a softmax over classes and one over the
members of the token's class, so probabilities of all ids sum to one. Its biases start from the counts of all
documents, so it begins as the table of word frequencies.

Training is in numpy, over all tokens of all documents. Documents are dealt by hash to streams of about STREAM_TOKENS
tokens a round, however the input is partitioned, and by hash to ROUNDS rounds; in a round every stream goes on from
the model so far, with steps that shrink by the gradients a row of parameters has seen, and the results are averaged,
weighted by tokens. The same rows give the same model, up to the order in which floating-point sums are formed. A
document's score is the sum of its tokens' conditional log-probabilities.

What is gathered grows with the corpus: word counts, the ids of all tokens and one model a stream and round are
shuffled. The driver gets FREQUENT words, SHARED counts and one model a round. Defined results: null or blank text has
no tokens, score 0 and mean 0; repeated rows have equal scores; a text of one word is predicted from padding; an empty
table gives no rows; a text of any length is trained on and scored whole, step by step; other columns are not carried.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import by_batch, cut, ship, table
from tidemark.llm.packing import grouped

FREQUENT, SHARED, CLASSES, MEMBERS = 3072, 1024, 64, 64
SIZE = FREQUENT + SHARED
WIDTH, REACH, BATCH, STEP, RATE = 16, 2, 4096, 4096, 0.2
ROUNDS, STREAM_TOKENS = 4, 1 << 18
SAFE = 60.0  # logits within it need no shift in single precision
GROUP = 1 << 17  # tokens that are held at a time, or one text
BLOCKS = 64  # into which a model is cut for the average
SPREAD = 32  # sums of models are formed in so many parts before the last one
SHAPES: dict[str, tuple[int, ...]] = {
    "in": (SIZE + 1, WIDTH), "at": (2 * REACH, WIDTH), "class": (CLASSES, WIDTH + 1), "member": (CLASSES, MEMBERS, WIDTH + 1),
    "in_seen": (SIZE + 1,), "at_seen": (2 * REACH,), "class_seen": (CLASSES,), "member_seen": (CLASSES, MEMBERS),
}
assert CLASSES * MEMBERS == SIZE


class Words:
    """Ids of words; those seen are kept."""

    def __init__(self, frequent: list[str]):
        self.fixed = {w: i for i, w in enumerate(frequent)}
        self.known = dict(self.fixed)

    def id(self, word: str) -> int:
        if (i := self.known.get(word)) is None:
            i = FREQUENT + zlib.crc32(word[-3:].encode("utf-8", "surrogatepass")) % SHARED
            if len(word) <= 48:
                if len(self.known) > 200_000:
                    self.known = dict(self.fixed)
                self.known[word] = i
        return i

    def ids(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of the words of each text; null is blank."""
        lower = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
        split = pc.utf8_split_whitespace(lower)
        coded = split.flatten().dictionary_encode()
        id_of = np.array([self.id(w) if w else -1 for w in coded.dictionary.to_pylist()], np.int32)
        every = id_of[coded.indices.to_numpy()] if len(id_of) else np.empty(0, np.int32)
        edge = split.offsets.to_numpy() - split.offsets[0].as_py()
        return [x[x >= 0] for x in (every[lo:hi] for lo, hi in zip(edge, edge[1:], strict=False))]


def fresh(counts: np.ndarray | None = None, seed: int = 1) -> dict[str, np.ndarray]:
    """Parameters before training: small embeddings, and biases that give every id its share of the counts.

    The last column of both output layers is their bias; *_seen are the squared gradients of each row so far."""
    rng = np.random.default_rng(seed)
    model = {k: np.ones(v, np.float32) if k.endswith("_seen") else np.zeros(v, np.float32) for k, v in SHAPES.items()}
    model["in"] = rng.normal(0, 0.3, (SIZE + 1, WIDTH)).astype(np.float32)  # the last row stands for the margin
    model["at"] += 1 / (2 * REACH)
    by = (np.ones(SIZE) if counts is None else counts + 0.5).reshape(MEMBERS, CLASSES).T
    model["class"][:, -1] = np.log(by.sum(1) / by.sum())
    model["member"][:, :, -1] = np.log(by / by.sum(1, keepdims=True))
    return model


def flat(model: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([model[k].ravel() for k in SHAPES])


def shaped(values: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in SHAPES.items():
        n = int(np.prod(s))
        out[k] = values[at : at + n].reshape(s).astype(np.float32)
        at += n
    return out


def joined(texts: list[np.ndarray]) -> np.ndarray:
    """Ids of texts one after the other with REACH margins around each; texts without tokens leave no trace."""
    margin = np.full(REACH, SIZE, np.int32)
    return np.concatenate([x for t in texts if len(t) for x in (margin, t)] + [margin])


def exponentials(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Turn z into exponentials, each row up to a factor; their sums by row and the logarithm of the true sums.

    Rows are shifted by their maximum only where a value could overflow or vanish."""
    most = 0.0
    if max(z.max(), -z.min()) > SAFE:
        most = z.max(1)
        z -= most[:, None]
    np.exp(z, out=z)
    total = z @ np.ones(z.shape[1], np.float32)
    return total, np.log(total) + most


def move(model: dict, name: str, rows, gradient: np.ndarray, rate: float) -> None:
    """A step of some rows of parameters, shorter the larger their gradients have been."""
    seen = model[f"{name}_seen"]
    seen[rows] += np.square(gradient).mean(-1)
    model[name][rows] -= rate * gradient / np.sqrt(seen[rows])[..., None]


def step(model: dict, ids: np.ndarray, at: np.ndarray, rate: float | None = None) -> np.ndarray:
    """Log-probability of the tokens at the increasing positions; with a rate, a gradient step follows.

    Hidden layers and their gradients are formed for the whole stretch of ids that the positions span, by shifting it."""
    n = at[-1] - at[0] + 1
    near = ids[at[0] - REACH : at[-1] + REACH + 1]
    shifts = [REACH + o for o in (*range(-REACH, 0), *range(1, REACH + 1))]
    seen = model["in"][near]
    hidden = np.zeros((n, WIDTH + 1), np.float32)
    for weight, o in zip(model["at"], shifts, strict=True):
        hidden[:, :WIDTH] += seen[o : o + n] * weight
    hidden[:, WIDTH] = 1
    token = ids[at]
    order = np.argsort((token % CLASSES).astype(np.uint8), kind="stable")
    token, place = token[order], at[order] - at[0]
    h = hidden[place]
    c, m = token % CLASSES, token // CLASSES
    rows = np.arange(len(at))
    p = h @ model["class"].T
    out = p[rows, c]
    p_sum, total = exponentials(p)
    out -= total
    bounds = np.searchsorted(c, np.arange(CLASSES + 1)).tolist()
    parts = [(k, lo, hi) for k, (lo, hi) in enumerate(zip(bounds, bounds[1:], strict=False)) if lo < hi]
    q = np.empty((len(at), MEMBERS), np.float32)
    for k, lo, hi in parts:
        np.matmul(h[lo:hi], model["member"][k].T, out=q[lo:hi])
    out += q[rows, m]
    q_sum, total = exponentials(q)
    out -= total
    if rate is not None:
        p /= p_sum[:, None]
        p[rows, c] -= 1
        q /= q_sum[:, None]
        q[rows, m] -= 1
        dh = p @ model["class"]
        for k, lo, hi in parts:
            dh[lo:hi] += q[lo:hi] @ model["member"][k]
            move(model, "member", k, q[lo:hi].T @ h[lo:hi], rate)
        move(model, "class", slice(None), p.T @ h, rate)
        spread = np.zeros((n, WIDTH), np.float32)
        spread[place] = dh[:, :WIDTH]
        change = np.zeros((len(near), WIDTH), np.float32)
        turn = np.empty_like(model["at"])
        for i, o in enumerate(shifts):
            change[o : o + n] += spread * model["at"][i]
            turn[i] = np.einsum("nd,nd->d", seen[o : o + n], spread)
        by = np.argsort(near.astype(np.uint16), kind="stable")
        own = near[by]
        starts = np.flatnonzero(np.diff(own, prepend=-1))
        move(model, "in", own[starts], np.add.reduceat(change[by], starts, axis=0), rate)
        move(model, "at", slice(None), turn, rate)
    back = np.empty(len(at))
    back[order] = out
    return back


def positions(ids: np.ndarray) -> np.ndarray:
    return np.flatnonzero(ids != SIZE)


def train_on(texts: Iterable[list[np.ndarray]], model: dict, rate: float = RATE) -> int:
    """Train the model in place; the number of tokens used, which is all of them."""
    n = 0
    for batch in texts:
        if not batch:
            continue
        ids = joined(batch)
        at = positions(ids)
        for i in range(0, len(at), STEP):
            step(model, ids, at[i : i + STEP], rate)
        n += len(at)
    return n


def log_likelihood(model: dict, texts: list[np.ndarray]) -> list[float]:
    """Summed conditional log-probability of each text."""
    out = np.zeros(len(texts))
    if not any(map(len, texts)):
        return out.tolist()
    ids = joined(texts)
    at = positions(ids)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    for i in range(0, len(at), BATCH):
        np.add.at(out, owner[i : i + BATCH], step(model, ids, at[i : i + BATCH]))
    return out.tolist()


def vocabulary(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """The most frequent words of all documents, ties in order of the words, and how often each id occurs."""

    def some(b: pa.RecordBatch) -> pa.RecordBatch:
        lower = pc.utf8_lower(pc.fill_null(b.column(0).cast(pa.large_string()), ""))
        found = pc.value_counts(pc.utf8_split_whitespace(lower).flatten())
        return pa.RecordBatch.from_arrays([found.field("values").cast(pa.string()), found.field("counts")], ["w", "k"])

    partial = by_batch(docs.select(F.col("text").cast("string").alias("text")), some, "w string, k long").where("w <> ''")
    counts = cut(partial.groupBy("w").agg(F.sum("k").alias("n")))
    own = counts.orderBy(F.desc("n"), "w").limit(FREQUENT).collect()
    shared = F.pmod(F.crc32(F.right("w", F.lit(3)).cast("binary")), F.lit(SHARED)).cast("int").alias("id")
    total = np.zeros(SIZE)
    for r in counts.groupBy(shared).agg(F.sum("n").alias("n")).collect():  # SHARED rows at most
        total[FREQUENT + r.id] = r.n
    for k, r in enumerate(own):
        total[k] = r.n
        total[FREQUENT + zlib.crc32(r.w[-3:].encode("utf-8", "surrogatepass")) % SHARED] -= r.n
    return [r.w for r in own], total


def coded(docs: DataFrame, frequent: list[str], streams: int = 1) -> DataFrame:
    """(stream, round, h, doc_id, ids) of every document: ids of its words as 16-bit integers, dealt to streams."""
    words_of = docs.sparkSession.sparkContext.broadcast(frequent)
    kept: dict[str, Words] = {}

    def code(b: pa.RecordBatch) -> pa.RecordBatch:
        words = kept.setdefault("w", Words(words_of.value))
        ids = [x.astype(np.uint16).tobytes() for part in grouped(b.column(2)) for x in words.ids(part)]
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.binary())], ["h", "doc_id", "ids"])

    text, doc_id = F.col("text").cast("string"), F.col("doc_id").cast("long")
    h = F.xxhash64(F.lit(1), doc_id, text)
    found = by_batch(docs.select(h.alias("h"), doc_id.alias("doc_id"), text.alias("text")), code, "h long, doc_id long, ids binary")
    stream = F.pmod("h", F.lit(streams)).cast("int").alias("stream")
    turn = F.pmod(F.shiftrightunsigned("h", 32), F.lit(ROUNDS)).cast("int").alias("round")
    return found.select(stream, turn, "h", "doc_id", "ids")


def train(docs: DataFrame, stream_tokens: int = STREAM_TOKENS) -> tuple[list[str], dict[str, np.ndarray], DataFrame]:
    """Vocabulary, model, and the coded documents."""
    spark = docs.sparkSession
    ship(spark)
    frequent, counts = vocabulary(docs)
    model = fresh(counts)
    streams = max(1, round(counts.sum() / (ROUNDS * stream_tokens)))
    dealt = coded(docs, frequent, streams)
    dealt = cut(dealt.repartitionById(streams, F.col("stream")).sortWithinPartitions("round", "stream", "h", "ids"))
    width = -(-len(flat(model)) // BLOCKS)
    schema = "block int, part int, n long, v array<float>"

    def total(group: pa.Table) -> pa.Table:
        rows = group.column("v").combine_chunks().flatten().to_numpy().reshape(group.num_rows, -1)
        n = group.column("n").to_numpy()
        mean = (n / n.sum()) @ rows.astype(np.float64)
        return pa.table({"block": group.column("block").slice(0, 1), "part": group.column("part").slice(0, 1), "n": [int(n.sum())], "v": pa.array([mean.astype(np.float32)], pa.list_(pa.float32()))})

    for r in range(ROUNDS):
        start = spark.sparkContext.broadcast(flat(model))

        def local(batches: Iterator[pa.RecordBatch], start=start) -> Iterator[pa.RecordBatch]:
            now, net, n, waiting, held = -1, {}, 0, [], 0
            for own, ids in ((s, i) for b in batches for s, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                if own != now:
                    n += train_on([waiting], net)
                    yield from trained(now, net, n)
                    now, net, n, waiting, held = own, shaped(start.value), 0, [], 0
                waiting.append(np.frombuffer(ids, np.uint16).astype(np.int32))
                held += len(waiting[-1])
                if held >= GROUP:
                    n += train_on([waiting], net)
                    waiting, held = [], 0
            n += train_on([waiting], net)
            yield from trained(now, net, n)

        def trained(stream: int, net: dict, n: int) -> Iterator[pa.RecordBatch]:
            if n:
                whole = flat(net)
                parts = [whole[i * width : (i + 1) * width] for i in range(BLOCKS)]
                yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([stream % SPREAD] * BLOCKS, pa.int32()), pa.array([n] * BLOCKS, pa.int64()), pa.array(parts, pa.list_(pa.float32()))], ["block", "part", "n", "v"])

        models = dealt.where((F.col("round") == r) & (F.length("ids") > 0)).select("stream", "ids").mapInArrow(local, schema)
        some = models.groupBy("block", "part").applyInArrow(total, schema)
        rows = some.groupBy("block").applyInArrow(total, schema).orderBy("block").collect()  # one model
        if rows:
            model = shaped(np.concatenate([np.array(x.v, np.float32) for x in rows]))
    return frequent, model, dealt


def score(docs: DataFrame, frequent: list[str], model: dict[str, np.ndarray]) -> DataFrame:
    """(doc_id, n_tokens, log_likelihood, mean_log_likelihood) of every document."""
    ship(docs.sparkSession)
    return score_coded(coded(docs, frequent), model)


def score_coded(dealt: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """As score(), for documents that are coded."""
    shared = dealt.sparkSession.sparkContext.broadcast(flat(model))
    kept: dict[str, dict[str, np.ndarray]] = {}

    def make(b: pa.RecordBatch) -> pa.RecordBatch:
        if "net" not in kept:
            kept["net"] = shaped(shared.value)
        net = kept["net"]
        every = [np.frombuffer(x, np.uint16).astype(np.int32) for x in b.column(1).to_pylist()]
        n, ll, lo = np.array(list(map(len, every)), np.int64), [], 0
        for hi in range(1, len(every) + 1):
            if hi == len(every) or n[lo:hi].sum() >= GROUP:
                ll += log_likelihood(net, every[lo:hi])
                lo = hi
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(ll, pa.float64())], ["doc_id", "n_tokens", "log_likelihood"])

    out = by_batch(dealt.select("doc_id", "ids"), make, "doc_id long, n_tokens long, log_likelihood double")
    return out.withColumn("mean_log_likelihood", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")).otherwise(0.0))


def op5_language_model(spark, sf_dir):
    """Pseudo-log-likelihood of every document under the network trained on all of them."""
    _, model, dealt = train(table(spark, sf_dir, "documents"))
    return score_coded(dealt, model)
