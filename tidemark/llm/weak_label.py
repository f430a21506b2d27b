"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on each document. The counts of vote patterns over all documents (a
bounded table: 3 to the number of labellers) go to the driver, where expectation-maximisation estimates each
labeller's accuracy and the share of good documents; every pattern then has a posterior. A linear scorer over hashed
word shapes and words is fitted to the posteriors of at most FIT_ROWS documents (the smallest hashes of doc_id and
text) and scores every document; a document is kept if its score is at least 0.5.

Defined results: null or blank text has score 0 and isn't kept; null doc_id is scored like any other; repeated rows get
equal scores; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import by_batch, cut, ship, table
from tidemark.llm.quality_rules import STOP_WORDS

FIT_ROWS, BUCKETS, KEPT_AT = 6000, 1 << 14, 0.5
ABSTAIN, BAD, GOOD = 0, 1, 2
_stop = frozenset(w for ws in STOP_WORDS.values() for w in ws)
_marks = re.compile(r"[#*$%&|<>!=~^]{2,}|[|<>]")
_ends = ".,;:!?#*$%&|()\"'-"


class _Tokens(dict):
    """What is known of a word, packed: hash of its shape, of itself, stop word, upper case, marks, letters."""

    def __missing__(self, word: str) -> int:
        core = word.strip(_ends)
        tail = word[len(word.rstrip(_ends)) :][:3] if core else word[:3]
        upper = len(core) > 1 and core.isupper()
        shape = ("X" if upper else "x" if core.isalpha() else "0" if core.isdigit() else "m" if core else "-") + tail
        letters = len(core) if core.isalpha() else sum(map(str.isalpha, core))
        got = zlib.crc32(("s" + shape).encode("utf-8", "surrogatepass")) % BUCKETS | zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) % BUCKETS << 14
        got |= (core.lower() in _stop) << 28 | upper << 29 | (_marks.search(word) is not None) << 30 | letters << 31
        if len(word) <= 48:
            if len(self) >= 150_000:
                self.clear()
            self[word] = got
        return got


_known = _Tokens()
_token = _known.__getitem__
#: Rows whose texts are held at a time.
ROWS = 1000


def forget() -> None:
    """Let go of the words that this worker knows."""
    _known.clear()


def _vote(value: float, good: tuple[float, float], bad: tuple[float, float]) -> int:
    """GOOD within `good`, BAD outside `bad`, else ABSTAIN."""
    return GOOD if good[0] <= value <= good[1] else BAD if not bad[0] <= value <= bad[1] else ABSTAIN


#: name, measure's index, range that is good, range outside which is bad.
LABELLERS = [
    ("marked words", 0, (0.0, 0.02), (0.0, 0.1)),
    ("stop words", 1, (0.12, 0.8), (0.04, 0.9)),
    ("capitals", 2, (0.0, 0.1), (0.0, 0.4)),
    ("different words", 3, (0.35, 1.0), (0.2, 1.0)),
    ("repeated neighbours", 4, (0.0, 0.05), (0.0, 0.2)),
    ("word length", 5, (3.5, 7.0), (2.5, 10.0)),
    ("letters", 6, (0.85, 1.0), (0.7, 1.0)),
]


def _packed(words: list[str]) -> np.ndarray:
    return np.fromiter(map(_token, words), np.int64, len(words))


def _votes(words: list[str], a: np.ndarray) -> list[int]:
    n, chars = len(words), sum(map(len, words))
    same = sum(map(str.__eq__, words, words[1:]))
    m = ((a >> 30 & 1).mean(), (a >> 28 & 1).mean(), (a >> 29 & 1).mean(), len(set(words)) / n**0.85, same / n, chars / n, (a >> 31).sum() / chars)
    return [_vote(m[i], good, bad) for _, i, good, bad in LABELLERS]


def voted_on(text: str) -> list[int]:
    """The labellers' votes on a text with at least one word."""
    words = text.split()
    return _votes(words, _packed(words))


def scored(text: str, w: np.ndarray) -> float:
    """The scorer's verdict on a text with at least one word: each word adds the weights of its two features."""
    a = _packed(text.split())
    total = (w[a & BUCKETS - 1].sum() + w[a >> 14 & BUCKETS - 1].sum()) / len(a) + w[-1]
    return float(1 / (1 + np.exp(-np.clip(total, -30, 30))))


def measured(text: str) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Feature ids, their weights and the votes of a text with at least one word."""
    words = text.split()
    a = _packed(words)
    ids, counts = np.unique(np.concatenate([a & BUCKETS - 1, a >> 14 & BUCKETS - 1]), return_counts=True)
    return ids, counts / len(words), _votes(words, a)


def pattern(votes: list[int]) -> int:
    out = 0
    for v in votes:
        out = out * 3 + v
    return out


def estimate(patterns: dict[int, int], rounds: int = 50) -> tuple[np.ndarray, float, dict[int, float]]:
    """P(vote | bad, good) by labeller, share of good documents, P(good) by pattern.

    The prior counts, a tenth of the documents, say that a labeller is right in most of its votes; they decide which
    class is which and keep it so where nearly all documents are of one class.
    """
    k, total = len(LABELLERS), sum(patterns.values())
    keys = np.array(list(patterns), np.int64)
    n = np.array([patterns[p] for p in keys], float)
    votes = np.stack([keys // 3 ** (k - 1 - i) % 3 for i in range(k)], 1) if len(keys) else np.zeros((0, k), int)
    prior = np.array([[0.25, 0.60, 0.15], [0.15, 0.05, 0.80]]) * max(10.0, 0.1 * total)  # by class, then vote
    p, good = np.tile(prior / prior.sum(1, keepdims=True), (k, 1, 1)), 0.8
    post = np.zeros(len(keys))
    for _ in range(rounds):
        odds = np.log(good / (1 - good)) + sum(np.log(p[i, 1, votes[:, i]] / p[i, 0, votes[:, i]]) for i in range(k))
        post = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        good = float(np.clip(((n * post).sum() + 8.0) / (total + 10.0), 0.02, 0.98))
        for i in range(k):
            for c, w in ((0, n * (1 - post)), (1, n * post)):
                got = np.bincount(votes[:, i], w, minlength=3) + prior[c]
                p[i, c] = got / got.sum()
    return p, good, dict(zip(keys.tolist(), post.tolist(), strict=True))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Weights of a logistic scorer (the last one is the bias) by adaptive gradient steps over shuffled rows."""
    w, g2, rng = np.zeros(BUCKETS + 1), np.full(BUCKETS + 1, 1e-6), np.random.default_rng(seed)
    w[-1] = 1.0
    for _ in range(rounds):
        for r in rng.permutation(len(rows)):
            ids, x = rows[r]
            err = 1 / (1 + np.exp(-np.clip(w[ids] @ x + w[-1], -30, 30))) - target[r]
            g = err * x
            g2[ids] += g * g
            w[ids] -= 0.3 * g / np.sqrt(g2[ids])
            g2[-1] += err * err
            w[-1] -= 0.1 * err / np.sqrt(g2[-1])
    return w


def train(docs: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[np.ndarray, dict]:
    """The scorer's weights, and what was estimated of the labellers."""
    ship(docs.sparkSession)

    def votes(b: pa.RecordBatch) -> pa.RecordBatch:
        found = [pattern(voted_on(t)) if t and t.strip() else -1 for t in b.column(0).to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), b.column(1)], ["pattern", "h"])

    texts = docs.select(F.col("text").cast("string").alias("text"), F.xxhash64(F.col("doc_id").cast("long"), "text").alias("h"))
    voted = cut(by_batch(texts, votes, "pattern int, h long", ROWS, forget).where("pattern >= 0"))
    patterns = {r.pattern: r.n for r in voted.groupBy("pattern").agg(F.count("*").alias("n")).collect()}  # 3 ** len(LABELLERS) rows at most
    p, good, posterior = estimate(patterns)
    chosen = voted.select("h").orderBy("h").limit(fit_rows).agg(F.max("h")).first()[0]
    report = {"accuracy": {name: float(p[i, 1, GOOD] * good + p[i, 0, BAD] * (1 - good)) for i, (name, *_) in enumerate(LABELLERS)}, "good": good}
    if chosen is None:
        return np.zeros(BUCKETS + 1), report

    def features(b: pa.RecordBatch) -> pa.RecordBatch:
        b = b.filter(pa.array([bool(t and t.strip()) for t in b.column(0).to_pylist()], pa.bool_()))
        got = [measured(t) for t in b.column(0).to_pylist()]
        return pa.RecordBatch.from_arrays([b.column(1), pa.array([g[0] for g in got], pa.list_(pa.int64())), pa.array([g[1] for g in got], pa.list_(pa.float64())), pa.array([pattern(g[2]) for g in got], pa.int32())], ["h", "ids", "x", "pattern"])

    sample = by_batch(texts.where(F.col("h") <= F.lit(chosen)), features, "h long, ids array<long>, x array<double>, pattern int", ROWS, forget)
    rows: pd.DataFrame = sample.orderBy("h").limit(fit_rows).toPandas()
    target = np.array([posterior.get(int(v), good) for v in rows["pattern"]])
    return fit([(np.asarray(i, np.int64), np.asarray(x, np.float64)) for i, x in zip(rows["ids"], rows["x"], strict=True)], target), report


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """docs (doc_id first, text second, any others after) as (doc_id, score, kept)."""
    w = docs.sparkSession.sparkContext.broadcast(weights)

    def make(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(_scores(b.column(1), w.value))], ["doc_id", "score"])

    out = by_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), make, "doc_id long, score double", ROWS, forget)
    return out.withColumn("kept", F.col("score") >= KEPT_AT)


def _scores(texts: pa.Array, w: np.ndarray) -> list[float]:
    return [scored(t, w) if t and t.strip() else 0.0 for t in texts.to_pylist()]


def keep(docs: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The documents that the classifier, trained on them, keeps; with all their columns."""
    weights, _ = train(docs, fit_rows)
    w = docs.sparkSession.sparkContext.broadcast(weights)
    at = docs.columns.index("text")

    def make(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = b.column(at)
        return b.filter(pa.array([s >= KEPT_AT for s in _scores(texts.cast(pa.string()), w.value)], pa.bool_()))

    return by_batch(docs, make, docs.schema, ROWS, forget)


def op10_weak_label(spark, sf_dir):
    """Score and verdict of every document."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs)[0])
