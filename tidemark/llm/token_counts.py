"""Word-piece counts by a linear longest-match automaton.

The vocabulary's tokens form a trie over bytes; the last byte of a word is a symbol of its own, as in the vocabulary. A node that can't go on with the next symbol
follows its failure link, which leads to the node of what is left after the longest tokens at its front are taken;
how many tokens that takes is stored with the link. One pass over a word therefore counts its greedy longest-match
pieces without building them. Words repeat, so each worker keeps the counts of those it has seen.

Defined results: null or blank text has no tokens and no words; repeated rows are each returned; other columns are
not carried. A word that can't be cut into tokens of the vocabulary counts as one.
"""

from __future__ import annotations

import json
import unicodedata
from collections import Counter, deque

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import by_batch, ship, table

VOCABULARY, MARK = "word_bpe_49k.json", "</w>"
LAST, CACHE, LONG = 256, 200_000, 64
_made: dict[str, "Counting"] = {}
_words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def final(symbols: list[int]) -> list[int]:
    """The symbols with the last one marked as a word's last."""
    return [*symbols[:-1], LAST + symbols[-1]] if symbols else []


class Automaton:
    def __init__(self, tokens: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        word: set[int] = set()
        for t in tokens:
            u = 0
            for c in t:
                if c not in self.next[u]:
                    self.next[u][c] = len(self.next)
                    self.next.append({})
                u = self.next[u][c]
            word.add(u)
        n = len(self.next)
        self.link, self.pops = [-1] * n, [0] * n
        todo = deque([0])
        while todo:
            u = todo.popleft()
            for c, v in self.next[u].items():
                todo.append(v)
                if v in word:
                    self.link[v], self.pops[v] = 0, 1
                    continue
                z, k = self.link[u], self.pops[u]
                while z >= 0 and c not in self.next[z]:
                    k += self.pops[z]
                    z = self.link[z]
                if z >= 0:
                    self.link[v], self.pops[v] = self.next[z][c], k

    def count(self, symbols) -> int:
        """Pieces of a word given by its symbols; 1 if it has no such pieces."""
        step, link, pops = self.next, self.link, self.pops
        u = n = 0
        for c in symbols:
            while c not in step[u]:
                n += pops[u]
                u = link[u]
                if u < 0:
                    return 1
            u = step[u][c]
        while u > 0:
            n += pops[u]
            u = link[u]
        return n if u == 0 else 1


class Counting:
    """Counts for white-space separated chunks, with what was counted before."""

    def __init__(self, path: str):
        symbols = byte_symbols()
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        self.automaton, self.known = Automaton([final(list(map(symbols.__getitem__, t.removesuffix(MARK)))) if t.endswith(MARK) else [symbols[c] for c in t] for t in vocabulary]), {}

    def chunk(self, chunk: str) -> tuple[int, int]:
        words = _words.findall("".join(c.lower() for c in unicodedata.normalize("NFC", chunk)))
        return sum(self.automaton.count(final([*w.encode("utf-8", "surrogatepass")])) for w in words), len(words)

    def text(self, text: str) -> tuple[int, int]:
        pieces = words = 0
        for chunk, times in Counter(text.replace("\n", " ").split(" ")).items():
            if (got := self.known.get(chunk)) is None:
                got = self.chunk(chunk)
                if len(chunk) <= LONG:
                    if len(self.known) >= CACHE:
                        self.known.clear()
                    self.known[chunk] = got
            pieces += got[0] * times
            words += got[1] * times
        return pieces, words


def counting(path: str) -> Counting:
    if path not in _made:
        _made[path] = Counting(path)
    return _made[path]


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, n_words, n_chars) of every whole text."""
    ship(docs.sparkSession)

    def make(b: pa.RecordBatch) -> pa.RecordBatch:
        c = counting(path or public_tokenizers.path(VOCABULARY))
        got = [(*c.text(t or ""), len(t or "")) for t in b.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([b.column(0), *(pa.array([g[i] for g in got], pa.int64()) for i in range(3))], ["doc_id", "n_tokens", "n_words", "n_chars"])

    return by_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), make, "doc_id long, n_tokens long, n_words long, n_chars long")


def op3_token_counts(spark, sf_dir):
    """Greedy word-piece counts of every document."""
    return token_counts(table(spark, sf_dir, "documents"))
