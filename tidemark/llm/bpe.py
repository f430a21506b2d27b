"""Byte-level BPE with the tiktoken library and a local rank file.

A text is cut only where the split pattern has a match boundary whatever stands around it: after a letter before
anything else, after a digit before anything else, and before white space that follows something else. White space runs too long for the pattern matcher are encoded as the one match (or two) that they are.

Defined results: null text is empty and has no tokens; lone surrogates can't occur in Spark strings; repeated rows are
each returned; other columns are not carried.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import by_batch, ship, table

RANKS = "byte_bpe_multi_50k.tiktoken"
CHUNK, RUN = 1 << 16, 1 << 13
_made: dict[str, tiktoken.Encoding] = {}
#: The characters that the split pattern's \s matches.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_safe = regex.compile(rf"(?<=\p{{L}})(?=\P{{L}})|(?<=\p{{N}})(?=\P{{N}})|(?<=[^{WHITE}])(?=[{WHITE}])")
_run = regex.compile(rf"[{WHITE}]{{{RUN},}}")


def encoding(path: str) -> tiktoken.Encoding:
    if path not in _made:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _made[path] = tiktoken.Encoding("local", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _made[path]


def pieces(text: str, size: int = CHUNK) -> Iterator[str]:
    """Parts of the text that can be encoded one by one; `size` characters or up to the next safe boundary."""
    start = 0
    while len(text) - start > size:
        m = _safe.search(text, start + size)
        if not m:
            break
        yield text[start : m.start()]
        start = m.start()
    yield text[start:]


def encode(enc: tiktoken.Encoding, text: str) -> np.ndarray:
    """Ids of the whole text as unsigned 32-bit integers."""
    if len(text) <= RUN:
        return np.asarray(enc.encode_ordinary(text), "<u4")
    out: list[int] = []
    for part in pieces(text):
        at = 0
        for m in _run.finditer(part) if len(part) > RUN else ():
            # the run is one match, but for its last character if something follows
            end = m.end() if m.end() == len(part) else m.end() - 1
            out += enc.encode_ordinary(part[at : m.start()])
            out += enc._encode_single_piece(part[m.start() : end])
            at = end
        out += enc.encode_ordinary(part[at:])
    return np.asarray(out, "<u4")


def decode(enc: tiktoken.Encoding, ids: np.ndarray) -> bytes:
    return enc.decode_bytes(ids.tolist())


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids): the token ids of every text."""
    ship(docs.sparkSession)

    def make(b: pa.RecordBatch) -> pa.RecordBatch:
        enc = encoding(path or public_tokenizers.path(RANKS))
        ids = [encode(enc, t or "").astype(np.int64) for t in b.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int64()))], ["doc_id", "ids"])

    return by_batch(_texts(docs), make, "doc_id long, ids array<long>")


def decoded(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, content): the bytes that the ids of encoded() stand for."""
    ship(tokens.sparkSession)

    def make(b: pa.RecordBatch) -> pa.RecordBatch:
        enc = encoding(path or public_tokenizers.path(RANKS))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([enc.decode_bytes(x or []) for x in b.column(1).to_pylist()], pa.binary())], ["doc_id", "content"])

    return by_batch(tokens.select("doc_id", "ids"), make, "doc_id long, content binary")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): ids never leave the worker that made them."""
    ship(docs.sparkSession)

    def make(b: pa.RecordBatch) -> pa.RecordBatch:
        enc = encoding(path or public_tokenizers.path(RANKS))
        n, a, d = [], [], []
        for t in b.column(1).to_pylist():
            ids = encode(enc, t or "")
            n.append(len(ids))
            a.append(hashlib.sha256(ids.tobytes()).hexdigest())
            d.append(hashlib.sha256(decode(enc, ids)).hexdigest())
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(d)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return by_batch(_texts(docs), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def op7_bpe(spark, sf_dir):
    """Token ids of every document and the bytes they decode to, as digests."""
    return round_trip(table(spark, sf_dir, "documents"))
