"""Byte-level BPE with a segment tree.

The leaves stand for byte positions. A leaf holds the rank of the pair that starts at its live token, and an inner
node the least rank below with the leftmost position that has it. A merge kills the right token's leaf and changes the
ranks of two live neighbours: three point updates, each logarithmic, so a piece of n bytes takes O(n log n) however
long it is.

Nulls: a null text is empty: no tokens. Repeated rows return one row each. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.chunks import Memo, encode_batch, marked, plain_word, splitter
from graphloom.llm.common import in_arrow, small_batches, texts_of

NONE = 1 << 60


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    size = 1 << (n - 1).bit_length()
    # A node's value is rank * size + position: its minimum is the leftmost least pair. Dead and rankless leaves have NONE.
    get = ranks.get
    tree = [NONE] * (2 * size)
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            tree[size + i] = r * size + i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    end, before = list(range(1, n + 1)), list(range(-1, n))  # of the token at a live position: its end, the token before
    while (least := tree[1]) < NONE:
        at = least & (size - 1)
        mid = end[at]
        stop = end[at] = end[mid]
        r = None
        if stop < n:
            before[stop] = at
            r = get(piece[at : end[stop]])
        changes = [(mid, NONE), (at, NONE if r is None else r * size + at)]
        if at:
            left = before[at]
            r = get(piece[left:stop])
            changes.append((left, NONE if r is None else r * size + left))
        for leaf, value in changes:  # point updates
            leaf += size
            tree[leaf] = value
            while leaf > 1:
                other = tree[leaf ^ 1]
                leaf >>= 1
                if other < value:
                    value = other
                if tree[leaf] == value:
                    break
                tree[leaf] = value
    out, at = [], 0
    while at < n:
        out.append(ranks[piece[at : end[at]]])
        at = end[at]
    return out


class Coder:
    """Encodes and decodes by one rank file and its split pattern."""

    def __init__(self, path: str, pattern: str):
        self.ranks = load_ranks(path)
        self.bytes = {i: b for b, i in self.ranks.items()}
        self.pattern: regex.Pattern = splitter(pattern)
        self.memo = Memo(self._encode)

    def _encode(self, pieces: list[str]) -> list[bytes]:
        out, ranks = [], self.ranks
        for x in pieces:
            if plain_word(x[1:] if x[:1] == " " else x):
                ids = merge(x.encode(), ranks)  # a word and the space before it are one match
            else:
                ids = [i for piece in self.pattern.findall(x) for i in merge(piece.encode("utf-8", "surrogatepass"), ranks)]
            out.append(array("I", ids).tobytes())
        return out

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text."""
        ids, lengths = encode_batch(texts, lambda text, sep: marked(text, self.pattern, sep), self.memo)
        ids = ids.tolist()
        return [ids[b - n : b] for b, n in zip(np.cumsum(lengths).tolist(), lengths.tolist())]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """All columns but the text, and `ids` (array of int), the tokens of the whole text."""
    kept = [c for c in docs.columns if c not in ("text", "ids")]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), "ids array<int>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(path, pattern)
        for batch in small_batches(batches, len(kept), 4 << 20):
            ids = pa.array(coder.encode(texts_of(batch, len(kept))), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], ids], names=[*kept, "ids"])

    return in_arrow(docs.select(*kept, "text"), run, schema)


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """`encoded` with `ids` replaced by `bytes`, what the tokens decode to; null ids decode to nothing."""
    kept = [c for c in encoded.columns if c not in ("ids", "bytes")]
    schema = ", ".join([*(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in kept), "bytes binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(path, pattern)
        for batch in batches:
            out = pa.array([coder.decode(x or []) for x in batch.column(len(kept)).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], out], names=[*kept, "bytes"])

    return in_arrow(encoded.select(*kept, "ids"), run, schema)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes each whole text and decodes its ids, without keeping either."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(path, pattern)
        digits = {i: str(i) for i in coder.bytes}
        digest = lambda x: hashlib.sha256(x).hexdigest()
        for batch in small_batches(batches, 1, 4 << 20):
            rows = coder.encode(texts_of(batch, 1))
            said = [digest(" ".join(map(digits.__getitem__, ids)).encode()) for ids in rows]
            back = [digest(coder.decode(ids)) for ids in rows]
            arrays = [pa.array([len(x) for x in rows], pa.int64()), pa.array(said, pa.string()), pa.array(back, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    ids = docs.schema["doc_id"].dataType.simpleString()
    return in_arrow(docs.select(F.col("doc_id"), F.col("text")), run, f"doc_id {ids}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
