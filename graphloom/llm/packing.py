"""Packing documents into sequences: dominance reduction after Martello and Toth, then best fit.

All that decides the packing is how many pieces there are of each length from 1 to the capacity. So the plan is made
on that table of counts, whose size has nothing to do with the number of documents, and works on whole groups of equal
sequences at once:

1. Reduction. A set that holds a piece j dominates all other sets with j if each of theirs can be exchanged, piece for piece or
   several for one, into it: (a) j alone where nothing fits beside it; (b) j and a piece that fills the rest exactly; (c) j and the
   longest that fits, where no two fit beside it together; where two may fit but no three, (d) j and the longest that
   fits, if it is at least as long as any two that fit, or (e) j and the fullest pair, if it holds the longest that fits and
   no pair has a longer shorter piece. Such sets are fixed for good, as many at a time as the counts allow, and their pieces
   leave the instance. All lengths are gone through, longest first, again and again until no length has such a set.
   The least number of sequences stays what it was.
2. Best fit, longest first, packs what remains: each piece goes where the least room is left that holds it.

The plan lists, for each length, ranges of piece numbers with their sequences and offset. Pieces get their numbers
by counting within tasks and summing over tasks, so no length, however common, meets in one task.

Nulls: a null text is empty and so is its end id alone. Rows with a null or repeated doc_id are packed like any others. An
empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from graphloom.llm.chunks import Memo, byte_level, encode_batch, id_bytes, looks, plain_word, special_strings
from graphloom.llm.common import discard, in_arrow, materialize, small_batches, texts_of

CAPACITY, END, TEXTS = 2048, 0, 8 << 20


class WordEncoder:
    """Ids of whole texts by a tokenizers file that drops white space and lower-cases; cut at spaces, which no token crosses.

    A special token's string in a text gives its id, as the library does it, or is ordinary text where `plain` is set.
    """

    def __init__(self, path: str, plain: bool = False):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.special = [] if plain else special_strings(self.tokenizer)
        self.model = self.tokenizer.model
        self.code = id_bytes(self.tokenizer.get_vocab_size())
        self.memo = Memo(self._encode)

    def _encode(self, pieces: list[str]) -> list[bytes]:
        """Plain words go to the library's model directly: nothing else would change or cut them."""
        out, model, whole, code, put = [], self.model.tokenize, self.tokenizer.encode, self.code, b"".join
        for x in pieces:
            if x.isalpha() and x.isascii():
                got = model(x.lower())
            elif plain_word(x):
                got = model(byte_level(x.lower()))
            else:
                out.append(put([code[i] for i in whole(x, add_special_tokens=False).ids]))
                continue
            out.append(code[got[0].id] if len(got) == 1 else put([code[t.id] for t in got]))
        return out

    def _mark(self, text: str, sep: str) -> str:
        if any(s in text for s in self.special):
            return text
        text = text.replace("\n", " ")
        if text.isascii() and looks(text)[1]:  # then a mark is a token of its own, with or without white space around it
            text = text.lower().replace(".", " . ").replace(",", " , ")
        return text.replace(" ", sep)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each has."""
        return encode_batch(texts, self._mark, self.memo)


def tokenize(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, plain: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian u32): each document's ids and `end`, cut where longer than `capacity`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(tokenizer, plain)
        for batch in small_batches(batches, 1, TEXTS):
            ids, lengths = encoder.encode(texts_of(batch, 1))
            ends = np.cumsum(lengths)
            ids = np.insert(ids, ends, end)  # one end after each document
            lengths += 1
            ends += np.arange(1, len(ends) + 1)
            each = -(-lengths // capacity)
            whose = np.repeat(np.arange(len(each)), each)
            piece = np.arange(len(whose)) - np.repeat(np.cumsum(each) - each, each)
            size = np.minimum(capacity, lengths[whose] - piece * capacity)
            offsets = 4 * np.concatenate([[0], np.cumsum(size)])
            cut = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
            arrays = [batch.column(0).take(pa.array(whose)), pa.array(piece.astype(np.int32)), pa.array(piece * capacity), pa.array(size), cut.cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "piece", "start", "length", "ids"])

    whole = docs.schema["doc_id"].dataType.simpleString()
    return in_arrow(docs.select("doc_id", "text"), run, f"doc_id {whole}, piece int, start bigint, length bigint, ids binary")


def _dominating(j: int, counts: dict[int, int], sizes: list[int], capacity: int) -> tuple[int, ...] | None:
    """A set with a piece of length `j` that dominates every other such set, or None where the rules give none."""
    room = capacity - j
    fit = bisect_left(sizes, room + 1)
    least: list[int] = []  # the shortest other pieces, as many as matter
    for s in sizes[:fit]:
        least += [s] * min(3 - len(least), counts[s] - (s == j))
        if len(least) == 3:
            break
    if not least:
        return (j,)
    best = next(s for s in reversed(sizes[:fit]) if counts[s] > (s == j))
    if best == room or len(least) < 2 or least[0] + least[1] > room:
        return (j, best)
    if len(least) == 3 and sum(least) <= room:
        return None
    # Two fit beside j, but no three: the fullest pair, and the longest that the shorter of any pair can be.
    small = [s for s in sizes[:fit] for _ in range(min(2, counts[s] - (s == j)))]
    pair, balanced, lo, hi = (0, 0), 0, 0, len(small) - 1
    while lo < hi:
        both = small[lo] + small[hi]
        if both > room:
            hi -= 1
        else:
            if both > sum(pair):
                pair = (small[hi], small[lo])
            balanced = max(balanced, small[lo])
            lo += 1
    if best >= sum(pair):
        return (j, best)
    if pair[0] == best and pair[1] >= balanced:
        return (j, *pair)
    return None


def _reduce(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Take dominating sets out of `counts`, pass after pass, until no length has one; returns them with their numbers."""
    fixed: list[tuple[tuple[int, ...], int]] = []
    sizes, again = sorted(counts), True
    while again:
        again = False
        for j in sizes[::-1]:
            while counts.get(j) and (chosen := _dominating(j, counts, sizes, capacity)):
                need = {s: chosen.count(s) for s in chosen}
                n = min(counts[s] // k for s, k in need.items())
                for s, k in need.items():
                    counts[s] -= k * n
                    if not counts[s]:
                        del counts[s]
                        sizes.pop(bisect_left(sizes, s))
                fixed.append((chosen, n))
                again = True
    return fixed


def _best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, by groups of sequences with equal contents."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms: list[int] = []
    full: list[tuple[tuple[int, ...], int]] = []

    def add(held: tuple[int, ...], n: int, room: int) -> None:
        if not room:
            full.append((held, n))
        else:
            if room not in open_:
                open_[room] = []
                insort(rooms, room)
            open_[room].append((held, n))

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            at = bisect_left(rooms, size)
            if at == len(rooms):
                each = min(capacity // size, left)
                n = left // each
                add((size,) * each, n, capacity - each * size)
                left -= n * each
                continue
            room = rooms[at]
            held, n = open_[room].pop()
            if not open_[room]:
                del open_[room]
                rooms.pop(at)
            # Best fit would come back to the same sequence while it is the fullest that holds the next piece.
            each = min(room // size, left)
            many = min(n, left // each)
            if many < n:
                add(held, n - many, room)
            add(held + (size,) * each, many, room - each * size)
            left -= many * each
    return full + [x for some in open_.values() for x in some]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[dict[int, tuple[np.ndarray, ...]], int]:
    """For each length its slots (first piece number, sequence of that piece, offset), and the number of sequences."""
    left = {int(k): int(v) for k, v in counts.items() if v}
    groups = _reduce(left, capacity)
    groups += _best_fit(left, capacity)
    slots: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for held, n in groups:
        offset = 0
        for size in held:
            slots.setdefault(size, []).append((used.get(size, 0), sequence, offset))
            used[size] = used.get(size, 0) + n
            offset += size
        sequence += n
    return {s: tuple(np.array(x, dtype=np.int64) for x in zip(*rows)) for s, rows in slots.items()}, sequence


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`pieces` (with a column length) and sequence_id, offset.

    `pieces` are written before they are numbered, so that no task has two Python workers at a time.
    """

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, task = np.zeros(capacity + 1, dtype=np.int64), TaskContext.get().partitionId()
        for batch in batches:
            lengths = np.asarray(batch.column(at))
            order = np.argsort(lengths, kind="stable")
            some, first, many = np.unique(lengths[order], return_index=True, return_counts=True)
            ranks = np.empty(len(lengths), dtype=np.int64)
            ranks[order] = np.arange(len(lengths)) - np.repeat(first, many) + np.repeat(seen[some], many)
            seen[some] += many
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(lengths), task, np.int32)), pa.array(ranks)], names=[*names, "__task", "__rank"])

    names, at = pieces.columns, pieces.columns.index("length")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    pieces = materialize(pieces, "pieces")
    numbered = materialize(in_arrow(pieces, number, f"{schema}, __task int, __rank bigint"), "numbered")
    discard(pieces)
    counts = numbered.groupBy("__task", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("__task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))
    total = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # `capacity` rows at most
    slots = pieces.sparkSession.sparkContext.broadcast(plan(total, capacity)[0])  # a few slots for each length

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = slots.value
        for batch in batches:
            lengths, rank = np.asarray(batch.column(at)), np.asarray(batch.column(len(names)))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for size in np.unique(lengths):
                mine = lengths == size
                first, start, off = where[int(size)]
                k = np.searchsorted(first, rank[mine], side="right") - 1
                sequence[mine], offset[mine] = start[k] + rank[mine] - first[k], off[k]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    ranked = numbered.join(bases, ["__task", "length"]).select(*names, (F.col("__rank") + F.col("__base")).alias("__rank"))
    return in_arrow(ranked, place, f"{schema}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    pieces = tokenize(docs, tokenizer, capacity, end)
    return pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), capacity)
