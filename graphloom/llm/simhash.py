"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint has 64 bits, cut into `BLOCKS` blocks. Two fingerprints that differ in at most `MAX_BITS` bits agree on
at least BLOCKS - MAX_BITS whole blocks, so they meet under one of the C(BLOCKS, MAX_BITS) keys made of that many
blocks. With six blocks a key has 32 bits or so: a bucket of unrelated fingerprints stays small for billions of documents.

Only distinct fingerprints are joined, so that exact copies cost one row. A bucket over `CELL` fingerprints is dealt
into cells of two chunks each, so no task holds an unbounded bucket; in a cell, a breadth-first search over the
verified Hamming distances returns a spanning forest, so dense buckets don't return their pairs. Components of the
links are then found by joins.

Nulls: a null text has no words, so fingerprint zero. A null doc_id takes part but is never a component's id; a
component of null ids only has a null id. Repeated rows return one row each. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import connected_components, in_arrow, materialize, rows_of, small_batches
from graphloom.llm.likeness import meetings, sets, signatures, similar_links

SHINGLE, SEED, BLOCKS, MAX_BITS, CELL = 3, 42, 6, 3, 2048


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """The 64-bit SimHash of one text, as a signed integer."""
    words = text.lower().split()  # bytes: lower() takes A-Z only, split() the ASCII white space
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    if width == 3 and n > 1:
        shingles = map(b" ".join, zip(words, words[1:], words[2:]))
    else:
        shingles = (b" ".join(words[i : i + width]) for i in range(n))
    total = np.zeros(64, dtype=np.int64)
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), dtype="<u8", count=n)
    for at in range(0, n, 65536):  # whole text, in slices of bounded memory
        bits = np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns but the text, and `fp` (long)."""
    kept = [c for c in docs.columns if c != text]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), "fp bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, len(kept), 1 << 20):
            fps = pa.array([fingerprint(x) for x in rows_of(batch, len(kept))], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], fps], names=[*kept, "fp"])

    return in_arrow(docs.select(*kept, text), run, schema)


def block_keys(fp: str = "fp", blocks: int = BLOCKS, bits: int = MAX_BITS):
    """An array of (t, key): for each choice of blocks - bits blocks, the choice and those blocks' bits."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = []
    for chosen in combinations(range(blocks), blocks - bits):
        mask = sum(((1 << edges[i + 1]) - (1 << edges[i])) for i in chosen)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    return F.array(*(F.struct(F.lit(t).alias("t"), F.col(fp).bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks)))


def _forest(values: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among `values`."""
    left, out = values, []
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            near = np.bitwise_count(left ^ x) <= bits
            if near.any():
                found = left[near]
                out += [(int(x), int(y)) for y in found]
                front += list(found)
                left = left[~near]
    return out


def _links(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Links within each cell of sorted rows (t, key, ca, cb, fp); a cell may span batches."""
    names, short = ["a", "b"], 8

    def batch_of(cols: list[np.ndarray]) -> pa.RecordBatch:
        *key, fp = cols
        same = np.logical_and.reduce([k[1:] == k[:-1] for k in key]) if len(fp) > 1 else np.zeros(0, bool)
        run = np.concatenate([[0], np.cumsum(~same)]) if len(fp) else np.zeros(0, int)
        size = np.bincount(run) if len(fp) else np.zeros(0, int)
        of, at = size[run] if len(fp) else run, np.concatenate([[0], np.cumsum(size)])
        left, right = [], []
        for lag in range(1, short):
            ok = np.flatnonzero((run[lag:] == run[:-lag]) & (of[lag:] <= short)) if len(fp) > lag else np.zeros(0, int)
            ok = ok[np.bitwise_count(fp[ok] ^ fp[ok + lag]) <= bits]
            left.append(fp[ok])
            right.append(fp[ok + lag])
        for r in np.flatnonzero(size > short):
            if edges := _forest(np.unique(fp[at[r] : at[r + 1]]), bits):
                pairs = np.array(edges, dtype=np.uint64)
                left.append(pairs[:, 0])
                right.append(pairs[:, 1])
        cast = lambda x: pa.array(np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64))
        return pa.RecordBatch.from_arrays([cast(left), cast(right)], names=names)

    held: list[np.ndarray] | None = None
    for batch in batches:
        cols = [np.asarray(batch.column(i)) for i in range(5)]
        cols[4] = cols[4].view(np.uint64)
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols)]
        if not len(cols[0]):
            continue
        last = np.logical_and.reduce([k == k[-1] for k in cols[:4]])
        cut = int(np.flatnonzero(~last)[-1]) + 1 if (~last).any() else 0
        yield batch_of([c[:cut] for c in cols])
        held = [c[cut:] for c in cols]
    if held is not None:
        yield batch_of(held)


def near_links(distinct: DataFrame, bits: int = MAX_BITS, blocks: int = BLOCKS, cell: int = CELL) -> DataFrame:
    """Links (a, b) among distinct fingerprints `fp`, enough to connect all that lie within `bits` bits."""
    keyed = distinct.select("fp", F.explode(block_keys("fp", blocks, bits)).alias("k")).select("k.t", "k.key", "fp")
    sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1")
    met = keyed.join(sizes, ["t", "key"]).withColumn("g", F.ceil(F.col("n") / cell).cast("int"))
    mine = F.pmod(F.xxhash64("fp", "t"), F.col("g")).cast("int")
    dealt = met.withColumn("c", mine).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    dealt = dealt.select("t", "key", F.least("c", "o").alias("ca"), F.greatest("c", "o").alias("cb"), "fp")
    ordered = dealt.repartition("t", "key", "ca", "cb").sortWithinPartitions("t", "key", "ca", "cb")
    return in_arrow(ordered, lambda it: _links(it, bits), "a bigint, b bigint").distinct()


def classes(reps: DataFrame, links: DataFrame) -> DataFrame:
    """(fp, first): of each of the distinct `reps` (fp, first), the smallest `first` (nulls aside) of its component."""
    roots = connected_components(links)
    rooted = reps.join(roots, reps.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.join(roots.select("root").distinct(), "root", "left_semi").groupBy("root").agg(F.min("first").alias("least"))
    return rooted.join(least, "root", "left").select("fp", F.coalesce("least", "first").alias("first"))


def simhash_components(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row of `docs`."""
    fps = materialize(fingerprints(docs.select("doc_id", "text")), "fps")
    reps = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "reps")
    known = classes(reps, near_links(reps.select("fp")))
    return fps.join(known, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first").alias("component_id"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of `docs` without near-copies: of each component of alike texts (likeness.py) the row with the smallest doc_id stays.

    Null ids come last. Rows that repeat a doc_id are told apart by their text, so each component keeps one row of its own.
    """
    spare = F.xxhash64("text")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "spare")
    signed = materialize(signatures(docs.select("doc_id", spare.alias("spare"), "text")).withColumn("rank", rank), "signed")
    reps = materialize(signed.groupBy("fp").agg(F.min("rank").alias("first"), F.first("size").alias("size"), F.first("print").alias("print")), "reps")
    marked = docs.withColumn("__spare", spare)

    def rows_in(keys: DataFrame) -> DataFrame:
        keys = keys.select(F.col("first.doc_id").alias("keep_id"), F.col("first.spare").alias("keep_spare")).distinct()
        return marked.join(keys.hint("merge"), marked["doc_id"].eqNullSafe(keys.keep_id) & marked["__spare"].eqNullSafe(keys.keep_spare), "left_semi")

    met = materialize(meetings(reps), "met")
    crowded = reps.join(met.select("fp").distinct(), "fp", "left_semi")
    links = similar_links(met, materialize(sets(rows_in(crowded)), "sets"))
    known = classes(reps.select("fp", "first"), links)
    # The row that stays is the first of some set, so the sets are enough to find it.
    kept = known.select("first").distinct()
    return rows_in(kept).dropDuplicates(["doc_id", "__spare"]).drop("__spare")
