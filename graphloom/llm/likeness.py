"""Near-copies by SimHash and exact likeness: texts whose sets of word shingles have a Jaccard similarity of 4/5 or more.

Shingles are `WIDTH` words; a shorter text is one shingle. A set is told by a hash of its sorted shingle hashes, so texts
with equal sets cost one row. A set's SimHash has `BLOCKS` blocks of `BLOCK` bits and `SKETCH` words more. By the pigeonhole
principle two prints with fewer than `BLOCKS` different bits agree on a whole block, and so meet. Sets of similarity s differ in
a share p of the bits, at 0.8 about 0.15 (sets of 4 and 5 shingles, the worst: 0.19), which is more than that; they share no
block with probability (1 - (1 - p)^BLOCK)^BLOCKS, which is 1e-9 (worst: 4e-6). Sets that meet are near if their sizes allow
the similarity and the other words differ in at most `MAX_BITS` bits, which misses as few. (op4's 64 bits can't tell
0.8: some 10 bits differ, often 20, and unrelated texts have 32.)

Blocks are gone through twice. First `FIRST` of them, in which a block of more than `CELL` sets is cut into cells of one chunk each: a
set has a row and at most a link (with the least of its component in the cell) for each. The components of these links are groups; they
miss links, but are never wrong, and hold most of a large number of near sets by then. Then all blocks: a block of more than `CELL` sets
is dealt into cells of two chunks each, so no task holds an unbounded block, and all pairs of different groups meet in a cell. A group that has more
than `CELL` sets in a block has chunks of its own, which don't meet each other. Links are those between groups, so neither rows
nor links grow with the square of a group's size. Rows do with that of a block of many groups, which have to be compared.

The components of near sets are families, and in a family every pair is held against the sets themselves, so a link is never
a guess. A family of up to `SMALL` sets gives its pairs. A larger one is dealt into cells of two chunks of about `WEIGHT`
shingles each; in a cell, a breadth-first search over the verified links returns a spanning forest.

Texts without words have equal sets, and so are copies of each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import connected_components, in_arrow, materialize, rows_of, small_batches

WIDTH, SEED, SMALL, WEIGHT = 5, 42, 32, 1 << 19
BLOCK, BLOCKS, SKETCH, MAX_BITS, CELL, SAMPLE, FIRST = 12, 144, 3, 64, 2048, 16, 8
WORDS = BLOCK * BLOCKS // 64 + SKETCH
#: A place is a block with its value (20 bits), a cell (20) and a size (23, larger ones count as the largest).
_SIZE, _CELL, _CHUNKS = 23, 20, 1400
_PLACED = "at bigint, fp bigint, root bigint, s0 bigint, s1 bigint, s2 bigint"
_ODD = np.random.default_rng(SEED).integers(0, 1 << 63, (2, WORDS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LANES = np.uint64(0x0101010101010101)


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct shingle hashes of one whole text."""
    words = text.lower().split()  # bytes: lower() takes A-Z only, split() the ASCII white space
    if not words:
        return np.zeros(0, np.uint64)
    parts = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in parts), dtype=np.uint64))


def simhash(hashes: np.ndarray) -> np.ndarray:
    """The `WORDS` words of a set's SimHash: a bit is 1 if it is in over half of the shingles' words."""
    total = np.zeros((8, WORDS * 8), np.int64)
    for at in range(0, len(hashes), 255):  # as many as a byte can count
        x = hashes[at : at + 255, None] * _ODD[0]
        x ^= x >> np.uint64(32)
        x *= _ODD[1]
        x ^= x >> np.uint64(29)
        for bit in range(8):
            total[bit] += ((x >> np.uint64(bit)) & _LANES).sum(0).view(np.uint8)
    return np.packbits(total * 2 > len(hashes), axis=0, bitorder="little").view(np.uint64)[0]


def block_places(prints: np.ndarray) -> np.ndarray:
    """Of rows of words, the `BLOCKS` numbers (block << BLOCK | its bits) of each: 12 bits are half of three bytes."""
    b = np.ascontiguousarray(prints[:, : WORDS - SKETCH]).view(np.uint8).reshape(len(prints), -1, 3).astype(np.int64)
    bits = np.stack([b[:, :, 0] | (b[:, :, 1] & 15) << 8, b[:, :, 1] >> 4 | b[:, :, 2] << 4], 2).reshape(len(prints), BLOCKS)
    return (np.arange(BLOCKS) << BLOCK) | bits


def set_print(hashes: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).view(np.int64))


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in parts])]), pa.int32())
    values = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(offsets, pa.array(values.view(np.int64)))


def signatures(docs: DataFrame) -> DataFrame:
    """All columns but the text, `fp` (tells the set), `size` (its shingles) and `print` (its SimHash)."""
    kept = [c for c in docs.columns if c != "text"]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), "fp bigint, size bigint, print binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, len(kept), 1 << 20):
            fps, sizes, prints = [], [], []
            for text in rows_of(batch, len(kept)):
                x = shingles(text)
                fps.append(set_print(x))
                sizes.append(len(x))
                prints.append(simhash(x).tobytes())
            cols = [*batch.columns[: len(kept)], pa.array(fps, pa.int64()), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=[*kept, "fp", "size", "print"])

    return in_arrow(docs.select(*kept, "text"), run, schema)


def sets(texts: DataFrame) -> DataFrame:
    """(fp, set) of the column `text`, each set once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 0, 1 << 20):
            found = [shingles(x) for x in rows_of(batch, 0)]
            yield pa.RecordBatch.from_arrays([pa.array([set_print(x) for x in found], pa.int64()), _lists(found)], names=["fp", "set"])

    return in_arrow(texts.select("text"), run, "fp bigint, set array<bigint>").dropDuplicates(["fp"])


def alike(both, one, other):
    """Whether `both` common shingles of sets of `one` and `other` are a similarity of 4/5 or more, in whole numbers."""
    return both * 9 >= (one + other) * 4


def _forest(held: list[np.ndarray]) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among sets, by their places."""
    found, ids = np.unique(np.concatenate(held), return_inverse=True)
    parts = np.split(ids, np.cumsum([len(x) for x in held])[:-1])
    sizes, mark, out = np.array([len(x) for x in held]), np.zeros(len(found), np.int64), []
    left = np.arange(len(held))
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        flat, starts, listed = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        while front and len(left):
            if len(listed) == 0 or len(left) * 2 < len(listed):
                listed = left
                flat = np.concatenate([parts[i] for i in listed])
                starts = np.concatenate([[0], np.cumsum(sizes[listed])[:-1]])
            x = front.pop()
            mark[parts[x]] = 1
            near = alike(np.add.reduceat(mark[flat], starts), sizes[listed], sizes[x])
            mark[parts[x]] = 0
            met = np.intersect1d(listed[near], left, assume_unique=True)
            out += [(int(x), int(y)) for y in met]
            front += list(met)
            left = np.setdiff1d(left, met, assume_unique=True)
    return out


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of equal (key, ca, cb) of sorted rows; a run may span batches."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([np.asarray(batch.column(i)) for i in range(3)], 1)
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1), len(key)]
        for lo, hi in zip(cuts, cuts[1:]):
            if held and tuple(key[lo]) != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = tuple(key[lo])
    if held:
        yield pa.Table.from_batches(held)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for cell in _cells(batches):
        fps = cell.column("fp").to_numpy()
        flat = cell.column("set").combine_chunks()
        edges = np.array(_forest(np.split(flat.flatten().to_numpy(), np.cumsum(flat.value_lengths().to_numpy())[:-1])), dtype=np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(fps[edges[:, 0]]), pa.array(fps[edges[:, 1]])], names=["a", "b"])


def _placed(batches: Iterator[pa.RecordBatch], blocks: int) -> Iterator[pa.RecordBatch]:
    """(at, fp, root, s0, s1, s2) of each of the first `blocks` blocks of rows (fp, root, size, print)."""
    for whole in batches:
        for lo in range(0, whole.num_rows, 256):
            batch = whole.slice(lo, 256)
            prints = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint64).reshape(-1, WORDS)
            size = np.minimum(np.asarray(batch.column(2)), (1 << _SIZE) - 1)
            at = (block_places(prints)[:, :blocks] << (_CELL + _SIZE)) | size[:, None]
            each = (np.asarray(batch.column(0)), np.asarray(batch.column(1)), *prints[:, -SKETCH:].T.view(np.int64))
            cols = [at.ravel(), *(np.repeat(c, blocks) for c in each)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["at", "fp", "root", "s0", "s1", "s2"])


def _join(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Let the trees of a and b in `root`, whose rows name their roots, be one."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while ((up := root[root]) != root).any():
            root[:] = up


def _near_rows(at: np.ndarray, group: np.ndarray, words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) of the groups that have near sets within a cell of rows sorted by `at`: of every component, its least group with each other one."""
    cell, size = at >> _SIZE, at & ((1 << _SIZE) - 1)
    root, left, lag = np.arange(len(at)), np.arange(len(at)), 0
    while len(left):
        lag += 1
        left = left[: np.searchsorted(left, len(at) - lag)]
        other = left + lag
        # Sizes ascend in a cell: beyond the first that is too large there is none.
        left = left[(cell[left] == cell[other]) & (size[left] * 5 >= size[other] * 4)]
        one = left[group[left] != group[left + lag]]
        near = one[sum(np.bitwise_count(w[one] ^ w[one + lag]) for w in words) <= MAX_BITS]
        if len(near):
            _join(root, near, near + lag)
    moved = np.flatnonzero(root != np.arange(len(at)))
    least = group.copy()
    np.minimum.at(least, root[moved], group[moved])
    kin = np.union1d(moved, root[moved])
    kin = kin[group[kin] != least[root[kin]]]
    a, b = np.unique(np.stack([least[root[kin]], group[kin]]), axis=1)
    return a, b


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of sorted rows (at, root, s0, s1, s2); a cell may span batches."""

    def batch_of(cols: list[np.ndarray]) -> pa.RecordBatch:
        a, b = _near_rows(cols[0], cols[1], [c.view(np.uint64) for c in cols[2:]])
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [np.asarray(batch.column(i)) for i in range(batch.num_columns)]
        cell = cols[0] >> _SIZE
        cut = int(np.searchsorted(cell, cell[-1]))  # the last cell may go on
        if cut or (held and held[-1][0][-1] >> _SIZE != cell[-1]):
            held.append([c[:cut] for c in cols])
            yield batch_of([np.concatenate(x) for x in zip(*held)])
            held = []
        held.append([c[cut:].copy() for c in cols])
    if held:
        yield batch_of([np.concatenate(x) for x in zip(*held)])


def _crowds(some: DataFrame, blocks: int, sample: int, most: int) -> DataFrame:
    """(block, total, root, n, per) of the blocks with more than `most` sets: the sets of each group in it, and how many make a chunk.

    The numbers are told by a sample of the sets: they decide how rows are dealt, not what meets.
    """
    told = in_arrow(some.filter(F.pmod("fp", F.lit(sample)) == 0), lambda it: _placed(it, blocks), _PLACED)
    told = materialize(told.groupBy(F.shiftright("at", _CELL + _SIZE).alias("block"), "root").agg((F.count("*") * sample).alias("n")), "told")
    totals = told.groupBy("block").agg(F.sum("n").alias("total")).filter(F.col("total") > most)
    # Groups of more than a chunk are at most as many as chunks, and each has less than one chunk that isn't full: so there are `_CHUNKS` in all.
    return told.join(totals, "block").withColumn("per", F.greatest(F.lit(most).cast("double"), F.col("total") / (_CHUNKS // 2 - 1)))


def _met(dealt: DataFrame) -> DataFrame:
    """Links (a, b) of the groups that meet in the cells of rows (at, root, s0, s1, s2)."""
    ordered = dealt.repartition(F.shiftright("at", _SIZE)).sortWithinPartitions("at")
    return in_arrow(ordered, _near, "a bigint, b bigint").distinct()


def groups(some: DataFrame, sample: int = SAMPLE, most: int = CELL) -> DataFrame:
    """(node, root) of sets `some` (fp, size, print) that are near others in a chunk of one of the first blocks."""
    some, block = some.withColumn("root", F.col("fp")).select("fp", "root", "size", "print"), F.shiftright("at", _CELL + _SIZE)
    total = _crowds(some, FIRST, sample, most).groupBy("block").agg(F.max("total").alias("total"))
    total = materialize(total.select("block", F.least(F.ceil(F.col("total") / most), F.lit(1 << _CELL)).alias("g")), "crowds")
    placed = in_arrow(some, lambda it: _placed(it, FIRST), _PLACED).withColumn("block", block).join(total, "block", "left")
    chunk = F.pmod(F.xxhash64("fp", "block"), F.coalesce("g", F.lit(1).cast("long")))
    return connected_components(_met(placed.select((F.col("at") + F.shiftleft(chunk, _SIZE)).alias("at"), "root", "s0", "s1", "s2")))


def near_prints(reps: DataFrame, sample: int = SAMPLE, most: int = CELL) -> DataFrame:
    """Links (a, b), a < b, among the distinct sets `reps` (fp, size, print), enough to connect all that are near.

    A set has a link with its group, and groups have links with groups.
    """
    block = F.shiftright("at", _CELL + _SIZE)
    # Different sets are alike from 4 of 5 shingles on: smaller ones are alone.
    some = reps.filter("size > 3").select("fp", "size", "print")
    known = groups(some, sample, most)
    some = some.join(known, some.fp == known.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "size", "print")
    crowds = _crowds(some, BLOCKS, sample, most)
    large = F.col("n") > F.col("per")
    # Chunks of a block: first those of all the small groups, then those of one large group after the other.
    own = crowds.filter(large).withColumn("m", F.ceil(F.col("n") / F.col("per")))
    own = own.withColumn("before", F.sum("m").over(Window.partitionBy("block").orderBy("root").rowsBetween(Window.unboundedPreceding, -1)))
    own = own.groupBy("block").agg(F.sum("m").alias("owned"), F.collect_list(F.struct("root", F.coalesce("before", F.lit(0).cast("long")).alias("before"), "m")).alias("own"))
    rest = F.sum(F.when(large, 0).otherwise(F.col("n")))
    dealing = crowds.groupBy("block").agg(F.greatest(F.ceil(rest / F.max("per")), F.lit(1).cast("long")).alias("shared")).join(own, "block", "left")
    dealing = materialize(dealing.select("block", "shared", (F.col("shared") + F.coalesce("owned", F.lit(0).cast("long"))).alias("g"), "own"), "crowds")
    placed = in_arrow(some, lambda it: _placed(it, BLOCKS), _PLACED).withColumn("block", block).join(dealing, "block", "left")
    one = F.lit(1).cast("long")
    placed = placed.withColumn("shared", F.coalesce("shared", one)).withColumn("g", F.coalesce("g", one))
    placed = placed.withColumn("mine", F.get(F.filter("own", lambda x: x["root"] == F.col("root")), F.lit(0)))
    start, chunk, o = F.col("shared") + F.col("mine.before"), F.xxhash64("fp", "block"), F.col("o")
    end = start + F.col("mine.m")
    others = F.sequence(F.lit(0).cast("long"), F.coalesce(start, F.col("g")) - 1)
    others = F.when(end < F.col("g"), F.concat(others, F.sequence(end, F.col("g") - 1))).otherwise(others)
    dealt = placed.withColumn("c", F.coalesce(start + F.pmod(chunk, F.col("mine.m")), F.pmod(chunk, F.col("shared")))).withColumn("o", F.explode(others))
    low, high = F.least("c", o), F.greatest("c", o)
    cell = F.shiftright(high * (high + 1), 1) + low
    dealt = dealt.select((F.col("at") + F.shiftleft(cell, _SIZE)).alias("at"), "root", "s0", "s1", "s2")
    return _met(dealt).union(known.filter("root < node").select("root", "node"))


def meetings(reps: DataFrame, sample: int = SAMPLE, most: int = CELL) -> DataFrame:
    """(key, fp, n, weight) of the distinct sets `reps` (fp, size, print) that are in a family with another one; its key tells the family."""
    roots = connected_components(near_prints(reps, sample, most)).select(F.col("root").alias("key"), F.col("node").alias("fp"))
    kin = roots.join(reps.select("fp", "size"), "fp")
    crowds = kin.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("weight"))
    return kin.join(crowds, "key").select("key", "fp", "n", "weight")


def similar_links(met: DataFrame, known: DataFrame, small: int = SMALL, weight: int = WEIGHT) -> DataFrame:
    """Links (a, b) among the sets `known` (fp, set) that meet in `met`, enough to connect all that are alike."""
    few = met.filter(F.col("n") <= small).select("key", "fp")
    pairs = few.select("key", F.col("fp").alias("a")).join(few.select("key", F.col("fp").alias("b")), "key").filter("a < b").select("a", "b").distinct()
    pairs = pairs.join(known.select(F.col("fp").alias("a"), F.col("set").alias("sa")), "a").join(known.select(F.col("fp").alias("b"), F.col("set").alias("sb")), "b")
    pairs = pairs.filter(alike(F.size(F.array_intersect("sa", "sb")), F.size("sa"), F.size("sb"))).select("a", "b")
    many = met.filter(F.col("n") > small).withColumn("g", F.ceil(F.col("weight") / weight).cast("int"))
    mine = F.pmod(F.xxhash64("fp", "key"), F.col("g")).cast("long")
    dealt = many.withColumn("c", mine).withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("g").cast("long") - 1)))
    dealt = dealt.select("key", F.least("c", "o").alias("ca"), F.greatest("c", "o").alias("cb"), "fp").join(known, "fp").select("key", "ca", "cb", "fp", "set")
    ordered = dealt.repartition("key", "ca", "cb").sortWithinPartitions("key", "ca", "cb")
    return materialize(pairs.union(in_arrow(ordered, _links, "a bigint, b bigint")).distinct(), "alike")
