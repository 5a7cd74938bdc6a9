"""Nearest neighbours by largest inner product with collision-counting hashing (query-aware LSH).

The vectors are dealt into shards of about SHARD rows, each built once and written as a file to the shared folder; the queries are
written in blocks of about BLOCK. A task takes a block against a few shards one after another: so rows are shuffled once, and
what the searches return is a few results for each query and task. In a shard, a vector gets one more component that gives all the same norm, so that the largest inner product is
the nearest point. Each of LINES random projections (as many as dimensions, if those are more) is kept as a sorted array. A window centred on the query's own projection
opens over every array; virtual rehashing widens all windows by the factor GROW until enough of the shard's n vectors
(ENOUGH * K + SPREAD * sqrt(n)) have fallen into THRESHOLD of the LINES windows. Those are verified: inner products of the
original vectors, in double precision. A query's best K of all shards are its result. Every vector is indexed; nothing is fitted.

Nulls: vectors that are null or zero, or hold null or non-finite components, and rows without an id take no part.
Vectors are compared with those of the same length only. Rows that repeat the query's id are its own and never its
neighbours; a repeated query is answered once for each distinct vector. An empty table gives no rows.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import shared_path

K, LINES, THRESHOLD, START, GROW, ENOUGH, SPREAD, SHARD, BLOCK, SEED = 20, 64, 0.7, 1.0, 1.2, 5, 10.0, 16_384, 256, 11


class Shard:
    """Sorted projections of some vectors."""

    def __init__(self, vectors: np.ndarray, lines: int = LINES, seed: int = SEED):
        self.vectors = vectors
        unit = vectors / np.abs(vectors).max()  # so that no square overflows
        norms = np.einsum("ij,ij->i", unit, unit)
        self.norm = float(np.sqrt(norms.max()))
        rest = np.sqrt(np.maximum(self.norm**2 - norms, 0))
        # Random orthonormal bases: each line is a random direction, and those of a basis don't repeat one another.
        rng, dim = np.random.default_rng(seed), vectors.shape[1] + 1
        lines = max(lines, dim - 1)
        bases = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-lines // dim))]
        self.lines = np.hstack(bases)[:, :lines]
        p = (unit @ self.lines[:-1] + rest[:, None] * self.lines[-1]).T
        self.order = np.argsort(p, axis=1, kind="stable")
        self.sorted = np.take_along_axis(p, self.order, axis=1).astype(np.float32)
        self.width = float(np.median(p.std(axis=1))) or 1.0

    def arrays(self) -> dict[str, np.ndarray]:
        return {"vectors": self.vectors, "order": self.order, "sorted": self.sorted, "lines": self.lines, "scale": np.array([self.norm, self.width])}

    @classmethod
    def of(cls, vectors, order, sorted, lines, scale) -> Shard:
        """A shard as arrays() gave it."""
        out = cls.__new__(cls)
        out.vectors, out.order, out.sorted, out.lines, (out.norm, out.width) = vectors, order, sorted, lines, scale.tolist()
        return out

    def candidates(self, queries: np.ndarray, need: int, threshold: float = THRESHOLD) -> Iterator[np.ndarray]:
        """For each query the positions of at least `need` vectors (all, if fewer) that reach the collision threshold.

        Of a round's vectors over the threshold, those are taken that exceed the highest one that still leaves `need`.
        """
        n, lines = len(self.vectors), len(self.sorted)
        queries = queries / np.abs(queries).max(axis=1, keepdims=True)
        at = ((queries * (self.norm / np.sqrt((queries**2).sum(1)))[:, None]) @ self.lines[:-1]).T.astype(np.float32)
        least, windows = int(np.ceil(threshold * lines)), []
        for i in range(len(queries)):
            if n <= need:
                yield np.arange(n)
                continue
            r, count = 0, None
            while True:
                if r == len(windows):
                    half = np.float32(START * self.width * GROW**r)
                    windows.append([np.array([s.searchsorted(v + d, side) for s, v in zip(self.sorted, at)]) for d, side in ((-half, "left"), (half, "right"))])
                low, high = windows[r][0][:, i].tolist(), windows[r][1][:, i].tolist()
                if count is None:
                    inside = sum(high) - sum(low)
                    if 2 * inside > n * lines:  # then those outside are fewer to count
                        count = lines - np.bincount(np.concatenate([x for o, a, b in zip(self.order, low, high) for x in (o[:a], o[b:])]), minlength=n)
                    else:
                        count = np.bincount(np.concatenate([o[a:b] for o, a, b in zip(self.order, low, high)]), minlength=n)
                else:
                    fresh = [x for o, a, b, c, d in zip(self.order, low, lo, hi, high) for x in (o[a:b], o[c:d])]
                    count += np.bincount(np.concatenate(fresh), minlength=n)
                lo, hi = low, high
                reach = np.bincount(count, minlength=lines + 1)[::-1].cumsum()[::-1]  # by collisions: how many have as many
                if reach[least] >= need or sum(hi) - sum(lo) == n * lines:
                    yield np.flatnonzero(count >= max(least, np.flatnonzero(reach >= min(need, n))[-1]))
                    break
                r += 1


class Best:
    """The best `k` of each query over the shards seen so far; ties go to the smaller id."""

    def __init__(self, queries: np.ndarray, query_ids: np.ndarray, k: int = K):
        self.queries, self.query_ids, self.k = queries, query_ids, k
        self.ids = [np.zeros(0, np.int64)] * len(queries)
        self.scores = [np.zeros(0)] * len(queries)

    def see(self, shard: Shard, ids: np.ndarray) -> None:
        for i, near in enumerate(shard.candidates(self.queries, verified(len(ids), self.k))):
            near = near[ids[near] != self.query_ids[i]]
            # Row by row, so that equal vectors get equal scores.
            scores = np.concatenate([self.scores[i], (shard.vectors[near] * self.queries[i]).sum(axis=1)])
            found = np.concatenate([self.ids[i], ids[near]])
            best = np.lexsort((found, -scores))[: self.k]
            self.ids[i], self.scores[i] = found[best], scores[best]


def verified(n: int, k: int = K) -> int:
    """How many of a shard's `n` vectors are verified for a query at least: a share that falls as shards grow."""
    return ENOUGH * k + int(SPREAD * n**0.5)


def _save(uri: str, **arrays: np.ndarray) -> None:
    """Write arrays as one file; a task that runs again writes the same one."""
    fs, path = pafs.FileSystem.from_uri(uri)
    own = f"{path}.{uuid.uuid4().hex}.part"
    held = io.BytesIO()
    np.savez(held, **arrays)
    with fs.open_output_stream(own) as f:
        f.write(held.getbuffer())
    fs.move(own, path)


def _load(uri: str) -> dict[str, np.ndarray]:
    fs, path = pafs.FileSystem.from_uri(uri)
    with fs.open_input_file(path) as f:
        held = io.BytesIO(f.read())
    with np.load(held) as got:
        return dict(got)


def _matrix(t: pa.Table) -> np.ndarray:
    return np.asarray(t.column("v").combine_chunks().flatten(), dtype=np.float64).reshape(t.num_rows, -1)


def write_index(usable: DataFrame, root: str, shards: dict[int, int]) -> None:
    """Build the shards of `usable` (id, v, dim; `shards` of them by dim), each once, and write them below `root`."""

    def build(t: pa.Table) -> pa.Table:
        dim, k = t.column("dim")[0].as_py(), t.column("shard")[0].as_py()
        order = np.argsort(np.asarray(t.column("id")), kind="stable")
        made = Shard(_matrix(t)[order])
        _save(f"{root}/shard-{dim}-{k}", ids=np.asarray(t.column("id"))[order], **made.arrays())
        return pa.table({"n": pa.array([t.num_rows], pa.int64())})

    many = F.coalesce(*(F.when(F.col("dim") == d, F.lit(n)) for d, n in shards.items()))
    # By place and not by value, so that a vector with many rows doesn't fill a shard.
    dealt = usable.withColumn("shard", (F.monotonically_increasing_id() % many).cast("int"))
    dealt.groupBy("dim", "shard").applyInArrow(build, "n bigint").agg(F.sum("n")).collect()


def write_queries(asked: DataFrame, root: str, blocks: dict[int, int]) -> None:
    """Write the distinct rows of `asked` (id, v, dim) below `root` in `blocks` blocks by dim."""

    def build(t: pa.Table) -> pa.Table:
        dim, k = t.column("dim")[0].as_py(), t.column("block")[0].as_py()
        _save(f"{root}/block-{dim}-{k}", ids=np.asarray(t.column("id")), names=np.asarray(t.column("query")), vectors=_matrix(t))
        return pa.table({"n": pa.array([t.num_rows], pa.int64())})

    many = F.coalesce(*(F.when(F.col("dim") == d, F.lit(n)) for d, n in blocks.items()))
    dealt = asked.distinct().withColumn("query", F.xxhash64("v")).withColumn("block", F.pmod(F.xxhash64("v", "id"), many).cast("int"))
    dealt.groupBy("dim", "block").applyInArrow(build, "n bigint").agg(F.sum("n")).collect()


def nearest(vectors: DataFrame, every: int = 20, k: int = K, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by `every`, its `k` nearest among all others."""
    spark, e = vectors.sparkSession, F.col("embedding")
    whole = F.forall(e, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf"))) & ~F.isnan(x))
    usable = vectors.select("vec_id", "embedding").filter(F.col("vec_id").isNotNull() & e.isNotNull() & whole & F.exists(e, lambda x: x != 0))
    usable = usable.select(F.col("vec_id").cast("long").alias("id"), e.alias("v"), F.size("embedding").alias("dim"))
    asked = usable.filter(F.col("id") % every == 0)
    # A row for each length of vectors.
    sizes = usable.groupBy("dim").agg(F.count("*").alias("n"), F.count_if(F.col("id") % every == 0).alias("q")).filter("q > 0").collect()
    schema = "query bigint, query_id bigint, vec_id bigint, score double"
    if not sizes:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    shards, blocks = {r.dim: -(-r.n // shard) for r in sizes}, {r.dim: -(-r.q // block) for r in sizes}
    root = shared_path(spark, "vectors")
    fs, path = pafs.FileSystem.from_uri(root)
    fs.create_dir(path, recursive=True)
    usable = usable.filter(F.col("dim").isin(list(shards)))
    write_index(usable, root, shards)
    write_queries(asked, root, blocks)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Takes pairs (dim, block, shard); shards of one block follow one another."""
        of, best, names = None, None, None

        def result() -> pa.RecordBatch:
            n = [len(x) for x in best.ids]
            cols = [np.repeat(names, n), np.repeat(best.query_ids, n), np.concatenate(best.ids), np.concatenate(best.scores)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["query", "query_id", "vec_id", "score"])

        for batch in batches:
            for dim, b, at in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (dim, b) != of:
                    if best is not None:
                        yield result()
                    asked = _load(f"{root}/block-{dim}-{b}") if fs_has(f"{root}/block-{dim}-{b}") else None
                    of, best = (dim, b), None
                    if asked is not None:
                        best, names = Best(asked["vectors"], asked["ids"], k), asked["names"]
                if best is not None and fs_has(f"{root}/shard-{dim}-{at}"):
                    got = _load(f"{root}/shard-{dim}-{at}")
                    ids = got.pop("ids")
                    best.see(Shard.of(**got), ids)
        if best is not None:
            yield result()

    def fs_has(uri: str) -> bool:
        """A block or shard to which no row was dealt has no file."""
        where, at = pafs.FileSystem.from_uri(uri)
        return where.get_file_info(at).type == pafs.FileType.File

    pairs = None
    for dim in shards:
        n, m = blocks[dim] * shards[dim], shards[dim]
        each = max(1, min(8, n // (4 * spark.sparkContext.defaultParallelism)))  # pairs of a task
        one = spark.range(0, n, 1, -(-n // each)).select(F.lit(dim).alias("dim"), F.floor(F.col("id") / m).cast("int").alias("block"), (F.col("id") % m).cast("int").alias("shard"))
        pairs = one if pairs is None else pairs.union(one)
    order = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    ranked = pairs.mapInArrow(search, schema).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
