"""Helpers that the operators share: tables, the shared folder, written intermediates, components."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.written import drop, shared_root

#: Bytes of an Arrow batch and of a row group of what is written: a few of each are in memory at a time in every task.
BATCH, ROW_GROUP = 8 << 20, 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/graphloom/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: a lineage cut that survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._graphloom_path = path  # for discard()
    return back


def discard(df: DataFrame) -> None:
    """Delete what materialize() wrote, once nothing reads it any more."""
    drop(df.sparkSession, df._graphloom_path)


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow with batches of about BATCH bytes: rows are texts, so that a number of rows bounds nothing.

    The setting is one of the session, and stays: plans are run after they are made. A lower one is left alone.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    held = conf.get(name).rstrip("bB")
    if not held.isdigit() or not 0 < int(held) <= BATCH:
        conf.set(name, str(BATCH))
    return df.mapInArrow(run, schema)


def rows_of(batch: pa.RecordBatch, column: int) -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def texts_of(batch: pa.RecordBatch, column: int) -> list[str]:
    return [x or "" for x in batch.column(column).to_pylist()]


def small_batches(batches: Iterator[pa.RecordBatch], column: int, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of at most `most` bytes in a string column (or of one row), so that long texts don't pile up in a worker."""
    for batch in batches:
        n = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            base = n[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(n, base + most, side="right")))
            yield batch.slice(at, end - at)
            at = end


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: tuple[int, int], max_chars: int) -> list:
    """At most `most[y]` labelled training rows of class y, chosen by a hash of their doc_id.

    Of a repeated doc_id one text is taken. Rows held out (crc32(doc_id) mod 3 = 1) and texts over `max_chars` are not learnt from. This is the bounded
    sample on which models are fitted; scoring covers whole texts of every length.
    """
    ids = labels.filter(F.col(label).isin(0, 1) & (F.crc32(F.col("doc_id").cast("string")) % 3 != 1))
    ids = ids.groupBy("doc_id").agg(F.max(label).alias("y"))
    picked = None
    for y in (0, 1):
        one = ids.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most[y])
        picked = one if picked is None else picked.unionByName(one)
    kept = docs.select("doc_id", "text").filter(F.col("text").isNotNull() & (F.length("text") <= max_chars))
    # One text, the least, of each of at most sum(most) ids, however many rows repeat an id.
    got = kept.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).collect()
    return sorted(got, key=lambda r: r.doc_id)


def held_out(column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 3 == 1, F.lit(False))


def ordered_buckets(df: DataFrame, column: str, spread: str, knots: int = 256) -> Column:
    """A bucket number for each row, ascending with `column` (an integer; nulls first), about sqrt(n) buckets in all.

    The knots are approximate quantiles. Rows at a knot (a value with many rows is one) and rows without a value have buckets
    of their own, as many as their number asks for, ascending with `spread` (a 64-bit hash); between knots buckets have equal widths.
    So no value fills a bucket, unless its rows have one hash, too.
    """
    got = df.agg(F.count("*").alias("n"), F.min(column).alias("first"), F.percentile_approx(column, [k / knots for k in range(knots + 1)], 10_000).alias("q")).first()
    at = sorted({int(x) for x in [got[1], *got.q]}) if got.q else [0]
    size = max(1, math.ceil(math.sqrt(got.n)))  # rows of a bucket, and number of buckets, aimed at
    each = max(1, math.ceil(size / len(at)) - 1)
    heavy = df.filter(F.col(column).isNull() | F.col(column).isin(at)).groupBy(F.col(column).cast("long").alias("x")).agg(F.count("*").alias("n"))
    many = {r.x: math.ceil(r.n / size) for r in heavy.collect()}  # a row for each knot at most
    parts = [many.get(None, 1), *(many.get(x, 1) for x in at)]
    bases, base = [], 0
    for k, n in enumerate(parts):
        bases.append(base)
        base += n + (each if k else 0)
    laid = lambda x: F.array(*map(F.lit, x))
    x = F.col(column)
    k = F.when(x.isNull(), F.lit(0)).otherwise(F.greatest(F.size(F.filter(laid(at), lambda b: b <= x)), F.lit(1)))
    low = F.element_at(laid(at), F.greatest(k, F.lit(1)))
    high = F.coalesce(F.get(laid(at), k), low + 1)
    inner = F.least(F.greatest(F.floor((x - low) / (high - low) * each), F.lit(0)), F.lit(each - 1))
    share = F.shiftrightunsigned(F.col(spread).bitwiseXOR(F.lit(-(1 << 63))), 33)
    own = F.shiftright(share * F.get(laid(parts), k), 31)
    return (F.get(laid(bases), k) + F.when(x.isNull() | (x == low), own).otherwise(F.get(laid(parts), k) + inner)).cast("long")


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node in `links`; root is the smallest node reachable.

    Minimum labels go over links, then labels jump to their label's label, until nothing changes. Every step is a
    join and an aggregate on written tables; no group is collected anywhere. An empty input gives an empty output.
    """
    ends = links.select(F.col(a).alias("src"), F.col(b).alias("dst"))
    both = materialize(ends.union(ends.select("dst", "src")).filter("src <> dst").distinct(), "links")
    labels = materialize(both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("m")).select("node", F.least("node", "m").alias("root")), "labels")
    while True:
        near = both.join(labels, both.dst == labels.node).groupBy("src").agg(F.min("root").alias("m"))
        step = labels.join(near, labels.node == near.src, "left").select("node", F.col("root").alias("was"), F.least("root", "m").alias("r"))
        step = materialize(step, "labels")
        up = step.select(F.col("node").alias("at"), F.col("r").alias("up"))
        jumped = step.join(up, step.r == up["at"], "left").select("node", "was", F.least("r", "up").alias("root"))
        after = materialize(jumped, "labels")
        changed = after.filter("root <> was").limit(1).count()
        discard(labels)
        discard(step)
        labels = after
        if not changed:
            discard(both)
            return labels.select("node", "root")
