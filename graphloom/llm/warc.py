"""Content-addressed WARC archive.

`payloads` holds every payload once under its SHA-256; `headers` holds one row for each record with the record's exact
header bytes. A record is header bytes + block + CRLF CRLF; the block of a response is its payload, a revisit has
none. `read_archive` joins the two tables again and verifies every digest.

Nulls: null html is an empty payload; a null page_id is written and never is the smallest; a null url has no
WARC-Target-URI line. Repeated rows write one record each, with ids of their own. An empty table gives an empty archive.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import discard, in_arrow, materialize, shared_path

DATE, LEAST = "1970-01-01T00:00:00Z", 100


def _records(pages: DataFrame) -> DataFrame:
    bytes_ = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    return pages.select("page_id", "url", bytes_.alias("payload")).withColumn("digest", F.sha2("payload", 256))


def _record_id(*parts):
    h = F.md5(F.concat_ws("|", *parts))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _line(name: str, value):
    """A header line; none where the value is null. Line breaks in a value are percent-encoded."""
    clean = F.regexp_replace(F.regexp_replace(value.cast("string"), "\r", "%0D"), "\n", "%0A")
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), clean, F.lit("\r\n"))).otherwise(F.lit(""))


def write_archive(pages: DataFrame, root: str, date: str = DATE, least: int = LEAST) -> str:
    """Write `pages` below `root` as the tables headers and payloads; returns `root`."""
    records = _records(pages)
    light = records.select("page_id", "url", "digest", F.octet_length("payload").cast("long").alias("bytes"), F.xxhash64("payload").alias("h"), F.monotonically_increasing_id().alias("row"))
    light = materialize(light, "light")  # so that `row` tells rows apart, equal ones too
    # Two payloads of one digest must be one payload: a second, unrelated hash is compared.
    place = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row")
    groups = light.groupBy("digest").agg(F.min(place).alias("first"), F.min("h").alias("h0"), F.max("h").alias("h1"))
    first = F.when(F.col("h0") != F.col("h1"), F.raise_error(F.lit("two payloads share a SHA-256")).cast("bigint")).otherwise(F.col("first.page_id").cast("long"))
    typed = light.join(groups.select("digest", first.alias("first"), F.col("first.row").alias("first_row")), "digest").withColumn(
        "again", (F.col("bytes") >= least) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    )
    kind = F.when(F.col("again"), "revisit").otherwise("response")
    # Each record has an id of its own; that of a group's first can be told from page and digest, for those that refer to it.
    own = F.concat_ws("/", F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.when(F.col("row") != F.col("first_row"), F.col("row").cast("string")))
    head = F.concat(
        F.lit("WARC/1.1\r\n"), _line("WARC-Type", kind), _line("WARC-Record-ID", _record_id(own, F.col("digest"))), _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.col("url")), _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(F.col("again"), F.concat(_line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), _line("WARC-Refers-To", _record_id(F.col("first").cast("string"), F.col("digest"))), _line("X-Refers-To-Page", F.col("first")))).otherwise(F.lit("")),
        _line("X-Page", F.col("page_id")), _line("Content-Type", F.lit("text/html; charset=utf-8")), _line("X-Payload-Length", F.col("bytes")),
        _line("Content-Length", F.when(F.col("again"), F.lit(0).cast("long")).otherwise(F.col("bytes"))), F.lit("\r\n"),
    )
    typed.select("page_id", "digest", head.cast("binary").alias("header")).write.parquet(f"{root}/headers")
    records.select("digest", "payload").dropDuplicates(["digest"]).write.parquet(f"{root}/payloads")  # repeats go before the shuffle
    discard(light)
    return root


def read_archive(spark: SparkSession, root: str) -> DataFrame:
    """One row for each record: page_id, record (its exact bytes), header text, payload; digests are verified."""
    headers, payloads = spark.read.parquet(f"{root}/headers"), spark.read.parquet(f"{root}/payloads")
    met = headers.join(payloads, "digest", "left").withColumn("head", F.col("header").cast("string"))
    good = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(F.raise_error(F.lit("a payload is missing or doesn't have its digest")).cast("binary"))
    met = met.withColumn("payload", good)
    block = F.when(_field("WARC-Type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return met.select("page_id", "head", "payload", F.concat("header", block, F.lit(b"\r\n\r\n")).alias("record"))


def _field(name: str):
    found = F.regexp_extract(F.col("head"), rf"(?dm)^{name}: (.*?)\r$", 1)
    return F.when(found != "", found)


def parsed(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to, as the bytes of each `record` say; its length is verified."""
    head = F.concat(F.split(F.col("record").cast("string"), "\r\n\r\n", 2)[0], F.lit("\r\n"))
    told = records.select("record", head.alias("head"))
    block = F.octet_length("record") - F.octet_length("head") - 6
    whole = F.when(block == _field("Content-Length").cast("long"), _field("X-Payload-Length").cast("long")).otherwise(F.raise_error(F.lit("a record doesn't have its length")).cast("bigint"))
    return told.select(
        _field("X-Page").cast("long").alias("page_id"), whole.alias("payload_bytes"), F.regexp_replace(_field("WARC-Payload-Digest"), "^sha256:", "").alias("payload_digest"),
        _field("WARC-Type").alias("record_type"), _field("X-Refers-To-Page").cast("long").alias("refers_to"),
    )


def write_warc(records: DataFrame, root: str, most: int = 1 << 30) -> DataFrame:
    """Write the `record` bytes as .warc files of about `most` bytes below `root`; returns (file, records, bytes). A task's files have its number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, task, at = None, TaskContext.get().partitionId(), 0

        def close() -> pa.RecordBatch:
            out[0].close()
            fs.move(out[1], out[2])
            return pa.RecordBatch.from_arrays([pa.array([out[2].rsplit("/", 1)[-1]]), pa.array([out[3]], pa.int64()), pa.array([out[4]], pa.int64())], names=["file", "records", "bytes"])

        for batch in batches:
            for record in batch.column(0):
                if out is None:
                    name = f"{path}/part-{task:06d}-{at:04d}.warc"
                    part = f"{name}.{uuid.uuid4().hex}.part"
                    out, at = [fs.open_output_stream(part), part, name, 0, 0], at + 1
                data = record.as_py()
                out[0].write(data)
                out[3] += 1
                out[4] += len(data)
                if out[4] >= most:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    fs, path = pafs.FileSystem.from_uri(root)
    fs.create_dir(path, recursive=True)
    return materialize(in_arrow(records.select("record"), run, "file string, records bigint, bytes bigint"), "warc-files")


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write `pages`, read them back, and return what the reconstructed records say of each page."""
    spark = pages.sparkSession
    return parsed(read_archive(spark, write_archive(pages, shared_path(spark, "warc"))))
