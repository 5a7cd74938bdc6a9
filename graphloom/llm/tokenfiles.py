"""Token-id files with frequency-ranked ids in a byte-aligned variable-length code with separate control bytes.

An id is replaced by its rank by frequency over the whole corpus (0: the commonest), so common ids take one byte. Two
control bits give a rank's length less one; four ranks share a control byte, and control and data bytes lie apart.
Decoding looks the control bytes up in tables of lengths and gathers the data with numpy.

A file: header MAGIC, documents (u32), ids (u64), control bytes (u64), data bytes (u64); per document a flag byte (1:
the doc_id is null), doc_id (i64) and length (u64); control bytes; data bytes; CRC-32 of all that (u32); all little-endian.
The file `ranks.bin` has the ids in the order of their ranks (u32). Files are named in ascending doc_id order:
a bucket of neighbouring doc_ids makes one file, or several where it has more than FILE_IDS ids.

Nulls: a null text is empty (its end id only); null doc_ids come first. Documents that repeat a doc_id lie side by
side in the order of their ids' checksum. An empty table writes no data files and reads back no rows.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from graphloom.llm.chunks import Memo, byte_level, encode_batch, id_bytes, marked, plain_word, special_strings, splitter
from graphloom.llm.common import discard, in_arrow, materialize, ordered_buckets, shared_path, small_batches, texts_of

MAGIC, HEAD, FILE_IDS = b"GLTOKEN1", struct.Struct("<8sIQQQ"), 4_000_000
#: The split pattern of byte-level tokenizers with use_regex.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_CODE = np.arange(256, dtype=np.uint16)
#: For each control byte the lengths of its four ranks.
LENGTHS = np.stack([(_CODE >> (2 * k) & 3) + 1 for k in range(4)], axis=1).astype(np.uint8)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes."""
    ranks = ranks.astype("<u4")
    n = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    four = np.zeros((len(n) + 3) // 4 * 4, dtype=np.uint8)
    four[: len(n)] = n
    four = four.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4, dtype=np.uint8) <= n[:, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    out = np.zeros((n, 4), dtype=np.uint8)
    out[np.arange(4, dtype=np.uint8) < lengths[:, None]] = np.frombuffer(data, np.uint8)
    return out.view("<u4").reshape(-1)


class Encoder:
    """The ids of whole texts by a byte-level tokenizers file.

    A special token's string in a text gives its id, as the library does it, or is ordinary text where `plain` is set.
    """

    def __init__(self, path: str, plain: bool = False):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.special = [] if plain else special_strings(self.tokenizer)
        self.pattern = splitter(PATTERN)
        self.model = self.tokenizer.model
        self.code = id_bytes(self.tokenizer.get_vocab_size())
        self.memo = Memo(self._encode)

    def _encode(self, pieces: list[str]) -> list[bytes]:
        """Plain words with the space before them go to the library's model directly: it cuts them nowhere else."""
        out, model, whole, code, put = [], self.model.tokenize, self.tokenizer.encode, self.code, b"".join
        for x in pieces:
            word = x[1:] if x[:1] == " " else x
            if word.isalpha() and word.isascii():
                got = model(x if word is x else "\u0120" + word)  # U+0120 stands for a space
            elif plain_word(word):
                got = model(byte_level(x))
            else:
                out.append(put([code[i] for i in whole(x, add_special_tokens=False).ids]))
                continue
            out.append(code[got[0].id] if len(got) == 1 else put([code[t.id] for t in got]))
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each has."""
        return encode_batch(texts, self._mark, self.memo)

    def _mark(self, text: str, sep: str) -> str:
        return text if any(s in text for s in self.special) else marked(text, self.pattern, sep)


def encode(docs: DataFrame, tokenizer: str, end: int) -> DataFrame:
    """doc_id, bucket, ids (the end id last; in two little-endian bytes each where the vocabulary allows, else four)."""
    kind = id_type(tokenizer, end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, last = Encoder(tokenizer), np.array([end], kind).tobytes()
        for batch in small_batches(batches, 1):
            all_, lengths = encoder.encode(texts_of(batch, 1))
            all_ = all_.astype(kind)
            ids = pa.array([all_[b - n : b].tobytes() + last for b, n in zip(np.cumsum(lengths), lengths)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), ids], names=["doc_id", "bucket", "ids"])

    return in_arrow(docs.select("doc_id", "text", "bucket"), run, "doc_id bigint, bucket bigint, ids binary")


def id_type(tokenizer: str, end: int) -> str:
    return "<u2" if max(Tokenizer.from_file(tokenizer).get_vocab_size() - 1, end) < 1 << 16 else "<u4"


def id_counts(encoded: DataFrame, kind: str) -> DataFrame:
    """(id, n) over all documents: each task counts what it reads, then the counts are summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for some in batches_of(batch.column(0).to_pylist()):
                c = np.bincount(np.frombuffer(some, kind))
                if len(c) > len(total):
                    total = np.concatenate([total, np.zeros(len(c) - len(total), np.int64)])
                total[: len(c)] += c
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(total[at])], names=["id", "n"])

    return in_arrow(encoded.select("ids"), run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


def batches_of(rows: list[bytes], most: int = 1 << 22) -> Iterator[bytes]:
    """Rows joined to about `most` bytes."""
    held, size = [], 0
    for x in rows:
        held.append(x)
        size += len(x)
        if size >= most:
            yield b"".join(held)
            held, size = [], 0
    yield b"".join(held)


def _put(uri: str, content: bytes) -> None:
    fs, path = pafs.FileSystem.from_uri(uri)
    own = f"{path}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(own) as f:
        f.write(content)
    fs.move(own, path)


def file_bytes(ids: list[int | None], lengths: list[int], control: bytes, data: bytes) -> bytes:
    body = HEAD.pack(MAGIC, len(ids), sum(lengths), len(control), len(data)) + np.array([x is None for x in ids], np.uint8).tobytes()
    body += np.array([x or 0 for x in ids], "<i8").tobytes() + np.array(lengths, "<u8").tobytes() + control + data
    return body + struct.pack("<I", zlib.crc32(body))


def parse_file(content: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, lengths, ranks."""
    magic, docs, n, c, d = HEAD.unpack_from(content)
    if magic != MAGIC or zlib.crc32(content[:-4]) != struct.unpack("<I", content[-4:])[0]:
        raise ValueError("not a token file, or a damaged one")
    at = HEAD.size
    none, at = np.frombuffer(content, np.uint8, docs, at), at + docs
    ids, at = np.frombuffer(content, "<i8", docs, at), at + 8 * docs
    lengths, at = np.frombuffer(content, "<u8", docs, at).astype(np.int64), at + 8 * docs
    ranks = unpack(content[at : at + c], content[at + c : at + c + d], n)
    return [None if x else int(i) for x, i in zip(none, ids)], lengths, ranks


def write_files(docs: DataFrame, root: str, tokenizer: str, end: int, file_ids: int = FILE_IDS) -> DataFrame:
    """Encode `docs` and write the files below `root`; returns the manifest (file, docs, ids, start)."""
    spark = docs.sparkSession
    kind = id_type(tokenizer, end)
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    encoded = materialize(encode(keyed.withColumn("bucket", ordered_buckets(keyed, "doc_id", "h")), tokenizer, end), "ids")
    counts = id_counts(encoded, kind).orderBy(F.desc("n"), "id").collect()  # a row for each id of the vocabulary at most
    by_rank = np.array([r.id for r in counts], dtype="<u4")
    rank_of = np.zeros(int(by_rank.max()) + 1 if len(by_rank) else 1, dtype=np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank))
    fs, path = pafs.FileSystem.from_uri(root)
    fs.create_dir(path, recursive=True)
    _put(f"{root}/ranks.bin", by_rank.tobytes())
    shared = spark.sparkContext.broadcast(rank_of)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held, size, of, at = shared.value, [], 0, None, 0

        def flush() -> pa.RecordBatch:
            ranks = table[np.frombuffer(b"".join([x[1] for x in held]), kind)]
            name = f"part-{of:012d}-{at:06d}.tok"
            _put(f"{root}/{name}", file_bytes([x[0] for x in held], [x[2] for x in held], *pack(ranks)))
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(held)], pa.int64()), pa.array([size], pa.int64())], names=["file", "docs", "ids"])

        width = np.dtype(kind).itemsize
        for batch in batches:
            for b, i, ids in zip(*(batch.column(k).to_pylist() for k in range(3))):
                n = len(ids) // width
                if held and (b != of or size + n > file_ids):
                    yield flush()
                    held, size, at = [], 0, at + 1 if b == of else 0
                of = b
                held.append((i, ids, n))
                size += n
        if held:
            yield flush()

    ordered = encoded.select("bucket", "doc_id", "ids").repartition("bucket").sortWithinPartitions("bucket", "doc_id", F.crc32("ids"), F.octet_length("ids"))
    files = in_arrow(ordered, write, "file string, docs bigint, ids bigint").collect()  # a row for each file: about sqrt(documents)
    discard(encoded)
    start, rows = 0, []
    for r in sorted(files, key=lambda r: r.file):
        rows.append((r.file, r.docs, r.ids, start))
        start += r.ids
    manifest = spark.createDataFrame(rows, "file string, docs bigint, ids bigint, start bigint")
    manifest.coalesce(1).write.parquet(f"{root}/manifest")
    return manifest


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files below `root`."""
    fs, path = pafs.FileSystem.from_uri(root)
    with fs.open_input_stream(f"{path}/ranks.bin") as f:
        by_rank = spark.sparkContext.broadcast(np.frombuffer(f.read(), "<u4"))
    manifest = spark.read.parquet(f"{root}/manifest")
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    if not manifest.take(1):
        return spark.createDataFrame([], schema)
    named = F.element_at(F.split("path", "/"), -1)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tok").load(root).select(named.alias("file"), "content")
    # The manifest has a row of a few dozen bytes for each file.
    files = files.join(F.broadcast(manifest.select("file", "start")), "file").select("start", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = by_rank.value
        for batch in batches:
            for start, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids, lengths, ranks = parse_file(content.as_py())
                tokens = table[ranks]
                ends = np.cumsum(lengths)
                crcs = [zlib.crc32(tokens[e - n : e].tobytes()) for e, n in zip(ends, lengths)]
                arrays = [pa.array(ids, pa.int64()), pa.array(start + ends - lengths), pa.array(lengths), pa.array(crcs, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return in_arrow(files, run, schema)


def file_round_trip(docs: DataFrame, tokenizer: str, end: int) -> DataFrame:
    root = shared_path(docs.sparkSession, "tokens")
    write_files(docs, root, tokenizer, end)
    return read_files(docs.sparkSession, root)
