"""Token-id files: ids compressed document by document with one shared zstandard dictionary.

A shard file is: MAGIC, the SHA-256 of the dictionary, the id width in bytes, one zstandard frame for each document in
ascending doc_id order, then the offset index (one record a document) and a footer with the place and size of the index.
A reader opens one document by its index record alone, and refuses a dictionary whose hash differs.

Null texts are empty; rows with a null doc_id come first; equal doc_ids are ordered by text. An empty table gives files
without documents and an empty result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm import common, tokens

MAGIC = b"TWIDS001"
INDEX = np.dtype([("doc_id", "<i8"), ("has_id", "u1"), ("offset", "<u8"), ("size", "<u4"), ("n_tokens", "<u4")])
FOOTER = "<QQ"
#: Documents whose ids the dictionary is trained on (those with the lowest hash among those with texts of at most
#: SAMPLE_BYTES bytes, as it is for short documents), and the dictionary's size.
SAMPLE, SAMPLE_BYTES, DICT_BYTES = 500, 64 << 10, 64 << 10
#: Documents, and bytes of their frames, that a reader takes in one read.
TAKE, TAKE_BYTES = 10_000, 8 << 20


@dataclass(frozen=True)
class Spec:
    """What writers and readers need. The dictionary is at most DICT_BYTES, so it travels with the tasks."""

    tokenizer: str
    end_id: int
    width: int
    dictionary: bytes
    level: int = 3

    @property
    def digest(self) -> bytes:
        return hashlib.sha256(self.dictionary).digest()

    @property
    def dtype(self) -> str:
        return f"<u{self.width}"


def open_fs(uri: str):
    """A pyarrow file system and the path in it."""
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "file:///" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def train(docs: DataFrame, tokenizer: str, end_id: int, sample: int = SAMPLE) -> Spec:
    """A dictionary from a bounded sample: at most `sample` rows of at most SAMPLE_BYTES bytes reach the driver."""
    import zstandard

    enc = tokens.encoder(tokenizer)
    width = 2 if max(len(enc.opens), end_id + 1) <= 1 << 16 else 4
    short = docs.where(F.octet_length("text") <= SAMPLE_BYTES).where("doc_id is not null").select("doc_id", "text")
    rows = common.lowest(short, sample, "doc_id", "text").collect()
    rows = sorted(rows, key=lambda r: (r["doc_id"], r["text"] or ""))
    ids = [np.frombuffer(x, "<u4").astype(f"<u{width}").tobytes() for x in enc.ids([r["text"] or "" for r in rows])]
    try:
        made = zstandard.train_dictionary(DICT_BYTES, [x for x in ids if x]).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few samples to train on
        made = b""
    return Spec(tokenizer, end_id, width, made)


def _codec(spec: Spec):
    import zstandard

    held = {"dict_data": zstandard.ZstdCompressionDict(spec.dictionary)} if spec.dictionary else {}
    return zstandard.ZstdCompressor(level=spec.level, write_content_size=True, **held), zstandard.ZstdDecompressor(**held)


def _write(spec: Spec, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        compressor, _ = _codec(spec)
        enc, end = tokens.encoder(spec.tokenizer), np.array([spec.end_id], "<u4").tobytes()
        fs, top = open_fs(folder)
        name = f"{top}/shard-{context.partitionId():06d}.ids"
        scratch = f"{name}.{context.taskAttemptId()}"
        index, at = [], len(MAGIC) + 33
        try:
            with fs.open_output_stream(scratch) as out:
                out.write(MAGIC + spec.digest + bytes([spec.width]))
                for batch in batches:
                    keys = batch.column(0).to_pylist()
                    for key, ids in zip(keys, enc.ids(common.texts_of(batch.column(1))), strict=True):
                        arr = np.frombuffer(ids + end, "<u4")
                        frame = compressor.compress(arr.astype(spec.dtype).tobytes())
                        out.write(frame)
                        index.append((key or 0, key is not None, at, len(frame), len(arr)))
                        at += len(frame)
                table = np.array(index, INDEX)
                out.write(table.tobytes() + struct.pack(FOOTER, at, len(table)))
        except BaseException:
            fs.delete_file(scratch)
            raise
        fs.move(scratch, name)  # a task that runs twice writes the same file
        yield pa.RecordBatch.from_pydict(
            {"shard": pa.array([context.partitionId()], pa.int32()), "docs": [len(table)], "n_tokens": [int(table["n_tokens"].sum())]}
        )

    return run


class ShardReader:
    """Random access to one shard file."""

    def __init__(self, uri: str, spec: Spec) -> None:
        fs, path = open_fs(uri)
        self.file, self.spec = fs.open_input_file(path), spec
        head = self.file.read_at(len(MAGIC) + 33, 0)
        if head[: len(MAGIC)] != MAGIC:
            raise ValueError(f"{uri} is not a token-id file")
        if head[len(MAGIC) : -1] != spec.digest:
            raise ValueError(f"{uri} was written with another dictionary")
        self.dtype = f"<u{head[-1]}"
        at, n = struct.unpack(FOOTER, self.file.read_at(16, self.file.size() - 16))
        self.index = np.frombuffer(self.file.read_at(n * INDEX.itemsize, at), INDEX)
        _, self.decompressor = _codec(spec)

    def ids(self, k: int) -> np.ndarray:
        """Of the k-th document, with the end id."""
        x = self.index[k]
        return np.frombuffer(self.decompressor.decompress(self.file.read_at(int(x["size"]), int(x["offset"]))), self.dtype).astype("<u4")

    def spans(self) -> Iterator[tuple[int, list[np.ndarray]]]:
        """All documents in order, many in a read: (the first one's number, ids of each)."""
        ends = (self.index["offset"] + self.index["size"]).astype(np.int64)
        a = 0
        while a < len(self.index):
            first = int(self.index["offset"][a])
            b = max(a + 1, min(a + TAKE, int(np.searchsorted(ends, first + TAKE_BYTES, side="right"))))
            data = memoryview(self.file.read_at(int(ends[b - 1]) - first, first))
            own = self.index[a:b]
            at = (own["offset"].astype(np.int64) - first).tolist()
            yield a, [np.frombuffer(self.decompressor.decompress(data[x : x + n]), self.dtype).astype("<u4") for x, n in zip(at, own["size"].tolist(), strict=True)]
            a = b

    def close(self) -> None:
        self.file.close()


def _read(spec: Spec, folder: str, shards: list[tuple[int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                shard, start = shards[k]
                reader = ShardReader(f"{folder}/shard-{shard:06d}.ids", spec)
                sizes = reader.index["n_tokens"].astype(np.int64)
                starts = start + np.concatenate([[0], np.cumsum(sizes)])[:-1]
                for a, got in reader.spans():
                    part = reader.index[a : a + len(got)]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array(part["doc_id"].copy(), pa.int64(), mask=part["has_id"] == 0),
                            "start": pa.array(starts[a : a + len(got)].astype(np.int64)),
                            "n_tokens": pa.array([len(x) for x in got], pa.int64()),
                            "ids_crc32": pa.array([zlib.crc32(x.tobytes()) for x in got], pa.int64()),
                        }
                    )
                reader.close()

    return run


def write_files(docs: DataFrame, folder: str, *, tokenizer: str | None = None, end_id: int = 2, shards: int | None = None) -> tuple[Spec, list[tuple[int, int]]]:
    """Encode every whole text, write the shard files and the dictionary; return the spec and (shard, first position)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spark = docs.sparkSession
    spec = train(docs, tokenizer or tokens.default_path(), end_id)
    fs, top = open_fs(folder)
    fs.create_dir(top, recursive=True)
    with fs.open_output_stream(f"{top}/dictionary.zdict") as out:
        out.write(spec.dictionary)
    laid = docs.repartitionByRange(shards or common.partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    rows = sorted(tuple(r) for r in laid.mapInArrow(_write(spec, folder), "shard int, docs long, n_tokens long").collect())  # one row a file
    starts = np.concatenate([[0], np.cumsum([r[2] for r in rows], dtype=np.int64)]).tolist()
    return spec, [(r[0], s) for r, s in zip(rows, starts, strict=False)]


def read_files(spark, folder: str, spec: Spec, shards: list[tuple[int, int]]) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    n = max(1, len(shards))
    return spark.range(0, len(shards), 1, n).mapInArrow(_read(spec, folder, shards), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_token_files(spark, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    folder = common.fresh_path(spark, "token-files")
    spec, shards = write_files(docs, folder)
    return read_files(spark, folder, spec, shards)
