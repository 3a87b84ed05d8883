"""Suffix-array deduplication: remove every byte covered by a string of `length` bytes that also starts anywhere else.

Routing. Each window of `length` bytes is given the least hash of its GRAM-byte grams; consecutive windows with the same
least hash form a slice. Equal windows have equal least hashes, so a window can repeat only in slices of the same hash, and
each window of a text lies in one slice. Slices whose hash occurs once, by a gram that stands there once, are done with.
Slices that are equal as a whole repeat in every byte. The other slices go to shards by hash.

Shards. A shard puts its slices on disk behind one another and sorts their suffixes by external induced sorting
(external_sa), whose tuples carry common prefixes capped at `length`; a run of suffixes that agree in `length` bytes is one
string, and repeats if it has two starts. A hash with over MAX_SLICES different slices would make one shard grow with the
input: its windows are counted by their digests in a distributed aggregation instead, which gives the same answer.

There are as many shards as shuffle partitions, or more, so that a shard has about SHARD_BYTES.

Texts are keyed by two 64-bit hashes. A null text is empty and keeps its zero bytes; texts shorter than `length` lose
nothing; repeated rows repeat each other's text; rows with a null doc_id are handled like others; an empty table gives no rows.
Only doc_id and text are read, whatever other columns are called.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm import common, external_sa

LENGTH, GRAM = 200, 32
#: Different slices of one hash that may go into a shard.
MAX_SLICES = 200_000
#: Bytes of slices in a shard, about.
SHARD_BYTES = 64 << 20
#: Bytes of a text that are hashed at a time.
PIECE = 1 << 21


def _mix(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def _grams(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes at each place, by doubling."""
    h = data.astype(np.uint64)
    h += np.uint64(1)
    base, width = 0x9E3779B97F4A7C15, 1
    while width < GRAM:
        h = h[:-width] * np.uint64(base) + h[width:]
        base, width = base * base % (1 << 64), width * 2
    return _mix(h)


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each width in a row, from prefix and suffix minima of blocks."""
    n = len(h)
    pad = -n % width
    blocks = np.concatenate([h, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def slices(data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first window, last window, whether the hash's gram stands in the text again) of each slice of a text."""
    found = []
    windows, width = len(data) - length + 1, length - GRAM + 1
    for a in range(0, windows, PIECE):
        grams = _grams(data[a : min(a + PIECE, windows) + length - 1])
        least = _least(grams, width)
        cuts = np.flatnonzero(np.diff(least)) + 1
        first = np.concatenate([[0], cuts])
        edge = np.zeros(width - 1, np.uint64)
        over = ~_least(~np.concatenate([edge, least, edge]), width)  # the most of the windows around each gram
        met, often = np.unique(grams[grams == over], return_counts=True)
        h = least[first]
        found.append((h, first + a, np.append(cuts, len(least)) - 1 + a, np.isin(h, met[often > 1])))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return tuple(map(np.concatenate, zip(*found, strict=True)))


def _data(batch: pa.RecordBatch, name: str) -> Iterator[np.ndarray]:
    """The UTF-8 bytes of each row of a column."""
    column = batch.column(name)
    if column.type in (pa.string(), pa.large_string()):
        column = column.cast(pa.large_string()).cast(pa.large_binary())
    column = column.fill_null(b"")
    for x in column:
        yield np.frombuffer(x.as_buffer(), np.uint8)


def _anchors(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            keys = [batch.column(c).to_pylist() for c in ("key", "key2")]
            out: list[list] = [[], [], [], [], [], [], []]
            for key, key2, data in zip(*keys, _data(batch, "text"), strict=True):
                h, a, b, again = slices(data, length)
                if len(h):
                    view = memoryview(data)
                    own = np.array([digest(view[x:y]) for x, y in zip(a.tolist(), (b + length).tolist(), strict=True)], np.uint64)
                    for column, x in zip(out, (np.full(len(h), key), np.full(len(h), key2), h.view(np.int64), own.view(np.int64), a, b, again), strict=True):
                        column.append(x)
            if out[0]:
                yield pa.RecordBatch.from_pydict({n: pa.array(np.concatenate(x)) for n, x in zip(("key", "key2", "h", "dg", "a", "b", "again"), out, strict=True)})

    return run


def _cut(length: int):
    """Rows of (text, slices that it stands for): the bytes of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            size = 0
            keys = [batch.column(c).to_pylist() for c in ("key", "key2")]
            for key, key2, data, wanted in zip(*keys, _data(batch, "text"), batch.column("wanted").to_pylist(), strict=True):
                for w in wanted:
                    out.append((w["h"], w["n"], key, key2, w["a"], data[w["a"] : w["b"] + length].tobytes()))
                    size += len(out[-1][-1])
                if size > 8 << 20:
                    yield _rows(out)
                    out, size = [], 0
            if out:
                yield _rows(out)

    return run


def _rows(out: list[tuple]) -> pa.RecordBatch:
    names = ("h", "n", "key", "key2", "a", "data")
    return pa.RecordBatch.from_pydict({c: pa.array(x, pa.binary() if c == "data" else pa.int64()) for c, x in zip(names, zip(*out, strict=True), strict=True)})


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return edges[::2], edges[1::2]


def _shard(length: int):
    """One shard a partition: intervals (key, key2, a, b) of the texts whose windows repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = tempfile.mkdtemp(prefix="suffixes-")  # scratch of this task alone, like a spill
        try:
            yield from _search(batches, length, folder)
        finally:
            shutil.rmtree(folder, ignore_errors=True)

    return run


def _search(batches: Iterator[pa.RecordBatch], length: int, folder: str) -> Iterator[pa.RecordBatch]:
    keys, seconds, firsts, counts, sizes = [], [], [], [], []
    with open(f"{folder}/text", "wb") as f:
        for batch in batches:
            for data in _data(batch, "data"):
                f.write((data.astype("<u2") + 2).tobytes() + b"\x01\x00")
                sizes.append(len(data))
            for column, name in ((keys, "key"), (seconds, "key2"), (firsts, "a"), (counts, "n")):
                column.append(batch.column(name).to_numpy())
        f.write(b"\x00\x00")
    if not sizes:
        return
    keys, seconds, firsts, counts = map(np.concatenate, (keys, seconds, firsts, counts))
    text = np.memmap(f"{folder}/text", "<u2", "r")
    ends = np.cumsum(np.array(sizes, np.int64) + 1) - 1  # the place of each separator
    starts = ends - sizes
    rows = external_sa.scratch(folder, "rows", np.uint32, len(text))  # the slice at each place
    for k in range(0, len(ends), 1 << 14):
        own = np.array(sizes[k : k + (1 << 14)]) + 1
        rows[starts[k] : starts[k] + own.sum()] = np.repeat(np.arange(k, k + len(own), dtype=np.uint32), own)
    hit = external_sa.scratch(folder, "hit", np.uint8, len(text))
    alone, total = -1, 0  # of the run of suffixes that may go on: its only window, and how often it occurs so far
    for entries in external_sa.suffixes(text, 258, length, folder):
        row = rows[entries["pos"]]
        own = ends[row] - entries["pos"] >= length
        cuts = entries["lcp"] < length
        pos, weight, group = entries["pos"][own], counts[row[own]], np.cumsum(cuts)[own]
        if len(pos):
            edge = np.flatnonzero(np.diff(group, prepend=-1))
            totals = np.add.reduceat(weight, edge)
            if group[0] == 0:  # goes on from the block before
                totals[0] += total
                if totals[0] > 1 and alone >= 0:
                    hit[alone] = 1
            hit[pos[np.repeat(totals > 1, np.diff([*edge, len(pos)]))]] = 1
            total = int(totals[-1])
            alone = int(pos[-1]) if total == 1 else -1
            cuts = cuts[np.flatnonzero(own)[-1] + 1 :]
        if cuts.any():
            alone, total = -1, 0
    out: list[tuple] = []
    for k in np.flatnonzero(counts == 1).tolist():  # the others repeat as a whole
        own = np.asarray(hit[starts[k] : ends[k] - length + 1])
        if own.any():
            a, b = _runs(own > 0)
            out += zip([int(keys[k])] * len(a), [int(seconds[k])] * len(a), (a + firsts[k]).tolist(), (b - 1 + length + firsts[k]).tolist(), strict=True)
    if out:
        yield pa.RecordBatch.from_pydict({n: pa.array(x, pa.int64()) for n, x in zip(("key", "key2", "a", "b"), zip(*out, strict=True), strict=True)})


def _windows(length: int):
    """Of slices whose hash has too many: each window's digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh3_128_digest
        for batch in batches:
            for key, key2, a, n, data in zip(*(batch.column(c).to_pylist() for c in ("key", "key2", "a", "n", "data")), strict=True):
                at = range(len(data) - length + 1)
                yield pa.RecordBatch.from_pydict(
                    {"window": [digest(data[i : i + length]) for i in at], "key": pa.array([key] * len(at)), "key2": pa.array([key2] * len(at)), "a": pa.array([a + i for i in at]), "n": pa.array([n] * len(at))}
                )

    return run


def _remove():
    """Rows of documents with the intervals of their text: what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for data, spans in zip(_data(batch, "text"), batch.column("spans").to_pylist(), strict=True):
                kept, removed, at = hashlib.sha256(), [], 0
                for s in sorted((s["a"], s["b"]) for s in spans or ()):
                    if removed and s[0] <= removed[-1][1]:
                        removed[-1][1] = max(removed[-1][1], s[1])
                    else:
                        removed.append([*s])
                for a, b in removed:
                    kept.update(data[at:a])
                    at = b
                kept.update(data[at:])
                out.append((len(data), sum(b - a for a, b in removed), len(removed), kept.hexdigest(), removed))
            n, gone, spans, sha, removed = zip(*out, strict=True) if out else ((),) * 5
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "n_bytes": pa.array(n, pa.int64()),
                    "n_removed": pa.array(gone, pa.int64()),
                    "n_spans": pa.array(spans, pa.int64()),
                    "kept_sha256": pa.array(sha, pa.string()),
                    "removed": pa.array(removed, pa.list_(pa.list_(pa.int64()))),
                }
            )

    return run


def repeated_spans(docs: DataFrame, *, length: int = LENGTH, max_slices: int = MAX_SLICES) -> DataFrame:
    """Rows: doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed (start and end of each maximal run, in bytes)."""
    text, keys = F.coalesce(F.col("text"), F.lit("")), ["key", "key2"]
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text, F.octet_length(text)).alias("key"), F.xxhash64(F.lit(1), text).alias("key2"))
    all_slices, path = common.saved_at(keyed.select(*keys, "text").mapInArrow(_anchors(length), "key long, key2 long, h long, dg long, a long, b long, again boolean"), "slices")
    # what is joined by h or by text is a table on both sides, so that adaptive execution can split a hot one
    often = all_slices.groupBy("h").agg(F.count("*").alias("c"), F.max("again").alias("again")).where("c > 1 or again").select("h")
    shared = all_slices.join(common.saved(often, "often"), "h").groupBy("h", "dg", *keys, "a", "b", "again").agg(F.count("*").alias("c"))
    shared = common.saved(shared, "shared-slices")
    common.drop_table(docs.sparkSession, path)
    # one row a different slice, with one place where it stands
    kinds = shared.groupBy("h", "dg").agg(F.sum("c").alias("n"), F.min(F.struct(*keys, "a", "b")).alias("at"), F.max("again").alias("again"))
    kinds = common.saved(kinds, "slice-kinds")
    mixed = kinds.groupBy("h").agg(F.count("*").alias("kinds"), F.max("again").alias("again"), F.min("n").alias("least"))
    mixed = common.saved(mixed.where("least = 1 and (kinds > 1 or again)").select("h", "kinds"), "mixed")  # kinds that occur twice are settled
    whole = kinds.where("n > 1").select(F.col("h").alias("_h"), F.col("dg").alias("_dg"))
    same = shared.join(whole, (F.col("h") == F.col("_h")) & (F.col("dg") == F.col("_dg"))).select(*keys, "a", (F.col("b") + length).alias("b"))
    wanted = common.saved(kinds.join(mixed, "h").select("h", "n", "kinds", "at.*"), "wanted")
    size = wanted.agg(F.sum(F.col("b") - F.col("a") + length)).first()[0] or 0
    wanted = wanted.groupBy(*keys).agg(F.collect_list(F.struct("h", "n", "a", "b")).alias("wanted"))
    one = common.saved(keyed.groupBy(*keys).agg(F.min("doc_id").alias("doc_id")).join(wanted, keys), "asked-texts")
    one = one.select(F.col("key").alias("_key"), F.col("key2").alias("_key2"), F.col("doc_id").alias("_doc_id"), "wanted")
    on = (F.col("key") == F.col("_key")) & (F.col("key2") == F.col("_key2"))
    source = keyed.join(one, on & F.col("doc_id").eqNullSafe(F.col("_doc_id"))).select(*keys, "text", "wanted")
    cut = source.mapInArrow(_cut(length), "h long, n long, key long, key2 long, a long, data binary")
    hot = mixed.where(F.col("kinds") > max_slices).select("h")
    found = []
    if not hot.isEmpty():
        cut = common.saved(cut, "slice-data")
        crowd = cut.join(hot, "h", "left_semi").dropDuplicates([*keys, "a"]).mapInArrow(_windows(length), "window binary, key long, key2 long, a long, n long")
        crowd = common.saved(crowd, "windows")
        again = crowd.groupBy("window").agg(F.sum("n").alias("total")).where("total > 1").select("window")
        found.append(crowd.join(again, "window").select(*keys, "a", (F.col("a") + length).alias("b")))
        cut = cut.join(hot, "h", "left_anti")
    shards = cut.repartition(max(common.partitions(docs.sparkSession), -(-size // SHARD_BYTES)), "h")
    found += [shards.mapInArrow(_shard(length), "key long, key2 long, a long, b long"), same]
    spans = found[0]
    for x in found[1:]:
        spans = spans.union(x)
    spans = common.saved(spans.groupBy(*keys).agg(F.collect_list(F.struct("a", "b")).alias("spans")), "spans").withColumnsRenamed({"key": "_key", "key2": "_key2"})
    joined = keyed.join(spans, on, "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_remove(), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<array<long>>")


def op10_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    found = repeated_spans(common.read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
