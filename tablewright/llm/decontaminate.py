"""Benchmark decontamination by greedy string tiling.

A benchmark item and a document that share a seed (MIN_MATCH words in a row) are compared: the longest common run of unmarked
words is found again and again by Karp-Rabin hashing, and marked in both, until none of MIN_MATCH words is left. The share of
an item's words that are marked is its coverage; as the order of tiles does not matter, reordered passages count in full. A
document with an item of coverage THRESHOLD or more is contaminated.

Words are runs of letters and digits, lower-cased. Items of fewer than MIN_MATCH words are matched as a whole. The benchmark is
joined in blocks of at most BLOCK seeds, so what is broadcast is bounded whatever its size. Only words of the block's items
have a number, so a document is read as numbers, nearly all of them the number for other words.

Null or empty texts and items match nothing. Repeated items give a row each; so do repeated documents. Documents with a null
doc_id are handled like others. Longest runs that tie are marked by their place in the item, then in the document. An empty
benchmark leaves every document clean; an empty documents table gives no rows. Only doc_id, item_id and text are read;
decontaminate() hands all columns on as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm import common

MIN_MATCH, THRESHOLD = 5, 0.5
#: Seeds of the items that are broadcast together.
BLOCK = 500_000
_WORD = re.compile(r"\w+")
_BASE, _PRIME = 1_000_003, (1 << 61) - 1


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def _hashes(ids: list[int], size: int, open_at: list[bool]) -> Iterator[tuple[int, int]]:
    """(place, rolling hash) of each run of size unmarked words."""
    h = run = 0
    top = pow(_BASE, size, _PRIME)
    for i, x in enumerate(ids):
        if not open_at[i] or x < 0:
            h = run = 0
            continue
        h = (h * _BASE + x + 1) % _PRIME
        run += 1
        if run > size:
            h = (h - (ids[i - size] + 1) * top) % _PRIME
        if run >= size:
            yield i - size + 1, h


def tile(item: list[int], doc: list[int], least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in item, place in doc, words) of each tile; ids under 0 match nothing."""
    open_item, open_doc = [True] * len(item), [True] * len(doc)
    tiles: list[tuple[int, int, int]] = []
    size = max(least, len(item) // 2)
    while True:
        table: dict[int, list[int]] = {}
        for j, h in _hashes(doc, size, open_doc):
            table.setdefault(h, []).append(j)
        longest, found = 0, []
        for i, h in _hashes(item, size, open_item):
            for j in table.get(h, ()):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] >= 0 and open_item[i + n] and open_doc[j + n]:
                    n += 1
                if n >= size:
                    longest = max(longest, n)
                    found.append((-n, i, j))
        if longest > 2 * size:  # look again with runs near the longest
            size = longest
            continue
        for n, i, j in sorted(found):
            n = -n
            if all(open_item[i : i + n]) and all(open_doc[j : j + n]):
                tiles.append((i, j, n))
                open_item[i : i + n] = [False] * n
                open_doc[j : j + n] = [False] * n
        if size <= least and not found:
            return tiles
        if size > least:
            size = max(least, size // 2)


class _Block:
    """Items with their words as numbers, and where each seed occurs."""

    def __init__(self, items: list[tuple[int, str]], least: int) -> None:
        self.least, self.numbers, self.items = least, {}, []
        seeds: dict[int, list[int]] = {}
        self.short = []
        for item_id, text in items:
            ids = [self.numbers.setdefault(w, len(self.numbers)) for w in words(text)]
            k = len(self.items)
            self.items.append((item_id, ids))
            if not ids:
                continue
            own = min(len(ids), least)
            if own < least:
                self.short.append((k, own))
            else:
                for h in set(self.seeds_of(np.array(ids, np.int64), least).tolist()):
                    seeds.setdefault(h, []).append(k)
        self.seed_items = seeds
        self.sorted = np.array(sorted(seeds), np.uint64)

    @staticmethod
    def seeds_of(ids: np.ndarray, size: int) -> np.ndarray:
        h = np.zeros(max(0, len(ids) - size + 1), np.uint64)
        for k in range(size):
            h = h * np.uint64(0x9E3779B97F4A7C15) + ids[k : len(ids) - size + 1 + k].astype(np.uint64) + np.uint64(1)
        return h

    def matches(self, text: str | None) -> list[tuple[int, float, list[tuple[int, int, int]]]]:
        """(item_id, coverage, tiles) of the items that share a seed with the text."""
        get = self.numbers.get
        ids = np.array([get(w, -1) for w in words(text)], np.int64)
        if not len(ids):
            return []
        close = set()
        if len(ids) >= self.least and len(self.sorted):
            known = np.flatnonzero(np.lib.stride_tricks.sliding_window_view(ids, self.least).min(axis=1) >= 0)
            if len(known):
                h = self.seeds_of(ids, self.least)[known]
                at = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
                for x in np.unique(h[self.sorted[at] == h]).tolist():
                    close.update(self.seed_items[x])
        sizes = {k: self.least for k in close} | {k: n for k, n in self.short if len(ids) >= n}
        if not sizes:
            return []
        out, doc = [], ids.tolist()
        for k in sorted(sizes):
            item_id, item = self.items[k]
            own = set(item)
            seen = [x if x in own else -1 for x in doc]
            tiles = tile(item, seen, sizes[k])
            if tiles:
                out.append((item_id, sum(t[2] for t in tiles) / len(item), tiles))
        return out


def _blocks(benchmark: DataFrame, least: int, block: int) -> Iterator[_Block]:
    """The benchmark by runs of item ids, each of at most `block` words (one item may be longer)."""
    sized = benchmark.select("item_id", "text", F.size(F.split("text", r"\s+")).alias("n"))
    total = sized.agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-total // block))
    if parts == 1:
        yield _Block([(r["item_id"], r["text"]) for r in sized.collect()], least)
        return
    numbered = common.saved(sized.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(2 * parts))), "benchmark")
    for k in range(2 * parts):  # a block's items are bounded in number by its words
        yield _Block([(r["item_id"], r["text"]) for r in numbered.where(F.col("part") == k).collect()], least)




def _matched(shared, wide: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch in batches:
            out = [(key, *m) for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for m in block.matches(text)]
            key, item, cover, tiles = zip(*out, strict=True) if out else ((),) * 4
            made = {"doc_id": pa.array(key, pa.int64()), "item_id": pa.array(item, pa.int64()), "coverage": pa.array(cover, pa.float64())}
            if wide:
                made["tiles"] = pa.array([[list(t) for t in x] for x in tiles], pa.list_(pa.list_(pa.int64())))
            yield pa.RecordBatch.from_pydict(made)

    return run


def matches(docs: DataFrame, benchmark: DataFrame, *, min_match: int = MIN_MATCH, block: int = BLOCK) -> DataFrame:
    """Rows: doc_id, item_id, coverage, tiles (place in item, place in doc, words), of pairs that share a seed."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = None
    for part in _blocks(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text"), min_match, block):
        shared = spark.sparkContext.broadcast(part)
        own = docs.mapInArrow(_matched(shared, True), "doc_id long, item_id long, coverage double, tiles array<array<long>>")
        found = own if found is None else found.union(own)
    return found


def _clean(shared, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            keep = [all(m[1] < threshold for m in block.matches(t)) for t in texts]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, min_match: int = MIN_MATCH, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """The rows of docs that cover no item by the threshold or more."""
    spark = docs.sparkSession
    for part in _blocks(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text"), min_match, block):
        docs = docs.mapInArrow(_clean(spark.sparkContext.broadcast(part), threshold), docs.schema)
    return docs


def op1_greedy_tiling_decontamination(spark, sf_dir: str) -> DataFrame:
    """doc_id, item_id (the best covered; the smallest of ties), coverage and n_items of each contaminated document."""
    docs, benchmark = common.read_table(spark, sf_dir, "documents"), common.read_table(spark, sf_dir, "benchmark")
    found = matches(docs, benchmark).where(F.col("coverage") >= THRESHOLD)
    best = F.max_by(F.struct("item_id", "coverage"), F.struct("coverage", -F.col("item_id")))
    return found.groupBy("doc_id").agg(best.alias("b"), F.count_distinct("item_id").alias("n_items")).select("doc_id", "b.item_id", "b.coverage", "n_items")
