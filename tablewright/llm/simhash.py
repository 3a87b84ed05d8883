"""SimHash near-duplicates: tiled exact comparison of fingerprints.

Fingerprints are compared once each, however many documents share one. A tile holds the fingerprints with like population
counts; tiles whose counts differ by more than the radius cannot hold a link and are never compared. What is left is
compared exactly, by numpy exclusive-or and bit counts. Tiles over BLOCK fingerprints are split into blocks that meet all
blocks of their partners. A task returns a star for each of its groups, not all its pairs, so a large group of near copies
gives as many rows as it has fingerprints.

Narrow fingerprints (64 bits, a small radius) have tiles by the counts of either half, and the same rule skips quarters
inside a tile. Wide ones (128 bits) are for similarities far from 1, where a link may differ in a fifth of the bits: they are
made of the different shingles of a text, and their tiles are bands of the total count and of the number of shingles, as two
sets whose sizes differ by more than a factor of SIMILAR cannot be similar. The comparison of two bands is quadratic.

near_copies() and keep_one() take a link of fingerprints for a candidate only: the texts of each group of candidates are
compared, and two are near copies when the sets of their shingles have a Jaccard similarity of SIMILAR or more. A group of more
than TEXTS bytes or MEMBERS texts is cut into chunks, and every two chunks meet in a task. Pairs already joined by verified links
are skipped. Texts of fewer than FEW shingles are similar to equal sets alone, which have equal fingerprints.

A null text is empty; a text without words has fingerprint zero and links like any other. Repeated rows get a row each. Rows
with a null doc_id get the smallest doc_id they reach, null if there is none. Only doc_id and text are read, whatever other
columns are called; keep_one() hands all columns on as they are. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm import common
from tablewright.llm.components import components

WORDS, RADIUS, SEED = 3, 3, 42
#: Words and radius (of 128 bits) for a Jaccard similarity of 0.8 or more: such pairs differ in 19.4 bits or fewer in the mean,
#: with a deviation of 4; unrelated texts differ in 64, with a deviation of 5.7.
WIDE_WORDS, WIDE_RADIUS = 5, 30
#: Jaccard similarity of near copies; bytes and texts of a group that meet as one chunk; tokens that are compared at a time.
SIMILAR, TEXTS, MEMBERS, TOKENS = 0.8, 1 << 25, 1 << 13, 1 << 21
#: Sets under FEW shingles are similar to equal ones alone (3 of 4 are under 0.8); bands of sizes.
FEW, BANDS = 4, 100
#: Rows (a few longs each) that are broadcast; more are joined with a shuffle.
SHOWN = 1_000_000
#: Fingerprints of a tile that one task compares at home; pairs compared at a time.
BLOCK, CHUNK = 1 << 17, 1 << 17


def fingerprint(text: str, words: int = WORDS, lanes: int = 1) -> list[int]:
    """Of a whole text, as 64-bit lanes: shingles of words by the majority of the bits of their hashes: with one lane XXH64,
    repeats included; with two lanes XXH3 of 128 bits, different shingles alone."""
    import xxhash

    parts = text.encode().lower().split()  # bytes: A-Z only, and white space is 0x20 and 0x09-0x0D
    if not parts:
        return [0] * lanes
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(words, len(parts))
    spans = zip(starts[: len(parts) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    if lanes == 1:
        one = xxhash.xxh64_intdigest
        hashes = np.array([one(joined[a:b], SEED) for a, b in spans], "<u8").view(np.uint8).reshape(-1, 8)
    else:
        two = xxhash.xxh3_128_digest
        hashes = np.frombuffer(b"".join({two(joined[a:b], SEED) for a, b in spans}), np.uint8).reshape(-1, 16)
    counts = np.zeros(64 * lanes, np.int64)
    for a in range(0, len(hashes), 1 << 14):
        counts += np.unpackbits(hashes[a : a + (1 << 14)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8").tolist()


def _lanes(lanes: int) -> list[str]:
    return [f"fp{i}" for i in range(lanes)]


def _fingerprints(words: int, lanes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, words, lanes) for t in common.texts_of(batch.column(1))], np.uint64).reshape(-1, lanes)
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column(0)} | {c: pa.array(found[:, i].copy().view(np.int64)) for i, c in enumerate(_lanes(lanes))}
            )

    return run


def fingerprints(docs: DataFrame, words: int = WORDS, lanes: int = 1) -> DataFrame:
    """Rows: doc_id, fp0 [, fp1]: the fingerprint's bits as signed longs."""
    schema = "doc_id long" + "".join(f", {c} long" for c in _lanes(lanes))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_fingerprints(words, lanes), schema)


def band(n: int) -> int:
    """Of a number of shingles: numbers whose ratio is SIMILAR or more are in the same band or in neighbours."""
    return min(int(np.log(max(n, 1)) / (1e-9 - np.log(SIMILAR))), BANDS - 1)


def _tiles(fps: np.ndarray, radius: int, bands: np.ndarray | None) -> np.ndarray:
    """Two coordinates a fingerprint: the counts of the halves, or the bands of sizes and of the total count."""
    if fps.shape[1] == 1:
        return np.stack([np.bitwise_count(fps[:, 0] >> np.uint64(32)), np.bitwise_count(fps[:, 0] & np.uint64(0xFFFFFFFF))], 1).astype(np.int64)
    total = np.bitwise_count(fps).sum(axis=1, dtype=np.int64) // (radius + 1)
    return np.stack([bands.astype(np.int64), total], 1)


def _near(lanes: int, radius: int) -> list[tuple[int, int]]:
    """Steps from a tile to those that may hold a partner and come no later."""
    if lanes > 1:
        return [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 0)]
    return [(i, j) for i in range(-radius, 1) for j in range(-radius, radius + 1) if abs(i) + abs(j) <= radius and (i, j) <= (0, 0)]


SIDE = 33


def _read(batch, lanes: int) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch[c].to_numpy() for c in _lanes(lanes)], 1).view(np.uint64)


def _route(tiles: dict[int, tuple[int, int]], radius: int, lanes: int):
    """tiles: first block and number of blocks of each tile. A fingerprint goes to its home block, and as a guest to the
    blocks of each tile within the radius that comes before its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = SIDE * (SIDE if lanes == 1 else BANDS)
        first, n_of = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for t, (a, n) in tiles.items():
            first[t], n_of[t] = a, n

        def rows(block: np.ndarray, home: bool, batch: pa.RecordBatch, go: np.ndarray) -> pa.RecordBatch:
            own = {c: batch.column(c) for c in ("node", *_lanes(lanes))} if go.all() else {c: batch.column(c).filter(pa.array(go)) for c in ("node", *_lanes(lanes))}
            return pa.RecordBatch.from_pydict({"block": pa.array(block), "home": pa.array(np.full(len(block), home))} | own)

        for batch in batches:
            fps = _read(batch, lanes)
            xy = _tiles(fps, radius, batch.column("band").to_numpy() if lanes > 1 else None)
            own = xy @ np.array([SIDE, 1])
            at = ((fps[:, 0] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % n_of[own]
            yield rows(first[own] + at, True, batch, np.ones(len(fps), bool))
            for i, j in _near(lanes, radius):
                x, y = xy[:, 0] + i, xy[:, 1] + j
                ok = (x >= 0) & (y >= 0) & (y < SIDE)
                tile = np.where(ok, x * SIDE + y, 0)
                for b in range(int(n_of[tile[ok]].max()) if ok.any() else 0):
                    go = ok & (b < n_of[tile])
                    if (i, j) == (0, 0):  # blocks of its own tile before its own
                        go &= b < at
                    if go.any():
                        yield rows(first[tile[go]] + b, False, batch, go)

    return run


class _Forest:
    """Labels of the smallest index reached."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.up[a], self.up[b]
            other = a != b
            a, b = a[other], b[other]
            if not len(a):
                return
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))
            while (self.up[self.up] != self.up).any():
                self.up = self.up[self.up]


def _quarters(fps: np.ndarray) -> np.ndarray:
    """Population counts of the quarters of narrow fingerprints; nothing to skip by in wide ones."""
    if fps.shape[1] > 1:
        return np.zeros((len(fps), 4), np.int64)
    return np.bitwise_count(fps >> np.array([0, 16, 32, 48], np.uint64) & np.uint64(0xFFFF)).astype(np.int64)


def link(home: np.ndarray, guests: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Label of each fingerprint of home, then guests: the first place in its group by links of home with home or guest."""
    n = len(home)
    fps = np.concatenate([home, guests])
    forest = _Forest(len(fps))
    parts = []
    for a, b in ((0, n), (n, len(fps))):
        quarters = _quarters(fps[a:b])
        key = quarters @ np.array([17**3, 17**2, 17, 1])
        order = np.argsort(key, kind="stable")
        cuts = np.flatnonzero(np.diff(key[order], prepend=-1))
        parts.append((order + a, cuts, [*cuts[1:].tolist(), b - a], quarters[order[cuts]]))
    (ho, ha, hb, hq), *_ = parts
    for side, (go, ga, gb, gq) in enumerate(parts):
        for k in range(len(ha)):
            mine = ho[ha[k] : hb[k]]
            near = np.flatnonzero(np.abs(gq - hq[k]).sum(axis=1) <= radius)
            if not side:
                near = near[near >= k]
            if not len(near):
                continue
            theirs = np.concatenate([go[ga[x] : gb[x]] for x in near.tolist()])
            across = fps[theirs].T.copy()
            step = max(1, CHUNK // len(theirs))
            for a in range(0, len(mine), step):
                some = mine[a : a + step]
                apart = np.bitwise_count(fps[some, 0][:, None] ^ across[0])
                for lane in range(1, fps.shape[1]):
                    apart += np.bitwise_count(fps[some, lane][:, None] ^ across[lane])
                i, j = np.nonzero(apart <= radius)
                forest.join(some[i], theirs[j])
    return forest.up


def _link(radius: int, lanes: int):
    def run(table: pa.Table) -> pa.Table:
        home, node = table["home"].to_numpy(), table["node"].to_numpy()
        fps = _read(table, lanes)
        order = np.concatenate([np.flatnonzero(home), np.flatnonzero(~home)])
        label = link(fps[home], fps[~home], radius)
        moved = label != np.arange(len(label))
        return pa.table({"u": pa.array(node[order][moved]), "v": pa.array(node[order][label[moved]])})

    return run


def _grouped(firsts: DataFrame, radius: int, lanes: int, block: int) -> DataFrame:
    """firsts: node, fp0 [, fp1, band], no fingerprint twice. Rows: node, root, for nodes with links."""
    names, more = _lanes(lanes), ["band"] * (lanes > 1)
    ones = sum((F.bit_count(c).cast("int") for c in names), F.lit(0))
    tile = F.bit_count(F.shiftrightunsigned("fp0", 32)).cast("int") * SIDE + F.bit_count(F.col("fp0").bitwiseAND(F.lit(0xFFFFFFFF))).cast("int")
    if lanes > 1:
        tile = F.col("band") * SIDE + F.floor(ones / (radius + 1)).cast("int")
    sizes = sorted((r["tile"], r["count"]) for r in firsts.groupBy(tile.alias("tile")).count().collect())  # at most 33 x 33, or bands x 5 rows
    each = min(block, max(4096, sum(n for _, n in sizes) // 16))
    tiles, at = {}, 0
    for t, n in sizes:
        tiles[t] = (at, -(-n // each))
        at += tiles[t][1]
    routed = firsts.select("node", *names, *more).mapInArrow(_route(tiles, radius, lanes), "block long, home boolean, node long" + "".join(f", {c} long" for c in names))
    return components(routed.groupBy("block").applyInArrow(_link(radius, lanes), "u long, v long"))


def near_duplicates(docs: DataFrame, *, words: int = WORDS, radius: int = RADIUS, lanes: int = 1, block: int = BLOCK) -> DataFrame:
    """Rows: doc_id, fp0 [, fp1], component_id (the smallest doc_id reachable by links)."""
    spark, names = docs.sparkSession, _lanes(lanes)
    rows = common.saved(fingerprints(docs, words, lanes), "fingerprints")
    firsts = rows.groupBy(*names).agg(F.min("doc_id").alias("first_doc")).withColumn("node", F.monotonically_increasing_id())
    firsts = common.saved(firsts, "distinct-fingerprints")
    joined = firsts.join(_grouped(firsts, radius, lanes, block), "node", "left").withColumn("root", F.coalesce("root", "node"))
    joined = common.saved(joined.select("root", "first_doc", *[F.col(c).alias("_" + c) for c in names]), "rooted")
    # tables on both sides, not an aggregate on its own exchange, so that adaptive execution can split a hot root or fingerprint
    least = common.saved(joined.groupBy("root").agg(F.min("first_doc").alias("component_id")), "least")
    classes = common.saved(joined.join(least, "root").select(*["_" + c for c in names], "component_id"), "classes")
    on = [rows[c] == classes["_" + c] for c in names]
    return rows.join(classes, on).select("doc_id", *names, "component_id")


def shingles(text: str, words: int = WIDE_WORDS) -> np.ndarray:
    """Sorted hashes of the different shingles of a text; a text of fewer words is one shingle, one without words has none."""
    import xxhash

    parts = text.encode().lower().split()
    k = min(words, len(parts))
    return np.unique(np.array([xxhash.xxh3_64_intdigest(b" ".join(parts[i : i + k]), SEED) for i in range(len(parts) - k + 1) if parts], np.uint64))


def _digests(words: int, lanes: int):
    """Fingerprint of each text, the band of its number of shingles, and a 128-bit digest of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            texts = common.texts_of(batch.column("text"))
            found = np.array([fingerprint(t, words, lanes) for t in texts], np.uint64).reshape(-1, lanes)
            many = [len(shingles(t, words)) for t in texts]
            own = np.frombuffer(b"".join(xxhash.xxh3_128_digest(b" ".join(t.encode().lower().split()), SEED) for t in texts), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_pydict(
                {
                    "_row": batch.column("_row"),
                    "doc_id": batch.column("doc_id"),
                    "size": pa.array([len(t.encode()) for t in texts], pa.int64()),
                    "n": pa.array(many, pa.int64()),
                    "band": pa.array([band(n) for n in many], pa.int32()),
                }
                | {c: pa.array(found[:, i].copy().view(np.int64)) for i, c in enumerate(_lanes(lanes))}
                | {f"d{i}": pa.array(own[:, i].copy()) for i in range(2)}
            )

    return run


def verified(fps: np.ndarray, sets: list[np.ndarray], chunk: np.ndarray, radius: int, least: float = SIMILAR) -> np.ndarray:
    """Label of each text: the first place in its group by links between texts of two chunks (of one, if there is only one) whose
    fingerprints are within the radius and whose sets of shingles have a Jaccard similarity of least or more. A text is compared
    with all others that are not yet in its group at once."""
    label, one = np.arange(len(fps)), len(fps) > 0 and (chunk == chunk[0]).all()
    sizes = np.array([len(s) for s in sets], np.int64)
    names, flat = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_inverse=True)
    ends, mark = np.cumsum(sizes), np.zeros(len(names), bool)
    for i in np.flatnonzero(sizes).tolist():
        other = label[i + 1 :] != label[i]
        if not one:
            other &= chunk[i + 1 :] != chunk[i]
        near = np.flatnonzero(other) + i + 1
        near = near[np.minimum(sizes[near], sizes[i]) >= least * np.maximum(sizes[near], sizes[i])]
        near = near[np.bitwise_count(fps[near] ^ fps[i]).sum(axis=1, dtype=np.int64) <= radius]
        if not len(near):
            continue
        mine = flat[ends[i] - sizes[i] : ends[i]]
        mark[mine] = True
        step = max(1, TOKENS // int(sizes[near].max()))
        for a in range(0, len(near), step):
            some = near[a : a + step]
            some = some[label[some] != label[i]]
            if not len(some):
                continue
            stops = np.cumsum(sizes[some])
            places = np.repeat(ends[some] - stops, sizes[some]) + np.arange(stops[-1])
            both = np.add.reduceat(mark[flat[places]].astype(np.int64), stops - sizes[some])
            met = np.unique(label[some[both >= least * (sizes[some] + sizes[i] - both)]])
            if len(met):
                met = np.append(met, label[i])
                label[np.isin(label, met)] = met.min()
        mark[mine] = False
    return label


def _verify(words: int, radius: int, lanes: int):
    def run(table: pa.Table) -> pa.Table:
        node = table["node"].to_numpy()
        sets = [shingles(t or "", words) for c in table["text"].chunks for t in c.to_pylist()]
        label = verified(_read(table, lanes), sets, table["chunk"].to_numpy(), radius)
        moved = label != np.arange(len(label))
        return pa.table({"u": pa.array(node[moved], pa.int64()), "v": pa.array(node[label[moved]], pa.int64())})

    return run


def _classes(keyed: DataFrame, *, words: int = WIDE_WORDS, radius: int = WIDE_RADIUS, lanes: int = 2, block: int = BLOCK, texts: int = TEXTS) -> tuple[DataFrame, DataFrame]:
    """Rows with the digest of their words, and one row for each different sequence of words: its group, and its first row."""
    names, own = _lanes(lanes), ["d0", "d1"]
    schema = "_row long, doc_id long, size long, n long, band int" + "".join(f", {c} long" for c in [*names, *own])
    cast = keyed.select("_row", F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = common.saved(cast.mapInArrow(_digests(words, lanes), schema), "digests")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *own, "_row"))
    facts = [F.max(c).alias(c) for c in ("size", "n", "band")]
    nodes = common.saved(rows.groupBy(*own, *names).agg(first.alias("first"), *facts).withColumn("node", F.col("first._row")), "distinct-texts")
    prints = nodes.groupBy(*names).agg(F.min("node").alias("node"), F.count("*").alias("members"), F.sum("size").alias("sizes"), F.max("n").alias("n"), F.max("band").alias("band"))
    prints = common.saved(prints, "distinct-fingerprints")
    linked = _grouped(prints.where(F.col("n") >= FEW), radius, lanes, block)
    grouped = common.saved(prints.join(linked, "node", "left").withColumn("group", F.coalesce("root", "node")).select("group", "members", "sizes", *names), "candidate-groups")
    groups = grouped.groupBy("group").agg(F.sum("members").alias("members"), F.sum("sizes").alias("sizes")).where("members > 1")
    groups = groups.select("group", F.ceil(F.greatest(F.col("sizes") / texts, F.col("members") / MEMBERS)).cast("int").alias("chunks"))
    groups = common.saved(grouped.join(common.saved(groups, "groups"), "group").select("group", "chunks", *names), "crowded-fingerprints")
    members = nodes.select("node", *names).join(groups, names)
    members = common.saved(members.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")), "candidates")
    small = members.limit(SHOWN + 1).count() <= SHOWN
    held = keyed.select(F.col("_row").alias("node"), "text").join(F.broadcast(members) if small else members, "node")
    held = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    pairs = held.withColumns({"low": F.least("chunk", "other"), "high": F.greatest("chunk", "other")})
    edges = pairs.groupBy("group", "low", "high").applyInArrow(_verify(words, radius, lanes), "u long, v long")
    stands = nodes.join(components(edges), "node", "left").select(*own, *names, F.coalesce("root", "node").alias("root"), "first")
    return rows.select("_row", "doc_id", *own, *names), common.saved(stands, "classes")


def near_copies(keyed: DataFrame, **settings) -> DataFrame:
    """keyed: _row (no value twice), doc_id, text. Rows: _row, doc_id, root: a row that stands for its group of near copies."""
    rows, stands = _classes(keyed, **settings)
    return rows.join(stands, [c for c in rows.columns if c not in ("_row", "doc_id")]).select("_row", "doc_id", "root")


def keep_one(docs: DataFrame, *, words: int = WIDE_WORDS, radius: int = WIDE_RADIUS, lanes: int = 2) -> DataFrame:
    """The rows of docs without near copies (verified, see near_copies): of each group the row with the smallest doc_id, null
    last; of rows that share it, the one whose words have the smallest digest, and one of the rows that repeat it. Rows are
    told apart by a number of their own, so what shares a doc_id and is no near copy stays."""
    row = "_row"
    while row in docs.columns:
        row += "_"
    keyed = common.saved(docs.withColumn(row, F.monotonically_increasing_id()), "keyed")
    rows, stands = _classes(keyed.select(F.col(row).alias("_row"), "doc_id", "text"), words=words, radius=radius, lanes=lanes)
    kept = stands.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first._row").alias(row))
    gone = common.saved(rows.select(F.col("_row").alias(row)).join(kept, row, "left_anti"), "copies")
    small = gone.limit(SHOWN + 1).count() <= SHOWN
    return keyed.join(F.broadcast(gone) if small else gone, row, "left_anti").drop(row)


def op9_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(common.read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp0")), 16, "0").alias("fingerprint"), "component_id")
