"""Quality classification by an interpolated modified Kneser-Ney model of bytes.

The model has orders 1 to ORDER over the UTF-8 bytes of trusted documents (labels with quality 1 and toxic 0), between start and
end marks. All tables are sharded by n-gram: counts of the highest order, continuation counts of the lower ones, and for each
context its total and how many of its n-grams were seen once, twice and more often. The n-grams that the corpus asks for are
joined with them from order 1 up, so that each gets its probability once. Each scan task (a unit) lists the n-grams of its own
documents, gets back their probabilities in one file of the shared folder, and adds up the documents' logarithms. What is
gathered grows with the corpus; a task holds the n-grams of its unit only.

A document is rejected when its perplexity is over a quantile of the held-out trusted documents of its language: one in
HELD_OUT, by hash of doc_id, is not learned from, as texts that were learned from have lower perplexities. The quantile of a
language is the one of QUANTILES that tells its held-out trusted documents best from those labelled as bad, none of which is
learned from: with the greatest share of bad documents caught less the share of trusted ones rejected, and the highest of equals.
A language without LEAST bad documents takes the highest quantile, one without LEAST held-out trusted documents (null is a
language of its own) the threshold of all.

A null or empty text has only its end mark. Repeated rows get a row each. With no trusted documents at all every byte is equally
likely and nothing is rejected; an empty table gives no rows. A null doc_id is never trusted. A perplexity at the threshold is
kept. Only doc_id, text and lang are read, whatever other columns are called. docs must be a plain scan: its partitions are the units of two
passes, and a pass that meets an n-gram its unit did not list fails.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm import common
from tablewright.llm.token_files import open_fs

ORDER, QUANTILES, HELD_OUT, LEAST = 5, (0.95, 0.96, 0.97, 0.98, 0.99), 4, 30
#: Folders of probabilities; scan tasks beyond them share one.
FOLDERS = 10_000
#: Trusted ids that are broadcast (8 bytes each); more are joined with a shuffle.
MAX_IDS = 4_000_000
#: Bytes of text that are numbered together; a longer text is a piece of its own.
PIECE = 1 << 20
START, END = 0xFE, 0xFF  # never part of UTF-8


def _pieces(keys: list, texts: list[str], order: int) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """(rows, n-gram of each place, first place of each row) of some texts at a time."""
    rows, parts, size = [], [], 0
    for i, text in enumerate(texts):
        data = b"\xfe" * (order - 1) + text.encode() + b"\xff"
        rows.append(i)
        parts.append(data)
        size += len(data)
        if size >= PIECE or i == len(texts) - 1:
            sizes = np.array([len(p) for p in parts])
            flat = np.frombuffer(b"".join(parts), np.uint8).astype(np.int64)
            grams = np.zeros(len(flat) - order + 1, np.int64)
            for k in range(order):
                grams = (grams << 8) | flat[k : len(flat) - order + 1 + k]
            ends = np.cumsum(sizes)
            keep = np.ones(len(flat), bool)
            for k in range(1, order):
                keep[ends - k] = False
            own = sizes - order + 1
            yield rows, grams[keep[: len(grams)]], np.cumsum(own) - own
            rows, parts, size = [], [], 0


class _Counter:
    """Sums of counts by n-gram."""

    def __init__(self) -> None:
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.n = 0

    def add(self, grams: np.ndarray, counts: np.ndarray) -> None:
        self.held.append((grams, counts))
        self.n += len(grams)
        if len(self.held) > 8:
            self.held = [self.total()]

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.held:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        grams, at = np.unique(np.concatenate([x[0] for x in self.held]), return_inverse=True)
        return grams, np.bincount(at, np.concatenate([x[1] for x in self.held]), len(grams)).astype(np.int64)


def _listed(ids, order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, trusted = _Counter(), ids.value if ids is not None else None
        for batch in batches:
            keys = batch.column("doc_id")
            if trusted is None:
                good = np.array(batch.column("trusted").to_pylist(), bool)
            else:
                own = keys.fill_null(-(1 << 63)).to_numpy()
                at = np.minimum(np.searchsorted(trusted, own), max(len(trusted) - 1, 0))
                good = trusted[at] == own if len(trusted) else np.zeros(len(own), bool)
            for rows, grams, starts in _pieces(keys, common.texts_of(batch.column("text")), order):
                learn = np.repeat(good[rows], np.diff(np.append(starts, len(grams))))
                met, n = np.unique(grams[learn], return_counts=True)
                counter.add(met, n)
                if not learn.all():
                    met = np.unique(grams[~learn])
                    counter.add(met, np.zeros(len(met), np.int64))
        grams, counts = counter.total()
        unit = TaskContext.get().partitionId()
        for a in range(0, len(grams), 100_000):
            part = grams[a : a + 100_000]
            yield pa.RecordBatch.from_pydict({"unit": pa.array(np.full(len(part), unit, np.int32)), "g": pa.array(part), "c": pa.array(counts[a : a + 100_000])})

    return run


def _discounts(counts: DataFrame) -> tuple[float, float, float]:
    n = {r["c"]: r["n"] for r in counts.where("c <= 4").groupBy("c").agg(F.count("*").alias("n")).collect()}  # four rows
    if not all(n.get(k) for k in (1, 2, 3, 4)):
        return 0.5, 0.75, 0.9
    y = n[1] / (n[1] + 2 * n[2])
    return tuple(min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.05), k - 0.05) for k in (1, 2, 3))


def probabilities(counts: DataFrame, asked: DataFrame, order: int = ORDER) -> DataFrame:
    """counts: g, c of the highest order; asked: g. Rows: g, p for every n-gram asked for."""
    spark = counts.sparkSession
    tables, wanted = {order: counts}, {order: asked}
    for n in range(order - 1, 0, -1):
        mask = (1 << (8 * n)) - 1
        cut = F.col("g").bitwiseAND(F.lit(mask)).alias("g")
        tables[n] = common.saved(tables[n + 1].groupBy(cut).agg(F.count("*").alias("c")), f"counts-{n}")
        wanted[n] = common.saved(wanted[n + 1].select(cut).distinct(), f"asked-{n}")
    found = spark.createDataFrame([(0, 1 / 257)], "g long, p double")
    for n in range(1, order + 1):
        d1, d2, d3 = _discounts(tables[n])
        own = tables[n].select(F.col("g"), "c", F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3).alias("d"))
        context = own.groupBy(F.shiftright("g", 8).alias("h")).agg(F.sum("c").alias("total"), F.sum("d").alias("freed"))
        mask = (1 << (8 * (n - 1))) - 1
        asked_n = wanted[n].select("g", F.shiftright("g", 8).alias("h"), F.col("g").bitwiseAND(F.lit(mask)).alias("lower"))
        lower = found.select(F.col("g").alias("lower"), F.col("p").alias("below"))
        p = F.coalesce((F.coalesce("c", F.lit(0)) - F.coalesce("d", F.lit(0.0)) + F.col("freed") * F.col("below")) / F.col("total"), F.col("below"))
        joined = asked_n.join(own, "g", "left").join(context, "h", "left").join(lower, "lower")
        found = common.saved(joined.select("g", p.alias("p")), f"probabilities-{n}")
    return found


def _scored(path: str, order: int, share: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        grams = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if grams is None:
                unit = TaskContext.get().partitionId()
                fs, top = open_fs(f"{path}/folder={unit // share}")
                table = pq.read_table(top, filesystem=fs, columns=["g", "p"], partitioning=None, filters=[("unit", "=", unit)])
                grams, logs = table["g"].to_numpy(), np.log(table["p"].to_numpy())
                order_of = np.argsort(grams)
                grams, logs = grams[order_of], logs[order_of]
            total, n = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for rows, own, starts in _pieces([], common.texts_of(batch.column("text")), order):
                met, at = np.unique(own, return_inverse=True)
                where = np.minimum(np.searchsorted(grams, met), len(grams) - 1)
                if (grams[where] != met).any():
                    raise RuntimeError("the partitions of the documents changed between two passes")
                total[rows] = np.add.reduceat(logs[where][at], starts)
                n[rows] = np.diff(np.append(starts, len(own)))
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column("doc_id"), "lang": batch.column("lang"), "n_bytes": pa.array(n - 1), "perplexity": pa.array(np.exp(-total / n))}
            )

    return run


def perplexities(docs: DataFrame, trusted: DataFrame, order: int = ORDER) -> DataFrame:
    """Rows: doc_id, lang, n_bytes, perplexity, trusted. trusted: doc_id."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    trusted = trusted.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    small = trusted.limit(MAX_IDS + 1).count() <= MAX_IDS
    if not small:  # the scan must stay a plain one, so the joined rows are written first
        docs = common.saved(docs.join(trusted.withColumn("trusted", F.lit(True)), "doc_id", "left").withColumn("trusted", F.coalesce("trusted", F.lit(False))), "labelled")
    ids = spark.sparkContext.broadcast(np.sort(trusted.toPandas()["doc_id"].to_numpy(np.int64))) if small else None
    listed, listed_path = common.saved_at(docs.mapInArrow(_listed(ids, order), "unit int, g long, c long"), "listed")
    sums = common.saved(listed.groupBy("g").agg(F.sum("c").alias("c")), "counts")
    found = probabilities(sums.where("c > 0"), sums.select("g"), order)
    path = common.fresh_path(spark, "unit-probabilities")
    share = -(-(1 + (listed.agg(F.max("unit")).first()[0] or 0)) // FOLDERS)
    placed = listed.join(found, "g").select("unit", "g", "p", F.floor(F.col("unit") / share).cast("int").alias("folder"))
    placed.repartition(common.partitions(spark), "folder").sortWithinPartitions("folder", "unit", "g").write.partitionBy("folder").option("compression", "zstd").parquet(path)
    common.drop_table(spark, listed_path)
    scored = common.saved(docs.select("doc_id", "lang", "text").mapInArrow(_scored(path, order, share), "doc_id long, lang string, n_bytes long, perplexity double"), "scored")
    common.drop_table(spark, path)
    return scored.join(trusted.withColumn("trusted", F.lit(True)), "doc_id", "left").withColumn("trusted", F.coalesce("trusted", F.lit(False)))


def classify(docs: DataFrame, trusted: DataFrame, bad: DataFrame | None = None, *, order: int = ORDER, quantiles: tuple[float, ...] = QUANTILES) -> DataFrame:
    """trusted, bad: doc_id. Rows: doc_id, lang, n_bytes, perplexity, threshold, keep."""
    key = F.col("doc_id").cast("long").alias("doc_id")
    held = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(HELD_OUT)) == 0
    rows = perplexities(docs, trusted.where(~held), order).drop("trusted")
    proof = rows.join(trusted.where(held).select(key).distinct(), "doc_id")
    cuts = F.percentile_approx("perplexity", F.array(*map(F.lit, sorted(quantiles))), 10_000).alias("cuts")
    by_lang = proof.groupBy("lang").agg(cuts, F.count("*").alias("n")).where(F.col("n") >= LEAST).drop("n")
    overall = proof.agg(cuts).first()["cuts"]
    if bad is not None:
        wrong = rows.join(bad.select(key).distinct(), "doc_id").select(F.col("lang").alias("_lang"), "perplexity")
        met = wrong.join(by_lang, F.col("_lang").eqNullSafe(F.col("lang")))
        caught = [F.avg((F.col("perplexity") > F.col("cuts")[k]).cast("int")) for k in range(len(quantiles))]
        gain = F.array(*[F.struct((c - (1 - q)).alias("gain"), F.lit(k).alias("k")) for k, (c, q) in enumerate(zip(caught, sorted(quantiles), strict=True))])
        best = met.groupBy("lang").agg(F.array_max(gain)["k"].alias("k"), F.count("*").alias("n")).where(F.col("n") >= LEAST)
        best = best.select(F.col("lang").alias("_best"), "k")
        by_lang = by_lang.join(best, F.col("lang").eqNullSafe(F.col("_best")), "left")
    else:
        by_lang = by_lang.withColumn("k", F.lit(None).cast("int"))
    by_lang = by_lang.select(F.col("lang").alias("_lang"), F.element_at("cuts", F.coalesce(F.col("k") + 1, F.lit(-1))).alias("threshold"))
    joined = rows.join(by_lang, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    limit = F.coalesce("threshold", F.lit(overall[-1] if overall else None).cast("double"), F.lit(float("inf")))
    return joined.withColumn("threshold", limit).select("doc_id", "lang", "n_bytes", "perplexity", "threshold", (F.col("perplexity") <= F.col("threshold")).alias("keep"))


def op5_kneser_ney_quality(spark, sf_dir: str) -> DataFrame:
    labels = common.read_table(spark, sf_dir, "labels")
    trusted, bad = labels.where("quality = 1 and toxic = 0"), labels.where("quality = 0 or toxic = 1")
    return classify(common.read_table(spark, sf_dir, "documents"), trusted.select("doc_id"), bad.select("doc_id"))
