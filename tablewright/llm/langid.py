"""Language identification by a string kernel.

The kernel of two texts is the number of letter n-grams (n = 1 to 3, blended) that both have, over the geometric mean of the
numbers each has; it counts presence, so whole texts of any length compare. Nyström landmarks (LANDMARKS texts) turn it into
features, on which one-versus-rest kernel ridge regression is solved on the driver. The fit reads at most PER_LANG different rows
(those with the lowest hash of doc_id and text) of each of the LANGS most frequent languages, as presence bits: no more than that
reaches the driver, however often rows or doc_ids repeat. All texts are scored by batched matrix products of their
presence with the landmarks' weights.

N-grams are hashed to BUCKETS; texts are lower-cased and everything but letters is one separator. A text that is null or has no
letter is `und` with score 0, and so is every text if no labelled row can be learned from. Ties of score go to the language that
sorts first. Repeated rows get a row each; a null doc_id is never learned from and not held out; an empty table gives no rows.
Only doc_id, lang and text are read, whatever other columns are called; keep_identified() hands all columns on as they are.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm import common

BUCKETS, ORDERS = 1 << 15, (1, 2, 3)
PER_LANG, LANGS, LANDMARKS, RIDGE = 400, 200, 256, 1e-2
#: Texts in one matrix product; sharpness of the score; the score under which keep_identified() rejects a text.
BATCH, SHARPNESS, MIN_SCORE = 64, 6.0, 0.3

_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def presence(text: str) -> np.ndarray | None:
    """Bits of the n-grams that a whole text has; None without a letter."""
    seen = np.zeros(BUCKETS, np.uint8)
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letters = _letter_table()[codes]
    if not letters.any():
        return None
    for a in range(0, len(codes), 1 << 18):  # in pieces that overlap by an n-gram
        b = min(len(codes), a + (1 << 18) + max(ORDERS) - 1)
        c = np.where(letters[a:b], codes[a:b], 0).astype(np.uint32)
        if a == 0:
            c = np.concatenate([[0], c]).astype(np.uint32)
        if b == len(codes):
            c = np.append(c, np.uint32(0))
        h = np.zeros(len(c), np.uint32)
        for n in ORDERS:
            h = h[: len(c) - n + 1] * np.uint32(0x01000193) + c[n - 1 :] + np.uint32(n)
            mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            seen[mixed >> np.uint32(32 - 15)] = 1
    return seen


@dataclass(frozen=True)
class Model:
    """Weights of n-grams for each language, folded over the landmarks."""

    langs: list[str]
    columns: np.ndarray
    weights: np.ndarray

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        if not self.langs:
            return out
        rows, x = [], np.zeros((BATCH, len(self.columns)), np.float32)
        norms = np.zeros(BATCH)

        def flush() -> None:
            value = (x[: len(rows)] @ self.weights) / norms[: len(rows), None]
            e = np.exp(SHARPNESS * (value - value.max(axis=1, keepdims=True)))
            best, share = value.argmax(axis=1), e / e.sum(axis=1, keepdims=True)
            for k, i in enumerate(rows):
                out[i] = (self.langs[int(best[k])], float(share[k, best[k]]))
            rows.clear()

        for i, text in enumerate(texts):
            bits = presence(text) if text else None
            if bits is None:
                continue
            x[len(rows)] = bits[self.columns]
            norms[len(rows)] = np.sqrt(bits.sum(dtype=np.int64))
            rows.append(i)
            if len(rows) == BATCH:
                flush()
        if rows:
            flush()
        return out


def fit(bits: np.ndarray, langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """bits: presence of each text; one-versus-rest kernel ridge regression on Nyström features."""
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros(0, np.int64), np.zeros((0, 0), np.float32))
    by = {name: [i for i, y in enumerate(langs) if y == name] for name in names}
    turns = [rows[k] for k in range(max(map(len, by.values()))) for rows in by.values() if k < len(rows)][:landmarks]
    columns = np.flatnonzero(bits[turns].any(axis=0))  # no other n-gram is shared with a landmark
    x = bits[:, columns].astype(np.float32)
    x /= np.sqrt(bits.sum(axis=1, keepdims=True, dtype=np.int64)).astype(np.float32)
    marks = x[turns]
    k_nm, k_mm = (x @ marks.T).astype(np.float64), (marks @ marks.T).astype(np.float64)
    value, vector = np.linalg.eigh(k_mm)
    good = value > 1e-6 * value.max()
    root = vector[:, good] / np.sqrt(value[good])
    phi = k_nm @ root
    y = np.where(np.array(langs)[:, None] == np.array(names)[None], 1.0, -1.0)
    weight = np.array([1 / len(by[name]) for name in langs]) * len(langs) / len(names)  # languages count alike
    alpha = root @ np.linalg.solve((phi * weight[:, None]).T @ phi + ridge * len(langs) * np.eye(phi.shape[1]) / 100, (phi * weight[:, None]).T @ y)
    weights = marks.T.astype(np.float64) @ alpha
    return Model(names, columns, weights.astype(np.float32))


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for lang, text in zip(batch.column(0).to_pylist(), common.texts_of(batch.column(1)), strict=True):
            bits = presence(text)
            if bits is not None:
                out.append((lang, np.packbits(bits).tobytes()))
        lang, bits = zip(*out, strict=True) if out else ((), ())
        yield pa.RecordBatch.from_pydict({"lang": pa.array(lang, pa.string()), "bits": pa.array(bits, pa.binary())})


def learn(docs: DataFrame, per_lang: int = PER_LANG) -> Model:
    """From rows with a lang whose crc32(doc_id) mod 3 is not 1."""
    own = docs.where("lang is not null and pmod(crc32(cast(cast(doc_id as string) as binary)), 3) <> 1").select("doc_id", "lang", "text")
    keyed = own.withColumn("_key", F.xxhash64("doc_id", "text"))
    most = keyed.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGS).collect()
    counts = {r["lang"]: r["n"] for r in most}
    if not counts:
        return fit(np.zeros((0, BUCKETS)), [])
    h = F.pmod(F.xxhash64("_key"), F.lit(1 << 30))

    def lowest(bounds: dict[str, int]) -> list[tuple[str, int]]:
        """(language, key) of the rows with the lowest hash under the bound of each language; tasks keep PER_LANG of each."""
        rows = keyed.select("lang", "_key", h.alias("_h")).where(F.col("lang").isin(list(bounds)))
        limit = F.element_at(F.create_map(*[F.lit(x) for pair in bounds.items() for x in pair]), F.col("lang"))
        rows = rows.where(F.col("_h") < limit).distinct()
        at = F.row_number().over(Window.partitionBy("lang").orderBy("_h", "_key"))
        return [(r["lang"], r["_key"]) for r in rows.withColumn("_at", at).where(F.col("_at") <= per_lang).collect()]

    wanted = lowest({lang: min(1 << 30, int((1 << 30) * 4 * per_lang / n) + 1) if n > 8 * per_lang else 1 << 30 for lang, n in counts.items()})
    found = Counter(lang for lang, _ in wanted)
    if few := [lang for lang, n in counts.items() if n > 8 * per_lang and found[lang] < per_lang]:  # rows that mostly repeat
        wanted = [w for w in wanted if w[0] not in few] + lowest(dict.fromkeys(few, 1 << 30))
    asked = keyed.where(F.col("_key").isin([k for _, k in wanted])).where(F.col("lang").isin(list(counts)))
    rows = asked.dropDuplicates(["lang", "_key"]).select("lang", "text").mapInArrow(_bits, "lang string, bits binary").collect()
    rows = sorted((r["lang"], bytes(r["bits"])) for r in rows)
    if not rows:
        return fit(np.zeros((0, BUCKETS)), [])
    return fit(np.unpackbits(np.frombuffer(b"".join(b for _, b in rows), np.uint8).reshape(len(rows), -1), axis=1), [x for x, _ in rows])


def _predicted(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.predict(batch.column(2).to_pylist())
            lang, score = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column(0), "held_out": batch.column(1), "lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64())}
            )

    return run


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Rows: doc_id, held_out, lang_pred, score. Only text enters a prediction."""
    held = F.expr("coalesce(pmod(crc32(cast(cast(doc_id as string) as binary)), 3) = 1, false)")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text")
    return rows.mapInArrow(_predicted(model), "doc_id long, held_out boolean, lang_pred string, score double")


def _kept(model: Model, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.predict(batch.column(batch.schema.get_field_index("text")).to_pylist())
            yield batch.filter(pa.array([lang != "und" and score >= least for lang, score in found], pa.bool_()))

    return run


def keep_identified(docs: DataFrame, model: Model | None = None, least: float = MIN_SCORE) -> DataFrame:
    """The rows of docs whose text is in a language that was learned, with a score of least or more."""
    return docs.mapInArrow(_kept(model or learn(docs), least), docs.schema)


def op6_string_kernel_language(spark, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    return predict(docs, learn(docs))
