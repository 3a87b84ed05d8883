"""The corpus pipeline: documents become packed training sequences in five stages.

Each stage reads what the one before it kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablewright.llm import common, decontaminate, langid, packing, secrets, simhash


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or in no learned language, go: so do null and empty texts. Where no row has a language to learn
    from, every text goes. Repeated rows stay or go together; null doc_ids are judged by their text like others; an empty table
    stays empty; further columns pass through, whatever they are called."""
    common.ready(spark)
    return langid.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (sets of five-word shingles with a Jaccard similarity of 0.8 or more) stays:
    the one with the smallest doc_id (null last), of rows that share it one alone. Null and empty texts are copies of each other.
    An empty table stays empty; further columns pass through, whatever they are called."""
    common.ready(spark)
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold half of a benchmark item's words or more, in any order of passages, go. Null and empty texts hold
    nothing and stay; repeated rows and items are judged alike; without a benchmark every document stays; an empty table stays
    empty; further columns pass through, whatever they are called."""
    return decontaminate.decontaminate(docs, common.read_table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts, and n_chars is counted anew; every document stays, also null and empty texts, null
    doc_ids and repeated rows. An empty table stays empty; further columns pass through, whatever they are called."""
    common.ready(spark)
    return secrets.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences. Null and empty texts give the end id alone; repeated rows are packed
    once each, rows with a null doc_id like others; an empty table gives no rows; further columns are not read."""
    common.ready(spark)
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scan", redact_secrets),
    ("best_fit_packing", pack_sequences),
]

#: The stages train models, compare by similarity and use a tokenizer, which SQL cannot express; tests compare each stage with
#: brute force on a small table.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the whole documents table, each written as Parquet and read again."""
    docs = common.read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.saved(stage(spark, docs, sf_dir), name)
    return docs
