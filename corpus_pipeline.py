"""The corpus pipeline: reject toxic documents, drop exact and near copies, remove benchmark passages' documents, pack.

STAGES are (name, function) pairs; a function takes (spark, docs, sf_dir) and returns a DataFrame that run() writes as
Parquet in the shared folder and reads again for the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkwell.llm import decontamination, exact_dedup, near_dedup, packing, toxicity
from chunkwell.llm.common import drop, mark, materialise, release, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier doesn't reject, each judged by itself; null and empty texts are judged by its bias and
    stay where toxic labels are the rarer ones; an empty table stays empty.

    Learned from the labels of rows that aren't held out (crc32 of the id mod 5 is 0).
    """
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels").where(~held_out)))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per text, null counting as empty: see exact_dedup.keep_distinct for null and repeated ids."""
    return exact_dedup.keep_distinct(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per group of near duplicates; all rows without words: see near_dedup.keep_one for null and repeated ids."""
    return near_dedup.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the benchmark doesn't contaminate, each judged by itself: see decontamination.keep_clean."""
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of every row's ids: see packing.pack for null texts and ids, repeated rows and empty tables."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: A trained classifier and a tokenizer are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; scratch tables are removed stage by stage."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        since = mark(spark)
        docs = materialise(stage(spark, docs, sf_dir), name)
        release(spark, since, [docs])
        if before is not None:
            drop(before)
        before = docs
    return docs
