"""The corpus pipeline: quality, language, near duplicates, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs. All but the last return the columns of docs,
whatever other names they carry. Rows with a null doc_id stay unless their text is rejected.

Defined cases: a null or empty text passes or fails the quality stage as its rules say, is dropped by the language
stage (it has no letter), has no duplicates and no benchmark words, and is packed as its end id alone; very long texts
are taken whole; rows that repeat a doc_id count as one document for the near duplicates, where rows with different
texts all stay or all go and equal ones are kept once; ties are those of the operators; an empty table passes every
stage as an empty table, as the models are learned from sf_dir.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm import decontam, langid, neardup, packing, quality, queries
from panelspark.llm.common import broadcast_if_small, stored

#: Ids of dropped documents that may be broadcast; beyond it they are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def _judged(docs: DataFrame, judge: Callable[[DataFrame], DataFrame], keep: str) -> DataFrame:
    """The rows of docs that pass `keep` after judge(), which sees the text and columns of neutral names only."""
    names = docs.columns
    at = names.index("text")
    neutral = ["text" if k == at else f"c{k}" for k in range(len(names))]
    return judge(docs.toDF(*neutral)).filter(keep).select(*neutral).toDF(*names)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the rule ensemble predicts to be of low quality."""
    model = queries.fitted_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _judged(docs, lambda rows: quality.scored(rows, model), "predicted = 1")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that lie too far from every language's centroids."""
    model = queries.fitted_languages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return _judged(docs, lambda rows: langid.predict(rows, model), "not rejected")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest doc_id of each group of near duplicates; of its rows with equal texts one stays."""
    found = stored(neardup.near_duplicates(docs.select("doc_id", "text")), "near_duplicates")
    dropped = stored(found.filter("not kept").select("doc_id").distinct(), "dropped")
    kept = docs.join(broadcast_if_small(dropped, dropped.count(), BROADCAST_ROWS), "doc_id", "left_anti").select(*docs.columns)
    repeated = found.filter("kept and doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    repeated = stored(repeated, "repeated")
    n = repeated.count()
    if not n:
        return kept
    held = broadcast_if_small(repeated, n, BROADCAST_ROWS)
    again = kept.join(held, "doc_id", "left_semi").select(*docs.columns)
    # Rows with one doc_id and one text are copies: the one whose columns have the least hash stays.
    ordered = F.struct(F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)).alias("h"), *(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)))
    once = again.groupBy(F.col("doc_id").alias("key"), F.xxhash64("text").alias("tie")).agg(F.min(ordered).alias("own"))
    once = once.select(*(F.col(f"own.c{k}").alias(c) for k, c in enumerate(docs.columns)))
    return kept.join(held, "doc_id", "left_anti").select(*docs.columns).unionByName(once)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents of which a twentieth or more are words of benchmark windows."""
    found = decontam.decontaminate(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), slack=None)
    dropped = stored(found.filter("contaminated").select(F.col("doc_id").alias("bad_id"), "tie").distinct(), "contaminated")
    held = broadcast_if_small(dropped, dropped.count(), BROADCAST_ROWS)
    same = docs["doc_id"].cast("long").eqNullSafe(held["bad_id"]) & (F.xxhash64(docs["text"]) == held["tie"])
    return docs.join(held, same, "left_anti")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the remaining documents into sequences of at most 1024 tokens."""
    return packing.pack(packing.cut_pieces(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), queries.END_ID))


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: The models, the similarity join and the packing have no SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return docs
