"""Token ids as ORC: integer run-length encoding, row indexes and Bloom filters on the document ids.

Files hold rows in ascending doc_id order, one file for each range of ids, so a reader can take stripes in parallel,
and a lookup of one id skips files and stripes by their minima, maxima and Bloom filters.

Defined cases: a null or empty text has no ids besides the end id; texts of any length are encoded whole, a very long
one in a batch of its own; rows that repeat a doc_id are all written, ordered by the hash of their text (rows equal in
both are alike, so their order doesn't matter); a null doc_id comes first; columns of documents other than doc_id and
text are ignored, whatever their names; an empty table gives an empty file set.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import parts, shared_folder, small_batches
from .tokens import encoder

#: part: the file; ordinal: the row in it.
FILE_SCHEMA = "part int, ordinal long, doc_id long, n_tokens long, ids array<int>"


def write_orc(docs: DataFrame, tokenizer_path: str, end_id: int, path: str, stripe_bytes: int = 8 << 20, row_index_stride: int = 1000) -> None:
    """Encode every whole text and write its ids and end_id to ORC files below path.

    stripe_bytes sets how much one task reads at once; row_index_stride how many rows an index entry covers.
    """
    spark = docs.sparkSession
    small_batches(spark)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = encoder(tokenizer_path)
        part, ordinal = TaskContext.get().partitionId(), 0
        for batch in batches:
            for first, ids, edges in own.encode(batch.column(1)):
                n = len(edges) - 1
                offsets = edges + np.arange(n + 1)
                values = np.full(int(offsets[-1]), end_id, dtype=np.int32)
                inside = np.ones(len(values), dtype=bool)
                inside[offsets[1:] - 1] = False
                values[inside] = ids
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, part, dtype=np.int32)), pa.array(np.arange(ordinal, ordinal + n)), batch.column(0).slice(first, n), pa.array(np.diff(offsets)), lists],
                    names=["part", "ordinal", "doc_id", "n_tokens", "ids"],
                )
                ordinal += n

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # The hash of the text divides rows of one repeated id among files and makes their order repeatable.
    ordered = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(parts(spark), "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    (
        ordered.select("doc_id", "text")
        .mapInArrow(encoded, FILE_SCHEMA)
        .write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.stripe.size", stripe_bytes)
        .option("orc.row.index.stride", row_index_stride)
        .option("orc.create.index", "true")
        .option("compression", "zstd")
        .orc(path)
    )


def read_orc(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows; filters on doc_id are pushed down to the stripes' statistics and Bloom filters."""
    return spark.read.schema(FILE_SCHEMA).orc(path)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the little-endian 32-bit ids, all from the files."""

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(4)
            offsets = lists.offsets.to_numpy()
            values = lists.values.to_numpy(zero_copy_only=True).astype("<u4", copy=False)
            crcs = [zlib.crc32(memoryview(values[a:b]).cast("B")) if b > a else 0 for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crcs, type=pa.int64())], names=["part", "ordinal", "doc_id", "n_tokens", "n_read", "ids_crc32"])

    files = read_orc(spark, path)
    rows = files.mapInArrow(checked, "part int, ordinal long, doc_id long, n_tokens long, n_read long, ids_crc32 long")
    # One row for each file: its tokens before it. Their number is that of the files, not of the documents.
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
    before = totals.select("part", (F.sum("tokens").over(Window.orderBy("part")) - F.col("tokens")).alias("before"))
    running = Window.partitionBy("part").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.join(F.broadcast(before), "part")
        .withColumn("start", F.col("before") + F.coalesce(F.sum("n_tokens").over(running), F.lit(0)))
        .select("doc_id", "start", F.col("n_read").alias("n_tokens"), "ids_crc32")
    )


def token_orc(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Write docs as ORC in a shared folder and return the digests read back."""
    path = shared_folder(spark, "tokens.orc")
    write_orc(docs, tokenizer_path, end_id, path)
    return digests(spark, path)
