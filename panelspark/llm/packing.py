"""Best-fit packing of token pieces into sequences, certified by dual-feasible-function lower bounds.

Pieces are dealt to partitions and each partition is packed by best-fit decreasing. Dual feasible functions give a
lower bound on the bins that any packing of the partition needs. A partition that uses more bins than its bound gives
up the documents of its open bins; those of several such partitions are exchanged, dealt anew and packed again by
best-fit decreasing, as long as that saves bins.

Defined cases: a null or empty text is one piece with only the end id; a very long text is cut into full pieces and
one shorter first piece; rows that repeat a doc_id are packed each by itself; pieces of equal length are taken in the
order of their rows, and of equally full bins the one opened or filled last takes a piece; a null doc_id stays null;
columns other than doc_id and text are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored
from .tokens import encoder

#: piece_key: the task, then 33 bits for the pieces of a task.
PIECE_SCHEMA = "piece_key long, doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"
KEY_BITS = 33


def cut_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = 1024, keep_ids: bool = False) -> DataFrame:
    """Pieces of every whole text: all but the first have `capacity` ids, so at most one piece of a text is open.

    piece_key tells pieces of repeated ids apart. keep_ids adds the ids as little-endian unsigned 32-bit integers.
    """
    small_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = encoder(tokenizer_path)
        serial = TaskContext.get().partitionId() << KEY_BITS
        for batch in batches:
            for first, ids, edges in own.encode(batch.column(1)):
                n = len(edges) - 1
                sizes = np.diff(edges) + 1
                with_end = np.full(int(sizes.sum()), end_id, dtype="<u4")
                ends = np.cumsum(sizes)
                inside = np.ones(len(with_end), dtype=bool)
                inside[ends - 1] = False
                with_end[inside] = ids
                pieces = -(-sizes // capacity)
                rows = np.repeat(np.arange(n), pieces)
                piece = np.arange(len(rows)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                head = sizes - (pieces - 1) * capacity
                start = np.where(piece == 0, 0, head[rows] + (piece - 1) * capacity)
                length = np.where(piece == 0, head[rows], capacity)
                at = (ends - sizes)[rows] + start
                raw = memoryview(with_end).cast("B")
                spans = [raw[4 * a : 4 * b] for a, b in zip(at.tolist(), (at + length).tolist())]
                columns = [
                    pa.array(serial + np.arange(len(rows))),
                    batch.column(0).slice(first, n).take(pa.array(rows)),
                    pa.array(piece.astype(np.int32)),
                    pa.array(start),
                    pa.array(length),
                    pa.array([zlib.crc32(x) for x in spans], type=pa.int64()),
                    pa.array([bytes(x) for x in spans] if keep_ids else [None] * len(rows), type=pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["piece_key", "doc_id", "piece", "start", "length", "ids_crc32", "ids"])
                serial += len(rows)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = rows.mapInArrow(cut, PIECE_SCHEMA)
    return pieces if keep_ids else pieces.drop("ids")


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each item, and the number of bins; each item goes to the fullest bin that still takes it."""
    order = np.argsort(-lengths, kind="stable")
    bins = np.zeros(len(lengths), dtype=np.int64)
    offsets = np.zeros(len(lengths), dtype=np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by the room left
    mask = 0  # bit r is set while open_bins[r] isn't empty
    n = 0
    for item, length in zip(order.tolist(), lengths[order].tolist()):
        fits = mask >> length
        if fits:
            room = length + (fits & -fits).bit_length() - 1
            number = open_bins[room].pop()
            if not open_bins[room]:
                mask &= ~(1 << room)
        else:
            number, room = n, capacity
            n += 1
        bins[item], offsets[item] = number, capacity - room
        room -= length
        if room:
            open_bins[room].append(number)
            mask |= 1 << room
    return bins, offsets, n


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """The best of some dual feasible functions; counts[s] items have size s.

    u_k: items over capacity - k count whole, those under k not at all. The rounding functions count
    floor((k + 1) * s / capacity) / k, or s / capacity where (k + 1) * s / capacity is a whole number.
    """
    sizes = np.arange(capacity + 1)
    best = -(-int((counts * sizes).sum()) // capacity)
    items, mass = np.cumsum(counts), np.cumsum(counts * sizes)
    for k in range(1, capacity // 2 + 1):
        whole = items[capacity] - items[capacity - k]
        middle = mass[capacity - k] - mass[k - 1]
        best = max(best, int(whole) - (-int(middle) // capacity))
    for k in range(2, 33):
        scaled = (k + 1) * sizes
        value = np.where(scaled % capacity == 0, sizes * k, (scaled // capacity) * capacity)
        best = max(best, -(-int((counts * value).sum()) // (k * capacity)))
    return best


def pack(pieces: DataFrame, capacity: int = 1024, per_partition: int = 20_000, rounds: int = 4) -> DataFrame:
    """pieces with sequence_id and offset. per_partition bounds what one task packs (about; pieces are dealt by hash).

    Full pieces are sequences of their own and are never dealt. sequence_id is unique over all rounds and partitions.
    """
    spark = pieces.sparkSession
    pieces = stored(pieces, "pieces")
    alone = -1 - F.col("piece_key")
    full = pieces.filter(F.col("length") == capacity).withColumns({"sequence_id": alone, "offset": F.lit(0).cast("long")})
    left = pieces.filter(F.col("length") < capacity)
    spread = ["piece_key", "length"]

    def packed(salt: int, count: int, source: DataFrame) -> DataFrame:
        def one(group: pd.DataFrame) -> pd.DataFrame:
            lengths = group["length"].to_numpy()
            bins, offsets, n = best_fit_decreasing(lengths, capacity)
            used = np.bincount(bins, weights=lengths, minlength=n)[bins]
            return pd.DataFrame({"piece_key": group["piece_key"], "length": lengths, "cell": group["cell"], "bin": bins, "offset": offsets, "used": used.astype(np.int64), "gap": n - lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)})

        cell = F.pmod(F.xxhash64("piece_key", F.lit(salt)), F.lit(count)).cast("int")
        return source.select(*spread).withColumn("cell", cell).groupBy("cell").applyInPandas(one, "piece_key long, length long, cell int, bin long, offset long, used long, gap long")

    placed: list[DataFrame] = []
    previous = None
    for round_no in range(rounds):
        total = left.count() if round_no == 0 else n_open
        if not total:
            break
        count = max(1, -(-total // per_partition))
        result = stored(packed(round_no, count, left).withColumn("sequence_id", F.lit(round_no << 56) + F.col("cell").cast("long") * F.lit(1 << 32) + F.col("bin")), f"packed{round_no}")
        row = result.agg(F.count_distinct("sequence_id").alias("n"), F.sum(F.when((F.col("gap") > 0) & (F.col("used") < capacity), 1)).alias("open"), F.count_distinct(F.when(F.col("gap") > 0, F.col("cell"))).alias("cells")).first()
        if previous is not None:
            old_result, old_open = previous
            if row["n"] >= old_open:  # the exchange saved nothing: the earlier packing of these documents stands
                placed.append(old_result.filter((F.col("gap") > 0) & (F.col("used") < capacity)))
                previous = None
                break
        n_open = row["open"] or 0
        closed = (F.col("gap") <= 0) | (F.col("used") >= capacity)
        if not n_open or row["cells"] < 2 or round_no == rounds - 1:
            placed.append(result)
            previous = None
            break
        placed.append(result.filter(closed))
        open_rows = result.filter(~closed)
        n_bins = open_rows.agg(F.count_distinct("sequence_id")).first()[0]
        previous = (result, n_bins)
        left = open_rows
    columns = ["piece_key", "sequence_id", "offset"]
    chosen = None
    for part in placed:
        chosen = part.select(*columns) if chosen is None else chosen.unionByName(part.select(*columns))
    output = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    if chosen is None:
        return full.select(*output)
    open_pieces = pieces.filter(F.col("length") < capacity).join(chosen, "piece_key")
    return full.select(*output).unionByName(open_pieces.select(*output))


def certificate(packing: DataFrame, capacity: int = 1024) -> tuple[int, int]:
    """The number of sequences, and a lower bound on those of any packing of the same pieces.

    The driver gets one row for each length that occurs, capacity at most.
    """
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for row in packing.groupBy("length").count().collect():
        counts[row["length"]] = row["count"]
    return packing.agg(F.count_distinct("sequence_id")).first()[0], lower_bound(counts, capacity)
