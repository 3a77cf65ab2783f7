"""Shared folders, Arrow text buffers and vectorised hashing used by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_MIX_A = np.uint64(0xBF58476D1CE4E5B9)
_MIX_B = np.uint64(0x94D049BB133111EB)

#: A-Z to a-z, every other byte unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: The six ASCII white-space bytes.
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True


#: Rows that Spark's Parquet reader holds at once.
READ_ROWS = 128


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below spark.checkpoint.dir, which every executor can reach.

    Only where the setting is empty (local tests) a temporary folder takes its place.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = getattr(context, "_panelspark_scratch", None)
        if base is None:
            if not context.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = context._panelspark_scratch = "file://" + tempfile.mkdtemp(prefix="panelspark-")
    return f"{base.rstrip('/')}/panelspark-{uuid.uuid4().hex}/{name}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once to a shared Parquet table and read back: cuts lineage and survives lost executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._panelspark_path = path
    return back


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables that no later plan reads."""
    for table in tables:
        path = getattr(table, "_panelspark_path", None)
        if path:
            spark = table.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def small_batches(spark: SparkSession, rows: int = 1000, most_bytes: int = 4 << 20, read: int = READ_ROWS) -> None:
    """At most `rows` rows and about most_bytes in an Arrow batch, so that long texts don't fill a worker's memory.

    Spark's Parquet reader holds a batch of rows by number only, and as it doubles its buffers up to three times their
    bytes: 4096 texts of 100 KB, as is its default, don't fit an executor. So it takes `read` rows at most.
    These are settings of the session, and stay: plans that are made lazily run with them later.
    """
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", most_bytes), ("spark.sql.parquet.columnarReaderBatchSize", read)):
        text = spark.conf.get(name)
        now = int(text.rstrip("bB")) if text.rstrip("bB").lstrip("-").isdigit() else most + 1
        if not 0 < now <= most:
            spark.conf.set(name, most)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def broadcast_if_small(df: DataFrame, rows: int, most: int) -> DataFrame:
    """Broadcast df where its counted rows are at most `most`; beyond that Spark joins by shuffle."""
    return F.broadcast(df) if rows <= most else df


def bucket_of_id(column: str, modulus: int):
    """crc32 of the id written as text, modulo modulus (null ids: null)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)


def text_chunks(column: pa.Array, most_bytes: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of whole texts as (first row, bytes, offsets); a text longer than most_bytes is a run of its own.

    offsets[i]:offsets[i + 1] are the bytes of text first row + i. A null has no bytes.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    kind = column.type
    wide = pa.types.is_large_string(kind) or pa.types.is_large_binary(kind)
    n = len(column)
    if not n:
        return
    _, offset_buffer, data = column.buffers()
    offsets = np.frombuffer(offset_buffer, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most_bytes, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x *= _MIX_A
    x ^= x >> np.uint64(27)
    x *= _MIX_B
    x ^= x >> np.uint64(31)
    return x


_TABLE = mixed(np.arange(1, 257, dtype=np.uint64) * _GOLDEN)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 20) + 1, base, dtype=np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if len(have) <= 1 << 22:
            _powers[int(base)] = have
    return have


def word_spans(raw: np.ndarray, offsets: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes outside `gap`, and for each text its first run (one more at the end)."""
    space = gap[raw]
    n = len(raw)
    before = np.empty(n + 1, dtype=bool)
    before[0] = True
    before[1:] = space
    before[offsets[offsets < n]] = True
    after = np.empty(n + 1, dtype=bool)
    after[n] = True
    after[:n] = space
    after[offsets[offsets < n]] = True  # position i here says whether a run that reaches i ends before it
    word = ~space
    starts = np.flatnonzero(word & before[:n])
    ends = np.flatnonzero(word & after[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    n = len(values)
    weights = _TABLE[values]
    weights *= _power(_BASE, n)[:n]
    edges = np.empty(2 * len(starts), dtype=np.int64)
    edges[0::2] = starts
    edges[1::2] = ends
    tail = edges[-1] == n
    sums = np.add.reduceat(weights, edges[:-1] if tail else edges)[0::2]
    sums = sums * _power(_BASE_INVERSE, n)[starts]
    return mixed(sums + (ends - starts).astype(np.uint64) * _GOLDEN)


def shingle_hashes(words: np.ndarray, firsts: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of `width` words.

    A text with fewer words has its whole sequence as one shingle, a text without words none.
    """
    n = len(words)
    counts = np.diff(firsts)
    rolled = np.zeros(max(n - width + 1, 0), dtype=np.uint64)
    for k in range(width):
        rolled = (rolled ^ (rolled >> np.uint64(32))) * _BASE + words[k : k + len(rolled)]
    rolled = mixed(rolled)
    found = []
    for first, count in zip(firsts[:-1].tolist(), counts.tolist()):
        if count >= width:
            own = np.sort(rolled[first : first + count - width + 1])
            found.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
        elif count:
            whole = np.uint64(count)
            with np.errstate(over="ignore"):
                for word in words[first : first + count]:
                    whole = (whole ^ (whole >> np.uint64(32))) * _BASE_INVERSE + word
            found.append(mixed(np.array([whole], dtype=np.uint64)))
        else:
            found.append(np.zeros(0, np.uint64))
    return found
