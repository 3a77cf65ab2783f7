"""WARC archives whose records are compressed one by one with a shared Zstandard dictionary.

The dictionary is trained on a bounded sample of the archived payloads and stands at the head of each file in a
skippable frame, so a file can be read alone. A payload that other records hold too is stored once, in the record of
the largest page_id; the others are revisit records that refer to it.

Files appear under their final names only when they are complete: a task that is run again writes its own temporary
file and renames it over the same name. Paths are Hadoop-style URIs in a folder that all executors share.

Defined cases: a null or empty html is an empty payload; very long payloads are archived whole; rows that repeat page_id
and payload give one response, the rest revisit it (which of the equal rows is the response doesn't show); a null
page_id is archived without an id, read back as null and smaller than any other: if all records of a payload have none,
one is the response and the others are revisits that refer to null; a null url becomes an empty target URI; columns
other than page_id, url and html are ignored, whatever their names; with fewer than LEAST_SAMPLE payloads to train on
the dictionary is empty, and records are compressed without one; an empty table gives no records. A file that ends
within a record, or holds fewer records than were written to it, raises ValueError.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import parts, shared_folder, small_batches, stored

#: The skippable frame that holds a dictionary, as the format for Zstandard-compressed WARC files has it (fixed value).
DICTIONARY_MAGIC = 0x184D2A5D
#: The driver trains on at most SAMPLE payloads, the first SAMPLE_BYTES bytes of each; the archive holds whole payloads.
SAMPLE, SAMPLE_BYTES, DICTIONARY_BYTES, LEAST_SAMPLE = 1000, 16_384, 112_640, 20
LEVEL = 6
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def train(pages: DataFrame, seed: int = 1) -> bytes:
    """A dictionary from a bounded sample of payloads (empty where there are too few to train on)."""
    total = pages.count()
    share = min(1.0, 2 * SAMPLE / max(total, 1))
    rows = pages.select(F.substring(F.encode("html", "utf-8"), 1, SAMPLE_BYTES).alias("p"), F.xxhash64("page_id", F.lit(seed)).alias("h"))
    rows = rows.filter((F.pmod(F.col("h"), F.lit(1_000_000)) < share * 1_000_000) & (F.length("p") > 0)).orderBy("h").limit(SAMPLE)
    samples = [bytes(r["p"]) for r in rows.select("p").collect()]
    if len(samples) < LEAST_SAMPLE:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""  # too little data for a dictionary


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, revisit: bool = False, refers_to: int | None = None) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP head only."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head if revisit else head + payload
    name = "" if page_id is None else str(page_id)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{name}:{digest}')}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}",
        f"WARC-Page-ID: {name}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Payload-Length: {size}",
    ]
    if revisit:
        origin = "" if refers_to is None else str(refers_to)
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To-Page: {origin}", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{origin}:{digest}')}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The fields of a record that write() gives; a response's length and digest are those of the payload read."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    revisit = fields["WARC-Type"] == "revisit"
    name, origin = (fields.get(x, "").strip() for x in ("WARC-Page-ID", "WARC-Refers-To-Page"))
    return {
        "page_id": int(name) if name else None,
        "payload_bytes": int(fields["WARC-Payload-Length"]) if revisit else len(payload),
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:") if revisit else payload_digest(payload),
        "record_type": fields["WARC-Type"],
        "refers_to": int(origin) if origin else None,
        "payload": None if revisit else payload,
    }


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def write(pages: DataFrame, path: str, dictionary: bytes, least_revisit: int = 0, level: int = LEVEL) -> DataFrame:
    """Write the archives below path; (file, records) of each. Payloads of fewer bytes than least_revisit are all kept."""
    spark = pages.sparkSession
    small_batches(spark)
    html = F.coalesce(F.encode(F.col("html").cast("string"), "utf-8"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("payload"))
    # Ids as text, null as the empty one, so that joins find them.
    name = F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("name")
    digests = stored(rows.select(name, "page_id", F.sha1("payload").alias("sha"), F.length("payload").alias("size")), "digests")
    repeated = digests.filter(F.col("size") >= least_revisit).groupBy("sha").agg(F.count("*").alias("n"), F.max("page_id").alias("keeper"))
    repeated = stored(repeated.filter("n > 1"), "repeated").select("sha", "keeper")
    # The payloads are dealt by page_id, which no group shares; only pages with a repeated payload have a keeper.
    keepers = digests.join(repeated, "sha").select("name", "sha", "keeper", F.lit(True).alias("shared"))
    keepers = stored(keepers.distinct(), "keepers")
    dealt = rows.select(name, "page_id", "url", "payload", F.sha1("payload").alias("sha")).repartition(parts(spark), "name", "sha")
    dealt = dealt.join(keepers.hint("shuffle_merge"), ["name", "sha"], "left").sortWithinPartitions("page_id", "sha")

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        store, base = _open(path)
        store.create_dir(base, recursive=True)
        own = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        packer = zstandard.ZstdCompressor(level=level, dict_data=own, write_checksum=True, write_content_size=True)
        final = f"{base}/part-{context.partitionId():05d}.warc.zst"
        temporary = f"{base}/_{context.partitionId():05d}-{uuid.uuid4().hex}"
        n, before = 0, None
        with store.open_output_stream(temporary, compression=None) as out:
            packed = zstandard.ZstdCompressor(level=19).compress(dictionary)
            out.write(struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed)
            for batch in batches:
                for page_id, url, payload, sha, keeper, shared in zip(*(batch.column(k).to_pylist() for k in range(6))):
                    # Equal rows come one after the other: the first is the response.
                    again = shared is not None and (page_id != keeper or (page_id, sha) == before)
                    before = (page_id, sha)
                    digest = base64.b32encode(bytes.fromhex(sha)).decode()
                    out.write(packer.compress(record(page_id, url, payload, digest, len(payload), again, keeper if again else None)))
                    n += 1
        if n:
            store.move(temporary, final)
        else:
            store.delete_file(temporary)
        yield pa.RecordBatch.from_arrays([pa.array([final] * bool(n), type=pa.string()), pa.array([n] * bool(n), type=pa.int64())], names=["file", "records"])

    return dealt.select("page_id", "url", "payload", "sha", "keeper", "shared").mapInArrow(written, "file string, records long")


def records(stream) -> Iterator[bytes]:
    """The records of one file, read a block at a time: the dictionary's frame, then a frame for each record."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != DICTIONARY_MAGIC:
        raise ValueError("the file doesn't begin with a dictionary")
    dictionary = zstandard.ZstdDecompressor().decompress(stream.read(size))
    own = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    frames = zstandard.ZstdDecompressor(dict_data=own).stream_reader(stream, read_size=1 << 16, read_across_frames=True)
    # A record says how long it is, so the frames needn't be told apart.
    with io.BufferedReader(frames, 1 << 16) as plain:
        while line := plain.readline():
            lines, length = [line], None
            while line.strip():
                line = plain.readline()
                if not line:
                    raise ValueError("the file ends within a record")
                lines.append(line)
                if line.startswith(b"Content-Length: "):
                    length = int(line[16:])
            block = plain.read(length + 4)
            if len(block) < length + 4:
                raise ValueError("the file ends within a record")
            yield b"".join(lines) + block


def read(spark: SparkSession, path: str, files: DataFrame, with_payload: bool = False) -> DataFrame:
    """One row for each record of the files (file, records), a file to a task at a time."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * with_payload
    kinds = dict(page_id=pa.int64(), payload_bytes=pa.int64(), payload_digest=pa.string(), record_type=pa.string(), refers_to=pa.int64(), payload=pa.binary())

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _open(path)
        for batch in batches:
            for name, written in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, n = [], 0
                with store.open_input_stream(name, compression=None) as stream:
                    for raw in records(stream):
                        rows.append(parse(raw))
                        n += 1
                        if len(rows) == 500:
                            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], type=kinds[c]) for c in names], names=names)
                            rows = []
                if n != written:
                    raise ValueError(f"{name} holds {n} records, {written} were written")
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], type=kinds[c]) for c in names], names=names)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    spread = files.select("file", "records").repartition(parts(spark), "file")
    return spread.mapInArrow(parsed, schema)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Archive pages in a shared folder and return what the archives hold, one row for each page."""
    path = shared_folder(spark, "archive")
    files = stored(write(pages, path, train(pages)), "archives")
    return read(spark, path, files)
