"""Shard placement by a permutation-filled lookup table.

Each shard has its own permutation of the slots of a table of prime size, from an offset and a step. The shards take
turns, each claiming the next free slot of its permutation, until the table is full; so shares differ by one slot at
most, and a shard that leaves disturbs few others. A key's slot is its hash modulo the table's size. The table is
bounded by its size, whatever the data, and is broadcast.

Defined cases: a null key has slot and shard null; equal keys share a shard; an empty table gives no rows; columns
named slot or shard are replaced, the others kept. A table with fewer slots than shards, or one that isn't of prime
size, raises ValueError.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TABLE_SIZE = 65_537
MOST_SLOTS = 10_000_000


def _number(text: str, salt: str) -> int:
    return int(hashlib.md5(f"{salt}:{text}".encode()).hexdigest()[:15], 16)


def lookup_table(shards: list[str], size: int = TABLE_SIZE, weights: dict[str, int] | None = None) -> list[int]:
    """The index of the shard that holds each slot. A shard of weight w claims w slots a turn."""
    if not shards or len(set(shards)) < len(shards) or len(shards) > size or size > MOST_SLOTS:
        raise ValueError("shards must be distinct, one at least, and no more than slots")
    if size < 2 or any(size % k == 0 for k in range(2, int(size**0.5) + 1)):
        raise ValueError("the table's size must be prime")
    offset = [_number(s, "offset") % size for s in shards]
    step = [_number(s, "step") % (size - 1) + 1 if size > 2 else 1 for s in shards]
    turns = [max(1, (weights or {}).get(s, 1)) for s in shards]
    tried = [0] * len(shards)
    table = [-1] * size
    left = size
    while left:
        for k in range(len(shards)):
            for _ in range(turns[k]):
                slot = (offset[k] + tried[k] * step[k]) % size
                while table[slot] >= 0:
                    tried[k] += 1
                    slot = (offset[k] + tried[k] * step[k]) % size
                table[slot] = k
                tried[k] += 1
                left -= 1
                if not left:
                    return table
    return table


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """The slot of a key: 60 bits of the MD5 of its text, modulo the size."""
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 15), 16, 10).cast("long") % F.lit(size)


def place(rows: DataFrame, key: str, shards: list[str], size: int = TABLE_SIZE) -> DataFrame:
    """rows with slot and shard; the broadcast table has `size` rows."""
    spark = rows.sparkSession
    table = lookup_table(shards, size)
    held = spark.createDataFrame([(slot, shards[k]) for slot, k in enumerate(table)], "slot long, shard string")
    kept = [F.col(f"`{c}`") for c in rows.columns if c.lower() not in ("slot", "shard")]
    return rows.select(*kept, slot_of(F.col(f"`{key}`"), size).alias("slot")).join(F.broadcast(held), "slot", "left").select(*kept, "slot", "shard")
