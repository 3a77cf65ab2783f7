"""SQL over named DataFrames."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

_TABLE = re.compile(r"\b(?:from|join)\s+([a-z_]\w*)", re.IGNORECASE)


def table_names(query: str) -> list[str]:
    """Names after FROM and JOIN, in order, each once; those that WITH defines aren't tables."""
    defined = {m.lower() for m in re.findall(r"(?:\bwith\b|,)\s*([a-z_]\w*)\s+as\s*\(", query, re.IGNORECASE)}
    return list(dict.fromkeys(n for n in _TABLE.findall(query) if n.lower() not in defined))


def sql(frames: Sequence[DataFrame] | Mapping[str, DataFrame], query: str) -> DataFrame:
    """Run Spark SQL; frames are named, or bound to the tables in order of their first appearance."""
    if not isinstance(frames, Mapping):
        names = table_names(query)
        if len(names) != len(frames):
            raise ValueError(f"the query names {names}, but {len(frames)} frames were given")
        frames = dict(zip(names, frames))
    spark = next(iter(frames.values())).sparkSession
    for name, frame in frames.items():
        frame.createOrReplaceTempView(name)
    return spark.sql(query)
