"""Readers by extension and SAS files with a Parquet cache."""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def read_file(spark: SparkSession, path: str, **options) -> DataFrame:
    """csv, parquet, json or orc by extension."""
    kind = os.path.splitext(path.rstrip("/"))[1].lstrip(".").lower()
    if kind not in ("csv", "parquet", "json", "orc"):
        raise NotImplementedError(f"no reader for {kind!r} files")
    if kind == "csv":
        options = {"header": True, "inferSchema": True} | options
    return spark.read.options(**options).format(kind).load(path)


def load_sas(spark: SparkSession, path: str, csv: bool = False, cache: bool = True, encodings: tuple[str, ...] = ("utf-8", "cp1252"), **options) -> DataFrame:
    """A SAS file of the driver's file system, decoded there in chunks; a copy beside it is used while it is newer.

    The copy is Parquet, which keeps the types, or with csv=True a CSV file, whose reading takes `options`.
    """
    kind = "csv" if csv else "parquet"
    copy = f"{os.path.splitext(path)[0]}.{kind}"
    if cache and os.path.exists(copy) and os.path.getmtime(copy) > os.path.getmtime(path):
        return read_file(spark, copy, **options)
    for k, encoding in enumerate(encodings):
        try:
            mode = "overwrite"
            if not cache:
                return spark.createDataFrame(pd.read_sas(path, encoding=encoding))
            for chunk in pd.read_sas(path, encoding=encoding, chunksize=200_000):
                spark.createDataFrame(chunk).write.mode(mode).options(**({"header": True} if csv else {})).format(kind).save(copy)
                mode = "append"
            return read_file(spark, copy, **options)
        except UnicodeDecodeError:
            if k == len(encodings) - 1:
                raise
    raise ValueError("encodings must not be empty")
