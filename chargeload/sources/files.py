"""The files of an input: how each begins, found by the executors from the scan itself.

Nothing is opened on the driver. JSON layouts come from the first characters of the files' first
blocks; CSV headers, quotes and row counts from one aggregate over the lines (``csv_blocks``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LISTING = "path string, modificationTime timestamp, length bigint, content binary"

#: A JSON array file is read as one value, and no value is longer than this: larger files can only hold lines.
LARGEST_ARRAY = 1 << 31

#: Tables up to this many bytes, known from their row count, are broadcast.
BROADCAST_BYTES = 256 << 20


def scan(reader, path: str | list[str]) -> DataFrame:
    """Load a path, or exactly the listed files (names that look like patterns included)."""
    if isinstance(path, str):
        return reader.load(path)
    return reader.option("globPaths", "false").load(list(path))


def is_single_file(files: list[str], path: str | list[str]) -> bool:
    """Was the input one file by name (not a folder, pattern or list that holds one)?"""
    return isinstance(path, str) and len(files) == 1 and files[0].rstrip("/").endswith(
        "/" + path.rstrip("/").rsplit("/", 1)[-1])


def broadcast_checked(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """``df`` marked for broadcast if its rows are known to fit, else as it is (a shuffle join)."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def _starts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(_file, array): does the first character of the file that is neither white space nor a byte-order mark say '['?

    Files that are too large for one value are not read (the listing knows their length); of the others only the first
    block's lines are looked at. Place and answer are one number, so this is a hash aggregate."""
    first = F.substring(F.regexp_replace("value", r"^[\s﻿]+", ""), 1, 1)
    lines = (scan(spark.read.format("text"), path)
             .where((F.col("_metadata.file_size") <= F.lit(LARGEST_ARRAY)) & (F.col("_metadata.file_block_start") == 0))
             .select(F.col("_metadata.file_path").alias("_file"), first.alias("c")).where(F.col("c") != ""))
    place = F.monotonically_increasing_id() * 2 + F.when(F.col("c") == "[", 1).otherwise(0)
    return (lines.select("_file", place.alias("p")).groupBy("_file").agg(F.min("p").alias("p"))
            .select("_file", (F.col("p") % 2 == 1).alias("array")))


def sniff_json_layouts(spark: SparkSession, path: str | list[str]) -> dict[str, str]:
    """{file: 'array' or 'lines'} of the files that are not blank and not too large for an array."""
    return {r["_file"]: "array" if r["array"] else "lines" for r in _starts(spark, path).collect()}


def array_files(spark: SparkSession, path: str | list[str]) -> tuple[list[str], bool]:
    """(names of the array files, is there any other file?) — the names only, and none where no file is an array."""
    found = _starts(spark, path)
    counts = {r["array"]: r["count"] for r in found.groupBy("array").count().collect()}
    if not counts.get(True):
        return [], True
    names = sorted(r["_file"] for r in found.where("array").select("_file").collect())
    listed = scan(spark.read.format("binaryFile").schema(_LISTING), path).select("path").count()    # contents are not read
    return names, listed > len(names)
