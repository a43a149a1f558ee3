"""Raw readers for session files (A1, A2).

* JSON: newline-delimited (splittable) or one JSON array per file. Each record is read
  as one VARIANT value, so no schema is inferred, keys may differ per record, and every
  field survives into ``raw_payload``.
* CSV: header row, every cell read as text (see ``csv_lines``).

A folder may mix layouts and headers: each file is read by its own. All add ``_file`` and an
order within the file (JSON: ``_block`` and ``_row``, CSV: ``_row``, the 0-based record
number), so that "first record wins" can be decided in source order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chargeload.sources.csv_lines import read_csv_cells, read_csv_records
from chargeload.sources.files import array_files, scan, sniff_json_layouts

JSON_LAYOUTS = ("auto", "lines", "array")

__all__ = ["JSON_LAYOUTS", "read_csv_cells", "read_csv_records", "read_json_records", "sniff_json_layouts"]


def read_json_records(spark: SparkSession, path: str | list[str], layout: str = "auto",
                      on_malformed: str = "fail") -> DataFrame:
    """One row per JSON record: ``record`` (VARIANT), ``_file``, ``_block``, ``_row``.

    ``on_malformed='fail'`` makes the job fail on text that is not JSON, on a record that
    is not an object and on an array file that does not hold one array (the whole ingest is
    then recorded as failed); ``'skip'`` drops such records. The order within a file is
    (``_block``, ``_row``): both come from the scan itself, the input is read once."""
    if layout not in JSON_LAYOUTS:
        raise ValueError(f"layout must be one of {JSON_LAYOUTS}")
    if on_malformed not in ("fail", "skip"):
        raise ValueError("on_malformed must be 'fail' or 'skip'")
    frames = []
    arrays, others = array_files(spark, path) if layout == "auto" else ([], layout == "lines")
    if layout == "array" or (arrays and not others):
        frames.append(_json_arrays(spark, path, on_malformed))
    elif arrays:
        frames.append(_json_arrays(spark, arrays, on_malformed))
    if others:
        frames.append(_json_lines(spark, path, on_malformed, arrays))
    return reduce(DataFrame.unionByName, frames)


def _json_lines(spark: SparkSession, path: str | list[str], on_malformed: str, but: list[str]) -> DataFrame:
    lines = scan(spark.read.format("text"), path)
    if but:         # the names reach the file listing: those files are not read
        lines = lines.where(~F.col("_metadata.file_path").isin(but))
    lines = lines.select(
        F.regexp_replace("value", "^﻿", "").alias("value"),        # byte-order mark
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"))
    lines = lines.where(F.col("value").rlike(r"\S"))
    parse = F.parse_json if on_malformed == "fail" else F.try_parse_json
    looks = F.ltrim(F.regexp_replace("value", r"^\s+", "")).startswith("{")
    return lines.select(_objects(parse("value"), looks, on_malformed, "JSON record is not an object").alias("record"),
                        "_file", "_block", "_row").where(F.col("record").isNotNull())


def _json_arrays(spark: SparkSession, path: str | list[str], on_malformed: str) -> DataFrame:
    # An array file is one value; it is read by one task per file (the format cannot be
    # split). posexplode gives each element its position in the file.
    mode = "FAILFAST" if on_malformed == "fail" else "PERMISSIVE"
    raw = scan(spark.read.format("json").option("multiLine", True).option("mode", mode)
               .option("singleVariantColumn", "doc"), path)
    items = F.expr("try_cast(doc AS ARRAY<VARIANT>)")
    if on_malformed == "fail":
        items = F.when(items.isNotNull() | F.col("doc").isNull(), items).otherwise(
            F.raise_error(F.lit("JSON document is not an array")))
    raw = raw.select(F.col("_metadata.file_path").alias("_file"), F.posexplode(items).alias("_pos", "item"))
    is_object = F.schema_of_variant("item").startswith("OBJECT")
    return raw.select(_objects(F.col("item"), is_object, on_malformed, "JSON record is not an object").alias("record"),
                      "_file", F.lit(0).cast("long").alias("_block"), F.col("_pos").cast("long").alias("_row")) \
              .where(F.col("record").isNotNull())


def _objects(value: Column, ok: Column, on_malformed: str, message: str) -> Column:
    if on_malformed == "skip":
        return F.when(ok, value)
    return F.when(value.isNull() | ok, value).otherwise(F.raise_error(F.lit(message)))
