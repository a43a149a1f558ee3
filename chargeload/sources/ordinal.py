"""0-based row position within each source file (C9), without a global window.

Spark reads a large file as several blocks (splits), possibly packed with other files'
blocks into one partition, and it does not keep file order across partitions. The
position of a row in its file is

    (rows in earlier blocks of the same file) + (position inside its own block)

The first term comes from a small per-block count table (one row per block, prefix-
summed per file); the second from ``monotonically_increasing_id`` which is consecutive
inside a partition, minus the block's smallest id.

The block table has one row per input split (≈ one per 128 MB of input). It is written
once to the shared folder (a lineage cut) and joined back; Spark broadcasts it where its
size, known from the written files, is below the session's threshold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chargeload.config import scratch_path


def with_row_ordinal(df: DataFrame, name: str = "_row", file_col: str = "_file") -> DataFrame:
    """Add ``file_col`` (source file path) and ``name`` (0-based row position in it).

    ``df`` must come straight from a file scan (no shuffle in between), so that the
    metadata columns and the scan order are those of the file. If ``df`` already holds
    ``file_col`` and ``_block`` (e.g. taken from ``_metadata`` in a streaming query),
    those are used."""
    file = F.col(file_col) if file_col in df.columns else F.col("_metadata.file_path")
    block = F.col("_block") if "_block" in df.columns else F.col("_metadata.file_block_start")
    keep = [F.col(f"`{c}`") for c in df.columns if c not in (file_col, "_block")]
    tagged = df.select(*keep, file.alias(file_col), block.alias("_block"),
                       F.monotonically_increasing_id().alias("_mono"))
    blocks = tagged.groupBy(file_col, "_block").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_mono").alias("_first"))
    before = Window.partitionBy(file_col).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(file_col, "_block", "_first",
                           F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    spark = df.sparkSession
    path = scratch_path(spark, "row-blocks")
    blocks.write.parquet(path)
    blocks = spark.read.schema(blocks.schema).parquet(path)      # schema given: empty input is fine
    return (tagged.join(blocks, [file_col, "_block"])
            .withColumn(name, F.col("_offset") + F.col("_mono") - F.col("_first"))
            .drop("_block", "_mono", "_first", "_offset"))
