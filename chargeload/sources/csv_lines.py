"""CSV files as records: header, quotes and record numbers of all files from one pass over their lines.

The lines are scanned as text. One aggregate per (file, block) counts the lines, notes the first one (the header) and
counts lines with an odd number of quotes: only a record that goes on in the next line has one. The block table
is written once; the same scan, joined to it, then gives every line its number in its file and its header, whatever
number of headers there is, and each line is parsed under its header's width. Files with such odd lines cannot be read line by
line; they alone go to the multi-line reader, a task a file.

A record is ``_cells`` (array of text, as long as the header), ``_names`` (the header, repeated names made distinct),
``_at`` (1-based place of each session field, by alias), ``_extra`` (the raw record where it has more cells than its header, else NULL),
``_file``, ``_row`` (0-based number in its file), ``_many`` (is the input more than one file by name?) and partition columns.
A short record is padded with NULL; surplus cells that are all empty (a trailing comma) do not count.
"""

from __future__ import annotations

import csv
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chargeload.config import scratch_path
from chargeload.sources.csv_sessions import ALIASES, resolve_aliases
from chargeload.sources.files import broadcast_checked, is_single_file, scan
from chargeload.sources.ordinal import with_row_ordinal

BOM = "﻿"
_HEADER_SCHEMA = f"_header string, _names array<string>, _at struct<{', '.join(f'{f}: int' for f in ALIASES)}>"
_RECORD = ("_cells", "_names", "_at", "_extra", "_file", "_row", "_many")


def distinct_names(names: list[str], same=lambda n: n) -> list[str]:
    """Header names with repeats told apart: name, name_duplicated_0, name_duplicated_1, …"""
    out, taken, repeats = [], set(), {}
    for name in names:
        new = name
        while same(new) in taken:
            k = repeats.get(name, 0)
            repeats[name], new = k + 1, f"{name}_duplicated_{k}"
        taken.add(same(new))
        out.append(new)
    return out


def parse_header(line: str) -> list[str]:
    """Cells of one header record; names that stand twice are told apart, letter case counts."""
    cells = next(csv.reader([line.lstrip(BOM)], strict=False), [])
    return distinct_names([c if c else f"_c{i}" for i, c in enumerate(cells)])


def _header_row(line: str, names: list[str]) -> tuple:
    at = resolve_aliases(names)
    return line, names, tuple(names.index(at[f]) + 1 if at[f] else None for f in ALIASES)


def _quotes(c: str) -> Column:
    return F.when(F.contains(F.col(c), F.lit('"')), F.length(c) - F.length(F.replace(F.col(c), F.lit('"')))).otherwise(0)


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    df = scan(spark.read.format("text"), path)
    df = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
    return df.where(F.col("value").rlike(r"[^\s﻿]")).withColumn("_mono", F.monotonically_increasing_id())


def _blocks(spark: SparkSession, lines: DataFrame) -> DataFrame:
    """Per (file, block), written once: first line's place, lines before the block, the file's header and whether any line leaves a quote open."""
    found = lines.groupBy("_file", "_block").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_mono").alias("_first"), F.sum(_quotes("value") % 2).alias("_odd"),
        F.min_by(F.when(F.col("_block") == 0, F.col("value")), "_mono").alias("_line"))
    by = Window.partitionBy("_file")
    before = by.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    found = found.select("_file", "_block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
                         F.max("_line").over(by).alias("_header"), (F.sum("_odd").over(by) > 0).alias("_open"))
    path = scratch_path(spark, "csv-blocks")
    found.write.parquet(path)
    return spark.read.schema(found.schema).parquet(path)        # schema given: empty input is fine


def _cells(row: Column, width: int) -> Column:
    return F.array(*[row[f"_c{i}"] for i in range(width)])


def _record(width: int) -> Column:
    """struct(cells, extra) of a line under a header of ``width`` names; the line is parsed once."""
    parsed = F.from_csv(F.col("value"), _schema(width), _csv_options(width))
    return F.transform(F.array(parsed), lambda r: F.struct(_cells(r, width).alias("cells"), _surplus(r["_bad"], width).alias("extra")))[0]


def _surplus(bad: Column, width: int) -> Column:
    """The raw record (given only where its cell count is wrong) if more cells than ``width`` hold anything."""
    bare = F.regexp_replace(bad, r'"[^"]*"', "x")
    return F.when(F.regexp_count(F.regexp_replace(bare, r"[,\s]+$", ""), F.lit(",")) >= width, bad)


def _schema(width: int) -> str:
    return ", ".join([f"_c{i} string" for i in range(width)] + ["_bad string"])


def _csv_options(width: int) -> dict[str, str]:
    return {"escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "maxCharsPerColumn": "-1",
            "maxColumns": str(max(20_480, 2 * width))}


def _by_line(lines: DataFrame, blocks: DataFrame, n_blocks: int, headers: DataFrame, widths: list[int]) -> DataFrame:
    """Records of the files that hold one record a line."""
    known = blocks.where(~F.col("_open")).join(F.broadcast(headers), "_header").drop("_header", "_open")      # a row a distinct header
    df = lines.join(broadcast_checked(known, n_blocks, 600), ["_file", "_block"])
    df = df.withColumn("_row", F.col("_offset") + F.col("_mono") - F.col("_first") - 1).where(F.col("_row") >= 0)
    parsed = None
    for w in sorted(set(widths)):       # one parser a width, so that only wrong records are marked
        own, record = F.size("_names") == w, _record(w)
        parsed = F.when(own, record) if parsed is None else parsed.when(own, record)
    df = df.withColumn("_r", parsed)
    keep = [c for c in df.columns if c not in ("value", "_block", "_first", "_offset", "_mono", "_r", "_row", "_names", "_at", "_file")]
    return df.select(*[F.col(f"`{c}`") for c in keep], F.col("_r.cells").alias("_cells"), "_names", "_at", F.col("_r.extra").alias("_extra"), "_file", "_row")


def _multi_line(spark: SparkSession, path: str | list[str], files: list[str], names: list[str]) -> DataFrame:
    """Records of files with quoted line breaks and one header, a task a file."""
    width = len(names)
    reader = spark.read.format("csv").schema(_schema(width)).option("header", False).option("multiLine", True).options(**_csv_options(width))
    if isinstance(path, str) and not any(c in path for c in "*?[{") and not is_single_file(files, path):
        reader = reader.option("basePath", path)        # keeps partition columns
    raw = scan(reader, files)
    row = F.struct(*[F.col(f"_c{i}") for i in range(width)])
    parts = [F.col(f"`{c}`") for c in raw.columns if c != "_bad" and c not in {f"_c{i}" for i in range(width)}]
    df = with_row_ordinal(raw.select(*parts, _cells(row, width).alias("_cells"), _surplus(F.col("_bad"), width).alias("_extra"),
                                     F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")))
    _, names, at = _header_row("", names)
    return (df.where(F.col("_row") > 0).withColumn("_row", F.col("_row") - 1)
            .withColumn("_names", F.array(*[F.lit(n) for n in names]))
            .withColumn("_at", F.struct(*[F.lit(p).cast("int").alias(f) for f, p in zip(ALIASES, at, strict=True)])))


def _first_record(spark: SparkSession, file: str) -> list[str]:
    """Header of a file whose header itself goes over several lines."""
    df = spark.read.format("csv").options(header=False, multiLine=True, escape='"').option("globPaths", "false").load([file])
    row = df.first()
    return distinct_names([(c or f"_c{i}").lstrip(BOM) for i, c in enumerate(row or [])])


def read_csv_cells(spark: SparkSession, path: str | list[str], multi_line: bool | None = None) -> DataFrame:
    """All records of an input (see the module). ``multi_line``: None decides by the quotes of each file, True
    reads every file as one that may hold quoted line breaks, False none."""
    return _read(spark, path, multi_line)[0]


def _read(spark: SparkSession, path: str | list[str], multi_line: bool | None) -> tuple[DataFrame, list[list[str]]]:
    """The records, and the distinct headers."""
    lines = _lines(spark, path)
    blocks = _blocks(spark, lines)
    if multi_line is not None:
        blocks = blocks.withColumn("_open", F.lit(bool(multi_line)))
    found = blocks.groupBy("_header", "_open").agg(F.countDistinct("_file").alias("files"), F.min("_file").alias("one"), F.count(F.lit(1)).alias("blocks")).collect()
    n_files = sum(r["files"] for r in found)
    many = F.lit(not is_single_file([r["one"] for r in found], path) if n_files == 1 else True)
    if any(r["_header"] is None for r in found):
        raise ValueError(f"no header in the first block of {next(r['one'] for r in found if r['_header'] is None)}")
    closed = [r for r in found if not r["_open"]]
    rows = [_header_row(r["_header"], parse_header(r["_header"])) for r in closed]
    n_blocks = sum(r["blocks"] for r in found)
    frames, headers = [], [r[1] for r in rows]
    if closed or not found:
        table = spark.createDataFrame(rows, _HEADER_SCHEMA)
        frames.append(_by_line(lines, blocks, n_blocks, table, [len(r[1]) for r in rows] or [1]))
    for r in (r for r in found if r["_open"]):
        files = sorted(x["_file"] for x in blocks.where(F.col("_open") & (F.col("_header") == r["_header"])).select("_file").distinct().collect())
        if r["_header"].count('"') % 2:
            groups: dict[tuple, list[str]] = {}
            for f in files:     # the header itself goes over lines: each file says its own
                groups.setdefault(tuple(_first_record(spark, f)), []).append(f)
        else:
            groups = {tuple(parse_header(r["_header"])): files}
        for names, group in groups.items():
            headers.append(list(names))
            frames.append(_multi_line(spark, path, group, list(names)))
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames).withColumn("_many", many)
    parts = [c for c in out.columns if c not in _RECORD]
    return out.select(*[F.col(f"`{c}`") for c in parts], *_RECORD), headers


def read_csv_records(spark: SparkSession, path: str | list[str], multi_line: bool | None = None) -> DataFrame:
    """All rows of an input with a column for every header name (NULL where a file lacks it), ``_file`` and ``_row``.

    Names that differ only in letter case are told apart like repeats, since Spark's columns would not be."""
    df, headers = _read(spark, path, multi_line)
    names = list(dict.fromkeys(n for h in headers for n in h))
    shown = distinct_names(names, str.lower)
    if len({tuple(h) for h in headers}) == 1:
        cell = lambda n: F.col("_cells")[headers[0].index(n)]
    else:
        cell = lambda n: F.try_element_at("_cells", F.nullif(F.array_position("_names", F.lit(n)), F.lit(0)).cast("int"))
    parts = [c for c in df.columns if c not in _RECORD]
    return df.select(*[cell(n).alias(s) for n, s in zip(names, shown, strict=True)], *[F.col(f"`{c}`") for c in parts], "_file", "_row")
