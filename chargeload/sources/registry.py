"""Source registry (A3, A4, A6): dataset name → (reader, normaliser).

A source is two plain functions. ``load`` composes them, checks the output contract and
returns canonical SESSION columns (validated) plus ``_file``/``_row`` for ordering.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chargeload.operators.quality import validate
from chargeload.schemas import REQUIRED_COLUMNS, SESSION, SESSION_COLUMNS
from chargeload.sources import csv_sessions, json_sessions, readers

#: Source order of a record: its file, and its place in the file.
ORDER_COLUMNS = ("_file", "_block", "_row")


@dataclass(frozen=True)
class SessionSource:
    """``read`` takes a path or a list of files and returns one frame of raw records, or a
    list of frames that are normalised one by one (files with different headers).
    ``prefixed``: every session id starts with the dataset name and a hyphen, which is
    checked on load; only then may an insert look for stored ids in this dataset alone."""

    dataset_name: str
    read: Callable[[SparkSession, str], DataFrame | list[DataFrame]]
    normalize: Callable[[DataFrame], DataFrame]
    prefixed: bool = False

    def load_and_normalize(self, spark: SparkSession, path: str | list[str]) -> DataFrame:
        records = self.read(spark, path)
        frames = [self.normalize(r) for r in (records if isinstance(records, list) else [records])]
        return reduce(DataFrame.unionByName, frames)

    def load(self, spark: SparkSession, path: str | list[str]) -> DataFrame:
        """Canonical, validated sessions with ``_file`` and the order columns kept last."""
        df = self.load_and_normalize(spark, path)
        check_contract(df)
        if self.prefixed:
            ok = F.startswith(F.col("session_id"), F.lit(f"{self.dataset_name}-"))
            wrong = F.raise_error(F.concat(F.lit("session id without its dataset prefix: "), F.col("session_id")))
            df = df.withColumn("session_id", F.when(F.col("session_id").isNull() | ok, F.col("session_id")).otherwise(wrong))
        for f in SESSION.fields:
            if f.name not in df.columns and f.name not in ("is_valid", "validation_errors"):
                df = df.withColumn(f.name, F.lit(None).cast(f.dataType))
        df = validate(df)
        extra = [c for c in ORDER_COLUMNS if c in df.columns]
        return df.select(*[F.col(f.name).cast(f.dataType) for f in SESSION.fields], *extra)


def check_contract(df: DataFrame) -> None:
    missing = [c for c in REQUIRED_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"normalized sessions lack required columns: {missing}")


_REGISTRY: dict[str, SessionSource] = {
    "acn": SessionSource("acn", lambda spark, path: readers.read_json_records(spark, path),
                         lambda df: json_sessions.normalize_json_sessions(df, "acn"), prefixed=True),
    "urbanev": SessionSource("urbanev", readers.read_csv_cells,
                             lambda df: csv_sessions.normalize_csv_sessions(df, "urbanev"), prefixed=True),
}


def register_loader(source: SessionSource) -> None:
    _REGISTRY[source.dataset_name] = source


def unregister_loader(dataset_name: str) -> None:
    _REGISTRY.pop(dataset_name, None)


def get_loader(dataset_name: str) -> SessionSource:
    source = _REGISTRY.get(dataset_name)
    if source is None:
        available = ", ".join(sorted(_REGISTRY))
        raise ValueError(f"Unknown dataset '{dataset_name}'. Available: {available}")
    return source


def list_loaders() -> list[str]:
    return sorted(_REGISTRY)


__all__ = ["SESSION_COLUMNS", "SessionSource", "check_contract", "get_loader", "list_loaders", "register_loader", "unregister_loader"]
