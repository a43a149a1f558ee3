"""Attaching a one-row result (a global aggregate) to every row of another frame.

Done as a scalar subquery, not a join: Spark runs the one-row plan once and uses its
value as a constant in the projection. A struct carries several columns in one
subquery (identical subqueries are reused, so it is computed once).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """``df`` plus the columns of ``one_row`` (which must hold at most one row; with
    none, the attached columns are NULL)."""
    value = one_row.select(F.struct(*[F.col(c) for c in one_row.columns]).alias("_row")).scalar()
    return df.select("*", *[value.getField(c).alias(c) for c in one_row.columns])
