"""Row validation: every row is kept, marked valid or not, with its list of errors.

The whole rule set is one column expression (``array_compact(array(when ...))``), so
validation is a narrow projection: no shuffle, no Python, fused into codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Error texts of the rule set, as stored in ``validation_errors``.
MISSING_TIMESTAMP = "missing required timestamp"
NOT_NEGATIVE = "must be non-negative"
ORDER = "departure must be after arrival"
POSITIVE = "must be positive"

# Errors of our own, for what the reader had to mend so that the row could be kept.
SURPLUS_CELLS = "more cells than the header"
OUT_OF_RANGE = "out of range"

# Fields checked for negative values, in the order their errors are listed.
NON_NEGATIVE_FIELDS = ("energy_requested_kwh", "energy_delivered_kwh", "max_charge_rate_kw",
                       "average_charge_rate_kw", "charging_duration_minutes")


def _err(field: str, message: str) -> Column:
    return F.struct(F.lit(field).alias("field"), F.lit(message).alias("error"))


def notes(*found: tuple[Column, str, str]) -> Column:
    """The ``_notes`` of a normaliser: errors (condition, field, message) that only the raw record shows."""
    return F.array_compact(F.array(*[F.when(c, _err(f, m)) for c, f, m in found]))


def _rules(columns: list[str] | None) -> list[tuple[Column, str, str]]:
    """(condition, field, message) in the order errors are listed. A rule fires when its
    condition is TRUE (NULL does not fire). Absent optional fields never fire."""
    present = set(columns) if columns is not None else None

    def has(c: str) -> bool:
        return present is None or c in present

    arr, dep = F.col("arrival_ts"), F.col("departure_ts")
    dur = F.col("session_duration_minutes") if has("session_duration_minutes") else F.lit(None).cast("int")
    rules = [
        (arr.isNull(), "arrival_ts", MISSING_TIMESTAMP),
        (dep.isNull(), "departure_ts", MISSING_TIMESTAMP),
        (dep <= arr, "departure_ts", ORDER),
        (dur.isNull() | (dur <= 0), "session_duration_minutes", POSITIVE),
    ]
    rules += [(F.col(n) < 0, n, NOT_NEGATIVE) for n in NON_NEGATIVE_FIELDS if has(n)]
    return rules


def error_list(columns: list[str] | None = None) -> Column:
    """The ordered error list of one row: arrival, departure, order, duration, then the
    non-negative fields. Fields absent from ``columns`` are treated as NULL (no error)."""
    return F.array_compact(F.array(*[F.when(c, _err(f, m)) for c, f, m in _rules(columns)]))


def is_valid_expr(columns: list[str] | None = None) -> Column:
    """The verdict as a plain predicate (no error array is built to filter on it)."""
    ok = F.lit(True)
    for cond, _f, _m in _rules(columns):
        ok = ok & ~F.coalesce(cond, F.lit(False))
    return ok


def validate(sessions: DataFrame) -> DataFrame:
    """Set ``is_valid`` and ``validation_errors`` on every row; other columns untouched. A normaliser's
    ``_notes``, if there, come after the rules' errors.

    Both are independent projections: a consumer filtering on ``is_valid`` evaluates a
    boolean predicate only, and the error list is pruned away unless it is read."""
    cols = sessions.columns
    errors, ok = error_list(cols), is_valid_expr(cols)
    if "_notes" in cols:
        errors, ok = F.concat(errors, F.col("_notes")), ok & (F.size("_notes") == 0)
    return sessions.withColumn("validation_errors", errors).withColumn("is_valid", ok)


def errors_text(errors: Column | str = "validation_errors") -> Column:
    """'field:error|field:error' — a flat text form of the error list (for reports/compare)."""
    e = F.col(errors) if isinstance(errors, str) else errors
    return F.array_join(F.transform(e, lambda x: F.concat(x["field"], F.lit(":"), x["error"])), "|")


def ingest_counts(validated: DataFrame) -> DataFrame:
    """One row: records seen and records invalid (a single aggregation pass)."""
    return validated.agg(
        F.count(F.lit(1)).alias("records_seen"),
        F.count_if(~F.col("is_valid")).alias("records_invalid"),
    )
