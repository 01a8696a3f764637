"""Precondition checks (the reference's UI gates become ValueErrors) and
bounded driver-side reads of small, schema-sized results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bounded_distinct(df: DataFrame, col: str, limit: int) -> list:
    """Sorted distinct non-null values of ``col``; raises if more than ``limit``.

    Used only where the values become column names or model classes, i.e.
    where the result is schema-sized by definition."""
    rows = df.select(col).where(F.col(col).isNotNull()).distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{col} has more than {limit} distinct values")
    return sorted(r[0] for r in rows)


def require(cond: bool, msg: str) -> None:
    if not cond:
        raise ValueError(msg)


def missing_counts(df: DataFrame, cols: Sequence[str]) -> dict:
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols]).first()
    return {c: int(row[c]) for c in cols}


def require_complete(df: DataFrame, cols: Sequence[str], what: str) -> None:
    bad = {c: n for c, n in missing_counts(df, cols).items() if n}
    if bad:
        raise ValueError(f"{what} needs data without missing values; missing: {bad}")


def complete(col: Column, what: str) -> Column:
    """``col`` as double; a missing value fails the query that reads it (the
    gate costs no pass of its own)."""
    return F.coalesce(col.cast("double"), F.raise_error(F.lit(f"{what} needs data without missing values")).cast("double"))


def require_missing(df: DataFrame, cols: Sequence[str], what: str) -> None:
    if not any(missing_counts(df, cols).values()):
        raise ValueError(f"{what} needs at least one missing value")


BROADCAST_BYTES = 64 << 20


def maybe_broadcast(small: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast ``small`` only if its rows take at most ``max_bytes``; above
    that the join stays a shuffle join (AQE splits skewed partitions).  Strings
    and other values of varying size are measured, not guessed."""
    width = F.lit(16)                           # row overhead
    for f in small.schema:
        size = F.octet_length(F.col(f"`{f.name}`").cast("string"))
        width = width + F.lit(16) + F.coalesce(size, F.lit(0))
    total = small.agg(F.sum(width.cast("long"))).first()[0] or 0
    return F.broadcast(small) if total <= max_bytes else small
