"""Wide / long layout conversions and resampling of irregular events into a
regular series (``idx`` = bucket number from the first bucket)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .validate import bounded_distinct

_UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def _seconds(t: str) -> F.Column:
    # wall-clock seconds since epoch; independent of the session time zone
    return F.expr(f"timestampdiff(SECOND, {_EPOCH}, CAST(`{t}` AS TIMESTAMP_NTZ))")



def resample(df: DataFrame, ts: str, step_seconds: int, value: str, key: str | None = None,
             agg: str = "avg", values: Sequence[str] | None = None, fill_gaps: bool = True,
             max_keys: int = 1000) -> DataFrame:
    """Bucket ``ts`` into ``step_seconds`` buckets and aggregate ``value``.

    With ``key`` the result is wide: one column per key value (the pivot
    values are taken from the data behind a bound of ``max_keys``).  Buckets
    without rows are added as NULL rows when ``fill_gaps``; the grid is
    ``spark.range`` over the bucket span, so it is generated in parallel.
    Output: ``idx BIGINT`` (bucket number), ``t TIMESTAMP_NTZ``, values.
    """
    sec = _seconds(ts)
    b = df.select(F.floor(sec / F.lit(step_seconds)).cast("long").alias("_bucket"),
                  *( [F.col(key)] if key else []), F.col(value).cast("double").alias("_v"))
    aggf = {"avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count}[agg]
    if key:
        vals = list(values) if values is not None else bounded_distinct(df, key, max_keys)
        # conditional aggregates: one shuffle on the bucket, partial aggregation
        # before it (a pivot would aggregate twice)
        def one(v):
            hit = F.col(key) == F.lit(v)
            if agg == "count":
                n = F.count_if(hit)
                return F.when(n > 0, n)
            return aggf(F.when(hit, F.col("_v")))
        g = b.groupBy("_bucket").agg(*[one(v).alias(str(v)) for v in vals])
        out_cols = [str(v) for v in vals]
    else:
        g = b.groupBy("_bucket").agg(aggf("_v").alias(value))
        out_cols = [value]
    g = cut_lineage(g)                          # one row per bucket: the events are read once
    lo_hi = g.agg(F.min("_bucket").alias("lo"), F.max("_bucket").alias("hi")).first()
    lo, hi = lo_hi["lo"], lo_hi["hi"]
    if lo is None:
        return g.select(F.lit(None).cast("long").alias("idx"), F.lit(None).cast("timestamp_ntz").alias("t"),
                        *[F.col(c) for c in out_cols]).where(F.lit(False))
    g = g.withColumn("idx", F.col("_bucket") - F.lit(lo)).drop("_bucket")
    if fill_gaps:
        grid = df.sparkSession.range(0, hi - lo + 1).withColumnRenamed("id", "idx")
        g = grid.join(g, "idx", "left")
    g = g.withColumn("_secs", (F.col("idx") + F.lit(lo)) * F.lit(step_seconds))
    t = F.expr(f"timestampadd(SECOND, _secs, {_EPOCH})")
    return g.select("idx", t.alias("t"), *[F.col(f"`{c}`").cast("double").alias(c) for c in out_cols])


def to_long(df: DataFrame, ids: Sequence[str], values: Sequence[str] | None = None,
            variable: str = "variable", value: str = "value") -> DataFrame:
    values = list(values) if values is not None else [c for c in df.columns if c not in ids]
    return df.select(*ids, *[F.col(c).cast("double").alias(c) for c in values]).unpivot(
        list(ids), values, variable, value)


def to_wide(df: DataFrame, ids: Sequence[str], variables: Sequence[str], variable: str = "variable",
            value: str = "value") -> DataFrame:
    return df.groupBy(*ids).pivot(variable, list(variables)).agg(F.first(value))
