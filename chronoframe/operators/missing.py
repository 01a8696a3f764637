"""Missing-data profiling (one aggregate pass per question)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import _cols


def _null(c: str) -> F.Column:
    # NULL is the only missing marker (NaN is normalised to NULL on ingest)
    return F.col(c).isNull()


def normalise_nan(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """NaN -> NULL for floating columns (pandas uses NaN as its missing marker)."""
    fl = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}
    cols = [c for c in (cols or df.columns) if c in fl]
    return df.select(*[F.nanvl(F.col(c), F.lit(None).cast("double")).alias(c) if c in cols else F.col(c)
                       for c in df.columns])


def missing_indices(df: DataFrame, cols: Sequence[str], idx: str = "idx") -> DataFrame:
    """Sorted positions where any of ``cols`` is missing (M1 for one column, M2 for several)."""
    cond = None
    for c in cols:
        cond = _null(c) if cond is None else (cond | _null(c))
    return df.where(cond).select(idx).distinct().orderBy(idx)


def missing_profile(df: DataFrame, cols: Sequence[str], moderate: float = 0.2) -> DataFrame:
    """Per column: rows, missing count, missing share and tier
    ('none' = 0, 'moderate' <= 0.2, 'high' > 0.2).  One aggregate pass."""
    row = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[F.count_if(_null(c)).alias(f"m{i}") for i, c in enumerate(cols)])
    stack = F.explode(F.array(*[
        F.struct(F.lit(c).alias("variable"), F.lit(i).alias("ordinal"), F.col(f"m{i}").alias("n_missing"))
        for i, c in enumerate(cols)]))
    out = row.select(F.col("_n").alias("n_rows"), stack.alias("s")).select(
        "s.variable", "s.ordinal", "n_rows", "s.n_missing")
    share = F.try_divide(F.col("n_missing").cast("double"), F.col("n_rows").cast("double"))
    return out.select(
        "variable", F.col("ordinal").cast("int").alias("ordinal"), F.col("n_rows").cast("long").alias("n_rows"),
        F.col("n_missing").cast("long").alias("n_missing"), share.alias("missing_share"),
        F.when(F.col("n_missing") == 0, "none").when(share <= moderate, "moderate").otherwise("high").alias("tier"))


def missing_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Columns with at least one missing value (M3); the complement is M11."""
    return missing_profile(df, cols).where(F.col("n_missing") > 0).select("variable", "n_missing")


def has_missing(df: DataFrame, cols: Sequence[str]) -> bool:
    """M4: any missing value among ``cols``."""
    return bool(df.agg(F.bool_or(F.array_contains(F.array(*[_null(c) for c in cols]), True))).first()[0])


def column_summary(df: DataFrame, cols: Sequence[str] | None = None, approx: bool = False, subject: str | None = None,
                   subject_ids=None, decimals: int | None = None) -> DataFrame:
    """Per column: observations, missing, missing share, distinct non-null, distinct share (M9).
    With ``subject`` and ``subject_ids`` over those subjects' rows; ``decimals`` rounds the shares.

    Shares use all rows as denominator.  Exact distinct counts are several
    ``count(DISTINCT)`` in one aggregate (Spark expands once and shuffles
    (column, value) pairs after a partial aggregate); ``approx=True`` uses
    HyperLogLog sketches instead."""
    cols = list(cols or df.columns)
    if subject is not None and subject_ids is not None:
        df = get_subject(df, subject, subject_ids)

    def share(x):
        x = F.try_divide(x.cast("double"), n)
        return x if decimals is None else F.round(x, decimals)
    dist = F.approx_count_distinct if approx else F.count_distinct
    row = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[F.count_if(_null(c)).alias(f"m{i}") for i, c in enumerate(cols)],
                 *[dist(F.col(c)).alias(f"d{i}") for i, c in enumerate(cols)])
    stack = F.explode(F.array(*[
        F.struct(F.lit(c).alias("variable"), F.col(f"m{i}").cast("long").alias("n_missing"),
                 F.col(f"d{i}").cast("long").alias("n_distinct")) for i, c in enumerate(cols)]))
    out = row.select(F.col("_n").cast("long").alias("observations"), stack.alias("s"))
    n = F.col("observations").cast("double")
    return out.select(
        "s.variable", "observations", "s.n_missing",
        share(F.col("s.n_missing")).alias("missing_share"),
        "s.n_distinct", share(F.col("s.n_distinct")).alias("distinct_share"))


def subject_missing(df: DataFrame, subject: str, cols: Sequence[str]) -> DataFrame:
    """M8: per subject, rows, missing cells per column and whether any is missing."""
    aggs = [F.count(F.lit(1)).cast("long").alias("n_rows")]
    aggs += [F.count_if(_null(c)).cast("long").alias(f"n_missing_{c}") for c in cols]
    aggs += [F.bool_or(F.array_contains(F.array(*[_null(c) for c in cols]), True)).alias("any_missing")]
    return df.groupBy(subject).agg(*aggs)


def drop_high_missing(df: DataFrame, subject: str | None, threshold: float = 0.3) -> DataFrame:
    """Drop columns whose missing share exceeds ``threshold`` (subject column kept)."""
    cols = [c for c in df.columns if c != subject]
    prof = {r["variable"]: r["missing_share"] for r in missing_profile(df, cols).collect()}
    return df.drop(*[c for c, s in prof.items() if s is not None and s > threshold])


def subjects(df: DataFrame, subject: str) -> DataFrame:
    """Distinct subject ids."""
    return df.select(subject).where(F.col(subject).isNotNull()).distinct()


def get_subject(df: DataFrame, subject: str, subject_ids, subjects_df: DataFrame | None = None) -> DataFrame:
    """Rows of the chosen subjects, all-NULL rows dropped.  A list of
    ids becomes ``isin``; a DataFrame of ids a semi join."""
    if subjects_df is not None:
        from .validate import maybe_broadcast
        out = df.join(maybe_broadcast(subjects_df.select(subject).distinct()), subject, "left_semi")
    else:
        ids = _cols(subject_ids) if not isinstance(subject_ids, (int, float)) else [subject_ids]
        out = df.where(F.col(subject).isin(ids))
    return out.dropna(how="all")


def inject_missing(df: DataFrame, cols: Sequence[str], n: int, seed: int = 0, idx: str = "idx") -> DataFrame:
    """Blank ``n`` distinct positions (all of ``cols``), chosen by the
    order of ``xxhash64(idx, seed)`` -- deterministic and reproducible, unlike
    drawing positions on the driver.  The limit is the feature here (a sample
    of positions); the positions are joined back, broadcast while small."""
    pick = df.select(idx).orderBy(F.xxhash64(F.col(idx), F.lit(seed)), idx).limit(n).withColumn("_blank", F.lit(True))
    from .validate import maybe_broadcast
    j = df.join(maybe_broadcast(pick), idx, "left")
    return j.select(*[F.when(F.col("_blank"), F.lit(None)).otherwise(F.col(c)).alias(c) if c in cols else F.col(c)
                      for c in df.columns])
