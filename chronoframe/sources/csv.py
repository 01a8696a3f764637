"""CSV sources and sinks for ordered tables.

Row order is time, so every reader attaches the file position (file name,
offset order via ``monotonically_increasing_id`` right after the scan) and
turns it into a dense ``idx`` with ``dense_index`` -- no single-partition
sort.  Writers sort by the order columns and write in parallel; a single
file only on request."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.missing import normalise_nan
from ..operators.ordering import dense_index
from ..operators.validate import require

CANDIDATES = (",", ";", "\t")
POSITION = ["_folder", "_part", "_file", "_pos"]


def infer_delimiter(spark: SparkSession, path: str, candidates: Sequence[str] = CANDIDATES) -> str:
    """The candidate that splits every line into the same number (> 1) of
    fields, preferring more fields.  Text in double quotes is left out of the
    count.  A table of one column has none of the candidates: comma.  If one
    occurs, but none splits the lines evenly, that is a ValueError.  One
    aggregate over the text lines."""
    lines = spark.read.text(path).where(F.length("value") > 0).select(
        F.regexp_replace("value", r'"([^"]|"")*"', "").alias("value"))
    aggs = []
    for i, c in enumerate(candidates):
        n = F.size(F.split(F.col("value"), _regex_escape(c)))
        aggs += [F.min(n).alias(f"lo{i}"), F.max(n).alias(f"hi{i}")]
    r = lines.agg(*aggs).first()
    best = None
    for i, c in enumerate(candidates):
        lo, hi = r[f"lo{i}"], r[f"hi{i}"]
        if lo is not None and lo == hi and lo > 1 and (best is None or lo > best[0]):
            best = (lo, c)
    if best is None and any((r[f"hi{i}"] or 0) > 1 for i in range(len(candidates))):
        raise ValueError(f"no delimiter among {list(candidates)} splits every line into the same number of fields")
    return best[1] if best else ","


def _regex_escape(c: str) -> str:
    return "\\t" if c == "\t" else ("\\" + c if c in ".^$|?*+()[]{}\\" else c)


def _with_position(df: DataFrame) -> DataFrame:
    # file order: (folder, number of the part file, name, position in file); a
    # part's number counts as a number, since part-100000 follows part-99999
    name = F.input_file_name()
    part = F.regexp_extract(name, r"part-(\d+)[^/]*$", 1)
    return df.select("*", F.regexp_extract(name, r"^(.*)/[^/]*$", 1).alias("_folder"),
                     F.when(part != "", part.cast("long")).alias("_part"), name.alias("_file"),
                     F.monotonically_increasing_id().alias("_pos"))


def read_series(spark: SparkSession, path: str, sep: str | None = None, header: bool = True,
                index_cols: Sequence[str] | None = None, schema=None, idx: str = "idx") -> DataFrame:
    """Read a time-series CSV; ``idx`` follows the index columns when
    given, else the file order.  NaN is normalised to NULL."""
    sep = sep or infer_delimiter(spark, path)
    r = spark.read.option("sep", sep).option("header", header)
    r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
    df = _with_position(r.csv(path))
    order = list(index_cols or []) + POSITION
    out = dense_index(df, order, idx=idx).drop(*POSITION)
    return normalise_nan(out)


def transpose_series(df: DataFrame, idx: str = "idx", wide: bool = False) -> DataFrame:
    """S1 ``classification=True``: one series per row becomes one per column.

    The result is long, (``idx``: position of the old column, series: the old
    ``idx``, value), for any number of rows.  ``wide`` turns every series into
    a column named after its old ``idx``; that is for tables whose rows may
    become columns."""
    cols = [c for c in df.columns if c != idx]
    long = df.select(idx, *[F.col(c).cast("double") for c in cols]).unpivot([idx], cols, "_col", "value")
    mapping = F.create_map(*[x for i, c in enumerate(cols) for x in (F.lit(c), F.lit(i).cast("long"))])
    long = long.select(F.element_at(mapping, F.col("_col")).alias("_new"), F.col(idx).alias("series"), "value")
    if not wide:
        return long.withColumnRenamed("_new", idx)
    names = [r[0] for r in df.select(idx).orderBy(idx).collect()]       # they become column names
    out = long.groupBy("_new").pivot("series", names).agg(F.first("value"))
    return out.select(F.col("_new").alias(idx), *[F.col(f"`{n}`").alias(str(n)) for n in names])


def read_longitudinal(spark: SparkSession, path: str, sep: str = ",", subject_col: str | None = None,
                      visit: str = "visit") -> DataFrame:
    """S3: longitudinal CSV; the subject is the first column unless named;
    ``visit`` = dense position of the row within its subject in file order.
    The chosen separator is honoured."""
    df = _with_position(spark.read.option("sep", sep).option("header", True).option("inferSchema", True).csv(path))
    subject_col = subject_col or df.columns[0]
    return normalise_nan(dense_index(df, POSITION, keys=[subject_col], idx=visit).drop(*POSITION))


def valid_source(paths: DataFrame, col: str = "path") -> DataFrame:
    """File names with exactly one dot, extension ``csv`` and a non-empty stem."""
    base = F.element_at(F.split(F.col(col), "/"), -1)
    return paths.withColumn("valid", base.rlike(r"^[^.]+\.csv$"))


def export_series(df: DataFrame, path: str, cols: Sequence[str] | None = None, order_by: Sequence[str] = ("idx",),
                  sep: str = ",", single_file: bool = False, with_index: bool = False) -> None:
    """Project columns and write CSV with a header, sorted by the order
    columns (parallel part files; one file only when asked)."""
    cols = list(cols or [c for c in df.columns if c not in order_by])
    extra = [c for c in order_by if c not in cols]
    out = df.select(*(extra if with_index else []), *cols, *([] if with_index else extra)).orderBy(*order_by)
    if not with_index:
        out = out.drop(*extra)
    if single_file:
        out = out.coalesce(1)
    out.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def snapshot(df: DataFrame, path: str) -> None:
    """Parquet snapshot of a dataset version (DataFrames are immutable;
    'revert' is re-reading an earlier snapshot)."""
    df.write.mode("overwrite").parquet(path)


def load_snapshot(spark: SparkSession, path: str, order_by: Sequence[str] = ("idx",)) -> DataFrame:
    return spark.read.parquet(path).orderBy(*order_by)


def subject_options(df: DataFrame, subject: str, add_all: bool = False) -> DataFrame:
    """The distinct subjects as options, and with ``add_all`` one for all of them."""
    subs = df.select(F.col(subject).cast("string").alias("option"), F.lit(False).alias("is_all")).where(F.col("option").isNotNull()).distinct()
    return subs.unionByName(df.sparkSession.range(1).select(F.lit("all").alias("option"), F.lit(True).alias("is_all"))) if add_all else subs


def catalog(df: DataFrame, subject: str | None = None, defaults: int = 5) -> tuple[DataFrame, DataFrame | None]:
    """Columns with ordinal and default-selection flag (first five),
    and the distinct subjects when a subject column is given."""
    spark = df.sparkSession
    cols = spark.createDataFrame([(c, i, i < defaults, t) for i, (c, t) in enumerate(df.dtypes)],
                                 "column string, ordinal int, is_default boolean, type string")
    subs = df.select(subject).where(F.col(subject).isNotNull()).distinct() if subject else None
    return cols, subs


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's shared checkpoint directory."""
    import uuid
    from ..session import ensure_checkpoint_dir
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex}")
