"""CSV sources: delimiter inference, index columns, NaN handling, file-name check."""
import numpy as np
import pandas as pd
import pytest

from chronoframe.sources import csv as cs


@pytest.mark.parametrize("sep", [",", ";", "\t"])
def test_read_series_infers_separator(spark, tmp_path, sep):
    pdf = pd.DataFrame({"a": [1.0, 2.5, None, 4.0], "b": [10, 20, 30, 40]})
    p = tmp_path / f"s{ord(sep)}.csv"
    pdf.to_csv(p, sep=sep, index=False)
    assert cs.infer_delimiter(spark, str(p)) == sep
    got = cs.read_series(spark, str(p)).toPandas().sort_values("idx")
    assert got.idx.tolist() == [0, 1, 2, 3]
    assert got.b.tolist() == [10, 20, 30, 40]
    assert got.a.isna().tolist() == [False, False, True, False]


def test_index_columns_define_order(spark, tmp_path):
    pdf = pd.DataFrame({"when": [3, 1, 2], "x": [30.0, 10.0, 20.0]})
    p = tmp_path / "idx.csv"
    pdf.to_csv(p, index=False)
    got = cs.read_series(spark, str(p), index_cols=["when"]).toPandas().sort_values("idx")
    assert got.x.tolist() == [10.0, 20.0, 30.0]


def test_nan_text_becomes_null(spark, tmp_path):
    p = tmp_path / "nan.csv"
    p.write_text("x,y\n1.0,NaN\n2.0,3.0\n")
    got = cs.read_series(spark, str(p)).toPandas().sort_values("idx")
    assert got.y.isna().tolist() == [True, False]


def test_longitudinal_visits_per_subject(spark, tmp_path):
    p = tmp_path / "ld.csv"
    p.write_text("sid;v\n1;a\n2;b\n1;c\n1;d\n2;e\n")
    got = cs.read_longitudinal(spark, str(p), sep=";").toPandas()
    got = got.sort_values(["sid", "visit"])
    assert got.v.tolist() == ["a", "c", "d", "b", "e"]
    assert got.visit.tolist() == [0, 1, 2, 0, 1]


def test_valid_source(spark):
    df = spark.createDataFrame([("/x/data.csv",), ("/x/a.b.csv",), ("/x/.csv",), ("/x/data.txt",)], "path string")
    got = {r["path"]: r["valid"] for r in cs.valid_source(df).collect()}
    assert got == {"/x/data.csv": True, "/x/a.b.csv": False, "/x/.csv": False, "/x/data.txt": False}


def test_transpose(spark):
    df = spark.createDataFrame([(0, 1.0, 2.0), (1, 3.0, 4.0), (2, 5.0, 6.0)], "idx long, a double, b double")
    got = cs.transpose_series(df, wide=True).toPandas().sort_values("idx")
    assert got["0"].tolist() == [1.0, 2.0] and got["2"].tolist() == [5.0, 6.0]
    long = {(r["idx"], r["series"]): r["value"] for r in cs.transpose_series(df).collect()}
    assert long[0, 2] == 5.0 and long[1, 0] == 2.0 and len(long) == 6


def test_part_numbers_order_as_numbers(spark, tmp_path):
    for i, name in enumerate(["part-99999-a.csv", "part-100000-a.csv", "part-100001-a.csv"]):
        (tmp_path / name).write_text(f"x\n{i}\n")
    got = cs.read_series(spark, str(tmp_path), sep=",").orderBy("idx").toPandas()
    assert got.x.tolist() == [0, 1, 2]


def test_delimiter_inside_quotes(spark, tmp_path):
    p = tmp_path / "q.csv"
    p.write_text('a;b\n"x;y";1\n"z";2\n')
    assert cs.infer_delimiter(spark, str(p)) == ";"
    assert cs.read_series(spark, str(p)).columns[:2] == ["a", "b"]
    (tmp_path / "u.csv").write_text("a;b\n1;2;3\n")
    with pytest.raises(ValueError):
        cs.infer_delimiter(spark, str(tmp_path / "u.csv"))
    (tmp_path / "one.csv").write_text("a\n1\n")
    assert cs.infer_delimiter(spark, str(tmp_path / "one.csv")) == ","


def test_snapshot_roundtrip_and_catalog(spark, tmp_path):
    df = spark.createDataFrame([(2, 20.0), (0, 0.0), (1, 10.0)], "idx long, x double")
    p = str(tmp_path / "snap")
    cs.snapshot(df, p)
    back = cs.load_snapshot(spark, p).toPandas().sort_values("idx")
    assert back.x.tolist() == [0.0, 10.0, 20.0]
    wide = spark.createDataFrame([(1, 1, 2, 3, 4, 5, 6)], "s long, a long, b long, c long, d long, e long, f long")
    cols, subs = cs.catalog(wide, subject="s")
    c = cols.toPandas()
    assert c.is_default.tolist() == [True] * 5 + [False] * 2 and subs.count() == 1


def test_get_subject_and_apply_imputation(spark):
    from chronoframe.operators import impute as im
    from chronoframe.operators import missing as ms
    df = spark.createDataFrame([(1, 0, None), (1, 1, 2.0), (2, 0, 3.0), (3, 0, None)], "s long, v long, x double")
    sel = ms.get_subject(df, "s", [1, 3]).toPandas()
    assert sorted(sel.s.unique().tolist()) == [1, 3]
    subs = spark.createDataFrame([(2,)], "s long")
    assert ms.get_subject(df, "s", None, subjects_df=subs).count() == 1
    imp = spark.createDataFrame([(1, 0, 9.0)], "s long, v long, x double")
    out = im.apply_imputation(df, imp, ["x"], idx="v", keys=["s"]).toPandas().set_index(["s", "v"])
    assert out.loc[(1, 0), "x"] == 9.0 and out.loc[(2, 0), "x"] == 3.0 and np.isnan(out.loc[(3, 0), "x"])
