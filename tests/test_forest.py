"""Forests from counts: bins, one tree, the bootstrap, and the agreement with pyspark.ml."""
import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from chronoframe.operators import forest as fo
from chronoframe.operators import learn as ln


def _planted(n, seed):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=n), rng.integers(0, 50, n).astype(float)
    y = np.where(a > 0.3, 10.0, 0.0) + np.where(b > 20, 5.0, 0.0) + rng.normal(scale=0.5, size=n)
    return pd.DataFrame({"id": np.arange(n), "a": a, "b": b, "y": y, "c": (y > 4).astype(float) + (y > 9)})


def test_bins(spark):
    assert fo.bin_cuts([3.0, 1.0, 1.0, 2.0]) == [1.5, 2.5] and fo.bin_cuts([]) == [] and fo.bin_cuts([7.0] * 9) == []
    cuts = fo.bin_cuts(np.arange(3200.0))
    assert len(cuts) == 31 and np.allclose(np.diff(cuts), 100, atol=2)
    df = spark.createDataFrame([(0, -1e9), (1, 1.5), (2, 1.6), (3, 2.6), (4, float("nan")), (5, None)], "id long, x double")
    got = [r.bin for r in df.select("id", fo.bin_of(F.col("x"), [1.5, 2.5]).alias("bin")).orderBy("id").collect()]
    assert got == [0, 0, 1, 2, 2, 2]             # a missing value is in the last bin


def test_grown_tree():
    bins = np.array([[0, 0], [0, 1], [1, 0], [1, 1]])
    stats = np.array([[2.0, 2.0], [2.0, 4.0], [2.0, 20.0], [2.0, 40.0]])      # weight, weight * y
    feature, cut, sums = fo.grow(bins, stats, [2, 2], 0, 2, np.random.default_rng(0))
    assert feature[1] == 0 and cut[1] == 0 and sums[1].tolist() == [8.0, 66.0]
    leaf = fo.leaf_sums(bins, feature, cut, sums)
    assert (leaf[:, 1] / leaf[:, 0]).tolist() == [1.0, 2.0, 10.0, 20.0]
    # both sides name class 0: the split is taken back, as in pyspark.ml
    feature, _, sums = fo.grow(np.array([[0], [1]]), np.array([[9.0, 1.0], [5.0, 4.0]]), [2], 2, 1, np.random.default_rng(0))
    assert feature[1] == -1 and sums[1].tolist() == [14.0, 5.0]


@pytest.mark.parametrize("label, ml", [("y", RandomForestRegressor), ("c", RandomForestClassifier)])
def test_agrees_with_pyspark_ml(spark, label, ml):
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(spark.createDataFrame(_planted(4000, 1))).cache()
    theirs = ml(featuresCol="features", labelCol=label, numTrees=30, seed=5)
    ours = fo.CountedForest(label, ["a", "b"], 3 if label == "c" else 0, 30, 5, None)
    x, y = (f.fit(df).transform(df).select("id", label, "prediction").orderBy("id").toPandas() for f in (theirs, ours))
    if label == "c":
        assert (x.prediction == y.prediction).mean() > 0.97
        assert abs((x.prediction == x.c).mean() - (y.prediction == y.c).mean()) < 0.01
    else:
        assert np.corrcoef(x.prediction, y.prediction)[0, 1] > 0.99
        errors = [((p.prediction - p.y) ** 2).mean() for p in (x, y)]
        assert errors[1] < 1.25 * errors[0]


def test_every_row_is_drawn_for_itself(spark):
    """One cell only: a tree answers with the mean of its bootstrap, whose spread is that of
    1,000 rows drawn one by one and not that of two labels drawn as a whole."""
    df = spark.range(1000).select(F.lit(1.0).alias("a"), (F.col("id") % 2).cast("double").alias("y"))
    got = [fo.CountedForest("y", ["a"], 0, 1, s, None).fit(df).prediction[0] for s in range(6)]
    assert np.std(got) < 0.05 and np.ptp(got) > 0


def test_wide_features_go_to_pyspark_ml(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame(pd.DataFrame(rng.normal(size=(300, 5)), columns=list("abcdy")))

    class Other:
        def fit(self, train):
            return train.count()
    assert fo.CountedForest("y", list("abcd"), 0, 50, 1, Other()).fit(df) == 300


def test_forest_impute_from_counts(spark, monkeypatch):
    """Tall tables take no pass of all rows per tree level: pyspark.ml's forests are not asked."""
    pdf = _planted(3000, 2)[["id", "a", "b", "y", "c"]]
    pdf["c"] = pdf.c.map({0.0: "low", 1.0: "mid", 2.0: "high"})
    hidden = pdf[["y", "c"]].copy()
    pdf.loc[::7, "y"], pdf.loc[::11, "c"] = np.nan, None
    kinds = "id long, a double, b double, y double, c string"
    rows = [tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r) for r in pdf.itertuples(index=False)]

    def never(*_):
        raise AssertionError("a pass over all rows per tree level")
    for ml in (RandomForestRegressor, RandomForestClassifier):
        monkeypatch.setattr(ml, "fit", never)
    df = spark.createDataFrame(rows, kinds)
    out = [ln.forest_impute(df.repartition(n), ["c", "y", "a"], ["c"], max_iter=1, num_trees=10, counted_from=1000)
           .orderBy("id").toPandas() for n in (1, 5)]
    got = out[0]
    assert len(got) == 3000 and got.notna().all().all() and list(got.columns) == list(pdf.columns)
    known = pdf.y.notna()
    assert (got.y[known] == pdf.y[known]).all() and (got.c[pdf.c.notna()] == pdf.c[pdf.c.notna()]).all()
    assert (got.c == hidden.c)[pdf.c.isna()].mean() > 0.85
    assert np.abs(got.y - hidden.y)[~known].mean() < 1.5
    assert np.allclose(got.y, out[1].y) and (got.c == out[1].c).all()      # whatever the partitions
    with pytest.raises(AssertionError, match="per tree level"):
        ln.forest_impute(df, ["c", "y", "a"], ["c"], max_iter=1, num_trees=2, counted_from=10_000)
