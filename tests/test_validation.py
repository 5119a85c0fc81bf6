"""Cross-validated models against single fits."""

import pytest
from pyspark.sql import functions as F

from quaymark.operators import learning, preparation, sampling
from quaymark.plans import preparing, serving


def test_folds_equal_single_fits(spark, sf_dir):
    rows = serving.mislabelled(preparing.hard_rows(preparing.Tables(spark, sf_dir)).drop("split")).persist()
    folded = sampling.folds(rows, "y", "row", 3).drop("row").persist()
    columns = preparation.FEATURES
    got = {r["fold"]: r for r in learning.cross_validated(folded, learning.logistic(columns), 3).collect()}
    assert set(got) == {0, 1, 2}
    weighed = learning.balanced(folded)
    for k in (0, 2):
        model = learning.logistic(columns).fit(weighed.where(F.col("fold") != k))
        one = learning.report(learning.probabilities(model, weighed.where(F.col("fold") == k)).select("y", "p")).first()
        assert {c: got[k][c] for c in one.asDict()} == pytest.approx(one.asDict(), abs=1e-6)
    mean = {r["metric"]: r for r in learning.summary(spark.createDataFrame(list(got.values())), ["f1"]).collect()}["f1"]
    assert mean["n"] == 3 and mean["mean"] == pytest.approx(sum(r["f1"] for r in got.values()) / 3, abs=1e-5) and mean["low"] < mean["mean"] < mean["high"]


def test_query(spark, sf_dir):
    got = {r["metric"]: r for r in serving.QUERIES["cross_validation"](spark, sf_dir).collect()}
    assert set(got) == {"accuracy", "precision", "recall", "f1", "roc_auc"} and all(r["n"] == 5 for r in got.values()) and got["roc_auc"]["mean"] > 0.55


def test_a_model_a_fold_and_no_more(spark, sf_dir, monkeypatch):
    """A model of all rows, which nothing reads, was fitted too, after an evaluation of each fold that nothing reads."""
    fitted, plain = [], learning.LogisticRegression._fit
    monkeypatch.setattr(learning.LogisticRegression, "_fit", lambda self, rows: fitted.append(self.uid) or plain(self, rows))
    rows = spark.range(60).select((F.col("id") % 2).cast("int").alias("y"), (F.col("id") % 3).cast("int").alias("fold"), (F.col("id") % 7 + F.col("id") % 2).cast("double").alias("x"))
    assert learning.cross_validated(rows, learning.logistic(["x"]), 3).count() == 3 and len(fitted) == 3
