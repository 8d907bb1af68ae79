"""Training path: three candidates, selection, persistence, importance, and the full decision chain."""

from __future__ import annotations

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from holdfast.config import FIXTURE
from holdfast.operators import checks, churn_data, training, validation
from holdfast.plans.engine import RetentionEngine
from holdfast.sources.star_schema import StarSchema

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def engine(spark):
    small = replace(FIXTURE, model=replace(FIXTURE.model, boosting_rounds=3, logistic_iterations=20))
    return RetentionEngine(spark, StarSchema(spark, SF_DIR).tables(), small, score_source="trained")


def test_split_is_exact_per_class(engine):
    got = {(r["churn_next_period"], r["in_test"]): r["count"] for r in engine.split.groupBy("churn_next_period", "in_test").count().collect()}
    for label in (0, 1):
        rows = got[label, True] + got[label, False]
        assert got[label, False] == rows * 3 // 4


def test_candidates_and_selection(engine):
    rows = engine.table("trained_comparison").collect()
    assert {r["model_name"] for r in rows} == {c.name for c in training.CANDIDATES}
    assert engine.best_model == max(rows, key=lambda r: (r["pr_auc"], r["roc_auc"], r["top_decile_lift"]))["model_name"]
    assert {r["feature_count"] for r in rows} == {38, 35}


def test_model_learns_a_real_signal(spark, engine):
    """The generated label is noise, so a label that follows a feature is planted."""
    frame = engine.table("model_frame").withColumn(
        churn_data.TARGET, (F.col("monthly_revenue") > 120_000).cast("int"))
    settings = replace(engine.p.model, boosting_rounds=20)  # a tree counts for a small step only
    for name in (training.LOGISTIC, training.BOOSTED):
        c = engine.candidate(name)
        scored = training.score(training.train(engine.store, c, frame, settings), frame)
        means = {r[0]: r[1] for r in scored.groupBy(churn_data.TARGET).agg(F.avg("predicted_churn_probability")).collect()}
        assert means[1] > means[0] + 0.2
    model = training.train(engine.store, engine.candidate(training.BOOSTED), frame, settings)
    gain = training.model_importance(engine.store, model, frame, engine.p.model).first()
    assert gain["feature"] == "monthly_revenue" and gain["importance_mean"] > 0.2


def test_importance_tells_very_close_scores_apart(spark, store):
    s = replace(FIXTURE.model, importance_repeats=2)
    rows = [(f"c{i:03}", int(i >= 150), [float(i), 1.0]) for i in range(200)]
    frame = spark.createDataFrame(rows, f"customer_id string, {churn_data.TARGET} int, x array<double>")
    gain = training.permutation_importance(
        store, frame, ("place", "nothing"), lambda rows: rows,
        lambda rows: rows.withColumn(training.P, 1e-9 * F.element_at("x", 1)), s,
    ).collect()
    assert [r["feature"] for r in gain] == ["place", "nothing"]
    assert gain[0]["importance_mean"] > 0.3 and gain[1]["importance_mean"] == 0


def test_importance_of_moved_rows_equals_the_full_form(spark, engine):
    """Every test row scored again for every feature and repeat, with the area from all pairs."""
    import numpy as np

    frame = engine.table("model_frame").withColumn(churn_data.TARGET, (F.col("monthly_revenue") > 120_000).cast("int"))
    s = replace(engine.p.model, boosting_rounds=4, importance_repeats=2, min_leaf_rows=10)
    model = training.train(engine.store, engine.candidate(training.BOOSTED), frame, s)
    got = {r.feature: (r.importance_mean, r.importance_std) for r in training.model_importance(engine.store, model, frame, s).collect()}
    rows = frame.select("customer_id", churn_data.TARGET, F.array(*model.columns()).alias("x")).toPandas().sort_values("customer_id")
    x, y = np.array(rows["x"].tolist()), rows[churn_data.TARGET].to_numpy()

    def area(values):
        p = 1 / (1 + np.exp(-model.fitted.margin(values)))
        gap = p[y == 1][:, None] - p[y == 0][None, :]
        return (gap > 0).mean() + (gap == 0).mean() / 2

    import hashlib

    ids = rows["customer_id"].tolist()
    for i, feature in enumerate(model.features):
        lost = []
        for repeat in range(2):
            donors = sorted(range(len(ids)), key=lambda k: (hashlib.sha256(f"{s.seed}|{repeat}|{ids[k]}".encode()).hexdigest(), ids[k]))
            shuffled = x.copy()
            shuffled[:, i] = x[donors, i]
            lost.append(area(x) - area(shuffled))
        assert got[feature] == pytest.approx((np.mean(lost), np.std(lost)), abs=1e-12)
    assert max(v[0] for v in got.values()) > 0.1


def test_preparation_follows_the_training_rows(engine):
    import numpy as np

    train = engine.table("model_frame").filter("not in_test").toPandas()
    ready = engine.preparation
    for c in churn_data.NUMERIC_FEATURES:
        assert ready.medians[c] == np.nanmedian(train[c])
        filled = train[c].fillna(ready.medians[c])
        assert ready.means[c] == pytest.approx(filled.mean(), abs=1e-9) and ready.deviations[c] == pytest.approx(filled.std(ddof=0) or 1.0)
    for c in churn_data.CATEGORICAL_FEATURES:
        assert ready.categories[c] == sorted(train[c].unique())


def test_unseen_categories_are_minus_one(engine):
    model = engine.model(training.BOOSTED)
    odd = engine.table("model_frame").withColumn("city", F.lit("never seen")).withColumn("age", F.lit(None).cast("double"))
    seen = odd.select(model.preparation.column("city").alias("city"), model.preparation.column("age").alias("age")).distinct().collect()
    assert [tuple(r) for r in seen] == [(-1.0, model.preparation.medians["age"])]
    scores = training.score(model, odd)
    assert scores.filter("predicted_churn_probability between 0 and 1").count() == odd.count()


@pytest.mark.parametrize("name", [training.LOGISTIC, training.BOOSTED])
def test_saved_model_scores_the_same(spark, engine, tmp_path, name):
    model = engine.model(name)
    training.save_model(spark, model, str(tmp_path / "model"))
    again = training.load_model(spark, str(tmp_path / "model"))
    assert again == model
    a = training.score(model, engine.table("model_frame")).select("customer_id", "predicted_churn_probability")
    b = training.score(again, engine.table("model_frame")).select("customer_id", "predicted_churn_probability")
    assert a.exceptAll(b).count() == 0


def test_importance_governance(engine):
    rows = engine.importance_governance.collect()
    assert len(rows) == 20 and [r["feature_rank"] for r in rows] == list(range(1, 21))
    unnamed = {r["feature"] for r in rows if r["signal_family"] == "Other modeled signal"}
    assert unnamed <= {"transaction_count"}


def test_trained_scores_drive_every_layer(engine):
    assert engine.table("population").count() > 0
    assert engine.check("validation").count() == 10
    assert engine.dashboard("model_governance").count() == 12


def test_forbidden_feature_is_refused(spark, engine, monkeypatch):
    monkeypatch.setattr(churn_data, "NUMERIC_FEATURES", (*churn_data.NUMERIC_FEATURES, "profit_adjusted_clv_proxy"))
    with pytest.raises(ValueError, match="profit_adjusted_clv_proxy"):
        churn_data.feature_leakage_audit(engine.table("clv"))


def test_failed_check_raises(spark):
    bad = spark.createDataFrame([("rows_exist", "FAIL", "0", "")], "check_name string, status string, value string, notes string")
    with pytest.raises(ValueError, match="rows_exist"):
        checks.fail_on_violation(bad)


def test_sensitivity_without_both_models(spark, engine):
    one = engine.table("trained_comparison").filter(F.col("model_name") == training.LOGISTIC)
    got = validation.cancel_signal_sensitivity(one, training.BOOSTED, training.BOOSTED_NO_CANCEL).first()
    assert got["status"] == "NOT_AVAILABLE"
