from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from holdfast.operators import checks, validation
from holdfast.plans import primitives

SF_DIR = "/root/testdata/sf0.001"
FILE_QUERIES = (
    primitives.csv_scan, primitives.csv_scan_chunked, primitives.csv_scan_projected, primitives.csv_sink,
    primitives.parquet_sink, primitives.top_sample_sink, primitives.staged_csv_reread,
)


@pytest.fixture(scope="module")
def engine(spark):
    return entry.engine_for(spark, SF_DIR)


def test_layers_and_reports_are_written(spark, engine, tmp_path):
    engine.publish(str(tmp_path))
    assert {p for p in os.listdir(tmp_path)} == {"layers", "dashboards", "checks"}
    months = spark.read.parquet(f"{tmp_path}/layers/customer_month")
    assert months.count() == engine.table("customer_month").count()
    assert any(p.startswith("snapshot_month=") for p in os.listdir(tmp_path / "layers" / "customer_month"))
    assert len(os.listdir(tmp_path / "dashboards")) == 11 and len(os.listdir(tmp_path / "checks")) == 9


def test_files_stay_readable_whatever_is_written_later(engine):
    frames = [query(engine) for query in (*FILE_QUERIES, *FILE_QUERIES)]
    counts = [frame.count() for frame in reversed(frames)][::-1]
    assert counts[:len(FILE_QUERIES)] == counts[len(FILE_QUERIES):] and min(counts) > 0


def test_a_broken_layer_is_refused(engine):
    broken = engine.table("clv").withColumn("profit_adjusted_clv_proxy", F.lit(-1.0))
    report = checks.check_clv(broken, engine.p)
    with pytest.raises(ValueError, match="no_negative_value_metrics"):
        checks.fail_on_violation(report)
    engine.enforce("customer_month", "clv")


def test_governance_follows_its_inputs(engine):
    audit, scored = engine.feature_audit, engine.table("scored")
    models = engine.table(engine.comparison_name)
    names = [r["model_name"] for r in models.select("model_name").collect()]

    def status(*args):
        return {r["governance_check"]: r["status"] for r in validation.leakage_governance_check(*args).collect()}

    good = status(audit, scored, models, *sorted(names, key=len))
    assert set(good.values()) == {"PASS"}
    leaking = audit.withColumn("is_forbidden", F.lit(True)).withColumn("feature", F.lit("clv_value_tier"))
    bad = status(leaking, scored.withColumn("save_priority_tier", F.lit("x")), models.limit(0), *names)
    assert bad == {
        "forbidden_features_not_used": "FAIL", "business_value_used_after_scoring": "REVIEW",
        "sensitivity_model_trained": "REVIEW", "model_output_not_final_targeting": "FAIL",
    }
    assert status(audit, scored, None, *names)["sensitivity_model_trained"] == "NOT_AVAILABLE"


def test_importance_check_needs_importance(engine):
    report = {r["check_name"]: r["status"] for r in engine.check("validation").collect()}
    assert report["feature_importance_governance_created"] == "NOT_AVAILABLE"
