"""The whole analysis as one lazy graph of named tables.

Every table is a property built from the tables it reads.  A table with several readers is
written once through the store (``table``); the rest stay lazy and are planned together with
their reader.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import cached_property, partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.config import REFERENCE, Profile
from holdfast.operators import (
    abtest, bi, bitmaps, checks, churn_data, clean, clv, cohort, customer_month, evaluate, leakage, lifecycle,
    roi, save, training, validation,
)
from holdfast.operators.ranking import NumberedRows
from holdfast.plans.store import TableStore, run_together
from holdfast.sources.raw import RawTables, write_csv, write_parquet

SCORECARD = "planning_scorecard"
SCORECARD_NO_CANCEL = "planning_scorecard_no_cancel_signals"
SCORECARD_NOTE = "Transparent scorecard over snapshot signals."
SCORECARD_NO_CANCEL_NOTE = "Scorecard without the cancellation signal."


#: Layers that ``publish`` writes, and the columns their folders are split by.
PUBLISHED_LAYERS: dict[str, list[str] | None] = {
    "customer_month": ["snapshot_month"], "snapshot": None, "clv": None, "scored": None, "lifecycle": None,
    "saves": None, "population": None,
}


#: Layers with one customer's rows in one bucket, so snapshot, scores and lifecycle meet without a shuffle.
BUCKETED = frozenset({"labels", "customer_numbers", "members", "latest_transaction", "customer_month", "snapshot", "clv", "scored", "lifecycle", "saves"})
BUCKET_CUSTOMERS = 200_000
LEAST_BUCKETS, MOST_BUCKETS = 8, 20_000


class RetentionEngine:
    """``score_source`` is "scorecard" (repeatable, no training) or "trained" (best model)."""

    def __init__(self, spark: SparkSession, raw: RawTables, profile: Profile = REFERENCE,
                 store: TableStore | None = None, score_source: str = "scorecard"):
        if score_source not in ("scorecard", "trained"):
            raise ValueError(f"Unknown score source: {score_source}")
        self.spark, self.raw, self.p = spark, raw, profile
        self.store = store or TableStore(spark)
        self.score_source = score_source
        self._written: dict[str, DataFrame] = {}
        self._ranks: dict[str, NumberedRows] = {}
        self._models: dict[str, training.ChurnModel] = {}

    def table(self, name: str) -> DataFrame:
        """The named table, written on first use."""
        if name not in self._written:
            df = getattr(self, name)
            if name in BUCKETED:
                self._written[name] = self.store.write_bucketed(name, df, "customer_id", self.buckets)
            else:
                self._written[name] = self.store.write(name, df)
        return self._written[name]

    @cached_property
    def buckets(self) -> int:
        """One number for all tables by customer, from the number of labelled customers."""
        return min(max(LEAST_BUCKETS, -(-self.label_count // BUCKET_CUSTOMERS)), MOST_BUCKETS)

    @cached_property
    def label_count(self) -> int:
        return self.table("label_rows").count()

    def by_customer(self, df: DataFrame) -> DataFrame:
        """Dealt by customer as the bucketed tables are."""
        return df.repartition(self.buckets, "customer_id")

    def write_together(self, *names: str) -> None:
        """Writes independent tables at the same time, so that one job's tail overlaps the next."""
        run_together([partial(self.table, n) for n in names if n not in self._written])

    # --- Clean ------------------------------------------------------------------------------

    @cached_property
    def label_rows(self) -> DataFrame:
        return clean.clean_labels(self.raw.labels)

    @cached_property
    def labels(self) -> DataFrame:
        return self.by_customer(self.table("label_rows"))

    @cached_property
    def members(self) -> DataFrame:
        return self.by_customer(clean.clean_members(self.raw.members, self.table("labels")))

    @cached_property
    def transactions(self) -> DataFrame:
        return clean.clean_transactions(self.raw.transactions, self.table("labels"), self.label_count)

    @cached_property
    def logs_monthly(self) -> DataFrame:
        return clean.user_logs_monthly(self.raw.user_logs, self.table("labels"))

    @cached_property
    def data_quality(self) -> DataFrame:
        return clean.data_quality_summary(
            *(self.table(t) for t in ("labels", "members", "transactions", "logs_monthly"))
        )

    # --- Customer month and snapshot --------------------------------------------------------

    @cached_property
    def transaction_monthly(self) -> DataFrame:
        return customer_month.transaction_monthly(self.table("transactions"))

    @cached_property
    def customer_month_base(self) -> DataFrame:
        self.table("labels")
        self.write_together("transactions", "logs_monthly", "members")
        return customer_month.customer_month_base(
            self.transaction_monthly, self.table("logs_monthly"), self.table("members"), self.table("labels"),
            self.by_customer,
        )

    @cached_property
    def customer_month_features(self) -> DataFrame:
        return customer_month.customer_month_features(self.customer_month_base)

    @cached_property
    def customer_month(self) -> DataFrame:
        return customer_month.with_change_and_tiers(self.customer_month_features, self.p)

    @cached_property
    def latest_transaction(self) -> DataFrame:
        return self.by_customer(customer_month.latest_transaction(self.table("transactions")))

    @cached_property
    def snapshot(self) -> DataFrame:
        return customer_month.modeling_customer_snapshot(
            self.table("labels"), customer_month.latest_customer_month(self.table("customer_month")),
            self.table("members"), self.table("latest_transaction"), self.p,
        )

    # --- Cohorts ----------------------------------------------------------------------------

    @cached_property
    def cohort_monthly(self) -> DataFrame:
        return cohort.monthly_revenue_leakage(self.table("customer_month"))

    @cached_property
    def cohort_long(self) -> DataFrame:
        return cohort.cohort_retention_long(self.table("customer_month"))

    @cached_property
    def customer_numbers(self) -> DataFrame:
        return self.by_customer(bitmaps.customer_numbers(self.store, self.table("labels")))

    @cached_property
    def customer_bitmaps(self) -> DataFrame:
        return bitmaps.monthly_bitmaps(self.table("customer_month"), self.table("customer_numbers"), "engagement_tier")

    @cached_property
    def distinct_rollups(self) -> DataFrame:
        return bitmaps.distinct_rollups(self.table("customer_bitmaps"), "engagement_tier")

    @cached_property
    def cohort_by_engagement(self) -> DataFrame:
        return cohort.engagement_tier_churn_revenue(self.table("snapshot"))

    @cached_property
    def cohort_by_stage(self) -> DataFrame:
        return cohort.lifecycle_stage_churn_revenue(self.table("snapshot"))

    @cached_property
    def recovery_segments(self) -> DataFrame:
        return cohort.high_value_at_risk_segments(self.table("snapshot"), self.p)

    # --- Value ------------------------------------------------------------------------------

    @cached_property
    def value_deciles(self) -> DataFrame:
        return clv.value_deciles(self.store, clv.value_baselines(self.table("snapshot")))

    @cached_property
    def clv(self) -> DataFrame:
        return clv.customer_clv_scores(self.value_deciles, self.p)

    @cached_property
    def clv_portfolio(self) -> DataFrame:
        return clv.portfolio_clv_summary(self.table("clv"))

    @cached_property
    def clv_tiers(self) -> DataFrame:
        return clv.clv_value_tier_summary(self.table("clv"))

    @cached_property
    def clv_actions(self) -> DataFrame:
        return clv.value_based_action_group_summary(self.table("clv"))

    @cached_property
    def clv_rank(self) -> NumberedRows:
        return leakage.rank_by_clv(self.store, self.table("clv"))

    # --- Leakage ----------------------------------------------------------------------------

    @cached_property
    def leak_portfolio(self) -> DataFrame:
        return leakage.portfolio_summary(self.table("clv"))

    @cached_property
    def leak_actions(self) -> DataFrame:
        return leakage.by_action_group(self.table("clv"))

    @cached_property
    def leak_deciles(self) -> DataFrame:
        return leakage.concentration_deciles(self.table("clv"), self.clv_rank)

    @cached_property
    def leak_thresholds(self) -> DataFrame:
        return leakage.concentration_thresholds(self.table("clv"), self.clv_rank)

    @cached_property
    def leak_drivers(self) -> DataFrame:
        return leakage.driver_scores(self.table("clv"), self.p)

    @cached_property
    def leak_scenarios(self) -> DataFrame:
        return leakage.recoverable_scenarios(self.table("clv"))

    @cached_property
    def leak_budgets(self) -> DataFrame:
        return leakage.budget_opportunity(self.table("clv"), self.p)

    @cached_property
    def leak_priorities(self) -> DataFrame:
        return leakage.model_priority_segments(self.table("clv"), self.p)

    # --- Churn score ------------------------------------------------------------------------

    @cached_property
    def split(self) -> DataFrame:
        labelled = self.table("clv").filter(F.col(churn_data.TARGET).isNotNull())
        return churn_data.stratified_split(self.store, labelled, self.p.model)

    @cached_property
    def model_frame(self) -> DataFrame:
        return churn_data.modeling_frame(self.split, keep=("in_test",))

    @cached_property
    def feature_audit(self) -> DataFrame:
        return churn_data.feature_leakage_audit(self.table("clv"))

    def scorecard_rank(self, use_cancellation: bool) -> NumberedRows:
        name = SCORECARD if use_cancellation else SCORECARD_NO_CANCEL
        return self._rank(name, self.split.withColumn(evaluate.P, churn_data.planning_score(use_cancellation)))

    def _rank(self, name: str, scored: DataFrame) -> NumberedRows:
        test = scored.filter("in_test").withColumn("actual_churn", F.col(churn_data.TARGET))
        return self.numbered(name, lambda: evaluate.rank_scores(self.store, name, test))

    def numbered(self, name: str, build: Callable[[], NumberedRows]) -> NumberedRows:
        """A numbered frame, built on first use."""
        if name not in self._ranks:
            self._ranks[name] = build()
        return self._ranks[name]

    def candidate(self, name: str) -> training.Candidate:
        return next(c for c in training.CANDIDATES if c.name == name)

    @cached_property
    def preparation(self) -> training.Preparation:
        return training.prepare(self.table("model_frame"))

    def model(self, name: str) -> training.ChurnModel:
        if name not in self._models:
            self._models[name] = training.train(
                self.store, self.candidate(name), self.table("model_frame"), self.p.model, self.preparation
            )
        return self._models[name]

    def model_scores(self, name: str) -> DataFrame:
        return training.score(self.model(name), self.table("model_frame"))

    def model_rank(self, name: str) -> NumberedRows:
        return self._rank(name, self.model_scores(name))

    def model_row(self, name: str) -> DataFrame:
        c = self.candidate(name)
        return evaluate.model_row(self.model_rank(name), name, c.note, c.uses_cancel, len(c.features))

    @cached_property
    def trained_comparison(self) -> DataFrame:
        self.preparation
        run_together([partial(self.model, c.name) for c in training.CANDIDATES])
        run_together([partial(self.model_rank, c.name) for c in training.CANDIDATES])
        return evaluate.model_comparison([self.model_row(c.name) for c in training.CANDIDATES])

    @cached_property
    def best_model(self) -> str:
        """Name of the winner among three one-row results."""
        first = self.table("trained_comparison").orderBy(
            F.desc("pr_auc"), F.desc("roc_auc"), F.desc("top_decile_lift"), "model_name"
        ).first()
        return first["model_name"]

    @cached_property
    def importance(self) -> DataFrame:
        return training.model_importance(
            self.store, self.model(self.best_model), self.table("model_frame").filter("in_test"), self.p.model,
        )

    @cached_property
    def scorecard_importance(self) -> DataFrame:
        return training.scorecard_importance(self.store, self.split.filter("in_test"), self.p.model)

    @cached_property
    def scorecard_comparison(self) -> DataFrame:
        self.split
        run_together([partial(self.scorecard_rank, True), partial(self.scorecard_rank, False)])
        return evaluate.model_comparison([
            evaluate.model_row(self.scorecard_rank(True), SCORECARD, SCORECARD_NOTE, True, 5),
            evaluate.model_row(self.scorecard_rank(False), SCORECARD_NO_CANCEL, SCORECARD_NO_CANCEL_NOTE, False, 4),
        ])

    @property
    def is_trained(self) -> bool:
        return self.score_source == "trained"

    @property
    def comparison_name(self) -> str:
        return "trained_comparison" if self.is_trained else "scorecard_comparison"

    @cached_property
    def test_rank(self) -> NumberedRows:
        return self.model_rank(self.best_model) if self.is_trained else self.scorecard_rank(True)

    @cached_property
    def scored(self) -> DataFrame:
        if self.is_trained:
            return evaluate.scored_customers(self.store, "trained", self.model_scores(self.best_model))
        frame = self.table("clv").withColumn(evaluate.P, churn_data.planning_score())
        return evaluate.scored_customers(self.store, "scorecard", frame)

    @cached_property
    def risk_deciles(self) -> DataFrame:
        return evaluate.risk_decile_table(self.test_rank)

    @cached_property
    def thresholds(self) -> DataFrame:
        return evaluate.threshold_table(self.test_rank)

    @cached_property
    def calibration(self) -> DataFrame:
        return evaluate.calibration_table(self.test_rank)

    # --- Lifecycle --------------------------------------------------------------------------

    @cached_property
    def month_bounds(self) -> DataFrame:
        return lifecycle.month_bounds(self.table("customer_month"))

    @cached_property
    def lifecycle(self) -> DataFrame:
        return lifecycle.survival_base(self.table("scored"), self.month_bounds)

    @cached_property
    def life_portfolio(self) -> DataFrame:
        return lifecycle.portfolio_lifecycle_summary(self.table("lifecycle"))

    @cached_property
    def life_stages(self) -> DataFrame:
        return lifecycle.lifecycle_stage_summary(self.table("lifecycle"))

    @cached_property
    def life_hazard(self) -> DataFrame:
        return lifecycle.monthly_hazard(self.table("lifecycle"), self.p)

    @cached_property
    def life_quadrants(self) -> DataFrame:
        return lifecycle.value_risk_quadrant_summary(self.table("lifecycle"))

    @cached_property
    def life_segments(self) -> DataFrame:
        return lifecycle.model_priority_segments(self.table("lifecycle"), self.p)

    def curve(self, key: str | None) -> DataFrame:
        keys = [key] if key else []
        return lifecycle.survival_curve(
            self.table("lifecycle"), keys, self.p, self.p.min_curve_rows if key else 0
        )

    @cached_property
    def overall_curve(self) -> DataFrame:
        return self.curve(None)

    @cached_property
    def quadrant_curve(self) -> DataFrame:
        return self.curve("value_risk_quadrant")

    # --- Validation -------------------------------------------------------------------------

    @cached_property
    def valid_kpi(self) -> DataFrame:
        return validation.kpi_summary(
            self.table(self.comparison_name), self.table("risk_deciles"), self.table("thresholds")
        )

    @cached_property
    def valid_calibration(self) -> DataFrame:
        return validation.calibration_diagnostic(self.table("calibration"))

    @cached_property
    def valid_risk_value(self) -> DataFrame:
        return validation.risk_tier_value_impact(self.table("scored"))

    @cached_property
    def valid_segments(self) -> DataFrame:
        return validation.segment_intervention_priority(self.table("scored"), self.p)

    @cached_property
    def governance(self) -> DataFrame:
        return validation.leakage_governance_check(
            self.feature_audit, self.table("scored"), self.table(self.comparison_name), *self._compared(self.is_trained)
        )

    @staticmethod
    def _compared(trained: bool) -> tuple[str, str]:
        return (training.BOOSTED, training.BOOSTED_NO_CANCEL) if trained else (SCORECARD, SCORECARD_NO_CANCEL)

    def sensitivity(self, trained: bool) -> DataFrame:
        names = self._compared(trained)
        source = "trained_comparison" if trained else "scorecard_comparison"
        return validation.cancel_signal_sensitivity(self.table(source), *names)

    @cached_property
    def importance_governance(self) -> DataFrame:
        return validation.feature_importance_governance(self.table("importance"))

    # --- Save-worthiness, ROI, experiment ---------------------------------------------------

    @cached_property
    def saves(self) -> DataFrame:
        return save.customer_save_worthiness_scores(
            self.store, save.from_lifecycle(self.table("lifecycle")), self.p, self.buckets
        )

    @cached_property
    def save_portfolio(self) -> DataFrame:
        return save.portfolio_summary(self.table("saves"))

    @cached_property
    def save_actions(self) -> DataFrame:
        return save.action_summary(self.table("saves"))

    @cached_property
    def save_tiers(self) -> DataFrame:
        return save.priority_tier_summary(self.table("saves"))

    @cached_property
    def save_segments(self) -> DataFrame:
        return save.segment_summary(self.table("saves"), self.p)

    @cached_property
    def save_deciles(self) -> DataFrame:
        return save.save_worthiness_deciles(self.table("saves"))

    @cached_property
    def save_suppressions(self) -> DataFrame:
        return save.suppression_summary(self.table("saves"))

    @cached_property
    def roi_matrix(self) -> DataFrame:
        return roi.strategy_scenario_matrix(self.table("saves"), self.p)

    @cached_property
    def roi_best(self) -> DataFrame:
        return roi.best_strategy_by_scenario(self.table("roi_matrix"))

    @cached_property
    def roi_frontier(self) -> DataFrame:
        return roi.budget_cap_frontier(self.table("saves"), self.p)

    @cached_property
    def roi_break_even(self) -> DataFrame:
        return roi.break_even_summary(self.table("roi_matrix"))

    @cached_property
    def efficient_budget(self) -> DataFrame:
        return roi.efficient_budget(self.table("roi_frontier"))

    @cached_property
    def population(self) -> DataFrame:
        return abtest.candidate_population(self.store, self.table("saves"), self.table("efficient_budget"), self.p)

    @cached_property
    def ab_portfolio(self) -> DataFrame:
        return abtest.portfolio_summary(self.table("saves"), self.table("population"))

    @cached_property
    def ab_design(self) -> DataFrame:
        return abtest.design_summary(self.table("population"))

    @cached_property
    def ab_power(self) -> DataFrame:
        return abtest.power_scenarios(self.table("population"))

    @cached_property
    def ab_cards(self) -> DataFrame:
        return abtest.plan_cards(self.table("ab_portfolio"), self.table("ab_design"), self.table("ab_power"))

    # --- Checks and dashboards --------------------------------------------------------------

    def check(self, name: str) -> DataFrame:
        t = self.table
        reports = {
            "customer_month": lambda: checks.check_customer_month(t("customer_month"), t("snapshot")),
            "clv": lambda: checks.check_clv(t("clv"), self.p),
            "leakage": lambda: checks.check_leakage(
                t("leak_portfolio"), t("leak_deciles"), t("leak_thresholds"), t("leak_scenarios"),
                t("leak_budgets"), t("leak_priorities"),
            ),
            "churn_model": lambda: checks.check_churn_model(
                t(self.comparison_name), t("risk_deciles"), t("scored")
            ),
            "lifecycle": lambda: checks.check_lifecycle(
                t("lifecycle"), t("overall_curve"), t("quadrant_curve"), t("life_segments")
            ),
            "validation": lambda: checks.check_validation(
                t("valid_kpi"), t("risk_deciles"), t("thresholds"), self.valid_calibration, self.governance,
                self.importance_governance if self.is_trained else None,
            ),
            "save": lambda: checks.check_save(t("saves"), t("save_deciles")),
            "roi": lambda: checks.check_roi(
                t("roi_matrix"), roi.roi_portfolio_summary(t("roi_matrix")), self.roi_best, t("roi_frontier"), self.p
            ),
            "ab": lambda: checks.check_ab(
                t("population"), t("ab_design"), t("ab_power"), abtest.treatment_control_plan(t("population")),
                abtest.balance_diagnostics(t("population")), abtest.minimum_detectable_effect(t("population")),
                self.ab_cards, abtest.segment_test_readiness(t("population"), self.p),
            ),
        }
        return reports[name]()

    def publish(self, folder: str, layers: Mapping[str, list[str] | None] = PUBLISHED_LAYERS) -> None:
        """Writes the layers as Parquet and every dashboard and check report as CSV below ``folder``."""
        for name, split_by in layers.items():
            write_parquet(self.table(name), f"{folder}/layers/{name}", split_by)
        for name, table in self.dashboards().items():
            write_csv(table, f"{folder}/dashboards/{name}")
        for name in self.check_names():
            write_csv(self.check(name), f"{folder}/checks/{name}")

    def enforce(self, *names: str) -> None:
        """Raises on the first report with a failed check; all reports if none is named."""
        for name in names or self.check_names():
            checks.fail_on_violation(self.check(name))

    def check_names(self) -> tuple[str, ...]:
        return ("customer_month", "clv", "leakage", "churn_model", "lifecycle", "validation", "save", "roi", "ab")

    def dashboards(self) -> dict[str, DataFrame]:
        """Every presentation table."""
        return {name: self.dashboard(name) for name in (
            "executive_kpi", "value_leakage_heatmap", "risk_value_decision_map", "save_worthiness_funnel",
            "budget_frontier", "ab_readiness", "model_governance", "lifecycle_priority", "clv_concentration",
            "risk_lift", "retention_action",
        )}

    def dashboard(self, name: str) -> DataFrame:
        t = self.table
        tables = {
            "executive_kpi": lambda: bi.executive_kpi(
                t("leak_portfolio"), t("leak_deciles"), t("leak_thresholds"), t("recovery_segments"),
                t("save_portfolio"), t("efficient_budget"), t("ab_portfolio"),
            ),
            "value_leakage_heatmap": lambda: bi.value_leakage_heatmap(t("life_segments")),
            "risk_value_decision_map": lambda: bi.risk_value_decision_map(t("life_segments")),
            "save_worthiness_funnel": lambda: bi.save_worthiness_funnel(
                t("save_portfolio"), t("life_portfolio"), t("ab_portfolio")
            ),
            "budget_frontier": lambda: bi.budget_frontier(t("roi_frontier"), t("efficient_budget")),
            "ab_readiness": lambda: bi.ab_readiness(t("ab_design")),
            "model_governance": lambda: bi.model_governance(
                t("valid_kpi"), t("risk_deciles"), self.sensitivity(self.is_trained), self.governance,
                self.importance_governance if self.is_trained else None,
            ),
            "lifecycle_priority": lambda: bi.lifecycle_priority(t("life_segments")),
            "clv_concentration": lambda: bi.clv_concentration(t("leak_deciles")),
            "risk_lift": lambda: bi.risk_lift(t("risk_deciles")),
            "retention_action": lambda: bi.retention_action(t("save_actions")),
        }
        return tables[name]()
