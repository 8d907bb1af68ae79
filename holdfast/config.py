"""Every business constant of the engine, grouped into one immutable profile.

``REFERENCE`` holds the published planning assumptions for a subscription data set with
~1M customers.  ``FIXTURE`` rescales the currency- and size-dependent ones so that every
branch is reachable on the small TPC-H-like test tables.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# --- Fixed values: labels -------------------------------------------------------------

NO_ACTIVITY = "No observed activity"
ENGAGEMENT_TIERS = ("Low engagement", "Medium engagement", "High engagement")
NO_REVENUE = "No observed revenue"
REVENUE_TIERS = ("Low revenue", "Medium revenue", "High revenue")
UNKNOWN_TENURE = "Unknown tenure"
LIFECYCLE_STAGES = ("New customer", "Early lifecycle", "Established", "Long-tenure")
NO_MONTH = "no_observed_month"

NO_VALUE, LOW_VALUE, CORE_VALUE, HIGH_VALUE, ELITE_VALUE = (
    "No observed value", "Low value", "Core value", "High value", "Elite value",
)
TOP_VALUE = (ELITE_VALUE, HIGH_VALUE)
CRITICAL, HIGH_RISK, MEDIUM_RISK, LOW_RISK = (
    "Critical risk", "High risk", "Medium risk", "Low risk",
)
ELEVATED_RISK = (CRITICAL, HIGH_RISK)

PREMIUM_BUDGET = "Premium save budget"
MODERATE_BUDGET = "Moderate save budget"
LOW_COST_BUDGET = "Low-cost save budget"
AUTOMATION_BUDGET = "Automation only"
NO_BUDGET = "No paid budget"

SUPPRESS = "Suppress paid offer"
PREMIUM_SAVE = "Immediate premium save offer"
WIN_BACK = "Premium win-back review"
TARGETED = "High-value targeted retention"
NURTURE = "Targeted lifecycle nurture"
AUTOMATED = "Low-cost automated retention"
PROTECT = "Protect without discount"
MONITOR = "Monitor only"

QUADRANT_HH = "High risk / high value"
QUADRANT_HL = "High risk / low value"
QUADRANT_LH = "Low risk / high value"
QUADRANT_MH = "Medium risk / high value"
QUADRANT_REST = "Standard lifecycle population"

TIER_1 = "Tier 1 - Executive save priority"
TIER_2 = "Tier 2 - Premium save priority"
TIER_3 = "Tier 3 - Targeted save priority"
TIER_4 = "Tier 4 - Test-and-learn save pool"
TIER_POOL = "Positive ROI monitor pool"
TIER_NONE = "Not targeted"
TIER_SUPPRESSED = "Suppressed from paid retention"
TIER_PROTECT = "Relationship protection only"

TREATMENT = "Treatment - retention offer"
CONTROL = "Control - holdout"


@dataclass(frozen=True)
class ClvAssumptions:
    margin: float = 0.65
    max_months: float = 24.0
    base_months: float = 3.0
    engagement_weight: float = 0.55
    auto_renew_bonus: float = 4.0
    long_tenure_bonus: float = 2.0
    established_bonus: float = 1.0
    cancellation_penalty: float = -5.0
    activity_drop_penalty: float = -2.0


@dataclass(frozen=True)
class BudgetTier:
    """Planning row of one retention budget tier."""

    tier: str
    cost_per_customer: float
    recovery_rate: float
    model_weight: float


@dataclass(frozen=True)
class Action:
    """Response and cost assumption of one retention action."""

    name: str
    response_rate: float
    cost: float


@dataclass(frozen=True)
class Scenario:
    name: str
    response_multiplier: float
    cost_multiplier: float
    budget_cap: float
    readout: str


BUDGET_TIERS = (
    BudgetTier(PREMIUM_BUDGET, 15.0, 0.12, 1.50),
    BudgetTier(MODERATE_BUDGET, 6.0, 0.06, 1.20),
    BudgetTier(LOW_COST_BUDGET, 2.0, 0.03, 0.80),
    BudgetTier(AUTOMATION_BUDGET, 0.5, 0.01, 0.50),
    BudgetTier(NO_BUDGET, 0.0, 0.0, 0.0),
)

ACTIONS = (
    Action(PREMIUM_SAVE, 0.14, 18.0),
    Action(WIN_BACK, 0.12, 12.0),
    Action(TARGETED, 0.08, 7.5),
    Action(NURTURE, 0.05, 3.0),
    Action(AUTOMATED, 0.025, 0.75),
    Action(PROTECT, 0.01, 0.25),
    Action(MONITOR, 0.0, 0.0),
    Action(SUPPRESS, 0.0, 0.0),
)

SCENARIOS = (
    Scenario("Conservative", 0.70, 1.25, 500_000.0,
             "Fewer responses at more cost."),
    Scenario("Base", 1.00, 1.00, 1_000_000.0,
             "Responses and costs as assumed."),
    Scenario("Upside", 1.25, 0.90, 1_500_000.0,
             "More responses at less cost."),
    Scenario("Budget constrained", 0.90, 1.10, 250_000.0,
             "A quarter of the base budget."),
    Scenario("Aggressive growth", 1.40, 1.15, 2_000_000.0,
             "Many more responses, bought at higher cost."),
)

RECOVERY_SCENARIOS = (
    ("Conservative recovery", 0.05), ("Base recovery", 0.10), ("Aggressive recovery", 0.15),
)
QUADRANT_WEIGHTS = ((QUADRANT_HH, 1.50), (QUADRANT_MH, 1.15), (QUADRANT_LH, 0.60), (QUADRANT_HL, 0.25))
QUADRANT_DEFAULT_WEIGHT = 0.75

# Target shares are kept as whole per-mille so that n * share never rounds the wrong way.
CONCENTRATION_PERMILLE = (("Top 1%", 10), ("Top 5%", 50), ("Top 10%", 100), ("Top 20%", 200))
TARGET_PERMILLE = (10, 50, 100, 150, 200, 300, 400, 500)

AB_RESPONSE_SCENARIOS = (
    ("Half expected response", 0.50), ("Conservative expected response", 0.70),
    ("Base expected response", 1.00), ("Upside expected response", 1.25),
)
AB_POWER_Z = ((0.80, 0.84), (0.90, 1.28), (0.95, 1.645))
AB_ALPHA = 0.05
AB_Z_ALPHA = 1.96
AB_REDUCTIONS = (0.01, 0.02, 0.03, 0.05, 0.075, 0.10, 0.15, 0.20)
# Assignment depends only on this text and the customer id; pass your own through Profile.ab_seed.
AB_SEED = "retention_holdout_v1"
RESPONSE_CAP = 0.60


@dataclass(frozen=True)
class ModelSettings:
    """Training settings of the three candidate models."""

    seed: int = 42
    test_permille: int = 250
    logistic_iterations: int = 700
    boosting_rounds: int = 180
    boosting_step: float = 0.06
    max_leaves: int = 31
    min_leaf_rows: int = 40
    leaf_penalty: float = 0.05
    bins: int = 255
    validation_permille: int = 120
    stop_rounds: int = 10
    stop_gain: float = 1e-7
    importance_repeats: int = 3


@dataclass(frozen=True)
class Profile:
    name: str = "reference"
    engagement_cuts: tuple[float, float] = (5.0, 9.0)
    revenue_cuts: tuple[float, float] = (100.0, 180.0)
    tenure_cuts: tuple[int, int, int] = (1, 6, 24)
    snapshot_date: str = "2017-03-01"
    min_segment_rows: int = 500
    min_export_rows: int = 250
    min_curve_rows: int = 500
    readiness_rows: tuple[int, int] = (100, 500)
    large_value: float = 1_000_000.0
    top_segments: int = 30
    sample_rows: int = 100_000
    top_n: tuple[int, ...] = (5_000, 10_000, 25_000, 50_000)
    fallback_test_rows: int | None = None
    budget_caps: tuple[float, ...] = (100e3, 250e3, 500e3, 750e3, 1e6, 1.5e6, 2e6)
    base_budget_cap: float = 1_000_000.0
    response_multipliers: tuple[float, ...] = (0.50, 0.70, 0.85, 1.00, 1.15, 1.30, 1.50)
    clv: ClvAssumptions = field(default_factory=ClvAssumptions)
    budget_tiers: tuple[BudgetTier, ...] = BUDGET_TIERS
    actions: tuple[Action, ...] = ACTIONS
    scenarios: tuple[Scenario, ...] = SCENARIOS
    ab_seed: str = AB_SEED
    model: ModelSettings = field(default_factory=ModelSettings)


REFERENCE = Profile()

# Offer costs in the currency of the test tables; with 800 the budget caps bind at every test size.
_COST_SCALE = 800.0

FIXTURE = replace(
    REFERENCE,
    name="fixture",
    engagement_cuts=(14.80, 15.05),
    revenue_cuts=(125_000.0, 250_000.0),
    snapshot_date="2000-07-01",
    min_segment_rows=5,
    min_export_rows=3,
    min_curve_rows=5,
    sample_rows=120,
    readiness_rows=(3, 6),
    large_value=10_000_000.0,
    top_n=(50, 100, 250, 500),
    budget_tiers=tuple(
        replace(b, cost_per_customer=b.cost_per_customer * _COST_SCALE) for b in BUDGET_TIERS
    ),
    actions=tuple(replace(a, cost=a.cost * _COST_SCALE) for a in ACTIONS),
    model=ModelSettings(min_leaf_rows=5),
)
