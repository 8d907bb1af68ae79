"""Candidate churn models: preparation, training, scoring, saving, and permutation importance."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.config import ModelSettings
from holdfast.functions.columns import hash_to_unit
from holdfast.functions.literals import literal_rows
from holdfast.operators import boosting, logistic
from holdfast.operators.boosting import BoostedTrees, Tree
from holdfast.operators.churn_data import (
    CANCELLATION_FEATURES, CATEGORICAL_FEATURES, NUMERIC_FEATURES, TARGET, planning_score,
)
from holdfast.operators.evaluate import P
from holdfast.operators.logistic import LogisticModel
from holdfast.operators.order_stats import medians
from holdfast.operators.ranking import ROW_NO, Key, number_rows
from holdfast.plans.store import TableStore

LOGISTIC = "logistic_regression_balanced"
BOOSTED = "gradient_boosted_trees"
BOOSTED_NO_CANCEL = "gradient_boosted_trees_no_cancel_signals"


@dataclass(frozen=True)
class Candidate:
    name: str
    note: str
    numeric: tuple[str, ...]
    uses_cancel: bool

    @property
    def features(self) -> tuple[str, ...]:
        return (*self.numeric, *CATEGORICAL_FEATURES)


CANDIDATES = (
    Candidate(LOGISTIC, "Weighted logistic regression, as a plain yardstick.", NUMERIC_FEATURES, True),
    Candidate(BOOSTED, "Boosted trees over all features; the model in use.", NUMERIC_FEATURES, True),
    Candidate(
        BOOSTED_NO_CANCEL, "The same trees without the cancellation columns.",
        tuple(f for f in NUMERIC_FEATURES if f not in CANCELLATION_FEATURES), False,
    ),
)


@dataclass(frozen=True)
class Preparation:
    """What the training rows say about the features; serves all candidates.

    Missing numbers become the exact median, categories their place in alphabetical order, and categories that
    the training rows don't have -1.  A number that is always missing becomes zero.
    """

    medians: dict[str, float]
    means: dict[str, float]
    deviations: dict[str, float]
    categories: dict[str, list[str]]

    def filled(self, feature: str) -> Column:
        value = F.col(feature)
        return F.coalesce(F.when(~F.isnan(value), value), F.lit(self.medians[feature]))

    def column(self, feature: str, scaled: bool = False) -> Column:
        """The prepared feature; with ``scaled`` numbers are standardised, codes stay as they are."""
        if feature in self.categories:
            names = F.array(*map(F.lit, self.categories[feature])).cast("array<string>")
            return (F.coalesce(F.array_position(names, F.col(feature)), F.lit(0)) - 1).cast("double")
        if not scaled:
            return self.filled(feature)
        return (self.filled(feature) - F.lit(self.means[feature])) / F.lit(self.deviations[feature])


@dataclass(frozen=True)
class ChurnModel:
    name: str
    features: tuple[str, ...]
    preparation: Preparation
    fitted: LogisticModel | BoostedTrees

    @property
    def scaled(self) -> bool:
        return isinstance(self.fitted, LogisticModel)

    def columns(self) -> list[Column]:
        return [self.preparation.column(f, self.scaled) for f in self.features]


def prepare(split: DataFrame, numeric: Sequence[str] = NUMERIC_FEATURES) -> Preparation:
    """From the training side; one pass for categories and one for means after the passes of the medians."""
    train = split.filter(~F.col("in_test"))
    middle = {c: 0.0 if m is None else m for c, m in medians(train, numeric).items()}
    kinds = train.agg(*(F.array_sort(F.collect_set(c)).alias(c) for c in CATEGORICAL_FEATURES)).first().asDict()
    half = Preparation(middle, {}, {}, kinds)
    facts = train.agg(
        *(F.avg(half.filled(c)).alias(f"mean_{i}") for i, c in enumerate(numeric)),
        *(F.stddev_pop(half.filled(c)).alias(f"deviation_{i}") for i, c in enumerate(numeric)),
    ).first()
    return Preparation(
        middle, {c: facts[f"mean_{i}"] or 0.0 for i, c in enumerate(numeric)},
        {c: facts[f"deviation_{i}"] or 1.0 for i, c in enumerate(numeric)}, kinds,
    )


def training_rows(split: DataFrame, s: ModelSettings) -> DataFrame:
    """Training side with balanced class weights and the early-stopping share marked."""
    train = split.filter(~F.col("in_test"))
    # Two classes: a two-row aggregate.
    counts = train.groupBy(TARGET).agg(F.count("*").alias("class_rows"))
    weights = counts.crossJoin(counts.agg(F.sum("class_rows").alias("all_rows"))).select(
        TARGET, (F.col("all_rows") / (2 * F.col("class_rows"))).alias("class_weight")
    )
    stop = hash_to_unit(f"{s.seed}-stop", "customer_id") < s.validation_permille / 1000
    return train.join(F.broadcast(weights), TARGET).withColumn("for_stopping", stop)


def train(
    store: TableStore, c: Candidate, split: DataFrame, s: ModelSettings, preparation: Preparation | None = None
) -> ChurnModel:
    preparation = preparation or prepare(split)
    rows = training_rows(split, s)
    scaled = c.name == LOGISTIC
    ready = rows.select(
        *(preparation.column(f, scaled).alias(f) for f in c.features), TARGET, "class_weight", "for_stopping"
    )
    if scaled:
        fitted = logistic.fit(
            store.write("logistic_rows", ready), c.features, TARGET, "class_weight", s.logistic_iterations
        )
    else:
        fitted = boosting.fit(store, ready, c.features, TARGET, "for_stopping", s)
    return ChurnModel(c.name, c.features, preparation, fitted)


def score(model: ChurnModel, frame: DataFrame) -> DataFrame:
    return frame.withColumn(P, model.fitted.probability(model.columns()))


def save_model(spark: SparkSession, model: ChurnModel, path: str) -> None:
    """One row of JSON: preparation and weights or trees, whose number the settings bound."""
    content = asdict(model) | {"kind": type(model.fitted).__name__}
    spark.createDataFrame([(json.dumps(content),)], "model string").coalesce(1).write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> ChurnModel:
    content = json.loads(spark.read.parquet(path).first()["model"])
    fitted = content["fitted"]
    features = tuple(content["features"])
    if content["kind"] == LogisticModel.__name__:
        again = LogisticModel(features, tuple(fitted["weights"]), fitted["intercept"])
    else:
        again = BoostedTrees(features, fitted["base"], tuple(Tree(**t) for t in fitted["trees"]))
    return ChurnModel(content["name"], features, Preparation(**content["preparation"]), again)


def hash_sample(rows: DataFrame, seed: int, size: int) -> DataFrame:
    """A repeatable sample of ``size`` rows: the smallest hashes."""
    return rows.withColumn("sample_hash", hash_to_unit(f"{seed}-sample", "customer_id")).orderBy(
        "sample_hash", "customer_id"
    ).limit(size).drop("sample_hash")


def permutation_importance(
    store: TableStore, test: DataFrame, features: Sequence[str], vector_of: Callable, score_of: Callable,
    s: ModelSettings, moves_of: Callable | None = None,
) -> DataFrame:
    """Mean and deviation of the ROC-AUC lost when one feature is shuffled, over all test rows.

    Per repeat every row gets one donor row: the rows are numbered by id and by a seeded hash, and the
    two numberings are joined.  Only rows whose score moves with the donor's value go on, and the area is corrected by
    what they change: the place they leave and the one they take among the unmoved scores, and among each other.
    ``vector_of`` turns rows into (customer_id, label, x) and ``score_of`` adds the score of a frame with x.
    ``moves_of`` finds the moved rows (i, repeat, label, old, new) of (repeat, label, x, donor); without it they are
    scored one by one inside the scan.
    """
    base = store.write("importance_rows", score_of(vector_of(test)).select("customer_id", TARGET, "x", P))
    by_id = number_rows(store, "importance_id", base.select("customer_id"), [Key("customer_id")]).frame
    placed = store.write("importance_places", base.join(by_id, "customer_id"))
    parts = []
    for repeat in range(s.importance_repeats):
        drawn = base.select(
            F.sha2(F.concat_ws("|", F.lit(f"{s.seed}|{repeat}"), "customer_id"), 256).alias("draw"), "customer_id",
            F.col("x").alias("donor"),
        )
        donors = number_rows(store, f"importance_{repeat}", drawn, [Key("draw"), Key("customer_id")]).frame
        parts.append(placed.join(donors.select(ROW_NO, "donor"), ROW_NO).select(
            F.lit(repeat).alias("repeat"), F.col(TARGET).cast("int").alias("label"), "x", "donor", F.col(P).alias("old")
        ))
    pairs = reduce(DataFrame.unionByName, parts)
    moved = moves_of(pairs) if moves_of else _scored_moves(pairs, features, score_of)
    changes = store.write("importance_changes", _score_changes(moved))
    lost = _area_lost(store, base, changes)
    grid = literal_rows(store.spark, [
        (i, feature, repeat) for i, feature in enumerate(features) for repeat in range(s.importance_repeats)
    ], "i int, feature string, repeat int")
    drop = F.coalesce("drop", F.lit(0.0))
    return grid.join(lost, ["i", "repeat"], "left").groupBy("feature").agg(
        F.avg(drop).alias("importance_mean"), F.stddev_pop(drop).alias("importance_std")
    ).orderBy(F.desc("importance_mean"), "feature")


def _scored_moves(pairs: DataFrame, features: Sequence[str], score_of: Callable) -> DataFrame:
    """Moved rows, each feature scored anew where the donor has another value."""
    each = pairs.select("repeat", "label", "x", "donor", "old", F.explode(F.sequence(F.lit(0), F.lit(len(features) - 1))).alias("i"))
    at = F.col("i") + 1
    each = each.filter(~F.element_at("x", at).eqNullSafe(F.element_at("donor", at)))
    shuffled = F.transform("x", lambda v, place: F.when(place == F.col("i"), F.element_at("donor", place + 1)).otherwise(v))
    scored = score_of(each.withColumn("x", shuffled).drop("donor"))
    return scored.select("i", "repeat", "label", "old", F.col(P).alias("new")).filter("old <> new")


def _score_changes(moved: DataFrame) -> DataFrame:
    """Rows and positives that each score loses or gains, per feature and repeat."""
    sides = F.explode(F.array(
        F.struct(F.col("old").alias("p"), F.lit(-1).alias("n"), (-F.col("label")).alias("pos")),
        F.struct(F.col("new").alias("p"), F.lit(1).alias("n"), F.col("label").alias("pos")),
    )).alias("side")
    summed = moved.select("i", "repeat", sides).groupBy("i", "repeat", "side.p").agg(
        F.sum("side.n").alias("n"), F.sum("side.pos").alias("pos")
    )
    return summed.filter("n <> 0 or pos <> 0")


def _area_lost(store: TableStore, base: DataFrame, changes: DataFrame) -> DataFrame:
    """i, repeat and how much of the area the changes of scores take; in half pairs, as whole numbers."""
    ties = base.groupBy(F.col(P).alias("p")).agg(F.count("*").alias("n"), F.sum(TARGET).cast("bigint").alias("pos"))
    none = F.lit(0).cast("bigint")
    scale = ties.unionByName(changes.select("p", none.alias("n"), none.alias("pos")).distinct()).groupBy("p").agg(
        F.sum("n").alias("at_n"), F.sum("pos").alias("at_pos")
    )
    numbered = number_rows(store, "importance_scores", scale, [Key("p")], {"up_to_n": "at_n", "up_to_pos": "at_pos"})
    positives = int(numbered.totals["up_to_pos"])
    negatives = int(numbered.totals["up_to_n"]) - positives
    if not positives or not negatives:
        return changes.select("i", "repeat", F.lit(0.0).alias("drop")).distinct()
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    at_neg = whole("at_n") - whole("at_pos")
    below = whole("up_to_n") - whole("up_to_pos") - at_neg
    above = F.lit(positives).cast("decimal(19,0)") - whole("up_to_pos")
    neg, pos = whole("n") - whole("pos"), whole("pos")
    against_others = pos * (2 * below + at_neg) + neg * (2 * above + whole("at_pos"))
    # Inside a group the changes of negatives add up to nothing, so one running sum serves all groups.
    signed = changes.withColumn("neg", F.col("n") - F.col("pos"))
    running = number_rows(
        store, "importance_moves", signed, [Key("i"), Key("repeat"), Key("p")], {"up_to_neg": "neg"}
    ).frame
    among = pos * (2 * whole("up_to_neg") - neg)
    halves = running.join(numbered.frame.drop(ROW_NO), "p").groupBy("i", "repeat").agg(
        F.sum((against_others + among).cast("decimal(38,0)")).alias("halves")
    )
    return halves.select("i", "repeat", (-F.col("halves").cast("double") / (2.0 * positives * negatives)).alias("drop"))


def model_importance(store: TableStore, model: ChurnModel, test: DataFrame, s: ModelSettings) -> DataFrame:
    """Permutation importance of a fitted candidate, on its prepared features."""
    def vector_of(rows: DataFrame) -> DataFrame:
        return rows.select("customer_id", TARGET, F.array(*model.columns()).alias("x"))

    def score_of(rows: DataFrame) -> DataFrame:
        return rows.withColumn(P, model.fitted.probability([F.element_at("x", i + 1) for i in range(len(model.features))]))

    moves = model.fitted.moves if isinstance(model.fitted, BoostedTrees) else None
    return permutation_importance(store, test, model.features, vector_of, score_of, s, moves)


SCORECARD_INPUTS = (
    "cancellation_signal_flag", "auto_renew_signal", "no_recent_activity_flag", "major_activity_drop_flag", "tenure_months",
)


def scorecard_importance(store: TableStore, test: DataFrame, s: ModelSettings) -> DataFrame:
    """The same for the planning scorecard, on its inputs."""
    def vector_of(rows: DataFrame) -> DataFrame:
        return rows.select("customer_id", TARGET, F.array(*(F.col(c).cast("double") for c in SCORECARD_INPUTS)).alias("x"))

    def score_of(rows: DataFrame) -> DataFrame:
        inputs = {c: F.element_at("x", i + 1) for i, c in enumerate(SCORECARD_INPUTS)}
        return rows.withColumns(inputs).withColumn(P, planning_score()).drop(*SCORECARD_INPUTS)

    return permutation_importance(store, test, SCORECARD_INPUTS, vector_of, score_of, s)
