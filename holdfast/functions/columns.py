"""Column expressions shared by the operators.  All of them stay inside codegen."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ScalarOrColumn = Column | str


def as_col(c: ScalarOrColumn) -> Column:
    return F.col(c) if isinstance(c, str) else c


def first_match(rules: Iterable[tuple[Column, object]], otherwise: object = None) -> Column:
    """Ordered decision rules: the value of the first rule whose condition holds."""
    out: Column | None = None
    for condition, value in rules:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(condition, value) if out is None else out.when(condition, value)
    if otherwise is None:
        return out
    return out.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def lookup(key: ScalarOrColumn, pairs: Iterable[tuple[str, object]], default: object) -> Column:
    """Small constant map from a label to a value."""
    key = as_col(key)
    return first_match(((key == k, v) for k, v in pairs), default)


def bands(value: ScalarOrColumn, cuts: Iterable[float], labels: Iterable[str]) -> Column:
    """Half-open bands: the first label whose upper cut exceeds the value, else the last one."""
    value, labels = as_col(value), list(labels)
    rules = [(value < cut, label) for cut, label in zip(cuts, labels)]
    return first_match(rules, labels[-1])


def ratio(numerator: ScalarOrColumn, denominator: ScalarOrColumn) -> Column:
    """Null when the denominator is zero or null, whatever the ANSI mode."""
    return F.try_divide(as_col(numerator).cast("double"), as_col(denominator).cast("double"))


def positive_ratio(numerator: ScalarOrColumn, denominator: ScalarOrColumn) -> Column:
    """Ratio defined only over a positive denominator."""
    d = as_col(denominator)
    return F.when(d > 0, as_col(numerator) / d)


def share_or_zero(numerator: ScalarOrColumn, total: ScalarOrColumn) -> Column:
    return F.coalesce(positive_ratio(numerator, total), F.lit(0.0))


def clip(value: ScalarOrColumn, low: float | None = None, high: float | None = None) -> Column:
    out = as_col(value)
    if low is not None:
        out = F.greatest(out, F.lit(low))
    return F.least(out, F.lit(high)) if high is not None else out


def flag(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


def number_or_zero(name: str, kind: str = "double") -> Column:
    """Lenient cast: text that is not a number, and null, become zero."""
    return F.coalesce(F.col(name).try_cast(kind), F.lit(0).cast(kind))


def parse_yyyymmdd(name: str) -> Column:
    return F.try_to_date(F.col(name).cast("string"), "yyyyMMdd")


def month_text(day: ScalarOrColumn) -> Column:
    return F.date_format(as_col(day), "yyyy-MM")


def month_start(month: ScalarOrColumn) -> Column:
    return F.to_date(F.concat(as_col(month), F.lit("-01")))


def calendar_months(start: ScalarOrColumn, end: ScalarOrColumn) -> Column:
    """Number of month boundaries crossed between two dates."""
    start, end = as_col(start), as_col(end)
    return (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)


def hash_to_unit(seed: str, key: ScalarOrColumn) -> Column:
    """Repeatable uniform number in [0, 1] from the first 64 bits of SHA-256(seed|key)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}|"), as_col(key).cast("string")), 256)
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("double") / F.lit(float(16**16 - 1))


def total(name: ScalarOrColumn) -> Column:
    return F.sum(as_col(name))


def mean(name: ScalarOrColumn) -> Column:
    return F.avg(as_col(name))


def total_where(condition: Column, value: ScalarOrColumn) -> Column:
    return F.sum(F.when(condition, as_col(value)).otherwise(0))


def large_side(df: DataFrame) -> DataFrame:
    """A join side that grows with the customers: merged, so that the driver never holds it.

    Spark takes a side's size from its compressed files and does not count rows that ``explode`` adds, so a side far
    larger than the driver can pass as small enough to be broadcast.
    """
    return df.hint("merge")


def summarise(df: DataFrame, keys: list[str], metrics: dict[str, Column],
              min_rows: int | None = None) -> DataFrame:
    """One grouped (or global) aggregate; ``min_rows`` filters on the ``customers`` count."""
    columns = [expr.alias(name) for name, expr in metrics.items()]
    out = df.groupBy(*keys).agg(*columns) if keys else df.agg(*columns)
    return out.filter(F.col("customers") >= min_rows) if min_rows else out


def top_pick(df: DataFrame, measure: str, fields: dict[str, str]) -> DataFrame:
    """One row: the fields (new name -> column) of the row with the largest measure.

    Rows with equal measures are told apart by their text columns, first in alphabet wins.
    """
    keys = [name for name, kind in df.dtypes if kind == "string"]
    place = F.when(F.col(measure).isNotNull(), F.struct((-F.col(measure)).alias("_measure"), *keys))
    row = F.struct(*(F.col(name).alias(new) for new, name in fields.items()))
    return df.agg(F.min_by(row, place).alias("_top")).select(*(F.col(f"_top.{new}") for new in fields))


def require_columns(df: DataFrame, names: Iterable[str], purpose: str) -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"Missing columns for {purpose}: {missing}")
    return df


# --- Text for dashboards ----------------------------------------------------------------

def fixed(value: ScalarOrColumn, decimals: int) -> Column:
    """Plain fixed-point text without thousands separators."""
    grouped = F.format_number(as_col(value).cast("double"), decimals)
    return F.regexp_replace(grouped, ",", "")


def count_text(value: ScalarOrColumn) -> Column:
    return F.coalesce(F.format_number(as_col(value).cast("double"), 0), F.lit(""))


def percent_text(value: ScalarOrColumn, decimals: int = 2) -> Column:
    return F.coalesce(F.concat(fixed(as_col(value) * 100, decimals), F.lit("%")), F.lit(""))


def times_text(value: ScalarOrColumn) -> Column:
    return F.coalesce(F.concat(fixed(value, 2), F.lit("x")), F.lit(""))


def money_text(value: ScalarOrColumn) -> Column:
    v = as_col(value).cast("double")
    size = F.abs(v)
    text = first_match(
        [
            (size >= 1e9, F.concat(fixed(v / 1e9, 2), F.lit("B"))),
            (size >= 1e6, F.concat(fixed(v / 1e6, 2), F.lit("M"))),
            (size >= 1e3, F.concat(fixed(v / 1e3, 0), F.lit("K"))),
        ],
        F.format_number(v, 0),
    )
    return F.when(v.isNull(), "").otherwise(F.concat(F.lit("$"), text))
