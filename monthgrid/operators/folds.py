"""Time-ordered folds, time-decay weights and target encoding."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import age_in_months
from ..functions.numeric import floored

MONTH = "panel_month"


@dataclass(frozen=True)
class Fold:
    """Training rows end at ``train_end``; validation months are inclusive."""

    fold: int
    train_end: str
    valid_start: str
    valid_end: str


def numbered_folds(bounds: Sequence[tuple[str, str, str]]) -> list[Fold]:
    return [Fold(i, *b) for i, b in enumerate(bounds, start=1)]


def training_rows(df: DataFrame, train_end: str, target: str) -> DataFrame:
    """Rows up to the cutoff month with a known target; both filters reach the scan."""
    return df.where((F.col(MONTH) <= F.lit(train_end).cast("date")) & F.col(target).isNotNull())


def _day(text: str) -> Column:
    return F.lit(text).cast("date")


def _memberships(folds: Sequence[Fold]) -> Column:
    """Per row, the (fold, role) pairs it belongs to, out of a literal list."""
    entries = []
    for f in folds:
        for role, first, last in (("train", "0001-01-01", f.train_end), ("valid", f.valid_start, f.valid_end)):
            entries.append(
                F.struct(
                    F.lit(f.fold).alias("fold"),
                    F.lit(role).alias("role"),
                    _day(first).alias("first"),
                    _day(last).alias("last"),
                )
            )
    return F.filter(F.array(*entries), lambda e: F.col(MONTH).between(e["first"], e["last"]))


def assigned(df: DataFrame, folds: Sequence[Fold], role: str | None = None) -> DataFrame:
    """One row per (row, fold, role); the range test runs on each row, without a join.

    ``reference_month`` is the last month of the fold's training or validation part.
    """
    out = df.withColumn("_m", F.explode(_memberships(folds))).select(
        *df.columns,
        F.col("_m.fold").alias("fold"),
        F.col("_m.role").alias("role"),
        F.col("_m.last").alias("reference_month"),
    )
    return out if role is None else out.where(F.col("role") == role)


def fold_stats(df: DataFrame, folds: Sequence[Fold], target: str) -> DataFrame:
    """Rows, distinct months and smallest target per fold and role.

    Rows are counted per month before the folds multiply them.
    """
    monthly = df.groupBy(MONTH).agg(F.count(F.lit(1)).alias("_rows"), F.min(target).alias("_min"))
    return (
        assigned(monthly, folds)
        .groupBy("fold", "role")
        .agg(
            F.sum("_rows").alias("row_count"),
            F.count(F.lit(1)).alias("month_count"),
            F.min("_min").alias("min_target"),
        )
    )


def usable_folds(df: DataFrame, folds: Sequence[Fold], target: str, minimum_months: int) -> list[Fold]:
    """Folds with enough training months and some validation rows; none is an error."""
    stats = {(r.fold, r.role): r for r in fold_stats(df, folds, target).collect()}
    kept = [
        f
        for f in folds
        if (f.fold, "valid") in stats
        and (f.fold, "train") in stats
        and stats[f.fold, "train"].month_count >= minimum_months
    ]
    if not kept:
        raise ValueError("no fold has enough training months and validation rows")
    return kept


@dataclass(frozen=True)
class Decay:
    """How a row's weight falls with its age in months."""

    strategy: str = "exponential"
    half_life_months: float = 12.0
    linear_min_ratio: float = 0.1
    enabled: bool = True

    def __post_init__(self) -> None:
        if self.strategy not in ("none", "exponential", "linear"):
            raise ValueError("strategy must be none, exponential or linear")
        if self.half_life_months <= 0:
            raise ValueError("half_life_months must be positive")
        if not 0 < self.linear_min_ratio <= 1:
            raise ValueError("linear_min_ratio must lie in (0, 1]")


def add_decay_weights(
    df: DataFrame, decay: Decay, reference: Column | str, by: Sequence[str] = (), output: str = "weights"
) -> DataFrame:
    """Weights of mean 1 (within each ``by`` group) that fall with a row's age.

    A weight depends on the month only, so it is worked out on row counts per
    group and month and joined back. That table is bounded by the calendar
    times the groups (folds), hence the broadcast.
    """
    if not decay.enabled or decay.strategy == "none":
        return df.withColumn(output, F.lit(1.0))
    reference = F.lit(reference).cast("date") if isinstance(reference, str) else reference
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    months = df.groupBy(*by, MONTH, reference.alias("_ref")).agg(F.count(F.lit(1)).alias("_n"))
    months = months.withColumn("_age", age_in_months(MONTH, F.col("_ref")))
    if decay.strategy == "exponential":
        raw = F.pow(F.lit(0.5), F.col("_age") / F.lit(float(decay.half_life_months)))
    else:
        oldest = F.max("_age").over(group)
        r = float(decay.linear_min_ratio)
        linear = F.lit(r) + F.lit(1.0 - r) * (F.lit(1.0) - F.col("_age") / oldest)
        raw = F.when(oldest <= 0, F.lit(1.0)).otherwise(floored(linear, r))
    months = months.withColumn("_raw", raw)
    mean = F.sum(F.col("_raw") * F.col("_n")).over(group) / F.sum("_n").over(group)
    months = months.withColumn("_mean", mean).withColumn(
        output,
        F.when(F.col("_mean") == 0, F.raise_error(F.lit("mean weight is zero")).cast("double")).otherwise(
            F.col("_raw") / F.col("_mean")
        ),
    )
    return df.join(F.broadcast(months.select(*by, MONTH, output)), [*by, MONTH], "left")


def category_means(df: DataFrame, column: str, target: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean target per category (and fold); combined map-side before the shuffle."""
    return df.groupBy(*by, column).agg(F.avg(target).alias("encoded"))


def encoding_default(df: DataFrame, target: str, unknown: float | str) -> float:
    """A given number, ``"zero"``, or the mean target."""
    if isinstance(unknown, (int, float)):
        return float(unknown)
    if unknown.lower() == "zero":
        return 0.0
    return float(df.agg(F.avg(target)).first()[0])


def encode(df: DataFrame, means: DataFrame, column: str, output: str, default: float, by: Sequence[str] = ()) -> DataFrame:
    """Look up the category mean; unknown and null categories get ``default``.

    ``means`` grows with the categories, so there is no hint. Saved means (see
    ``sources.artefacts``) have a known size and broadcast only if small.
    """
    table = means.withColumnRenamed("encoded", output)
    return df.drop(output).join(table, [*by, column], "left").withColumn(
        output, F.coalesce(F.col(output), F.lit(float(default)))
    )


def month_parts(parts: int) -> Column:
    """Months dealt in turn to ``parts`` parts, so that whole months are left out together."""
    return F.pmod(F.year(MONTH) * 12 + F.month(MONTH), F.lit(parts))


def encode_out_of_fold(
    df: DataFrame, column: str, target: str, output: str, default: float, parts: int = 5, part: Column | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Each row's category mean over the rows of all other parts; no row sees its own target.

    Sums per category and part are made in one aggregate; all sums less a part's own give its complement,
    which goes back to the rows in one join. ``part`` deals the rows, by default by month. Null categories
    and those without a target in other parts get ``default``.
    """
    dealt = df.drop(output).withColumn("_part", month_parts(parts) if part is None else part)
    sums = dealt.groupBy(*by, column, "_part").agg(F.sum(target).alias("_s"), F.count(target).alias("_n"))
    whole = Window.partitionBy(*by, column)
    rest = F.sum("_n").over(whole) - F.col("_n")
    # A sum of no value is null, not 0.
    mean = (F.sum("_s").over(whole) - F.coalesce("_s", F.lit(0.0))) / F.when(rest > 0, rest)
    table = sums.select(*by, column, "_part", mean.alias(output))
    joined = dealt.join(table, [*by, column, "_part"], "left").drop("_part")
    return joined.select(*[c for c in df.columns if c != output], F.coalesce(F.col(output), F.lit(float(default))).alias(output))
