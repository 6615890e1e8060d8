"""Data checks: missing values, table profile, histogram."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def null_audit(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Missing values per column, in one pass."""
    cols = list(cols or df.columns)
    return df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in cols])


def table_profile(df: DataFrame, date: str = "date", asset: str = "ticker") -> DataFrame:
    """Rows, date range and number of assets, in one pass."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min(date).alias("first_date"),
        F.max(date).alias("last_date"),
        F.count_distinct(asset).alias("n_assets"),
    )


def value_histogram(df: DataFrame, col: str, bins: int, density: bool = False) -> DataFrame:
    """Equal-width bins from minimum to maximum, the last one closed.

    Output: (bin, lower, upper, n[, density]); empty bins are reported. Values
    are counted by bin before the shuffle, so only ``bins`` rows leave a task.
    """
    known = df.where(F.col(col).isNotNull())
    ends = known.agg(F.min(col).alias("lo"), F.max(col).alias("hi"), F.count(col).alias("total"))
    lo, hi = ends.select("lo").scalar(), ends.select("hi").scalar()
    width = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    place = F.floor(F.try_divide(F.col(col) - F.col("_lo"), width)).cast("int")
    placed = known.withColumn("_lo", lo).withColumn("_hi", hi)
    slot = F.coalesce(F.least(place, F.lit(bins - 1)), F.lit(0))
    counts = placed.groupBy(slot.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    spine = ends.select(
        F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), "total", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    )
    out = spine.join(counts, "bin", "left").select(
        "bin",
        (F.col("_lo") + F.col("bin") * width).alias("lower"),
        (F.col("_lo") + (F.col("bin") + 1) * width).alias("upper"),
        F.coalesce("n", F.lit(0).cast("bigint")).alias("n"),
        *([F.try_divide(F.coalesce("n", F.lit(0)), F.col("total") * width).alias("density")] if density else []),
    )
    return out
