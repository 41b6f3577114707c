"""Number functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rounded(c: Column | str, digits: int = 0) -> Column:
    """Half away from zero on the binary value times 10**digits."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c * 10**digits) / 10**digits if digits else F.round(c)


def with_rounded(df: DataFrame, out: str, c: Column, digits: int) -> DataFrame:
    """Adds a double, rounded as by `rounded`, without decimal text on the way: the nearest whole number, with exact halves taken
    away from zero. Each step is a column of its own, so that no row computes it twice."""
    df = df.withColumn("_x", c * float(10**digits)).withColumn("_near", F.rint("_x"))
    x, near = F.col("_x"), F.col("_near")
    away = ((x - near == 0.5) & (x > 0)).cast("double") - ((x - near == -0.5) & (x < 0)).cast("double")
    return df.withColumn(out, (near + away) / float(10**digits)).drop("_x", "_near")


def padded(number: Column, digits: int) -> Column:
    """A whole number with zeros before it up to so many digits; a longer one stays whole, where lpad would cut it."""
    text = number.cast("string")
    return F.lpad(text, F.greatest(F.lit(digits), F.length(text)), "0")
