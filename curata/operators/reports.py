"""Counts, rates, distributions and top lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rate(part: Column, whole: Column) -> Column:
    """part / whole to six places; 0 of nothing."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.round(part / whole, 6))


def counts(df: DataFrame, label: Column, name: str = "label") -> DataFrame:
    return df.groupBy(label.alias(name)).agg(F.count(F.lit(1)).alias("n"))


def exploded_counts(df: DataFrame, labels: Column, missing: str = "missing", name: str = "label") -> DataFrame:
    """Counts over the elements of arrays; a missing array counts once as `missing`, an empty one not at all."""
    return counts(df.select(F.explode(F.coalesce(labels, F.array(F.lit(missing)))).alias(name)), F.col(name), name)


def most_common(df: DataFrame, label: str, order: list[str], n: int = 30) -> DataFrame:
    """The n commonest labels; of equally common ones those that come first."""
    per = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*order)).alias("__first"))
    return per.orderBy(F.desc("n"), "__first").limit(n).select(label, "n")
