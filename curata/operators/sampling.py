"""Seeded samples and splits that don't hang on row order or partitions: rows are ordered by a hash of seed and key.

The same seed gives the same rows on any cluster; which rows these are differs from a shuffle by a pseudo-random stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_key(seed: int, key: str) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")), 256)


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows or all: a top-n, of which each task keeps n at most."""
    return df.orderBy(rank_key(seed, key), key).limit(n)


def split(df: DataFrame, key: str, n_validation: int, seed: int = 42) -> DataFrame:
    """Adds split: exactly n_validation rows are "val", the others "train". Keys are unique.

    The hash of the last validation row is found by a top-n over hashes alone; rows are then told apart without a shuffle.
    """
    hashes = df.select(rank_key(seed, key).alias("h"))
    last = hashes.orderBy("h").limit(n_validation).agg(F.max("h").alias("__last"))
    return df.join(F.broadcast(last)).withColumn("split", F.when(rank_key(seed, key) <= F.col("__last"), "val").otherwise("train")).drop("__last")


def check_split(n_rows: int, n_validation: int) -> None:
    if n_rows == 0:
        raise ValueError("no rows to split")
    if not 0 < n_validation < n_rows:
        raise ValueError(f"validation size {n_validation} isn't between 0 and {n_rows}")


def ranked(df: DataFrame, key: str, groups: list[str], seed: int = 42) -> DataFrame:
    """Adds a rank by hash within groups."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*groups).orderBy(rank_key(seed, key), key)))
