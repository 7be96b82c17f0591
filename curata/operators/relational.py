"""Keyed lookups, resume, dedup, limits and reasons over ordered rows. Row order is a column, row_idx by default."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_row_index(df: DataFrame, name: str = "row_idx", first: int = 0, per_file: bool = False) -> DataFrame:
    """A gapless number in file order for the rows of a file scan, from `first`; per_file starts anew in each file.

    Rows of a block of a file stand together in a task, so a row's number is its place in the block and the number of rows
    in the blocks before it. Only a row a block is shuffled and ordered; the scan is read twice.
    """
    m = F.col("_metadata")
    placed = df.select("*", m["file_path"].alias("__file"), m["file_block_start"].alias("__block"), F.monotonically_increasing_id().alias("__place"))
    blocks = placed.groupBy("__file", "__block").agg(F.min("__place").alias("__least"), F.count(F.lit(1)).alias("__n"))
    order = (Window.partitionBy("__file").orderBy("__block") if per_file else Window.orderBy("__file", "__block")).rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("__file", "__block", (F.coalesce(F.sum("__n").over(order), F.lit(0)) - F.col("__least") + first).alias("__start"))
    return placed.join(starts, ["__file", "__block"]).withColumn(name, F.col("__place") + F.col("__start")).drop("__file", "__block", "__place", "__start")


def last_by_key(df: DataFrame, key: str, order: str, value: Column) -> DataFrame:
    """key, value: the value of each non-empty key's last row; a partial aggregate, so hot keys shrink before the shuffle."""
    return df.where(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(key).agg(F.max_by(value, F.col(order)).alias("value"))


def lookup(rows: DataFrame, table: DataFrame, key: str, name: str, flag: str) -> DataFrame:
    """Left join with a table of unique keys; flag tells whether there was a match. Spark broadcasts the table by its size."""
    return rows.join(table.select(key, F.col("value").alias(name)), key, "left").withColumn(flag, F.col(name).isNotNull())


def not_done(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys aren't among the finished ones. Rows with an empty first key are never taken for finished."""
    return rows.join(done.where(F.col(keys[0]) != "").select(*keys).distinct(), keys, "left_anti")


def first_rows(df: DataFrame, order: str, n: int) -> DataFrame:
    return df.orderBy(order).limit(n)


def split_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """Adds is_first: whether the row is its key's first; a null key is a key like any other. The least order comes from a
    partial aggregate and is joined back, so the rows of a hot key aren't gathered in a window. Rows of equal key and order
    are told apart by a hash of all their columns; rows equal in all of them are both first."""
    rows = df.withColumn("__order", F.struct(F.col(order).alias("order"), F.xxhash64(*df.columns).alias("tie")))
    first = rows.groupBy(F.col(key).alias("__key")).agg(F.min("__order").alias("__first"))
    return rows.join(first, F.col(key).eqNullSafe(F.col("__key"))).withColumn("is_first", F.col("__order") == F.col("__first")).drop("__first", "__key", "__order")


def first_reason(reasons: list[tuple[str, Column]], otherwise: str) -> Column:
    """The name of the first condition that holds."""
    out = F.when(F.lit(False), "")
    for name, cond in reasons:
        out = out.when(cond, name)
    return out.otherwise(otherwise)


def codes(pairs: list[tuple[str | Column, Column]]) -> Column:
    """The codes whose conditions hold, in order."""
    return F.filter(F.array(*(F.when(cond, F.lit(code) if isinstance(code, str) else code) for code, cond in pairs)), lambda x: x.isNotNull())


def first_keyed(df: DataFrame, key: str, order: str, value: Column, n: int) -> DataFrame:
    """Of the n keys that come first by the order of their first rows: key, first_idx and the value of the key's last row."""
    per = df.where(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(key).agg(F.min(order).alias("first_idx"), F.max_by(value, F.col(order)).alias("value"))
    return per.orderBy("first_idx").limit(n)
