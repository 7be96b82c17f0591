"""Quality rules whose thresholds adapt to each language and source, from mergeable quantile sketches.

A sketch is a histogram over logarithmic buckets (relative error alpha). Sketches merge by adding counts, so they are
one groupBy with partial sums, exact under any order of merging, and the same after a lost task.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curata.llm import common as C

METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: The characters that count as symbols.
SYMBOLS = "[#*$%&|<>]"
#: Rate -> the least spread between its quartiles: slack for groups whose quartiles are equal, as where nearly all rates are 0.
RATES = {"symbols_per_word": 0.01, "dup_line_words": 0.01, "chars_per_word": 0.25}
ALPHA = 0.01
GAMMA = (1 + ALPHA) / (1 - ALPHA)
#: Rows in a group, below which its language's merged sketch is used, then that of all rows.
LEAST_ROWS = 200


def measure(text: pa.Array) -> dict[str, np.ndarray]:
    """The base metrics of each text, by whole texts."""
    text = pc.fill_null(text, "")
    offsets, flat = C.split_words(text)
    n, words = len(text), np.diff(offsets)
    chars = np.concatenate([[0], np.cumsum(pc.utf8_length(flat).to_numpy())])
    repeated = np.zeros(n, np.int64)
    at = np.flatnonzero(C.inside(offsets, 5))
    if len(at):
        h = C.rolling(C.word_hashes(flat), 5, 0x9E3779B97F4A7C15)[at]
        doc = np.searchsorted(offsets, at, side="right") - 1
        by = np.lexsort((h, doc))
        same = (h[by[1:]] == h[by[:-1]]) & (doc[by[1:]] == doc[by[:-1]])
        twice = np.zeros(len(h), bool)
        twice[by[1:]] |= same
        twice[by[:-1]] |= same
        steps = np.zeros(int(offsets[-1]) + 1, np.int64)
        np.add.at(steps, at[twice], 1)
        np.add.at(steps, at[twice] + 5, -1)
        cover = np.concatenate([[0], np.cumsum(np.cumsum(steps)[:-1] > 0)])
        repeated = cover[offsets[1:]] - cover[offsets[:-1]]
    dup = np.zeros(n, np.int64)
    lines = pc.split_pattern(text.cast(pa.large_string()), "\n")
    many = np.flatnonzero(np.diff(lines.offsets.to_numpy()) > 1)
    has_word = re.compile(r"[^\x20\x09-\x0D]").search
    for i in many:
        full = [x for x in lines[int(i)].as_py() if has_word(x)]
        dup[i] = len(full) - len(set(full))
    return {
        "n_words": words,
        "word_chars": chars[offsets[1:]] - chars[offsets[:-1]],
        "n_symbols": pc.count_substring_regex(text, SYMBOLS).to_numpy().astype(np.int64),
        "n_dup_lines": dup,
        "n_repeat_words": repeated,
    }


def with_metrics(df: DataFrame, text_col: str) -> DataFrame:
    """Adds the METRICS (bigint); input columns of these names are replaced. Null texts count as empty."""
    df = df.drop(*METRICS)
    C.bound_batches(df.sparkSession)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.small_batches(batches, text_col):
            got = measure(batch.column(batch.schema.get_field_index(text_col)))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(got[m].astype(np.int64)) for m in METRICS)], names=[*batch.schema.names, *METRICS])

    return df.mapInArrow(C.tidy(add), T.StructType([*df.schema.fields, *(T.StructField(m, T.LongType()) for m in METRICS)]))


def rates() -> dict[str, Column]:
    """What the thresholds bound; 0 without words."""
    share = lambda x: F.when(F.col("n_words") > 0, F.col(x) / F.col("n_words")).otherwise(0.0)
    return {"symbols_per_word": share("n_symbols"), "dup_line_words": share("n_dup_lines"), "chars_per_word": share("word_chars")}


def sketch(df: DataFrame, groups: list[str]) -> DataFrame:
    """groups, rate, bucket, n: the sketch of each rate in each group; bucket null holds the zeros."""
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("rate"), v.alias("x")) for k, v in rates().items())))
    long = df.select(*groups, pairs.alias("p"))
    bucket = F.when(F.col("p.x") > 0, F.ceil(F.log(F.col("p.x")) / math.log(GAMMA)).cast("int"))
    return long.groupBy(*groups, F.col("p.rate").alias("rate"), bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def merge(sketches: DataFrame, groups: list[str]) -> DataFrame:
    return sketches.groupBy(*groups, "rate", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, groups: list[str], shares: dict[str, float]) -> DataFrame:
    """groups, rate, n and a column for each share: the least bucket's value at which that share of the rows is reached."""
    w = Window.partitionBy(*groups, "rate")
    cum = sketches.withColumns({"__below": F.sum("n").over(w.orderBy(F.col("bucket").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)), "__all": F.sum("n").over(w)})
    value = F.when(F.col("bucket").isNull(), 0.0).otherwise(F.pow(F.lit(GAMMA), F.col("bucket")) * (2 / (1 + GAMMA)))
    return cum.groupBy(*groups, "rate").agg(F.max("__all").alias("n"), *(F.min(F.when(F.col("__below") >= F.col("__all") * q, value)).alias(k) for k, q in shares.items()))


def thresholds(df: DataFrame, groups: list[str]) -> DataFrame:
    """The limit of each rate in each group: Tukey's far fence, high + 3 * (high - low) of the sketch's quartiles, with at
    least the rate's slack between these. Junk that is less than a quarter of a group doesn't move its limit.

    Groups of fewer than LEAST_ROWS rows take the limit of the sketch merged over all groups with the same first column,
    and where that has fewer rows too, of the sketch merged over all rows.
    """
    own = sketch(df, groups)
    shares = {"low": 0.25, "high": 0.75}
    slack = F.create_map(*(x for k, v in RATES.items() for x in (F.lit(k), F.lit(v))))[F.col("rate")]
    limit = F.col("high") + 3 * F.greatest(slack, F.col("high") - F.col("low"))
    fine = quantiles(own, groups, shares).withColumn("limit", limit).select(*groups, "rate", "n", "limit")
    coarse = quantiles(merge(own, groups[:1]), groups[:1], shares).withColumn("limit", limit).select(F.col(groups[0]).alias("__g"), F.col("rate").alias("__rate"), F.col("n").alias("__n"), F.col("limit").alias("__wide"))
    every = quantiles(merge(own, []), [], shares).withColumn("limit", limit).select(F.col("rate").alias("__r"), F.col("limit").alias("__all"))
    both = fine.join(coarse, F.col(groups[0]).eqNullSafe(F.col("__g")) & (F.col("rate") == F.col("__rate"))).join(F.broadcast(every), F.col("rate") == F.col("__r"))
    best = F.when(F.col("n") >= LEAST_ROWS, F.col("limit")).when(F.col("__n") >= LEAST_ROWS, F.col("__wide")).otherwise(F.col("__all"))
    return both.groupBy(*groups).pivot("rate", list(RATES)).agg(F.first(best))


def apply_rules(df: DataFrame, text_col: str, groups: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """Adds the METRICS, base_failed and kept.

    base_failed: fewer than 10 words, or more than 20 % of the words in repeated 5-word windows. Else kept tells whether
    every rate stays within the limit of the document's group. Null groups are groups of their own; a null or empty text
    has no words and fails; equal texts in one group get equal verdicts; an empty table gives an empty result. Input
    columns named like the added ones are replaced.
    """
    own = ("base_failed", "kept")
    measured = with_metrics(df.drop(*own), text_col)  # measured once for the sketches and again for the verdicts
    limits = C.materialise(thresholds(with_metrics(df.select(text_col, *groups), text_col), list(groups)))  # a row a group: Spark knows its size
    limits = limits.select(*(F.col(g).alias(f"__{g}") for g in groups), *(F.col(r).alias(f"__limit_{r}") for r in RATES))
    on = [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in groups]
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    within = F.lit(True)
    for r, x in rates().items():
        within &= x <= F.col(f"__limit_{r}")
    joined = measured.join(limits, on, "left")
    return joined.withColumns({"base_failed": failed, "kept": ~failed & F.coalesce(within, F.lit(True))}).select(*measured.columns, *own)
