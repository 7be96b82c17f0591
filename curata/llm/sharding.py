"""A uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

Rows first fall into hash partitions. Given only the partitions' row counts, the driver draws how many rows each
partition sends to each shard (a multivariate hypergeometric matrix whose column sums are the shard sizes). Each
partition permutes its rows and deals them out by its row of the matrix; after the exchange each shard permutes again.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curata.llm.common import partitions

#: Rows of a partition and of a piece of a shard, at which their number grows with the input.
ROWS_PER_PART = 1_000_000


def communication_matrix(counts: list[int], n_shards: int, seed: int) -> np.ndarray:
    """How many rows go from each partition to each shard: rows sum to counts, columns to shard sizes at most one apart."""
    total, rng = sum(counts), np.random.default_rng(seed)
    left = np.array([total // n_shards + (s < total % n_shards) for s in range(n_shards)], np.int64)
    out = np.zeros((len(counts), n_shards), np.int64)
    for p, n in enumerate(counts):
        rest, pool = int(n), int(left.sum())
        for s in range(n_shards):
            if rest == 0:
                break
            pool -= int(left[s])
            out[p, s] = rest if pool == 0 else _draw(rng, int(left[s]), pool, rest)
            rest -= int(out[p, s])
        left -= out[p]
    return out


def _draw(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """A hypergeometric draw; numpy's takes populations below 10^9, larger ones are drawn in halves of the sample."""
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, n)) if good and n else 0
    got, at = 0, 0
    while at < n:  # without replacement, in steps small against the population: the binomial step is corrected by what is left
        step = min(n - at, max(1, (good + bad - at) // 1000))
        hit = int(rng.binomial(step, (good - got) / (good + bad - at)))
        hit = max(min(hit, good - got), step - (bad - (at - got)), 0)
        got, at = got + hit, at + step
    return got


def shuffle_into_shards(df: DataFrame, key_cols: list[str], n_shards: int, seed: int = 0) -> DataFrame:
    """Adds shard (int, from 0) and slot (long, gapless from 0 in each shard) to every row.

    key_cols: what rows are told apart by; rows equal in all of them may swap places. Null keys are values like any
    other. An empty table gives an empty result. Own columns named shard or slot are replaced; other columns ride along,
    so select what is needed first. Deterministic: a lost task deals its rows out as before. No text is compared.
    """
    spark = df.sparkSession
    df = df.drop("shard", "slot")
    rows = df.count()
    n_parts = max(partitions(spark), -(-rows // ROWS_PER_PART))
    keys = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in key_cols]
    mixed = lambda salt: F.xxhash64(F.lit(f"{seed}/{salt}"), *keys)
    dealt = df.withColumns({"__part": F.pmod(mixed("part"), F.lit(n_parts)).cast("int"), "__first": mixed("first"), "__second": mixed("second")})
    counts = dict(dealt.groupBy("__part").count().collect())  # one number a partition
    matrix = communication_matrix([counts.get(p, 0) for p in range(n_parts)], n_shards, seed)
    ends = spark.createDataFrame([(p, [int(x) for x in np.cumsum(r)]) for p, r in enumerate(matrix)], "__part int, __ends array<bigint>")

    local = Window.partitionBy("__part").orderBy("__first", *key_cols)
    sent = dealt.withColumn("__rank", F.row_number().over(local).cast("long") - 1).join(ends, "__part")
    sent = sent.withColumn("shard", F.size(F.filter("__ends", lambda e: e <= F.col("__rank"))).cast("int"))

    # The second permutation orders a shard by a fresh hash; its high bits part it into pieces, so no task holds a shard.
    pieces = max(1, -(-n_parts // n_shards))
    sent = sent.withColumn("__piece", F.floor((F.shiftrightunsigned("__second", 33)) * pieces / F.lit(2**31)).cast("int"))
    before = Window.partitionBy("shard").orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sent.groupBy("shard", "__piece").count().withColumn("__before", F.coalesce(F.sum("count").over(before), F.lit(0)))
    again = Window.partitionBy("shard", "__piece").orderBy("__second", *key_cols)
    out = sent.withColumn("__at", F.row_number().over(again).cast("long") - 1).join(sizes, ["shard", "__piece"])
    return out.withColumn("slot", F.col("__before") + F.col("__at")).select(*df.columns, "shard", "slot")
