from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from curata.llm.sharding import communication_matrix, shuffle_into_shards


def test_matrix():
    counts = [0, 5, 1000, 17, 3]
    for seed in range(20):
        m = communication_matrix(counts, 8, seed)
        assert m.sum(1).tolist() == counts and set(m.sum(0).tolist()) <= {1025 // 8, 1025 // 8 + 1} and (m >= 0).all()
    mean = np.mean([communication_matrix([40, 40], 4, s)[0] for s in range(3000)], 0)
    assert np.abs(mean - 10).max() < 0.2
    var = np.var([communication_matrix([40, 40], 4, s)[0, 0] for s in range(3000)])
    assert abs(var - 40 * 0.25 * 0.75 * 40 / 79) < 0.4  # hypergeometric


def test_shards(spark):
    df = spark.range(1003).select((F.col("id") % 900).alias("doc_id"), F.when(F.col("id") % 7 > 0, F.col("id") % 5).alias("x"), F.lit("s").alias("shard")).repartition(5)
    got = shuffle_into_shards(df, ["doc_id", "x"], 8, 3).collect()
    sizes = Counter(r.shard for r in got)
    assert len(got) == 1003 and set(sizes.values()) == {125, 126}
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in sizes.items())
    again = shuffle_into_shards(df.repartition(2), ["doc_id", "x"], 8, 3).collect()
    key = lambda r: (r.doc_id, r.x is None, r.x or 0, r.shard, r.slot)
    assert sorted(map(key, got)) == sorted(map(key, again))
    other = {key(r)[:2]: r.shard for r in shuffle_into_shards(df, ["doc_id", "x"], 8, 4).collect()}
    assert sum(other[key(r)[:2]] == r.shard for r in got) < 300
    assert shuffle_into_shards(df.limit(0), ["doc_id"], 8).count() == 0


def test_spread_is_uniform(spark):
    df = spark.range(8000).select(F.col("id").alias("doc_id"))
    rows = shuffle_into_shards(df, ["doc_id"], 8).collect()
    by = Counter((r.doc_id // 1000, r.shard) for r in rows)
    assert max(by.values()) < 180 and min(by.values()) > 80
