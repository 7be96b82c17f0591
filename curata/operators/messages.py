"""Chat rows: shape checks, masked labels and padded batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROLES = ("system", "user", "assistant")
IGNORED = -100


def has_chat_shape(messages: Column) -> Column:
    """Exactly a system, a user and an assistant message."""
    return F.coalesce(F.transform(messages, lambda m: m["role"]) == F.array(*map(F.lit, ROLES)), F.lit(False))


def is_trainable(messages: Column) -> Column:
    """The chat shape, and text in every message."""
    return has_chat_shape(messages) & F.forall(messages, lambda m: F.trim(F.coalesce(m["content"], F.lit(""))) != "")


def masked(ids: Column, n_prompt: Column, most: int) -> Column:
    """struct<input_ids, attention_mask, labels, supervised>: ids cut to `most`, the prompt's labels ignored."""
    cut = F.slice(ids, 1, most)
    size = F.size(cut)
    p = F.least(n_prompt, size)
    labels = F.concat(F.array_repeat(F.lit(IGNORED).cast("bigint"), p), F.slice(cut, p + 1, F.greatest(size - p, F.lit(0))))
    return F.struct(cut.alias("input_ids"), F.array_repeat(F.lit(1).cast("bigint"), size).alias("attention_mask"), labels.alias("labels"), (size - p).cast("int").alias("supervised"))


def padded(df: DataFrame, batch: str, pad_id: int = 0) -> DataFrame:
    """input_ids, attention_mask and labels padded on the right to the longest row of the batch."""
    longest = df.groupBy(batch).agg(F.max(F.size("input_ids")).alias("__m"))
    fill = lambda c, v: F.concat(F.col(c), F.array_repeat(F.lit(v).cast("bigint"), F.col("__m") - F.size(c))).alias(c)
    rest = [c for c in df.columns if c not in (batch, "input_ids", "attention_mask", "labels")]
    return df.join(longest, batch).select(batch, *rest, fill("input_ids", pad_id), fill("attention_mask", 0), fill("labels", IGNORED))
