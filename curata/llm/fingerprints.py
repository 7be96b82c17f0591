"""Document fingerprints from closed syncmers, by DataFrame expressions alone.

Letters of the alphabet are words. A k-mer of WIDTH words is a closed syncmer where the least hash among its inner
s-mers of INNER words is the first or the last: a choice by the k-mer alone, whatever stands around it. The chosen
k-mers are the document's anchors. A fingerprint lists anchors by rising hash, each with the word position at which it
first stands, so that two documents can be compared both by the anchors they share and by where these stand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curata.llm.common import ASCII_SPACE, with_chunk

WIDTH, INNER = 5, 2
#: Characters of a block of documents that lie together in id order.
BLOCK_CHARS = 8_000_000


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def anchors(text: Column) -> Column:
    """array<struct<hash: bigint, at: int>> by rising hash: each distinct anchor and its first position."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), ASCII_SPACE), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def chosen(h: Column) -> Column:
        inner = F.transform(F.sequence(F.lit(0), F.size(h) - INNER), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1)))
        last = WIDTH - INNER

        def closed(m: Column) -> Column:
            starts = F.sequence(F.lit(0), F.size(h) - WIDTH)
            edge = lambda i: F.least(F.get(m, i), F.get(m, i + last)) <= F.least(*(F.get(m, i + j) for j in range(1, last)))
            return F.transform(F.filter(starts, edge), lambda i: F.struct(F.xxhash64(*(F.get(h, i + j) for j in range(WIDTH))).alias("hash"), i.cast("int").alias("at")))

        whole = F.array(F.struct(F.xxhash64(F.array_join(h.cast("array<string>"), " ")).alias("hash"), F.lit(0).alias("at")))
        return F.when(F.size(h) >= WIDTH, _let(inner, closed)).when(F.size(h) > 0, whole).otherwise(F.slice(whole, 1, 0))

    def first_of_each(a: Column) -> Column:
        return F.filter(a, lambda x, i: (i == 0) | (F.get(a, i - 1)["hash"] != x["hash"]))

    return _let(F.array_sort(_let(hashes, chosen)), first_of_each)


def fingerprint(text: Column) -> Column:
    """All anchors of a text, however long it is."""
    return anchors(text)


def shown(print_: Column) -> Column:
    """A fingerprint as a string: for each anchor 16 hex digits of its hash, a colon and its position."""
    return F.array_join(F.transform(print_, lambda x: F.concat(F.lpad(F.lower(F.hex(x["hash"])), 16, "0"), F.lit(":"), x["at"].cast("string"))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two fingerprints' anchors, wherever these stand, exact over all of them; two empty ones are alike."""
    x, y = F.transform(a, lambda e: e["hash"]), F.transform(b, lambda e: e["hash"])
    share = _let(F.size(F.array_intersect(x, y)), lambda both: both / (F.size(a) + F.size(b) - both))
    return F.when(F.size(a) + F.size(b) == 0, 1.0).otherwise(share)


def in_place(a: Column, b: Column) -> Column:
    """Positional likeness: Jaccard over anchors with their positions, so an anchor counts as shared only where it first
    stands at the same word of both texts; two empty ones are alike."""
    placed = lambda p: F.transform(p, lambda e: F.xxhash64(e["hash"], e["at"]))  # noqa: E731 - sets of structs are compared pair by pair
    share = _let(F.size(F.array_intersect(placed(a), placed(b))), lambda both: both / (F.size(a) + F.size(b) - both))
    return F.when(F.size(a) + F.size(b) == 0, 1.0).otherwise(share)


def with_next(df: DataFrame, id_col: str, text_col: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Adds next_text: the text of the next row by ascending id, of the first after the last; rows with equal ids follow by
    the hash of their text. Only id and text are kept.

    Ids fall into ranges of about block_chars characters; each block sorts its own rows. The first row of
    each block is copied to the end of the block before, so texts are shuffled once and no task holds all rows. A null id
    comes first.
    """
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    docs = docs.withColumn("tie", F.xxhash64("text"))
    placed, _ = with_chunk(docs, "id", "text", block_chars, name="block")
    # Block -> its first row and the block before it, round the ring; a row a block.
    firsts = placed.groupBy("block").agg(F.min(F.struct(F.col("id").isNotNull().alias("known"), "id", "tie")).alias("first"))
    ring = Window.orderBy("block")
    firsts = firsts.withColumns({"before": F.lag("block").over(ring), "last": F.max("block").over(Window.partitionBy())})
    heads = firsts.select(F.col("block").alias("b"), F.col("first.id").alias("i"), F.col("first.tie").alias("t"), F.coalesce("before", "last").alias("to"))
    copies = placed.join(heads, (F.col("block") == F.col("b")) & F.col("id").eqNullSafe(F.col("i")) & (F.col("tie") == F.col("t")))
    both = placed.select("block", "id", "tie", "text", F.lit(False).alias("copy")).unionAll(copies.select(F.col("to").alias("block"), "id", "tie", "text", F.lit(True).alias("copy")))
    order = Window.partitionBy("block").orderBy("copy", F.col("id").asc_nulls_first(), "tie")
    return both.withColumn("next_text", F.lead("text").over(order)).where("not copy").select(F.col("id").alias(id_col), F.col("text").alias(text_col), "next_text")


def fingerprints(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text, edited text and the fingerprints of the text, the edited and the next text (arrays of anchors).

    The edited text has its last floor(n / 2) code points replaced by the first as many, or all, of the next text. A null
    text is empty, and an empty text has an empty fingerprint; a text of 1 to WIDTH - 1 words has its whole word sequence
    as its one anchor; equal texts have equal fingerprints. Texts of any length are read whole. The only row follows
    itself. An empty table gives an empty result. Other columns of the input are not read.
    """
    n, half = F.length(text_col), F.floor(F.length(text_col) / 2).cast("int")
    edited = F.concat(F.substring(F.col(text_col), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    full = with_next(df, id_col, text_col).withColumn("edited_text", edited)
    return full.select("*", *(fingerprint(F.col(c)).alias(name) for c, name in ((text_col, "anchors"), ("edited_text", "edited_anchors"), ("next_text", "next_anchors"))))
