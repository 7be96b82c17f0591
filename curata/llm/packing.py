"""Best-fit decreasing packing of token sequences.

Pieces of one length are alike and bins of one remaining capacity are alike, so best-fit decreasing runs on the counts
of lengths: at most `capacity` lengths, however many documents. A segment tree over remaining capacities finds the
tightest open bin in logarithmic time, for a run of equal pieces at once. The plan it returns, intervals of ranks of a
length with their bins, is applied to all pieces in Spark, where each piece gets its rank among those of its length.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curata.llm import common as C
from curata.llm.word_ids import WordEncoder


#: Pieces of a part, in which one task ranks those of one length.
PART_PIECES = 100_000


class CapacityTree:
    """A segment tree over remaining capacities 0 to n: which of them have an open bin."""

    def __init__(self, n: int) -> None:
        self.size = 1 << n.bit_length()
        self.any = bytearray(2 * self.size)

    def put(self, capacity: int, has: bool) -> None:
        i = capacity + self.size
        self.any[i] = has
        while i > 1:
            i >>= 1
            self.any[i] = self.any[2 * i] | self.any[2 * i + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest capacity >= least that has a bin."""
        i = least + self.size
        if self.any[i]:
            return least
        while i > 1:
            if not i & 1 and self.any[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> tuple[dict[int, list[tuple[int, int, int]]], int]:
    """length -> [(first rank, first bin, offset)], ascending, and the number of bins.

    Pieces of a length with ranks from one first rank to the next go to consecutive bins. The result is best-fit
    decreasing's on the single pieces, up to the names of equal pieces and bins.
    """
    tree = CapacityTree(capacity)
    open_bins: dict[int, list[tuple[int, int]]] = defaultdict(list)  # remaining capacity -> runs of bins [start, end)
    plan: dict[int, list[tuple[int, int, int]]] = {}
    n_bins = 0

    def put(rest: int, start: int, end: int) -> None:
        open_bins[rest].append((start, end))
        tree.put(rest, True)

    for length in sorted((x for x in counts if x > 0 and counts[x] > 0), reverse=True):
        rank, total, out = 0, counts[length], []
        while rank < total:
            rest = tree.tightest(length)
            fresh = rest is None
            rest = capacity if fresh else rest
            per = rest // length  # a bin that has taken one piece is the tightest for the next, until it is full
            if fresh:
                start, end = n_bins, n_bins - (rank - total) // per
            else:
                start, end = open_bins[rest].pop()
            taken = min((end - start) * per, total - rank)
            full, over = divmod(taken, per)
            for k in range(per):
                if n := full + (k < over):
                    out.append((rank, start, capacity - rest + k * length))
                    rank += n
            used = start + full + bool(over)
            if fresh:
                n_bins = used
            elif used < end:
                open_bins[rest].append((used, end))
            if not fresh and not open_bins[rest]:
                tree.put(rest, False)
            if full and rest - per * length:
                put(rest - per * length, start, start + full)
            if over and rest - over * length:
                put(rest - over * length, start + full, used)
        plan[length] = out
    return plan, n_bins


def pieces(df: DataFrame, id_col: str, text_col: str, tokenizer: str, end_id: int, capacity: int, with_ids: bool = False) -> DataFrame:
    """id, piece, start, length, ids_crc32 (and ids) of every text's pieces: its ids and end_id, cut every `capacity`."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.of(tokenizer)
        for batch in C.small_batches(batches, 1):
            offsets, ids = encoder.encode(batch.column(1))
            n = np.diff(offsets)
            doc, piece, start, length, crc, own = [], [], [], [], [], []
            tail = np.array([end_id], "<u4").tobytes()
            flat = np.ascontiguousarray(ids, "<u4").view(np.uint8).data
            for i, size in enumerate((n + 1).tolist()):
                at = int(offsets[i])
                for k in range(0, size, capacity):
                    stop = min(k + capacity, size)
                    x = flat[4 * (at + k) : 4 * (at + min(stop, size - 1))]
                    sum_ = zlib.crc32(x)
                    doc.append(i)
                    piece.append(k // capacity)
                    start.append(k)
                    length.append(stop - k)
                    crc.append(zlib.crc32(tail, sum_) if stop == size else sum_)
                    if with_ids:
                        own.append(np.frombuffer(bytes(x) + tail * (stop == size), "<u4").astype(np.int32))
            columns = [batch.column(0).take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(own, pa.list_(pa.int32()))] if with_ids else columns, names=[*names, "ids"] if with_ids else names)

    C.bound_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(C.tidy(cut), schema)


def pack(df: DataFrame, id_col: str, text_col: str, tokenizer: str, end_id: int = 0, capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    """id_col, piece, start, length, ids_crc32, sequence_id, offset (and ids): all texts' pieces in sequences of at most capacity.

    A text's ids are the file's, without special tokens, then end_id; only texts of more than `capacity` ids are cut.
    A null or empty text is its end_id alone. Rows with equal or null ids are rows of their own, and stay apart. An empty
    table gives an empty result. Only id and text are read, so clashing columns do no harm. Sequences are filled gapless
    from 0. The driver gets the counts of lengths, at most `capacity` numbers.
    """
    spark = df.sparkSession
    made = C.materialise(pieces(df, id_col, text_col, tokenizer, end_id, capacity, with_ids))
    counts = {r[0]: r[1] for r in made.groupBy("length").count().collect()}
    n_parts = max(C.partitions(spark), sum(counts.values()) // PART_PIECES)
    made = made.withColumn("part", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(n_parts)))
    plan, _ = best_fit_decreasing(counts, capacity)
    shared = spark.sparkContext.broadcast({k: tuple(np.array(x, np.int64) for x in zip(*v, strict=True)) for k, v in plan.items()})  # grows with capacity, not with the rows

    # Ranks within a length: by part, then within (length, part), so a frequent length is spread over all parts.
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = made.groupBy("length", "part").count().select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("ahead"))
    ahead = ahead.repartition("length", "part")  # else the join deals all pieces by length alone, which one length may rule
    inner = Window.partitionBy("length", "part").orderBy("id", "piece", "ids_crc32")
    ranked = made.withColumn("place", F.row_number().over(inner)).join(ahead, ["length", "part"]).withColumn("rank", F.col("ahead") + F.col("place") - 1)

    @F.pandas_udf("sequence_id long, offset long")
    def placed(length, rank):  # noqa: ANN001, ANN202
        import pandas as pd

        size, r = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        seq, off = np.zeros(len(r), np.int64), np.zeros(len(r), np.int64)
        for n in np.unique(size):
            ranks, bins, offsets = shared.value[int(n)]
            at = np.flatnonzero(size == n)
            k = np.searchsorted(ranks, r[at], side="right") - 1
            seq[at], off[at] = bins[k] + r[at] - ranks[k], offsets[k]
        return pd.DataFrame({"sequence_id": seq, "offset": off})

    names = ["piece", "start", "length", "ids_crc32"]
    out = ranked.withColumn("at", placed("length", "rank"))
    return out.select(F.col("id").alias(id_col), *names, "at.sequence_id", "at.offset", *(["ids"] if with_ids else []))
