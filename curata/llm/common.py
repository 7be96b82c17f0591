"""What the operators of this subpackage share: the shared folder, word splitting and hashing over Arrow arrays, chunks."""

from __future__ import annotations

import ctypes
import json
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space that separates words, as a Java pattern.
ASCII_SPACE = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors see; one is set beside the warehouse only where it is unset."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Cuts the lineage: df written to the shared folder as Parquet and read again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/curata-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, under: str) -> None:
    """Deletes a folder of intermediate tables."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(under)
    path.getFileSystem(conf).delete(path, True)


class Scratch:
    """Intermediate tables of one operator call, in a folder of their own that goes when the block ends. What the block
    returns must not read them."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.path, self.n = spark, f"{shared_dir(spark)}/curata-{uuid.uuid4().hex}", 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        discard(self.spark, self.path)

    def store(self, df: DataFrame) -> DataFrame:
        """Cuts the lineage: df written and read again."""
        self.n += 1
        path = f"{self.path}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(batches: Iterator[pa.RecordBatch], column: int | str, most_bytes: int = 3_000_000) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about most_bytes of text, a longer text alone, so that work arrays stay small."""
    for batch in batches:
        at = column if isinstance(column, int) else batch.schema.get_field_index(column)
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            so_far = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, so_far + most_bytes, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


#: Bytes of rows that a Python worker gets at once, a longer row alone. Spark's own bounds, 10,000 rows or 64 MB, are held
#: several times by the JVM, beside its heap, and by the worker.
BATCH_BYTES = 2_000_000


def bound_batches(spark: SparkSession) -> None:
    """Sets BATCH_BYTES for the session, whose plans read it when they run; what the session already says stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def release() -> None:
    """Memory that is free goes back to the system. A Python worker lives on through later tasks and stages, and what its
    allocators hold counts for its executor."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's
        trim(0)


def tidy(f: Callable) -> Callable:
    """f over batches, as mapInArrow takes it; free memory is released at a task's end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            release()

    return run


def tidy_group(f: Callable) -> Callable:
    """The same for a function of a key and its group."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        try:
            return f(key, table)
        finally:
            release()

    return run


def tidy_groups(f: Callable) -> Callable:
    """The same for a function of a key and its two groups."""

    def run(key: tuple, table: pa.Table, other: pa.Table) -> pa.Table:
        try:
            return f(key, table, other)
        finally:
            release()

    return run


def split_words(text: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Words [^\\x20\\x09-\\x0D]+ of each text: offsets (n + 1) into the flat words. A null text has none."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    lists = pc.ascii_split_whitespace(pc.fill_null(text, "").cast(pa.large_string()))
    flat, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if not full.all():
        offsets = np.concatenate([[0], np.cumsum(full)])[offsets]
        flat = flat.filter(pa.array(full))
    return offsets, flat


def distinct(flat: pa.Array) -> tuple[list[bytes], np.ndarray]:
    """The distinct values of a string array as bytes, and each row's index into them."""
    if not len(flat):
        return [], np.zeros(0, np.int64)
    coded = flat.dictionary_encode()
    return coded.dictionary.cast(pa.large_binary()).to_pylist(), coded.indices.to_numpy().astype(np.int64)


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each span, one span after another."""
    ends = np.cumsum(sizes)
    if not len(ends):
        return np.zeros(0, np.int64)
    return np.arange(ends[-1]) + np.repeat(starts - (ends - sizes), sizes)


class SpanMemo:
    """Ids of strings, kept by one Python worker between batches: at most `most` strings. Then those that were asked for
    again stay, or none where these are more than half."""

    def __init__(self, most: int) -> None:
        self.most = most
        self.forget()

    def forget(self) -> None:
        self.known: pa.Array = pa.array([], pa.large_binary())
        self.starts, self.sizes, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.again = np.zeros(0, bool)

    def shrink(self) -> None:
        kept = np.flatnonzero(self.again)
        if 2 * len(kept) > self.most:
            return self.forget()
        self.known, sizes = self.known.take(pa.array(kept)), self.sizes[kept]
        self.ids = self.ids[spans(self.starts[kept], sizes)]
        self.starts, self.sizes, self.again = np.cumsum(sizes) - sizes, sizes, np.zeros(len(kept), bool)

    def places(self, keys: pa.Array, learn: Callable[[np.ndarray, list[bytes]], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The memo's entry of each of the distinct keys. What isn't in it yet goes to learn(places in keys, strings), which
        returns the sizes and, one after another, the ids of these."""
        keys = keys.cast(pa.large_binary())
        at = pc.index_in(keys, value_set=self.known)
        place = np.flatnonzero(at.is_null().to_numpy(zero_copy_only=False))
        if len(place) and len(self.known) and len(self.known) + len(place) > self.most:
            self.again[at.drop_null().to_numpy()] = True
            before = len(self.known)
            self.shrink()
            if len(self.known) < before:
                return self.places(keys, learn)
        fresh = keys.take(pa.array(place))
        sizes, ids = learn(place, fresh.to_pylist())
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
        self.sizes, self.ids = np.concatenate([self.sizes, sizes]), np.concatenate([self.ids, ids])
        out = pc.fill_null(at, 0).to_numpy().astype(np.int64)
        self.again[out[at.is_valid().to_numpy(zero_copy_only=False)]] = True
        self.again = np.concatenate([self.again, np.zeros(len(place), bool)])
        out[place] = len(self.known) + np.arange(len(place))
        self.known = pa.concat_arrays([self.known, fresh])
        return out


def word_hashes(flat: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word."""
    words, index = distinct(flat)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))[index]


def rolling(h: np.ndarray, width: int, base: int) -> np.ndarray:
    """Rabin-Karp hashes, modulo 2^64 with an odd base, of every window of `width` values: window i covers h[i : i + width]."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, b = np.zeros(n, np.uint64), np.uint64(base | 1)
    with np.errstate(over="ignore"):
        for j in range(width):
            out *= b
            out += h[j : j + n]
        out ^= out >> np.uint64(31)
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def inside(offsets: np.ndarray, width: int) -> np.ndarray:
    """Which of the windows over flat words lie within one document."""
    n = int(offsets[-1]) - width + 1
    ok = np.zeros(max(n, 0), bool)
    steps = np.zeros(max(n, 0) + 1, np.int64)
    lo, hi = offsets[:-1], offsets[1:] - width + 1
    keep = hi > lo
    np.add.at(steps, lo[keep], 1)
    np.add.at(steps, hi[keep], -1)
    if n > 0:
        ok = np.cumsum(steps)[:n] > 0
    return ok


def pack(sorted_hashes: np.ndarray) -> bytes:
    """Ascending 64-bit hashes as differences, each in as few whole bytes as the largest difference takes."""
    if not len(sorted_hashes):
        return b""
    d = np.diff(sorted_hashes, prepend=np.uint64(0)).astype("<u8")
    first, rest = d[:1].tobytes(), d[1:]
    width = max(1, (int(rest.max()).bit_length() + 7) // 8) if len(rest) else 1
    return bytes([width]) + first + rest.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, np.uint64)
    width, n = blob[0], (len(blob) - 9) // blob[0] + 1
    d = np.zeros((n, 8), np.uint8)
    d[0] = np.frombuffer(blob, np.uint8, 8, 1)
    d[1:, :width] = np.frombuffer(blob, np.uint8, -1, 9).reshape(-1, width)
    with np.errstate(over="ignore"):
        return np.cumsum(d.reshape(-1).view("<u8"), dtype=np.uint64)


#: Characters of a chunk of documents, which one task holds at a time.
CHUNK_CHARS = 4_000_000
#: Bounds that the driver holds at most, however many documents there are, and the rows that it draws for each of them.
RANGES, DRAWN = 8192, 16


def weighted_bounds(ids: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """At most n - 1 ids that part the rows into ranges of about equal weight."""
    by = np.argsort(ids, kind="stable")
    below = np.cumsum(weights[by])
    if n < 2 or not len(by):
        return np.zeros(0, np.int64)
    at = np.searchsorted(below, below[-1] * np.arange(1, n) / n)
    return np.unique(ids[by][np.minimum(at, len(by) - 1)])


def rank_among(x: Column, bounds: np.ndarray) -> Column:
    """How many of the ascending bounds are less than x, which isn't null: a search in two steps, JVM-side."""
    if not len(bounds):
        return F.lit(0).cast("long")
    width = int(np.ceil(np.sqrt(len(bounds))))
    groups = [bounds[i : i + width].tolist() for i in range(0, len(bounds), width)]
    less = lambda a: F.size(F.filter(a, lambda b: b < x))
    whole = less(F.from_json(F.lit(json.dumps([g[0] for g in groups])), "array<bigint>"))
    inside_ = less(F.get(F.from_json(F.lit(json.dumps(groups)), "array<array<bigint>>"), whole - 1))
    return F.when(whole == 0, 0).otherwise((whole - 1) * width + inside_).cast("long")


def with_chunk(df: DataFrame, id_col: str, text_col: str, chunk_chars: int = CHUNK_CHARS, least: int | None = None, name: str = "__chunk", ranges: int = RANGES) -> tuple[DataFrame, int]:
    """df with the number (long) of a range of ids of about chunk_chars characters, and about how many ranges there are, by
    default at least two a partition. Numbers ascend with the id; a null id is the least; equal ids share a range.

    The driver draws a bounded number of rows and parts the ids into at most `ranges` ranges by their characters; what asks
    for more has each range parted again by its own quantiles, in a table that is joined. Where bounds fall changes the
    tasks' sizes alone, no result. Ids must be integers.
    """
    if not isinstance(df.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col}: ids must be integers, not {df.schema[id_col].dataType.simpleString()}")
    spark, own = df.sparkSession, F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))
    sizes = df.select(own.alias("id"), F.coalesce(F.length(text_col), F.lit(0)).alias("n"))
    chars, rows = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    n = min(max(chars // chunk_chars, least or 2 * partitions(spark)), max(rows // 8, 1))
    if n < 2:
        return df.withColumn(name, F.lit(0).cast("long")), 1
    first = min(n, ranges)
    drawn = sizes.sample(min(1.0, 2 * DRAWN * first / rows), 7).toArrow()  # about 2 * DRAWN rows a range at most
    bounds = weighted_bounds(drawn["id"].to_numpy(), drawn["n"].to_numpy() + 1, first)
    placed = df.withColumn(name, rank_among(own, bounds))
    per = -(-n // first)
    if per > 1:
        cuts = placed.groupBy(F.col(name).alias("__range")).agg(F.percentile_approx(own, [i / per for i in range(1, per)], 4 * per + 1000).alias("__cuts"))
        inner = F.size(F.filter(F.array_distinct("__cuts"), lambda c: c < own))
        placed = placed.join(materialise(cuts), F.col(name) == F.col("__range")).withColumn(name, F.col(name) * per + inner).drop("__range", "__cuts")
    return placed, n
