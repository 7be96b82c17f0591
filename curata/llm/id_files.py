"""Token-id files: an adaptive context-mixing range coder in independently reset, checksummed blocks.

A file is a Parquet container of chunks, ranges of ascending document ids. A chunk holds its documents' ids and sizes, its
order-0 and order-1 predictions and blocks of up to BLOCK ids. Order 0 is a distribution over the chunk's distinct ids;
order 1 is one over the successors of each frequent id; order 2 learns within the block which id last followed the same two
ids, with a confidence from how often it was right. For each order-2 confidence and each class of order-1 context a block
learns the weights of the three predictions, and the range coder codes the prediction that holds the id, by its weight, and
the id by that prediction. Each block starts from the same state, so any block can be decoded with its chunk's predictions
alone, and carries a crc32 of its ids.

All blocks of a chunk are coded in step, one id of each block at a time, as numpy arrays over the blocks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curata.llm import common as C
from curata.llm.word_ids import WordEncoder

BLOCK = 2048
#: Bytes of text whose words are looked up at a time, about a chunk's: each look-up goes over the whole memo.
WORD_BYTES = 7_000_000
TABLE_BITS, MIX_BITS, ORDER1_BITS, ORDER0_BITS = 11, 16, 12, 18
#: Occurrences of an id from which on it has a distribution of its own over what follows it, and of a pair in it.
LEAST_CONTEXT, LEAST_PAIR = 512, 3
#: Where a block's weights move to, by the prediction that held the id: order 2, order 1, order 0. Sums from below in one
#: number's fields of 16 bits: none, the first, the second and, as its low 16 bits, the whole. So both weights move by one
#: operation, and a shift by 16 bits for each prediction before it brings a prediction's own to the low two fields.
RATE = 5
TO = np.array([first << 16 | second << 32 for first, second in ((64000, 64768), (768, 64768), (768, 1536))], np.uint64) >> np.uint64(RATE)
FIELD, LOW, HALF, MOVED = np.uint64(16), np.uint64(0xFFFF), np.uint64(32), np.uint64(0x7FF07FF0000)
#: An id's interval in one number: start, size from bit SIZE_AT on, for the encoder the bits of its distribution and the
#: prediction that holds it, for the decoder its place.
SIZE_AT, BITS_AT, KIND_AT, PLACE_AT = (np.uint64(x) for x in (20, 40, 48, 40))
PART, BYTE = np.uint64((1 << 20) - 1), np.uint64(0xFF)
WHOLE = np.uint64(1 << 20)  # all of an interval, as order 2 takes it
#: Confidences of order 2, in an entry's bits below the id.
LEAST_SURE, SURE = 4, 12
#: The next confidence, by the one so far and, added to it, whether it was right.
NEXT_SURE = np.array([min(s + LEAST_SURE, SURE) if hit else LEAST_SURE * (s > LEAST_SURE) for s in range(0, SURE + 1, LEAST_SURE) for hit in (0, 1, 1, 1)], np.uint16)
FULL = np.uint64(1 << 32)
FILE_SCHEMA = "chunk long, n_ids long, doc_ids array<{id}>, doc_sizes array<int>, symbols binary, frequencies binary, successors binary, block_sizes array<int>, block_crc32 array<long>, blocks array<binary>"


def shares(counts: np.ndarray, group: np.ndarray, groups: int, bits: int) -> np.ndarray:
    """Frequencies of at least 1 that sum to 2 ^ bits in each group; rows of a group stand together."""
    total = np.bincount(group, weights=counts, minlength=groups).astype(np.int64)
    n = np.bincount(group, minlength=groups)
    out = 1 + counts * ((1 << bits) - n)[group] // np.maximum(total, 1)[group]
    rest = (1 << bits) - np.bincount(group, weights=out, minlength=groups).astype(np.int64)
    by = np.lexsort((-out, group))
    first = by[np.append(True, group[by][1:] != group[by][:-1])] if len(by) else by
    out[first] += rest[group[first]]
    return out


@dataclass
class Predictions:
    """A chunk's order 0 and order 1. Entries are the successors of all contexts, then the distinct ids."""

    symbols: np.ndarray  # the distinct ids, ascending; below, an id goes by its place here
    freq: np.ndarray  # of each, sum 2 ^ ORDER0_BITS
    contexts: np.ndarray  # ids that have successors, ascending
    sizes: np.ndarray  # how many
    successors: np.ndarray  # ascending within a context
    succ_freq: np.ndarray  # sum 2 ^ ORDER1_BITS in each context

    @classmethod
    def of(cls, places: np.ndarray, symbols: np.ndarray) -> tuple[Predictions, np.ndarray]:
        """The predictions, and for each id but the first its entry among the successors of the one before it, or -1."""
        n = len(symbols)
        freq = shares(np.bincount(places, minlength=n), np.zeros(n, np.int64), 1, ORDER0_BITS) if n else np.zeros(0, np.int64)
        total = np.bincount(places[:-1], minlength=n)
        entry, found, most = np.full(max(len(places) - 1, 0), -1, np.int32), [], 0
        frequent = np.flatnonzero(total >= LEAST_CONTEXT)
        # Pairs are counted in a table of so many contexts at a time that it is about as large as the places are.
        for own in np.array_split(frequent, -(-len(frequent) * n // max(4 * len(places), n, 1))) if len(frequent) else []:
            rank = np.full(n, -1, np.int64)
            rank[own] = np.arange(len(own)) * n
            at = rank.take(places[:-1])
            here = slice(None) if (at >= 0).all() else np.flatnonzero(at >= 0)
            pair = at[here] + places[1:][here]
            count = np.bincount(pair, minlength=len(own) * n)
            kept = np.flatnonzero((count >= LEAST_PAIR) & (count << ORDER1_BITS >= np.repeat(total[own], n)))
            number = np.full(len(count), -1, np.int32)
            number[kept] = most + np.arange(len(kept))
            entry[here], most = number.take(pair), most + len(kept)
            found.append((own[kept // n], kept % n, count[kept]))
        context, after, count = (np.concatenate([np.zeros(0, np.int64), *(x[k] for x in found)]) for k in range(3))
        contexts, group, sizes = np.unique(context, return_inverse=True, return_counts=True)
        return cls(symbols, freq, contexts, sizes, after, shares(count, group, len(contexts), ORDER1_BITS)), entry

    def pack(self) -> dict:
        z = lambda *xs: zlib.compress(b"".join(np.asarray(x, t).tobytes() for x, t in xs), 6)
        first = np.zeros(len(self.successors), bool)
        first[np.cumsum(self.sizes) - self.sizes] = True
        steps = np.where(first, self.successors, np.diff(self.successors, prepend=0))
        head = (np.array([len(self.contexts), len(steps)]), "<u4")
        return {
            "symbols": z((np.diff(self.symbols.astype(np.int64), prepend=0), "<u4")),
            "frequencies": z((self.freq, "<u4")),
            "successors": z(head, (np.diff(self.contexts, prepend=0), "<u4"), (self.sizes, "<u4"), (steps, "<u4"), (self.succ_freq, "<u2")),
        }

    @classmethod
    def unpack(cls, chunk: dict) -> Predictions:
        raw = {k: zlib.decompress(chunk[k]) for k in ("symbols", "frequencies", "successors")}
        n, m = np.frombuffer(raw["successors"], "<u4", 2).tolist()
        rest = np.frombuffer(raw["successors"], "<u4", 2 * n + m, 8).astype(np.int64)
        sizes, steps = rest[n : 2 * n], rest[2 * n :]
        sums = np.cumsum(steps)
        starts = np.cumsum(sizes) - sizes
        succ = sums - np.repeat(sums[starts] - steps[starts], sizes)
        freq = np.frombuffer(raw["successors"], "<u2", m, 8 + 4 * (2 * n + m)).astype(np.int64)
        return cls(np.cumsum(np.frombuffer(raw["symbols"], "<u4"), dtype=np.uint32), np.frombuffer(raw["frequencies"], "<u4").astype(np.int64), np.cumsum(rest[:n]), sizes, succ, freq)

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each entry its id, where its interval starts and the interval's size."""
        start = lambda f, group_sizes: np.cumsum(f) - f - np.repeat((np.cumsum(f) - f)[np.cumsum(group_sizes) - group_sizes], group_sizes)
        one = start(self.succ_freq, self.sizes) if len(self.sizes) else np.zeros(0, np.int64)
        return np.concatenate([self.successors, np.arange(len(self.freq))]), np.concatenate([one, np.cumsum(self.freq) - self.freq]).astype(np.uint64), np.concatenate([self.succ_freq, self.freq]).astype(np.uint64)

    def classes(self) -> np.ndarray:
        """Of each id, and of no id at a block's start, the class of its successors: none, or by how many they are."""
        out = np.zeros(len(self.symbols) + 1, np.int64)
        out[self.contexts] = 1 + (self.sizes > 16) + (self.sizes > 64)
        return out


class _Mix:
    """Order 2 and the weights of all blocks, each from the same start."""

    def __init__(self, lanes: int, n_ids: int) -> None:
        # (id + 1) << 4 | confidence; narrow where ids allow it, for its places are far apart in memory
        self.table = np.zeros(lanes << TABLE_BITS, np.uint16 if n_ids < 4095 else np.int32)
        self.base = np.arange(lanes, dtype=np.int64) << TABLE_BITS
        self.row = np.arange(lanes, dtype=np.int64) << 4
        start = np.array([[960, 51200], [9600, 54400], [22400, 57600], [41600, 60800]], np.uint64)  # by confidence
        own = np.repeat(start, 4, 0)
        own[::4, 1] = own[::4, 0] + np.uint64(768)  # without successors
        self.weights = np.tile(own[:, 0] << FIELD | own[:, 1] << HALF, lanes)

    def learn(self, i: np.ndarray, held: np.ndarray, sure: np.ndarray, hit: np.ndarray, s1: np.ndarray, row: np.ndarray, w: np.ndarray, kind: np.ndarray) -> None:
        """held: the entries without their confidence; s1: (id + 1) << 4, of the table's type, equal to held at a hit; w: the weights in use."""
        self.table[i] = np.where(sure > LEAST_SURE, held, s1) | NEXT_SURE.take(sure + hit)
        self.weights[row] = w - (w >> np.uint64(RATE) & MOVED) + TO.take(kind)


def _hash(p2: np.ndarray, p1: np.ndarray) -> np.ndarray:
    return ((p2 * 0x2F0B4C47 + p1 * 0x9E3779B1) >> 15) & ((1 << TABLE_BITS) - 1)


def encode_blocks(places: np.ndarray, entry: np.ndarray, sizes: np.ndarray, model: Predictions) -> list[bytes]:
    """places: ids by their place in the model, one block after another; all blocks but the last have equal sizes."""
    lanes, longest = len(sizes), int(sizes.max(initial=0))
    if not lanes:
        return []
    n_ids, order0 = len(model.symbols), len(model.successors)

    def grid(x: np.ndarray) -> np.ndarray:
        out = np.zeros(lanes * longest, np.int32)
        out[: len(x)] = x
        return np.ascontiguousarray(out.reshape(lanes, longest).T)

    own = np.concatenate([[-1], entry])
    own[np.cumsum(sizes) - sizes] = -1
    g_place, g_own = grid(places), grid(np.where(own < 0, order0 + places, own))
    del own
    _, start, freq = model.entries()
    intervals = start | freq << SIZE_AT
    intervals[:order0] |= np.uint64(ORDER1_BITS) << BITS_AT | np.uint64(16) << KIND_AT
    intervals[order0:] |= np.uint64(ORDER0_BITS) << BITS_AT | np.uint64(32) << KIND_AT
    m, classes = _Mix(lanes, n_ids), model.classes()
    p1, p2 = np.full(lanes, n_ids, np.int64), np.full(lanes, n_ids, np.int64)
    active = np.searchsorted(-sizes, -np.arange(longest), side="left")
    out, filled = np.zeros((lanes, longest + 4), np.uint32), np.ones(lanes, np.int64)
    low, width = np.zeros(lanes, np.uint64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
    mix, four = np.uint64(MIX_BITS), np.uint64(4)
    with np.errstate(over="ignore"):
        for t in range(longest):
            n = int(active[t])
            p2, p1, place = p2[:n], p1[:n], g_place[t, :n]
            i, s1 = m.base[:n] + _hash(p2, p1), (place + 1 << 4).astype(m.table.dtype)
            g = m.table.take(i)
            sure = g & SURE
            held = g - sure
            hit = held == s1
            row = m.row[:n] + classes.take(p1) + sure
            w = m.weights.take(row)
            interval = np.where(hit, WHOLE, intervals.take(g_own[t, :n]))
            kind = interval >> KIND_AT
            own = w >> kind
            unit = width[:n] >> mix
            add, r = unit * (own & LOW), unit * ((own >> FIELD) - own & LOW)
            unit = r >> (interval >> BITS_AT & BYTE)
            add += unit * (interval & PART)
            width[:n] = r = unit * (interval >> SIZE_AT & PART)
            low[:n] += add
            if (over := low[:n] < add).any():
                for lane in np.flatnonzero(over).tolist():  # a carry into what has been moved out
                    k = filled[lane] - 1
                    while out[lane, k] == 0xFFFFFFFF:
                        out[lane, k] = 0
                        k -= 1
                    out[lane, k] += 1
            if len(at := np.flatnonzero(r < FULL)):
                x = low[at]
                out[at, filled[at]] = x >> np.uint64(32)
                filled[at] += 1
                low[at], width[at] = x << np.uint64(32), r[at] << np.uint64(32)
            m.learn(i, held, sure, hit, s1, row, w, (kind >> four).view(np.int64))
            p2, p1 = p1, place.astype(np.int64)
    every = np.arange(lanes)
    for k in (0, 1):
        out[every, filled + k] = (low >> np.uint64(32 * (1 - k))).astype(np.uint32)
    return [out[i, 0 if out[i, 0] else 1 : filled[i] + 2].astype("<u4").tobytes() for i in range(lanes)]


def decode_blocks(blocks: list[bytes], sizes: np.ndarray, model: Predictions) -> np.ndarray:
    """The places of all blocks' ids, one block after another."""
    lanes, longest = len(sizes), int(sizes.max(initial=0))
    if not lanes:
        return np.zeros(0, np.int64)
    words = np.zeros((lanes, max(map(len, blocks)) // 4 + 3), np.uint64)
    for i, x in enumerate(blocks):
        words[i, : len(x) // 4] = np.frombuffer(x, "<u4")
    symbol, start, freq = model.entries()
    interval = start | freq << SIZE_AT | symbol.astype(np.uint64) << PLACE_AT
    n_ids = len(model.symbols)
    # For each place in a distribution the interval there: all contexts, then order 0.
    interval_at = np.repeat(interval, np.concatenate([model.succ_freq, model.freq]))
    order0_at, classes = len(model.contexts) << ORDER1_BITS, model.classes()
    context_at = np.zeros(n_ids + 1, np.int64)
    context_at[model.contexts] = np.arange(len(model.contexts)) << ORDER1_BITS
    active = np.searchsorted(-sizes, -np.arange(longest), side="left")
    m, grid, read = _Mix(lanes, n_ids), np.zeros((longest, lanes), np.int32), np.full(lanes, 2, np.int64)
    v, width = (words[:, 0] << np.uint64(32)) | words[:, 1], np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
    p1, p2 = np.full(lanes, n_ids, np.int64), np.full(lanes, n_ids, np.int64)
    # By the prediction that held the id, of which order 2 has no distribution.
    fields, bits = np.array([0, 16, 32], np.uint64), np.array([ORDER1_BITS, ORDER1_BITS, ORDER0_BITS], np.uint64)
    mix, most = np.uint64(MIX_BITS), (np.int64(1) << bits.view(np.int64)) - 1
    with np.errstate(over="ignore"):
        for t in range(longest):
            n = int(active[t])
            p2, p1, v, width = p2[:n], p1[:n], v[:n], width[:n]
            i = m.base[:n] + _hash(p2, p1)
            g = m.table.take(i)
            sure = g & SURE
            held = g - sure
            row = m.row[:n] + classes.take(p1) + sure
            w = m.weights.take(row)
            x, unit = v, width >> mix
            t0, t1 = unit * (w >> FIELD & LOW), unit * (w >> HALF)
            hit, plain = x < t0, x >= t1
            kind = (x >= t0).view(np.int8) + plain.view(np.int8)
            own = w >> fields.take(kind)
            x = x - unit * (own & LOW)
            r = unit * ((own >> FIELD) - own & LOW)
            unit = r >> bits.take(kind)
            place = np.minimum((x // unit).view(np.int64), most.take(kind))  # weights keep unit over 0
            own = interval_at.take(np.where(plain, order0_at, context_at.take(p1)) + place)
            s = np.where(hit, (held >> 4).astype(np.int64) - 1, (own >> PLACE_AT).view(np.int64))
            x = np.where(hit, x, x - unit * (own & PART))
            r = np.where(hit, r, unit * (own >> SIZE_AT & PART))
            if len(at := np.flatnonzero(r < FULL)):
                r[at] <<= np.uint64(32)
                x[at] = (x[at] << np.uint64(32)) | words[at, np.minimum(read[at], words.shape[1] - 1)]
                read[at] += 1
            v, width = x, r
            grid[t, :n] = s
            m.learn(i, held, sure, hit, (s + 1 << 4).astype(m.table.dtype), row, w, kind)
            p2, p1 = p1, s
    grid = grid.T
    return np.ascontiguousarray(grid)[np.arange(longest)[None, :] < sizes[:, None]].astype(np.int64)


def encode_chunk(ids: np.ndarray) -> dict:
    """A chunk's ids as the columns of the file."""
    symbols = np.flatnonzero(np.bincount(ids))  # vocabularies are small, so this takes the place of a sort
    place_of = np.zeros(int(symbols.max(initial=0)) + 1, np.int64)
    place_of[symbols] = np.arange(len(symbols))
    places = place_of[ids]
    model, entry = Predictions.of(places, symbols)
    sizes = np.full(-(-len(ids) // BLOCK), BLOCK, np.int64)
    if len(sizes):
        sizes[-1] = len(ids) - BLOCK * (len(sizes) - 1)
    flat = np.ascontiguousarray(ids, "<u4")
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    return model.pack() | {
        "block_sizes": sizes.tolist(),
        "block_crc32": [zlib.crc32(flat[s:e].view(np.uint8).data) for s, e in zip(cuts[:-1], cuts[1:], strict=True)],
        "blocks": encode_blocks(places, entry, sizes, model),
    }


def decode_chunk(chunk: dict) -> np.ndarray:
    """A chunk's ids; a block whose checksum doesn't hold is an error."""
    model = Predictions.unpack(chunk)
    sizes = np.array(chunk["block_sizes"], np.int64)
    ids = model.symbols[decode_blocks(chunk["blocks"], sizes, model)].astype("<u4") if len(sizes) else np.zeros(0, "<u4")
    at = 0
    for k, (size, crc) in enumerate(zip(sizes.tolist(), chunk["block_crc32"], strict=True)):
        if zlib.crc32(ids[at : at + size].view(np.uint8).data) != crc:
            raise ValueError(f"block {k} of chunk {chunk['chunk']}: the checksum doesn't hold")
        at += size
    return ids


def write(df: DataFrame, id_col: str, text_col: str, path: str, tokenizer: str, end_id: int, chunk_chars: int = 6_000_000) -> None:
    """Writes every text's ids and end_id to files at path, in ascending order of the document's id.

    A null or empty text is its end_id alone; a null id comes first; rows with equal ids stand side by side. Only id and
    text are read. An empty table gives files without chunks.
    """
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    chunked, _ = C.with_chunk(docs, "id", "text", chunk_chars, df.sparkSession.sparkContext.defaultParallelism)
    kind = docs.schema["id"].dataType.simpleString()

    def encode(key: tuple, table: pa.Table) -> pa.Table:
        id_type = table["id"].type
        table = table.sort_by([("id", "ascending")]) if table["id"].null_count == 0 else table.take(pa.compute.sort_indices(table, [("id", "ascending")], null_placement="at_start"))
        parts, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for batch in C.small_batches(iter(table.combine_chunks().to_batches()), "text", WORD_BYTES):
            offsets, ids = WordEncoder.of(tokenizer).encode(batch["text"])
            parts.append(np.insert(ids, offsets[1:], np.uint32(end_id)))
            sizes.append(np.diff(offsets) + 1)
        all_ids, doc_ids = np.concatenate(parts), table["id"].to_pylist()
        del parts, table
        row = encode_chunk(all_ids)
        row |= {"chunk": key[0].as_py(), "n_ids": len(all_ids), "doc_ids": doc_ids, "doc_sizes": np.concatenate(sizes).tolist()}
        types = {"chunk": pa.int64(), "n_ids": pa.int64(), "doc_ids": pa.list_(id_type), "doc_sizes": pa.list_(pa.int32()), "symbols": pa.binary(), "frequencies": pa.binary(), "successors": pa.binary(), "block_sizes": pa.list_(pa.int32()), "block_crc32": pa.list_(pa.int64()), "blocks": pa.list_(pa.binary())}
        return pa.table({k: pa.array([row[k]], t) for k, t in types.items()})

    chunked.groupBy("__chunk").applyInArrow(encode, FILE_SCHEMA.format(id=kind)).write.option("compression", "none").parquet(path)


def read(spark: SparkSession, path: str, id_col: str, with_ids: bool = False) -> DataFrame:
    """id_col, start, n_tokens, ids_crc32 (and ids) of every document in the files at path; every block is checked."""
    files = spark.read.parquet(path)
    kind = files.schema["doc_ids"].dataType.elementType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                chunk = batch.slice(i, 1).to_pylist()[0]
                ids, sizes = decode_chunk(chunk), np.array(chunk["doc_sizes"], np.int64)
                ends = np.concatenate([[0], np.cumsum(sizes)])
                crc = [zlib.crc32(ids[s:e].view(np.uint8).data) for s, e in zip(ends[:-1], ends[1:], strict=True)]
                columns = [pa.array(np.full(len(sizes), chunk["chunk"], np.int64)), batch.column("doc_ids")[i].values, pa.array(ends[:-1]), pa.array(sizes), pa.array(crc, pa.int64())]
                names = ["chunk", "id", "at", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns, names = [*columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype(np.int64)))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"chunk long, id {kind}, at long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    before = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("chunk", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("before"))  # two numbers a chunk
    out = files.mapInArrow(decode, schema).join(starts, "chunk")
    return out.select(F.col("id").alias(id_col), (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))
