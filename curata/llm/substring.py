"""Substring dedup: Rabin-Karp hashes of every fixed-length word window, counted in Spark, merged into removal intervals.

Documents fall into chunks by ranges of their id. Each chunk sends the distinct hashes of its windows, sorted and packed,
to buckets of hashes; a bucket tells each chunk which of its hashes an earlier chunk has. So a window that a third of
all documents hold is one hash a chunk, never one row a document, and texts are shuffled once.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from curata.llm import common as C

#: Two odd bases; the second hash also picks the bucket, so that two windows are taken for equal only if both agree.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Hashes in a bucket, at which the number of buckets grows with the input.
BUCKET_HASHES = 4_000_000
OWN = {"n_words": "bigint", "n_removed": "bigint", "kept_text": "string", "removed": "array<struct<start:bigint,end:bigint>>"}


def _windows(text: pa.Array, width: int) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Offsets, words, and of each whole window: start, hash, second hash."""
    offsets, flat = C.split_words(text)
    h = C.word_hashes(flat)
    at = np.flatnonzero(C.inside(offsets, width))
    first = C.rolling(h, width, BASES[0])
    return offsets, flat, at, first[at] if len(at) else np.zeros(0, np.uint64), C.rolling(h, width, BASES[1])[at] if len(at) else np.zeros(0, np.uint64)


def packed_by_bucket(chunk: int, h: np.ndarray, second: np.ndarray, n_buckets: int) -> pa.Table:
    """The distinct hashes of a chunk, a row for each bucket."""
    u, at = np.unique(h, return_index=True)
    b = (second[at] >> np.uint64(20)) % np.uint64(n_buckets)
    order = np.argsort(b, kind="stable")
    u, b = u[order], b[order]
    which, starts = np.unique(b, return_index=True)
    ends = np.append(starts[1:], len(u))
    return pa.table(
        {"bucket": pa.array(which.astype(np.int32)), "chunk": pa.array(np.full(len(which), chunk, np.int64)), "hashes": pa.array([C.pack(u[s:e]) for s, e in zip(starts, ends, strict=True)], pa.binary())},
    )


def _reply(key: tuple, table: pa.Table) -> pa.Table:
    """To each chunk, those of its hashes in this bucket that a chunk before it has."""
    order = np.argsort(table["chunk"].to_numpy(), kind="stable")
    chunks, parts = table["chunk"].to_numpy()[order], [C.unpack(table["hashes"][int(i)].as_py()) for i in order]
    h = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
    by = np.argsort(h, kind="stable")
    later = np.zeros(len(h), bool)
    later[by[1:]] = h[by[1:]] == h[by[:-1]]
    out = [(int(chunks[i]), C.pack(x)) for i, x in enumerate(np.split(h[later], np.cumsum(np.bincount(owner[later], minlength=len(parts)))[:-1]) if parts else []) if len(x)]
    return pa.table({"chunk": pa.array([x[0] for x in out], pa.int64()), "hashes": pa.array([x[1] for x in out], pa.binary())})


def removal_mask(ids: np.ndarray, offsets: np.ndarray, at: np.ndarray, h: np.ndarray, prior: np.ndarray, width: int) -> np.ndarray:
    """Words covered by a window that starts in a document with a smaller id: in an earlier chunk (prior) or in this one."""
    n = int(offsets[-1])
    if not len(at):
        return np.zeros(n, bool)
    rank = np.unique(ids, return_inverse=True)[1]
    doc = rank[np.searchsorted(offsets, at, side="right") - 1]
    by = np.lexsort((doc, h))
    hs, ds = h[by], doc[by]
    new = np.append(True, hs[1:] != hs[:-1])
    least = ds[np.flatnonzero(new)][np.cumsum(new) - 1]
    hit = np.zeros(len(h), bool)
    hit[by] = ds > least
    if len(prior):
        hit |= prior[np.minimum(np.searchsorted(prior, h), len(prior) - 1)] == h
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, at[hit], 1)
    np.add.at(steps, at[hit] + width, -1)
    return np.cumsum(steps)[:n] > 0


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def cut(text: str, spans: list[dict]) -> str:
    """The text without the words of the spans and the white space after them; all else stays as it is."""
    drop, out, last = [(s["start"], s["end"]) for s in spans], [], 0
    words = [m.span() for m in WORD.finditer(text)]
    for start, end in drop:
        out.append(text[last : words[start][0]])
        last = words[end][0] if end < len(words) else len(text)
    return "".join([*out, text[last:]])


def dedup_substrings(df: DataFrame, id_col: str, text_col: str, width: int = 13, keep_layout: bool = False, chunk_chars: int = C.CHUNK_CHARS) -> DataFrame:
    """Removes each word covered by a window of `width` words that also starts in a document with a smaller id.

    Adds n_words, n_removed, kept_text and removed (maximal intervals of word positions, end exclusive); input columns
    of these names are replaced, all others are kept. kept_text joins the kept words by one space, or with keep_layout
    is the text with only the removed words and the space after them cut. Windows are judged on the input.

    A null text has no words and an empty kept_text; rows with a null id count as one document with the smallest id;
    rows with equal ids don't remove each other's words. A text of fewer than `width` words loses nothing. An empty
    table gives an empty result. Windows are taken for equal if 64 hash bits and the bucket, picked by a second hash, agree.
    """
    df = df.drop(*OWN)
    C.bound_batches(df.sparkSession)
    chunked, n_chunks = C.with_chunk(df, id_col, text_col, chunk_chars)
    n_buckets = max(2 * C.partitions(df.sparkSession), n_chunks * chunk_chars // 6 // BUCKET_HASHES)
    schema = T.StructType([*df.schema.fields, *T._parse_datatype_string(", ".join(f"{k} {v}" for k, v in OWN.items())).fields])

    def send(key: tuple, table: pa.Table) -> pa.Table:
        _, _, _, h, second = _windows(table[text_col].combine_chunks(), width)
        return packed_by_bucket(key[0].as_py(), h, second, n_buckets)

    texts = chunked.groupBy("__chunk")  # used twice with the same columns, so that Spark shuffles them once
    sent = texts.applyInArrow(C.tidy_group(send), "bucket int, chunk long, hashes binary")
    replies = sent.groupBy("bucket").applyInArrow(C.tidy_group(_reply), "chunk long, hashes binary")

    def remove(key: tuple, table: pa.Table, told: pa.Table) -> pa.Table:
        table = table.drop_columns(["__chunk"]).combine_chunks()
        text = table[text_col].combine_chunks() if table.num_rows else pa.array([], pa.string())
        offsets, flat, at, h, _2 = _windows(text, width)
        ids = table[id_col].cast(pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy()
        prior = np.sort(np.concatenate([np.zeros(0, np.uint64), *(C.unpack(x) for x in told["hashes"].to_pylist())]))
        gone = removal_mask(ids, offsets, at, h, prior, width)
        before = np.concatenate([[0], np.cumsum(gone)])
        removed = before[offsets[1:]] - before[offsets[:-1]]
        kept = pa.LargeListArray.from_arrays(offsets - before[offsets], flat.filter(pa.array(~gone)))
        spans = [[] for _ in range(table.num_rows)]
        for i in np.flatnonzero(removed):
            edge = np.flatnonzero(np.diff(np.concatenate([[0], gone[offsets[i] : offsets[i + 1]].astype(np.int8), [0]])))
            spans[i] = [{"start": int(s), "end": int(e)} for s, e in zip(edge[::2], edge[1::2], strict=True)]
        if keep_layout:
            kept_text = pa.array([(t or "") if not s else cut(t, s) for t, s in zip(text.to_pylist(), spans, strict=True)], pa.string())
        else:
            kept_text = pc.binary_join(kept, pa.scalar(" ", pa.large_string())).cast(pa.string())
        own = [pa.array(np.diff(offsets)), pa.array(removed.astype(np.int64)), kept_text, pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
        for name, x in zip(OWN, own, strict=True):
            table = table.append_column(name, x)
        return table

    return texts.cogroup(replies.groupBy("chunk")).applyInArrow(C.tidy_groups(remove), schema)
