"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every document. Expectation-maximisation over the counts of vote
patterns, of which there are at most 3 ^ labellers however many documents, estimates each labeller's accuracy and the
share of good documents. The posteriors of the patterns train a linear scorer over hashed words and word shapes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curata.llm import common as C
from curata.llm.quality_rules import measure

LABELLERS = ("symbols", "shouting", "repeats", "lines", "table_cells", "sentences", "length", "letters", "plain_words", "stutter", "variety")
ABSTAIN, BAD, GOOD = 0, 1, 2
#: About how many documents train the scorer: those with the least hashes.
SAMPLE = 2_000
BITS = 16
OWN = {"score": "double", "kept": "boolean"}


def _patterns(v: np.ndarray) -> list[str]:
    """Each row of votes as a string of digits."""
    width = v.shape[1]
    flat = (v.astype(np.uint8) + 48).tobytes().decode()
    return [flat[i : i + width] for i in range(0, len(flat), width)]


def _bytes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' UTF-8 bytes and each text's bounds in them."""
    text = text.cast(pa.large_string())
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def _letter_tables() -> tuple[np.ndarray, np.ndarray]:
    """Bytes that begin a letter, and ASCII capitals. Each character beyond ASCII counts as a letter, by its lead byte."""
    upper = np.zeros(256, bool)
    upper[65:91] = True
    letter = upper.copy()
    letter[97:123] = letter[0xC2:0xF5] = True
    return letter, upper


LETTER, UPPER = _letter_tables()


def votes(text: pa.Array) -> np.ndarray:
    """Each labeller's vote on each text: rows by LABELLERS."""
    text = pc.fill_null(text, "")
    m = measure(text)
    n = np.maximum(m["n_words"], 1)
    data, bounds = _bytes(text)
    after, before = np.append(data[1:], 0), np.append(0, data[:-1])
    last = np.zeros(len(data), bool)
    last[bounds[1:][bounds[1:] > bounds[:-1]] - 1] = True
    first = np.append(True, last[:-1]) if len(data) else last

    def count(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int32)])
        return sums[bounds[1:]] - sums[bounds[:-1]]

    is_in = lambda x, chars: np.isin(np.arange(256), list(chars.encode()))[x]
    out = np.zeros((len(text), len(LABELLERS)), np.int8)

    def vote(name: str, bad: np.ndarray, good: np.ndarray) -> None:
        out[:, LABELLERS.index(name)] = np.where(bad, BAD, np.where(good, GOOD, ABSTAIN))

    symbols, letters = m["n_symbols"] / n, np.maximum(count(LETTER[data]), 1)
    chars = np.maximum(count((data & 0xC0) != 0x80), 1)
    upper = count(UPPER[data]) + count((before == 0xC3) & (data >= 0x80) & (data <= 0x9E) & ~first)
    vote("symbols", symbols > 0.2, symbols < 0.02)
    vote("shouting", upper / letters > 0.4, upper / letters < 0.1)
    repeats = m["n_repeat_words"] / n
    vote("repeats", repeats > 0.3, repeats < 0.05)
    lines = count(data == 10) + 1
    vote("lines", (m["n_dup_lines"] > 1) & (m["n_dup_lines"] > 0.3 * lines), m["n_dup_lines"] == 0)
    cells = count((data == 124) & (before == 32) & (after == 32) & ~first & ~last) / n
    vote("table_cells", cells > 0.2, cells == 0)
    stops = count(is_in(data, ".?") & (is_in(after, " \n") | last)) / n
    vote("sentences", (stops == 0) & (m["n_words"] >= 10), stops > 0.01)
    vote("length", m["n_words"] < 1, m["n_words"] >= 40)
    vote("letters", letters / chars < 0.6, letters / chars > 0.75)
    odd = is_in(data, "!*$%&#|")
    odd = count(odd & is_in(after, "!*$%&#|") & ~last & ~(is_in(before, "!*$%&#|") & ~first)) / n
    vote("plain_words", odd > 0.1, odd < 0.01)
    offsets, flat = C.split_words(text)
    _, index = C.distinct(flat)
    doc = np.repeat(np.arange(len(text)), np.diff(offsets))
    same = np.bincount(doc[1:][_same_as_before(index, doc)[1:]], minlength=len(text)) / n
    vote("stutter", same > 0.2, same < 0.05)
    pairs = np.unique(doc * (int(index.max(initial=0)) + 1) + index) // (int(index.max(initial=0)) + 1)
    variety = np.bincount(pairs, minlength=len(text)) / np.sqrt(n)  # distinct words grow about as the root of all words
    vote("variety", (n >= 40) & (variety < 2.5), (n >= 40) & (variety > 4))
    out[m["n_words"] == 0] = BAD
    return out


def _same_as_before(index: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Words equal to the one before them in their document."""
    same = np.zeros(len(index), bool)
    same[1:] = (index[1:] == index[:-1]) & (doc[1:] == doc[:-1])
    return same


@dataclass
class LabelModel:
    """P(vote | class) of each labeller, [labeller, class, vote], and P(good)."""

    table: np.ndarray
    prior: float

    def posterior(self, pattern: str) -> float:
        """P(good) given the votes."""
        v = np.frombuffer(pattern.encode(), np.uint8) - 48
        log = np.log(self.table[np.arange(len(v)), :, v]).sum(0) + np.log([1 - self.prior, self.prior])
        return float(1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50))))


def expectation_maximisation(patterns: dict[str, int], rounds: int = 100, smooth: float = 1.0) -> LabelModel:
    """Two-class Dawid-Skene over counted vote patterns; starts from majority votes, which names the classes."""
    k = len(next(iter(patterns), "0" * len(LABELLERS)))
    if not patterns:
        return LabelModel(np.full((k, 2, 3), 1 / 3), 0.5)
    v = np.array([np.frombuffer(p.encode(), np.uint8) - 48 for p in patterns])
    n = np.array(list(patterns.values()), float)
    good, bad = (v == GOOD).sum(1), (v == BAD).sum(1)
    post = np.clip((good - 2 * bad + 1) / (good + 2 * bad + 2), 0.05, 0.95)
    hot = np.stack([v == x for x in (ABSTAIN, BAD, GOOD)], 2).astype(float)
    for _ in range(rounds):
        table = np.stack([np.einsum("p,pkv->kv", n * w, hot) for w in (1 - post, post)], 1) + smooth
        table /= table.sum(2, keepdims=True)
        prior = float(np.clip((n * post).sum() / n.sum(), 0.02, 0.98))
        log = np.einsum("pkv,kcv->pc", hot, np.log(table)) + np.log([1 - prior, prior])
        new = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return LabelModel(table, prior)


SHAPES = [(re.compile(p), x) for p, x in ((r"[^\W\d_]+", lambda m: "A" if len(m[0]) > 1 and m[0].isupper() else "Aa" if m[0][0].isupper() else "a"), (r"\d+", "0"))]


def _slots(word: bytes) -> tuple[int, int]:
    """Hashed places of a word and of its shape."""
    w = word.decode()
    shape = w
    for p, x in SHAPES:
        shape = p.sub(x, shape)
    mask = (1 << BITS) - 1
    return xxhash.xxh3_64_intdigest("w" + w.lower()) & mask, xxhash.xxh3_64_intdigest("s" + shape) & mask


#: Places that tell whether a word repeats the one before it.
FRESH, AGAIN = (xxhash.xxh3_64_intdigest(x) & ((1 << BITS) - 1) for x in ("fresh", "again"))


def features(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows: (document, slot, value), for each word itself, its shape and whether it repeats the word before it."""
    offsets, flat = C.split_words(text)
    words, index = C.distinct(flat)
    slots = np.array([_slots(w) for w in words], np.int64).reshape(-1, 2)[index]
    sizes = np.diff(offsets)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    value = np.repeat(1 / np.maximum(sizes, 1), sizes)
    again = np.where(_same_as_before(index, doc), AGAIN, FRESH)
    return np.concatenate([doc] * 3), np.concatenate([*slots.T, again]), np.concatenate([value] * 3)


def train_scorer(text: pa.Array, target: np.ndarray, rounds: int = 150, rate: float = 0.05, decay: float = 1e-4) -> np.ndarray:
    """Weights and, last, the bias of a logistic scorer on soft targets, by Adam on the whole sample; the two classes weigh alike."""
    doc, slot, value = features(text)
    pairs, at = np.unique(doc << BITS | slot, return_inverse=True)
    doc, slot, value = pairs >> BITS, pairs & ((1 << BITS) - 1), np.bincount(at, weights=value)
    size, n = (1 << BITS) + 1, max(len(target), 1)
    good = max(target.sum(), 1e-9)
    share = target * (0.5 / good) + (1 - target) * (0.5 / max(n - good, 1e-9))
    w, m1, m2 = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, rounds + 1):
        z = np.bincount(doc, weights=value * w[slot], minlength=len(target)) + w[-1]
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) * share
        g = np.append(np.bincount(slot, weights=value * err[doc], minlength=size - 1), err.sum()) + decay * w
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        w -= rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
    return w


def score(text: pa.Array, weights: np.ndarray) -> np.ndarray:
    doc, slot, value = features(text)
    z = np.bincount(doc, weights=value * weights[slot], minlength=len(text)) + weights[-1]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def classify(df: DataFrame, id_col: str, text_col: str, cutoff: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """Adds score (0 to 1) and kept (score >= cutoff).

    The labellers vote and the scorer scores on every whole text; vote patterns are counted over all rows. The scorer is
    fitted on about `sample` rows, those with the least hashes of (id, text), and never on more than twice as many. Null and empty texts have no words and
    score 0; equal texts score alike; an empty table gives an empty result. Input columns named like
    the added ones are replaced.
    """
    df = df.drop(*OWN)
    spark = df.sparkSession
    C.bound_batches(spark)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.small_batches(batches, 0):
            yield pa.RecordBatch.from_arrays([pa.array(_patterns(votes(batch.column(0))), pa.string())], names=["votes"])

    counted = df.select(F.col(text_col).alias("text")).mapInArrow(C.tidy(vote), "votes string").groupBy("votes").agg(F.count(F.lit(1)).alias("n"))
    counts = dict(counted.collect())  # at most 3 ^ len(LABELLERS) rows, far fewer in any corpus
    model = expectation_maximisation(counts)
    posterior = {p: model.posterior(p) for p in counts}
    # Hashes are uniform, so a bound on them takes about `sample` rows wherever they lie; no task sees more than these.
    bound = -(2**63) + int(2**64 * min(1.0, sample / max(sum(counts.values()), 1)))
    some = df.select(text_col, F.xxhash64(id_col, text_col).alias("__h")).where((F.length(text_col) > 0) & (F.col("__h") <= min(bound, 2**63 - 1)))
    top = some.orderBy("__h").limit(2 * sample).toArrow()
    texts = top[text_col].combine_chunks()
    weights = np.zeros((1 << BITS) + 1) if not len(texts) else train_scorer(texts, np.array([posterior.get(p, 0.5) for p in _patterns(votes(texts))]))
    C.release()
    shared = spark.sparkContext.broadcast(weights.astype(np.float32))  # 2 ^ BITS weights

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.small_batches(batches, text_col):
            text = pc.fill_null(batch.column(batch.schema.get_field_index(text_col)), "")
            s = np.where(np.diff(C.split_words(text)[0]) > 0, score(text, shared.value), 0.0)
            own = [pa.array(s), pa.array(s >= cutoff)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *own], names=[*batch.schema.names, *OWN])

    return df.mapInArrow(C.tidy(add), T.StructType([*df.schema.fields, *T._parse_datatype_string(", ".join(f"{k} {v}" for k, v in OWN.items())).fields]))
