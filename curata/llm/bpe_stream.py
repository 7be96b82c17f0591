"""Byte-level BPE as a streaming transducer with bounded lookahead, and its inverse.

Encoding. A prefix of a piece has one BPE encoding, and if the encoding of a longer text has a boundary at some place, its
tokens before it are the encoding of that prefix. So it is enough to keep, for each byte position, the last token of the
prefix's encoding: the one token t ending there whose pair with the last token before it stays apart under the merges.
An Aho-Corasick automaton lists the tokens that end at a position. No token is longer than `lookahead` bytes, so the final
encoding has a boundary among the last `lookahead` positions: the tokens before the last boundary that all paths back from
these go through are stable and are emitted at once, whatever follows. Memory holds the unstable end alone. Every piece of
a text is encoded so; a memo keeps the ids of words met before.

Decoding. Each token's bytes go through a UTF-8 state machine that holds at most three bytes of an unfinished character
and puts U+FFFD for each maximal ill-formed part, as the library's decoder does.
"""

from __future__ import annotations

import codecs
import json
from array import array
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curata.llm import common as C

#: Fixed value: how this family of vocabularies parts a text before merging.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Words, pieces and pairs of tokens kept by one Python worker.
KEPT_WORDS, KEPT_PIECES, KEPT_PAIRS = 1_000_000, 700_000, 1_000_000
#: Bytes of a piece that the transducer reads at a time, and ids that the decoder does.
PART, FEED = 4096, 65_536


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the file: printable Latin-1 for itself, the others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


NONE = 1 << 60


class Transducer:
    """One merge list: pieces of bytes to ids, ids to text."""

    _open: dict[str, "Transducer"] = {}

    def __init__(self, path: str) -> None:
        spec = json.loads(open(path, encoding="utf-8").read())
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        vocab = {raw(k): v for k, v in spec["model"]["vocab"].items() if all(c in letters for c in k)}
        self.bytes_of = {v: k for k, v in vocab.items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {v: k.encode() for k, v in self.added.items() if v not in self.bytes_of}
        self.added_at = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.single = [vocab[bytes([b])] for b in range(256)]
        #: Two ids -> the rank of their merge and the id it makes, 20 bits each.
        self.best: dict[int, int] = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = (raw(x) for x in (m.split(" ") if isinstance(m, str) else m))
            self.best.setdefault(vocab[a] << 20 | vocab[b], rank << 20 | vocab[a + b])
        #: Sufficient lookahead in bytes: the longest token that the merge list can make.
        made = {x & 0xFFFFF for x in self.best.values()} | set(self.single)
        self.lookahead = max(len(self.bytes_of[x]) for x in made)
        self.size = {x: len(self.bytes_of[x]) for x in made}
        self.ending = ahocorasick.Automaton()
        for x in made:
            if self.merged(self.bytes_of[x]) == [x]:  # else no encoding has it
                self.ending.add_word(self.bytes_of[x].decode("latin-1"), x)
        self.ending.make_automaton()
        self.halves: dict[int, tuple[int, int, int]] = {}
        for pair, x in self.best.items():
            self.halves.setdefault(x & 0xFFFFF, (x >> 20, pair >> 20, pair & 0xFFFFF))
        self.edges: dict[tuple[int, bool], list[tuple[int, int]]] = {}
        self.apart: dict[int, bool] = {}
        self.pieces: dict[bytes, bytes] = {}
        #: Pieces that went through the transducer.
        self.streamed = 0
        self.memo = C.SpanMemo(KEPT_WORDS)
        top = max(self.bytes_of) + 1
        self.decimal = pa.array([str(i) for i in range(top)], pa.large_string())
        self.raw = pa.array([self.bytes_of.get(i, b"") for i in range(top)], pa.large_binary())

    @classmethod
    def of(cls, path: str) -> "Transducer":
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def merged(self, piece: bytes) -> list[int]:
        """All merges of bytes at hand, lowest rank first, leftmost first."""
        ids = [self.single[b] for b in piece]
        get = self.best.get
        pairs = [get(a << 20 | b, NONE) for a, b in zip(ids, ids[1:])]
        while pairs and (best := min(pairs)) != NONE:
            i = pairs.index(best)
            ids[i] = best & 0xFFFFF
            del ids[i + 1], pairs[i]
            if i < len(pairs):
                pairs[i] = get(ids[i] << 20 | ids[i + 1], NONE)
            if i:
                pairs[i - 1] = get(ids[i - 1] << 20 | ids[i], NONE)
        return ids

    def _edge(self, t: int, left: bool) -> list[tuple[int, int]]:
        """The tokens that stand at the left or right edge of t while it is made, from a byte to t itself, each with the rank
        of the merge that takes it up."""
        got = self.edges.get((t, left))
        if got is None:
            up, x, got = NONE, t, []
            while True:
                got.append((x, up))
                if x not in self.halves:
                    break
                up, first, second = self.halves[x]
                x = first if left else second
            got.reverse()
            self.edges[t, left] = got
        return got

    def _apart(self, a: int, b: int) -> bool:
        """Whether the merges leave the tokens a and b side by side: at no time does a merge of the two tokens at the
        boundary come before those that take them up. Merges of equal rank go from left to right."""
        x, y = self._edge(a, False), self._edge(b, True)
        i = j = 0
        while True:
            (p, up_p), (q, up_q) = x[i], y[j]
            rank = self.best.get(p << 20 | q, NONE) >> 20
            if rank < up_p and rank <= up_q and rank < NONE >> 20:
                return False
            if up_p == up_q == NONE:
                return True
            if up_p <= up_q:
                i += 1
            else:
                j += 1

    def stream(self, parts: Iterable[bytes]) -> Iterator[int]:
        """The ids of one piece that arrives in parts, each as soon as nothing that follows can change it."""
        open_ = OpenPiece(self)
        for part in parts:
            yield from open_.feed(part)
        yield from open_.close()

    def piece(self, piece: bytes) -> bytes:
        """The ids of a piece as little-endian 32-bit integers."""
        got = self.pieces.get(piece)
        if got is None:
            got = array("I", self.stream(piece[i : i + PART] for i in range(0, len(piece), PART))).tobytes()
            if len(piece) <= self.lookahead:
                if len(self.pieces) >= KEPT_PIECES:
                    self.pieces.clear()
                self.pieces[piece] = got
        return got

    def plain(self, text: str) -> bytes:
        """Ids of a text without added tokens, as little-endian 32-bit integers."""
        return b"".join([self.piece(m.encode()) for m in PIECES.findall(text)])

    def encode(self, text: str) -> list[int]:
        if not self.added_at:
            return np.frombuffer(self.plain(text), "<u4").tolist()
        out, at = [], 0
        for m in self.added_at.finditer(text):
            out += [*np.frombuffer(self.plain(text[at : m.start()]), "<u4").tolist(), self.added[m[0]]]
            at = m.end()
        return out + np.frombuffer(self.plain(text[at:]), "<u4").tolist()

    def decoder(self) -> "Decoder":
        return Decoder(self.bytes_of)


class OpenPiece:
    """A piece under way: feed() returns the ids that became stable, close() the rest."""

    def __init__(self, bpe: Transducer) -> None:
        self.bpe = bpe
        bpe.streamed += 1
        self.last: list[int] = []  # for each position after the last stable boundary, the last token of what ends there
        self.base, self.before = 0, None  # that boundary's place, and the token ahead of it
        self.found = None

    def feed(self, part: bytes) -> list[int]:
        bpe, last, base, before = self.bpe, self.last, self.base, self.before
        size, apart, most, out = bpe.size, bpe.apart, 4 * bpe.lookahead, []
        if self.found is None:
            self.found = bpe.ending.iter(part.decode("latin-1"))
        else:
            self.found.set(part.decode("latin-1"))
        at = len(last)
        for end, t in self.found:  # the tokens that end here, the longest first
            here = end - base
            if at > here:
                continue
            n = size[t]
            if n <= here:
                prior = last[here - n]
            elif n == here + 1:
                prior = before
            else:
                continue
            if prior is not None:
                ok = apart.get(prior << 20 | t)
                if ok is None:
                    if len(apart) >= KEPT_PAIRS:
                        apart.clear()
                    ok = apart[prior << 20 | t] = bpe._apart(prior, t)
                if not ok:
                    continue
            last.append(t)
            at += 1
            if at >= most and (done := self._shared()):
                out += done
                n = sum(size[x] for x in done)
                base, before = base + n, done[-1]
                at -= n
                del last[:n]
        self.base, self.before = base, before
        return out

    def close(self) -> list[int]:
        return self._path(len(self.last))

    def _path(self, at: int) -> list[int]:
        out = []
        while at:
            out.append(self.last[at - 1])
            at -= self.bpe.size[out[-1]]
        out.reverse()
        return out

    def _shared(self) -> list[int]:
        """The tokens up to the last boundary that the paths back from all of the last `lookahead` positions go through."""
        at = len(self.last)
        least = at - self.bpe.lookahead
        ends, n = [p > least for p in range(at + 1)], at - max(least, 0)
        while at and not (n == 1 and ends[at]):
            if ends[at]:
                to = at - self.bpe.size[self.last[at - 1]]
                n -= ends[to]
                ends[to] = True
            at -= 1
        return self._path(at)


class Decoder:
    """Ids to text, step by step: feed() returns the characters that an id completes, close() what is left over."""

    def __init__(self, bytes_of: dict[int, bytes]) -> None:
        self.bytes_of, self.machine = bytes_of, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, token: int) -> str:
        return self.take(self.bytes_of.get(token, b""))

    def take(self, raw: bytes) -> str:
        """The same for the bytes of one token or more."""
        return self.machine.decode(raw)

    def close(self) -> str:
        return self.machine.decode(b"", True)


#: White space at an edge of a word, or what may be an added token: such texts are encoded as a whole.
EDGE = r"^[\s\x0b\x1c-\x1f\x{85}\p{Z}]|[\s\x0b\x1c-\x1f\x{85}\p{Z}]$|<\|"


def encode_texts(bpe: Transducer, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) into the ids of all texts. Null texts are empty.

    Between two characters that aren't white space a single space starts a piece, so such texts are encoded word by word,
    each distinct word of a batch once.
    """
    text = pc.fill_null(text, "").cast(pa.large_string())
    lists = pc.split_pattern(text, " ")
    flat, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    sizes_of = np.diff(offsets)
    first = np.zeros(len(flat), bool)
    first[offsets[:-1][sizes_of > 0]] = True
    # An empty word, or white space at a word's edge, stands by an odd space; an added token may hold one.
    odd_word = pc.or_(pc.equal(pc.binary_length(flat), 0), pc.match_substring_regex(flat, EDGE)).to_numpy(zero_copy_only=False)
    odd = np.concatenate([[0], np.cumsum(odd_word)])
    whole = (odd[offsets[1:]] - odd[offsets[:-1]]) > 0

    # Ids by word: words of whole texts have none, and a first word has no space before it.
    by_word = ~np.repeat(whole, sizes_of)
    sizes, starts = np.zeros(len(flat), np.int64), np.zeros(len(flat), np.int64)
    keys, uses = [pa.array([], pa.large_binary())], []
    for mask, space in ((by_word & ~first, b" "), (by_word & first, b"")):
        coded = flat.filter(pa.array(mask)).cast(pa.large_binary()).dictionary_encode()
        keys.append(pc.binary_join_element_wise(pa.scalar(space, pa.large_binary()), coded.dictionary, pa.scalar(b"", pa.large_binary())))
        uses.append((mask, coded.indices.to_numpy()))

    def learn(_: np.ndarray, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = [bpe.plain(w.decode()) for w in new]
        return np.fromiter(map(len, ids), np.int64, len(ids)) // 4, np.frombuffer(b"".join(ids), "<u4")

    every = pa.concat_arrays(keys)
    distinct = every.dictionary_encode()
    place = bpe.memo.places(distinct.dictionary, learn)[distinct.indices.to_numpy()]
    at = 0
    for (mask, index), k in zip(uses, keys[1:], strict=True):
        own = place[at : at + len(k)][index]
        sizes[mask], starts[mask] = bpe.memo.sizes[own], bpe.memo.starts[own]
        at += len(k)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    counts = ends[offsets[1:]] - ends[offsets[:-1]]
    ids = bpe.memo.ids[C.spans(starts, sizes)]
    if not whole.any():
        return np.concatenate([[0], np.cumsum(counts)]), ids
    odd_ids = [np.array(bpe.encode(text[int(i)].as_py()), np.uint32) for i in np.flatnonzero(whole)]
    counts[whole] = list(map(len, odd_ids))
    out = np.zeros(counts.sum(), np.uint32)
    begin = np.cumsum(counts) - counts
    out[C.spans(begin[~whole], counts[~whole])] = ids
    out[C.spans(begin[whole], counts[whole])] = np.concatenate(odd_ids)
    return np.concatenate([[0], np.cumsum(counts)]), out


def decode_ids(bpe: Transducer, offsets: np.ndarray, ids: np.ndarray) -> list[str]:
    """The texts of the ids between the offsets, each by a state machine of its own that takes FEED ids at a time."""
    cuts = np.unique(np.concatenate([offsets, *(np.arange(s, e, FEED) for s, e in zip(offsets[:-1], offsets[1:], strict=True) if e - s > FEED)]))
    tokens = bpe.raw.take(pa.array(ids))
    fed = iter(zip(cuts[1:].tolist(), pc.binary_join(pa.LargeListArray.from_arrays(cuts, tokens), pa.scalar(b"", pa.large_binary())).to_pylist(), strict=True))
    out = []
    for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        machine, text = Decoder(bpe.bytes_of), []
        while s < e:
            s, raw = next(fed)
            text.append(machine.take(raw))
        out.append("".join(text) + machine.close())
    return out


def round_trip(df: DataFrame, id_col: str, text_col: str, vocabulary: str) -> DataFrame:
    """id_col, ids_text (decimal ids joined by commas), n_tokens and decoded (the text of the ids) of every whole text.

    Null texts are empty and have no ids; equal texts and rows with equal or null ids are rows of their own; a text of any
    length is encoded piece by piece. An empty table gives an empty result. Other columns aren't read.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Transducer.of(vocabulary)
        for batch in C.small_batches(batches, 1, 6_000_000):
            offsets, ids = encode_texts(bpe, batch.column(1))
            shown = pc.binary_join(pa.LargeListArray.from_arrays(offsets, bpe.decimal.take(pa.array(ids))), pa.scalar(",", pa.large_string()))
            decoded = decode_ids(bpe, offsets, ids)
            columns = [batch.column(0), pa.array(np.diff(offsets)), shown.cast(pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_tokens", "ids_text", "decoded"])

    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(add, f"id {kind}, n_tokens long, ids_text string, decoded string")
    return out.withColumnRenamed("id", id_col)
