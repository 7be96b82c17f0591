"""Ids of texts by a tokenizers file whose words are encoded one by one.

Where the pre-tokenizer never joins what white space parts, a text's ids are its words' ids in order. So the tokenizers
library encodes each distinct word once and a memo keeps its ids for later batches. Words of letters alone go to it many
at a time, joined by spaces, for a token that ends a word tells where each of them ends.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from curata.llm import common as C

#: Capitals beyond ASCII that are lowered here, lower-case letters that no normalizer changes, signs, and words of letters,
#: perhaps with signs at their end.
CAPITALS = "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ"
LETTERS = "".join(map(chr, [*range(97, 123), *range(223, 247), *range(248, 256)]))
SIGNS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())
PLAIN = rf"^[a-zß-öø-ÿ{CAPITALS}]+[!-/:-@\[-`{{-~]*$"
#: What a file does before its model that, for words of lower-case letters, comes to parting them at white space.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
PIECES = {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}
#: Plain words that the library gets as one text, and texts a call.
JOINED, CALL = 200, 200
#: Words kept by one Python worker between batches, without the signs at their end, and such ends.
KEPT_WORDS, KEPT_ENDS = 250_000, 10_000


class WordEncoder:
    """texts -> (offsets, ids), equal to encode(text, add_special_tokens=False, no truncation, no padding) of the file.

    For files that lower-case, part letters from the signs that end a word, and mark the token that ends a word; the
    constructor tries all of it.
    """

    _open: dict[str, "WordEncoder"] = {}

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        ids = lambda x: self.tokenizer.encode(x, add_special_tokens=False).ids
        apart = all(ids(f"Ab{s}") == ids("ab") + ids(s) for s in [*SIGNS, SIGNS, *(a + b for a in ".,'" for b in SIGNS)])
        if not apart or ids("Ab.\n CD,e") != ids("ab") + ids(".") + ids("cd") + ids(",") + ids("e") or ids(CAPITALS) != ids(CAPITALS.lower()):
            raise ValueError(f"{path} doesn't encode word by word")
        self.special = sorted({t.content[:2] for t in self.tokenizer.get_added_tokens_decoder().values()})
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.signs: dict[str, list[int]] = {}
        self.memo = C.SpanMemo(KEPT_WORDS)
        self.bare = self.tokenizer
        state = lambda x: json.loads(x.__getstate__()) if x else {}
        before = state(self.tokenizer.pre_tokenizer).get("pretokenizers", [])
        split = {"type": "Split", "pattern": PIECES, "behavior": "Removed", "invert": True}
        if state(self.tokenizer.normalizer).get("normalizers") == NORMALIZERS and before[:1] == [split] and [(x["type"], x.get("add_prefix_space"), x.get("use_regex")) for x in before[1:]] == [("ByteLevel", False, False)]:
            self.bare = Tokenizer(self.tokenizer.model)
            self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

    @classmethod
    def of(cls, path: str) -> "WordEncoder":
        """One encoder a path and worker."""
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def _each(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of words, each encoded by itself."""
        sizes, parts = np.zeros(len(words), np.int64), [np.zeros(0, np.uint32)]
        for i in range(0, len(words), 20_000):
            coded = [e.ids for e in self.tokenizer.encode_batch_fast(words[i : i + 20_000], add_special_tokens=False)]
            sizes[i : i + len(coded)] = list(map(len, coded))
            parts.append(np.array([x for ids in coded for x in ids], np.uint32))
        return sizes, np.concatenate(parts)

    def _plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of plain letters, many a text."""
        parts = [np.zeros(0, np.uint32)]
        texts = [" ".join(words[i : i + JOINED]) for i in range(0, len(words), JOINED)]
        for i in range(0, len(texts), CALL):
            parts += [np.array(e.ids, np.uint32) for e in self.bare.encode_batch_fast(texts[i : i + CALL], add_special_tokens=False)]
        ids = np.concatenate(parts)
        last = np.flatnonzero(self.ends[ids])
        if len(last) != len(words):
            return self._each(words)
        return np.diff(last, prepend=-1), ids

    def _learn(self, place: np.ndarray, words: list[bytes], plain: int) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of words, those at the first `plain` places by many at a time."""
        n = int((place < plain).sum())
        strings = [w.decode() for w in words]
        coded = self._plain(strings[:n]), self._each(strings[n:])
        return tuple(np.concatenate(x) for x in zip(*coded, strict=True))

    def _ends(self, ends: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for runs of signs, which may be empty."""
        if len(self.signs) > KEPT_ENDS:
            self.signs = {}
        for s in ends:
            if s not in self.signs:
                self.signs[s] = self.tokenizer.encode(s, add_special_tokens=False).ids
        return np.array([len(self.signs[s]) for s in ends], np.int64), np.array([x for s in ends for x in self.signs[s]], np.uint32)

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of distinct words, one after another."""
        plain = pc.match_substring_regex(words, PLAIN).to_numpy(zero_copy_only=False)
        at, others = np.flatnonzero(plain), np.flatnonzero(~plain)
        some = pc.utf8_lower(words.take(pa.array(at)))
        stems, ends = pc.utf8_rtrim(some, SIGNS).dictionary_encode(), pc.utf8_ltrim(some, LETTERS).dictionary_encode()
        n_stems, memo = len(stems.dictionary), self.memo
        key = memo.places(pa.concat_arrays([stems.dictionary, words.take(pa.array(others))]), lambda place, new: self._learn(place, new, n_stems))
        of = np.zeros(len(words), np.int64)
        of[at], of[others] = key[stems.indices.to_numpy()], key[n_stems:]
        sizes, starts = memo.sizes[of], memo.starts[of]
        end, end_sizes, end_ids = ends.indices.to_numpy(), *self._ends(ends.dictionary.to_pylist())
        more, end_starts = end_sizes[end], (np.cumsum(end_sizes) - end_sizes)[end]
        total = sizes.copy()
        total[at] += more
        out = np.zeros(total.sum(), np.uint32)
        first = np.cumsum(total) - total
        out[C.spans(first, sizes)] = memo.ids.take(C.spans(starts, sizes))
        out[C.spans((first + sizes)[at], more)] = end_ids.take(C.spans(end_starts, more))
        return total, out

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Offsets (n + 1) into the ids (uint32) of all texts. Null texts are empty."""
        text = pc.fill_null(text, "")
        if not any(pc.any(pc.match_substring(text, s)).as_py() for s in self.special):  # begins of tokens whose case matters
            text = pc.ascii_lower(text)
        offsets, flat = C.split_words(text)
        if not len(flat):
            return np.zeros(len(text) + 1, np.int64), np.zeros(0, np.uint32)
        coded = flat.dictionary_encode()
        size, pool = self.words(coded.dictionary)
        index = coded.indices.to_numpy()
        sizes = size[index]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return ends[offsets], pool.take(C.spans((np.cumsum(size) - size).take(index), sizes))
