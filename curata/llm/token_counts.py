"""Token counts under a unigram vocabulary, by a Viterbi pass that carries best score and piece count alone.

An Aho-Corasick automaton lists the vocabulary pieces that end at each character, longest first. For each end the best
score wins and, among equal scores, the piece that starts first: the library's tie rule. A character that is no piece of
its own may be unknown, at the least score less 10; a run of unknown characters counts once. No piece spans two words,
so a text's count is the sum over its words, and each distinct word is counted once.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curata.llm import common as C

#: The mark that stands for a space, and the unknown character's penalty.
MARK, UNKNOWN_PENALTY = "▁", 10.0
KEPT_WORDS = 900_000


def vocabulary(model_path: str) -> list[tuple[str, float]]:
    """The pieces of a sentencepiece file that stand for text, with their scores."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    kept = (i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i) or sp.is_unused(i)))
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in kept]


class Kept:
    """A bounded memo of two generations."""

    def __init__(self, most: int) -> None:
        self.half, self.young, self.old = most // 2, {}, {}

    def get(self, key):  # noqa: ANN001, ANN201
        x = self.young.get(key)
        if x is None and (x := self.old.get(key)) is not None:
            self.put(key, x)
        return x

    def put(self, key, value) -> None:  # noqa: ANN001
        if len(self.young) >= self.half:
            self.old, self.young = self.young, {}
        self.young[key] = value


class Counter:
    _open: dict[str, "Counter"] = {}

    def __init__(self, pieces: list[tuple[str, float]]) -> None:
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p, _ in pieces if len(p) == 1}
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.known = Kept(KEPT_WORDS)

    @classmethod
    def of(cls, path: str) -> "Counter":
        if path not in cls._open:
            cls._open[path] = cls(vocabulary(path))
        return cls._open[path]

    def viterbi(self, word: str) -> tuple[int, float]:
        """Pieces on the best path over one marked word, and its score."""
        n = len(word)
        hits: list = [()] * (n + 1)
        for end, hit in self.automaton.iter(word):
            hits[end + 1] += (hit,)
        score, count, is_unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for end in range(1, n + 1):
            best = None
            for size, own in hits[end]:
                s = own + score[end - size]
                if best is None or s > best:
                    best, start = s, end - size
            if best is not None:
                score[end], count[end] = best, count[start] + 1
            if word[end - 1] not in self.single:
                s = self.unknown + score[end - 1]
                if best is None or s > best:
                    score[end], count[end], is_unknown[end] = s, count[end - 1] + (not is_unknown[end - 1]), True
        return count[n], score[n]

    def count(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Pieces and score of each text. Null texts are empty and have none."""
        text = pc.replace_substring(pc.fill_null(text, "").cast(pa.large_string()), MARK, " ")
        lists = pc.split_pattern(text, " ")
        flat, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
        offsets = offsets - offsets[0]
        words, index = C.distinct(flat)
        got = []
        for w in words:
            if (x := self.known.get(w)) is None:
                self.known.put(w, x := self.viterbi(MARK + w.decode()))
            got.append(x)
        counts = np.array([x[0] for x in got], np.int64)[index] if got else np.zeros(0, np.int64)
        scores = np.array([x[1] for x in got], float)[index] if got else np.zeros(0)
        # An empty first word is a leading mark, which takes the place of the one put before the text, or an empty text.
        first = offsets[:-1][np.diff(offsets) > 0]
        none = first[pc.equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)[first]] if len(flat) else first
        counts[none], scores[none] = 0, 0.0
        sums = [np.concatenate([[0], np.cumsum(x)]) for x in (counts, scores)]
        return tuple(x[offsets[1:]] - x[offsets[:-1]] for x in sums)  # scores are whole numbers in the file, so sums are exact


def count_tokens(df: DataFrame, text_col: str, vocabulary_path: str) -> DataFrame:
    """Adds n_tokens and score to every row, from its whole text; input columns of these names are replaced.

    A null or empty text has 0 tokens; equal texts have equal counts; an empty table gives an empty result.
    """
    df = df.drop("n_tokens", "score")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter.of(vocabulary_path)
        for batch in C.small_batches(batches, text_col):
            n, score = counter.count(batch.column(batch.schema.get_field_index(text_col)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n), pa.array(score)], names=[*batch.schema.names, "n_tokens", "score"])

    schema = df.select("*", F.lit(0).cast("long").alias("n_tokens"), F.lit(0.0).alias("score")).schema
    return df.mapInArrow(add, schema)
