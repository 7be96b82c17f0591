import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from curata.llm.packing import best_fit_decreasing, pack
from curata.llm.word_ids import WordEncoder

PATH = public_tokenizers.path("word_bpe_49k.json")


def plain(lengths, capacity):
    """Best-fit decreasing on single pieces: how many bins are filled how far. Bins of one capacity are alike."""
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = [b for b in bins if b[0] >= n]
        if fit:
            b = min(fit, key=lambda b: b[0])
        else:
            bins.append(b := [capacity, []])
        b[0] -= n
        b[1].append(n)
    return Counter(sum(b[1]) for b in bins)


@pytest.mark.parametrize("seed", range(40))
def test_counts_against_single_pieces(seed):
    rng = random.Random(seed)
    capacity = rng.choice([20, 64, 100])
    lengths = [rng.randint(1, capacity if rng.random() < 0.3 else capacity // 3) for _ in range(rng.choice([0, 5, 400, 900]))]
    plan, n_bins = best_fit_decreasing(Counter(lengths), capacity)
    bins = {}
    for n, runs in plan.items():
        total, ends = Counter(lengths)[n], [r[0] for r in runs[1:]]
        for (rank, first, offset), end in zip(runs, [*ends, total]):
            for k in range(end - rank):
                bins.setdefault(first + k, []).append((offset, n))
    assert n_bins == len(bins) == sum(plain(lengths, capacity).values())
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= capacity
    assert sum(len(b) for b in bins.values()) == len(lengths)
    assert Counter(sum(n for _, n in b) for b in bins.values()) == plain(lengths, capacity)


def test_word_ids():
    texts = ["The CAT'S hat. don't <|endoftext|> x<|ENDOFTEXT|>y", "É ﬁ K 12,5 a.,b,.", None, "", " \n\t", "a b c \x1cd", "é É. ΑΣ ΑΣ.", "abc." * 50, "no. no, no.", "it's 'LL'll"]
    offsets, ids = WordEncoder(PATH).encode(pa.array(texts))
    t = Tokenizer.from_file(PATH)
    for i, x in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == t.encode(x or "", add_special_tokens=False).ids


def test_words_with_signs_at_their_end_are_encoded_as_stems(monkeypatch):
    words = ["Para.###", "abc***", "é!?", "don'", "x<|", "abc", "a\\", "b^_`", "c{|}~", "D[]"]
    each, real = [], WordEncoder._each
    monkeypatch.setattr(WordEncoder, "_each", lambda self, them: (each.extend(them), real(self, them))[1])
    t = Tokenizer.from_file(PATH)
    offsets, ids = WordEncoder(PATH).encode(pa.array([*words, "l'a 3# a-b <|endoftext|>###"]))
    assert each and not set(each) & {w.lower() for w in words}
    for i, x in enumerate([*words, "l'a 3# a-b <|endoftext|>###"]):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == t.encode(x, add_special_tokens=False).ids


def test_pack(spark):
    t = Tokenizer.from_file(PATH)
    rng = random.Random(4)
    rows = [(k, " ".join(rng.choice(["alpha", "beta.", "GAMMA", "x9"]) for _ in range(rng.randrange(60)))) for k in range(50)]
    rows += [(60, None), (61, ""), (62, "word " * 500), (63, rows[1][1]), (63, rows[1][1])]
    df = spark.createDataFrame([(i, x, 1) for i, x in rows], "doc_id long, text string, length int").repartition(4)
    got = pack(df, "doc_id", "text", PATH, 0, 64, with_ids=True).collect()
    want = []
    for i, x in rows:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        want += [(i, k // 64, k, ids[k : k + 64]) for k in range(0, len(ids), 64)]
    assert sorted((r.doc_id, r.piece, r.start, r.ids) for r in got) == sorted(want)
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids) for r in got)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        assert [o for o, _ in sorted(b)] == [sum(n for _, n in sorted(b)[:k]) for k in range(len(b))] and sum(n for _, n in b) <= 64
    assert len(bins) == sum(plain([len(w[3]) for w in want], 64).values())
    assert pack(df.limit(0), "doc_id", "text", PATH).count() == 0
