import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer
from tokenizers.models import Unigram
from tokenizers.pre_tokenizers import Metaspace

from curata.llm.token_counts import Counter, count_tokens, vocabulary

PATH = public_tokenizers.path("piece_bpe_32k.model")


def library(pieces):
    t = Tokenizer(Unigram([("<unk>", 0.0), *pieces], 0, False))
    t.pre_tokenizer = Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return t


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    out = ["", " ", "  ", "Hello world", " lead", "trail ", "two  spaces", "line\nbreak\ttab", "日本語 mixed ☃☃☃ ☃", "▁mark▁", "\n", "x" * 300, "ሴሴሴ ab ሴ", "a\x00b"]
    return out + ["".join(rng.choice("the an ☃e▁ tion\nQzéሴ") for _ in range(rng.randrange(60))) for _ in range(400)]


def test_against_the_library(spark, texts):
    t = library(vocabulary(PATH))
    df = spark.createDataFrame([(i, x, 0) for i, x in enumerate([*texts, None])], "doc_id long, text string, n_tokens int").repartition(3)
    got = {r.doc_id: r.n_tokens for r in count_tokens(df, "text", PATH).collect()}
    assert got == {i: len(t.encode(x or "", add_special_tokens=False).ids) for i, x in enumerate([*texts, None])}
    assert count_tokens(df.limit(0), "text", PATH).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_ties(seed):
    """Many equal scores: the piece that starts first wins, as in the library."""
    rng = random.Random(seed)
    pieces = {"▁": -1.0} | {c: float(-rng.randrange(1, 3)) for c in "abc"}
    for _ in range(30):
        pieces.setdefault("".join(rng.choice("▁abc") if k == 0 else rng.choice("abc") for k in range(rng.randrange(2, 5))), float(-rng.randrange(1, 4)))
    t, c = library(list(pieces.items())), Counter(list(pieces.items()))
    for _ in range(300):
        word = "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 14)))
        assert c.viterbi("▁" + word)[0] == len(t.encode(word).ids)
