import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from curata.llm.bpe_stream import Transducer, round_trip

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "Hello world", "  two  spaces ", "tabs\tand\n\nlines \n x", "don't I'LL we've", "naïve Ünïcode 日本語 😀👍🏽", "12345 1,234.5", "a b   c  d", "x \x1cy \x85z\x0b w",
    "<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "<|x", "", " ", "\n", "a ", " a", "é ́x", "word" * 900, "a" * 3000, "=" * 700 + " -" * 50, "� ퟿", "ab<| c", "ᾳ ﬁ ǅ ½ ² Ⅷ",
]


@pytest.fixture(scope="module")
def bpe():
    return Transducer.of(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_encode(bpe, library):
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice("ab tion the1\n'é.,<|>") for _ in range(rng.randrange(80))) for _ in range(300)]
    for t in texts:
        assert bpe.encode(t) == library.encode(t, add_special_tokens=False).ids, t


def test_stream_emits_early_and_keeps_little(bpe, library):
    rng = random.Random(2)
    for letters in ("a", "ab", "etaoin", "=-", "日本"):
        piece = "".join(rng.choice(letters) for _ in range(1500))
        got, seen = [], 0

        def parts():
            nonlocal seen
            for c in piece.encode():
                seen += 1
                yield bytes([c])

        held = 0
        for t in bpe.stream(parts()):
            got.append(t)
            held = max(held, seen - sum(len(bpe.bytes_of[x]) for x in got))
        whole = "".join(piece.split())
        assert got == bpe.merged(whole.encode())
        assert held <= 8 * bpe.lookahead


def test_decode(bpe, library):
    rng = random.Random(3)
    for _ in range(200):
        ids = [rng.choice((rng.randrange(50257), rng.randrange(256))) for _ in range(rng.randrange(12))]
        d = bpe.decoder()
        assert "".join(map(d.feed, ids)) + d.close() == library.decode(ids, skip_special_tokens=False)


def test_table(spark, library):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, None), (None, "Hello world"), (4, "the  cat sat on the mat the cat")]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n_tokens int").repartition(3)
    got = round_trip(df, "doc_id", "text", PATH).collect()
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i if i is not None else -1, len(ids), ",".join(map(str, ids)), t or ""))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.ids_text, r.decoded) for r in got) == sorted(want)
    assert round_trip(df.limit(0), "doc_id", "text", PATH).count() == 0


def test_every_distinct_piece_goes_through_the_transducer():
    import pyarrow as pa

    from curata.llm import bpe_stream as B

    bpe = Transducer(PATH)
    before = bpe.streamed
    text = pa.array(["the cat sat on the mat", "the cat, the mat", None])
    offsets, ids = B.encode_texts(bpe, text)
    assert bpe.streamed - before == len({"the", " cat", " sat", " on", " the", " mat", ","})
    assert B.decode_ids(bpe, offsets, ids) == ["the cat sat on the mat", "the cat, the mat", ""]
    B.encode_texts(bpe, text)
    assert bpe.streamed - before == 7


def test_a_long_word_takes_constant_memory(bpe):
    from curata.llm.bpe_stream import OpenPiece

    open_, held, n = OpenPiece(bpe), 0, 0
    for _ in range(200):
        n += len(open_.feed(b"abcab" * 1000))
        held = max(held, len(open_.last))
    assert held <= 4 * bpe.lookahead and n > 100_000


def test_tokens_stay_apart_as_the_merges_have_it(bpe):
    rng = random.Random(5)
    made = sorted(bpe.size)
    for _ in range(3000):
        a, b = rng.choice(made[: rng.choice((400, 5000, len(made)))]), rng.choice(made)
        assert bpe._apart(a, b) == (bpe.merged(bpe.bytes_of[a] + bpe.bytes_of[b]) == [a, b])
