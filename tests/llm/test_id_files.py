import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from curata.llm import id_files as I

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("n", [0, 1, 2, 2047, 2048, 2049, 9000])
@pytest.mark.parametrize("top", [1, 2, 50_000, 200_000])
def test_round_trip(n, top):
    ids = np.random.default_rng(n + top).integers(0, top, n).astype(np.uint32)
    chunk = I.encode_chunk(ids) | {"chunk": 0}
    assert (I.decode_chunk(chunk) == ids).all()


def test_repeats_shrink_and_blocks_stand_alone():
    once = np.random.default_rng(1).integers(0, 3000, 200).astype(np.uint32)
    ids = np.tile(once, 60)
    chunk = I.encode_chunk(ids) | {"chunk": 0}
    assert (I.decode_chunk(chunk) == ids).all() and sum(map(len, chunk["blocks"])) < len(ids)
    one = chunk | {k: chunk[k][2:3] for k in ("blocks", "block_sizes", "block_crc32")}
    assert (I.decode_chunk(one) == ids[2 * I.BLOCK : 3 * I.BLOCK]).all()


@pytest.mark.parametrize("n_ids", [4093, 4094, 4095, 4096])
def test_tables_of_either_width(n_ids):
    ids = np.concatenate([np.arange(n_ids), np.tile(np.arange(n_ids - 40, n_ids), 200)]).astype(np.uint32)
    chunk = I.encode_chunk(ids) | {"chunk": 0}
    assert (I.decode_chunk(chunk) == ids).all()
    assert I._Mix(1, n_ids).table.itemsize == (2 if n_ids < 4095 else 4)


def test_coded_bytes_stay():
    rng = np.random.default_rng(8)
    ids = np.concatenate([np.repeat(rng.zipf(1.3, 9000) % 700, 2), np.tile(rng.integers(0, 3000, 90), 80), rng.integers(0, 60_000, 9000)])
    blocks = I.encode_chunk(ids.astype(np.uint32))["blocks"]
    assert (len(b"".join(blocks)), zlib.crc32(b"".join(blocks))) == (32228, 363598810)


def test_damage_is_found():
    ids = np.random.default_rng(1).integers(0, 3000, 5000).astype(np.uint32)
    chunk = I.encode_chunk(ids) | {"chunk": 7}
    b = bytearray(chunk["blocks"][1])
    b[100] ^= 4
    chunk["blocks"][1] = bytes(b)
    with pytest.raises(ValueError, match="block 1 of chunk 7"):
        I.decode_chunk(chunk)


def test_files(spark, tmp_path):
    t = Tokenizer.from_file(PATH)
    rng = random.Random(2)
    rows = [(k * 5 - 40, " ".join(rng.choice(["alpha", "Beta,", "gamma."]) for _ in range(rng.randrange(90)))) for k in range(60)]
    rows += [(7, None), (10**12, ""), (12, rows[3][1]), (12, rows[3][1]), (None, "x")]
    df = spark.createDataFrame([(i, x, 0) for i, x in rows], "doc_id long, text string, n_tokens int").repartition(4)
    I.write(df, "doc_id", "text", f"file://{tmp_path}/f", PATH, 1, chunk_chars=2000)
    got = sorted(I.read(spark, f"file://{tmp_path}/f", "doc_id", with_ids=True).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    want = sorted([*t.encode(x or "", add_special_tokens=False).ids, 1] for _, x in rows)
    assert sorted(r.ids for r in got) == want
    I.write(df.limit(0), "doc_id", "text", f"file://{tmp_path}/e", PATH, 1)
    assert I.read(spark, f"file://{tmp_path}/e", "doc_id").count() == 0


def test_predictions_beat_order_0():
    rng = np.random.default_rng(4)
    follows = rng.integers(0, 60, (60, 4))
    ids = [0]
    for k in rng.integers(0, 4, 60_000).tolist():
        ids.append(int(follows[ids[-1], k]))
    ids = np.array(ids, np.uint32)
    chunk = I.encode_chunk(ids) | {"chunk": 0}
    assert (I.decode_chunk(chunk) == ids).all()
    share = np.bincount(ids) / len(ids)
    entropy = -(share[share > 0] * np.log2(share[share > 0])).sum() / 8
    assert sum(map(len, chunk["blocks"])) < 0.6 * entropy * len(ids)


def test_many_shapes_round_trip():
    rng = np.random.default_rng(8)
    for k in range(60):
        n, top = int(rng.integers(1, 7000)), int(rng.integers(1, 500))
        ids = np.minimum(rng.zipf(1.3, n), top).astype(np.uint32) if k % 2 else np.repeat(rng.integers(0, top, n // 5 + 1), 5).astype(np.uint32)
        chunk = I.encode_chunk(ids) | {"chunk": 0}
        assert (I.decode_chunk(chunk) == ids).all()


def test_memo_keeps_what_is_asked_for_again():
    import pyarrow as pa

    from curata.llm.common import SpanMemo

    learnt = []

    def learn(place, strings):
        learnt.extend(strings)
        return np.array([len(x) for x in strings], np.int64), np.array([ord("a") + c for x in strings for c in x], np.uint32)

    memo = SpanMemo(10)
    for k in range(40):
        keys = pa.array(["hot", "warm", f"rare{k}", f"odd{k}"])
        at = memo.places(keys, learn)
        for i, key in zip(at, keys.to_pylist(), strict=True):
            got = memo.ids[memo.starts[i] : memo.starts[i] + memo.sizes[i]]
            assert [int(x) - ord("a") for x in got] == list(key.encode())
        assert len(memo.known) <= 10
    assert learnt.count(b"hot") == 1 and learnt.count(b"warm") == 1
    wide = SpanMemo(3)
    for _ in range(2):
        assert len(set(wide.places(pa.array(list("abcdefgh")), learn))) == 8
