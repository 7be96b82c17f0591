import random
import re

import pytest

from curata.llm.substring import dedup_substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, width):
    """doc_id -> (n_words, n_removed, kept)."""
    first = {}
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in words:
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < i:
                gone.update(range(k, k + width))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), kept))
    return sorted(out)


@pytest.mark.parametrize("chunk_chars", [200, 4_000_000])
def test_against_brute_force(spark, chunk_chars):
    rng = random.Random(3)
    passage = " ".join(f"p{k}" for k in range(20))
    rows = []
    for i in range(80):
        w = [rng.choice("abcdefgh") + str(rng.randrange(40)) for _ in range(rng.randrange(60))]
        if i % 3 == 0:
            w[len(w) // 2 : len(w) // 2] = passage.split()
        rows.append((i * 7 - 100, " \n\t"[i % 3].join(w)))
    rows += [(1000, None), (1001, ""), (1002, "  \n "), (1003, rows[5][1]), (1004, rows[6][1]), (1005, "a " * 3000), (1006, "a " * 3000), (1007, "é b " * 15), (1008, "é b " * 14)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_words string").repartition(5)
    got = dedup_substrings(df, "doc_id", "text", 13, chunk_chars=chunk_chars).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == brute(rows, 13)
    assert all(sum(s.end - s.start for s in r.removed) == r.n_removed for r in got)


def test_layout_nulls_repeats_and_empty(spark):
    w = [f"w{k}" for k in range(14)]
    df = spark.createDataFrame([(1, " ".join(w)), (1, " ".join(w)), (2, "x\n" + "\t".join(w) + "\n y z"), (None, "q")], "doc_id long, text string")
    got = {(r.doc_id, r.kept_text) for r in dedup_substrings(df, "doc_id", "text", 13, keep_layout=True).collect()}
    assert got == {(1, " ".join(w)), (2, "x\ny z"), (None, "q")}
    assert dedup_substrings(df.limit(0), "doc_id", "text").count() == 0
