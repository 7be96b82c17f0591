import random
import re

import pytest

from curata.llm.components import components
from curata.llm.ngram_join import near_duplicate_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def brute(rows, n, percent):
    sets = []
    for _, t in rows:
        w = WORD.findall(lower(t or ""))
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            x = len(sets[i] & sets[j])
            if x and 100 * x >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


def rows_of(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + str(rng.randrange(60))
    passage = [word() for _ in range(60)]
    rows, base = [], [word() for _ in range(150)]
    for i in range(60):  # near copies, a chain of edits among them
        w = list(base)
        for _ in range(rng.randrange(8)):
            w[rng.randrange(len(w))] = word()
        rows.append((i * 3 + 5, " ".join(w)))
        if i % 9 == 0:
            base = w
    for i in range(40):
        w = passage + [word() for _ in range(rng.randrange(15))]
        rng.random() < 0.3 and rng.shuffle(w)
        rows.append((1000 + i, "\n".join(w)))
    for i in range(30):
        rows.append((2000 + i, " ".join(word() for _ in range(rng.randrange(90)))))
    rows += [(1, None), (2, ""), (3, " \t"), (9001, "A b"), (9002, "a  B"), (9003, "a c"), (9004, rows[3][1].upper()), (9005, rows[3][1]), (9006, "z " * 500), (9007, "z " * 900)]
    return rows


@pytest.mark.parametrize("n,percent,seed,frequent,chunk", [(4, 85, 1, 64, 4_000_000), (5, 80, 2, 3, 3000), (5, 80, 3, None, 3000)])
def test_against_brute_force(spark, monkeypatch, n, percent, seed, frequent, chunk):
    from curata.llm import ngram_join

    if frequent:  # else the bound that the data give
        monkeypatch.setattr(ngram_join, "class_bound", lambda nodes: frequent)
    monkeypatch.setattr(ngram_join, "SPLIT", 7)
    rows = rows_of(seed)
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, size int").repartition(5)
    got = near_duplicate_components(df, "doc_id", "text", n, percent, chunk_chars=chunk).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, n, percent)


def test_links_come_from_both_classes(spark, monkeypatch):
    from pyspark.sql import functions as F

    from curata.llm import ngram_join

    seen, real = {}, ngram_join.keys

    def spy(nodes, bound):
        index = real(nodes, bound)
        holders = index.groupBy("key", "combined").agg(F.countDistinct("node").alias("n")).where("n > 1")
        seen.update({r.combined: r.n for r in holders.groupBy("combined").agg(F.count("key").alias("n")).collect()})
        seen["bound"] = bound
        return index

    monkeypatch.setattr(ngram_join, "keys", spy)
    rows = rows_of(4)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = near_duplicate_components(df, "doc_id", "text", 5, 80).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 5, 80)
    assert seen[True] > 0 and seen[False] > 0 and seen["bound"] in ngram_join.CLASSES


def test_nodes_that_share_many_keys_are_paired_once(spark, monkeypatch):
    from curata.llm import ngram_join

    made, real = [], ngram_join._across

    def spy(rows, percent):
        pairs = real(rows, percent)
        made.append((pairs.count(), pairs.distinct().count()))
        return pairs

    monkeypatch.setattr(ngram_join, "_across", spy)
    monkeypatch.setattr(ngram_join, "class_bound", lambda nodes: 3)
    rng = random.Random(6)
    base, rows = [f"w{k}" for k in range(215)], []
    for i in range(60):  # two with two edits each link, one with two and one with three only nearly
        w = list(base)
        for k in rng.sample(range(4, 210, 5), rng.choice((2, 3))):
            w[k] = f"v{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = near_duplicate_components(df, "doc_id", "text", 5, 80).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 5, 80)
    ((pairs, distinct),) = made
    assert distinct > 20 and pairs <= 2 * distinct


def test_null_ids_string_ids_and_long_texts(spark):
    words = [f"w{k * k % 7919}" for k in range(60_000)]
    texts = [" ".join(words), " ".join(["other", *words[1:]]), None, "a b c d e f", "a b c d e f", "x" * 300_000]
    df = spark.createDataFrame([(None if i == 4 else f"d{i}", t) for i, t in enumerate(texts)], "doc_id string, text string")
    got = {(r.doc_id, r.size): r.component for r in near_duplicate_components(df, "doc_id", "text", 5, 80).collect()}
    assert got["d0", max(s for d, s in got if d == "d0")] == got["d1", max(s for d, s in got if d == "d1")] == "d0"
    assert got["d2", 0] == "d2" and got["d3", 2] == got[None, 2] == "d3" and got["d5", 1] == "d5"


def test_empty(spark):
    assert near_duplicate_components(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").count() == 0


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 102), (101, 102), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 0), 101: 100, 102: 100}
