import math
import random
import re
from collections import Counter

import pytest

from curata.llm import quality_rules as Q
from curata.llm import weak_labels as W
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    """The base metrics of a text, one by one."""
    t = text or ""
    w = WORD.findall(t)
    grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    hit = {k + j for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for j in range(5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)


TEXTS = [None, "", " \n ", "one two", "a b c d e f " * 9, "x\ny\nx\n\n \n \nx", "é ü ## $$ <b>", "line one here\n" * 30, "a\x0bb\x0cc\rd", "w " * 2000, "\n".join(f"l{k % 3}" for k in range(9))]


def test_base_metrics(spark):
    rng = random.Random(1)
    texts = TEXTS + [" ".join(rng.choice(["a", "b", "c#", "d\n"]) for _ in range(rng.randrange(60))) for _ in range(80)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_words string").repartition(3)
    got = {r.doc_id: tuple(r[m] for m in Q.METRICS) for r in Q.with_metrics(df, "text").collect()}
    assert got == {i: base(t) for i, t in enumerate(texts)}


def test_sketch_quantiles_and_merging(spark):
    rng = random.Random(2)
    rows = [(k % 3, rng.choice([0, 1, 1, rng.randrange(1, 500)])) for k in range(3000)]
    df = spark.createDataFrame(rows, "g int, n_symbols long").select("g", "n_symbols", *(F.lit(1).cast("long").alias(m) for m in Q.METRICS if m != "n_symbols"))
    whole = Q.sketch(df, ["g"])
    parts = Q.merge(Q.sketch(df.where("n_symbols % 2 = 0"), ["g"]).unionAll(Q.sketch(df.where("n_symbols % 2 = 1"), ["g"])), ["g"])
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, parts.collect()))
    for r in Q.quantiles(whole, ["g"], {"q": 0.9}).where("rate = 'symbols_per_word'").collect():
        x = sorted(v for g, v in rows if g == r.g)
        want = x[math.ceil(0.9 * len(x)) - 1]
        assert abs(r.q - want) <= 0.011 * want


def test_rules(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9)))
    good = [(i, " ".join(word() for _ in range(60)), "en", f"s{i % 2}") for i in range(600)]
    junk = [(1000 + i, " ".join(word() + "###" for _ in range(60)), "en", "s0") for i in range(90)]
    odd = [(2000, None, None, None), (2001, "too short", "en", "s1"), (2002, " ".join(word() for _ in range(60)), None, "rare"), (2003, "r e p e a t " * 20, "en", "s1")]
    df = spark.createDataFrame(good + junk + odd, "doc_id long, text string, lang string, source string").withColumn("kept", F.lit(1)).repartition(4)
    got = {r.doc_id: r for r in Q.apply_rules(df, "text").collect()}
    assert len(got) == 694
    assert all(got[i].kept for i, *_ in good) and not any(got[i].kept for i, *_ in junk)
    assert [got[i].base_failed for i in (2000, 2001, 2002, 2003)] == [True, True, False, True] and got[2002].kept
    assert Q.apply_rules(df.limit(0), "text").count() == 0


def test_limits_come_from_each_group(spark):
    """A rate that is usual in one group is an outlier in another; no fixed cutoff parts them."""
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    text = lambda marks, n=5: " ".join(word(n + rng.randrange(-1, 2)) + "#" * (k < marks) for k in range(60))
    code = [(i, text(rng.randrange(15, 31)), "en", "code") for i in range(300)]
    prose = [(1000 + i, text(0), "en", "prose") for i in range(300)]
    odd = [(2000, text(12), "en", "prose"), (2001, text(12), "en", "code"), (2002, text(0, 9), "en", "prose")]
    df = spark.createDataFrame(code + prose + odd, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.kept for r in Q.apply_rules(df, "text").collect()}
    assert all(got[i] for i, *_ in code + prose)
    assert not got[2000] and got[2001] and not got[2002]
    limits = {r.source: r for r in Q.thresholds(Q.with_metrics(df, "text"), ["lang", "source"]).collect()}
    assert limits["code"].symbols_per_word > 5 * limits["prose"].symbols_per_word


def test_small_languages_take_the_limit_of_all_rows(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 8)))
    good = [(i, " ".join(word() for _ in range(60)), "en", "s0") for i in range(300)]
    lone = [(1000, " ".join(word() + "###" for _ in range(60)), "xx", "s0"), (1001, " ".join(word() + "###" for _ in range(60)), None, None), (1002, " ".join(word() for _ in range(60)), "xx", "s1")]
    got = {r.doc_id: r.kept for r in Q.apply_rules(spark.createDataFrame(good + lone, "doc_id long, text string, lang string, source string"), "text").collect()}
    assert all(got[i] for i, *_ in good) and (got[1000], got[1001], got[1002]) == (False, False, True)


def test_label_model_finds_accuracies():
    rng = random.Random(4)
    accuracy = [0.95, 0.9, 0.8, 0.75, 0.6]
    counts, truth = Counter(), {}
    for _ in range(20000):
        y = rng.random() < 0.8
        v = "".join("0" if rng.random() < 0.2 else "12"[y == (rng.random() < a)] for a in accuracy)
        counts[v] += 1
        truth.setdefault(v, []).append(y)
    m = W.expectation_maximisation(counts)
    assert abs(m.prior - 0.8) < 0.04
    for k, a in enumerate(accuracy):
        assert abs(m.table[k, 1, W.GOOD] / (m.table[k, 1, W.GOOD] + m.table[k, 1, W.BAD]) - a) < 0.04
    right = sum(sum(t == (m.posterior(v) > 0.5) for t in ts) for v, ts in truth.items()) / 20000
    assert right > 0.93


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01"])
def test_classifier_on_gold_labels(spark, sf):
    """Gold labels are used here alone."""
    out = W.classify(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id", "text").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    n = {(r.quality, r.kept): r["count"] for r in out.groupBy("quality", "kept").count().collect()}
    assert n.get((1, False), 0) <= 0.02 * n[1, True] and n.get((0, True), 0) <= 0.1 * n[0, False]


def test_classifier_edges(spark):
    df = spark.createDataFrame([(1, None, 0.0), (2, "", 0.0), (3, "some words here.", 0.0), (None, "some words here.", 0.0)], "doc_id long, text string, score double")
    got = W.classify(df, "doc_id", "text").collect()
    assert [r.score for r in got if not r.text] == [0.0, 0.0] and len({r.score for r in got if r.text}) == 1
    assert W.classify(df.limit(0), "doc_id", "text").count() == 0
