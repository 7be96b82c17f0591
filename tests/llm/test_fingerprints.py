from pyspark.sql import functions as F

from curata.llm import fingerprints as f


def test_next_and_edited(spark):
    rows = [(5, "abcdefg"), (-3, None), (9, "héllo wörld"), (10, "x"), (10**9, "tail"), (9, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("block", F.lit(1)).repartition(3)
    got = f.fingerprints(df, "doc_id", "text").collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.text): r for r in got}
    assert by[(5, "abcdefg")].edited_text[:4] == "abcd" and by[(5, "abcdefg")].next_text in ("héllo wörld", "again")
    assert by[(-3, "")].next_text == "abcdefg" and by[(-3, "")].edited_text == "" and by[(-3, "")].anchors == []
    assert by[(10**9, "tail")].next_text == "" and by[(10**9, "tail")].edited_text == "ta"
    assert by[(10, "x")].next_text == "tail"
    assert {by[(9, "again")].next_text, by[(9, "héllo wörld")].next_text} in ({"héllo wörld", "x"}, {"again", "x"})


def test_closed_syncmers_by_brute_force(spark):
    words = [f"w{(k * k * 7 + k) % 41}" for k in range(400)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, "\n ".join(words[50:]) + " \t"), (3, "one two"), (4, "one  two"), (5, "")], "doc_id long, text string")
    h = {r.w: r.h for r in spark.createDataFrame([(w,) for w in set(words)], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    a = [h[w] for w in words]
    pairs = [(x, y) for x, y in zip(a, a[1:])]
    inner = {(r.x, r.y): r.h for r in spark.createDataFrame(sorted(set(pairs)), "x long, y long").select("x", "y", F.xxhash64("x", "y").alias("h")).collect()}
    m = [inner[p] for p in pairs]
    at = [i for i in range(len(a) - 4) if min(m[i : i + 4]) in (m[i], m[i + 3])]
    first = {}
    for i in at:
        first.setdefault(tuple(a[i : i + 5]), i)
    out = {r.doc_id: r.p for r in df.select("doc_id", f.anchors(F.col("text")).alias("p")).collect()}
    assert sorted(x["at"] for x in out[1]) == sorted(first.values())
    assert {x["hash"] for x in out[2]} <= {x["hash"] for x in out[1]} and len(out[2]) > 15
    assert out[3] == out[4] and len(out[3]) == 1 and out[5] == []
    like = df.alias("x").crossJoin(df.select("text").where("doc_id = 1").toDF("o")).select("doc_id", f.likeness(f.fingerprint(F.col("text")), f.fingerprint(F.col("o"))).alias("s"))
    got = {r.doc_id: r.s for r in like.collect()}
    x, y = {e["hash"] for e in out[1]}, {e["hash"] for e in out[2]}
    assert got[1] == 1.0 and got[3] == 0.0 and got[5] == 0.0 and abs(got[2] - len(x & y) / len(x | y)) < 0.15


def test_long_texts_keep_all_anchors(spark):
    words = [f"w{k}" for k in range(4000)]
    other = [w if k % 1000 else "changed" for k, w in enumerate(words)]
    passage = [f"o{k}" for k in range(3000)] + words[2000:2050] + [f"o{k}" for k in range(3000, 6000)]
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate((words, other, passage))], "doc_id long, text string")
    prints = df.select("doc_id", f.anchors(F.col("text")).alias("all"), f.fingerprint(F.col("text")).alias("p"))
    out = {r.doc_id: r for r in prints.collect()}
    assert all(r.p == r.all and len(r.p) > 1000 for r in out.values())
    pairs = prints.alias("x").crossJoin(prints.where("doc_id = 0").select(F.col("p").alias("o")))
    got = {r.doc_id: r.s for r in pairs.select("doc_id", f.likeness(F.col("p"), F.col("o")).alias("s")).collect()}
    h = {k: {e["hash"] for e in r.p} for k, r in out.items()}
    assert got == {k: len(x & h[0]) / len(x | h[0]) for k, x in h.items()}
    assert 0.9 < got[1] < 1.0 and 0.0 < got[2] < 0.05


def test_empty_table(spark):
    assert f.fingerprints(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").count() == 0


def test_positional_likeness(spark):
    words = [f"w{k}" for k in range(300)]
    rows = [(0, words), (1, words[:200] + ["x"] * 100), (2, ["extra", *words]), (3, words)]
    prints = spark.createDataFrame([(k, " ".join(w)) for k, w in rows], "doc_id long, text string").select("doc_id", f.anchors(F.col("text")).alias("p"))
    pairs = prints.crossJoin(prints.where("doc_id = 0").select(F.col("p").alias("o")))
    got = {r.doc_id: (r.s, r.l, r.p, r.o) for r in pairs.select("doc_id", "p", "o", f.in_place(F.col("p"), F.col("o")).alias("s"), f.likeness(F.col("p"), F.col("o")).alias("l")).collect()}
    for s, _, p, o in got.values():
        x, y = {tuple(e) for e in p}, {tuple(e) for e in o}
        assert s == len(x & y) / len(x | y)
    assert got[3][0] == 1.0 and got[2][0] == 0.0 and got[2][1] > 0.9 and 0.4 < got[1][0] < 0.9


def test_far_ids_negative_ids_and_long_texts(spark):
    rows = [(k, f"text {k}") for k in range(3000)] + [(2**62, "far"), (-(2**62), "deep"), (7, "a " * 200_000), (None, "none")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {(r.doc_id, r.text[:20]): r.next_text[:20] for r in f.with_next(df, "doc_id", "text", block_chars=1000).collect()}
    assert len(got) == len(rows)
    assert got[None, "none"] == "deep" and got[-(2**62), "deep"] == "text 0" and got[2999, "text 2999"] == "far" and got[2**62, "far"] == "none"
    assert all(got[k, f"text {k}"] == f"text {k + 1}" for k in range(2999) if k not in (6, 7))


def test_string_ids_are_refused(spark):
    import pytest

    with pytest.raises(TypeError, match="integers"):
        f.fingerprints(spark.createDataFrame([("a", "b")], "doc_id string, text string"), "doc_id", "text")
