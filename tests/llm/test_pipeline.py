"""Each stage of the pipeline by brute force on a small corpus, and the whole run."""

import random

import pytest

import corpus_pipeline as P
from curata.llm.common import materialise

from .test_ngram_join import brute as near
from .test_substring import brute as repeated

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n)) + "."
    passage = text(55)
    rows = [(i, text(rng.randrange(50, 90))) for i in range(120)]
    rows += [(200 + i, f"{text(40)}\n{passage}\n{text(40)}") for i in range(10)]
    rows += [(300 + i, rows[i][1]) for i in range(10)] + [(320 + i, rows[i][1] + " more") for i in range(10)]
    rows += [(400 + i, " ".join(word() + "###" for _ in range(60))) for i in range(12)] + [(500, None), (501, "")]
    return spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)


def rows_of(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


def test_stages(spark, corpus):
    docs = corpus
    kept = []
    for name, stage in P.STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, "/nowhere"))
        assert docs.columns == COLUMNS, name
        kept.append((rows_of(before), rows_of(docs)))
    (a, b), (_, c), (c2, d), (d2, e) = kept
    assert {i for i, _ in b} == {i for i, _ in a if i < 400}  # junk and empty texts go, clean ones stay
    assert c == b and c2 == c
    assert d == sorted((i, t) for i, t in c if (i, i) in {(x, m) for x, _, m in near(c, 5, 80)})
    want = {i: (n - r, k) for i, n, r, k in repeated(d, 13)}
    assert {i: (len(t.split()), " ".join(t.split())) for i, t in e} == {i: x for i, x in want.items() if x[0]}
    assert sum(len(t) != len(dict(d2)[i]) for i, t in e) == 9  # all but the first of the documents with the passage
    packed = P.STAGES[-1][1](spark, docs, "/nowhere").collect()
    assert {r.doc_id for r in packed} == {i for i, _ in e}


def test_run(spark, corpus, tmp_path):
    corpus.write.parquet(f"file://{tmp_path}/documents.parquet")
    out = P.run(spark, f"file://{tmp_path}").collect()
    assert len({r.doc_id for r in out}) == 130 and sum(r.length for r in out) > 10000
