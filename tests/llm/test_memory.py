"""What a Python worker holds once a stage has ended. In a session of its own, for other tests' workers hold memos."""

import os
import subprocess
import sys

import public_tokenizers
import pyarrow as pa

from curata.llm import common as C
from curata.llm.packing import pieces

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = r"""
import re, sys
import numpy as np, pandas as pd, pyarrow as pa
from pyspark.sql import SparkSession, functions as F
from curata.llm import quality_rules, substring, weak_labels

spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", f"file://{sys.argv[1]}").getOrCreate()
rng = np.random.default_rng(3)
words = np.array([f"w{i:x}" for i in range(60_000)])
texts = [" ".join(words[(rng.random(500) ** 3 * len(words)).astype(int)]) for _ in range(6_000)]
docs = spark.createDataFrame(pd.DataFrame({"doc_id": range(len(texts)), "text": texts})).repartition(1)

def held():
    def size(batches):
        for _ in batches:
            pass
        got = re.findall(r"Pss_Anon:\s+(\d+)", open("/proc/self/smaps_rollup").read())
        yield pa.RecordBatch.from_pydict({"mb": [int(got[0]) // 1024]})
    return spark.range(1).coalesce(1).mapInArrow(size, "mb long").first()[0]

first = held()
for stage in (lambda: weak_labels.classify(docs, "doc_id", "text"), lambda: quality_rules.with_metrics(docs, "text"), lambda: substring.dedup_substrings(docs, "doc_id", "text")):
    stage().write.format("noop").mode("overwrite").save()
    print("HELD", held() - first)
"""


def test_worker_gives_free_memory_back(tmp_path):
    run = subprocess.run([sys.executable, "-c", SCRIPT, str(tmp_path)], cwd=ROOT, env=os.environ | {"PYTHONPATH": ROOT}, capture_output=True, text=True, timeout=200)
    more = [int(x.split()[1]) for x in run.stdout.splitlines() if x.startswith("HELD")]
    assert len(more) == 3 and max(more) < 80, (more, run.stderr[-1500:])


PEAK = r"""
import resource, sys
import numpy as np, pandas as pd, public_tokenizers, pyarrow as pa
from pyspark.sql import SparkSession
from curata.llm import packing

spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", f"file://{sys.argv[1]}").getOrCreate()
rng = np.random.default_rng(5)
words = np.array([f"w{i:x}" for i in range(20_000)])
texts = [" ".join(words[(rng.random(600) ** 3 * len(words)).astype(int)]) for _ in range(10_000)]

def peak(rows):
    docs = spark.createDataFrame(pd.DataFrame({"doc_id": range(len(rows)), "text": rows})).coalesce(1)
    packing.pieces(docs, "doc_id", "text", public_tokenizers.path("word_bpe_49k.json"), 0, 2048).write.format("noop").mode("overwrite").save()
    most = lambda batches: [pa.RecordBatch.from_pydict({"kb": [resource.getrusage(resource.RUSAGE_SELF).ru_maxrss]}) for _ in batches]
    return spark.range(1).coalesce(1).mapInArrow(most, "kb long").first()[0] // 1024

peak(texts[:100])
first = peak(texts[:500])
print("MORE", peak(texts) - first)
"""


def test_packing_worker_holds_few_rows_at_a_time(tmp_path):
    run = subprocess.run([sys.executable, "-c", PEAK, str(tmp_path)], cwd=ROOT, env=os.environ | {"PYTHONPATH": ROOT}, capture_output=True, text=True, timeout=200)
    more = [int(x.split()[1]) for x in run.stdout.splitlines() if x.startswith("MORE")]
    assert len(more) == 1 and more[0] < 80, (more, run.stderr[-1500:])


def test_batches_are_bounded_unless_the_session_says_otherwise(spark):
    key, sizes = "spark.sql.execution.arrow.maxBytesPerBatch", lambda batches: (pa.RecordBatch.from_pydict({"rows": [b.num_rows], "bytes": [b.nbytes]}) for b in batches)
    docs = spark.createDataFrame([(i, "x" * (5_000_000 if i == 7 else 10_000)) for i in range(1000)], "doc_id long, text string").coalesce(1)
    before = spark.conf.get(key, None)
    try:
        spark.conf.set(key, "40000000")
        C.bound_batches(spark)
        assert spark.conf.get(key) == "40000000"
        spark.conf.unset(key)
        pieces(docs, "doc_id", "text", public_tokenizers.path("word_bpe_49k.json"), 0, 2048)
        got = docs.mapInArrow(sizes, "rows long, bytes long").collect()
        assert sum(r.rows for r in got) == 1000 and sum(r.bytes for r in got) > 14_000_000
        assert sorted(r.bytes for r in got)[-2] < 2_100_000 and max(r.bytes for r in got) < 7_200_000
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
