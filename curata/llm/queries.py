"""One query for each operator over the whole table it is meant for."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curata.llm import bpe_stream, fingerprints, id_files, ngram_join, packing, quality_rules, sharding, substring, token_counts, weak_labels
from curata.llm.common import documents, shared_dir

#: The tokenizer files' place, a function of the file's name.
TOKENIZER = public_tokenizers.path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op4_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = documents(spark, sf_dir).select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return sharding.shuffle_into_shards(docs, ["doc_id", "text_crc32", "size"], 8).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return substring.dedup_substrings(docs, "doc_id", "text", 13).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query
def op8_adaptive_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", "source")
    out = quality_rules.apply_rules(docs, "text")
    return out.select("doc_id", *quality_rules.METRICS, "base_failed", "kept")


@query
def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ngram_join.near_duplicate_components(documents(spark, sf_dir), "doc_id", "text", 4, 85)
    return out.select("doc_id", F.col("size").alias("n_shingles"), F.col("component").alias("component_id"))


@query
def op9_weak_label_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_labels.classify(documents(spark, sf_dir).select("doc_id", "text"), "doc_id", "text").select("doc_id", *weak_labels.OWN)


@query
def op2_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fingerprints
    prints = f.fingerprints(documents(spark, sf_dir), "doc_id", "text")
    return prints.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited_text", 256).alias("edited_sha256"),
        f.shown(F.col("anchors")).alias("fingerprint"),
        f.shown(F.col("edited_anchors")).alias("edited_fingerprint"),
        f.likeness(F.col("anchors"), F.col("edited_anchors")).alias("near_edited"),
        f.likeness(F.col("anchors"), F.col("next_anchors")).alias("near_next"),
        f.in_place(F.col("anchors"), F.col("edited_anchors")).alias("placed_edited"),
    )


@query
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), "doc_id", "text", TOKENIZER("word_bpe_49k.json"), 0, 2048)


@query
def op5_range_coded_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    id_files.write(documents(spark, sf_dir), "doc_id", "text", path, TOKENIZER("word_bpe_49k.json"), 1)
    return id_files.read(spark, path, "doc_id")


@query
def op10_streaming_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe_stream.round_trip(documents(spark, sf_dir), "doc_id", "text", TOKENIZER("byte_bpe_50k.json"))
    return out.select("doc_id", "n_tokens", F.sha2("ids_text", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op6_viterbi_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return token_counts.count_tokens(docs, "text", TOKENIZER("piece_bpe_32k.model")).drop("text")


_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

ORACLES["op7_substring_dedup"] = f"""
WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w WHERE len(w) >= 13)),
f AS (SELECT g, min(doc_id) AS first FROM g GROUP BY g HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, i + j AS k FROM (SELECT doc_id, i FROM g JOIN f USING (g) WHERE first < doc_id), range(13) r(j)),
u AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS k FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY k) AS t FROM u ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""

ORACLES["op3_ngram_jaccard_join"] = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM c JOIN n a ON x = a.doc_id JOIN n b ON y = b.doc_id WHERE 100 * c >= 85 * (a.n + b.n - c)),
links AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, links.y FROM r JOIN links ON r.c = links.x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least.c AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) least USING (doc_id)
"""
