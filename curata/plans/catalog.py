"""The registered queries over the driver's tables, each with the SQL that DuckDB compares it with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curata.functions import jsonrepair as J
from curata.functions import keys as K
from curata.functions import labels as L
from curata.functions import text as T
from curata.operators import messages as M
from curata.operators import relational as R
from curata.operators import reports, sampling, targets
from curata.plans import generate

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its oracle."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", *(columns or ("text",)))


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Article rows out of pages."""
    title = T.clean_text(F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    return table(spark, sf_dir, "pages").select("page_id", F.col("page_id").cast("string").alias("article_id"), title.alias("article_title"), (F.col("page_id") % 97).cast("string").alias("image_id"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fact rows out of documents; image ids repeat."""
    return documents(spark, sf_dir, "text", "source", "lang", "n_chars").withColumn("image_id", (F.col("doc_id") % 97).cast("string"))


#: The same for DuckDB.
CLEAN = "trim(regexp_replace(coalesce({}, ''), '\\s+', ' ', 'g'))"
DOC_TEXT = CLEAN.format("text")
TITLES = f"(SELECT page_id, page_id::VARCHAR AS article_id, {CLEAN.format(chr(39).join(['regexp_extract(html, ', '<title>([^<]*)</title>', ', 1)']))} AS article_title, (page_id % 97)::VARCHAR AS image_id FROM pages)"
FACTS = "(SELECT doc_id, text, source, lang, n_chars, (doc_id % 97)::VARCHAR AS image_id FROM documents)"
TOKENS = "regexp_extract_all(lower(" + DOC_TEXT + "), '[\\p{L}\\p{N}_]+')"
PHRASES = "list_filter(list_transform(regexp_split_to_array({}, '[,;]\\s*'), lambda p: trim(trim(p), ' .')), lambda p: p <> '')"


def strings(*xs: str) -> Column:
    return F.array(*map(F.lit, xs))


@query("""
SELECT lang, count(*)::BIGINT AS n_docs, count_if(length(t) >= 40)::BIGINT AS n_usable,
       round(count_if(length(t) >= 40)::DOUBLE / count(*), 6) AS usable_rate, count(quality)::BIGINT AS n_labelled
FROM (SELECT lang, quality, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS t
      FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY lang
""")
def usable_rate_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", (F.length(T.clean_text(F.col("text"))) >= 40).alias("usable"))
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    g = docs.join(labels, "doc_id", "left").groupBy("lang")
    return g.agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.count_if("usable").alias("n_usable"),
        F.round(F.count_if("usable") / F.count(F.lit(1)), 6).alias("usable_rate"),
        F.count("quality").alias("n_labelled"),
    )


# Text functions.


@query(f"SELECT doc_id, length({DOC_TEXT})::BIGINT AS n, sha256({DOC_TEXT}) AS clean_sha256 FROM documents")
def clean_text_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.clean_text(F.col("text"))
    return documents(spark, sf_dir).select("doc_id", F.length(t).cast("bigint").alias("n"), F.sha2(t, 256).alias("clean_sha256"))


@query(f"SELECT article_id, article_title, image_id FROM {TITLES}")
def title_extract_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return titles(spark, sf_dir).select("article_id", "article_title", "image_id")


@query(f"""
WITH t AS (SELECT doc_id, {TOKENS} AS w FROM documents),
g AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || chr(31) || w[i + 1] || chr(31) || w[i + 2])) AS g FROM t WHERE len(w) >= 3),
c AS (SELECT doc_id, max(n) AS top FROM (SELECT doc_id, g, count(*) AS n FROM g GROUP BY ALL) GROUP BY doc_id)
SELECT doc_id, coalesce(top, 0)::BIGINT AS top, len(w) >= 9 AND coalesce(top, 0) >= 3 AS repeats FROM t LEFT JOIN c USING (doc_id)
""")
def trigram_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = documents(spark, sf_dir).select("doc_id", T.tokens(F.col("text")).alias("w"))
    top = T.most_repeats(F.col("w")).cast("bigint")
    return words.select("doc_id", top.alias("top"), (F.size("w") >= 9) & (top >= 3)).toDF("doc_id", "top", "repeats")


@query(f"""
WITH t AS (SELECT doc_id, {DOC_TEXT} AS t FROM documents),
w AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, {TOKENS} AS w FROM documents)),
wr AS (SELECT doc_id, max(n) AS n FROM (SELECT doc_id, w, k, count(*) AS n FROM (SELECT doc_id, w, i - row_number() OVER (PARTITION BY doc_id, w ORDER BY i) AS k FROM w) GROUP BY ALL) GROUP BY doc_id),
c AS (SELECT doc_id, unnest(c) AS c, generate_subscripts(c, 1) AS i FROM (SELECT doc_id, string_split(t, '') AS c FROM t)),
cr AS (SELECT doc_id, max(n) AS n FROM (SELECT doc_id, c, k, count(*) AS n FROM (SELECT doc_id, c, i - row_number() OVER (PARTITION BY doc_id, c ORDER BY i) AS k FROM c) GROUP BY ALL) GROUP BY doc_id)
SELECT doc_id, length(t) >= 30 AS long_enough, coalesce(cr.n, 0) > 12 AS char_run, coalesce(wr.n, 0) >= 4 AS word_run
FROM t LEFT JOIN wr USING (doc_id) LEFT JOIN cr USING (doc_id)
""")
def usable_text_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return documents(spark, sf_dir).select("doc_id", (F.length(T.clean_text(t)) >= 30).alias("long_enough"), T.has_char_run(t).alias("char_run"), T.has_word_run(t).alias("word_run"))


@query(f"""
WITH p AS (SELECT doc_id, {PHRASES.format(DOC_TEXT)} AS p FROM documents),
d AS (SELECT doc_id, p, list_transform(p, lambda x: lower(x)) AS l FROM p),
k AS (SELECT doc_id, p, l, list_filter(range(1, len(p) + 1), lambda i: list_position(l, l[i]) = i) AS i FROM d)
SELECT doc_id, sha256(array_to_string(list_transform(i[1:32], lambda j: p[j]), ', ')) AS kept_sha256,
       len(p) >= 4 AND len(i) < len(p) AS repeats FROM k
""")
def dedupe_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return documents(spark, sf_dir).select("doc_id", F.sha2(T.dedupe_comma_phrases(t), 256).alias("kept_sha256"), T.has_repeated_comma_phrases(t).alias("repeats"))


@query(f"""
SELECT article_id, array_to_string(string_split(trim(regexp_replace(translate(article_title, '{{}}[]|"' || chr(39), '      '), '\\s+', ' ', 'g'), ' ,.;:'), ' ')[1:18], ' ') || '{T.FALLBACK_TAIL}' AS prompt
FROM {TITLES}
""")
def fallback_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return titles(spark, sf_dir).select("article_id", T.fallback_prompt(F.col("article_title")).alias("prompt"))


@query(f"""
WITH s AS (SELECT article_id, image_id, left(trim(regexp_replace(regexp_replace(article_title, '[^\\p{{L}}\\p{{N}}_-]', '_', 'g'), '_{{2,}}', '_', 'g'), '_'), 120) AS slug FROM {TITLES})
SELECT article_id, slug, slug || '__main__s0' AS candidate_id, ('0x' || substr(sha256('42||' || article_id || '||' || image_id), 1, 8))::BIGINT AS seed FROM s
""")
def slug_seed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    slug = T.slugify(F.col("article_title"))
    return titles(spark, sf_dir).select("article_id", slug.alias("slug"), F.concat(slug, F.lit("__main__s0")).alias("candidate_id"), T.stable_seed(F.lit(42), F.col("article_id"), F.col("image_id")).alias("seed"))


@query(f"SELECT article_id, '{T.STYLES['symbolic']}, ' || article_title AS before, article_title || ', {T.STYLES['silhouette']}' AS after, article_title AS plain FROM {TITLES}")
def flux_style_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("article_title")
    return titles(spark, sf_dir).select("article_id", T.styled_prompt(t, "symbolic").alias("before"), T.styled_prompt(t, "silhouette", "suffix").alias("after"), T.styled_prompt(t, "none").alias("plain"))


@query(f"""
SELECT doc_id, len(list_filter(list_transform(regexp_split_to_array({DOC_TEXT}, '[,;]'), lambda x: trim(x)), lambda x: x <> ''))::BIGINT AS n_parts,
       source || ', ' || lang AS joined, [source, lang] AS items FROM documents
""")
def list_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    as_json = F.to_json(F.array("source", F.lit(""), "lang"))
    docs = documents(spark, sf_dir, "text", "source", "lang")
    plain = F.when(F.col("text").startswith("["), F.concat(F.lit(" ,"), F.col("text"))).otherwise(F.col("text"))
    return docs.select("doc_id", F.size(T.text_list(plain)).cast("bigint").alias("n_parts"), T.text_value(as_json).alias("joined"), T.text_list(as_json).alias("items"))


@query(f"""
SELECT article_id, 'non-photorealistic editorial illustration, about ' || article_title || ', ' || CASE WHEN image_id = 'cue 5' THEN image_id ELSE image_id || ', Cue 5' END
       || ', symbolic editorial visual strategy, wide view, no watermark' AS prompt FROM (SELECT article_id, article_title, 'cue ' || image_id AS image_id FROM {TITLES})
""")
def plan_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    cue = F.concat(F.lit("cue "), F.col("image_id"))
    prompt = T.plan_prompt(F.col("article_title"), F.array(cue), F.array(F.upper(cue), F.lit("Cue 5")), F.lit("symbolic_editorial"), F.lit("wide view"), F.lit(""), ["non-photorealistic editorial illustration"], ["no watermark"])
    return titles(spark, sf_dir).select("article_id", prompt.alias("prompt"))


# Joins, resume, dedup.


@query(f"""
SELECT article_id, image_id, f.text IS NOT NULL AS vlm_parse_used, f.doc_id AS fact_doc, sha256(f.text) AS fact_sha256
FROM (SELECT article_id, (page_id % 131)::VARCHAR AS image_id FROM {TITLES}) t LEFT JOIN (SELECT image_id, max(doc_id) AS doc_id, max_by(text, doc_id) AS text FROM {FACTS} GROUP BY 1) f USING (image_id)
""")
def facts_lookup_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Titles have more image ids than facts do, so that some find none.
    wanted = titles(spark, sf_dir).withColumn("image_id", (F.col("page_id") % 131).cast("string"))
    last = R.last_by_key(facts(spark, sf_dir), "image_id", "doc_id", F.struct("doc_id", "text"))
    out = R.lookup(wanted, last, "image_id", "fact", "vlm_parse_used")
    return out.select("article_id", "image_id", "vlm_parse_used", F.col("fact.doc_id").alias("fact_doc"), F.sha2("fact.text", 256).alias("fact_sha256"))


def _done(spark: SparkSession, sf_dir: str) -> DataFrame:
    return titles(spark, sf_dir).where("page_id % 2 = 0").select("article_id", "image_id")


@query(f"SELECT article_id, image_id, article_title FROM {TITLES} WHERE page_id % 2 = 1")
def resume_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.not_done(titles(spark, sf_dir), _done(spark, sf_dir), ["article_id", "image_id"]).select("article_id", "image_id", "article_title")


@query(f"SELECT article_id FROM (SELECT * FROM {TITLES} ORDER BY page_id LIMIT 30) WHERE page_id % 2 = 1")
def limit_then_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.not_done(R.first_rows(titles(spark, sf_dir), "page_id", 30), _done(spark, sf_dir), ["article_id", "image_id"]).select("article_id")


@query(f"SELECT article_id FROM {TITLES} WHERE page_id % 2 = 1 ORDER BY page_id LIMIT 30")
def anti_then_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.first_rows(R.not_done(titles(spark, sf_dir), _done(spark, sf_dir), ["article_id", "image_id"]), "page_id", 30).select("article_id")


@query("""
SELECT doc_id, CASE WHEN doc_id = first THEN 'written' ELSE 'duplicate_article_id' END AS status
FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(coalesce(text, ''))) AS first FROM documents)
""")
def dedup_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("article_id"))
    return R.split_first(docs, "article_id", "doc_id").select("doc_id", F.when(F.col("is_first"), "written").otherwise("duplicate_article_id").alias("status"))


@query("SELECT sha256(text) AS content_sha256, min(doc_id) AS first_doc, count(*)::BIGINT AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def duplicate_content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).where("text is not null").groupBy(F.sha2("text", 256).alias("content_sha256"))
    return docs.agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("copies")).where("copies > 1")


@query(f"""
SELECT doc_id, len(e) = 0 AS ok, e AS errors FROM (SELECT doc_id, list_filter([CASE WHEN length(t) < 40 THEN 'sdxl_prompt_too_short' END, CASE WHEN quality IS NULL THEN 'missing_label' END,
CASE WHEN toxic = 1 THEN 'toxic' END], lambda x: x IS NOT NULL) AS e FROM (SELECT doc_id, {DOC_TEXT} AS t, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)))
""")
def valid_bad_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", (F.length(T.clean_text(F.col("text"))) < 40).alias("short")).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    errors = R.codes([("sdxl_prompt_too_short", F.col("short")), ("missing_label", F.col("quality").isNull()), ("toxic", F.col("toxic") == 1)])
    return docs.withColumn("errors", errors).select("doc_id", (F.size("errors") == 0).alias("ok"), "errors")


@query(f"""
SELECT reason, count(*)::BIGINT AS n FROM (SELECT CASE WHEN quality IS NULL OR quality = 0 THEN 'skipped_invalid' WHEN length({DOC_TEXT}) < 200 THEN 'skipped_missing_title'
WHEN toxic = 1 THEN 'skipped_revalidation' WHEN doc_id % 7 = 0 THEN 'skipped_no_vlm' ELSE 'written' END AS reason FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY 1
""")
def reason_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", (F.length(T.clean_text(F.col("text"))) < 200).alias("short")).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    reason = R.first_reason(
        [("skipped_invalid", F.coalesce("quality", F.lit(0)) == 0), ("skipped_missing_title", F.col("short")), ("skipped_revalidation", F.col("toxic") == 1), ("skipped_no_vlm", F.col("doc_id") % 7 == 0)],
        "written",
    )
    return reports.counts(docs, reason, "reason")


@query("""
SELECT conv_id, CASE WHEN n = 1 THEN 'ok' ELSE 'not_exactly_one_usable_prompt' END AS status, n FROM
(SELECT conv_id, count_if(role = 'assistant')::BIGINT AS n FROM conversations GROUP BY 1)
""")
def exactly_one_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "assistant").alias("n"))
    return rows.select("conv_id", F.when(F.col("n") == 1, "ok").otherwise("not_exactly_one_usable_prompt").alias("status"), "n")


# Labels and facts.


@query("""
SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'map' WHEN 1 THEN 'photograph' WHEN 2 THEN 'uncertain' WHEN 3 THEN 'stock_photograph' WHEN 4 THEN 'poster_or_logo' ELSE 'uncertain' END AS style FROM part
""")
def label_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.element_at(F.array(F.lit(" map "), F.lit("Real Photo"), F.col("p_type"), F.lit("junk|Stock-Photograph"), F.lit("Brand logo"), F.lit("map|chart")), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", L.normalize_label(raw, L.STYLE_TYPES).alias("style"))


@query("""
SELECT event_id, CASE event_id % 4 WHEN 0 THEN ['portrait', 'event_scene'] WHEN 1 THEN ['uncertain'] WHEN 2 THEN ['mixed_role'] ELSE ['map_based_representation'] END AS roles FROM events
""")
def label_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.element_at(F.array(F.lit("Portrait, event scene,portrait"), F.col("event_type"), F.lit("portrait|event_scene|open_role|mixed role"), F.lit("map-based")), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", L.normalize_label_list(raw, L.VISUAL_ROLES).alias("roles"))


@query(f"""
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS flag, label, CASE WHEN label IN ('small_amount', 'large_amount') AND doc_id % 4 <> 0 THEN length(raw) ELSE 0 END::BIGINT AS n_content
FROM (SELECT doc_id, raw, CASE WHEN doc_id % 4 = 0 THEN 'none' WHEN raw = '' THEN 'none' WHEN length(raw) <= 30 THEN 'small_amount' ELSE 'large_amount' END AS label FROM (SELECT doc_id, {DOC_TEXT} AS raw FROM documents))
""")
def bool_and_visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = L.visible_text(F.when(F.col("doc_id") % 4 == 0, " none").otherwise(T.clean_text(F.col("text"))))
    flag = L.normalize_bool(F.element_at(strings(" Yes", "0", "maybe"), (F.col("doc_id") % 3 + 1).cast("int")))
    docs = documents(spark, sf_dir).select("doc_id", flag.alias("flag"), v.alias("v"))
    return docs.select("doc_id", "flag", F.col("v.label").alias("label"), F.length("v.content").cast("bigint").alias("n_content"))


@query("""
SELECT doc_id, score, CASE WHEN score >= 0.70 THEN 'strong' WHEN score >= 0.40 THEN 'soft' ELSE 'ignore' END AS usage FROM (SELECT doc_id, greatest(0.0::DOUBLE, least(1.0::DOUBLE,
1.0::DOUBLE + CASE doc_id % 3 WHEN 0 THEN -0.25::DOUBLE WHEN 1 THEN -0.10::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN doc_id % 5 = 0 THEN -0.25::DOUBLE ELSE 0.0::DOUBLE END
+ CASE WHEN doc_id % 5 = 1 THEN -0.10::DOUBLE ELSE 0.0::DOUBLE END + CASE doc_id % 7 WHEN 0 THEN -0.15::DOUBLE WHEN 1 THEN -0.10::DOUBLE ELSE 0.0::DOUBLE END
+ CASE WHEN doc_id % 2 = 0 THEN -0.10::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN length(coalesce(text, '')) < 10 THEN -0.20::DOUBLE ELSE 0.0::DOUBLE END)) AS score FROM documents)
""")
def reliability_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda n, *xs: F.element_at(F.array(*xs), (F.col("doc_id") % n + 1).cast("int"))
    roles = pick(5, strings("uncertain"), strings("open_role"), *[strings("portrait")] * 3)
    r = L.reliability(pick(3, *map(F.lit, ("other", "mixed", "person"))), roles, pick(7, *map(F.lit, ("uncertain", "mixed_composition", *["collage"] * 5))), pick(2, F.lit("uncertain"), F.lit("map")), F.col("text"))
    return documents(spark, sf_dir).select("doc_id", r.alias("r")).select("doc_id", "r.score", "r.usage")


@query("SELECT event_type AS label, count(*)::BIGINT AS n FROM events GROUP BY 1")
def label_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.counts(table(spark, sf_dir, "events"), F.col("event_type"))


@query("""
SELECT label, count(*)::BIGINT AS n FROM (SELECT unnest(CASE doc_id % 3 WHEN 0 THEN ['portrait', lang] WHEN 1 THEN []::VARCHAR[] ELSE ['missing'] END) AS label FROM documents) GROUP BY 1
""")
def roles_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("portrait"), F.col("lang"))).when(F.col("doc_id") % 3 == 1, F.array().cast("array<string>"))
    return reports.exploded_counts(documents(spark, sf_dir, "lang"), roles)


@query(f"""
WITH w AS (SELECT doc_id, unnest(w) AS token, generate_subscripts(w, 1) AS pos FROM (SELECT doc_id, {TOKENS} AS w FROM documents))
SELECT token, count(*)::BIGINT AS n FROM w GROUP BY 1 ORDER BY n DESC, min((doc_id, pos)) LIMIT 30
""")
def audit_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = documents(spark, sf_dir).select("doc_id", F.posexplode(T.tokens(F.col("text"))).alias("pos", "token"))
    return reports.most_common(words, "token", ["doc_id", "pos"])


@query(f"""
SELECT count(*)::BIGINT AS total, count_if(t <> '')::BIGINT AS usable, count_if(recovery = 'model_written')::BIGINT AS model_written, count_if(recovery = 'plan_based_fallback')::BIGINT AS plan_based,
count_if(recovery = 'title_template_fallback')::BIGINT AS title_template, count_if(recovery = 'failed_no_prompt')::BIGINT AS failed, round(count_if(recovery = 'model_written')::DOUBLE / count(*), 6) AS model_rate,
round(count_if(recovery IN ('plan_based_fallback', 'title_template_fallback'))::DOUBLE / count(*), 6) AS fallback_rate
FROM (SELECT t, CASE WHEN length(t) >= 400 THEN 'model_written' WHEN length(t) >= 100 THEN 'plan_based_fallback' WHEN t <> '' THEN 'title_template_fallback' ELSE 'failed_no_prompt' END AS recovery FROM (SELECT {DOC_TEXT} AS t FROM documents))
""")
def inference_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.clean_text(F.col("text"))
    notes = F.when(F.length(t) >= 400, F.array().cast("array<string>")).when(F.length(t) >= 100, strings("plan_based_fallback")).when(t != "", strings("title_template_fallback")).otherwise(strings("no_prompt"))
    rows = documents(spark, sf_dir).select(t.alias("t"), notes.alias("notes"))
    recovery = R.first_reason([("plan_based_fallback", F.array_contains("notes", "plan_based_fallback")), ("title_template_fallback", F.array_contains("notes", "title_template_fallback")), ("failed_no_prompt", F.col("t") == "")], "model_written")
    rows = rows.withColumn("recovery", recovery)
    n = lambda *names: F.count_if(F.col("recovery").isin(*names))
    every = F.count(F.lit(1))
    return rows.agg(
        every.alias("total"), F.count_if(F.col("t") != "").alias("usable"), n("model_written").alias("model_written"), n("plan_based_fallback").alias("plan_based"), n("title_template_fallback").alias("title_template"),
        n("failed_no_prompt").alias("failed"), reports.rate(n("model_written"), every).alias("model_rate"), reports.rate(n("plan_based_fallback", "title_template_fallback"), every).alias("fallback_rate"),
    )


# Samples and splits.


@query("SELECT doc_id FROM documents ORDER BY sha256('42|' || doc_id::VARCHAR), doc_id LIMIT 50")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sample(documents(spark, sf_dir, "lang").select("doc_id"), "doc_id", 50)


@query("SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY sha256('42|' || o_orderkey::VARCHAR)) <= 500 THEN 'val' ELSE 'train' END AS split FROM orders")
def train_val_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.split(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 500)


@query("""
SELECT doc_id, lang, NULL::BOOLEAN AS schema_ok, NULL::BOOLEAN AS keep_for_sft FROM documents LEFT JOIN labels USING (doc_id) WHERE coalesce(quality, 1) = 1 ORDER BY sha256('7|' || doc_id::VARCHAR), doc_id LIMIT 40
""")
def audit_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir, "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left").where(F.coalesce("quality", F.lit(1)) == 1)
    nothing = F.lit(None).cast("boolean")
    return sampling.sample(rows, "doc_id", 40, 7).select("doc_id", "lang", nothing.alias("schema_ok"), nothing.alias("keep_for_sft"))


# Chat rows.


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each conversation; its turns are few."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    return turns.select("conv_id", F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


@query("""
SELECT conv_id, coalesce(roles = ['system', 'user', 'assistant'], false) AS chat_shape, coalesce(roles = ['system', 'user', 'assistant'], false) AND NOT blank AS trainable
FROM (SELECT conv_id, list(role ORDER BY turn) AS roles, count_if(trim(coalesce(text, '')) = '') > 0 AS blank FROM conversations GROUP BY 1)
""")
def messages_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conversations(spark, sf_dir).select("conv_id", M.has_chat_shape(F.col("messages")).alias("chat_shape"), M.is_trainable(F.col("messages")).alias("trainable"))


@query(f"""
SELECT article_id, '[{{"role":"system","content":"Plan."}},{{"role":"user","content":"Title: ' || replace(replace(article_title, '\\', '\\\\'), '"', '\\"') || '"}},{{"role":"assistant","content":"{{\\"ranking_caption\\":\\"' || image_id || '\\"}}"}}]' AS messages FROM {TITLES}
""")
def sft_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    say = lambda role, x: F.struct(F.lit(role).alias("role"), x.alias("content"))
    target = F.to_json(F.struct(F.col("image_id").alias("ranking_caption")))
    m = F.array(say("system", F.lit("Plan.")), say("user", F.concat(F.lit("Title: "), F.col("article_title"))), say("assistant", target))
    return titles(spark, sf_dir).select("article_id", F.to_json(m).alias("messages"))


@query("""
WITH t AS (SELECT doc_id, list_transform(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda w: w <> '')[1:64], lambda w: length(w)) AS ids, doc_id // 8 AS batch FROM documents),
m AS (SELECT batch, max(len(ids)) AS m FROM t GROUP BY 1)
SELECT doc_id, m::BIGINT AS width, greatest(len(ids) - 10, 0)::BIGINT AS supervised, list_sum(ids)::BIGINT AS total, len(ids)::BIGINT AS attended FROM t JOIN m USING (batch) WHERE len(ids) > 10
""")
def token_mask_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "")
    ids = F.transform(words, lambda w: F.length(w).cast("bigint"))
    rows = documents(spark, sf_dir).select("doc_id", F.floor(F.col("doc_id") / 8).alias("batch"), M.masked(ids, F.lit(10), 64).alias("x")).select("doc_id", "batch", "x.*")
    out = M.padded(rows, "batch").where("supervised > 0")
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)
    kept = F.size(F.filter("labels", lambda x: x != M.IGNORED)).cast("bigint")
    return out.select("doc_id", F.size("input_ids").cast("bigint").alias("width"), kept.alias("supervised"), total("input_ids").alias("total"), total("attention_mask").alias("attended"))


# Malformed JSON and near-miss keys.


@query("SELECT event_id, regexp_extract(props, '\"k\": *(-?[0-9.]+)', 1) AS k FROM events")
def json_parse_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", J.parse_object(F.col("props"))["object"]["k"].alias("k"))


#: Defect -> the text around a document's id, as Spark SQL's concat would have it.
DEFECTS = {
    "none": ('{"id": "', '", "n": 1}'),
    "fence": ('```json\n{"id": "', '", "n": 1}\n```'),
    "prose": ('Sure: {"id": "', '", "n": 1} done'),
    "singleton": ('[{"id": "', '", "n": 1}]'),
    "trailing_comma": ('{"id": "', '", "n": 1,}'),
    "comment": ('{"id": "', '", // the id\n "n": 1}'),
    "escape": ('{"id": "\\&', '", "n": 1}'),
    "extra_quote": ('{"id": "', '"", "n": 1}'),
    "key_tab": ('{"\tid": "', '", "n": 1}'),
    "python": ("{'id': '", "', 'n': 1}"),
    "broken": ('{"id": "', '"'),
}


@query("SELECT doc_id, CASE doc_id % 11 WHEN 6 THEN '&' || doc_id WHEN 10 THEN NULL ELSE doc_id::VARCHAR END AS id, CASE WHEN doc_id % 11 = 10 THEN NULL ELSE '1' END AS n FROM documents")
def json_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.element_at(F.array(*(F.concat(F.lit(a), F.col("doc_id").cast("string"), F.lit(b)) for a, b in DEFECTS.values())), (F.col("doc_id") % len(DEFECTS) + 1).cast("int"))
    got = documents(spark, sf_dir).select("doc_id", J.parse_object(made).alias("p"))
    return got.select("doc_id", F.try_element_at("p.object", F.lit("id")).alias("id"), F.try_element_at("p.object", F.lit("n")).alias("n"))


KEYS = ["SDXL Prompt", "visualPlan", "caption", "negativePrompt", "headline", "title understand", "weather"]


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.element_at(strings(*KEYS), (F.col("doc_id") % len(KEYS) + 1).cast("int")).alias("key"))


@query("SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'sdxl_prompt' WHEN 1 THEN 'generation_plan' WHEN 2 THEN 'ranking_caption' WHEN 3 THEN 'negative_prompt' END AS mapped FROM documents")
def fuzzy_keys_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keys(spark, sf_dir).select("doc_id", K.exact_key(F.col("key"), K.TOP_KEYS).alias("mapped"))


@query("SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'sdxl_prompt' WHEN 3 THEN 'negative_prompt' WHEN 5 THEN 'title_understanding' END AS mapped FROM documents")
def fuzzy_keys_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keys(spark, sf_dir).select("doc_id", K.partial_key(F.col("key"), K.TOP_KEYS).alias("mapped"))


@query()
def fuzzy_keys_likeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = _keys(spark, sf_dir).withColumn("key", F.when(F.col("doc_id") % 2 == 0, F.translate("key", "p", "b")).otherwise(F.col("key")))
    return K.map_keys(typed, "key", K.TOP_KEYS).select("doc_id", "key", "mapped")


# Plans and model calls.

GOOD_PLAN = (
    '"generation_plan":{"image_role":"thumbnail","required_visual_cues":["cue a","cue b"],"optional_visual_cues":[],"forbidden_or_misleading_cues":["blood"],'
    '"visual_strategy":"event_scene","framing":"wide view","abstractness":"literal"},"negative_prompt":"readable text, exact logos, watermark"'
)
GOOD_PROMPT = "flat vector editorial illustration of an event, no readable text"


def _planner_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model output made from ids: sound, with near-miss keys, fenced, without a plan, and unparsable."""
    d = F.col("doc_id").cast("string")
    tu = F.concat(F.lit('"title_understanding":{"headline_core":"core '), d, F.lit('","visual_risks":"wrong likeness; gore"},'))
    prompt = F.concat(F.lit(f',"sdxl_prompt":"{GOOD_PROMPT} '), d, F.lit('"'))
    whole = F.concat(F.lit("{"), tu, F.lit(GOOD_PLAN), prompt, F.lit("}"))
    kinds = [
        whole,
        F.replace(F.replace(whole, F.lit('"sdxl_prompt"'), F.lit('"SDXL Prompt"')), F.lit('"headline_core"'), F.lit('"headlineCore"')),
        F.concat(F.lit("```json\n"), F.replace(whole, F.lit("event_scene"), F.lit("dream_scene")), F.lit("\n```")),
        F.concat(F.lit("{"), tu, F.substring(prompt, F.lit(2), F.length(prompt)), F.lit("}")),
        F.lit("no plan today"),
    ]
    return documents(spark, sf_dir, "lang").select("doc_id", F.element_at(F.array(*kinds), (F.col("doc_id") % 5 + 1).cast("int")).alias("raw"), F.concat(F.lit("Title "), d).alias("title"))


@query(f"""
SELECT doc_id, k <> 4 AS parse_ok, CASE WHEN k = 4 THEN 'Title ' || doc_id ELSE 'core ' || doc_id END AS headline, CASE WHEN k = 4 THEN ['readable text', 'exact logos', 'misleading literal scene'] ELSE ['wrong likeness', 'gore'] END AS risks,
CASE WHEN k IN (3, 4) THEN []::VARCHAR[] ELSE ['cue a', 'cue b'] END AS cues, CASE WHEN k = 4 THEN '' ELSE '{GOOD_PROMPT} ' || doc_id END AS prompt, 'Title ' || doc_id || ': title-grounded editorial illustration' AS caption,
CASE WHEN k = 1 THEN 2 ELSE 0 END::BIGINT AS n_fuzzy FROM (SELECT doc_id, doc_id % 5 AS k FROM documents)
""")
def canonical_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = targets.canonical(_planner_output(spark, sf_dir), "doc_id", "raw", "title")
    tu, gp = "target.title_understanding", "target.generation_plan"
    fuzzy = F.size(F.filter("notes", lambda n: n.startswith("fuzzy_key:"))).cast("bigint")
    return t.select("doc_id", "parse_ok", F.col(f"{tu}.headline_core").alias("headline"), F.col(f"{tu}.visual_risks").alias("risks"), F.col(f"{gp}.required_visual_cues").alias("cues"), F.col("target.sdxl_prompt").alias("prompt"), F.col("target.ranking_caption").alias("caption"), fuzzy.alias("n_fuzzy"))


@query("""
SELECT doc_id, len(errors) = 0 AS ok, errors FROM (SELECT doc_id, CASE doc_id % 5 WHEN 2 THEN ['invalid_visual_strategy:dream_scene'] WHEN 3 THEN ['too_few_required_visual_cues', 'empty_visual_strategy', 'empty_framing', 'empty_abstractness']
WHEN 4 THEN ['too_few_required_visual_cues', 'empty_visual_strategy', 'empty_framing', 'empty_abstractness', 'sdxl_prompt_too_short', 'sdxl_prompt_lacks_synthetic_editorial_style'] ELSE []::VARCHAR[] END AS errors FROM documents)
""")
def validate_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = targets.canonical(_planner_output(spark, sf_dir), "doc_id", "raw", "title")
    return t.select("doc_id", targets.errors(F.col("target")).alias("errors")).select("doc_id", (F.size("errors") == 0).alias("ok"), "errors")


@query()
def stub_generate_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    todo = R.not_done(titles(spark, sf_dir), _done(spark, sf_dir), ["article_id", "image_id"])
    return generate.generate(todo, generate.stub, lambda text: text.endswith("}"))
