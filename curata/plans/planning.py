"""More registered queries: facts, prompts, recovery and generation, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curata.functions import jsonrepair as J
from curata.functions import prompts as P
from curata.functions import text as T
from curata.operators import facts as X
from curata.operators import generation as G
from curata.operators import guards, recovery, targets
from curata.operators import relational as R
from curata.plans.catalog import DOC_TEXT, FACTS, TITLES, documents, facts, query, strings, table, titles

NEGATIVE = targets.DEFAULT_NEGATIVE
PLAN = "struct<image_role:string,required_visual_cues:array<string>,optional_visual_cues:array<string>,forbidden_or_misleading_cues:array<string>,visual_strategy:string,framing:string,abstractness:string>"


def _planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with exported prompts, a student's or a teacher's prompt, or a plan alone, by the document's id."""
    d, none = F.col("doc_id"), F.lit(None)
    p = F.left(T.clean_text(F.col("text")), F.lit(60))
    one = lambda v, s, n: F.struct(F.lit(v).alias("variant"), s.alias("sdxl_prompt"), n.alias("negative_prompt"))
    exported = F.when(d % 4 == 0, F.array(one("main", p, F.lit("")), one("alt ", F.concat(F.col("source"), F.lit("  scene")), F.lit("blur")), one("", F.col("lang"), F.lit(" "))))
    plan = F.struct(F.lit("thumbnail").alias("image_role"), F.array("lang", "source").alias("required_visual_cues"), F.array(F.upper("lang")).alias("optional_visual_cues"), F.when(d % 8 == 3, F.array("lang", F.lit(" "))).alias("forbidden_or_misleading_cues"), F.lit("event_scene").alias("visual_strategy"), F.lit("wide").alias("framing"), F.lit("").alias("abstractness"))
    target = lambda prompt, negative, plan: F.struct(prompt.alias("sdxl_prompt"), negative.alias("negative_prompt"), plan.cast(PLAN).alias("generation_plan"))
    student = F.when(d % 4 == 1, target(p, F.lit("noise"), none))
    teacher = F.when(d % 4 != 0, target(F.when(d % 4 == 2, F.concat(F.lit("teacher "), F.col("source"))).otherwise(""), F.lit(""), F.when(d % 4 == 3, plan)))
    return documents(spark, sf_dir, "text", "lang", "source").select("doc_id", F.concat(F.lit("T "), d.cast("string")).alias("title"), exported.alias("exported"), student.alias("student"), teacher.alias("teacher"))


CANDIDATES = f"""(SELECT * FROM (
SELECT doc_id, unnest([0, 1, 2]) AS pos, unnest(['main', 'alt', 'chosen']) AS variant, unnest([p, source || ' scene', lang]) AS sdxl_prompt, unnest(['{NEGATIVE}', 'blur', '{NEGATIVE}']) AS negative_prompt FROM d WHERE doc_id % 4 = 0
UNION ALL SELECT doc_id, 0, 'raw', p, 'noise' FROM d WHERE doc_id % 4 = 1 AND p <> ''
UNION ALL SELECT doc_id, 0, 'raw', 'teacher ' || source, '{NEGATIVE}' FROM d WHERE doc_id % 4 = 2
UNION ALL SELECT doc_id, 0, 'raw', 'about T ' || doc_id || ', ' || lang || ', ' || source || ', event scene visual strategy, wide', '{NEGATIVE}' || CASE WHEN doc_id % 8 = 3 THEN ', ' || lang ELSE '' END FROM d WHERE doc_id % 4 = 3
) WHERE sdxl_prompt <> '')"""
WITH_D = f"WITH d AS (SELECT doc_id, lang, source, trim(left({DOC_TEXT}, 60)) AS p FROM documents)"


def _prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    col = F.col
    return _planned(spark, sf_dir).select("doc_id", "title", G.prompts_of_row(col("exported"), col("student"), col("teacher"), col("title")).alias("prompts"))


@query(f"{WITH_D} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS pos, variant, sdxl_prompt, negative_prompt FROM {CANDIDATES}")
def collect_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.candidates(_prompts(spark, sf_dir), "prompts", ["doc_id"]).withColumn("pos", F.col("pos").cast("bigint"))


@query(f"{WITH_D}, n AS (SELECT doc_id, count(*) AS n FROM {CANDIDATES} GROUP BY 1) SELECT doc_id::VARCHAR AS article_id, 'T ' || doc_id AS article_title, 'not_exactly_one_usable_prompt' AS reason, coalesce(n, 0)::VARCHAR || ' prompts' AS error, 0 AS sample_index, '' AS candidate_id FROM d LEFT JOIN n USING (doc_id) WHERE coalesce(n, 0) <> 1")
def generation_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.size("prompts")
    rows = _prompts(spark, sf_dir).withColumns({"article_id": F.col("doc_id").cast("string"), "article_title": F.col("title")})
    out = G.failures(rows, F.when(n != 1, "not_exactly_one_usable_prompt"), error=F.concat(n.cast("string"), F.lit(" prompts")))
    return out.select("article_id", "article_title", "reason", "error", "sample_index", "candidate_id")


@query(f"""
{WITH_D}, n AS (SELECT doc_id, count(*) AS n FROM {CANDIDATES} GROUP BY 1), s AS (SELECT CASE WHEN doc_id % 5 = 0 THEN 'skipped' WHEN coalesce(n, 0) <> 1 THEN 'failed' ELSE 'generated' END AS s FROM d LEFT JOIN n USING (doc_id))
SELECT count(*) AS n_input, count_if(s = 'generated')::BIGINT AS n_generated, count_if(s = 'skipped')::BIGINT AS n_skipped, count_if(s = 'failed')::BIGINT AS n_failed, count_if(s = 'failed') = 0 AS complete FROM s
""")
def generation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = lambda: G.submission_name(F.concat(F.lit("t"), F.col("doc_id").cast("string")), "group", "run").alias("path")
    rows = _prompts(spark, sf_dir).select("prompts", path())
    there = documents(spark, sf_dir, "lang").where("doc_id % 5 = 0").select(path())
    return G.summary(G.with_status(rows, there, "path", F.size("prompts") != 1), "status")


@query("SELECT doc_id, CASE WHEN abs(w / h - 460 / 260) <= 0.01 THEN [0, 0, w, h] WHEN w / h > 460 / 260 THEN [floor((w - floor(h * (460 / 260))) / 2), 0, floor((w - floor(h * (460 / 260))) / 2) + floor(h * (460 / 260)), h] ELSE [0, floor((h - floor(w / (460 / 260))) / 2), w, floor((h - floor(w / (460 / 260))) / 2) + floor(w / (460 / 260))] END::INT[] AS box FROM (SELECT doc_id, (n_chars % 1500 + 8)::DOUBLE AS w, (doc_id % 700 + 8)::DOUBLE AS h FROM documents)")
def crop_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir, "n_chars").select("doc_id", G.crop_box(F.col("n_chars") % 1500 + 8, F.col("doc_id") % 700 + 8).alias("b"))
    return rows.select("doc_id", F.array("b.left", "b.top", "b.right", "b.bottom").alias("box"))


#: A record's facts by the document's id: nested, flat, an empty object, or none.
def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, text = F.col("doc_id"), F.left(T.clean_text(F.col("text")), F.lit(80))
    facts = F.struct(
        F.concat(F.lit(" "), text).alias("open_visible_description"), F.array(F.col("lang"), F.lit(" "), F.col("source")).alias("open_objects"), F.concat("lang", F.lit("; ;x")).alias("open_actions"),
        (d % 2 == 0).alias("human_presence"), F.when(d % 3 == 0, "Real Photo").when(d % 3 == 1, "map").otherwise("junk").alias("style_type_vlm"),
        F.array(F.lit("portrait"), F.when(d % 5 == 0, "map based").otherwise("event scene")).alias("visual_role_candidates"), text.alias("visible_text"), F.lit("7").alias("weather"),
    )
    nested = F.to_json(F.struct(F.col("doc_id").cast("string").alias("image_id"), F.struct(facts.alias("parsed_visible_facts")).alias("qwen_visible_facts")))
    made = F.when(d % 4 == 0, nested).when(d % 4 == 1, F.to_json(facts)).when(d % 4 == 2, F.lit('{"image_id":"1","parse":{}}')).otherwise(F.lit('{"image_id":"1","qwen_visible_facts":"none"}'))
    return documents(spark, sf_dir, "text", "lang", "source").select("doc_id", made.alias("record"))


RECORDS = f"(SELECT doc_id, lang, source, trim(left({DOC_TEXT}, 80)) AS t, doc_id % 4 AS k FROM documents)"


@query(f"""
SELECT doc_id, k < 3 AS has_facts, CASE WHEN k < 2 THEN t WHEN k = 2 THEN '' END AS description, CASE WHEN k < 2 THEN [lang, source] WHEN k = 2 THEN [] END AS objects, CASE WHEN k < 2 THEN [lang, 'x'] WHEN k = 2 THEN [] END AS actions,
CASE WHEN k < 3 THEN 'uncertain' END AS scene, CASE WHEN k < 2 THEN doc_id % 2 = 0 END AS human, CASE WHEN k < 2 THEN CASE doc_id % 3 WHEN 0 THEN 'photograph' WHEN 1 THEN 'map' ELSE 'uncertain' END WHEN k = 2 THEN 'uncertain' END AS style,
CASE WHEN k < 2 THEN ['portrait', CASE WHEN doc_id % 5 = 0 THEN 'map_based_representation' ELSE 'event_scene' END] WHEN k = 2 THEN ['uncertain'] END AS roles,
CASE WHEN k = 2 OR (k = 1 AND t = '') THEN 'uncertain' WHEN k < 2 THEN CASE WHEN t = '' THEN 'none' WHEN length(t) <= 30 THEN 'small_amount' ELSE 'large_amount' END END AS seen, CASE WHEN k < 2 THEN t WHEN k = 2 THEN '' END AS content,
CASE WHEN k = 0 THEN 1 WHEN k < 3 THEN 0 END AS n_extras FROM {RECORDS}
""")
def facts_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _records(spark, sf_dir).select("doc_id", X.facts_of(F.col("record")).alias("m")).select("doc_id", X.normalized(F.col("m")).alias("f"))
    x = lambda k, name: F.col(f"f.{k}").alias(name)
    return f.select(
        "doc_id", F.col("f").isNotNull().alias("has_facts"), x("open_visible_description", "description"), x("open_objects", "objects"), x("open_actions", "actions"), x("open_scene", "scene"), x("human_presence", "human"),
        x("style_type_vlm", "style"), x("visual_role_candidates", "roles"), x("visible_text", "seen"), x("visible_text_content", "content"), F.when(F.col("f").isNotNull(), F.size("f.extras")).alias("n_extras"),
    )


@query(f"""
SELECT doc_id, CASE WHEN k < 2 THEN list_concat(CASE WHEN k = 1 AND t = '' THEN ['open_visible_description'] WHEN k = 0 OR t <> '' THEN ['open_visible_description'] END, ['open_objects', 'open_actions', 'human_presence', 'visual_role_candidates', 'style_type_vlm'], CASE WHEN t <> '' THEN ['visible_text'] ELSE [] END) WHEN k = 2 THEN [] END AS kept FROM {RECORDS}
""")
def facts_compressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).select("doc_id", F.map_keys(X.compressed(X.facts_of(F.col("record")))).alias("kept"))


@query(f"""
SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'unreadable' END AS error, CASE WHEN doc_id % 6 <> 0 AND k < 2 THEN lang || '; ' || source WHEN doc_id % 6 <> 0 THEN '' END AS open_objects, CASE WHEN doc_id % 6 <> 0 AND k < 3 THEN 'uncertain' END AS open_scene, CASE WHEN doc_id % 6 <> 0 THEN 0.5 END AS score FROM {RECORDS}
""")
def facts_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _records(spark, sf_dir).select("doc_id", X.normalized(X.facts_of(F.col("record"))).alias("f"), F.when(F.col("doc_id") % 6 == 0, "unreadable").alias("error"), F.lit(0.5).alias("score"))
    return X.flat_rows(f, "f", "error", ["doc_id"], ["score"]).select("doc_id", "error", "open_objects", "open_scene", "score")


@query("""
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN [lang, source] WHEN 1 THEN [lang] WHEN 2 THEN [source, lang] ELSE [] END AS texts, CASE doc_id % 4 WHEN 0 THEN ['place', 'person'] WHEN 2 THEN ['org'] ELSE [] END AS roles FROM documents
""")
def entities_and_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    ent = lambda t, **more: F.struct(t.alias("text"), *(F.lit(v).alias(k) for k, v in more.items()))
    both = F.to_json(F.array(ent(F.col("lang"), role_in_title=" place", role="x"), ent(F.concat("source", F.lit(" ")), role_in_title="", role="person")))
    mixed = F.concat(F.lit("["), F.to_json(ent(F.col("source"), role="org")), F.lit(',"'), F.col("lang"), F.lit('"," ",{"role":""}]'))
    raw = F.when(F.col("doc_id") % 4 == 0, both).when(F.col("doc_id") % 4 == 1, F.col("lang")).when(F.col("doc_id") % 4 == 2, mixed).otherwise("[]")
    e = documents(spark, sf_dir, "lang", "source").select("doc_id", T.entities(raw).alias("e"))
    return e.select("doc_id", "e.texts", "e.roles")


SYSTEM, INSTRUCTION, TEACHER = "You plan.", 'Plan an image for "{title}". Answer as JSON: {"a": 1}', "Title: {title}\nFacts: {facts}"


@query(f"""
SELECT article_id, 'Plan an image for "' || article_title || '". Answer as JSON: {{"a": 1}}' AS student, 'Title: ' || article_title || chr(10) || 'Facts: ' || CASE WHEN page_id % 3 = 0 THEN 'null' ELSE '{{"id":"' || image_id || '"}}' END AS teacher, left(article_title, 12) AS again FROM {TITLES}
""")
def model_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.col("article_title")
    facts = F.when(F.col("page_id") % 3 != 0, F.struct(F.col("image_id").alias("id")))
    said = lambda m: F.get(m, 1)["content"]
    return titles(spark, sf_dir).select("article_id", said(P.student_messages(SYSTEM, INSTRUCTION, title)).alias("student"), said(P.teacher_messages(SYSTEM, TEACHER, title, facts)).alias("teacher"), P.retry_context(title, 12).alias("again"))


@query(f"""
SELECT article_id, article_title AS headline, [article_title] AS cues, array_to_string(string_split(trim(regexp_replace(translate(article_title, '{{}}[]|"' || chr(39), ''), '\\s+', ' ', 'g'), ' ,.;:'), ' ')[1:18], ' ') || '{T.FALLBACK_TAIL}' AS prompt, '{NEGATIVE}' AS negative_prompt,
'about ' || article_title || ', ' || image_id || ', other visual strategy' AS plan_prompt, article_title || ': ' || image_id AS plan_caption FROM {TITLES}
""")
def fallback_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.col("article_title")
    made = titles(spark, sf_dir).select("article_id", "article_title", "image_id", recovery.title_fallback(title).alias("t"))
    own = F.col("t").withField("generation_plan", F.col("t.generation_plan").withField("required_visual_cues", F.array("image_id")).withField("framing", F.lit("")).withField("abstractness", F.lit(""))).withField("ranking_caption", F.lit(" "))
    full = made.select("*", recovery.plan_fallback(own, title, [], []).alias("p"))
    return full.select("article_id", F.col("t.title_understanding.headline_core").alias("headline"), F.col("t.generation_plan.required_visual_cues").alias("cues"), F.col("t.sdxl_prompt").alias("prompt"), F.col("p.negative_prompt").alias("negative_prompt"), F.col("p.sdxl_prompt").alias("plan_prompt"), F.col("p.ranking_caption").alias("plan_caption"))


@query(f"""
SELECT doc_id, t <> '' AS positive, t <> '' AND doc_id % 2 = 0 AS usable, CASE WHEN doc_id % 7 = 0 THEN ['json_parse_failed'] ELSE list_concat(CASE WHEN t = '' THEN ['missing_sdxl_prompt'] ELSE [] END, CASE WHEN doc_id % 2 = 1 THEN ['missing_negative_prompt'] ELSE [] END) END AS errors,
CASE WHEN t = '' OR doc_id % 2 = 1 THEN 'failed_no_prompt' WHEN doc_id % 3 = 0 THEN 'model_written_sdxl_prompt' WHEN doc_id % 3 = 1 THEN 'plan_based_fallback' ELSE 'title_template_fallback' END AS recovery FROM (SELECT doc_id, {DOC_TEXT} AS t FROM documents)
""")
def recovery_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    target = F.struct(F.col("text").alias("sdxl_prompt"), F.when(d % 2 == 0, "blur").otherwise(" ").alias("negative_prompt"))
    notes = F.when(d % 3 == 0, F.array().cast("array<string>")).when(d % 3 == 1, strings("plan_based_fallback", "x")).otherwise(strings("title_template_fallback"))
    rows = documents(spark, sf_dir).select("doc_id", target.alias("t"), notes.alias("n"))
    written = T.clean_text(F.col("t.sdxl_prompt")) != ""
    return rows.select("doc_id", written.alias("positive"), recovery.has_usable_prompt(F.col("t")).alias("usable"), recovery.final_errors(F.col("t"), d % 7 != 0).alias("errors"), recovery.recovery_type(F.col("t"), F.col("n"), written).alias("recovery"))


@query(f"""
WITH t AS (SELECT article_id, article_title AS t, regexp_extract_all(lower(article_title), '[\\p{{L}}\\p{{N}}_]+') AS w, regexp_extract_all(lower(article_title), '[a-zA-Z][a-zA-Z0-9_-]*') AS a FROM {TITLES}),
g AS (SELECT article_id, max(n) AS n FROM (SELECT article_id, g, count(*) AS n FROM (SELECT article_id, unnest(list_transform(range(1, len(a) - 1), lambda i: a[i] || ' ' || a[i + 1] || ' ' || a[i + 2])) AS g FROM t WHERE len(a) >= 9) GROUP BY ALL) GROUP BY 1)
SELECT article_id, length(t) >= 30 AND NOT regexp_matches(t, 'aaaaaaaaaaaaa') AND len(list_filter(range(1, len(w) - 2), lambda i: w[i] = w[i + 1] AND w[i] = w[i + 2] AND w[i] = w[i + 3])) = 0 AND coalesce(g.n, 0) < 3 AS usable FROM t LEFT JOIN g USING (article_id)
""")
def usable_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return titles(spark, sf_dir).select("article_id", recovery.is_usable_text(F.col("article_title"), 30).alias("usable"))


@query("SELECT count(*) AS n_rows, round(avg(n), 1) AS avg_supervised, min(n) AS min_supervised, max(n) AS max_supervised FROM (SELECT length(text) AS n FROM conversations WHERE role = 'assistant' ORDER BY conv_id, turn LIMIT 50)")
def token_sanity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant'").select(F.struct("conv_id", "turn").alias("at"), F.length("text").cast("bigint").alias("n"))
    return guards.token_sanity(rows, "at", "n")


@query("SELECT 'run/checkpoint-' || max(doc_id) AS path, max(doc_id) AS step FROM documents WHERE doc_id % 3 = 0")
def latest_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.when(F.col("doc_id") % 3 == 0, "run/checkpoint-").otherwise("run/final-"), F.col("doc_id").cast("string"))
    return guards.latest_checkpoint(documents(spark, sf_dir, "lang").select(name.alias("folder")), "folder")


@query("""
SELECT doc_id, CASE WHEN k = 6 THEN NULL ELSE doc_id::VARCHAR END AS id, CASE k WHEN 0 THEN [] WHEN 1 THEN ['json_extract:removed_markdown_fence'] WHEN 2 THEN ['json_extract:object_substring'] WHEN 3 THEN ['json_repair:unwrapped_singleton_list_if_needed']
WHEN 4 THEN ['json_repair:trailing_commas'] WHEN 5 THEN ['json_repair:strip_comments', 'json_repair:trailing_commas'] ELSE ['json_parse:failed_after_repairs'] END AS notes, k < 4 AS any_json
FROM (SELECT doc_id, CASE WHEN doc_id % 8 = 7 THEN 6 ELSE doc_id % 8 END AS k FROM documents)
""")
def json_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = [('{"id":"', '"}'), ('```json\n{"id":"', '"}\n```'), ('Sure: {"id":"', '"} done'), ('[{"id":"', '"}]'), ('{"id":"', '",}'), ('{"id":"', '", // the id\n}'), ('{"id":"', '"'), ("no json ", "")]
    made = F.element_at(F.array(*(F.concat(F.lit(a), F.col("doc_id").cast("string"), F.lit(b)) for a, b in forms)), (F.col("doc_id") % len(forms) + 1).cast("int"))
    rows = documents(spark, sf_dir, "lang").select("doc_id", made.alias("raw"))
    got = rows.select("doc_id", J.parse_with_notes(F.col("raw")).alias("p"), J.any_json(F.col("raw")).alias("j"))
    return got.select("doc_id", F.try_element_at("p.object", F.lit("id")).alias("id"), "p.notes", F.col("j.parsed_ok").alias("any_json"))


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS row_idx FROM documents")
def row_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file's rows stand by ascending doc_id."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "_metadata")
    return R.with_row_index(rows, first=1).select("doc_id", "row_idx")


@query(f"SELECT image_id, min(doc_id) AS first_idx, arg_max(source || ' ' || lang, doc_id) AS facts FROM {FACTS} GROUP BY image_id ORDER BY first_idx LIMIT 20")
def inspect_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.first_keyed(facts(spark, sf_dir), "image_id", "doc_id", F.concat_ws(" ", "source", "lang"), 20)
    return found.select("image_id", "first_idx", F.col("value").alias("facts"))


@query(f"SELECT article_id, list_transform(list_filter(list_zip(w, range(len(w))), lambda x: list_position(w, x[1]) = x[2] + 1), lambda x: x[1]) AS words FROM (SELECT article_id, string_split(article_title, ' ') AS w FROM {TITLES})")
def distinct_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return titles(spark, sf_dir).select("article_id", F.array_distinct(F.split("article_title", " ")).alias("words"))
