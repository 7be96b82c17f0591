import json

import pytest
from pyspark.sql import functions as F

from curata.functions import jsonrepair as J
from curata.functions import keys as K
from curata.functions import labels as L
from curata.functions import prompts as P
from curata.operators import facts as X
from curata.operators import generation as G
from curata.operators import guards, recovery, targets
from curata.operators import relational as R


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_notes_of_keys_follow_the_entries(spark):
    raw = [("many", '{"sdxl_prompt": "a b", "SDXL Prompt": "c", "prompt": "d", "caption": "", "ranking_caption": "e", "weather": 1}'), ("empty_first", '{"prompt": "", "SDXL Prompt": "c"}')]
    df = spark.createDataFrame(raw, "id string, raw string").select("id", F.from_json("raw", "map<string,string>").alias("o"))
    got = {r.id: r for r in targets.with_mapped(df, "o", K.TOP_KEYS, "top", "f").collect()}
    assert got["many"].f == {"sdxl_prompt": "a b", "ranking_caption": "e"}
    assert got["many"].f_notes == ["duplicate_mapped_key_ignored:top:SDXL Prompt->sdxl_prompt", "duplicate_mapped_key_ignored:top:prompt->sdxl_prompt", "fuzzy_key:top:caption->ranking_caption", "unmapped_key:top:weather"]
    assert got["empty_first"].f == {"sdxl_prompt": "c"} and got["empty_first"].f_notes == ["fuzzy_key:top:prompt->sdxl_prompt", "fuzzy_key:top:SDXL Prompt->sdxl_prompt"]
    heavy = {r.id: r.h for r in targets.with_mapped(df, "o", K.TOP_KEYS, "top", "f").select("id", targets.is_heavy(F.col("f_notes")).alias("h")).collect()}
    assert heavy == {"many": True, "empty_first": False}


def test_canonical_takes_roles_and_old_names(spark):
    tu = {"named_entities": [{"text": " Ada ", "role_in_title": "engineer"}, "Rome", {"text": ""}], "causal_or_logical_relation": "a causes b", "what_is_not_the_point": ["noise"]}
    df = spark.createDataFrame([(1, json.dumps({"title_understanding": tu}), "T")], "id long, raw string, title string")
    t = targets.canonical(df, "id", "raw", "title").first().target.title_understanding
    assert (t.named_entities, t.entity_roles, t.relation, t.what_should_not_be_emphasized) == (["Ada", "Rome"], ["engineer"], "a causes b", ["noise"])


def test_label_quotes_and_comments(spark):
    text = '{"a": "large screen with "LIVE" text", "b": ["company", ""event"]}'
    fixed = one(spark, J.join_label_quotes(F.lit('{"b": ["For Sale" sign", ""event"]}')))
    assert fixed == '{"b": ["For Sale sign", "event"]}' and text
    assert one(spark, J.strip_line_comments(F.lit('{\n // gone\n"u": "http://x", // stays\n"a": 1, // cut \n}'))) == '{\n"u": "http://x", // stays\n"a": 1,\n}'
    assert one(spark, J.drop_extra_quote(F.lit('{"a": "b"", "c": "d"}'))) == '{"a": "b", "c": "d"}'
    assert one(spark, J.drop_extra_quote(F.lit('{"a": """, "c": ["x"", "y"]}'))) == '{"a": "", "c": ["x", "y"]}'
    assert one(spark, J.drop_extra_quote(F.lit('{"a": "", "c": ""}'))) == '{"a": "", "c": ""}'


def test_any_json(spark):
    got = lambda x: tuple(one(spark, J.any_json(F.lit(x))))
    assert got("[1,2]") == (True, "[1,2]") and got('```json\n{"a":1}\n```') == (True, '{"a":1}') and got('so {"a":1} it is') == (True, '{"a":1}')
    assert got("none") == (False, None) and got("") == (False, None) and got(None) == (False, None)


def test_no_facts_score_nothing(spark):
    r = one(spark, L.reliability(F.lit("person"), F.array(F.lit("portrait")), F.lit("collage"), F.lit("map"), F.lit("a long text here"), F.lit(None).isNotNull()))
    assert (r.score, r.usage) == (0.0, "ignore")
    assert one(spark, X.normalized(X.facts_of(F.lit('{"image_id": "1"}')))) is None
    assert one(spark, X.facts_of(F.lit('{"parsed": 1, "open_scene": "", "coarse_tone": "tense"}'))) == {"coarse_tone": "tense"}


def test_first_of_null_keys_and_ties(spark):
    df = spark.createDataFrame([(None, 1, "a"), (None, 2, "b"), ("k", 5, "c"), ("k", 5, "d")], "key string, at long, v string")
    got = R.split_first(df, "key", "at").collect()
    assert len(got) == 4 and sum(r.is_first for r in got if r.key is None) == 1 and sum(r.is_first for r in got if r.key == "k") == 1


def test_prompts_of_row(spark):
    plan = F.lit(None).cast("struct<image_role:string,required_visual_cues:array<string>,optional_visual_cues:array<string>,forbidden_or_misleading_cues:array<string>,visual_strategy:string,framing:string,abstractness:string>")
    target = F.struct(F.lit(" x ").alias("sdxl_prompt"), F.lit("").alias("negative_prompt"), plan.alias("generation_plan"))
    none = F.lit(None).cast(G.PROMPT)
    got = lambda **k: [tuple(r) for r in one(spark, G.prompts_of_row(none, target, target, F.lit("t"), **k))]
    assert got() == [("raw", "x", targets.DEFAULT_NEGATIVE)] and got(source="student", synthesise=False) == [("student", "x", "")]
    assert got(mode="exported") == [] and got(variants=["main"]) == []


def test_crop_box(spark):
    assert tuple(one(spark, G.crop_box(F.lit(460), F.lit(260)))) == (0, 0, 460, 260)
    assert tuple(one(spark, G.crop_box(F.lit(1000), F.lit(260)))) == (270, 0, 730, 260)
    assert tuple(one(spark, G.crop_box(F.lit(460), F.lit(500)))) == (0, 120, 460, 380)


def test_model_flags_and_recovery(spark):
    long = "flat vector editorial illustration of a harbour, no readable text"
    rows = [("good", long, "blur, noise, text", "core", ["cue"], "other", "wide", "literal"), ("plan", "short", "x", "core", ["cue", "b"], "other", "wide", "literal"), ("none", "word word word word " * 9, "", "", [], "", "", "")]
    df = spark.createDataFrame(rows, "id string, p string, n string, h string, cues array<string>, s string, f string, a string")
    none = F.array().cast("array<string>")
    tu = F.struct(F.col("h").alias("headline_core"), none.alias("named_entities"), none.alias("entity_roles"), F.lit("").alias("main_event_or_issue"), F.lit("").alias("implied_context"), F.lit("").alias("relation"), none.alias("visual_risks"), none.alias("what_should_not_be_emphasized"))
    gp = F.struct(F.lit("").alias("image_role"), F.col("cues").alias("required_visual_cues"), none.alias("optional_visual_cues"), none.alias("forbidden_or_misleading_cues"), F.col("s").alias("visual_strategy"), F.col("f").alias("framing"), F.col("a").alias("abstractness"))
    t = F.struct(tu.alias("title_understanding"), gp.alias("generation_plan"), F.col("p").alias("sdxl_prompt"), F.col("n").alias("negative_prompt"), F.lit("").alias("ranking_caption"))
    made = df.select("id", t.alias("t")).select("id", recovery.model_flags(F.col("t")).alias("f"), recovery.recovered(F.col("t"), F.lit("T"), ["head"], ["tail"]).alias("r"))
    got = {r.id: r for r in made.select("*", recovery.recovery_type(F.col("r.target"), F.col("r.notes"), F.col("f.model_written_sdxl_prompt_ok")).alias("k")).collect()}
    assert [tuple(got[k].f) for k in ("good", "plan", "none")] == [(True,) * 5, (False, False, True, True, False), (False,) * 5]
    assert [got[k].k for k in ("good", "plan", "none")] == ["model_written_sdxl_prompt", "plan_based_fallback", "title_template_fallback"]
    assert got["plan"].r.target.sdxl_prompt == "head, about T, cue, b, other visual strategy, literal composition, wide, tail" and got["plan"].r.target.ranking_caption == "T: cue, b"


def test_guards(spark):
    guards.check_resume({"a": 1}, {"a": 1}, ["a"])
    with pytest.raises(ValueError, match="a: 1 then, 2 now; b"):
        guards.check_resume({"a": 2, "b": 1}, {"a": 1}, ["a", "b"])
    guards.check_generation(920, 520, names=("g", "h"))
    with pytest.raises(ValueError, match="width.*names.*sequence.*offloads"):
        guards.check_generation(921, 520, names=(" ",), sequence=300, offloads=2)
    folders = spark.createDataFrame([("x/checkpoint-9",), ("x/checkpoint-10/",), ("x/final",)], "p string")
    assert tuple(guards.latest_checkpoint(folders, "p").first()) == ("x/checkpoint-10/", 10)
    assert guards.latest_checkpoint(folders.limit(0), "p").count() == 0
    rows = spark.createDataFrame([("generated",), ("failed",)], "status string")
    with pytest.raises(ValueError, match="1 outputs for 2"):
        G.require_complete(rows, "status")
    assert not G.require_complete(rows, "status", True).first().complete


def test_messages(spark):
    m = one(spark, P.teacher_messages("s", "{title} {x} {facts}", F.lit(" a{facts} "), F.lit(None).cast("struct<a:int>")))
    assert [(x.role, x.content) for x in m] == [("system", "s"), ("user", "a{facts} {x} null")]
    assert P.taxonomy_prompt("one of {tones}", {"tones": ["a", "b"]}) == "one of a|b"
    assert one(spark, P.retry_context(F.lit("x" * 5000))) == "x" * 4000


def test_outputs(spark, tmp_path):
    f = spark.createDataFrame([("1", '{"open_objects": ["a", "b"]}', None), ("2", None, "bad")], "image_id string, raw string, error string").select("image_id", "error", X.normalized(X.facts_of(F.col("raw"))).alias("f"))
    flat = X.flat_rows(f, "f", "error", ["image_id"])
    X.write_outputs(f, flat, f.groupBy("error").count(), f"file://{tmp_path}")
    back = {r.image_id: r for r in spark.read.option("header", True).csv(f"file://{tmp_path}/flat").collect()}
    assert back["1"].open_objects == "a; b" and back["2"].open_objects is None and back["2"].error == "bad"
    assert spark.read.json(f"file://{tmp_path}/records").count() == 2
