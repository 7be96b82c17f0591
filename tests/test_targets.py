import json

import pytest
from pyspark.sql import functions as F

from curata.operators import targets


def plan(**changed):
    gp = {"image_role": "thumbnail", "required_visual_cues": ["cue a", "cue b"], "visual_strategy": "event_scene", "framing": "wide view", "abstractness": "literal"}
    top = {"headline_core": "core", "sdxl_prompt": "flat vector editorial illustration of an event, no readable text", "ranking_caption": "a caption"}
    for k, v in changed.items():
        (top if k in top else gp)[k] = v
    return json.dumps({"title_understanding": {"headline_core": top["headline_core"]}, "generation_plan": gp, "sdxl_prompt": top["sdxl_prompt"], "ranking_caption": top["ranking_caption"]})


PLANS = {
    "sound": plan(),
    "copied_cue": plan(required_visual_cues=["2-5 title-supported concrete semantic cues", "cue b"]),
    "copied_optional": plan(optional_visual_cues=["0-4 broad safe title-compatible cues"]),
    "changed_word": plan(ranking_caption="one concise plain-language captions"),
    "changed_part": plan(sdxl_prompt="flat vector editorial illustration of an event; short composition/framing description"),
    "near_values": plan(visual_strategy="event scene", abstractness="Symbolik"),
    "cut_value": plan(visual_strategy="Symbolic Edito"),
    "alien_value": plan(visual_strategy="dream_scene"),
}


@pytest.fixture(scope="module")
def judged(spark):
    df = spark.createDataFrame([(k, v, "A title") for k, v in PLANS.items()], "id string, raw string, title string")
    t = targets.canonical(df, "id", "raw", "title")
    return {r.id: r for r in t.select("id", "target", "notes", targets.errors(F.col("target")).alias("errors")).collect()}


def test_copies_of_placeholders_are_errors(judged):
    assert judged["sound"].errors == []
    assert judged["copied_cue"].errors == judged["copied_optional"].errors == ["generation_plan_looks_like_schema_copy"]
    assert judged["changed_word"].errors == ["ranking_caption_looks_like_schema_copy"]
    assert judged["changed_part"].errors == ["sdxl_prompt_looks_like_schema_copy"]


def test_near_values_are_mapped(judged):
    fuzzy = lambda k: [n for n in judged[k].notes if n.startswith("fuzzy_value:")]
    gp = lambda k: judged[k].target.generation_plan
    assert (gp("near_values").visual_strategy, gp("near_values").abstractness, judged["near_values"].errors) == ("event_scene", "symbolic", [])
    assert fuzzy("near_values") == ["fuzzy_value:generation_plan.visual_strategy:event scene->event_scene", "fuzzy_value:generation_plan.abstractness:Symbolik->symbolic"]
    assert gp("cut_value").visual_strategy == "symbolic_editorial" and judged["cut_value"].errors == []
    assert judged["alien_value"].errors == ["invalid_visual_strategy:dream_scene"] and fuzzy("sound") == fuzzy("alien_value") == []


def test_all_placeholders_are_known():
    assert len(targets.PLACEHOLDERS) == 21 and all(targets.looks_copied(p) for p in targets.PLACEHOLDERS)
    assert not targets.looks_copied("") and not targets.looks_copied(None) and not targets.looks_copied("a plain text, with parts; of no note")
