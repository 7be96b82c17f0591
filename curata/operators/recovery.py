"""What a model wrote itself, and the plans that stand in for it where that isn't usable."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from curata.functions import text as T
from curata.operators.relational import codes
from curata.operators.targets import DEFAULT_NEGATIVE, _copied

#: Least lengths, and what the title's stand-in plan says.
LEAST_PROMPT, LEAST_NEGATIVE = 30, 10
TITLE_CONTEXT = "title-only deterministic fallback"
TITLE_RISKS = ["readable text", "exact logos", "realistic face"]
TITLE_NOT_EMPHASIZED = ["unsupported details", "readable text", "exact logos"]
TITLE_ROLE = "editorial illustration for a news thumbnail"
TITLE_FORBIDDEN = ["readable text", "exact logos", "realistic public-figure likeness"]
TITLE_FRAMING = "centered clearly synthetic news/editorial image composition"
NO_CUES = "title-grounded editorial scene"
PLAN_NOTES = ["force_synthesized_sdxl_prompt_from_qwen_generation_plan", "filled_negative_prompt_with_baseline_template_negative"]


def _list(xs: list[str]) -> Column:
    return F.array(*map(F.lit, xs)).cast("array<string>")


def is_usable_text(x: Column, least: int) -> Column:
    """Long enough, without runs and repeated word triples, and no copy of the schema's placeholders."""
    s = T.clean_text(x)
    return (F.length(s) >= least) & ~T.has_char_run(s) & ~T.has_word_run(s) & ~T.has_token_repetition(s) & ~_copied(s)


def model_flags(target: Column) -> Column:
    """struct of five flags on what the model wrote; a null target has none."""
    tu, gp = target["title_understanding"], target["generation_plan"]
    some = lambda x: F.coalesce(T.clean_text(x), F.lit("")) != ""
    cues = F.filter(F.coalesce(gp["required_visual_cues"], _list([])), lambda c: T.clean_text(c) != "")
    positive, negative = is_usable_text(target["sdxl_prompt"], LEAST_PROMPT), is_usable_text(target["negative_prompt"], LEAST_NEGATIVE)
    understood = tu.isNotNull() & ~F.coalesce(_copied(F.to_json(tu), True), F.lit(False)) & (some(tu["headline_core"]) | some(tu["main_event_or_issue"]))
    planned = gp.isNotNull() & ~F.coalesce(_copied(F.to_json(gp), True), F.lit(False)) & (F.size(cues) > 0) & some(gp["visual_strategy"]) & some(gp["framing"]) & some(gp["abstractness"])
    flags = {"model_written_sdxl_prompt_ok": positive, "model_written_negative_prompt_ok": negative, "model_title_understanding_ok": understood, "model_generation_plan_ok": planned, "model_plan_and_prompt_ok": positive & understood & planned}
    return F.struct(*(F.coalesce(target.isNotNull() & v, F.lit(False)).alias(k) for k, v in flags.items()))


def has_usable_prompt(target: Column) -> Column:
    """Both prompts have text."""
    return F.coalesce(target.isNotNull() & (T.clean_text(target["sdxl_prompt"]) != "") & (T.clean_text(target["negative_prompt"]) != ""), F.lit(False))


def final_errors(target: Column, parsed: Column) -> Column:
    """Codes of what a final plan lacks: only whether it was parsed, is an object, and has both prompts."""
    missing = codes([(f"missing_{k}", T.clean_text(target[k]) == "") for k in ("sdxl_prompt", "negative_prompt")])
    return F.when(~parsed, _list(["json_parse_failed"])).when(target.isNull(), _list(["target_not_dict"])).otherwise(missing)


def visual_plan(target: Column, *names: str) -> Column:
    """The first of the plans under these names that is there."""
    return F.coalesce(*(target[n] for n in names or ("generation_plan", "visual_plan")))


def postprocessed(target: Column, most: int = 24) -> Column:
    """Clean texts and cue lists; a negative prompt of at most `most` distinct phrases. Adds nothing."""
    clean = lambda a: F.filter(F.transform(a, T.clean_text), lambda x: x != "")
    gp = target["generation_plan"]
    for k in ("required_visual_cues", "optional_visual_cues", "forbidden_or_misleading_cues"):
        gp = gp.withField(k, clean(gp[k]))
    out = target.withField("generation_plan", gp)
    for k in ("sdxl_prompt", "ranking_caption"):
        out = out.withField(k, T.clean_text(target[k]))
    return out.withField("negative_prompt", T.dedupe_comma_phrases(target["negative_prompt"], most))


def title_fallback(title: Column) -> Column:
    """A plan made from the title alone."""
    tu = F.struct(title.alias("headline_core"), _list([]).alias("named_entities"), _list([]).alias("entity_roles"), title.alias("main_event_or_issue"), F.lit(TITLE_CONTEXT).alias("implied_context"), F.lit("").alias("relation"), _list(TITLE_RISKS).alias("visual_risks"), _list(TITLE_NOT_EMPHASIZED).alias("what_should_not_be_emphasized"))
    gp = F.struct(F.lit(TITLE_ROLE).alias("image_role"), F.array(title).alias("required_visual_cues"), _list([]).alias("optional_visual_cues"), _list(TITLE_FORBIDDEN).alias("forbidden_or_misleading_cues"), F.lit("other").alias("visual_strategy"), F.lit(TITLE_FRAMING).alias("framing"), F.lit("other").alias("abstractness"))
    return F.struct(tu.alias("title_understanding"), gp.alias("generation_plan"), T.fallback_prompt(title).alias("sdxl_prompt"), F.lit(DEFAULT_NEGATIVE).alias("negative_prompt"), title.alias("ranking_caption"))


def plan_fallback(target: Column, title: Column, head: list[str], tail: list[str]) -> Column:
    """The model's plan with a prompt rebuilt from it, the default negative prompt, and a caption where it has none."""
    gp = target["generation_plan"]
    cues = F.filter(F.transform(gp["required_visual_cues"], T.clean_text), lambda x: x != "")
    prompt = T.plan_prompt(title, gp["required_visual_cues"], gp["optional_visual_cues"], gp["visual_strategy"], gp["framing"], gp["abstractness"], head, tail)
    caption = F.concat(title, F.lit(": "), F.when(F.size(cues) > 0, F.array_join(F.slice(cues, 1, 3), ", ")).otherwise(NO_CUES))
    own = T.clean_text(target["ranking_caption"])
    return target.withField("sdxl_prompt", prompt).withField("negative_prompt", F.lit(DEFAULT_NEGATIVE)).withField("ranking_caption", F.when(own == "", caption).otherwise(own))


def recovered(target: Column, title: Column, head: list[str], tail: list[str]) -> Column:
    """struct<target, notes>: the target where the model wrote a usable prompt, else its plan's stand-in, else the title's."""
    f = model_flags(target)
    return (
        F.when(f["model_written_sdxl_prompt_ok"], F.struct(target.alias("target"), _list([]).alias("notes")))
        .when(f["model_generation_plan_ok"], F.struct(plan_fallback(target, title, head, tail).alias("target"), _list(["plan_based_fallback", *PLAN_NOTES]).alias("notes")))
        .otherwise(F.struct(title_fallback(title).alias("target"), _list(["title_template_fallback"]).alias("notes")))
    )


def recovery_type(target: Column, notes: Column, written: Column) -> Column:
    """How the final prompt came about."""
    fallback = F.exists(notes, lambda n: F.contains(n, F.lit("fallback")) | F.contains(n, F.lit("synthesized_missing_sdxl_prompt")))
    planned = F.exists(notes, lambda n: F.contains(n, F.lit("plan_based_fallback")))
    usable = has_usable_prompt(target)
    return F.when(written & usable & ~fallback, "model_written_sdxl_prompt").when(fallback & usable & planned, "plan_based_fallback").when(fallback & usable, "title_template_fallback").otherwise("failed_no_prompt")
