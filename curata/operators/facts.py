"""Visible facts of an image: found in a record, normalised, compressed, and flattened for a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.functions import labels as L

#: The keys of facts, in order, and where records keep them.
FACT_KEYS = [
    "open_visible_description", "open_objects", "open_actions", "open_scene", "human_presence", "person_count_estimate", "face_visibility",
    "main_subject_type", "visual_role_candidates", "composition_type", "style_type_vlm", "coarse_tone", "visible_text", "visible_text_content",
    "logo_or_watermark_visible", "requires_title_context", "uncertainty_notes", "visual_evidence_reliability", "image_anchor_usage",
]
NESTED = ["$.qwen_visible_facts.parsed_visible_facts", "$.qwen_visible_facts.visible_facts", "$.qwen_visible_facts.parsed", "$.parsed_visible_facts", "$.visible_facts", "$.parse"]
EMPTY = ["", "[]", "{}"]
MAP = "map<string,string>"


def _full(v: Column) -> Column:
    return v.isNotNull() & ~v.isin(EMPTY)


def facts_of(record: Column) -> Column:
    """map<string, string> out of a record's JSON: the first object, even an empty one, of the places in NESTED, else the
    record's own non-empty facts, or null if it has no key of facts."""
    nested = [F.get_json_object(record, path) for path in NESTED]
    first = F.coalesce(*(F.when(F.trim(x).startswith("{"), x) for x in nested))
    own = F.from_json(record, MAP)
    flat = F.when(F.arrays_overlap(F.map_keys(own), F.array(*map(F.lit, FACT_KEYS))), F.map_filter(own, lambda k, v: k.isin(FACT_KEYS) & _full(v)))
    return F.coalesce(F.from_json(first, MAP), flat)


def compressed(facts: Column) -> Column:
    """The known keys in their fixed order, without null and empty values."""
    lines = F.transform(F.array(*map(F.lit, FACT_KEYS)), lambda k: F.struct(k.alias("key"), F.try_element_at(facts, k).alias("value")))
    return F.when(facts.isNotNull(), F.map_from_entries(F.filter(lines, lambda e: _full(e["value"]))))


def items(x: Column) -> Column:
    """A JSON array's non-empty elements, or a text's parts between semicolons, else commas."""
    some = F.filter(F.transform(F.from_json(x, "array<string>"), lambda i: F.trim(i)), lambda i: i != "")
    return F.when(F.trim(x).startswith("["), F.coalesce(some, F.array().cast("array<string>"))).otherwise(L.normalize_open_list(x))


def normalized(facts: Column) -> Column:
    """struct of the 17 normalised facts and `extras`, the map of all other keys; null stays null. The title is always
    required as context."""
    get = lambda k: F.try_element_at(facts, F.lit(k))
    text = lambda k, default="": F.trim(F.coalesce(get(k), F.lit(default)))
    label = lambda k, allowed: L.normalize_label(get(k), allowed)
    roles = get("visual_role_candidates")
    roles = F.when(F.trim(roles).startswith("["), F.array_join(F.from_json(roles, "array<string>"), "|")).otherwise(roles)
    scene, seen, content = text("open_scene", "uncertain"), L.visible_text(get("visible_text")), text("visible_text_content")
    own = {
        "open_visible_description": text("open_visible_description"),
        "open_objects": items(get("open_objects")),
        "open_actions": items(get("open_actions")),
        "open_scene": F.when(scene == "", "uncertain").otherwise(scene),
        "human_presence": L.normalize_bool(get("human_presence")),
        "person_count_estimate": label("person_count_estimate", L.PERSON_COUNT_LABELS),
        "face_visibility": label("face_visibility", L.FACE_VISIBILITY_LABELS),
        "main_subject_type": label("main_subject_type", L.MAIN_SUBJECT_TYPES),
        "visual_role_candidates": L.normalize_label_list(roles, L.VISUAL_ROLES),
        "composition_type": label("composition_type", L.COMPOSITION_TYPES),
        "style_type_vlm": label("style_type_vlm", L.STYLE_TYPES),
        "coarse_tone": label("coarse_tone", L.COARSE_TONES),
        "visible_text": seen["label"],
        "visible_text_content": F.when(content != "", content).otherwise(seen["content"]),
        "logo_or_watermark_visible": label("logo_or_watermark_visible", L.YES_NO_UNCERTAIN),
        "requires_title_context": F.lit(True),
        "uncertainty_notes": text("uncertainty_notes"),
    }
    extras = F.map_filter(facts, lambda k, _: ~k.isin(list(own)))
    return F.when(facts.isNotNull(), F.struct(*(v.alias(k) for k, v in own.items()), extras.alias("extras")))


#: Columns of the flat table that hold lists.
LISTS = ["open_objects", "open_actions", "visual_role_candidates"]


def flat_rows(df: DataFrame, facts: str, error: str, first: list[str], last: list[str] = ()) -> DataFrame:
    """A row of plain values for each record: `first`, the facts with lists joined by semicolons, `last`. A record with an
    error has `first` and the error alone."""
    ok = F.coalesce(F.col(error), F.lit("")) == ""
    names = [f.name for f in df.schema[facts].dataType.fields if f.name not in ("extras", "requires_title_context")]
    value = lambda k: F.coalesce(F.array_join(f"{facts}.{k}", "; "), F.lit("")) if k in LISTS else F.col(f"{facts}.{k}")
    return df.select(*first, error, *(F.when(ok, value(k)).alias(k) for k in names), *(F.when(ok, F.col(k)).alias(k) for k in last))


def write_outputs(df: DataFrame, flat: DataFrame, summary: DataFrame, folder: str) -> None:
    """All records as JSON lines, the flat table as CSV with a header, and the summary, each anew from the whole input."""
    df.write.mode("overwrite").json(f"{folder}/records")
    flat.write.mode("overwrite").option("header", True).csv(f"{folder}/flat")
    summary.write.mode("overwrite").json(f"{folder}/summary")
