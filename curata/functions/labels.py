"""Labels of a closed vocabulary from free text, and the reliability of visible facts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from curata.functions.text import canonical_label

#: The vocabularies of labels.
STYLE_TYPES = ["photograph", "stock_photograph", "non_photorealistic_illustration", "editorial_cartoon", "infographic", "map", "chart", "screenshot", "document", "collage", "poster_or_logo", "mixed_style", "other", "uncertain"]
MAIN_SUBJECT_TYPES = ["person", "group", "object", "institution", "landscape_or_environment", "map", "chart_or_data", "document_or_screenshot", "abstract_or_symbolic", "mixed", "other", "uncertain"]
VISUAL_ROLES = ["portrait", "event_scene", "institutional_anchor", "object_metaphor", "map_based_representation", "data_visualization", "document_evidence", "generic_stock_concept", "symbolic_editorial_scene", "mixed_role", "open_role", "uncertain"]
COMPOSITION_TYPES = ["single_dominant_subject", "central_person", "group_scene", "object_centered_closeup", "map_centered", "left_right_opposition", "collage", "text_heavy", "abstract_layout", "mixed_composition", "other", "uncertain"]
COARSE_TONES = ["neutral", "serious", "urgent", "positive", "tense", "celebratory", "uncertain"]
VISIBLE_TEXT_LABELS = ["none", "small_amount", "large_amount", "uncertain"]
FACE_VISIBILITY_LABELS = ["none", "small_faces", "clear_face", "large_closeup_face", "uncertain"]
YES_NO_UNCERTAIN = ["yes", "no", "uncertain"]
PERSON_COUNT_LABELS = ["0", "1", "2", "3-5", "more_than_5", "uncertain"]

#: Other names of labels.
ALIASES = {
    "text_heavy": "text_heavy",
    "photo": "photograph",
    "real_photo": "photograph",
    "real_photograph": "photograph",
    "news_photograph": "photograph",
    "stock_photo": "stock_photograph",
    "stock_image": "stock_photograph",
    "illustration": "non_photorealistic_illustration",
    "non_photorealistic": "non_photorealistic_illustration",
    "non_photorealistic_image": "non_photorealistic_illustration",
    "cartoon": "editorial_cartoon",
    "poster": "poster_or_logo",
    "logo": "poster_or_logo",
    "poster_logo": "poster_or_logo",
    "brand_logo": "poster_or_logo",
    "data_visualisation": "data_visualization",
    "building": "institution",
    "government_building": "institution",
    "institutional_building": "institution",
    "church": "institution",
    "school": "institution",
    "courthouse": "institution",
    "court": "institution",
    "document_screenshot": "document_or_screenshot",
    "screenshot_or_document": "document_or_screenshot",
    "page": "document_or_screenshot",
    "symbolic_scene": "symbolic_editorial_scene",
    "object_metaphorical": "object_metaphor",
    "map_based": "map_based_representation",
}


def _strings(xs: list[str]) -> Column:
    return F.array(*map(F.lit, xs))


def _known(label: Column) -> Column:
    """The label itself, or the one that it is another name of."""
    out = F.when(label.isNull(), label)
    for target in dict.fromkeys(ALIASES.values()):
        out = out.when(label.isin([name for name, to in ALIASES.items() if to == target]), target)
    return out.otherwise(label)


def normalize_label(x: Column, allowed: list[str], default: str | None = "uncertain", several: str | None = "uncertain") -> Column:
    """One label: as it stands, else the only valid part of a list joined by bars, else by its canonical form or another name."""
    raw, missing, many = F.trim(x.cast("string")), F.lit(default).cast("string"), F.lit(several).cast("string")
    valid = F.filter(F.transform(F.filter(F.split(raw, r"\|"), lambda p: F.trim(p) != ""), canonical_label), lambda p: p.isin(allowed))
    one = _known(canonical_label(raw))
    return (
        F.when(raw.isNull(), missing)
        .when(raw.isin(allowed), raw)
        .when(F.contains(raw, F.lit("|")), F.when(F.size(valid) == 1, F.get(valid, 0)).otherwise(many))
        .when(one.isin(allowed), one)
        .otherwise(missing)
    )


def normalize_label_list(x: Column, allowed: list[str], default: str = "uncertain", most: int = 3) -> Column:
    """Distinct labels of a text parted by bars, or else by commas; more than `most` of them are mixed_role or the default."""
    raw = F.trim(x)
    parts = F.when(F.contains(raw, F.lit("|")), F.split(raw, r"\|")).otherwise(F.split(raw, ","))
    # A comma or bar never stands inside a part, so each part is a single label.
    found = F.array_distinct(F.filter(F.transform(parts, lambda p: normalize_label(p, allowed, None, None)), lambda p: p.isNotNull()))
    base = F.array(F.lit(default))
    return F.when(x.isNull() | (F.size(found) == 0), base).when(F.size(found) > most, F.when(F.array_contains(found, "mixed_role"), F.array(F.lit("mixed_role"))).otherwise(base)).otherwise(found)


def normalize_bool(x: Column, default: bool | None = None) -> Column:
    s = F.lower(F.trim(x.cast("string")))
    return F.when(s.isin("true", "yes", "1"), True).when(s.isin("false", "no", "0"), False).otherwise(F.lit(default).cast("boolean"))


def normalize_open_list(x: Column) -> Column:
    """The non-empty parts between semicolons, or else between commas."""
    parts = F.when(F.contains(x, F.lit(";")), F.split(x, ";")).otherwise(F.split(x, ","))
    return F.when(x.isNull(), F.array().cast("array<string>")).otherwise(F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != ""))


def visible_text(x: Column, small: int = 30) -> Column:
    """struct<label, content>: a label as it stands; other text is content, its amount by its length."""
    raw = F.trim(x)
    pair = lambda a, b: F.struct(F.lit(a).alias("label") if isinstance(a, str) else a.alias("label"), (b if isinstance(b, Column) else F.lit(b)).alias("content"))
    return (
        F.when(x.isNull(), pair("uncertain", ""))
        .when(raw.isin(VISIBLE_TEXT_LABELS), pair(raw, ""))
        .when(raw == "", pair("none", ""))
        .when(F.lower(raw).isin("yes", "no", "true", "false"), pair("uncertain", ""))
        .when(F.length(raw) <= small, pair("small_amount", raw))
        .otherwise(pair("large_amount", raw))
    )


def reliability(main: Column, roles: Column, composition: Column, style: Column, description: Column, known: Column | None = None) -> Column:
    """struct<score, usage>: 1 less penalties for what is missing, mixed or uncertain; penalties add in this order. Where
    `known` doesn't hold there are no facts, which scores 0."""
    missing = lambda x: F.coalesce(x, F.lit("uncertain"))
    roles = F.coalesce(roles, F.array().cast("array<string>"))
    cost = lambda cond, x: F.when(cond, F.lit(-x)).otherwise(F.lit(0.0))
    m, c = missing(main), missing(composition)
    score = F.lit(1.0) + F.when(m.isin("uncertain", "other"), F.lit(-0.25)).when(m == "mixed", F.lit(-0.10)).otherwise(F.lit(0.0))
    score = score + cost((F.size(roles) == 0) | F.array_contains(roles, "uncertain"), 0.25)
    score = score + cost(F.arrays_overlap(roles, _strings(["mixed_role", "open_role"])), 0.10)
    score = score + F.when(c.isin("uncertain", "other"), F.lit(-0.15)).when(c == "mixed_composition", F.lit(-0.10)).otherwise(F.lit(0.0))
    score = score + cost(missing(style) == "uncertain", 0.10)
    score = score + cost(F.length(F.coalesce(description, F.lit(""))) < 10, 0.20)
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
    if known is not None:
        score = F.when(known, score).otherwise(0.0)
    return F.struct(score.alias("score"), F.when(score >= 0.70, "strong").when(score >= 0.40, "soft").otherwise("ignore").alias("usage"))
