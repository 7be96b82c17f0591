"""Plans out of model output: canonical form with notes of each change, and validation with codes.

A plan is a struct of five fields (see SCHEMA). canonical() maps near-miss keys, coerces values and fills what may be
filled; it leaves the core of the plan empty where the model left it so, and validate() then says what is missing. Values
stay Column expressions; Python judges likeness alone: of distinct keys (curata.functions.keys), of values to the closed
vocabularies, and of texts to the schema's placeholders.
"""

from __future__ import annotations

import json
import re
from difflib import SequenceMatcher
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.functions import keys as K
from curata.functions import text as T
from curata.functions.jsonrepair import STRICT, parse_object
from curata.operators.relational import codes
from curata.operators.storage import stored

#: Closed vocabularies, fill-ins, placeholders of the prompt's schema, style words and risky terms.
STRATEGIES = ["direct_depiction", "symbolic_editorial", "location_anchor", "person_or_group_scene", "object_still_life", "document_or_data_visual", "map_or_geography", "event_scene", "conceptual_composite", "other"]
ABSTRACTNESS = ["literal", "semi_symbolic", "symbolic", "other"]
DEFAULT_NEGATIVE = (
    "photorealistic face, realistic face, detailed human face, realistic portrait, face close-up, headshot, exact facial likeness, "
    "AI-generated fake portrait, uncanny human face, photorealistic fake news photo, readable text, legible text, dense text, small text, "
    "letters, words, chart labels, document text, exact logos, watermark, clutter, unrelated objects, distorted anatomy, graphic gore, "
    "misleading literal scene"
)
DEFAULT_CONTEXT = "inferred from the title only"
DEFAULT_RISKS = ["readable text", "exact logos", "misleading literal scene"]
DEFAULT_NOT_EMPHASIZED = ["unsupported details", "readable text", "exact logos"]
DEFAULT_ROLE = "editorial illustration for a news thumbnail"
DEFAULT_FORBIDDEN = ["readable text", "exact logos", "watermark", "fake documents", "photorealistic face", "exact realistic likeness"]
PLACEHOLDERS = [
    "short interpretation of the title",
    "entity names explicitly from the title",
    "brief roles of the named entities",
    "main issue or event described by the title",
    "relevant context inferred only from the title and general knowledge",
    "relationship among entities/issues if any",
    "risks such as wrong likeness, misleading literal scene, readable text",
    "things that should not dominate the image",
    "2-5 title-supported visual cues",
    "2-5 title-supported concrete semantic cues",
    "2-5 concrete cues supported by the title",
    "0-4 broad safe title-compatible cues",
    "0-4 broad safe title-compatible cues, possibly inspired by VLM facts",
    "0-4 safe title-compatible supporting cues",
    "title risks, SDXL/editorial risks, or VLM-observed risky artifacts",
    "title risks, generic SDXL risks, or VLM-observed risky artifacts",
    "brief composition/framing description",
    "concise natural-language comma-separated SDXL positive prompt",
    "concise natural-language SDXL positive prompt with explicit non-photorealistic/editorial style",
    "concise comma-separated SDXL negative prompt",
    "one concise plain-language caption",
]
STYLE_WORDS = ["non-photorealistic", "synthetic", "editorial illustration", "illustration", "vector", "cut-paper", "symbolic", "stylized", "news thumbnail"]
RISKY = [
    "readable text", "legible text", "exact logo", "exact logos", "watermark", "watermarks", "photorealistic portrait", "realistic portrait",
    "exact facial likeness", "fake document", "fake documents", "newspaper headline", "newspaper headlines",
]

TU = {"headline_core": "string", "named_entities": "list", "entity_roles": "list", "main_event_or_issue": "string", "implied_context": "string", "relation": "string", "visual_risks": "list", "what_should_not_be_emphasized": "list"}
#: Names of an older schema that still count.
OLD_NAMES = {"relation": "causal_or_logical_relation", "what_should_not_be_emphasized": "what_is_not_the_point"}
GP = {"image_role": "string", "required_visual_cues": "list", "optional_visual_cues": "list", "forbidden_or_misleading_cues": "list", "visual_strategy": "string", "framing": "string", "abstractness": "string"}


def with_mapped(df: DataFrame, object_: str, expected: list[str], scope: str, name: str) -> DataFrame:
    """Adds name (map of expected key to value) and name_notes for a map of an object's entries, in the order of the entries.

    The first non-empty value of a key counts, else its last. Notes: an unmapped key, a key whose expected key has a value
    already, a key that isn't the expected one itself. Everything stays in the row: no shuffle.
    """
    keys, native, open_ = f"__{name}_keys", f"__{name}_native", f"__{name}_open"
    df = df.withColumn(keys, F.map_keys(object_))
    df = df.withColumn(native, F.transform(keys, lambda k: K.native_key(k, expected)))
    df = df.withColumn(open_, F.filter(keys, lambda k, i: F.get(native, i).isNull()))
    df = df.withColumn(f"{open_}_mapped", K.close_keys(F.col(open_), expected))
    found = lambda k, i: F.coalesce(F.get(native, i), F.get(f"{open_}_mapped", F.array_position(F.col(open_), k).cast("int") - 1))
    values = F.map_values(object_)
    lines = F.transform(keys, lambda k, i: F.struct(k.alias("key"), F.get(values, i).alias("value"), (T.clean_text(F.get(values, i)) != "").alias("full"), found(k, i).alias("to"), i.alias("i")))
    df = df.withColumn(f"{name}_lines", lines)
    rows = F.col(f"{name}_lines")

    def note(e: Column) -> Column:
        taken = F.exists(rows, lambda x: (x["i"] < e["i"]) & (x["to"] == e["to"]) & x["full"])
        say = lambda kind, tail="": F.concat(F.lit(f"{kind}:{scope}:"), e["key"], *( [F.lit("->"), e["to"]] if tail else []))
        return F.when(e["to"].isNull(), say("unmapped_key")).when(F.coalesce(taken, F.lit(False)), say("duplicate_mapped_key_ignored", "to")).when(e["key"] != e["to"], say("fuzzy_key", "to"))

    def value(key: str) -> Column:
        own = F.filter(rows, lambda x: F.coalesce(x["to"] == key, F.lit(False)))
        return F.coalesce(F.get(F.filter(own, lambda x: x["full"]), 0)["value"], F.try_element_at(own, F.lit(-1))["value"])

    fields = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, expected)), F.array(*map(value, expected))), lambda _, v: v.isNotNull())
    df = df.withColumns({name: F.when(rows.isNotNull(), fields), f"{name}_notes": F.filter(F.transform(rows, note), lambda n: n.isNotNull())})
    return df.drop(keys, native, open_, f"{open_}_mapped", f"{name}_lines")


@lru_cache(100_000)
def _close_value(value: str, allowed: tuple[str, ...]) -> str | None:
    return K.close_key(value, list(allowed), least=0.70)


def allowed_value(value: Column, allowed: list[str]) -> Column:
    """The allowed value that a near miss stands for, as keys are mapped but by a likeness of 0.70; else the value itself."""

    @F.pandas_udf("string")
    def close(values):  # noqa: ANN001, ANN202
        return values.map(lambda v: v and _close_value(v, tuple(allowed)))

    near = F.coalesce(K.exact_key(value, allowed), K.partial_key(value, allowed), close(value), value)
    return F.when((value == "") | value.isin(allowed), value).otherwise(near)


def canonical(df: DataFrame, row: str, raw: str, title: str) -> DataFrame:
    """row, title, parse_ok, target and notes for each row; raw is model output, row a unique key.

    Output that can't be parsed gives an empty plan with the fills that any plan gets; nulls count as empty.
    """
    # Each step is written, narrow and without a shuffle: one plan of all steps grows beyond what the optimizer can handle.
    parsed = stored(df.select(row, F.col(title).alias("title"), parse_object(F.coalesce(raw, F.lit("")))["object"].alias("object")))
    full = stored(with_mapped(parsed, "object", K.TOP_KEYS, "top", "fields").withColumnRenamed("fields_notes", "notes"))
    parts = {"title_understanding": [*TU, *OLD_NAMES.values()], "generation_plan": list(GP)}
    for key, fields in parts.items():
        inner = F.from_json(F.try_element_at("fields", F.lit(key)), "map<string,string>", STRICT)
        full = stored(with_mapped(full.withColumn("__object", inner), "__object", fields, key, key).drop("__object"))
    full = full.withColumn("parse_ok", F.col("object").isNotNull()).drop("object")

    get = lambda m, k: F.try_element_at(m, F.lit(k))
    some = lambda m, k, kind: T.text_list(F.coalesce(get(m, k), F.lit(""))) if kind == "list" else T.text_value(F.coalesce(get(m, k), F.lit("")))
    own = {("title_understanding", k): some("title_understanding", k, v) for k, v in TU.items()} | {("generation_plan", k): some("generation_plan", k, v) for k, v in GP.items()}
    named = T.entities(F.coalesce(get("title_understanding", "named_entities"), F.lit("")))
    roles = own["title_understanding", "entity_roles"]
    own["title_understanding", "named_entities"] = named["texts"]
    own["title_understanding", "entity_roles"] = F.when(F.size(roles) > 0, roles).otherwise(named["roles"])
    for k, old in OLD_NAMES.items():
        x, y = own["title_understanding", k], some("title_understanding", old, TU[k])
        own["title_understanding", k] = F.when((F.size(x) > 0) if TU[k] == "list" else (x != ""), x).otherwise(y)
    closed = {"visual_strategy": STRATEGIES, "abstractness": ABSTRACTNESS}
    full = full.withColumns({f"__{k}": own["generation_plan", k] for k in closed})
    full = full.withColumns({f"__{k}_mapped": allowed_value(F.col(f"__{k}"), allowed) for k, allowed in closed.items()})
    own |= {("generation_plan", k): F.col(f"__{k}_mapped") for k in closed}
    lits = lambda xs: F.array(*map(F.lit, xs))
    fills: dict[tuple[str, str], Column] = {
        ("title_understanding", "headline_core"): F.col("title"),
        ("title_understanding", "main_event_or_issue"): F.col("title"),
        ("title_understanding", "implied_context"): F.lit(DEFAULT_CONTEXT),
        ("title_understanding", "visual_risks"): lits(DEFAULT_RISKS),
        ("title_understanding", "what_should_not_be_emphasized"): lits(DEFAULT_NOT_EMPHASIZED),
        ("generation_plan", "image_role"): F.lit(DEFAULT_ROLE),
        ("generation_plan", "forbidden_or_misleading_cues"): lits(DEFAULT_FORBIDDEN),
    }
    missing = lambda part, k: (F.size(own[part, k]) == 0) if (TU | GP)[k] == "list" else (own[part, k] == "")
    filled = lambda part, k: F.when(missing(part, k), fills[part, k]).otherwise(own[part, k]) if (part, k) in fills else own[part, k]
    struct = lambda part, fields: F.struct(*(filled(part, k).alias(k) for k in fields))
    caption = some("fields", "ranking_caption", "string")
    negative = some("fields", "negative_prompt", "string")
    target = F.struct(
        struct("title_understanding", TU).alias("title_understanding"),
        struct("generation_plan", GP).alias("generation_plan"),
        some("fields", "sdxl_prompt", "string").alias("sdxl_prompt"),
        T.dedupe_comma_phrases(F.when(negative == "", DEFAULT_NEGATIVE).otherwise(negative), 28).alias("negative_prompt"),
        F.when(caption == "", F.concat(F.col("title"), F.lit(": title-grounded editorial illustration"))).otherwise(caption).alias("ranking_caption"),
    )
    none = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    values = codes([(F.concat(F.lit(f"fuzzy_value:generation_plan.{k}:"), F.col(f"__{k}"), F.lit("->"), F.col(f"__{k}_mapped")), F.col(f"__{k}") != F.col(f"__{k}_mapped")) for k in closed])
    made = codes([(f"missing_or_non_dict:{k}", F.col(k).isNull()) for k in parts] + [(f"filled_missing:{p}.{k}", missing(p, k)) for p, k in fills] + [("filled_missing:ranking_caption", caption == "")])
    return full.select(row, "title", "parse_ok", target.alias("target"), F.concat(none(F.col("notes")), *(none(F.col(f"{k}_notes")) for k in parts), values, made).alias("notes"))


def _similar_form(x: str) -> str:
    return " ".join(re.sub("[_-]+", " ", x.lower()).split())


KNOWN = [_similar_form(p) for p in PLACEHOLDERS]


@lru_cache(100_000)
def _near_placeholder(text: str, least: float = 0.82) -> bool:
    """Whether the Ratcliff-Obershelp likeness to some placeholder reaches the least; bounds of it are tried first."""
    ms = (SequenceMatcher(None, text, p) for p in KNOWN if 2.0 * min(len(text), len(p)) / (len(text) + len(p)) >= least)
    return any(m.quick_ratio() >= least and m.ratio() >= least for m in ms)


def looks_copied(text: str | None) -> bool:
    """Whether a text holds a placeholder, or it or a part of 8 characters or more between commas or semicolons is much like one."""
    t = _similar_form(text or "")
    if not t:
        return False
    parts = (x.strip() for x in re.split("[,;]", t))
    return any(p in t for p in KNOWN) or _near_placeholder(t) or any(len(x) >= 8 and _near_placeholder(x) for x in parts)


def _copied(text: Column, is_json: bool = False) -> Column:
    """looks_copied of a text, or of JSON as Python's json.dumps spaces it."""

    @F.pandas_udf("boolean")
    def copied(texts):  # noqa: ANN001, ANN202
        return texts.map(lambda x: looks_copied(json.dumps(json.loads(x), ensure_ascii=False) if is_json and x else x))

    return copied(text)


def errors(target: Column) -> Column:
    """Codes of what makes a plan unusable, in a fixed order."""

    gp, tu = target["generation_plan"], target["title_understanding"]
    texts = {k: T.clean_text(target[k]) for k in ("sdxl_prompt", "negative_prompt", "ranking_caption")} | {k: T.clean_text(gp[k]) for k in ("visual_strategy", "framing", "abstractness")}
    copies = {"tu": _copied(F.to_json(tu), True), "gp": _copied(F.to_json(gp), True), "pos": _copied(target["sdxl_prompt"]), "cap": _copied(target["ranking_caption"])}
    values = F.struct(*(x.alias(k) for k, x in (texts | copies).items()), F.lower(texts["sdxl_prompt"]).alias("low"), (T.clean_text(tu["headline_core"]) == "").alias("headless"), F.size(gp["required_visual_cues"]).alias("cues"))

    def found(v: Column) -> Column:
        low = v["low"]
        styled = F.exists(F.array(*map(F.lit, STYLE_WORDS)), lambda w: F.contains(low, w))
        out: list[tuple[str | Column, Column]] = [
            ("empty_headline_core", v["headless"]),
            ("title_understanding_looks_like_schema_copy", v["tu"]),
            ("too_few_required_visual_cues", v["cues"] < 2),
            *((f"empty_{k}", v[k] == "") for k in ("visual_strategy", "framing", "abstractness")),
            ("generation_plan_looks_like_schema_copy", v["gp"]),
            *((F.concat(F.lit(f"invalid_{k}:"), v[k]), (v[k] != "") & ~v[k].isin(allowed)) for k, allowed in (("visual_strategy", STRATEGIES), ("abstractness", ABSTRACTNESS))),
            ("sdxl_prompt_too_short", F.length(v["sdxl_prompt"]) < 40),
            ("negative_prompt_too_short", F.length(v["negative_prompt"]) < 10),
            ("missing_ranking_caption", v["ranking_caption"] == ""),
            ("sdxl_prompt_looks_like_schema_copy", v["pos"]),
            ("ranking_caption_looks_like_schema_copy", v["cap"]),
            *((f"{k}_bad_repetition", T.has_bad_repetition(v[k])) for k in ("sdxl_prompt", "negative_prompt", "ranking_caption")),
            ("sdxl_prompt_lacks_synthetic_editorial_style", ~styled),
            *((f"risky_positive_prompt_term:{t}", F.contains(low, F.lit(t)) & ~T.is_negated(low, t)) for t in RISKY),
        ]
        return codes(out)

    return T.let(values, found)


def warnings(target: Column) -> Column:
    return T.let(
        F.struct(F.lower(T.clean_text(target["negative_prompt"])).alias("neg"), F.size(target["generation_plan"]["required_visual_cues"]).alias("cues")),
        lambda v: codes([("too_many_required_visual_cues", v["cues"] > 6), *((f"negative_prompt_missing_common_risk:{t}", ~F.contains(v["neg"], F.lit(t))) for t in ("readable text", "exact logos", "watermark"))]),
    )


def is_heavy(notes: Column, most_fuzzy: int = 4) -> Column:
    """Whether a plan took too much repair to train on."""
    n = lambda p: F.size(F.filter(notes, lambda x: x.startswith(p)))
    return (n("fuzzy_key:") > most_fuzzy) | (n("unmapped_key:") > 2) | (n("duplicate_mapped_key_ignored:") > 1)
