"""From planned rows to image candidates: which prompts a row offers, failures, completeness, paths and crop boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.functions import text as T
from curata.operators.targets import DEFAULT_NEGATIVE

PROMPT = "array<struct<variant:string,sdxl_prompt:string,negative_prompt:string>>"


def has_exported(prompts: Column) -> Column:
    return F.size(F.coalesce(prompts, F.array().cast(PROMPT))) > 0


def raw_target(student: Column, teacher: Column, source: str = "auto") -> Column:
    """The target of one source; "auto" takes the teacher's where the student's has no prompt."""
    if source in ("teacher", "student"):
        return teacher if source == "teacher" else student
    return F.when(F.coalesce(T.clean_text(student["sdxl_prompt"]), F.lit("")) != "", student).otherwise(teacher)


def negative_of_plan(plan: Column, default: str = DEFAULT_NEGATIVE) -> Column:
    """The default negative prompt and the plan's forbidden cues."""
    cues = F.filter(F.transform(F.coalesce(plan["forbidden_or_misleading_cues"], F.array().cast("array<string>")), T.clean_text), lambda x: x != "")
    return F.concat_ws(", ", F.lit(default), F.when(F.size(cues) > 0, F.array_join(cues, ", ")))


def prompts_of_row(
    exported: Column, student: Column, teacher: Column, title: Column, mode: str = "auto", source: str = "auto", variants: list[str] | None = None,
    head: list[str] = (), tail: list[str] = (), synthesise: bool = True, default_negative: str = DEFAULT_NEGATIVE,
) -> Column:
    """array<struct<variant, sdxl_prompt, negative_prompt>> that a row offers.

    Exported prompts if the row has any (or by mode), each cleaned, without empty ones; else its raw target's, whose prompt
    may be made from the title and plan. variants keeps only these. An empty variant is "chosen", that of a raw target its
    source or "raw". Without synthesise no prompt is made and no negative is filled in. Null columns are absent.
    """
    keep = lambda v: v.isin(variants) if variants is not None else F.lit(True)
    fill = lambda x: F.when(T.clean_text(x) == "", default_negative if synthesise else "").otherwise(T.clean_text(x))
    struct = lambda v, p, n: F.struct(v.alias("variant"), p.alias("sdxl_prompt"), n.alias("negative_prompt"))
    none = F.array().cast(PROMPT)
    variant = lambda x: F.when(T.clean_text(x["variant"]) == "", "chosen").otherwise(T.clean_text(x["variant"]))
    full = lambda a: F.filter(a, lambda x: (x["sdxl_prompt"] != "") & keep(x["variant"]))
    own = full(F.transform(F.coalesce(exported, none), lambda x: struct(variant(x), T.clean_text(x["sdxl_prompt"]), fill(x["negative_prompt"]))))

    def raw(target: Column) -> Column:
        written, plan = T.clean_text(target["sdxl_prompt"]), target["generation_plan"]
        name = F.lit(source if source in ("teacher", "student") else "raw")
        lists = lambda k: F.coalesce(plan[k], F.array().cast("array<string>"))
        made = T.plan_prompt(title, lists("required_visual_cues"), lists("optional_visual_cues"), plan["visual_strategy"], plan["framing"], plan["abstractness"], list(head), list(tail))
        negative = T.clean_text(target["negative_prompt"])
        from_plan = (written == "") & plan.isNotNull() & F.lit(synthesise)
        one = struct(name, F.when(from_plan, made).otherwise(written), F.when(from_plan & (negative == ""), negative_of_plan(plan, default_negative)).otherwise(fill(negative)))
        return F.when(target.isNull(), none).otherwise(full(F.array(one)))

    rows = T.let(raw_target(student, teacher, source), raw)
    if mode == "exported":
        return own
    return rows if mode == "raw_target" else F.when(has_exported(exported), own).otherwise(rows)


def candidates(df: DataFrame, prompts: str, keys: list[str]) -> DataFrame:
    """keys, pos, variant, sdxl_prompt, negative_prompt: a row for each prompt that a row offers."""
    return df.select(*keys, F.posexplode(prompts).alias("pos", "p")).select(*keys, "pos", "p.*")


FAILURE = "article_index long, article_id string, image_id string, article_title string, reason string, error string, candidate_id string, variant string, sample_index int, seed long, positive_prompt string, negative_prompt string"


def failures(df: DataFrame, reason: Column, **known: Column) -> DataFrame:
    """The rows with a reason as failure records of 12 columns; what isn't known is empty."""
    fields = [f.split(" ") for f in FAILURE.split(", ")]
    blank = {"string": F.lit(""), "int": F.lit(0), "long": F.lit(None)}
    value = lambda n, t: reason if n == "reason" else known.get(n, F.col(n) if n in df.columns else blank[t])
    return df.where(reason.isNotNull()).select(*((F.coalesce(value(n, t), F.lit("")) if t == "string" else value(n, t)).cast(t).alias(n) for n, t in fields))


def summary(rows: DataFrame, status: str) -> DataFrame:
    """n_input, n_generated, n_skipped, n_failed and complete: whether each input row gave an output."""
    n = lambda *s: F.count_if(F.col(status).isin(*s))
    counts = rows.agg(F.count(F.lit(1)).alias("n_input"), n("generated").alias("n_generated"), n("skipped_existing").alias("n_skipped"), n("failed").alias("n_failed"))
    return counts.withColumn("complete", F.col("n_generated") + F.col("n_skipped") == F.col("n_input"))


def require_complete(rows: DataFrame, status: str, allow_incomplete: bool = False) -> DataFrame:
    """The summary; an incomplete one is an error unless that is allowed."""
    out = summary(rows, status)
    got = out.first()
    if not got.complete and not allow_incomplete:
        raise ValueError(f"{got.n_generated + got.n_skipped} outputs for {got.n_input} rows")
    return out


def with_status(wanted: DataFrame, existing: DataFrame, path: str, failed: Column) -> DataFrame:
    """Adds status: skipped_existing where a readable file stands at the row's path, else failed or generated."""
    there = existing.select(path).distinct().withColumn("__there", F.lit(True))
    out = wanted.join(there, path, "left")
    return out.withColumn("status", F.when(F.col("__there"), "skipped_existing").when(failed, "failed").otherwise("generated")).drop("__there")


def submission_name(slug: Column, group: str, approach: str) -> Column:
    return F.concat(slug, F.lit(f"_{group}_{approach}.png"))


def crop_box(width: Column, height: Column, to_width: int = 460, to_height: int = 260) -> Column:
    """struct<left, top, right, bottom>: the centred part with the target's aspect ratio, or all if it is within 0.01 of it."""
    ratio, wanted = width / height, to_width / to_height
    new_w, new_h = F.floor(height * wanted).cast("int"), F.floor(width / wanted).cast("int")
    left, top = F.floor((width - new_w) / 2).cast("int"), F.floor((height - new_h) / 2).cast("int")
    box = lambda *x: F.struct(*(F.lit(v).cast("int").alias(n) if isinstance(v, int) else v.cast("int").alias(n) for n, v in zip(("left", "top", "right", "bottom"), x, strict=True)))
    return F.when(F.abs(ratio - wanted) <= 0.01, box(0, 0, width, height)).when(ratio > wanted, box(left, 0, left + new_w, height)).otherwise(box(0, top, width, top + new_h))
