"""Messages for a model from templates. A template's text is an input; {title} and {facts} stand for a row's values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from curata.functions import text as T


def filled(template: str, **values: Column) -> Column:
    """The template with each {name} replaced, in one pass: braces in values stay as they are."""
    parts, rest = [], template
    while True:
        found = sorted((rest.find("{" + k + "}"), k) for k in values if "{" + k + "}" in rest)
        if not found:
            return F.concat(*parts, F.lit(rest)) if parts else F.lit(rest)
        at, k = found[0]
        parts += [F.lit(rest[:at]), F.coalesce(values[k], F.lit(""))]
        rest = rest[at + len(k) + 2 :]


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def student_messages(system: str, instruction: str, title: Column) -> Column:
    """System and user messages: the instruction with the clean title."""
    return F.array(message("system", F.lit(system)), message("user", filled(instruction, title=T.clean_text(title))))


def teacher_messages(system: str, instruction: str, title: Column, facts: Column, missing: str = "null") -> Column:
    """The same with the facts as JSON; null facts are `missing`."""
    return F.array(message("system", F.lit(system)), message("user", filled(instruction, title=T.clean_text(title), facts=F.coalesce(F.to_json(facts), F.lit(missing)))))


def taxonomy_prompt(template: str, taxonomies: dict[str, list[str]]) -> str:
    """A constant prompt that lists each closed vocabulary: {name} becomes its labels joined by bars."""
    for name, labels in taxonomies.items():
        template = template.replace("{" + name + "}", "|".join(labels))
    return template


def retry_context(answer: Column, most: int = 4000) -> Column:
    """The start of a model's last answer, for the message that asks it again."""
    return F.left(F.coalesce(answer, F.lit("")), F.lit(most))
