"""Checks of settings before a run, and what a run may resume from. All of them look at settings alone, never at rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def check_resume(settings: dict, previous: dict, fields: list[str]) -> None:
    """Resuming is an error where any of the fields differs; the message lists them all."""
    differ = [f"{k}: {previous.get(k)!r} then, {settings.get(k)!r} now" for k in fields if previous.get(k) != settings.get(k)]
    if differ:
        raise ValueError("the previous run's settings differ: " + "; ".join(differ))


def check_split(n_rows: int, n_validation: int) -> None:
    if n_rows == 0:
        raise ValueError("nothing to split")
    if not 0 < n_validation < n_rows:
        raise ValueError(f"validation rows must be between 1 and {n_rows - 1}")


def check_generation(width: int, height: int, images_per_prompt: int = 1, names: tuple[str, ...] = (), multiple: int = 8, sequence: int | None = None, most_sequence: int = 256, offloads: int = 0) -> None:
    """Sides divisible by `multiple`, one image a prompt, no empty name, a short enough text sequence, at most one offload."""
    wrong = [f"{n} must be a positive multiple of {multiple}" for n, x in (("width", width), ("height", height)) if x <= 0 or x % multiple]
    wrong += ["images per prompt must be 1"] * (images_per_prompt != 1) + ["names must not be empty"] * any(not n.strip() for n in names)
    wrong += [f"the text sequence has at most {most_sequence} tokens"] * (sequence is not None and sequence > most_sequence) + ["offloads exclude each other"] * (offloads > 1)
    if wrong:
        raise ValueError("; ".join(wrong))


def checkpoint_step(path: Column) -> Column:
    """N of a folder named checkpoint-N, else null."""
    n = F.regexp_extract(path, r"(?:^|/)checkpoint-(\d+)/?$", 1)
    return F.when(n != "", n.cast("long"))


def latest_checkpoint(folders: DataFrame, path: str) -> DataFrame:
    """One row: path and step of the greatest step, or no row where no folder is a checkpoint."""
    steps = folders.select(F.col(path).alias("path"), checkpoint_step(F.col(path)).alias("step")).where("step is not null")
    return steps.groupBy().agg(F.max(F.struct("step", "path")).alias("m")).where("m is not null").select("m.path", "m.step")


def token_sanity(rows: DataFrame, order: str, supervised: str, n: int = 50) -> DataFrame:
    """Average (to one place), least and greatest number of supervised tokens of the first n rows."""
    first = rows.orderBy(order).limit(n)
    return first.agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.avg(supervised), 1).alias("avg_supervised"), F.min(supervised).alias("min_supervised"), F.max(supervised).alias("max_supervised"))
