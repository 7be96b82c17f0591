"""Model calls as a stage: a generator is loaded once a Python worker and called row by row, with retries and isolation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "article_id string, image_id string, raw_text string, attempts int, status string, error string"
#: prompt and earlier answers -> answer.
Generator = Callable[[str, list[str]], str]


def stub() -> Generator:
    """A deterministic stand-in: the first answer to a prompt with an odd number of letters is cut off."""

    def answer(prompt: str, earlier: list[str]) -> str:
        full = '{"sdxl_prompt": "editorial illustration about ' + prompt.replace('"', "") + '", "ranking_caption": "' + prompt.replace('"', "") + '"}'
        return full if earlier or sum(c.isalpha() for c in prompt) % 2 == 0 else full[: len(full) // 2]

    return answer


def generate(rows: DataFrame, load: Callable[[], Generator], accept: Callable[[str], bool], prompt: str = "article_title", retries: int = 2) -> DataFrame:
    """article_id, image_id and the first accepted answer, or the last; a call that raises makes its row a failure, no more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                answers: list[str] = []
                error = None
                try:
                    while len(answers) <= retries and not (answers and accept(answers[-1])):
                        answers.append(model(r[prompt], answers))
                except Exception as e:  # the row's own
                    error = f"{type(e).__name__}: {e}"
                ok = error is None and bool(answers) and accept(answers[-1])
                out.append({"article_id": r["article_id"], "image_id": r["image_id"], "raw_text": answers[-1] if answers else None, "attempts": len(answers), "status": "ok" if ok else "error" if error else "rejected", "error": error})
            types = {"attempts": pa.int32()}
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], types.get(k, pa.string())) for k in ("article_id", "image_id", "raw_text", "attempts", "status", "error")], names=["article_id", "image_id", "raw_text", "attempts", "status", "error"])

    return rows.select("article_id", "image_id", prompt).mapInArrow(run, SCHEMA)
