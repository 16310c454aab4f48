"""Detector passes beside the rules: recognizers and language models that a caller brings, which may fail.

A pass takes a batch of texts in a task. What raises is asked again in halves, so that a text that a pass can't stand costs
that pass its spans of this text and nothing else: the rules' spans stay, and so do other passes'. Errors are kept by
row and pass. Texts behind a pass's gate aren't shown to it, and neither are null and empty ones. Passes run
side by side in one stage, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfold.functions import rules
from inkfold.functions.text import normalized
from inkfold.operators import spans

FOUND = "array<struct<entity_type:string,start:int,end:int,score:double>>"


def isolated(call: Callable[[list[str]], Sequence], texts: list[str]) -> list[tuple[object, str | None]]:
    """(result, error) for each text: a batch that raises, or has another number of results, is called again in halves."""
    if not texts:
        return []
    try:
        out = list(call(texts))
        if len(out) != len(texts):
            raise ValueError(f"{len(out)} results for {len(texts)} texts")
        return [(x, None) for x in out]
    except Exception as e:  # noqa: BLE001 - whatever a pass raises is its text's error
        if len(texts) == 1:
            return [(None, f"{type(e).__name__}: {e}")]
    half = len(texts) // 2
    return isolated(call, texts[:half]) + isolated(call, texts[half:])


def _told(call: Callable[[list[str]], Sequence], read: Callable[[object], object]) -> Callable[[pd.Series], pd.DataFrame]:
    """A batch of texts as results and errors; a result that can't be read is an error too."""

    def told(texts: pd.Series) -> pd.DataFrame:
        asked = [t for t in texts if t]
        results = iter(isolated(lambda batch: [read(x) for x in call(batch)], asked))
        rows = [next(results) if t else (None, None) for t in texts]
        return pd.DataFrame({"result": [r for r, _ in rows], "error": [e for _, e in rows]}, dtype=object)

    return told


@dataclass(frozen=True)
class Recognizer:
    """find gives, for each text of a batch, rows (entity_type, start, end, score) in code points, under its own names of types."""

    name: str
    find: Callable[[list[str]], Sequence[Iterable]]
    gate: Column | None = field(default=None, compare=False)

    def run(self, text: Column) -> Column:
        def read(found) -> list[dict]:
            return [{"entity_type": str(k), "start": int(a), "end": int(b), "score": float(s)} for k, a, b, s in found]

        return F.pandas_udf(_told(self.find, read), f"result {FOUND}, error string")(text)

    def spans(self, result: Column, text: Column) -> Column:
        # A place that isn't in the text, as a recognizer's mistake, gives no span.
        inside = F.filter(result, lambda s: (s["start"] >= 0) & (s["end"] <= F.length(text)))
        return spans.recognized(inside, text)


@dataclass(frozen=True)
class Asker:
    """ask gives, for the first ASKED_CHARS characters of each text of a batch, a language model's answer."""

    name: str
    ask: Callable[[list[str]], Sequence[str]]
    gate: Column | None = field(default=None, compare=False)

    def run(self, text: Column) -> Column:
        def read(answer) -> str | None:
            return None if answer is None else str(answer)

        return F.pandas_udf(_told(self.ask, read), "result string, error string")(F.substr(text, F.lit(1), F.lit(spans.ASKED_CHARS)))

    def spans(self, result: Column, text: Column) -> Column:
        return spans.answered(text, result)


def detect(texts: DataFrame, passes: Sequence[Recognizer | Asker], codes: Iterable[str] = rules.DEFAULT_PACKS, *, column: str = "text", normalize: bool = True, packs: dict[str, rules.Pack] = rules.PACKS) -> DataFrame:
    """As `spans.detect`, with the passes' spans after the rules', and `pass_errors`: a map from the passes that failed on the
    text to their errors."""
    rows = texts.withColumn("_seen", normalized(F.col(column)) if normalize else F.col(column))
    for i, p in enumerate(passes):
        shown = F.col("_seen") if p.gate is None else F.when(p.gate, F.col("_seen"))
        rows = rows.withColumn(f"_pass{i}", p.run(shown))
    more = [F.coalesce(p.spans(F.col(f"_pass{i}.result"), F.col("normalized")), spans.no_spans()) for i, p in enumerate(passes)]
    found = spans.detect(rows, codes, column="_seen", normalize=False, more=more, packs=packs)
    errors = F.array(*(F.struct(F.lit(p.name).alias("name"), F.col(f"_pass{i}.error").alias("error")) for i, p in enumerate(passes)))
    failed = F.filter(errors, lambda e: e["error"].isNotNull()) if passes else F.array().cast("array<struct<name:string,error:string>>")
    return found.withColumn("pass_errors", F.map_from_entries(failed)).drop("_seen", *(f"_pass{i}" for i in range(len(passes))))


def error_counts(found: DataFrame) -> DataFrame:
    """How many texts each pass failed on: pass, n_failed."""
    return found.select(F.explode("pass_errors").alias("pass", "error")).groupBy("pass").agg(F.count(F.lit(1)).alias("n_failed"))
