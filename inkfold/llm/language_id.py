"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts each hashed 1- to 3-gram per language inside the tasks, and Spark adds the counts up; what reaches
the driver is one number for each language and bucket, however many documents there are. The log priors and the
log-probability matrix are broadcast (`cells` floats at most: with more languages there are fewer buckets) and score
sparse batches: each batch of texts is one array of bucket numbers with row offsets, looked up in the matrix and summed
by row.

Edge cases: a null or empty text, or one without a letter, gives `und` and score 0; with nothing to learn from every
text does. Rows with a null text or label teach nothing. Of languages with equal scores the first by name wins.
Very long texts are scored in slices whose sums add up. Repeated rows each give a row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.llm import common

ORDERS = 3
SLICE = 1 << 20


@cache
def _letters() -> np.ndarray:
    """For each code point of the basic plane itself if it is a letter, else a space."""
    return np.array([c if chr(c).isalpha() else 32 for c in range(1 << 16)], dtype=np.uint32)


def _codes(text: str) -> np.ndarray:
    """Lower-case letters of the text as code points, anything else as spaces, with a space at both ends."""
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), dtype="<u4")
    out = _letters()[np.minimum(raw, 0xFFFF)]
    high = raw > 0xFFFF
    if high.any():
        for c in np.unique(raw[high]):
            out[raw == c] = c if chr(c).isalpha() else 32
    return out


def _buckets(codes: np.ndarray, bits: int) -> list[np.ndarray]:
    """The bucket of each 1-, 2- and 3-gram, by its first position."""
    mixed = codes * np.uint32(0x9E3779B1)
    mixed ^= mixed >> np.uint32(15)
    gram, out = mixed, []
    for order in range(1, ORDERS + 1):
        if order > 1:
            if len(gram) < 2:
                break
            gram = gram[:-1] * np.uint32(0x85EBCA6B) + mixed[order - 1 :]
        out.append(((gram ^ (gram >> np.uint32(13))) * np.uint32(0xC2B2AE35) >> np.uint32(32 - bits)).astype(np.int32))
    return out


def _slices(codes: np.ndarray) -> Iterator[np.ndarray]:
    """Pieces that overlap so that each n-gram of two or three letters lies in one of them."""
    for at in range(0, max(1, len(codes) - ORDERS + 1), SLICE):
        yield codes[at : at + SLICE + ORDERS - 1]


def _counter(bits: int, at_once: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, n in held.items():
                at = np.flatnonzero(n)  # the last number counts documents
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], ["lang", "bucket", "n"])
            held.clear()

        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                if lang not in held and len(held) >= at_once:
                    yield from flush()
                n = held.setdefault(lang, np.zeros((1 << bits) + 1, dtype=np.int64))
                n[-1] += 1
                for piece in _slices(_codes(text)):
                    for grams in _buckets(piece, bits):
                        n[:-1] += np.bincount(grams, minlength=1 << bits)
        yield from flush()

    return count


def fit(labelled: DataFrame, bits: int = 15, alpha: float = 0.5, cells: int = 1 << 23) -> dict:
    """Learn class priors and n-gram probabilities from columns text and lang. The model has 2**bits buckets a label, and
    fewer where there are so many labels that it would have more than `cells` numbers."""
    rows = labelled.select(F.col("text"), F.col("lang").cast("string").alias("lang")).where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    langs = [r["lang"] for r in rows.select("lang").distinct().orderBy("lang").collect()]
    bits = max(3, min(bits, (cells // max(1, len(langs))).bit_length() - 1))
    if not langs:
        return {"langs": [], "prior": np.zeros(0), "matrix": np.zeros((1 << bits, 0), np.float32), "bits": bits}
    grams = rows.mapInArrow(_counter(bits, max(1, (1 << 23) >> bits)), "lang string, bucket int, n long")
    found = grams.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    place = {x: i for i, x in enumerate(langs)}
    table = np.zeros(((1 << bits) + 1, len(langs)))
    table[found.column("bucket").to_numpy(), [place[x] for x in found.column("lang").to_pylist()]] = found.column("n").to_numpy()
    table, docs = table[:-1], table[-1]
    matrix = np.log((table + alpha) / (table.sum(0) + alpha * (1 << bits))).astype(np.float32)
    return {"langs": langs, "prior": np.log(docs / docs.sum()), "matrix": matrix, "bits": bits}


def _scorer(held):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        langs, matrix, bits = model["langs"], model["matrix"], model["bits"]
        for batch in batches:
            total = np.tile(model["prior"], (batch.num_rows, 1))
            lettered = np.zeros(batch.num_rows, dtype=bool)
            rows: list[int] = []
            parts: list[np.ndarray] = []
            size = 0

            def settle() -> None:
                """Sparse rows times matrix: one lookup and one sum by row offsets."""
                nonlocal size
                if parts:
                    starts = np.cumsum([0, *map(len, parts[:-1])])
                    np.add.at(total, rows, np.add.reduceat(matrix[np.concatenate(parts)], starts, axis=0, dtype=np.float64))
                rows.clear()
                parts.clear()
                size = 0

            for i, text in enumerate(batch.column("text").to_pylist()):
                codes = _codes(text or "")
                lettered[i] = bool((codes != 32).any())
                if not lettered[i] or not langs:
                    continue
                for piece in _slices(codes):
                    for grams in _buckets(piece, bits):
                        rows.append(i)
                        parts.append(grams)
                        size += len(grams)
                    if size >= SLICE:
                        settle()
            settle()
            known = lettered & bool(langs)
            best, score = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            if langs:
                at = total.argmax(1)
                odds = np.exp(total - total.max(1, keepdims=True))
                score = np.where(known, 1 / odds.sum(1), 0.0)
                best = [langs[k] if ok else "und" for k, ok in zip(at, known)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(best, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return score


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """A row for each row of docs (doc_id, held_out, text): doc_id, held_out, lang_pred, score (its posterior probability)."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "text").mapInArrow(_scorer(held), "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, folds: int = 5) -> DataFrame:
    """Learn from all documents whose crc32(doc_id) mod folds isn't 0, and predict all documents."""
    marked = docs.select("doc_id", "text", "lang", F.coalesce(common.id_crc() % folds == 0, F.lit(False)).alias("held_out"))
    return predict(marked, fit(marked.where(~F.col("held_out"))))
