"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Each test item is seeded with all its trigrams, not only with rare ones: with a third of its words changed an item may
keep any of them, so each subset would lose edited copies, and which are rare would depend on the size of the corpus and
on how often the item is copied. Items of one or two words are seeded with themselves. Documents are joined to items on the seeds, and around each seed the item
is aligned word by word with the document, unless too few of its words are there at all; the score is 1 for the whole
item in place and loses for words that are changed, left out or put in. Copies with no three words in a row unchanged
share no seed and aren't found.
Items are handled in blocks of bounded size, each in a pass over all documents, so what is sent to the tasks is bounded.

Words are runs of letters and digits, in lower case. Edge cases: null, empty and blank texts have no words and match
nothing; items of one or two words match in place only. Long texts are read whole. Repeated rows and equal items each give
their rows. With an empty table on either side there are no rows. Other columns are ignored by `find` and kept by
`drop_contaminated`. Of alignments with equal scores the first in the document counts.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.llm import common, hashing

GRAM = 3
MATCH, MISMATCH, GAP = 2, -1, -1


def _separators() -> np.ndarray:
    return np.array([not (48 <= b <= 57 or 97 <= b <= 122 or b >= 128) for b in range(256)])


def words(text: str) -> np.ndarray:
    data = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    return hashing.span_hashes(data, *hashing.spans(data, _separators()))


def _lookup(keys: np.ndarray, found: np.ndarray) -> np.ndarray:
    """The place in sorted keys of each of found, or -1."""
    if not len(keys):
        return np.full(len(found), -1)
    at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
    return np.where(keys[at] == found, at, -1)


def align(item: np.ndarray, part: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman score of item in part, and start and end of the best place in part."""

    def best(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
        slope = GAP * np.arange(1, len(b) + 1)
        above = np.zeros(len(b) + 1, np.int64)
        top = (0, 0, 0)
        for i, word in enumerate(a):
            row = np.maximum(above[:-1] + np.where(b == word, MATCH, MISMATCH), above[1:] + GAP)
            row = np.maximum(np.maximum.accumulate(np.maximum(row, 0) - slope) + slope, 0)
            j = int(row.argmax())
            if row[j] > top[0]:
                top = (int(row[j]), i + 1, j + 1)
            above[1:] = row
        return top

    score, rows, end = best(item, part)
    if not score:
        return 0, 0, 0
    _, _, back = best(item[:rows][::-1], part[:end][::-1])
    return score, end - back, end


def _matcher(held, threshold: float):
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = held.value
        keys, first, last, owners, places, grams = (block[k] for k in ("keys", "first", "last", "owners", "places", "grams"))
        for batch in batches:
            rows = []
            for doc_id, tag, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "tag", "text"))):
                w = words(text)
                hits = defaultdict(list)
                for gram in grams:
                    at = _lookup(keys, hashing.run_hashes(w, gram))
                    for p in np.flatnonzero(at >= 0):
                        for k in range(first[at[p]], last[at[p]]):
                            hits[owners[k]].append(p - places[k])
                for k, begins in hits.items():
                    item, best, reach = block["items"][k], (0.0, 0, 0), -1
                    slack = len(item) // 2 + 2
                    windows: list[list[int]] = []
                    for b in sorted(begins):  # one window for places that overlap
                        if windows and b - slack <= reach:
                            windows[-1][1] = reach = max(reach, b + len(item) + slack)
                        else:
                            windows.append([b - slack, b + len(item) + slack])
                            reach = windows[-1][1]
                    for a, b in windows:
                        a = max(a, 0)
                        if np.isin(item, w[a:b]).sum() / len(item) < threshold:  # words in common bound the score
                            continue
                        score, start, end = align(item, w[a:b])
                        if score / (MATCH * len(item)) > best[0]:
                            best = (score / (MATCH * len(item)), a + start, a + end)
                    if best[0] >= threshold:
                        rows.append((doc_id, tag, block["ids"][k], *best))
            columns = list(zip(*rows)) if rows else [[]] * 6
            types = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "tag", "item_id", "score", "start_word", "end_word"])

    return match


def _seeds(items: list[np.ndarray]) -> dict:
    chosen = defaultdict(list)
    for k, item in enumerate(items):
        for p, gram in enumerate(hashing.run_hashes(item, min(GRAM, len(item)))):
            chosen[int(gram)].append((k, p))
    keys = np.array(sorted(chosen), np.uint64)
    size = np.array([len(chosen[int(x)]) for x in keys], np.int64)
    flat = [x for key in keys for x in chosen[int(key)]]
    ends = np.cumsum(size)
    return {"grams": sorted({min(GRAM, len(item)) for item in items}), "keys": keys, "first": ends - size, "last": ends, "owners": [k for k, _ in flat], "places": [p for _, p in flat]}


def _find(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, block_items: int = 20_000, block_chars: int = 16_000_000) -> DataFrame:
    """The rows of find, with the tag of the document's text."""
    spark, texts = docs.sparkSession, common.ids_and_texts(docs).withColumn("tag", common.text_tag())
    tests = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    size = tests.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")).first()
    blocks = max(1, -(-size["n"] // block_items), -(-(size["chars"] or 0) // block_chars))
    out = None
    for b in range(blocks):
        rows = tests.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        pairs = [(r["item_id"], w) for r in rows if len(w := words(r["text"]))]
        ids, items = [i for i, _ in pairs], [w for _, w in pairs]
        held = spark.sparkContext.broadcast(_seeds(items) | {"ids": ids, "items": items})
        found = texts.mapInArrow(_matcher(held, threshold), "doc_id long, tag long, item_id long, score double, start_word long, end_word long")
        out = found if out is None else out.unionByName(found)
    return out


def find(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, block_items: int = 20_000, block_chars: int = 16_000_000) -> DataFrame:
    """A row for each document and test item with an alignment of at least threshold: doc_id, item_id, score, and the
    place of the passage among the document's words (start_word, end_word)."""
    return _find(docs, benchmark, threshold, block_items, block_chars).drop("tag")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs, with all columns, without those that hold a test item. Rows with one id, or none, are told apart by their texts."""
    hit = common.stash(_find(docs, benchmark, **options).select(*common.identity(F.col("doc_id"), F.col("tag"))).distinct(), "hits")
    rows = docs.select(F.struct(*docs.columns).alias("row"), *common.identity(F.col("doc_id").cast("long"), common.text_tag()))
    return rows.join(hit, ["no_id", "id", "tag"], "left_anti").select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
