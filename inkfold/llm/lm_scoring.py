"""LM scoring by subword lattice likelihood.

A text is scored by the probability of all its segmentations into the pieces of an existing vocabulary. Pieces don't
cross white space, so a text's lattice is the product of its words' lattices, and each distinct word is run through
the forward recursion once, in log space, with the bytes of all words of a length side by side. The vocabulary's scores
give the order in which its pieces start (the n-th has a share of 1 / (n + 10)); `rounds` passes of expectation-maximisation over the
word counts of the training documents then weigh them. Every single byte is a piece too, so no word is impossible.

Word counts come from all training documents and stay distributed. The `common_words` most frequent words are broadcast;
occurrences of others are joined with their counts.

Edge cases: a null, empty or blank text is its end alone. Words longer than `LONG` bytes are weighed and scored
one by one. With no training text all counts are zero, base scores are 0 and pieces keep their first
weights. Repeated rows are scored each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import exp, log, log10

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.llm import common, hashing

#: Stands for the vocabulary's mark of a word's start; no UTF-8 text has this byte.
START = 255
LONG = 64
BASE = 0x9E3779B97F4A7C15


def vocabulary(path: str) -> list[bytes]:
    """The pieces of a sentencepiece model in the order of their scores, then the single bytes that it lacks."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    mark = "▁".encode()
    found = []
    for i in sorted(range(model.get_piece_size()), key=lambda i: (-model.get_score(i), i)):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
            piece = model.id_to_piece(i).encode().replace(mark, bytes([START]))
            if START not in piece[1:]:
                found.append(piece)
    return list(dict.fromkeys(found + [bytes([b]) for b in range(256)]))


class Lattice:
    """The forward and backward recursions over the words' segmentations into weighted pieces."""

    def __init__(self, pieces: list[bytes], weights: np.ndarray):
        self.weights = weights
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in sorted({len(p) for p in pieces}):
            at = np.array([i for i, p in enumerate(pieces) if len(p) == n])
            keys = self._prefixes(np.frombuffer(b"".join(pieces[i] for i in at), np.uint8).reshape(len(at), n))[:, n]
            order = np.argsort(keys)
            self.tables[n] = (keys[order], at[order])
        self.by_piece = dict(zip(pieces, enumerate(weights.tolist())))

    @staticmethod
    def _prefixes(words: np.ndarray) -> np.ndarray:
        """The polynomial hash of each prefix, so that a substring's is a difference."""
        up, _ = hashing.powers(BASE, words.shape[1])
        out = np.zeros((len(words), words.shape[1] + 1), np.uint64)
        np.cumsum((words.astype(np.uint64) + np.uint64(1)) * up[: words.shape[1]], axis=1, out=out[:, 1:])
        return out

    def run(self, words: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Log probability of each row of bytes; with counts also the expected number of uses of each piece."""
        n, size = words.shape
        sums, (_, down) = self._prefixes(words), hashing.powers(BASE, size)
        ahead = np.full((n, size + 1), -np.inf)
        ahead[:, 0] = 0
        arcs = []
        for end in range(1, size + 1):
            for k, (keys, pieces) in self.tables.items():
                if k > end:
                    break
                found = (sums[:, end] - sums[:, end - k]) * down[end - k]
                at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
                rows = np.flatnonzero(keys[at] == found)
                if len(rows):
                    used = pieces[at[rows]]
                    ahead[rows, end] = np.logaddexp(ahead[rows, end], ahead[rows, end - k] + self.weights[used])
                    if counts is not None:
                        arcs.append((rows, used, end - k, end))
        if counts is None:
            return ahead[:, size], None
        behind = np.full((n, size + 1), -np.inf)
        behind[:, size] = 0
        for rows, used, start, end in reversed(arcs):
            behind[rows, start] = np.logaddexp(behind[rows, start], behind[rows, end] + self.weights[used])
        expected = np.zeros(len(self.weights))
        for rows, used, start, end in arcs:
            share = np.exp(ahead[rows, start] + self.weights[used] + behind[rows, end] - ahead[rows, size])
            expected += np.bincount(used, share * counts[rows], minlength=len(expected))
        return ahead[:, size], expected

    def _into(self, word: bytes, end: int) -> list[tuple[int, int, float]]:
        """Start, piece and weight of each piece of word that ends there."""
        return [(end - k, *hit) for k in self.tables if k <= end and (hit := self.by_piece.get(word[end - k : end])) is not None]

    def long(self, word: bytes, count: float = 0.0, expected: np.ndarray | None = None) -> float:
        """The same for one long word; with expected, its expected uses times count are added there."""
        ahead = [0.0]
        for end in range(1, len(word) + 1):
            arcs = [ahead[start] + w for start, _, w in self._into(word, end)]
            top = max(arcs)
            ahead.append(top + log(sum(exp(a - top) for a in arcs)))
        if expected is not None:
            # The share of the paths through each place flows back over its arcs, which are looked up again, not held.
            through = [0.0] * len(word) + [count]
            for end in range(len(word), 0, -1):
                for start, piece, w in self._into(word, end):
                    share = through[end] * exp(ahead[start] + w - ahead[end])
                    through[start] += share
                    expected[piece] += share
        return ahead[-1]

    def score(self, words: list[bytes]) -> np.ndarray:
        """Log probability of each word."""
        out = np.zeros(len(words))
        for size, at in _by_length(words):
            if size > LONG:
                out[at] = [self.long(bytes([START]) + words[i]) for i in at]
            else:
                out[at] = self.run(_matrix(words, at, size))[0]
        return out


def _by_length(words: list[bytes], most: int = 4096) -> Iterator[tuple[int, np.ndarray]]:
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        for k in range(0, len(at), most):
            yield int(size), at[k : k + most]


def _matrix(words: list[bytes], at: np.ndarray, size: int) -> np.ndarray:
    out = np.full((len(at), size + 1), START, np.uint8)
    out[:, 1:] = np.frombuffer(b"".join(words[i] for i in at), np.uint8).reshape(len(at), size)
    return out


def _count_words(most: int = 400_000):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[Counter, Counter] = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            learned, others = held
            words = list(learned | others)
            out = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([learned[w] for w in words], pa.int64()), pa.array([learned[w] + others[w] for w in words], pa.int64())], ["word", "n", "n_all"])
            learned.clear()
            others.clear()
            return out

        for batch in batches:
            for held_out, text in zip(batch.column("held_out").to_pylist(), batch.column("text").to_pylist()):
                held[held_out].update(text.encode("utf-8", "replace").lower().split())
                if len(held[0]) + len(held[1]) >= most:
                    yield flush()
        yield flush()

    return count


def _expect(model):
    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, weights = model.value
        lattice, total = Lattice(pieces, weights), np.zeros(len(weights))
        for batch in batches:
            words, n = batch.column("word").to_pylist(), batch.column("n").to_numpy()
            for size, at in _by_length(words):
                if size <= LONG:
                    total += lattice.run(_matrix(words, at, size), n[at].astype(float))[1]
                else:
                    for i in at:
                        lattice.long(bytes([START]) + words[i], float(n[i]), total)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["piece", "uses"])

    return expect


def _weigh_words(model):
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(*model.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), batch.column("n_all"), pa.array(lattice.score(batch.column("word").to_pylist()) / log(10))], ["word", "n", "n_all", "logp"])

    return weigh


def _score_common(held):
    """A row for each document with the sums over its common words, and the others with their numbers."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                words = text.encode("utf-8", "replace").lower().split()
                base = logp = 0.0
                known, rare = 0, []
                for w, k in Counter(words).items():
                    if (hit := table.get(w)) is None:
                        rare.append({"word": w, "k": k})
                    else:
                        base, logp, known = base + k * hit[0], logp + k * hit[1], known + k * hit[2]
                out.append((row, len(words) + 1, base, logp, known, rare))
                row += 1
            columns = list(zip(*out)) if out else [[]] * 6
            types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.list_(pa.struct([("word", pa.binary()), ("k", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *(pa.array(c, t) for c, t in zip(columns, types))], ["doc_id", "held_out", "row", "n_tokens", "base", "logp", "known", "rare"])

    return score


def score(docs: DataFrame, pieces_path: str, folds: int = 10, rounds: int = 2, common_words: int = 100_000) -> DataFrame:
    """A row for each document: doc_id, held_out (crc32(doc_id) mod folds is 0: not learned from), n_tokens, n_known,
    train_tokens, base_score (smoothed unigram counts) and score, both log10 probabilities of the whole text."""
    spark = docs.sparkSession
    texts = common.ids_and_texts(docs).withColumn("held_out", F.coalesce(common.id_crc() % folds == 0, F.lit(False)))
    counted = texts.mapInArrow(_count_words(), "word binary, n long, n_all long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_all").alias("n_all"))
    counted = common.stash(counted, "words")
    ends = texts.where(~F.col("held_out")).count()
    of = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if(F.col("n") > 0).alias("v")).first()
    total, distinct = of["n"] + ends, of["v"] + (ends > 0)

    pieces = vocabulary(pieces_path)
    uses = 1 / (np.arange(len(pieces)) + 10)
    uses *= max(of["n"], 1) / uses.sum()
    for k in range(rounds + 1):
        if k and of["n"]:
            found = counted.where("n > 0").mapInArrow(_expect(held), "piece long, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect()
            uses = np.full(len(pieces), 0.01)
            np.add.at(uses, [r["piece"] for r in found], [r["uses"] for r in found])
        weights = np.log(uses / (uses.sum() + ends + 1))
        held = spark.sparkContext.broadcast((pieces, weights))
    end_logp = log10((ends + 1) / (uses.sum() + ends + 1))

    weighed = common.stash(counted.mapInArrow(_weigh_words(held), "word binary, n long, n_all long, logp double"), "words")
    floor = log10(total + 0.1 * (distinct + 1))
    base = F.log10(F.col("n") + 0.1) - floor
    weighed = weighed.select("word", "n_all", base.alias("base"), "logp", (F.col("n") > 0).cast("long").alias("known"))
    top = weighed.orderBy(F.col("n_all").desc(), "word").limit(common_words).toArrow().to_pydict()
    table = spark.sparkContext.broadcast(dict(zip(top["word"], zip(top["base"], top["logp"], top["known"]))))
    schema = "doc_id long, held_out boolean, row long, n_tokens long, base double, logp double, known long, rare array<struct<word: binary, k: long>>"
    rows = common.stash(texts.mapInArrow(_score_common(table), schema), "scored")
    sums = ["base", "logp", "known"]
    rare = rows.select("row", F.inline("rare")).join(weighed, "word").groupBy("row").agg(*(F.sum(F.col(c) * F.col("k")).alias(f"more_{c}") for c in sums))
    out = rows.drop("rare").join(rare, "row", "left")
    whole = {c: F.col(c) + F.coalesce(F.col(f"more_{c}"), F.lit(0)) for c in sums}
    end_base = log10((ends + 0.1)) - floor
    return out.select(
        "doc_id", "held_out", "n_tokens", (whole["known"] + int(ends > 0)).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (whole["base"] + end_base).alias("base_score"), (whole["logp"] + end_logp).alias("score"),
    )
