"""Compression of vectors to a few bytes: each part of a vector becomes the number of its nearest codebook entry.

Vectors are scaled to integers and cut into equal consecutive parts. Each part position has a codebook, learned by rounds of
assigning every part to its nearest entry and moving each entry to the floored mean of its parts. Nearest entries are
looked up in a vantage-point tree over the codebook: a node knows the range of distances from its vantage entry to what
lies below it, rounded outward to whole numbers, so that the triangle inequality never cuts off an entry that could be
nearest. Subtrees whose bound equals the best distance are visited too, since an equal distance with a lower index wins;
distances are compared as exact 64-bit integers. Tasks search whole batches at once, and each gives one row for an entry
that it used (count and sums), so what is shuffled doesn't grow with the vectors. Only codebooks, `entries` rows for each
part, pass the driver.

Edge cases: a vector that is null or empty, or holds a null or non-finite component, is dropped, and so is one whose length
differs from that of the first kept vector in order of vec_id, or can't be cut into equal parts. Rows with one vec_id or none
count each by itself; a null vec_id comes last. Fewer vectors than entries make a smaller codebook. Repeated vectors make equal
entries, of which the lowest is used. No vectors give no rows. Components of 32,768 and more raise ValueError: squares of
their differences could leave 64 bits. Null labels are one label. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfold.llm import common

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Entries below which a node isn't split any more.
LEAF = 16
#: Scaled components stay below this, so that squared distances of up to 2,048 components fit 64 bits.
MOST = 1 << 25


def kept(vectors: DataFrame) -> DataFrame:
    """vec_id, vector and label of the rows whose vectors are finite and not empty."""
    v = F.col("embedding")
    # A comparison with a null component is null, so such a vector isn't kept either.
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return vectors.where(v.isNotNull() & (F.size(v) > 0) & finite).select("vec_id", v.cast("array<double>").alias("vector"), "label")


def scaled(flat: np.ndarray, scale: int) -> np.ndarray:
    whole = np.floor(flat * scale)
    if len(whole) and np.abs(whole).max() >= MOST:
        raise ValueError(f"a component's size is {MOST // scale} or more")
    return whole.astype(np.int64)


def _matrix(batch: pa.RecordBatch, scale: int) -> np.ndarray:
    """A row of integers for each vector of a batch; all vectors have one length."""
    column = batch.column("vector")
    return scaled(column.flatten().to_numpy(zero_copy_only=False), scale).reshape(len(column), -1)


def root(squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The square roots of whole numbers, rounded down and up exactly."""
    r = np.sqrt(squares.astype(np.float64)).astype(np.int64)
    r -= r * r > squares
    r += (r + 1) * (r + 1) <= squares
    return r, r + (r * r < squares)


def _squares(points: np.ndarray, entry: np.ndarray) -> np.ndarray:
    d = points - entry
    return np.einsum("...i,...i->...", d, d)


class Tree:
    """A vantage-point tree over the entries of one codebook (an integer matrix, an entry a row)."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.top = self._node(np.arange(len(entries)))

    def _node(self, ids: np.ndarray):
        if len(ids) <= LEAF:
            return ids
        # The entry farthest from the first one sees the others at the most different distances.
        vantage = ids[np.argmax(_squares(self.entries[ids], self.entries[ids[0]]))]
        rest = ids[ids != vantage]
        squares = _squares(self.entries[rest], self.entries[vantage])
        if squares.min() == squares.max():  # nothing to tell them apart by
            return ids
        near = squares <= np.median(squares)
        sides = []
        for side in (near, ~near):
            if side.any():  # the median may be the largest
                sides.append((self._node(rest[side]), root(squares[side].min(keepdims=True))[0][0], root(squares[side].max(keepdims=True))[1][0]))
        return int(vantage), sides

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each point the index of its nearest entry, the lowest of equal ones, and the squared distance."""
        index, best = np.full(len(points), len(self.entries)), np.full(len(points), np.iinfo(np.int64).max)

        def take(rows: np.ndarray, ids, squares: np.ndarray) -> None:
            better = (squares < best[rows]) | (squares == best[rows]) & (ids < index[rows])
            best[rows] = np.where(better, squares, best[rows])
            index[rows] = np.where(better, ids, index[rows])

        def visit(node, rows: np.ndarray) -> None:
            if not len(rows):
                return
            if isinstance(node, np.ndarray):
                squares = _squares(points[rows][:, None, :], self.entries[node][None])
                first = squares.argmin(1)  # ids ascend, so the first of equal ones is the lowest
                return take(rows, node[first], squares[np.arange(len(rows)), first])
            vantage, sides = node
            squares = _squares(points[rows], self.entries[vantage])
            take(rows, vantage, squares)
            low, high = root(squares)
            bounds = [np.maximum(0, np.maximum(low - far, near - high)) for _, near, far in sides]
            nearer = bounds[0] <= bounds[-1]
            for chosen, order in ((nearer, range(len(sides))), (~nearer, reversed(range(len(sides))))):
                for k in order:
                    bound = bounds[k][chosen]
                    visit(sides[k][0], rows[chosen][bound * bound <= best[rows[chosen]]])

        visit(self.top, np.arange(len(points)))
        return index, best


def _coded(matrix: np.ndarray, trees: list[Tree]) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's entries, a column for each part, and the sum of its squared distances."""
    found = [tree.nearest(part) for tree, part in zip(trees, np.split(matrix, len(trees), axis=1))]
    return np.stack([i for i, _ in found], 1), sum((d for _, d in found), np.zeros(len(matrix), np.int64))


def _totals(vectors: DataFrame, books: list[np.ndarray], scale: int) -> DataFrame:
    """(part, entry, n, sums) of the vectors' parts nearest to each entry."""
    width = books[0].shape[1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Tree(b) for b in books]
        counts, sums = [np.zeros(len(b), np.int64) for b in books], [np.zeros_like(b) for b in books]
        for batch in batches:
            matrix = _matrix(batch, scale)
            codes, _ = _coded(matrix, trees)
            for p, part in enumerate(np.split(matrix, len(books), axis=1)):
                counts[p] += np.bincount(codes[:, p], minlength=len(books[p]))
                np.add.at(sums[p], codes[:, p], part)
        used = [(p, i) for p in range(len(books)) for i in np.flatnonzero(counts[p])]
        yield pa.RecordBatch.from_arrays(
            [pa.array([p for p, _ in used], pa.int32()), pa.array([int(i) for _, i in used], pa.int32()), pa.array([int(counts[p][i]) for p, i in used], pa.int64()), pa.array([sums[p][i].tolist() for p, i in used], pa.list_(pa.int64()))],
            ["part", "entry", "n", "sums"],
        )

    rows = vectors.select("vector").mapInArrow(assign, "part int, entry int, n long, sums array<long>")
    return rows.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i]) for i in range(width))).alias("sums"))


def learn(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> list[np.ndarray]:
    """A codebook for each part position of vectors (as `kept` gives), an integer matrix with an entry a row. They start as
    the parts of the first vectors by vec_id."""
    first = vectors.orderBy(F.asc_nulls_last("vec_id"), "vector").select("vector").limit(1).collect()
    if not first or len(first[0][0]) % parts:
        return []
    rows = vectors.where(F.size("vector") == len(first[0][0]))
    start = rows.orderBy(F.asc_nulls_last("vec_id"), "vector").select("vector").limit(entries).collect()
    books = np.split(np.stack([scaled(np.array(r[0], np.float64), scale) for r in start]), parts, axis=1)
    for _ in range(rounds):
        moved = [b.copy() for b in books]
        for r in _totals(rows, books, scale).collect():  # a row for each entry
            moved[r["part"]][r["entry"]] = [s // r["n"] for s in r["sums"]]
        books = moved
    return books


def encode(vectors: DataFrame, books: list[np.ndarray], scale: int = SCALE) -> DataFrame:
    """vec_id, label, code (hex digits, two for each part) and error of the vectors that have the codebooks' length."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Tree(b) for b in books]
        for batch in batches:
            codes, errors = _coded(_matrix(batch, scale), trees)
            digits = pa.array([bytes(c) for c in codes.astype(np.uint8)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), digits, pa.array(errors, pa.int64())], ["vec_id", "label", "code", "error"])

    fit = vectors.where(F.size("vector") == sum(b.shape[1] for b in books) if books else F.lit(False))
    kinds = dict(vectors.dtypes)
    coded = fit.mapInArrow(code, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code binary, error long")
    return coded.withColumn("code", F.lower(F.hex("code")))


def decode(code: Column, books: list[np.ndarray], scale: int = SCALE) -> Column:
    """The vector (array<double>) that a code stands for: the lower corners of its entries' cells."""
    tables = [F.array(*(F.array(*(F.lit(float(x) / scale) for x in row)) for row in b.tolist())) for b in books]
    return F.concat(*(F.get(t, F.conv(F.substring(code, 2 * p + 1, 2), 16, 10).cast("int")) for p, t in enumerate(tables)))


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components as decimals, by part, entry and place in the part."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def compress(vectors: DataFrame, **options) -> DataFrame:
    """A row for each kept vector: vec_id, code, error, label_error (the sum over its label) and codebooks_sha256."""
    rows = kept(vectors)
    books = learn(rows, **options)
    key = [F.col("label").isNull().alias("no_label"), F.coalesce(F.col("label").cast("string"), F.lit("")).alias("named")]
    coded = common.stash(encode(rows, books, options.get("scale", SCALE)).select("vec_id", "code", "error", *key), "codes")
    labels = common.stash(coded.groupBy("no_label", "named").agg(F.count(F.lit(1)).alias("n"), F.sum("error").alias("label_error")), "labels")
    joined = common.join_counted(coded, labels, ["no_label", "named"])
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
