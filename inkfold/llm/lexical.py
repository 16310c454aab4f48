"""Ranked lexical search over a two-level index of impacts.

A term's share in a document's score is its weight times an impact, a whole number below a million that its occurrences and
the document's length give. The index holds a row for each term of a block of documents: level one is the places of the
documents and their impacts as bytes, rounded up to multiples of STEP; level two is the occurrences, from which the impact
follows exactly. A search first sums bytes: each sum bounds a document's score from above, and, less a step for each term,
from below. The k-th largest lower bound of all blocks is a score that k documents reach, so only documents whose upper
bound reaches it can be among the best k; of those, and no others, exact scores are summed from level two.

Blocks are made where the documents are read, without a shuffle, and hold at most BLOCK_DOCS documents or BLOCK_BYTES of
text (a longer text is a block of its own); a term that all documents hold is a short row in each block. Queries are sent to the
blocks in bounded groups, whose terms alone are read from the index. Of documents with one text (told by a BLAKE2b digest of its
lower-case bytes), whose scores are equal, the k with the smallest ids are scored.

Edge cases: a null or empty text, or one without a term, is found by no query and isn't counted; nor does such a query find anything.
Texts and queries are read whole. A row repeated with its id is ranked as often as it occurs. Equal scores go by doc_id, a
null one last. Each query row is answered by itself, whatever its id. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkfold.llm import common, hashing

#: Fixed value: a term is a run of letters and digits of ASCII and of all characters beyond it.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Impacts are below MOST; a byte counts steps of this size.
MOST, STEP = 1_000_000, 3922
BLOCK_DOCS, BLOCK_BYTES = 4096, 1 << 22
#: So many texts are handed to a task at once.
BATCH = 1024
#: So much text is hashed at once.
SLICE = 1 << 20
#: Queries, and terms of theirs, that are sent to the blocks together; cells of a matrix of documents and terms.
GROUP_QUERIES, GROUP_TERMS, CELLS = 256, 1 << 15, 1 << 21
INDEX = "block long, term string, places array<int>, impacts binary, counts array<int>, ids array<long>, lengths array<int>, prints array<binary>"


def terms(text: Column) -> Column:
    """The terms of a text, in order."""
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(TERM), F.lit(0))


def _tables() -> tuple[np.ndarray, np.ndarray]:
    letter, lower = np.zeros(256, bool), np.arange(256, dtype=np.uint8)
    for lo, hi in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
        letter[lo:hi] = True
    lower[0x41:0x5B] += 32
    return letter, lower


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of strings without nulls, and where each string starts, and the last ends."""
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8))[at[0] : at[-1]], at - at[0]


def _ends(data: np.ndarray, at: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the terms of texts laid end to end; none goes over from one text to the next."""
    inside, edge = letter[data], np.zeros(len(data) + 1, bool)
    edge[at] = True
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    return np.flatnonzero(inside & (~before | edge[:-1])), np.flatnonzero(inside & (~after | edge[1:])) + 1


def _counted(docs: DataFrame) -> tuple[int, int]:
    """How many documents have a term, and how many terms they have together."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letter, _ = _tables()
        docs, found = 0, 0
        for batch in batches:
            data, at = _bytes(batch.column("text"))
            starts, _ = _ends(data, at, letter)
            docs, found = docs + len(np.unique(np.searchsorted(at, starts, "right"))), found + len(starts)
        yield pa.RecordBatch.from_arrays([pa.array([docs], pa.int64()), pa.array([found], pa.int64())], ["docs", "terms"])

    return tuple(docs.select("text").mapInArrow(count, "docs long, terms long").agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first())


def impact(counts: np.ndarray, lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Exact impacts of terms that occur `counts` times in documents of so many terms."""
    m = 50 + 50 * lengths.astype(np.int64) * n_docs // n_terms
    return 1_000_000_000 * counts.astype(np.int64) // (1000 * counts.astype(np.int64) + 20 * m)


def _cuts(at: np.ndarray, most_docs: int, most_bytes: int) -> list[int]:
    """Where to cut texts that start at `at` into blocks."""
    cuts = [0]
    while cuts[-1] < len(at) - 1:
        far = int(np.searchsorted(at, at[cuts[-1]] + most_bytes, "right")) - 1
        cuts.append(min(max(far, cuts[-1] + 1), cuts[-1] + most_docs, len(at) - 1))
    return cuts


def _lists(starts: np.ndarray, values: np.ndarray) -> pa.Array:
    """Lists of values, which start at `starts`."""
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)), pa.int32()), pa.array(values, pa.int32()))


def _block(block: int, ids: pa.Array, data: np.ndarray, at: np.ndarray, n_docs: int, n_terms: int) -> pa.RecordBatch:
    letter, lower = _tables()
    data = lower[data]
    starts, ends = _ends(data, at, letter)
    place = (np.searchsorted(at, starts, "right") - 1).astype(np.int64)
    lengths = np.bincount(place, minlength=len(at) - 1)
    own, other = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.uint64)
    edges = np.searchsorted(starts, at[_cuts(at, len(at), SLICE)])
    for lo, hi in zip(edges[:-1], edges[1:]):
        if hi > lo:
            piece = data[starts[lo] : ends[hi - 1]]
            for hashes, base in ((own, hashing.WORD[0]), (other, hashing.WORD[1])):
                hashes[lo:hi] = hashing.span_hashes(piece, starts[lo:hi] - starts[lo], ends[lo:hi] - starts[lo], base)
    order = np.argsort(own, kind="stable")  # so places ascend within a term
    new_term = lambda: np.append(True, own[order][1:] != own[order][:-1]) if len(order) else np.zeros(0, bool)
    fresh = new_term()
    if np.any(~fresh[1:] & (other[order][1:] != other[order][:-1])):  # two terms with one hash
        order = np.lexsort((place, other, own))
        fresh = new_term() | np.append(True, other[order][1:] != other[order][:-1])
    pair = np.flatnonzero(fresh | np.append(True, place[order][1:] != place[order][:-1])[: len(order)])
    counts, places = np.diff(np.append(pair, len(order))), place[order][pair]
    first = np.flatnonzero(fresh)
    lists = np.searchsorted(pair, first)
    shown = order[first]
    lens = ends[shown] - starts[shown]
    bytes_at = np.append(0, np.cumsum(lens))
    told = data[np.repeat(starts[shown] - bytes_at[:-1], lens) + np.arange(bytes_at[-1])]
    n = len(first)
    names = pa.StringArray.from_buffers(n, pa.py_buffer(bytes_at.astype(np.int32).tobytes()), pa.py_buffer(told.tobytes()))
    steps = (-(-impact(counts, lengths[places], n_docs, n_terms) // STEP)).astype(np.uint8) if len(places) else np.zeros(0, np.uint8)
    bounds = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.append(lists, len(places)).astype(np.int32).tobytes()), pa.py_buffer(steps.tobytes())])
    prints = [hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in zip(at[:-1], at[1:])]
    none = lambda kind, k: pa.nulls(k, kind)
    head = {"ids": pa.array([ids.to_pylist()], pa.list_(pa.int64())), "lengths": pa.array([lengths.tolist()], pa.list_(pa.int32())), "prints": pa.array([prints], pa.list_(pa.binary()))}
    columns = {
        "block": pa.array(np.full(n + 1, block), pa.int64()),
        "term": pa.concat_arrays([names, none(pa.string(), 1)]),
        "places": pa.concat_arrays([_lists(lists, places), none(pa.list_(pa.int32()), 1)]),
        "impacts": pa.concat_arrays([bounds, none(pa.binary(), 1)]),
        "counts": pa.concat_arrays([_lists(lists, counts), none(pa.list_(pa.int32()), 1)]),
    } | {k: pa.concat_arrays([none(v.type, n), v]) for k, v in head.items()}
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def build(docs: DataFrame) -> DataFrame:
    """The index of docs (doc_id, text), as written: rows of terms (block, term, places, impacts, counts), and one row for
    each block without a term (ids, lengths and prints of its documents)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            data, at = _bytes(batch.column("text"))
            cuts = _cuts(at, BLOCK_DOCS, BLOCK_BYTES)
            for a, b in zip(cuts[:-1], cuts[1:]):
                yield _block(block, batch.column("doc_id")[a:b], data[at[a] : at[b]], at[a : b + 1] - at[a], n_docs, max(1, n_terms))
                block += 1

    with common.batches_of(docs.sparkSession, BATCH):
        n_docs, n_terms = _counted(rows)
        return common.stash(rows.mapInArrow(index, INDEX), "index")


def _bounds(asked: dict[int, list[tuple[int, int]]], n_queries: int, k: int):
    """asked: for each term's number the numbers of the queries with it, and its weight there. A function from a block's
    rows (block, number, places, impacts) to (block, query, place, low, high), of all that may be among the block's best k."""

    def bound(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        numbers = table.column("number").to_pylist()
        lists = table.column("places").combine_chunks()
        places = lists.flatten().to_numpy(zero_copy_only=False)
        term = np.repeat(np.arange(len(numbers)), np.diff(lists.offsets.to_numpy()))
        steps = np.frombuffer(b"".join(table.column("impacts").to_pylist()), np.uint8)
        weights = np.zeros((len(numbers), n_queries))
        for i, number in enumerate(numbers):
            for query, weight in asked[number]:
                weights[i, query] = weight
        held, dense = np.unique(places, return_inverse=True)
        high, low = np.zeros((2, len(held), n_queries))
        chunk = max(1, CELLS // len(numbers))
        order = np.argsort(dense, kind="stable")
        edges = np.searchsorted(dense[order], np.arange(0, len(held) + chunk, chunk))
        for c, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])):
            at, size = order[lo:hi], min(chunk, len(held) - c * chunk)
            if size <= 0:
                break
            cells = np.zeros((size, len(numbers)))
            cells[dense[at] - c * chunk, term[at]] = steps[at]
            top = STEP * (cells @ weights)  # whole numbers far below 2**53, so exact
            high[c * chunk : c * chunk + size] = top
            low[c * chunk : c * chunk + size] = top - (STEP - 1) * ((cells > 0) @ weights)
        floor = np.partition(low, len(held) - k, axis=0)[len(held) - k] if len(held) > k else np.zeros(n_queries)
        doc, query = np.nonzero((high > 0) & (high >= floor))
        return pa.table({"block": pa.array(np.full(len(doc), table.column("block")[0].as_py()), pa.int64()), "query": pa.array(query, pa.int32()), "place": pa.array(held[doc], pa.int32()), "low": pa.array(low[doc, query].astype(np.int64)), "high": pa.array(high[doc, query].astype(np.int64))})

    return bound


def _best(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k of each group, reduced to k in each task before the shuffle; rank is their place."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def _searched(index: DataFrame, asked: DataFrame, n_docs: int, k: int) -> DataFrame:
    """(row, rank, doc_id, score) for a group of queries: asked has a row (row, term) for each query's distinct terms."""
    spark = index.sparkSession
    wanted = F.broadcast(asked.select("term").distinct())  # at most some GROUP_TERMS
    held = index.where("term is not null").join(wanted, "term").groupBy("term").agg(F.sum(F.size("places")).alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log((F.lit(2.0) * n_docs + 2) / (F.lit(2.0) * F.col("df") + 1))).cast("long")
    weighed = asked.join(held.select("term", weight.alias("weight")), "term").where("weight > 0").collect()
    if not weighed:
        return spark.createDataFrame([], "row long, rank int, doc_id long, score long")
    numbers = {t: i for i, t in enumerate(sorted({r["term"] for r in weighed}))}
    queries = {q: i for i, q in enumerate(sorted({r["row"] for r in weighed}))}
    by_term: dict[int, list[tuple[int, int]]] = {}
    for r in weighed:
        by_term.setdefault(numbers[r["term"]], []).append((queries[r["row"]], r["weight"]))
    terms_of = F.broadcast(spark.createDataFrame(list(numbers.items()), "term string, number int"))
    shares = F.broadcast(spark.createDataFrame([(queries[r["row"]], numbers[r["term"]], r["weight"]) for r in weighed], "query int, number int, weight long"))
    rows_of = F.broadcast(spark.createDataFrame([(i, q) for q, i in queries.items()], "query int, row long"))
    postings = index.where("term is not null").join(terms_of, "term")
    level1 = postings.select("block", "number", "places", "impacts").groupBy("block")
    bounded = common.stash(level1.applyInArrow(_bounds(by_term, len(queries), k), "block long, query int, place int, low long, high long"), "bounds")
    # The score that k documents reach at least; none where fewer hold a term.
    floors = _best(bounded.select("query", "low"), ["query"], [F.col("low").desc()], k).groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min("low").alias("low"))
    floors = floors.select("query", F.when(F.col("n") >= k, F.col("low")).otherwise(0).alias("floor"))
    open_ = bounded.join(F.broadcast(floors), "query").where("high >= floor").select("block", "query", "place")
    heads = index.where("term is null").select("block", "ids", "lengths", "prints")
    at = lambda c: F.get(c, F.col("place"))
    known = open_.join(heads, "block").select("block", "query", "place", at("ids").alias("doc_id"), at("lengths").alias("length"), at("prints").alias("print"))
    known = common.stash(_best(known, ["query", "print"], [F.asc_nulls_last("doc_id"), F.col("block"), F.col("place")], k).drop("rank"), "candidates")
    level2 = postings.select("block", "number", "places", "counts")
    hits = known.join(shares, "query").join(level2, ["block", "number"])
    tf = F.get("counts", F.array_position("places", F.col("place")).cast("int") - 1).cast("long")
    hits = hits.select("query", "block", "place", "doc_id", "length", "weight", tf.alias("tf")).where("tf is not null")
    n_terms = F.lit(max(1, index.where("term is null").select(F.explode("lengths").alias("n")).agg(F.sum("n")).first()[0] or 1))
    m = F.lit(50).cast("long") + F.call_function("div", F.lit(50).cast("long") * F.col("length") * F.lit(n_docs), n_terms)
    share = F.col("weight") * F.call_function("div", F.lit(1_000_000_000).cast("long") * F.col("tf"), F.lit(1000).cast("long") * F.col("tf") + F.lit(20).cast("long") * m)
    scored = hits.groupBy("query", "block", "place", "doc_id").agg(F.sum(share).alias("score")).where("score > 0")
    best = _best(scored, ["query"], [F.col("score").desc(), F.asc_nulls_last("doc_id"), F.col("block"), F.col("place")], k)
    return best.join(rows_of, "query").select("row", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(index: DataFrame, queries: DataFrame, k: int = 50) -> DataFrame:
    """The k best documents for each row of queries (item_id, text): item_id, rank (from 1), doc_id, score."""
    spark = index.sparkSession
    sized = index.where("term is null").select(F.explode("lengths").alias("n")).agg(F.count_if(F.col("n") > 0)).first()[0]
    rows = common.stash(queries.select("item_id", F.array_distinct(terms(F.coalesce(F.col("text"), F.lit("")))).alias("terms")).withColumn("row", F.monotonically_increasing_id()), "queries")
    n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    groups = max(1, -(-n // GROUP_QUERIES), -(-total // GROUP_TERMS))
    out = None
    for g in range(groups):
        mine = rows.where(F.pmod(F.xxhash64("row"), F.lit(groups)) == g)
        found = _searched(index, mine.select("row", F.explode("terms").alias("term")), sized, k)
        found = common.stash(found, "found") if groups > 1 else found
        out = found if out is None else out.unionByName(found)
    return out.join(rows.select("row", "item_id"), "row").select("item_id", "rank", "doc_id", "score")


def rank(docs: DataFrame, queries: DataFrame, k: int = 50) -> DataFrame:
    """The k best documents of docs for each row of queries."""
    return search(build(docs), queries, k)
