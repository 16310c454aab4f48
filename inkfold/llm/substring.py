"""Substring dedup by a compacted de Bruijn graph of token k-mers.

The graph's edges are windows of 50 words, its nodes the 49 words that two windows in a row share. Only those windows can
repeat whose smallest 16-mer repeats in another document, so each document's windows are first compacted where nothing
can branch for sure: a maximal run of windows with one smallest 16-mer is one edge wherever all runs with that 16-mer are
equal. Runs with a 16-mer that has several are split into their windows again, one holder for each run. Edges that repeat
make the graph: Spark counts what enters and leaves each node, links the edges at nodes with one in and one out whose
first source goes on, and contracts these paths by doubling joins. What comes out are source coordinates: for each path the
first document that holds it, and long spans of other documents. An edge's identity is a cryptographic digest of its
words, read at its coordinates, so spans are equal in their words and not only in rolling hashes.

Edge cases: a null, empty or blank text has no words. A text of fewer than 50 words has no window. A null id is neither
smaller nor larger than others, so nothing of such rows is removed. Rows that repeat an id don't remove from each other.
Very long texts are taken whole. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.llm import common, hashing

SPAN, MER = 50, 16
NODE = SPAN - 1


class Words:
    """The words of a text, joined by one space, and their places."""

    def __init__(self, text: str):
        self.text = b" ".join(text.encode("utf-8", "replace").split())
        data = np.frombuffer(self.text, np.uint8)
        self.starts, self.ends = hashing.spans(data, hashing.space_table())
        self.hashes = hashing.span_hashes(data, self.starts, self.ends)

    def digests(self, starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
        """A cryptographic digest of each run of words, as rows of 64-bit numbers."""
        joined = b"".join(hashlib.blake2b(self.text[a:b], digest_size=size).digest() for a, b in zip(self.starts[starts].tolist(), self.ends[ends - 1].tolist()))
        return np.frombuffer(joined, "<i8").reshape(-1, size // 8)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: list[tuple] = []
        for doc_id, tag, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "tag", "text"))):
            words = Words(text)
            if len(words.hashes) < SPAN:
                continue
            least = sliding_window_view(hashing.run_hashes(words.hashes, MER), SPAN - MER + 1).min(axis=1)
            starts = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
            ends = np.append(starts[1:], len(least)) + SPAN - 1
            found.append((least[starts], words.digests(starts, ends, 8)[:, 0], np.full(len(starts), doc_id), np.full(len(starts), tag), starts, ends - starts))
        if found:
            mer, run, doc, tag, start, size = (np.concatenate(c) for c in zip(*found))
            yield pa.RecordBatch.from_arrays([_signed(mer), pa.array(run), pa.array(doc), pa.array(tag), pa.array(start, pa.int32()), pa.array(size, pa.int32())], ["mer", "run", "doc_id", "tag", "start", "size"])


_EDGE = "one long, two long, left long, right long, doc_id long, tag long, start int, size int, whole boolean"


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a document's parts, with the hashes of their nodes: an unsplit run is one, others one for each window."""
    for batch in batches:
        found: list[tuple] = []
        for doc_id, tag, text, parts in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "tag", "text", "parts"))):
            words = Words(text)
            nodes = hashing.run_hashes(words.hashes, NODE).view(np.int64)
            split = [np.arange(p["start"], p["start"] + p["size"] - SPAN + 1) for p in parts if p["split"]]
            whole = [p for p in parts if not p["split"]]
            if split:
                at = np.unique(np.concatenate(split))
                digests = words.digests(at, at + SPAN, 16)
                found.append((digests[:, 0], digests[:, 1], nodes[at], nodes[at + 1], np.full(len(at), doc_id), np.full(len(at), tag), at, np.full(len(at), SPAN), np.zeros(len(at), bool)))
            if whole:
                mer, run, start, size = (np.array([p[k] for p in whole], np.int64) for k in ("mer", "run", "start", "size"))
                found.append((mer, run, nodes[start], nodes[start + size - NODE], np.full(len(start), doc_id), np.full(len(start), tag), start, size, np.ones(len(start), bool)))
        if found:
            one, two, left, right, doc, tag, start, size, whole = (np.concatenate(c) for c in zip(*found))
            columns = [*map(_signed, (one, two, left, right)), pa.array(doc), pa.array(tag), pa.array(start, pa.int32()), pa.array(size, pa.int32()), pa.array(whole)]
            yield pa.RecordBatch.from_arrays(columns, ["one", "two", "left", "right", "doc_id", "tag", "start", "size", "whole"])


def compact(edges: DataFrame) -> DataFrame:
    """Contract nonbranching paths. edges: edge, left, right, and its source doc_id, tag, start and size, one row for each
    edge. Gives edge, head (first edge of its path) and offset (words from the head's start), for edges in such a path
    that aren't its head."""
    out, into = (edges.groupBy(F.col(side).alias("node")).agg(F.count(F.lit(1)).alias(n)) for side, n in (("left", "n_out"), ("right", "n_in")))
    through = out.where("n_out = 1").join(into.where("n_in = 1"), "node").select("node")
    end = edges.select(F.col("right").alias("node"), F.col("edge").alias("head"), F.col("doc_id").alias("d"), F.col("tag").alias("t"), (F.col("start") + F.col("size") - NODE).alias("next"), (F.col("size") - NODE).alias("offset"))
    follows = (F.col("d") == F.col("doc_id")) & (F.col("t") == F.col("tag")) & (F.col("next") == F.col("start"))
    begin = edges.select(F.col("left").alias("node"), "edge", "doc_id", "tag", "start")
    links = common.stash(begin.join(through, "node").join(end, "node").where(follows).select("edge", "head", F.col("offset").cast("long").alias("offset")), "links")
    while True:  # a path of n edges takes log2(n) rounds; starts grow along it, so there is no circle
        further = links.select(F.col("edge").alias("head"), F.col("head").alias("far"), F.col("offset").alias("more"))
        links = common.stash(links.join(further, "head", "left").select("edge", F.coalesce("far", "head").alias("head"), (F.col("offset") + F.coalesce("more", F.lit(0))).alias("offset"), F.col("far").isNotNull().alias("moved")), "links")
        if links.where("moved").isEmpty():
            return links.drop("moved")


def _cut(emit_text: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            spans = batch.column("spans").to_pylist() if "spans" in batch.schema.names else [None] * batch.num_rows
            for text, own in zip(batch.column("text").to_pylist(), spans):
                words = text.encode("utf-8", "replace").split()
                gone = np.zeros(len(words) + 1, np.int64)
                for span in own or ():
                    gone[span["start"]] += 1
                    gone[span["end"]] -= 1
                keep = np.cumsum(gone[:-1]) == 0
                left = b" ".join(words if keep.all() else [w for w, k in zip(words, keep) if k])
                rows.append((len(words), int(len(words) - keep.sum()), hashlib.sha256(left).hexdigest(), left.decode() if emit_text else None))
            n, removed, sha, left = zip(*rows) if rows else ((),) * 4
            columns = [batch.column("doc_id"), batch.column("tag"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(left, pa.string())] * emit_text, ["doc_id", "tag", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * emit_text)

    return cut


def repeats(docs: DataFrame) -> DataFrame:
    """The repeated spans: doc_id, tag (of the text), spans, an array of (start, end) in words. Each word of a 50-word window
    that also starts in a document with a smaller id lies in one of them."""
    texts = common.ids_and_texts(docs).withColumn("tag", common.text_tag()).where("doc_id is not null")
    runs = common.stash(texts.mapInArrow(_runs, "mer long, run long, doc_id long, tag long, start int, size int"), "runs")
    # A 16-mer of one document only can't be in a repeated window.
    mers = runs.groupBy("mer").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count(F.lit(1)).alias("n")).where("a < b")
    shared = common.stash(common.join_counted(runs, common.stash(mers.select("mer", "n"), "mers"), ["mer"]).drop("n").distinct(), "shared")
    firsts = common.stash(shared.groupBy("mer", "run").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows")), "firsts")
    kinds = common.stash(firsts.groupBy("mer").agg(F.count(F.lit(1)).alias("n")), "kinds")
    firsts = common.join_counted(firsts, kinds, ["mer"]).select("mer", "run", "first", F.col("rows").alias("n"), (F.col("n") > 1).alias("split"))
    owned = common.stash(common.join_counted(shared, common.stash(firsts, "firsts"), ["mer", "run"]).drop("n"), "owned")
    parts = owned.where("doc_id = first").groupBy("doc_id", "tag").agg(F.collect_list(F.struct("mer", "run", "start", "size", "split")).alias("parts"))
    edges = common.stash(texts.join(parts, ["doc_id", "tag"]).mapInArrow(_edges, _EDGE), "edges")
    source = F.min(F.struct("doc_id", "tag", "start")).alias("source")
    repeated = edges.groupBy("one", "two").agg(source, F.max("doc_id").alias("last"), F.min("left").alias("left"), F.min("right").alias("right"), F.min("size").alias("size"), F.max("whole").alias("whole"), F.count(F.lit(1)).alias("n"))
    repeated = common.stash(repeated.where("whole or source.doc_id < last").select("one", "two", F.xxhash64("one", "two").alias("edge"), "source.*", "left", "right", "size", "whole", "n"), "repeated")
    paths = compact(repeated.select("edge", "left", "right", "doc_id", "tag", "start", "size"))
    least = common.stash(repeated.where("not whole").select("one", "two", F.col("doc_id").alias("a"), "n"), "least")
    windows = common.join_counted(edges.where("not whole"), least, ["one", "two"]).where("doc_id > a").select("one", "two", "doc_id", "tag", "start", "size")
    later = owned.where("doc_id > first")
    held = later.where("not split").select(F.col("mer").alias("one"), F.col("run").alias("two"), "doc_id", "tag", "start", "size").unionByName(windows)
    held = held.select(F.xxhash64("one", "two").alias("edge"), "doc_id", "tag", "start", (F.col("start") + F.col("size")).alias("end"))
    # The edges of a path lie in a document one after another: one span, unless the document holds but parts of it.
    placed = held.join(paths, "edge", "left").withColumns({"head": F.coalesce("head", "edge"), "begin": F.col("start") - F.coalesce("offset", F.lit(0))})
    placed = placed.groupBy("doc_id", "tag", "head", "begin").agg(F.min("start").alias("lo"), F.max("end").alias("up"), F.sum(F.col("end") - F.col("start") - NODE).alias("covered"), F.collect_set(F.struct("start", "end")).alias("own"))
    whole = F.array(F.struct(F.col("lo").alias("start"), F.col("up").alias("end")))
    spans = placed.select("doc_id", "tag", F.when(F.col("covered") == F.col("up") - F.col("lo") - NODE, whole).otherwise(F.col("own")).alias("spans"))
    equal = later.where("split").select("doc_id", "tag", F.array(F.struct("start", (F.col("start") + F.col("size")).alias("end"))).alias("spans"))
    return common.stash(spans.unionByName(equal).groupBy("doc_id", "tag").agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans")), "spans")


def remove_repeats(docs: DataFrame, emit_text: bool = True) -> DataFrame:
    """A row for each document: doc_id, n_words, n_removed (words in a 50-word window that also starts in a document with
    a smaller id), kept_sha256 and, with emit_text, kept_text, the other words joined by spaces."""
    texts, spans = common.ids_and_texts(docs).withColumn("tag", common.text_tag()), repeats(docs)
    schema = "doc_id long, tag long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * emit_text
    whole = texts.mapInArrow(_cut(emit_text), schema).join(spans.select("doc_id", "tag"), ["doc_id", "tag"], "left_anti")
    return whole.unionByName(texts.join(spans, ["doc_id", "tag"]).mapInArrow(_cut(emit_text), schema)).drop("tag")
