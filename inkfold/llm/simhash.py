"""SimHash near-dedup by an inverted index over byte positions with count filtering.

Two 64-bit fingerprints that differ in at most 4 bits agree in at least 4 of their 8 bytes. The index has a list for
each value of three byte positions, out of twenty triples of which any four agreeing positions contain one. Each pair is
tallied once, by the byte positions it shares; those under the guaranteed minimum are dropped, and the rest verified bit
by bit. Lists longer than `crowd` are not paired: within one, two fingerprints are within an even number of bits exactly
if some third value is within half as many of both, so each is linked to the values around it, and rows grow with the
list, not with its square. Equal fingerprints are one node throughout.

Edge cases: a null, empty or blank text has the fingerprint zero, and one of fewer words than a shingle has that of
the whole sequence. Long texts are hashed whole. Repeated rows each give a row; a null id is nobody's smallest. An
empty table gives no rows; other columns are ignored by `near_duplicates` and kept by `keep_first`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.llm import common, components

#: Fixed parts of the triples: in any four positions two lie in one part and a third there or in the next.
PARTS = ((0, 1, 2), (3, 4, 5), (6, 7))


def triples() -> list[tuple[int, int, int]]:
    """Twenty triples of byte positions of which every four positions contain one."""
    out = [p for p in PARTS if len(p) == 3]
    for part, after in zip(PARTS, PARTS[1:] + PARTS[:1]):
        out += [tuple(sorted((*two, one))) for two in combinations(part, 2) for one in after]
    return out


def fingerprint(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(size) - 1
    starts = (ends - size + 1)[: len(words) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    votes = np.zeros(64, np.int64)
    ends = ends[shingle - 1 :].tolist()
    for at in range(0, len(starts), 1 << 16):
        h = np.array([digest(joined[a:b], seed) for a, b in zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)])], "<u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(starts)).tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(t.encode("utf-8", "replace")) for t in batch.column("text").to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tag"), pa.array(found.view(np.int64))], ["doc_id", "tag", "print"])


def _mask(positions: tuple[int, ...]) -> int:
    m = sum(0xFF << (8 * p) for p in positions)
    return m - (1 << 64) if m >> 63 else m


def _near_links(prints: DataFrame, bits: int, crowd: int) -> DataFrame:
    """(u, v) links that join the same fingerprints into components as all pairs within `bits` bits do."""
    covers = triples()
    keys = F.array(*(F.struct(F.lit(i).alias("triple"), F.col("print").bitwiseAND(F.lit(_mask(t))).alias("value")) for i, t in enumerate(covers)))
    lists = prints.select("print", F.explode(keys).alias("key")).select("print", "key.triple", "key.value")
    crowded = common.stash(lists.groupBy("triple", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd).select("triple", "value"), "crowded")
    calm = lists.join(crowded, ["triple", "value"], "left_anti")
    # A pair meets in as many lists as it shares triples; it is tallied once, before anything is dealt.
    met = calm.withColumnRenamed("print", "u").join(calm.withColumnRenamed("print", "v"), ["triple", "value"]).where("u < v")
    pairs = met.groupBy("u", "v").agg(F.min("triple").alias("triple"))
    differ = F.col("u").bitwiseXOR(F.col("v"))
    tally = sum((F.when(differ.bitwiseAND(F.lit(_mask((p,)))) == 0, 1).otherwise(0) for p in range(8)), F.lit(0))
    links = pairs.where(tally >= 8 - bits).where(F.bit_count(differ) <= bits).select("u", "v")
    if crowded.isEmpty():
        return links
    full = common.stash(lists.join(crowded, ["triple", "value"], "left_semi").drop("value"), "full")
    # Flips of up to half the bits, outside the bytes of the triple: 16,420 rows at most, whatever the input.
    flips = [(i, f - (1 << 64) if f >> 63 else f) for i, t in enumerate(covers) for f in _flips(bits // 2) if not f & (_mask(t) % (1 << 64))]
    around = prints.sparkSession.createDataFrame(flips, "triple int, flip long")
    centres = full.join(F.broadcast(around), "triple").select("print", F.col("print").bitwiseXOR(F.col("flip")).alias("centre")).distinct()
    hubs = centres.groupBy("centre").agg(F.min("print").alias("v"), F.max("print").alias("last")).where("v < last")
    return links.unionByName(centres.join(hubs, "centre").where("print != v").select(F.col("print").alias("u"), "v").distinct())


def _flips(n: int) -> list[int]:
    """All numbers of 64 bits with at most n ones."""
    return [sum(1 << b for b in at) for k in range(n + 1) for at in combinations(range(64), k)]


def _labelled(docs: DataFrame, bits: int = 4, crowd: int = 1024) -> DataFrame:
    """doc_id, tag (of the text) and print of each document, and (no_id, doc_id, tag) of the first of its component."""
    if bits not in (0, 2, 4):
        raise ValueError("the triples of byte positions guarantee at most 4 differing bits, and long lists take an even number")
    texts = common.ids_and_texts(docs).withColumn("tag", common.text_tag())
    found = common.stash(texts.mapInArrow(_fingerprints, "doc_id long, tag long, print long"), "prints")
    nodes = found.groupBy("print").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("tag"))).alias("least"))
    label = components.labels(_near_links(nodes.select("print"), bits, crowd))
    nodes = common.stash(nodes.join(label.withColumnRenamed("node", "print"), "print", "left").select("print", "least", F.coalesce("label", "print").alias("root")), "nodes")
    least = nodes.groupBy("root").agg(F.min("least").alias("first"))
    nodes = common.stash(nodes.join(least, "root").select("print", "first"), "nodes")
    return found.join(nodes, "print")


def near_duplicates(docs: DataFrame, bits: int = 4, crowd: int = 1024) -> DataFrame:
    """A row for each document: doc_id, fingerprint (16 hexadecimal digits) and component_id (smallest doc_id linked to it)."""
    return _labelled(docs, bits, crowd).select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), F.col("first.doc_id").alias("component_id"))


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """docs, with all columns: of each component one row stays, the one with the smallest id (a null one after all others).
    Rows with one id, or none, and unlike texts are of different components and stay."""
    first = _labelled(docs, **options).select(*common.identity(F.col("first.doc_id"), F.col("first.tag"))).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), *common.identity(F.col("doc_id").cast("long"), common.text_tag()))
    kept = rows.join(first, ["no_id", "id", "tag"], "left_semi").dropDuplicates(["no_id", "id", "tag"])
    return kept.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
