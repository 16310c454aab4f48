"""Exact dedup against a persistent index of digests, bucketed and sorted by digest.

Texts are equal when they are identical without their spaces, which their SHA-256 tells. The index is a table in buckets by
digest, sorted by digest within files; new data is dealt into the same buckets, anti-joined with the index by a sort-merge
join that leaves the index where it lies, and what the index didn't have is appended. Of equal new texts the one with
the most code points stays, then that with the smallest doc_id; what the index holds already stays whatever comes later.

Equal texts are first counted and reduced to their best row, map-side too, so a text that a third of all rows share is one
row of the join; rows learn their group's outcome by a join that broadcasts the groups of more than a thousandth of all
rows, under a thousand of them. An index entry names its batch: a batch that is added again, after a crash or by a retry, is
judged as the first time and appends only what is missing.

Edge cases: a null text is empty, and all texts of spaces alone equal it. Of rows with equal text, length and doc_id one
stays, whichever; a null doc_id comes after others. Texts are read whole. An empty table gives no rows and appends nothing.
Other columns are ignored by `add` and kept by `drop_known`, whatever their names.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfold.llm import common
from inkfold.sources.scratch import shared_folder

ENTRY = "digest binary, batch string, doc_id bigint, points bigint, copies bigint"


def digest(text: Column) -> Column:
    """SHA-256 (lowercase hex) of a text without its spaces."""
    return F.sha2(F.translate(F.coalesce(text, F.lit("")), common.SPACES, "").cast("binary"), 256)


def index(spark: SparkSession, path: str, buckets: int = 64) -> str:
    """The name of the index table at path, made if it isn't there: a row for each digest, in so many buckets. The number is
    part of the folder's name, as an index keeps the number that it was made with."""
    place = f"{path.rstrip('/')}/digests-in-{int(buckets)}"
    name = f"inkfold_digests_{uuid.uuid5(uuid.NAMESPACE_URL, place).hex}"
    safe = re.sub(r"(['\\])", r"\\\1", place)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({ENTRY}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {int(buckets)} BUCKETS LOCATION '{safe}'")
    spark.catalog.refreshTable(name)
    return name


def _buckets(spark: SparkSession, name: str) -> int:
    told = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").where("col_name = 'Num Buckets'").first()
    return int(told["data_type"])


def _without(groups: DataFrame, entries: DataFrame) -> DataFrame:
    """The groups whose digest isn't among the entries, which stay in their buckets."""
    return groups.hint("merge").join(entries.select("digest"), "digest", "left_anti")


def append(groups: DataFrame, name: str, batch: str) -> None:
    """Append the groups (digest, doc_id, points, n) that the index lacks, a file for each bucket."""
    spark = groups.sparkSession
    rows = _without(groups, spark.table(name)).select("digest", F.lit(batch).alias("batch"), "doc_id", "points", F.col("n").alias("copies"))
    rows.repartition(_buckets(spark, name), "digest").sortWithinPartitions("digest").write.insertInto(name)
    spark.catalog.refreshTable(name)


def compact(spark: SparkSession, name: str, path: str) -> str:
    """The index again, at another path, with one sorted file for each bucket; its name."""
    n = _buckets(spark, name)
    fresh = index(spark, path, n)
    spark.table(name).repartition(n, "digest").sortWithinPartitions("digest").write.insertInto(fresh, overwrite=True)
    spark.catalog.refreshTable(fresh)
    return fresh


def add(docs: DataFrame, name: str, batch: str) -> DataFrame:
    """Judge docs against the index and each other, and append what is new: doc_id, keep_id (doc_id of the row that stays),
    group_size (equal texts in docs), kept, text_sha256, known (an earlier batch has the text), and row (of docs as read once)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(digest(F.col("text"))).alias("digest"), F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("points"))
    return _judged(common.stash(rows.withColumn("row", F.monotonically_increasing_id()), "digested"), name, batch)


def _judged(rows: DataFrame, name: str, batch: str) -> DataFrame:
    spark = rows.sparkSession
    best = F.min(F.struct((-F.col("points")).alias("less"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("best")
    groups = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), best)
    groups = common.stash(groups.select("digest", "n", "best.doc_id", "best.row", (-F.col("best.less")).alias("points")), "groups")
    earlier = spark.table(name).where(F.col("batch") != batch)
    fresh = _without(groups, earlier).select("digest", "n", F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"), F.lit(False).alias("known"))
    held = groups.hint("merge").join(earlier.select("digest", F.col("doc_id").alias("keep_id")), "digest")
    outcome = fresh.unionByName(held.select("digest", "n", "keep_id", F.lit(None).cast("long").alias("keep_row"), F.lit(True).alias("known")))
    outcome = common.stash(outcome, "outcomes")
    append(groups.join(outcome.where("not known").select("digest"), "digest", "left_semi"), name, batch)
    told = common.join_counted(rows.select("doc_id", "digest", "row"), outcome, ["digest"])
    kept = F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False))
    return told.select("doc_id", "keep_id", F.col("n").cast("long").alias("group_size"), kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "known", "row")


def drop_known(docs: DataFrame, name: str, batch: str) -> DataFrame:
    """docs, with all columns, without those that equal an earlier text of docs or of the index, which learns the rest."""
    held = common.stash(docs.select(F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("row")), "rows")
    rows = held.select(F.col("doc.doc_id").cast("long").alias("doc_id"), F.unhex(digest(F.col("doc.text"))).alias("digest"), F.char_length(F.coalesce("doc.text", F.lit(""))).cast("long").alias("points"), "row")
    kept = _judged(rows, name, batch).where("kept").select("row")
    return held.join(kept, "row", "left_semi").select("doc.*")


def dedup(docs: DataFrame) -> DataFrame:
    """docs judged against each other, by a new index in the shared folder: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    name = index(spark, f"{shared_folder(spark)}/inkfold/index-{uuid.uuid4().hex}", max(8, common.spark_partitions(spark)))
    return add(docs, name, "all").drop("known", "row")
