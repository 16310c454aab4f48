"""The audit log as a stream's sink: each micro-batch is chained after the one before it, once, whatever crashes between.

A log is a folder: `events` has a part for each micro-batch, and `heads` a part for each micro-batch that is done, with the
last hash of every team so far. A batch's events are written first, over whatever a crashed attempt left, and its heads
last; so a batch counts when its heads are there, one that comes again then adds nothing, and chaining reads the heads
of the batch before instead of the log. Micro-batches are chained one after another, and a team's events within one in order of id.
Events that the sink refuses with their session ids are chained anew without them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkfold.operators import audit
from inkfold.sources.scratch import stored


def _replace(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def _heads(spark: SparkSession, path: str) -> DataFrame | None:
    return audit.written(spark, f"{path}/heads")


def _last_batch(heads: DataFrame | None, before: int) -> int | None:
    """The last finished batch before that one; parts are named by batch, so only their names are read."""
    return None if heads is None else heads.where(F.col("batch_id") < before).agg(F.max("batch_id")).first()[0]


def sink(path: str, key: bytes, put: Callable[[DataFrame, str], None] = _replace, report: Callable[[int, str], None] | None = None) -> Callable[[DataFrame, int], None]:
    """What a stream of events (id and the business fields) is given to, for each micro-batch: `writeStream.foreachBatch(sink(...))`.
    put writes a micro-batch's events over a path. Where it refuses them without session ids too, the error goes to report
    and the stream goes on without the batch; without a report the stream fails, and the batch comes again."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        done = _heads(spark, path)
        if done is not None and not done.where(F.col("batch_id") == batch_id).isEmpty():
            return
        last = _last_batch(done, batch_id)
        before = None if last is None else done.where(F.col("batch_id") == last).select("team_id", "head")
        part, error = f"{path}/events/batch_id={batch_id}", None
        for rows in (batch, audit.unlinked(batch)):
            try:
                put(audit.append(rows, key, heads=before), part)
                error = None
                break
            except Exception as e:  # noqa: BLE001 - whatever hinders the sink is reported
                error = e
        if error is not None:
            if report is None:
                raise error
            report(batch_id, str(error).splitlines()[0] if str(error) else type(error).__name__)
            return
        heads = audit.last_hashes(spark.read.parquet(part))
        if before is not None:
            heads = heads.unionByName(before.join(heads.select("team_id"), "team_id", "left_anti"))
        _replace(heads, f"{path}/heads/batch_id={batch_id}")

    return write


def log(spark: SparkSession, path: str) -> DataFrame:
    """The events of all finished batches, with batch_id."""
    events, done = audit.written(spark, f"{path}/events"), _heads(spark, path)
    if events is None or done is None:
        return spark.createDataFrame([], T.StructType.fromDDL("id long, team_id string, prev_hash string, event_hash string, batch_id long"))
    return events.join(F.broadcast(done.select("batch_id").distinct()), "batch_id", "left_semi")


def verified(spark: SparkSession, path: str, key: bytes, only: list[int] | None = None) -> DataFrame:
    """The log, or some batches of it, with `intact`. Ids may start anew in each batch, so it is verified batch by batch, each
    from the heads that the one before it left: batches are checked side by side."""
    rows, done = log(spark, path), _heads(spark, path)
    if done is None:
        return rows.withColumn("intact", F.lit(True))
    order = Window.partitionBy("team_id", "batch_id").orderBy("id")
    batches = done.select("batch_id").distinct().withColumn("_before", F.lag("batch_id").over(Window.orderBy("batch_id")))
    rows = rows if only is None else rows.where(F.col("batch_id").isin(only))
    heads = done.select("team_id", F.col("head").alias("_head"), F.col("batch_id").alias("_before"))
    known = rows.join(F.broadcast(batches), "batch_id").join(heads, ["team_id", "_before"], "left")
    before = F.coalesce(F.lag("event_hash", 1).over(order), "_head", F.lit(audit.GENESIS))
    expected = audit.hmac_sha256(key, F.concat(F.col("prev_hash"), audit.payload()))
    intact = F.coalesce((F.col("prev_hash") == before) & (F.col("event_hash") == expected), F.lit(False))
    return known.withColumn("intact", intact).select(*rows.columns, "intact")


def _files(spark: SparkSession, path: str) -> DataFrame:
    """(batch_id, files): a digest of the names, sizes and times of each finished batch's files; no event is read."""
    events, done = audit.written(spark, f"{path}/events"), _heads(spark, path)
    if events is None or done is None:
        return spark.createDataFrame([], "batch_id int, files string")
    told = events.select("batch_id", F.struct("_metadata.file_name", "_metadata.file_size", "_metadata.file_modification_time").alias("f")).distinct()
    told = told.join(F.broadcast(done.select("batch_id").distinct()), "batch_id", "left_semi")
    one = F.concat_ws(":", F.col("f.file_name"), F.col("f.file_size"), F.unix_micros("f.file_modification_time"))
    return told.groupBy("batch_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(one)), ",").cast("binary"), 256).alias("files"))


def verify_on(spark: SparkSession, path: str, key: bytes) -> DataFrame:
    """A row for each finished batch: batch_id, state (known, new or changed), n_events and n_broken (null for what is known).

    Batches that were intact are noted with a digest of their files, and aren't read again while that stays the same; a batch
    whose files changed is read again and reported, whether its events fit or not."""
    known = audit.written(spark, f"{path}/verified")
    files = _files(spark, path)
    if known is None:
        judged = files.withColumn("state", F.lit("new"))
    else:
        last = known.groupBy("batch_id").agg(F.max_by("files", "noted").alias("before"))
        state = F.when(F.col("before").isNull(), "new").when(F.col("before") == F.col("files"), "known").otherwise("changed")
        judged = files.join(last, "batch_id", "left").select("batch_id", "files", state.alias("state"))
    judged = stored(judged, "judged")
    # The few batches to read are named, so that the folders of others aren't opened.
    wanted = [r["batch_id"] for r in judged.where("state <> 'known'").select("batch_id").collect()]
    read = verified(spark, path, key, wanted).groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_events"), F.count_if(~F.col("intact")).alias("n_broken"))
    out = stored(judged.join(read, "batch_id", "left"), "verified")
    out.where("n_broken = 0").select("batch_id", "files", F.current_timestamp().alias("noted")).write.mode("append").parquet(f"{path}/verified")
    return out.drop("files")
