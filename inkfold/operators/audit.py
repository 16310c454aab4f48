"""A hash-chained audit log that holds counts only: appended per team in order of id, verified in parallel.

An event's hash covers the hash before it in its team's chain, so appending is sequential within a team; it streams
over the team's sorted rows and keeps one hash. Verification compares neighbours and needs no order of work.
"""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkfold.functions.text import canonical_json, hmac_sha256, sorted_map

GENESIS = "0" * 64
FIELDS = ("team_id", "api_key_id", "session_id", "route", "provider", "entity_counts", "blocked", "prompt_tokens", "completion_tokens", "latency_ms")


def payload(columns: dict[str, Column] | None = None) -> Column:
    """The canonical JSON of an event's ten business fields, by default the columns of the same names."""
    c = {f: F.col(f) for f in FIELDS} | (columns or {})
    kinds = {"entity_counts": "map<string,bigint>", "blocked": "boolean", "prompt_tokens": "bigint", "completion_tokens": "bigint", "latency_ms": "bigint"}
    c = {f: v.cast(kinds.get(f, "string")) for f, v in c.items()}
    c["entity_counts"] = sorted_map(F.coalesce(c["entity_counts"], F.create_map().cast("map<string,bigint>")))
    c["blocked"] = F.coalesce(c["blocked"], F.lit(False))
    return canonical_json(**c)


def _chain(key: bytes):
    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = ""
        for batch in batches:
            before, after = [], []
            for place, head, body in zip(*(batch.column(c).to_pylist() for c in ("place", "head", "payload"))):
                last = head if place == 1 else last
                before.append(last)
                last = hmac.new(key, (last + body).encode(), hashlib.sha256).hexdigest()
                after.append(last)
            rest = [c for c in batch.schema.names if c not in ("place", "head", "payload")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(before, pa.string()), pa.array(after, pa.string())], [*rest, "prev_hash", "event_hash"])

    return chain


def last_hashes(log: DataFrame) -> DataFrame:
    """(team_id, head): the hash of each team's last event."""
    return log.groupBy("team_id").agg(F.max_by("event_hash", "id").alias("head"))


def append(events: DataFrame, key: bytes, log: DataFrame | None = None, heads: DataFrame | None = None) -> DataFrame:
    """events (id and the business fields) with prev_hash and event_hash, after what log holds, or after heads as `last_hashes`
    gives them. To be written in append mode."""
    rows = events.withColumn("payload", payload())
    heads = last_hashes(log) if log is not None and heads is None else heads
    if heads is None:
        rows = rows.withColumn("head", F.lit(GENESIS))
    else:
        rows = rows.join(heads.select("team_id", "head"), "team_id", "left").withColumn("head", F.coalesce("head", F.lit(GENESIS)))
    # A window keeps a team's rows in one task. A repartition doesn't: the join's own one would replace it, and that is read
    # in other pieces where the heads turn out small enough to be broadcast.
    ordered = rows.withColumn("place", F.row_number().over(Window.partitionBy("team_id").orderBy("id")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema) + ", prev_hash string, event_hash string"
    return ordered.select(*events.columns, "place", "head", "payload").mapInArrow(_chain(key), schema)


#: Ids are serial numbers; so many of them in a row make a block.
BLOCK = 1 << 16


def verified(log: DataFrame, key: bytes) -> DataFrame:
    """log with `intact`: whether an event's hash fits its fields and its previous hash is that of the event before it. A
    team's log is verified in blocks of ids, each of which gets the last hash of the block before: no task reads all of a
    team's events, however many it has."""
    rows = log.withColumn("_block", F.floor(F.col("id") / BLOCK))
    last = rows.groupBy("team_id", "_block").agg(F.max_by("event_hash", "id").alias("_last"))
    heads = last.select("team_id", "_block", F.lag("_last", 1, GENESIS).over(Window.partitionBy("team_id").orderBy("_block")).alias("_head"))
    rows = rows.join(heads, ["team_id", "_block"])
    before = F.coalesce(F.lag("event_hash", 1).over(Window.partitionBy("team_id", "_block").orderBy("id")), "_head")
    expected = hmac_sha256(key, F.concat(F.col("prev_hash"), payload()))
    intact = F.coalesce((F.col("prev_hash") == before) & (F.col("event_hash") == expected), F.lit(False))
    return rows.withColumn("intact", intact).select(*log.columns, "intact")


def verify(log: DataFrame, key: bytes) -> DataFrame:
    """A row for each team: team_id, n_events, n_broken, valid. A log without events has no rows and is valid."""
    return verified(log, key).groupBy("team_id").agg(F.count(F.lit(1)).alias("n_events"), F.count_if(~F.col("intact")).alias("n_broken"), F.min("intact").alias("valid"))


def blocked_event(requests: DataFrame) -> DataFrame:
    """The audit events of blocked requests (team_id, api_key_id, route, provider, offending): each offending type counts one,
    and there is neither a session nor tokens nor a latency."""
    none = lambda kind: F.lit(None).cast(kind)
    return requests.select(
        "id", "team_id", "api_key_id", none("string").alias("session_id"), "route", "provider",
        F.map_from_entries(F.transform("offending", lambda t: F.struct(t, F.lit(1).cast("long")))).alias("entity_counts"), F.lit(True).alias("blocked"),
        none("bigint").alias("prompt_tokens"), none("bigint").alias("completion_tokens"), none("bigint").alias("latency_ms"),
    )


def unlinked(events: DataFrame) -> DataFrame:
    """events without their session ids."""
    return events.withColumn("session_id", F.lit(None).cast("string"))


def written(spark: SparkSession, path: str) -> DataFrame | None:
    """The log's table at path; None before anything is in it."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def write(log: DataFrame, path: str) -> None:
    """Append to the log's table; there is no way to overwrite it."""
    log.write.mode("append").parquet(path)


def write_or_report(events: DataFrame, key: bytes, path: str, sink: Callable[[DataFrame, str], None] = write) -> str | None:
    """Chain events to the log at path and write them as far as possible: once as they are, and if that fails once more without
    session ids. Hashes cover those, so what is retried is chained anew. An answer must not fail for its audit event, so the
    last error is given, not raised; None if the events are written."""
    error = None
    for rows in (events, unlinked(events)):
        try:
            sink(append(rows, key, written(events.sparkSession, path)), path)
            return None
        except Exception as e:  # noqa: BLE001 - whatever hinders the sink is reported
            error = str(e).splitlines()[0] if str(e) else type(e).__name__
    return error
