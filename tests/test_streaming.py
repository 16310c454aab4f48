"""Streams that run: chunks in any order, restarts, and sinks."""

from __future__ import annotations

import json
import time

import pytest
from pyspark.sql import functions as F

from inkfold.operators import audit, sanitize, vault
from inkfold.sources import bucketed
from inkfold.streaming import ledger, restore

WHOLE = "to [[EMAIL_000001]], [[IP_000002]] and [[EMAIL_zz [[X_12]] or [[ [[EMAIL_000001]"
KNOWN = [("s", "[[EMAIL_000001]]", "a@b.co"), ("s", "[[IP_000002]]", "10.0.0.1"), ("other", "[[EMAIL_000001]]", "no@one.co")]
RESTORED = WHOLE.replace("[[EMAIL_000001]]", "a@b.co").replace("[[IP_000002]]", "10.0.0.1")
SCHEMA = "session_id string, seq long, delta string, is_end boolean"


@pytest.fixture
def feed(spark, tmp_path):
    """A function that adds a file of chunks to a folder, and the stream over it."""

    def add(rows) -> None:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        time.sleep(0.05)

    (tmp_path / "in").mkdir()
    return add, lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))


def parts(size: int, session: str = "s", whole: str = WHOLE) -> list[tuple]:
    cut = [whole[i : i + size] for i in range(0, len(whole), size)]
    return [(session, i, p, i == len(cut) - 1) for i, p in enumerate(cut)]


def told(table, session: str) -> str:
    return "".join(r["text"] for r in table.where(f"session_id = '{session}'").orderBy("seq").collect())


def test_chunks_out_of_order_over_micro_batches_and_a_restart(spark, tmp_path, feed):
    add, stream = feed
    tokens = spark.createDataFrame(KNOWN, "session_id string, placeholder string, value string")
    own, other = parts(6), parts(9, "other", "only [[EMAIL_000001]] here")
    for rows in (own[5:9] + other[1:2], own[1:5], own[9:11] + own[2:4]):  # nothing can be told before the first chunk
        add(rows[::-1])
    out = str(tmp_path / "out")
    assert restore.run_restored(stream(), tokens, out).count() == 0
    add(own[:1] + other[:1])
    some = restore.run_restored(stream(), tokens, out)
    assert some.where("session_id = 's'").count() == 11 and "a@b.co" in told(some, "s")
    for rows in (own[11:][::-1], other[2:], own[3:5] + own[-1:]):  # the last ones come again after the end
        add(rows)
    done = restore.run_restored(stream(), tokens, out)
    assert told(done, "s") == RESTORED and told(done, "other") == "only no@one.co here"
    assert done.count() == len(own) + len(other)


def test_a_session_that_falls_silent_is_given_up(spark, tmp_path, feed):
    add, stream = feed
    tokens = spark.createDataFrame(KNOWN, "session_id string, placeholder string, value string")
    own = parts(6)
    add(own[:4] + own[6:8])  # neither the end nor what comes between
    with restore.state_store(spark):
        query = restore.restore(stream(), tokens, idle_minutes=0.02).writeStream.option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="1 second").start(str(tmp_path / "text"), format="parquet")
        deadline = time.time() + 60
        rows = []
        while time.time() < deadline and (not rows or max(r["seq"] for r in rows) < 7):
            time.sleep(1)
            try:
                rows = spark.read.schema(restore.OUT).parquet(str(tmp_path / "text")).orderBy("seq").collect()
            except Exception:  # noqa: BLE001 - nothing is written yet
                rows = []
        query.stop()
    joined = "".join(x[2] for x in own[:4] + own[6:8])
    assert "".join(r["text"] for r in rows) == joined.replace("[[EMAIL_000001]]", "a@b.co").replace("[[IP_000002]]", "10.0.0.1")


EVENT = "id long, team_id string, api_key_id string, session_id string, route string, provider string, entity_counts map<string,long>, blocked boolean, prompt_tokens int, completion_tokens int, latency_ms int"


def events(first: int, last: int) -> list[tuple]:
    return [(i, f"t{i % 3}", "k", f"s{i}", "/r", "p", {"A": i}, False, 1, 2, 3) for i in range(first, last)]


@pytest.fixture
def event_feed(spark, tmp_path):
    def add(rows) -> None:
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
        time.sleep(0.05)

    (tmp_path / "events").mkdir()
    return add, lambda: spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "events"))


def run(stream, put, checkpoint) -> None:
    stream.writeStream.foreachBatch(put).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start().awaitTermination()


def broken(spark, path: str) -> set[int]:
    return {r["id"] for r in ledger.verified(spark, path, b"k").where("not intact").collect()}


def test_a_replayed_batch_adds_nothing_to_the_log(spark, tmp_path, event_feed):
    add, stream = event_feed
    path = str(tmp_path / "log")
    add(events(0, 9))
    run(stream(), ledger.sink(path, b"k"), tmp_path / "ck")
    add(events(9, 14))
    add(events(14, 20))

    def dying(log, part):
        """Half of a batch is written, and the driver dies."""
        log.limit(2).write.mode("overwrite").parquet(part)
        raise KeyboardInterrupt

    put = ledger.sink(path, b"k", dying)
    batch = spark.createDataFrame(events(9, 14), EVENT)
    with pytest.raises(KeyboardInterrupt):
        put(batch, 1)
    assert ledger.log(spark, path).count() == 9
    run(stream(), ledger.sink(path, b"k"), tmp_path / "ck")
    log = ledger.log(spark, path)
    assert sorted(r["id"] for r in log.collect()) == list(range(20)) and not broken(spark, path)
    ledger.sink(path, b"k")(batch, 1)  # comes again after it was done
    assert ledger.log(spark, path).count() == 20 and not broken(spark, path)
    # The chain is the one that a single append gives.
    whole = {r["id"]: r["event_hash"] for r in audit.append(spark.createDataFrame(events(0, 20), EVENT), b"k").collect()}
    assert {r["id"]: r["event_hash"] for r in log.collect()} == whole


def test_a_refused_batch_is_chained_anew_without_its_sessions(spark, tmp_path, event_feed):
    add, stream = event_feed
    path, told = str(tmp_path / "log"), []
    for first in (0, 4, 8):
        add(events(first, first + 4))

    def refusing(log, part):
        if not log.where("session_id >= 's4' and session_id < 's8'").isEmpty():
            raise OSError("no such session")
        if part.endswith("batch_id=2") and not told:
            raise OSError("full")
        log.write.mode("overwrite").parquet(part)

    run(stream(), ledger.sink(path, b"k", refusing, lambda batch, error: told.append((batch, error))), tmp_path / "ck")
    log = ledger.log(spark, path)
    assert told == [(2, "full")] and {r["id"] for r in log.collect()} == set(range(8)) and not broken(spark, path)
    assert {r["id"] for r in log.where("session_id is null").collect()} == {4, 5, 6, 7}
    changed = log.withColumn("latency_ms", log.latency_ms + (log.id == 5).cast("int"))
    changed.where("batch_id = 1").drop("batch_id").write.mode("overwrite").parquet(str(tmp_path / "copy"))
    spark.read.parquet(str(tmp_path / "copy")).write.mode("overwrite").parquet(f"{path}/events/batch_id=1")
    assert broken(spark, path) == {5}


def test_an_error_comes_inline_before_the_end_mark(spark):
    chunk = lambda text: json.dumps({"choices": [{"delta": {"content": text}}]})
    rows = [("a", 0, chunk("one [[EM"), None), ("a", 1, None, "upstream error: 'x'"), ("a", 2, chunk("never"), None), ("b", 0, None, "at once"), ("c", 0, chunk("fine [[EM"), None)]
    df = spark.createDataFrame(rows, "session_id string, seq long, chunk string, error string")
    none = spark.createDataFrame([], "session_id string, placeholder string, value string")
    lines = {}
    for r in sanitize.event_stream(df, none).orderBy("session_id", "seq").collect():
        lines.setdefault(r["session_id"], []).append(r["line"])
    assert [len(x) for x in lines.values()] == [3, 2, 3] and all(x[-1] == "data: [DONE]\n\n" for x in lines.values())
    assert json.loads(lines["a"][1][6:])["error"] == {"message": "upstream error: 'x'", "type": "gateway_error", "code": "provider_error"}
    assert json.loads(lines["a"][0][6:])["choices"][0]["delta"]["content"] == "one " and "[[EM" in lines["c"][1]


def test_verification_goes_on_after_what_it_knows(spark, tmp_path):
    path, put = str(tmp_path / "log"), ledger.sink(str(tmp_path / "log"), b"k")
    for k in range(3):
        put(spark.createDataFrame(events(5 * k, 5 * k + 5), EVENT), k)
    told = lambda: sorted((r["batch_id"], r["state"], r["n_events"], r["n_broken"]) for r in ledger.verify_on(spark, path, b"k").collect())
    assert told() == [(0, "new", 5, 0), (1, "new", 5, 0), (2, "new", 5, 0)]
    put(spark.createDataFrame(events(15, 18), EVENT), 3)
    assert told() == [(0, "known", None, None), (1, "known", None, None), (2, "known", None, None), (3, "new", 3, 0)]
    part = f"{path}/events/batch_id=1"
    spark.read.parquet(part).withColumn("latency_ms", F.when(F.col("id") == 7, 99).otherwise(F.col("latency_ms"))).write.parquet(str(tmp_path / "copy"))
    spark.read.parquet(str(tmp_path / "copy")).write.mode("overwrite").parquet(part)
    for _ in range(2):  # what is broken stays reported
        assert told() == [(0, "known", None, None), (1, "changed", 5, 1), (2, "known", None, None), (3, "known", None, None)]


def test_a_stored_table_of_tokens_stays_where_it_lies(spark, tmp_path):
    name = vault.token_table(spark, str(tmp_path / "tokens"), 4)
    tokens = spark.range(50).select(F.concat(F.lit("s"), F.col("id") % 5).alias("session_id"), F.lit("T").alias("entity_type"), F.concat(F.lit("p"), "id").alias("placeholder"), F.sha2(F.col("id").cast("string"), 256).alias("value_fingerprint"), F.col("id").cast("string").cast("binary").alias("value_ciphertext"), F.lit(1).cast("long").alias("occurrences"))
    vault.store_tokens(tokens.where("id < 20"), name)
    vault.store_tokens(tokens, name)
    vault.store_tokens(tokens.where("id > 40"), name)
    assert sorted(r["placeholder"] for r in spark.table(name).collect()) == sorted(f"p{i}" for i in range(50))
    plan = bucketed.absent(tokens, name, vault.TOKEN_KEYS)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan and plan.count("Exchange hashpartitioning") == 1  # of the new tokens
    spark.sql(f"DROP TABLE {name}")
    assert spark.table(vault.token_table(spark, str(tmp_path / "tokens"), 4)).count() == 50


def test_key_derivation_gives_the_standards_first_vector():
    out = vault.hkdf(b"\x0b" * 22, bytes(range(13)), bytes(range(0xF0, 0xFA)), 42)
    assert out.hex() == "3cb25f25faacd57a90434f64d0362f2a2d2d0a90cf1a5a4c5db02d56ecc4c5bf34007208d5b887185865"
