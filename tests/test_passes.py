"""Detector passes that fail, and asking once."""

from __future__ import annotations

import json
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from inkfold.operators import asking, dashboard, evaluation, passes, providers, spans
from inkfold.operators import payload as payload_
from inkfold.sources import tables


@pytest.fixture(scope="module")
def stand_ins():
    """A recognizer and a model; functions of a test's own, since workers can't import test modules."""

    def find_names(batch):
        """Names; a text with BOOM can't be stood, one with SHORT gives a result that isn't one."""
        if any("BOOM" in t for t in batch):
            raise RuntimeError("boom")
        out = []
        for t in batch:
            at = t.find("Ann")
            out.append([("PERSON", at, at + 3, 0.9), ("PET", 0, 1, 0.9), ("PERSON", 5, 10_000, 0.9)] if at >= 0 else [("PERSON",)] if "SHORT" in t else [])
        return out

    def answer(batch):
        return ['{"entities":[{"type":"code word","text":"swordfish"}]}' if "ask" in t else "no idea" for t in batch]

    return find_names, answer


TEXTS = [(1, "Ann at a@b.co"), (2, "BOOM Ann c@d.co"), (3, "ask: swordfish e@f.co"), (4, "SHORT"), (5, None), (6, ""), (7, "Ann again, ask for swordfish")]


def test_failing_passes_leave_the_others_spans(spark, stand_ins):
    find_names, answer = stand_ins
    rows = spark.createDataFrame(TEXTS, "id long, text string").coalesce(1)
    found = passes.detect(rows, [passes.Recognizer("names", find_names), passes.Asker("words", answer, gate=F.col("id") != 7)])
    assert found.columns == ["id", "text", "normalized", "spans", "pass_errors"]
    got = {r["id"]: ([(s["entity_type"], s["text"]) for s in r["spans"]], r["pass_errors"]) for r in found.collect()}
    assert got == {
        1: ([("PERSON", "Ann"), ("EMAIL", "a@b.co")], {}),
        2: ([("EMAIL", "c@d.co")], {"names": "RuntimeError: boom"}),
        3: ([("CODE_WORD", "swordfish"), ("EMAIL", "e@f.co")], {}),
        4: ([], got[4][1]), 5: ([], {}), 6: ([], {}), 7: ([("PERSON", "Ann")], {}),
    }
    assert list(got[4][1]) == ["names"] and got[4][1]["names"].startswith("ValueError")
    assert [tuple(r) for r in passes.error_counts(found).collect()] == [("names", 2)]
    plain = passes.detect(rows, []).drop("pass_errors")
    assert plain.columns == spans.detect(rows).columns and sorted(map(str, plain.collect())) == sorted(map(str, spans.detect(rows).collect()))


def test_only_halves_with_a_failure_are_called_again():
    calls = []

    def call(batch):
        calls.append(len(batch))
        if 7 in batch:
            raise KeyError(7)
        return batch

    assert passes.isolated(call, list(range(16))) == [(i, None) if i != 7 else (None, "KeyError: 7") for i in range(16)]
    assert sum(calls) <= 16 + 2 * (8 + 4 + 2 + 1)
    assert passes.isolated(lambda b: b[:-1], [1, 2]) == [(None, "ValueError: 0 results for 1 texts")] * 2 and passes.isolated(call, []) == []


@pytest.fixture
def client(tmp_path):
    """A client that notes each body, answers with the text it was asked about, and judges by equality."""
    calls = tmp_path / "calls"

    def call(bodies):
        out = []
        for body in bodies:
            with calls.open("a") as f:
                f.write(json.dumps(body) + "\n")
            said = json.loads(body)["messages"][-1]["content"]
            if "down" in said:
                out.append((503, "down"))
                continue
            if said.startswith("First:"):
                one, other = said[len("First:\n") :].split("\n\nSecond:\n")
                said = json.dumps({"score": 1.0 if one == other else 0.25}) if "unsure" not in one else "who knows"
            else:
                said = said[len("Text:\n") : said.index("\n\nQuestion")]
                said = said.replace("[[EMAIL_000001]]", "someone") if "lose" in said else said
            out.append((200, json.dumps({"choices": [{"message": {"content": said}}]})))
        return out

    return call, lambda: len(calls.read_text().splitlines()) if calls.exists() else 0


def test_redact_ask_restore_and_judge_once(spark, tmp_path, client):
    call, n_calls = client
    rows = spark.createDataFrame([("s", 1, "mail a@b.co", "who?"), ("s", 2, "lose a@b.co", "who?"), ("s", 3, "down a@b.co", "who?"), ("t", 4, "unsure", "who?"), ("s", 5, "plain", "who?")], "golden_set string, row_id long, text string, question string")
    name = asking.answers(spark, str(tmp_path / "answers"), 4)
    scores = {r["row_id"]: r["score"] for r in asking.fidelity(rows, call, name, b"k").collect()}
    assert scores == {"1": 1.0, "2": 0.25, "3": None, "4": None, "5": 1.0}
    first = n_calls()
    assert first == 8 + 4  # two texts of four rows, and one each of the two that hold nothing; a judgment for each pair
    again = {r["golden_set"]: (r["answer_fidelity"], r["n_scores"]) for r in asking.evaluated(rows, call, name, b"k").collect()}
    assert again == {"s": (0.75, 3), "t": (None, 0)}
    assert n_calls() == first + 2  # only what failed is asked again


def test_equal_requests_are_asked_once(spark, tmp_path, client):
    call, n_calls = client
    name = asking.answers(spark, str(tmp_path / "answers"), 4)
    body = json.dumps({"messages": [{"content": "Text:\nx\n\nQuestion: y"}]})
    requests = spark.createDataFrame([(i, body if i < 40 else None) for i in range(42)], "id long, body string").repartition(5)
    got = asking.ask(requests, call, name).collect()
    assert len(got) == 42 and n_calls() == 1 and {r["status"] for r in got if r["body"]} == {200} and {r["status"] for r in got if not r["body"]} == {None}


@pytest.mark.parametrize("values", [[], [5], [5, None, 8], [1, 2, 3, 10**9], [-7, -8], [-7, -6, 0, 1], [3] * 9, list(range(0, 50_000, 7)), [10**15, -(10**15), 3, 4]])
def test_median_by_narrowing_is_exact(spark, values):
    log = spark.createDataFrame([(v, False) for v in values], "latency_ms long, blocked boolean")
    known = sorted(v for v in values if v is not None)
    expected = None if not known else round((Fraction(known[(len(known) - 1) // 2]) + known[len(known) // 2]) / 2)
    row = dashboard.totals(log).first()
    assert (row["total_requests"], row["median_latency_ms"]) == (len(values), expected)


def test_deep_pages_read_as_few_files_as_the_first(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(dashboard, "BLOCK", 100)
    events = spark.range(2000).select("id", F.concat(F.lit("t"), F.col("id") % 3).alias("team_id"))
    for part in ("id < 950", "id >= 950"):
        dashboard.cluster(events.where(part), str(tmp_path / "log"))
    ids, own = list(range(1999, -1, -1)), [i for i in range(1999, -1, -1) if i % 3 == 1]
    pages = {n: dashboard.clustered_page(spark, str(tmp_path / "log"), n, 40) for n in (1, 26, 50, 51)}
    assert [[r["id"] for r in p.collect()] for p in pages.values()] == [ids[:40], ids[1000:1040], ids[1960:2000], []]
    blocks = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert len(pages[1].inputFiles()) >= 20 and all("PartitionFilters: [isnotnull(block" in blocks(pages[n]) or "PartitionFilters: [(block" in blocks(pages[n]) or "PartitionFilters: [block" in blocks(pages[n]) for n in (1, 50))
    assert [r["id"] for r in dashboard.clustered_page(spark, str(tmp_path / "log"), 14, 50, "t1").collect()] == own[650:700]
    with pytest.raises(ValueError):
        dashboard.clustered_page(spark, str(tmp_path / "log"), 0)


# What nothing else tests.


def test_small_tables(spark):
    sets = spark.createDataFrame([("ca", 0.123456, 1.0, None)], "golden_set string, recall double, precision double, answer_fidelity double")
    row = evaluation.run_rows(sets, "openai").first()
    assert (row["golden_set"], row["provider"], str(row["recall"]), str(row["precision"]), row["answer_fidelity"]) == ("ca", "openai", "0.1235", "1.0000", None) and row["created_at"]
    seeded = tables.seed(spark)
    assert sorted(seeded) == ["orgs", "policies", "teams"] and all(df.count() == 1 for df in seeded.values())
    assert seeded["teams"].join(seeded["policies"], ["org_id", "policy_id"]).count() == 1
    assert tables.insert_absent(seeded["orgs"], seeded["orgs"], "org_id").count() == 0
    use = spark.sql("""select parse_json('{"usage":{"prompt_tokens":3,"completion_tokens":4}}') a, parse_json('{}') b""").select(payload_.usage(F.col("a")).alias("a"), payload_.usage(F.col("b")).alias("b")).first()
    assert tuple(use["a"]) == (3, 4) and tuple(use["b"]) == (None, None)
    dated = spark.sql("select * from values ('a', timestamp'2024-01-01'), ('b', timestamp'2024-01-02'), ('c', timestamp'2024-01-02') t(policy_id, created_at)")
    assert [r["policy_id"] for r in dashboard.newest_policies(dated).collect()] == ["c", "b", "a"]
    sessions = spark.sql("select * from values (1, timestamp'2001-01-01'), (2, timestamp'2999-01-01') t(id, expires_at)")
    assert [r["id"] for r in sessions.where(tables.expired(sessions)).collect()] == [1]
    listed = {r["owned_by"]: r["id"] for r in providers.models(spark).collect()}
    assert "azure" not in listed and listed["openai"] == providers.lookup("openai").default_model and len(listed) == 6
    piece = json.loads(spark.range(1).select(F.to_json(providers.chunk(F.lit("x"), F.lit(None).cast("string"), F.lit("m"), F.lit("1")))).first()[0])
    assert piece == {"id": "chatcmpl-1", "object": "chat.completion.chunk", "model": "m", "choices": [{"index": 0, "delta": {"content": "x"}}]}
