from __future__ import annotations

import json
import pathlib
import random

import pytest
from pyspark.sql import functions as F
from test_functions import CARD, GOOD, SIN

from inkfold.functions import rules
from inkfold.operators import audit, evaluation, payload, policy, providers, sanitize, spans, vault
from inkfold.sources import scratch, tables
from inkfold.streaming import restore

RANK = spans.SOURCE_RANK


def detected(spark, text, codes=rules.DEFAULT_PACKS, merged=False):
    df = spark.createDataFrame([(text,)], "text string")
    column = spans.all_rule_spans(F.col("text"), codes)
    return [(s["entity_type"], s["text"], s["start"], s["end"], s["jurisdiction"]) for s in df.select((spans.merge(column) if merged else column).alias("s")).first()["s"]]


CASES = [
    ("GENERIC", "é x@y.org!", "EMAIL", "x@y.org"), ("GENERIC", "x@y", "EMAIL", None), ("GENERIC", f"n {CARD}.", "CREDIT_CARD", CARD), ("GENERIC", "n 4000000000001230", "CREDIT_CARD", None),
    ("GENERIC", "at +1 (555) 010-2030.", "PHONE", "+1 (555) 010-2030"), ("GENERIC", "5550102030", "PHONE", None), ("GENERIC", "10.0.0.255", "IP_ADDRESS", "10.0.0.255"), ("GENERIC", "10.0.0.256", "IP_ADDRESS", None),
    ("GENERIC", "2001:db8::1", "IP_ADDRESS_V6", "2001:db8::"), ("GENERIC", "dob: 1990-01-02", "DATE_OF_BIRTH", "dob: 1990-01-02"), ("GENERIC", "DOB: 1990-01-02", "DATE_OF_BIRTH", None), ("GENERIC", "1990-01-02", "DATE_OF_BIRTH", None), ("GENERIC", "дата народження 01.02.1990", "DATE_OF_BIRTH", "дата народження 01.02.1990"),
    ("CA", f"sin {SIN}", "SIN", SIN), ("CA", "123456789RT0001", "GST_HST", "123456789RT0001"), ("CA", "123456789 RX 0001", "BUSINESS_NUMBER", None), ("CA", "neq # 1234 567-890", "NEQ", "1234 567-890"), ("CA", "1234567890", "NEQ", None),
    ("US", "912-70-1234", "ITIN", "912-70-1234"), ("US", "123-45-6789", "SSN", "123-45-6789"), ("US", "666-45-6789", "SSN", None), ("US", "12-3456789", "EIN", "12-3456789"), ("US", "07-3456789", "EIN", None),
    ("EU", GOOD, "IBAN", GOOD), ("EU", GOOD[:-1] + "0", "IBAN", None), ("EU", "FR AB123456789", "VAT", "FR AB123456789"), ("EU", "ITIN", "VAT", "ITIN"), ("EU", "éITIN", "VAT", None), ("EU", "fr123", "VAT", None),
    ("UA", "іпн: 1234567890", "IPN", "1234567890"), ("UA", "1234567890", "IPN", None), ("UA", "ЄДРПОУ № 12345678", "EDRPOU", "12345678"),
    ("IRCC", "Client Identifier 1234-567890", "UCI", "1234-567890"), ("IRCC", "W123456789", "APPLICATION_NUMBER", "W123456789"), ("IRCC", "A123456789", "APPLICATION_NUMBER", None),
]


def test_rules_find_and_miss(spark):
    for code, text, kind, value in CASES:
        got = [s for s in detected(spark, text, [code]) if s[0] == kind]
        assert [s[1] for s in got] == ([value] if value else []), (text, kind)
        assert all(text[s[2] : s[3]] == s[1] for s in got)


def test_offsets_count_code_points(spark):
    text = "🙂🙂\x01 a@b.co \x02 🙂 c@d.org"
    assert [(s[2], s[3], text[s[2] : s[3]]) for s in detected(spark, text, ["GENERIC"])] == [(4, 10, "a@b.co"), (15, 22, "c@d.org")]


def test_ties_follow_the_packs(spark):
    assert [s[0] for s in detected(spark, "123456789RT0001", merged=True)] == ["BUSINESS_NUMBER"]
    assert [(s[0], s[4]) for s in detected(spark, GOOD, merged=True)] == [("IBAN", "GENERIC")]
    assert detected(spark, "", merged=True) == []


def plain_merge(found):
    rank = lambda s: (s[3], s[1] - s[0], RANK.get(s[4], 0))
    out = []
    for s in sorted(found, key=lambda s: (s[0], *(-x for x in rank(s)))):
        if not out or out[-1][1] <= s[0]:
            out.append(s)
        elif rank(s) > rank(out[-1]):
            out[-1] = s
    return out


def test_merge_as_a_plain_sweep(spark):
    rng = random.Random(2)
    rows = []
    for k in range(150):
        found = []
        for i in range(rng.randrange(8)):
            a = rng.randrange(20)
            found.append((a, a + 1 + rng.randrange(6), f"T{i}", rng.choice([0.5, 0.95]), rng.choice([*RANK, "other"])))
        rows.append((k, found))
    df = spark.createDataFrame([(k, [(a, b, t, "x", sc, so, "J") for a, b, t, sc, so in f]) for k, f in rows], f"k int, spans {spans.SPANS}")
    for r in df.select("k", spans.merge(F.col("spans")).alias("m")).collect():
        expected = plain_merge([(a, b, t, sc, so) for a, b, t, sc, so in rows[r["k"]][1]])
        assert [(s["start"], s["end"], s["entity_type"]) for s in r["m"]] == [x[:3] for x in expected]


def test_values_are_anchored_once_each(spark):
    df = spark.createDataFrame([("Ann met Ann and Bob", [("person", "Ann"), ("person", "Ann"), ("person", "Ann"), ("org name", "Bob"), ("x", "Zed"), ("x", "")])], "t string, r array<struct<type:string,value:string>>")
    got = df.select(spans.anchored(F.col("t"), F.col("r")).alias("s")).first()["s"]
    assert [(s["start"], s["entity_type"]) for s in got] == [(0, "PERSON"), (8, "PERSON"), (16, "ORG_NAME")]
    df = spark.createDataFrame([("aaaaaaa", [("x", "aaa"), ("x-y", "aa"), ("x", "aaa"), ("z", "aa")])], "t string, r array<struct<type:string,value:string>>")
    assert [(s["start"], s["end"], s["entity_type"]) for s in df.select(spans.anchored(F.col("t"), F.col("r")).alias("s")).first()["s"]] == [(0, 3, "X"), (3, 5, "X-Y"), (5, 7, "Z")]
    said = spark.createDataFrame([("Ann and Bob", '[{"type":"person","text":"Bob"}]'), ("x", None), (None, "[]")], "t string, a string")
    assert [[s["start"] for s in r["s"]] for r in said.select(spans.answered(F.col("t"), F.col("a")).alias("s")).collect()] == [[8], [], []]


def found(spark, rows):
    return spans.detect(spark.createDataFrame(rows, "session_id string, text_idx int, text string"))


TEXTS = [("s1", 0, "write a@b.co or a@b.co, ip 10.0.0.1"), ("s1", 1, "again a@b.co and c@d.org"), ("s2", 0, "a@b.co near [[EMAIL_00000f]] and [[EMAIL_ffffff]]"), ("s3", 0, "nothing"), ("s4", 0, None), ("s5", 0, "10.0.0.1,a@b.co")]


def test_vault_round_trip(spark):
    rows = found(spark, TEXTS).cache()
    closed = vault.token_map(rows, b"key", master=b"m" * 32).cache()
    tokens = vault.opened(closed, b"m" * 32).cache()
    got = tokens.collect()
    assert len({(r["session_id"], r["placeholder"]) for r in got}) == len(got) == len({(r["session_id"], r["value_fingerprint"]) for r in got})
    assert {(r["session_id"], r["value"]): r["occurrences"] for r in got}["s1", "a@b.co"] == 3
    assert all(r["placeholder"] not in ("[[EMAIL_00000f]]", "[[EMAIL_ffffff]]") for r in got)
    put = vault.tokenize(rows, tokens)
    assert not any("@" in (r["sanitized"] or "") for r in put.collect())
    back = {(r["session_id"], r["text_idx"]): r["restored"] for r in vault.detokenize(put, tokens).collect()}
    assert back == {(s, i): t for s, i, t in TEXTS}
    assert all(len(bytes(r["value_ciphertext"])) > 28 for r in closed.collect())
    with pytest.raises(Exception):
        vault.opened(closed, b"n" * 32).collect()
    assert vault.new_tokens(tokens, tokens).count() == 0
    assert vault.bumped(tokens, tokens).where("session_id = 's1' and value = 'a@b.co'").first()["occurrences"] == 6
    other = vault.detokenize(put.withColumn("session_id", F.lit("s9")), tokens)
    assert any("[[" in (r["restored"] or "") for r in other.collect())


def test_masking(spark):
    assert found(spark, TEXTS[:1]).select(vault.masked(F.col("normalized"), F.col("spans")).alias("m")).first()["m"] == "write [[EMAIL]] or [[EMAIL]], ip [[IP_ADDRESS]]"


def test_policies(spark):
    stored = spark.createDataFrame([("a", "tokenize", ["EMAIL"], ["openai"], ["EMAIL"]), ("b", "hard_block", [], [], None), ("c", "tokenize", None, None, [])], "policy_id string, mode string, blocked_types array<string>, allowed_providers array<string>, redact_types array<string>")
    rows = found(spark, [(p, 0, "a@b.co 10.0.0.1") for p in "abcd"]).withColumn("policy_id", F.col("session_id"))
    types = F.array_distinct("spans.entity_type")
    ruled = policy.resolve(rows, stored, honour_redact_types=True)
    got = {r["policy_id"]: r for r in ruled.select("policy_id", policy.blocked(types, F.col("policy")).alias("blocked"), policy.offending_types(types, F.col("policy")).alias("bad"), F.size(policy.kept_spans(F.col("spans"), F.col("policy"))).alias("kept"), policy.provider_allowed(F.lit("OpenAI"), F.col("policy")).alias("may")).collect()}
    assert {k: (r["blocked"], r["bad"], r["kept"], r["may"]) for k, r in got.items()} == {"a": (True, ["EMAIL"], 1, False), "b": (True, ["EMAIL", "IP_ADDRESS"], 2, True), "c": (False, None, 0, True), "d": (False, None, 2, True)}
    with pytest.raises(Exception):
        policy.validated(spark.createDataFrame([("o", None, "tokenize")], "org_id string, name string, mode string")).collect()


def log_rows(spark, ids):
    rows = [(i, f"t{i % 3}", None, None, "/r", "openai", {"SIN": i, "EMAIL": 1}, i % 2 == 0, 5, None, i if i % 4 else None) for i in ids]
    return spark.createDataFrame(rows, "id long, team_id string, api_key_id string, session_id string, route string, provider string, entity_counts map<string,long>, blocked boolean, prompt_tokens long, completion_tokens long, latency_ms long")


def test_a_team_is_chained_in_one_task(spark):
    """Where the heads' join is planned as one of shuffled tables and turns into one of a broadcast table."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        log = audit.append(log_rows(spark, range(200)), b"k").localCheckpoint()
        more = audit.append(log_rows(spark, range(200, 400)).repartition(8), b"k", log).localCheckpoint()
        assert [r["n_broken"] for r in audit.verify(log.unionByName(more), b"k").collect()] == [0, 0, 0]
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_audit_chain_and_tampering(spark):
    log = audit.append(log_rows(spark, range(30)), b"k").cache()
    more = audit.append(log_rows(spark, range(30, 40)), b"k", log)
    whole = log.unionByName(more).cache()
    assert all(r["valid"] for r in audit.verify(whole, b"k").collect()) and whole.count() == 40
    assert not any(r["valid"] for r in audit.verify(whole, b"other").collect())
    first = [r for r in whole.collect() if r["id"] == 0][0]
    body = json.dumps({"api_key_id": None, "blocked": True, "completion_tokens": None, "entity_counts": {"EMAIL": 1, "SIN": 0}, "latency_ms": None, "prompt_tokens": 5, "provider": "openai", "route": "/r", "session_id": None, "team_id": "t0"}, separators=(",", ":"))
    import hashlib
    import hmac

    assert first["event_hash"] == hmac.new(b"k", (audit.GENESIS + body).encode(), hashlib.sha256).hexdigest()
    swap = {"route": F.lit("/x"), "provider": F.lit("p"), "blocked": ~F.col("blocked"), "prompt_tokens": F.lit(6), "latency_ms": F.lit(99), "session_id": F.lit("s"), "api_key_id": F.lit("k"), "completion_tokens": F.lit(1), "entity_counts": F.create_map(F.lit("A"), F.lit(1)).cast("map<string,bigint>"), "event_hash": F.lit("0" * 64)}
    for name, value in swap.items():
        broken = whole.withColumn(name, F.when(F.col("id") == 6, value).otherwise(F.col(name)))
        assert {r["team_id"] for r in audit.verify(broken, b"k").collect() if not r["valid"]} == {"t0"}, name
    assert {r["team_id"] for r in audit.verify(whole.where("id <> 7"), b"k").collect() if not r["valid"]} == {"t1"}
    assert audit.verify(whole.limit(0), b"k").count() == 0


def test_greedy_matching_takes_each_span_once(spark):
    df = spark.createDataFrame([([("A", 0, 5), ("A", 3, 9), ("B", 0, 9), ("A", 20, 25)], [("A", 2, 4), ("A", 4, 6), ("C", 0, 9), ("A", 25, 30)])], "labels array<struct<type:string,start:int,end:int>>, spans array<struct<entity_type:string,start:int,end:int>>")
    r = evaluation.micro(evaluation.scored(df)).first()
    assert (r["tp"], r["recall"], r["precision"]) == (2, 0.5, 0.5)
    assert evaluation.micro(evaluation.scored(df.limit(0))).first()["recall"] == 0.0


PAYLOAD = {
    "model": "auto", "n": 2,
    "messages": [
        {"role": "system", "content": "one"}, "skipped",
        {"role": "user", "content": [{"type": "text", "text": "two"}, {"type": "image_url", "image_url": {"url": "u"}}, "bare", {"type": "output_text", "text": "three"}]},
        {"role": "assistant", "content": None, "tool_calls": [{"id": 1, "function": {"name": "f", "arguments": "{\"four\":1}"}}], "function_call": {"arguments": "five"}},
        {"role": "user", "content": 7},
    ],
    "input": [{"role": "user", "content": "six"}, {"text": "seven"}, {"type": "x"}, "bare"],
}


def test_restoring_changes_nothing_else(spark):
    odd = "a\x01b x@q.co c\x02d [[EMAIL_00000a]] \x01q@r.co\x02"
    rows = found(spark, [("s", 0, odd), ("s", 1, "plain"), (None, 2, "[[X_000001]]")])
    assert [(s["text"], s["start"]) for s in rows.where("text_idx = 0").first()["spans"]] == [("x@q.co", 4), ("q@r.co", odd.index("q@r"))]
    tokens = vault.token_map(rows, b"k")
    told = vault.tokenize(rows, tokens)
    back = {r["text_idx"]: (r["sanitized"], r["restored"]) for r in vault.detokenize(told, tokens).collect()}
    assert "q.co" not in back[0][0] and back[0][1] == odd and back[1][1] == "plain" and back[2][1] == "[[X_000001]]"


def test_requests_there_and_back(spark):
    said = lambda *texts: json.dumps({"model": "m", "n": 1, "messages": [{"role": "user", "content": t} for t in texts]})
    shapes = [("a", said("mail ann@b.co", "ann@b.co or 10.0.0.1"), None), ("b", said("ip 10.0.0.1"), "p1"), ("c", said("nothing"), "p1"), ("d", "{}", "p2"), ("e", "no json", None), ("f", said("x"), "p2"), ("g", said("a@b.co 10.0.0.9"), "p3")]
    policies = spark.createDataFrame([("p1", "o", "n", "tokenize", None, ["IP_ADDRESS"], [], None, None), ("p2", "o", "n", "hard_block", None, [], [], None, None), ("p3", "o", "n", "tokenize", None, [], [], ["EMAIL"], None)], policy.POLICY)
    done = sanitize.sanitize(spark.createDataFrame(shapes, "session_id string, payload string, policy_id string"), b"k", policies, honour_redact_types=True)
    got = {r["session_id"]: r for r in done.requests.collect()}
    assert {k: r["blocked"] for k, r in got.items()} == {"a": False, "b": True, "c": False, "d": False, "e": False, "f": True, "g": False}
    assert got["a"]["entity_counts"] == {"EMAIL": 2, "IP_ADDRESS": 1} and got["b"]["offending"] == ["IP_ADDRESS"] and got["b"]["sanitized"] is None
    assert got["e"]["sanitized"] == "no json" and "10.0.0.9" in got["g"]["sanitized"] and "a@b.co" not in got["g"]["sanitized"]
    sent = json.loads(got["a"]["sanitized"])
    mail = sent["messages"][0]["content"].split()[1]
    assert sent["messages"][1]["content"].startswith(mail + " or [[IP_ADDRESS_") and sent["n"] == 1
    answers = spark.createDataFrame([("a", json.dumps({"choices": [{"message": {"content": f"to {mail}!"}}]})), ("c", "no json"), ("g", '{"choices":[]}')], "session_id string, answer string")
    back = {r["session_id"]: r["restored"] for r in sanitize.reinflate(answers, done.tokens).collect()}
    assert json.loads(back["a"])["choices"][0]["message"]["content"] == "to ann@b.co!" and back["c"] == "no json" and back["g"] == '{"choices":[]}'
    whole = f"to {mail} and [[EM"
    deltas = [*(whole[i : i + 7] for i in range(0, len(whole), 7)), None]
    chunks = [("a", i, json.dumps({"choices": [{"delta": {} if d is None else {"content": d}, "finish_reason": None}]})) for i, d in enumerate(deltas)]
    lines = [r["line"] for r in sanitize.event_stream(spark.createDataFrame(chunks, "session_id string, seq long, chunk string"), done.tokens).orderBy("seq").collect()]
    assert lines[-1] == tables.END_OF_EVENTS and len(lines) == len(chunks) + 2
    assert "".join(json.loads(x[6:])["choices"][0]["delta"].get("content", "") for x in lines[:-1]) == "to ann@b.co and [[EM"


def test_audit_in_blocks_and_sinks_that_fail(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(audit, "BLOCK", 3)
    events = spark.createDataFrame([(i, f"t{i % 2}", "k", None, "/r", "p", {"A": i}, False, 1, 2, 3) for i in range(20)], "id long, team_id string, api_key_id string, session_id string, route string, provider string, entity_counts map<string,long>, blocked boolean, prompt_tokens int, completion_tokens int, latency_ms int")
    log = audit.append(events, b"k").cache()
    assert all(r["valid"] for r in audit.verify(log, b"k").collect())
    broken = {r["id"] for r in audit.verified(log.where("id not in (6, 7)"), b"k").collect() if not r["intact"]}
    assert broken == {8, 9}
    (tmp_path / "file").write_text("x")
    assert audit.write_or_report(events, b"k", str(tmp_path / "file")) is not None


def refusing_links(log, path):
    """A sink that takes no event of a session."""
    if not log.where("session_id is not null").isEmpty():
        raise OSError("no such session")
    audit.write(log, path)


def test_a_log_verifies_after_its_sink_refused_the_sessions(spark, tmp_path):
    path = str(tmp_path / "log")
    events = spark.createDataFrame([(i, f"t{i % 2}", "k", f"s{i}", "/r", "p", {"A": i}, False, 1, 2, 3) for i in range(10)], "id long, team_id string, api_key_id string, session_id string, route string, provider string, entity_counts map<string,long>, blocked boolean, prompt_tokens int, completion_tokens int, latency_ms int")
    assert audit.write_or_report(events.where("id < 6"), b"k", path) is None
    assert audit.write_or_report(events.where("id >= 6"), b"k", path, refusing_links) is None
    log = spark.read.parquet(path)
    assert sorted((r["team_id"], r["n_events"], r["n_broken"], r["valid"]) for r in audit.verify(log, b"k").collect()) == [("t0", 5, 0, True), ("t1", 5, 0, True)]
    assert {r["id"] for r in log.where("session_id is null").collect()} == {6, 7, 8, 9}

    def refusing(log, path):
        raise OSError("full\nof rows")

    assert audit.write_or_report(events, b"k", path, refusing) == "full" and spark.read.parquet(path).count() == 10


def test_payload_walk_and_injection(spark):
    shapes = [("a", json.dumps(PAYLOAD)), ("b", '{"input":"only"}'), ("c", "{}"), ("d", "no json"), ("e", None)]
    df = spark.createDataFrame(shapes, "session_id string, payload string")
    got = payload.extract(df).orderBy("session_id", "text_idx").collect()
    assert [(r["session_id"], r["text"]) for r in got] == [("a", t) for t in ("one", "two", "three", '{"four":1}', "five", "six", "seven")] + [("b", "only")]
    new = payload.extract(df).withColumn("sanitized", F.upper("text"))
    put = {r["session_id"]: r["injected"] for r in payload.inject(df, new).collect()}
    changed = json.loads(put["a"])
    assert changed["messages"][2]["content"][3]["text"] == "THREE" and changed["messages"][1] == "skipped" and changed["input"][1]["text"] == "SEVEN" and changed["n"] == 2
    assert put["b"] == '{"input":"ONLY"}' and put["c"] == "{}" and put["d"] == "no json"
    with pytest.raises(Exception):
        payload.inject(df.where("session_id = 'a'"), new.where("text_idx > 0")).collect()


def test_provider_shapes(spark):
    df = spark.createDataFrame([(json.dumps(PAYLOAD),)], "p string").select(F.parse_json("p").alias("p"))
    body = json.loads(df.select(providers.request(F.col("p"), providers.lookup("anthropic")).alias("b")).first()["b"])
    assert body["system"] == "one" and body["max_tokens"] == 1024 and body["messages"][-1]["role"] == "user"
    body = json.loads(df.select(providers.request(F.col("p"), providers.lookup("gemini")).alias("b")).first()["b"])
    assert {"role": "user", "parts": [{"text": "two"}]} in body["contents"]
    answers = {"openai": {"choices": [{"message": {"content": "hi"}, "finish_reason": "length"}]}, "bedrock": {"content": [{"type": "text", "text": "h"}, {"type": "thinking", "text": "?"}, {"type": "text", "text": "i"}], "stop_reason": "max_tokens"}, "gemini": {"candidates": [{"content": {"parts": [{"text": "hi"}]}, "finishReason": "MAX_TOKENS"}]}, "ollama": {"message": {"content": "hi"}, "done": False}}
    for name, a in answers.items():
        r = spark.createDataFrame([(json.dumps(a),)], "a string").select(providers.answer(F.parse_json("a"), providers.lookup(name)).alias("r")).first()["r"]
        assert (r["content"], r["finish_reason"]) == ("hi", "length"), name
    given = json.dumps({"model": "auto", "messages": [{"role": "user", "content": "é"}], "temperature": 0.5, "max_tokens": 7, "tools": [{"a": [1, None]}], "stream": True})
    df = spark.createDataFrame([(given,)], "p string").select(F.parse_json("p").alias("p"))
    asked = lambda name: json.loads(df.select(providers.request(F.col("p"), providers.lookup(name)).alias("b")).first()["b"])
    assert asked("openai") == json.loads(given) | {"model": providers.lookup("openai").default_model, "stream": False}
    assert asked("anthropic")["temperature"] == 0.5 and asked("anthropic")["max_tokens"] == 7
    assert asked("gemini")["generationConfig"] == {"temperature": 0.5, "maxOutputTokens": 7}
    assert asked("ollama")["options"] == {"temperature": 0.5}
    bad = spark.createDataFrame([('{"model":"../x","messages":[]}',)], "p string").select(F.parse_json("p").alias("p"))
    for name, status in (("bedrock", 400), ("gemini", 400), ("azure", 400), ("openai", None)):
        r = bad.select(providers.refusal(F.col("p"), providers.lookup(name)).alias("e"), providers.request(F.col("p"), providers.lookup(name)).alias("b")).first()
        assert (r["e"] and r["e"]["status"]) == status and (r["b"] is None) == (status is not None), name
    with pytest.raises(ValueError):
        providers.lookup("nobody")
    calls = providers.complete(spark.createDataFrame([("s", "x")], "session_id string, body string"), lambda bodies: [(200, b.upper()) for b in bodies]).first()
    assert (calls["status"], calls["answer"]) == (200, "X")


def test_sources(spark, tmp_path):
    ok, bad = tables.requests(spark.createDataFrame([('{"a":1}',), ("[1]",), ("x",), ('{"a":"' + "y" * 60 + '"}',), (None,)], "body string"), 50)
    assert ok.count() == 1 and sorted(r["status"] for r in bad.collect()) == [400, 400, 400, 413]
    lines = spark.createDataFrame([(x,) for x in (": c", "", 'data: {"k":1}', "data: [DONE]", "data: {", 'data:{"k":2}', "event: x")], "value string")
    assert sorted(r["k"] for r in tables.event_data(lines).select(F.try_variant_get("event", "$.k", "int").alias("k")).collect()) == [1, 2]
    (tmp_path / "g.jsonl").write_text('{"text":"a","entities":[{"type":"X","start":0,"end":1}]}\n\n{"text":"b","entities":[]}\n')
    assert tables.golden(spark, str(tmp_path / "g.jsonl")).count() == 2
    packs, n = tables.sync_packs(spark, None)
    assert n == 6 and tables.sync_packs(spark, packs)[0].count() == 6 and tables.insert_absent(packs, packs, "code").count() == 0
    assert spark.range(1).select(tables.in_pieces(F.lit("abcdefg"), 3).alias("p")).first()["p"] == ["abc", "def", "g"]


def test_deployments_are_named_in_the_address(spark):
    own = providers.azure("https://x.example/", "base", "2024-06-01")
    payloads = spark.createDataFrame([('{"model":"auto","messages":[]}',), ('{"model":"mine","n":1}',)], "p string").select(F.parse_json("p").alias("p"))
    got = payloads.select(providers.address(F.col("p"), own).alias("a"), providers.request(F.col("p"), own).alias("r"), providers.refusal(F.col("p"), own).alias("no")).collect()
    assert [r["a"] for r in got] == [f"https://x.example/openai/deployments/{d}/chat/completions?api-version=2024-06-01" for d in ("base", "mine")]
    assert [json.loads(r["r"]) for r in got] == [{"messages": [], "stream": False}, {"n": 1, "stream": False}] and all(r["no"] is None for r in got)
    assert payloads.select(providers.request(F.col("p"), providers.lookup("azure")).alias("r")).first()["r"] is None
    assert payloads.select(providers.address(F.col("p"), providers.lookup("openai")).alias("a")).first()["a"] is None


def test_scopes_drop_what_was_stored_inside(spark):
    place = lambda df: pathlib.Path(df.inputFiles()[0].removeprefix("file:")).parent
    outside = scratch.stored(spark.range(3), "a")
    with scratch.scope(spark):
        inside = place(scratch.stored(spark.range(3), "b"))
        with scratch.scope(spark):
            kept, deep = scratch.stored(spark.range(4), "c", keep=True), place(scratch.stored(spark.range(5), "d"))
        assert not deep.exists() and inside.exists() and kept.count() == 4
        last = scratch.stored(kept, "e", keep=True)
    assert not inside.exists()
    assert outside.count() == 3 and last.count() == 4


def test_one_session_is_numbered_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(vault, "BLOCK", 2)
    texts = [("all", i, f"mail u{i % 17}@b.co and u{(i * 7) % 23}@b.co") for i in range(40)] + [(None, 0, "x@b.co"), (None, 3, "y@b.co"), ("two", 1, "z@b.co")]
    found = spans.detect(spark.createDataFrame(texts, "session_id string, text_idx long, text string"))
    with restore.settings(spark, spark__sql__adaptive__enabled="false"):  # which would put so few rows together again
        rows = vault.token_map(found, b"k").withColumn("task", F.spark_partition_id()).collect()
    seen = {}
    for session, _, text in texts:
        for word in text.replace("mail ", "").split(" and "):
            seen.setdefault(session, []).append(word) if word not in seen.get(session, []) else None
    assert {(r["session_id"], r["value"]): r["placeholder"] for r in rows} == {(s, w): f"[[EMAIL_{n:06x}]]" for s, words in seen.items() for n, w in enumerate(words, 1)}
    assert len({r["task"] for r in rows if r["session_id"] == "all"}) > 1


WHOLE = "to [[EMAIL_000001]], [[IP_000002]] and [[EMAIL_zz [[X_12]] or [[ [[EMAIL_000001]"
KNOWN = [("s", "[[EMAIL_000001]]", "a@b.co"), ("s", "[[IP_000002]]", "10.0.0.1")]


@pytest.mark.parametrize("size", [1, 2, 3, 5, 7, 11, 64, 500])
def test_chunks_of_any_size_give_the_same_text(spark, size):
    pieces = [WHOLE[i : i + size] for i in range(0, len(WHOLE), size)]
    chunks = spark.createDataFrame([("s", i, p) for i, p in enumerate(pieces)], "session_id string, seq long, delta string")
    tokens = spark.createDataFrame(KNOWN, "session_id string, placeholder string, value string")
    expected = WHOLE.replace("[[EMAIL_000001]]", "a@b.co").replace("[[IP_000002]]", "10.0.0.1")
    assert restore.restore_batch(chunks, tokens).first()["text"] == expected
    out, buffer = [], ""
    for p in pieces:
        ready, buffer = restore.split_buffer(buffer + p)
        out.append(restore.put_back(ready, dict(x[1:] for x in KNOWN)))
    assert "".join(out) + buffer == expected
