"""Registered queries over the smaller operators, with their oracle SQL: parsers, provider shapes, sinks, pages and scores,
over inputs made from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.functions import rules, text
from inkfold.operators import audit, dashboard, evaluation, payload, policy, providers, sanitize, spans, vault
from inkfold.plans import relations as R
from inkfold.plans.catalog import _NORMAL, _TURNS, CODES, KEY, _query, found_identifiers, payloads
from inkfold.sources import tables
from inkfold.sources.scratch import shared_folder, stored

IDS = ["session_id", "text_idx"]


def _events(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _json(column: str):
    return F.try_parse_json(F.col(column))


# Parsers.


@_query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN concat('k', user_id) WHEN 1 THEN concat('a ', event_type) END AS token FROM events")
def bearer_tokens(spark, sf_dir):
    kind = F.col("event_id") % 5
    header = F.when(kind == 0, F.concat(F.lit("Bearer k"), F.col("user_id"))).when(kind == 1, F.concat(F.lit(" bearer  a "), F.col("event_type"), F.lit(" "))).when(kind == 2, "Basic x").when(kind == 3, "Bearer ")
    return _events(spark, sf_dir).select("event_id", text.bearer_token(header).alias("token"))


@_query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN least(1.0, (user_id % 30) / 20.0) WHEN 1 THEN 0.0 WHEN 2 THEN 0.25 END::DOUBLE AS score FROM events")
def judge_scores(spark, sf_dir):
    kind = F.col("event_id") % 4
    said = F.when(kind == 0, F.concat(F.lit('```json\n{"score": '), (F.col("user_id") % 30 / F.lit(20)).cast("decimal(6,3)").cast("string"), F.lit("}\n```"))).when(kind == 1, '{"score":-3}').when(kind == 2, 'I say {"why":"","score" : 0.25} so').otherwise("none")
    return _events(spark, sf_dir).select("event_id", text.judge_score(said).alias("score"))


@_query("SELECT event_id, CASE WHEN event_id % 4 < 3 THEN user_id END AS k FROM events")
def salvaged_answers(spark, sf_dir):
    kind, body = F.col("event_id") % 4, F.concat(F.lit('{"k": '), F.col("user_id"), F.lit("}"))
    said = F.when(kind == 0, body).when(kind == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(kind == 2, F.concat(F.lit("well, "), body, F.lit(" it is"))).otherwise("{oops")
    return _events(spark, sf_dir).select("event_id", F.try_variant_get(text.salvaged_json(said), "$.k", "bigint").alias("k"))


@_query("""SELECT event_id, kind, value FROM (SELECT event_id, unnest([{'kind': 'PERSON', 'value': concat('u', user_id)}, {'kind': event_type, 'value': 'x'}]) AS e, FROM events WHERE event_id % 4 < 2) t, LATERAL (SELECT e.kind, e.value) u""")
def reported_entities(spark, sf_dir):
    """Answers as a list, in an object, under the other name, and as something else."""
    items = F.concat(F.lit('[{"type":"PERSON","text":"u'), F.col("user_id"), F.lit('"},7,{"entity_type":"'), F.col("event_type"), F.lit('","text":"x"},{"type":"NONE"}]'))
    kind = F.col("event_id") % 4
    said = F.when(kind == 0, items).when(kind == 1, F.concat(F.lit('see {"results": '), items, F.lit("}"))).when(kind == 2, '"none"')
    return _events(spark, sf_dir).select("event_id", F.inline(text.reported_entities(said))).select("event_id", F.col("type").alias("kind"), "value")


@_query("""SELECT event_id, CASE WHEN user_id % 2 = 0 THEN '[[' ELSE '' END AS held, (CASE WHEN user_id % 2 = 0 THEN 2 ELSE 0 END)::INTEGER AS n FROM events""")
def held_ends(spark, sf_dir):
    told = F.concat(F.col("event_type"), F.when(F.col("user_id") % 2 == 0, " [[").otherwise(" "))
    n = text.held_back(told)
    return _events(spark, sf_dir).select("event_id", F.when(n > 0, F.right(told, n)).otherwise("").alias("held"), n.cast("int").alias("n"))


@_query("""SELECT doc_id, coalesce(regexp_full_match(word, '[A-Za-z0-9][A-Za-z0-9._-]{0,63}'), FALSE) AS plain, coalesce(regexp_full_match(start, '[A-Za-z0-9][A-Za-z0-9._-]{0,63}'), FALSE) AS path
FROM (SELECT doc_id, string_split(text, ' ')[1] AS word, substr(replace(text, ' ', '-'), 1, 60 + doc_id % 10) AS start FROM documents) d""")
def model_names(spark, sf_dir):
    """Whether the first word of a document, and its start without spaces, could name a model."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    start = F.substr(F.replace("text", F.lit(" "), F.lit("-")), F.lit(1), (F.lit(60) + F.col("doc_id") % 10).cast("int"))
    return docs.select("doc_id", text.valid_model_name(F.get(F.split("text", " "), F.lit(0))).alias("plain"), text.valid_model_name(start).alias("path"))


@_query(f"SELECT session_id, text_idx, md5(replace(text, '№', 'No') || ' No x') AS normalized_md5 FROM ({R.TEXTS}) t")
def normalized_texts(spark, sf_dir):
    """Documents with evasions put in: full-width digits, a numero sign, zero-width and no-break characters."""
    rows = R.texts(spark, sf_dir)
    odd = F.concat(F.translate(F.col("text"), "0123456789", "０１２３４５６７８９"), F.lit(" №​ x"))
    return rows.select(*IDS, F.md5(text.normalized(odd).cast("binary")).alias("normalized_md5"))


# Spans from elsewhere.


@_query(f"""SELECT session_id, text_idx, unnest([strpos(text, 'mail') - 1, strpos(text, 'mail') + 3 + strpos(substr(text, strpos(text, 'mail') + 4), 'mail') - 1, strpos(text, 'Ref') - 1]) AS span_start, unnest(['E_MAIL', 'E_MAIL', 'A-B']) AS entity_type FROM ({R.IDENTIFIERS}) t""")
def anchored_values(spark, sf_dir):
    said = F.lit('{"entities":[{"type":"e mail","text":"mail"},{"type":"e mail","text":"mail"},{"type":"a-b","text":"Ref"},{"type":"x","text":"not there"}]}')
    rows = R.identifiers(spark, sf_dir).select(*IDS, F.inline(spans.answered(F.col("text"), said)))
    return rows.select(*IDS, F.col("start").cast("long").alias("span_start"), "entity_type")


@_query("SELECT doc_id, 'PERSON' AS entity_type, 0::BIGINT AS span_start, 5::BIGINT AS span_end, substr(text, 1, 5) AS value FROM documents UNION ALL SELECT doc_id, 'LOCATION', 2, 9, substr(text, 3, 7) FROM documents")
def recognized_spans(spark, sf_dir):
    kinds = F.expr("array(struct('PERSON' entity_type, 0 start, 5 end, 0.9D score), struct('GPE' entity_type, 2 start, 9 end, 0.5D score), struct('PET' entity_type, 1 start, 3 end, 0.9D score), struct('ORG' entity_type, 4 start, 4 end, 0.9D score))")
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.inline(spans.recognized(kinds, F.col("text"))))
    return rows.select("doc_id", "entity_type", F.col("start").cast("long").alias("span_start"), F.col("end").cast("long").alias("span_end"), F.col("text").alias("value"))


@_query(f"WITH RECURSIVE {R.merged_ctes(_NORMAL.format(R.IDENTIFIERS), CODES)} SELECT entity_type, jurisdiction, count(*) AS n FROM spans GROUP BY ALL")
def unmerged_totals(spark, sf_dir):
    """Spans of all rules, those that overlap too."""
    rows = R.identifiers(spark, sf_dir).withColumn("text", text.normalized(F.col("text"))).select(F.inline(spans.all_rule_spans(F.col("text"), CODES)))
    return rows.groupBy("entity_type", "jurisdiction").agg(F.count(F.lit(1)).alias("n"))


@_query(f"""WITH RECURSIVE {R.merged_ctes(_NORMAL.format(R.IDENTIFIERS), CODES)}, cuts AS (SELECT *, lag(span_end, 1, 0) OVER (PARTITION BY session_id, text_idx ORDER BY span_start) AS before FROM merged),
put AS (SELECT c.session_id, c.text_idx, string_agg(substr(x.text, c.before + 1, c.span_start - c.before) || '[[' || c.entity_type || ']]', '' ORDER BY c.span_start) AS head, max(c.span_end) AS last FROM cuts c JOIN texts x USING (session_id, text_idx) GROUP BY ALL)
SELECT x.session_id, x.text_idx, md5(coalesce(p.head, '') || substr(x.text, coalesce(p.last, 0) + 1)) AS masked_md5 FROM texts x LEFT JOIN put p USING (session_id, text_idx)""")
def masked_text(spark, sf_dir):
    return found_identifiers(spark, sf_dir).select(*IDS, F.md5(vault.masked(F.col("normalized"), F.col("spans")).cast("binary")).alias("masked_md5"))


# Whole requests.

_SAID = f"SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY text_idx) - 1 AS text_idx, replace(text, '№', 'No') AS text FROM ({R.IDENTIFIERS}) t"
_SAID_MERGED = "WITH RECURSIVE " + R.merged_ctes(_SAID, CODES)


def _id_payloads(spark, sf_dir: str) -> DataFrame:
    """A payload for each session of identifiers, with a message for each of its texts."""
    message = F.to_json(F.struct(F.lit("user").alias("role"), F.col("text").alias("content")))
    said = R.identifiers(spark, sf_dir).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("text_idx", message.alias("message")))).alias("m"))
    return said.select("session_id", F.concat(F.lit('{"model":"auto","messages":['), F.array_join("m.message", ","), F.lit("]}")).alias("payload"))


@_query(f"{_SAID_MERGED} SELECT t.session_id, FALSE AS blocked, (SELECT count(*) FROM merged m WHERE m.session_id = t.session_id) AS n_entities, count(*) AS n_texts FROM texts t GROUP BY t.session_id")
def sanitized_requests(spark, sf_dir):
    done = sanitize.sanitize(_id_payloads(spark, sf_dir), KEY)
    n_texts = F.size(payload.places(F.try_parse_json("sanitized"))).cast("long")
    return done.requests.select("session_id", "blocked", text.sum_of_counts(F.col("entity_counts")).alias("n_entities"), n_texts.alias("n_texts"))


@_query(f"SELECT session_id, CAST(text_idx AS INTEGER) AS text_idx, text, TRUE AS changed FROM ({_SAID}) t")
def sanitized_requests_restored(spark, sf_dir):
    """The texts of sanitized payloads, restored: those that came in, normalized. Each was changed on its way."""
    done = sanitize.sanitize(_id_payloads(spark, sf_dir), KEY)
    texts = payload.extract(done.requests.select("session_id", F.col("sanitized").alias("payload")))
    back = vault.detokenize(texts, done.tokens, "text")
    return back.select("session_id", "text_idx", F.col("restored").alias("text"), (F.col("text") != F.col("restored")).alias("changed"))


@_query(f"{_SAID_MERGED} SELECT session_id, 'ITIN' AS offending FROM merged WHERE entity_type = 'ITIN' GROUP BY 1")
def blocked_requests(spark, sf_dir):
    policies = spark.sql("SELECT 'p' policy_id, 'o' org_id, 'n' name, 'tokenize' mode, cast(null as array<string>) pack_ids, array('ITIN') blocked_types, cast(null as array<string>) allowed_providers, cast(null as array<string>) redact_types, cast(null as timestamp) created_at")
    done = sanitize.sanitize(_id_payloads(spark, sf_dir).withColumn("policy_id", F.lit("p")), KEY, policies)
    return done.requests.where("blocked").select("session_id", F.array_join("offending", ",").alias("offending"))


# Providers.


@_query(f"SELECT session_id, count(*) AS n_messages, 'gpt-4o-mini' AS model, 'u' AS user FROM ({_TURNS}) t GROUP BY 1")
def chat_requests(spark, sf_dir):
    body = F.parse_json(providers.request(_json("payload"), providers.lookup("openai")))
    get = lambda path, kind="string": F.try_variant_get(body, path, kind)
    return payloads(spark, sf_dir).select("session_id", F.size(get("$.messages", "array<variant>")).cast("long").alias("n_messages"), get("$.model").alias("model"), get("$.user").alias("user"))


@_query(f"SELECT session_id, count(*) FILTER (role <> 'system') AS n_turns, 1024::BIGINT AS max_tokens, NOT bool_or(role = 'system' AND text <> '') AS no_system FROM ({_TURNS}) t GROUP BY 1")
def messages_requests(spark, sf_dir):
    body = F.parse_json(providers.request(_json("payload"), providers.lookup("anthropic")))
    get = lambda path, kind="string": F.try_variant_get(body, path, kind)
    return payloads(spark, sf_dir).select("session_id", F.size(get("$.messages", "array<variant>")).cast("long").alias("n_turns"), get("$.max_tokens", "bigint").alias("max_tokens"), get("$.system").isNull().alias("no_system"))


@_query(f"SELECT session_id, count(*) FILTER (role <> 'system') AS n_turns, count(*) FILTER (role = 'assistant') AS n_model FROM ({_TURNS}) t GROUP BY 1")
def candidates_requests(spark, sf_dir):
    body = F.parse_json(providers.request(_json("payload"), providers.lookup("gemini")))
    turns = F.try_variant_get(body, "$.contents", "array<variant>")
    return payloads(spark, sf_dir).select("session_id", F.size(turns).cast("long").alias("n_turns"), F.size(F.filter(turns, lambda t: F.try_variant_get(t, "$.role", "string") == "model")).cast("long").alias("n_model"))


@_query("SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL WHEN 2 THEN 400 ELSE NULL END::INTEGER AS status FROM events")
def refused_requests(spark, sf_dir):
    kind = F.col("event_id") % 4
    model = F.when(kind == 0, "auto").when(kind == 1, "anthropic.own").when(kind == 2, "other").otherwise("")
    refused = providers.refusal(F.parse_json(F.to_json(F.struct(model.alias("model")))), providers.lookup("bedrock"))
    return _events(spark, sf_dir).select("event_id", refused["status"].alias("status"))


def _said(spark, sf_dir: str) -> DataFrame:
    """Turns with a text, and the text as JSON."""
    quoted = F.to_json(F.struct(F.col("text").alias("t")))
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").where("text <> ''").select("conv_id", "turn", F.substr(quoted, F.lit(6), F.length(quoted) - 6).alias("said"))


_ANSWERS = {
    "openai": '{"choices":[{"message":{"content":%s},"finish_reason":"length"}],"usage":{"prompt_tokens":3,"completion_tokens":4}}',
    "anthropic": '{"content":[{"type":"text","text":%s},{"type":"tool_use","text":"-"}],"stop_reason":"max_tokens","usage":{"input_tokens":3,"output_tokens":4}}',
    "gemini": '{"candidates":[{"content":{"parts":[{"text":%s}]},"finishReason":"MAX_TOKENS"}],"usageMetadata":{"promptTokenCount":3,"candidatesTokenCount":4}}',
    "ollama": '{"message":{"content":%s},"done":false,"prompt_eval_count":3,"eval_count":4}',
}


@_query(" UNION ALL ".join(f"SELECT conv_id, turn, '{name}' AS provider, text AS content, 'length' AS finish_reason, 7::BIGINT AS total_tokens FROM conversations WHERE text <> ''" for name in _ANSWERS))
def provider_answers(spark, sf_dir):
    out = None
    for name, shape in _ANSWERS.items():
        before, after = shape.split("%s")
        read = providers.answer(F.parse_json(F.concat(F.lit(before), F.col("said"), F.lit(after))), providers.lookup(name))
        whole = _said(spark, sf_dir).select("conv_id", "turn", F.lit(name).alias("provider"), read.alias("a"))
        done = providers.completion(F.col("a.content"), F.col("a.finish_reason"), F.lit("m"), F.lit("1"), F.col("a.prompt_tokens"), F.col("a.completion_tokens"))
        rows = whole.withColumn("c", done).select("conv_id", "turn", "provider", F.col("c.choices")[0]["message"]["content"].alias("content"), F.col("c.choices")[0]["finish_reason"].alias("finish_reason"), F.col("c.usage.total_tokens").alias("total_tokens"))
        out = rows if out is None else out.unionByName(rows)
    return out


_STREAMS = {
    "openai": '{"choices":[{"delta":{"content":%s},"finish_reason":null}]}',
    "anthropic": '{"type":"content_block_delta","delta":{"type":"text_delta","text":%s}}',
    "gemini": '{"candidates":[{"content":{"parts":[{"text":%s}]}}]}',
    "ollama": '{"message":{"content":%s},"done":false}',
}


@_query(" UNION ALL ".join(f"SELECT conv_id, turn, '{name}' AS provider, text AS delta, FALSE AS is_end FROM conversations WHERE text <> ''" for name in _STREAMS))
def provider_stream_events(spark, sf_dir):
    out = None
    for name, shape in _STREAMS.items():
        before, after = shape.split("%s")
        read = providers.stream_event(F.parse_json(F.concat(F.lit(before), F.col("said"), F.lit(after))), providers.lookup(name))
        rows = _said(spark, sf_dir).select("conv_id", "turn", F.lit(name).alias("provider"), read["delta"].alias("delta"), read["is_end"].alias("is_end"))
        out = rows if out is None else out.unionByName(rows)
    return out


@_query("SELECT event_id, (CASE event_id % 3 WHEN 0 THEN 429 WHEN 1 THEN 502 END)::INTEGER AS status, CASE event_id % 3 WHEN 0 THEN concat('upstream error: ', event_type) WHEN 1 THEN 'upstream error: ' END AS message FROM events")
def upstream_errors(spark, sf_dir):
    kind = F.col("event_id") % 3
    e = providers.upstream_error(F.when(kind == 0, 429).when(kind == 2, 200), F.when(kind != 1, F.col("event_type")))
    return _events(spark, sf_dir).select("event_id", e["status"].alias("status"), e["message"].alias("message"))


@_query(f"SELECT session_id, count(*) + 1 AS n_lines, md5(string_agg(text, '' ORDER BY n)) AS told_md5 FROM ({_TURNS} AND text <> '') t GROUP BY 1")
def event_streams(spark, sf_dir):
    """Conversations as streams of chunks, and what a client reads of them."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("text is not null and text <> ''")
    delta = F.struct(F.struct(F.col("text").alias("content")).alias("delta"))
    chunks = turns.select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("seq"), F.to_json(F.struct(F.array(delta).alias("choices"))).alias("chunk"))
    none = spark.createDataFrame([], "session_id string, placeholder string, value string")
    lines = sanitize.event_stream(chunks, none).withColumnRenamed("line", "value")
    said = tables.event_data(lines).select("session_id", "seq", payload.delta_text(F.col("event")).alias("text"))
    told = said.groupBy("session_id").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "").cast("binary")).alias("told_md5"))
    return lines.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_lines")).join(told, "session_id")


@_query("SELECT event_id, user_id AS k FROM events WHERE event_id % 3 = 1")
def line_events(spark, sf_dir):
    kind = F.col("event_id") % 3
    lines = _events(spark, sf_dir).select("event_id", F.when(kind == 0, "  ").when(kind == 1, F.to_json(F.struct(F.col("user_id").alias("k")))).otherwise("{oops").alias("value"))
    return tables.line_objects(lines).select("event_id", F.try_variant_get("event", "$.k", "bigint").alias("k"))


@_query("SELECT conv_id, turn, (CASE WHEN 8 + strlen(regexp_replace(coalesce(text, ''), '[^a-zé ]', '', 'g')) > 200 THEN 413 ELSE 200 END)::INTEGER AS status FROM conversations")
def sized_requests(spark, sf_dir):
    """Turns as bodies, of which those over 200 bytes are refused."""
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), "[^a-zé ]", "")
    ok, bad = tables.requests(spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumn("body", F.concat(F.lit('{"a":"'), plain, F.lit('"}'))), 200)
    return ok.select("conv_id", "turn", F.lit(200).alias("status")).unionByName(bad.select("conv_id", "turn", "status"))


@_query(f"SELECT session_id, coalesce(last(text ORDER BY turn) FILTER (role = 'user' AND turn % 2 = 0), '') AS echoed FROM (SELECT * FROM ({_TURNS}) t WHERE turn % 2 = 0) u GROUP BY 1")
def echoed_messages(spark, sf_dir):
    """A stand-in provider's answer to the even turns of each conversation."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("turn % 2 = 0 and text is not null")
    said = turns.groupBy(F.col("conv_id").cast("string").alias("session_id")).agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("messages"))
    return said.select("session_id", tables.echoed(F.parse_json(F.to_json(F.struct("messages")))).alias("echoed"))


# Stored tables.

_KEPT = "SELECT s_suppkey AS k, s_nationkey AS n, 1::BIGINT AS occurrences FROM supplier"


def _suppliers(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("n"), F.lit(1).cast("long").alias("occurrences"))


@_query(f"SELECT k, CASE WHEN k % 3 = 0 THEN -1 ELSE n END AS n FROM ({_KEPT}) t")
def upserted_rows(spark, sf_dir):
    rows = _suppliers(spark, sf_dir).select("k", F.col("n").cast("long").alias("n"))
    return tables.upsert(rows, rows.where("k % 3 = 0").withColumn("n", F.lit(-1).cast("long")), "k")


@_query(f"SELECT k FROM ({_KEPT}) t WHERE k % 4 <> 0")
def inserted_rows(spark, sf_dir):
    rows = _suppliers(spark, sf_dir).select("k")
    return tables.insert_absent(rows.where("k % 4 = 0"), rows, "k")


@_query(f"SELECT k::VARCHAR AS session_id, CASE WHEN k % 2 = 0 THEN 6 ELSE 1 END::BIGINT AS occurrences FROM ({_KEPT}) t")
def bumped_tokens(spark, sf_dir):
    rows = _suppliers(spark, sf_dir).select(F.col("k").cast("string").alias("session_id"), F.lit("f").alias("value_fingerprint"), "occurrences")
    return vault.bumped(rows, rows.where("session_id % 2 = 0").withColumn("occurrences", F.lit(5).cast("long"))).select("session_id", "occurrences")


@_query(f"SELECT k::VARCHAR AS session_id FROM ({_KEPT}) t WHERE k % 2 = 1")
def unseen_tokens(spark, sf_dir):
    rows = _suppliers(spark, sf_dir).select(F.col("k").cast("string").alias("session_id"), F.lit("f").alias("value_fingerprint"))
    return vault.new_tokens(rows, rows.where("session_id % 2 = 0")).select("session_id")


# The log, its pages and scores.


@_query(f"SELECT count(*) AS total FROM ({R.EVENTS}) e WHERE team_id = 'team-3' AND provider = 'error'")
def audit_page_total(spark, sf_dir):
    return dashboard.audit_total(R.events(spark, sf_dir), "team-3", provider="error")


@_query(f"SELECT id, provider FROM ({R.EVENTS}) e WHERE team_id = 'team-5' ORDER BY id DESC LIMIT 20 OFFSET 100")
def clustered_audit_page(spark, sf_dir):
    """The sixth page of a team's events, from a log that is clustered by id in two writes."""
    path, events = f"{shared_folder(spark)}/inkfold/clustered-{uuid.uuid4().hex}", R.events(spark, sf_dir)
    for part in ("id % 2 = 0", "id % 2 = 1"):
        dashboard.cluster(events.where(part), path)
    return dashboard.clustered_page(spark, path, 6, 20, "team-5").select("id", "provider")


@_query(f"SELECT id, 'ITIN,SSN' AS types, TRUE AS blocked, latency_ms IS NOT NULL AND FALSE AS timed FROM ({R.EVENTS}) e WHERE blocked")
def blocked_events(spark, sf_dir):
    rows = R.events(spark, sf_dir).where("blocked").withColumn("offending", F.array(F.lit("ITIN"), F.lit("SSN")))
    out = audit.blocked_event(rows)
    return out.select("id", F.array_join(F.array_sort(F.map_keys("entity_counts")), ",").alias("types"), "blocked", F.col("latency_ms").isNotNull().alias("timed"))


@_query(f"SELECT team_id, max(id) AS id FROM ({R.EVENTS}) e GROUP BY 1")
def last_events(spark, sf_dir):
    """The event whose hash heads each team's chain."""
    log = stored(audit.append(R.events(spark, sf_dir), KEY).select("id", "team_id", "event_hash"), "log")
    heads = audit.last_hashes(log)
    return heads.join(log, (heads["head"] == log["event_hash"]) & (heads["team_id"] == log["team_id"])).select(heads["team_id"], "id")


@_query("SELECT event_id, (CASE WHEN user_id > 0 THEN 21 ELSE 0 END)::BIGINT AS first_row, least(30, user_id)::BIGINT AS last_row, 3::BIGINT AS page, greatest(1, ceil(user_id / 10.0))::BIGINT AS pages FROM events")
def page_bounds(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", dashboard.page_bounds(F.col("user_id"), F.lit(20), F.lit(10)).alias("b")).select("event_id", "b.*")


@_query("SELECT event_id, CASE WHEN user_id % 7 > user_id % 5 THEN 'B,A' WHEN user_id % 7 < user_id % 5 THEN 'A,B' ELSE 'A,B' END AS ordered FROM events")
def sorted_counts(spark, sf_dir):
    counts = F.create_map(F.lit("B"), F.col("user_id") % 7, F.lit("A"), F.col("user_id") % 5)
    return _events(spark, sf_dir).select("event_id", F.array_join(F.transform(dashboard.sorted_counts(counts), lambda x: x["entity_type"]), ",").alias("ordered"))


@_query("SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 'none' WHEN user_id % 3 = 1 THEN 'good' ELSE 'fair' END AS band, CASE WHEN user_id % 3 = 0 THEN '–' WHEN user_id % 3 = 1 THEN '93.4%' ELSE '50.0%' END AS shown, coalesce(strftime(ts, '%Y-%m-%d %H:%M'), '–') AS at FROM events")
def shown_scores(spark, sf_dir):
    score = F.when(F.col("user_id") % 3 == 1, 0.934).when(F.col("user_id") % 3 == 2, 0.5)
    return _events(spark, sf_dir).select("event_id", dashboard.score_band(score).alias("band"), text.percent(score).alias("shown"), dashboard.shown_date(F.col("ts")).alias("at"))


@_query("SELECT round(avg(s_nationkey / 25.0), 9) AS recall, round(avg(1 - s_nationkey / 25.0), 9) AS precision FROM supplier")
def macro_scores(spark, sf_dir):
    sets = _suppliers(spark, sf_dir).select((F.col("n") / 25).alias("recall"), (1 - F.col("n") / 25).alias("precision"))
    return evaluation.macro(sets).select(F.round("recall", 9).alias("recall"), F.round("precision", 9).alias("precision"))


@_query("SELECT s_nationkey AS provider, CASE WHEN s_nationkey % 5 <> 0 THEN round(avg(s_suppkey % 10 / 10.0), 9) END AS answer_fidelity, CASE WHEN s_nationkey % 5 <> 0 THEN count(*) ELSE 0 END AS n_scores FROM supplier GROUP BY 1")
def answer_fidelity(spark, sf_dir):
    rows = _suppliers(spark, sf_dir).select(F.col("n").alias("provider"), F.when(F.col("n") % 5 != 0, F.col("k") % 10 / 10).alias("score"))
    return evaluation.fidelity(rows, "provider").withColumn("answer_fidelity", F.round("answer_fidelity", 9))


@_query("SELECT s_suppkey::VARCHAR AS id FROM supplier ORDER BY s_nationkey DESC, s_suppkey::VARCHAR DESC LIMIT 20")
def latest_runs(spark, sf_dir):
    rows = _suppliers(spark, sf_dir).select(F.col("k").cast("string").alias("id"), F.timestamp_seconds(F.col("n") * 1000).alias("created_at"))
    return dashboard.latest_runs(rows).select("id")


@_query("SELECT n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'mask' ELSE 'tokenize' END AS mode, concat(upper(n_name), ',SIN') AS types, lower(n_name) AS providers FROM nation")
def policies_from_forms(spark, sf_dir):
    form = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 2 == 0, "mask").otherwise("other").alias("mode"), F.concat(F.lit(" "), F.lower("n_name"), F.lit(", ,sin ")).alias("blocked_types"), F.upper("n_name").alias("allowed_providers"))
    return policy.from_form(form).select("name", "mode", F.array_join("blocked_types", ",").alias("types"), F.array_join("allowed_providers", ",").alias("providers"))


@_query("SELECT n_nationkey AS id, concat('request blocked by policy: ', CASE WHEN n_name < 'SIN' THEN concat(n_name, ', SIN') ELSE concat('SIN, ', n_name) END) AS message, 'hard_block' AS code FROM nation")
def block_errors(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("id"), policy.block_error(F.array(F.lit("SIN"), F.col("n_name"), F.lit("SIN"))).alias("e"))
    return rows.select("id", "e.message", "e.code")


_PACK_ROWS = " UNION ALL ".join(f"SELECT '{p.code}' AS code, '{p.version}' AS version, {len(p.entity_types())}::BIGINT AS n_types, {len(p.rules)}::BIGINT AS n_rules" for p in rules.PACKS.values())


@_query(f"WITH RECURSIVE {R.merged_ctes(R.IDENTIFIERS, list(rules.PACKS))} SELECT p.*, count(s.jurisdiction) AS n_spans FROM ({_PACK_ROWS}) p LEFT JOIN spans s ON s.jurisdiction = p.code GROUP BY ALL")
def packs_table(spark, sf_dir):
    """The stored packs, with how much each finds in the identifiers."""
    packs, _ = tables.sync_packs(spark, None)
    n_rules = F.size(F.try_variant_get(F.parse_json("definition"), "$.rules", "array<variant>"))
    found = R.identifiers(spark, sf_dir).select(F.inline(spans.all_rule_spans(F.col("text"), list(rules.PACKS)))).groupBy("jurisdiction").agg(F.count(F.lit(1)).alias("n_spans"))
    rows = packs.select("code", "version", F.size("entity_types").cast("long").alias("n_types"), n_rules.cast("long").alias("n_rules"))
    return rows.join(found.withColumnRenamed("jurisdiction", "code"), "code", "left").withColumn("n_spans", F.coalesce("n_spans", F.lit(0)))


#: A pack of a user's own: values before, between and after other characters, and one without a value.
_OWN_PACK = """{"code":"own","name":"Own","version":"2.1","entity_types":["REFERENCE","FILE","SECOND_PHONE","NETWORK"],"patterns":[
{"type":"REFERENCE","regex":"^ref\\\\s(?P<value>\\\\d{9}), SIN\\\\b","flags":"I|M"},
{"type":"FILE","regex":"(?<=, )file (?P<value>W\\\\d+),","validator":"none"},
{"type":"SECOND_PHONE","regex":"(?:tel|or) (?P<value>\\\\d{3}(?:[.]\\\\d+){2})(?!\\\\d)"},
{"type":"NETWORK","regex":"fe80:(?:\\\\d|:)+"}]}"""


@_query(f"""SELECT session_id, text_idx, u.entity_type, u.span_start, u.span_start + length(u.value) AS span_end, u.value FROM (SELECT session_id, text_idx, unnest([
{{'entity_type': 'REFERENCE', 'span_start': 4, 'value': substr(text, 5, 9)}},
{{'entity_type': 'FILE', 'span_start': strpos(text, ', file W') + 6, 'value': substr(text, strpos(text, ', file W') + 7, 10)}},
{{'entity_type': 'SECOND_PHONE', 'span_start': strpos(text, ' or ') + 3, 'value': substr(text, strpos(text, ' or ') + 4, 12)}},
{{'entity_type': 'NETWORK', 'span_start': strpos(text, 'fe80:') - 1, 'value': substr(text, strpos(text, 'fe80:'), 15)}}]) AS u FROM ({R.IDENTIFIERS}) t) x""")
def own_pack_spans(spark, sf_dir):
    """A pack of one's own from a document, over all identifiers."""
    packs, broken = rules.usable(spark, rules.load_packs([_OWN_PACK]))
    if broken:
        raise ValueError(broken)
    rows = R.identifiers(spark, sf_dir).select(*IDS, F.inline(spans.all_rule_spans(F.col("text"), ["OWN"], packs)))
    return rows.select(*IDS, "entity_type", F.col("start").cast("long").alias("span_start"), F.col("end").cast("long").alias("span_end"), F.col("text").alias("value"))
