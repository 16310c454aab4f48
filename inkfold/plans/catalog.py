"""Registered queries over the library's operators, with their oracle SQL. Each reads its whole tables."""

from __future__ import annotations

import uuid
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfold.functions import rules, text
from inkfold.operators import audit, dashboard, evaluation, payload, policy, providers, spans, vault
from inkfold.plans import relations as R
from inkfold.sources import tables
from inkfold.sources.scratch import shared_folder, stored
from inkfold.streaming import ledger
from inkfold.streaming.restore import emitted, run_restored

KEY, MASTER = b"fingerprint-key-for-tests", bytes(range(32))
CODES = rules.DEFAULT_PACKS
IDS = ["session_id", "text_idx"]
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# Detection: one query for each rule, over documents and identifiers.


def _detect(rule: rules.Rule, code: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.texts(spark, sf_dir).select(*IDS, F.inline(spans.rule_spans(F.col("text"), rule, code)))
    return found.select(*IDS, F.col("start").cast("long").alias("span_start"), F.col("end").cast("long").alias("span_end"), F.col("text").alias("value"))


for _pack in rules.PACKS.values():
    for _rule in _pack.rules:
        _name = f"detect_{_pack.code.lower()}_{_rule.type.lower()}"
        QUERIES[_name] = partial(_detect, _rule, _pack.code)
        ORACLES[_name] = R.spans_sql(_rule, R.TEXTS)


def detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts, normalized, with their merged spans under the default packs, for one use."""
    return spans.detect(R.texts(spark, sf_dir), CODES)


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for several uses: detection runs once for all of them."""
    return stored(detected(spark, sf_dir).select(*IDS, "normalized", "spans"), "found")


def found_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spans.detect(R.identifiers(spark, sf_dir), CODES), "found")


#: Normalization changes one character of these texts.
_NORMAL = "SELECT session_id, text_idx, replace(text, '№', 'No') AS text FROM ({}) raw"
_MERGED = "WITH RECURSIVE " + R.merged_ctes(_NORMAL.format(R.TEXTS), CODES)
_SPAN_SQL = "SELECT session_id, text_idx, span_start, span_end, entity_type, value, jurisdiction FROM merged"


def _spans(rows: DataFrame) -> DataFrame:
    s = rows.select(*IDS, F.inline("spans"))
    return s.select(*IDS, F.col("start").cast("long").alias("span_start"), F.col("end").cast("long").alias("span_end"), "entity_type", F.col("text").alias("value"), "jurisdiction")


@_query(f"{_MERGED} {_SPAN_SQL}")
def merged_spans(spark, sf_dir):
    return _spans(detected(spark, sf_dir))


@_query(f"{_MERGED} {_SPAN_SQL}")
def merged_spans_from_documents(spark, sf_dir):
    """The same spans by packs that were read from documents, with patterns as Python writes them."""
    packs, broken = rules.usable(spark, rules.load_packs(rules.as_documents()))
    if broken:
        raise ValueError(broken)
    return _spans(spans.detect(R.texts(spark, sf_dir), CODES, packs=packs))


@_query("WITH RECURSIVE " + R.merged_ctes(R.IDENTIFIERS, ["ircc", "US", "XX", "us", "EU"]) + " " + _SPAN_SQL)
def merged_spans_chosen_packs(spark, sf_dir):
    return _spans(spans.detect(R.identifiers(spark, sf_dir), ["ircc", "US", "XX", "us", "EU"], normalize=False))


@_query(f"{_MERGED} SELECT session_id, text_idx, entity_type, count(*) AS n FROM merged GROUP BY ALL")
def entity_counts_by_text(spark, sf_dir):
    return detected(spark, sf_dir).select(*IDS, F.explode(spans.counts(F.col("spans"))).alias("entity_type", "n"))


@_query(f"{_MERGED} SELECT entity_type, count(*) AS n FROM merged GROUP BY 1")
def entity_totals(spark, sf_dir):
    return detected(spark, sf_dir).select(F.explode("spans.entity_type").alias("entity_type")).groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"))


@_query("SELECT page_id, count(*) AS n FROM (" + R.spans_sql(rules.PACKS["GENERIC"].rules[1], "SELECT page_id, page_id AS session_id, page_id AS text_idx, html AS text FROM pages").replace("session_id, text_idx", "session_id AS page_id", 1) + ") x GROUP BY 1")
def pages_with_cards(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", spans.rule_spans(F.col("html"), rules.PACKS["GENERIC"].rules[1], "GENERIC").alias("spans"))
    return rows.where(F.size("spans") > 0).select("page_id", F.size("spans").cast("long").alias("n"))


# Policies.

_POLICIES = """SELECT 'p0' AS policy_id, 'tokenize' AS mode, 'EMAIL' AS listed, 'openai' AS allowed UNION ALL SELECT 'p1', 'hard_block', '', '' UNION ALL SELECT 'p2', 'tokenize', 'IBAN,IP_ADDRESS,SIN', 'ollama,openai'"""


def _policies(spark: SparkSession) -> DataFrame:
    rows = spark.sql(_POLICIES)
    items = lambda c: F.filter(F.split(c, ","), lambda x: x != "")
    return rows.select("policy_id", "mode", items("listed").alias("blocked_types"), items("allowed").alias("allowed_providers"), F.when(F.col("listed") != "", items("listed")).alias("redact_types"))


#: The policy of an identifier's session is told by its customer, as both engines can.
_BY_CUSTOMER = "concat('p', CAST(CAST(substr(session_id, 2) AS BIGINT) % 4 AS STRING))"
_ID_MERGED = "WITH RECURSIVE " + R.merged_ctes(_NORMAL.format(R.IDENTIFIERS), CODES)
_JUDGED = f"""{_ID_MERGED}, judged AS (SELECT t.session_id, t.text_idx, coalesce(any_value(p.mode), 'tokenize') AS mode, list_filter(string_split(coalesce(any_value(p.listed), ''), ','), lambda x: x <> '') AS banned,
  list_filter(string_split(coalesce(any_value(p.allowed), ''), ','), lambda x: x <> '') AS allowed, list_sort(list_distinct(list_filter(list(m.entity_type), lambda x: x IS NOT NULL))) AS types
  FROM texts t LEFT JOIN merged m USING (session_id, text_idx) LEFT JOIN ({_POLICIES}) p ON p.policy_id = {_BY_CUSTOMER.replace("session_id", "t.session_id")} GROUP BY ALL)"""


def _judged(spark, sf_dir, **options) -> DataFrame:
    rows = found_identifiers(spark, sf_dir).withColumn("policy_id", F.expr(_BY_CUSTOMER))
    return policy.resolve(rows, _policies(spark), **options).withColumn("types", F.array_distinct("spans.entity_type"))


@_query(f"""{_JUDGED} SELECT session_id, text_idx, mode = 'hard_block' OR len(list_intersect(types, banned)) > 0 AS blocked,
CASE WHEN len(list_intersect(types, banned)) > 0 THEN array_to_string(list_sort(list_intersect(types, banned)), ',') WHEN mode = 'hard_block' THEN array_to_string(types, ',') END AS offending FROM judged""")
def policy_block(spark, sf_dir):
    p, t = F.col("policy"), F.col("types")
    return _judged(spark, sf_dir).select(*IDS, policy.blocked(t, p).alias("blocked"), F.array_join(policy.offending_types(t, p), ",").alias("offending"))


@_query(f"""{_ID_MERGED} SELECT m.session_id, m.text_idx, m.span_start, m.span_end, m.entity_type, m.value, m.jurisdiction FROM merged m LEFT JOIN ({_POLICIES}) p ON p.policy_id = {_BY_CUSTOMER.replace("session_id", "m.session_id")}
WHERE p.policy_id IS NULL OR p.listed = '' OR list_contains(string_split(p.listed, ','), m.entity_type)""")
def policy_filter(spark, sf_dir):
    rows = _judged(spark, sf_dir, honour_redact_types=True)
    return _spans(rows.withColumn("spans", policy.kept_spans(F.col("spans"), F.col("policy"))))


@_query(f"{_JUDGED} SELECT session_id, text_idx, len(allowed) = 0 OR list_contains(allowed, CASE text_idx % 3 WHEN 0 THEN 'openai' WHEN 1 THEN 'ollama' ELSE 'OpenAI' END) AS allowed FROM judged")
def provider_gate(spark, sf_dir):
    named = F.when(F.col("text_idx") % 3 == 0, "openai").when(F.col("text_idx") % 3 == 1, "ollama").otherwise("OpenAI")
    return _judged(spark, sf_dir).select(*IDS, policy.provider_allowed(named, F.col("policy")).alias("allowed"))


# The vault.

_TOKENS = f"""{_MERGED}, held AS (SELECT session_id, max(CAST(regexp_extract(text, '\\[\\[EMAIL_0*([0-9]+)\\]\\]', 1) AS BIGINT)) AS base FROM texts WHERE contains(text, '[[EMAIL_00000') GROUP BY 1),
vals AS (SELECT session_id, entity_type, value, count(*) AS occurrences, row_number() OVER (PARTITION BY session_id ORDER BY min((text_idx, span_start)), entity_type, value) AS n FROM merged GROUP BY session_id, entity_type, value),
tokens AS MATERIALIZED (SELECT v.session_id, v.entity_type, v.value, v.occurrences, concat('[[', v.entity_type, '_', printf('%06x', v.n + coalesce(h.base, 0)), ']]') AS placeholder FROM vals v LEFT JOIN held h USING (session_id))"""
_FINGERPRINT = R.hmac_sql(KEY, "concat(session_id, ':', entity_type, ':', value)")


@_query(f"{_TOKENS} SELECT session_id, entity_type, value, placeholder, {_FINGERPRINT} AS value_fingerprint, occurrences FROM tokens")
def token_map(spark, sf_dir):
    return vault.token_map(found(spark, sf_dir), KEY)


_ONE_SESSION = "WITH RECURSIVE " + R.merged_ctes(_NORMAL.format(f"SELECT 'all' AS session_id, text_idx, text FROM ({R.IDENTIFIERS}) i"), CODES)


@_query(f"{_TOKENS.replace(_MERGED, _ONE_SESSION)} SELECT session_id, entity_type, value, placeholder, {_FINGERPRINT} AS value_fingerprint, occurrences FROM tokens")
def token_map_one_session(spark, sf_dir):
    """All texts are of one session."""
    return vault.token_map(found_identifiers(spark, sf_dir).withColumn("session_id", F.lit("all")), KEY)


@_query(f"{_TOKENS} SELECT session_id, entity_type, value, placeholder, {_FINGERPRINT} AS value_fingerprint, occurrences FROM tokens")
def encrypted_round_trip(spark, sf_dir):
    closed = stored(vault.token_map(found(spark, sf_dir), KEY, master=MASTER), "tokens")
    return vault.opened(closed, MASTER).select("session_id", "entity_type", "value", "placeholder", "value_fingerprint", "occurrences")


@_query(f"""{_TOKENS}, cuts AS (SELECT m.*, t.placeholder, lag(m.span_end, 1, 0) OVER (PARTITION BY m.session_id, m.text_idx ORDER BY m.span_start) AS before FROM merged m JOIN tokens t USING (session_id, entity_type, value)),
put AS (SELECT c.session_id, c.text_idx, string_agg(substr(x.text, c.before + 1, c.span_start - c.before) || c.placeholder, '' ORDER BY c.span_start) AS head, max(c.span_end) AS last FROM cuts c JOIN texts x USING (session_id, text_idx) GROUP BY ALL)
SELECT x.session_id, x.text_idx, md5(coalesce(p.head, '') || substr(x.text, coalesce(p.last, 0) + 1)) AS sanitized_md5 FROM texts x LEFT JOIN put p USING (session_id, text_idx)""")
def tokenized_text(spark, sf_dir):
    rows = found(spark, sf_dir)
    return vault.tokenize(rows, stored(vault.token_map(rows, KEY), "tokens")).select(*IDS, F.md5(F.col("sanitized").cast("binary")).alias("sanitized_md5"))


@_query(f"SELECT session_id, text_idx, md5(replace(text, '№', 'No')) AS restored_md5 FROM ({R.TEXTS}) t")
def detokenized_round_trip(spark, sf_dir):
    rows = found(spark, sf_dir)
    tokens = stored(vault.token_map(rows, KEY), "tokens")
    # Restoring reads its texts three times.
    put = stored(vault.tokenize(rows, tokens).select(*IDS, "sanitized"), "put")
    return vault.detokenize(put, tokens).select(*IDS, F.md5(F.col("restored").cast("binary")).alias("restored_md5"))


@_query(f"SELECT session_id, text_idx, md5(replace(text, '№', 'No')) AS restored_md5 FROM ({R.IDENTIFIERS}) t")
def streamed_round_trip(spark, sf_dir):
    """What a stream of 5-character pieces gives, joined, is the restored text."""
    rows = found_identifiers(spark, sf_dir)
    tokens = stored(vault.token_map(rows, KEY), "tokens")
    told = vault.tokenize(rows, tokens).select(*IDS, emitted(tables.in_pieces(F.col("sanitized"))).alias("told")).join(vault.resolution_maps(tokens), "session_id", "left")
    restored = F.array_join(F.transform("told", lambda t: vault.resolved(t, F.col("known"))), "")
    return told.select(*IDS, F.md5(restored.cast("binary")).alias("restored_md5"))


@_query(f"{_TOKENS.replace(_MERGED, _ID_MERGED)} SELECT session_id, entity_type, value, placeholder, {_FINGERPRINT} AS value_fingerprint, occurrences FROM tokens")
def stored_tokens(spark, sf_dir):
    """A stored table of tokens that gets some of them first, and then all: each is in it once."""
    tokens = stored(vault.token_map(found_identifiers(spark, sf_dir), KEY, master=MASTER), "tokens")
    name = vault.token_table(spark, f"{shared_folder(spark)}/inkfold/tokens-{uuid.uuid4().hex}", 8)
    vault.store_tokens(tokens.where(F.hash("session_id") % 2 == 0), name)
    vault.store_tokens(tokens, name)
    return vault.opened(spark.table(name), MASTER).select("session_id", "entity_type", "value", "placeholder", "value_fingerprint", "occurrences")


@_query(f"SELECT session_id, md5(string_agg(replace(text, '№', 'No'), '|' ORDER BY text_idx)) AS restored_md5 FROM ({R.IDENTIFIERS}) t GROUP BY 1")
def streamed_sessions(spark, sf_dir):
    """A real stream: each session's sanitized texts as numbered chunks, of which every other one comes micro-batches late."""
    rows = found_identifiers(spark, sf_dir)
    tokens = stored(vault.token_map(rows, KEY), "tokens")
    told = vault.tokenize(rows, tokens).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("text_idx", "sanitized"))).alias("t"))
    pieces = told.select("session_id", F.posexplode(tables.in_pieces(F.array_join("t.sanitized", "|"), 512)).alias("seq", "delta"), F.array_join("t.sanitized", "|").alias("whole"))
    chunks = pieces.select("session_id", F.col("seq").cast("long").alias("seq"), "delta", ((F.col("seq") + 1) * 512 >= F.length("whole")).alias("is_end"))
    feed = f"{shared_folder(spark)}/inkfold/chunks-{uuid.uuid4().hex}"
    chunks = stored(chunks, "chunks")
    for late in (1, 0, 2):  # a third each, in an order that isn't theirs
        chunks.where(F.col("seq") % 3 == late).coalesce(1).write.mode("append").parquet(feed)
    source = spark.readStream.schema(chunks.schema).option("maxFilesPerTrigger", 1).parquet(feed)
    restored = run_restored(source, tokens, f"{shared_folder(spark)}/inkfold/restored-{uuid.uuid4().hex}")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "")
    return restored.groupBy("session_id").agg(F.md5(text.cast("binary")).alias("restored_md5"))


# The audit log.

_JSON = """concat('{"api_key_id":"', api_key_id, '","blocked":', CASE WHEN blocked THEN 'true' ELSE 'false' END, ',"completion_tokens":null,"entity_counts":{"EMAIL":', CAST(k AS STRING), ',"SIN":', CAST(k % 3 AS STRING), '},"latency_ms":',
coalesce(CAST(latency_ms AS STRING), 'null'), ',"prompt_tokens":', coalesce(CAST(prompt_tokens AS STRING), 'null'), ',"provider":"', provider, '","route":"', route, '","session_id":null,"team_id":"', team_id, '"}')"""
_CHAIN = f"""WITH RECURSIVE e AS MATERIALIZED (SELECT *, {_JSON} AS body, row_number() OVER (PARTITION BY team_id ORDER BY id) AS n FROM ({R.EVENTS}) x),
chain(team_id, n, id, prev_hash, event_hash) AS (SELECT team_id, n, id, '{audit.GENESIS}', {R.hmac_sql(KEY, f"'{audit.GENESIS}' || body")} FROM e WHERE n = 1
UNION ALL SELECT e.team_id, e.n, e.id, c.event_hash, {R.hmac_sql(KEY, "c.event_hash || e.body")} FROM chain c JOIN e ON e.team_id = c.team_id AND e.n = c.n + 1)"""


@_query(f"{_CHAIN} SELECT team_id, id, prev_hash, event_hash FROM chain")
def audit_chain(spark, sf_dir):
    return audit.append(R.events(spark, sf_dir), KEY).select("team_id", "id", "prev_hash", "event_hash")


@_query(f"SELECT team_id, count(*) AS n_events, CAST(0 AS BIGINT) AS n_broken, TRUE AS valid FROM ({R.EVENTS}) e GROUP BY 1")
def audit_verify(spark, sf_dir):
    return audit.verify(audit.append(R.events(spark, sf_dir), KEY), KEY)


@_query(f"""SELECT team_id, id, NOT (id % 1000 = 0 OR coalesce(before % 1500 = 1, FALSE)) AS intact FROM (SELECT team_id, id, lag(id) OVER (PARTITION BY team_id ORDER BY id) AS before FROM ({R.EVENTS}) e) w WHERE id % 1500 <> 1""")
def audit_tampered(spark, sf_dir):
    """Events whose latency was changed, and those after a deleted event, break the chain."""
    log = audit.append(R.events(spark, sf_dir), KEY).where("id % 1500 <> 1")
    log = log.withColumn("latency_ms", F.when(F.col("id") % 1000 == 0, F.coalesce("latency_ms", F.lit(0)) + 1).otherwise(F.col("latency_ms")))
    return audit.verified(log, KEY).select("team_id", "id", "intact")


def _refusing(log: DataFrame, path: str) -> None:
    """A sink that takes no event that is linked to a session."""
    if not log.where("session_id is not null").isEmpty():
        raise OSError("no such session")
    audit.write(log, path)


@_query(f"{_CHAIN} SELECT team_id, id, prev_hash, event_hash FROM chain")
def audit_unlinked(spark, sf_dir):
    """Two writes of events with session ids, which the sink refuses: they are chained again without, over both writes."""
    events = R.events(spark, sf_dir).withColumn("session_id", F.concat(F.lit("s"), "id"))
    path, half = f"{shared_folder(spark)}/inkfold/audit-{uuid.uuid4().hex}", (events.agg(F.max("id")).first()[0] or 0) // 2
    for part in (events.where(F.col("id") <= half), events.where(F.col("id") > half)):
        if error := audit.write_or_report(part, KEY, path, _refusing):
            raise OSError(error)
    return audit.written(spark, path).select("team_id", "id", "prev_hash", "event_hash")


@_query(f"{_CHAIN} SELECT team_id, id, prev_hash, event_hash, TRUE AS intact FROM chain")
def audit_streamed(spark, sf_dir):
    """The log as the sink of a real stream of four micro-batches, of which two come again."""
    folder = f"{shared_folder(spark)}/inkfold/audit-{uuid.uuid4().hex}"
    events = stored(R.events(spark, sf_dir), "events")
    most = (events.agg(F.max("id")).first()[0] or 0) + 1
    for k in range(4):
        part = events.where((F.col("id") * 4 >= most * k) & (F.col("id") * 4 < most * (k + 1)))
        part.coalesce(1).write.mode("append").parquet(f"{folder}/feed")
    feed = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/feed")
    put = ledger.sink(f"{folder}/log", KEY)

    def twice(batch, batch_id):
        put(batch, batch_id)
        if batch_id % 2:
            put(batch, batch_id)

    feed.writeStream.foreachBatch(twice).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return ledger.verified(spark, f"{folder}/log", KEY).select("team_id", "id", "prev_hash", "event_hash", "intact")


# Dashboard.


@_query(f"SELECT count(*) AS total_requests, count(*) FILTER (blocked) AS blocked_requests, CAST(round_even(quantile_cont(latency_ms, 0.5), 0) AS BIGINT) AS median_latency_ms FROM ({R.EVENTS}) e")
def stats_totals(spark, sf_dir):
    return dashboard.totals(R.events(spark, sf_dir))


@_query(f"SELECT provider, count(*) AS n_requests FROM ({R.EVENTS}) e GROUP BY 1")
def stats_by_provider(spark, sf_dir):
    return dashboard.by_provider(R.events(spark, sf_dir))


@_query(f"SELECT 'EMAIL' AS entity_type, CAST(sum(k) AS BIGINT) AS n_entities FROM ({R.EVENTS}) e UNION ALL SELECT 'SIN', CAST(sum(k % 3) AS BIGINT) FROM ({R.EVENTS}) f")
def stats_by_entity(spark, sf_dir):
    return dashboard.by_entity(R.events(spark, sf_dir))


@_query(f"SELECT provider, n_requests, CAST(sum(n_requests) OVER () AS BIGINT) AS grand_total, n_requests / CAST(max(n_requests) OVER () AS DOUBLE) AS scale FROM (SELECT provider, count(*) AS n_requests FROM ({R.EVENTS}) e GROUP BY 1) g")
def stats_routing(spark, sf_dir):
    return dashboard.shares(dashboard.by_provider(R.events(spark, sf_dir)), "provider", "n_requests")


@_query(f"SELECT id, team_id, provider, blocked, coalesce(latency_ms, -1) AS latency_ms FROM ({R.EVENTS}) e WHERE team_id = 'team-3' ORDER BY id DESC LIMIT 25 OFFSET 50")
def audit_page(spark, sf_dir):
    return dashboard.audit_page(R.events(spark, sf_dir), 25, 50, "team-3").select("id", "team_id", "provider", "blocked", F.coalesce("latency_ms", F.lit(-1)).alias("latency_ms"))


@_query(f"SELECT count(DISTINCT session_id) AS n_sessions FROM ({R.TEXTS}) t")
def session_count(spark, sf_dir):
    return vault.sessions(R.texts(spark, sf_dir)).agg(F.count(F.lit(1)).alias("n_sessions"))


# Evaluation: labels are the merged spans of each text, two characters later, with the first one twice.

_LABELLED = f"""{_ID_MERGED}, numbered AS (SELECT *, row_number() OVER (PARTITION BY session_id, text_idx ORDER BY span_start) AS n FROM merged),
lists AS MATERIALIZED (SELECT session_id, text_idx, list({{'t': entity_type, 's': span_start, 'e': span_end}} ORDER BY span_start) AS found FROM numbered GROUP BY ALL),
labelled AS MATERIALIZED (SELECT session_id, text_idx, found, list_concat([{{'t': found[1].t, 's': found[1].s + 2, 'e': found[1].e + 2}}], list_transform(found, lambda x: {{'t': x.t, 's': x.s + 2, 'e': x.e + 2}})) AS labels FROM lists),
greedy(session_id, text_idx, n, used) AS (SELECT session_id, text_idx, 0, CAST([] AS BIGINT[]) FROM labelled
UNION ALL SELECT g.session_id, g.text_idx, g.n + 1, list_concat(g.used, list_filter(range(1, len(l.found) + 1), lambda i: l.found[i].t = l.labels[g.n + 1].t AND l.found[i].s < l.labels[g.n + 1].e AND l.labels[g.n + 1].s < l.found[i].e AND NOT list_contains(g.used, i))[1:1])
FROM greedy g JOIN labelled l USING (session_id, text_idx) WHERE g.n < len(l.labels)),
scores AS (SELECT session_id, text_idx, CAST(len(g.used) AS BIGINT) AS tp, CAST(len(l.labels) AS BIGINT) AS n_labels, CAST(len(l.found) AS BIGINT) AS n_found FROM greedy g JOIN labelled l USING (session_id, text_idx) WHERE g.n = len(l.labels))"""


def _scores(spark, sf_dir) -> DataFrame:
    rows = found_identifiers(spark, sf_dir)
    late = F.transform("spans", lambda s: F.struct(s["entity_type"].alias("type"), (s["start"] + 2).alias("start"), (s["end"] + 2).alias("end")))
    return evaluation.scored(rows.withColumn("late", late).withColumn("labels", F.concat(F.slice("late", 1, 1), "late")))


@_query(f"{_LABELLED} SELECT * FROM scores")
def greedy_scores(spark, sf_dir):
    return _scores(spark, sf_dir).select(*IDS, "tp", "n_labels", "n_found")


@_query(f"{_LABELLED} SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(n_labels) AS BIGINT) AS n_labels, CAST(sum(n_found) AS BIGINT) AS n_found, sum(tp) / CAST(sum(n_labels) AS DOUBLE) AS recall, sum(tp) / CAST(sum(n_found) AS DOUBLE) AS precision FROM scores")
def recall_precision(spark, sf_dir):
    return evaluation.micro(_scores(spark, sf_dir))


# Chat payloads, made of conversations: every second turn has its text in parts, one of which isn't text.


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    plain = F.to_json(F.struct("role", F.col("text").alias("content")))
    part = F.to_json(F.struct(F.lit("text").alias("type"), "text"))
    parts = F.concat(F.lit('{"role":"'), F.col("role"), F.lit('","content":['), part, F.lit(',{"type":"image_url","image_url":{"url":"x"}}]}'))
    said = turns.withColumn("message", F.when(F.col("turn") % 2 == 0, plain).otherwise(parts))
    whole = said.groupBy(F.col("conv_id").cast("string").alias("session_id")).agg(F.array_sort(F.collect_list(F.struct("turn", "message"))).alias("m"))
    return whole.select("session_id", F.concat(F.lit('{"model":"auto","messages":['), F.array_join("m.message", ","), F.lit('],"user":"u"}')).alias("payload"))


_TURNS = "SELECT CAST(conv_id AS VARCHAR) AS session_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n FROM conversations WHERE text IS NOT NULL"


@_query(f"SELECT session_id, CAST(n AS INTEGER) AS text_idx, CASE WHEN turn % 2 = 0 THEN concat('messages[', turn_no, '].content') ELSE concat('messages[', turn_no, '].content[0].text') END AS path, text FROM (SELECT t.*, row_number() OVER (PARTITION BY session_id ORDER BY turn) - 1 AS turn_no FROM ({_TURNS}) t) u")
def extract_texts(spark, sf_dir):
    return payload.extract(payloads(spark, sf_dir))


@_query(f"SELECT session_id, CAST(n AS INTEGER) AS text_idx, concat('<', text, '>') AS text FROM ({_TURNS}) t")
def inject_texts(spark, sf_dir):
    rows = payloads(spark, sf_dir)
    new = payload.extract(rows).withColumn("sanitized", F.concat(F.lit("<"), F.col("text"), F.lit(">")))
    put = payload.inject(rows, new).select("session_id", F.col("injected").alias("payload"))
    return payload.extract(put).select("session_id", "text_idx", "text")


@_query(f"SELECT session_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (role = 'system' AND text <> '') AS system, count(*) FILTER (role <> 'system') AS n_turns, md5(coalesce(string_agg(CASE WHEN role = 'assistant' THEN 'model' ELSE 'user' END || ':' || text, '|' ORDER BY turn) FILTER (role <> 'system'), '')) AS turns_md5 FROM ({_TURNS}) t GROUP BY 1")
def flattened_messages(spark, sf_dir):
    parts = payloads(spark, sf_dir).select("session_id", providers.system_and_turns(F.try_parse_json("payload"), "model").alias("p"))
    joined = F.array_join(F.transform("p.turns", lambda t: F.concat_ws(":", t["role"], t["content"])), "|")
    return parts.select("session_id", F.col("p.system").alias("system"), F.size("p.turns").cast("long").alias("n_turns"), F.md5(joined.cast("binary")).alias("turns_md5"))


@_query("SELECT event_id, CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS k FROM events WHERE event_id % 5 >= 3")
def server_sent_events(spark, sf_dir):
    """Lines of a stream with comments, end marks and broken data among the events."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.col("event_id") % 5
    lines = rows.select("event_id", F.when(kind == 0, ": ping").when(kind == 1, "data: [DONE]").when(kind == 2, "data: {oops").otherwise(F.concat(F.lit("data: "), F.col("props"))).alias("value"))
    return tables.event_data(lines).select("event_id", F.try_variant_get("event", "$.k", "bigint").alias("k"))


@_query("SELECT event_id, CASE WHEN event_type IN ('default', 'auto', 'gpt', 'model') THEN 'base' ELSE event_type END AS model, CASE WHEN props LIKE '{%' THEN 200 ELSE 400 END AS status FROM events")
def accepted_requests(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("body", F.col("props"))
    ok, bad = tables.requests(rows)
    every = ok.select("event_id", "event_type", F.lit(200).alias("status")).unionByName(bad.select("event_id", "event_type", "status"))
    return every.select("event_id", text.resolve_model(F.col("event_type"), "base").alias("model"), "status")
