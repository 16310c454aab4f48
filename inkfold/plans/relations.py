"""Inputs of the registered queries, as SQL that Spark and the oracle both run, and helpers that write oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkfold.functions.rules import PACKS, Rule, select

#: An order's key makes numbers of which some pass their checks and most don't.
_NUMBERS = """
SELECT o_orderkey AS k, o_custkey AS c,
  lpad(CAST((o_orderkey * 104729 + 130363) % 1000000000 AS STRING), 9, '0') AS a,
  lpad(CAST((o_orderkey * 7368787 + 15485863) % 1000000000 AS STRING), 9, '0') AS b
FROM orders"""
_IDENTIFIERS = f"""
SELECT concat('c', CAST(c AS STRING)) AS session_id, CAST(k AS BIGINT) AS text_idx, concat(
  'Ref ', a, ', SIN ', substr(a, 1, 3), ' ', substr(a, 4, 3), '-', substr(a, 7, 3),
  ', SSN ', substr(b, 1, 3), '-', substr(b, 4, 2), '-', substr(b, 6, 4), ', EIN ', substr(b, 1, 2), '-', substr(b, 3, 7),
  ', itin 9', substr(a, 2, 2), '-', substr(a, 4, 2), '-', substr(a, 6, 4),
  ', BN ', a, CASE WHEN k % 2 = 0 THEN ' RT' ELSE 'RC' END, substr(b, 1, 4), ', neq: ', substr(b, 1, 4), ' ', substr(a, 1, 3), '-', substr(a, 4, 3),
  ', card 4', substr(a, 1, 3), ' ', substr(a, 4, 4), '-', substr(b, 1, 4), ' ', substr(b, 5, 4),
  ', tel +1 (', substr(b, 1, 3), ') ', substr(a, 1, 3), '-', substr(b, 5, 4), ' or ', substr(a, 1, 3), '.', substr(a, 4, 3), '.', substr(b, 1, 4),
  ', ip ', CAST(k % 300 AS STRING), '.', CAST(c % 256 AS STRING), '.0.', CAST(k % 7 AS STRING), ', v6 fe80:', substr(b, 1, 4), '::', substr(a, 1, 4),
  ', iban GB', substr(a, 1, 2), ' AB12 ', substr(b, 1, 4), ' ', substr(a, 3, 4), ' ', substr(b, 5, 3),
  ', UA', substr(b, 3, 2), ' ', substr(a, 1, 4), ' ', substr(b, 1, 4), ' ', substr(a, 5, 4), ' ', substr(b, 5, 4), ' AB1', substr(a, 9, 1), ' ', substr(b, 1, 5),
  ', VAT DE', a, ' and FR X', substr(a, 1, 1), substr(b, 1, 5), ', dob: 19', substr(a, 1, 2), '-', substr(b, 1, 2), '-', substr(b, 3, 2), ', DOB 01.02.19', substr(a, 1, 2),
  ', ІПН № ', b, substr(a, 1, 1), ', єдрпоу: ', substr(b, 1, 8), ', client id ', substr(a, 1, 4), '-', substr(b, 1, 6), ', file W', a,
  ', mail user.', CAST(c AS STRING), '@mail.example.org', CASE WHEN k % 97 = 0 THEN concat(', was [[EMAIL_00000', CAST(k % 10 AS STRING), ']]') ELSE '' END
) AS text FROM ({_NUMBERS}) n"""
#: Texts of all documents and of identifiers made from all orders.
TEXTS = f"SELECT concat('d', CAST(doc_id AS STRING)) AS session_id, CAST(0 AS BIGINT) AS text_idx, text FROM documents UNION ALL {_IDENTIFIERS}"
IDENTIFIERS = _IDENTIFIERS

EVENTS = """
SELECT event_id AS id, concat('team-', CAST(user_id % 40 AS STRING)) AS team_id, concat('key-', CAST(user_id AS STRING)) AS api_key_id,
  CAST(NULL AS STRING) AS session_id, '/v1/chat/completions' AS route, event_type AS provider, CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS k,
  event_type = 'error' AS blocked, CAST(floor(value) AS BIGINT) AS prompt_tokens, CAST(NULL AS BIGINT) AS completion_tokens,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(floor(value * 10) AS BIGINT) END AS latency_ms
FROM events"""


def views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for n in names:
        spark.read.parquet(f"{sf_dir}/{n}.parquet").createOrReplaceTempView(n)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if a small input came in fewer partitions; as it is otherwise, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "documents", "orders")
    return spread(spark.sql(TEXTS))


def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "orders")
    return spread(spark.sql(IDENTIFIERS))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "events")
    return spark.sql(f"SELECT id, team_id, api_key_id, session_id, route, provider, map('EMAIL', k, 'SIN', k % 3) AS entity_counts, blocked, prompt_tokens, completion_tokens, latency_ms FROM ({EVENTS}) e")


# What follows writes SQL for the oracle only.


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: The oracle's patterns know ASCII words only: letters of the texts' other alphabets become a word character.
_FOREIGN = "[À-ÖØ-öø-ÿĀ-žͰ-ϿЀ-ӿ]"


def _luhn(d: str) -> str:
    x = f"CAST(substr(reverse({d}), CAST(j AS BIGINT), 1) AS INTEGER)"
    total = f"list_sum(list_transform(range(1, length({d}) + 1), lambda j: CASE WHEN j % 2 = 1 THEN {x} WHEN {x} > 4 THEN 2 * {x} - 9 ELSE 2 * {x} END))"
    return f"(length({d}) >= 2 AND CAST({total} AS BIGINT) % 10 = 0)"


def _iban(value: str) -> str:
    v = f"upper(regexp_replace({value}, '[\\s-]', '', 'g'))"
    digits = f"list_aggregate(list_transform(string_split(substr({v}, 5) || substr({v}, 1, 4), ''), lambda c: CASE WHEN c >= 'A' THEN CAST(ascii(c) - 55 AS VARCHAR) ELSE c END), 'string_agg', '')"
    out = f"CAST(substr({digits}, 1, 30) AS HUGEINT) % 97"
    for start in (31, 61):
        out = f"CAST(CAST({out} AS VARCHAR) || substr({digits}, {start}, 30) AS HUGEINT) % 97"
    return f"({out} = 1)"


def valid_sql(validator: str | None, value: str) -> str:
    d = f"regexp_replace({value}, '[\\s-]', '', 'g')"
    two = f"CAST(substr({d}, 4, 2) AS INTEGER)"
    return {
        None: "TRUE",
        "luhn": _luhn(d),
        "sin_check": f"(substr({d}, 1, 1) NOT IN ('0', '8') AND {_luhn(d)})",
        "iban_mod97": _iban(value),
        "ssn_check": f"(substr({d}, 1, 3) NOT IN ('000', '666') AND substr({d}, 1, 1) <> '9' AND substr({d}, 4, 2) <> '00' AND substr({d}, 6, 4) <> '0000')",
        "ein_check": f"substr({d}, 1, 2) NOT IN ('07', '08', '09', '17', '18', '19', '28', '29', '49', '78', '79', '89')",
        "itin_check": f"(substr({d}, 1, 1) = '9' AND ({two} BETWEEN 50 AND 65 OR {two} BETWEEN 70 AND 88 OR {two} BETWEEN 90 AND 92 OR {two} BETWEEN 94 AND 99))",
        "edrpou_check": f"length({d}) = 8",
        "ipn_check": f"length({d}) = 10",
        "uci_check": f"length({d}) BETWEEN 8 AND 10",
    }[validator]


def spans_sql(rule: Rule, source: str) -> str:
    """session_id, text_idx, span_start, span_end, value of a rule's valid spans in source."""
    text = "text" if rule.type == "EMAIL" or rule.ignore_case or rule.type == "DATE_OF_BIRTH" else f"regexp_replace(text, '{_FOREIGN}', '_', 'g')"
    pattern = quoted(("(?i)" if rule.ignore_case else "") + rule.pattern)
    put = "'\\1' || chr(1) || '\\2' || chr(2)" if rule.value else "chr(1) || '\\0' || chr(2)"
    return f"""SELECT session_id, text_idx, span_start, span_start + CAST(length(value) AS BIGINT) AS span_end, value FROM (
  SELECT session_id, text_idx, CAST(list_sum(list_transform(p[1:i - 1], lambda x: length(x))) AS BIGINT) - (i - 2) AS span_start, split_part(p[i], chr(2), 1) AS value
  FROM (SELECT session_id, text_idx, p, unnest(range(2, len(p) + 1)) AS i FROM (SELECT session_id, text_idx, string_split(regexp_replace({text}, {pattern}, {put}, 'g'), chr(1)) AS p FROM ({source}) t) u) w
) z WHERE {valid_sql(rule.validator, "value")}"""


def merged_ctes(source: str, codes) -> str:
    """CTEs that end in `merged`: session_id, text_idx, k, span_start, span_end, entity_type, value, jurisdiction. To follow WITH RECURSIVE."""
    parts, order = [], 0
    for pack in select(codes, PACKS):
        for rule in pack.rules:
            parts.append(f"SELECT *, {order} AS r, {quoted(rule.type)} AS entity_type, {quoted(pack.code)} AS jurisdiction FROM ({spans_sql(rule, 'SELECT * FROM texts')}) x")
            order += 1
    every = " UNION ALL ".join(parts)
    names = ("span_start", "span_end", "entity_type", "value", "jurisdiction")
    apart, longer = "w.span_end <= s.span_start", "s.span_end - s.span_start > w.span_end - w.span_start"
    picked = ", ".join(f"CASE WHEN {apart} OR {longer} THEN s.{c} ELSE w.{c} END" for c in names)
    own = ", ".join(names)
    return f"""texts AS MATERIALIZED ({source}),
spans AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY session_id, text_idx ORDER BY span_start, span_end - span_start DESC, r) AS k FROM ({every}) e),
sweep(session_id, text_idx, k, {own}, fresh) AS (
  SELECT session_id, text_idx, k, {own}, TRUE FROM spans WHERE k = 1
  UNION ALL SELECT s.session_id, s.text_idx, s.k, {picked}, {apart} FROM sweep w JOIN spans s ON s.session_id = w.session_id AND s.text_idx = w.text_idx AND s.k = w.k + 1),
merged AS MATERIALIZED (SELECT session_id, text_idx, k, {own} FROM sweep QUALIFY coalesce(lead(fresh) OVER (PARTITION BY session_id, text_idx ORDER BY k), TRUE))"""


def hmac_sql(key: bytes, message: str) -> str:
    block = key.ljust(64, b"\0")
    inner, outer = (bytes(b ^ pad for b in block).hex() for pad in (0x36, 0x5C))
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({message}))))"
