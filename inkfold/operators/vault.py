"""A keyed vault: values become consistent placeholders within a session, and come back from them.

`token_map` holds one row for each (session, type, value); (session_id, value_fingerprint) and (session_id, placeholder)
are unique in it. Suffixes come from the order in which a session's values first occur, not from the values, and never
equal one that the session's texts already hold, so a retried task gives the same placeholders again.
"""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkfold.functions.text import PLACEHOLDER, find_placeholders, hmac_sha256, make_placeholder
from inkfold.operators import scanning
from inkfold.operators.spans import once
from inkfold.sources import bucketed

KEY_INFO = b"session-data-key-v1"
#: Suffixes of input texts from here on can't meet ours.
FAR = 16**10


def fingerprint(key: bytes, session: Column, entity_type: Column, value: Column) -> Column:
    return hmac_sha256(key, F.concat_ws(":", session.cast("string"), entity_type, value))


def hkdf(master: bytes, salt: bytes, info: bytes, length: int = 32) -> bytes:
    """HKDF-SHA256 (RFC 5869)."""
    first, block, out = hmac.new(salt, master, hashlib.sha256).digest(), b"", b""
    while len(out) < length:
        block = hmac.new(first, block + info + bytes([len(out) // 32 + 1]), hashlib.sha256).digest()
        out += block
    return out[:length]


def session_key(master: bytes, session: Column, info: bytes = KEY_INFO) -> Column:
    """A session's 32-byte key: HKDF-SHA256 (RFC 5869) of the master key, with the session id as salt."""
    if len(master) != 32:
        raise ValueError("the master key must have 32 bytes")

    @F.pandas_udf(T.BinaryType())
    def derive(sessions: pd.Series) -> pd.Series:
        return sessions.map(lambda s: hkdf(master, s.encode(), info), na_action="ignore")

    return derive(session.cast("string"))


def encrypted(value: Column, key: Column) -> Column:
    """AES-256-GCM with a random nonce in front: nonce, ciphertext, tag."""
    return F.aes_encrypt(value.cast("binary"), key, F.lit("GCM"), F.lit("DEFAULT"))


def decrypted(blob: Column, key: Column) -> Column:
    return F.aes_decrypt(blob, key, F.lit("GCM"), F.lit("DEFAULT")).cast("string")


def _base_suffixes(texts: DataFrame) -> DataFrame:
    """(session_id, base) of sessions whose texts already hold placeholders."""
    held = texts.where(F.contains("normalized", F.lit("[["))).select("session_id", F.explode(F.regexp_extract_all("normalized", F.lit(PLACEHOLDER), F.lit(2))).alias("suffix"))
    number = F.conv("suffix", 16, 10).cast("long")
    return held.where(number < FAR).groupBy("session_id").agg(F.max(number).alias("base"))


#: Values that first occur in so many texts in a row are numbered together.
BLOCK = 1 << 10


def _numbered(values: DataFrame, bases: DataFrame) -> DataFrame:
    """values with ordinal: their place among a session's values, by where each first occurs, after the session's base. Each
    block of a session's texts is ranked by itself, and starts after as many values as the blocks before it have; one session
    that holds all rows is numbered by as many tasks as it has blocks."""
    rows = values.withColumn("_block", F.floor(F.col("first.text_idx") / BLOCK))
    local = F.row_number().over(Window.partitionBy("session_id", "_block").orderBy("first", "entity_type", "value"))
    before = F.sum("n").over(Window.partitionBy("session_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    sizes = rows.groupBy("session_id", "_block").agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.withColumn("_before", F.coalesce(before, F.lit(0))).join(bases, "session_id", "left")
    starts = starts.select(F.col("session_id").alias("_session"), F.col("_block").alias("_start"), (F.col("_before") + F.coalesce("base", F.lit(0))).alias("_before"))
    same = F.col("session_id").eqNullSafe(F.col("_session")) & F.col("_block").eqNullSafe(F.col("_start"))
    ranked = rows.withColumn("_local", local).join(starts, same)
    return ranked.withColumn("ordinal", F.col("_local") + F.col("_before")).drop("_block", "_local", "_session", "_start", "_before")


def token_map(found: DataFrame, key: bytes, *, master: bytes | None = None) -> DataFrame:
    """found: session_id, text_idx, normalized, spans. A row for each (session, type, value) with its placeholder,
    fingerprint, occurrences and value; with a master key value_ciphertext in place of value."""
    rows = found.select("session_id", "text_idx", F.inline("spans"))
    values = rows.groupBy("session_id", "entity_type", F.col("text").alias("value")).agg(F.count(F.lit(1)).alias("occurrences"), F.min(F.struct("text_idx", "start")).alias("first"))
    values = _numbered(values, _base_suffixes(found))
    suffix = F.lower(F.hex("ordinal"))
    suffix = F.when(F.length(suffix) < 6, F.lpad(suffix, 6, "0")).otherwise(suffix)
    out = values.select(
        "session_id", "entity_type", "value", make_placeholder(F.col("entity_type"), suffix).alias("placeholder"),
        fingerprint(key, F.col("session_id"), F.col("entity_type"), F.col("value")).alias("value_fingerprint"), "occurrences",
    )
    if master is None:
        return out
    keys = out.select("session_id").distinct().withColumn("data_key", session_key(master, F.col("session_id")))
    return out.join(keys, "session_id").withColumn("value_ciphertext", encrypted(F.col("value"), F.col("data_key"))).drop("value", "data_key")


def opened(tokens: DataFrame, master: bytes) -> DataFrame:
    """token_map with its values decrypted; another master key fails."""
    keys = tokens.select("session_id").distinct().withColumn("data_key", session_key(master, F.col("session_id")))
    return tokens.join(keys, "session_id").withColumn("value", decrypted(F.col("value_ciphertext"), F.col("data_key"))).drop("value_ciphertext", "data_key")


def _replaced(text: Column, cuts: Column, before: str = "", after: str = "", *, put: str = "put") -> Column:
    """text with each of cuts (start, end, put; sorted, disjoint) replaced by put between before and after."""

    def replace(texts: pa.Array, starts: pa.Array, ends: pa.Array, puts: pa.Array) -> pa.Array:
        if before or after:
            flat = pc.binary_join_element_wise(before, puts.flatten(), after, "")
            counts = pc.fill_null(pc.list_value_length(puts), 0).to_numpy()
            puts = pa.ListArray.from_arrays(pa.array([0, *counts.cumsum()], pa.int32()), flat)
        return scanning.replaced(texts, starts, ends, puts)

    return F.arrow_udf(replace, T.StringType())(text, cuts["start"], cuts["end"], cuts[put])


def masked(text: Column, spans: Column) -> Column:
    """text with each span replaced by its type alone, which can't be undone."""
    return _replaced(text, spans, "[[", "]]", put="entity_type")


def tokenize(found: DataFrame, tokens: DataFrame) -> DataFrame:
    """found (session_id, text_idx, normalized, spans) with `sanitized`. Texts without spans take no part in the joins."""
    ids = ["session_id", "text_idx"]
    hit = found.where(F.size("spans") > 0)
    cuts = hit.select(*ids, F.inline("spans")).withColumnRenamed("text", "value").join(tokens.select("session_id", "entity_type", "value", "placeholder"), ["session_id", "entity_type", "value"])
    cuts = cuts.groupBy(*ids).agg(F.array_sort(F.collect_list(F.struct("start", "end", F.col("placeholder").alias("put")))).alias("cuts"))
    put = hit.join(cuts, ids).withColumn("sanitized", _replaced(F.col("normalized"), F.col("cuts"))).drop("cuts")
    return put.unionByName(found.where(F.coalesce(F.size("spans"), F.lit(0)) <= 0).withColumn("sanitized", F.col("normalized")))


def resolution_maps(tokens: DataFrame) -> DataFrame:
    """(session_id, known): a session's placeholders and their values, for streams, whose state holds them."""
    return tokens.groupBy("session_id").agg(F.map_from_entries(F.collect_list(F.struct("placeholder", "value"))).alias("known"))


def resolved(text: Column, known: Column) -> Column:
    """text with the placeholders of known replaced by their values; all else stays as it is."""
    between, marks = F.split(text, PLACEHOLDER), F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(0))
    put = once(marks, lambda m: F.transform(between, lambda x, i: F.concat(x, F.coalesce(F.element_at(known, F.get(m, i)), F.get(m, i), F.lit("")))))
    return F.when(F.contains(text, F.lit("[[")) & known.isNotNull(), F.array_join(put, "")).otherwise(text)


def detokenize(texts: DataFrame, tokens: DataFrame, column: str = "sanitized") -> DataFrame:
    """texts (session_id, column) with `restored`. Each text meets the tokens that it holds, by session and placeholder, and
    no others, so nothing grows with a session."""
    held = F.coalesce(F.array_distinct(find_placeholders(F.col(column))), F.array().cast("array<string>"))
    # Texts of a session with one hash would share their tokens, which does no harm.
    marked = texts.withColumns({"_held": held, "_hash": F.xxhash64(column)})
    asked = marked.where(F.size("_held") > 0).select("session_id", "_hash", F.explode("_held").alias("placeholder")).distinct()
    met = asked.join(tokens.select("session_id", "placeholder", "value"), ["session_id", "placeholder"])
    known = met.groupBy("session_id", "_hash").agg(F.map_from_entries(F.collect_list(F.struct("placeholder", "value"))).alias("_known"))
    put = marked.where(F.size("_held") > 0).join(known, ["session_id", "_hash"], "left").withColumn("restored", resolved(F.col(column), F.col("_known")))
    rest = marked.where(F.size("_held") == 0).withColumn("restored", F.col(column))
    return put.select(*texts.columns, "restored").unionByName(rest.select(*texts.columns, "restored"))


def sessions(found: DataFrame, ttl_hours: int = 24) -> DataFrame:
    """A row for each session id, with its expiry."""
    return found.select("session_id").distinct().select("session_id", F.lit(None).cast("string").alias("document_hash"), F.current_timestamp().alias("created_at"), (F.current_timestamp() + F.expr(f"INTERVAL {int(ttl_hours)} HOURS")).alias("expires_at"))


#: What tells a stored token from others, and the columns of the table of tokens.
TOKEN_KEYS = ("session_id", "value_fingerprint")
TOKEN_COLUMNS = "session_id string, entity_type string, placeholder string, value_fingerprint string, value_ciphertext binary, occurrences bigint"


def token_table(spark: SparkSession, path: str, buckets: int = 64) -> str:
    """The name of the stored table of tokens at path, in buckets by session and fingerprint."""
    return bucketed.table(spark, path, TOKEN_COLUMNS, TOKEN_KEYS, buckets)


def store_tokens(tokens: DataFrame, name: str) -> None:
    """Append the tokens (with value_ciphertext) that the table lacks; it isn't shuffled, however large it is."""
    bucketed.insert_absent(tokens, name, TOKEN_KEYS)


def new_tokens(tokens: DataFrame, stored: DataFrame) -> DataFrame:
    """Tokens that aren't stored yet, to be appended (insert or do nothing)."""
    return tokens.join(stored.select("session_id", "value_fingerprint"), ["session_id", "value_fingerprint"], "left_anti")


def bumped(stored: DataFrame, tokens: DataFrame) -> DataFrame:
    """The stored tokens with the occurrences of the same values in tokens added."""
    more = tokens.select("session_id", "value_fingerprint", F.col("occurrences").alias("more"))
    return stored.join(more, ["session_id", "value_fingerprint"], "left").withColumn("occurrences", F.col("occurrences") + F.coalesce("more", F.lit(0))).drop("more")
