"""Scalar functions over text, as column expressions."""

from __future__ import annotations

import base64
import hashlib
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Invisible characters that normalization deletes.
INVISIBLE = "​‌‍⁠﻿­"
#: Fixed value: the grammar of a placeholder; the groups are its type and its suffix.
PLACEHOLDER = r"\[\[([A-Z][A-Z0-9_]*)_([0-9a-f]{4,12})\]\]"
#: Fixed value: the end of a text that could be the start of a placeholder.
PARTIAL_END = r"\[(?:\[[A-Z0-9_]*(?:_[0-9a-f]*)?\]?)?\z"
LONGEST_PLACEHOLDER = 64
#: Names that stand for a provider's default model.
GENERIC_MODELS = ("", "default", "auto", "gpt", "model")


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def normalized(text: Column) -> Column:
    """NFKC, then without invisible characters. Python sees only rows that aren't plain ASCII; null stays null."""
    foreign = F.when(text.rlike(r"[^\x00-\x7F]"), text)
    return F.translate(F.coalesce(_nfkc(foreign), text), INVISIBLE, "")


def without_separators(text: Column) -> Column:
    """text without white space and hyphens."""
    return F.regexp_replace(text, r"(?U)[\s-]", "")


def make_placeholder(entity_type: Column, suffix: Column) -> Column:
    return F.concat(F.lit("[["), entity_type, F.lit("_"), suffix, F.lit("]]"))


def find_placeholders(text: Column) -> Column:
    """The placeholders in text, in order; an empty array without any."""
    return F.when(F.contains(text, F.lit("[[")), F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(0))).otherwise(F.array().cast("array<string>"))


def partial_end_length(text: Column) -> Column:
    """How many characters at the end of text could be the start of a placeholder."""
    return F.length(F.regexp_extract(text, PARTIAL_END, 0))


def held_back(text: Column) -> Column:
    """The same as a stream holds back: nothing if it is longer than any placeholder."""
    n = partial_end_length(text)
    return F.when(n <= LONGEST_PLACEHOLDER, n).otherwise(0)


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 as lower-case hexadecimal digits (RFC 2104), in built-in functions.

    Literals derived from the key show in plans and event logs: give production keys through a secret-redacted session.
    """
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (bytearray(b ^ pad for b in block) for pad in (0x36, 0x5C))
    first = F.unhex(F.sha2(F.concat(F.lit(inner), message.cast("binary")), 256))
    return F.sha2(F.concat(F.lit(outer), first), 256)


def _ascii_escaped(json: Column) -> Column:
    def escape(c: Column) -> Column:
        code = F.ascii(c)
        unit = lambda n: F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(n), 4, "0")))
        high = F.lit(0xD800) + F.shiftright(code - 0x10000, 10)
        low = F.lit(0xDC00) + F.expr("0") + (code - 0x10000).bitwiseAND(F.lit(0x3FF))
        return F.when(code < 128, c).when(code < 0x10000, unit(code)).otherwise(F.concat(unit(high), unit(low)))

    return F.when(json.rlike(r"[^\x00-\x7F]"), F.array_join(F.transform(F.split(json, ""), escape), "")).otherwise(json)


def sorted_map(entries: Column) -> Column:
    """A map with its keys in order."""
    return F.map_from_entries(F.array_sort(F.map_entries(entries)))


def canonical_json(**fields: Column) -> Column:
    """Compact JSON with sorted keys, nulls kept, and everything but ASCII escaped."""
    return _ascii_escaped(F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"}))


def resolve_model(model: Column, default: Column | str, aliases: tuple[str, ...] = ()) -> Column:
    """model, or the default where it is a generic name or one of aliases."""
    default = F.lit(default) if isinstance(default, str) else default
    return F.when(F.lower(F.trim(F.coalesce(model, F.lit("")))).isin(*GENERIC_MODELS, *aliases), default).otherwise(model)


def valid_model_name(model: Column) -> Column:
    return F.coalesce(model.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]{0,63}\z"), F.lit(False))


def judge_score(answer: Column) -> Column:
    """The first "score" number in a judge's answer, held between 0 and 1; null without one."""
    found = F.regexp_extract(answer, r'"score"\s*:\s*(-?[0-9]+(?:\.[0-9]+)?)', 1)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.expr("cast(null as double)") if answer is None else found.try_cast("double"))) + F.when(found == "", F.lit(None)).otherwise(0.0)


def bearer_token(header: Column) -> Column:
    """What follows the first word of an authorization header, if that is "bearer"; null for any other header."""
    found = F.regexp_extract(header, r"(?isU)^\s*bearer\s+(\S.*?)\s*\z", 1)
    return F.when(found != "", found)


def decoded_key(text: str | None, *, production: bool = False, name: str = "key") -> bytes:
    """A key of 32 bytes from base64. Without one a fixed, insecure key stands in, but never in production."""
    if not text:
        if production:
            raise ValueError(f"{name} must be set in production")
        return hashlib.sha256(f"insecure {name}".encode()).digest()
    try:
        raw = base64.b64decode(text, validate=True)
    except ValueError as e:
        raise ValueError(f"{name} must be base64") from e
    if len(raw) != 32:
        raise ValueError(f"{name} must have 32 bytes")
    return raw


def salvaged_json(answer: Column) -> Column:
    """A model's answer as VARIANT: without code fences, else its first {...} block; null if neither is JSON."""
    bare = F.regexp_replace(F.trim(answer), r"^```[A-Za-z]*\s*|\s*```$", "")
    return F.coalesce(F.try_parse_json(bare), F.try_parse_json(F.regexp_extract(answer, r"(?s)\{.*\}", 0)))


def reported_entities(answer: Column) -> Column:
    """What a model's answer names: array<struct<type, value>>, from a list or from an object's `entities` or `results`. Items
    that aren't objects with a type (or entity_type) and a text are skipped; an answer that isn't JSON names nothing."""
    listed = "array<variant>"
    # An answer may be a list by itself, which has no {...} around it.
    bare = F.try_parse_json(F.regexp_replace(F.trim(answer), r"^```[A-Za-z]*\s*|\s*```$", ""))
    whole = F.coalesce(bare, salvaged_json(answer))
    inside = lambda path: F.try_variant_get(whole, path, listed)
    items = F.coalesce(F.try_variant_get(whole, "$", listed), F.when(F.size(inside("$.entities")) > 0, inside("$.entities")), inside("$.results"), F.array().cast(listed))

    def string(item: Column, path: str) -> Column:
        v = F.try_variant_get(item, path, "variant")
        return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))

    kind = lambda x: F.coalesce(F.nullif(string(x, "$.type"), F.lit("")), string(x, "$.entity_type"))
    named = F.transform(items, lambda x: F.struct(kind(x).alias("type"), string(x, "$.text").alias("value")))
    return F.filter(named, lambda x: x["type"].isNotNull() & (x["value"] != ""))


def percent(share: Column) -> Column:
    """A share as per cent with one decimal; a dash for null."""
    return F.coalesce(F.concat(F.format_number(share * 100, 1), F.lit("%")), F.lit("–"))


def sum_of_counts(counts: Column) -> Column:
    return F.coalesce(F.aggregate(F.map_values(counts), F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))
