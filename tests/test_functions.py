from __future__ import annotations

import re

import hashlib
import hmac
import json
import unicodedata

import pytest
from pyspark.sql import functions as F

from inkfold.functions import checksums, rules, text
from inkfold.operators import spans


def one(spark, column, **values):
    """The value of column over one row of string columns."""
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names)).select(column.alias("out")).first()["out"]


def luhn_digit(body: str) -> str:
    return next(str(d) for d in range(10) if sum(int(x) if i % 2 == 0 else sum(divmod(2 * int(x), 10)) for i, x in enumerate(reversed(body + str(d)))) % 10 == 0)


def iban(country: str, body: str) -> str:
    number = int("".join(str(int(c, 36)) for c in body + country + "00"))
    return f"{country}{98 - number % 97:02d}{body}"


SIN = "12345678" + luhn_digit("12345678")
CARD = "400000000000123" + luhn_digit("400000000000123")
GOOD = iban("GB", "ABCD12345612345678")
VECTORS = [
    ("luhn", CARD, True), ("luhn", " ".join(CARD[i : i + 4] for i in range(0, 16, 4)), True), ("luhn", CARD[:-1] + str((int(CARD[-1]) + 1) % 10), False), ("luhn", "0", False), ("luhn", "", False), ("luhn", "12a4", False), ("luhn", None, False),
    ("sin_check", SIN, True), ("sin_check", f"{SIN[:3]}-{SIN[3:6]} {SIN[6:]}", True), ("sin_check", "0" + SIN[1:], False), ("sin_check", "8" + SIN[1:], False), ("sin_check", SIN[:8], False),
    ("iban_mod97", GOOD, True), ("iban_mod97", GOOD.lower(), True), ("iban_mod97", " ".join(GOOD[i : i + 4] for i in range(0, len(GOOD), 4)), True), ("iban_mod97", GOOD[:-1] + "0", False), ("iban_mod97", "GB00", False), ("iban_mod97", iban("UA", "3996220000026007233566001"), True), ("iban_mod97", "A" * 40, False),
    ("ssn_check", "123-45-6789", True), ("ssn_check", "000-12-3456", False), ("ssn_check", "666-12-3456", False), ("ssn_check", "912-12-3456", False), ("ssn_check", "123-00-3456", False), ("ssn_check", "123-45-0000", False),
    *(("ein_check", f"{p}-1234567", False) for p in checksums.NO_EIN), ("ein_check", "12-3456789", True),
    *(("itin_check", f"912-{g}-1234", ok) for g, ok in ((49, False), (50, True), (65, True), (66, False), (69, False), (70, True), (88, True), (89, False), (90, True), (92, True), (93, False), (94, True), (99, True))), ("itin_check", "812-70-1234", False),
    ("edrpou_check", "12345678", True), ("edrpou_check", "1234567", False), ("ipn_check", "1234567890", True), ("ipn_check", "123456789", False), ("uci_check", "1234-5678", True), ("uci_check", "1234 567890", True), ("uci_check", "12345678901", False),
    ("no_such_check", "anything", True), (None, "anything", True), ("luhn", "".join(chr(0x660 + int(c)) for c in CARD), True),
]


def test_validator_vectors(spark):
    df = spark.createDataFrame([(i, v) for i, (_, v, _) in enumerate(VECTORS)], "i int, v string")
    for name in dict.fromkeys(n for n, _, _ in VECTORS):
        got = {r["i"]: r["ok"] for r in df.select("i", checksums.check(name, F.col("v")).alias("ok")).collect()}
        for i, (n, v, expected) in enumerate(VECTORS):
            if n == name:
                assert got[i] is expected, (name, v)


RAW = ["plain", "", "ＡＢＣ１２３", "1​2‌3‍4⁠5﻿6­7", "a b", "№ 5", "é́🙂", None]


def test_normalization(spark):
    got = [r["n"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(RAW)], "i int, t string").select("i", text.normalized(F.col("t")).alias("n")).orderBy("i").collect()]
    assert got == [None if t is None else "".join(c for c in unicodedata.normalize("NFKC", t) if c not in text.INVISIBLE) for t in RAW]


@pytest.mark.parametrize(("value", "n"), [("", 0), ("abc", 0), ("a[", 1), ("a[[", 2), ("a[[EMAIL_0", 9), ("a[[EMAIL_00ab12]", 15), ("a[[EMAIL_00ab12]]", 0), ("[[a", 0), ("[[[X", 3), ("x[y", 0)])
def test_partial_ends(spark, value, n):
    assert one(spark, text.partial_end_length(F.col("v")), v=value) == n


def test_placeholders(spark):
    found = one(spark, text.find_placeholders(F.col("v")), v="[[EMAIL_00ab]] [[email_00ab]] [[A_B2_0123456789ab]] [[X_12]] [[X_0123456789abc]]")
    assert found == ["[[EMAIL_00ab]]", "[[A_B2_0123456789ab]]"]


@pytest.mark.parametrize("key", [b"k", b"x" * 64, b"y" * 100])
def test_hmac(spark, key):
    assert one(spark, text.hmac_sha256(key, F.col("v")), v="naïve 🙂") == hmac.new(key, "naïve 🙂".encode(), hashlib.sha256).hexdigest()


def test_canonical_json(spark):
    value = {"b": 'quote " and é 🙂 \n', "a": None, "c": "z"}
    got = one(spark, text.canonical_json(b=F.col("b"), a=F.lit(None).cast("string"), c=F.col("c")), b=value["b"], c="z")
    assert got == json.dumps(value, sort_keys=True, separators=(",", ":"))


def test_small_parsers(spark):
    assert [one(spark, text.bearer_token(F.col("v")), v=v) for v in ("Bearer abc", "bearer  x", "Basic x", "Bearer", "Bearer a b")] == ["abc", "x", None, None, "a b"]
    assert [one(spark, text.judge_score(F.col("v")), v=v) for v in ('{"score": 0.7}', 'so "score":3', "none", '"score": -1')] == [0.7, 1.0, None, 0.0]
    assert [one(spark, text.resolve_model(F.col("v"), "base"), v=v) for v in (" AUTO ", "", None, "own")] == ["base", "base", "base", "own"]
    assert [one(spark, text.valid_model_name(F.col("v")), v=v) for v in ("a.b-c_1", "../x", "", "a" * 65, None)] == [True, False, False, False, False]
    assert [one(spark, text.salvaged_json(F.col("v")).cast("string"), v=v) for v in ('```json\n{"a":1}\n```', 'well: {"a":2} ok', "no")] == ['{"a":1}', '{"a":2}', None]


def test_packs(spark):
    assert rules.available() == ["CA", "EU", "GENERIC", "IRCC", "UA", "US"]
    assert [p.code for p in rules.select(["us", "zz", "CA", "US"])] == ["US", "CA"]
    assert sum(len(p.rules) for p in rules.PACKS.values()) == 21
    again = rules.load_packs([r["definition"] for r in rules.as_rows(spark).collect()])
    assert again["UA"].rules == rules.PACKS["UA"].rules


def test_keys_are_decoded():
    import base64

    raw = bytes(range(32))
    assert text.decoded_key(base64.b64encode(raw).decode()) == raw and len(text.decoded_key("", name="a")) == 32
    assert text.decoded_key(None, name="a") != text.decoded_key(None, name="b")
    for bad in ("?", base64.b64encode(b"short").decode()):
        with pytest.raises(ValueError):
            text.decoded_key(bad)
    with pytest.raises(ValueError):
        text.decoded_key("", production=True)


def test_entities_that_a_model_reports(spark):
    said = [('[{"type":"a b","text":"x"},3,{"text":"y"}]', [("a b", "x")]), ('{"entities":[],"results":[{"entity_type":"p","text":"z"}]}', [("p", "z")]), ('ok {"entities":[{"type":"p","text":""},{"type":"q","text":"w"}]}', [("q", "w")]), ("no", []), ('"s"', []), (None, [])]
    for v, expected in said:
        found = spark.createDataFrame([(v,)], "v string").select(text.reported_entities(F.col("v")).alias("r")).first()["r"]
        assert [tuple(x) for x in found] == expected, v


def test_flags_and_documents_of_packs(spark):
    assert [rules.flags(x) for x in (None, "IGNORECASE", "I|M", "dotall, UNICODE", "WHAT")] == [0, re.I, re.I | re.M, re.S | re.U, 0]
    document = '{"code":" zz ","entity_types":["CODE"],"patterns":[{"type":"CODE","regex":"\\\\bzz-[0-9]+","flags":"I","validator":"none"}]}'
    packs = rules.load_packs([document, '{"code":"bad","patterns":[{"type":"X","regex":"(open"}]}'])
    good, bad = rules.usable(spark, packs)
    assert list(good) == ["ZZ"] and list(bad) == ["BAD"] and good["ZZ"].entity_types() == ["CODE"]
    df = spark.createDataFrame([("a ZZ-17 b",)], "t string").select(spans.all_rule_spans(F.col("t"), ["ZZ"], good).alias("s"))
    assert [(x["start"], x["text"]) for x in df.first()["s"]] == [(2, "ZZ-17")]
