"""Jurisdiction packs: ordered lists of rules, each a pattern with an optional validator.

Packs of a caller's own are read with `load_packs`: JSON documents with patterns as Python writes them, in which a group
named `value` is what is found, or of the form that `as_rows` gives.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfold.functions.patterns import CLOSE, OPEN, translated


@dataclass(frozen=True)
class Rule:
    """A pattern in Java's syntax. With `value`, its first group is a cue and its second the span; `marked`, of a translated
    pattern, is the replacement that marks the span."""

    type: str
    pattern: str
    validator: str | None = None
    value: bool = False
    ignore_case: bool = False
    #: A cheap pattern that every match's text holds.
    hint: str = r"(?U)\d"
    marked: str | None = None
    #: A document's pattern as Python writes it, with its flags.
    python: str | None = None
    flags: int = 0

    @property
    def java(self) -> str:
        if self.marked is not None:
            return self.pattern
        return ("(?iuU)" if self.ignore_case else "(?U)") + self.pattern

    @property
    def replacement(self) -> str:
        """What a match is replaced by to mark its span."""
        return self.marked or (f"$1{OPEN}$2{CLOSE}" if self.value else f"{OPEN}$0{CLOSE}")


@dataclass(frozen=True)
class Pack:
    code: str
    name: str
    rules: tuple[Rule, ...]
    version: str = "1.0.0"
    types: tuple[str, ...] = field(default=())
    #: Why a document's patterns can't be used.
    error: str | None = None

    def entity_types(self) -> list[str]:
        return list(self.types or dict.fromkeys(r.type for r in self.rules))


#: Parts of the patterns below.
OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
H = r"[0-9a-fA-F]{1,4}"
#: Countries whose tax numbers the VAT rule looks for.
VAT_COUNTRIES = "AT|BE|BG|CY|CZ|DE|DK|EE|EL|ES|FI|FR|GB|GR|HR|HU|IE|IT|LT|LU|LV|MT|NL|PL|PT|RO|SE|SI|SK"

#: The rules of each jurisdiction, in order; order decides between equal spans.
PACKS = {
    p.code: p
    for p in (
        Pack(
            "GENERIC",
            "Any jurisdiction",
            (
                Rule("EMAIL", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b", hint="@"),
                Rule("CREDIT_CARD", r"\b\d(?:[ \-]?\d){12,18}\b", "luhn"),
                Rule("PHONE", r"(?:\+?\d{1,3}[ .\-]?)?(?:\(\d{3}\)|\d{3})[ .\-]\d{3}[ .\-]\d{4}\b", hint=r"(?U)\d{3}[ .\-]\d{4}"),
                Rule("IP_ADDRESS", rf"\b(?:{OCTET}\.){{3}}{OCTET}\b", hint=r"(?U)\d\.\d"),
                Rule("IP_ADDRESS_V6", rf"(?:{H}:){{7}}{H}|(?:{H}:){{1,7}}:|(?:{H}:){{1,6}}:{H}|::(?:{H}:){{0,5}}{H}|::1", hint=":[0-9a-fA-F:]"),
                Rule("IBAN", r"\b[A-Z]{2}\d{2}[ ]?(?:[A-Z0-9]{4}[ ]?){1,7}[A-Z0-9]{1,4}\b", hint=r"(?U)[A-Z]{2}\d{2}"),
                Rule(
                    "DATE_OF_BIRTH",
                    r"(?:(?:born|dob|birth(?:date)?|date of birth|дата?\s+(?:народження|рождения)|ДН)\s*[:\-]?\s*)(?:\d{4}[-/]\d{2}[-/]\d{2}|\d{2}[-/.]\d{2}[-/.]\d{4})",
                    hint=r"(?U)[-/.]\d{2}",
                ),
            ),
        ),
        Pack(
            "CA",
            "Canada",
            (
                Rule("SIN", r"\b\d{3}[ -]?\d{3}[ -]?\d{3}\b", "sin_check"),
                Rule("BUSINESS_NUMBER", r"\b\d{9}[ ]?R[CTPMZ][ ]?\d{4}\b", hint="R[CTPMZ]"),
                Rule("GST_HST", r"\b\d{9}[ ]?RT[ ]?\d{4}\b", hint="RT"),
                Rule("NEQ", r"(\bNEQ[ :#]*)(\d{4}[ -]?\d{3}[ -]?\d{3})\b", value=True, ignore_case=True, hint="(?iu)NEQ"),
            ),
        ),
        Pack(
            "US",
            "United States",
            (
                Rule("ITIN", r"\b9\d{2}[ -]?\d{2}[ -]?\d{4}\b", "itin_check"),
                Rule("SSN", r"\b\d{3}-\d{2}-\d{4}\b", "ssn_check", hint=r"(?U)\d{3}-\d{2}-\d{4}"),
                Rule("EIN", r"\b\d{2}-\d{7}\b", "ein_check", hint=r"(?U)\d{2}-\d{7}"),
            ),
        ),
        Pack(
            "EU",
            "European Union",
            (
                Rule("IBAN", r"\b[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?\b", "iban_mod97", hint=r"(?U)[A-Z]{2}\d{2}"),
                Rule("VAT", rf"\b(?:{VAT_COUNTRIES})[ ]?[A-Z0-9]{{2,12}}\b", hint="[A-Z]{2}"),
            ),
        ),
        Pack(
            "UA",
            "Ukraine",
            (
                Rule("IBAN_UA", r"\bUA\d{2}[ ]?(?:[A-Z0-9]{4}[ ]?){5}[A-Z0-9]{5}\b", "iban_mod97", hint=r"(?U)UA\d{2}"),
                Rule("IPN", r"((?:ІПН|IPN|ИНН|РНОКПП|РНУКПН)[ :№#]*)(\d{10})\b", "ipn_check", value=True, ignore_case=True, hint="(?iu)ІПН|IPN|ИНН|РНОКПП|РНУКПН"),
                Rule("EDRPOU", r"((?:ЄДРПОУ|ЕДРПОУ|EDRPOU)[ :№#]*)(\d{8})\b", "edrpou_check", value=True, ignore_case=True, hint="(?iu)ЄДРПОУ|ЕДРПОУ|EDRPOU"),
            ),
        ),
        Pack(
            "IRCC",
            "Immigration to Canada",
            (
                Rule("UCI", r"((?:UCI|Client ID|Client Identifier)[ :#]*)(\d{4}[ -]?\d{4,6})\b", "uci_check", value=True, ignore_case=True, hint="(?iu)UCI|Client ID"),
                Rule("APPLICATION_NUMBER", r"\b[EFVWX]\d{9,10}\b"),
            ),
        ),
    )
}
DEFAULT_PACKS = ("GENERIC", "CA", "US", "EU", "UA")


def available() -> list[str]:
    return sorted(PACKS)


def select(codes, packs: dict[str, Pack] = PACKS) -> list[Pack]:
    """The packs of codes in their order, whatever their case; repeated and unknown codes are left out."""
    wanted = dict.fromkeys(str(c).strip().upper() for c in codes)
    return [packs[c] for c in wanted if c in packs]


#: The names of flags in pack documents.
FLAGS = {"IGNORECASE": re.I, "I": re.I, "MULTILINE": re.M, "M": re.M, "DOTALL": re.S, "S": re.S, "UNICODE": re.U, "U": re.U, "VERBOSE": re.X, "X": re.X}


def flags(names: str | None) -> int:
    """The flags that a pack document's `flags` name, separated by bars, commas or spaces; unknown names mean nothing."""
    found = 0
    for n in re.split(r"[|, ]+", names or ""):
        found |= int(FLAGS.get(n.upper(), 0))
    return found


def _rule(d: dict) -> Rule:
    """A rule of a document: in the form of `as_rows` (pattern), or with regex, flags, validator and description."""
    if "regex" not in d:
        return Rule(**d)
    own = translated(str(d["regex"]), flags(d.get("flags")))
    return Rule(str(d["type"]), own.pattern, d.get("validator"), hint=own.hint, marked=own.marked, python=str(d["regex"]), flags=flags(d.get("flags")))


def load_packs(documents: list[str]) -> dict[str, Pack]:
    """Packs from JSON documents: code and rules, or patterns with regex and flags, are required; name defaults to the code. A
    pack with a pattern that can't be read or translated has no rules, and says why in `error`."""
    out = {}
    for text in documents:
        d = json.loads(text)
        code = str(d["code"]).strip().upper()
        found, error = (), None
        try:
            found = tuple(_rule(r) for r in d.get("rules", d.get("patterns") or ()))
        except (ValueError, re.error, RecursionError) as e:
            error = f"{type(e).__name__}: {e}"
        out[code] = Pack(code, str(d.get("name", code)), found, str(d.get("version", "1.0.0")), tuple(d.get("entity_types") or ()), error)
    return out


def usable(spark: SparkSession, packs: dict[str, Pack]) -> tuple[dict[str, Pack], dict[str, str]]:
    """The packs whose patterns compile, and the error of each other one: a broken pack doesn't fail the others' jobs."""
    good, bad = {}, {code: p.error for code, p in packs.items() if p.error}
    for code, pack in packs.items():
        if code in bad:
            continue
        try:
            tried = [F.lit("").rlike(x) for r in pack.rules for x in (r.java, r.hint)]
            spark.range(1).select(F.array(*tried, F.lit(True))).collect()
            good[code] = pack
        except Exception as e:  # noqa: BLE001 - whatever the engine says of a pattern is its pack's error
            bad[code] = str(e).splitlines()[0]
    return good, bad


def _first_group(pattern: str) -> int:
    """Where the group ends that a pattern starts with."""
    depth, i = 0, 0
    while True:
        depth += {"(": 1, ")": -1}.get(pattern[i], 0)
        i += 2 if pattern[i] == "\\" else 1
        if not depth:
            return i


def _written(r: Rule) -> str:
    """The pattern of a built-in rule as Python writes it."""
    if not r.value:
        return r.pattern
    cue = _first_group(r.pattern)
    return f"{r.pattern[1:cue - 1]}(?P<value>{r.pattern[cue + 1:]}"


@cache
def _built_in() -> dict[Rule, Rule]:
    out = {}
    for p in PACKS.values():
        for r in p.rules:
            own = translated(_written(r), re.I if r.ignore_case else 0)
            if own.gated:
                out[r] = Rule(r.type, own.pattern, r.validator, hint=r.hint, marked=own.marked)
    return out


def running(rule: Rule) -> Rule:
    """The rule as it runs: a built-in one as if it had been read from a document, where most places of a text then fail on
    their first character."""
    return _built_in().get(rule, rule)


@cache
def _all_built_in() -> frozenset[Rule]:
    return frozenset(r for p in PACKS.values() for r in p.rules)


def in_python(rule: Rule) -> tuple[str, int] | None:
    """A rule's pattern as Python writes it, with its flags; None for patterns of a caller's own that were written for Java."""
    if rule.python is not None:
        return rule.python, rule.flags
    return (_written(rule), re.I if rule.ignore_case else 0) if rule in _all_built_in() else None


def as_documents(packs: dict[str, Pack] = PACKS) -> list[str]:
    """The built-in packs as documents that `load_packs` reads, with patterns as Python writes them."""

    def rule(r: Rule) -> dict:
        return {"type": r.type, "regex": _written(r), "validator": r.validator, "flags": "IGNORECASE" if r.ignore_case else None}

    return [json.dumps({"code": p.code, "name": p.name, "version": p.version, "entity_types": p.entity_types(), "patterns": [rule(r) for r in p.rules]}, ensure_ascii=False) for p in packs.values()]


def as_rows(spark: SparkSession, packs: dict[str, Pack] = PACKS) -> DataFrame:
    """A row for each pack: code, name, version, entity_types, definition (JSON)."""
    rows = [(p.code, p.name, p.version, p.entity_types(), json.dumps({"code": p.code, "name": p.name, "version": p.version, "rules": [vars(r) for r in p.rules]}, ensure_ascii=False)) for p in packs.values()]
    return spark.createDataFrame(rows, "code string, name string, version string, entity_types array<string>, definition string")
