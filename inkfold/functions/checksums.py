"""Checksum and format predicates over identifiers, as column expressions.

Each strips white space and hyphens itself and is false for null and for anything that isn't all digits (IBAN: letters
and digits). Digits of other scripts that `(?U)\\d` matches count by their value in the two Arabic sets.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkfold.functions.text import without_separators

ARABIC = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹"
#: Prefixes that no employer number has.
NO_EIN = ("07", "08", "09", "17", "18", "19", "28", "29", "49", "78", "79", "89")


def _digits(value: Column) -> Column:
    return F.translate(without_separators(value), ARABIC, "0123456789" * 2)


def _is(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def luhn(value: Column) -> Column:
    d = _digits(value)
    return _is(d.rlike(r"^[0-9]{2,}\z") & F.call_function("luhn_check", d))


def sin(value: Column) -> Column:
    return _is(_digits(value).rlike(r"^[1-79][0-9]{8}\z")) & luhn(value)


def iban(value: Column) -> Column:
    """Two letters, two digits and 1 to 30 letters or digits, whose number modulo 97 is 1."""
    v = F.upper(without_separators(value))
    turned = F.concat(F.substr(v, F.lit(5)), F.substr(v, F.lit(1), F.lit(4)))
    figure = lambda c: F.ascii(c) - F.when(c >= "A", F.lit(55)).otherwise(F.lit(48))
    rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise((a * F.when(figure(c) > 9, 100).otherwise(10) + figure(c)) % 97).cast("int"))
    return _is(v.rlike(r"^[A-Z]{2}[0-9]{2}[A-Z0-9]{1,30}\z") & (rest == 1))


def ssn(value: Column) -> Column:
    return _is(_digits(value).rlike(r"^(?!000|666|9)[0-9]{3}(?!00)[0-9]{2}(?!0000)[0-9]{4}\z"))


def ein(value: Column) -> Column:
    d = _digits(value)
    return _is(d.rlike(r"^[0-9]{9}\z") & ~F.substr(d, F.lit(1), F.lit(2)).isin(*NO_EIN))


def itin(value: Column) -> Column:
    d = _digits(value)
    group = F.substr(d, F.lit(4), F.lit(2)).cast("int")
    inside = group.between(50, 65) | group.between(70, 88) | group.between(90, 92) | group.between(94, 99)
    return F.when(_is(d.rlike(r"^9[0-9]{8}\z")), inside).otherwise(F.lit(False))


def _length(least: int, most: int) -> Callable[[Column], Column]:
    return lambda value: _is(_digits(value).rlike(rf"^[0-9]{{{least},{most}}}\z"))


VALIDATORS: dict[str, Callable[[Column], Column]] = {
    "luhn": luhn,
    "sin_check": sin,
    "iban_mod97": iban,
    "ssn_check": ssn,
    "ein_check": ein,
    "itin_check": itin,
    "edrpou_check": _length(8, 8),
    "ipn_check": _length(10, 10),
    "uci_check": _length(8, 10),
}


def check(name: str | None, value: Column) -> Column:
    """Whether value passes the named validator; a name that isn't known accepts everything."""
    found = VALIDATORS.get(name or "")
    return found(value) if found else F.lit(True)


# The same for one text in Python.

_SEPARATORS = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000-]")
_WESTERN = str.maketrans(ARABIC, "0123456789" * 2)


def _luhn(d: str) -> bool:
    ds = [int(c) for c in reversed(d)]
    return (sum(ds[::2]) + sum(2 * x - 9 * (x > 4) for x in ds[1::2])) % 10 == 0


def _mod97(v: str) -> bool:
    return int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


_PASSES: dict[str, tuple[str, Callable[[str], bool]]] = {
    "luhn": (r"[0-9]{2,}", _luhn),
    "sin_check": (r"[1-79][0-9]{8}", _luhn),
    "iban_mod97": (r"[A-Z]{2}[0-9]{2}[A-Z0-9]{1,30}", _mod97),
    "ssn_check": (r"(?!000|666|9)[0-9]{3}(?!00)[0-9]{2}(?!0000)[0-9]{4}", lambda d: True),
    "ein_check": (r"[0-9]{9}", lambda d: d[:2] not in NO_EIN),
    "itin_check": (r"9[0-9]{8}", lambda d: (g := int(d[3:5])) >= 50 and not 66 <= g <= 69 and g not in (89, 93)),
    "edrpou_check": (r"[0-9]{8}", lambda d: True),
    "ipn_check": (r"[0-9]{10}", lambda d: True),
    "uci_check": (r"[0-9]{8,10}", lambda d: True),
}


def passes(name: str | None, value: str) -> bool:
    """`check` for one value."""
    if name not in _PASSES:
        return True
    shape, good = _PASSES[name]
    bare = _SEPARATORS.sub("", value)
    bare = bare.upper() if name == "iban_mod97" else bare.translate(_WESTERN)
    return bool(re.fullmatch(shape, bare)) and good(bare)
