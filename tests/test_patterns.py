"""Translated patterns against Python's own matching."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from inkfold.functions import patterns, rules
from inkfold.operators import spans

PATTERNS = [
    (r"\bNEQ[ :#]*(?P<value>\d{4}[ -]?\d{3})\b", re.I),
    (r"\d+(?P<value>[a-z]+)\d+", 0),
    (r"(?P<value>\w+)@\w+", 0),
    (r"id=(?:(?P<value>\d+)|none)", 0),
    (r"(?:no (?P<value>\d+)|n[ao]\s?\d)", 0),
    (r"ab(?: (?P<value>\d+))?", 0),
    (r"ab(?: (?P<value>\d+))??", 0),
    (r"((?:x|y)(?P<value>\d)z)", 0),
    (r"(?i:ref) (?P<value>[A-Z]\d+)(?=[ ,.])", 0),
    (r"(?P<q>['\"])(?P<value>\w+)(?P=q)", 0),
    (r"(?P<value>(\d)\2+)", 0),
    (r"\w+", 0),
    (r"\w+", re.A),
    (r"\s+\S", 0),
    (r"[^\W\d]+", 0),
    (r"[\S\d]{2}", 0),
    (r"^\w", re.M),
    (r"\w$", re.M),
    (r"\w$", 0),
    (r"\A.", 0),
    (r".\Z", 0),
    (r"a.c", 0),
    (r"a.c", re.S),
    (r"\Bb\w", 0),
    (r"(?<!\d)\d{2}(?!\d)", 0),
    (r"(?<=№ )\d", 0),
    (r"x*+x|a++b", 0),
    (r"(?>ab|a)c", 0),
    (r"[\]\-^\\&&]+", 0),
    (r"straße|ночь|日本", re.I),
    (r"(?x) \d  [ ] \d  # two digits", 0),
    (r"$\w|#\{|\$1", 0),
    (r"(a|b)c\1", 0),
]
ALPHABET = ["a", "b", "c", "x", "y", "z", "Z", "ab", "neq", "NEQ", " ", "  ", "\n", "\r\n", "\t", "\x1c", " ", " ", "-", ":", "#", "1", "2", "12", "1234", "123", "٣", "²", "é", "é", "_", "@", "id=", "none", "no ", "n", "ref ", "REF ", "A1", ".", ",", "'", '"', "straße", "STRASSE", "НОЧЬ", "日本", "№ ", "[", "]", "^", "\\", "&", "$", "{", "\U0001f600", "\x01", "\x02"]


def expected(pattern: str, flags: int, text: str) -> list[tuple]:
    out = []
    for m in re.finditer(pattern, text, flags):
        group = "value" if m.groupdict().get("value") is not None else 0
        out.append((*m.span(group), m.group(group)))
    return out


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(11)
    return ["".join(rng.choices(ALPHABET, k=rng.randint(1, 40))) for _ in range(150)] + ["NEQ: 1234-567 and neq#1234 567x", "no 12 na 3 id=none id=44", "'ab' \"ab' 'c'", "ab 12ab", "x\n", "ab\n"]


def test_translated_patterns_match_as_in_python(spark, odd_texts):
    # Marks in a text are taken for something else, as detection does.
    texts = [t.replace("\x01", "\x1a").replace("\x02", "\x1a") for t in odd_texts]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    made = [patterns.translated(p, f) for p, f in PATTERNS]
    columns = [spans.marked_matches(F.col("text"), t.pattern, t.marked).alias(f"m{i}") for i, t in enumerate(made)]
    hints = [F.col("text").rlike(t.hint).alias(f"h{i}") for i, t in enumerate(made)]
    for r in rows.select("text", *columns, *hints).collect():
        for i, (p, f) in enumerate(PATTERNS):
            want = expected(p, f, r["text"])
            assert [tuple(x) for x in r[f"m{i}"]] == want, (p, r["text"])
            assert r[f"h{i}"] or not want, (p, made[i].hint, r["text"])


@pytest.mark.parametrize("pattern", [r"\d+(?:a(?P<value>b)|c)", r"(?:(?P<value>a))*", r"(?=(?P<value>a))a", r"(a(?P<value>b))\1", r"(a)?(?(1)b|c)"])
def test_patterns_without_a_counterpart_say_so(pattern):
    with pytest.raises(ValueError):
        patterns.translated(pattern)


def test_hints_tell_most():
    hint = lambda p, f=0: patterns.translated(p, f).hint
    assert hint(r"\bNEQ[ :#]*(?P<value>\d{4})\b") == "NEQ"
    assert hint(r"\w+@\w+") == r"\x{40}"
    assert hint(r"[A-Z]{2}\d{2}[ ]?x*") == r"[A-Z]{2}[\p{Nd}]{2}"
    assert hint(r".*") == "" and hint(r"a?b*") == ""
    assert hint("(?:QX|ZK)7?") == "(?:QX|ZK)"


def test_built_in_packs_come_back_from_documents(spark):
    packs = rules.load_packs(rules.as_documents())
    good, bad = rules.usable(spark, packs)
    assert list(good) == list(rules.PACKS) and not bad
    for code, pack in good.items():
        assert pack.entity_types() == rules.PACKS[code].entity_types()
        assert [(r.type, r.validator) for r in pack.rules] == [(r.type, r.validator) for r in rules.PACKS[code].rules]


def test_a_broken_pattern_is_its_packs_error(spark):
    documents = ['{"code":"a","patterns":[{"type":"X","regex":"(open"}]}', '{"code":"b","patterns":[{"type":"X","regex":"(?:(?P<value>a))*"}]}', '{"code":"c","rules":[{"type":"X","pattern":"(java"}]}']
    good, bad = rules.usable(spark, rules.load_packs([*documents, '{"code":"d","patterns":[{"type":"X","regex":"cue (?P<value>\\\\d+);"}]}']))
    assert list(good) == ["D"] and sorted(bad) == ["A", "B", "C"]
    found = spark.createDataFrame([("a cue 17; cue 18",)], "t string").select(spans.all_rule_spans(F.col("t"), ["D"], good).alias("s")).first()["s"]
    assert [(x["start"], x["end"], x["text"]) for x in found] == [(6, 8, "17")]
