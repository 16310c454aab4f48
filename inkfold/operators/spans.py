"""Typed entity spans: detection by rules, overlap resolution, counts, and anchoring of values that other detectors report.

Spans are half-open, in code points of the text they were found in. A text's spans are one array column, so detection
and merging run in the scan's stage without a shuffle. Null texts have no spans.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfold.functions import checksums, rules
from inkfold.functions.patterns import CLOSE, OPEN
from inkfold.functions.text import normalized, reported_entities
from inkfold.operators import scanning

SPAN = "struct<start:int,end:int,entity_type:string,text:string,score:double,source:string,jurisdiction:string>"
SPANS = f"array<{SPAN}>"
RULE_SCORE, ANCHOR_SCORE = 0.95, 0.6
#: Which source wins between spans of equal score and length.
SOURCE_RANK = {"manual": 4, "regex": 3, "llm": 2, "presidio": 1}


def once(value: Column, use) -> Column:
    """use(value), where value is computed once however often it is used: higher-order functions don't share expressions."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def no_spans() -> Column:
    return F.array().cast(SPANS)


#: Characters that mark matches; in a text itself they are taken for something else.
ODD = f"[{OPEN}{CLOSE}]"


def clean(text: Column) -> Column:
    """text as rules see it: without the two characters that mark matches. Offsets stay."""
    return F.when(text.rlike(ODD), F.translate(text, OPEN + CLOSE, "\x1a\x1a")).otherwise(text)


def marked_matches(text: Column, pattern: str, replacement: str = f"{OPEN}$0{CLOSE}") -> Column:
    """(start, end, text) of what the replacement marks of each match in a clean text, in code points.

    The matches are marked by two control characters, and the text is split at them: regular-expression offsets would
    count UTF-16 units.
    """
    marked = F.regexp_replace(text, F.lit(pattern), F.lit(replacement))

    def step(acc: Column, piece: Column) -> Column:
        match = F.substring_index(piece, CLOSE, 1)
        span = F.struct(acc["at"].alias("start"), (acc["at"] + F.length(match)).alias("end"), match.alias("text"))
        return F.struct((acc["at"] + F.length(piece) - 1).alias("at"), F.concat(acc["found"], F.array(span)).alias("found"))

    def found(pieces: Column) -> Column:
        none = F.array().cast("array<struct<start:int,end:int,text:string>>")
        begin = F.struct(F.length(F.get(pieces, F.lit(0))).alias("at"), none.alias("found"))
        return F.when(F.size(pieces) > 1, F.aggregate(F.slice(pieces, 2, F.size(pieces) - 1), begin, step, lambda acc: acc["found"])).otherwise(none)

    return once(F.split(marked, OPEN), found)


def _typed(text: Column, rule: rules.Rule, jurisdiction: str) -> Column:
    rule = rules.running(rule)
    found = marked_matches(text, rule.java, rule.replacement)
    if rule.validator:
        found = F.filter(found, lambda m: checksums.check(rule.validator, m["text"]))
    typed = F.transform(found, lambda m: F.struct(m["start"], m["end"], F.lit(rule.type).alias("entity_type"), m["text"], F.lit(RULE_SCORE).alias("score"), F.lit("regex").alias("source"), F.lit(jurisdiction).alias("jurisdiction")))
    return F.when(text.rlike(rule.hint), typed).otherwise(no_spans()) if rule.hint else typed


def _own_texts(found: Column, text: Column) -> Column:
    """Spans with their texts as they stand in text."""
    own = lambda spans: F.transform(spans, lambda s: s.withField("text", F.substr(text, s["start"] + 1, s["end"] - s["start"])))
    return once(found, lambda spans: F.when(text.rlike(ODD), own(spans)).otherwise(spans))


def _scans(chosen: Iterable[tuple[rules.Rule, str]]) -> list[scanning.Scan] | None:
    """The rules as they run over batches; None if one of them was written for Java."""
    out = []
    for r, code in chosen:
        own = rules.in_python(r)
        if own is None:
            return None
        out.append(scanning.Scan(r.type, code, r.validator, *own))
    return out


def _scanned(text: Column, scans: list[scanning.Scan], merged: bool = False) -> Column:
    def scan(texts: pa.Array) -> pa.Array:
        return scanning.scanned(texts, scans, merged)

    return F.arrow_udf(scan, SPANS)(text)


def _scanned_anew(text: Column, scans: list[scanning.Scan], normalize: bool) -> Column:
    """(normalized, spans) of a text: normalized and searched in one go, with its spans merged."""

    def scan(texts: pa.Array) -> pa.Array:
        told = scanning.normalized(texts) if normalize else texts.cast(pa.string())
        return pa.StructArray.from_arrays([told, scanning.scanned(told, scans, True)], ["normalized", "spans"])

    return F.arrow_udf(scan, f"struct<normalized:string,spans:{SPANS}>")(text)


def rule_spans(text: Column, rule: rules.Rule, jurisdiction: str) -> Column:
    """The spans of one rule that pass its validator."""
    scans = _scans([(rule, jurisdiction)])
    return _scanned(text, scans) if scans else _own_texts(once(clean(text), lambda t: _typed(t, rule, jurisdiction)), text)


def all_rule_spans(text: Column, codes: Iterable[str] = rules.DEFAULT_PACKS, packs: dict[str, rules.Pack] = rules.PACKS) -> Column:
    """The spans of all rules of the packs, one rule after another. Where a rule was written for Java, all run as columns, and texts
    without anything that any rule's hint asks for are looked at once."""
    chosen = [(r, p.code) for p in rules.select(codes, packs) for r in p.rules]
    if not chosen:
        return no_spans()
    if scans := _scans(chosen):
        return _scanned(text, scans)
    hints = list(dict.fromkeys(r.hint for r, _ in chosen))
    found = once(clean(text), lambda t: F.concat(*(_typed(t, r, code) for r, code in chosen)))
    return F.when(text.rlike("|".join(f"(?:{h})" for h in hints)), _own_texts(found, text)).otherwise(no_spans())


def merge(spans: Column) -> Column:
    """Spans without overlaps, by start. Of two that overlap the higher score stays, then the longer one, then the one of
    the higher source, then the earlier one; what has lost doesn't come back."""
    rank = lambda s: F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in SOURCE_RANK.items() for x in kv)), s["source"]), F.lit(0))
    keyed = F.transform(spans, lambda s, i: F.struct(s["start"].alias("a"), (-s["score"]).alias("b"), (s["start"] - s["end"]).alias("c"), (-rank(s)).alias("d"), i.alias("e"), s.alias("span")))
    begin = F.struct(no_spans().alias("done"), F.lit(None).cast(f"struct<b:double,c:int,d:int,span:{SPAN}>").alias("last"))

    def step(acc: Column, x: Column) -> Column:
        last = acc["last"]
        apart = last.isNull() | (last["span"]["end"] <= x["span"]["start"])
        better = F.struct(x["b"], x["c"], x["d"]) < F.struct(last["b"], last["c"], last["d"])
        own = F.struct(x["b"].alias("b"), x["c"].alias("c"), x["d"].alias("d"), x["span"].alias("span"))
        return F.struct(
            F.when(apart & last.isNotNull(), F.concat(acc["done"], F.array(last["span"]))).otherwise(acc["done"]).alias("done"),
            F.when(apart | better, own).otherwise(last).alias("last"),
        )

    swept = F.aggregate(F.array_sort(keyed), begin, step, lambda acc: F.concat(acc["done"], F.when(acc["last"].isNotNull(), F.array(acc["last"]["span"])).otherwise(no_spans())))
    return F.when(F.size(spans) < 2, spans).otherwise(swept)


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def counts(spans: Column) -> Column:
    """A map from entity type to the number of spans, by type."""
    types = F.transform(spans, lambda s: s["entity_type"])
    return F.map_from_entries(F.transform(F.array_sort(F.array_distinct(types)), lambda t: F.struct(t, F.size(F.filter(types, lambda x: x == t)).cast("long"))))


def detect(texts: DataFrame, codes: Iterable[str] = rules.DEFAULT_PACKS, *, column: str = "text", normalize: bool = True, more: Iterable[Column] = (), packs: dict[str, rules.Pack] = rules.PACKS) -> DataFrame:
    """texts with `normalized` (the text that spans refer to) and `spans` (merged). `more` are span arrays over the
    column `normalized` from other detectors, such as `anchored`; they come after the rules'."""
    codes, more = list(codes), list(more)
    scans = _scans((r, p.code) for p in rules.select(codes, packs) for r in p.rules)
    if scans and not more:
        found = _scanned_anew(F.col(column), scans, normalize)
        out = texts.withColumn("_found", F.explode(F.array(found)))
        return out.withColumns({"normalized": F.col("_found.normalized"), "spans": F.col("_found.spans")}).drop("_found")
    out = texts.withColumn("normalized", normalized(F.col(column)) if normalize else F.col(column))
    found = F.concat(all_rule_spans(F.col("normalized"), codes, packs), *(F.coalesce(m, no_spans()) for m in more))
    found = F.when(F.col("normalized").isNull() | (F.col("normalized") == ""), no_spans()).otherwise(found)
    # Through an array of one, or filters on the spans (those that exploding them implies) would detect again.
    return out.withColumn("_found", F.explode(F.array(F.struct(once(found, merge).alias("spans"))))).withColumn("spans", F.col("_found.spans")).drop("_found")


def exploded(found: DataFrame, *ids: str) -> DataFrame:
    """A row for each span: ids, start, end, entity_type, text, score, source, jurisdiction."""
    return found.select(*ids, F.inline("spans"))


def anchored(text: Column, reported: Column, source: str = "llm", score: float = ANCHOR_SCORE) -> Column:
    """Spans of values that a detector reports without a place: array<struct<type, value>>, in order. Each takes its first
    occurrence in text that overlaps none taken before; types become upper case with `_` for spaces; what isn't there is
    dropped."""
    from_ = lambda value, at: F.call_function("locate", value, text, at)

    def step(acc: Column, item: Column) -> Column:
        kind, value = F.replace(F.upper(F.trim(item["type"])), F.lit(" "), F.lit("_")), item["value"]
        n = F.length(value)
        taken = lambda p: F.filter(acc, lambda s: (s["start"] < p - 1 + n) & (p - 1 < s["end"]))
        # Each turn leaves the spans behind that stand in the way, so there is one turn more than spans at most.
        on = lambda p, _: F.when(p > 0, once(taken(p), lambda hit: F.when(F.size(hit) > 0, from_(value, F.array_max(F.transform(hit, lambda s: s["end"])) + 1)).otherwise(p))).otherwise(p)
        first = F.aggregate(F.sequence(F.lit(0), F.size(acc)), from_(value, F.lit(1)), on) - 1
        span = lambda at: F.struct(at.alias("start"), (at + n).alias("end"), kind.alias("entity_type"), value.alias("text"), F.lit(score).alias("score"), F.lit(source).alias("source"), F.lit(None).cast("string").alias("jurisdiction"))
        return F.when((n > 0) & (kind != ""), once(first, lambda at: F.when(at >= 0, F.concat(acc, F.array(span(at)))).otherwise(acc))).otherwise(acc)

    return F.aggregate(reported, no_spans(), step)


#: Fixed value: how much of a text a language model is asked about.
ASKED_CHARS = 20_000


def answered(text: Column, answer: Column) -> Column:
    """Spans from a language model's answer about text, of which it saw the first ASKED_CHARS characters. An answer that is
    missing or isn't what was asked for gives none."""
    return F.coalesce(anchored(F.substr(text, F.lit(1), F.lit(ASKED_CHARS)), reported_entities(answer)), no_spans())


#: What the entity recognizer's types are called here; others are dropped.
NER_TYPES = {
    "PERSON": "PERSON",
    "LOCATION": "LOCATION",
    "GPE": "LOCATION",
    "ORGANIZATION": "ORG",
    "ORG": "ORG",
    "NRP": "NRP",
    "PHONE_NUMBER": "PHONE",
    "EMAIL_ADDRESS": "EMAIL",
    "CREDIT_CARD": "CREDIT_CARD",
    "DATE_TIME": "DATE_TIME",
}


def recognized(found: Column, text: Column) -> Column:
    """Spans from an entity recognizer's output: array<struct<entity_type, start, end, score>>. Unknown types and empty spans are dropped."""
    names = F.create_map(*(F.lit(x) for kv in NER_TYPES.items() for x in kv))
    typed = F.transform(found, lambda s: F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"), F.element_at(names, s["entity_type"]).alias("entity_type"), F.substr(text, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")).alias("text"), s["score"].cast("double").alias("score"), F.lit("presidio").alias("source"), F.lit(None).cast("string").alias("jurisdiction")))
    return F.filter(typed, lambda s: s["entity_type"].isNotNull() & (s["end"] > s["start"]))
