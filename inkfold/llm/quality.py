"""Quality rules under weak supervision, in DataFrame functions only.

Each rule votes good or bad or abstains. Expectation-maximisation over the counts of vote patterns (at most three to
the power of the number of rules, however many documents there are) estimates how often a rule votes each way on good
and on bad documents; the posterior probability of being good takes the place of passing every rule.

Edge cases: a null, empty or blank text has no words, fails the base rule and isn't kept. Very long texts are measured
whole. Repeated rows each get the same verdict; an empty table gives no rows; other columns are ignored by `measure`
and kept by `judge`. Of equal odds the document is kept.
"""

from __future__ import annotations

from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfold.llm import common

WINDOW = 8
SYMBOLS = "#*$%&|<>"


def measure(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row for each document: the columns in keep, prefixed by `in_`, and what the rules look at."""
    text = F.coalesce(F.col("text"), F.lit(""))
    kept = [F.col(c).alias(f"in_{c}") for c in keep]
    names = [f"in_{c}" for c in keep]
    rows = docs.select(*kept, text.alias("text"), common.java_words(text).alias("words"), F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    rows = rows.select(
        *names,
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
        F.size("words").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("lines", lambda x: x.rlike(r"[.!?…:;\"'»”)]\s*$"))).cast("long").alias("n_ended"),
        F.length(F.translate("text", common.SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length("text") - F.length(F.translate("text", "!", ""))).cast("long").alias("n_shouts"),
        F.length(F.regexp_replace("text", r"\P{Lu}+", "")).cast("long").alias("n_upper"),
        F.length(F.regexp_replace("text", r"\P{L}+", "")).cast("long").alias("n_letters"),
    )
    rest = [c for c in rows.columns if c != "hashes"]
    at = lambda i, k: F.get("hashes", i + F.lit(k))
    windows = F.when(F.size("hashes") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("hashes") - WINDOW), lambda i: F.xxhash64(*(at(i, k) for k in range(WINDOW)))))
    rows = rows.select(*rest, windows.alias("windows"))
    # Only a text with an equal pair of windows is sorted.
    ordered = F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    rows = rows.select(*rest, ordered.alias("ordered"))
    twice = F.filter("ordered", lambda x, i: (x["h"] == F.get("ordered", i - 1)["h"]) | (x["h"] == F.get("ordered", i + 1)["h"]))
    rows = rows.select(*rest, F.array_sort(F.transform(twice, lambda x: x["i"])).alias("starts"))
    covered = F.transform("starts", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("starts", i + 1) - p, F.lit(WINDOW))).cast("long"))
    return rows.select(*rest, F.coalesce(F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long")).alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _vote(good: Column | None, bad: Column) -> Column:
    vote = F.when(bad, F.lit(-1))
    return (vote if good is None else vote.when(good, F.lit(1))).otherwise(F.lit(0)).cast("tinyint")


def rules() -> dict[str, Column]:
    """Each rule's vote: 1 good, -1 bad, 0 abstains."""
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    words = F.col("n_words")
    return {
        "length": _vote(words >= 50, words < 20),
        "word_length": _vote(None, (share("word_chars", "n_words") < 2) | (share("word_chars", "n_words") > 20)),
        "symbols": _vote(share("n_symbols", "n_words") < 0.02, share("n_symbols", "n_words") > 0.1),
        "repeats": _vote(share("n_repeat_words", "n_words") < 0.05, share("n_repeat_words", "n_words") > 0.3),
        "lines_again": _vote(None, share("n_dup_lines", "n_lines") > 0.3),
        "line_ends": _vote(share("n_ended", "n_lines") > 0.5, share("n_ended", "n_lines") < 0.1),
        "capitals": _vote(share("n_upper", "n_letters") < 0.2, share("n_upper", "n_letters") > 0.5),
        "shouts": _vote(None, share("n_shouts", "n_words") > 0.2),
        "letters": _vote(share("n_letters", "word_chars") > 0.8, share("n_letters", "word_chars") < 0.6),
    }


def fit(measured: DataFrame, rounds: int = 50, smooth: float = 1.0) -> dict:
    """Estimate the share of good documents and, by rule, the log-odds of good against bad that each vote carries.

    A bad vote is held to be no likelier on a good document than on a bad one, and a good vote no likelier on a bad one.
    """
    names = list(rules())
    counted = measured.select(*(v.alias(k) for k, v in rules().items())).groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    seen = [(tuple(r[k] for k in names), r["n"]) for r in counted.collect()]
    good = [0.1 if -1 in votes else 0.9 for votes, _ in seen]
    prior, odds = 0.0, [{v: 0.0 for v in (-1, 0, 1)} for _ in names]
    for _ in range(rounds if seen else 0):
        up = sum(g * n for g, (_, n) in zip(good, seen)) + smooth
        down = sum((1 - g) * n for g, (_, n) in zip(good, seen)) + smooth
        prior = log(up / down)
        for j in range(len(names)):
            for v in (-1, 0, 1):
                a = (sum(g * n for g, (votes, n) in zip(good, seen) if votes[j] == v) + smooth) / (up + 2 * smooth)
                b = (sum((1 - g) * n for g, (votes, n) in zip(good, seen) if votes[j] == v) + smooth) / (down + 2 * smooth)
                odds[j][v] = log(a / b)
            odds[j][-1], odds[j][1] = min(odds[j][-1], 0.0), max(odds[j][1], 0.0)
        good = [1 / (1 + exp(-max(-500.0, min(500.0, prior + sum(odds[j][v] for j, v in enumerate(votes)))))) for votes, _ in seen]
    return {"prior": prior, "odds": dict(zip(names, odds))}


def posterior(model: dict) -> Column:
    """The probability that a measured document is good."""
    total = F.lit(float(model["prior"]))
    for k, vote in rules().items():
        o = model["odds"][k]
        total = total + F.when(vote == -1, F.lit(o[-1])).when(vote == 1, F.lit(o[1])).otherwise(F.lit(o[0]))
    return 1 / (1 + F.exp(-total))


def assess(docs: DataFrame) -> DataFrame:
    """A row for each document with its measures, base_failed, quality (posterior probability) and kept."""
    measured = common.stash(measure(docs), "quality")
    quality = posterior(fit(measured))
    kept = ~base_failed() & (quality >= 0.5)
    return measured.select(F.col("in_doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), kept.alias("kept"), quality.alias("quality"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that pass. Texts are measured twice, for the estimates and for the verdict:
    a table of measures would have to be joined to the texts again, or hold them."""
    odds = fit(measure(docs, ()))
    row = F.struct(*docs.columns).alias("row")
    measured = measure(docs.select("text", row), ("row",))
    # The measures go through an array of one, or the filter would repeat their expressions.
    rows = measured.select("in_row", F.explode(F.array(F.struct(*(c for c in measured.columns if c != "in_row")))).alias("m")).select("in_row", "m.*")
    rows = rows.where(~base_failed() & (posterior(odds) >= 0.5))
    return rows.select(*(F.col("in_row").getField(c).alias(c) for c in docs.columns))
