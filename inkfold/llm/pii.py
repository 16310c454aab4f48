"""Personal data: patterns, and a skip-chain conditional random field that adds spans to theirs.

The patterns find e-mail addresses, IP addresses, card and phone numbers. The field labels the tokens that could be
part of one, those with a digit or an @; others are held to the label "none", which cuts a document's chain into short
pieces. Its potentials are of three kinds: a token's features, neighbouring tokens, and skip edges between each token
and the next one in the document with the same key (the local part of an address, or the digits). Loopy message passing
over a document's pieces and skip edges makes a number that is once written as a phone number a phone number wherever it
stands. It runs on every document with such tokens, whether a pattern has found one there or not. A run of tokens so labelled, and plausible as such, becomes a span. The potentials are trained piecewise on the
pattern spans of a bounded sample: at most `sample_docs` documents, chosen by a hash of their ids, and of each its first
`sample_tokens` tokens. Tokens that share a key with a found one, but aren't found, don't count as "none" there.

Edge cases: a null or empty text has no spans. A text's size doesn't matter: patterns run in linear time, and each token
has two neighbours and two skip edges at most. Repeated rows each give a row; an empty table gives no rows; without
pattern spans in the sample nothing is added. Of labels with equal probability the first by kind counts, which isn't sure
enough to add a span. Spans of a kind never overlap; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.llm import common

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[^A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_MARK, _SPACE = re.compile(r"[0-9@]"), re.compile(r"\s")
_DIGITS = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text[start - 1]):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield "email", start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def patterns(text: str) -> list[Span]:
    """The spans of the patterns by kind, then start; per kind leftmost and without overlap."""
    out = list(_emails(text)) if "@" in text else []
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(int(x[-4:]) <= 255 and len(x.lstrip("0")) <= 3 for x in m.group().split("."))]
    for m in _CARD.finditer(text):
        digits = _DIGITS.sub("", m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_DIGITS.sub("", m.group())) <= 15]
    return out


FEATURES = 40


def _features(token: str, before: str, after: str) -> list[int]:
    """Numbers of a token's features, under FEATURES."""
    digits = sum(c.isdigit() for c in token)
    out = [min(digits, 16), 17 + min(token.count("."), 4), 22 + min(token.count("-"), 3)]
    out += [26] * ("@" in token) + [27] * token.startswith("+") + [28] * ("(" in token) + [29] * any(c.isalpha() for c in token)
    out += [30] * before.startswith("+") + [31] * any(c.isdigit() for c in before) + [32] * any(c.isdigit() for c in after) + [33] * before.endswith(":")
    if token.isdigit() and len(token) >= 13:
        out.append(34 + luhn(token))
    return out + [36]


def _key(token: str) -> str:
    """Equal for tokens that likely name the same thing; empty for tokens that could be anything."""
    if "@" in token:
        local = token.split("@")[0].lower().strip(".,;:!?\"'()<>[]")
        return f"@{local}" if len(local) > 2 else ""
    digits = _DIGITS.sub("", token)
    return digits if len(digits) >= 3 else ""


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of each run without spaces that has a digit or an @; in time linear in the text."""
    end = 0
    while m := _MARK.search(text, end):
        start, space = m.start(), _SPACE.search(text, m.end())
        while start > end and not text[start - 1].isspace():
            start -= 1
        end = space.start() if space else len(text)
        yield start, end


def _key_number(key: str) -> int:
    """A number that tells keys apart; 0 for the empty one."""
    return int.from_bytes(hashlib.blake2b(key.encode("utf-8", "surrogatepass"), digest_size=8).digest()) | 1 if key else 0


class Document:
    """A text's candidate tokens with their features, neighbours, skip edges and pattern labels (0: none), in arrays: some
    fifty bytes for each token, whatever a text holds."""

    def __init__(self, text: str, found: list[Span]):
        flat, ends, keys, spans = array("B"), array("q", [0]), array("Q"), array("q")
        tokens = candidates(text)
        last, now, after = None, next(tokens, None), next(tokens, None)
        self.joined = array("B")  # whether a token stands right after the one before it
        while now:
            a, b = now
            token, beside = text[a:b], after is not None and not text[b : after[0]].strip()
            held = last is not None and not text[last[1] : a].strip()
            before = text[last[0] : last[1]] if held else (text[max(0, a - 20) : a].split() or [""])[-1]
            flat.extend(_features(token, before, text[after[0] : after[1]] if beside else ""))
            ends.append(len(flat))
            keys.append(_key_number(_key(token)))
            self.joined.append(held)
            spans.extend(now)
            last, now, after = now, after, next(tokens, None) if after else None
        self.spans = np.frombuffer(spans, np.int64).reshape(-1, 2) if spans else np.zeros((0, 2), np.int64)
        self.flat, self.ends, self.keys = np.frombuffer(flat, np.uint8) if flat else np.zeros(0, np.uint8), np.frombuffer(ends, np.int64), np.frombuffer(keys, np.uint64) if keys else np.zeros(0, np.uint64)
        second = np.flatnonzero(np.frombuffer(self.joined, np.uint8)) if self.joined else np.zeros(0, np.int64)
        self.chain = np.stack([second - 1, second], 1).astype(np.int32)
        order = np.argsort(self.keys, kind="stable")
        same = (self.keys[order][1:] == self.keys[order][:-1]) & (self.keys[order][1:] != 0)
        skip = np.stack([order[:-1][same], order[1:][same]], 1)
        self.skip = skip[np.argsort(skip[:, 1], kind="stable")].astype(np.int32)
        self.labels = np.zeros(len(self.spans), np.int64)
        starts, stops = self.spans[:, 0], self.spans[:, 1]
        at = 0
        for kind, start, end in sorted(found, key=lambda s: s[1]):
            at = max(at, int(np.searchsorted(stops, start, "right")))  # the first token that ends after the span's start
            self.labels[at : max(at, int(np.searchsorted(starts, end, "left")))] = KINDS.index(kind) + 1

    def features(self, i: int) -> np.ndarray:
        return self.flat[self.ends[i] : self.ends[i + 1]]


#: So many edges are worked on at once.
EDGES = 1 << 15


def posteriors(doc: Document, model: dict, rounds: int = 10) -> np.ndarray:
    """Loopy belief propagation: a row of label probabilities for each token. Pattern labels are held. An edge keeps its two
    messages; what it takes to compute them is there for EDGES of them at a time."""
    n, labels = len(doc.spans), len(KINDS) + 1
    own = np.add.reduceat(model["node"][doc.flat], doc.ends[:-1], axis=0) if n <= EDGES and n else np.zeros((n, labels))
    for lo in range(0, n if n > EDGES else 0, EDGES):
        hi = min(n, lo + EDGES)
        own[lo:hi] = np.add.reduceat(model["node"][doc.flat[doc.ends[lo] : doc.ends[hi]]], doc.ends[lo:hi] - doc.ends[lo], axis=0)
    held = np.flatnonzero(doc.labels)
    own[held] = -50.0
    own[held, doc.labels[held]] = 0.0
    edges = np.concatenate([doc.chain, doc.skip])
    count, total = len(edges), own
    if count:
        tables = np.stack([model["chain"], model["skip"], model["chain"].T, model["skip"].T])
        source, target = edges.T.reshape(-1), edges[:, ::-1].T.reshape(-1)
        kind = np.repeat(np.array([0, 1, 2, 3], np.int8), [len(doc.chain), len(doc.skip)] * 2)
        message = np.zeros((2 * count, labels))
        for _ in range(rounds):
            total = own.copy()
            np.add.at(total, target, message)
            fresh = np.empty_like(message)
            for lo in range(0, 2 * count, EDGES):
                some = np.arange(lo, min(2 * count, lo + EDGES))
                back = message[np.where(some < count, some + count, some - count)]
                new = np.logaddexp.reduce((total[source[some]] - back)[:, :, None] + tables[kind[some]], axis=1)
                new -= np.logaddexp.reduce(new, axis=1, keepdims=True)
                fresh[some] = 0.5 * message[some] + 0.5 * new
            message = fresh
        total = own.copy()
        np.add.at(total, target, message)
    total -= total.max(1, keepdims=True) if n else 0
    p = np.exp(total)
    return p / p.sum(1, keepdims=True) if n else p


def _plausible(kind: str, text: str) -> bool:
    digits = _DIGITS.sub("", text)
    if kind == "email":
        return "@" in text and len(text) >= 5
    if kind == "ip":
        return len(re.findall(r"[0-9]+", text)) == 4 and len(digits) <= 12
    return 13 <= len(digits) <= 19 if kind == "card" else 7 <= len(digits) <= 15


def added(text: str, found: list[Span], model: dict, sure: float = 0.8) -> list[Span]:
    """Spans that the field adds to those of the patterns."""
    doc = Document(text, found)
    if not len(doc.spans) or not model["trained"]:
        return []
    p = posteriors(doc, model)
    best = np.where((p.max(1) >= sure) & (doc.labels == 0), p.argmax(1), 0)
    runs: list[list[int]] = []
    for i in np.flatnonzero(best):
        if runs and runs[-1][-1] == i - 1 and doc.joined[i] and best[i] == best[i - 1] and KINDS[best[i] - 1] in ("card", "phone"):
            runs[-1].append(i)
        else:
            runs.append([i])
    out = []
    for run in runs:
        kind = KINDS[best[run[0]] - 1]
        start, end = int(doc.spans[run[0], 0]), int(doc.spans[run[-1], 1])
        while start < end and not (text[start].isalnum() or text[start] in "+("):
            start += 1
        while end > start and not text[end - 1].isalnum():
            end -= 1
        if start < end and _plausible(kind, text[start:end]) and not any(k == kind and s < end and start < e for k, s, e in found):
            out.append((kind, start, end))
    return out


def _sample(sample_tokens: int):
    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for order, text in zip(batch.column("order").to_pylist(), batch.column("text").to_pylist()):
                doc = Document(text, patterns(text))
                n = min(len(doc.spans), sample_tokens)
                if n:
                    cut = lambda edges: edges[edges.max(1, initial=-1) < n].reshape(-1).tolist()
                    named = set(doc.keys[(doc.labels > 0) & (doc.keys != 0)].tolist())
                    labels = [-1 if not y and k in named else y for k, y in zip(doc.keys[:n].tolist(), doc.labels[:n].tolist())]
                    rows.append((order, [doc.features(i).tolist() for i in range(n)], labels, cut(doc.chain), cut(doc.skip)))
            columns = list(zip(*rows)) if rows else [[]] * 5
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.list_(ints), ints, ints, ints])], ["order", "features", "labels", "chain", "skip"])

    return take


def fit(texts: DataFrame, sample_docs: int = 4000, sample_tokens: int = 200) -> dict:
    """Piecewise training: token weights by regularised logistic regression, edge potentials as smoothed log ratios of pairs to chance."""
    total = texts.count()
    hashed = texts.withColumn("order", F.xxhash64("doc_id"))
    if total > 10 * sample_docs:  # read about ten times the sample, to have enough texts with tokens
        hashed = hashed.where(F.pmod("order", F.lit(1 << 20)) < F.lit(-(-10 * sample_docs * (1 << 20) // total)))
    picked = hashed.mapInArrow(_sample(sample_tokens), "order long, features array<array<int>>, labels array<int>, chain array<int>, skip array<int>")
    docs = picked.orderBy("order").limit(sample_docs).toArrow().to_pylist()
    labels = len(KINDS) + 1
    seen = {"node": np.ones(labels), "chain": np.full((labels, labels), 0.5), "skip": np.full((labels, labels), 0.5)}
    rows, ys = [], []
    for d in docs:
        y = d["labels"]
        for f, k in zip(d["features"], y):
            if k >= 0:
                rows.append(f)
                ys.append(k)
                seen["node"][k] += 1
        for kind in ("chain", "skip"):
            for a, b in zip(d[kind][::2], d[kind][1::2]):
                if y[a] >= 0 and y[b] >= 0:
                    seen[kind][y[a], y[b]] += 1
    x, y = np.zeros((len(rows), FEATURES)), np.array(ys, np.int64)
    for i, f in enumerate(rows):
        x[i, f] = 1
    node = np.zeros((FEATURES, labels))
    target = np.eye(labels)[y] if len(y) else np.zeros((0, labels))
    for _ in range(200 if len(y) else 0):
        z = x @ node
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        node += 0.5 * (x.T @ (target - p) / len(y) - 1e-3 * node)
    share = seen["node"] / seen["node"].sum()

    def ratio(pairs: np.ndarray) -> np.ndarray:
        both = (pairs + pairs.T) / 2
        rows_ = both.sum(1) / both.sum()
        return np.log(both / both.sum() / np.outer(rows_, rows_))

    return {"node": node, "chain": ratio(seen["chain"]), "skip": ratio(seen["skip"]), "share": share, "trained": bool((y > 0).any()) if len(y) else False}


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def _finder(held):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                base = patterns(text) if _MARK.search(text) else []
                whole = base + added(text, base, model)
                n = [sum(k == kind for k, _, _ in base) for kind in KINDS]
                rows.append((*n, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(whole)))
            columns = list(zip(*rows)) if rows else [[]] * 6
            types = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types))], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return find


def find(docs: DataFrame, **options) -> DataFrame:
    """A row for each document: doc_id, the number of pattern spans of each kind, the sha256 of those spans, and all spans
    as kind:start:end in code points, by kind and start."""
    texts = common.ids_and_texts(docs)
    held = docs.sparkSession.sparkContext.broadcast(fit(texts, **options))
    return texts.mapInArrow(_finder(held), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
