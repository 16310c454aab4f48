"""Lexical search, exact dedup and vector codes against brute force on small tables."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkfold.llm import exact_dedup, lexical, vector_codes

LOWER = str.maketrans(lexical.UPPER, lexical.LOWER)


def found_terms(text: str | None) -> list[str]:
    return re.findall(lexical.TERM, (text or "").translate(LOWER))


def ranked(docs, items, k: int) -> list[tuple]:
    counts = [Counter(found_terms(t)) for _, t in docs]
    n_docs, total = sum(1 for c in counts if c), sum(sum(c.values()) for c in counts)
    df = Counter(t for c in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for (doc_id, _), c in zip(docs, counts):
            m = 50 + (50 * sum(c.values()) * n_docs) // total if total else 50
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(found_terms(text)) if t in c)
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scores)[:k])]
    return out


@pytest.fixture(scope="module")
def library(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(60)] + ["Straße", "ÄB", "ночь", "x-y", "A1", "日本語", "Q"]
    odds = 1 / np.arange(1, len(words) + 1)
    texts = [" ".join(rng.choice(words, int(rng.integers(1, 60)), p=odds / odds.sum())) for _ in range(400)]
    docs = list(enumerate(texts, 10)) + [(i, texts[7]) for i in range(1000, 1090)] + [(2000, None), (2001, ""), (2002, " - !"), (None, texts[3]), (None, None), (11, texts[1]), (2003, "w0 " * 9000)]
    return docs, spark.createDataFrame(docs, "doc_id long, text string").withColumn("term", F.lit("x"))


@pytest.mark.parametrize("k", [1, 7, 50])
def test_search_equals_scoring_all(spark, library, k):
    docs, df = library
    items = [(1, "w0 W1 w2 w0"), (2, "ночь straße STRASSE äb ÄB"), (2, "w30 nothing else"), (3, None), (4, ""), (None, "Q a1, 日本語"), (5, docs[7][1]), (6, "absent")]
    asked = spark.createDataFrame(items, "item_id int, text string").withColumn("row", F.lit("x"))
    got = lexical.rank(df.repartition(5), asked, k).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, ranked(docs, items, k)))


def test_search_in_groups_of_queries(spark, library, monkeypatch):
    docs, df = library
    monkeypatch.setattr(lexical, "GROUP_QUERIES", 3)
    items = [(i, t) for i, t in docs[:9] if t]
    got = lexical.rank(df, spark.createDataFrame(items, "item_id int, text string"), 5).collect()
    assert sorted(map(tuple, got)) == sorted(ranked(docs, items, 5))


def test_search_without_documents_or_queries(spark, edge_docs, no_docs):
    items = spark.createDataFrame([(1, "one road")], "item_id int, text string")
    assert lexical.rank(no_docs, items).count() == 0
    assert lexical.rank(edge_docs, items.limit(0)).count() == 0
    assert {r["doc_id"] for r in lexical.rank(edge_docs, items).collect()} == {4, 5}


def test_bytes_bound_impacts():
    counts = np.arange(1, 5000)
    for length in (1, 40, 10**6):
        exact = lexical.impact(counts, np.full(len(counts), length), 1000, 50_000)
        steps = -(-exact // lexical.STEP)
        assert steps.max() <= 255 and np.all(exact <= steps * lexical.STEP) and np.all(exact >= (steps - 1) * lexical.STEP + 1 * (exact > 0) - lexical.STEP * (exact == 0))


def test_terms_of_texts_end_to_end():
    data, at = lexical._bytes(pa.array(["ab", "cd e", "", "é1"]))
    starts, ends = lexical._ends(data, at, lexical._tables()[0])
    assert [bytes(data[a:b]).decode() for a, b in zip(starts, ends)] == ["ab", "cd", "e", "é1"]


# Exact dedup.


def plain(text: str | None) -> str:
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def judged(docs) -> list[tuple]:
    groups = defaultdict(list)
    for i, t in docs:
        groups[plain(t)].append((-len(t or ""), i is None, i or 0, i))
    out = []
    for i, t in docs:
        group = groups[plain(t)]
        out.append((i, min(group)[3], len(group), hashlib.sha256(plain(t).encode()).hexdigest()))
    return out


TEXTS = ["a b", "ab", "a  b", "x", "x ", " x", "", None, " \t\n", "ünï  code", "ün\x0bïcode", "a\xa0b", "AB"]


def test_dedup_equals_grouping(spark):
    docs = [(i, t) for i, t in enumerate(TEXTS * 3)] + [(None, "x   "), (None, "only here")] + [(i, "hot text") for i in range(100, 400)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("digest", F.lit("x")).repartition(3)
    got = exact_dedup.dedup(df)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    rows = got.collect()
    assert sorted(repr((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in rows) == sorted(map(repr, judged(docs)))
    assert all(r.doc_id == r.keep_id for r in rows if r.kept) and sum(r.kept for r in rows) == len({plain(t) for _, t in docs})


def test_later_batches_and_a_batch_added_again(spark, tmp_path):
    name = exact_dedup.index(spark, str(tmp_path / "index"), 4)
    first, second = ([(1, "a b"), (2, "ab"), (3, "c")], [(4, "c   "), (5, "d"), (6, "a b"), (7, "d ")])
    df = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    told = lambda out: sorted((r.doc_id, r.keep_id, r.kept, r.known) for r in out.collect())
    one = told(exact_dedup.add(df(first), name, "day 1"))
    assert one == [(1, 1, True, False), (2, 1, False, False), (3, 3, True, False)]
    two = told(exact_dedup.add(df(second), name, "day 2"))
    assert two == [(4, 3, False, True), (5, 7, False, False), (6, 1, False, True), (7, 7, True, False)]
    held = sorted(map(tuple, spark.table(name).select("batch", "doc_id").collect()))
    assert told(exact_dedup.add(df(second), name, "day 2")) == two
    assert sorted(map(tuple, spark.table(name).select("batch", "doc_id").collect())) == held == [("day 1", 1), ("day 1", 3), ("day 2", 7)]
    # A table of that name made anew over the folder holds the same.
    spark.sql(f"DROP TABLE {name}")
    assert exact_dedup.index(spark, str(tmp_path / "index"), 4) == name and spark.table(name).count() == 3
    packed = exact_dedup.compact(spark, name, str(tmp_path / "packed"))
    assert sorted(map(tuple, spark.table(packed).select("batch", "doc_id").collect())) == held
    kept = exact_dedup.drop_known(df([(8, "c"), (9, "new"), (10, "new")]).withColumn("row", F.lit(1)), packed, "day 3")
    assert kept.columns == ["doc_id", "text", "row"] and [tuple(r) for r in kept.collect()] == [(9, "new", 1)]


def test_the_index_isnt_shuffled(spark, tmp_path):
    name = exact_dedup.index(spark, str(tmp_path / "index"), 4)
    exact_dedup.append(spark.sql("select unhex(sha2('a', 256)) digest, 1L doc_id, 1L points, 1L n"), name, "b")
    groups = spark.range(100).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"))
    plan = exact_dedup._without(groups, spark.table(name))._jdf.queryExecution().executedPlan().toString()
    join, right = plan.index("SortMergeJoin"), plan.index("FileScan")
    assert "LeftAnti" in plan and plan.count("Exchange hashpartitioning") == 1 and plan.rindex("Exchange", join, right) < plan.rindex("Sort [", join, right)


def test_dedup_edges(edge_docs, no_docs):
    assert exact_dedup.dedup(no_docs).count() == 0
    rows = exact_dedup.dedup(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    empty = [r for r in rows if r.text_sha256 == hashlib.sha256(b"").hexdigest()]
    assert len(empty) == 4 and [r.doc_id for r in empty if r.kept] == [3]
    assert sorted((r.group_size, r.kept) for r in rows if r.doc_id == 5) == [(2, False), (2, True)]


# Vector codes.


def coded(vectors, entries: int = 256, rounds: int = 4):
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in vectors if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // 4
    part = lambda v, p: v[p * width : (p + 1) * width]
    nearest = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    books = [[part(v, p) for _, v, _ in kept[:entries]] for p in range(4)]
    for _ in range(rounds):
        for p in range(4):
            cells = defaultdict(list)
            for _, v, _ in kept:
                cells[nearest(part(v, p), books[p])[1]].append(part(v, p))
            books[p] = [[sum(c) // len(c) for c in zip(*cells[k])] if k in cells else e for k, e in enumerate(books[p])]
    best = [[nearest(part(v, p), books[p]) for p in range(4)] for _, v, _ in kept]
    labels = Counter()
    for (_, _, label), b in zip(kept, best):
        labels[label] += sum(d for d, _ in b)
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, "".join(f"{k:02x}" for _, k in b), sum(d for d, _ in b), labels[label], sha) for (i, _, label), b in zip(kept, best)]


def test_codes_equal_plain_rounds(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.3, 8)], [None, 1, 2][i % 3]) for i in range(1, 120)]
    vectors += [(0, vectors[5][1], 1), (500, vectors[5][1], 1), (500, vectors[5][1], 1), (None, vectors[8][1], 7)]
    odd = [(7, None, 1), (8, [], 1), (3, [float("nan")] * 8, 1), (4, [1.0] * 7 + [None], 1), (5, [float("-inf")] * 8, 2)]
    df = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<float>, label int").withColumn("code", F.lit("x")).repartition(3)
    rows = vector_codes.kept(df)
    books = vector_codes.learn(rows, entries=40)
    got = vector_codes.compress(df, entries=40)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, coded(vectors, 40)))
    back = vector_codes.encode(rows, books).where("vec_id = 20").select(vector_codes.decode(F.col("code"), books).alias("v")).first().v
    assert np.abs(np.array(back) - vectors[19][1]).max() < 1


@pytest.mark.parametrize("seed", range(6))
def test_the_tree_finds_the_nearest_entry_with_the_lowest_index(seed):
    rng = np.random.default_rng(seed)
    spread, width = [(3, 2), (4, 4), (1000, 16), (1 << 25, 3), (1, 1), (50, 8)][seed]
    entries = rng.integers(-spread, spread, (256, width))
    entries[100:140] = entries[7]
    points = np.concatenate([rng.integers(-spread, spread, (3000, width)), entries])
    index, best = vector_codes.Tree(entries).nearest(points)
    squares = ((points[:, None, :] - entries[None]) ** 2).sum(2)
    assert np.array_equal(index, squares.argmin(1)) and np.array_equal(best, squares.min(1))


def test_roots_round_outward():
    squares = np.array([0, 1, 2, 3, 4, 2**52 - 1, 2**60 - 1, 2**60, 2**60 + 1, 3037000499**2 - 1], np.int64)
    low, high = vector_codes.root(squares)
    assert low.tolist() == [math.isqrt(int(s)) for s in squares] and high.tolist() == [math.isqrt(int(s)) + (math.isqrt(int(s)) ** 2 < s) for s in squares]


def test_codes_without_vectors_and_of_other_lengths(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert vector_codes.compress(spark.createDataFrame([], schema)).count() == 0
    assert vector_codes.compress(spark.createDataFrame([(1, [1.0, 2.0], 1)], schema)).count() == 0
    rows = vector_codes.compress(spark.createDataFrame([(1, [1.0] * 4, 1), (2, [1.0] * 8, 1), (3, [2.0] * 4, None)], schema)).collect()
    assert sorted((r.vec_id, r.code, r.error) for r in rows) == [(1, "00000000", 0), (3, "01010101", 0)]
    with pytest.raises(Exception, match="32768 or more"):
        vector_codes.compress(spark.createDataFrame([(1, [40000.0] * 4, 1)], schema)).count()


@pytest.mark.parametrize("name", ["op11_lexical_search", "op12_exact_dedup", "op13_vector_codes"])
def test_query_equals_its_oracle(spark, sf, name):
    import duckdb

    from inkfold.llm import queries

    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got, expected = queries.QUERIES[name](spark, sf).toPandas(), con.execute(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(expected.columns) and len(got)
    plain = lambda df: sorted(repr([v.item() if hasattr(v, "item") else v for v in r]) for r in df[sorted(df.columns)].itertuples(index=False, name=None))
    assert plain(got) == plain(expected)
