"""Line dedup, SimHash, decontamination, substring dedup, sharding and the pipeline."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from inkfold.llm import common, components, decontaminate, line_dedup, sharding, simhash, substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sentence(rng: random.Random, n: int, size: int = 400) -> str:
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def rows(df):
    return [r.asDict() for r in df.collect()]


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def line_texts(seed: int) -> list[tuple[int, str]]:
    rng = random.Random(seed)
    base = ["the same phrase in every line " + "".join(rng.choice("abc") for _ in range(6)) for _ in range(12)] + ["".join(rng.choice("ab") for _ in range(21)) for _ in range(12)]
    out = []
    for i in range(40):
        lines = []
        for _ in range(3):
            s = list(rng.choice(base))
            for _ in range(rng.randrange(3)):
                p = rng.randrange(len(s))
                s[p : p + rng.randrange(2)] = [rng.choice("abc")] * rng.randrange(2)
            lines.append("".join(s))
        out.append((i, "\n".join(lines)))
    return out


@pytest.mark.parametrize(("threshold", "crowd"), [(1, 4), (2, 8), (3, 1000)])
def test_lines_link_as_brute_force_says(spark, threshold, crowd):
    texts = line_texts(threshold)
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    every = [(d, k, x) for d, t in texts for k, x in enumerate(t.split("\n"))]
    distinct = {x for _, _, x in every}
    first, copies = {}, Counter(x for _, _, x in every)
    for d, k, x in every:
        first[x] = min(first.get(x, (d, k)), (d, k))
    near = {x: [y for y in distinct if y != x and edits(x, y) <= min(threshold, len(x) // 5, len(y) // 5)] for x in distinct}
    found = {(r["doc_id"], r["line_no"]): r for r in rows(line_dedup.link(docs, threshold, crowd))}
    assert len(found) == len(every)
    for d, k, x in every:
        r = found[d, k]
        assert (r["class_doc_id"], r["class_line_no"]) == first[x] and r["n_copies"] == copies[x] and r["n_links"] == len(near[x])
        assert r["removed"] == ((d, k) > first[x] or any(first[y] < first[x] for y in near[x]))


def test_default_links_reach_four_edits_and_short_lines(spark):
    rng = random.Random(11)
    made = []
    for n in (*range(2, 48), 75, 79, 80, 81, 119, 120, 124, 200, 1000):
        s = "".join(rng.choice("abcdefg hij") for _ in range(n - 1)) + "z"
        made.append(s)
        for k in (0, 1, 2, 3, 4, 5):
            x = list(s)
            for _ in range(k):
                at = rng.randrange(len(x) + 1)
                x[at : at + rng.randrange(2)] = rng.choice(["", "k", "q"])
            made.append("".join(x))
    made = [x for x in made if x.strip()]
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    distinct = set(made)
    first = {x: made.index(x) for x in distinct}
    near = {x: [y for y in distinct if y != x and abs(len(x) - len(y)) <= 4 and edits(x, y) <= min(4, len(x) // 5, len(y) // 5)] for x in distinct}
    for crowd in (4096, 12):
        found = {r["doc_id"]: (r["n_links"], r["removed"]) for r in rows(line_dedup.link(docs, crowd=crowd))}
        assert found == {d: (len(near[x]), d > first[x] or any(first[y] < first[x] for y in near[x])) for d, x in enumerate(made)}


def test_lines_of_many_words_link_as_brute_force_says(spark):
    rng = random.Random(21)
    made = []
    for n in (17, 18, 19, 20, 21, 24, 25, 39, 40, 44, 45, 50, 64, 90, 200):
        for s in (sentence(rng, n, 60), " ".join(rng.choice("a b cd  e".split(" ")) for _ in range(2 * n))):
            made.append(s)
            for k in (1, 2, 3, 4, 4, 4, 5):
                x = list(s)
                for _ in range(k):
                    spaces = [i for i, c in enumerate(x) if c == " "]
                    at = rng.choice(spaces) if rng.random() < 0.5 else rng.randrange(len(x) + 1)
                    x[at : at + rng.randrange(2)] = rng.choice(["", " ", "q"])
                made.append("".join(x))
    made = [x for x in made if x.strip()]
    distinct = set(made)
    near = {x: sum(y != x and abs(len(x) - len(y)) <= 4 and edits(x, y) <= 4 for y in distinct) for x in distinct}
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    for crowd in (3, 4096):
        assert {r["doc_id"]: r["n_links"] for r in rows(line_dedup.link(docs, crowd=crowd))} == {d: near[x] for d, x in enumerate(made)}


def test_unlike_lines_of_one_key_make_no_pairs(spark):
    rng = random.Random(5)
    start = sentence(rng, 40)
    docs = spark.createDataFrame([(i, f"{start} {x}") for i, x in enumerate("".join(rng.choices("hdlugwkbfm", k=40)) for _ in range(80))], "doc_id long, text string")
    assert line_dedup._candidates(line_dedup.lines(docs), 4, 4096, 3)[0].count() < 80 * 79 / 2 / 10


def test_banded_edits(spark):
    rng = random.Random(4)
    made = []
    for _ in range(600):
        a = "".join(rng.choice("abé") for _ in range(rng.randrange(5, 30)))
        x = list(a)
        for _ in range(rng.randrange(7)):
            at = rng.randrange(len(x) + 1)
            x[at : at + rng.randrange(2)] = rng.choice(["", "k", "ab"])
        if abs(len(a) - len("".join(x))) <= 4 and len("".join(x)) > 4:
            made.append((a, "".join(x), edits(a, "".join(x))))
    found = spark.createDataFrame(made, "a string, b string, d int").select("d", line_dedup.edits_within(F.split("a", ""), F.split("b", ""), 4).alias("e"))
    assert all(min(r["d"], 5) == min(r["e"], 5) for r in found.collect())


def test_many_like_lines_and_periodic_ones(spark):
    rng = random.Random(8)
    made = [f"Item number {rng.randrange(10**6):06d} of the list is out of stock today" for _ in range(60)]
    made += ["ha " * 40 + "ha" * k for k in range(4)] + ["a" * n for n in (30, 31, 33, 60)]
    distinct = set(made)
    near = {x: sum(y != x and abs(len(x) - len(y)) <= 4 and edits(x, y) <= min(4, len(x) // 5, len(y) // 5) for y in distinct) for x in distinct}
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    for crowd in (16, 4096):
        assert {r["doc_id"]: r["n_links"] for r in rows(line_dedup.link(docs, crowd=crowd))} == {d: near[x] for d, x in enumerate(made)}


def test_columns_with_inner_names_and_lines_left(spark):
    names = ["gone_key", "gone_id", "gone_tag", "gone_lines", "text_left", "gone", "whole", "left", "row", "id", "first_id", "first_key", "hit_id", "hit_key"]
    texts = [(1, "one line here\ntwo lines there"), (2, "two lines there\nthree of them"), (None, "one line here"), (3, "one line here\n\nfour more of these")]
    docs = spark.createDataFrame([(i, t, *[str(k)] * len(names)) for k, (i, t) in enumerate(texts)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    left = rows(line_dedup.drop_lines(docs))
    assert {(r["doc_id"], r["text"], r["left"], r["row"]) for r in left} == {(1, "two lines there", "0", "0"), (2, "three of them", "1", "1"), (None, "one line here", "2", "2"), (3, "\nfour more of these", "3", "3")}
    benchmark = spark.createDataFrame([(1, "three of them and more")], "item_id long, text string")
    assert rows(simhash.keep_first(docs)) and simhash.keep_first(docs).columns == decontaminate.drop_contaminated(docs, benchmark).columns == docs.columns


def test_lines_at_the_edges(edge_docs, no_docs):
    left = line_dedup.drop_lines(edge_docs)
    assert left.columns == edge_docs.columns
    assert {r["doc_id"] for r in rows(left)} >= {1, 2, 3, 4, 5, None}
    assert line_dedup.link(no_docs).count() == 0 and line_dedup.drop_lines(no_docs).count() == 0


def plain_fingerprint(text: str) -> int:
    words = [w.encode() for w in WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text))]
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints: dict[int, int], bits: int) -> dict[int, int]:
    group = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for i in prints:
            for j in prints:
                if (prints[i] ^ prints[j]).bit_count() <= bits and group[j] < group[i]:
                    group[i], changed = group[j], True
    return group


def test_fingerprints_and_components(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("text is not null")
    prints = {r["doc_id"]: plain_fingerprint(r["text"]) for r in docs.collect()}
    group = plain_components(prints, 4)
    for crowd in (1024, 1):
        found = rows(simhash.near_duplicates(docs, crowd=crowd))
        assert {r["doc_id"]: r["component_id"] for r in found} == group
        assert all(int(r["fingerprint"], 16) == prints[r["doc_id"]] for r in found)


@pytest.mark.parametrize(("crowd", "bits"), [(1, 4), (8, 2), (1, 2), (1000, 4)])
def test_links_between_random_fingerprints(spark, crowd, bits):
    rng = random.Random(3)
    prints = []
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(8):
            y = x
            for b in rng.sample(range(64), rng.randrange(6)):
                y ^= 1 << b
            prints.append(y)
    nodes = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in set(prints)], "print long")
    label = {r["node"]: r["label"] for r in rows(components.labels(simhash._near_links(nodes, bits, crowd)))}
    own = {i: p - (1 << 64) if p >> 63 else p for i, p in enumerate(sorted(set(prints), key=lambda p: p - (1 << 64) if p >> 63 else p))}
    group = plain_components({i: p % (1 << 64) for i, p in own.items()}, bits)
    assert {i: label.get(p, p) for i, p in own.items()} == {i: own[g] for i, g in group.items()}


def test_triples_cover_all_fours():
    from itertools import combinations

    covers = [set(t) for t in simhash.triples()]
    assert len(covers) == 20 and all(any(t <= set(four) for t in covers) for four in combinations(range(8), 4))


def test_simhash_at_the_edges(edge_docs, no_docs):
    found = rows(simhash.near_duplicates(edge_docs))
    assert len(found) == edge_docs.count() and {r["component_id"] for r in found if r["doc_id"] in (1, 2, 3)} == {1}
    assert simhash.keep_first(edge_docs).columns == edge_docs.columns
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.keep_first(no_docs).count() == 0


def test_planted_passages_are_found(spark):
    rng = random.Random(5)
    items = [(i, sentence(rng, 30)) for i in range(20)]
    docs = [(i, sentence(rng, 300)) for i in range(60)]
    planted = {}
    for k in range(20):
        words, at = items[k][1].split(), rng.randrange(250)
        for p in rng.sample(range(30), k % 5):
            words[p] = "changed"
        if k % 3 == 0:
            del words[k % 30]
        body = docs[k][1].split()
        docs[k] = (k, " ".join(body[:at] + [w.upper() + "," for w in words] + body[at:]))
        planted[k] = k
    benchmark = spark.createDataFrame([*items, (98, None), (99, "")], "item_id long, text string")
    found = rows(decontaminate.find(spark.createDataFrame(docs, "doc_id long, text string"), benchmark, block_items=7))
    assert {r["doc_id"]: r["item_id"] for r in found} == planted and len(found) == 20
    kept = decontaminate.drop_contaminated(spark.createDataFrame(docs, "doc_id long, text string"), benchmark)
    assert {r["doc_id"] for r in rows(kept)} == set(range(20, 60))


def test_edited_copies_of_common_passages_are_found(spark):
    item = [f"i{k}" for k in range(24)]
    edited = [w if k % 8 != 3 else "changed" for k, w in enumerate(item)]
    # The item's words are frequent throughout, and its rarest trigrams are those that the copy lost.
    common_words = " ".join(" ".join(w for k, w in enumerate(item) if k % 8 != 3) for _ in range(40))
    docs = [(0, " ".join(edited)), *((k, common_words) for k in range(1, 40)), (99, "i0 i1 i2 and nothing else of it")]
    found = rows(decontaminate.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string"), threshold=0.8))
    assert {(r["doc_id"], r["score"]) for r in found if r["doc_id"] in (0, 99)} == {(0, (2 * 21 - 3) / 48)}


def plain_alignment(a: list, b: list) -> int:
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            table[i][j] = max(0, table[i - 1][j - 1] + (2 if x == y else -1), table[i - 1][j] - 1, table[i][j - 1] - 1)
    return max(map(max, table))


def test_all_pairs_align_as_found(spark):
    rng = random.Random(13)
    items = [(i, sentence(rng, rng.randrange(1, 16), 12)) for i in range(12)]
    docs = [(i, sentence(rng, rng.randrange(60), 12)) for i in range(40)]
    found = {(r["doc_id"], r["item_id"]): r["score"] for r in rows(decontaminate.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), threshold=0.7))}
    for d, text in docs:
        for i, item in items:
            a, b = item.split(), text.split()
            score = plain_alignment(a, b) / (2 * len(a))
            n = min(3, len(a))
            shared = {tuple(a[k : k + n]) for k in range(len(a) - n + 1)} & {tuple(b[k : k + n]) for k in range(len(b) - n + 1)}
            if (d, i) in found:
                assert found[d, i] <= score + 1e-9
            assert ((d, i) in found) == (score >= 0.7 and bool(shared)), (d, i, score)


def test_alignment_scores():
    import numpy as np

    a = np.array([1, 2, 3, 4], np.uint64)
    assert decontaminate.align(a, np.array([9, 1, 2, 3, 4, 9], np.uint64)) == (8, 1, 5)
    assert decontaminate.align(a, np.array([1, 2, 9, 4], np.uint64)) == (5, 0, 4)
    assert decontaminate.align(a, np.array([9, 9], np.uint64)) == (0, 0, 0)


def test_decontamination_at_the_edges(spark, edge_docs, no_docs):
    benchmark = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    assert {r["doc_id"] for r in rows(decontaminate.find(edge_docs, benchmark))} == {5}
    short = spark.createDataFrame([(1, "Two, three"), (2, "three one"), (3, "mail")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"], r["score"]) for r in rows(decontaminate.find(edge_docs, short))} == {(5, 1, 1.0), (6, 3, 1.0)}
    left = decontaminate.drop_contaminated(edge_docs, benchmark)
    assert left.columns == edge_docs.columns and left.count() == edge_docs.count() - 2
    assert decontaminate.find(edge_docs, benchmark.limit(0)).count() == 0 and decontaminate.find(no_docs, benchmark).count() == 0


def plain_removed(texts: dict[int, list[str]], span: int) -> dict[int, set[int]]:
    first = {}
    for d, ws in texts.items():
        for i in range(len(ws) - span + 1):
            w = tuple(ws[i : i + span])
            first[w] = min(first.get(w, d), d)
    return {d: {j for i in range(len(ws) - span + 1) if first[tuple(ws[i : i + span])] < d for j in range(i, i + span)} for d, ws in texts.items()}


def test_repeated_passages_go(spark, sf):
    rng = random.Random(9)
    passages = [sentence(rng, 120, 30) for _ in range(4)]
    made = []
    for i in range(30):
        parts = []
        for _ in range(3):
            words, at = rng.choice(passages).split(), rng.randrange(40)
            parts += [sentence(rng, rng.randrange(60), 30), " ".join(words[at : at + rng.randrange(40, 80)])]
        made.append((1000 + i, " ".join(parts)))
    made += [(2000, passages[0]), (2001, passages[0] + "\n" + passages[0]), (2002, " ".join(["same"] * 130)), (2003, " ".join(["same"] * 90))]
    docs = spark.createDataFrame(made, "doc_id long, text string").unionByName(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))
    texts = {r["doc_id"]: WORD.findall(r["text"] or "") for r in docs.collect()}
    gone = plain_removed(texts, substring.SPAN)
    assert sum(map(bool, gone.values())) > 20
    for r in rows(substring.remove_repeats(docs)):
        words = texts[r["doc_id"]]
        left = " ".join(w for j, w in enumerate(words) if j not in gone[r["doc_id"]])
        assert (r["n_words"], r["n_removed"]) == (len(words), len(gone[r["doc_id"]]))
        assert r["kept_text"] == left and r["kept_sha256"] == hashlib.sha256(left.encode()).hexdigest()


@pytest.mark.parametrize("share", [1, 3, 1000])
def test_common_keys_join_like_others(spark, share):
    data = [(k, i) for k, n in ((1, 50), (2, 7), (3, 1), (None, 4)) for i in range(n)]
    table = spark.createDataFrame(data, "k int, i int")
    groups = table.where("k is null or k != 3").groupBy("k").count().withColumnRenamed("count", "n")
    found = common.join_counted(table, groups, ["k"], share)
    assert sorted((r["k"], r["i"], r["n"]) for r in found.collect()) == sorted((k, i, {1: 50, 2: 7}[k]) for k, i in data if k in (1, 2))
    assert common.join_counted(table, groups.limit(0), ["k"], share).count() == 0


def test_nonbranching_paths_compact(spark):
    # One path of 9 edges whose node after the fourth branches; sources go on within a document.
    chain = [(e, e, e + 1, 1, 5, e * 3, 52) for e in range(9)] + [(100, 4, 50, 2, 6, 0, 52), (101, 50, 51, 2, 6, 40, 52)]
    edges = spark.createDataFrame(chain, "edge long, left long, right long, doc_id long, tag long, start int, size int")
    found = {(r["edge"], r["head"], r["offset"]) for r in rows(substring.compact(edges))}
    assert found == {(e, 0, 3 * e) for e in range(1, 4)} | {(e, 4, 3 * (e - 4)) for e in range(5, 9)}


def test_substrings_at_the_edges(edge_docs, no_docs):
    found = rows(substring.remove_repeats(edge_docs))
    assert len(found) == edge_docs.count() and all(r["n_removed"] == 0 for r in found)
    assert substring.remove_repeats(no_docs).count() == 0


def test_unlike_rows_with_one_id_or_none_stay(spark):
    rng = random.Random(21)
    texts = [sentence(rng, 60) for _ in range(6)]
    made = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (8, texts[3]), (None, texts[4]), (9, texts[4]), (9, texts[5])]
    docs = spark.createDataFrame(made, "doc_id long, text string")
    kept = [(r["doc_id"], r["text"]) for r in rows(simhash.keep_first(docs))]
    assert len(kept) == 6 and set(kept) == {(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (9, texts[4]), (9, texts[5])}
    benchmark = spark.createDataFrame([(1, " ".join(texts[1].split()[10:40])), (2, texts[3])], "item_id long, text string")
    left = [(r["doc_id"], r["text"]) for r in rows(decontaminate.drop_contaminated(docs, benchmark))]
    assert len(left) == 5 and set(left) == {m for m in made if m[1] not in (texts[1], texts[3])}


def test_shards_are_level(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    placed, slots = rows(sharding.assign(docs)), defaultdict(list)
    assert len(placed) == len(texts)
    for r in placed:
        slots[r["shard"]].append(r["slot"])
        assert r["size"] == len(texts[r["doc_id"]]) + 8 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]])
    assert set(slots) == set(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in rows(sharding.assign(docs.repartition(7)))} == {(r["doc_id"], r["shard"], r["slot"]) for r in placed}


def test_equal_rows_are_ranked_in_parts(spark, monkeypatch):
    monkeypatch.setattr(sharding, "LEAST_CROWD", 50)
    docs = spark.createDataFrame([(None, "")] * 700 + [(i, f"text {i}") for i in range(500)], "doc_id long, text string").repartition(9)
    slots = defaultdict(list)
    for r in rows(sharding.assign(docs)):
        slots[r["shard"]].append(r["slot"])
    assert sum(map(len, slots.values())) == 1200 and all(sorted(x) == list(range(50)) for x in slots.values())


def plain_walk(counts: dict[int, int], shards: int, replicas: int) -> list[int]:
    """Rows of each shard, one row at a time round the ring: overflow first, then a node's own rows."""
    nodes, total = sharding.ring(shards, replicas), sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    own = {k: [] for k in range(len(nodes))}
    for p in sorted(counts):
        own[next((k for k, (at, _) in enumerate(nodes) if at >= p), 0)] += [(p, r) for r in range(counts[p])]
    waiting, home = [], {}
    for turn in range(2):
        for k, (_, shard) in enumerate(nodes):
            waiting += own[k] if not turn else []
            while waiting and room[shard]:
                home[waiting.pop(0)] = shard
                room[shard] -= 1
    return home


def test_places_are_those_of_a_walk_round_the_ring():
    rng = random.Random(2)
    counts = {rng.randrange(1 << 16): rng.randrange(1, 6) for _ in range(200)} | {77: 90}
    for shards in (3, 24):
        found = {(p, r): s for p, first, end, s, _ in sharding.place(counts, shards, 8) for r in range(first, end)}
        assert found == plain_walk(counts, shards, 8)


def test_most_rows_stay_on_their_nodes():
    counts = {p: 1 for p in range(0, 1 << 16, 16)}
    home = {}
    for shards in (24, 25):
        home[shards] = {p: s for p, _, _, s, _ in sharding.place(counts, shards, 64)}
    assert sum(home[24][p] == home[25][p] for p in counts) > 0.9 * len(counts)


def test_shards_at_the_edges(edge_docs, no_docs):
    assert sharding.assign(edge_docs).count() == edge_docs.count() and sharding.assign(no_docs).count() == 0


def test_pipeline_stages_keep_the_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        n = docs.count()
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == before and 0 < docs.count() <= n, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_pipeline_is_its_stages_by_brute_force(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(31)
    text = lambda: "\n".join(sentence(rng, rng.randrange(16, 26), 5000) + "." for _ in range(3))
    made = [[i, text()] for i in range(24)]
    made[5][1] = made[2][1]
    made[7][1] = made[3][1].replace("w1", "v1", 1) + "\nnew words stand here, many of them, and more follow."
    made[9][1] += "\n" + made[1][1].split("\n")[0]
    item = sentence(rng, 20, 5000)
    made[11][1] = made[11][1] + "\n" + " ".join(w if k != 7 else "other" for k, w in enumerate(item.split())) + "."
    made += [[100, "# # $ $ %"], [101, None], [102, ""], [None, text()], [103, " ".join(["same words"] * 60)]]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in made], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    from inkfold.llm import quality

    good = {r["doc_id"] for r in rows(quality.assess(docs)) if r["kept"]}
    left = [(i, t) for i, t in made if i in good]
    order = lambda i: (i is not None, i or 0)
    every = [((order(i), k), x) for i, t in left for k, x in enumerate(t.split("\n")) if WORD.search(x)]
    first = {}
    for at, x in every:
        first[x] = min(first.get(x, at), at)
    near = lambda x, y: abs(len(x) - len(y)) <= 4 and edits(x, y) <= min(4, len(x) // 5, len(y) // 5)
    gone = {at for at, x in every if at > first[x] or any(first[y] < first[x] and y != x and near(x, y) for y in first)}
    left = [(i, "\n".join(x for k, x in enumerate(t.split("\n")) if (order(i), k) not in gone)) for i, t in left]
    left = [(i, t) for i, t in left if WORD.search(t)]
    group = plain_components(dict(enumerate(plain_fingerprint(t) for _, t in left)), 4)
    best = {}
    for n, (i, _) in enumerate(left):
        best[group[n]] = min(best.get(group[n], n), n, key=lambda m: (left[m][0] is None, left[m][0] or 0))
    left = [left[n] for n in sorted(best.values())]
    plain = lambda t: re.findall(r"[a-z0-9]+", t.lower())
    left = [(i, t) for i, t in left if plain_alignment(plain(item), plain(t)) / (2 * len(plain(item))) < 0.5]
    tokens = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = sorted((order(i), len(tokens.encode(t, add_special_tokens=False).ids) + 1) for i, t in left)
    found = {(order(r["doc_id"]), r["doc_tokens"]) for r in rows(corpus_pipeline.run(spark, str(tmp_path)))}
    assert sorted(found) == expected and {5, 11, 100, 101, 102, 103}.isdisjoint({r[0][1] for r in found})


def test_pipeline_without_documents(spark, tmp_path, no_docs):
    no_docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
