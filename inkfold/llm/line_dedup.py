"""Line dedup by a segment-partition edit join, in DataFrame functions only.

Of two lines within k edits, the shorter one split into k + 1 equal segments, one segment stands unchanged in the other,
moved by no more places than there are segments before it or after it. Each line is indexed by its segments, and probes
those places for each length that a shorter partner may have. Neighbouring lengths share one segment size, so a line
probes one or two partitions, seldom more. A segment's key is the gram in it with the least hash: places next to each
other mostly have the same one, so a line has few keys whatever the threshold. What agrees in no key with another line
is dropped on the keys alone; texts are fetched only for the lines left. Lines of many words have segments of words instead,
with runs of words as keys, which are cheaper to compute. The join on keys drops pairs whose letter counts differ by more
than the edits; it still compares all lines of a key, so its work, not its result, is of the square of a key's lines. The others
are verified by banded bit-parallel edit distance, without the ends at which they agree. Where a key is common to more than `crowd` lines, the lines that hold it are not paired: what is left of them,
without the gram, must also lie within k edits, so the same join runs on the rests, `depth` times at most. So a phrase
that a third of all lines share costs no pairs; lines that share `depth` grams, one in the rest of the other, are compared
outright, however many they are.

Exact copies are one class, told by two independent 64-bit hashes of the line. Two lines are linked within `threshold`
edits and one for each EDIT_CHARS characters of the shorter one; lines under EDIT_CHARS characters have exact copies only,
which go like others.

Edge cases: a null or empty text has no lines, nor does a line without a word. Of copies the one with the smallest
(doc_id, line_no) is first, a null id before others. A row repeated with its id is the same lines again. Lines of any
length are read whole. An empty table gives no rows; other columns are ignored by `link` and kept by `drop_lines`,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfold.llm import common

#: A line may differ by one edit for each so many characters, up to the threshold; shorter ones have exact copies only.
EDIT_CHARS = 5
#: Lines of so many words, told by single spaces, are indexed by runs of words.
WORDS = 20
#: And of so many characters.
LONG = 40
#: A word's place, below the bits of its hash.
PLACE = (1 << 31) - 1
WORDY = r"[^\x20\x09-\x0D]"


def _once(value: Column, use) -> Column:
    """use(value), where value is computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def lines(docs: DataFrame) -> DataFrame:
    """A row for each line with a word: doc_id, tag (of the text), line_no, line, and its two hashes line_id and line_id2."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_tag().alias("tag"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    return rows.where(F.col("line").rlike(WORDY)).withColumns({"line_id": F.xxhash64("line"), "line_id2": F.xxhash64(F.lit(1), "line")})


def _bucket(n: Column) -> Column:
    """The least length that shares n's segment size: steps of 1 below 8, then at most a quarter of n."""
    step = F.call_function("shiftleft", F.lit(1), F.greatest(F.length(F.bin(n.cast("long"))) - 3, F.lit(0)))
    return n - n % step


def _partitions(rows: DataFrame, allowed, threshold: int) -> DataFrame:
    """Rows g, line_id, s once for each partition that a line is in: g, line_id, n, chars, b (least length of the partition), k
    (edits), mine (its own, not that of shorter lines), part (size of a segment) and size (of a gram)."""

    def partition(less: int) -> Column:
        m = F.col("n") - less
        return _once(F.struct(_bucket(m).alias("b"), allowed(m).cast("int").alias("k"), F.lit(less == 0).alias("mine")), lambda x: F.when((x["k"] >= max(less, 1)) & (x["b"] >= 2 * (x["k"] + 1)), x))

    def unlike(found: Column) -> Column:  # the line's own partition comes first, so a later one that is equal goes
        return F.filter(found, lambda x, i: ~F.exists(F.slice(found, 1, i), lambda y: (y["b"] == x["b"]) & (y["k"] == x["k"])))

    found = _once(F.array_compact(F.array(*(partition(less) for less in range(threshold + 1)))), unlike)
    placed = rows.withColumn("n", F.length("s")).select("g", "line_id", "s", "n", F.explode(found).alias("p")).select("g", "line_id", "n", F.encode("s", "UTF-32").alias("chars"), "p.*")
    placed = placed.withColumn("part", F.floor(F.col("b") / (F.col("k") + 1)).cast("int"))
    return placed.withColumn("size", F.col("part") - F.least(F.greatest(F.col("part") - 12, F.lit(0)), F.lit(10)))


def _segments(use) -> Column:
    """use(grams, i, lo, up, start) for each segment i: the hashes of the grams in the windows that start in lo to up; start
    is the segment's own place."""
    n, k, part, size = (F.col(c) for c in ("n", "k", "part", "size"))

    def segment(i: Column) -> Column:
        start = part * i
        lo, up = F.greatest(start - F.least(i, k - i), F.lit(0)), F.least(start + i, n - part)
        grams = F.transform(F.sequence(lo, up + part - size), lambda j: F.xxhash64(F.substring(F.col("chars"), 4 * j + 1, 4 * size)))
        return _once(grams, lambda g: use(g, i, lo, up, start))

    return F.transform(F.sequence(F.lit(0), k), segment)


def _key(least: Column, i: Column) -> Column:
    return F.xxhash64("g", "b", "k", i, least)


def _window(grams: Column, at: Column, lo: Column) -> Column:
    return F.slice(grams, at - lo + 1, F.col("part") - F.col("size") + 1)


def _keys(placed: DataFrame) -> DataFrame:
    """line_id, n, k, own (the keys of a line's own segments, by which it is indexed) and keys (those it only probes)."""

    def both(grams: Column, i: Column, lo: Column, up: Column, start: Column) -> Column:
        least = lambda at: _key(F.array_min(_window(grams, at, lo)), i)
        return F.struct(F.when(F.col("mine"), least(start)).alias("own"), F.transform(F.sequence(lo, up), least).alias("keys"))

    found = placed.select("line_id", "n", "k", F.explode(F.array(_segments(both))).alias("x"))
    own = F.array_compact("x.own")
    return found.select("line_id", "n", "k", own.alias("own"), F.array_except(F.flatten("x.keys"), own).alias("keys"))


def _word_keys(rows: DataFrame, threshold: int) -> DataFrame:
    """As _keys, for rows line_id, s of at least WORDS words, where n counts words and segments are of words.

    An edit changes a word, or parts or joins two; it counts for the segment whose words, or spaces after them, it changes. So
    of a segment without edits all words but the first stand in the other line. Its key is a run of words behind the first
    one: of the first few runs there, the one that starts with the word of the least hash."""
    k, pairs = threshold, [(i, d) for i in range(threshold + 1) for d in range(-min(i, threshold - i), i + 1)]
    n, part = F.col("n"), F.col("part")
    marks = F.transform(F.split("s", " "), lambda w, j: F.xxhash64(w).bitwiseAND(F.lit(-1 << 31)).bitwiseOR(j.cast("long")))  # a word's place is below its hash
    split = rows.select("line_id", F.explode(F.array(marks)).alias("marks")).select("line_id", "marks", F.size("marks").alias("n"))
    found = F.filter(F.array_distinct(F.array(*(_bucket(n - less) for less in range(k + 1)))), lambda b: b >= WORDS)
    placed = split.select("line_id", "n", "marks", F.explode(found).alias("b"))
    placed = placed.withColumns({"part": F.floor(F.col("b") / (k + 1)).cast("int"), "mine": _bucket(n) == F.col("b")})
    # Runs are of three words, or five; those at up to four places fit into the segment.
    short = F.col("part") < 8
    room = part - F.when(short, 3).otherwise(5)
    place = lambda at, t: F.get("marks", at + t) if t == 0 else F.when(t < room, F.get("marks", at + t))
    least = lambda at: F.least(*(place(at, t) for t in range(4)))
    starts = {(i, d): F.greatest(F.least(part * i + d, n - part), F.lit(0)) + 1 for i, d in pairs}
    own = F.when(F.col("mine"), F.array_distinct(F.transform(F.array(*(starts[i, 0] for i in range(k + 1))), least))).otherwise(F.array().cast("array<bigint>"))
    placed = placed.select("line_id", "n", "marks", "b", "part", own.alias("own"), F.transform(F.array(*starts.values()), least).alias("every"))

    def key(x: Column) -> Column:
        words = lambda size: F.xxhash64(F.lit(-1), "b", *(F.shiftright(F.get("marks", x.bitwiseAND(F.lit(PLACE)).cast("int") + t), 31) for t in range(size)))
        return F.when(short, words(3)).otherwise(words(5))

    return placed.select("line_id", "n", F.lit(k).alias("k"), F.transform("own", key).alias("own"), F.transform(F.array_except("every", "own"), key).alias("keys"))


def _rests(placed: DataFrame, crowded: DataFrame, texts: DataFrame) -> DataFrame:
    """(g, line_id, k, s) for each crowded key of a line: what is left of it without the gram; a mark keeps what was before it
    apart from what was after."""

    def places(grams: Column, i: Column, lo: Column, up: Column, start: Column) -> Column:
        def place(at: Column) -> Column:
            return _once(_window(grams, at, lo), lambda w: F.struct(_key(F.array_min(w), i).alias("key"), (at + F.array_position(w, F.array_min(w)) - 1).cast("int").alias("at")))

        return F.transform(F.sequence(lo, up), place)

    spots = placed.select("g", "line_id", "k", "size", F.explode(F.flatten(_segments(places))).alias("x")).select("x.key", "g", "line_id", "k", "size", "x.at").distinct()
    rest = F.concat(F.col("s").substr(F.lit(1), F.col("at")), F.lit("\n"), F.col("s").substr(F.col("at") + F.col("size") + 1, F.length("s")))
    return spots.join(crowded, "key", "left_semi").join(texts.select("g", "line_id", "s"), ["g", "line_id"]).select(F.col("key").alias("g"), "line_id", "k", rest.alias("s")).distinct()


def _held(keyed: DataFrame) -> DataFrame:
    """key, line_id, n, k, own and lines (how many distinct lines have the key) of the keys that a line's own segments share
    with other lines."""
    tagged = lambda keys, own: F.transform(keys, lambda x: F.struct(x.alias("key"), F.lit(own).alias("own")))
    both = F.concat(tagged("own", True), tagged("keys", False))
    flat = keyed.select("line_id", "n", "k", F.explode(both).alias("x")).select("x.key", "line_id", "n", "k", "x.own")
    shared = flat.groupBy("key").agg(F.count(F.lit(1)).alias("lines"), F.max("own").alias("indexed")).where("lines > 1 and indexed")
    # Copies of a line, and places in it with one gram, are one row from here on.
    met = common.stash(flat.join(shared.select("key"), "key").groupBy("key", "line_id", "n", "k").agg(F.max("own").alias("own")), "met")
    shared = met.groupBy("key").agg(F.count(F.lit(1)).alias("lines"), F.max("own").alias("indexed")).where("lines > 1 and indexed")
    return met.join(shared.drop("indexed"), "key")


def _key_pairs(held: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """(a, b) for lines with a common key, a's own, where b is as long or up to k longer, and their letters are alike."""
    held = held.join(texts.select("line_id", *LETTERS), "line_id")
    a = held.where("own").select("key", F.col("line_id").alias("a"), F.col("n").alias("n_a"), "k", *_side("a"))
    b = held.select("key", F.col("line_id").alias("b"), F.col("n").alias("n_b"), *_side("b"))
    return a.join(b, "key").where((F.col("n_b") - F.col("n_a")).between(0, F.col("k")) & (F.col("a") != F.col("b")) & _alike(threshold)).select("a", "b")


def _short_pairs(rows: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """(a, b) for rests of one key with hardly more characters than edits: most of these are links."""
    sized = rows.withColumn("n", F.length("s")).drop("s").join(texts.select("line_id", *LETTERS), "line_id")
    a = sized.where(F.col("n") < 2 * (F.col("k") + 1)).select("g", F.col("line_id").alias("a"), F.col("n").alias("n_a"), "k", *_side("a"))
    b = sized.where(F.col("n") < 3 * F.col("k") + 2).select("g", F.col("line_id").alias("b"), F.col("n").alias("n_b"), *_side("b"))
    return a.join(b, "g").where((F.col("n_b") - F.col("n_a")).between(0, F.col("k")) & (F.col("a") != F.col("b")) & _alike(threshold)).select("a", "b")


def _candidates(every: DataFrame, threshold: int, crowd: int, depth: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of line_ids, a before b, that may be links, none of those missed; and the lines they name (line_id, line_id2, s)."""
    rows = every.select(F.lit(0).cast("long").alias("g"), "line_id", F.col("line").alias("s"))
    allowed = lambda m: F.least(F.floor(m / EDIT_CHARS), F.lit(threshold))
    # A pair of lines of WORDS words and LONG characters or more meets by words, all others by characters.
    n_words, n_chars = F.octet_length("s") - F.octet_length(F.replace(F.col("s"), F.lit(" "), F.lit(""))) + 1, F.length("s")
    brief = (n_words < WORDS + threshold) | (n_chars < LONG + threshold)
    keyed = _keys(_partitions(rows.where(brief), allowed, threshold)).unionByName(_word_keys(rows.where((n_words >= WORDS) & (n_chars >= LONG)), threshold))
    held = common.stash(_held(common.stash(keyed, "keys")), "held")
    named = held.select("line_id").distinct()
    texts = every.join(named, "line_id", "left_semi").groupBy("line_id", "line_id2").agg(F.first("line").alias("s"))
    texts = common.stash(texts.select("*", *(x.alias(c) for c, x in zip(LETTERS, _letters()))), "texts")
    rows, pairs = texts.select(F.lit(0).cast("long").alias("g"), "line_id", "s"), None
    for level in range(1, depth + 1):
        calm = _key_pairs(held.where(F.col("lines") <= crowd) if level < depth else held, texts, threshold)
        pairs = calm if pairs is None else pairs.unionByName(calm)
        crowded = held.where(F.col("lines") > crowd)
        if level == depth or crowded.isEmpty():
            break
        keys, crowding = crowded.select("key").distinct(), rows.join(crowded.select("line_id").distinct(), "line_id", "left_semi")
        rests = _rests(_partitions(crowding.where(brief) if level == 1 else crowding, allowed, threshold), keys, rows)
        if level == 1:  # lines with a common run of words meet by their characters
            rests = rests.unionByName(crowding.where((n_words >= WORDS) & (n_chars >= LONG)).withColumn("k", F.lit(threshold)))
        rows = common.stash(rests, "rests")
        allowed = lambda m: F.when(m > 0, F.col("k")).otherwise(0)
        pairs = pairs.unionByName(_short_pairs(rows, texts, threshold))
        held = common.stash(_held(common.stash(_keys(_partitions(rows, allowed, threshold)), "keys")), "held")
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return common.stash(pairs.repartition(common.spark_partitions(every.sparkSession)), "pairs"), texts  # few bytes, much work


#: The letters that are counted, eight to a column, and the columns: counts, and their sum.
COUNTED = "enitarsohdlugywkbfmcv., "
LETTERS = ("letters0", "letters1", "letters2", "letters")


def _letters() -> list[Column]:
    """How often each of these letters is in s, eight bits for each, counted up to 127; and the sum of these counts."""
    count = lambda c: F.least(F.octet_length("s") - F.octet_length(F.replace(F.col("s"), F.lit(c), F.lit(""))), F.lit(127)).cast("long")
    packed = [sum((F.shiftleft(count(c), 8 * i) for i, c in enumerate(COUNTED[at : at + 8])), F.lit(0).cast("long")) for at in (0, 8, 16)]
    return [*packed, sum(map(count, COUNTED), F.lit(0).cast("long"))]


def _side(x: str) -> list[Column]:
    return [F.col(c).alias(f"{c}_{x}") for c in LETTERS]


def _alike(threshold: int) -> Column:
    """Whether a's and b's letters allow so few edits: an edit takes one letter away at most, and puts one in at most. The
    letters taken and those put in are differences in all; what one exceeds the other by is that of the sums."""
    at = lambda c, i: F.shiftright(c, 8 * i).bitwiseAND(F.lit(127))
    apart = sum((F.abs(at(f"{c}_a", i) - at(f"{c}_b", i)) for c in LETTERS[:3] for i in range(8)), F.lit(0))
    return apart + F.abs(F.col("letters_a") - F.col("letters_b")) <= 2 * threshold


def edits_within(a: Column, b: Column, k: int) -> Column:
    """The edit distance of two arrays of characters, of lengths that differ by at most k and are over k, if it is at most
    k; else something over k. Banded and bit-parallel: a number's 2k + 1 bits are the differences along a column of the
    table within k places of the diagonal, and each character of b takes a fixed number of steps on them."""
    band, m = 2 * k + 1, F.size(a)
    ones, top = (1 << band) - 1, 1 << (band - 1)
    left = lambda x, i: F.call_function("shiftleft", x, i)
    right = lambda x: F.shiftright(x, 1)

    def equal(j: Column) -> Column:
        return sum((F.when(F.get(a, j + (i - k)) == F.get(b, j), F.lit(1 << i)).otherwise(F.lit(0)) for i in range(band)), F.lit(0))

    def step(acc: Column, x: Column) -> Column:
        vp, vn = acc["vp"], acc["vn"]

        def after(d: Column) -> Column:
            hp, hn = vn.bitwiseOR(d.bitwiseOR(vp).bitwiseXOR(F.lit(ones))), d.bitwiseAND(vp)
            at = left(F.lit(1), F.greatest(m + (k - 1) - x["j"], F.lit(0)).cast("int"))  # the last row's bit, once it is in the band
            below = F.when(d.bitwiseAND(F.lit(top)) == 0, 1).otherwise(0)
            along = F.when(hp.bitwiseAND(at) != 0, 1).when(hn.bitwiseAND(at) != 0, -1).otherwise(0)
            down = right(d)
            return F.struct(hn.bitwiseOR(down.bitwiseOR(hp).bitwiseXOR(F.lit(ones))).alias("vp"), down.bitwiseAND(hp).alias("vn"), (acc["far"] + F.when(x["j"] < m - k, below).otherwise(along)).alias("far"))

        e = x["e"]
        return _once(e.bitwiseAND(vp).__add__(vp).bitwiseXOR(vp).bitwiseOR(e).bitwiseOR(vn).bitwiseAND(F.lit(ones)), after)

    columns = F.transform(F.sequence(F.lit(0), F.size(b) - 1), lambda j: F.struct(j.alias("j"), equal(j).alias("e")))
    start = F.struct(F.lit(((1 << (k + 1)) - 1) << k).alias("vp"), F.lit(0).alias("vn"), F.lit(k).alias("far"))
    return F.aggregate(columns, start, step, lambda acc: acc["far"])


def _cores(threshold: int, step: int = 8) -> Column:
    """s_a and s_b without the steps of characters that are equal at both ends; over threshold characters are left of each."""
    n = F.least(F.length("s_a"), F.length("s_b"))
    equal = F.floor((n - threshold - 1) / step).cast("int")  # so many steps can be looked at, from both ends together
    coded = F.struct(F.encode("s_a", "UTF-32").alias("a"), F.encode("s_b", "UTF-32").alias("b"))

    def run(at) -> Column:
        same = lambda j: F.when(at("a", j) != at("b", j), 1)
        return F.when(equal < 1, F.lit(0)).otherwise(_once(F.array_position(F.transform(F.sequence(F.lit(1), F.greatest(equal, F.lit(1))), lambda j: F.coalesce(same(j), F.lit(0))), 1).cast("int"), lambda p: F.when(p == 0, equal).otherwise(p - 1)))

    def cut(c: Column) -> Column:
        before = run(lambda x, j: F.substring(c[x], (j - 1) * (4 * step) + 1, F.lit(4 * step)))
        after = run(lambda x, j: F.substring(c[x], F.octet_length(c[x]) - j * (4 * step) + 1, F.lit(4 * step)))
        core = lambda s, p, q: F.substring(s, step * p + 1, F.length(s) - step * (p + q))
        return _once(before, lambda p: _once(F.least(after, equal - p), lambda q: F.struct(core(F.col("s_a"), p, q).alias("a"), core(F.col("s_b"), p, q).alias("b"))))

    return _once(coded, cut)


def _near(pairs: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """The pairs that are links, with both hashes of both lines: a, a2, b, b2."""
    side = lambda x: texts.select(F.col("line_id").alias(x), F.col("line_id2").alias(f"{x}2"), F.col("s").alias(f"s_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    allowed = F.least(F.lit(threshold), F.floor(F.least(F.length("s_a"), F.length("s_b")) / EDIT_CHARS))
    both = both.where(F.abs(F.length("s_a") - F.length("s_b")) <= allowed)
    edits = _once(_cores(threshold), lambda c: _once(F.split(c["a"], ""), lambda x: _once(F.split(c["b"], ""), lambda y: edits_within(x, y, threshold))))
    return both.where(edits <= allowed).select("a", "a2", "b", "b2")


def link(docs: DataFrame, threshold: int = 4, crowd: int = 4096, depth: int = 3) -> DataFrame:
    """A row for each line with a word: doc_id, line_no, tag; its class of equal lines (class_doc_id and class_line_no of
    the first, n_copies), n_links (other distinct lines within the edits allowed: threshold, and one for each EDIT_CHARS
    characters of the shorter line) and removed (an equal or linked line comes first)."""
    every, ids = lines(docs), ["line_id", "line_id2"]
    place = F.struct(F.col("doc_id"), F.col("line_no"))
    near = common.stash(_near(*_candidates(every, threshold, crowd, depth), threshold), "near")
    classes = common.stash(every.groupBy(*ids).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n_copies")), "classes")
    sides = near.select(F.col("a").alias("line_id"), F.col("a2").alias("line_id2"), F.col("b").alias("peer"), F.col("b2").alias("peer2"))
    sides = sides.unionByName(near.select(F.col("b").alias("line_id"), F.col("b2").alias("line_id2"), F.col("a").alias("peer"), F.col("a2").alias("peer2")))
    firsts = classes.select(F.col("line_id").alias("peer"), F.col("line_id2").alias("peer2"), F.col("first").alias("peer_first"))
    links = sides.join(firsts, ["peer", "peer2"]).groupBy(*ids).agg(F.count(F.lit(1)).alias("n_links"), F.min("peer_first").alias("peer_first"))
    # Lines alone in their class and without links need no partner.
    known = classes.where("n_copies > 1").join(links, ids, "full_outer")
    out = every.select("doc_id", "tag", "line_no", *ids).join(known, ids, "left").withColumn("first", F.coalesce("first", place))
    removed = (place > F.col("first")) | F.coalesce(F.col("peer_first") < F.col("first"), F.lit(False))
    return out.select(
        "doc_id", "tag", F.col("line_no").cast("long").alias("line_no"), F.col("first.doc_id").alias("class_doc_id"), F.col("first.line_no").cast("long").alias("class_line_no"),
        F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), removed.alias("removed"),
    )


def drop_lines(docs: DataFrame, **options) -> DataFrame:
    """docs, with all columns, without the lines that an equal or linked line precedes. A document that loses all its
    words this way goes; one without any before stays."""
    gone = link(docs, **options).where("removed").groupBy(F.col("doc_id").alias("id"), "tag").agg(F.collect_set(F.col("line_no").cast("int")).alias("gone"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), common.text_tag().alias("tag"))
    joined = rows.alias("r").join(gone.alias("g"), F.col("r.id").eqNullSafe(F.col("g.id")) & (F.col("r.tag") == F.col("g.tag")), "left").select("row", "gone")
    pieces = F.split(F.col("row.text"), "\n")
    left = _once(pieces, lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("gone")), lambda i: F.get(x, i)), "\n"))
    out = joined.select("row", F.col("gone").isNull().alias("whole"), F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(left).alias("left"))
    out = out.where(F.col("whole") | F.col("left").rlike(WORDY))
    return out.select(*(F.col("left").alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))
