"""Packing: sum-of-squares online packing of token sequences into windows.

Each partition is a stream of documents. A document's whole windows leave at once; what remains of it goes to the
fill level that makes the sum of the squared numbers of partially filled windows smallest, a level array holding
those numbers. At the end of the stream, or when max_open windows are open, the emptiest windows are cut to fill up
the others, so at most one window of a partition stays partial; it is cut at powers of two, which need no padding.
No document crosses a partition, so there is no shuffle, and a lost task packs its own rows again.

Edge cases: a null or empty text is its end token alone. Very long texts fill windows as they come. Repeated rows are
packed each. An empty table gives no rows; other columns are ignored. Which rows share a sequence depends on how the
input is split into partitions; sequence ids are unique over all partitions.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate, chain, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from inkfold.llm import common

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


#: So many texts of a batch are taken from Arrow at once.
TEXTS = 256
#: ASCII marks that form a token apart from the letters and digits before them; an apostrophe can start a suffix such as 's.
MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: One such mark at a word's end, cut off before words are looked up, so that fewer of them are new.
LAST_MARK = re.compile(rb"[.,;:!?](?<=[a-z0-9].)(?=[\x20\x09-\x0D]|\Z)")


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: itself if printable, else by rank from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordTokenizer:
    """Token ids of texts, by a cache of words.

    The tokenizer neither joins nor splits across white space, so a text's ids are those of its words in order. A word
    of lower-case letters is one piece, merged by rank; its end mark is held as the byte 255, which no UTF-8 text has.
    """

    def __init__(self, path: str, max_words: int = 300_000):
        import tiktoken
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        self.max_words = max_words
        byte, ranks = _byte_of(), {}
        for token, i in self.inner.get_vocab(with_added_tokens=False).items():
            stem = token.removesuffix("</w>")
            if all(c in byte for c in stem):
                ranks[bytes(byte[c] for c in stem) + b"\xff" * (stem != token)] = i
        ranks.setdefault(b"\xff", len(ranks) + (1 << 20))
        self.merge = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self._clear()

    def _clear(self) -> None:
        #: The number of each known word; its ids are flat[offsets[k] : offsets[k + 1]].
        self.places: dict[bytes, int] = {}
        self.offsets, self.flat = array("q", [0]), array("I")

    def _put(self, words: list[bytes], ids: list) -> None:
        first = len(self.places)
        self.places.update(zip(words, range(first, first + len(words))))
        self.offsets.extend(islice(accumulate(map(len, ids), initial=len(self.flat)), 1, None))
        self.flat.extend(chain.from_iterable(ids))

    def _get(self, word: bytes) -> array:
        k = self.places[word]
        return self.flat[self.offsets[k] : self.offsets[k + 1]]

    def _learn(self, words: set[bytes]) -> None:
        # Marks after a letter or digit are always a token apart, so such words come from their stems.
        tailed = {w: n for w in words if w[-1] in MARKS and 0 < (n := len(w.rstrip(MARKS))) and w[:n].decode()[-1].lower()[-1].isalnum() and b"<|" not in w}
        parts = {x for w, n in tailed.items() for x in (w[:n], w[n:])}
        new = [w for w in (words - tailed.keys()) | parts if w not in self.places]
        soft, hard = [], []
        for w in new:
            # bytes.isalpha knows ASCII letters only, and those are in lower case unless the text has special tokens.
            if w.isalpha() and w.islower() or (t := w.decode()).isalpha() and t == t.lower() and unicodedata.is_normalized("NFC", t):
                soft.append(w)
            else:
                hard.append(w)
        merge = self.merge
        self._put(soft, [merge(w + b"\xff") for w in soft])
        for at in range(0, len(hard), 4096):
            part = hard[at : at + 4096]
            self._put(part, [e.ids for e in self.inner.encode_batch_fast([x.decode() for x in part], add_special_tokens=False)])
        both = [w for w in tailed if w not in self.places]
        self._put(both, [self._get(w[: tailed[w]]) + self._get(w[tailed[w] :]) for w in both])

    def encode(self, text: bytes) -> np.ndarray:
        # The tokenizer lowers letters itself, but looks for its special tokens before that.
        words = LAST_MARK.sub(rb" \g<0>", text if b"<|" in text else text.lower()).split()
        if not words:
            return np.zeros(0, np.uint32)
        if len(self.places) > self.max_words:
            self._clear()
        places = self.places
        at = list(map(places.get, words))
        if None in at:
            missing = [i for i, k in enumerate(at) if k is None]
            self._learn({words[i] for i in missing})
            for i in missing:
                at[i] = places[words[i]]
        at, offsets = np.array(at), np.frombuffer(self.offsets, np.int64)
        starts, n = offsets[at], offsets[at + 1] - offsets[at]
        ends = np.cumsum(n)
        return np.frombuffer(self.flat, np.uint32)[np.repeat(starts - ends + n, n) + np.arange(ends[-1])]


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One for each Python worker, kept between tasks."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


class SumOfSquares:
    """Online packing of pieces (doc_id, start, ids, doc_tokens) into windows of `size`; closed windows are lists of pieces."""

    def __init__(self, size: int, max_open: int = 4096):
        self.size, self.max_open = size, max_open
        self.level = np.zeros(size + 1, np.int64)
        self.open: dict[int, list[list[tuple]]] = defaultdict(list)
        self.n_open = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[list[tuple]]:
        whole, total = len(ids) // self.size * self.size, len(ids)
        for at in range(0, whole, self.size):
            yield [(doc_id, at, ids[at : at + self.size], total)]
        if whole < total:
            yield from self._place((doc_id, whole, ids[whole:], total))

    def _place(self, piece: tuple) -> Iterator[list[tuple]]:
        n, size, level = len(piece[2]), self.size, self.level
        # The sum of squares grows by 2 N(h + n) + 1 where a window arrives and by 1 - 2 N(h) where one leaves; full ones don't count.
        gain = 2 * level[n : size + 1] + 1
        gain[size - n] = 0
        here = level[: size - n + 1]
        cost = np.where(here > 0, gain + 1 - 2 * here, np.iinfo(np.int64).max)
        cost[0] = gain[0]
        at = size - n - int(cost[::-1].argmin())
        window = self.open[at].pop() if at else []
        level[at] -= at > 0
        self.n_open += at == 0
        window.append(piece)
        if at + n == size:
            self.n_open -= 1
            yield window
            return
        self.open[at + n].append(window)
        level[at + n] += 1
        if self.n_open > self.max_open:
            rest = list(self._refill())
            yield from (x for x in rest if sum(len(p[2]) for p in x) == size)
            for x in rest:
                if (n := sum(len(p[2]) for p in x)) < size:
                    self.open[n].append(x)
                    self.level[n] += 1
                    self.n_open += 1

    def _refill(self) -> Iterator[list[tuple]]:
        """Cut the emptiest open windows to fill up the others; all windows but the last are full."""
        windows = [x for k in sorted(self.open, reverse=True) for x in self.open[k]]
        self.open.clear()
        self.level[:] = 0
        self.n_open = 0
        last = len(windows) - 1
        for i, window in enumerate(windows):
            if i > last:
                return
            gap = self.size - sum(len(p[2]) for p in window)
            while gap and last > i:
                doc_id, start, ids, total = windows[last].pop()
                if len(ids) > gap:
                    windows[last].append((doc_id, start, ids[:-gap], total))
                    start, ids = start + len(ids) - gap, ids[-gap:]
                window.append((doc_id, start, ids, total))
                gap -= len(ids)
                if not windows[last]:
                    last -= 1
            yield window

    def close(self) -> Iterator[list[tuple]]:
        for window in self._refill():
            room = 1 << (sum(len(p[2]) for p in window).bit_length() - 1)  # the largest power of two that can be filled
            part: list[tuple] = []
            left = sum(len(p[2]) for p in window)
            room = self.size if left == self.size else room
            for doc_id, start, ids, total in window:
                while len(ids):
                    part.append((doc_id, start, ids[:room], total))
                    taken = len(part[-1][2])
                    start, ids, room, left = start + taken, ids[taken:], room - taken, left - taken
                    if not room:
                        yield part
                        part, room = [], 1 << (left.bit_length() - 1) if left else 0


def _packer(path: str, size: int, end_id: int, max_open: int, emit_ids: bool):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, packer = tokenizer(path), SumOfSquares(size, max_open)
        sequence = TaskContext.get().partitionId() << 32
        rows: list[tuple] = []
        lists: list[np.ndarray] = []

        def put(window: list[tuple]) -> None:
            nonlocal sequence
            offset = 0
            for doc_id, start, ids, total in window:
                rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, sequence, offset))
                if emit_ids:
                    lists.append(ids.astype(np.int32))
                offset += len(ids)
            sequence += 1

        def take() -> pa.RecordBatch:
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if emit_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, lists)]), pa.int32()), pa.array(np.concatenate(lists))))
                names.append("ids")
            rows.clear()
            lists.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        # A batch may hold thousands of whole texts: few of them are Python's objects at once.
        for batch in (b.slice(at, TEXTS) for b in batches for at in range(0, b.num_rows, TEXTS)):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = np.append(words.encode(text.encode("utf-8", "replace")), np.uint32(end_id))
                for window in packer.add(doc_id, ids.astype(np.uint16 if ids.max() < 1 << 16 else np.uint32)):
                    put(window)
                if len(rows) >= 2000:
                    yield take()
        for window in packer.close():
            put(window)
            if len(rows) >= 2000:
                yield take()
        if rows:
            yield take()

    return pack


def pack(docs: DataFrame, tokenizer_path: str, size: int = 4096, end_id: int = 2, max_open: int = 4096, emit_ids: bool = True) -> DataFrame:
    """A row for each piece of a document: its place in the document (start, length, doc_tokens) and in a sequence (sequence_id, offset).

    ids holds the piece's token ids, and ids_crc32 their crc32 as little-endian unsigned 32-bit numbers; emit_ids=False
    leaves ids out. At most max_open windows of a task are open at a time, beyond that they are cut to fill one another.
    """
    return common.ids_and_texts(docs).mapInArrow(_packer(tokenizer_path, size, end_id, max_open, emit_ids), SCHEMA + ", ids array<int>" * emit_ids)
