"""Patterns written for Python as patterns of RE2, which looks at a batch of texts at once and in time linear in its length.

RE2 knows words of ASCII only and looks neither ahead nor behind. So it is shown a shadow of a text, with one byte for each
code point: letters and digits beyond ASCII are a word's character there, and all else beyond ASCII is a control character. A
pattern that tells such characters apart (its own text isn't ASCII, or it holds an underscore) runs over the text itself; its word
boundaries are then right where no letter beyond ASCII stands next to what they can stand at, which the caller sees to. Patterns of
any other kind have no such form, and Python's `re` runs them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _parser  # the tree behind re.compile

import pyarrow as pa
import pyarrow.compute as pc

from inkfold.functions.patterns import CLOSE, MANY, OPEN, _holds, _width

#: What letters and digits beyond ASCII are in a shadow, and what else is.
WORD, OTHER = ord("_"), 0x1A
WORDS = frozenset("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz")
SPACE, NO_SPACE = r"\x{9}-\x{D}\x{1C}-\x{20}", r"\x{0}-\x{8}\x{E}-\x{1B}\x{21}-"


@dataclass(frozen=True)
class Linear:
    """A pattern in RE2's syntax and the replacement that marks what its matches are about; over the shadow or the text itself.
    edges: the ASCII characters that its word boundaries stand at; loose: the pattern without boundaries. Both are for texts."""

    pattern: str
    marked: str
    shadow: bool
    edges: frozenset[str] = frozenset()
    loose: str = ""


def _codes(items):
    """The characters that the items name, as ranges."""
    for op, av in items:
        name = str(op)
        if name in ("LITERAL", "NOT_LITERAL"):
            yield av, av
        elif name == "RANGE":
            yield av
        elif name == "IN":
            yield from _codes(av)
        elif name == "BRANCH":
            for p in av[1]:
                yield from _codes(p)
        elif name == "SUBPATTERN":
            yield from _codes(av[3])
        elif name.endswith("_REPEAT"):
            yield from _codes(av[2])


def _edge(item) -> frozenset[str] | None:
    """The ASCII characters that an item can start or end with, where it is one character or a repeated one; None for others."""
    op, av = str(item[0]), item[1]
    if op in ("MAX_REPEAT", "MIN_REPEAT") and av[0] and len(av[2]) == 1:
        return _edge(av[2][0])
    if op == "SUBPATTERN" and len(av[3]) == 1:
        return _edge(av[3][0])
    out: set[str] = set()
    for kind, value in [(op, av)] if op == "LITERAL" else av if op == "IN" else [("NOTHING", None)]:
        if str(kind) in ("LITERAL", "RANGE"):
            a, b = (value, value) if str(kind) == "LITERAL" else value
            if b > 0x7F:
                return None
            out.update(map(chr, range(a, b + 1)))
        elif str(value) == "CATEGORY_DIGIT":
            out.update("0123456789")
        else:
            return None
    return frozenset(out | {c.swapcase() for c in out})


class _Writer:
    def __init__(self, shadow: bool, flags: int, bounded: bool = True):
        self.shadow, self.flags, self.bounded = shadow, flags, bounded
        self.edges: set[str] = set()

    def sequence(self, items) -> str:
        return "".join(self.pieces(items))

    def pieces(self, items) -> list[str]:
        items, out = list(items), []
        for i, (op, av) in enumerate(items):
            if str(av) == "AT_BOUNDARY":
                out.append(self.boundary(items[i - 1 : i] if i else [], items[i + 1 : i + 2]))
            else:
                out.append(self.item(str(op), av))
        return out

    def boundary(self, before, after) -> str:
        if not self.bounded:
            return ""
        if not self.shadow:
            sides = [e for e in (_edge(x) for x in (*before, *after)) if e]
            if not sides:
                raise ValueError("a boundary at unknown characters")
            self.edges |= next((e for e in sides if e <= WORDS), sides[0])
        return r"\b"

    def item(self, op: str, av) -> str:
        if op == "LITERAL":
            return self.escaped(av)
        if op == "NOT_LITERAL":
            return f"[^{self.escaped(av)}]"
        if op == "ANY":
            return "(?s:.)" if self.flags & re.S else r"[^\n]"
        if op == "IN":
            inverse = str(av[0][0]) == "NEGATE"
            return f"[{'^' if inverse else ''}{''.join(self.member(str(k), v) for k, v in av[inverse:])}]"
        if op == "BRANCH":
            return "(?:" + "|".join(self.sequence(p) for p in av[1]) + ")"
        if op == "SUBPATTERN" and not av[1] and not av[2]:
            return f"(?:{self.sequence(av[3])})"
        if op in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high = av[0], int(av[1])
            if not _width(av[2])[0] and high > 1:
                raise ValueError("repeated nothing")
            times = {(0, MANY): "*", (1, MANY): "+", (0, 1): "?"}.get((low, high)) or f"{{{low},{'' if high == MANY else high}}}"
            return f"(?:{self.sequence(av[2])}){times}{'?' if op == 'MIN_REPEAT' else ''}"
        if op == "AT" and str(av) in ("AT_BEGINNING", "AT_BEGINNING_STRING") and not self.flags & re.M:
            return r"\A"
        raise ValueError(f"{op} has no counterpart")

    def escaped(self, code: int) -> str:
        # Of letters beyond ASCII only those with one other case are compared without regard to case.
        if code > 0x7F and self.flags & re.I and chr(code).lower() != chr(code).upper() and not 0x400 <= code < 0x460:
            raise ValueError("a letter with cases of its own")
        return chr(code) if code < 0x80 and chr(code).isalnum() else f"\\x{{{code:X}}}"

    def member(self, kind: str, value) -> str:
        if kind == "LITERAL":
            return self.escaped(value)
        if kind == "RANGE":
            if value[1] > 0x7F and self.flags & re.I:
                raise ValueError("a range of letters with cases")
            return f"\\x{{{value[0]:X}}}-\\x{{{value[1]:X}}}"
        name = str(value).removeprefix("CATEGORY_")
        if not self.shadow and name.endswith("WORD"):
            raise ValueError("a word's characters in a text")
        return {"DIGIT": "0-9", "NOT_DIGIT": r"\D", "SPACE": SPACE, "NOT_SPACE": NO_SPACE + (r"\x{FF}" if self.shadow else r"\x{10FFFF}"), "WORD": "0-9A-Za-z_", "NOT_WORD": r"\W"}[name]


def _written(items, number: int | None, writer: _Writer) -> tuple[str, str]:
    if number is None:
        return writer.sequence(items), f"{OPEN}\\0{CLOSE}"
    k = next((i for i, (op, av) in enumerate(items) if str(op) == "SUBPATTERN" and av[0] == number), None)
    if k is None or _holds(items[k][1][3], number) or not _width(items[k : k + 1])[0]:
        raise ValueError("a value in another group, or one that may be empty")
    pieces = writer.pieces(items)
    return f"({''.join(pieces[:k])})({pieces[k]})({''.join(pieces[k + 1 :])})", f"\\1{OPEN}\\2{CLOSE}\\3"


def linear(pattern: str, flags: int = 0) -> Linear | None:
    """A pattern for Python with its flags in RE2's form; None where it has none."""
    tree = _parser.parse(pattern, flags)
    flags, items, number = tree.state.flags, list(tree), tree.state.groupdict.get("value")
    if flags & (re.A | re.L) or not _width(items)[0]:
        return None
    shadow = all(b < 0x80 and not a <= WORD <= b and not a <= OTHER <= b for a, b in _codes(items))
    try:
        writer = _Writer(shadow, flags)
        body, marked = _written(items, number, writer)
        loose = "" if shadow else _written(items, number, _Writer(False, flags, False))[0]
        fold = "(?i)" if flags & re.I else ""
        pc.replace_substring_regex(pa.array([b""] if shadow else [""]), pattern=fold + body, replacement=marked)
    except (ValueError, KeyError, pa.ArrowInvalid):
        return None
    return Linear(fold + body, marked, shadow, frozenset(writer.edges), fold + loose)
