"""Patterns of pack documents, which are written for Python, as patterns of the JVM, with what a match must hold.

A pattern is read as a tree and written again: Python's classes become explicit sets of characters (what Java calls a word
or a space differs), flags become groups, and anchors become what they mean in Python. A group named `value` is what a match is
about: the pattern is written as alternatives of what stands before it, the value, and what stands after it, each a group, so
that a replacement can mark the value alone. From the same tree comes a hint: the run of characters that tells most, and that
every match must hold.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from re import _parser  # the tree behind re.compile

#: Characters that stand around a match in a marked text.
OPEN, CLOSE = "\x01", "\x02"
#: What Python's \d, \s and \w match in texts, as members of a Java class.
DIGIT, WORD = r"\p{Nd}", r"\p{L}\p{N}_"
SPACE = r"\x09-\x0D\x1C-\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
ASCII = {"DIGIT": "0-9", "WORD": "A-Za-z0-9_", "SPACE": r"\x09-\x0D\x20"}
MANY = int(_parser.MAXREPEAT)
REPEATS = {"MAX_REPEAT": "", "MIN_REPEAT": "?", "POSSESSIVE_REPEAT": "+"}


@dataclass(frozen=True)
class Translated:
    """pattern and hint in Java's syntax; marked is the replacement that puts marks around what a match is about; gated is
    whether the pattern looks first at the character that a match can start with."""

    pattern: str
    hint: str
    marked: str
    gated: bool = False


@dataclass
class _Writer:
    """Writes trees, and numbers the groups that it opens; own has the new numbers of a pattern's own groups."""

    opened: int = 0
    own: dict[int, int] = field(default_factory=dict)

    def group(self, inside) -> tuple[int, str]:
        self.opened += 1
        n = self.opened
        return n, f"({inside(n)})"

    def sequence(self, items, flags: int) -> str:
        items, out = list(items), []
        for i, (op, av) in enumerate(items):
            if str(op) in REPEATS and _single(av[2]):
                kind = REPEATS[str(op)]
                if str(op) == "MAX_REPEAT" and int(av[1]) != av[0] and _apart(av[2][0], items[i + 1 : i + 2], flags):
                    kind = "+"  # what follows can't be one of the repeated, so nothing is gained by giving back
                out.append(self.item(str(av[2][0][0]), av[2][0][1], flags) + _times(av[0], int(av[1])) + kind)
            elif str(av) == "AT_BOUNDARY" and (_wordy(items[i + 1 : i + 2], 0, flags) or _wordy(items[max(0, i - 1) : i], -1, flags)):
                # One side is known to be a word's, so only the other one is looked at.
                word = f"[{_category('CATEGORY_WORD', flags)[0]}]"
                out.append(f"(?<!{word})" if _wordy(items[i + 1 : i + 2], 0, flags) else f"(?!{word})")
            else:
                out.append(self.item(str(op), av, flags))
        return "".join(out)

    def item(self, op: str, av, flags: int) -> str:
        if op in ("LITERAL", "NOT_LITERAL", "IN", "ANY"):
            return _character(op, av, flags)
        if op == "BRANCH":
            return "(?:" + "|".join(self.sequence(p, flags) for p in av[1]) + ")"
        if op == "SUBPATTERN":
            number, added, dropped, inside = av
            inner = (flags | added) & ~dropped

            def written(n: int | None = None) -> str:
                if n is not None:
                    self.own[number] = n
                return _scoped(self.sequence(inside, inner), flags, inner)

            return f"(?:{written()})" if number is None else self.group(written)[1]
        if op in REPEATS:
            return f"(?:{self.sequence(av[2], flags)}){_times(av[0], int(av[1]))}{REPEATS[op]}"
        if op == "ATOMIC_GROUP":
            return f"(?>{self.sequence(av, flags)})"
        if op in ("ASSERT", "ASSERT_NOT"):
            direction, inside = av
            return f"(?{'<' if direction < 0 else ''}{'=' if op == 'ASSERT' else '!'}{self.sequence(inside, flags)})"
        if op == "GROUPREF":
            if av not in self.own:
                raise ValueError("a reference to a group that is split around the value")
            return rf"(?:\{self.own[av]})"
        if op == "AT":
            return _anchor(str(av), flags)
        if op == "FAILURE":
            return "(?!)"
        raise ValueError(f"{op} has no counterpart")


def _times(low: int, high: int) -> str:
    if low == high:
        return "" if low == 1 else f"{{{low}}}"
    return {(0, MANY): "*", (1, MANY): "+", (0, 1): "?"}.get((low, high), f"{{{low},{'' if high == MANY else high}}}")


def _single(items) -> bool:
    """Whether the items are one character, written as one class."""
    if len(items) != 1 or str(items[0][0]) not in ("LITERAL", "NOT_LITERAL", "IN", "ANY"):
        return False
    return str(items[0][0]) != "IN" or not _character("IN", items[0][1], 0).startswith("(")


def _few(item, flags: int) -> set[str] | None:
    """The characters of a literal or a small class of ASCII, digits standing for all digits; None for others."""
    op, av = str(item[0]), item[1]
    if op not in ("LITERAL", "IN") or flags & re.I:
        return None
    out: set[str] = set()
    for kind, value in [(op, av)] if op == "LITERAL" else av:
        if str(kind) == "LITERAL" and value < 0x80:
            out.add(chr(value))
        elif str(kind) == "RANGE" and value[1] < 0x80:
            out.update(map(chr, range(value[0], value[1] + 1)))
        elif str(value) == "CATEGORY_DIGIT":
            out.update("0123456789")
        else:
            return None
    return out


def _apart(item, following, flags: int) -> bool:
    """Whether what follows is surely one character that the item isn't."""
    if not following:
        return False
    one, two = _few(item, flags), _few(following[0], flags)
    return one is not None and two is not None and not one & two


def _first(items, flags: int) -> str | None:
    """Members of a class that holds whatever a match of the items can start with; None where that isn't told, or a match may
    be empty."""
    for i, (op, av) in enumerate(items):
        name = str(op)
        if name in ("AT", "ASSERT", "ASSERT_NOT"):
            continue
        if name == "LITERAL":
            return _escaped(av)
        if name == "IN":
            inverse = str(av[0][0]) == "NEGATE"
            members, nested = _members(av, flags) if not inverse else ("", True)
            return None if nested else members
        if name == "SUBPATTERN":
            same = not (av[1] | av[2]) & re.I
            return _first([*av[3], *items[i + 1 :]], flags) if same else None
        if name == "BRANCH":
            each = [_first([*p, *items[i + 1 :]], flags) for p in av[1]]
            return None if None in each else "".join(dict.fromkeys(each))
        if name in ("MAX_REPEAT", "MIN_REPEAT"):
            inside, after = _first(av[2], flags), "" if av[0] else _first(items[i + 1 :], flags)
            return None if inside is None or after is None else inside + after
        return None
    return None


def _scoped(text: str, outer: int, inner: int) -> str:
    """text under the case flag of inner, where outer holds."""
    if (outer ^ inner) & re.I:
        return f"(?iu:{text})" if inner & re.I else f"(?-iu:{text})"
    return text


def _escaped(code: int) -> str:
    c = chr(code)
    if code > 0x7F and c.isprintable() or code < 0x80 and c.isalnum():
        return c
    return f"\\x{{{code:X}}}"


def _category(name: str, flags: int) -> tuple[str, bool]:
    """The members of a category, and whether it is what isn't among them."""
    kind = name.removeprefix("CATEGORY_")
    inverse, kind = kind.startswith("NOT_"), kind.removeprefix("NOT_")
    return (ASCII[kind] if flags & re.A else {"DIGIT": DIGIT, "WORD": WORD, "SPACE": SPACE}[kind]), inverse


def _members(items, flags: int) -> tuple[str, bool]:
    """The members of a class, and whether nested classes are among them."""
    out, nested = [], False
    for op, av in items:
        if str(op) == "RANGE":
            out.append(f"{_escaped(av[0])}-{_escaped(av[1])}")
        elif str(op) == "CATEGORY":
            members, inverse = _category(str(av), flags)
            nested |= inverse
            out.append(f"[^{members}]" if inverse else members)
        else:
            out.append(_escaped(av))
    return "".join(out), nested


def _character(op: str, av, flags: int) -> str:
    if op == "LITERAL":
        return _escaped(av)
    if op == "NOT_LITERAL":
        return f"[^{_escaped(av)}]"
    if op == "ANY":
        return r"[\x{0}-\x{10FFFF}]" if flags & re.S else r"[^\x{A}]"
    inverse = bool(av) and str(av[0][0]) == "NEGATE"
    members, nested = _members(av[inverse:], flags)
    if inverse and nested:
        return rf"(?![{members}])[\x{{0}}-\x{{10FFFF}}]"
    return f"[{'^' if inverse else ''}{members}]"


def _anchor(name: str, flags: int) -> str:
    word = f"[{_category('CATEGORY_WORD', flags)[0]}]"
    if name == "AT_BEGINNING":
        return r"(?<![^\x{A}])" if flags & re.M else r"\A"
    if name == "AT_END":
        return r"(?![^\x{A}])" if flags & re.M else r"(?=\x{A}?\z)"
    return {
        "AT_BEGINNING_STRING": r"\A",
        "AT_END_STRING": r"\z",
        "AT_BOUNDARY": f"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))",
        "AT_NON_BOUNDARY": f"(?:(?<={word})(?={word})|(?<!{word})(?!{word}))",
    }[name]


def _wordy(items, side: int, flags: int) -> bool:
    """Whether the items' first (side 0) or last (-1) character is surely a word's."""
    if not items:
        return False
    op, av = items[side]
    name = str(op)
    word = lambda code: chr(code).isalnum() and (code < 0x80 or not flags & re.A) or chr(code) == "_"
    if name == "LITERAL":
        return word(av)
    if name == "IN":
        ranges = lambda a, b: b - a < 64 and all(word(c) for c in range(a, b + 1))
        return all(str(k) == "LITERAL" and word(v) or str(k) == "RANGE" and ranges(*v) or str(v) in ("CATEGORY_DIGIT", "CATEGORY_WORD") for k, v in av)
    if name == "SUBPATTERN":
        return _wordy(av[3], side, flags)
    if name == "BRANCH":
        return all(_wordy(p, side, flags) for p in av[1])
    return name in REPEATS and av[0] > 0 and _wordy(av[2], side, flags)


# What stands before the value, the value, and what stands after it.


def _holds(items, number: int) -> bool:
    """Whether the group of that number is among the items or in them."""
    for op, av in items:
        name = str(op)
        if name == "SUBPATTERN" and (av[0] == number or _holds(av[3], number)):
            return True
        if name == "BRANCH" and any(_holds(p, number) for p in av[1]) or name == "ATOMIC_GROUP" and _holds(av, number):
            return True
        if (name in REPEATS or name in ("ASSERT", "ASSERT_NOT")) and _holds(av[-1], number):
            return True
    return False


def _width(items) -> tuple[int, int]:
    low, high = 0, 0
    for op, av in items:
        name = str(op)
        if name in ("LITERAL", "NOT_LITERAL", "IN", "ANY"):
            a, b = 1, 1
        elif name == "BRANCH":
            each = [_width(p) for p in av[1]]
            a, b = min(w[0] for w in each), max(w[1] for w in each)
        elif name == "SUBPATTERN":
            a, b = _width(av[3])
        elif name == "ATOMIC_GROUP":
            a, b = _width(av)
        elif name in REPEATS:
            a, b = _width(av[2])
            a, b = a * av[0], b * int(av[1])
        elif name in ("GROUPREF", "GROUPREF_EXISTS"):
            a, b = 0, MANY
        else:
            a, b = 0, 0
        low, high = low + a, min(high + b, MANY)
    return low, high


def _around(items: list, number: int) -> list[tuple]:
    """The items as choices, in order, of (before, value, after), or (before,) where the value takes no part."""
    if not _holds(items, number):
        return [(items,)]
    k = next(i for i, x in enumerate(items) if _holds([x], number))
    (op, av), before, after = items[k], items[:k], items[k + 1 :]
    name = str(op)
    if name == "SUBPATTERN":
        own, added, dropped, inside = av
        if own == number:
            return [(before, [(op, (None, added, dropped, inside))], after)]
        wrap = (lambda x: [(op, (None, added, dropped, x))] if x else []) if added or dropped else (lambda x: x)
        choices = [tuple(map(wrap, c)) for c in _around(list(inside), number)]
    elif name == "BRANCH":
        choices = [c for p in av[1] for c in _around(list(p), number)]
    elif name in ("MAX_REPEAT", "MIN_REPEAT") and (av[0], int(av[1])) in ((0, 1), (1, 1)):
        choices = _around(list(av[2]), number)
        if av[0] == 0:
            choices = choices + [([],)] if name == "MAX_REPEAT" else [([],), *choices]
    else:
        raise ValueError(f"a value inside {name.lower()}")
    low, high = _width(before)
    if len(choices) > 1 and low != high:
        raise ValueError("a value in a choice after a part of variable length")
    return [(before + c[0], c[1], c[2] + after) if len(c) == 3 else (before + c[0] + after,) for c in choices]


def _marked(items: list, number: int, flags: int) -> tuple[str, str]:
    writer, choices, marks = _Writer(), [], ([], [], [])
    for choice in _around(items, number):
        writer.own = {}
        text = ""
        for part, into in zip(choice if len(choice) == 3 else ([], *choice, []), marks):
            if part or into is marks[1]:

                def written(n: int, part=part, value=into is marks[1] and len(choice) == 3) -> str:
                    if value:
                        writer.own[number] = n
                    return writer.sequence(part, flags)

                n, piece = writer.group(written)
                into.append(n)
                text += piece
        choices.append(text)
    before, value, after = ("".join(f"${n}" for n in m) for m in marks)
    return "|".join(choices), f"{before}{OPEN}{value}{CLOSE}{after}"


# Hints.


#: The characters that texts are full of tell least.
COMMON = frozenset("abcdefghijklmnopqrstuvwxyz ")


def _bits(op: str, av, flags: int) -> float:
    """How much a character tells: seven bits if it can be one character only, fewer for sets and common characters."""
    if op not in ("LITERAL", "IN"):
        return 0.0
    members: set[str] = set()
    for kind, value in [(op, av)] if op == "LITERAL" else av:
        if str(kind) == "LITERAL":
            members.add(chr(value))
        elif str(kind) == "RANGE":
            members.update(map(chr, range(value[0], min(value[1], value[0] + 127) + 1)))
        elif str(kind) == "CATEGORY" and str(value) in ("CATEGORY_DIGIT", "CATEGORY_SPACE"):
            members.update("0123456789" if str(value) == "CATEGORY_DIGIT" else " ")
        else:  # what isn't in a set, and any letter, is nearly anything
            return 0.0
    weight = sum(8 if c in COMMON or flags & re.I and c.lower() in COMMON else 1 for c in members)
    return max(0.0, 7 - math.log2(weight))


def _hints(items, flags: int) -> list[tuple[float, str]]:
    """Hints of a sequence, with how much they tell: a match holds each of them."""
    found: list[tuple[float, str]] = []
    run: list[tuple[float, str]] = []

    def end() -> None:
        while run and not run[-1][0]:
            run.pop()
        while run and not run[0][0]:
            run.pop(0)
        if run:
            found.append((sum(b for b, _ in run), "".join(t for _, t in run)))
        run.clear()

    def walk(items) -> None:
        for op, av in items:
            name = str(op)
            if name in ("LITERAL", "NOT_LITERAL", "IN", "ANY"):
                run.append((_bits(name, av, flags), _character(name, av, flags)))
            elif name == "SUBPATTERN" and not av[1] and not av[2]:
                walk(av[3])
            elif name == "SUBPATTERN":
                end()
                inner = (flags | av[1]) & ~av[2]
                found.extend((b, _scoped(t, flags, inner)) for b, t in _hints(av[3], inner))
            elif name == "ATOMIC_GROUP":
                walk(av)
            elif name == "BRANCH":
                end()
                each = [max(_hints(p, flags), default=None) for p in av[1]]
                if all(each):
                    found.append((min(b for b, _ in each) - math.log2(len(each)), "(?:" + "|".join(dict.fromkeys(t for _, t in each)) + ")"))
            elif name in REPEATS:
                low, high, inside = av
                single = len(inside) == 1 and str(inside[0][0]) in ("LITERAL", "NOT_LITERAL", "IN", "ANY")
                if low and single:
                    kind, value = str(inside[0][0]), inside[0][1]
                    text = _character(kind, value, flags)
                    run.append((low * _bits(kind, value, flags), text if low == 1 else f"{text}{{{low}}}"))
                    if int(high) != low:
                        end()
                        run.append((_bits(kind, value, flags), text))  # the last one stands before what follows
                elif low and int(high) == low == 1:
                    walk(inside)
                else:
                    end()
                    if low:
                        found.extend(_hints(inside, flags))
            elif name == "GROUPREF":
                end()
            # What has no width leaves its neighbours next to each other.

    walk(items)
    end()
    return found


def translated(pattern: str, flags: int = 0) -> Translated:
    """A pattern for Python with its flags; ValueError or re.error where it has no counterpart."""
    tree = _parser.parse(pattern, flags)
    flags = tree.state.flags
    items = list(tree)
    value = tree.state.groupdict.get("value")
    if value is None:
        body, marked = _Writer().sequence(items, flags), f"{OPEN}$0{CLOSE}"
    else:
        body, marked = _marked(items, value, flags)
    fold = "(?iu)" if flags & re.I else ""
    # Most places of a text are passed by on their first character.
    first = _first(items, flags)
    gated = first is not None and "a-z" not in first
    if gated:
        body = f"(?=[{first}])(?:{body})"
    told, hint = max(_hints(items, flags), default=(0.0, ""))
    return Translated(fold + body, fold + hint if told >= 3 else "", marked, gated)
