"""Boolean trigram queries of regular expressions, for an index of lower-cased trigrams.

A query is True (nothing is mandatory), a trigram, ("and", [queries]) or ("or", [queries]). It holds for every
text that the expression matches. Runs while a plan is made, on the rules alone.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

MOST = 64  # strings kept of a part; beyond that a part counts as unknown
CLASS = 8  # characters of a class that are spelled out


@dataclass(frozen=True)
class Part:
    """exact: all strings that the part matches, or None. Else starts and ends: what its matches start and
    end with; need: the query that its matches meet."""

    exact: frozenset[str] | None
    starts: frozenset[str]
    ends: frozenset[str]
    need: object = True


NOTHING = frozenset([""])
ANY = Part(None, NOTHING, NOTHING)


def both(a, b):
    parts = [p for q in (a, b) if q is not True for p in (q[1] if isinstance(q, tuple) and q[0] == "and" else [q])]
    unique = list(dict.fromkeys(map(frozen, parts)))
    return True if not unique else unique[0] if len(unique) == 1 else ("and", unique)


def either(a, b):
    if a is True or b is True:
        return True
    parts = [p for q in (a, b) for p in (q[1] if isinstance(q, tuple) and q[0] == "or" else [q])]
    unique = absorbed(list(dict.fromkeys(map(frozen, parts))))
    return unique[0] if len(unique) == 1 else ("or", unique)


def absorbed(parts: list) -> list:
    """Without alternatives that ask for all that another one asks for, and more."""
    asked = [{q} if isinstance(q, str) else set(q[1]) if q[0] == "and" and all(isinstance(x, str) for x in q[1]) else None for q in parts]
    more = lambda a, i, b, j: a is not None and b is not None and (b < a or (b == a and j < i))
    return [q for i, (q, a) in enumerate(zip(parts, asked, strict=True)) if not any(more(a, i, b, j) for j, b in enumerate(asked))]


def frozen(q):
    return q if isinstance(q, str) else (q[0], tuple(q[1]))


def strings_need(strings: frozenset[str]):
    """The query of a text that holds one of the strings."""
    out = None
    for s in sorted(strings):
        own = True
        for i in range(len(s) - 2):
            own = both(own, s[i : i + 3])
        out = own if out is None else either(out, own)
    return True if out is None else out


def loose(p: Part) -> Part:
    """Without exact strings; their trigrams become a need."""
    if p.exact is None:
        return p
    return Part(None, frozenset(s[:2] for s in p.exact), frozenset(s[-2:] if s else s for s in p.exact), strings_need(p.exact))


def joined(a: Part, b: Part) -> Part:
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= MOST:
        s = frozenset(x + y for x, y in product(a.exact, b.exact))
        return Part(s, s, s)
    starts = frozenset(x + y for x, y in product(a.exact, b.exact or b.starts)) if a.exact is not None else a.starts
    ends = frozenset(x + y for x, y in product(a.exact or a.ends, b.exact)) if b.exact is not None else b.ends
    middle = frozenset(x + y for x, y in product(a.exact or a.ends, b.exact or b.starts))
    need = both(both(loose(a).need, loose(b).need), strings_need(middle) if len(middle) <= MOST else True)
    small = lambda s, f: frozenset(map(f, s)) if len(s) <= MOST else NOTHING
    need = both(need, strings_need(starts) if len(starts) <= MOST else True)
    need = both(need, strings_need(ends) if len(ends) <= MOST else True)
    return Part(None, small(starts, lambda s: s[:2]), small(ends, lambda s: s[-2:] if s else s), need)


def one_of(a: Part, b: Part) -> Part:
    if a.exact is not None and b.exact is not None and len(a.exact | b.exact) <= MOST:
        s = a.exact | b.exact
        return Part(s, s, s)
    a, b = loose(a), loose(b)
    return Part(None, a.starts | b.starts, a.ends | b.ends, either(a.need, b.need))


EMPTY = Part(NOTHING, NOTHING, NOTHING)
TIMES = re.compile(r"\{(\d+)(,?)(\d*)\}")
WORD_ESCAPES = "bBAZz"  # match between characters
CONTROLS = {"t": "\t", "n": "\n", "r": "\r", "f": "\f", "v": "\v"}


def strings(chars) -> Part:
    """One of these characters, lower-cased; unknown if they are many, or not ASCII."""
    low = frozenset(x.lower() for x in chars)
    return Part(low, low, low) if 0 < len(low) <= CLASS and all(x.isascii() for x in low) else ANY


class Reader:
    """Reads a regular expression from left to right. What it doesn't know counts as anything."""

    def __init__(self, regex: str):
        self.regex, self.at = regex, 0

    def peek(self) -> str:
        return self.regex[self.at : self.at + 1]

    def take(self, n: int = 1) -> str:
        self.at += n
        return self.regex[self.at - n : self.at]

    def alternatives(self) -> Part:
        out = self.sequence()
        while self.peek() == "|":
            self.take()
            out = one_of(out, self.sequence())
        return out

    def sequence(self) -> Part:
        out = EMPTY
        while self.peek() and self.peek() not in "|)":
            out = joined(out, self.repeated(self.one()))
        return out

    def repeated(self, own: Part) -> Part:
        while self.peek() and self.peek() in "*+?{":
            if self.peek() == "{":
                times = TIMES.match(self.regex, self.at)
                if not times:
                    return joined(own, self.one())
                self.at = times.end()
                low = int(times[1])
                high = (int(times[3]) if times[3] else None) if times[2] else low
            else:
                low, high = {"*": (0, None), "+": (1, None), "?": (0, 1)}[self.take()]
            if self.peek() and self.peek() in "?+":  # lazy and possessive ones match the same strings, or fewer
                self.take()
            own = self.times(own, low, high)
        return own

    @staticmethod
    def times(own: Part, low: int, high: int | None) -> Part:
        if (low, high) == (0, 1):
            return one_of(own, EMPTY)
        if high == 0:
            return EMPTY
        if low == 0:
            return ANY
        out = own
        for _ in range(min(low, 3) - 1):
            out = joined(out, own)
        if low == high and low <= 3:
            return out
        return Part(None, loose(out).starts, loose(own).ends, loose(out).need)  # more of the same may stand in between

    def one(self) -> Part:
        c = self.take()
        if c == "(":
            return self.group()
        if c == "[":
            return strings(self.members() or ())
        if c == "\\":
            if self.peek() and self.peek() in WORD_ESCAPES:
                self.take()
                return EMPTY
            x = self.escape()
            return ANY if x is None else strings(x)
        return EMPTY if c in "^$" else ANY if c == "." else strings(c)

    def group(self) -> Part:
        around = False
        if self.peek() == "?":
            self.take()
            kind = self.take()
            if kind in "=!" or (kind == "<" and self.peek() in ("=", "!")):
                around = True
                self.take(kind == "<")
            elif kind in "P<":
                self.at = self.regex.index(">", self.at) + 1
            elif kind not in ":>":  # flags, for all that follows or for a group
                while self.peek() not in (":", ")"):
                    self.take()
                if self.peek() == ":":
                    self.take()
        own = self.alternatives()
        self.take()
        return EMPTY if around else own

    def escape(self) -> str | None:
        """The character that an escape stands for, if it is one."""
        c = self.take()
        if c in "xu":
            return chr(int(self.take(2 if c == "x" else 4), 16))
        return CONTROLS.get(c) or (None if c.isalnum() else c)

    def members(self) -> set[str] | None:
        """The characters of a class, or None."""
        out: set[str] | None = set()
        if self.peek() == "^":
            self.take()
            out = None
        first = True
        while first or self.peek() != "]":
            first = False
            c = self.take()
            low = self.escape() if c == "\\" else c
            high = low
            if self.peek() == "-" and self.regex[self.at + 1 : self.at + 2] != "]":
                self.take()
                c = self.take()
                high = self.escape() if c == "\\" else c
            if out is not None:
                out = None if low is None or high is None or ord(high) - ord(low) >= 64 else out | set(map(chr, range(ord(low), ord(high) + 1)))
        self.take()
        return out


def query(regex: str):
    """The query of a regular expression in the syntax that Python and Java share."""
    return loose(Reader(regex).alternatives()).need


def trigrams(q) -> set[str]:
    return set() if q is True else {q} if isinstance(q, str) else set().union(*map(trigrams, q[1]))


def conjunctions(q) -> list[tuple[str, ...]]:
    """Sets of trigrams of which a text that the query holds for has all of one; a query of another form than alternatives of
    conjunctions counts as conjunctions of one trigram each."""
    parts = q[1] if isinstance(q, tuple) and q[0] == "or" else [q]
    out = []
    for p in parts:
        if isinstance(p, str):
            out.append((p,))
        elif p[0] == "and" and all(isinstance(x, str) for x in p[1]):
            out.append(tuple(p[1]))
        else:
            out += [(g,) for g in sorted(trigrams(p))]
    return out


#: Letters from the most frequent one of English texts on; any order gives right results.
FREQUENT = "etaoinshrdlcumwfgypbvkjxqz"


def rarest(conjunction: tuple[str, ...]) -> str:
    """The trigram of the rarest letters."""
    return max(conjunction, key=lambda g: (sum(FREQUENT.index(x) if x in FREQUENT else 0 if x == " " else 26 for x in g), g))


def holds(q, have: set[str]) -> bool:
    if q is True:
        return True
    if isinstance(q, str):
        return q in have
    return (all if q[0] == "and" else any)(holds(x, have) for x in q[1])
