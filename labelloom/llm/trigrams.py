"""Boolean trigram queries derived from regular expressions.

A pattern is read into literals, classes, groups, choices and repeats. Parts that match only a few
strings are kept as those strings and multiplied along a sequence; where that ends, the strings' trigrams
become a condition: one of the strings must occur, so all trigrams of one of them. Conditions along a
sequence are joined by *and*, those of choices by *or*. What can be left out, or is shorter than three
characters, sets no condition. All is in lower case.
"""

from __future__ import annotations

from dataclasses import dataclass

#: Strings that a part may stand for and still be kept as strings; alternatives of a query.
STRINGS, ALTERNATIVES = 64, 64

#: Alternatives, each a set of trigrams that must all occur; an empty one sets no condition.
Query = frozenset[frozenset[str]]
ANYTHING: Query = frozenset([frozenset()])

# What the escapes of the supported syntax stand for.
CONTROL = {"t": "\t", "n": "\n", "r": "\r", "f": "\f"}
CLASSES = "dDsSwWvVhHR"
BORDERS = "bBAzZG"


@dataclass(frozen=True)
class Part:
    """What a piece of a pattern matches: its strings, if they are few, and the condition it sets beyond them."""

    strings: frozenset[str] | None
    query: Query = ANYTHING


EMPTY = Part(frozenset([""]))
UNKNOWN = Part(None)


def simplest(query: Query) -> Query:
    """Without alternatives that hold a weaker one; no condition rather than too many alternatives."""
    kept = frozenset(a for a in query if not any(b < a for b in query))
    return kept if len(kept) <= ALTERNATIVES else ANYTHING


def both(a: Query, b: Query) -> Query:
    return simplest(frozenset(x | y for x in a for y in b)) if len(a) * len(b) <= ALTERNATIVES**2 else a


def either(a: Query, b: Query) -> Query:
    return simplest(a | b)


def condition(part: Part) -> Query:
    """What a match of the part must hold."""
    if part.strings is None:
        return part.query
    return both(part.query, simplest(frozenset(frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in part.strings)))


def sequence(parts: list[Part]) -> Part:
    """Parts one after the other."""
    held, query, whole = frozenset([""]), ANYTHING, True
    for p in parts:
        query = both(query, p.query)
        if p.strings is not None and len(held) * len(p.strings) <= STRINGS:
            held = frozenset(a + b for a in held for b in p.strings)
            continue
        query, whole = both(query, condition(Part(held))), False
        held = p.strings if p.strings is not None else frozenset([""])
    return Part(held, query) if whole else Part(None, both(query, condition(Part(held))))


def choice(parts: list[Part]) -> Part:
    """Any one of the parts."""
    strings = frozenset().union(*(p.strings or () for p in parts))
    if all(p.strings is not None and p.query == ANYTHING for p in parts) and len(strings) <= STRINGS:
        return Part(strings)
    query = condition(parts[0])
    for p in parts[1:]:
        query = either(query, condition(p))
    return Part(None, query)


def repeated(part: Part, least: int, most: int | None) -> Part:
    """A part ``least`` to ``most`` times."""
    if least == 0:
        return choice([EMPTY, part]) if most == 1 else UNKNOWN
    # A string beyond a few copies is told by those as well.
    again = [part] * min(least, 4)
    return sequence(again if most == least == len(again) else [*again, UNKNOWN])


class Reader:
    """Recursive descent over a pattern; flags and captures do not matter in lower case."""

    def __init__(self, pattern: str):
        self.pattern, self.at = pattern, 0

    def read(self) -> Part:
        found = self.choices()
        if self.at < len(self.pattern):
            raise ValueError(f"unbalanced pattern: {self.pattern}")
        return found

    def next(self, text: str) -> bool:
        if self.pattern.startswith(text, self.at):
            self.at += len(text)
            return True
        return False

    def choices(self) -> Part:
        found = [self.run()]
        while self.next("|"):
            found.append(self.run())
        return choice(found) if len(found) > 1 else found[0]

    def run(self) -> Part:
        found = []
        while self.at < len(self.pattern) and self.pattern[self.at] not in "|)":
            found.append(self.repeat(self.atom()))
        return sequence(found)

    def repeat(self, part: Part) -> Part:
        bounds = next((b for mark, b in (("*", (0, None)), ("+", (1, None)), ("?", (0, 1))) if self.next(mark)), None)
        if bounds is None and self.next("{"):
            end = self.pattern.index("}", self.at)
            low, comma, high = self.pattern[self.at:end].partition(",")
            self.at = end + 1
            bounds = int(low), (int(high) if high else None) if comma else int(low)
        if bounds is None:
            return part
        if self.pattern[self.at:self.at + 1] in ("?", "+"):  # reluctant, possessive
            self.at += 1
        return self.repeat(repeated(part, *bounds))

    def atom(self) -> Part:
        c = self.pattern[self.at]
        self.at += 1
        if c == "(":
            return self.group()
        if c == "[":
            return self.bracket()
        if c == "\\":
            return self.escape()
        if c == ".":
            return UNKNOWN
        return EMPTY if c in "^$" else self.literal(c)

    @staticmethod
    def literal(c: str) -> Part:
        """One character; beyond ASCII, case is not a matter of one character."""
        return Part(frozenset([c.lower()])) if c.isascii() else UNKNOWN

    def group(self) -> Part:
        silent = self.next("?=") or self.next("?!") or self.next("?<=") or self.next("?<!")
        if not silent and self.next("?"):
            if self.next("<"):
                self.at = self.pattern.index(">", self.at) + 1
            else:
                while self.pattern[self.at] not in ":>)":
                    self.at += 1
                if self.next(")"):
                    return EMPTY
                self.at += 1
        found = self.choices()
        if not self.next(")"):
            raise ValueError(f"unbalanced pattern: {self.pattern}")
        return EMPTY if silent else found

    def escape(self) -> Part:
        c = self.pattern[self.at]
        self.at += 1
        if c in BORDERS:
            return EMPTY
        if c == "x":
            self.at += 2
            return self.literal(chr(int(self.pattern[self.at - 2:self.at], 16)))
        if c in "pP":
            self.at = self.pattern.index("}", self.at) + 1
            return UNKNOWN
        if c in CLASSES or c.isdigit():
            return UNKNOWN
        if c.isalpha() and c not in CONTROL:
            raise ValueError(f"escape \\{c} is not supported: {self.pattern}")
        return self.literal(CONTROL.get(c, c))

    def bracket(self) -> Part:
        """A class as its characters, if it is a plain list of few."""
        members, plain = set(), not self.next("^")
        first = True
        while first or self.pattern[self.at] != "]":
            first = False
            c = self.pattern[self.at]
            self.at += 1
            if c in "[&":
                plain = plain and c == "&" and self.pattern[self.at] != "&"
                members.add(c)
                continue
            one = self.escape() if c == "\\" else self.literal(c)
            if self.pattern[self.at] == "-" and self.pattern[self.at + 1] != "]":
                self.at += 1
                c = self.pattern[self.at]
                self.at += 1
                last = self.escape() if c == "\\" else self.literal(c)
                plain = False if one.strings is None or last.strings is None else plain
                if plain:
                    low, high = (ord(next(iter(p.strings))) for p in (one, last))
                    members |= {chr(x) for x in range(low, high + 1)} if high - low < STRINGS else set()
                    plain = high - low < STRINGS and low <= high
                continue
            plain = plain and one.strings is not None and one.strings != {""}
            members |= one.strings or set()
        self.at += 1
        return Part(frozenset(members)) if plain and len(members) <= 8 else UNKNOWN


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Alternatives of trigrams, in lower case, one of which every match holds; empty without a condition."""
    found = condition(Reader(pattern).read())
    return [] if frozenset() in found else sorted(found, key=sorted)
