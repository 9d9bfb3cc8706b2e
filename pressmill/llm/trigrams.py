"""Boolean trigram queries that any match of a regular expression must satisfy.

A regex is parsed, and for every part of it these are worked out: the strings it
matches exactly, if they are few; what every match begins and ends with; and a
condition on the trigrams of the text.  Conditions are an OR of ANDs: a set of
sets of trigrams.  ``{frozenset()}`` asks for nothing.  Where a part would grow
too large, the condition is made weaker, never stronger, so no match is lost.

Texts are indexed with ASCII letters in lower case, so literals are lowered too.
Other letters have cases that differ between libraries: such a character counts
as any one.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as op
from re import _parser

#: Strings of an exact set, terms of a condition, characters of a begin or an end, of a class.
STRINGS, TERMS, ENDS, CLASS = 64, 64, 8, 8
Condition = frozenset[frozenset[str]]
ANYTHING: Condition = frozenset([frozenset()])


@dataclass(frozen=True)
class Part:
    exact: frozenset[str] | None
    begins: frozenset[str]
    ends: frozenset[str]
    needs: Condition

    @property
    def first(self) -> frozenset[str]:
        return self.begins if self.exact is None else self.exact

    @property
    def last(self) -> frozenset[str]:
        return self.ends if self.exact is None else self.exact

    @property
    def condition(self) -> Condition:
        return self.needs if self.exact is None else conjoin(self.needs, of_strings(self.exact))


def trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def absorbed(terms: Condition) -> Condition:
    """Without the terms that ask for more than another one does."""
    return frozenset(t for t in terms if not any(other < t for other in terms))


def of_strings(strings: frozenset[str]) -> Condition:
    return absorbed(frozenset(map(trigrams, strings)))


def conjoin(a: Condition, b: Condition) -> Condition:
    if len(a) * len(b) > TERMS:
        return min(a, b, key=len)  # one of the two alone: weaker
    return absorbed(frozenset(x | y for x in a for y in b))


def disjoin(a: Condition, b: Condition) -> Condition:
    found = absorbed(a | b)
    return found if len(found) <= TERMS else ANYTHING


def exactly(*strings: str) -> Part:
    found = frozenset(strings)
    return Part(found, found, found, ANYTHING)


UNKNOWN = Part(None, frozenset([""]), frozenset([""]), ANYTHING)


def _joined(a: frozenset[str], b: frozenset[str]) -> frozenset[str] | None:
    return frozenset(x + y for x in a for y in b) if len(a) * len(b) <= STRINGS else None


def concat(a: Part, b: Part) -> Part:
    if a.exact is not None and b.exact is not None and (both := _joined(a.exact, b.exact)) is not None:
        return Part(both, both, both, conjoin(a.needs, b.needs))
    needs, seam = conjoin(a.condition, b.condition), _joined(a.last, b.first)
    if seam is not None:
        needs = conjoin(needs, of_strings(seam))
    begins = _joined(a.exact, b.first) if a.exact is not None else None
    ends = _joined(a.last, b.exact) if b.exact is not None else None
    return Part(None, frozenset(x[:ENDS] for x in (begins or a.first)), frozenset(x[-ENDS:] for x in (ends or b.last)), needs)


def either(a: Part, b: Part) -> Part:
    if a.exact is not None and b.exact is not None and len(a.exact | b.exact) <= STRINGS and a.needs == b.needs == ANYTHING:
        return exactly(*(a.exact | b.exact))
    begins, ends = a.first | b.first, a.last | b.last
    if len(begins) > STRINGS or len(ends) > STRINGS:
        begins = ends = frozenset([""])
    return Part(None, begins, ends, disjoin(a.condition, b.condition))


def repeated(part: Part, least: int, most: int) -> Part:
    if most == 0:
        return exactly("")
    if least == 0:
        return either(exactly(""), part) if most == 1 else UNKNOWN
    whole = part
    for _ in range(min(least, 4) - 1):
        whole = concat(whole, part)
    if least == most and least <= 4:
        return whole
    return Part(None, whole.first, whole.last, whole.condition)


def _characters(items: list) -> set[str] | None:
    """The characters of a class in lower case; None: too many, or unknown."""
    found: set[str] = set()
    for code, value in items:
        if code is op.LITERAL:
            found.add(chr(value))
        elif code is op.RANGE and value[1] - value[0] < STRINGS:
            found |= set(map(chr, range(value[0], value[1] + 1)))
        else:
            return None
    lowered = {c.lower() for c in found if c.isascii()}
    return lowered if all(c.isascii() for c in found) and len(lowered) <= CLASS else None


def _sequence(items) -> Part:
    whole = exactly("")
    for code, value in items:
        whole = concat(whole, _one(code, value))
    return whole


def _one(code, value) -> Part:
    if code is op.LITERAL:
        return exactly(chr(value).lower()) if value < 128 else UNKNOWN
    if code is op.IN:
        found = _characters(value)
        return exactly(*found) if found else UNKNOWN
    if code is op.BRANCH:
        whole, *rest = map(_sequence, value[1])
        for part in rest:
            whole = either(whole, part)
        return whole
    if code is op.SUBPATTERN:
        return _sequence(value[3])
    if code is op.ATOMIC_GROUP:
        return _sequence(value)
    if code in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
        least, most, inner = value
        return repeated(_sequence(inner), least, most)
    if code in (op.AT, op.ASSERT, op.ASSERT_NOT):
        return exactly("")  # takes no characters
    return UNKNOWN


def query(regex: str) -> list[frozenset[str]]:
    """Alternatives: any text with a match has all trigrams of one of them.

    An empty list means that nothing can be asked for, and all texts must be searched.
    """
    found = _sequence(_parser.parse(regex)).condition
    return [] if frozenset() in found else sorted(found, key=sorted)
