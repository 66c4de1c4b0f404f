"""Boolean trigram queries of regular expressions.

``trigram_query(regex)`` tells which trigrams every match of an expression must hold, as
alternatives: a list of trigram lists, of which each match holds one list in full. It is read off
the expression's parse tree, from the inside out. Of a part of the expression one knows

* ``whole``: all texts it can be, where these are few; or else
* ``head`` and ``tail``: texts of which one begins, and of which one ends, each of its matches; and
* ``need``: alternatives that its matches hold besides.

Two parts in a row join the left one's tails to the right one's heads, so trigrams that span parts
are found; branches unite their alternatives; a repetition with a least count is that many parts in
a row and something unknown. Where texts or alternatives get too many, they are replaced by fewer
trigrams that still hold for each, so the answer may ask for less than it could, but never for more
than a match has. An empty list means that nothing is mandatory: the rule scans fully.

Texts are compared with A-Z lower-cased, whether the expression does so or not. Expressions are the
JVM's; one that Python's parser doesn't read, or might read in another way (set operations in
brackets, Unicode case folding, comment mode, ``\\v``, octal numbers), has no mandatory trigrams.
"""

from __future__ import annotations

import re
import re._constants as op
import re._parser as parser
import warnings
from dataclasses import dataclass

#: Texts that a part may be before they are replaced by what they begin and end with.
MOST_TEXTS = 64
#: Characters of a bracket that are told apart; a larger one is any character.
MOST_CHARS = 8
#: Alternatives of a query before they are replaced by what they have in common.
MOST_ALTERNATIVES = 64
#: Copies of a repeated part that are looked at in a row.
MOST_COPIES = 3

Query = frozenset[frozenset[str]]
#: The query that every text meets.
ANYTHING: Query = frozenset([frozenset()])


def fold(text: str) -> str:
    """A-Z lower-cased, all else as it is."""
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _fewest(alternatives) -> Query:
    """Alternatives without those that ask for more than another; if too many, what all have in common."""
    kept: list[frozenset[str]] = []
    for a in sorted(set(alternatives), key=len):
        if not any(k <= a for k in kept):
            kept.append(a)
    return frozenset(kept) if len(kept) <= MOST_ALTERNATIVES else frozenset([frozenset.intersection(*kept)])


def _both(a: Query, b: Query) -> Query:
    if len(a) * len(b) > MOST_ALTERNATIVES**2:
        return max(a, b, key=lambda q: min(map(len, q)))
    return _fewest(x | y for x in a for y in b)


def _any_of(texts) -> Query:
    return _fewest(map(trigrams, texts))


@dataclass(frozen=True)
class Part:
    whole: frozenset[str] | None
    head: frozenset[str]
    tail: frozenset[str]
    need: Query = ANYTHING

    @staticmethod
    def of(texts) -> Part:
        texts = frozenset(texts)
        return Part(texts, texts, texts)


EMPTY = Part.of([""])
UNKNOWN = Part(None, frozenset([""]), frozenset([""]))


def _then(a: Part, b: Part) -> Part:
    if a.whole is not None and b.whole is not None and len(a.whole) * len(b.whole) <= MOST_TEXTS:
        return Part.of(x + y for x in a.whole for y in b.whole)
    need = _both(_both(a.need, b.need), _both(_any_of(a.tail), _any_of(b.head)))
    ends, begins = {t[-2:] for t in a.tail}, {t[:2] for t in b.head}
    if len(ends) * len(begins) <= MOST_TEXTS:
        need = _both(need, _any_of(x + y for x in ends for y in begins))
    head = {x + y[:2] for x in a.whole for y in b.head} if a.whole is not None else a.head
    tail = {x[-2:] + y for x in a.tail for y in b.whole} if b.whole is not None else b.tail
    if len(head) > MOST_TEXTS:
        head = a.head
    if len(tail) > MOST_TEXTS:
        tail = b.tail
    return Part(None, frozenset(head), frozenset(tail), need)


def _either(parts: list[Part]) -> Part:
    if all(p.whole is not None for p in parts):
        texts = frozenset().union(*(p.whole for p in parts))
        if len(texts) <= MOST_TEXTS:
            return Part.of(texts)
    heads, tails = (frozenset().union(*x) for x in zip(*((p.head, p.tail) for p in parts), strict=True))
    unsure = frozenset([""])
    need = _fewest(x for p in parts for x in _needed(p))
    return Part(None, heads if len(heads) <= MOST_TEXTS else unsure, tails if len(tails) <= MOST_TEXTS else unsure, need)


def _repeated(part: Part, least: int, most: int) -> Part:
    out = EMPTY
    for _ in range(min(least, MOST_COPIES)):
        out = _then(out, part)
    if most <= MOST_COPIES and part.whole is not None:  # a few more or less: told one by one
        ways = [out]
        for _ in range(most - least):
            ways.append(_then(ways[-1], part))
        return _either(ways)
    if least > MOST_COPIES:  # the copies between those looked at
        return _then(_then(out, UNKNOWN), part)
    if most == least:
        return out
    return _then(_then(out, UNKNOWN), part) if least else UNKNOWN


def _bracket(items) -> Part:
    chars: set[str] = set()
    for kind, value in items:
        if kind is op.LITERAL:
            chars.add(fold(chr(value)))
        elif kind is op.RANGE and value[1] - value[0] < 256:
            chars.update(fold(chr(c)) for c in range(value[0], value[1] + 1))
        else:  # a class, all but some, or many
            return UNKNOWN
    return Part.of(chars) if len(chars) <= MOST_CHARS else UNKNOWN


def _part(tree) -> Part:
    out = EMPTY
    for kind, value in tree:
        if kind is op.LITERAL:
            p = Part.of([fold(chr(value))])
        elif kind is op.IN:
            p = _bracket(value)
        elif kind is op.BRANCH:
            p = _either([_part(x) for x in value[1]])
        elif kind is op.SUBPATTERN:
            p = _part(value[-1])
        elif kind is op.ATOMIC_GROUP:
            p = _part(value)
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
            p = _repeated(_part(value[2]), int(value[0]), int(value[1]))
        elif kind in (op.AT, op.ASSERT, op.ASSERT_NOT):  # between characters
            p = EMPTY
        else:
            p = UNKNOWN
        out = _then(out, p)
    return out


def _needed(part: Part) -> Query:
    if part.whole is not None:
        return _any_of(part.whole)
    return _both(part.need, _both(_any_of(part.head), _any_of(part.tail)))


def trigram_query(regex: str) -> list[list[str]]:
    """Lists of trigrams, one of which each match holds in full; empty if no trigram is mandatory."""
    if re.search(r"\(\?[a-zA-Z]*[uUx]|\\[v0]", regex):
        return []
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("error")
            tree = parser.parse(regex)
    except (re.error, Warning, OverflowError):
        return []
    need = _needed(_part(tree))
    return sorted(map(sorted, need)) if all(need) else []
