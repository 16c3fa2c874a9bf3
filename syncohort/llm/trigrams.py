"""Trigrams that every match of a regular expression must hold, as a Boolean query.

A query is an OR of clauses, a clause an AND of trigrams (three UTF-8 bytes, A-Z
lower-cased). `ANY`, the query with one empty clause, holds for every text. Queries err
on one side only: a text with a match always satisfies the query of its pattern.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from itertools import product

Clause = frozenset[bytes]
Query = frozenset[Clause]

ANY: Query = frozenset({frozenset()})
#: Strings of a set, or clauses of a query, that are told apart; beyond, less is asked for.
MOST = 64


def both(a: Query, b: Query) -> Query:
    if len(a) * len(b) > MOST:
        return min(a, b, key=len)
    return _short(x | y for x, y in product(a, b))


def either(a: Query, b: Query) -> Query:
    out = _short([*a, *b])
    return out if len(out) <= MOST else ANY


def _short(clauses: Iterable[Clause]) -> Query:
    """Without clauses that ask for more than another clause does."""
    found = set(clauses)
    return frozenset(c for c in found if not any(o < c for o in found))


def needs(strings: Iterable[bytes]) -> Query:
    """Every trigram of one of the strings."""
    return reduce(
        either, (frozenset({frozenset(s[i : i + 3] for i in range(len(s) - 2))}) for s in strings)
    )


@dataclass(frozen=True)
class _Part:
    """What is known of the strings a part of a pattern matches.

    `exact`: all of them, or None; otherwise each begins with one of `head`, ends with one
    of `tail`, and satisfies `query`.
    """

    exact: frozenset[bytes] | None
    head: frozenset[bytes]
    tail: frozenset[bytes]
    query: Query = ANY

    def asked(self) -> Query:
        return self.query if self.exact is None else needs(self.exact)


_NONE = frozenset({b""})
_UNKNOWN = _Part(None, _NONE, _NONE)
_EMPTY = _Part(_NONE, _NONE, _NONE)


def _ends(strings: Iterable[bytes], cut: slice) -> frozenset[bytes]:
    out = frozenset(s[cut] for s in strings)
    return out if len(out) <= MOST else _NONE


def _one_of(strings: Iterable[bytes]) -> _Part:
    known = frozenset(strings)
    return _Part(known, known, known) if len(known) <= MOST else _UNKNOWN


def _joined(a: _Part, b: _Part) -> _Part:
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= MOST:
        return _one_of(x + y for x, y in product(a.exact, b.exact))
    ends = _ends(a.tail, slice(-2, None)), _ends(b.head, slice(2))
    seam = needs(x + y for x, y in product(*ends)) if len(ends[0]) * len(ends[1]) <= MOST else ANY
    head = a.head if a.exact is None else (x + y for x, y in product(a.exact, ends[1]))
    tail = b.tail if b.exact is None else (x + y for x, y in product(ends[0], b.exact))
    query = both(both(a.asked(), b.asked()), seam)
    return _Part(None, _ends(head, slice(2)), _ends(tail, slice(-2, None)), query)


def _split(a: _Part, b: _Part) -> _Part:
    if a.exact is not None and b.exact is not None and len(a.exact | b.exact) <= MOST:
        return _one_of(a.exact | b.exact)
    return _Part(
        None,
        _ends(a.head | b.head, slice(2)),
        _ends(a.tail | b.tail, slice(-2, None)),
        either(a.asked(), b.asked()),
    )


def _repeated(part: _Part, least: int, most: int) -> _Part:
    if least == 0:
        return _split(part, _EMPTY) if most == 1 else _UNKNOWN
    start = reduce(_joined, [part] * min(least, 3))
    if most == least <= 3:
        return start
    # Further copies: every match begins with `start` and ends with another of its copies.
    return _Part(
        None,
        _ends(start.head, slice(2)),
        _ends(part.tail, slice(-2, None)) if b"" not in part.tail else _NONE,
        start.asked(),
    )


def _character(code: int) -> bytes:
    return chr(code).lower().encode() if code < 128 else chr(code).encode()


def _of(node, flags: int) -> _Part:
    kind, value = str(node[0]), node[1]
    if kind == "LITERAL":
        odd = value >= 128 and flags & re.IGNORECASE
        return _UNKNOWN if odd else _one_of([_character(value)])
    if kind == "IN":
        codes: set[int] = set()
        for what, x in value:
            if str(what) == "LITERAL":
                codes.add(x)
            elif str(what) == "RANGE" and x[1] - x[0] < 2 * MOST:
                codes |= set(range(x[0], x[1] + 1))
            else:
                return _UNKNOWN
        if flags & re.IGNORECASE and max(codes, default=0) >= 128:
            return _UNKNOWN
        # A class of many characters says next to nothing but multiplies the strings.
        return _one_of(map(_character, codes)) if len(codes) <= 8 else _UNKNOWN
    if kind == "BRANCH":
        return reduce(_split, (_sequence(x, flags) for x in value[1]))
    if kind == "SUBPATTERN":
        return _sequence(value[3], (flags | value[1]) & ~value[2])
    if kind == "ATOMIC_GROUP":
        return _sequence(value, flags)
    if kind.endswith("_REPEAT"):
        return _repeated(_sequence(value[2], flags), value[0], value[1])
    if kind in ("AT", "ASSERT", "ASSERT_NOT"):
        return _EMPTY
    return _UNKNOWN


def _sequence(nodes, flags: int) -> _Part:
    return reduce(_joined, (_of(n, flags) for n in nodes), _EMPTY)


def trigram_query(pattern: re.Pattern[str]) -> Query:
    """The query of a compiled pattern; one that ignores case must be ASCII-only (`(?ai)`)."""
    if pattern.flags & re.IGNORECASE and not pattern.flags & re.ASCII:
        raise ValueError("patterns that ignore case must carry the ASCII flag")
    if pattern.flags & re.VERBOSE:
        raise ValueError("patterns must not be verbose")
    tree = re._parser.parse(pattern.pattern, pattern.flags & ~re.UNICODE)
    return _sequence(tree, pattern.flags).asked()
