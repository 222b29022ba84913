"""Boolean trigram queries of regular expressions.

A query is a disjunction of conjunctions: a list of sets of trigrams, of which a text must hold
every one of at least one set. ``None`` means that the expression needs no trigram: every text is
a candidate. Trigrams are in lower case (A-Z only), for both cases of a letter.
"""

from __future__ import annotations

from re import _constants as C
from re import _parser

MOST_STRINGS = 64

Strings = set[str] | None  # every string that a part can match; None: too many to list
Query = list[frozenset[str]] | None


def _trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _any(queries: list[Query]) -> Query:
    """Of the alternatives one holds."""
    if any(q is None for q in queries):
        return None
    return _shortest([s for q in queries for s in q])


def _both(a: Query, b: Query) -> Query:
    if a is None or b is None:
        return b if a is None else a
    return _shortest([x | y for x in a for y in b]) if len(a) * len(b) <= MOST_STRINGS else min(a, b, key=len)


def _shortest(sets: list[frozenset[str]]) -> Query:
    """Without sets that hold another one: those are implied."""
    if frozenset() in sets:
        return None
    distinct = sorted(set(sets), key=lambda s: (len(s), sorted(s)))
    return [s for i, s in enumerate(distinct) if not any(t <= s for t in distinct[:i])]


def _of_strings(strings: Strings) -> Query:
    if not strings or any(len(s) < 3 for s in strings):
        return None
    return _shortest([_trigrams(s) for s in strings])


def _class(items) -> Strings:
    found: set[str] = set()
    for kind, value in items:
        if kind is C.LITERAL:
            found.add(chr(value).lower())
        elif kind is C.RANGE and value[1] - value[0] < MOST_STRINGS:
            found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return found if len(found) <= 8 else None


def _walk(tree) -> tuple[Strings, Query]:
    """The strings of a sequence where they can be listed, and its query."""
    run: set[str] = {""}
    whole, query = True, None
    for kind, value in tree:
        strings, inner = _part(kind, value)
        if strings is not None and len(run) * len(strings) <= MOST_STRINGS:
            run = {a + b for a in run for b in strings}
            continue
        once = _walk(value[2])[0] if kind in (C.MAX_REPEAT, C.MIN_REPEAT) and value[0] else None
        if once is not None and len(run) * len(once) <= MOST_STRINGS:  # a repeat begins with one copy
            run = {a + b for a in run for b in once}
        query, whole = _both(_both(query, _of_strings(run)), inner), False
        run = strings if strings is not None else {""}
    if whole:
        return run, _of_strings(run)
    return None, _both(query, _of_strings(run))


def _part(kind, value) -> tuple[Strings, Query]:
    if kind is C.LITERAL:
        return {chr(value).lower()}, None
    if kind is C.IN:
        return _class(value), None
    if kind is C.AT:
        return {""}, None
    if kind is C.SUBPATTERN:
        return _walk(value[3])
    if kind is C.BRANCH:
        parts = [_walk(x) for x in value[1]]
        listed = set().union(*(s for s, _ in parts)) if all(s is not None for s, _ in parts) else None
        return listed if listed and len(listed) <= MOST_STRINGS else None, _any([q for _, q in parts])
    if kind in (C.MAX_REPEAT, C.MIN_REPEAT):
        least, most, inner = value
        strings, query = _walk(inner)
        if least == 0:
            return (strings | {""} if most == 1 and strings is not None else None), None
        if least == most and strings is not None and len(strings) ** least <= MOST_STRINGS:
            listed = {""}
            for _ in range(least):
                listed = {a + b for a in listed for b in strings}
            return listed, _of_strings(listed)
        return None, query
    return None, None


def trigram_query(pattern: str) -> Query:
    """The query that every text with a match of ``pattern`` satisfies."""
    return _walk(_parser.parse(pattern))[1]
