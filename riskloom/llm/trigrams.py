"""What every match of a regular expression must contain, as a Boolean query over trigrams.

The expression is read once. What it can match is held as a set of texts in which gaps stand for
anything: literal characters and small classes add to the texts, alternatives and optional parts join sets,
repeats and large classes leave gaps. The trigrams of one text are a conjunction, the texts a disjunction.
Everything is lower-cased, so the query is put to lower-cased documents, whatever the flags of the expression.

The query may ask for less than the expression, never for more. Whatever the reader does not know makes the
query empty, and the rule scans every document.
"""

from __future__ import annotations

import re
from functools import lru_cache

#: Larger classes are gaps; larger sets of texts lose their ends.
CLASS, TEXTS = 8, 64
_GAP = "\0"

_REPEAT = re.compile(r"(?:([?*+])|\{(\d+)(?:,\d*)?\})[?+]?")
_GROUP = re.compile(r"\((?:\?(?::|(?P<flags>[ims]*(?:-[ims]+)?)(?P<ends>[:)])|P?<[A-Za-z]\w*>|(?P<look><?[=!])|>))?")
_RANGE = re.compile(r"(\\x[0-9A-Fa-f]{2}|\\[^A-Za-z0-9]|[^\\\[\]&])(?:-(\\x[0-9A-Fa-f]{2}|\\[^A-Za-z0-9]|[^\\\[\]&]))?")


class _Unknown(Exception):
    """The reader does not know this part of an expression."""


def _letter(c: str) -> str:
    return c.lower() if c.isascii() else _GAP


def _joined(heads: set[str], tails: set[str]) -> set[str]:
    if len(heads) * len(tails) > TEXTS:
        return {h + _GAP for h in heads}
    return {h + t for h in heads for t in tails}


def _char(written: str) -> str:
    if written.startswith("\\x"):
        return chr(int(written[2:], 16))
    return written[-1]


class _Reader:
    def __init__(self, pattern: str):
        self.pattern, self.at = pattern, 0

    def _rest(self) -> str:
        return self.pattern[self.at : self.at + 1]

    def either(self) -> set[str]:
        found = self._sequence()
        while self._rest() == "|":
            self.at += 1
            found = found | self._sequence()
        return found if len(found) <= TEXTS else {_GAP}

    def _sequence(self) -> set[str]:
        found = {""}
        while self._rest() and self._rest() not in "|)":
            found = _joined(found, self._repeated())
        return found

    def _repeated(self) -> set[str]:
        one = self._single()
        sign = _REPEAT.match(self.pattern, self.at)
        if sign is None:
            return one
        self.at = sign.end()
        if sign[1] == "?":
            return {"", *one}
        if sign[1] == "*" or sign[2] and int(sign[2]) == 0:
            return {_GAP}
        return {x + _GAP for x in one}

    def _single(self) -> set[str]:
        c = self._rest()
        if c == "(":
            return self._group()
        if c == "[":
            return self._class()
        if c == "\\":
            return self._escape()
        if c in "*+?{":
            raise _Unknown(c)
        self.at += 1
        if c in "^$":
            return {""}
        return {_GAP if c == "." else _letter(c)}

    def _group(self) -> set[str]:
        head = _GROUP.match(self.pattern, self.at)
        self.at = head.end()
        if head["ends"] == ")":  # flags alone
            return {""}
        if self._rest() == "?":
            raise _Unknown("(?")
        inside = self.either()
        if self._rest() != ")":
            raise _Unknown("(")
        self.at += 1
        return {""} if head["look"] else inside

    def _class(self) -> set[str]:
        self.at += 1
        negated = self._rest() == "^"
        self.at += negated
        found: set[str] = set()
        first = True
        while first or self._rest() != "]":
            known = re.compile(r"\\[dDwWsS]").match(self.pattern, self.at)
            part = known or _RANGE.match(self.pattern, self.at)
            if part is None:
                raise _Unknown("[")
            self.at, first = part.end(), False
            if known:
                negated = True  # a large class, like a negated one
                continue
            low = _char(part[1])
            high = _char(part[2]) if part[2] else low
            if ord(high) - ord(low) > 127:
                negated = True
            else:
                found |= {_letter(chr(i)) for i in range(ord(low), ord(high) + 1)}
        self.at += 1
        return {_GAP} if negated or len(found) > CLASS else found

    def _escape(self) -> set[str]:
        known = re.compile(r"\\(?:x[0-9A-Fa-f]{2}|[^A-Za-z0-9]|(?P<kind>[dDwWsS]|[1-9]\d*)|(?P<edge>[bBAzZ]))").match(self.pattern, self.at)
        if known is None:
            raise _Unknown("\\")
        self.at = known.end()
        if known["edge"]:
            return {""}
        return {_GAP if known["kind"] else _letter(_char(known[0]))}


@lru_cache(maxsize=4096)
def trigram_query(pattern: str) -> tuple[frozenset[str], ...]:
    """Sets of trigrams, one of which is in every lower-cased match of the pattern as a whole; empty if nothing is mandatory."""
    reader = _Reader(pattern)
    try:
        texts = reader.either()
    except _Unknown:
        return ()
    if reader.at != len(pattern):
        return ()
    every = {frozenset(p[i : i + 3] for p in t.split(_GAP) for i in range(len(p) - 2)) for t in texts}
    least = [a for a in every if not any(b < a for b in every)]
    return tuple(sorted(least, key=sorted)) if all(least) else ()
