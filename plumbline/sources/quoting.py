"""Quotes and fields of delimited lines, as a state that can be carried from line to line and folded over parts of a file.

A quote opens a quoted text only where a field begins; inside, two quotes stand for one. A part of a file is summed up for both states in
which it may begin (outside and inside a quoted text), so parts are looked at independently and folded in order afterwards.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# up to the quote that ends a quoted text: its inside, then a quote that is not doubled
_CLOSE = re.compile(r'[^"]*(?:""[^"]*)*"(?!")')
# Fixed value: a closing quote with text right behind it.
_GLUED = re.compile(r'"([^"]*)"([^\s])')


def scan(line: str, inside: bool, sep: str) -> tuple[int, bool]:
    """(separators outside quotes, whether the line ends inside a quoted text) for a line that begins in state ``inside``."""
    seps, at = 0, 0
    quoted = inside
    while True:
        if quoted or line.startswith('"', at):
            end = _CLOSE.match(line, at if quoted else at + 1)
            if not end:
                return seps, True
            at, quoted = end.end(), False
        after = line.find(sep, at)
        if after < 0:
            return seps, False
        seps, at = seps + 1, after + 1


def repaired(line: str) -> str:
    """A tab between a closing quote and the text that follows it directly."""
    return _GLUED.sub(r'"\1"' + "\t" + r"\2", line)


@dataclass
class Course:
    """What one start state leads to over some lines: widths of records and the state at the end.

    ``head`` is the number of separators up to the end of a record that was open at the start (-1 if it is still open), ``tail`` that of
    the record open at the end, ``most`` the largest of whole records (-1 for none).
    """

    inside: bool
    head: int = -1
    most: int = -1
    tail: int = 0
    records: int = 0
    spans: int = 0
    _partial: bool = field(default=False, repr=False)
    _long: bool = field(default=False, repr=False)

    def __post_init__(self) -> None:
        self._partial = self.inside

    def add(self, line: str, sep: str) -> None:
        seps, self_inside = scan(line, self.inside, sep)
        self.tail += seps
        self.inside = self_inside
        if self_inside:
            self._long = True
            return
        if self._partial:
            self.head, self._partial = self.tail, False
        else:
            self.most = max(self.most, self.tail)
            self.spans += self._long
        self.records += 1
        self.tail, self._long = 0, False

    def add_plain(self, most: int, records: int) -> None:
        """Lines without a quote that are not blank: whole records outside, more of the text inside."""
        if not self.inside and records:
            self.most = max(self.most, most)
            self.records += records


@dataclass
class Part:
    """A part of a file under one separator."""

    sep: str
    outside: Course = field(default_factory=lambda: Course(False))
    within: Course = field(default_factory=lambda: Course(True))
    plain_most: int = -1  # separators of a line, quotes not looked at
    tab_most: int = -1  # tabs of a line
    repaired_most: int = -1  # tabs of a line after repair

    def add(self, lines: pa.Array, first: bool) -> None:
        """Consecutive lines; ``first`` if the part opens the file, so that it begins outside."""
        courses = [self.outside] if first else [self.outside, self.within]
        solid = np.asarray(pc.not_equal(pc.utf8_trim_whitespace(lines), ""))
        seps = np.asarray(pc.count_substring(lines, self.sep))
        quotes = np.flatnonzero(np.asarray(pc.match_substring(lines, '"')))
        if solid.any():
            self.plain_most = max(self.plain_most, int(seps[solid].max()))
            self.tab_most = max(self.tab_most, int(np.asarray(pc.count_substring(lines, "\t"))[solid].max()))
            self.repaired_most = max(self.repaired_most, self.tab_most)
        start = 0
        for q in [*quotes.tolist(), len(lines)]:
            own = seps[start:q][solid[start:q]]
            for c in courses:
                c.add_plain(int(own.max()) if len(own) else -1, len(own))
            if q < len(lines):
                line = lines[q].as_py()
                self.repaired_most = max(self.repaired_most, repaired(line).count("\t"))
                for c in courses:
                    c.add(line, self.sep)
            start = q + 1


def fold(parts: list[tuple[int, Part]]) -> tuple[int, int, int, bool, list[int]]:
    """(separators of the widest record, records, records over several lines, whether the end is inside a quoted text, starts of the parts
    that begin inside one) of a file's parts, given with their starts in order."""
    inside, open_, most, records, spans, within = False, 0, -1, 0, 0, []
    for start, part in parts:
        c = part.within if inside else part.outside
        if inside:
            within.append(start)
            open_ += c.head if c.head >= 0 else c.tail
            if c.head >= 0:
                most, spans = max(most, open_), spans + 1
        if not inside or c.head >= 0:
            open_ = c.tail
        most, records, spans, inside = max(most, c.most), records + c.records, spans + c.spans, c.inside
    return most, records, spans, inside, within


def stretches(*keys: pa.Array) -> Iterator[tuple[int, int]]:
    """(start, end) of the runs of rows that agree in all keys."""
    n = len(keys[0])
    if not n:
        return
    changed = np.zeros(n, dtype=bool)
    for k in keys:
        codes = np.asarray(pc.dictionary_encode(k, null_encoding="encode").indices)
        changed[1:] |= codes[1:] != codes[:-1]
    edges = [0, *np.flatnonzero(changed).tolist(), n]
    yield from zip(edges[:-1], edges[1:], strict=True)
