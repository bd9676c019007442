"""Literal values placed in a text, all at once, and places kept free of one another."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable

import ahocorasick


class Taken:
    """Disjoint places, in order; one that overlaps another is refused, in time that grows with the logarithm of their number."""

    def __init__(self, places: Iterable[tuple[int, int]] = ()) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        for start, end in sorted(places):  # what is given may overlap; it is joined
            if self.ends and start < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def take(self, start: int, end: int) -> bool:
        at = bisect_left(self.starts, end)  # those before it begin before the end
        if at and self.ends[at - 1] > start:
            return False
        self.starts.insert(at, start)
        self.ends.insert(at, end)
        return True


def placed(text: str, values: list[tuple[str, str]], taken: Taken | None = None) -> list[tuple[int, int, str, str]]:
    """(start, end, category, value) of the values (value, category) by place: the longest value first, then in the order given.

    An automaton over all values (Aho-Corasick) reads the text once, whatever their number. Occurrences of one value do not overlap one
    another, the leftmost counts; one that overlaps a longer value, or what is taken, is passed over. Empty values are nowhere.
    """
    taken = taken or Taken()
    automaton = ahocorasick.Automaton()
    for value in {v for v, _ in values if v}:
        automaton.add_word(value, value)
    if not len(automaton) or not text:
        return []
    automaton.make_automaton()
    ends: dict[str, list[int]] = {}
    for last, value in automaton.iter(text):
        own = ends.setdefault(value, [])
        if not own or last + 1 - len(value) >= own[-1]:
            own.append(last + 1)
    out = []
    for value, category in sorted(values, key=lambda v: -len(v[0])):
        out += [(end - len(value), end, category, value) for end in ends.get(value, ()) if taken.take(end - len(value), end)]
    return sorted(out)
