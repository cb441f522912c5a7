"""Fenced blocks of a text, found line by line.

A mark is a line of spaces or tabs, or none, then three tildes or at least three
backticks, then anything. A mark opens a block that the first later mark closes which
has the same white space, the same sign and no fewer signs. Where all later ones have
fewer, the opening counts as one of the most that any of them has. A mark without a
later one of its white space and sign opens nothing. Blocks do not overlap.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

_MARK = re.compile(r"^(?P<space>[ \t]*)(?P<signs>`{3,}|~~~)", re.M)


class Block(NamedTuple):
    start: int  # of the opening line
    info: int  # what stands after the signs of the opening line
    body: int  # the line after it
    close: int  # the closing line
    end: int  # its end


def blocks(text: str) -> Iterator[Block]:
    if "```" not in text and "~~~" not in text:
        return
    marks = list(_MARK.finditer(text))
    alike = defaultdict(list)
    for i, m in enumerate(marks):
        alike[m["space"], m["signs"][0]].append(i)
    turn = {i: k for own in alike.values() for k, i in enumerate(own)}
    i = 0
    while i < len(marks):
        opening = marks[i]
        own = alike[opening["space"], opening["signs"][0]]
        many = len(opening["signs"])
        later = range(turn[i] + 1, len(own))
        signs = lambda k: len(marks[own[k]]["signs"])  # noqa: B023, E731
        fit = next((k for k in later if signs(k) >= many), None)
        if fit is None:
            fit = max(later, key=signs, default=None)
        if fit is None:
            i += 1
            continue
        closing = marks[own[fit]]
        end = text.find("\n", closing.end())
        yield Block(opening.start(), opening.start("signs") + min(many, signs(fit)), text.index("\n", opening.end()) + 1, closing.start(), len(text) if end < 0 else end)
        i = own[fit] + 1
