"""Splitting text where every byte-level BPE token must end, with a bounded memory of what came out.

A token of the pattern used here never runs from a character that isn't white space into one that
is. So a text is the chain of its units, a unit being white space followed by other characters, and
the tokens of a text are those of its units. Most texts have single spaces and line feeds only; these
are split by ``str.split``, and others by a regular expression, with the same result.
"""

from __future__ import annotations

import re
from collections.abc import Callable

#: White space of the tokenizer's pattern (Unicode White_Space).
_WHITE = r"\t-\r \x85\xa0  -     　"
_UNIT = re.compile(f"[{_WHITE}]*[^{_WHITE}]+|[{_WHITE}]+")
#: Entries in each of the two generations of a memory.
MEMORY_ENTRIES = 150_000
#: Longer units aren't remembered.
MEMORY_UNIT = 64


def units(text: str) -> list[str]:
    """The units of a text whose white space is single spaces and line feeds between words; else none.

    A unit after the first that doesn't start with a line feed has lost the space before it.
    """
    words = text.split()
    if text.replace("\n", " ").split(" ") != words:
        return []
    return text.replace("\n", " \n").split(" ") if "\n" in text else words


def any_units(text: str) -> list[str]:
    """The units of any text, white space included."""
    return _UNIT.findall(text)


class Memory(dict):
    """unit -> value, computed where it is missing; the older of two generations is dropped when full."""

    def __init__(self, make: Callable[[str], object], entries: int = MEMORY_ENTRIES):
        super().__init__()
        self.make, self.entries, self.old = make, entries, {}

    def __missing__(self, unit: str):
        value = self.old.get(unit)
        if value is None:
            value = self.make(unit)
            if len(unit) > MEMORY_UNIT:
                return value
        if len(self) >= self.entries:
            self.old = dict(self)
            self.clear()
        self[unit] = value
        return value
