"""A file under extraction."""

from __future__ import annotations

from bisect import bisect_left
from functools import cached_property
from itertools import accumulate


class Source:
    def __init__(self, path: str, text: str, is_test: bool = False):
        self.path, self.text, self.is_test = path, text, is_test

    def read(self, python: bool = False):
        """The file's tokens, read once for all extractors."""
        from fathom.operators.extract.reading import Reading

        if python not in self._read:
            self._read[python] = Reading(self, python)
        return self._read[python]

    @cached_property
    def _read(self) -> dict:
        return {}

    @cached_property
    def _breaks(self) -> list[int]:
        ends = list(accumulate(len(x) + 1 for x in self.text.split("\n")))
        return [e - 1 for e in ends[:-1]]

    def line(self, offset: int) -> int:
        return 1 + bisect_left(self._breaks, offset)

    @property
    def suffix(self) -> str:
        name = self.path.rsplit("/", 1)[-1]
        return name.rsplit(".", 1)[-1].lower() if "." in name else ""

    @property
    def stem(self) -> str:
        return self.path.rsplit("/", 1)[-1].rsplit(".", 1)[0]


def unique(rows, *key: str) -> list[dict]:
    """The first row of each key."""
    return list({tuple(r[k] for k in key): r for r in reversed(list(rows))}.values())[::-1]


def before(marks: list[tuple[int, str]], offset: int, default=None):
    """The value of the last mark at or before an offset. marks: sorted."""
    i = bisect_left(marks, (offset + 1,))
    return marks[i - 1][1] if i else default
