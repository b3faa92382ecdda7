"""A file as tokens, brackets, calls and annotations: what the extractors read instead of text.

One scan cuts the text into words, strings and single marks; comments and white space are gone. Brackets are matched once, so a call's arguments are slices of
the tokens, and nested ones never confuse them. What a call is made on (its receiver) is read backwards along dots.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import cached_property
from typing import NamedTuple

from fathom.operators.extract.source import Source

_STRINGS = r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'"
_REST = r"|(?P<word>[A-Za-z_$][\w$]*)|(?P<number>\d[\w.]*)|(?P<arrow>=>)|(?P<mark>\S)"
_CURLY = re.compile(rf"//[^\n]*|/\*.*?(?:\*/|\Z)|(?P<string>\"\"\".*?\"\"\"|{_STRINGS}|`(?:\\.|[^`\\])*`)" + _REST, re.S)
_PYTHON = re.compile(rf"#[^\n]*|(?P<string>(?:[rbfuRBFU]{{1,2}})?(?:\"\"\".*?\"\"\"|'''.*?'''|{_STRINGS}))" + _REST, re.S)
_OPEN, _CLOSE = dict(zip("([{", ")]}")), set(")]}")


class Token(NamedTuple):
    kind: str  # word, string, number, arrow, mark
    text: str
    at: int

    @property
    def end(self) -> int:
        return self.at + len(self.text)

    @property
    def value(self) -> str:
        """A string without its quotes."""
        body = self.text.lstrip("rbfuRBFU")
        quotes = 3 if body[:3] in ('"""', "'''") else 1
        return body[quotes:-quotes]


class Call(NamedTuple):
    """name(arguments) or @name(arguments): offsets are of the name, or of an annotation's mark."""

    at: int
    name: str
    receiver: tuple[str, ...]  # words before the name's dot, as far as they are words
    arguments: list[list[Token]]
    first: int  # the place of its first token
    last: int  # the place of its last token
    after: int | None = None  # the place of the closing bracket of the call that it is chained to

    @property
    def on(self) -> str:
        return self.receiver[-1] if self.receiver else ""

    def literal(self, i: int = 0) -> Token | None:
        """The string that an argument begins with."""
        return self.arguments[i][0] if i < len(self.arguments) and self.arguments[i] and self.arguments[i][0].kind == "string" else None

    def goes_on(self, i: int = 0) -> bool:
        """Whether something is added to that string."""
        return len(self.arguments[i]) > 1 and self.arguments[i][1].text == "+"

    def named(self, *names: str) -> list[Token] | None:
        """The value of a named argument (name = value, or name: value inside braces)."""
        for part in self.arguments:
            inside = part[1:-1] if part and part[0].text == "{" else part
            for k in range(len(inside) - 2):
                if inside[k].text in names and inside[k + 1].text in "=:" and (not k or inside[k - 1].text in ",{("):
                    return _until_comma(inside[k + 2 :])
        return None

    def plain(self) -> list[Token] | None:
        """The only value given without a name."""
        return next((p for p in self.arguments if not (len(p) > 1 and p[1].text == "=")), None)


def _until_comma(tokens: list[Token]) -> list[Token]:
    depth = 0
    for i, t in enumerate(tokens):
        depth += (t.text in _OPEN) - (t.text in _CLOSE)
        if depth < 0 or (not depth and t.text == ","):
            return tokens[:i]
    return tokens


class Reading:
    def __init__(self, src: Source, python: bool = False):
        rule = _PYTHON if python else _CURLY
        made = tuple.__new__  # a third of the time that Token(...) takes
        self.tokens = [made(Token, (kind, m.group(), m.start())) for m in rule.finditer(src.text) if (kind := m.lastgroup)]
        self.texts = [t[1] for t in self.tokens]

    @cached_property
    def close(self) -> dict[int, int]:
        """Places of opening brackets and of those that close them."""
        out, open_ = {}, []
        for i, (kind, text, _) in enumerate(self.tokens):
            if kind == "mark":
                if text in _OPEN:
                    open_.append(i)
                elif text in _CLOSE:
                    while open_ and _OPEN[self.texts[open_[-1]]] != text:
                        open_.pop()  # a bracket that nothing closes
                    if open_:
                        out[open_.pop()] = i
        return out

    @cached_property
    def opener(self) -> dict[int, int]:
        return {b: a for a, b in self.close.items()}

    def place(self, offset: int) -> int:
        """The first token at or after an offset."""
        return bisect_left(self._offsets, offset)

    @cached_property
    def _offsets(self) -> list[int]:
        return [t.at for t in self.tokens]

    def text(self, i: int) -> str:
        return self.texts[i] if 0 <= i < len(self.texts) else ""

    def beyond_generics(self, i: int) -> int:
        """The place after <...>, if such a list of types begins at i."""
        if self.text(i) != "<":
            return i
        depth = 0
        for k in range(i, min(len(self.tokens), i + 60)):
            t = self.tokens[k]
            depth += (t.text == "<") - (t.text == ">")
            if not depth:
                return k + 1
            if t.kind not in ("word", "mark") or t.text in "(){};=":
                return i
        return i

    def arguments(self, open_: int) -> list[list[Token]]:
        out, last = [], self.close.get(open_)
        if last is None:
            return []
        i = open_ + 1
        while i < last:
            begin = i
            while i < last and self.text(i) != ",":
                i = self.close.get(i, i) + 1
            out.append(self.tokens[begin:i])
            i += 1
        return out

    @cached_property
    def calls(self) -> list[Call]:
        """Calls, in order; annotations are none."""
        return self.calls_of(lambda name: True)

    def calls_of(self, wanted: Callable[[str], bool]) -> list[Call]:
        """Those whose names meet a condition; others are not read."""
        return [c for i, at in self._called if wanted(self.texts[i]) and (c := self._call(i, at))]

    @cached_property
    def _called(self) -> list[tuple[int, int]]:
        """Places of words that arguments follow, and of the arguments' brackets."""
        out = []
        for i, (t, after) in enumerate(zip(self.tokens, self.texts[1:])):
            if t[0] != "word" or after != "(" and after != "<":
                continue
            at = i + 1 if after == "(" else self.beyond_generics(i + 1)
            if self.text(at) == "(" and at in self.close and self.text(i - 1) != "@":
                out.append((i, at))
        return out

    def _call(self, i: int, at: int) -> Call | None:
        if i in self._made:
            return self._made[i]
        receiver, k = [], i
        while self.text(k - 1) == "." and k >= 2 and self.tokens[k - 2].kind == "word":
            receiver.insert(0, self.text(k - 2))
            k -= 2
        made = None
        if self.text(k - 1) != "@":
            after = k - 2 if self.text(k - 1) == "." and self.text(k - 2) == ")" else None
            t = self.tokens[i]
            made = Call(t.at, t.text, tuple(receiver), self.arguments(at), i, self.close[at], after)
        self._made[i] = made
        return made

    @cached_property
    def _made(self) -> dict[int, Call | None]:
        return {}

    @cached_property
    def annotations(self) -> list[Call]:
        """@name, @name(...) and @a.name(...), in order."""
        out = []
        for i, text in enumerate(self.texts):
            if text != "@" or i + 1 >= len(self.tokens) or self.tokens[i + 1].kind != "word":
                continue
            t = self.tokens[i]
            names, k = [self.text(i + 1)], i + 1
            while self.text(k + 1) == "." and k + 2 < len(self.tokens) and self.tokens[k + 2].kind == "word":
                names.append(self.text(k + 2))
                k += 2
            open_ = k + 1
            given = self.text(open_) == "(" and open_ in self.close
            out.append(Call(t.at, names[-1], tuple(names[:-1]), self.arguments(open_) if given else [], i, self.close[open_] if given else k))
        return out

    def declared_by(self, note: Call) -> int:
        """The place of the first token after an annotation, those that follow it and modifiers."""
        known, i = self._notes, note.last + 1
        while i in known or self.text(i) in MODIFIERS:
            i = known.get(i, i) + 1
        return i

    @cached_property
    def _notes(self) -> dict[int, int]:
        """First and last places of annotations."""
        return {a.first: a.last for a in self.annotations}

    def annotated_classes(self) -> Iterator[tuple[int, str, dict[str, Call]]]:
        """(offset of the first annotation, name, annotations by name) of classes that have any."""
        groups: dict[int, list[Call]] = {}
        for a in self.annotations:
            groups.setdefault(self.declared_by(a), []).append(a)
        for i, notes in groups.items():
            if self.text(i) == "class" and i + 1 < len(self.tokens):
                yield notes[0].at, self.text(i + 1), {a.name: a for a in notes}


MODIFIERS = {"public", "protected", "private", "final", "abstract", "static", "sealed", "open", "data", "export", "default"}


def statement(tokens: list[Token]) -> str:
    """Tokens as text, apart by single spaces."""
    return " ".join(t.text for t in tokens)
