"""Symbols, calls, imports and test cases of a file.

Three tiers: Python through its own syntax tree; Java, Kotlin, JavaScript and TypeScript by one walk over a file's tokens with a stack of open blocks, so that
nesting gives parents and callers in time linear in the file; the other languages by the words that begin a declaration's line, without calls.
"""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass, field

from fathom.operators.extract.reading import Reading
from fathom.operators.extract.source import Source, unique

SIGNATURE = 200
#: fixed values: callees that say nothing about a program's structure
CALL_NOISE = {
    "print", "len", "str", "int", "float", "range", "isinstance", "super", "require", "console", "append", "extend", "splitlines", "startswith", "endswith", "strip", "join", "split", "replace",
    "format", "items", "keys", "values", "encode", "decode", "lower", "upper", "push", "pop", "slice", "indexOf", "includes",
}
STATEMENTS = {
    "if", "for", "while", "switch", "catch", "return", "new", "throw", "else", "do", "try", "synchronized", "assert", "await", "yield", "function", "typeof", "sizeof", "when", "super", "this", "constructor",
}
#: words that open a type, by language, and the kind of symbol it is
TYPES = {
    "java": {"class": "class", "interface": "class", "enum": "class", "record": "class"}, "kotlin": {"class": "class", "interface": "class", "object": "class"},
    "javascript": {"class": "class"}, "typescript": {"class": "class", "interface": "type", "type": "type", "enum": "type"},
}


@dataclass(frozen=True)
class Flat:
    """A language whose declarations begin a line: words that may come first, words that declare, and whether a visibility word alone makes a method."""

    skip: tuple[str, ...] = ()
    declare: dict[str, str] = field(default_factory=dict)
    methods: tuple[str, ...] = ()


FLAT = {
    "csharp": Flat(
        ("public", "internal", "protected", "private", "static", "abstract", "sealed", "partial", "readonly", "async", "override", "virtual"),
        {"class": "class", "interface": "class", "enum": "class", "record": "class", "struct": "class"}, ("public", "internal", "protected", "private"),
    ),
    "go": Flat((), {"func": "function", "type": "class"}),
    "rust": Flat(("pub", "async", "unsafe", "const", "extern"), {"fn": "function", "struct": "class", "enum": "class", "trait": "class"}),
    "ruby": Flat((), {"def": "function", "class": "class", "module": "class"}),
    "php": Flat(("public", "protected", "private", "static", "abstract", "final"), {"function": "function", "class": "class", "interface": "class", "trait": "class"}),
}
#: by language: the words that begin an import's line, words to skip after them, and what a module's name may hold
IMPORTS = {
    "java": (("import",), ("static",), r"[\w.]+"), "csharp": (("using",), ("static",), r"[\w.]+"), "rust": (("use",), (), r"[\w:]+"), "php": (("use",), (), r"[\w\\]+"),
    "ruby": (("require", "require_relative"), (), r"['\"][^'\"\n]+"), "python": (("import", "from"), (), r"[\w.]+"),
}


def extract(src: Source, lang: str) -> tuple[list[dict], list[dict]]:
    """Symbols (name, kind, line, signature, parent) in order, and calls (caller, callee, line)."""
    if lang == "python":
        try:
            return _python(src)
        except (SyntaxError, ValueError, RecursionError):
            return _flat(src, Flat(("async",), {"def": "function", "class": "class"})), []
    if lang in TYPES:
        return _Walk(src, lang).run()
    return _flat(src, FLAT[lang]) if lang in FLAT else [], []


def _symbol(name: str, kind: str, line: int, signature: str = "", parent: str | None = None) -> dict:
    return {"name": name, "kind": kind, "line": line, "signature": signature[:SIGNATURE], "parent": parent}


def _python(src: Source) -> tuple[list[dict], list[dict]]:
    symbols, calls = [], []

    def visit(node: ast.AST, parent: str | None, caller: str | None) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.ClassDef):
                symbols.append(_symbol(child.name, "class", child.lineno, "", parent))
                visit(child, child.name, None)
            elif isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                symbols.append(_symbol(child.name, "method" if parent else "function", child.lineno, f"({ast.unparse(child.args)})", parent))
                visit(child, parent, child.name)
            else:
                if isinstance(child, ast.Call):
                    callee = getattr(child.func, "attr", None) or getattr(child.func, "id", None)
                    if callee and caller and callee != caller and callee not in CALL_NOISE:
                        calls.append({"caller": caller, "callee": callee, "line": child.lineno})
                visit(child, parent, caller)

    visit(ast.parse(src.text), None, None)
    return symbols, calls


class _Walk:
    """One pass over the tokens of a file in a language of braces.

    blocks holds, for every open brace, the class and the function that it belongs to; a declaration waits in `pending` for the brace that opens its body, at the
    depth of parentheses where it was made.
    """

    def __init__(self, src: Source, lang: str):
        self.src, self.lang, self.types = src, lang, TYPES[lang]
        self.read = src.read()
        self.symbols, self.calls = [], []
        self.blocks: list[tuple[str | None, str | None, bool]] = []  # innermost class, innermost function, whether a class's own body
        self.parens, self.pending = 0, None  # pending: (is class, name, depth of parentheses)

    def run(self) -> tuple[list[dict], list[dict]]:
        tokens, texts, i, telling = self.read.tokens, [*self.read.texts, ""], 0, {*self.types, "fun", "function", "const"}
        while i < len(tokens):
            kind, text, _ = tokens[i]
            if kind == "word":  # one that neither tells of a declaration nor stands before brackets says nothing
                i = self.word(i) if text in telling or texts[i + 1] in ("(", "<") else i + 1
                continue
            if text in "([":
                self.parens += 1
            elif text in ")]":
                self.parens = max(0, self.parens - 1)
            elif text == "{":
                self.opened()
            elif text == "}":
                if self.blocks:
                    self.blocks.pop()
                self.pending = None
            elif text == ";" or text == "=" and self.lang == "kotlin":
                self.pending = None if self.pending and self.pending[2] >= self.parens else self.pending
            i += 1
        return sorted(self.symbols, key=lambda s: s.pop("at")), self.calls

    def opened(self) -> None:
        cls, fn, _ = self.blocks[-1] if self.blocks else (None, None, False)
        if self.pending and self.pending[2] == self.parens:
            is_class, name, _ = self.pending
            self.blocks.append((name, None, True) if is_class else (cls, name, False))
            self.pending = None
        else:
            self.blocks.append((cls, fn, False))

    def found(self, i: int, kind: str, open_: int | None, is_class: bool = False) -> None:
        """A declaration whose name is token i, with its parameters in the brackets at open_."""
        read, t = self.read, self.read.tokens[i]
        signature = ""
        if open_ is not None and open_ in read.close:
            signature = " ".join(self.src.text[read.tokens[open_].at : read.tokens[read.close[open_]].end].split())
        parent = self.blocks[-1][0] if self.blocks else None
        kind = "method" if kind == "function" and parent and self.lang == "kotlin" else kind
        self.symbols.append(_symbol(t.text, kind, self.src.line(t.at), signature, parent) | {"at": t.at})
        self.pending = (is_class, t.text, self.parens)

    def word(self, i: int) -> int:
        """Reads a word, and gives the place to go on from."""
        read, text = self.read, self.read.text(i)
        before, after = read.text(i - 1), read.text(i + 1)
        named = i + 1 < len(read.tokens) and read.tokens[i + 1].kind == "word"
        if text in self.types and named and before not in (".", "@", "::") and self.is_type(i):
            self.found(i + 1, self.types[text], None, True)
            return i + 2
        if text == "fun" and self.lang == "kotlin":
            k = read.beyond_generics(i + 1)
            while read.text(k + 1) == "." or read.text(read.beyond_generics(k + 1)) == ".":
                k = read.beyond_generics(k + 1) + 1
            if read.text(k + 1) == "(":
                self.found(k, "function", k + 1)
                return k + 1
        if self.lang in ("javascript", "typescript"):
            if text == "function":
                k = i + 1 + (after == "*")
                open_ = read.beyond_generics(k + 1)
                if k < len(read.tokens) and read.tokens[k].kind == "word" and read.text(open_) == "(":
                    self.found(k, "function", open_)
                    return k + 1
            if text == "const" and named and (arrow := self.arrow(i + 2)):
                self.found(i + 1, "function", arrow[0])
                return arrow[1]
        open_ = read.beyond_generics(i + 1)
        if read.text(open_) != "(" or open_ not in read.close or text in STATEMENTS or before == "@":
            return i + 1
        if self.is_method(i, read.close[open_]):
            self.found(i, "method", open_)
            return i + 1
        fn = self.blocks[-1][1] if self.blocks else None
        if fn and text != fn and text not in CALL_NOISE:
            self.calls.append({"caller": fn, "callee": text, "line": self.src.line(read.tokens[i].at)})
        return i + 1

    def is_type(self, i: int) -> bool:
        """Whether a type's word stands for it here: `record` and `type` are names as well."""
        after = self.read.text(i + 2)
        if self.read.text(i) == "record":
            return after in "(<"
        return self.read.text(i) != "type" or after in "=<"

    def arrow(self, k: int) -> tuple[int | None, int] | None:
        """The place of the parameters of an arrow function that a constant is given, and where to go on."""
        read = self.read
        if read.text(k) == ":":
            while k < len(read.tokens) and read.text(k) not in ("=", ";", "{"):
                k = read.close.get(k, k) + 1
        if read.text(k) != "=":
            return None
        k += 1 + (read.text(k + 1) == "async")
        k = read.beyond_generics(k)
        open_, end = (k, read.close[k]) if read.text(k) == "(" and k in read.close else (None, k)
        if read.text(end + 1) == ":":
            limit = end + 40
            while end < min(limit, len(read.tokens)) and read.text(end + 1) not in ("=>", ";", "{"):
                end += 1
        if read.text(end + 1) != "=>" or open_ is None and read.tokens[k].kind != "word":
            return None
        return open_, end + 1

    def is_method(self, i: int, end: int) -> bool:
        """Whether name(...) at token i, closed at `end`, declares a method."""
        read, before = self.read, self.read.text(i - 1)
        if self.lang == "java":
            typed = i and (read.tokens[i - 1].kind == "word" and before not in ("return", "new", "throw", "else", "case", "instanceof") or before in (">", "]"))
            if not typed or not (self.blocks and self.blocks[-1][2]) or read.text(i - 2) == "@":
                return False
            k = end + 1
            if read.text(k) == "throws":
                while k < len(read.tokens) and read.text(k) not in ("{", ";"):
                    k += 1
            return read.text(k) in ("{", ";")
        if self.lang == "kotlin":
            return False
        begins = before in ("{", "}", ";", ",", "", ")") or before in ("public", "private", "protected", "static", "async", "get", "set", "readonly", "override", "*")
        if not begins:
            return False
        k = end + 1
        if read.text(k) == ":":
            limit = k + 40
            while k < min(limit, len(read.tokens)) and read.text(k) not in ("{", ";", "="):
                k += 1
        return read.text(k) == "{"


def _flat(src: Source, rule: Flat) -> list[dict]:
    """Declarations that begin a line: skipped words, a declaring word, the name; in C# also visibility, type and name( without a declaring word."""
    out, at = [], 0
    for number, line in enumerate(src.text.split("\n"), 1):
        words = [(m.group(), m.start()) for m in re.finditer(r"[\w.?!:]+|\S", line)]
        k = 0
        while k < len(words) and words[k][0] in rule.skip:
            k += 1
            if k < len(words) and words[k][0] == "(":  # pub(crate)
                k = next((j + 1 for j in range(k, len(words)) if words[j][0] == ")"), len(words))
        if k < len(words) and (kind := rule.declare.get(words[k][0])):
            k += 1
            if k < len(words) and words[k][0] == "(":  # a receiver
                k = next((j + 1 for j in range(k, len(words)) if words[j][0] == ")"), len(words))
            name = words[k][0].rstrip(":.") if k < len(words) else ""
            if words[0][0] == "type" and [w for w, _ in words[k + 1 : k + 2]] not in (["struct"], ["interface"]):
                name = ""
            if name and (name[0].isalpha() or name[0] == "_"):
                out.append(_symbol(name, kind, number, _parameters(src.text, at + words[k][1] + len(name)) if kind == "function" else ""))
        elif rule.methods and words and words[0][0] in rule.methods:
            open_ = next((j for j in range(1, len(words)) if words[j][0] in ("(", "=", ";", "{")), None)
            if open_ and words[open_][0] == "(" and open_ - 1 >= k + 1 and words[open_ - 1][0].isidentifier():
                out.append(_symbol(words[open_ - 1][0], "method", number, _parameters(src.text, at + words[open_][1])))
        at += len(line) + 1
    return out


def _parameters(text: str, at: int) -> str:
    """The parameters in parentheses that begin at an offset, after types in <>, if any do."""
    m = re.compile(r"\s*(?:<[^<>]*>)?\s*(?P<sig>\([^)]*\))").match(text, at)
    return m.group("sig") if m else ""


def imports(src: Source, lang: str) -> list[str]:
    """Modules that a file names, each once, sorted."""
    if lang in ("javascript", "typescript"):
        return sorted(_web_imports(src.read()))
    if lang == "go":
        return sorted(_go_imports(src))
    if lang not in IMPORTS:
        return []
    words, skip, module = IMPORTS[lang]
    out, rule = set(), re.compile(module)
    for line in src.text.split("\n"):
        word, _, rest = line.strip().partition(" ")
        if word not in words:
            continue
        rest = rest.strip()
        for s in skip:
            rest = rest.removeprefix(f"{s} ").strip()
        m = rule.match(rest)
        if m and (lang not in ("java", "csharp") or rest[m.end() :].strip().startswith(";")) and (word != "from" or " import" in rest):
            out.add(m.group().lstrip("'\""))
    return sorted(out)


def _web_imports(read: Reading) -> set[str]:
    """Strings that follow `from` or `import`, or stand in require(...) or import(...)."""
    out = set()
    for i, t in enumerate(read.tokens):
        if t.kind == "string" and t.value and "\n" not in t.value:
            before = read.text(i - 1)
            if before in ("from", "import") or before == "(" and read.text(i - 2) in ("require", "import"):
                out.add(t.value)
    return out


def _go_imports(src: Source) -> set[str]:
    """Strings of import lines and of import blocks."""
    out, inside = set(), False
    for line in src.text.split("\n"):
        line = line.split("//")[0].strip() if '"' not in line.split("//")[0] or "//" not in line else line.strip()
        if line.startswith("import (") or line == "import(":
            inside = True
        elif inside and line.startswith(")"):
            inside = False
        elif inside or line.startswith("import "):
            parts = line.split('"')
            if len(parts) >= 3 and parts[1]:
                out.add(parts[1])
    return out


_JVM_TEST = re.compile(r"@(?:Test|ParameterizedTest|RepeatedTest)\b[^{;]*?(?:\bvoid\s+|\bfun\s+)(?P<name>\w+|`[^`]+`)\s*\(", re.S)
_JS_TEST = re.compile(r"""\b(?:it|test)(?:\.\w+)?\s*\(\s*(?P<q>["'`])(?P<name>(?:\\.|(?!(?P=q)).){1,200})(?P=q)""")
_PY_TEST = re.compile(r"^[ \t]*(?:async[ \t]+)?def[ \t]+(?P<name>test_\w+)", re.M)


def test_cases(src: Source, lang: str) -> list[dict]:
    """name, line of the cases in a test file."""
    rule = {"java": _JVM_TEST, "kotlin": _JVM_TEST, "javascript": _JS_TEST, "typescript": _JS_TEST, "python": _PY_TEST}.get(lang)
    return [{"name": m.group("name").strip("`"), "line": src.line(m.start("name"))} for m in rule.finditer(src.text)] if rule and src.is_test else []


_ANNOTATED = re.compile(r"(?P<notes>(?:@\w+(?:\s*\([^)]*\))?\s*)+)(?:(?:public|final|abstract|static)\s+)*class\s+(?P<name>\w+)")
#: annotations that generate symbols
GENERATES = re.compile("@(?:Builder|SuperBuilder|Data|Value|Getter|Setter)")
_FIELD = re.compile(r"\b(?:private|protected)\s+(?P<words>(?:(?:static|final|transient|volatile)\s+)*)(?P<type>[\w.$]+(?:\s*<[^;={}]*>)?(?:\[\])?)\s+(?P<name>\w+)\s*[=;]")


def lombok(src: Source) -> list[dict]:
    """Accessors and builders that annotations generate."""
    out = []
    for m in _ANNOTATED.finditer(src.text) if GENERATES.search(src.text) else ():
        notes = set(re.findall(r"@(\w+)", m.group("notes")))
        cls, line = m.group("name"), src.line(m.start())
        if notes & {"Builder", "SuperBuilder"}:
            out += [_symbol(n, "method", line, "() [Lombok-generated]", cls) for n in ("builder", "build")]
        reads, writes = bool(notes & {"Data", "Value", "Getter"}), bool(notes & {"Data", "Setter"}) and "Value" not in notes
        for f in _FIELD.finditer(src.text) if reads or writes else ():
            if {"static", "final"} <= set(f.group("words").split()):
                continue
            kind, name = f.group("type"), f.group("name")
            title, at = name[:1].upper() + name[1:], src.line(f.start())
            if reads:
                out.append(_symbol(("is" if kind in ("boolean", "Boolean") else "get") + title, "method", at, f"() : {kind} [Lombok-generated]", cls))
            if writes:
                out.append(_symbol(f"set{title}", "method", at, f"({kind} {name}) [Lombok-generated]", cls))
    return out


__all__ = ["extract", "imports", "test_cases", "lombok", "unique"]
