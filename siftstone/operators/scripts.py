"""Units of JavaScript and TypeScript sources, from tokens.

A small lexer tells words, numbers, strings, templates, regular expressions and marks apart, so
that braces and names in texts and comments count for nothing; code inside a
template's ``${}`` is code.  Over its tokens, with brackets matched, statements at the
top and members of classes give units of the schema that Python sources have.  What
does not close is read to the end of the file.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from siftstone.functions.lineage import dealt
from siftstone.operators.code import UNIT


class Token(NamedTuple):
    kind: str
    text: str
    line: int


_SPACE = re.compile(r"\s+|//[^\n]*")
_BLOCK = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_WORD = re.compile(r"#?[^\W\d][\w$]*|#?\$[\w$]*")
_NUMBER = re.compile(r"\d[\w.]*|\.\d[\w.]*")
_STRING = re.compile(r"""'(?:[^'\\\n]|\\.)*'?|"(?:[^"\\\n]|\\.)*"?""", re.S)
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/\w*")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*", re.S)
_MARK = re.compile(r"=>|\.\.\.|\?\.(?!\d)|\?\?=?|&&=?|\|\|=?|[=!]==?|.", re.S)
#: Words after which a slash begins a regular expression, and those that are no callee.
BEFORE_VALUE = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "await", "yield", "instanceof"}
NO_CALL = BEFORE_VALUE | {"if", "for", "while", "switch", "catch", "function", "super", "import", "with", "async"}
BRANCHES = {"if", "for", "while", "case", "catch", "&&", "||", "??"}
MODIFIERS = {"static", "async", "get", "set", "public", "private", "protected", "readonly", "abstract", "override", "declare", "accessor", "*"}
PAIRS = {"(": ")", "[": "]", "{": "}"}


def lex(source: str) -> list[Token]:
    """Tokens; block comments are kept (kind "comment"), line comments are not."""
    out: list[Token] = []
    at, line, held = 0, 1, []  # held: open braces; True where one opens in a template

    def take(kind: str, end: int) -> None:
        nonlocal at, line
        out.append(Token(kind, source[at:end], line))
        line, at = line + source.count("\n", at, end), end

    def template() -> None:
        """From after a backquote, or after what closes ``${``."""
        end = _TEMPLATE.match(source, at).end()
        if source.startswith("${", end):
            held.append(True)
            take("template", end + 2)
        else:
            take("template", min(end + 1, len(source)))

    while at < len(source):
        c = source[at]
        if m := _SPACE.match(source, at):
            line, at = line + m[0].count("\n"), m.end()
        elif source.startswith("/*", at):
            take("comment", _BLOCK.match(source, at).end())
        elif c in "'\"":
            take("string", _STRING.match(source, at).end())
        elif c == "`":
            at += 1
            template()
        elif c == "}" and held and held.pop():
            at += 1
            template()
        elif m := _WORD.match(source, at) or _NUMBER.match(source, at):
            take("number" if m[0][0].isdigit() or m[0][0] == "." else "word", m.end())
        else:
            last = next((t for t in reversed(out) if t.kind != "comment"), None)
            value = last is not None and (last.kind in ("number", "string", "regex") or last.kind == "template" and not last.text.endswith("${") or last.kind == "word" and last.text not in BEFORE_VALUE or last.text in (")", "]", "}"))
            if c == "/" and not value and (m := _REGEX.match(source, at)):
                take("regex", m.end())
            else:
                if c == "{":
                    held.append(False)
                take("mark", _MARK.match(source, at).end())
    return out


class _Reader:
    def __init__(self, path: str, source: str):
        every = lex(source)
        self.path, self.found = path, []
        self.doc: dict[int, str] = {}  # by the token that follows
        self.t: list[Token] = []
        for token in every:
            if token.kind == "comment":
                self.doc[len(self.t)] = token.text
            else:
                self.t.append(token)
        self.match, stack = {}, []
        for i, token in enumerate(self.t):
            if token.kind == "mark" and token.text in PAIRS:
                stack.append(i)
            elif token.kind == "mark" and token.text in PAIRS.values() and stack and PAIRS[self.t[stack[-1]].text] == token.text:
                self.match[stack.pop()] = i
        for i in stack:
            self.match[i] = len(self.t) - 1

    def is_(self, i: int, *texts: str) -> bool:
        return i < len(self.t) and self.t[i].kind in ("word", "mark") and self.t[i].text in texts

    def after_types(self, i: int) -> int:
        """Behind type parameters that begin at i."""
        if self.is_(i, "<"):
            deep = 0
            while i < len(self.t):
                deep += self.is_(i, "<") - self.is_(i, ">")
                i += 1
                if not deep:
                    break
        return i

    def body(self, i: int, *stops: str) -> int:
        """The next of the stops, over groups in brackets; a type in braces after a
        colon or an operator is such a group."""
        while i < len(self.t) and not (self.is_(i, *stops) and not (self.is_(i, "{") and self.is_(i - 1, ":", "|", "&", "<", ","))):
            i = self.match.get(i, i) + 1
        return i

    def text(self, a: int, b: int) -> str:
        out = ""
        for token in self.t[a:b]:
            tight = not out or out[-1] in "([{." or token.text in (",", ")", "]", "}", ".", ":", "?", "(", "[", "<", ">") or out.endswith("...") or out[-1] == "<"
            out += token.text if tight else f" {token.text}"
        return out

    def parameters(self, a: int, b: int) -> list[str]:
        """Of the tokens between two brackets; defaults are marked."""
        out, i = [], a
        while i < b:
            end = min(self.body(i, ","), b)
            given = min(self.body(i, "=", ","), end)
            out.append(self.text(i, given) + (" = ..." if given < end else ""))
            i = end + 1
        return out

    def calls(self, a: int, b: int) -> list[str]:
        names = set()
        for i in range(a, b):
            if self.t[i].kind == "word" and self.t[i].text not in NO_CALL:
                at = self.after_types(i + 1) if self.is_(i - 1, "new") else i + 1
                at += self.is_(at, "?.")
                defined = self.is_(at, "(") and self.is_(self.match[at] + 1, "{") or self.is_(i - 1, "function")
                if self.is_(at, "(") and not defined:
                    names.add(self.t[i].text)
        return sorted(names)

    def unit(self, start: int, end: int, name: str, kind: str, owner: str | None = None, **more) -> None:
        own = f"{owner}.{name}" if owner else name
        doc = self.doc.get(start, "")
        said = re.sub(r"(?m)^\s*\*+ ?", "", doc[3:-2]).strip() if doc.startswith("/**") else None
        blank = {"signature": None, "decorators": [], "parameters": [], "calls": [], "bases": [], "is_async": False, "is_private": name[:1] in ("_", "#"), "is_test": name.lower().startswith("test"), "complexity": None}
        self.found.append({"path": self.path, "id": f"{self.path}::{own}", "name": name, "type": kind, "start_line": self.t[start].line, "end_line": self.t[min(end, len(self.t) - 1)].line, "docstring": said or None, "parent_class": owner, **blank, **more})

    def callable(self, start: int, name: str, at: int, owner: str | None, kind: str | None = None, is_async: bool = False, **more) -> int | None:
        """A unit whose parameters begin at ``at``; its end, or None if it has no body."""
        at = self.after_types(at)
        if self.is_(at, "("):
            close, given = self.match[at], self.parameters(at + 1, self.match[at])
            begin = self.body(close + 1, "{", "=>", ";", "}")
        else:
            close, given, begin = at, [self.t[at].text], at + 1
        if not self.is_(begin, "{", "=>"):
            return None
        arrow = self.is_(begin, "=>")
        begin += arrow
        end = self.match[begin] if self.is_(begin, "{") else self.statement(begin)
        inside = range(begin, min(end + 1, len(self.t)))
        ternary = sum(self.is_(i, "?") and not self.is_(i + 1, ":", ")", ",", "=") for i in inside)
        self.unit(start, end, name, kind or ("method" if owner else "async_function" if is_async else "function"), owner, signature=f"{'async ' * is_async}{name}({', '.join(given)})", parameters=given,
                  calls=self.calls(begin, min(end + 1, len(self.t))), is_async=is_async, complexity=1 + ternary + sum(self.is_(i, *BRANCHES) for i in inside), **more)
        return end

    def statement(self, i: int) -> int:
        """The last token of an expression that begins at i."""
        while i < len(self.t):
            if i in self.match:
                i = self.match[i]
            after = i + 1
            if after >= len(self.t) or self.is_(after, ";", ",", ")", "}", "]"):
                return i
            ends = self.t[i].kind != "mark" or self.t[i].text in (")", "]", "}")
            begins = self.t[after].kind in ("word", "string", "number") and self.t[after].text not in ("in", "of", "instanceof", "as") or self.is_(after, "@", "*", "#")
            if ends and begins and self.t[after].line > self.t[i].line and self.t[i].text not in BEFORE_VALUE:
                return i
            i = after
        return len(self.t) - 1

    def value(self, start: int, name: str, at: int, owner: str | None, **more) -> int | None:
        """A function or class that is assigned; its end."""
        is_async = self.is_(at, "async") and not self.is_(at + 1, "=>")
        at += is_async
        if self.is_(at, "function"):
            at += 1 + self.is_(at + 1, "*")
            at += at < len(self.t) and self.t[at].kind == "word"
            return self.callable(start, name, at, owner, is_async=is_async, **more)
        if self.is_(at, "class"):
            return self.klass(start, name, at)
        head = self.after_types(at)
        arrow = self.is_(self.body(self.match[head] + 1, "=>", ";", "{", "=", ","), "=>") if self.is_(head, "(") else at < len(self.t) and self.t[at].kind == "word" and self.is_(at + 1, "=>")
        return self.callable(start, name, at, owner, is_async=is_async, **more) if arrow else None

    def klass(self, start: int, name: str | None, at: int, decorators: list[str] | None = None) -> int:
        """A class whose word stands at ``at``; its end."""
        i, bases = at + 1, []
        if i < len(self.t) and self.t[i].kind == "word" and self.t[i].text not in ("extends", "implements"):
            name, i = name or self.t[i].text, i + 1
        i = self.after_types(i)
        if self.is_(i, "extends"):
            b = i = i + 1
            while i < len(self.t) and (self.t[i].kind == "word" and self.t[i].text != "implements" or self.is_(i, ".")):
                i += 1
            bases = [self.text(b, i)] if i > b else []
        i = self.body(i, "{")
        end = self.match.get(i, len(self.t) - 1)
        name = name or "default"
        self.unit(start, end, name, "class", signature=f"class {name}" + "".join(f" extends {b}" for b in bases), bases=bases, calls=self.calls(i, end), decorators=decorators or [])
        self.members(i + 1, end, name)
        return end

    def marks(self, i: int) -> tuple[int, list[str]]:
        """Behind decorators, and their names."""
        out = []
        while self.is_(i, "@"):
            b = i = i + 1
            while i < len(self.t) and (self.t[i].kind == "word" or self.is_(i, ".")) and (i == b or self.is_(i, ".") or self.is_(i - 1, ".")):
                i += 1
            out.append(self.text(b, i))
            if self.is_(i, "("):
                i = self.match[i] + 1
        return i, out

    def members(self, i: int, end: int, owner: str) -> None:
        while i < end:
            start = i
            i, decorators = self.marks(i)
            said = set()
            while i < end and self.is_(i, *MODIFIERS) and not self.is_(i + 1, "(", "=", ";", ":", "?", "<", "}"):
                said.add(self.t[i].text)
                i += 1
            more = {"decorators": decorators} | ({"is_private": True} if "private" in said else {})
            done, named = None, i < end and (self.t[i].kind in ("word", "string", "number") or self.is_(i, "["))
            if named:
                name, head = (self.text(i, self.match[i] + 1), self.match[i] + 1) if self.is_(i, "[") else (self.t[i].text.strip("'\""), i + 1)
                head += self.is_(head, "?", "!")
                if self.is_(head, "(", "<"):
                    done = self.callable(start, name, head, owner, "property" if "get" in said else None, "async" in said, **more)
                else:
                    given = self.body(head, "=", ";", "}") if self.is_(head, ":") else head
                    if self.is_(given, "="):
                        done = self.value(start, name, given + 1, owner, **more)
            i = max((self.statement(i) if done is None else done) + 1, start + 1)
            i += self.is_(i, ";")

    def module(self) -> list[dict]:
        i = 0
        while i < len(self.t):
            start, done = i, None
            i, decorators = self.marks(i)
            while self.is_(i, "export", "default", "declare", "abstract"):
                i += 1
            i, more = self.marks(i)
            is_async = self.is_(i, "async") and self.is_(i + 1, "function")
            i += is_async
            if self.is_(i, "class"):
                done = self.klass(start, None, i, decorators + more)
            elif self.is_(i, "function"):
                head = i + 1 + self.is_(i + 1, "*")
                named = head < len(self.t) and self.t[head].kind == "word"
                done = self.callable(start, self.t[head].text if named else "default", head + named, None, is_async=is_async)
            elif self.is_(i, "const", "let", "var") and i + 1 < len(self.t) and self.t[i + 1].kind == "word":
                name, given = self.t[i + 1].text, self.body(i + 2, "=", ";", ",") if self.is_(i + 2, ":") else i + 2
                if self.is_(given, "="):
                    done = self.value(start, name, given + 1, None)
                    if done is None and name.isupper():
                        done = self.statement(given + 1)
                        self.unit(start, done, name, "constant")
            i = max((self.match.get(i, i) if done is None else done) + 1, start + 1)
        return self.found


def units_of(path: str, source: str) -> list[dict]:
    return _Reader(path, source).module()


def parse_scripts(files: DataFrame) -> DataFrame:
    """Files (path, source) to units, a row each, as ``code.parse_units`` gives them."""
    kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    schema = pa.schema([(p.split(" ")[0], kinds[p.split(" ")[1]]) for p in UNIT.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([u for p, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for u in units_of(p, s or "")], schema=schema)

    return dealt(files.select("path", "source"), "path").mapInArrow(run, UNIT)
