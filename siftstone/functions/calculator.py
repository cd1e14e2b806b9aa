"""Arithmetic from text, by a grammar; nothing is evaluated as code.

    sum   := term (("+" | "-") term)*
    term  := sign (("*" | "/" | "%") sign)*
    sign  := ("-" | "+") sign | power
    power := atom ("^" sign)?
    atom  := number | name | name "(" sum ("," sum)* ")" | "(" sum ")"
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)|([A-Za-z]\w*)|(\*\*|[-+*/%^(),]))")
CONSTANTS = {"pi": math.pi, "e": math.e}
#: Function names with their least and greatest number of arguments.
FUNCTIONS = {"sqrt": (1, 1), "sin": (1, 1), "cos": (1, 1), "tan": (1, 1), "log": (1, 2), "log10": (1, 1), "exp": (1, 1), "abs": (1, 1), "round": (1, 2), "pow": (2, 2)}


@dataclass(frozen=True)
class Node:
    kind: str
    value: object = None
    parts: tuple = ()


def parse(text: str) -> Node:
    """The expression's tree; ValueError for anything outside the grammar."""
    tokens, at = [], 0
    while at < len(text.rstrip()):
        m = _TOKEN.match(text, at)
        if m is None:
            raise ValueError(f"unexpected {text[at:].strip()[:10]!r}")
        kind = ("number", "name", "op")[m.lastindex - 1]
        tokens.append((kind, "^" if m[m.lastindex] == "**" else m[m.lastindex]))
        at = m.end()
    tokens.append(("end", ""))
    place = 0

    def peek() -> str:
        return tokens[place][1] if tokens[place][0] == "op" else ""

    def take(expected: str | None = None) -> tuple[str, str]:
        nonlocal place
        token = tokens[place]
        if expected is not None and token != ("op", expected):
            raise ValueError(f"expected {expected!r}")
        place += 1
        return token

    def chain(inner, ops: str) -> Node:
        left = inner()
        while peek() and peek() in ops:
            op = take()[1]
            left = Node(op, None, (left, inner()))
        return left

    def total() -> Node:
        return chain(term, "+-")

    def term() -> Node:
        return chain(sign, "*/%")

    def sign() -> Node:
        if peek() in ("-", "+"):
            return sign() if take()[1] == "+" else Node("neg", None, (sign(),))
        return power()

    def power() -> Node:
        base = atom()
        if peek() == "^":
            take()
            return Node("^", None, (base, sign()))
        return base

    def atom() -> Node:
        kind, value = take()
        if kind == "number":
            return Node("number", float(value) if re.search(r"[.eE]", value) else int(value))
        if kind == "name":
            if peek() != "(":
                if value not in CONSTANTS:
                    raise ValueError(f"unknown name {value!r}")
                return Node("number", CONSTANTS[value])
            if value not in FUNCTIONS:
                raise ValueError(f"unknown function {value!r}")
            take("(")
            parts = [total()]
            while peek() == ",":
                take()
                parts.append(total())
            take(")")
            low, high = FUNCTIONS[value]
            if not low <= len(parts) <= high:
                raise ValueError(f"{value} takes {low} to {high} arguments")
            return Node("call", value, tuple(parts))
        if (kind, value) == ("op", "("):
            inner = total()
            take(")")
            return inner
        raise ValueError("an operand is missing")

    tree = total()
    if tokens[place][0] != "end":
        raise ValueError(f"unexpected {tokens[place][1]!r}")
    return tree


def to_column(text: str, **columns: Column) -> Column:
    """The expression as a column of doubles; division by zero is null."""
    def build(n: Node) -> Column:
        if n.kind == "number":
            return F.lit(float(n.value))
        p = [build(x) for x in n.parts]
        if n.kind == "call":
            one = {"sqrt": F.sqrt, "sin": F.sin, "cos": F.cos, "tan": F.tan, "log": F.log, "log10": F.log10, "exp": F.exp, "abs": F.abs}
            if n.value == "pow":
                return F.pow(*p)
            if n.value == "round":
                return F.bround(p[0], int(n.parts[1].value) if len(p) > 1 else 0)
            return F.log(p[0]) / F.log(p[1]) if n.value == "log" and len(p) > 1 else one[n.value](p[0])
        if n.kind == "neg":
            return -p[0]
        return {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "^": F.pow, "/": F.try_divide,
                # The remainder has the divisor's sign.
                "%": lambda a, b: F.when(b != 0, a - b * F.floor(F.try_divide(a, b)))}[n.kind](*p)

    return build(parse(text))


def evaluate(text: str) -> float | None:
    """The value; None for a division by zero or outside a function's domain."""
    def value(n: Node):
        if n.kind == "number":
            return n.value
        p = [value(x) for x in n.parts]
        if n.kind == "call":
            calls = {"abs": abs, "round": lambda x, d=0: round(x, int(d)) if d else round(x), "pow": pow}
            return calls.get(n.value, getattr(math, n.value, None))(*p)
        if n.kind == "neg":
            return -p[0]
        if n.kind == "^" and abs(p[1]) > 1000:
            return float(p[0]) ** p[1]
        return {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: a / b, "%": lambda a, b: a % b, "^": lambda a, b: a**b}[n.kind](*p)

    tree = parse(text)
    try:
        return float(value(tree))
    except (ArithmeticError, ValueError, TypeError):
        return None
