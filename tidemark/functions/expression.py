"""The scalar expression language: text to Column.

``+ - * /``, unary minus, parentheses, numbers without exponent, quoted strings, identifiers, and
upper-case calls ABS, LOG, CLIP, CAST. TS_* calls are allowed where a ``stage`` callback is given: each
distinct call is computed once and stands in the expression as a column.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import values as V

STATEFUL = ("TS_EMA", "TS_MEAN", "TS_STD", "TS_DELAY", "TS_DIFF", "TS_RETURN")
_TOKENS = re.compile(r"\s*(?:(?P<number>\d+\.?\d*|\.\d+)|(?P<string>\"[^\"]*\"|'[^']*')|(?P<name>[A-Za-z_][A-Za-z0-9_]*)|(?P<sign>[-+*/(),]))")
_KINDS = {"double": "double", "float": "float", "bigint": "bigint", "int": "int", "string": "string"}


@dataclass(frozen=True)
class Node:
    """``op`` is number, string, column, neg, one of + - * /, or a function name."""

    op: str
    args: tuple


def parse(text: str) -> Node:
    tokens, at = [], 0
    while text[at:].strip():
        m = _TOKENS.match(text, at)
        if not m:
            raise ValueError(f"unexpected character at {at} in [{text}]")
        tokens.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    if not tokens:
        raise ValueError("empty expression")
    pos = 0

    def peek(sign: str | None = None):
        if pos >= len(tokens):
            return None
        return tokens[pos] if sign is None else tokens[pos] == ("sign", sign)

    def take(sign: str) -> None:
        nonlocal pos
        if not peek(sign):
            raise ValueError(f"expected {sign} in [{text}]")
        pos += 1

    def binary(signs: str, below: Callable[[], Node]) -> Node:
        nonlocal pos
        left = below()
        while pos < len(tokens) and tokens[pos][0] == "sign" and tokens[pos][1] in signs:
            op = tokens[pos][1]
            pos += 1
            left = Node(op, (left, below()))
        return left

    def total() -> Node:
        return binary("+-", lambda: binary("*/", unary))

    def unary() -> Node:
        nonlocal pos
        if peek("-"):
            pos += 1
            return Node("neg", (unary(),))
        return primary()

    def primary() -> Node:
        nonlocal pos
        if peek() is None:
            raise ValueError(f"unexpected end of [{text}]")
        kind, value = tokens[pos]
        pos += 1
        if kind == "number":
            return Node("number", (float(value),))
        if kind == "string":
            return Node("string", (value[1:-1],))
        if kind == "name":
            if not peek("("):
                return Node("column", (value,))
            take("(")
            args = [] if peek(")") else [total()]
            while peek(","):
                take(",")
                args.append(total())
            take(")")
            return Node(value, tuple(args))
        if value == "(":
            inner = total()
            take(")")
            return inner
        raise ValueError(f"unexpected {value} in [{text}]")

    out = total()
    if pos != len(tokens):
        raise ValueError(f"unexpected {tokens[pos][1]} in [{text}]")
    return out


def build(node: Node, schema: T.StructType, stage: Callable[[str, Column, int, Node], Column] | None = None) -> tuple[Column, str]:
    """Column and type of a parsed expression over ``schema``."""

    def numeric(n: Node) -> Column:
        c, kind = make(n)
        if kind == "string":
            raise ValueError("a number is expected, not text")
        return c.cast("double")

    def count(node: Node, n: int) -> None:
        if len(node.args) != n:
            raise ValueError(f"{node.op} takes {n} arguments")

    def make(n: Node) -> tuple[Column, str]:
        if n.op == "number":
            return F.lit(n.args[0]), "double"
        if n.op == "string":
            return F.lit(n.args[0]), "string"
        if n.op == "column":
            if n.args[0] not in schema.names:
                raise ValueError(f"unknown column [{n.args[0]}]")
            kind = schema[n.args[0]].dataType.simpleString()
            if kind not in _KINDS:
                raise ValueError(f"unsupported type [{kind}] of column [{n.args[0]}]")
            return F.col(f"`{n.args[0]}`"), kind
        if n.op == "neg":
            return -numeric(n.args[0]), "double"
        if n.op in "+-*/":
            a, b = (numeric(x) for x in n.args)
            return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: F.try_divide(a, b)}[n.op](), "double"
        if n.op == "ABS":
            count(n, 1)
            return F.abs(numeric(n.args[0])), "double"
        if n.op == "LOG":
            count(n, 1)
            return V.natural_log(numeric(n.args[0])), "double"
        if n.op == "CLIP":
            count(n, 3)
            return V.clip(*(numeric(x) for x in n.args)), "double"
        if n.op == "CAST":
            count(n, 2)
            if n.args[1].op != "string":
                raise ValueError("CAST takes a quoted dtype")
            c, kind = make(n.args[0])
            return V.convert(c, kind, n.args[1].args[0]), V.CASTS[n.args[1].args[0]]
        if n.op in STATEFUL:
            count(n, 2)
            if stage is None:
                raise ValueError(f"{n.op} needs a state by instrument and isn't allowed here")
            size = n.args[1]
            if size.op != "number" or size.args[0] != int(size.args[0]) or size.args[0] < 1:
                raise ValueError(f"{n.op} takes a positive whole number")
            return stage(n.op, numeric(n.args[0]), int(size.args[0]), n), "double"
        raise ValueError(f"unknown function [{n.op}]; names are upper case")

    return make(node)


def column(text: str, schema: T.StructType) -> Column:
    """A stateless expression."""
    return build(parse(text), schema)[0]
