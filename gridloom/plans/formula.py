"""Formula text to a tree: a lexer and an operator-precedence parser.

Comparisons bind loosest, then &, + and -, * and /, ^ (right-associative), unary signs, and % after an operand. A name of up
to three letters is a column; longer names that no ( follows, array constants and error literals aren't formulas here.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field


class ParseError(ValueError):
    pass


@dataclass(frozen=True)
class Num:
    value: float


@dataclass(frozen=True)
class Str:
    value: str


@dataclass(frozen=True)
class Bool:
    value: bool


@dataclass(frozen=True)
class Empty:
    """An argument that was left out."""


@dataclass(frozen=True)
class Ref:
    """A cell, column or range. Columns are 0-based; rows are None for whole columns, and fixed where a $ stands before them."""

    first: int
    last: int
    top: int | None
    bottom: int | None
    sheet: str | None = None
    book: str | None = None
    is_range: bool = False
    top_fixed: bool = field(default=False, compare=False)
    bottom_fixed: bool = field(default=False, compare=False)


@dataclass(frozen=True)
class Unary:
    op: str
    operand: Node


@dataclass(frozen=True)
class Binary:
    op: str
    left: Node
    right: Node


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple[Node, ...]


Node = Num | Str | Bool | Empty | Ref | Unary | Binary | Call

_PREFIX = r"(?:'(?P<quoted>(?:[^']|'')+)'|(?P<bare>(?:\[[^\]]+\])?[^\W\d][\w.]*|\[[^\]]+\][\w.]+))!"
_CELL = r"\$?[A-Za-z]{1,3}(?:\$?[0-9]+)?"
_TOKEN = re.compile(
    rf"""\s*(?:
    (?P<number>(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?)
    |(?P<string>"(?:[^"]|"")*")
    |(?P<call>[^\W\d][\w.]*)\s*\(
    |(?P<ref>(?:{_PREFIX})?(?P<a>{_CELL})(?::(?P<b>{_CELL}))?)(?![\w.])
    |(?P<word>[^\W\d][\w.]*)
    |(?P<op><>|<=|>=|[-+*/^&=<>%(),;])
    )""",
    re.VERBOSE,
)
_BINDS = {"=": 1, "<>": 1, "<": 1, ">": 1, "<=": 1, ">=": 1, "&": 2, "+": 3, "-": 3, "*": 4, "/": 4, "^": 5}


def column_index(letters: str) -> int:
    n = 0
    for c in letters.upper():
        n = n * 26 + ord(c) - 64
    return n - 1


def column_letters(index: int) -> str:
    out, n = "", index + 1
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def _cell(text: str) -> tuple[int, int | None, bool]:
    letters, fixed, digits = re.fullmatch(r"\$?([A-Za-z]+)(\$?)(\d*)", text).groups()
    return column_index(letters), int(digits) if digits else None, bool(fixed)


def _reference(m: re.Match) -> Ref:
    sheet = m["quoted"].replace("''", "'") if m["quoted"] else m["bare"]
    book = None
    if sheet and (found := re.match(r"\[([^\]]+)\](.*)", sheet)):
        book, sheet = found.groups()
    (c1, *end1), (c2, *end2) = _cell(m["a"]), _cell(m["b"] or m["a"])
    rows = sorted([e for e in (end1, end2) if e[0] is not None], key=lambda e: e[0]) or [[None, False]]
    return Ref(min(c1, c2), max(c1, c2), rows[0][0], rows[-1][0], sheet, book, bool(m["b"]), rows[0][1], rows[-1][1])


def tokens(text: str) -> list[tuple[str, object]]:
    out: list[tuple[str, object]] = []
    at = 0
    while at < len(text.rstrip()):
        m = _TOKEN.match(text, at)
        if not m:
            raise ParseError(f"unexpected {text[at:].strip()[:1]!r} in {text!r}")
        at = m.end()
        if m["number"]:
            out.append(("number", float(m["number"])))
        elif m["string"]:
            out.append(("string", m["string"][1:-1].replace('""', '"')))
        elif m["call"]:
            out.append(("call", re.sub(r"^(_XLFN\.|_XLWS\.)+", "", m["call"].upper())))
        elif m["word"] or (m["ref"] and m["ref"].upper() in ("TRUE", "FALSE")):
            word = (m["word"] or m["ref"]).upper()
            if word not in ("TRUE", "FALSE"):
                raise ParseError(f"unknown name {word} in {text!r}")
            out.append(("bool", word == "TRUE"))
        elif m["ref"]:
            out.append(("ref", _reference(m)))
        else:
            out.append(("op", "," if m["op"] == ";" else m["op"]))
    return out


class _Parser:
    def __init__(self, text: str):
        self.text, self.all, self.at = text, [*tokens(text), ("end", None)], 0

    def peek(self) -> tuple[str, object]:
        return self.all[self.at]

    def take(self) -> tuple[str, object]:
        self.at += 1
        return self.all[self.at - 1]

    def expect(self, op: str) -> None:
        if self.take() != ("op", op):
            raise ParseError(f"expected {op!r} in {self.text!r}")

    def expression(self, floor: int = 1) -> Node:
        left = self.signed()
        while (token := self.peek())[0] == "op" and (power := _BINDS.get(token[1], 0)) >= floor:
            self.take()
            left = Binary(token[1], left, self.expression(power if token[1] == "^" else power + 1))
        return left

    def signed(self) -> Node:
        if self.peek() in (("op", "-"), ("op", "+")):
            return Unary(self.take()[1], self.signed())
        node = self.operand()
        while self.peek() == ("op", "%"):
            self.take()
            node = Unary("%", node)
        return node

    def operand(self) -> Node:
        kind, value = self.take()
        if kind == "number":
            return Num(value)
        if kind == "string":
            return Str(value)
        if kind == "bool":
            return Bool(value)
        if kind == "ref":
            return value
        if kind == "call":
            return Call(value, self.arguments())
        if (kind, value) == ("op", "("):
            node = self.expression()
            self.expect(")")
            return node
        raise ParseError(f"unexpected {value!r} in {self.text!r}")

    def arguments(self) -> tuple[Node, ...]:
        args: list[Node] = []
        if self.peek() == ("op", ")"):
            self.take()
            return ()
        while True:
            args.append(Empty() if self.peek() in (("op", ","), ("op", ")")) else self.expression())
            if self.take() == ("op", ")"):
                return tuple(args)
            if self.all[self.at - 1] != ("op", ","):
                raise ParseError(f"expected ',' or ')' in {self.text!r}")


def parse(formula: str) -> Node:
    p = _Parser(formula.strip().removeprefix("="))
    node = p.expression()
    if p.peek()[0] != "end":
        raise ParseError(f"unexpected {p.peek()[1]!r} in {formula!r}")
    return node


def walk(node: Node):
    yield node
    for child in (node.operand,) if isinstance(node, Unary) else (node.left, node.right) if isinstance(node, Binary) else node.args if isinstance(node, Call) else ():
        yield from walk(child)
