"""One syntax tree and one precedence-climbing parser for the three dialects.

``cel`` is the canonical dialect, ``plain`` the older filter language, and ``view`` the language of
saved view files. They differ in their operators' precedence and in a few literals.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, fields, is_dataclass, replace

MAX_SOURCE, MAX_DEPTH = 64 * 1024, 128


class ExpressionError(ValueError):
    """An expression that doesn't compile; ``code`` names the reason."""

    def __init__(self, message: str, code: str = "expression_compile_error"):
        super().__init__(message)
        self.code = code


@dataclass(frozen=True)
class Lit:
    value: object


@dataclass(frozen=True)
class Regex:
    pattern: str
    flags: str = ""


@dataclass(frozen=True)
class Name:
    id: str


@dataclass(frozen=True)
class Member:
    target: object
    name: str
    optional: bool = False


@dataclass(frozen=True)
class Index:
    target: object
    index: object


@dataclass(frozen=True)
class Call:
    name: str
    target: object | None
    args: tuple


@dataclass(frozen=True)
class Unary:
    op: str
    operand: object


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Ternary:
    test: object
    yes: object
    no: object


@dataclass(frozen=True)
class ListLit:
    items: tuple


@dataclass(frozen=True)
class MapLit:
    items: tuple = field(default_factory=tuple)


@dataclass(frozen=True)
class Grammar:
    """Binary operators with their binding strength, and what else a dialect has."""

    name: str
    binary: dict[str, int]
    ternary: bool = True
    maps: bool = False
    regex: bool = False
    namespaced: bool = False
    max_depth: int = MAX_DEPTH


def _levels(*rows: str) -> dict[str, int]:
    return {op: i for i, row in enumerate(rows, 1) for op in row.split()}


CEL = Grammar("cel", _levels("||", "&&", "== != < <= > >= in", "+ -", "* / %"), maps=True)
PLAIN = Grammar("plain", _levels("??", "||", "&&", "== !=", "< > <= >= in", "+ -", "* / %"), namespaced=True, max_depth=64)
VIEW = Grammar("view", _levels("||", "&&", "== != > < >= <=", "+ -", "* / %"), ternary=False, regex=True)

_TOKEN = re.compile(
    r"""(?P<space>\s+|//[^\n]*)
      |(?P<number>(?:\d+\.\d+|\.\d+|\d+)(?:[eE][+-]?\d+)?u?)
      |(?P<raw>[rR](?:"[^"]*"|'[^']*'))
      |(?P<string>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')
      |(?P<name>[^\W\d][\w$]*(?:::[^\W\d]\w*)?)
      |(?P<op>\?\.|\?\?|\|\||&&|[=!<>]=|[-+*/%<>!?:.,()\[\]{}])""",
    re.X | re.S,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}
_CONSTANTS = {"true": True, "false": False, "null": None}


def _unquote(text: str) -> str:
    def one(m: re.Match) -> str:
        code = m[1]
        if code[0] == "u":
            return chr(int(code[1:], 16))
        return _ESCAPES.get(code, code)

    return re.sub(r"\\(u[0-9a-fA-F]{4}|.)", one, text[1:-1], flags=re.S)


def tokenize(source: str, grammar: Grammar) -> list[tuple[str, object]]:
    if len(source.encode()) > MAX_SOURCE:
        raise ExpressionError("the expression is too long", "expression_source_limit_exceeded")
    out: list[tuple[str, object]] = []
    at = 0
    while at < len(source):
        operand = not out or (out[-1][0] == "op" and out[-1][1] not in (")", "]"))
        if grammar.regex and operand and source[at] == "/":
            m = re.compile(r"/((?:[^/\\\n]|\\.)+)/([a-z]*)").match(source, at)
            if not m:
                raise ExpressionError("unclosed regular expression")
            out.append(("regex", (m[1], m[2])))
            at = m.end()
            continue
        m = _TOKEN.match(source, at)
        if not m:
            raise ExpressionError(f"unexpected character {source[at]!r} at {at}")
        at = m.end()
        kind, text = m.lastgroup, m[0]
        if kind == "space":
            continue
        if kind == "number":
            digits = text.rstrip("u")
            whole = digits.isdigit()
            out.append(("lit", int(digits) if whole and grammar is CEL else float(digits)))
        elif kind == "raw":
            out.append(("lit", text[2:-1]))
        elif kind == "string":
            out.append(("lit", _unquote(text)))
        elif kind == "name" and text in _CONSTANTS:
            out.append(("lit", _CONSTANTS[text]))
        elif kind == "name" and text == "in" and "in" in grammar.binary:
            out.append(("op", "in"))
        else:
            out.append((kind, text))
    return out


class _Parser:
    def __init__(self, source: str, grammar: Grammar):
        self.tokens, self.at, self.grammar, self.depth = tokenize(source, grammar), 0, grammar, 0

    def peek(self, *ops: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] == "op" and self.tokens[self.at][1] in ops

    def take(self, *ops: str) -> bool:
        found = self.peek(*ops)
        self.at += found
        return found

    def expect(self, op: str) -> None:
        if not self.take(op):
            raise ExpressionError(f"{op!r} expected")

    def expression(self):
        self.depth += 1
        if self.depth > self.grammar.max_depth:
            raise ExpressionError("the expression is nested too deeply", "expression_depth_exceeded")
        test = self.binary(1)
        if self.grammar.ternary and self.take("?"):
            yes = self.expression()
            self.expect(":")
            test = Ternary(test, yes, self.expression())
        self.depth -= 1
        return test

    def binary(self, least: int):
        left = self.unary()
        while self.at < len(self.tokens):
            kind, op = self.tokens[self.at]
            power = self.grammar.binary.get(op) if kind == "op" else None
            if power is None or power < least:
                break
            self.at += 1
            left = Binary(op, left, self.binary(power + 1))
        return left

    def unary(self):
        for op in ("!", "-", *(["+"] if self.grammar is VIEW else [])):
            if self.take(op):
                self.depth += 1
                if self.depth > self.grammar.max_depth:
                    raise ExpressionError("the expression is nested too deeply", "expression_depth_exceeded")
                inner = self.unary()
                self.depth -= 1
                if op == "-" and isinstance(inner, Lit) and isinstance(inner.value, (int, float)) and not isinstance(inner.value, bool):
                    return Lit(-inner.value)
                return Unary(op, inner)
        return self.postfix(self.primary())

    def postfix(self, node):
        while True:
            if self.take("."):
                node = self.member(node, False)
            elif self.grammar is CEL and self.take("?."):
                node = self.member(node, True)
            elif self.take("["):
                node = Index(node, self.expression())
                self.expect("]")
            else:
                return node

    def member(self, target, optional: bool):
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
            raise ExpressionError("a name is expected after '.'")
        name = self.tokens[self.at][1]
        self.at += 1
        if self.take("("):
            return Call(name, target, self.items(")"))
        return Member(target, name, optional)

    def items(self, end: str) -> tuple:
        out = []
        while not self.take(end):
            out.append(self.expression())
            if not self.take(","):
                self.expect(end)
                break
        return tuple(out)

    def primary(self):
        if self.at >= len(self.tokens):
            raise ExpressionError("the expression ends too early")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "lit":
            return Lit(value)
        if kind == "regex":
            return Regex(*value)
        if kind == "name":
            return Call(value, None, self.items(")")) if self.take("(") else Name(value)
        if value == "(":
            inner = self.expression()
            self.expect(")")
            return inner
        if value == "[":
            return ListLit(self.items("]"))
        if value == "{" and self.grammar.maps:
            pairs = []
            while not self.take("}"):
                key = self.expression()
                self.expect(":")
                pairs.append((key, self.expression()))
                if not self.take(","):
                    self.expect("}")
                    break
            return MapLit(tuple(pairs))
        raise ExpressionError(f"unexpected {value!r}")


def parse(source: str, grammar: Grammar = CEL):
    """The syntax tree of an expression."""
    parser = _Parser(source, grammar)
    tree = parser.expression()
    if parser.at != len(parser.tokens):
        raise ExpressionError(f"unexpected {parser.tokens[parser.at][1]!r}")
    return tree


def children(node) -> list:
    if isinstance(node, (Member, Index)):
        return [node.target, *([node.index] if isinstance(node, Index) else [])]
    if isinstance(node, Call):
        return [*([node.target] if node.target is not None else []), *node.args]
    if isinstance(node, Unary):
        return [node.operand]
    if isinstance(node, Binary):
        return [node.left, node.right]
    if isinstance(node, Ternary):
        return [node.test, node.yes, node.no]
    if isinstance(node, ListLit):
        return list(node.items)
    if isinstance(node, MapLit):
        return [x for pair in node.items for x in pair]
    return []


def rewritten(node, change: Callable):
    """The tree with ``change`` applied to every node, inner ones first."""
    if isinstance(node, tuple):
        return tuple(rewritten(x, change) for x in node)
    if not is_dataclass(node):
        return node
    return change(replace(node, **{f.name: rewritten(getattr(node, f.name), change) for f in fields(node)}))


def references(node, root: str) -> set[str]:
    """Names read as ``root.name`` anywhere in the tree."""
    own = {node.name} if isinstance(node, Member) and node.target == Name(root) else set()
    return own.union(*(references(c, root) for c in children(node)))


def in_order(needs: dict[str, set[str]]) -> list[str]:
    """Names so that each comes after those it needs; keeps the given order where it can."""
    out: list[str] = []
    open_: set[str] = set()

    def visit(name: str) -> None:
        if name in out:
            return
        if name in open_:
            raise ExpressionError(f"{name} depends on itself", "invalid_query")
        open_.add(name)
        for n in needs:
            if n in needs[name]:
                visit(n)
        open_.discard(name)
        out.append(name)

    for name, wanted in needs.items():
        if unknown := sorted(wanted - set(needs)):
            raise ExpressionError(f"{name} refers to unknown {unknown[0]}", "invalid_query")
    for name in needs:
        visit(name)
    return out
