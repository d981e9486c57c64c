"""The channel expression language, compiled to a Column.

    expr   := term (('+' | '-') term)*
    term   := factor (('*' | '/') factor)*
    factor := '-' factor | primary
    primary := number | name | name '(' expr (',' expr)* ')' | '(' expr ')'

Variables: R G B (0..1), L (0..1), a b (-1..1), K.  Functions: max min abs
invert clip.  A divisor under 1e-9 gives 0.  Text after a whole expression is
an error.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .color import clamp

VARIABLES = ("R", "G", "B", "L", "a", "b", "K")
ARITY = {"max": 2, "min": 2, "abs": 1, "invert": 1, "clip": 3}
_TOKEN = re.compile(r"[ \t\r\n]*(?:([0-9.]+)|([A-Za-z_][A-Za-z0-9_]*)|([-+*/(),]))")


class DslError(ValueError):
    """kind: unexpected_char, unexpected_end, unknown_ident, bad_arity or expected."""

    def __init__(self, kind: str, at: int, message: str):
        super().__init__(f"{message} at {at}")
        self.kind, self.at = kind, at


def tokens(text: str) -> list[tuple[int, str, str]]:
    out, at, end = [], 0, len(text.rstrip(" \t\r\n"))
    while at < end:
        m = _TOKEN.match(text, at)
        if not m:
            at += len(text[at:]) - len(text[at:].lstrip(" \t\r\n"))
            raise DslError("unexpected_char", at, f"unexpected {text[at]!r}")
        kind = ("number", "name", "sign")[m.lastindex - 1]
        out.append((m.start(m.lastindex), kind, m[m.lastindex]))
        at = m.end()
    return out


class _Parser:
    def __init__(self, text: str):
        self.text, self.found, self.at = text, tokens(text), 0

    def peek(self) -> str | None:
        return self.found[self.at][2] if self.at < len(self.found) else None

    def take(self) -> tuple[int, str, str]:
        if self.at == len(self.found):
            raise DslError("unexpected_end", len(self.text), "unexpected end")
        self.at += 1
        return self.found[self.at - 1]

    def want(self, sign: str) -> None:
        at, _, got = self.take()
        if got != sign:
            raise DslError("expected", at, f"expected {sign!r}, got {got!r}")

    def chain(self, below, signs: str):
        left = below()
        while self.peek() is not None and self.peek() in signs:
            left = (self.take()[2], left, below())
        return left

    def expr(self):
        return self.chain(self.term, "+-")

    def term(self):
        return self.chain(self.factor, "*/")

    def factor(self):
        if self.peek() == "-":
            self.take()
            return ("neg", self.factor())
        return self.primary()

    def primary(self):
        at, kind, got = self.take()
        if kind == "number":
            try:
                return float(got)
            except ValueError:
                raise DslError("unexpected_char", at, f"not a number: {got!r}") from None
        if got == "(":
            inner = self.expr()
            self.want(")")
            return inner
        if kind != "name":
            raise DslError("expected", at, f"expected a value, got {got!r}")
        if self.peek() != "(":
            if got not in VARIABLES:
                raise DslError("unknown_ident", at, f"unknown name {got!r}")
            return got
        if got not in ARITY:
            raise DslError("unknown_ident", at, f"unknown function {got!r}")
        self.take()
        args = [self.expr()]
        while self.peek() == ",":
            self.take()
            args.append(self.expr())
        self.want(")")
        if len(args) != ARITY[got]:
            raise DslError("bad_arity", at, f"{got} takes {ARITY[got]} arguments, got {len(args)}")
        return (got, *args)


def parse(text: str, whole: bool = True):
    """The expression tree: numbers, variable names, and tuples of an operator and its arguments.  whole: text after it is an error, else it is ignored."""
    p = _Parser(text)
    tree = p.expr()
    if whole and p.at < len(p.found):
        raise DslError("expected", p.found[p.at][0], f"expected the end, got {p.found[p.at][2]!r}")
    return tree


def variables() -> dict[str, Column]:
    """Over columns r, g, b, l, a and b_ (see color.with_lab)."""
    r, g, b = (F.col(c) / F.lit(255.0) for c in "rgb")
    return {
        "R": r, "G": g, "B": b, "K": 1.0 - F.greatest(r, g, b), "L": clamp(F.col("l") / 100.0, 0.0, 1.0),
        "a": clamp(F.col("a") / 128.0, -1.0, 1.0), "b": clamp(F.col("b_") / 128.0, -1.0, 1.0),
    }


def uses_lab(tree) -> bool:
    return tree in ("L", "a", "b") if isinstance(tree, str) else isinstance(tree, tuple) and any(map(uses_lab, tree[1:]))


def compile_tree(tree, names: dict[str, Column]) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    if isinstance(tree, str):
        return names[tree]
    op, *args = (tree[0], *(compile_tree(t, names) for t in tree[1:]))
    match op:
        case "+":
            return args[0] + args[1]
        case "-":
            return args[0] - args[1]
        case "*":
            return args[0] * args[1]
        case "/":
            return F.when(F.abs(args[1]) < 1e-9, 0.0).otherwise(args[0] / args[1])
        case "neg":
            return -args[0]
        case "max":
            return F.greatest(*args)
        case "min":
            return F.least(*args)
        case "abs":
            return F.abs(args[0])
        case "invert":
            return 1.0 - args[0]
        case "clip":
            x, low, high = args
            return F.when(low > high, F.raise_error(F.lit("clip: low bound above high bound")).cast("double")).otherwise(F.least(F.greatest(x, low), high))
    raise AssertionError(op)


def compile_expr(text: str, whole: bool = False) -> Column:
    """The value of an expression, clamped to 0..1.  Tokens after it are ignored, as saved projects may hold such, unless whole."""
    return clamp(compile_tree(parse(text, whole), variables()), 0.0, 1.0)
