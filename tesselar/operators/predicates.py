"""User filter text as a Catalyst predicate.

The text has comparisons, and/or/not, arithmetic, ``in [..]``, literals and known column aliases.  Everything else, calls
and member access included, is refused.  Values follow dynamic typing: text meets a number as a number, an undefined
result stays undefined through and, or and not, such a row does not match, and no row can fail the job.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: characters a user expression may contain.
EXPRESSION_CHARACTERS = re.compile(r"""^[\s\w\d_"'().,!<>=&|+\-/*%\[\]]+$""")
_TOKEN = re.compile(r"""\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)|("[^"]*"|'[^']*')|([A-Za-z_]\w*)|(===|!==|==|!=|<=|>=|&&|\|\||[<>!+\-*/%()\[\],]))""", re.ASCII)
_COMPARISONS = {"==", "===", "!=", "!==", "<", "<=", ">", ">=", "in"}
_LITERALS = {"true": True, "false": False, "null": None}
NUMBER, TEXT, TRUTH, MISSING = "number", "text", "truth", "missing"


class Value(NamedTuple):
    column: Column
    kind: str


def column_value(column: Column, kind: T.DataType) -> Value:
    if isinstance(kind, T.BooleanType):
        return Value(column, TRUTH)
    if isinstance(kind, T.NumericType):
        # NaN is undefined like NULL.
        number = column.cast("double")
        return Value(F.when(~F.isnan(number), number), NUMBER)
    return Value(column.cast("string"), TEXT)


def _number(v: Value) -> Column:
    if v.kind == TEXT:
        parsed = F.when(F.trim(v.column) == "", F.lit(0.0)).otherwise(F.trim(v.column).try_cast("double"))
        return F.when(~F.isnan(parsed), parsed)
    return v.column.cast("double")


def _text(v: Value) -> Column:
    if v.kind != NUMBER:
        return v.column.cast("string")
    whole = (v.column == F.floor(v.column)) & (F.abs(v.column) < 1e15)
    return F.when(whole, v.column.try_cast("bigint").cast("string")).otherwise(v.column.cast("string"))


def truth(v: Value) -> Column:
    """Whether the value counts as true; NULL where it is undefined."""
    return {NUMBER: lambda c: c != 0, TEXT: lambda c: c != "", TRUTH: lambda c: c, MISSING: lambda c: c}[v.kind](v.column)


def _compare(op: str, a: Value, b: Value) -> Value:
    if MISSING in (a.kind, b.kind) and op[0] in "=!":
        gone = a.column.isNull() & b.column.isNull()
        return Value(gone if op[0] == "=" else ~gone, TRUTH)
    x, y = (a.column, b.column) if a.kind == b.kind else (_number(a), _number(b))
    found = {"=": x == y, "!": x != y, "<": x <= y if op == "<=" else x < y, ">": x >= y if op == ">=" else x > y}[op[0]]
    return Value(found, TRUTH)


def _arithmetic(op: str, a: Value, b: Value) -> Value:
    if op == "+" and TEXT in (a.kind, b.kind):
        return Value(F.concat(_text(a), _text(b)), TEXT)
    x, y = _number(a), _number(b)
    if op == "/":
        endless = F.when(x > 0, F.lit(float("inf"))).when(x < 0, F.lit(float("-inf")))
        return Value(F.when(y == 0, endless).otherwise(F.try_divide(x, y)), NUMBER)
    if op == "%":
        return Value(F.when(y != 0, F.try_mod(x, y)), NUMBER)
    return Value({"+": x + y, "-": x - y, "*": x * y}[op], NUMBER)


class _Parser:
    def __init__(self, text: str, names: dict[str, Value]):
        self.names, self.tokens, at = names, [], 0
        text = text.strip()
        if not text:
            raise ValueError("expression is empty")
        if not EXPRESSION_CHARACTERS.match(text):
            raise ValueError("expression contains unsupported characters")
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"expression syntax error near {text[at:at + 12]!r}")
            self.tokens.append((m.lastindex, m.group(m.lastindex)))
            at = m.end()
        self.tokens.append((0, ""))
        self.at = 0

    def peek(self) -> str:
        kind, text = self.tokens[self.at]
        return text if kind == 4 or (kind == 3 and text == "in") else ""

    def take(self, wanted: str | None = None) -> str:
        kind, text = self.tokens[self.at]
        if wanted is not None and (kind != 4 or text != wanted):
            raise ValueError(f"expression syntax error: expected {wanted!r}, found {text or 'the end'!r}")
        self.at += 1
        return text

    def chain(self, ops: set[str], below, join) -> Value:
        left = below()
        while self.peek() in ops:
            op = self.take()
            left = join(op, left, below())
        return left

    def whole(self) -> Value:
        found = self.either()
        if self.tokens[self.at][0]:
            raise ValueError(f"expression syntax error near {self.tokens[self.at][1]!r}")
        return found

    def either(self) -> Value:
        return self.chain({"||"}, self.both, lambda _, a, b: Value(truth(a) | truth(b), TRUTH))

    def both(self) -> Value:
        return self.chain({"&&"}, self.comparison, lambda _, a, b: Value(truth(a) & truth(b), TRUTH))

    def comparison(self) -> Value:
        left = self.sums()
        while self.peek() in _COMPARISONS:
            op = self.take()
            left = self.member(left) if op == "in" else _compare(op, left, self.sums())
        return left

    def member(self, left: Value) -> Value:
        self.take("[")
        found = F.lit(False)
        while self.peek() != "]":
            found = found | _compare("==", left, self.either()).column
            if self.peek() != "]":
                self.take(",")
        self.take("]")
        return Value(found, TRUTH)

    def sums(self) -> Value:
        return self.chain({"+", "-"}, self.products, _arithmetic)

    def products(self) -> Value:
        return self.chain({"*", "/", "%"}, self.unary, _arithmetic)

    def unary(self) -> Value:
        if self.peek() == "!":
            self.take()
            return Value(~truth(self.unary()), TRUTH)
        if self.peek() in ("-", "+"):
            sign = self.take()
            inner = _number(self.unary())
            return Value(-inner if sign == "-" else inner, NUMBER)
        return self.atom()

    def atom(self) -> Value:
        kind, text = self.tokens[self.at]
        if kind == 4:
            self.take("(")
            inner = self.either()
            self.take(")")
            return inner
        self.at += 1
        if kind == 1:
            return Value(F.lit(float(text)), NUMBER)
        if kind == 2:
            return Value(F.lit(text[1:-1]), TEXT)
        if kind == 3 and text in self.names:
            return self.names[text]
        if kind == 3 and text in _LITERALS:
            literal = _LITERALS[text]
            return Value(F.lit(literal).cast("boolean"), MISSING if literal is None else TRUTH)
        raise ValueError(f"expression is not executable: unknown name {text!r}" if text else "expression syntax error at the end")


def predicate(expression: str, names: dict[str, Value]) -> Column:
    """The expression as a boolean column that is never NULL."""
    return F.coalesce(truth(_Parser(expression, names).whole()), F.lit(False))
