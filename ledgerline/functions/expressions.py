"""Templates and arithmetic formulas given as text, compiled to Columns. Nothing is ever evaluated as code.

A template holds column names in braces: "{First} {Last}" joins text. It is arithmetic if, with each name replaced by a
value, the template itself (not the data) reads as a formula with an operator or a call: "{price} * (1 - {discount})".
A template that names an unknown column stays as it is.

Formulas: numbers, strings, names, + - * / % **, unary minus, chained comparisons, in and not in over literal lists,
is and is not None, `x if c else y`, and, or, not, and calls of abs, round, min, max, len, int, float, str, bool.
Arithmetic on values that are no numbers and division by zero give null.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import q
from .canon import is_number, number_of, number_text, text_number, text_of, type_of

_NAME = re.compile(r"\{([^}]+)\}")


class Value:
    """A compiled part: numeric, text or boolean, each reading the others when asked."""

    def __init__(self, kind: str, column: Column, number: Column | None = None, text: Column | None = None):
        self.kind, self.column, self._number, self._text = kind, column, number, text

    @property
    def number(self) -> Column:
        if self._number is not None:
            return self._number
        if self.kind == "boolean":
            return self.column.cast("double")
        return self.column if self.kind == "number" else text_number(self.column)

    @property
    def text(self) -> Column:
        if self._text is not None:
            return self._text
        return number_text(self.column) if self.kind == "number" else self.column.cast("string")

    @property
    def truth(self) -> Column:
        if self.kind == "boolean":
            return self.column
        return F.coalesce(self.number != 0 if self.kind == "number" else self.column != "", F.lit(False))


def column_value(df: DataFrame, name: str) -> Value:
    kind = type_of(df, name)
    if isinstance(kind, T.BooleanType):
        return Value("boolean", F.col(q(name)), text=text_of(df, name))
    number = is_number(kind)
    return Value("number" if number else "text", number_of(df, name) if number else text_of(df, name), number_of(df, name), text_of(df, name))


def _number(c: Column) -> Value:
    return Value("number", c)


def _power(a: Column, b: Column) -> Column:
    return F.pow(a, b)


_ARITHMETIC: dict[type, Callable[[Column, Column], Column]] = {
    ast.Add: lambda a, b: a + b,
    ast.Sub: lambda a, b: a - b,
    ast.Mult: lambda a, b: a * b,
    ast.Div: lambda a, b: F.try_divide(a, b),
    ast.Mod: lambda a, b: F.pmod(a, F.when(b != 0, b)),
    ast.Pow: _power,
}
_ORDER: dict[type, Callable[[Column, Column], Column]] = {ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b, ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b}
_CALLS: dict[str, Callable[..., Value]] = {
    "abs": lambda x: _number(F.abs(x.number)),
    "round": lambda x, n=None: _number(F.round(x.number, _literal(n) if n else 0)),
    "min": lambda *xs: _number(F.least(*[x.number for x in xs])),
    "max": lambda *xs: _number(F.greatest(*[x.number for x in xs])),
    "len": lambda x: _number(F.length(x.text).cast("double")),
    "int": lambda x: _number(F.when(x.number >= 0, F.floor(x.number)).otherwise(F.ceil(x.number)).cast("double")),
    "float": lambda x: _number(x.number),
    "str": lambda x: Value("text", x.text),
    "bool": lambda x: Value("boolean", x.truth),
}


def _literal(v: Value) -> int:
    if not hasattr(v, "literal"):
        raise ValueError("round takes a literal number of digits")
    return int(v.literal)


def _constant(x) -> Value:
    if isinstance(x, bool):
        out = Value("boolean", F.lit(x))
    elif isinstance(x, (int, float)):
        out = _number(F.lit(float(x)))
    elif isinstance(x, str):
        out = Value("text", F.lit(x))
    elif x is None:
        out = Value("text", F.lit(None).cast("string"))
    else:
        raise ValueError(f"no constant of type {type(x).__name__}")
    out.literal = x
    return out


def _compared(op: ast.cmpop, a: Value, b: Value, right: ast.expr) -> Column:
    if isinstance(op, (ast.Is, ast.IsNot)):
        if getattr(b, "literal", 0) is not None:
            raise ValueError("is compares with None only")
        return a.column.isNull() if isinstance(op, ast.Is) else a.column.isNotNull()
    numeric = "number" in (a.kind, b.kind) and "text" not in (a.kind, b.kind)
    if isinstance(op, (ast.Eq, ast.NotEq)):
        same = F.coalesce(a.number == b.number if numeric else a.text == b.text, F.lit(False))
        return same if isinstance(op, ast.Eq) else ~same
    if type(op) not in _ORDER:
        raise ValueError(f"no operator {type(op).__name__}")
    f = _ORDER[type(op)]
    by_text = f(a.text, b.text)
    return F.coalesce(f(a.number, b.number) if numeric else F.coalesce(f(a.number, b.number), by_text), F.lit(False))


def compiled(node: ast.AST, names: Callable[[str], Value]) -> Value:
    """The Column of a parsed formula. names: what a name or dotted path stands for."""
    sub = lambda n: compiled(n, names)
    if isinstance(node, ast.Expression):
        return sub(node.body)
    if isinstance(node, ast.Constant):
        return _constant(node.value)
    if isinstance(node, (ast.Name, ast.Attribute)):
        return names(ast.unparse(node))
    if isinstance(node, ast.BinOp) and type(node.op) in _ARITHMETIC:
        a, b = sub(node.left), sub(node.right)
        if isinstance(node.op, ast.Add) and a.kind == b.kind == "text" and a._number is None and b._number is None:
            return Value("text", F.concat(a.text, b.text))
        return _number(_ARITHMETIC[type(node.op)](a.number, b.number))
    if isinstance(node, ast.UnaryOp):
        x = sub(node.operand)
        if isinstance(node.op, ast.Not):
            return Value("boolean", ~x.truth)
        out = _number(-x.number if isinstance(node.op, ast.USub) else x.number)
        if isinstance(node.op, ast.USub) and hasattr(x, "literal"):
            out.literal = -x.literal
        return out
    if isinstance(node, ast.BoolOp):
        parts = [sub(v).truth for v in node.values]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if isinstance(node.op, ast.And) else out | p
        return Value("boolean", out)
    if isinstance(node, ast.Compare):
        out, left = F.lit(True), sub(node.left)
        for op, right in zip(node.ops, node.comparators):
            if isinstance(op, (ast.In, ast.NotIn)):
                if isinstance(right, (ast.List, ast.Tuple, ast.Set)):
                    items = [sub(e) for e in right.elts]
                    hit = F.lit(False)
                    for x in items:
                        hit = hit | _compared(ast.Eq(), left, x, right)
                else:
                    hit = F.coalesce(F.contains(sub(right).text, left.text), F.lit(False))
                out = out & (hit if isinstance(op, ast.In) else ~hit)
                continue
            value = sub(right)
            out = out & _compared(op, left, value, right)
            left = value
        return Value("boolean", out)
    if isinstance(node, ast.IfExp):
        c, a, b = sub(node.test), sub(node.body), sub(node.orelse)
        if a.kind == b.kind:
            return Value(a.kind, F.when(c.truth, a.column).otherwise(b.column))
        return Value("text", F.when(c.truth, a.text).otherwise(b.text))
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in _CALLS and not node.keywords:
        return _CALLS[node.func.id](*[sub(a) for a in node.args])
    raise ValueError(f"not allowed in a formula: {ast.unparse(node)}")


def formula(df: DataFrame, text: str, names: Mapping[str, str] | None = None) -> Value:
    """A formula over the columns of df. names: what else a name stands for; a dotted path means its last part."""
    known = names or {}

    def value(name: str) -> Value:
        column = known.get(name, name)
        column = column if column in df.columns else column.rpartition(".")[2]
        if name in ("True", "False", "None"):
            return _constant({"True": True, "False": False}.get(name))
        if column not in df.columns:
            raise ValueError(f"no column {name!r} in the formula {text!r}")
        return column_value(df, column)

    return compiled(ast.parse(text.strip(), mode="eval"), value)


def template_formula(df: DataFrame, text: str) -> Value | None:
    """The template as arithmetic, or None if it isn't any."""
    columns: list[str] = []

    def slot(m: re.Match) -> str:
        columns.append(m.group(1))
        return f" slot_{len(columns) - 1} "

    plain = _NAME.sub(slot, text)
    try:
        parsed = ast.parse(plain.strip(), mode="eval")
    except SyntaxError:
        return None
    if isinstance(parsed.body, (ast.Name, ast.Constant)):
        return None
    places = {f"slot_{i}": c for i, c in enumerate(columns)}
    try:
        return compiled(parsed, lambda n: column_value(df, places[n]))
    except (ValueError, KeyError):
        return None


def template(df: DataFrame, text) -> Column:
    """A value given as a template: text with the columns put in, or the result of its arithmetic."""
    if not isinstance(text, str):
        return F.lit(text)
    names = _NAME.findall(text)
    if not names or any(n not in df.columns for n in names):
        return F.lit(text)
    if len(names) == 1 and text.strip() == "{" + names[0] + "}":
        return text_of(df, names[0])
    found = template_formula(df, text)
    if found is not None:
        return found.column
    pieces, at = [], 0
    for m in _NAME.finditer(text):
        pieces += [F.lit(text[at : m.start()]), F.coalesce(text_of(df, m.group(1)), F.lit(""))]
        at = m.end()
    return F.trim(F.concat(*pieces, F.lit(text[at:])))


def condition(df: DataFrame, text: str | None, names: Mapping[str, str] | None = None) -> Column:
    """A condition given as a formula; an empty one holds always. && and || read as and, or."""
    if not text or not text.strip():
        return F.lit(True)
    return formula(df, text.replace("&&", " and ").replace("||", " or "), names).truth


# Operators of a dynamic condition.
OPERATORS = ("==", "!=", ">", "<", ">=", "<=", "contains", "startsWith", "endsWith")


def dynamic(df: DataFrame, column: str, operator: str, value) -> Column:
    """One dynamic condition; never null. Ordering compares numbers (commas aside) if both sides are any, else text; null is in no order."""
    if operator not in OPERATORS:
        raise ValueError(f"unknown operator {operator!r}; known: {', '.join(OPERATORS)}")
    text, given, has = F.coalesce(text_of(df, column), F.lit("nan")), str(value), F.col(q(column)).isNotNull()
    if operator in (">", "<", ">=", "<="):
        f = {">": lambda a, b: a > b, "<": lambda a, b: a < b, ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b}[operator]
        number = number_of(df, column) if is_number(type_of(df, column)) else text_number(F.regexp_replace(text, ",", ""))
        try:
            limit = float(given.replace(",", ""))
        except ValueError:
            return has & f(text, F.lit(given))
        return has & F.coalesce(F.when(number.isNotNull(), f(number, F.lit(limit))).otherwise(f(text, F.lit(given))), F.lit(False))
    if operator in ("==", "!="):
        return text == given if operator == "==" else text != given
    return {"contains": F.contains, "startsWith": F.startswith, "endsWith": F.endswith}[operator](text, F.lit(given))
