"""The small transform language of rule templates, compiled to Column expressions.

An expression over ``value`` may use + - * / % **, signs, float int str round abs min max and
the text methods strip upper lower title replace. A null result for a present input means that
the transform failed on that cell; the caller then keeps the raw cell.
"""

from __future__ import annotations

import ast
from dataclasses import dataclass

from pyspark.sql import Column, functions as F, types as T

from terraloom.functions import values as V

NUMBER, INTEGER, TEXT = "number", "integer", "text"


class TransformError(ValueError):
    """The expression leaves the allowed language."""


@dataclass(frozen=True)
class Typed:
    column: Column
    kind: str
    literal: object = None


def compile_transform(expression: str, value: Column, data_type: T.DataType) -> Typed:
    if isinstance(data_type, T.StringType):
        kind = TEXT
    elif isinstance(data_type, T.IntegralType):
        kind = INTEGER
    elif V.is_number_type(data_type):
        kind = NUMBER
    else:
        raise TransformError(f"cannot transform a {data_type.simpleString()} column")
    return _visit(ast.parse(expression, mode="eval").body, Typed(value, kind))


def result_type(kind: str) -> str:
    return {NUMBER: "double", INTEGER: "bigint", TEXT: "string"}[kind]


def _visit(node: ast.AST, value: Typed) -> Typed:
    match node:
        case ast.Name(id="value"):
            return value
        case ast.Constant(value=bool()):
            raise TransformError("booleans are not allowed")
        case ast.Constant(value=int() as v):
            return Typed(F.lit(v).cast("bigint"), INTEGER, v)
        case ast.Constant(value=float() as v):
            return Typed(F.lit(v), NUMBER, v)
        case ast.Constant(value=str() as v):
            return Typed(F.lit(v), TEXT, v)
        case ast.UnaryOp(op=ast.UAdd() | ast.USub() as op, operand=operand):
            inner = _visit(operand, value)
            if inner.kind == TEXT:
                return Typed(F.lit(None).cast("double"), NUMBER)
            literal = -inner.literal if isinstance(op, ast.USub) and inner.literal is not None else inner.literal
            return Typed(-inner.column if isinstance(op, ast.USub) else inner.column, inner.kind, literal)
        case ast.BinOp(left=left, op=op, right=right):
            return _arithmetic(op, _visit(left, value), _visit(right, value))
        case ast.Call(func=ast.Name(id=name), args=args, keywords=[]):
            return _function(name, [_visit(a, value) for a in args])
        case ast.Call(func=ast.Attribute(value=owner, attr=name), args=args, keywords=[]):
            return _method(name, _visit(owner, value), [_visit(a, value) for a in args])
    raise TransformError(f"not allowed: {ast.dump(node)[:80]}")


def _arithmetic(op: ast.operator, a: Typed, b: Typed) -> Typed:
    if TEXT in (a.kind, b.kind):
        if isinstance(op, ast.Add) and a.kind == b.kind == TEXT:
            return Typed(F.concat(a.column, b.column), TEXT)
        if isinstance(op, ast.Mult) and INTEGER in (a.kind, b.kind):
            text, times = (a, b) if a.kind == TEXT else (b, a)
            return Typed(F.repeat(text.column, times.column.cast("int")), TEXT)
        return Typed(F.lit(None).cast("double"), NUMBER)  # text with a number fails on every cell
    kind = INTEGER if a.kind == b.kind == INTEGER else NUMBER
    x, y = a.column, b.column
    if isinstance(op, ast.Add):
        return Typed(F.try_add(x, y), kind)
    if isinstance(op, ast.Sub):
        return Typed(F.try_subtract(x, y), kind)
    if isinstance(op, ast.Mult):
        return Typed(F.try_multiply(x, y), kind)
    if isinstance(op, ast.Div):
        return Typed(F.try_divide(x.cast("double"), y.cast("double")), NUMBER)
    if isinstance(op, ast.Mod):  # sign follows the divisor
        zero = F.lit(0)
        remainder = F.try_mod(x, y)
        wrap = (remainder != zero) & ((remainder < zero) != (y < zero))
        return Typed(F.when(wrap, remainder + y).otherwise(remainder), kind)
    if isinstance(op, ast.Pow):
        power = F.pow(x.cast("double"), y.cast("double"))
        power = F.when((x == 0) & (y < 0), None).otherwise(power)
        if kind == INTEGER and isinstance(b.literal, int) and b.literal >= 0:
            return Typed(power.try_cast("bigint"), INTEGER)
        return Typed(power, NUMBER)
    raise TransformError(f"operator not allowed: {type(op).__name__}")


def _function(name: str, args: list[Typed]) -> Typed:
    a = args[0] if args else None
    if name == "float" and len(args) == 1:
        return Typed(V.to_number(a.column) if a.kind == TEXT else a.column.cast("double"), NUMBER)
    if name == "int" and len(args) == 1:
        if a.kind == TEXT:
            digits = V.strip(a.column)
            plain = F.replace(digits, F.lit("_"), F.lit(""))
            return Typed(F.when(digits.rlike(V.INTEGER_PATTERN), plain.try_cast("bigint")), INTEGER)
        return Typed(F.when(V.finite(a.column.cast("double")), a.column.try_cast("bigint")), INTEGER)
    if name == "str" and len(args) == 1:
        return Typed(a.column.cast("string"), TEXT)
    if name == "abs" and len(args) == 1:
        return Typed(F.abs(a.column), a.kind) if a.kind != TEXT else Typed(F.lit(None).cast("double"), NUMBER)
    if name == "round" and args and a.kind == TEXT:
        return Typed(F.lit(None).cast("double"), NUMBER)
    if name == "round" and len(args) == 1:
        return Typed(F.bround(a.column.cast("double"), 0).try_cast("bigint"), INTEGER)
    if name == "round" and len(args) == 2 and isinstance(args[1].literal, int):
        return Typed(F.bround(a.column, args[1].literal), a.kind)
    if name in ("min", "max") and len(args) >= 2:
        kinds = {x.kind for x in args}
        if TEXT in kinds and len(kinds) > 1:
            return Typed(F.lit(None).cast("double"), NUMBER)
        kind = kinds.pop() if len(kinds) == 1 else NUMBER
        pick = F.least if name == "min" else F.greatest
        present = F.lit(True)
        for x in args:
            present = present & x.column.isNotNull()
        return Typed(F.when(present, pick(*[x.column.cast(result_type(kind)) for x in args])), kind)
    raise TransformError(f"function not allowed: {name}/{len(args)}")


def _method(name: str, owner: Typed, args: list[Typed]) -> Typed:
    if owner.kind != TEXT:
        return Typed(F.lit(None).cast("string"), TEXT)  # a number has no text methods
    text = owner.column
    if name == "strip" and not args:
        return Typed(V.strip(text), TEXT)
    if name == "strip" and len(args) == 1 and isinstance(args[0].literal, str):
        return Typed(F.btrim(text, args[0].column), TEXT)
    if name == "upper" and not args:
        return Typed(F.upper(text), TEXT)
    if name == "lower" and not args:
        return Typed(F.lower(text), TEXT)
    if name == "title" and not args:
        return Typed(V.title_case(text), TEXT)
    if name == "replace" and len(args) == 2 and all(isinstance(x.literal, str) for x in args):
        return Typed(F.replace(text, args[0].column, args[1].column), TEXT)
    raise TransformError(f"method not allowed: {name}/{len(args)}")
