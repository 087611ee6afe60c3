"""Predicates: conjunctive filters, disjunctive rules, and a small query language."""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterable, Mapping
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.nulls import present

_COMPARED: dict[str, Callable[[Column, Any], Column]] = {
    "<": lambda c, v: c < v, "<=": lambda c, v: c <= v, ">": lambda c, v: c > v, ">=": lambda c, v: c >= v, "==": lambda c, v: c == v, "!=": lambda c, v: c != v,
}


def _listed(values: Any) -> list:
    """A rule's values as a list without missing ones; a string is one value."""
    if isinstance(values, str | bytes) or not isinstance(values, Iterable):
        values = [values]
    elif not isinstance(values, list | tuple | set | frozenset):
        raise TypeError(f"a rule takes a value, list, tuple or set, not {type(values).__name__}")
    return [v for v in values if v is not None and v == v]


def _need(df: DataFrame, column: str) -> None:
    if column not in df.columns:
        raise KeyError(f"no column {column!r} (there are {sorted(df.columns)})")


def passing(df: DataFrame, filters: Mapping[str, Any]) -> Column:
    """Whether a row passes every condition; a missing value passes none, not even != or "not in".

    A condition is (op, value) with < <= > >= == != in "not in", or a function of a Column.
    """
    conditions = [F.lit(True)]
    for column, condition in filters.items():
        _need(df, column)
        value = F.col(f"`{column}`")
        if callable(condition):
            holds = condition(value)
        else:
            op, wanted = condition
            if op in ("in", "not in"):
                holds = value.isin(_listed(wanted))
                holds = ~holds if op == "not in" else holds
            elif op in _COMPARED:
                holds = _COMPARED[op](value, wanted)
            else:
                raise ValueError(f"unknown filter operator {op!r} for {column!r}")
        conditions.append(present(df, column) & F.coalesce(holds, F.lit(False)))
    return reduce(and_, conditions)


def apply_filters(df: DataFrame, filters: Mapping[str, Any]) -> DataFrame:
    return df.where(passing(df, filters))


def matching(df: DataFrame, rules: Mapping[str, Any]) -> Column:
    """Whether any rule {column: value or values} matches; a missing value matches none."""
    found = [F.lit(False)]
    for column, values in rules.items():
        _need(df, column)
        found.append(present(df, column) & F.coalesce(F.col(f"`{column}`").isin(_listed(values)), F.lit(False)))
    return reduce(or_, found)


def rows_matching(df: DataFrame, rules: Mapping[str, Any]) -> DataFrame:
    return df.where(matching(df, rules))


def without_matching(df: DataFrame, rules: Mapping[str, Any] | None) -> DataFrame:
    """The rows that no rule excludes."""
    return df.where(~matching(df, rules)) if rules else df


def query_column(df: DataFrame, text: str) -> Column:
    """A boolean expression over columns (comparisons, and/or/not, in/not in, literals) as a Column that is never NULL.

    ``==`` binds as in Python; names outside the table, calls, @variables and arithmetic are refused.
    """
    if "@" in text:
        raise ValueError("a query can't refer to variables")
    quoted: dict[str, str] = {}
    pieces = text.split("`")
    for k in range(1, len(pieces), 2):
        quoted[f"quoted_{k}"] = pieces[k]
        pieces[k] = f"quoted_{k}"
    tree = ast.parse("".join(pieces).strip().replace("&", " and ").replace("|", " or ").replace("~", " not "), mode="eval").body

    def name_of(node: ast.AST) -> str:
        if not isinstance(node, ast.Name):
            raise ValueError(f"not supported in a query: {ast.unparse(node)}")
        name = quoted.get(node.id, node.id)
        _need(df, name)
        return name

    def build(node: ast.AST) -> Column:
        if isinstance(node, ast.BoolOp):
            return reduce(and_ if isinstance(node.op, ast.And) else or_, map(build, node.values))
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not):
            return ~build(node.operand)
        if isinstance(node, ast.Name):
            return F.coalesce(F.col(f"`{name_of(node)}`").cast("boolean"), F.lit(False))
        if isinstance(node, ast.Compare):
            left, out = node.left, []
            for op, right in zip(node.ops, node.comparators, strict=True):
                out.append(compare(left, op, right))
                left = right
            return reduce(and_, out)
        raise ValueError(f"not supported in a query: {ast.unparse(node)}")

    def operand(node: ast.AST) -> Any:
        return F.col(f"`{name_of(node)}`") if isinstance(node, ast.Name) else F.lit(ast.literal_eval(node))

    def compare(left: ast.AST, op: ast.cmpop, right: ast.AST) -> Column:
        if isinstance(op, ast.In | ast.NotIn):
            name = name_of(left)
            holds = present(df, name) & F.coalesce(F.col(f"`{name}`").isin(_listed(ast.literal_eval(right))), F.lit(False))
            return ~holds if isinstance(op, ast.NotIn) else holds
        signs = {ast.Lt: "<", ast.LtE: "<=", ast.Gt: ">", ast.GtE: ">=", ast.Eq: "==", ast.NotEq: "!="}
        if type(op) not in signs:
            raise ValueError("not supported in a query: is")
        both = [name_of(x) for x in (left, right) if isinstance(x, ast.Name)]
        known = reduce(and_, [present(df, name) for name in both], F.lit(True))
        holds = known & F.coalesce(_COMPARED[signs[type(op)]](operand(left), operand(right)), F.lit(False))
        return holds | ~known if isinstance(op, ast.NotEq) else holds

    return build(tree)
