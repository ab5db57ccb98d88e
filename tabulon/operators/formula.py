"""Arithmetic formulas over named values, as columns (calculated fields and items).

Names become placeholders and Python's own grammar reads the rest; ``^`` is right-associative and a unary
minus binds tighter than it. Dividing by zero or using a missing value gives null.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from tabulon.functions.values import finite


def references(formula: str, names: Sequence[str]) -> list[str]:
    """Names used by the formula, longest known name first at each position."""
    _, used = _source(formula, names)
    return used


def _source(formula: str, names: Sequence[str]) -> tuple[str, list[str]]:
    known = sorted((n for n in names if n), key=len, reverse=True)
    used: list[str] = []

    def place(m: re.Match) -> str:
        token = m.group(0)
        if token == "^":
            return "**"
        if token == "(":
            return "_group("
        name = token[1:-1] if token.startswith("'") and token.endswith("'") and token not in known else token
        if name not in names:
            raise ValueError(f"unknown name {name!r} in formula")
        if name not in used:
            used.append(name)
        return f"_v{used.index(name)}"

    pattern = "|".join([*map(re.escape, known), r"'[^']*'", r"\^", r"\("])
    return re.sub(pattern, place, formula).strip(), used


def compile_formula(formula: str, values: Mapping[str, Column]) -> Column:
    source, used = _source(formula, list(values))
    bound = {f"_v{i}": values[n].cast("double") for i, n in enumerate(used)}

    def build(node: ast.AST) -> Column:
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)):
            return F.lit(float(node.value))
        if isinstance(node, ast.Name) and node.id in bound:
            return bound[node.id]
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id == "_group" and len(node.args) == 1:
            return build(node.args[0])
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
            inner = node.operand
            if isinstance(inner, ast.BinOp) and isinstance(inner.op, ast.Pow):
                return F.pow(-build(inner.left), build(inner.right))
            return -build(inner)
        if isinstance(node, ast.BinOp):
            a, b = build(node.left), build(node.right)
            kind = type(node.op)
            if kind is ast.Add:
                return a + b
            if kind is ast.Sub:
                return a - b
            if kind is ast.Mult:
                return a * b
            if kind is ast.Div:
                return F.try_divide(a, b)
            if kind is ast.Pow:
                return F.pow(a, b)
        raise ValueError(f"cannot read formula {formula!r}")

    return finite(build(ast.parse(source, mode="eval").body))
