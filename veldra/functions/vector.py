"""The vector functions by their SQL names, as Column functions and as SQL functions of a session."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .metrics import distance


def array_value(*values) -> Column:
    """A vector from numbers or columns."""
    return F.array(*(v if isinstance(v, Column) else F.lit(float(v)) for v in values)).cast("array<float>")


def vector(values) -> Column:
    """A constant vector."""
    return F.array(*(F.lit(float(v)) for v in values))


def array_distance(a: Column, b: Column, dim: int | None = None) -> Column:
    return distance("l2", a, b, dim)


def array_cosine_distance(a: Column, b: Column, dim: int | None = None) -> Column:
    return distance("cosine_distance", a, b, dim)


def array_cosine_similarity(a: Column, b: Column, dim: int | None = None) -> Column:
    return distance("cosine_similarity", a, b, dim)


def array_inner_product(a: Column, b: Column, dim: int | None = None) -> Column:
    return distance("inner_product", a, b, dim)


def array_negative_inner_product(a: Column, b: Column, dim: int | None = None) -> Column:
    return distance("negative_inner_product", a, b, dim)


_ZIP = "aggregate(zip_with({{a}}, {{b}}, (x, y) -> {}), 0D, (s, x) -> s + x)"
_NORM = "sqrt(aggregate({}, 0D, (s, x) -> s + x * x))"


def _bodies() -> dict[str, str]:
    dot, na, nb = _ZIP.format("x * y"), _NORM.format("{a}"), _NORM.format("{b}")
    cosine = f"CASE WHEN {na} = 0 OR {nb} = 0 THEN double('NaN') ELSE {dot} / ({na} * {nb}) END"
    return {
        "array_distance": f"sqrt({_ZIP.format('(x - y) * (x - y)')})",
        "array_inner_product": dot,
        "array_negative_inner_product": f"-({dot})",
        "array_cosine_similarity": cosine,
        "array_cosine_distance": f"1 - ({cosine})",
    }


_GUARD = "CASE WHEN {{a}} IS NULL OR {{b}} IS NULL THEN NULL WHEN size({{a}}) <> size({{b}}) THEN raise_error('vectors must have the same dimension') ELSE {} END"


def register(spark: SparkSession) -> None:
    """SQL functions of the same names; Catalyst inlines their bodies."""
    for name, body in _bodies().items():
        text = _GUARD.format(body).replace("{a}", "a").replace("{b}", "b")
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN {text}")


_CALL = re.compile(r"\b(" + "|".join(_bodies()) + r")\s*\(", re.IGNORECASE)


def inline(sql: str) -> str:
    """SQL text with the calls replaced by their bodies: Spark takes no SQL functions in ORDER BY."""
    found = _CALL.search(sql)
    if not found:
        return sql
    depth, args, at = 1, [""], found.end()
    while depth and at < len(sql):
        c = sql[at]
        depth += (c in "([") - (c in ")]")
        if c == "," and depth == 1:
            args.append("")
        elif depth:
            args[-1] += c
        at += 1
    if len(args) != 2:
        raise ValueError(f"{found[1]} takes two vectors")
    a, b = (f"cast({inline(x.strip())} AS ARRAY<DOUBLE>)" for x in args)
    body = _GUARD.format(_bodies()[found[1].lower()]).replace("{a}", a).replace("{b}", b)
    return f"{sql[: found.start()]}({body}){inline(sql[at:])}"
