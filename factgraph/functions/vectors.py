"""Vector expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine_similarity(a: Column, b: Column, na: Column | None = None, nb: Column | None = None) -> Column:
    """0 where a norm is 0; null where a vector is null."""
    n = (norm(a) if na is None else na) * (norm(b) if nb is None else nb)
    return F.when(n > 0, dot(a, b) / n).when(n == 0, F.lit(0.0))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - cosine_similarity(a, b)


def parse_vector_text(c: Column) -> Column:
    """``[0.1,0.2]`` as numbers; null where the text is no such list."""
    return F.from_json(c, "array<double>")


def format_vector_text(c: Column) -> Column:
    return F.to_json(c)


def unwrapped(c: Column) -> Column:
    """The vector inside a nested one."""
    return F.try_element_at(c, F.lit(1))
