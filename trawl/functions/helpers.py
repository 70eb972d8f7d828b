"""Small things the function modules share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def suffix(path) -> Column:
    """The last name's extension with its dot, lower-cased; none where the name has none or only starts with a dot."""
    name = F.regexp_extract(col(path), r"([^/]*)/*$", 1)
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1))


def sorted_set(array: Column) -> Column:
    return F.array_sort(F.array_distinct(array))
