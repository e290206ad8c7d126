"""Rounding for comparisons: the same double arithmetic in Spark and SQL, so both sides round alike."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def rd(x: Column | str, digits: int = 6) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    scale = F.lit(float(10**digits))
    return F.floor(x * scale + 0.5) / scale


def r(name: str, digits: int = 6) -> Column:
    """``name`` rounded, under its own last name part."""
    return rd(name, digits).alias(name.split(".")[-1])


def expand_round(sql: str) -> str:
    """Replaces ``round(x, n)`` with the arithmetic of :func:`rd`."""
    while True:
        found = re.search(r"(?<![a-z_])round\(", sql)
        if not found:
            return sql
        depth, comma, i = 1, None, found.end()
        while depth:
            c = sql[i]
            depth += (c == "(") - (c == ")")
            if c == "," and depth == 1:
                comma = i
            i += 1
        inner, digits = sql[found.end() : comma], int(sql[comma + 1 : i - 1])
        scale = f"1{'0' * digits}.0::DOUBLE"
        sql = sql[: found.start()] + f"(floor(({inner}) * {scale} + 0.5::DOUBLE) / {scale})" + sql[i:]
