"""Scalar rules: null-safe division, delimited lists, packed keys, buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def safe_divide(a, b) -> Column:
    """Double division that yields NULL instead of failing on a zero divisor."""
    return F.try_divide(_c(a).cast("double"), _c(b).cast("double"))


def greatest_strict(*cols) -> Column:
    """``greatest`` that is NULL as soon as one argument is NULL."""
    cs = [_c(c) for c in cols]
    known = cs[0].isNotNull()
    for c in cs[1:]:
        known = known & c.isNotNull()
    return F.when(known, F.greatest(*cs))


def ceil_long(x) -> Column:
    return F.ceil(_c(x)).cast("long")


def split_list(s, sep: str = ",") -> Column:
    """Array of a delimited string; ``sep`` is taken literally."""
    quoted = "".join("\\" + ch if not ch.isalnum() and ch != " " else ch for ch in sep)
    return F.split(_c(s), quoted)


def packed_part(s, i: int, sep: str = ":") -> Column:
    """``i``-th (0-based) part of a packed key, NULL when there are fewer parts."""
    return F.get(split_list(s, sep), F.lit(i))


def prefix_before_dash(s) -> Column:
    """Text before the first dash; NULL where there is no dash."""
    s = _c(s)
    return F.when(F.instr(s, "-") > 0, F.substring_index(s, "-", 1))


def trailing_digit(s) -> Column:
    """Last character as an integer (NULL when it is not a digit)."""
    return F.substring(_c(s), -1, 1).try_cast("int")


def random_key(seed: str | Column, *ids) -> Column:
    """Repeatable stand-in for a random draw: the md5 of the ids and a seed."""
    return F.md5(F.concat_ws("|", *[_c(i).cast("string") for i in ids], F.lit(seed)).cast("binary"))


def labelled_bucket(x, edges: Sequence[float]) -> Column:
    """Struct(bucket, sort_key) of the half-open range ``[edge, next edge)`` holding x.

    Values below the first edge get ``< e0`` and values from the last edge on
    ``>= eN``; a NULL stays NULL.
    """
    x = _c(x)

    def item(label: str, key: int) -> Column:
        return F.struct(F.lit(label).alias("bucket"), F.lit(key).alias("sort_key"))

    chain = F.when(x < edges[0], item(f"< {edges[0]}", 0))
    for i in range(len(edges) - 1):
        chain = chain.when(x < edges[i + 1], item(f"{edges[i]} - {edges[i + 1]}", i + 1))
    return chain.when(x >= edges[-1], item(f">= {edges[-1]}", len(edges)))


def pair_diff(a, b, method: str = "control_abs") -> Column:
    """Relative difference of a test value ``a`` and a control value ``b``."""
    a, b = _c(a), _c(b)
    diff = a - b
    if method == "control_abs":
        return safe_divide(diff, F.abs(b))
    if method == "sum_abs":
        return safe_divide(diff, F.abs(a) + F.abs(b))
    if method == "half_sum_abs":
        return 2 * safe_divide(diff, F.abs(a) + F.abs(b))
    if method == "greatest":
        both_zero = (a == 0) & (b == 0)
        share = safe_divide(diff, greatest_strict(F.abs(a), F.abs(b))) * 100
        return F.when(both_zero, F.lit(0.0)).otherwise(share)
    if method == "sign_flip":
        plain = safe_divide(a, b) - 1
        return F.when((a < 0) | (b < 0), -plain).otherwise(plain)
    raise ValueError(f"unknown pair difference method: {method}")
