"""Column helpers: every one returns a built-in expression, none of them a UDF."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def lookup(mapping: Mapping, key: Column, default: Column | None = None) -> Column:
    """Fixed table lookup as a CASE, so a configuration table never needs a join."""
    out = None
    for k, v in mapping.items():
        value = v if isinstance(v, Column) else F.lit(v)
        out = F.when(key == F.lit(k), value) if out is None else out.when(key == F.lit(k), value)
    if out is None:
        return default if default is not None else F.lit(None)
    return out if default is None else out.otherwise(default)


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """NULL stays NULL: ``least`` and ``greatest`` alone would turn an absent value into a bound."""
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def z_score(value: Column, mean: Column, stdev: Column) -> Column:
    return F.when(stdev != 0, (value - mean) / stdev).otherwise(F.lit(0.0))


def reaches(c: Column, threshold) -> Column:
    """``c >= threshold`` on values whose last bits depend on the order of a distributed sum."""
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return F.round(c, 9) >= F.round(limit, 9)


def settled(c: Column, digits: int) -> Column:
    """Round in two steps, so that a decimal tie does not depend on the last bits of a sum."""
    return F.round(F.round(c.cast("double"), 10), digits)


def fixed(c: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", settled(c, digits))


def shortest(c: Column, digits: int) -> Column:
    """Rounded, without trailing zeros but always with one decimal: 1.4, 0.1667, 1.0."""
    return F.regexp_replace(F.regexp_replace(fixed(c, digits), "0+$", ""), r"\.$", ".0")


def signed(c: Column, digits: int) -> Column:
    return F.format_string(f"%+.{digits}f", settled(c, digits))


def percent(c: Column) -> Column:
    """Whole percent; halves go to the even neighbour."""
    return F.concat(F.rint(F.round(c * 100, 9)).cast("bigint").cast("string"), F.lit("%"))


def total(array: Column, term) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda acc, x: acc + term(x))


def strings(values: Iterable[str]) -> Column:
    items = [F.lit(v) for v in values]
    return F.array(*items) if items else F.array().cast("array<string>")


def present(*items: Column) -> Column:
    """Array of the items that are not NULL, in order."""
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def contains_any(text: Column, needles: Iterable[str]) -> Column:
    out = F.lit(False)
    for needle in needles:
        out = out | text.contains(needle)
    return out


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it many times, also inside lambdas of ``body``.

    Lambda bodies have no common-subexpression elimination: an expression named in one is computed
    again for every element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def hmac_sha256(secret: str, message: Column) -> Column:
    """HMAC-SHA256 in hex, composed from ``sha2`` so that it stays inside code generation."""
    key = secret.encode()
    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\0")
    inner = F.lit(bytearray(b ^ 0x36 for b in key))
    outer = F.lit(bytearray(b ^ 0x5C for b in key))
    digest = F.sha2(F.concat(inner, message.cast("binary")), 256)
    return F.sha2(F.concat(outer, F.unhex(digest)), 256)


def keyed_uniform(secret: str, *parts: Column) -> Column:
    """Uniform in (0, 1), fixed by its key: a retried task draws the same noise again."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    head = F.substring(hmac_sha256(secret, text), 1, 13)
    return (F.conv(head, 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def laplace(scale: Column, uniform: Column) -> Column:
    u = uniform - 0.5
    return -scale * F.signum(u) * F.log(1 - 2 * F.abs(u))
