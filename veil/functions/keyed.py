"""Keyed hashing of columns: what makes synthetic values and noise a function of the data alone.

Everything here is a pure expression, so equal values have equal results in any
row, table, partition or run, without shared state and without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text(value: Column) -> Column:
    return value.cast("string")


def number(seed: object, domain: str, value: Column, salt: int = 0) -> Column:
    """52 bits of md5 over seed, domain, salt and value."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|{domain}|{salt}|"), text(value))), 1, 13), 16, 10).cast("long")


def below(seed: object, domain: str, value: Column, n: int, salt: int = 0) -> Column:
    """An integer from 0 to n - 1."""
    return number(seed, domain, value, salt) % F.lit(n)


def uniform(seed: object, domain: str, value: Column, salt: int = 0) -> Column:
    """A number strictly between 0 and 1."""
    return (number(seed, domain, value, salt).cast("double") + F.lit(0.5)) / F.lit(2.0**52)


def digits(seed: object, domain: str, value: Column, n: int, salt: int = 0) -> Column:
    """n decimal digits, twelve from each hash."""
    parts = []
    for i in range(0, n, 12):
        size = min(12, n - i)
        parts.append(F.lpad(below(seed, domain, value, 10**size, salt * 100 + i).cast("string"), size, "0"))
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def hexes(seed: object, domain: str, value: Column, n: int, salt: int = 0) -> Column:
    """n hex digits, at most 32."""
    return F.substring(F.md5(F.concat(F.lit(f"{seed}|{domain}|{salt}|"), text(value))), 1, n)


def pick(options: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*(F.lit(x) for x in options)), (index % F.lit(len(options)) + 1).cast("int"))


def choice(seed: object, domain: str, value: Column, options: tuple[str, ...], salt: int = 0) -> Column:
    return pick(options, number(seed, domain, value, salt))
