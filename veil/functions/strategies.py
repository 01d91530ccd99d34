"""The field strategies as column expressions: replace, hash, mask, remove, and the string helpers beside them.

Null and empty values stay as they are under every strategy.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from veil.functions.fakes import fake
from veil.functions.keyed import text

_SHA2 = {"sha224": 224, "sha256": 256, "sha384": 384, "sha512": 512}


def skip_blank(value: Column, changed: Column) -> Column:
    """changed, but null and empty values as they are."""
    return F.when(value.isNull() | (text(value) == ""), text(value)).otherwise(changed)


def hashed(value: Column, algorithm: str = "sha256", salt: str = "") -> Column:
    """Hex digest of ``salt:value``, or of the value; digests that Spark lacks go through Arrow batches."""
    body = F.concat(F.lit(f"{salt}:"), text(value)) if salt else text(value)
    name = algorithm.lower()
    if name in _SHA2:
        return F.sha2(body, _SHA2[name])
    if name in ("md5", "sha1"):
        return F.md5(body) if name == "md5" else F.sha1(body)
    try:
        hashlib.new(name)
    except ValueError as e:
        raise ValueError(f"unknown hash algorithm {algorithm!r}") from e

    @F.pandas_udf("string")
    def digest(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        size = {"shake_128": (32,), "shake_256": (64,)}.get(name, ())
        for part in parts:
            yield part.map(lambda v: None if v is None else hashlib.new(name, v.encode()).hexdigest(*size))

    return digest(body)


def masked(value: Column, mask_char: str = "*", preserve_last: int = 4, preserve_first: int = 0) -> Column:
    """All characters masked but the first and last so many; values no longer than these are masked whole."""
    if preserve_last < 0 or preserve_first < 0:
        raise ValueError("preserve_first and preserve_last can't be negative")
    v, n = text(value), F.length(text(value))
    kept = preserve_first + preserve_last
    middle = F.repeat(F.lit(mask_char), F.greatest(n - F.lit(kept), F.lit(0)))
    last = F.right(v, F.lit(preserve_last)) if preserve_last else F.lit("")
    return F.when(n <= kept, F.repeat(F.lit(mask_char), n)).otherwise(F.concat(F.left(v, F.lit(preserve_first)) if preserve_first else F.lit(""), middle, last))


def removed(kind: DataType | str) -> Column:
    return F.lit(None).cast(kind)


def replaced(value: Column, kind: str | None, *, seed: object = 0, domain: str = "", consistent: bool = True) -> Column:
    """A synthetic value; with consistent=False each occurrence gets one of its own."""
    key = text(value) if consistent else F.concat(text(value), F.lit("|"), F.uuid())
    return fake(kind, seed, domain, key)


def partial_email(value: Column, mask_char: str = "*") -> Column:
    """First and last letter of the local part and the domain stay; without ``@`` the last three characters."""
    v = text(value)
    local, domain = F.regexp_extract(v, r"(?s)^(.*)@[^@]*$", 1), F.substring_index(v, "@", -1)
    n = F.length(local)
    hidden = F.when(n <= 2, F.repeat(F.lit(mask_char), n)).otherwise(F.concat(F.left(local, F.lit(1)), F.repeat(F.lit(mask_char), F.greatest(n - F.lit(2), F.lit(0))), F.right(local, F.lit(1))))
    return F.when(F.instr(v, "@") > 0, F.concat(hidden, F.lit("@"), domain)).otherwise(masked(v, mask_char, 3))


def truncated(value: Column, most: int, suffix: str = "...") -> Column:
    return F.when(F.length(value) > most, F.concat(F.left(value, F.lit(most - len(suffix))), F.lit(suffix))).otherwise(value)


Strategy = Callable[..., Column]
_registered: dict[str, Strategy] = {}


def register_strategy(name: str, make: Strategy) -> None:
    """Adds a strategy of the caller's: make(value, **options) -> Column."""
    _registered[name] = make


def registered_strategies() -> dict[str, Strategy]:
    return dict(_registered)
