"""Codecs: anonymization that knows a type's shape.

The plain family (``*_simple``) rewrites values of its shape and leaves others
alone.  The rich family gives a struct of value, original_type, strategy_used
and metadata, and takes six strategies.  Synthetic values are functions of the
value and a seed.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veil.errors import PolicyError
from veil.functions.fakes import GENERATORS, luhn_digit
from veil.functions.keyed import choice, digits, let
from veil.functions.strategies import hashed, masked
from veil.operators.values import EMAIL, JAVA, PHONE

#: Fixed values.
DISPOSABLE = ("guerrillamail.com", "mailinator.com", "tempmail.com", "throwaway.com", "yopmail.com")
COUNTRY_CODES = {"1": "US", "44": "UK", "49": "DE", "33": "FR", "39": "IT", "34": "ES", "31": "NL", "41": "CH", "43": "AT", "32": "BE"}
PHONE_SHAPES = (
    PHONE,
    r"^(\+?44[-.\s]?)?0?([0-9]{2,4})[-.\s]?([0-9]{3,4})[-.\s]?([0-9]{3,4})$",
    r"^(\+?[0-9]{1,3})[-.\s]?([0-9]{1,4})[-.\s]?([0-9]{2,4})[-.\s]?([0-9]{2,4})$",
    r"^[+]?[0-9\s.-]{7,20}$",
)
SSN_SHAPE = r"^(?!000|666|9\d{2})([0-8]\d{2}|7[0-2]0)-?(?!00)(\d{2})-?(?!0000)(\d{4})$"
SSN_INVALID = ("078-05-1120", "219-09-9999", "457-55-5462")


def only_digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def md5_modulo(value: Column, n: int) -> Column:
    """The 128-bit md5 of a string modulo n, eight hex digits at a time."""
    h = F.md5(value)
    return reduce(lambda rest, i: (rest * F.lit(1 << 32) + F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("long")) % n, range(4), F.lit(0).cast("long"))


# --- checks ---------------------------------------------------------------


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn test; other strings don't."""
    n = F.length(number)

    def part(i: Column) -> Column:
        d = F.substring(number, n - i, F.lit(1)).cast("long")
        return F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    total = F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), part), F.lit(0).cast("long"), lambda a, x: a + x)
    return F.when(number.rlike(r"^[0-9]+$"), total % 10 == 0).otherwise(False)


def valid_email(value: Column) -> Column:
    v = F.trim(value)
    return v.rlike(JAVA + EMAIL) & ~F.split(v, "@")[0].contains("..")


def valid_phone(value: Column) -> Column:
    plain = F.regexp_replace(value, r"[\s.-]", "")
    return reduce(lambda a, b: a | b, (v.rlike(JAVA + p) for p in PHONE_SHAPES for v in (value, plain)))


def valid_ssn(value: Column) -> Column:
    """By shape and ranges, without the known invalid numbers."""
    plain = F.regexp_replace(value, "[- ]", "")
    shown = F.concat_ws("-", F.substring(plain, 1, 3), F.substring(plain, 4, 2), F.substring(plain, 6, 4))
    return plain.rlike(r"^\d{9}$") & ~shown.isin(*SSN_INVALID) & F.trim(value).rlike(JAVA + SSN_SHAPE)


def ssn_in_range(value: Column) -> Column:
    """By ranges of the three parts alone."""
    d = only_digits(value)
    return F.when(F.length(d) == 9, ~F.substring(d, 1, 3).isin("000", "666") & (F.substring(d, 1, 1) != "9") & (F.substring(d, 4, 2) != "00") & (F.substring(d, 6, 4) != "0000")).otherwise(False)


def is_disposable(value: Column) -> Column:
    return F.when(F.instr(value, "@") > 0, F.lower(F.split(value, "@")[1]).isin(*DISPOSABLE)).otherwise(False)


def card_type(value: Column) -> Column:
    d = only_digits(value)
    return F.when(d.startswith("4"), "visa").when(d.rlike("^5[1-5]"), "mastercard").when(d.rlike("^3[47]"), "amex").when(d.rlike("^(6011|65)"), "discover").when(d != "", "unknown")


# --- the plain family -----------------------------------------------------


def email_simple(value: Column, strategy: str = "replace") -> Column:
    local, domain = F.regexp_extract(value, r"(?s)^(.*)@[^@]*$", 1), F.substring_index(value, "@", -1)
    n = F.length(local)
    made = {
        "hash": F.concat(F.left(F.sha2(value, 256), F.lit(16)), F.lit("@hashed")),
        "mask": F.concat(F.when(n <= 2, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.left(local, F.lit(1)), F.repeat(F.lit("*"), n - 1))), F.lit("@"), domain),
        "domain_only": F.concat(F.lit("***@"), domain),
    }.get(strategy, F.concat(F.lit("user"), md5_modulo(local, 10_000).cast("string"), F.lit("@example.com")))
    return F.when(F.instr(value, "@") > 0, made).otherwise(value)


def phone_digits(value: Column) -> Column:
    """The ten digits of a number of that length, or of eleven with a leading 1; else null."""
    d = only_digits(value)
    d = F.when((F.length(d) == 11) & d.startswith("1"), F.substring(d, 2, 10)).otherwise(d)
    return F.when(F.length(d) == 10, d)


def phone_simple(value: Column, strategy: str = "replace") -> Column:
    d = phone_digits(value)
    made = {
        "hash": F.left(F.sha2(value, 256), F.lit(10)),
        "mask": F.concat(F.lit("(***) ***-"), F.substring(d, 7, 4)),
        "last4": F.concat(F.lit("****-****-"), F.substring(d, 7, 4)),
    }.get(strategy, F.concat(F.lit("(555) "), (md5_modulo(d, 900) + 100).cast("string"), F.lit("-"), F.lpad(md5_modulo(F.concat(d, F.lit("salt")), 10_000).cast("string"), 4, "0")))
    return F.when(d.isNotNull(), made).otherwise(value)


def _seeded(n: str) -> random.Random:
    return random.Random(int(hashlib.md5(n.encode()).hexdigest(), 16))


def _twister(make: Callable[[str], str]) -> Callable[[Column], Column]:
    """A replacement that needs Python's own random numbers, over Arrow batches.

    It takes the value as it is and says itself what is valid.  Spark can't run one whose input has higher-order functions in it; ``seeded`` computes such an input first.
    """

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda v: None if v is None else make(v))

    return run


def _ascii_digits(v: str) -> str:
    return re.sub(r"[^0-9]", "", v)


def _luhn_sum(n: str) -> int:
    """Of the digits, every second one from the last but one on doubled."""
    doubled = (int(c) * (1 + i % 2) for i, c in enumerate(reversed(n)))
    return sum(d - 9 if d > 9 else d for d in doubled)


def _twister_ssn(v: str) -> str:
    n = _ascii_digits(v)
    if len(n) != 9:
        return v
    rng = _seeded(n)
    area = rng.choice([f"{i:03d}" for i in range(1, 900) if i != 666])
    return f"{area}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}"


def _twister_card(v: str) -> str:
    n = _ascii_digits(v)
    if not 12 <= len(n) <= 19 or _luhn_sum(n) % 10:
        return v
    rng = _seeded(n)
    lead = f"5{rng.randint(1, 5)}" if n[0] == "5" else "4"
    body = lead + "".join(str(rng.randint(0, 9)) for _ in range(16 - len(lead)))
    body = body[:15]
    whole = body + str(-_luhn_sum(body + "0") % 10)
    return "-".join(whole[i : i + 4] for i in range(0, 16, 4))


def ssn_simple(value: Column, strategy: str = "mask", twister: bool = False) -> Column:
    """twister: replacements from Python's seeded generator; else from keyed hashes."""
    d = only_digits(value)
    if strategy == "replace" and twister:
        return _twister(_twister_ssn)(value)
    if strategy == "replace":
        made = GENERATORS["ssn"](0, "ssn", d)
    else:
        made = {
            "hash": F.concat(F.lit("SSN-"), F.upper(F.left(F.sha2(value, 256), F.lit(12)))),
            "last4": F.concat(F.lit("****-****-"), F.substring(d, 6, 4)),
            "invalid": F.concat(F.lit("000-"), F.substring(d, 4, 2), F.lit("-"), F.substring(d, 6, 4)),
        }.get(strategy, F.concat(F.lit("XXX-XX-"), F.substring(d, 6, 4)))
    return F.when(F.length(d) == 9, made).otherwise(value)


def card_simple(value: Column, strategy: str = "mask", *, key: str | None = None, twister: bool = False) -> Column:
    """Cards of 12 to 19 digits that pass the Luhn test; key: for reversible tokens (16, 24 or 32 bytes).

    The key is a literal of the plan, so whoever may read plans or event logs may read it.
    """
    d = only_digits(value)
    hidden = F.concat(F.when(F.length(d) == 15, F.lit("XXXX-XXXXXX-X")).otherwise(F.lit("XXXX-XXXX-XXXX-")), F.right(d, F.lit(4)))
    if strategy == "replace" and twister:
        return _twister(_twister_card)(value)
    if strategy == "replace":
        lead = F.when(d.startswith("5"), F.concat(F.lit("5"), choice(0, "card", d, ("1", "2", "3", "4", "5")))).otherwise(F.concat(F.lit("4"), digits(0, "card", d, 1, 1)))
        body = F.concat(lead, digits(0, "card", d, 13, 2))
        whole = let(body, lambda b: F.concat(b, luhn_digit(b, 15)))
        made = F.concat_ws("-", *(F.substring(whole, 1 + 4 * i, 4) for i in range(4)))
    elif strategy == "token" and key:
        # the first twelve hex digits of the number's hash as nonce: one number has one token
        nonce = F.unhex(F.left(F.sha2(F.concat(F.lit(key), d), 256), F.lit(24)))
        made = F.concat(F.lit("TKN-"), F.base64(F.aes_encrypt(d, F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), nonce)))
    else:
        made = {"hash": F.concat(F.lit("CARD-"), F.upper(F.left(F.sha2(value, 256), F.lit(16)))), "last4": F.right(d, F.lit(4))}.get(strategy, hidden)
    return F.when(F.length(d).between(12, 19) & luhn(d), made).otherwise(value)


def card_from_token(token: Column, key: str) -> Column:
    return F.aes_decrypt(F.unbase64(F.substring(token, 5, 1 << 20)), F.lit(key), F.lit("GCM")).cast("string")


# --- the rich family ------------------------------------------------------


def applied_format(template: Column, filler: Column) -> Column:
    """The letters and digits of template replaced, one after another, by filler's characters; what is left of the filler follows."""
    chars = F.filter(F.split(template, ""), lambda c: c != "")
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("used"))

    def put(state: Column, c: Column) -> Column:
        use = c.rlike(r"(?U)[\p{L}\p{N}]") & (state["used"] < F.length(filler))
        return F.struct(
            F.concat(state["out"], F.when(use, F.substring(filler, state["used"] + 1, F.lit(1))).otherwise(c)).alias("out"),
            F.when(use, state["used"] + 1).otherwise(state["used"]).alias("used"),
        )

    return F.aggregate(chars, start, put, lambda s: F.concat(s["out"], F.substring(filler, s["used"] + 1, F.length(filler))))


def hidden_digits(value: Column, mask_char: str = "*", keep: int = 4) -> Column:
    """Digits masked but the last so many; other characters stay."""
    return F.regexp_replace(value, r"\d(?=(?:\D*\d){%d})" % keep, mask_char.replace("\\", "\\\\").replace("$", "\\$"))


def country_code(value: Column) -> Column:
    """The known country code of a number, longest first; 1 for eleven digits with a leading 1; else empty."""
    plain = F.regexp_replace(value, r"[^\d+]", "")
    code = F.lit("")
    for c in sorted(COUNTRY_CODES, key=len):
        code = F.when(F.substring(plain, 2, len(c)) == c, F.lit(c)).otherwise(code)
    return F.when(plain.startswith("+"), code).when(plain.startswith("1") & (F.length(plain) == 11), F.lit("1")).otherwise(F.lit(""))


class Codec:
    """Base of the rich family; subclasses say what is valid and how a synthetic value looks."""

    kind = ""
    default = "replace"

    def __init__(self, seed: object = 0) -> None:
        self.seed = seed

    def valid(self, value: Column) -> Column:
        raise NotImplementedError

    def fake(self, value: Column, **options: Any) -> Column:
        raise NotImplementedError

    def replace(self, value: Column, **options: Any) -> Column:
        return self.fake(value, **options)

    def hash(self, value: Column, algorithm: str = "sha256", salt: str = "", **_: Any) -> Column:
        return hashed(value, algorithm, salt)

    def mask(self, value: Column, mask_char: str = "*", preserve_first: int = 0, preserve_last: int = 4, **_: Any) -> Column:
        return masked(value, mask_char, preserve_last, preserve_first)

    def preserve_format(self, value: Column, **options: Any) -> Column:
        return applied_format(value, F.regexp_replace(self.fake(value, **options), r"[^\p{L}\p{N}]", ""))

    def deterministic(self, value: Column, **options: Any) -> Column:
        return type(self)("deterministic").fake(value, **options)

    def remove(self, value: Column, **_: Any) -> Column:
        return F.lit("")

    def anonymize(self, value: Column, strategy: str | None = None, **options: Any) -> Column:
        """struct(value, original_type, strategy_used, metadata); empty values come back with strategy none."""
        name = (strategy or self.default).lower()
        if name not in ("replace", "hash", "mask", "remove", "preserve_format", "deterministic"):
            raise PolicyError(f"unknown strategy {name!r}")
        made = getattr(self, name)(value, **options)
        blank = value.isNull() | (value == "")
        facts = F.create_map(F.lit("was_valid"), self.valid(value).cast("string"), F.lit("original_length"), F.length(value).cast("string"))
        return F.struct(
            F.when(blank, F.coalesce(value, F.lit(""))).otherwise(made).alias("value"),
            F.lit(self.kind).alias("original_type"),
            F.when(blank, "none").otherwise(name).alias("strategy_used"),
            F.when(blank, F.create_map(F.lit("error"), F.lit("empty_or_invalid_value"))).otherwise(facts).alias("metadata"),
        )


class EmailCodec(Codec):
    kind = "email"

    def valid(self, value: Column) -> Column:
        return valid_email(value)

    def fake(self, value: Column, preserve_domain: bool = False, preserve_tld: bool = False, **_: Any) -> Column:
        local = GENERATORS["username"](self.seed, self.kind, value)
        if preserve_domain:
            domain = F.when(F.instr(value, "@") > 0, F.substring_index(value, "@", -1)).otherwise("example.com")
        elif preserve_tld:
            own = F.substring_index(value, "@", -1)
            domain = F.concat(F.lit("example."), F.when(F.instr(own, ".") > 0, F.substring_index(own, ".", -1)).otherwise("com"))
        else:
            domain = choice(self.seed, self.kind, value, ("example.com", "example.org", "example.net", "mail.example"), 7)
        return F.concat(local, F.lit("@"), domain)

    def mask(self, value: Column, mask_char: str = "*", **_: Any) -> Column:
        local = F.regexp_extract(value, r"(?s)^(.*)@[^@]*$", 1)
        return F.when(F.instr(value, "@") > 0, F.concat(F.repeat(F.lit(mask_char), F.length(local)), F.lit("@"), F.substring_index(value, "@", -1))).otherwise(F.repeat(F.lit(mask_char), F.length(value)))


class PhoneCodec(Codec):
    kind = "phone"

    def valid(self, value: Column) -> Column:
        return valid_phone(value)

    def fake(self, value: Column, preserve_country: bool = False, **_: Any) -> Column:
        d = digits(self.seed, self.kind, value, 10)
        us = F.concat(F.lit("("), F.substring(d, 1, 3), F.lit(") "), F.substring(d, 4, 3), F.lit("-"), F.substring(d, 7, 4))
        code = country_code(value) if preserve_country else F.lit("1")
        code = F.when(code == "", F.lit("1")).otherwise(code)
        uk = F.concat(F.lit("20 "), F.substring(d, 1, 4), F.lit(" "), F.substring(d, 5, 4))
        return F.concat(F.lit("+"), code, F.lit(" "), F.when(code == "1", us).when(code == "44", uk).otherwise(d))

    def replace(self, value: Column, preserve_country: bool = False, preserve_format: bool = True, **options: Any) -> Column:
        if preserve_country or not preserve_format:
            return self.fake(value, preserve_country=preserve_country)
        return self.preserve_format(value)

    def preserve_format(self, value: Column, **_: Any) -> Column:
        """Digits alone are replaced, so the result is as long as the value."""
        chars = F.filter(F.split(value, ""), lambda c: c != "")
        stream = digits(self.seed, self.kind, value, 24)
        start = F.struct(F.lit("").alias("out"), F.lit(0).alias("used"))
        step = lambda s, c: F.struct(F.concat(s["out"], F.when(c.rlike(r"\d"), F.substring(stream, s["used"] % 24 + 1, F.lit(1))).otherwise(c)).alias("out"), (s["used"] + c.rlike(r"\d").cast("int")).alias("used"))
        return F.aggregate(chars, start, step, lambda s: s["out"])

    def mask(self, value: Column, mask_char: str = "*", preserve_country: bool = False, **_: Any) -> Column:
        if not preserve_country:
            return hidden_digits(value, mask_char)
        code = country_code(value)
        prefix = F.concat(F.lit("+"), code, F.lit(" "))
        after = F.substring(value, F.instr(value, "+") + F.length(code) + 1, F.length(value))
        local = F.when(F.startswith(value, prefix), F.substring(value, F.length(prefix) + 1, F.length(value))).otherwise(after)
        return F.when(code != "", F.concat(prefix, hidden_digits(local, mask_char))).otherwise(hidden_digits(value, mask_char))


class SSNCodec(Codec):
    kind = "ssn"
    default = "mask"

    def valid(self, value: Column) -> Column:
        return valid_ssn(value)

    def fake(self, value: Column, **_: Any) -> Column:
        return GENERATORS["ssn"](self.seed, self.kind, value)

    def mask(self, value: Column, mask_char: str = "*", **_: Any) -> Column:
        d = only_digits(value)
        return F.when(F.length(d) == 9, F.concat(F.lit(f"{mask_char * 3}-{mask_char * 2}-"), F.substring(d, 6, 4))).otherwise(F.repeat(F.lit(mask_char), F.length(value)))

    def hash(self, value: Column, algorithm: str = "sha256", salt: str = "", **_: Any) -> Column:
        return hashed(F.concat(F.lit("ssn:"), value), algorithm, salt)


_codecs: dict[str, type[Codec]] = {"email": EmailCodec, "phone": PhoneCodec, "ssn": SSNCodec}


def codec(kind: str, seed: object = 0) -> Codec:
    if kind.lower() not in _codecs:
        raise PolicyError(f"unknown type {kind!r}", f"Types: {', '.join(sorted(_codecs))}.")
    return _codecs[kind.lower()](seed)


def register_codec(kind: str, made: type[Codec]) -> None:
    if not (isinstance(made, type) and issubclass(made, Codec)):
        raise TypeError("a codec is a subclass of Codec")
    _codecs[kind.lower()] = made


def seeded(df: DataFrame, kind: str, value: Column, name: str) -> DataFrame:
    """df with a column of replacements (ssn or credit_card) of any expression by Python's seeded generator; the value is computed before, in a row's own one-element list that the optimizer doesn't merge into the call."""
    stored = df.select("*", F.explode(F.array(value)).alias(name))
    return stored.withColumn(name, SIMPLE[kind](F.col(f"`{name}`"), "replace", twister=True))


#: The plain family by type.
SIMPLE: dict[str, Callable[..., Column]] = {"email": email_simple, "phone": phone_simple, "ssn": ssn_simple, "credit_card": card_simple}
