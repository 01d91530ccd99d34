"""Personal data inside free text: all finds of a kind, and their removal.

Fixed values: the patterns.  A projection matches them, each in a scan of the text
of its own; cheap tests go before costly patterns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Unicode-aware word boundaries and classes, as in Python.
JAVA = "(?dU)"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
PHONES = (
    r"\b\d{3}-\d{3}-\d{4}\b",
    r"\(\d{3}\)\s*\d{3}-\d{4}",
    r"\b\d{3}\.\d{3}\.\d{4}\b",
    r"\b\d{10}\b",
    r"\+1[-.\s]?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}",
)
SSN = r"\b(?!000|666|9\d{2})\d{3}-?(?!00)\d{2}-?(?!0000)\d{4}\b"
CARDS = {
    "visa": r"\b4\d{3}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b",
    "mastercard": r"\b5[1-5]\d{2}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b",
    "amex": r"\b3[47]\d{2}[-\s]?\d{6}[-\s]?\d{5}\b",
    "discover": r"\b6(?:011|5\d{2})[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b",
}
IPV4 = r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b"


def _all(text: Column, *patterns: str) -> Column:
    found = [F.regexp_extract_all(text, F.lit(JAVA + p), F.lit(0)) for p in patterns]
    return found[0] if len(found) == 1 else F.concat(*found)


def _none() -> Column:
    return F.array().cast("array<string>")


def find_emails(text: Column) -> Column:
    """In order of place, with repeats."""
    return F.when(F.instr(text, "@") > 0, _all(text, EMAIL)).otherwise(_none())


def find_phones(text: Column) -> Column:
    """Distinct, sorted."""
    return F.when(text.rlike(JAVA + r"\d{3}"), F.array_sort(F.array_distinct(_all(text, *PHONES)))).otherwise(_none())


def find_ssns(text: Column) -> Column:
    return F.when(text.rlike(JAVA + r"\d{3}"), _all(text, SSN)).otherwise(_none())


def find_cards(text: Column, valid_only: bool = False) -> Column:
    """Distinct, sorted; valid_only: those alone that pass the Luhn test."""
    from veil.functions.codecs import luhn

    found = F.when(text.rlike(JAVA + r"\d{4}"), F.array_sort(F.array_distinct(_all(text, *CARDS.values())))).otherwise(_none())
    return F.filter(found, lambda c: luhn(F.regexp_replace(c, r"\D", ""))) if valid_only else found


def find_ips(text: Column) -> Column:
    return F.when(F.instr(text, ".") > 0, _all(text, IPV4)).otherwise(_none())


REDACTIONS: tuple[tuple[str, str], ...] = (
    (EMAIL, "[EMAIL]"),
    *((p, "[CARD]") for p in CARDS.values()),
    (PHONES[4], "[PHONE]"),
    *((p, "[PHONE]") for p in PHONES[:4]),
    (SSN, "[SSN]"),
    (IPV4, "[IP]"),
)


def redacted(text: Column, redactions: tuple[tuple[str, str], ...] = REDACTIONS) -> Column:
    """Every find replaced by its mark; texts without digits or ``@`` aren't searched."""
    out = text
    for pattern, mark in redactions:
        out = F.regexp_replace(out, JAVA + pattern, mark)
    return F.when(text.rlike(JAVA + r"[@\d]"), out).otherwise(text)


#: Finders by kind.
FINDERS = {"email": find_emails, "phone": find_phones, "ssn": find_ssns, "credit_card": find_cards, "ip_address": find_ips}


def finds(df: DataFrame, text: str, *keep: str, kinds: tuple[str, ...] = tuple(FINDERS)) -> DataFrame:
    """The kept columns, kind and value: a row for each find in a text column."""
    column = F.col(f"`{text}`")
    rows = lambda kind: F.transform(FINDERS[kind](column), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    found = [rows(k) for k in kinds]
    return df.select(*(F.col(f"`{c}`") for c in keep), F.inline(F.concat(*(F.coalesce(f, F.array().cast("array<struct<kind:string,value:string>>")) for f in found))))
