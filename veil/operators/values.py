"""Patterns of personal data: what a whole value is, by pattern; what a column is, by name.

Fixed values: the patterns, their confidences and their order are part of what
detection means; the first that fits decides.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
PHONE = r"^(\+?1[-.\s]?)?\(?([0-9]{3})\)?[-.\s]?([0-9]{3})[-.\s]?([0-9]{4})$"
SSN = r"^(?!000|666|9\d{2})\d{3}-?(?!00)\d{2}-?(?!0000)\d{4}$"
CARD = r"^(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|3(?:0[0-5]|[68][0-9])[0-9]{11}|6(?:011|5[0-9]{2})[0-9]{12}|(?:2131|1800|35\d{3})\d{11})$"
IPV4 = r"^(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)$"
IPV6 = r"^(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}$|^::(?:[0-9a-fA-F]{1,4}:){0,6}[0-9a-fA-F]{1,4}$|^[0-9a-fA-F]{1,4}::(?:[0-9a-fA-F]{1,4}:){0,5}[0-9a-fA-F]{1,4}$"
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
URL = r"^https?://(?:[-\w.])+(?:[:\d]+)?(?:/(?:[\w/_.])*(?:\?(?:[\w&=%.])*)?(?:#(?:[\w.])*)?)?$"

VALUE_PATTERNS: tuple[tuple[str, str, float], ...] = (
    ("email", EMAIL, 1.0),
    ("phone", PHONE, 0.9),
    ("ssn", SSN, 0.95),
    ("credit_card", CARD, 0.9),
    ("ipv4", IPV4, 0.85),
    ("ipv6", IPV6, 0.85),
    ("uuid", UUID, 0.8),
    ("url", URL, 0.8),
)

NAME_PATTERNS: tuple[tuple[str, str], ...] = (
    ("email", r"e[-_]?mail"),
    ("phone", r"phone|tel|mobile|cell|fax"),
    ("ssn", r"ssn|social[-_]?security|tax[-_]?id"),
    ("name", r"name|full[-_]?name"),
    ("first_name", r"first[-_]?name|fname|given[-_]?name"),
    ("last_name", r"last[-_]?name|lname|surname|family[-_]?name"),
    ("address", r"address|street|addr"),
    ("city", r"city|town"),
    ("country", r"country|nation"),
    ("zip", r"zip|postal[-_]?code|postcode"),
    ("credit_card", r"credit[-_]?card|cc[-_]?num|card[-_]?num"),
    ("ip_address", r"ip[-_]?addr|ip[-_]?address|remote[-_]?ip"),
    ("date_of_birth", r"dob|date[-_]?of[-_]?birth|birth[-_]?date|birthday"),
    ("password", r"password|passwd|pwd"),
    ("username", r"user[-_]?name|login|user[-_]?id|userid"),
)
NAME_CONFIDENCE = 0.7

#: Java's ``$`` and classes as Python has them: only \n ends a line, classes know Unicode.
JAVA = "(?dU)"
#: With strict names, more particular types go before the general ones that contain them.
STRICT_FIRST = ("first_name", "last_name", "username", "ip_address")


@dataclass(frozen=True)
class Patterns:
    """The patterns in force; ``with_pattern`` adds one, or changes one in its place."""

    values: tuple[tuple[str, str, float], ...] = VALUE_PATTERNS
    names: tuple[tuple[str, str], ...] = NAME_PATTERNS
    check_names: bool = True
    strict_names: bool = False
    threshold: float = 0.5

    def with_pattern(self, kind: str, pattern: str, confidence: float = 0.8) -> Patterns:
        re.compile(pattern)
        new = (kind, pattern, confidence)
        held = any(k == kind for k, _, _ in self.values)
        values = tuple(new if k == kind else (k, p, c) for k, p, c in self.values) if held else (*self.values, new)
        return Patterns(values, self.names, self.check_names, self.strict_names, self.threshold)

    def supported(self) -> list[str]:
        return sorted({k for k, _, _ in self.values} | {k for k, _ in self.names})

    def confidence(self, kind: str) -> float:
        return next((c for k, _, c in self.values if k == kind), NAME_CONFIDENCE)

    def value_type(self, value: Column) -> Column:
        """The type of a value, null if none fits; patterns are tried in order."""
        return F.coalesce(*(F.when(value.rlike(JAVA + p), F.lit(k)) for k, p, _ in self.values))

    def name_type(self, name: str) -> str | None:
        plain = normalized(name)
        order = sorted(self.names, key=lambda n: n[0] not in STRICT_FIRST) if self.strict_names else self.names
        return next((k for k, p in order if re.search(p, plain, re.IGNORECASE)), None) if self.check_names else None


def normalized(name: str) -> str:
    return name.lower().strip().replace(" ", "_")


@dataclass(frozen=True)
class Keywords:
    """Words in column names for the heuristic detector, by category, and its thresholds (fixed values)."""

    words: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "personal": ("name", "email", "phone", "address", "birth", "age", "gender"),
            "financial": ("account", "card", "bank", "routing", "swift", "iban"),
            "identification": ("ssn", "social", "tax", "passport", "license", "id"),
            "contact": ("email", "phone", "mobile", "fax", "contact"),
            "location": ("address", "city", "state", "zip", "postal", "country", "coordinates"),
        }
    )
    entropy: float = 3.5
    unique: float = 0.9
    threshold: float = 0.5

    def adding(self, category: str, *words: str) -> Keywords:
        return Keywords({**self.words, category: (*self.words.get(category, ()), *words)}, self.entropy, self.unique, self.threshold)

    def score(self, name: str) -> float:
        plain = name.lower().replace("_", "").replace("-", "")
        first = next((w for words in self.words.values() for w in words if w in plain), None)
        return 0.0 if first is None else 0.9 if first == plain else 0.7


#: Parts of column names, in order, with the type that they tell.
TYPE_PARTS: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("identifier", ("id", "uuid", "guid")),
    ("name", ("name", "first", "last")),
    ("email", ("email", "mail")),
    ("phone", ("phone", "tel", "mobile", "fax")),
    ("address", ("address", "street", "city", "zip")),
    ("ssn", ("ssn", "social", "tax")),
    ("financial", ("card", "account", "bank")),
)


def inferred_type(name: str, reasons: list[str]) -> str:
    plain = name.lower()
    known = next((kind for kind, parts in TYPE_PARTS if any(p in plain for p in parts)), None)
    return known or ("identifier" if {"high_entropy", "high_uniqueness"} & set(reasons) else "unknown")
