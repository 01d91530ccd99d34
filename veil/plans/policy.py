"""Policies: which field gets which strategy, compiled to column expressions.

A policy is a value.  Compiled against a schema it gives one expression a field,
so a dataset is rewritten by one projection whatever the number of rules.
"""

from __future__ import annotations

import logging
from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from veil.errors import PolicyError
from veil.functions.strategies import hashed, masked, registered_strategies, removed, replaced, skip_blank

log = logging.getLogger(__name__)
STRATEGIES = ("replace", "hash", "mask", "remove")


def validate(config: Any) -> list[str]:
    """What is wrong with a policy's dict, an entry for each fault."""
    if not isinstance(config, Mapping):
        return ["policy must be a dictionary"]
    known = {*STRATEGIES, *registered_strategies()}
    out = []
    for name, rule in config.items():
        if not isinstance(rule, Mapping):
            out.append(f"{name}: a rule must be a dictionary")
        elif not rule.get("strategy"):
            out.append(f"{name}: the rule names no strategy")
        elif rule["strategy"] not in known:
            out.append(f"{name}: no strategy {rule['strategy']!r}; there are {', '.join(sorted(known))}")
    return out


def merge(base: Mapping[str, Any], override: Mapping[str, Any]) -> dict[str, Any]:
    """base with override's entries; dicts are merged at any depth."""
    out = dict(base)
    for key, value in override.items():
        both = isinstance(out.get(key), Mapping) and isinstance(value, Mapping)
        out[key] = merge(out[key], value) if both else value
    return out


#: Locales that generators have values for.
LOCALES = ("en_US", "en")


@dataclass(frozen=True)
class Rule:
    strategy: str
    type: str | None = None
    options: Mapping[str, Any] = field(default_factory=dict)
    #: Applied only to rows for which this holds.
    where: Column | None = None

    @classmethod
    def of(cls, settings: Mapping[str, Any]) -> Rule:
        rest = {k: v for k, v in settings.items() if k not in ("strategy", "type", "where", "options")}
        return cls(settings.get("strategy", ""), settings.get("type"), {**settings.get("options", {}), **rest}, settings.get("where"))


@dataclass(frozen=True)
class Policy:
    """Rules by field.  domain="field" gives each field synthetic values of its own; any other domain is shared by all fields, so one value has one replacement everywhere."""

    rules: Mapping[str, Rule]
    seed: object = 0
    consistent: bool = True
    domain: str = "field"
    locale: str = "en_US"
    strict: bool = False

    @classmethod
    def of(cls, config: Mapping[str, Mapping[str, Any]], **options: Any) -> Policy:
        """From a dict; raises PolicyError with every fault if strict, else unknown strategies leave their field alone."""
        faults = validate(config)
        if faults and (options.get("strict") or not isinstance(config, Mapping) or any(not isinstance(r, Mapping) for r in config.values())):
            raise PolicyError("; ".join(faults))
        return cls({name: Rule.of(rule) for name, rule in config.items()}, **options)

    def __post_init__(self) -> None:
        if self.locale not in LOCALES:
            raise PolicyError(f"no values for locale {self.locale!r}", f"Locales: {', '.join(LOCALES)}.")

    def configure(self, *, locale: str | None = None, preserve_relationships: bool | None = None, seed: object = None) -> Policy:
        """A policy with some settings changed; calls can be chained."""
        new = {"locale": locale, "consistent": preserve_relationships, "seed": seed}
        return replace(self, **{k: v for k, v in new.items() if v is not None})

    def stats(self) -> dict[str, Any]:
        return {"cached_values": 0, "locale": self.locale, "preserve_relationships": self.consistent}

    def clear_cache(self) -> Policy:
        """Nothing is kept between rows or runs; there for callers that expect it."""
        return self

    def value(self, rule: Rule, value: Column, name: str, kind: Any) -> Column:
        """What a rule makes of one value."""
        o = dict(rule.options)
        if rule.strategy == "replace":
            made = replaced(value, rule.type, seed=self.seed, domain=name if self.domain == "field" else self.domain, consistent=o.get("consistent", self.consistent))
        elif rule.strategy == "hash":
            made = hashed(value, o.get("algorithm", "sha256"), o.get("salt", ""))
        elif rule.strategy == "mask":
            made = masked(value, o.get("mask_char", "*"), o.get("preserve_last", 4), o.get("preserve_first", 0))
        elif rule.strategy == "remove":
            blank = value.isNull() | (value.cast("string") == "")
            return F.when(blank, value).otherwise(removed(kind))
        elif rule.strategy in registered_strategies():
            made = registered_strategies()[rule.strategy](value, **o)
        else:
            log.warning("field %s: unknown strategy %r; values stay", name, rule.strategy)
            return value
        return skip_blank(value, made)

    def columns(self, schema: StructType) -> dict[str, Column]:
        """An expression for each rule whose field the schema has; others are skipped."""
        out = {}
        for name, rule in self.rules.items():
            if name not in schema.names:
                log.warning("no column %r; its rule is skipped", name)
                continue
            column = F.col(f"`{name}`")
            made = self.value(rule, column, name, schema[name].dataType)
            if rule.where is not None:
                made = F.when(rule.where, made).otherwise(column if rule.strategy == "remove" else column.cast("string"))
            out[name] = made
        return out

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumns(self.columns(df.schema)) if self.rules else df


def apply_tables(tables: Mapping[str, DataFrame], policies: Mapping[str, Policy | Mapping[str, Any]], **options: Any) -> dict[str, DataFrame]:
    """A policy for each table; a shared domain keeps values equal across tables."""
    return {name: (p if isinstance(p, Policy) else Policy.of(p, **options)).apply(tables[name]) for name, p in policies.items()}


def erase(df: DataFrame, user: str, user_id: Any, *, hashed_fields: tuple[str, ...], removed_fields: tuple[str, ...] = ()) -> DataFrame:
    """Right to erasure: one user's fields hashed with their id as salt or removed; other rows as they are."""
    mine = F.col(user) == F.lit(user_id)
    rules = {f: Rule("hash", options={"salt": str(user_id)}, where=mine) for f in hashed_fields} | {f: Rule("remove", where=mine) for f in removed_fields}
    return Policy(rules).apply(df)
