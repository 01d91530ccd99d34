"""Differential privacy: parameters, mechanisms, budget, and noisy aggregates.

Aggregates run natively; noise is added to one row a group.  Spending is
accounted on the driver before a query runs.

Every query draws noise of its own: without a seed, its key is a secret that is
drawn anew for each call, so noises neither cancel between calls nor can be
recomputed.  A seed makes noise repeatable and is for tests; the seed and name of
a query then work once in a budget.  Group names are in the open: a group that is
there only because of one person is a fact that noise doesn't hide.
"""

from __future__ import annotations

import math
import secrets
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veil.errors import BudgetExceededError
from veil.functions.noise import gaussian, laplace


@dataclass(frozen=True)
class Parameters:
    epsilon: float
    delta: float = 0.0
    sensitivity: float = 1.0

    def __post_init__(self) -> None:
        if not self.epsilon > 0:
            raise ValueError("epsilon must be positive")
        if not 0 <= self.delta < 1:
            raise ValueError("delta must be in [0, 1)")
        if not self.sensitivity > 0:
            raise ValueError("sensitivity must be positive")


def _confidence(c: float) -> None:
    if not 0 < c < 1:
        raise ValueError("confidence must be in (0, 1)")


def _key(seed: object) -> object:
    """The seed, or a secret of this call."""
    return secrets.token_hex(16) if seed is None else seed


@dataclass(frozen=True)
class Laplace:
    parameters: Parameters
    #: None: a secret one for each call of ``noise``.
    seed: object = None

    @property
    def scale(self) -> float:
        return self.parameters.sensitivity / self.parameters.epsilon

    def noise(self, key: Column, query: str) -> Column:
        return laplace(key, self.scale, _key(self.seed), query)

    def margin(self, confidence: float = 0.95) -> float:
        _confidence(confidence)
        return -self.scale * math.log(1 - confidence)

    def interval(self, value: float, confidence: float = 0.95) -> tuple[float, float]:
        return value - self.margin(confidence), value + self.margin(confidence)


@dataclass(frozen=True)
class Gaussian:
    parameters: Parameters
    seed: object = None

    def __post_init__(self) -> None:
        if not self.parameters.delta > 0:
            raise ValueError("the Gaussian mechanism needs delta > 0")

    @property
    def sigma(self) -> float:
        p = self.parameters
        return p.sensitivity * math.sqrt(2 * math.log(1.25 / p.delta)) / p.epsilon

    def noise(self, key: Column, query: str) -> Column:
        return gaussian(key, self.sigma, _key(self.seed), query)

    def margin(self, confidence: float = 0.95) -> float:
        _confidence(confidence)
        low, high = 0.0, 10.0
        for _ in range(80):  # erf is monotone: the quantile by bisection
            middle = (low + high) / 2
            low, high = (middle, high) if math.erf(middle / math.sqrt(2)) < confidence else (low, middle)
        return self.sigma * low

    def interval(self, value: float, confidence: float = 0.95) -> tuple[float, float]:
        return value - self.margin(confidence), value + self.margin(confidence)


MECHANISMS = {"laplace": Laplace, "gaussian": Gaussian}


def mechanism(name: str, parameters: Parameters, seed: object = None) -> Laplace | Gaussian:
    if name.lower() not in MECHANISMS:
        raise ValueError(f"unknown mechanism {name!r}")
    return MECHANISMS[name.lower()](parameters, seed)


def sensitivity(kind: str, bounds: tuple[float, float] | None = None) -> float:
    """Of count, sum or mean queries over values within bounds."""
    if kind == "count":
        return 1.0
    if kind not in ("sum", "mean"):
        raise ValueError(f"unknown query {kind!r}")
    if bounds is None:
        raise ValueError(f"{kind} needs bounds")
    return float(max(abs(bounds[0]), abs(bounds[1])) if kind == "sum" else bounds[1] - bounds[0])


def l1_sensitivity(record: float) -> float:
    return abs(record)


l2_sensitivity = l1_sensitivity


class Budget:
    """Accountant of epsilon and delta; a query is paid before it runs, and nothing is given back."""

    def __init__(self, epsilon: float, delta: float = 0.0) -> None:
        Parameters(epsilon, delta)
        self.epsilon, self.delta = Decimal(str(epsilon)), Decimal(str(delta))
        self.reset()

    def reset(self) -> None:
        self.spent_epsilon = self.spent_delta = Decimal(0)
        self.queries = 0
        self.seeded: set[tuple] = set()

    def claim(self, *name: object) -> None:
        """Refuses the second query of one name and seed, whose noise would be known from the first."""
        if name in self.seeded:
            raise ValueError(f"the seeded query {name!r} has been asked; give it another name")
        self.seeded.add(name)

    def consume(self, epsilon: float, delta: float = 0.0) -> None:
        if epsilon < 0 or delta < 0:
            raise ValueError("spending can't be negative")
        e, d = self.spent_epsilon + Decimal(str(epsilon)), self.spent_delta + Decimal(str(delta))
        if e > self.epsilon or d > self.delta:
            raise BudgetExceededError(f"asked for epsilon {epsilon}, delta {delta}; left are {self.epsilon - self.spent_epsilon}, {self.delta - self.spent_delta}")
        self.spent_epsilon, self.spent_delta, self.queries = e, d, self.queries + 1

    @property
    def remaining(self) -> tuple[float, float]:
        return float(self.epsilon - self.spent_epsilon), float(self.delta - self.spent_delta)

    @contextmanager
    def query(self, epsilon: float, delta: float = 0.0) -> Iterator[Budget]:
        self.consume(epsilon, delta)
        yield self

    def report(self) -> dict[str, Any]:
        part = lambda spent, total: float(100 * spent / total) if total else 0.0
        return {
            "total_epsilon": float(self.epsilon),
            "total_delta": float(self.delta),
            "spent_epsilon": float(self.spent_epsilon),
            "spent_delta": float(self.spent_delta),
            "remaining_epsilon": self.remaining[0],
            "remaining_delta": self.remaining[1],
            "epsilon_percent": part(self.spent_epsilon, self.epsilon),
            "delta_percent": part(self.spent_delta, self.delta),
            "query_count": self.queries,
        }


class Private:
    """Noisy aggregates under a budget."""

    def __init__(self, budget: Budget, name: str = "laplace", seed: object = None) -> None:
        self.budget, self.name, self.seed = budget, name, seed
        mechanism(name, Parameters(1.0, 1e-6))

    def _noise(self, query: str, key: Column, of: float, epsilon: float | None, delta: float | None) -> Column:
        epsilon = float(self.budget.epsilon) / 10 if epsilon is None else epsilon
        delta = (float(self.budget.delta) / 10 if self.name == "gaussian" else 0.0) if delta is None else delta
        made = mechanism(self.name, Parameters(epsilon, delta, of), self.seed)
        if self.seed is not None:
            self.budget.claim(self.name, self.seed, query)
        self.budget.consume(epsilon, delta)
        return made.noise(key, query)

    def numeric(self, value: Column, key: Column, query: str, of: float, epsilon: float | None = None, delta: float | None = None) -> Column:
        """value plus noise, keyed by the row's key."""
        return value + self._noise(query, key, of, epsilon, delta)

    def _groups(self, by: Sequence[str]) -> Column:
        """A group's values in one string from which they could be read back, so that no two groups have one key."""
        values = (F.col(f"`{c}`").cast("string") for c in by)
        return F.concat(*(F.coalesce(F.concat(F.length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values)) if by else F.lit("")

    def count(self, df: DataFrame, by: Sequence[str] = (), *, query: str = "count", epsilon: float | None = None, delta: float | None = None) -> DataFrame:
        out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
        return out.select(*by, (F.col("n") + self._noise(query, self._groups(by), 1.0, epsilon, delta)).alias("noisy_count"))

    def sum(self, df: DataFrame, column: str, bounds: tuple[float, float], by: Sequence[str] = (), *, query: str = "sum", epsilon: float | None = None, delta: float | None = None) -> DataFrame:
        """Values are clipped to the bounds, which is what makes their sensitivity hold."""
        clipped = F.least(F.greatest(F.col(f"`{column}`"), F.lit(bounds[0])), F.lit(bounds[1]))
        out = df.groupBy(*by).agg(F.sum(clipped).alias("s"))
        return out.select(*by, (F.coalesce("s", F.lit(0.0)) + self._noise(query, self._groups(by), sensitivity("sum", bounds), epsilon, delta)).alias("noisy_sum"))

    def mean(self, df: DataFrame, column: str, bounds: tuple[float, float], by: Sequence[str] = (), *, query: str = "mean", epsilon: float | None = None, delta: float | None = None) -> DataFrame:
        """Half of the spending for the sum, half for the count."""
        half = None if epsilon is None else epsilon / 2
        s = self.sum(df, column, bounds, by, query=f"{query}.sum", epsilon=half, delta=delta)
        n = self.count(df, by, query=f"{query}.count", epsilon=half, delta=delta)
        both = s.join(n, list(by)) if by else s.crossJoin(n)
        return both.select(*by, (F.col("noisy_sum") / F.greatest(F.col("noisy_count"), F.lit(1.0))).alias("noisy_mean"))


def k_anonymous(df: DataFrame, fields: Sequence[str], k: int) -> DataFrame:
    """Rows whose combination of fields is held by at least k rows; counts are summed before the shuffle."""
    counts = df.groupBy(*fields).agg(F.count(F.lit(1)).alias("veil_n")).where(F.col("veil_n") >= k)
    same = [df[f].eqNullSafe(counts[f]) for f in fields]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    return df.join(counts, condition, "left_semi")
