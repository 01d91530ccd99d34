"""Noise for differential privacy, keyed by seed, query, scale and group.

A group's noise is the same however rows are partitioned and tasks are rerun.
Who knows the seed knows the noise, so a seed is secret unless a test names one;
the scale is part of the key, so that noise of one seed and name isn't the same
draw at another epsilon, delta or sensitivity.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from veil.functions.keyed import uniform


def laplace(key: Column, scale: float, seed: object, query: str) -> Column:
    u = uniform(seed, f"laplace|{scale!r}|{query}", key) - F.lit(0.5)
    return F.lit(-scale) * F.signum(u) * F.log(F.lit(1.0) - F.lit(2.0) * F.abs(u))


def gaussian(key: Column, sigma: float, seed: object, query: str) -> Column:
    u, v = (uniform(seed, f"gauss|{sigma!r}|{query}", key, salt) for salt in (1, 2))
    return F.lit(sigma) * F.sqrt(F.lit(-2.0) * F.log(u)) * F.cos(F.lit(2.0 * math.pi) * v)
