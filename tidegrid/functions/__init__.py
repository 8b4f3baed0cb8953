"""Functions that SQL lacks, as expressions that stay in the JVM."""

from __future__ import annotations

from math import e
from statistics import NormalDist

EULER = 0.5772156649015329


def phi(x: str) -> str:
    """The normal distribution function by a five-term rational approximation (error below 1e-7)."""
    t = f"(1.0 / (1.0 + 0.2316419 * abs({x})))"
    tail = f"exp(-({x}) * ({x}) / 2.0) * 0.3989422804014327 * {t} * (0.319381530 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429))))"
    return f"(CASE WHEN {x} >= 0 THEN 1.0 - {tail} ELSE {tail} END)"


def expected_max(n: int) -> float:
    """The expected largest of n standard normal draws."""
    top = NormalDist().inv_cdf
    return (1 - EULER) * top(1 - 1 / n) + EULER * top(1 - 1 / (n * e))
