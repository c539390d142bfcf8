"""Tails of distributions as column expressions: Simpson's rule over a fixed number of points, so they stay in the JVM and can be written in SQL."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

STEPS = 400
Z95 = 1.959963984540054  # the normal 97.5 % point


def simpson(f, upper: Column, steps: int = STEPS) -> Column:
    """Integral of ``f`` from 0 to ``upper``."""
    h = upper / steps
    weight = lambda k: F.when((k == 0) | (k == steps), 1.0).when(k % 2 == 1, 4.0).otherwise(2.0)
    return F.aggregate(F.sequence(F.lit(0), F.lit(steps)), F.lit(0.0), lambda t, k: t + weight(k) * f(h * k)) * h / 3


def normal_two_sided(z: Column) -> Column:
    """Chance that a standard normal is at least as far from 0 as z; null for null."""
    inside = simpson(lambda x: F.exp(-x * x / 2), F.least(F.abs(z), F.lit(9.0))) * (2 / math.sqrt(2 * math.pi))
    return F.when(z.isNotNull(), F.greatest(F.lit(0.0), 1 - inside))


def student_two_sided(t: Column, df: Column) -> Column:
    """The same for Student's t with ``df`` degrees of freedom, 1 at least.

    With t = sqrt(df) cot(phi) the tail is the integral of sin(phi)^(df - 1) up to that phi, over the one up to
    half a turn's half; phi = pi/2 v^3 keeps the integrand smooth for fractional df.
    """
    f = lambda v: F.pow(F.sin(math.pi / 2 * v * v * v), df - 1) * v * v
    upper = F.pow(F.atan2(F.sqrt(df), F.abs(t)) / (math.pi / 2), 1 / 3)
    return F.when(t.isNotNull() & df.isNotNull(), simpson(f, upper) / simpson(f, F.lit(1.0)))


def sql_simpson(f: str, upper: str, steps: int = STEPS) -> str:
    """The same rule for the SQL side; ``f`` is written in @."""
    return f"(list_sum(list_transform(range({steps + 1}), lambda k: (CASE WHEN k = 0 OR k = {steps} THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * ({f.replace('@', f'({upper} / {steps} * k)')}))) * {upper} / {3 * steps})"
