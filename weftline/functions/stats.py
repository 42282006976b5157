"""Exact tail probabilities as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def t_tail(t: Column, df: Column) -> Column:
    """P(T > t) of Student's t with a whole number of degrees of freedom, by its finite series; null where either is null or df < 1."""
    theta = F.atan(F.abs(t) / F.sqrt(df))
    c, odd = F.cos(theta), df % 2 == 1
    last = F.floor((df - F.when(odd, 3).otherwise(2)) / 2).cast("int")
    start = F.struct(F.when(odd, c).otherwise(F.lit(1.0)).alias("term"), F.when(odd, c).otherwise(F.lit(1.0)).alias("total"))

    def add(s: Column, j: Column) -> Column:
        ratio = F.when(odd, 2 * j / (2 * j + 1)).otherwise((2 * j - 1) / (2 * j))
        term = s["term"] * ratio * c * c
        return F.struct(term.alias("term"), (s["total"] + term).alias("total"))

    steps = F.when(last >= 1, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(steps, start, add, lambda s: s["total"])
    inside = F.when(df == 1, 2 * theta / math.pi).when(odd, 2 / math.pi * (theta + F.sin(theta) * total)).otherwise(F.sin(theta) * total)
    return F.when(df >= 1, F.when(t > 0, (1 - inside) / 2).otherwise((1 + inside) / 2))


def mean_tail(n: Column, mean: Column, std: Column) -> Column:
    """One-sided p-value that a mean is over 0: null for fewer than two values or where all are 0, and 0 or 1 where they do not vary."""
    t = F.try_divide(mean, std / F.sqrt(n))
    flat = F.when(mean > 0, F.lit(0.0)).when(mean < 0, F.lit(1.0))
    return F.when(n < 2, F.lit(None).cast("double")).when(std > 0, t_tail(t, (n - 1).cast("int"))).otherwise(flat)


def binomial_tail(hits: Column, n: Column) -> Column:
    """P(at least hits of n at one half); 1 where hits is 0, null where n is 0."""
    start = F.struct(F.lit(0.0).alias("log"), F.when(hits <= 0, F.exp(-n * math.log(2))).otherwise(F.lit(0.0)).alias("total"))

    def add(s: Column, j: Column) -> Column:
        log = s["log"] + F.log((n - j + 1) / j)
        return F.struct(log.alias("log"), (s["total"] + F.when(j >= hits, F.exp(log - n * math.log(2))).otherwise(F.lit(0.0))).alias("total"))

    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int")), start, add, lambda s: F.least(s["total"], F.lit(1.0))))
