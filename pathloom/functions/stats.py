"""Statistics of repeated measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sample_mean(c: str) -> Column:
    return F.avg(c)


def unbiased_variance(c: str) -> Column:
    """Null for a single measurement, where it isn't defined."""
    return F.var_samp(c)


def summarise(runs: DataFrame, by: list[str], value: str = "time") -> DataFrame:
    return runs.groupBy(*by).agg(sample_mean(value).alias("time"), unbiased_variance(value).alias("variance"))
