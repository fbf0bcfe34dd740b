"""Sizes, rates, latencies and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of the overall score, out of 100.
SCORE_WEIGHTS = {"file_score": 15, "check_score": 35, "tests_pass": 30, "code_runs": 10, "agent_success": 10}


def padding(size: Column, align: int = 4) -> Column:
    """Bytes that bring ``size`` up to a multiple of ``align``."""
    return F.pmod(-size, F.lit(align)).cast("bigint")


def rate_gbps(size: Column, seconds: Column) -> Column:
    """Gigabytes per second, 0 when no time has passed."""
    return F.when(seconds > 0, size / seconds / F.lit(1e9)).otherwise(F.lit(0.0))


def latency_health(seconds: Column, timeout: float = 30.0) -> Column:
    return F.when(seconds >= timeout, "TIMEOUT").otherwise("HEALTHY")


def within_slo(seconds: Column, expected: float = 2.0) -> Column:
    return seconds < expected


def length_quality(avg_length: Column, full: float = 200.0) -> Column:
    """0 for answers of ``full`` characters or more on average, up to 1 for none."""
    return F.lit(1.0) - F.least(avg_length / F.lit(full), F.lit(1.0))


def round_tenths(value: Column) -> Column:
    """One decimal, decided on the exact binary value, exact ties to even.

    ``round`` and ``bround`` decide on the shortest decimal text, so they see a tie in
    0.45, which really is a little more. Here twenty times the value is compared with
    its nearest whole number; written as 16 and 4 times, both subtractions are exact.
    """
    nearest = F.rint(value * 20)
    short = (nearest - value * 16) - value * 4
    down, up = (nearest - 1) / 2, (nearest + 1) / 2
    tenths = (
        F.when(nearest % 2 == 0, nearest / 2)
        .when(short > 0, down)
        .when(short < 0, up)
        .otherwise(F.when(down % 2 == 0, down).otherwise(up))
    )
    return tenths / 10


def overall_score(**columns: Column) -> Column:
    """Weighted score, 0 to 100, with one decimal; missing is 0."""
    total = F.lit(0.0)
    for name, weight in SCORE_WEIGHTS.items():
        value = columns.get(name, F.lit(0)).cast("double")
        total = total + F.coalesce(value, F.lit(0.0)) * weight
    return round_tenths(total)
