"""Risk levels as Column expressions. NULL in, NULL out: no level without an index."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from climrisk.schemas import LEVELS

LOW, MEDIUM, HIGH = LEVELS

# Drought limits on the three-month index, and the probability cuts.
DROUGHT_MEDIUM, DROUGHT_HIGH = -1.0, -1.5
PROBABILITY_MEDIUM, PROBABILITY_HIGH = 1 / 3, 2 / 3


def severity(level: Column) -> Column:
    """0, 1, 2 for low, medium, high."""
    return F.when(level == LOW, 0).when(level == MEDIUM, 1).when(level == HIGH, 2)


def level_name(rank: Column) -> Column:
    return F.when(rank == 0, LOW).when(rank == 1, MEDIUM).when(rank == 2, HIGH)


def rain_level(total: Column, p95: Column, p99: Column) -> Column:
    known = total.isNotNull() & p95.isNotNull() & p99.isNotNull()
    return F.when(known, F.when(total <= p95, LOW).when(total <= p99, MEDIUM).otherwise(HIGH))


def drought_level(spi: Column) -> Column:
    return F.when(spi > DROUGHT_MEDIUM, LOW).when(spi > DROUGHT_HIGH, MEDIUM).when(
        spi <= DROUGHT_HIGH, HIGH
    )


def fire_level(detections: Column, p90: Column) -> Column:
    return F.when(detections == 0, LOW).when(detections <= p90, MEDIUM).when(
        detections > p90, HIGH
    )


def level_from_probability(probability: Column) -> Column:
    return (
        F.when(probability >= PROBABILITY_HIGH, HIGH)
        .when(probability >= PROBABILITY_MEDIUM, MEDIUM)
        .when(probability.isNotNull(), LOW)
    )
