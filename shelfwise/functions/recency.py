"""Half-life decay of event weights as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfwise.params import Recency

_MICROS_PER_DAY = 8.64e10


def age_days(event_time: Column, reference_time: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", event_time, reference_time) / F.lit(_MICROS_PER_DAY)


def decay(event_time: Column, reference_time: Column, half_life_days: float) -> Column:
    """0.5 ** (age / half life). An event later than the reference fails the job;
    equal times weigh 1."""
    if half_life_days <= 0:
        raise ValueError(f"weights cannot halve every {half_life_days!r} days")
    age = age_days(event_time, reference_time)
    message = F.concat(
        F.lit("event at "), event_time.cast("string"),
        F.lit(" is later than reference time "), reference_time.cast("string"),
    )
    return F.when(age < 0, F.raise_error(message).cast("double")).otherwise(
        F.pow(F.lit(0.5), age / F.lit(float(half_life_days)))
    )


def recency_factor(event_time: Column, reference_time: Column | None, recency: Recency) -> Column:
    """Decay, or 1 when decay is off, the reference is missing, or the event has no time."""
    if not recency.enabled or reference_time is None:
        return F.lit(1.0)
    return F.when(event_time.isNull() | reference_time.isNull(), F.lit(1.0)).otherwise(
        decay(event_time, reference_time, recency.half_life_days)
    )


def effective_weight(base: float | Column, event_time: Column, reference_time: Column | None,
                     recency: Recency) -> Column:
    base = base if isinstance(base, Column) else F.lit(float(base))
    return base * recency_factor(event_time, reference_time, recency)
