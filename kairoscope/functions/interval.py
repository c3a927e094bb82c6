"""Closed intervals in microseconds; a null end is open."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FOREVER = (1 << 63) - 1
HOUR_US = 3_600_000_000
#: Hours in which relevance halves, least half-life in hours, least transition weight.
DECAY_HOURS, LEAST_HOURS, LEAST_WEIGHT = 168.0, 0.001, 1e-9


def micros(ts: Column) -> Column:
    """Microseconds of a timestamp without zone, which counts as UTC."""
    return F.unix_micros(ts.cast("timestamp"))


def micros_of_text(text: Column) -> Column:
    """Microseconds of ISO text; null where it is none."""
    return F.unix_micros(F.try_to_timestamp(text))


def micros_of_text_strict(text: Column) -> Column:
    """Microseconds of ISO text, null for null; an error for any other text."""
    us = micros_of_text(text)
    return F.when(text.isNull() | us.isNotNull(), us).otherwise(F.raise_error(F.concat(F.lit("no ISO time: "), text)).cast("long"))


def iso_of_micros(us: Column) -> Column:
    return F.date_format(F.timestamp_millis(F.floor(us / 1000).cast("long")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def overlaps(a_from: Column, a_to: Column, b_from: Column, b_to: Column) -> Column:
    return (a_from <= F.coalesce(b_to, F.lit(FOREVER))) & (b_from <= F.coalesce(a_to, F.lit(FOREVER)))


def midpoint(start: Column, end: Column) -> Column:
    """The start of an open interval."""
    return F.coalesce(start + F.floor((end - start) / 2).cast("long"), start)


def distance(start: Column, end: Column, at: Column) -> Column:
    """How far a point lies outside."""
    return F.greatest(start - at, at - F.coalesce(end, at), F.lit(0))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def decayed(relevance: Column, hours: Column) -> Column:
    """Half after DECAY_HOURS, within 0 and 1."""
    return F.when(relevance <= 0, F.lit(0.0)).otherwise(clamp(relevance * F.pow(F.lit(2.0), -F.greatest(hours, F.lit(0.0)) / DECAY_HOURS)))


def transition_weight(confidence: Column, relevance: Column, away_us: Column, half_life_hours: float, contradictions: Column) -> Column:
    half = max(half_life_hours, LEAST_HOURS) * HOUR_US
    return F.greatest(F.lit(LEAST_WEIGHT), confidence * relevance * F.pow(F.lit(2.0), -away_us / F.lit(half)) / (1 + contradictions))
