"""Scalar expressions: plain functions from Column to Column, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import DAY, R20, SEC

# Accepted timestamp layouts, tried in this order.
TS_FORMATS = ("yyyy/MM/dd HH:mm", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy HH:mm")


def paise(amount: Column) -> Column:
    return F.round(amount * 100).cast("bigint")


def rupees(paise_col: Column) -> Column:
    return F.round(paise_col / 100, 2)


def near_cap(amount: Column) -> Column:
    """Just under the transfer cap, or a just-under amount such as 49,999 (amount rounded half-even first)."""
    a = F.bround(amount).cast("bigint")
    return a.between(R20.near_cap_low, R20.cap) | ((a >= 9_999) & (F.pmod(a, F.lit(1000)) == 999))


def epoch_day(t_us: Column) -> Column:
    return F.floor(t_us / DAY).cast("bigint")


def day_of(t_us: Column, start_us: int) -> Column:
    return F.floor((t_us - F.lit(start_us)) / DAY).cast("bigint")


def time_bucket(t_us: Column, seconds: int) -> Column:
    return F.floor(t_us / (seconds * SEC)).cast("bigint")


def ts_of(t_us: Column) -> Column:
    return F.timestamp_micros(t_us)


def group_indian(n: Column) -> Column:
    """12345678 -> '₹1,23,45,678' (rounded half-even to whole rupees)."""
    s = F.bround(n).cast("bigint").cast("string")
    cut = F.length(s) - 3
    grouped = F.concat(F.regexp_replace(F.substring(s, F.lit(1), cut), r"(\d)(?=(\d\d)+$)", "$1,"), F.lit(","), F.right(s, F.lit(3)))
    return F.concat(F.lit("₹"), F.when(F.length(s) <= 3, s).otherwise(grouped))


def parse_ts(s: Column, formats: tuple[str, ...] = TS_FORMATS) -> Column:
    t = F.trim(s)
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in formats])


def iso_time(s: Column) -> Column:
    """ISO text to UTC time: an offset shifts, a naive time is kept, '' is null. Fractions of a second are dropped.

    The text must begin with a full date: a time alone would become a time of the day on which the job runs."""
    dated = F.trim(s).rlike(r"^\d{4}-\d{2}-\d{2}([T ]|$)")
    return F.date_trunc("second", F.when(dated, F.trim(s)).try_cast("timestamp"))


def hour_of_day(t_seconds: Column) -> Column:
    return F.pmod(t_seconds, F.lit(86_400)) / 3600


def log_amount(amount: Column) -> Column:
    return F.log1p(amount)


def score_band(score: Column) -> Column:
    return F.when(score >= 0.9, "High mule probability").when(score >= 0.6, "Elevated risk").otherwise("Nominal")


def score_reading(score: Column, act: float = 0.9, investigate: float = 0.6) -> Column:
    return (
        F.when(score >= act, "high mule probability")
        .when(score >= investigate, "elevated - investigate")
        .when(score >= 0.40, "ambiguous")
        .otherwise("low")
    )


def score_level(score: Column) -> Column:
    """The part a model score adds to an alert: 0..10."""
    return F.bround(score * 10).cast("int")


def alert_score(base: Column, level: Column) -> Column:
    return F.least(F.lit(99), base + level).cast("int")


def prf(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Precision, recall, F1; 0 where undefined."""
    p = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0))
    r = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(0.0))
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
    return p, r, f1


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """95% Wilson interval, 4 decimals, null when n = 0."""
    p = k / n
    denom = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / denom
    half = F.lit(z) * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / denom
    lo = F.round(F.greatest(F.lit(0.0), centre - half), 4)
    hi = F.round(F.least(F.lit(1.0), centre + half), 4)
    return F.when(n > 0, lo), F.when(n > 0, hi)
