"""Date spines, training windows, request chunks."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_STEP = {"h": "hours", "min": "minutes", "s": "seconds", "D": "days"}


def _interval(freq: str) -> tuple[str, timedelta | None]:
    """SQL interval, and its length if it is shorter than a day."""
    if freq == "MS":
        return "1 month", None
    m = re.fullmatch(r"(\d*)(h|min|s|D)", freq)
    if not m:
        raise ValueError(f"unknown frequency {freq!r}")
    n = int(m[1] or 1)
    length = timedelta(**{_STEP[m[2]]: n})
    return f"{n} {_STEP[m[2]]}", length if length < timedelta(days=1) else None


def spine(spark: SparkSession, start: datetime, end: datetime, freq: str, shift_months: int = 0) -> DataFrame:
    """t (timestamp_ntz), both ends included. Month starts begin at the first one not before start; frequencies below a day run one step past end."""
    step, short = _interval(freq)
    if freq == "MS" and start != start.replace(day=1, hour=0, minute=0, second=0, microsecond=0):
        start = (start.replace(day=1, hour=0, minute=0, second=0, microsecond=0) + timedelta(days=32)).replace(day=1)
    end = end + short if short else end
    if start > end:
        return spark.createDataFrame([], "t timestamp_ntz")
    at = f"sequence(timestamp_ntz'{start:%Y-%m-%d %H:%M:%S}', timestamp_ntz'{end:%Y-%m-%d %H:%M:%S}', interval {step})"
    t = spark.sql(f"select explode({at}) as t")
    return t.select((F.col("t") + F.make_interval(months=F.lit(shift_months))).cast("timestamp_ntz").alias("t")) if shift_months else t


def spine_of(times: DataFrame, freq: str, column: str = "t") -> DataFrame:
    """t (timestamp_ntz): spine() from the first to the last of the times; none for none."""
    step, short = _interval(freq)
    ends = times.agg(F.min(column).cast("timestamp_ntz").alias("a"), F.max(column).cast("timestamp_ntz").alias("b"))
    if freq == "MS":
        month = F.date_trunc("month", "a").cast("timestamp_ntz")
        ends = ends.withColumn("a", F.when(month == F.col("a"), month).otherwise((month + F.expr("interval 1 month")).cast("timestamp_ntz")))
    if short:
        ends = ends.withColumn("b", (F.col("b") + F.expr(f"interval {step}")).cast("timestamp_ntz"))
    return ends.where("a <= b").select(F.explode(F.expr(f"sequence(a, b, interval {step})")).alias("t"))


def hours_of_day(step: str | int) -> list[str]:
    """"6h" or 6 -> 00:00, 06:00, ...; only divisors of 24."""
    n = int(str(step).removesuffix("h"))
    if n <= 0 or 24 % n:
        raise ValueError("the step has to divide 24 hours")
    return [f"{h:02d}:00" for h in range(0, 24, n)]


def halved_windows(start: datetime, end: datetime, min_months: int, anchor: str = "end") -> list[tuple[datetime, datetime]]:
    """Windows of half the days each time, down to min_months (30 days each), that share their end (or start)."""
    if anchor not in ("start", "end") or min_months <= 0 or end <= start:
        raise ValueError("bad window arguments")
    days, out = (end - start).days, []
    while days >= min_months * 30:
        out.append((end - timedelta(days=days), end) if anchor == "end" else (start, start + timedelta(days=days)))
        days //= 2
    return out


def split_at(windows: list[tuple[datetime, datetime]], cutoff: datetime) -> list[list[tuple[datetime, datetime]]]:
    """Each window as [before the cutoff, from the day after it on]; parts without days are left out."""
    out = []
    for a, b in windows:
        parts = [(a, min(b, cutoff)), (max(a, cutoff + timedelta(days=1)), b)]
        out.append([p for p in parts if p[0] <= p[1]])
    return out


def request_chunks(start: datetime, end: datetime, months: int | None = None, skip: frozenset[str] = frozenset()) -> list[dict]:
    """Years, or runs of `months` months without those in skip ("03"), clipped to the period."""
    if months is None:
        return [{"year": y, "start": max(start, datetime(y, 1, 1)), "end": min(end, datetime(y, 12, 31))} for y in range(start.year, end.year + 1)]
    out = []
    for y in range(start.year, end.year + 1):
        inside = [f"{m:02d}" for m in range(1, 13) if (y, m) >= (start.year, start.month) and (y, m) <= (end.year, end.month) and f"{m:02d}" not in skip]
        out += [{"year": y, "months": inside[k : k + months]} for k in range(0, len(inside), months)]
    return out


def ensemble_size(n_times: int, n_leadtimes: int, n_months: int) -> int:
    """Members of a file of n_times start dates and lead-time steps; has to come out whole."""
    n_lead = n_times - n_months + 1
    size, rest = divmod(n_leadtimes, n_months * n_lead) if n_lead > 0 else (0, 1)
    if rest or size < 1:
        raise ValueError("the ensemble size is not a whole number")
    return size


def floor_day(t: Column) -> Column:
    """Midnight of the day."""
    return F.date_trunc("day", t).cast("timestamp_ntz")


def span(value: int | float, unit: str) -> Column:
    """A number of minutes, hours, days or weeks as an interval."""
    minutes = {"minute": 1, "hour": 60, "day": 1440, "week": 10080}[unit.lower().removesuffix("s")]
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(int(value * minutes)))
