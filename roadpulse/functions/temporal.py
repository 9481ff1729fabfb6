"""Calendar, duration and tier expressions (all JVM-side Column expressions)."""
from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, TimestampNTZType

from roadpulse.constants import (
    DAYPART_BINS, DURATION_TIERS, FESTIVAL_WINDOWS, LOCAL_TZ, MAX_VALID_DURATION_MIN,
)


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def parse_mixed_ts(col) -> Column:
    """B2: each value parsed on its own; ``…SS.fff+00`` and ISO ``…Z`` both
    accepted, anything unparseable becomes NULL.  Naive text is UTC.  Result
    is a TIMESTAMP_NTZ holding UTC wall time (session zone is UTC, S1)."""
    return F.try_to_timestamp(_c(col)).cast(TimestampNTZType())


def as_utc_ntz(col, dtype) -> Column:
    """Normalise a start/end column of any type to UTC TIMESTAMP_NTZ."""
    if isinstance(dtype, StringType):
        return parse_mixed_ts(col)
    return _c(col).cast(TimestampNTZType())


def to_local(col) -> Column:
    """UTC wall time -> Asia/Kolkata wall time (both TIMESTAMP_NTZ)."""
    return F.convert_timezone(F.lit("UTC"), F.lit(LOCAL_TZ), _c(col))


def weekday0(col) -> Column:
    """Day of week, 0 = Monday."""
    return F.weekday(_c(col))


def daypart(hour) -> Column:
    """Right-closed bins, so hour 4 is late night and 22 is night peak."""
    h = _c(hour)
    expr = None
    for upper, label in DAYPART_BINS:
        cond = h <= F.lit(upper)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return F.when(h.isNull() | (h <= F.lit(-1)), F.lit(None).cast("string")).otherwise(expr)


def festival_flag(local_ts) -> Column:
    """1 when the local calendar date falls in any festival window."""
    d = F.to_date(_c(local_ts))
    cond = F.lit(False)
    for start, end in FESTIVAL_WINDOWS:
        cond = cond | d.between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return F.coalesce(cond, F.lit(False)).cast("int")


def cyclical(value, period: int, fn) -> Column:
    """Sin / cos of 2*pi*value/period with NULL treated as 0."""
    return fn(F.lit(2 * math.pi) * F.coalesce(_c(value), F.lit(0)) / F.lit(float(period)))


def calendar_columns(local_ts) -> dict[str, Column]:
    """B3 + B4 + B5 + B6 from a local (IST) timestamp column."""
    ts = _c(local_ts)
    hour, dow = F.hour(ts), weekday0(ts)
    return {
        "hour": hour,
        "dow": dow,
        "dow_name": F.date_format(ts, "EEEE"),
        "month": F.month(ts),
        "is_weekend": F.coalesce(dow.isin(5, 6), F.lit(False)).cast("int"),
        "hour_sin": cyclical(hour, 24, F.sin),
        "hour_cos": cyclical(hour, 24, F.cos),
        "dow_sin": cyclical(dow, 7, F.sin),
        "dow_cos": cyclical(dow, 7, F.cos),
        "daypart": daypart(hour),
        "is_festival_window": festival_flag(ts),
    }


def minutes_between(start, end) -> Column:
    """Exact difference in minutes from microseconds (double)."""
    return F.timestamp_diff("MICROSECOND", _c(start), _c(end)) / F.lit(6e7)


def duration_minutes(start, resolved, closed, end) -> Column:
    """First available end (resolved, closed, end) minus start."""
    return minutes_between(start, F.coalesce(_c(resolved), _c(closed), _c(end)))


def duration_valid(minutes) -> Column:
    """Valid iff 0 < d < 2880 (strict); NULL is invalid."""
    m = _c(minutes)
    return F.coalesce((m > 0) & (m < F.lit(float(MAX_VALID_DURATION_MIN))), F.lit(False))


def duration_tier(minutes) -> Column:
    """Left-closed [0,30) Quick, [30,120) Moderate, [120, inf) Prolonged."""
    m = _c(minutes)
    expr = F.when(m.isNull() | m.isNaN() | (m < 0), F.lit(None).cast("string"))
    for upper, label in DURATION_TIERS:
        expr = expr.when(m < F.lit(upper), F.lit(label)) if upper != float("inf") else expr.otherwise(F.lit(label))
    return expr
