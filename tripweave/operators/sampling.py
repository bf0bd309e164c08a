"""Departure times: raw, uniform, or informed by an hourly distribution.

A sampler adds the epoch second of departure to moves with ``end_timestamp``
(the stop ends) and ``next_start`` (the next begins).
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripweave.functions import digest_uniform, hour_of, local_seconds, row_digest
from tripweave.sources.distributions import HourlyDistribution

DEFAULT_SALT = "departure"
_KEY = ("uid", "stop_event", "month")


def with_raw_departure(moves: DataFrame, out: str = "departure") -> DataFrame:
    return moves.withColumn(out, F.col("end_timestamp").cast("double"))


def with_uniform_departure(
    moves: DataFrame, salt: str = DEFAULT_SALT, out: str = "departure"
) -> DataFrame:
    u = "s_u_hour" if "s_u_hour" in moves.columns else digest_uniform(row_digest(*_KEY, salt=salt))
    return moves.withColumn(out, F.expr(f"end_timestamp + (next_start - end_timestamp) * {u}"))


def with_gap(moves: DataFrame, zone: str = "UTC", salt: str = DEFAULT_SALT) -> DataFrame:
    """What draws of one zone and salt share, whatever their distribution: the gap in whole hours and the digest.

    Samplers that find these columns do not make them again.
    """
    steps = [
        {
            "s_end": local_seconds("end_timestamp", zone),
            "s_start": local_seconds("next_start", zone),
            "s_digest": row_digest(*_KEY, salt=salt),
        },
        # Whole hours, counted from the midnight before the first one in the gap.
        {"s_midnight": "floor(ceil(s_end / 3600) / 24) * 24", "s_u_hour": digest_uniform("s_digest", 0)},
        {
            "s_first": "cast(ceil(s_end / 3600) - s_midnight as int)",
            "s_last": "cast(floor(s_start / 3600) - s_midnight as int)",
        },
        {"s_days": "floor(s_last / 24)"},
    ]
    for step in steps:
        moves = moves.withColumns({name: F.expr(text) for name, text in step.items()})
    return moves


_GAP = ("s_end", "s_start", "s_digest", "s_midnight", "s_u_hour", "s_first", "s_last", "s_days")


def with_informed_departure(
    moves: DataFrame,
    distribution: HourlyDistribution,
    zone: str = "UTC",
    salt: str = DEFAULT_SALT,
    out: str = "departure",
) -> DataFrame:
    """Draw one of the whole hours inside the gap by its share, then a minute.

    The drawn time lies on the day the stop ended and is clipped into the gap.
    Without a whole hour in the gap the draw is uniform. All arithmetic is in
    wall-clock seconds of ``zone``; the shift is applied to the epoch at the end.

    With C(h) the running sum of the 24 hour weights, the whole hours of the gap
    that fall on hour of day <= h weigh
    ``days * C(h) + min(C(h), through) - min(C(h), before)``: a function of C(h)
    made of three straight pieces. It is inverted at a uniform times the total,
    and the drawn hour is the first whose C exceeds the inverse. The cost does
    not depend on the length of the gap, and each step is a plain column.
    """
    weights = distribution.weights()
    running = list(accumulate(weights))
    table = f"array(0D, {', '.join(f'{r!r}D' for r in running)})"
    u_hour, u_minute, u_gap = "s_u_hour", digest_uniform("s_digest", 1), digest_uniform("s_digest", 2)
    hour = _first_above("s_inverse", running)
    if min(weights) <= 0:
        evenly = f"pmod(s_first + cast(floor({u_hour} * (s_last - s_first + 1)) as int), 24)"
        hour = f"if(s_days = 0 and s_low = s_high, {evenly}, {hour})"
    steps = [
        {
            "s_through": f"get({table}, pmod(s_last, 24) + 1)",
            "s_before": f"get({table}, s_first)",
        },
        {
            "s_low": "least(s_before, s_through)",
            "s_high": "greatest(s_before, s_through)",
            "s_target": f"{u_hour} * (s_days * {running[-1]!r}D + s_through - s_before)",
        },
        {
            "s_at_low": "s_days * s_low",
            "s_at_high": "s_days * s_high + s_through - s_before",
        },
        {
            "s_inverse": """
case when s_target < s_at_low then try_divide(s_target, s_days)
  when s_target < s_at_high
    then s_low + (s_target - s_at_low) * (s_high - s_low) / (s_at_high - s_at_low)
  else s_high + coalesce(try_divide(s_target - s_at_high, s_days), 0D) end"""
        },
        {
            "s_drawn": f"floor(s_end / 86400) * 86400 + {hour} * 3600 + floor({u_minute} * 60) * 60"
        },
        {
            out: f"""
end_timestamp + if(s_first > s_last, (s_start - s_end) * {u_gap},
  cast(greatest(s_end, least(s_start, s_drawn)) - s_end as double))"""
        },
    ]
    shared = set(_GAP) <= set(moves.columns)
    moves = moves if shared else with_gap(moves, zone, salt)
    for step in steps:
        moves = moves.withColumns({name: F.expr(text) for name, text in step.items()})
    return moves.drop(*[name for step in steps for name in step if name != out], *(() if shared else _GAP))


def _first_above(x: str, running: list[float], low: int = 0, high: int = 23) -> str:
    """Index of the first running sum above ``x``, by halving."""
    if low == high:
        return str(low)
    middle = (low + high) // 2
    return (
        f"if({x} < {running[middle]!r}D, {_first_above(x, running, low, middle)}, "
        f"{_first_above(x, running, middle + 1, high)})"
    )


def departure_hour(departure: str = "departure", zone: str = "UTC") -> Column:
    return F.expr(hour_of(local_seconds(departure, zone)))


def departure_timestamp(departure: str = "departure") -> Column:
    return F.expr(f"timestamp_seconds(floor({departure}))")
