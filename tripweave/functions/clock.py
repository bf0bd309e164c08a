"""Hours and dates from epoch seconds, independent of the session time zone.

Epochs are first shifted to "local seconds" (seconds since 1970 on the wall
clock of a named zone); hours and dates are then plain arithmetic. Arguments
and results are SQL text, so that a long expression is built in one piece.
"""

from __future__ import annotations


def local_seconds(epoch: str, zone: str = "UTC") -> str:
    """Whole wall-clock seconds of ``zone`` for an epoch in seconds."""
    seconds = f"floor({epoch})"
    if zone == "UTC":
        return seconds
    return f"unix_seconds(from_utc_timestamp(timestamp_seconds({seconds}), '{zone}'))"


def hour_of(local: str) -> str:
    return f"cast(pmod(floor({local} / 3600), 24) as int)"


def date_of(local: str) -> str:
    return f"date_from_unix_date(cast(floor({local} / 86400) as int))"
