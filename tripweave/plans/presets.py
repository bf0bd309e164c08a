"""Named departure-time analyses."""

from __future__ import annotations

from dataclasses import dataclass, replace

from tripweave.sources.distributions import HourlyDistribution

RAW, UNIFORM, INFORMED = "raw", "uniform", "informed"


@dataclass(frozen=True)
class TripFilter:
    origins: tuple[str, ...] | None = None
    dests: tuple[str, ...] | None = None
    weekday_only: bool = True
    exclude_type: str | None = "O"
    same_day_only: bool = True
    first_outbound: bool = False
    last_return: bool = False
    per_direction: bool = False


@dataclass(frozen=True)
class Sampling:
    strategy: str = INFORMED
    distribution: HourlyDistribution | None = None
    salt: str = "departure"

    def __post_init__(self):
        if self.strategy not in (RAW, UNIFORM, INFORMED):
            raise ValueError(f"unknown sampling strategy {self.strategy!r}")


@dataclass(frozen=True)
class Preset:
    """``survey`` names the survey hours that inform and are compared with it."""

    name: str
    trips: TripFilter
    sampling: Sampling
    survey: str
    month_positions: tuple[int | None, int | None] | None = None
    zone: str = "UTC"

    def informed_by(self, distribution: HourlyDistribution) -> Preset:
        return replace(self, sampling=replace(self.sampling, distribution=distribution))


_COMMUTE = TripFilter(("H",), ("W",), first_outbound=True, last_return=True)
_LEGACY_HOME_OTHER = TripFilter(
    ("H",), ("O",), exclude_type="W", first_outbound=True, last_return=True
)

PRESETS = {
    p.name: p
    for p in (
        Preset("HW_informed", _COMMUTE, Sampling(INFORMED), "hw"),
        Preset("HW_random_uniform", _COMMUTE, Sampling(UNIFORM), "hw"),
        Preset("HW_raw", _COMMUTE, Sampling(RAW), "hw"),
        Preset("HO_informed", TripFilter(("H",), ("O",), exclude_type=None), Sampling(INFORMED), "ho"),
        Preset("nonH_informed", TripFilter(), Sampling(INFORMED), "nhb"),
        Preset("all_informed", TripFilter(), Sampling(INFORMED), "all"),
        Preset("legacy_ho", _LEGACY_HOME_OTHER, Sampling(INFORMED), "ho"),
        Preset("legacy_nonh", TripFilter(exclude_type="H"), Sampling(INFORMED), "nhb"),
        Preset("legacy_all", TripFilter(exclude_type=None), Sampling(INFORMED), "all"),
    )
}

MODULAR = ("HW_informed", "HW_random_uniform", "HW_raw", "HO_informed", "nonH_informed", "all_informed")


def preset(name: str) -> Preset:
    if name not in PRESETS:
        raise ValueError(f"unknown preset {name!r}, known: {', '.join(PRESETS)}")
    return PRESETS[name]
