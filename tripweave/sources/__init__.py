from tripweave.sources.distributions import HourlyDistribution, read_hourly_distribution
from tripweave.sources.scratch import scratch_path
from tripweave.sources.store import manifest, origin, stored
from tripweave.sources.tables import (
    read_anchors,
    read_stops,
    read_survey_csv,
    read_trips,
    reuse_or_build,
    table_ready,
    write_anchors,
    write_csv,
    write_trips,
)
from tripweave.sources.zonefiles import read_zones, write_collection, write_zones

__all__ = [
    "HourlyDistribution",
    "manifest",
    "origin",
    "read_anchors",
    "read_hourly_distribution",
    "read_stops",
    "read_survey_csv",
    "read_trips",
    "read_zones",
    "reuse_or_build",
    "scratch_path",
    "stored",
    "table_ready",
    "write_anchors",
    "write_collection",
    "write_csv",
    "write_trips",
    "write_zones",
]
