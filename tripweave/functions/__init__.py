from tripweave.functions.clock import date_of, hour_of, local_seconds
from tripweave.functions.hashing import digest_uniform, row_digest
from tripweave.functions.scalars import (
    concat_ids,
    expansion_factor,
    fill_int,
    log10_positive,
    round_to_multiple,
    truncated_weight,
    zero_pad,
)

__all__ = [
    "concat_ids",
    "date_of",
    "expansion_factor",
    "fill_int",
    "digest_uniform",
    "hour_of",
    "local_seconds",
    "log10_positive",
    "round_to_multiple",
    "row_digest",
    "truncated_weight",
    "zero_pad",
]
