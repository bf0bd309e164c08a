"""Repeatable uniform numbers derived from row keys, as SQL text.

A task that is retried, or a table that is partitioned differently, yields
the same numbers, and plain SQL can recompute them.
"""

from __future__ import annotations

_HEX_WORD = 8
_WORD_RANGE = 2**32


def row_digest(*keys: str, salt: str) -> str:
    """128 bits per row as 32 hexadecimal digits."""
    if not salt.replace("_", "").isalnum():
        raise ValueError("a salt is letters, digits and underscores")
    return f"md5(concat_ws(':', {', '.join(keys)}, '{salt}'))"


def digest_uniform(digest: str, word: int = 0) -> str:
    """Uniform in [0, 1) from one of the four 32-bit words of a digest."""
    if not 0 <= word < 4:
        raise ValueError("one digest holds four 32-bit words")
    hexadecimal = f"substring({digest}, {1 + _HEX_WORD * word}, {_HEX_WORD})"
    return f"(cast(conv({hexadecimal}, 16, 10) as double) / {_WORD_RANGE}D)"
