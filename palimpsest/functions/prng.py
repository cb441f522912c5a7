"""A public 32-bit generator (mulberry32) and the shuffle it drives, for pools that must be the same everywhere."""

from __future__ import annotations

from collections.abc import Iterator

_M = (1 << 32) - 1


def mulberry32(seed: int) -> Iterator[float]:
    state = seed & _M
    while True:
        state = (state + 0x6D2B79F5) & _M
        x = ((state ^ (state >> 15)) * (state | 1)) & _M
        x ^= (x + (((x ^ (x >> 7)) * (x | 61)) & _M)) & _M
        yield ((x ^ (x >> 14)) & _M) / (1 << 32)


def shuffled(values: list, seed: int) -> list:
    """Fisher-Yates from the end."""
    out, rng = list(values), mulberry32(seed)
    for last in range(len(out) - 1, 0, -1):
        j = int(next(rng) * (last + 1))
        out[last], out[j] = out[j], out[last]
    return out
