"""Random sequences of the PCG family and permutations (H-20, H-21)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The published multipliers and increments of the 64-bit and the 128-bit generator.
MULTIPLIER, INCREMENT = 6364136223846793005, 1442695040888963407
MULTIPLIER_128, INCREMENT_128 = 0x2360ED051FC65DA44385DF649FCCF645, 0x5851F42D4C957F2D14057B7EF767814F
M32, M64, M128 = (1 << 32) - 1, (1 << 64) - 1, (1 << 128) - 1


def _right(v: int, by: int, size: int) -> int:
    by %= size
    return (v >> by | v << (size - by)) & ((1 << size) - 1)


def _xsh_rr(s: int) -> int:
    return _right((s ^ s >> 18) >> 27 & M32, s >> 59, 32)


def _xsh_rs(s: int) -> int:
    return (s ^ s >> 22) >> 22 + (s >> 61) & M32


def _rxs_m_xs(s: int) -> int:
    w = (s >> (s >> 59) + 5 ^ s) * 12605985483714917081 & M64
    return w >> 43 ^ w


def _xsl_rr_rr(s: int) -> int:
    low = _right(s >> 64 ^ s & M64, s >> 122, 64)
    return _right(s >> 64, low & 63, 64) << 64 | low


def _xsl_rr(s: int) -> int:
    return _right(s >> 64 ^ s & M64, s >> 122, 64)


#: kind -> output function, bits of the output, bits of the state, increment, whether the state steps before the output
KINDS = {
    "xsh_rr": (_xsh_rr, 32, M64, MULTIPLIER, INCREMENT, False),
    "xsh_rs": (_xsh_rs, 32, M64, MULTIPLIER, INCREMENT, False),
    "rxs_m_xs": (_rxs_m_xs, 64, M64, MULTIPLIER, INCREMENT, False),
    "xsl_rr_rr": (_xsl_rr_rr, 128, M128, MULTIPLIER_128, INCREMENT_128, False),
    "mcg_xsl_rr": (_xsl_rr, 64, M128, MULTIPLIER_128, 0, True),
}


def draws(seed: int, kind: str = "xsh_rr") -> Iterator[int]:
    """H-20: outputs of a generator seeded with 2 seed + 1."""
    output, _, mask, times, plus, before = KINDS[kind]
    s = (2 * seed + 1) & mask
    while True:
        following = (s * times + plus) & mask
        yield output(following if before else s)
        s = following


def draws_64(seed: int, kind: str = "xsh_rr") -> Iterator[int]:
    """64 bits each: two draws of 32 bits, high half first, or the low half of a wider draw."""
    source, size = draws(seed, kind), KINDS[kind][1]
    while True:
        yield next(source) << 32 | next(source) if size == 32 else next(source) & M64


def below(seed: int, limit: int, kind: str = "xsh_rr") -> Iterator[int]:
    """H-20: numbers from 0 to limit - 1 without modulo bias: draws from the last, partial span on are drawn again."""
    span = limit if limit & (limit - 1) == 0 else (1 << 31) - (1 << 31) % limit
    for v in draws(seed, kind):
        if limit & (limit - 1) == 0:
            yield v & M32 & (limit - 1)
        elif v & M32 < span:
            yield (v & M32) % limit


def random_numbers(seed: Column, count: int, kind: str = "xsh_rr") -> Column:
    """The first `count` 64-bit draws of each row's seed, as signed longs."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def run(seeds: pd.Series) -> pd.Series:
        signed = lambda v: v - (1 << 64) if v >> 63 else v
        return seeds.map(lambda s: None if pd.isna(s) else [signed(v) for _, v in zip(range(count), draws_64(int(s), kind))])

    return run(seed)


def in_range(draw: Column, low: float, high: float) -> Column:
    """H-20: a 64-bit draw, read without sign, as a number from low to high."""
    unit = F.when(draw < 0, draw.cast("double") + 18446744073709551616.0).otherwise(draw.cast("double")) / 18446744073709551615.0
    return F.lit(low) + unit * (high - low)


def orders(n: int) -> Iterator[list[int]]:
    """H-21: all orders of n things by Heap's method, each one swap from the one before."""
    held = list(range(n))

    def through(k: int) -> Iterator[list[int]]:
        if k <= 1:
            yield list(held)
            return
        for i in range(k):
            yield from through(k - 1)
            if i < k - 1:
                j = 0 if k % 2 else i
                held[j], held[k - 1] = held[k - 1], held[j]

    yield from through(n)


@F.udtf(returnType="ordinal: bigint, items: array<string>")
class Permutations:
    """H-21: a row for each order of an array's items, one in memory at a time; null and the empty array have one order, empty."""

    def eval(self, items: list):
        items = items or []
        for i, order in enumerate(orders(len(items))):
            yield i, [items[j] for j in order]
