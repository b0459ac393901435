"""Keyed randomness: draws are functions of (seed, row key, draw number) only.

Retries, repartitioning and reruns give the same draw. A public seed voids privacy: noise for a
release takes a secret seed and ``bits=52``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed, key: Column, draw=0, bits: int = 32) -> Column:
    """A number in (0, 1), from the first 8 (or 13) hex digits of md5(seed|key|draw)."""
    digits = {32: 8, 52: 13}[bits]
    draw = draw if isinstance(draw, Column) else F.lit(draw)
    text = F.concat_ws("|", F.lit(str(seed)), key.cast("string"), draw.cast("string"))
    number = F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")
    return (number + 0.5) / float(1 << bits)


def gaussian(seed, key: Column, draw: int = 0, bits: int = 32) -> Column:
    """A standard normal draw (Box-Muller of two uniforms)."""
    u, v = uniform(seed, key, 2 * draw, bits), uniform(seed, key, 2 * draw + 1, bits)
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)


def gumbel(seed, key: Column, draw=0) -> Column:
    return -F.log(-F.log(uniform(seed, key, draw)))
