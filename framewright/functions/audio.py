"""Column expressions over arrays of whole samples: rates, channels, widths, frames, fades."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .planes import at, bound, cdiv, pixels


@bound
def resample(s: Column, n: int, rate_in: int, rate_out: int) -> Column:
    """n samples at one rate -> n * rate_out / rate_in at another, on the line between neighbours; the last one stays."""

    def one(k):
        i, r = cdiv(k * rate_in, rate_out), (k * rate_in) % rate_out
        a = at(s, i)
        return cdiv(a * (rate_out - r) + F.coalesce(at(s, i + 1), a) * r, rate_out)

    return pixels(n * rate_out // rate_in, one)


@bound
def to_mono(s: Column, n: int) -> Column:
    """The mean of each pair of samples, left and right."""
    return pixels(n // 2, lambda k: cdiv(at(s, k * 2) + at(s, k * 2 + 1), 2))


def to_stereo(s: Column) -> Column:
    return F.flatten(F.transform(s, lambda v: F.array(v, v)))


def widen(s: Column) -> Column:
    """Unsigned 8-bit samples as signed 16-bit ones."""
    return F.transform(s, lambda v: (v - 128) * 256)


def fade_out(s: Column, n: int) -> Column:
    """Samples on their way to silence: sample k is multiplied by exp(-ln(256) / (n + 1) * k)."""
    rate = -math.log(256) / (n + 1)
    return F.transform(s, lambda v, k: F.round(F.round(v * F.exp(k * rate), 6)).cast("long"))


def hann(n: int) -> Column:
    """The n weights of a raised-cosine window."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: 0.5 * (1 - F.cos(k * (2 * math.pi / n))))


def add_decibels(a: Column, b: Column) -> Column:
    """The level of two powers together."""
    return 10 * F.log10(F.pow(F.lit(10.0), a / 10) + F.pow(F.lit(10.0), b / 10))
