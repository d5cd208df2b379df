"""Scalar functions: ratios, time codes, rounding, bit and byte order, checks, resampling weights."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .planes import cdiv

# Frame rates by code, from 1 on (numerator, denominator).
FRAME_RATES = [(24000, 1001), (24, 1), (25, 1), (30000, 1001), (30, 1), (50, 1), (60000, 1001), (60, 1)]
# Whole frames a second by frame rate code.
WHOLE_RATES = [24, 24, 25, 30, 30, 50, 60, 60]
# Sample aspects in the order in which a guess takes them.
SAMPLE_ASPECTS = [(1, 1), (10, 11), (40, 33), (59, 54), (118, 81)]


def ratio_reduce(n: Column, d: Column) -> Column:
    """STRUCT<n, d> in lowest terms; 0:0 (unknown) and n:0 stay as they are. Euclid's steps fold over a fixed sequence:
    a 63-bit pair needs at most 91."""
    start = F.struct(F.abs(n).cast("long").alias("a"), F.abs(d).cast("long").alias("b"))
    step = lambda s, _: F.when(s.b == 0, s).otherwise(F.struct(s.b.alias("a"), F.when(s.b == 0, F.lit(0)).otherwise(s.a % F.nullif(s.b, F.lit(0))).cast("long").alias("b")))
    g = F.aggregate(F.sequence(F.lit(1), F.lit(91)), start, step, lambda s: F.greatest(s.a, F.lit(1)))
    return F.struct(cdiv(n, g).alias("n"), cdiv(d, g).alias("d"))


def parse_ratio(text: Column) -> Column:
    """'n:d' -> STRUCT<n, d>; null where it isn't one, or where the denominator is 0 under a numerator other than 0."""
    n = F.regexp_extract(text, r"^\s*(-?\d+):(-?\d+)\s*$", 1).try_cast("long")
    d = F.regexp_extract(text, r"^\s*(-?\d+):(-?\d+)\s*$", 2).try_cast("long")
    return F.when(n.isNotNull() & d.isNotNull() & ~((d == 0) & (n != 0)), F.struct(n.alias("n"), d.alias("d")))


def guess_sample_aspect(w: Column, h: Column, dar_n: Column, dar_d: Column) -> Column:
    """The first listed sample aspect within 3 % of what shows w x h at the display aspect; 0:0 if none is."""
    implied = dar_n * h / F.nullif(dar_d * w, F.lit(0))
    out = F.struct(F.lit(0).alias("n"), F.lit(0).alias("d"))
    for n, d in reversed(SAMPLE_ASPECTS):
        rel = implied / (n / d)
        out = F.when((rel > 0.97) & (rel < 1.03), F.struct(F.lit(n).alias("n"), F.lit(d).alias("d"))).otherwise(out)
    return out


def frame_rate(code: Column) -> Column:
    """STRUCT<n, d> of a frame rate code; null for codes that stand for none."""
    table = F.array(*[F.struct(F.lit(n).cast("long").alias("n"), F.lit(d).cast("long").alias("d")) for n, d in FRAME_RATES])
    return F.get(table, code.cast("int") - 1)


def frame_rate_code(n: Column, d: Column) -> Column:
    """The code of a frame rate, 0 for one without."""
    out = F.lit(0)
    for i, (a, b) in enumerate(FRAME_RATES, 1):
        out = F.when(n * b == d * a, i).otherwise(out)
    return out


def parse_geometry(text: Column) -> Column:
    """'WxH' or 'WxH+X+Y' (signs of X and Y at will) -> STRUCT<w, h, x, y>, x and y 0 where not told; else null."""
    rule = r"^(\d+)x(\d+)(?:([+-]\d+)([+-]\d+))?$"
    part = lambda k: F.regexp_extract(text, rule, k).try_cast("long")
    return F.when(part(1).isNotNull(), F.struct(part(1).alias("w"), part(2).alias("h"), F.coalesce(part(3), F.lit(0)).alias("x"), F.coalesce(part(4), F.lit(0)).alias("y")))


def add_tag(tags: Column, tag: Column) -> Column:
    """A tag behind the others, once."""
    return F.when(F.array_contains(tags, tag), tags).otherwise(F.array_append(tags, tag))


def drop_tag(tags: Column, tag: Column) -> Column:
    return F.filter(tags, lambda t: t != tag)


def merge_tags(a: Column, b: Column) -> Column:
    """a, and what of b is not in a."""
    return F.concat(a, F.filter(b, lambda t: ~F.array_contains(a, t)))


def matches(name: Column, pattern: Column, mode: str, case: bool = True) -> Column:
    """Whether a name is, begins with, ends with or holds a pattern."""
    a, b = (name, pattern) if case else (F.lower(name), F.lower(pattern))
    return {"equal": a == b, "start": F.startswith(a, b), "end": F.endswith(a, b), "anywhere": F.contains(a, b)}[mode]


def guide_time(days: Column, slot: Column) -> Column:
    """A listing page's day and second -> seconds since 1970, on whole five minutes."""
    return F.floor((days * 86400 + slot + 290) / 300) * 300


def time_code(f: Column, code: int = 5) -> Column:
    """Frame number -> STRUCT<h, m, s, f> at the whole rate of a frame rate code."""
    r = WHOLE_RATES[code - 1]
    s = cdiv(f, r)
    return F.struct(cdiv(s, 3600).alias("h"), (cdiv(s, 60) % 60).alias("m"), (s % 60).alias("s"), (f % r).alias("f"))


def time_code_drop(f: Column, code: int = 4) -> Column:
    """Drop-frame time code: each minute but every tenth leaves out its first two labels (at 30; four at 60)."""
    r = WHOLE_RATES[code - 1]
    skip = r // 15
    per_minute, per_ten = 60 * r - skip, 600 * r - 9 * skip
    tens, rest = cdiv(f, per_ten), f % per_ten
    more = F.when(rest < 60 * r, F.lit(0).cast("long")).otherwise(cdiv(rest - skip, per_minute))
    label = f + tens * 9 * skip + more * skip
    return time_code(label, code)


def parse_time_code(text: Column, rate: int) -> Column:
    """'h:m:s.f', with leading parts left out at will -> frames; null where it is no time code."""
    got = F.regexp_extract(text, r"^(?:(?:(\d+):)?(\d+):)?(\d+)(?:\.(\d+))?$", 0)
    part = lambda k: F.coalesce(F.regexp_extract(text, r"^(?:(?:(\d+):)?(\d+):)?(\d+)(?:\.(\d+))?$", k).try_cast("long"), F.lit(0))
    return F.when(got != "", ((part(1) * 60 + part(2)) * 60 + part(3)) * rate + part(4))


def round_away(v: Column) -> Column:
    """Rounds half away from zero."""
    return F.round(v).cast("long")


def round_to(v: Column, step: int) -> Column:
    """The nearest multiple of step, half away from zero."""
    return round_away(v / step) * step


def search_radius(r: Column) -> Column:
    """A radius rounded to a multiple of 8, halves up, 8 at least."""
    return F.greatest(cdiv(r + 4, 8) * 8, F.lit(8))


def to_bcd(v: Column) -> Column:
    return cdiv(v, 10) * 16 + v % 10


def from_bcd(v: Column) -> Column:
    return cdiv(v, 16) * 10 + v % 16


def swap16(v: Column) -> Column:
    return F.shiftleft(v.bitwiseAND(255), 8).bitwiseOR(F.shiftrightunsigned(v, 8).bitwiseAND(255))


def swap32(v: Column) -> Column:
    byte = lambda k: F.shiftrightunsigned(v, 8 * k).bitwiseAND(255)
    return byte(0) * (1 << 24) + byte(1) * (1 << 16) + byte(2) * (1 << 8) + byte(3)


def crc16(values: Column, polynomial: int = 0x8005, start: int = 0xFFFF) -> Column:
    """CRC-16 of an array of byte values, most significant bit first."""
    # the eight bits of a byte fold one by one, so that the expression stays small
    bits = F.flatten(F.transform(values, lambda v: F.transform(F.sequence(F.lit(7), F.lit(0), F.lit(-1)), lambda k: F.call_function("shiftright", v.cast("long"), k).bitwiseAND(1))))
    return F.aggregate(bits, F.lit(start).cast("long"), lambda c, b: F.shiftleft(c, 1).bitwiseAND(0xFFFF).bitwiseXOR(F.shiftright(c, 15).bitwiseXOR(b).bitwiseAND(1) * polynomial))


def substitute(template: Column, values: dict[str, Column]) -> Column:
    """Replaces each $key of a command template."""
    for k, v in values.items():
        template = F.replace(template, F.lit(f"${k}"), v.cast("string"))
    return template


def between_points(points: list[tuple[int, int]], at: Column) -> Column:
    """A parameter at a frame, on the line between control points (frame, value), truncated; the ends hold beyond them."""
    out = F.lit(points[-1][1])
    for (a, x), (b, y) in reversed(list(zip(points, points[1:]))):
        out = F.when(at < b, F.lit(x) + cdiv((at - a) * (y - x), b - a)).otherwise(out)
    return F.when(at < points[0][0], points[0][1]).otherwise(out)


# Weights of the resampler: kernel name -> (support, k(t) for t >= 0).


def _spline(b: float, c: float):
    def k(t):
        if t < 1:
            return ((12 - 9 * b - 6 * c) * t**3 + (-18 + 12 * b + 6 * c) * t * t + 6 - 2 * b) / 6
        return ((-b - 6 * c) * t**3 + (6 * b + 30 * c) * t * t + (-12 * b - 48 * c) * t + 8 * b + 24 * c) / 6

    return k


def _sinc(t):
    return 1.0 if t == 0 else math.sin(math.pi * t) / (math.pi * t)


def _keys4(t):
    """Fourth-order cubic convolution with support 3."""
    if t < 1:
        return (3 + t * t * (-7 + 4 * t)) / 3
    if t < 2:
        return (30 + t * (-59 + t * (36 - 7 * t))) / 12
    return (t - 3) ** 2 * (t - 2) / 12


KERNELS = {
    "box": (0.5, lambda t: 1.0),
    "linear": (1.0, lambda t: 1 - t),
    "quadratic": (1.5, lambda t: 0.75 - t * t if t < 0.5 else 0.5 * (t - 1.5) ** 2),
    "cubicB": (2.0, _spline(1, 0)),
    "cubic": (2.0, _spline(1 / 3, 1 / 3)),
    "cubicCR": (2.0, _spline(0, 0.5)),
    "cubicK4": (3.0, _keys4),
    "sinc4hann": (4.0, lambda t: _sinc(t) * (0.5 + 0.5 * math.cos(math.pi * t / 4))),
    "sinc4lan": (4.0, lambda t: _sinc(t) * _sinc(t / 4)),
    "sinc8lan": (8.0, lambda t: _sinc(t) * _sinc(t / 8)),
    "sinc": (16.0, _sinc),
}


def resample_weights(n: int, m: int, kernel: str) -> list[list[tuple[int, float]]]:
    """For each of m outputs, the (input, weight) pairs over n inputs; weights sum to 1, inputs are clamped to the plane.

    Output q looks at (q + 0.5) / scale - 0.5; the kernel is stretched when shrinking."""
    support, k = KERNELS[kernel]
    scale = m / n
    stretch = max(1.0, 1 / scale)
    out = []
    for q in range(m):
        centre = (q + 0.5) / scale - 0.5
        lo, hi = math.ceil(centre - support * stretch), math.floor(centre + support * stretch)
        w: dict[int, float] = {}
        for p in range(lo, hi + 1):
            t = abs(p - centre) / stretch
            if t <= support and (v := k(t)):
                c = min(max(p, 0), n - 1)
                w[c] = w.get(c, 0.0) + v
        s = sum(w.values())
        out.append([(p, v / s) for p, v in sorted(w.items())])
    return out


def fir_taps(length: int, bandwidth: float) -> list[list[float]]:
    """Low-pass taps (centre and one side) for half-lengths 0..length: windowed sinc, normalised to sum 1."""
    out = []
    for k in range(length + 1):
        t = [bandwidth] + [bandwidth * _sinc(bandwidth * n) * _sinc(2 * n / (2 * k + 1)) for n in range(1, k + 1)]
        s = t[0] + 2 * sum(t[1:])
        out.append([v / s for v in t])
    return out


def gaussian_taps(radius: float) -> list[float]:
    """Blur taps (centre and one side) of a Gaussian of deviation |radius| + 1 over twice that distance, each tap the
    mean of 50 samples across its pixel."""
    std = abs(radius) + 1
    n = max(1, int(math.ceil(2 * std)))
    g = lambda x: math.exp(-x * x / (2 * std * std))
    t = [sum(g(i - 0.5 + (j + 0.5) / 50) for j in range(50)) / 50 for i in range(n + 1)]
    s = t[0] + 2 * sum(t[1:])
    return [v / s for v in t]
