"""Block coding: 8 x 8 transforms, quantisation, zigzag runs and their sizes in bits."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.planes import at, bound, cdiv, let, clip, pixels, total, zipped

BASIS = [[math.sqrt(0.125 if u == 0 else 0.25) * math.cos(math.pi / 8 * u * (x + 0.5)) for x in range(8)] for u in range(8)]
# Weights of intra blocks, row by row.
INTRA = [
    8, 16, 19, 22, 26, 27, 29, 34,
    16, 16, 22, 24, 27, 29, 34, 37,
    19, 22, 26, 27, 29, 34, 34, 38,
    22, 22, 26, 27, 29, 34, 37, 40,
    22, 26, 27, 29, 32, 35, 40, 48,
    26, 27, 29, 32, 35, 40, 48, 58,
    26, 27, 29, 34, 38, 46, 56, 69,
    27, 29, 35, 38, 46, 56, 69, 83,
]
FLAT = [16] * 64


def zigzag() -> list[int]:
    """Places of an 8 x 8 block by diagonals, every second one upwards."""
    return sorted(range(64), key=lambda i: (s := i // 8 + i % 8, i // 8 if s % 2 else -(i // 8)))


def _product(block: Column, left: list[list[float]], by_row: bool) -> Column:
    m = F.array(*[F.array(*map(F.lit, r)) for r in left])

    def cell(i, block, m):
        a, b = cdiv(i, 8), i % 8
        line, k = (F.get(m, b.cast("int")), a) if by_row else (F.get(m, a.cast("int")), b)
        terms = [at(line, F.lit(j)) * at(block, (k * 8 + j) if by_row else (k + 8 * j)) for j in range(8)]
        return sum(terms[1:], terms[0])

    return let(block, lambda p: let(m, lambda t: pixels(64, lambda i: cell(i, p, t))))


def _round(p: Column) -> Column:
    """Half away from zero; a millionth decides nothing, so that sums of doubles in any order round alike."""
    return F.transform(p, lambda v: F.round(F.round(v, 6)).cast("long"))


def dct(block: Column) -> Column:
    """Forward transform, rounded half away from zero."""
    return _round(_product(_product(F.transform(block, lambda v: v.cast("double")), BASIS, True), BASIS, False))


def idct(block: Column) -> Column:
    back = [list(r) for r in zip(*BASIS)]
    return _round(_product(_product(F.transform(block, lambda v: v.cast("double")), back, True), back, False))


def _matrix(m: list[int]) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in m])


@bound
def quantise_intra(block: Column, scale: int, matrix: list[int] = INTRA, dc: int = 8, limit: int = 2047) -> Column:
    """The first coefficient by dc, others by matrix and scale, all rounded to nearest, held to +-limit."""

    def one(i):
        v, m = at(block, i), at(_matrix(matrix), i)
        near = lambda d: F.sign(v).cast("long") * cdiv(F.abs(v) * 2 + d, d * 2)
        return F.when(i == 0, near(F.lit(dc).cast("long"))).otherwise(clip(F.sign(v).cast("long") * cdiv(F.abs(v) * 32 + m * scale, m * (2 * scale)), -limit, limit))

    return pixels(64, one)


def quantise_inter(block: Column, scale: int, matrix: list[int] = FLAT, limit: int = 2047) -> Column:
    """Truncating division of 16 |v| by matrix x scale, sign kept, held to +-limit."""
    return zipped(block, _matrix(matrix), lambda v, m: F.sign(v).cast("long") * F.least(cdiv(F.abs(v) * 16, m * scale), F.lit(limit).cast("long")))


@bound
def _mismatch(block: Column) -> Column:
    """An even sum flips the last bit of the last coefficient."""
    last = at(block, F.lit(63))
    return F.concat(F.slice(block, 1, 63), F.array(F.when(F.pmod(total(block), F.lit(2)) == 0, last.bitwiseXOR(F.lit(1).cast("long"))).otherwise(last)))


@bound
def dequantise_intra(block: Column, scale: int, matrix: list[int] = INTRA, dc: int = 8) -> Column:
    out = pixels(64, lambda i: F.when(i == 0, at(block, i) * dc).otherwise(clip(cdiv(at(block, i) * at(_matrix(matrix), i) * scale, 16), -2048, 2047)))
    return _mismatch(out)


@bound
def dequantise_inter(block: Column, scale: int, matrix: list[int] = FLAT) -> Column:
    out = zipped(block, _matrix(matrix), lambda v, m: F.sign(v).cast("long") * F.least(cdiv((F.abs(v) * 2 + 1) * m * scale, 32), F.lit(2047).cast("long")))
    return _mismatch(out)


# What a unit coefficient is worth by the zeros before it; beyond, nothing.
UNIT_WORTH = [3, 2, 2] + [1] * 21
# Bits of the published code (table B-14) for a run of zeros (row) before levels 1, 2, ..., without sign.
CODE_BITS = [
    [2, 4, 5, 7, 8, 8, 10, 12, 12, 12, 12, 13, 13, 13, 13] + [14] * 16 + [15] * 9,
    [3, 6, 8, 10, 12, 13, 13] + [15] * 7 + [16] * 4,
    [4, 7, 10, 12, 13], [5, 8, 12, 13], [5, 10, 12], [6, 10, 13], [6, 12, 16], [6, 12], [7, 12], [7, 13], [8, 13],
    [8, 16], [8, 16], [8, 16], [10, 16], [10, 16], [10, 16],
    [12], [12], [12], [12], [12], [13], [13], [13], [13], [13], [16], [16], [16], [16], [16],
]
ESCAPE_BITS, END_BITS = 24, 2


@bound
def run_levels(block: Column) -> Column:
    """ARRAY<STRUCT<run, level>>: nonzero coefficients past the first along the zigzag, with the zeros before each."""
    scan = F.array(*[F.lit(i) for i in zigzag()])
    v = F.transform(F.slice(scan, 2, 63), lambda k, i: F.struct((i + 1).cast("long").alias("k"), at(block, k).alias("v")))
    pairs = lambda hit: F.transform(hit, lambda e, i: F.struct((e.k - F.when(i == 0, F.lit(0)).otherwise(F.get(hit, i - 1).k) - 1).alias("run"), e.v.alias("level")))
    return let(F.filter(v, lambda e: e.v != 0), pairs)


@bound
def eliminate_singles(block: Column, least: int) -> Column:
    """A block whose coefficients beyond the first are all 0 or +-1 loses them when together they are worth less than
    `least`: each is worth the more the fewer zeros stand before it. A first coefficient over 1 keeps the block whole."""
    worth = F.array(*[F.lit(v).cast("long") for v in UNIT_WORTH])
    zeroed = F.concat(F.slice(block, 1, 1), F.array_repeat(F.lit(0).cast("long"), 63))

    def rest(pairs):
        score = total(F.transform(pairs, lambda e: F.coalesce(F.get(worth, e.run.cast("int")), F.lit(0).cast("long"))))
        return F.when((at(block, F.lit(0)) <= 1) & F.forall(pairs, lambda e: F.abs(e.level) <= 1) & (score < least), zeroed).otherwise(block)

    return let(run_levels(block), rest)


def coded_bits(block: Column) -> Column:
    """Bits of a block's coefficients past the first: code and sign of each (run, level), an escape where there is no
    code, and the end mark."""
    table = F.array(*[F.array(*[F.lit(v).cast("long") for v in r]) for r in CODE_BITS])
    pair = lambda e: F.coalesce(F.get(F.get(table, e.run.cast("int")), F.abs(e.level).cast("int") - 1) + 1, F.lit(ESCAPE_BITS).cast("long"))
    return total(F.transform(run_levels(block), pair)) + END_BITS
