"""Exact fractions, difficulties, prices and emission as Spark columns over DECIMAL(38,0)."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

WHOLE = "decimal(38,0)"
#: Fixed values of the emission: units in a coin, coins at the start, target block time in seconds.
UNITS, GENESIS, BLOCK_TIME = 1_000_000_000_000, 55_000_000, 120


def whole(c: Column | int) -> Column:
    return (F.lit(Decimal(c)) if isinstance(c, int) else c).cast(WHOLE)


def quotient(a: Column, b: Column) -> Column:
    """The truncated quotient of whole numbers beyond a long: ``a`` less its remainder divides without one."""
    a, b = whole(a), whole(b)
    return whole((a - a % b) / b)


def power(x: Column, n: int) -> Column:
    """``x`` to a small power by squaring."""
    if n == 0:
        return whole(1)
    if n == 1:
        return whole(x)
    half = power(x, n // 2)
    square = whole(half * half)
    return whole(square * whole(x)) if n % 2 else square


def times(a: tuple[Column, Column], b: tuple[Column, Column]) -> tuple[Column, Column]:
    return whole(whole(a[0]) * whole(b[0])), whole(whole(a[1]) * whole(b[1]))


def plus(a: tuple[Column, Column], b: tuple[Column, Column]) -> tuple[Column, Column]:
    return whole(whole(whole(a[0]) * whole(b[1])) + whole(whole(b[0]) * whole(a[1]))), whole(whole(a[1]) * whole(b[1]))


def less(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """Whether fraction ``a`` is below ``b``, both with positive denominators."""
    return whole(whole(a[0]) * whole(b[1])) < whole(whole(b[0]) * whole(a[1]))


def exponential(x: tuple[Column, Column], terms: int) -> tuple[Column, Column]:
    """e to a fraction by its power series up to the power of ``terms``, over one denominator."""
    n, d = x
    factorial = 1
    for k in range(2, terms + 1):
        factorial *= k
    top, under = whole(0), 1
    for k in range(terms + 1):
        under = under * k if k else 1
        top = whole(top + whole(whole(power(n, k) * power(d, terms - k)) * whole(factorial // under)))
    return top, whole(power(d, terms) * whole(factorial))


def halved(x: tuple[Column, Column], most: int) -> tuple[Column, Column]:
    """A fraction halved on both sides until neither exceeds ``most``; a side that would vanish is 1, the other ``most`` at most."""
    n, d = whole(x[0]), whole(x[1])
    steps = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(n, d).cast("double") / most))).cast("int")
    by = F.pow(F.lit(2.0), steps).cast(WHOLE)
    a, b = quotient(n, by), quotient(d, by)
    return F.when(b < 1, whole(most)).otherwise(F.when((a < 1) & (n > 0), whole(1)).otherwise(a)), F.when(b < 1, whole(1)).when((a < 1) & (n > 0), whole(most)).otherwise(b)


def hash_rate(diff: Column, most: int) -> Column:
    """Hashes that a solution takes: the greatest difficulty over what it leaves."""
    return quotient(whole(most), whole(most) - whole(diff))


def scaled_difficulty(diff: Column, up: int, down: int, least: int, most: int) -> Column:
    """A difficulty made ``up / down`` times as hard, held to its bounds."""
    inverse = quotient(whole(whole(most) - whole(diff)) * whole(down), whole(up))
    return F.greatest(whole(least), F.least(whole(most) - inverse, whole(most - 1)))


def shared_difficulty(diff: Column, n: int, most: int) -> Column:
    """The difficulty at which ``n`` tries do as well as one at ``diff``, by the first terms of the series."""
    left = whole(whole(most) - whole(diff))
    top = whole(whole(left * whole(2 * n * most)) + whole(whole(left * left) * whole(n - 1)))
    under = 2 * n * n * most * most
    return quotient(whole(whole(most * under) - whole(top * whole(most))), whole(under))


def log_difficulty(diff: Column, bits: int) -> Column:
    return F.lit(float(bits)) - F.log2((whole(1 << bits) - whole(diff)).cast("double"))


def emission(height: Column) -> Column:
    """Coins set free by a block, halving every year of blocks."""
    year = 365 * 24 * 3600 // BLOCK_TIME
    return F.lit(0.2 * GENESIS * UNITS) * F.pow(F.lit(2.0), -height.cast("double") / year) * F.log(F.lit(2.0)) / year
