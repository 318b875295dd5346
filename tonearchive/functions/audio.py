"""Column functions: decibels, loudness, finiteness, and the rounding that results are published with."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Loudness offset in LU (fixed value of the loudness definition).
OFFSET = -0.691


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    """True for a number that is neither null, NaN nor infinite."""
    c = col(c)
    return F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))


def half_up(c: Column | str, digits: int = 0) -> Column:
    """Rounded half up, towards plus infinity, to so many decimals."""
    scale = 10.0**digits
    return F.floor(col(c) * scale + 0.5) / scale


def down(c: Column | str, digits: int = 1) -> Column:
    scale = 10.0**digits
    return F.floor(col(c) * scale) / scale


def published(c: Column | str) -> Column:
    """Six decimals, no negative zero; a number that is not finite becomes null."""
    return F.when(finite(c), half_up(c, 6) + 0.0)


def db(amplitude: Column | str) -> Column:
    """Amplitude in decibels; null where silence would give minus infinity."""
    a = col(amplitude)
    return F.when(a > 0, 20 * F.log10(a))


def power_db(energy: Column | str) -> Column:
    e = col(energy)
    return F.when(e > 0, 10 * F.log10(e))


def lufs(energy: Column | str) -> Column:
    e = col(energy)
    return F.when(e > 0, OFFSET + 10 * F.log10(e))


def energy(loudness: Column | str) -> Column:
    """Inverse of ``lufs``."""
    return F.pow(F.lit(10.0), (col(loudness) - OFFSET) / 10)


def gain(decibels: Column | str) -> Column:
    return F.pow(F.lit(10.0), col(decibels) / 20)


def when_first(*rules: tuple[Column, str], otherwise: str | None = None) -> Column:
    """The text of the first rule that holds."""
    out = F
    for condition, text in rules:
        out = out.when(condition, F.lit(text))
    return out.otherwise(F.lit(otherwise)) if otherwise is not None else out


def all_that_hold(*rules: tuple[Column, str]) -> Column:
    """The texts of all rules that hold, in order, as an array."""
    return F.filter(F.array(*[F.when(condition, F.lit(text)) for condition, text in rules]), lambda x: x.isNotNull())
