"""Scalar column functions: tags, ratings, angles and complex numbers held as two double columns."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, functions as F


def canonical_tag(c: Column) -> Column:
    """Device tag without outer blanks and one pair of quotes, cut at the first inner blank. Null stays null."""
    bare = F.regexp_replace(F.trim(c), r"^(['\"])(.*)\1$", "$2")
    return F.substring_index(F.trim(bare), " ", 1)


def padded_tag(c: Column) -> Column:
    """The two-character form used in exports."""
    return F.rpad(canonical_tag(c), 2, " ")


def csv_field(c: Column) -> Column:
    """Quoted if it holds a comma, quote, CR or LF; inner quotes are doubled."""
    return F.when(c.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def rounded6(c: Column) -> Column:
    """A double rounded to six places, halves away from zero, in double arithmetic (``round`` goes through decimals, which costs far more). Values of
    9e12 and more, which have hardly six places, NaN and infinities stay."""
    return F.when(F.abs(c) < 9e12, F.signum(c) * F.floor(F.abs(c) * 1e6 + 0.5) / 1e6).otherwise(c) + 0.0


def circular_diff(a: Column, b: Column) -> Column:
    """a - b in degrees, wrapped into [-180, 180)."""
    return F.pmod(a - b + 180.0, F.lit(360.0)) - 180.0


def power_angle(angle: Column, reference: Column) -> Column:
    """Angle against a reference in degrees, wrapped into [-180, 180)."""
    return circular_diff(angle, reference)


def select_rating(which: str | Column, a: Column, b: Column, c: Column) -> Column:
    """A: a. B: b if positive, else a. C: c if positive, else b if positive, else a. Nulls count as absent."""
    which = F.lit(which) if isinstance(which, str) else which
    b_or_a = F.when(b > 0, b).otherwise(a)
    return F.when(which == "C", F.when(c > 0, c).otherwise(b_or_a)).when(which == "B", b_or_a).otherwise(a)


class Complex(NamedTuple):
    """A complex value as (re, im) columns, so that expressions stay in generated code."""

    re: Column
    im: Column

    def __add__(self, o: Complex) -> Complex:  # type: ignore[override]
        return Complex(self.re + o.re, self.im + o.im)

    def __sub__(self, o: Complex) -> Complex:
        return Complex(self.re - o.re, self.im - o.im)

    def __neg__(self) -> Complex:
        return Complex(-self.re, -self.im)

    def times(self, o: Complex) -> Complex:
        return Complex(self.re * o.re - self.im * o.im, self.re * o.im + self.im * o.re)

    def over(self, o: Complex) -> Complex:
        """Quotient; null where the divisor is zero."""
        d = o.re * o.re + o.im * o.im
        d = F.when(d != 0, d)
        return Complex((self.re * o.re + self.im * o.im) / d, (self.im * o.re - self.re * o.im) / d)

    def scaled(self, k: Column | float) -> Complex:
        return Complex(self.re * k, self.im * k)

    def conj(self) -> Complex:
        return Complex(self.re, -self.im)

    def abs(self) -> Column:
        return F.hypot(self.re, self.im)

    def where(self, keep: Column) -> Complex:
        """Zero where ``keep`` doesn't hold."""
        return Complex(F.when(keep, self.re).otherwise(0.0), F.when(keep, self.im).otherwise(0.0))

    def exp(self) -> Complex:
        return Complex(F.exp(self.re) * F.cos(self.im), F.exp(self.re) * F.sin(self.im))

    def reciprocal(self) -> Complex:
        return Complex(F.lit(1.0), F.lit(0.0)).over(self)


def named(prefix: str) -> Complex:
    """The columns prefix_re and prefix_im."""
    return Complex(F.col(f"{prefix}_re"), F.col(f"{prefix}_im"))


def polar(size: Column, degrees: Column) -> Complex:
    return Complex(size * F.cos(F.radians(degrees)), size * F.sin(F.radians(degrees)))


def columns(prefix: str, z: Complex) -> dict[str, Column]:
    return {f"{prefix}_re": z.re, f"{prefix}_im": z.im}
