"""Units, cosmology, gravity and phase space, as Column expressions."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

from trackweave.functions.geometry import Vec, col, norm2

#: Gravity for 1e10 solar masses, Mpc and km/s; the softening kernel's extent in softenings.
GRAVITY, KERNEL = 43.0071, 2.8
#: Coefficients of u = r / h, from the constant upwards, of the spline potential for u below and above
#: one half (the latter with 1 / (15 u) besides), and of the spline density below one half.
INNER = (-2.8, 0.0, 16 / 3, 0.0, -9.6, 6.4)
OUTER = (-3.2, 0.0, 32 / 3, -16.0, 9.6, -32 / 15)
DENSITY = (8 / pi, 0.0, -48 / pi, 48 / pi)


def polynomial(coefficients, u):
    """A polynomial's value, of a Column or an array."""
    out = coefficients[-1]
    for c in reversed(coefficients[:-1]):
        out = out * u + c
    return out


def gravity(mass_in_msunh: Column | str, length_in_mpch: Column | str, vel_in_kms: Column | str) -> Column:
    """The gravitational constant in units of the given mass, length and velocity."""
    v = col(vel_in_kms)
    return F.lit(GRAVITY) * (col(mass_in_msunh) / 1e10) / (v * v) / col(length_in_mpch)


def hubble_today(length_in_mpch: Column | str, vel_in_kms: Column | str) -> Column:
    return F.lit(100.0) * col(length_in_mpch) / col(vel_in_kms)


def hubble(a: Column | str, omega_m: Column | str, omega_l: Column | str, h0: Column) -> Column:
    """H(a) from the density parameters, with curvature for what is missing to 1."""
    a, m, lam = col(a), col(omega_m), col(omega_l)
    return h0 * F.sqrt(m / (a * a * a) + (1 - m - lam) / (a * a) + lam)


def softening(comoving: Column | str, max_physical: Column | str, a: Column | str) -> Column:
    """The comoving softening in force; a max_physical of -1 or null sets no bound."""
    c, p = col(comoving), col(max_physical)
    return F.when(p.isNull() | (p < 0), c).otherwise(F.least(c, p / col(a)))


def is_tracer(kind: Column | str, mask: int) -> Column:
    """Whether bit `kind` of the mask is set."""
    return F.coalesce(F.call_function("shiftleft", F.lit(1), col(kind).cast("int")).bitwiseAND(F.lit(mask)) != 0, F.lit(False))


def type_mask(kinds: tuple[int, ...]) -> int:
    """The mask of a set of types; -1 alone stands for none."""
    return 0 if kinds == (-1,) else sum(1 << k for k in set(kinds))


def is_bound(energy: Column | str) -> Column:
    return F.coalesce(col(energy) < 0, F.lit(False))


def potential_kernel(r: Column, h: Column) -> Column:
    """Potential of a unit mass at distance r for G = 1: a softened spline within h, a point mass beyond."""
    u = r / h
    inner, outer = polynomial(INNER, u), polynomial(OUTER, u) + 1 / (15 * u)
    return F.when(r >= h, -1 / r).when(u < 0.5, inner / h).otherwise(outer / h)


def binding_energy(dv: Vec, potential: Column, u: Column | None = None) -> Column:
    """Specific kinetic energy of the relative velocity plus potential, plus thermal energy if given."""
    e = norm2(dv) * 0.5 + potential
    return e if u is None else e + F.coalesce(u, F.lit(0.0))


def phase_space_distance(dx2: Column, dv2: Column, sigma_r: Column, sigma_v: Column) -> Column:
    """Separation in units of the reference's spreads; below 2 two objects overlap. A spread of 0 gives null."""
    return F.sqrt(dx2) / F.nullif(sigma_r, F.lit(0.0)) + F.sqrt(dv2) / F.nullif(sigma_v, F.lit(0.0))


def sph_kernel(r: Column, h: Column) -> Column:
    """The cubic spline of unit mass with extent h."""
    u = r / h
    gap = 1 - u
    far = F.lit(16 / pi) * gap * gap * gap
    return F.when(u < 0.5, polynomial(DENSITY, u)).otherwise(far) / (h * h * h)


def virial_density(factor: float, hz: Column | str, a: Column | str, g: Column | float = GRAVITY) -> Column:
    """Comoving mass within r over r cubed at `factor` times the critical density."""
    h, s = col(hz), col(a)
    return F.lit(factor) * h * h / 2.0 / (col(g)) * s * s * s
