"""Vector and potential-field kernels as Column expressions (pure, code-generated)."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]
EPS = 1e-15
#: Gravitational constant, g/cc to kg/m3, m/s2 to mGal.
G_MGAL = 6.67430e-11 * 1000.0 * 1e5
MU0 = 4e-7 * pi


def vec(*names: str) -> Vec:
    return tuple(F.col(n) for n in names)


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(x - y for x, y in zip(a, b, strict=True))


def scale(a: Vec, k) -> Vec:
    return tuple(x * k for x in a)


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def triple(a: Vec, b: Vec, c: Vec) -> Column:
    return dot(a, cross(b, c))


def tetra_volume(a: Vec, b: Vec, c: Vec, d: Vec) -> Column:
    """Signed volume of a tetrahedron."""
    return triple(sub(b, a), sub(c, a), sub(d, a)) / 6.0


def solid_angle(a: Vec, b: Vec, c: Vec, o: Vec) -> Column:
    """Solid angle of a triangle seen from ``o`` (van Oosterom-Strackee); 0 at a corner."""
    ra, rb, rc = sub(a, o), sub(b, o), sub(c, o)
    la, lb, lc = norm(ra), norm(rb), norm(rc)
    below = la * lb * lc + dot(ra, rb) * lc + dot(ra, rc) * lb + dot(rb, rc) * la
    at_corner = F.least(la, lb, lc) < EPS
    return F.when(at_corner, 0.0).otherwise(2.0 * F.atan2(triple(ra, rb, rc), below))


def edge_log(a: Vec, b: Vec, o: Vec) -> Column:
    """Logarithmic term of an edge seen from ``o``; 0 where it is singular or the edge is a point."""
    e = sub(b, a)
    length = norm(e)
    ra, rb = sub(a, o), sub(b, o)
    upper = dot(rb, e) / length + norm(rb)
    lower = dot(ra, e) / length + norm(ra)
    fine = (length >= EPS) & (F.abs(lower) >= EPS) & (upper > 0) & (lower > 0)
    return F.when(fine, F.ln(upper / lower)).otherwise(0.0)


def normal(a: Vec, b: Vec, c: Vec, least: float = EPS) -> tuple[Vec, Column]:
    """(unit normal, twice the area); the zero vector for a degenerate triangle."""
    n = cross(sub(b, a), sub(c, a))
    size = norm(n)
    return tuple(F.when(size < least, 0.0).otherwise(x / size) for x in n), size


def surface_term(a: Vec, b: Vec, c: Vec, o: Vec) -> Column:
    """Solid angle times the height of the triangle's plane over ``o``."""
    n, size = normal(a, b, c)
    return F.when(size < EPS, 0.0).otherwise(solid_angle(a, b, c, o) * dot(sub(a, o), n))


def _edges(a: Vec, b: Vec, c: Vec, n: Vec):
    """(start, end, in-plane normal) of the three edges; a degenerate edge has a null normal."""
    for p, q in ((a, b), (b, c), (c, a)):
        e = sub(q, p)
        size = norm(e)
        yield p, q, cross(n, scale(e, F.when(size >= EPS, 1.0 / size)))


def gravity_facet(a: Vec, b: Vec, c: Vec, o: Vec) -> Column:
    """Vertical attraction factor of a facet of uniform density; 0 for a degenerate facet."""
    n, size = normal(a, b, c)
    rim = F.lit(0.0)
    for p, q, out in _edges(a, b, c, n):
        rim = rim + F.coalesce(dot(sub(o, p), out) * edge_log(p, q, o), F.lit(0.0))
    return F.when(size < EPS, 0.0).otherwise(n[2] * (rim - dot(sub(a, o), n) * solid_angle(a, b, c, o)))


def tmi_facet(a: Vec, b: Vec, c: Vec, o: Vec, m: Vec, f: Vec) -> Column:
    """Total-field factor of a facet with magnetisation direction ``m`` in the field ``f``."""
    n, size = normal(a, b, c)
    inner = dot(f, n) * solid_angle(a, b, c, o)
    for p, q, out in _edges(a, b, c, n):
        inner = inner + F.coalesce(dot(f, out) * edge_log(p, q, o), F.lit(0.0))
    return F.when(size < EPS, 0.0).otherwise(dot(m, n) * inner)


def tmi_facet_ascoded(a: Vec, b: Vec, c: Vec, o: Vec, m: Vec, f: Vec) -> Column:
    """The variant whose edge term carries m.t instead of m.n (kept for comparison; not a dipole)."""
    n, size = normal(a, b, c)
    total = dot(m, n) * dot(f, n) * solid_angle(a, b, c, o)
    for p, q, out in _edges(a, b, c, n):
        total = total + F.coalesce(dot(m, out) * dot(f, out) * edge_log(p, q, o), F.lit(0.0))
    return F.when(size < EPS, 0.0).otherwise(total)


def field_unit(inclination: Column, declination: Column) -> Vec:
    """Unit vector of a field from inclination and declination in degrees; z is up."""
    i, d = F.radians(inclination), F.radians(declination)
    return (F.cos(i) * F.cos(d), F.cos(i) * F.sin(d), -F.sin(i))


def magnetisation(susceptibility: Column, field_nt: float, field: Vec, mode: str, remanence: Vec | None = None) -> tuple[Column, Vec]:
    """(amplitude in A/m, direction) of induced plus remanent magnetisation.

    ``mode``: 'effective' ignores remanence, 'vector' adds the vector ``remanence``; a body
    without magnetisation has the direction of the field.
    """
    induced = scale(field, susceptibility * (field_nt / 100.0))
    total = induced if mode == "effective" or remanence is None else tuple(x + F.coalesce(y, F.lit(0.0)) for x, y in zip(induced, remanence, strict=True))
    size = norm(total)
    return size, tuple(F.when(size < EPS, f).otherwise(t / size) for t, f in zip(total, field, strict=True))


def tmi_scale(amplitude: Column) -> Column:
    """From facet factors to nT: minus amplitude (A/m) times 100 / 4 pi."""
    return -amplitude * (100.0 / (4.0 * pi))


def skin_depth(conductivity: Column, frequency: Column) -> Column:
    """Metres, 503 / sqrt(sigma f); 1e9 where either is not positive."""
    return F.when((conductivity <= 0) | (frequency <= 0), 1e9).otherwise(503.0 / F.sqrt(conductivity * frequency))


def skin_depth_time(conductivity: Column, time: Column) -> Column:
    """Skin depth at the frequency 1 / (2 t)."""
    return F.when(time <= 0, 1e9).otherwise(skin_depth(conductivity, 1.0 / (2.0 * time)))


def mt_impedance(conductivity: Column, frequency: Column) -> Column:
    """Half-space impedance sqrt(omega mu0 / sigma)."""
    return F.sqrt(2.0 * pi * frequency * MU0 / conductivity)


def active_response(conductivity: Column, time: Column, distance: Column) -> Column:
    """Dipole-like decay of an active source: sigma delta^3 / max(R, 1)^3."""
    delta, r = skin_depth_time(conductivity, time), F.greatest(distance, F.lit(1.0))
    return conductivity * delta * delta * delta / (r * r * r)


def ellipsoid_top(x: Column, y: Column, cx, cy, cz, a, b, c) -> Column:
    """Height of an ellipsoid's upper half; 0 outside its footprint."""
    v = F.pow((x - cx) / a, 2) + F.pow((y - cy) / b, 2)
    return F.when(v > 1.0, 0.0).otherwise(cz + c * F.sqrt(F.greatest(1.0 - v, F.lit(0.0))))


def bowl(x: Column, y: Column, cx, cy, depth, a, b, regional) -> Column:
    """A regional level with an elliptic bowl sunk into it."""
    v = F.pow((x - cx) / a, 2) + F.pow((y - cy) / b, 2)
    return F.when(v > 1.0, regional).otherwise(regional - depth * F.sqrt(F.greatest(1.0 - v, F.lit(0.0))))


def dipping_plane(x: Column, y: Column, z0, dip, azimuth, dip_sign: int = 1) -> Column:
    """z0 + sign * (x sin(azimuth) + y cos(azimuth)) tan(dip), angles in degrees."""
    return F.lit(z0) + dip_sign * (x * F.sin(F.radians(F.lit(azimuth))) + y * F.cos(F.radians(F.lit(azimuth)))) * F.tan(F.radians(F.lit(dip)))


def bouguer_slab(density: Column, height: Column) -> Column:
    """Attraction of an infinite slab, 2 pi G rho h, in mGal."""
    return 2.0 * pi * G_MGAL * density * height


def cross_gradient_weight(cell: Column) -> Column:
    return F.pow(cell, 4) / 16.0
