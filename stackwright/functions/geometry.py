"""Rotations and projections as column expressions. A matrix is an array of three row arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Matrix = list[list[Column]]


def as_column(m: Matrix) -> Column:
    return F.array(*[F.array(*row) for row in m])


def product(a: Matrix, b: Matrix) -> Matrix:
    return [[sum((a[i][k] * b[k][j] for k in range(1, len(b))), a[i][0] * b[0][j]) for j in range(len(b[0]))] for i in range(len(a))]


def plane_turn(t: Column) -> Matrix:
    return [[F.cos(t), -F.sin(t)], [F.sin(t), F.cos(t)]]


def turn_z(t: Column) -> Matrix:
    zero, one = F.lit(0.0), F.lit(1.0)
    return [[F.cos(t), -F.sin(t), zero], [F.sin(t), F.cos(t), zero], [zero, zero, one]]


def turn_y(t: Column) -> Matrix:
    zero, one = F.lit(0.0), F.lit(1.0)
    return [[F.cos(t), zero, F.sin(t)], [zero, one, zero], [-F.sin(t), zero, F.cos(t)]]


def from_euler(phi: Column, theta: Column, psi: Column) -> Matrix:
    """Turn by psi about z, theta about y, phi about z."""
    return product(product(turn_z(phi), turn_y(theta)), turn_z(psi))


def from_quaternion(w: Column, x: Column, y: Column, z: Column) -> Matrix:
    """A quaternion of any length but zero."""
    s = 2 / (w * w + x * x + y * y + z * z)
    return [
        [1 - s * (y * y + z * z), s * (x * y - w * z), s * (x * z + w * y)],
        [s * (x * y + w * z), 1 - s * (x * x + z * z), s * (y * z - w * x)],
        [s * (x * z - w * y), s * (y * z + w * x), 1 - s * (x * x + y * y)],
    ]


def to_quaternion(m: Matrix) -> list[Column]:
    """For matrices whose trace is above -1."""
    w = F.sqrt(1 + m[0][0] + m[1][1] + m[2][2]) / 2
    return [w, (m[2][1] - m[1][2]) / (4 * w), (m[0][2] - m[2][0]) / (4 * w), (m[1][0] - m[0][1]) / (4 * w)]


def from_direction(x: Column, y: Column, z: Column) -> Matrix:
    """The turn of least angle that takes +z to the unit direction; the opposite of +z flips y and z."""
    far = z <= -1 + 1e-12
    k = F.when(far, F.lit(0.0)).otherwise(1 / (1 + F.when(far, F.lit(0.0)).otherwise(z)))
    m = [[1 - k * x * x, -k * x * y, x], [-k * x * y, 1 - k * y * y, y], [-x, -y, z]]
    flip = [[1.0, 0.0, 0.0], [0.0, -1.0, 0.0], [0.0, 0.0, -1.0]]
    return [[F.when(far, F.lit(flip[i][j])).otherwise(m[i][j]) for j in range(3)] for i in range(3)]


def from_rotation_vector(x: Column, y: Column, z: Column) -> Matrix:
    """Exponential map: the vector is the axis times the angle."""
    half = F.sqrt(x * x + y * y + z * z) / 2
    scale = F.when(half > 1e-12, F.sin(half) / (2 * half)).otherwise(F.lit(0.5))
    return from_quaternion(F.cos(half), x * scale, y * scale, z * scale)


def direction(phi: Column, theta: Column) -> list[Column]:
    return [F.sin(theta) * F.cos(phi), F.sin(theta) * F.sin(phi), F.cos(theta)]


def to_euler(x: Column, y: Column, z: Column) -> list[Column]:
    """(phi, theta) of a direction; the in-plane angle is taken as 0."""
    return [F.atan2(y, x), F.atan2(F.sqrt(x * x + y * y), z)]


def winkel_tripel(longitude: Column, latitude: Column) -> list[Column]:
    """The map projection, with the standard parallel at arccos(2/pi)."""
    alpha = F.acos(F.cos(latitude) * F.cos(longitude / 2))
    sinc = F.when(alpha == 0, F.lit(1.0)).otherwise(F.sin(alpha) / F.when(alpha == 0, F.lit(1.0)).otherwise(alpha))
    two_over_pi = 0.6366197723675814
    return [(longitude * two_over_pi + 2 * F.cos(latitude) * F.sin(longitude / 2) / sinc) / 2, (latitude + F.sin(latitude) / sinc) / 2]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def quadratic_form(m: Column, v: Column) -> Column:
    """v' M v for an array of row arrays."""
    return dot(F.transform(m, lambda row: dot(row, v)), v)
