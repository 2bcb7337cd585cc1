"""Column functions of camera, pose and grid geometry. All are native expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Vec(NamedTuple):
    """Three columns."""

    x: Column
    y: Column
    z: Column


class Quat(NamedTuple):
    x: Column
    y: Column
    z: Column
    w: Column


class Pose(NamedTuple):
    """Rotation and translation, as columns."""

    q: Quat
    t: Vec


class Camera(NamedTuple):
    width: int
    height: int
    fx: float
    fy: float
    cx: float
    cy: float
    scale: float = 1000.0
    far: float = 10.0


class Box(NamedTuple):
    """An axis-aligned box, borders included."""

    lo: Vec
    hi: Vec

    def contains(self, p: Vec) -> Column:
        return p.x.between(self.lo.x, self.hi.x) & p.y.between(self.lo.y, self.hi.y) & p.z.between(self.lo.z, self.hi.z)

    def intersects(self, other: Box) -> Column:
        apart = [(a.lo.x > b.hi.x) | (a.lo.y > b.hi.y) | (a.lo.z > b.hi.z) for a, b in ((self, other), (other, self))]
        return ~(apart[0] | apart[1])

    def centre(self) -> Vec:
        return Vec(*((a + b) / 2 for a, b in zip(self.lo, self.hi, strict=True)))

    def half_extent(self) -> Vec:
        return Vec(*((b - a) / 2 for a, b in zip(self.lo, self.hi, strict=True)))


def vec(*names: str) -> Vec:
    return Vec(*(F.col(n) for n in names))


def pose_of(prefix: str = "") -> Pose:
    c = lambda n: F.col(prefix + n)
    return Pose(Quat(c("qx"), c("qy"), c("qz"), c("qw")), Vec(c("tx"), c("ty"), c("tz")))


def dot(a: Vec, b: Vec) -> Column:
    return a.x * b.x + a.y * b.y + a.z * b.z


def cross(a: Vec, b: Vec) -> Vec:
    return Vec(a.y * b.z - a.z * b.y, a.z * b.x - a.x * b.z, a.x * b.y - a.y * b.x)


def add(a: Vec, b: Vec) -> Vec:
    return Vec(a.x + b.x, a.y + b.y, a.z + b.z)


def sub(a: Vec, b: Vec) -> Vec:
    return Vec(a.x - b.x, a.y - b.y, a.z - b.z)


def scale(a: Vec, k: Column | float) -> Vec:
    return Vec(a.x * k, a.y * k, a.z * k)


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def unproject(u: Column, v: Column, z: Column, cam: Camera) -> Vec:
    """The camera-space point of pixel (u, v) at depth z."""
    return Vec((u - cam.cx) / cam.fx * z, (v - cam.cy) / cam.fy * z, z)


def project(p: Vec, cam: Camera) -> Vec:
    """(u, v, z) of a camera-space point; null at z = 0."""
    return Vec(F.try_divide(F.lit(cam.fx) * p.x, p.z) + cam.cx, F.try_divide(F.lit(cam.fy) * p.y, p.z) + cam.cy, p.z)


def rotate(q: Quat, p: Vec) -> Vec:
    """p turned by a unit quaternion: p + 2w(q x p) + 2 q x (q x p)."""
    axis = Vec(q.x, q.y, q.z)
    once = scale(cross(axis, p), 2.0)
    twice = cross(axis, once)
    return Vec(p.x + q.w * once.x + twice.x, p.y + q.w * once.y + twice.y, p.z + q.w * once.z + twice.z)


def apply_pose(pose: Pose, p: Vec) -> Vec:
    return add(rotate(pose.q, p), pose.t)


def multiply(a: Quat, b: Quat) -> Quat:
    return Quat(
        a.w * b.x + a.x * b.w + a.y * b.z - a.z * b.y,
        a.w * b.y - a.x * b.z + a.y * b.w + a.z * b.x,
        a.w * b.z + a.x * b.y - a.y * b.x + a.z * b.w,
        a.w * b.w - a.x * b.x - a.y * b.y - a.z * b.z,
    )


def compose(a: Pose, b: Pose) -> Pose:
    """First b, then a."""
    return Pose(multiply(a.q, b.q), apply_pose(a, b.t))


def invert(a: Pose) -> Pose:
    back = Quat(-a.q.x, -a.q.y, -a.q.z, a.q.w)
    return Pose(back, scale(rotate(back, a.t), -1.0))


def exp_update(pose: Pose, rho: Vec, phi: Vec) -> Pose:
    """inverse(exp(rho, phi)) * pose: rho moves, phi turns; a series stands in for small angles."""
    angle = norm(phi)
    small = angle < 1e-8
    safe = F.when(small, F.lit(1.0)).otherwise(angle)
    half = F.when(small, F.lit(0.5)).otherwise(F.sin(angle / 2) / safe)
    q = Quat(phi.x * half, phi.y * half, phi.z * half, F.cos(angle / 2))
    b = F.when(small, F.lit(0.5)).otherwise((1 - F.cos(angle)) / (safe * safe))
    c = F.when(small, F.lit(1 / 6)).otherwise((angle - F.sin(angle)) / (safe * safe * safe))
    once = cross(phi, rho)
    t = add(rho, add(scale(once, b), scale(cross(phi, once), c)))
    return compose(invert(Pose(q, t)), pose)


def euler(q: Quat) -> Vec:
    """Angles about x, y and z."""
    return Vec(
        F.atan2(2 * (q.w * q.x + q.y * q.z), 1 - 2 * (q.x * q.x + q.y * q.y)),
        F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 2 * (q.w * q.y - q.z * q.x)))),
        F.atan2(2 * (q.w * q.z + q.x * q.y), 1 - 2 * (q.y * q.y + q.z * q.z)),
    )


def pose_cost(before: Pose, now: Pose) -> Column:
    """9 * squared wrapped angles + squared translation of the pose from before to now."""
    d = compose(invert(before), now)
    e = euler(d.q)
    wrap = lambda a: F.least(F.abs(a - math.pi), F.abs(a + math.pi), F.abs(a))
    return 9.0 * sum((wrap(a) * wrap(a) for a in e[1:]), wrap(e.x) * wrap(e.x)) + dot(d.t, d.t)


def quadratic_truncation(z: Column, q: float = 0.0019, linear: float = 0.00152, const: float = 0.001504, factor: float = 8.0) -> Column:
    return F.abs(F.lit(q) * z * z + F.lit(linear) * z + F.lit(const)) * F.lit(factor)


def constant_truncation(distance: float) -> Column:
    return F.lit(distance)


def observation_weight(truncation: Column, weight: float = 1.0) -> Column:
    """weight / (2 * truncation)."""
    return F.lit(weight) / (2.0 * truncation)


def cell(x: Column, size: float) -> Column:
    """Floor of x / size as an int; right for negatives too."""
    return F.floor(x / F.lit(size)).cast("int")


def chunk_of(p: Vec, voxel: float, n: int) -> list[Column]:
    return [cell(c, voxel * n).alias(a) for c, a in zip(p, ("cx", "cy", "cz"), strict=True)]


def local_id(x: Column, y: Column, z: Column, n: int) -> Column:
    """(z * n + y) * n + x for coordinates within a chunk."""
    return (z * n + y) * n + x


def voxel_of(g: Vec, n: int) -> Column:
    """The local id of global voxel coordinates."""
    return local_id(*(F.pmod(c, F.lit(n)) for c in g), n)


def centroid(cx: Column, cy: Column, cz: Column, vid: Column, voxel: float, n: int) -> Vec:
    at = (vid % n, F.floor(vid / n) % n, F.floor(vid / (n * n)))
    return Vec(*((c * n + a + 0.5) * voxel for c, a in zip((cx, cy, cz), at, strict=True)))


def corners(lo: Vec, hi: Vec) -> Column:
    """The eight corners of a box as array<struct<x, y, z>>, x fastest."""
    return F.array(
        *[F.struct((hi.x if k & 1 else lo.x).alias("x"), (hi.y if k & 2 else lo.y).alias("y"), (hi.z if k & 4 else lo.z).alias("z")) for k in range(8)]
    )


def fixed_encode(x: Column, signed: bool = True, limit: float = 1000.0) -> Column:
    """16-bit fixed point over [-limit, limit] (or [0, limit])."""
    c = F.greatest(F.lit(-limit if signed else 0.0), F.least(F.lit(limit), x))
    return F.floor(c * F.lit(32767.0 / limit if signed else 65535.0 / limit) + 0.5).cast("int")


def fixed_decode(n: Column, signed: bool = True, limit: float = 1000.0) -> Column:
    return n * F.lit(limit / 32767.0 if signed else limit / 65535.0)


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a * (1 - t) + b * t


def bilinear(ul: Column, ur: Column, ll: Column, lr: Column, x: Column, y: Column) -> Column:
    return lerp(lerp(ul, ur, x), lerp(ll, lr, x), y)


def huber(error: Column, tau: Column | float) -> Column:
    """min(1, tau / error); 1 at no error."""
    return F.coalesce(F.least(F.lit(1.0), F.try_divide(F.lit(tau) if isinstance(tau, float) else tau, error)), F.lit(1.0))


def view_cosine(p: Vec, n: Vec) -> Column:
    """|cosine| between the ray to p and the normal n; null where either has no length."""
    return F.abs(F.try_divide(dot(p, n), norm(p) * norm(n)))


def skew(a: Vec) -> Column:
    """Row-major 3 x 3 matrix of the cross product by a."""
    o = F.lit(0.0)
    return F.array(o, -a.z, a.y, a.z, o, -a.x, -a.y, a.x, o)


def skew_product(a: Vec, b: Vec) -> Column:
    """skew(a) * skew(b), row-major: b a' - (a.b) I."""
    d = dot(a, b)
    return F.array(*[(bi * aj - d) if i == j else bi * aj for i, bi in enumerate(b) for j, aj in enumerate(a)])


def point_jacobian(p: Vec) -> Column:
    """3 x 6, row-major: [I, -skew(p)]."""
    o, i = F.lit(0.0), F.lit(1.0)
    return F.array(i, o, o, o, p.z, -p.y, o, i, o, -p.z, o, p.x, o, o, i, p.y, -p.x, o)


def plane_distance(p: Vec, normal: Sequence[float], d: float) -> Column:
    return p.x * normal[0] + p.y * normal[1] + p.z * normal[2] + d


def frustum_planes(cam: Camera, near: float, far: float) -> list[tuple[tuple[float, float, float], float]]:
    """Six inward planes of the view along +z: (normal, distance); inside is a distance >= 0."""
    left, right = -cam.cx / cam.fx, (cam.width - cam.cx) / cam.fx
    top, bottom = -cam.cy / cam.fy, (cam.height - cam.cy) / cam.fy
    unit = lambda a, b, c: tuple(x / math.sqrt(a * a + b * b + c * c) for x in (a, b, c))
    return [
        ((0.0, 0.0, 1.0), -near),
        ((0.0, 0.0, -1.0), far),
        (unit(1.0, 0.0, -left), 0.0),
        (unit(-1.0, 0.0, right), 0.0),
        (unit(0.0, 1.0, -top), 0.0),
        (unit(0.0, -1.0, bottom), 0.0),
    ]


def in_frustum(p: Vec, cam: Camera, near: float, far: float) -> Column:
    """Whether a camera-space point lies inside all six planes."""
    inside = F.lit(True)
    for normal, d in frustum_planes(cam, near, far):
        inside = inside & (plane_distance(p, normal, d) >= 0)
    return inside


def ray_hits_box(origin: Vec, direction: Vec, lo: Vec, hi: Vec) -> Column:
    """Slab test for t >= 0."""
    enter, leave = [], []
    for o, d, a, b in zip(origin, direction, lo, hi, strict=True):
        d = F.when(F.abs(d) < 1e-12, F.lit(1e-12)).otherwise(d)
        t0, t1 = (a - o) / d, (b - o) / d  # a product with 1 / d would miss edges that the ray touches
        enter.append(F.least(t0, t1))
        leave.append(F.greatest(t0, t1))
    return F.least(*leave) >= F.greatest(F.lit(0.0), *enter)


def edge_crossing(a: Vec, b: Vec, sa: Column, sb: Column) -> Vec:
    """Where the distance is 0 on the edge from a to b, whose ends have distances sa and sb."""
    return add(a, scale(sub(b, a), sa / (sa - sb)))
