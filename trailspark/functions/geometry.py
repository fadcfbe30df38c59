"""Scalar geometry as Column builders; nothing here leaves the JVM."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Matrix = Sequence  # nine Columns or numbers, by rows


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def project(h: Matrix, x, y) -> tuple[Column, Column]:
    """The image of (x, y) under a 3x3 homography; null where the point maps to infinity."""
    h, x, y = [_c(v) for v in h], _c(x), _c(y)
    w = h[6] * x + h[7] * y + h[8]
    return F.try_divide(h[0] * x + h[1] * y + h[2], w), F.try_divide(h[3] * x + h[4] * y + h[5], w)


def determinant(h: Matrix) -> Column:
    a, b, c, d, e, f, g, i, j = (_c(v) for v in h)
    return a * (e * j - f * i) - b * (d * j - f * g) + c * (d * i - e * g)


def inverse(h: Matrix) -> list[Column]:
    """The inverse matrix by its adjugate; nulls where it is singular."""
    a, b, c, d, e, f, g, i, j = (_c(v) for v in h)
    det = determinant(h)
    adj = [e * j - f * i, c * i - b * j, b * f - c * e, f * g - d * j, a * j - c * g, c * d - a * f, d * i - e * g, b * g - a * i, a * e - b * d]
    return [F.try_divide(v, det) for v in adj]


def product(p: Matrix, q: Matrix) -> list[Column]:
    p, q = [_c(v) for v in p], [_c(v) for v in q]
    return [sum((p[3 * r + k] * q[3 * k + s] for k in range(1, 3)), p[3 * r] * q[s]) for r in range(3) for s in range(3)]


def normalised(h: Matrix) -> list[Column]:
    """The matrix divided by its last element."""
    return [F.try_divide(_c(v), _c(h[8])) for v in h]


def jacobian_scale(h: Matrix, x, y, eps: float = 2.0) -> Column:
    """Mean length of the images of two steps of ``eps``, for each unit of step."""
    x, y = _c(x), _c(y)
    x0, y0 = project(h, x, y)
    x1, y1 = project(h, x + eps, y)
    x2, y2 = project(h, x, y + eps)
    return (F.hypot(x1 - x0, y1 - y0) + F.hypot(x2 - x0, y2 - y0)) / (2 * eps)


def area_scale(h: Matrix, x, y, eps: float = 2.0) -> Column:
    """Square root of the absolute determinant of the local Jacobian, by finite differences."""
    x, y = _c(x), _c(y)
    x0, y0 = project(h, x, y)
    x1, y1 = project(h, x + eps, y)
    x2, y2 = project(h, x, y + eps)
    return F.sqrt(F.abs((x1 - x0) * (y2 - y0) - (x2 - x0) * (y1 - y0))) / eps


def projection_scale(h: Matrix, x, y, length: float = 100.0) -> Column:
    """The length of the image of a horizontal step of ``length``, relative to it."""
    x, y = _c(x), _c(y)
    x0, y0 = project(h, x, y)
    x1, y1 = project(h, x + length, y)
    return F.hypot(x1 - x0, y1 - y0) / length


def line_normal(ax, ay, bx, by, dx, dy) -> tuple[Column, Column]:
    """Unit normal of the line a-b, turned to the side that (dx, dy) points to."""
    ax, ay, bx, by = (_c(v) for v in (ax, ay, bx, by))
    nx, ny = -(by - ay), bx - ax
    size = F.hypot(nx, ny)
    nx, ny = F.try_divide(nx, size), F.try_divide(ny, size)
    sign = F.when(nx * dx + ny * dy < 0, -1.0).otherwise(1.0)
    return nx * sign, ny * sign


def signed_distance(x, y, ax, ay, nx, ny) -> Column:
    return (_c(x) - ax) * nx + (_c(y) - ay) * ny


def crossing(px, py, qx, qy, line: Sequence[float], direction: Sequence[float], margin: float = 0.15) -> tuple[Column, Column]:
    """Whether the step p-q crosses the line (ax, ay, bx, by) in ``direction``, and at which fraction of the step.

    Half open: a step that ends on the line crosses, one that starts on it doesn't. The
    crossing may miss either end of the line by ``margin`` of its length.
    """
    ax, ay, bx, by = line
    size = math.hypot(bx - ax, by - ay)
    nx, ny = -(by - ay) / size, (bx - ax) / size
    if nx * direction[0] + ny * direction[1] < 0:
        nx, ny = -nx, -ny
    d0, d1 = signed_distance(px, py, ax, ay, nx, ny), signed_distance(qx, qy, ax, ay, nx, ny)
    part = F.try_divide(d0, d0 - d1)
    cx, cy = px + part * (qx - px), py + part * (qy - py)
    along = ((cx - ax) * (bx - ax) + (cy - ay) * (by - ay)) / size**2
    return (d0 < 0) & (d1 >= 0) & along.between(-margin, 1 + margin), part


def in_polygon(x, y, polygon: Sequence[Sequence[float]]) -> Column:
    """Even-odd ray casting, half open in y; a literal polygon unrolls into plain comparisons after a bounding-box test."""
    x, y = _c(x), _c(y)
    xs, ys = [float(p[0]) for p in polygon], [float(p[1]) for p in polygon]
    odd = F.lit(0)
    for i in range(len(polygon)):
        x0, y0, x1, y1 = xs[i - 1], ys[i - 1], xs[i], ys[i]
        if y0 != y1:
            hit = ((y > y0) != (y > y1)) & (x < (x1 - x0) * (y - y0) / (y1 - y0) + x0)
            odd = odd + F.when(hit, 1).otherwise(0)
    box = x.between(min(xs), max(xs)) & y.between(min(ys), max(ys))
    return F.coalesce(box & (F.pmod(odd, F.lit(2)) == 1), F.lit(False))


def in_polygon_array(x, y, polygon: Column) -> Column:
    """The same for a polygon in a column: an array of structs (x, y)."""
    x, y = _c(x), _c(y)
    n = F.size(polygon)

    def edge(i):
        p, q = F.get(polygon, F.pmod(i + n - 1, n)), F.get(polygon, i)
        cross = (q["x"] - p["x"]) * (y - p["y"]) / F.nullif(q["y"] - p["y"], F.lit(0.0)) + p["x"]
        return F.coalesce(((y > p["y"]) != (y > q["y"])) & (x < cross), F.lit(False))

    return F.when(n >= 3, F.pmod(F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + F.when(edge(i), 1).otherwise(0)), F.lit(2)) == 1).otherwise(False)


def segment_projection(x, y, ax, ay, bx, by) -> tuple[Column, Column, Column, Column]:
    """Clamped fraction, foot x, foot y and distance of a point on the segment a-b."""
    x, y, ax, ay, bx, by = (_c(v) for v in (x, y, ax, ay, bx, by))
    dx, dy = bx - ax, by - ay
    size = dx * dx + dy * dy
    part = F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - ax) * dx + (y - ay) * dy) / size))).otherwise(0.0)
    fx, fy = ax + part * dx, ay + part * dy
    return part, fx, fy, F.hypot(x - fx, y - fy)


def turn_degrees(ax, ay, bx, by) -> Column:
    """Signed angle from a to b, degrees in (-180, 180]."""
    ax, ay, bx, by = (_c(v) for v in (ax, ay, bx, by))
    return F.degrees(F.atan2(ax * by - ay * bx, ax * bx + ay * by))


def movement(turn: Column) -> Column:
    """Label of a turn angle; positive angles turn right where y points down."""
    return F.when(turn.isNull(), "unknown").when(F.abs(turn) <= 45, "straight").when(F.abs(turn) >= 135, "uturn").when(turn > 0, "right").otherwise("left")


def rotated(x, y, dx: float, dy: float) -> tuple[Column, Column]:
    """Coordinates along and across the direction (dx, dy)."""
    size = math.hypot(dx, dy)
    ux, uy = dx / size, dy / size
    return _c(x) * ux + _c(y) * uy, _c(y) * ux - _c(x) * uy


def angle_gap(a, b) -> Column:
    """Absolute difference of two angles in radians, at most pi."""
    gap = F.pmod(F.abs(_c(a) - _c(b)), F.lit(2 * math.pi))
    return F.least(gap, 2 * math.pi - gap)


def local_metres(lat, lon, lat0, lon0) -> tuple[Column, Column]:
    """Equirectangular metres east and north of (lat0, lon0)."""
    metre = 111_320.0
    return (_c(lon) - _c(lon0)) * metre * F.cos(F.radians(_c(lat0))), (_c(lat) - _c(lat0)) * metre


def speed_colour(speed, low: float, high: float) -> Column:
    """Red at ``low`` or slower, yellow between, green at ``high`` or faster, as (r, g, b)."""
    part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (_c(speed) - low) / (high - low)))
    red = F.when(part < 0.5, 255).otherwise(F.round(255 * (2 - 2 * part)).cast("int"))
    green = F.when(part < 0.5, F.round(255 * 2 * part).cast("int")).otherwise(255)
    return F.struct(red.cast("int").alias("r"), green.cast("int").alias("g"), F.lit(0).alias("b"))


def corners(cx, cy, w, h, grow: float = 0.0) -> Column:
    """The four corners of a box, grown by a part of its size, as an array of structs (x, y)."""
    cx, cy, rx, ry = _c(cx), _c(cy), _c(w) * (1 + grow) / 2, _c(h) * (1 + grow) / 2
    return F.array(*[F.struct((cx + a * rx).alias("x"), (cy + b * ry).alias("y")) for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1))])


def ricker(width: int, a: float) -> Column:
    """The Ricker wavelet of scale a at ``width`` points, an array of doubles."""
    norm = 2 / (math.sqrt(3 * a) * math.pi**0.25)
    at = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: i.cast("double") - (width - 1) / 2)
    return F.transform(at, lambda u: norm * (1 - u * u / a**2) * F.exp(-u * u / (2 * a**2)))


def ease_out(part) -> Column:
    return 1 - F.pow(1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), _c(part))), F.lit(3.0))


def pulse(part) -> Column:
    return F.sin(math.pi * F.greatest(F.lit(0.0), F.least(F.lit(1.0), _c(part))))


def kmh(px_per_s, car_px, car_m: float = 4.5) -> Column:
    """Pixels per second as km/h by the length of a car."""
    return F.try_divide(_c(px_per_s), _c(car_px)) * car_m * 3.6


def clock_seconds(text: Column) -> Column:
    """Seconds of a clock string ``HH:mm:ss[.SSS]``; null where it isn't one."""
    p = F.split(text, ":")
    return F.when(F.size(p) == 3, p[0].try_cast("double") * 3600 + p[1].try_cast("double") * 60 + p[2].try_cast("double"))
