"""Column functions. All stay inside whole-stage codegen; integer arguments give integer results."""
import math

from pyspark.sql import Column, functions as F

# fixed values
SPEED_EDGES = (0.0, 20.0, 100.0, 300.0)
AGE_EDGES = (1, 2, 4, 16, 64, 256)
FLICKER_US = (10_000.0, 1e6 / 120.0)
FLICKER_TOL = 0.02


def col(c):
    return F.col(c) if isinstance(c, str) else (c if isinstance(c, Column) else F.lit(c))


def idiv(a, b) -> Column:
    """Integer division; operands must not be negative."""
    return F.call_function("div", col(a).cast("bigint"), col(b).cast("bigint"))


def time_bin(tr, k, t0) -> Column:
    k = col(k)
    return F.least(k - 1, idiv(col(tr) * k, t0)).cast("bigint")


def block_id(x, y, side, width) -> Column:
    return idiv(y, side) * (-(-width // side)) + idiv(x, side)


def block_centre(block, side, width):
    nbx = -(-width // side)
    return (col(block) % nbx) * side + (side - 1) / 2.0, idiv(block, nbx) * side + (side - 1) / 2.0


def active_threshold(side: int, rho: float) -> int:
    return max(1, math.ceil(rho * side * side))


def with_voxel(df, s, k, sensor, tr="tr"):
    return df.withColumns({"tb": time_bin(tr, k, sensor.t0), "by": idiv("y", s), "bx": idiv("x", s)})


def padded_dims(s, width, height):
    """(columns, rows, padded rows, padded columns of both polarities) of a voxel frame."""
    s = col(s)
    nx, ny = idiv(s + (width - 1), s), idiv(s + (height - 1), s)
    return nx, ny, ny + ny % 2, (nx + nx % 2) * 2


def move_affine(x, y, cx, cy, hx, hy, q):
    """Pixel under the integer map q = (dx, dy, ia, ib, ic, id) about (cx, cy); rounding is half-even."""
    dx, dy, ia, ib, ic, id_ = (col(v) for v in q)
    x, y = col(x).cast("double"), col(y).cast("double")
    u, v = x - col(cx), y - col(cy)
    hx, hy = col(hx), col(hy)
    return (F.rint(x + dx + (ia / hx) * u + (ib / hy) * v).cast("bigint"),
            F.rint(y + dy + (ic / hx) * u + (id_ / hy) * v).cast("bigint"))


def warp_velocity(x, t, t_ref, v, tick=1e-6) -> Column:
    return col(x).cast("double") - col(v) * ((col(t) - col(t_ref)) * F.lit(tick))


def warp_box(x, bx, bw, rx, rw) -> Column:
    """Box-to-box map of one coordinate: box (bx, bw) onto box (rx, rw)."""
    return (col(rx) + col(rw) * 0.5) + (col(x) - (col(bx) + col(bw) * 0.5)) * (col(rw) / F.greatest(col(bw), F.lit(1e-9)))


def speed_class(speed, edges=SPEED_EDGES) -> Column:
    """Class 0..3 of a speed in px/s; -1 outside (negative or NULL)."""
    out = F.lit(-1)
    for i, e in enumerate(edges):
        out = F.when(col(speed) >= e, i).otherwise(out)
    return out


def shift_class(dx, dy) -> Column:
    """Chebyshev classes 0-1, 2-5, >= 6 of an integer displacement."""
    v = F.greatest(F.abs(col(dx)), F.abs(col(dy)))
    return F.when(v <= 1, 0).when(v <= 5, 1).otherwise(2)


def geometric_edges(lo, hi, n):
    return [lo * (hi / lo) ** (i / (n - 1)) for i in range(n)]


# fixed values: 29 log-spaced edges 1/128 .. 128 with 0 below; bins 0..29 by ratio, 30 for "no value"
RATIO_EDGES = [0.0] + [2.0 ** ((i - 14) / 2.0) for i in range(29)]


def bin_of(r, edges=tuple(RATIO_EDGES)) -> Column:
    r = col(r)
    arr = F.array(*[F.lit(float(e)) for e in edges])
    n = F.size(F.filter(arr, lambda e: e <= r)) - 1
    return F.when(r.isNull() | F.isnan(r) | (r == float("inf")), len(edges)).otherwise(F.greatest(n, F.lit(0)))


def tau_bin(tau, edges) -> Column:
    """Index of the log bin of tau, clipped to the inner bins."""
    arr = F.array(*[F.lit(float(e)) for e in edges])
    n = F.size(F.filter(arr, lambda e: e <= col(tau))) - 1
    return F.greatest(F.lit(0), F.least(n, F.lit(len(edges) - 2)))


def bin_centre(i, edges=tuple(RATIO_EDGES)) -> Column:
    """Geometric centre of an inner bin, NULL for the open ones."""
    arr = F.array(*[F.lit(float(e)) for e in edges])
    i = col(i)
    return F.when((i >= 1) & (i <= len(edges) - 2), F.sqrt(F.get(arr, i) * F.get(arr, i + 1)))


def is_flicker(tau, periods=FLICKER_US, tol=FLICKER_TOL) -> Column:
    out = F.lit(False)
    for p in periods:
        out = out | (F.abs(col(tau) - p) <= tol * p)
    return F.coalesce(out, F.lit(False))


def age_bucket(age) -> Column:
    out = F.lit(0)
    for i, e in enumerate(AGE_EDGES):
        out = F.when(col(age) >= e, i + 1).otherwise(out)
    return F.when(col(age).isNull(), 6).otherwise(out)


def moved_fidelity(r, n) -> Column:
    r = col(r)
    return F.when(r <= 0.5, r - r * r / (col(n) * 3.0))


def poisson_bits(rate, delta) -> Column:
    return (F.lit(1.0) - F.ln(col(rate) * col(delta))) / math.log(2.0)


def zigzag(d) -> Column:
    d = col(d).cast("bigint")
    return F.shiftleft(d, 1).bitwiseXOR(F.shiftright(d, 63))


def unzigzag(u) -> Column:
    u = col(u).cast("bigint")
    return F.shiftright(u, 1).bitwiseXOR(-(u.bitwiseAND(F.lit(1))))


def uleb_len(v) -> Column:
    """Bytes of a non-negative integer in base-128."""
    v = col(v)
    n = F.lit(1)
    for j in range(1, 9):
        n = n + (v >= F.lit(1 << (7 * j))).cast("int")
    return n


def bin_start(f, k, t0) -> Column:
    """First tick of time bin f of k (a ceiling division)."""
    return idiv(col(f) * t0 + col(k) - 1, k)


def bin_middle(f, k, t0) -> Column:
    return idiv((col(f) * 2 + 1) * t0, col(k) * 2)


def mix(seed: int, a, b) -> Column:
    """Integer hash of a row key in [0, 2^31); the only source of pseudo-random draws, so that retries agree."""
    a, b = col(a).cast("bigint") % 2147483648, col(b).cast("bigint") % 2147483648
    h = (a * 1103515245 + b * 12345 + F.lit(seed).cast("bigint") * 2654435761) % 2147483648
    return (h * 1103515245 + 12345) % 2147483648


def uniform(seed: int, a, b) -> Column:
    return mix(seed, a, b) / F.lit(2147483648.0)


def rint_bigint(c) -> Column:
    return F.rint(col(c)).cast("bigint")


def ratio(num, den) -> Column:
    """num / den, NULL where den is zero."""
    return F.when(col(den) != 0, col(num) / col(den))


def ratio0(num, den) -> Column:
    """num / den, 0 where den is zero."""
    return F.coalesce(ratio(num, den), F.lit(0.0))
