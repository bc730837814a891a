"""Column functions over 2-D maps held as arrays, row after row: reductions, boxes, smoothing, row centres, column widths.

values: array<double>; width: the length of a row (int Column or number). A map has size(values) div width rows; what is left over is ignored.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import columns as C


def _int(x: Column | int) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _range(a: Column, b: Column) -> Column:
    """a, a + 1 up to b - 1; empty where b isn't above a."""
    return F.when(b > a, F.sequence(a, F.greatest(a, b - 1))).otherwise(F.array().cast("array<int>"))


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def height(values: Column, width: Column | int) -> Column:
    return F.floor(F.size(values) / _int(width)).cast("int")


def row_means(values: Column, width: Column | int, x0: Column | int = 0) -> Column:
    """The mean of every row from column x0 on."""
    w, x0 = _int(width), _int(x0)
    return C.bound(values, lambda v: F.transform(_range(F.lit(0), height(v, w)), lambda y: _sum(F.slice(v, y * w + x0 + 1, w - x0)) / (w - x0)))


def column_sums(values: Column, width: Column | int, y0: Column | int = 0, y1: Column | None = None, x0: Column | int = 0) -> Column:
    """The sum over rows y0 to y1 - 1 of every column from x0 on. Rows are added to each other whole, so each cell is read once."""
    w, x0 = _int(width), _int(x0)
    rows = lambda v: _range(_int(y0), height(v, w) if y1 is None else y1)
    return C.bound(values, lambda v: F.aggregate(rows(v), F.array_repeat(F.lit(0.0), w - x0), lambda s, y: F.zip_with(s, F.slice(v, y * w + x0 + 1, w - x0), lambda a, b: a + b)))


def crop(values: Column, width: Column | int, box: Column) -> Column:
    """The cells within a struct (x0, y0, x1, y1), as a map of width x1 - x0."""
    w = _int(width)
    return C.bound(values, lambda v: F.flatten(F.transform(_range(box["y0"], box["y1"]), lambda y: F.slice(v, y * w + box["x0"] + 1, box["x1"] - box["x0"]))))


def content_box(values: Column, width: Column | int, below: float = 245, pad: int = 8, share: float = 0.01) -> Column:
    """Struct (x0, y0, x1, y1), ends exclusive: the cells under a value, with a margin of pad cells or a share of the extent, whichever is more; the
    whole map where there are none."""
    w = _int(width)
    h = height(values, w)
    places = F.array_compact(F.transform(values, lambda v, i: F.when((v < below) & (i < h * w), i)))

    def box(at: Column) -> Column:
        xs, ys = F.transform(at, lambda i: (i % w).cast("int")), F.transform(at, lambda i: F.floor(i / w).cast("int"))
        margin = lambda a, b: F.greatest(F.lit(pad), F.floor(share * (b - a + 1)).cast("int"))
        low = lambda p: F.greatest(F.lit(0), F.array_min(p) - margin(F.array_min(p), F.array_max(p)))
        high = lambda p, n: F.least(n.cast("int"), F.array_max(p) + margin(F.array_min(p), F.array_max(p)))
        found = F.struct(low(xs).alias("x0"), low(ys).alias("y0"), high(xs, w).alias("x1"), high(ys, h).alias("y1"))
        return F.when(F.size(at) > 0, found).otherwise(F.struct(F.lit(0).alias("x0"), F.lit(0).alias("y0"), w.cast("int").alias("x1"), h.alias("y1")))

    return C.bound(places, box)


def gaussian(values: Column, sigma: Column | float) -> Column:
    """The values smoothed by a Gaussian of round(8 sigma + 1) places, or one more if that is even; mirrored at the ends, without repeating the last."""
    sigma = sigma if isinstance(sigma, Column) else F.lit(float(sigma))
    widest = F.floor(F.rint(8 * sigma + 1) / 2).cast("int")
    weights = F.transform(F.sequence(-widest, widest), lambda i: F.exp(-(i * i) / (2 * sigma * sigma)))
    kernel = C.bound(weights, lambda k: C.bound(_sum(k), lambda total: F.transform(k, lambda x: x / total)))

    # Both lists are bound before the sums over them, as every tap would compute them anew.
    def smooth(v: Column, k: Column) -> Column:
        n, reach = F.size(v), F.floor(F.size(k) / 2).cast("int")
        period = F.greatest(2 * (n - 1), F.lit(1))
        inside = lambda i: C.bound(F.pmod(i, period), lambda m: F.when(m < n, m).otherwise(period - m))
        wide = F.transform(F.sequence(-reach, n - 1 + reach), lambda i: F.get(v, inside(i)))
        own = lambda w: F.transform(_range(F.lit(0), n), lambda i: _sum(F.zip_with(k, F.slice(w, i + 1, F.size(k)), lambda a, b: a * b)))
        return F.when(n > 0, C.bound(wide, own)).otherwise(v)

    return C.bound(values, lambda v: C.bound(kernel, lambda k: smooth(v, k)))


def row_centres(values: Column, width: Column | int, most: int = 4, left: float = 0.18, top: float = 0.12, bottom: float = 0.985) -> Column:
    """Ascending rows of the strongest bands: the mean of every row right of a share of the width, smoothed; the top and the bottom set to the least;
    rounded to nine places, so that bands of one shape tie; then peaks at least max(50, 0.12 h) apart. With fewer than ``most``, rows evenly spaced from 0.24 to 0.92 of the height."""
    w = _int(width)
    h = height(values, w)

    def masked(e: Column) -> Column:
        low = F.array_min(e)
        return F.transform(e, lambda v, y: F.round(F.when((y < F.floor(h * top)) | (y >= F.floor(h * bottom)), low).otherwise(v), 9))

    energy = gaussian(row_means(values, w, F.floor(w * left).cast("int")), F.greatest(F.lit(5.0), h / 120))
    a, b = F.floor(h * 0.24).cast("int"), F.floor(h * 0.92).cast("int")
    even = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.when(i == most - 1, b).otherwise(F.floor(i * ((b - a) / F.lit(float(most - 1))) + a).cast("int")))
    peaks = lambda e: C.top_peaks(e, most, F.greatest(F.lit(50), F.floor(h * 0.12).cast("int")))
    return C.bound(C.bound(C.bound(energy, masked), peaks), lambda p: F.when(F.size(p) == most, p).otherwise(even))


def expected_width(width: Column | int, start: Column | int, share: float = 0.94, columns: int = 4, least: int = 32) -> Column:
    return F.greatest(F.floor((_int(width) - _int(start)) * share / columns).cast("int"), F.lit(least))


def column_width(values: Column, width: Column | int, y0: Column, y1: Column, start: Column | int) -> Column:
    """The width of a column of leads: the median distance of the marks between columns, found near the first three multiples of the expected width,
    if within a quarter of it; else the expected width. A mark is the highest detrended column sum nearby, if above the deviation of all."""
    w, start = _int(width), _int(start)
    expect = expected_width(w, start)
    margin = F.floor(expect * 0.2).cast("int")

    def found(sharp: Column) -> Column:
        n = F.size(sharp)
        mean = lambda: _sum(sharp) / n
        spread = C.bound(mean(), lambda m: F.sqrt(_sum(F.transform(sharp, lambda v: (v - m) * (v - m))) / n))

        def mark(sd: Column):
            def at(i: Column) -> Column:
                a = F.greatest(F.lit(0), i * expect - margin)
                part = F.slice(sharp, a + 1, F.greatest(F.lit(0), F.least(n, i * expect + margin) - a))
                return C.bound(part, lambda p: F.when(F.array_max(p) > sd, a + F.array_position(p, F.array_max(p)).cast("int") - 1))

            return F.array_compact(F.transform(F.sequence(F.lit(1), F.lit(3)), at))

        def judged(marks: Column) -> Column:
            steps = F.sort_array(F.transform(marks, lambda m, i: F.when(i == 0, m).otherwise(m - F.get(marks, i - 1))))
            middle = C.bound(steps, lambda s: (F.get(s, F.floor((F.size(s) - 1) / 2).cast("int")) + F.get(s, F.floor(F.size(s) / 2).cast("int"))) / F.lit(2.0))
            return C.bound(middle, lambda m: F.when((m >= 0.75 * expect) & (m <= 1.25 * expect), F.floor(m).cast("int")).otherwise(expect))

        return C.bound(C.bound(spread, mark), judged)

    sums = column_sums(values, w, y0, y1, start)
    detrended = lambda s: F.zip_with(s, gaussian(s, F.greatest(F.lit(3.0), expect / 3)), lambda a, b: a - b)
    return C.bound(C.bound(sums, detrended), found)


def half(x: Column) -> Column:
    """The nearest 16-bit float, ties to even, as a double: 11 significant bits down to 2**-14, steps of 2**-24 below, infinite from 65520 on."""
    x = x.cast("double")
    size = F.abs(x)
    quantum = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.greatest(size, F.lit(2.0**-14)))), F.lit(-14)) - 10)
    finite = F.rint(x / quantum) * quantum
    return F.when(F.isnan(x) | (size == float("inf")), x).when(size >= 65520, F.signum(x) * float("inf")).otherwise(finite)


def quad_corners(points: Column) -> Column:
    """Upper left, upper right, lower right, lower left of an array of structs (x, y): least and greatest x + y, least and greatest y - x; of equal
    ones the first."""
    keyed = lambda f: F.transform(points, lambda p, i: F.struct(f(p).alias("k"), i.alias("i"), p.alias("p")))
    least = lambda f: F.array_min(keyed(f))["p"]
    total, slope = (lambda p: p["x"] + p["y"]), (lambda p: p["y"] - p["x"])
    return F.array(least(total), least(slope), least(lambda p: -total(p)), least(lambda p: -slope(p)))
