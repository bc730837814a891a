"""Column functions over point clouds: places (array of [x, y, z]) and their values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import columns as C


def dense(indices: Column, values: Column, shape: Column) -> Column:
    """The grid of that shape, row-major, with the values at their places and zeros elsewhere; of two values at one place the later stays. Null
    if any argument is; a place outside the grid is an error. Runs of zeros are laid between the values in order of place, one row at a time."""

    def flat(place: Column, s: Column) -> Column:
        inside = (F.size(place) == F.size(s)) & F.forall(F.zip_with(place, s, lambda i, n: F.coalesce((i >= 0) & (i < n), F.lit(False))), lambda ok: ok)
        at = F.aggregate(F.zip_with(place, s, lambda i, n: F.struct(i.cast("int").alias("i"), n.cast("int").alias("n"))), F.lit(0), lambda a, x: a * x["n"] + x["i"])
        return F.when(inside, at).otherwise(F.raise_error(F.lit("a place lies outside the grid")).cast("int"))

    def laid(cells: Column, total: Column) -> Column:
        end = lambda i: F.coalesce(F.get(cells, i)["at"], total)
        zeros = lambda n: F.array_repeat(F.lit(0.0), n)
        # A cell, and the zeros up to the next; of equal places only the last has any length.
        parts = F.transform(cells, lambda c, i: F.when(end(i + 1) > c["at"], F.concat(F.array(c["v"]), zeros(end(i + 1) - c["at"] - 1))).otherwise(zeros(F.lit(0))))
        return F.concat(zeros(end(F.lit(0))), F.flatten(parts))

    def grid(s: Column) -> Column:
        total = F.aggregate(s, F.lit(1), lambda a, n: a * n.cast("int"))
        cells = F.sort_array(F.zip_with(F.transform(indices, lambda p, i: F.struct(flat(p, s).alias("at"), i.alias("i"))), values.cast("array<double>"), lambda c, v: F.struct(c["at"].alias("at"), c["i"].alias("i"), v.alias("v"))))
        return C.bound(total, lambda n: C.bound(cells, lambda c: laid(c, n)))

    return F.when(indices.isNotNull() & values.isNotNull() & shape.isNotNull(), C.bound(shape, grid))


def unit_sphere(points: Column) -> Column:
    """Points moved so that their mean is the origin, and scaled so that the farthest is 1 from it; all zeros where they coincide."""
    axis = lambda p, i: F.transform(p, lambda x: F.get(x, i).cast("double"))
    mean = lambda p: F.transform(F.sequence(F.lit(0), F.size(F.get(p, F.lit(0))) - 1), lambda i: F.aggregate(axis(p, i), F.lit(0.0), lambda s, v: s + v) / F.size(p))
    moved = lambda m: F.transform(points, lambda x: F.zip_with(x, m, lambda a, b: a - b))
    far = lambda p: F.array_max(F.transform(p, lambda x: F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))))
    scaled = lambda p: C.bound(far(p), lambda m: F.transform(p, lambda x: F.transform(x, lambda v: F.coalesce(F.try_divide(v, m), F.lit(0.0)))))
    return F.when(F.size(points) > 0, C.bound(C.bound(mean(points), moved), scaled)).otherwise(F.array().cast("array<array<double>>"))


def padded(points: Column, n: int = 2000, axes: int = 3) -> Column:
    """n points, zeros behind those there are; null where there are more."""
    zeros = F.array(*[F.lit(0.0)] * axes)
    return F.when(F.size(points) <= n, F.concat(points.cast("array<array<double>>"), F.array_repeat(zeros, F.lit(n) - F.size(points))))


def weighted_centre(points: Column, weights: Column) -> Column:
    """The mean of the points by weight; the weights' sum counts as 1e-8 at least."""
    total = F.greatest(F.aggregate(weights, F.lit(0.0), lambda s, w: s + w), F.lit(1e-8))
    along = lambda i: F.aggregate(F.zip_with(points, weights, lambda p, w: F.get(p, i) * w), F.lit(0.0), lambda s, v: s + v)
    return C.bound(total, lambda t: F.transform(F.sequence(F.lit(0), F.size(F.get(points, F.lit(0))) - 1), lambda i: along(i) / t))


def radial_features(points: Column, weights: Column) -> Column:
    """Per point a struct of its distance r from the weighted centre (1e-6 at least), the unit direction, and density, log1p(r), r squared and cubed, density
    times r and r squared, exp(-r squared / 2)."""

    def of(centre: Column) -> Column:
        def one(p: Column, w: Column) -> Column:
            moved = F.zip_with(p, centre, lambda a, b: a - b)

            def named(m: Column) -> Column:
                r = F.greatest(F.sqrt(F.aggregate(m, F.lit(0.0), lambda s, v: s + v * v)), F.lit(1e-6))
                fields = lambda r: F.struct(r.alias("r"), F.transform(m, lambda v: v / r).alias("direction"), w.alias("density"), F.log1p(r).alias("log_r"), (r * r).alias("r2"), (r * r * r).alias("r3"), (w * r).alias("density_r"), (w * r * r).alias("density_r2"), F.exp(-r * r / 2).alias("gauss"))
                return C.bound(r, fields)

            return C.bound(moved, named)

        return F.zip_with(points, weights, one)

    none = F.array().cast("array<struct<r:double,direction:array<double>,density:double,log_r:double,r2:double,r3:double,density_r:double,density_r2:double,gauss:double>>")
    return F.when(F.size(points) > 0, C.bound(weighted_centre(points, weights), of)).otherwise(none)
