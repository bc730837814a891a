"""Ridge tracking: a path through a score map, one row per column, by dynamic programming; and the layout of leads on a page."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.functions import grids

#: Leads of a page: three rows of four, and below them the rhythm lead over the whole width.
LEADS = (("I", "aVR", "V1", "V4"), ("II", "aVL", "V2", "V5"), ("III", "aVF", "V3", "V6"))
LONG = "II_long"
SHORT_S, LONG_S, RATE = 2.5, 10.0, 500
MM_PER_S, MM_PER_MV = 25.0, 10.0
SMOOTH = 0.8
CELLS = 1_000_000  # comparisons, or cells of maps, held at once


def blur(a: np.ndarray, sigma: float, axis: int = -1) -> np.ndarray:
    """Smoothed along an axis by a Gaussian of round(8 sigma + 1) places, or one more if that is even; mirrored at the ends."""
    reach, n = round(8 * sigma + 1) // 2, a.shape[axis]
    if n == 1 or sigma <= 0:
        return a.astype(float)
    weights = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma * sigma))
    at = np.arange(-reach, n + reach) % (2 * (n - 1))
    wide = np.take(a, np.where(at < n, at, 2 * (n - 1) - at), axis=axis)
    windows = np.lib.stride_tricks.sliding_window_view(wide, 2 * reach + 1, axis=axis)
    return windows @ (weights / weights.sum())


def track_all(scores: np.ndarray, centres: np.ndarray | None = None, jump_cost: float = 0.05, start_cost: float = 0.01) -> np.ndarray:
    """(maps, columns): of each map of scores (maps, rows, columns) the row of every column that maximises the scores less jump_cost per row
    jumped; a jump is at most max(10, min(28, rows / 5)).

    The first column pays start_cost times the squared distance from the map's centre, if given. Of equal sources the lowest (greatest
    row) is taken. Each column is one step over all maps, rows and jumps.
    """
    n, h, w = scores.shape
    most = min(max(10, min(28, h // 5)), h - 1)
    rows = np.arange(h)
    by_column = np.ascontiguousarray(np.moveaxis(scores, 2, 0))
    best = by_column[0] - (start_cost * (rows - np.asarray(centres, float)[:, None]) ** 2 if centres is not None else 0)
    came = np.zeros((w, n, h), np.int32)
    padded = np.full((n, h + 2 * most), -np.inf)
    price = jump_cost * np.abs(np.arange(most, -most - 1, -1))
    for x in range(1, w):
        padded[:, most : most + h] = best
        # The greatest source row comes first, so that argmax takes it of equal ones.
        options = np.lib.stride_tricks.sliding_window_view(padded, 2 * most + 1, axis=1)[:, :, ::-1] - price
        choice = options.argmax(axis=2)
        best = by_column[x] + np.take_along_axis(options, choice[:, :, None], 2)[:, :, 0]
        came[x] = rows + most - choice
    path = np.empty((n, w), np.int32)
    path[:, -1] = best.argmax(axis=1)
    for x in range(w - 1, 0, -1):
        path[:, x - 1] = came[x, np.arange(n), path[:, x]]
    return path


def track(score: np.ndarray, centre: float | None = None, jump_cost: float = 0.05, start_cost: float = 0.01) -> np.ndarray:
    """track_all of one map."""
    return track_all(score[None], None if centre is None else np.array([centre]), jump_cost, start_cost)[0]


def smooth_tracks(maps: list[np.ndarray], centres: list[float], smooth: float) -> list[np.ndarray]:
    """The path of every map, maps of one shape in one go; with smooth over 0 columns are smoothed before and paths after."""
    out: list[np.ndarray] = [np.empty(0)] * len(maps)
    shapes: dict[tuple[int, int], list[int]] = {}
    for i, m in enumerate(maps):
        if m.size:
            shapes.setdefault(m.shape, []).append(i)
    for (h, w), every in shapes.items():
        step = max(1, CELLS // (h * max(w, 2 * max(10, min(28, h // 5)) + 1)))
        for lo in range(0, len(every), step):
            own = every[lo : lo + step]
            scores = np.stack([maps[i] for i in own]).astype(float)
            # Rounded, so that columns of one shape tie whatever the order their taps were added in.
            paths = track_all(np.round(blur(scores, smooth, 1), 6) if smooth else scores, np.array([centres[i] for i in own]))
            for i, path in zip(own, blur(paths.astype(float), smooth) if smooth else paths, strict=True):
                out[i] = path
    return out


def ridge(values: Column, width: Column, centre: Column, smooth: float = SMOOTH) -> Column:
    """The path of a map held as rows end to end, smoothed; empty for a map without a whole row, null for null."""

    def run(values: pd.Series, width: pd.Series, centre: pd.Series) -> pd.Series:
        shaped = lambda v, w: np.asarray(v, float)[: len(v) // w * w].reshape(-1, w) if v is not None and w > 0 else np.empty((0, 0))
        maps = [shaped(v, int(w)) for v, w in zip(values, width, strict=True)]
        paths = smooth_tracks(maps, list(centre), smooth)
        return pd.Series([None if v is None else p for v, p in zip(values, paths, strict=True)])

    return F.pandas_udf(run, "array<double>")(values, F.coalesce(width, F.lit(0)), F.coalesce(centre.cast("double"), F.lit(0.0)))


def ridges(maps: DataFrame, key: str, values: str, height: int, smooth: float = SMOOTH) -> DataFrame:
    """(key, x, y): the ridge of every map, given as rows of equal width laid end to end. Maps are independent: no shuffle."""
    own = maps.select(F.col(key), F.col(values).alias("_v")).filter(F.size("_v") >= height)
    path = ridge(F.col("_v"), F.floor(F.size("_v") / height).cast("int"), F.lit(height // 2), smooth)
    # What is left over of a last row that isn't whole is cut off, or it would count as one more row.
    own = own.withColumn("_v", F.slice("_v", F.lit(1), F.floor(F.size("_v") / height).cast("int") * height))
    return own.select(key, F.posexplode(path).alias("x", "y"))


def calibration_end(path: np.ndarray, px_per_mm: float) -> int:
    """Where a calibration pulse ends in a traced line (y grows downwards), or 0 for none: within the first 20 mm, samples over 4 mm above the
    median that span more than 2.5 mm; then the first return to within 1 mm of it, and a margin."""
    limit = min(int(20 * px_per_mm), len(path) - 1)
    if limit < int(5 * px_per_mm) or limit <= 0:
        return 0
    base = float(np.median(path))
    high = np.flatnonzero(path[:limit] < base - 4 * px_per_mm)
    if not len(high) or high[-1] - high[0] <= 2.5 * px_per_mm:
        return 0
    back = np.flatnonzero(path[high[-1] : limit] > base - px_per_mm)
    end = high[-1] + back[0] + max(3, int(1.5 * px_per_mm)) if len(back) else high[-1] + int(3 * px_per_mm)
    return int(min(end, len(path) - 1))


def calibration_ends(lines: DataFrame, key: str, path: str, px_per_mm: str) -> DataFrame:
    """(key, calib_end) of every traced line. Lines are independent: no shuffle."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            ends = [calibration_end(np.asarray(p, float), s) if p is not None and s == s else 0 for p, s in zip(pdf[path], pdf[px_per_mm], strict=True)]
            yield pd.DataFrame({key: pdf[key], "calib_end": np.array(ends, np.int32)})

    return lines.select(F.col(key), F.col(path), F.col(px_per_mm).cast("double")).mapInPandas(run, f"{key} bigint, calib_end int")


def boxes(rows: list[tuple[int, int]], start: int, step: int, width: int) -> list[tuple[str, tuple[int, int, int, int]]]:
    """(lead, (x0, y0, x1, y1)) of the 13 leads of a page: bands of rows, columns of a step from the start, none beyond the page's width."""
    end, out = min(width, start + 4 * step), []
    for row, names in enumerate(LEADS):
        for column, name in enumerate(names):
            x0 = start + column * step
            x1 = min(end, x0 + step)
            out.append((name, (x0, rows[row][0], max(x1, x0 + 1), rows[row][1])))
    return [*out, (LONG, (start, rows[3][0], end, rows[3][1]))]


def lead_layout(pages: DataFrame, key: str = "page", values: str = "values", width: str = "width") -> DataFrame:
    """(key, lead, box, path, px_per_mm): the 13 leads of every page, each with its box on the page and the row of its line in every column of the box,
    in page coordinates.

    A page is a score map, rows end to end. Its four bands give the rows; the first band's line gives the end of the calibration pulse, where the
    columns begin; marks between the columns give their width. The page is cut into its boxes, one row each, and the line of each box is tracked by
    itself. Pages are independent: no shuffle.

    Nulls and edges: a page without a whole row has no leads, nor has one whose map or width is null; on a blank page the bands are evenly
    spaced; columns beyond the right edge are one pixel wide.
    """
    kind = pages.schema[key].dataType.simpleString()
    v, w = F.col("_v"), F.col("_w")
    p = pages.select(F.col(key).alias("_k"), F.col(values).cast("array<double>").alias("_v"), F.col(width).cast("int").alias("_w")).filter((F.col("_w") > 0) & (F.size("_v") >= F.col("_w")))
    bands = C.bound(grids.row_centres(v, w), lambda c: C.row_bounds(c, grids.height(v, w)))
    p = p.select("_k", "_v", "_w", F.transform(bands, lambda b: b["y0"]).alias("_top"), F.transform(bands, lambda b: b["y1"]).alias("_end"))

    def shaped(v, w: int) -> np.ndarray:
        return np.asarray(v, float)[: len(v) // w * w].reshape(-1, w)

    def start(batches: Iterator) -> Iterator:
        for pdf in batches:
            maps = [shaped(v, w)[top[0] : end[0]] for v, w, top, end in zip(pdf["_v"], pdf["_w"], pdf["_top"], pdf["_end"], strict=True)]
            lines = smooth_tracks(maps, [m.shape[0] // 2 for m in maps], SMOOTH)
            yield pdf.assign(_x=np.array([calibration_end(line, w / (LONG_S * MM_PER_S)) if len(line) else 0 for line, w in zip(lines, pdf["_w"], strict=True)], np.int32))

    def cut(batches: Iterator) -> Iterator:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                page, placed = shaped(r.v, r.w), boxes(list(zip(r.top, r.end, strict=True)), r.x, r.step, r.w)
                scale = float(np.median([b[2] - b[0] for _, b in placed[:-1]]))
                out = [(r.k, name, *b, scale, page[b[1] : b[3], b[0] : b[2]].ravel()) for name, b in placed]
                yield pd.DataFrame(out, columns=["_k", "lead", "x0", "y0", "x1", "y1", "short_width", "_v"])

    p = p.mapInPandas(start, f"_k {kind}, _v array<double>, _w int, _top array<int>, _end array<int>, _x int")
    step = grids.column_width(v, w, F.get("_top", F.lit(0)), F.get("_end", F.lit(2)), F.col("_x"))
    p = p.select(*[F.col(f"_{c}").alias(c) for c in ("k", "v", "w", "top", "end", "x")], step.alias("step"))
    rows = p.mapInPandas(cut, f"_k {kind}, lead string, x0 int, y0 int, x1 int, y1 int, short_width double, _v array<double>")
    path = ridge(v, F.col("x1") - F.col("x0"), F.floor((F.col("y1") - F.col("y0")) / 2), SMOOTH)
    traced = rows.select(F.col("_k").alias(key), "lead", F.struct("x0", "y0", "x1", "y1").alias("box"), "short_width", path.alias("_path"))
    scale = C.px_per_mm(F.array("short_width"), F.lit(None).cast("double"), SHORT_S * MM_PER_S)
    return traced.select(key, "lead", "box", F.transform("_path", lambda y: y + F.col("box.y0")).alias("path"), scale.alias("px_per_mm"))


def lead_signals(layout: DataFrame, key: str = "page") -> DataFrame:
    """(key, lead, values): millivolts above the lead's median row, resampled to RATE a second, as 16-bit floats hold them."""
    n = F.size("path")
    ordered = F.sort_array("path")
    base = C.bound(ordered, lambda o: (F.get(o, F.floor((n - 1) / 2).cast("int")) + F.get(o, F.floor(n / 2).cast("int"))) / 2)
    rows = layout.withColumn("_mv", C.bound(base, lambda b: F.transform("path", lambda y: (b - y) / (F.col("px_per_mm") * MM_PER_MV))))
    short, long = (C.resample(F.col("_mv"), round(s * RATE)) for s in (SHORT_S, LONG_S))
    return rows.select(key, "lead", F.transform(F.when(F.col("lead") == LONG, long).otherwise(short), grids.half).alias("values"))
