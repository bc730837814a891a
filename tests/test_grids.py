"""2-D maps against numpy: reductions, boxes, smoothing, bands, column widths, half precision, and the layout of a synthetic page."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import clouds, grids
from tessera.operators import tracking


def one(spark, values, width, **columns):
    df = spark.createDataFrame([([float(x) for x in np.ravel(values)], width)], "v array<double>, w int")
    return df.select(*[c.alias(k) for k, c in columns.items()]).first()


V = W = None


@pytest.fixture(autouse=True)
def columns(spark):
    global V, W
    V, W = F.col("v"), F.col("w")


def mirrored(a, sigma):
    """The Gaussian in plain numpy, by numpy's own mirrored padding."""
    size = round(8 * sigma + 1) | 1
    k = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma**2))
    return np.convolve(np.pad(a, size // 2, mode="reflect"), k / k.sum(), "valid")


def test_reductions_and_boxes(spark):
    a = np.random.default_rng(1).integers(0, 256, (7, 5)).astype(float)
    box = F.struct(F.lit(1).alias("x0"), F.lit(2).alias("y0"), F.lit(4).alias("x1"), F.lit(6).alias("y1"))
    got = one(spark, a, 5, m=grids.row_means(V, W), p=grids.row_means(V, W, 2), s=grids.column_sums(V, W), q=grids.column_sums(V, W, F.lit(1), F.lit(3), 3), n=grids.column_sums(V, W, F.lit(3), F.lit(3)), c=grids.crop(V, W, box), h=grids.height(V, W))
    assert np.allclose(got.m, a.mean(1)) and np.allclose(got.p, a[:, 2:].mean(1)) and np.allclose(got.s, a.sum(0)) and np.allclose(got.q, a[1:3, 3:].sum(0))
    assert got.n == [0.0] * 5 and got.c == a[2:6, 1:4].ravel().tolist() and got.h == 7
    page = np.full((60, 900), 255.0)
    page[20:30, 15:880] = 0
    b = one(spark, page, 900, b=grids.content_box(V, W), e=grids.content_box(F.transform(V, lambda x: F.lit(255.0)), W), t=grids.content_box(V, W, below=0))
    assert tuple(b.b) == (7, 12, 887, 37) and tuple(b.e) == tuple(b.t) == (0, 0, 900, 60)


@pytest.mark.parametrize("n, sigma", [(30, 0.8), (30, 2.0), (12, 1.1), (2, 0.8), (1, 1.0)])
def test_gaussian(spark, n, sigma):
    a = np.random.default_rng(n).random(n)
    got = one(spark, a, 1, g=grids.gaussian(V, sigma)).g
    if n > 2:
        assert np.allclose(got, mirrored(a, sigma)) and np.allclose(tracking.blur(a, sigma), got)
    else:
        assert np.allclose(got, tracking.blur(a, sigma)) and len(got) == n
    assert one(spark, [], 1, g=grids.gaussian(V, sigma)).g == []


def test_row_centres(spark):
    page = np.zeros((480, 100))
    for y, x in ((100, 2.0), (200, 1.0), (300, 3.0), (400, 1.5), (20, 9.0)):
        page[y, 18:] = x  # a band in the top margin doesn't count
    page[150, :18] = 99  # nor does what lies left
    assert one(spark, page, 100, c=grids.row_centres(V, W)).c == [100, 200, 300, 400]
    page[200] = 0
    assert one(spark, page, 100, c=grids.row_centres(V, W)).c == np.linspace(115, 441, 4).astype(int).tolist()


@pytest.mark.parametrize("marks, start, want", [((94, 190, 287), 0, 96), ((95, 188, 284), 30, 94), ((60, 140, 300), 0, 94), ((), 0, 94), ((94,), 0, 94), ((90, 270), 0, 94)])
def test_column_width(spark, marks, start, want):
    """Marks near the multiples of 94 (87 with a start of 30); what is too far from one, or none, leaves the expected width."""
    page = np.ones((40, 400))
    for x in marks:
        page[:, start + x] = 30
    expect = int((400 - start) * 0.94 / 4)
    near = [x for i in (1, 2, 3) for x in marks if i * expect - int(expect * 0.2) <= x < i * expect + int(expect * 0.2)]
    steps = [b - a for a, b in zip([0, *near], near, strict=False)]
    middle = np.median(steps) if steps else 0
    own = int(middle) if 0.75 * expect <= middle <= 1.25 * expect else expect
    assert one(spark, page, 400, c=grids.column_width(V, W, F.lit(0), F.lit(40), start)).c == own and (start or own == want)


def test_half(spark):
    rnd = np.random.default_rng(3)
    edge = [0.0, -0.0, 1.0, 65504, 65519.99, 65520, -65520, 1e300, 2**-14, 2**-24, 2**-25, 2**-25 * 1.0000001, 3 * 2**-25, 2**-14 - 2**-25, 2047.5, 2048.5, 2049, 0.1, float("inf"), float("-inf"), float("nan")]
    x = np.concatenate([edge, rnd.normal(size=500) * 10.0 ** rnd.integers(-9, 6, 500), 1 + rnd.integers(0, 4096, 200) / 4096])
    got = np.array(one(spark, x, 1, h=F.transform(V, grids.half)).h)
    with np.errstate(over="ignore"):
        want = x.astype(np.float16).astype(float)
    assert np.array_equal(got, want, equal_nan=True)
    assert spark.range(1).select(grids.half(F.lit(None).cast("double"))).first()[0] is None


def slow_track(score, centre):
    h, w = score.shape
    most = max(10, min(28, h // 5))
    best, came = [score[y, 0] - 0.01 * (y - centre) ** 2 for y in range(h)], []
    for x in range(1, w):
        source = [max((s for s in range(h) if abs(y - s) <= most), key=lambda s, y=y: (best[s] - 0.05 * abs(y - s), s)) for y in range(h)]
        best, came = [score[y, x] + (best[s] - 0.05 * abs(y - s)) for y, s in enumerate(source)], [*came, source]
    path = [int(np.argmax(best))]
    for source in reversed(came):
        path.append(source[path[-1]])
    return path[::-1]


def test_tracks_of_many_maps():
    rnd = np.random.default_rng(9)
    for h in (1, 2, 12, 60):
        maps = np.round(rnd.random((5, h, 9)) * 4) / 4  # ties
        got = tracking.track_all(maps, np.full(5, h // 2))
        assert [p.tolist() for p in got] == [slow_track(m, h // 2) for m in maps]
    mixed = [rnd.random((4, 6)), rnd.random((5, 3)), np.empty((0, 0)), rnd.random((4, 6))]
    paths = tracking.smooth_tracks(mixed, [2, 2, 0, 2], 0.8)
    assert [len(p) for p in paths] == [6, 3, 0, 6]
    assert np.allclose(paths[3], mirrored(tracking.track(tracking.blur(mixed[3], 0.8, 0), 2).astype(float), 0.8))


def page(h=600, w=1000, start=60, step=220):
    """A score map with a calibration pulse, four bands of waves, and marks between the columns; the true rows of every lead."""
    score, lines = np.zeros((h, w)), {}
    centres = [150, 260, 370, 480]
    for r, y in enumerate(centres):
        x = np.arange(w)
        line = y + np.round(18 * np.sin(x / 23 + r)).astype(int)
        if r == 0:
            line[10:40] = y - 45  # the pulse: 30 pixels wide, over 4 mm high
        if r == 0:
            line[:10] = y
        score[line, x] = 255
        lines[r] = line
    for i in (1, 2, 3):
        score[: int(centres[2] + 40), start + i * step] += 40
    return score, lines, centres


def test_lead_layout(spark):
    score, lines, centres = page()
    rows = [("a", score.ravel().tolist(), 1000), ("blank", [0.0] * 2000, 100), ("none", None, 10), ("short", [1.0], 10), ("nowidth", [1.0] * 20, None)]
    df = spark.createDataFrame(rows, "page string, values array<double>, width int")
    got = tracking.lead_layout(df)
    leads = {(r.page, r.lead): r for r in got.collect()}
    assert {p for p, _ in leads} == {"a", "blank"} and len(leads) == 26
    own = {lead: r for (p, lead), r in leads.items() if p == "a"}
    x0, x1 = own["I"].box.x0, own["I"].box.x1
    assert 40 <= x0 <= 60 and abs(x1 - x0 - 220) <= 8 and own["V4"].box.x0 == x0 + 3 * (x1 - x0)
    assert [own[n].box.x0 for n in ("II", "aVR", "aVL")] == [x0, x1, x1] and (own["II_long"].box.x0, own["II_long"].box.x1) == (x0, own["V4"].box.x1)
    for r, names in enumerate([*tracking.LEADS, (tracking.LONG,)]):
        for name in names:
            b, path = own[name].box, np.array(own[name].path)
            assert len(path) == b.x1 - b.x0 and b.y0 < centres[r] < b.y1
            inner = slice(3, -3)
            assert np.abs(path - lines[r][b.x0 : b.x1])[inner].max() <= 1 and np.abs(path - lines[r][b.x0 : b.x1])[inner].mean() < 0.5
    signals = {r.lead: r["values"] for r in tracking.lead_signals(got.filter("page = 'a'")).collect()}
    assert {n: len(v) for n, v in signals.items()} == {n: 5000 if n == tracking.LONG else 1250 for n in own}
    scale = own["I"].px_per_mm * 10
    assert own["I"].px_per_mm == (x1 - x0) / 62.5
    assert max(signals["II"]) - min(signals["II"]) == pytest.approx(36 / scale, rel=0.05) and all(np.float16(v) == v for v in signals["aVL"][:50])


def test_clouds(spark):
    df = spark.createDataFrame([([[0, 1, 1], [1, 0, 0], [0, 1, 1]], [2.0, 3.0, 5.0], [2, 2, 2]), ([], [], [1, 1, 2]), (None, [1.0], [1])], "i array<array<int>>, v array<double>, s array<int>")
    got = [r[0] for r in df.select(clouds.dense(F.col("i"), F.col("v"), F.col("s"))).collect()]
    assert got == [[0, 0, 0, 5, 3, 0, 0, 0], [0, 0], None]
    p = np.random.default_rng(5).random((9, 3)) * 7
    df = spark.createDataFrame([([x.tolist() for x in p],), ([[2.0, 2.0, 2.0]] * 2,), ([],), (None,)], "p array<array<double>>")
    rows = df.select(clouds.unit_sphere(F.col("p")).alias("u"), clouds.padded(F.col("p"), 9).alias("n"), clouds.padded(F.col("p"), 8).alias("x")).collect()
    c = p - p.mean(0)
    assert np.allclose(rows[0].u, c / np.linalg.norm(c, axis=1).max()) and rows[1].u == [[0, 0, 0]] * 2 and rows[2].u == []
    assert np.allclose(rows[0].n, p) and rows[0].x is None and rows[1].n[2:] == [[0, 0, 0]] * 7 and rows[3].n is None


def test_corners_and_radial_features(spark):
    df = spark.createDataFrame([([(9, 8), (1, 1), (8, 0), (0, 9)],)], "p array<struct<x: int, y: int>>")
    assert [tuple(r) for r in df.select(grids.quad_corners(F.col("p"))).first()[0]] == [(1, 1), (8, 0), (9, 8), (0, 9)]
    rnd = np.random.default_rng(2)
    p, w = rnd.random((6, 3)) * 4, rnd.random(6)
    df = spark.createDataFrame([(p.tolist(), w.tolist()), ([[1.0, 2.0, 3.0]], [0.0]), ([], [])], "p array<array<double>>, w array<double>")
    rows = [r.f for r in df.select(clouds.radial_features(F.col("p"), F.col("w")).alias("f")).collect()]
    c = p - (p * w[:, None]).sum(0) / w.sum()
    r = np.linalg.norm(c, axis=1)
    for got, x, n, d in zip(rows[0], c, r, w, strict=True):
        assert np.allclose([got.r, got.density, got.log_r, got.r2, got.r3, got.density_r, got.density_r2, got.gauss], [n, d, np.log1p(n), n**2, n**3, d * n, d * n**2, np.exp(-n * n / 2)]) and np.allclose(got.direction, x / n)
    assert rows[1][0].r == pytest.approx(np.sqrt(14)) and rows[2] == []


def test_maps_are_laid_without_python_and_once(spark):
    """No batch of maps passes through Python, a place outside is an error, and no filter or expression lays a map anew."""
    from tessera.jobs import signals

    df = spark.createDataFrame([([[1, 1], [0, 2], [1, 1]], [2.0, 3.0, 5.0])], "i array<array<int>>, v array<double>").select(clouds.dense(F.col("i"), F.col("v"), F.array(F.lit(2), F.lit(3))).alias("g"))
    assert df.first().g == [0, 0, 3, 0, 5, 0] and "Python" not in df._jdf.queryExecution().executedPlan().toString()
    for place in ([2, 0], [-1, 0], [0, 3], [0]):
        with pytest.raises(Exception, match="outside the grid"):
            spark.createDataFrame([([place], [1.0])], "i array<array<int>>, v array<double>").select(clouds.dense(F.col("i"), F.col("v"), F.array(F.lit(2), F.lit(3)))).collect()
    for query in (signals.sg_row_centres, signals.sg_row_layout, signals.sg_column_width, signals.sg_content_box):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "Python" not in plan and plan.count("outside the grid") == 1


def test_tracks_hold_few_maps_at_once(monkeypatch):
    """Wide flat maps: what is held is bounded in cells, not in comparisons alone; the paths are the same."""
    held = []
    whole = tracking.track_all
    monkeypatch.setattr(tracking, "track_all", lambda scores, *a: held.append(scores.size) or whole(scores, *a))
    maps = list(np.random.default_rng(4).random((300, 3, 4000)))
    got = tracking.smooth_tracks(maps, [1] * 300, 0.0)
    assert max(held) <= tracking.CELLS and all(np.array_equal(p, tracking.track(m, 1)) for p, m in zip(got[::50], maps[::50], strict=True))
