"""Signal layout queries: a user's events plotted on a page, time to the right and value upwards, are the score maps."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tessera.functions import clouds, grids
from tessera.functions import columns as C
from tessera.jobs.registry import query, table
from tessera.operators import tracking

TOP = 250.0  # the value at the upper edge; higher ones are plotted there


def _pages(spark, d, rows: int, hours: int, key: str = "user_id"):
    """(page, values, width): a cell holds 64 for each event in it, 255 at most. Cells are counted before they meet by page."""
    e = table(spark, d, "events")
    width = 31 * 24 // hours
    x = (F.dayofmonth("ts") - 1) * (24 // hours) + F.floor(F.hour("ts") / hours)
    y = rows - 1 - F.least(F.lit(rows - 1), F.floor(F.greatest("value", F.lit(0.0)) * rows / TOP))
    cells = e.select(F.col(key).alias("page"), x.cast("int").alias("x"), y.cast("int").alias("y")).filter("x is not null and y is not null").groupBy("page", "x", "y").agg(F.least(F.lit(255.0), 64.0 * F.count("*")).alias("v"))
    listed = cells.groupBy("page").agg(F.collect_list(F.struct("y", "x", "v")).alias("c"))  # rows * width at most
    grid = clouds.dense(F.transform("c", lambda c: F.array(c["y"], c["x"])), F.transform("c", lambda c: c["v"]), F.array(F.lit(rows), F.lit(width)))
    # A generator lays each map once: a plain column would be computed anew in filters and expressions that name it.
    return listed.select("page", F.explode_outer(F.array(grid)).alias("values"), F.lit(width).alias("width"))


def _pages_sql(rows: int, hours: int) -> str:
    """p: user, place and value of every cell of the page, zeros included."""
    w = 31 * 24 // hours
    return f"""c AS (SELECT user_id, (day(ts) - 1) * {24 // hours} + hour(ts) // {hours} AS x, {rows - 1} - least({rows - 1}, floor(greatest(value, 0) * {rows} / {TOP}::DOUBLE)::INT) AS y, least(255, 64 * count(*))::DOUBLE AS v FROM events GROUP BY ALL),
p AS (SELECT u.user_id, x.x, y.y, coalesce(v, 0) AS v FROM (SELECT DISTINCT user_id FROM events) u, (SELECT unnest(range(0, {w})) AS x) x, (SELECT unnest(range(0, {rows})) AS y) y LEFT JOIN c ON c.user_id = u.user_id AND c.x = x.x AND c.y = y.y)"""


def _smooth_sql(values: str, n: int, sigma: float) -> str:
    """The list of n values smoothed by a Gaussian: mirrored ends are put on, then every window is weighted."""
    reach = round(8 * sigma + 1) // 2
    weights = [math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(-reach, reach + 1)]
    kernel = ", ".join(f"{w / sum(weights)!r}::DOUBLE" for w in weights)
    wide = f"list_concat(list_reverse({values}[2:{reach + 1}]), {values}, list_reverse({values}[{n - reach}:{n - 1}]))"
    return f"list_transform(range(1, {n + 1}), lambda i: list_dot_product(({wide})[i:i + {2 * reach}], [{kernel}]))"


@query(f"""WITH {_pages_sql(60, 8)}, i AS (SELECT user_id, min(x) AS a, max(x) AS b, min(y) AS e, max(y) AS f FROM p WHERE 255 - v < 128 GROUP BY 1),
b AS (SELECT user_id, coalesce(greatest(0, a - greatest(8, floor(0.01::DOUBLE * (b - a + 1))::INT)), 0) AS x0, coalesce(greatest(0, e - greatest(8, floor(0.01::DOUBLE * (f - e + 1))::INT)), 0) AS y0, coalesce(least(93, b + greatest(8, floor(0.01::DOUBLE * (b - a + 1))::INT)), 93) AS x1,
coalesce(least(60, f + greatest(8, floor(0.01::DOUBLE * (f - e + 1))::INT)), 60) AS y1 FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN i USING (user_id)),
r AS (SELECT user_id, y, avg(v) AS m FROM p JOIN b USING (user_id) WHERE x >= x0 AND x < x1 AND y >= y0 AND y < y1 GROUP BY ALL), s AS (SELECT user_id, x, sum(v) AS s FROM p JOIN b USING (user_id) WHERE x >= x0 AND x < x1 AND y >= y0 AND y < y1 GROUP BY ALL)
SELECT user_id AS page, x0::INT AS x0, y0::INT AS y0, x1::INT AS x1, y1::INT AS y1, round((SELECT max(m) FROM r WHERE r.user_id = b.user_id), 6) AS most_row, round((SELECT max(s) FROM s WHERE s.user_id = b.user_id), 6) AS most_column FROM b""")
def sg_content_box(spark, d):
    """The box of the cells with two events or more on a user's page, and the highest row mean and column sum in it."""
    v, w = F.col("values"), F.col("width")
    p = _pages(spark, d, 60, 8).withColumn("box", grids.content_box(F.transform(v, lambda x: 255 - x), w, below=128))
    p = p.withColumn("inner", grids.crop(v, w, F.col("box"))).withColumn("across", F.col("box.x1") - F.col("box.x0"))
    most = lambda x: F.round(F.array_max(x), 6)
    return p.select("page", "box.*", most(grids.row_means(F.col("inner"), F.col("across"))).alias("most_row"), most(grids.column_sums(F.col("inner"), F.col("across"))).alias("most_column"))


#: e: smoothed row means; z: the four row centres of every user's page.
_CENTRES = f"""{_pages_sql(240, 12)}, r AS (SELECT user_id, y, avg(v) AS m FROM p WHERE x >= 11 GROUP BY ALL), l AS (SELECT user_id, list(m ORDER BY y) AS m FROM r GROUP BY 1), e AS (SELECT user_id, {_smooth_sql('m', 240, 5.0)} AS e FROM l),
k AS (SELECT user_id, list_transform(range(1, 241), lambda i: round(CASE WHEN i <= 28 OR i > 236 THEN list_min(e) ELSE e[i] END, 9)) AS s FROM e),
m AS (SELECT user_id, unnest(list_filter(range(2, 240), lambda i: s[i] >= s[i - 1] AND s[i] > s[i + 1])) AS i, s FROM k), o AS (SELECT user_id, i - 1 AS place, row_number() OVER (PARTITION BY user_id ORDER BY s[i] DESC, i) AS k FROM m),
g(user_id, k, taken) AS (SELECT user_id, 0::BIGINT, []::BIGINT[] FROM k UNION ALL SELECT g.user_id, o.k, CASE WHEN len(taken) < 4 AND len(list_filter(taken, lambda t: abs(t - place) < 50)) = 0 THEN list_append(taken, place) ELSE taken END FROM g JOIN o ON o.user_id = g.user_id AND o.k = g.k + 1),
t AS (SELECT user_id, list_sort(taken) AS t FROM g QUALIFY k = max(k) OVER (PARTITION BY user_id)), z AS (SELECT user_id, len(t) = 4 AS found, CASE WHEN len(t) = 4 THEN t ELSE [57, 111, 165, 220] END AS t FROM t)"""


@query(f"""WITH RECURSIVE {_CENTRES}
SELECT user_id AS page, unnest(range(0, 4))::INT AS i, unnest(t)::INT AS centre, unnest(list_transform(t, lambda x: round(e[x + 1], 5))) AS energy FROM z JOIN e USING (user_id)""")
def sg_row_centres(spark, d):
    """The four bands of a user's page, or evenly spaced rows, with the smoothed mean of each."""
    v, w = F.col("values"), F.col("width")
    p = _pages(spark, d, 240, 12).select("page", grids.row_centres(v, w).alias("c"), grids.gaussian(grids.row_means(v, w, F.floor(w * 0.18).cast("int")), 5.0).alias("e"))
    return p.select("page", F.posexplode_outer("c").alias("i", "centre"), "e").select("page", "i", "centre", F.round(F.get("e", F.col("centre")), 5).alias("energy"))


@query(f"""WITH RECURSIVE {_CENTRES}, b AS (SELECT user_id, [greatest(0, trunc(t[1] - 0.7::DOUBLE * (t[2] - t[1]))), trunc((t[1] + t[2]) / 2), trunc((t[2] + t[3]) / 2), trunc((t[3] + t[4]) / 2)] AS y0,
[trunc((t[1] + t[2]) / 2), trunc((t[2] + t[3]) / 2), trunc((t[3] + t[4]) / 2), least(240, trunc(t[4] + 0.7::DOUBLE * (t[4] - t[3])))] AS y1 FROM z)
SELECT user_id AS page, y0[1]::BIGINT AS top, y1[2]::BIGINT AS mid, y1[4]::BIGINT AS bottom, round(list_median(list_transform(range(1, 5), lambda i: y1[i] - y0[i])) / 62.5::DOUBLE, 6) AS px_per_mm FROM b""")
def sg_row_layout(spark, d):
    """The bands of rows around the centres of a user's page, and the scale if each were as wide as it is high."""
    p = _pages(spark, d, 240, 12).select("page", C.bound(grids.row_centres(F.col("values"), F.col("width")), lambda c: C.row_bounds(c, F.lit(240))).alias("b"))
    at = lambda i, y: F.get("b", F.lit(i))[y].cast("long")
    scale = C.px_per_mm(F.transform("b", lambda x: x["y1"] - x["y0"]), F.lit(None).cast("double"))
    return p.select("page", at(0, "y0").alias("top"), at(1, "y1").alias("mid"), at(3, "y1").alias("bottom"), F.round(scale, 6).alias("px_per_mm"))


_TALL, _SPAN = 24, 31 * 4


@query(f"""WITH RECURSIVE {_pages_sql(_TALL, 6)}, l AS (SELECT user_id, x, list(v ORDER BY y) AS v FROM p GROUP BY ALL), s AS (SELECT user_id, x, list_transform({_smooth_sql('v', _TALL, 0.8)}, lambda v: round(v, 6)) AS s FROM l),
b(user_id, x, best, came) AS (SELECT user_id, x, list_transform(range(0, {_TALL}), lambda y: s[y + 1] - 0.01::DOUBLE * (y - {_TALL // 2}) ** 2), []::BIGINT[] FROM s WHERE x = 0 UNION ALL
SELECT user_id, x, list_transform(range(0, {_TALL}), lambda y: s[y + 1] + c[y + 1].m), list_transform(c, lambda z: z.at) FROM (SELECT s.user_id, s.x, s, list_transform(range(0, {_TALL}), lambda y: list_reduce(list_transform(range(least({_TALL - 1}, y + 10), greatest(0, y - 10) - 1, -1),
lambda k: {{'m': best[k + 1] - 0.05::DOUBLE * abs(y - k), 'at': k}}), lambda a, z: CASE WHEN z.m > a.m THEN z ELSE a END)) AS c FROM b JOIN s ON s.user_id = b.user_id AND s.x = b.x + 1)),
t(user_id, x, y) AS (SELECT user_id, x, list_position(best, list_max(best))::BIGINT - 1 FROM b WHERE x = {_SPAN - 1} UNION ALL SELECT t.user_id, t.x - 1, came[t.y + 1] FROM t JOIN b ON b.user_id = t.user_id AND b.x = t.x WHERE t.x > 0),
y AS (SELECT user_id, list(y::DOUBLE ORDER BY x) AS y FROM t GROUP BY 1), z AS (SELECT user_id, {_smooth_sql('y', _SPAN, 0.8)} AS y FROM y)
SELECT user_id AS page, unnest(range(0, {_SPAN}))::INT AS x, round(unnest(y), 4) AS y FROM z""")
def sg_dp_track(spark, d):
    """The line of every user's page, by dynamic programming."""
    return tracking.ridges(_pages(spark, d, _TALL, 6), "page", "values", _TALL).withColumn("y", F.round("y", 4))


_WIDE = 31 * 12
_EXPECT = int(_WIDE * 0.94 / 4)


@query(f"""WITH {_pages_sql(40, 2)}, s AS (SELECT user_id, x, sum(v) AS s FROM p GROUP BY ALL), l AS (SELECT user_id, list(s ORDER BY x) AS s FROM s GROUP BY 1),
b AS (SELECT user_id, s, {_smooth_sql('s', _WIDE, _EXPECT / 3)} AS bg FROM l), t AS (SELECT user_id, list_transform(range(1, {_WIDE + 1}), lambda i: s[i] - bg[i]) AS s FROM b), q AS (SELECT user_id, s, list_stddev_pop(s) AS sd FROM t),
m AS (SELECT user_id, i, s[greatest(0, i * {_EXPECT} - {int(_EXPECT * 0.2)}) + 1:least({_WIDE}, i * {_EXPECT} + {int(_EXPECT * 0.2)})] AS part, sd FROM q, (SELECT unnest([1, 2, 3]) AS i)),
k AS (SELECT user_id, i, i * {_EXPECT} - {int(_EXPECT * 0.2)} + list_position(part, list_max(part)) - 1 AS mark FROM m WHERE list_max(part) > sd),
n AS (SELECT user_id, mark - lag(mark, 1, 0) OVER (PARTITION BY user_id ORDER BY i) AS step FROM k), o AS (SELECT user_id, median(step) AS step FROM n GROUP BY 1)
SELECT user_id AS page, CASE WHEN step >= 0.75 * {_EXPECT} AND step <= 1.25 * {_EXPECT} THEN floor(step)::INT ELSE {_EXPECT} END AS column_width FROM l LEFT JOIN o USING (user_id)""")
def sg_column_width(spark, d):
    """The width of a column on a user's page."""
    p = _pages(spark, d, 40, 2)
    return p.select("page", grids.column_width(F.col("values"), F.col("width"), F.lit(0), F.lit(40), 0).alias("column_width"))


@query()
def sg_lead_signals(spark, d):
    """Thirteen lines traced on the page of every event type, in millivolts: (page, lead, n, low, high)."""
    signals = tracking.lead_signals(tracking.lead_layout(_pages(spark, d, 240, 2, "event_type")))
    return signals.select("page", "lead", F.size("values").cast("long").alias("n"), F.array_min("values").alias("low"), F.array_max("values").alias("high"))


@query("""SELECT event_id, CASE WHEN abs(value) >= 65520 THEN sign(value) * 'inf'::DOUBLE WHEN value = 0 THEN 0 ELSE round_even(value / q, 0) * q END AS value FROM (
SELECT event_id, value, pow(2, greatest(floor(log2(greatest(abs(value), 1e-300))), -14) - 10)::DOUBLE AS q FROM events)""")
def sg_half_values(spark, d):
    """Values as a 16-bit float holds them."""
    return table(spark, d, "events").select("event_id", (grids.half(F.col("value")) + 0.0).alias("value"))
