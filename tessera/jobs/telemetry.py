"""Telemetry queries: events stand for device readings (user_id: device, event_type: period)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.jobs.registry import query, table
from tessera.operators import forecast, rollup


@query("""SELECT user_id, event_type, date_trunc('hour', ts)::TIMESTAMP AS hour, round(avg(value), 6) AS mean_value, min(value) AS min_value,
max(value) AS max_value, count(*) AS n, first(props ORDER BY ts, event_id) AS first_props FROM events GROUP BY ALL""")
def ts_hourly_rollup(spark, d):
    of = {"mean": {"mean_value": "value"}, "least": {"min_value": "value"}, "greatest": {"max_value": "value"}, "first": {"first_props": "props"}}
    r = rollup.hourly(table(spark, d, "events"), ["user_id", "event_type"], "ts", ["ts", "event_id"], **of)
    return r.withColumn("mean_value", F.round("mean_value", 6))


@query("""SELECT l_suppkey, l_returnflag, date_trunc('hour', l_shipdate)::TIMESTAMP AS hour, count(*) AS n, round(avg(l_quantity), 6) AS quantity, round(avg(l_discount), 6) AS discount, round(avg(l_tax), 6) AS tax,
min(l_quantity) AS quantity_min, max(l_quantity) AS quantity_max, first(l_extendedprice ORDER BY l_orderkey, l_linenumber) AS price, first(l_linestatus ORDER BY l_orderkey, l_linenumber) AS status FROM lineitem GROUP BY ALL""")
def ts_hourly_rollup_wide(spark, d):
    """Several measures and first values by key and hour, as the telemetry's rollup has 13 and 5."""
    of = {"mean": {x: f"l_{x}" for x in ("quantity", "discount", "tax")}, "least": {"quantity_min": "l_quantity"}, "greatest": {"quantity_max": "l_quantity"}, "first": {"price": "l_extendedprice", "status": "l_linestatus"}}
    r = rollup.hourly(table(spark, d, "lineitem"), ["l_suppkey", "l_returnflag"], "l_shipdate", ["l_orderkey", "l_linenumber"], **of)
    return r.withColumns({x: F.round(x, 6) for x in ("quantity", "discount", "tax")})


@query("""SELECT l_orderkey, l_linenumber, round(l_quantity * l_tax, 6) AS a1, CASE WHEN l_tax = 0 THEN 'inf'::DOUBLE ELSE round(l_quantity / l_tax, 3) END AS a2, round(l_quantity + l_tax, 6) AS a4, round(l_quantity * l_discount, 6) AS a5,
round(l_extendedprice - l_discount, 4) AS b1, round(l_tax - l_quantity, 6) AS b2, round(l_extendedprice * (1 - l_discount), 4) AS b3, round(l_discount - l_quantity, 6) AS c1, round(l_extendedprice - l_tax, 4) AS c2, round(l_quantity - l_extendedprice, 4) AS c3 FROM lineitem WHERE l_quantity > 0""")
def ts_engineered_features(spark, d):
    """All engineered features, line items standing for readings."""
    of = {"t3": "l_discount", "t4": "l_quantity", "t5": "l_extendedprice", "t6": "l_tax", "t8": "l_tax", "t10": "l_quantity", "t11": "l_extendedprice", "t13": "l_discount", "t1_max": "l_discount", "x3": "l_extendedprice"}
    rows = table(spark, d, "lineitem").filter("l_quantity > 0").select("l_orderkey", "l_linenumber", *[F.col(c).alias(n) for n, c in of.items()])
    digits = {"a1": 6, "a2": 3, "a4": 6, "a5": 6, "b1": 4, "b2": 6, "b3": 4, "c1": 6, "c2": 4, "c3": 4}
    return rollup.engineered(rows).select("l_orderkey", "l_linenumber", *[C.round_scaled(F.col(c), n).alias(c) for c, n in digits.items()])


@query("SELECT hour(ts)::BIGINT AS hour, round(avg(value), 6) AS mean_value FROM events GROUP BY 1")
def ts_hour_profile(spark, d):
    return table(spark, d, "events").groupBy(F.hour("ts").cast("long").alias("hour")).agg(F.round(F.avg("value"), 6).alias("mean_value"))


@query("SELECT user_id, count(*) AS n FROM events GROUP BY 1")
def ts_value_counts(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id")


@query("""WITH b AS (SELECT min(value) lo, max(value) hi FROM events)
SELECT least(floor((value - lo) / ((hi - lo) / 30.0)), 29)::BIGINT AS bin, count(*) AS n FROM events, b GROUP BY 1""")
def ts_histogram30(spark, d):
    e = table(spark, d, "events").select("value")
    b = e.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    bins = F.least(F.floor((F.col("value") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / 30.0)), F.lit(29)).cast("long")
    return e.join(F.broadcast(b)).groupBy(bins.alias("bin")).agg(F.count("*").alias("n"))


@query("""SELECT user_id, year(ts)::BIGINT AS year, month(ts)::BIGINT AS month, round(avg(greatest(value - 200, 0)), 6) AS prediction
FROM events GROUP BY ALL""")
def ts_monthly_clip_mean(spark, d):
    e = table(spark, d, "events").withColumn("value", F.col("value") - 200)
    return rollup.monthly_mean(e, "user_id", "ts", "value").withColumn("prediction", F.round("prediction", 6))


@query("""SELECT event_id, year(ts)::BIGINT AS year, month(ts)::BIGINT AS month, hour(ts)::BIGINT AS hour, round(cos(2 * pi() * month(ts) / 12), 9) + 0.0 AS month_cos,
round(sin(2 * pi() * (hour(ts) + 5) / 24), 9) + 0.0 AS hour_sin FROM events""")
def ts_cyclic_features(spark, d):
    e = table(spark, d, "events")
    parts = [f(F.col("ts")).cast("long").alias(n) for f, n in ((F.year, "year"), (F.month, "month"), (F.hour, "hour"))]
    return e.select("event_id", *parts, (F.round(C.cyclic(F.month("ts"), 12), 9) + 0.0).alias("month_cos"), (F.round(C.cyclic(F.hour("ts"), 24, 5, F.sin), 9) + 0.0).alias("hour_sin"))


@query("""SELECT l_orderkey, l_linenumber, round(l_quantity * l_discount, 6) AS a1, CASE WHEN l_tax = 0 THEN (CASE WHEN l_quantity > 0 THEN 'inf' ELSE 'nan' END)
ELSE CAST(floor(l_quantity / l_tax + 0.000001::DOUBLE)::BIGINT AS VARCHAR) END AS a2, round(l_quantity + l_discount, 6) AS a4, round(l_tax - l_discount, 6) AS b1, round(l_extendedprice * (1 - l_discount), 4) AS b3 FROM lineitem""")
def ts_ratio_features(spark, d):
    q, t, s, p = (F.col(c) for c in ("l_quantity", "l_tax", "l_discount", "l_extendedprice"))
    ratio = C.ieee_divide(q, t)
    text = F.when(t == 0, F.when(q > 0, "inf").otherwise("nan")).otherwise(F.floor(ratio + 0.000001).cast("string"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", C.round_scaled(q * s, 6).alias("a1"), text.alias("a2"), C.round_scaled(q + s, 6).alias("a4"), C.round_scaled(t - s, 6).alias("b1"), C.round_scaled(p * (1 - s), 4).alias("b3"))


@query("""SELECT l_returnflag, round(avg(l_discount), 6) AS mean_l_discount, round(avg(l_extendedprice), 4) AS mean_l_extendedprice, round(avg(l_quantity), 6) AS mean_l_quantity,
round(avg(l_tax), 6) AS mean_l_tax FROM lineitem GROUP BY 1""")
def ts_regex_select_mean(spark, d):
    rows = table(spark, d, "lineitem")
    names = sorted(rollup.matching(rows, r"l_(quantity|extendedprice|discount|tax)"))
    return rows.groupBy("l_returnflag").agg(*[F.round(F.avg(c), 4 if "price" in c else 6).alias(f"mean_{c}") for c in names])


@query("SELECT e.event_id, e.user_id, c.c_mktsegment AS segment, c.c_nationkey::BIGINT AS nation FROM events e LEFT JOIN customer c ON e.user_id = c.c_custkey")
def ts_device_left_join(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").cast("long").alias("nation"))
    return table(spark, d, "events").select("event_id", "user_id").join(c, "user_id", "left")


@query("SELECT event_id, user_id, event_type, value FROM events WHERE event_type = 'view' UNION ALL SELECT event_id, user_id, event_type, value FROM events WHERE event_type = 'purchase'")
def ts_union_valid_test(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    return e.filter("event_type = 'view'").unionByName(e.filter("event_type = 'purchase'"))


_CORR = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for i, a in enumerate(_CORR) for b in _CORR[i:]))
def ts_corr_matrix(spark, d):
    return rollup.correlations(table(spark, d, "lineitem"), _CORR).withColumn("r", F.round("r", 6))


@query("""SELECT event_id, row_number() OVER (ORDER BY user_id, ts, event_id) <= floor(0.8 * count(*) OVER ()) AS in_train FROM events""")
def ts_positional_split(spark, d):
    return rollup.positional_split(table(spark, d, "events").select("user_id", "ts", "event_id"), ["user_id", "ts", "event_id"]).select("event_id", "in_train")


@query("""SELECT o_custkey, round(quantile_cont(o_totalprice, 0.5), 4) AS median_price, round(stddev_pop(o_totalprice), 4) AS spread,
round(quantile_cont(o_totalprice, 0.01), 4) AS p1, round(quantile_cont(o_totalprice, 0.99), 4) AS p99 FROM orders GROUP BY 1""")
def ts_robust_summary(spark, d):
    p = lambda q, n: F.round(F.percentile("o_totalprice", F.lit(q)), 4).alias(n)
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.round(F.median("o_totalprice"), 4).alias("median_price"), F.round(F.stddev_pop("o_totalprice"), 4).alias("spread"), p(0.01, "p1"), p(0.99, "p99"))


@query("""SELECT user_id, event_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS step FROM events""")
def ts_adjacent_differences(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("user_id", "event_id", F.round(F.col("value") - F.lag("value").over(w), 6).alias("step"))


def _forecast_rows(spark, d):
    return rollup.calendar(table(spark, d, "events").select("event_id", "user_id", "ts", "value"), "ts").withColumn("day", F.dayofweek("ts"))


@query()
def ml_gbt_forecast_monthly(spark, d):
    """Gradient-boosted trees on calendar features, then the clipped monthly mean per device."""
    rows = _forecast_rows(spark, d)
    model = forecast.fit(rows, ["month_cos", "hour_sin", "day"], "value", rounds=10)
    return rollup.monthly_mean(forecast.predict(model, rows).select("user_id", "ts", F.col("prediction").alias("value")), "user_id", "ts", "value")


@query()
def ml_gbt_holdout_mae(spark, d):
    """The last fifth of each device's readings is held out: it ends the boosting early and gives the error."""
    rows = _forecast_rows(spark, d)
    split = rollup.positional_split(rows, ["user_id", "ts", "event_id"])
    model = forecast.fit(split, ["month_cos", "hour_sin", "day"], "value", rounds=20, held_out=~F.col("in_train"))
    return forecast.mean_error(model, split.filter("not in_train"), "value")


@query("""SELECT event_id, row_number() OVER (ORDER BY md5(event_id::VARCHAR || '-42'), event_id) <= floor(0.85 * count(*) OVER ()) AS in_train FROM events""")
def ml_exact_random_split(spark, d):
    e = table(spark, d, "events").select("event_id", F.md5(F.concat(F.col("event_id").cast("string"), F.lit("-42"))).alias("h"))
    return rollup.positional_split(e, ["h", "event_id"], 0.85).select("event_id", "in_train")
