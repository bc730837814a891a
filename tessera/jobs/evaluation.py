"""Metrics and signals: the first 10 components of an embedding stand for logits, all 64 for a one-dimensional signal."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.jobs.registry import query, table


def _logits(spark, d):
    z = F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double") * 10)
    return table(spark, d, "embeddings").select("vec_id", F.col("label").cast("long").alias("y"), z.alias("z"))


_Z = "WITH z AS (SELECT vec_id, label::BIGINT AS y, list_transform(embedding[1:10], lambda x: x::DOUBLE * 10) AS z FROM embeddings)"
_RANK = "1 + len(list_filter(z, lambda x: x > z[y + 1]))"
_EXP = "list_transform(z, lambda x: exp(x - list_max(z)))"


@query(f"{_Z} SELECT round(avg(CASE WHEN list_position(z, list_max(z)) - 1 = y THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg(CASE WHEN {_RANK} <= 3 THEN 1.0 ELSE 0.0 END), 6) AS top3, round(avg({_RANK}), 6) AS mean_rank, count(*) AS n FROM z")
def ev_accuracy_rank(spark, d):
    truth = F.get("z", F.col("y").cast("int"))
    rank = 1 + F.size(F.filter("z", lambda x: x > truth))
    right = F.array_position("z", F.array_max("z")) - 1 == F.col("y")
    mean = lambda c: F.round(F.avg(c.cast("double")), 6)
    return _logits(spark, d).agg(mean(right).alias("accuracy"), mean(rank <= 3).alias("top3"), mean(rank).alias("mean_rank"), F.count("*").alias("n"))


@query(f"""{_Z}, p AS (SELECT y, z, {_EXP} AS e FROM z), q AS (SELECT y, z, list_transform(e, lambda x: x / list_sum(e)) AS p FROM p)
SELECT round(avg(-ln(p[y + 1])), 6) AS cross_entropy, round(avg(list_sum(list_transform(p, lambda x, i: (x - CASE WHEN i = y + 1 THEN 1 ELSE 0 END) ** 2))), 6) AS brier FROM q""")
def ev_cross_entropy_brier(spark, d):
    p = C.softmax(F.col("z"))
    rows = _logits(spark, d).select("y", "z", p.alias("p"))
    entropy = C.log_sum_exp(F.col("z")) - F.get("z", F.col("y").cast("int"))
    brier = F.aggregate(F.transform("p", lambda x, i: F.pow(x - (i == F.col("y")).cast("double"), F.lit(2))), F.lit(0.0), lambda s, x: s + x)
    return rows.agg(F.round(F.avg(entropy), 6).alias("cross_entropy"), F.round(F.avg(brier), 6).alias("brier"))


@query(f"{_Z}, r AS (SELECT y, avg(CASE WHEN list_position(z, list_max(z)) - 1 = y THEN 1.0 ELSE 0.0 END) AS r FROM z GROUP BY y) SELECT round(avg(r), 6) AS macro_recall FROM r")
def ev_macro_recall(spark, d):
    right = (F.array_position("z", F.array_max("z")) - 1 == F.col("y")).cast("double")
    return _logits(spark, d).groupBy("y").agg(F.avg(right).alias("r")).agg(F.round(F.avg("r"), 6).alias("macro_recall"))


@query("""WITH c AS (SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality = 1 AND toxic = 0) AS fp, count(*) FILTER (quality = 0 AND toxic = 1) AS fn FROM labels)
SELECT tp, fp, fn, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 6) AS dice FROM c""")
def ev_dice_counts(spark, d):
    q, t = F.col("quality") == 1, F.col("toxic") == 1
    c = table(spark, d, "labels").agg(F.count_if(q & t).alias("tp"), F.count_if(q & ~t).alias("fp"), F.count_if(~q & t).alias("fn"))
    return c.withColumn("dice", F.round(F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)), 6))


@query("""WITH x AS (SELECT value / 100 - 2 AS z, CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END AS y FROM events),
p AS (SELECT z, y, 1 / (1 + exp(-z)) AS p FROM x) SELECT round(avg(greatest(z, 0) - z * y + ln(1 + exp(-abs(z)))), 6) AS bce, round(avg(abs(p - y)), 6) AS mae,
round(1 - (2 * sum(p * y) + 1) / (sum(p) + sum(y) + 1), 6) AS soft_dice FROM p""")
def ev_bce_mae_soft_dice(spark, d):
    x = table(spark, d, "events").select((F.col("value") / 100 - 2).alias("z"), (F.col("event_type") == "purchase").cast("double").alias("y")).withColumn("p", 1 / (1 + F.exp(-F.col("z"))))
    z, y, p = F.col("z"), F.col("y"), F.col("p")
    return x.agg(F.round(F.avg(F.greatest(z, F.lit(0.0)) - z * y + F.log1p(F.exp(-F.abs(z)))), 6).alias("bce"), F.round(F.avg(F.abs(p - y)), 6).alias("mae"), F.round(1 - (2 * F.sum(p * y) + 1) / (F.sum(p) + F.sum(y) + 1), 6).alias("soft_dice"))


_S = "WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS s FROM embeddings)"


def _signals(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("s"))


@query(f"""{_S}, j AS (SELECT vec_id, s, unnest(range(0, 100)) AS j FROM s), p AS (SELECT vec_id, j, s, j * 63 / 99.0::DOUBLE AS p FROM j)
SELECT vec_id, j::BIGINT AS sample_idx, round(s[floor(p)::BIGINT + 1] + (s[ceil(p)::BIGINT + 1] - s[floor(p)::BIGINT + 1]) * (p - floor(p)), 6) + 0.0 AS value_mv FROM p""")
def sg_resample_long(spark, d):
    return _signals(spark, d).select("vec_id", F.posexplode(C.resample(F.col("s"), 100)).alias("sample_idx", "v")).select("vec_id", F.col("sample_idx").cast("long").alias("sample_idx"), (F.round("v", 6) + 0.0).alias("value_mv"))


@query(f"{_S} SELECT vec_id, len(list_filter(range(2, 64), lambda i: s[i] >= s[i - 1] AND s[i] > s[i + 1]))::BIGINT AS n_maxima, round(list_median(s), 6) + 0.0 AS baseline FROM s")
def sg_local_maxima(spark, d):
    n = F.size("s")
    ordered = F.sort_array("s")
    mid = (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2
    return _signals(spark, d).select("vec_id", F.size(C.local_maxima(F.col("s"))).cast("long").alias("n_maxima"), (F.round(mid, 6) + 0.0).alias("baseline"))


@query(f"""WITH RECURSIVE {_S.removeprefix("WITH ")}, m AS (SELECT vec_id, unnest(list_filter(range(2, 64), lambda i: s[i] >= s[i - 1] AND s[i] > s[i + 1])) AS i, s FROM s), c AS (SELECT vec_id, i - 1 AS place, row_number() OVER (PARTITION BY vec_id ORDER BY s[i] DESC, i) AS k FROM m),
g(vec_id, k, taken) AS (SELECT DISTINCT vec_id, 0::BIGINT, []::BIGINT[] FROM c UNION ALL SELECT g.vec_id, c.k, CASE WHEN len(taken) < 4 AND len(list_filter(taken, lambda t: abs(t - place) < 8)) = 0 THEN list_append(taken, place) ELSE taken END FROM g JOIN c ON c.vec_id = g.vec_id AND c.k = g.k + 1),
l AS (SELECT vec_id, list_sort(taken) AS t FROM g QUALIFY k = max(k) OVER (PARTITION BY vec_id)) SELECT vec_id, unnest(range(0, len(t)))::INT AS i, unnest(t)::INT AS place FROM l""")
def sg_greedy_peaks(spark, d):
    return _signals(spark, d).select("vec_id", F.posexplode(C.top_peaks(F.col("s"), 4, 8)).alias("i", "place"))


@query("""WITH b AS (SELECT user_id, quantile_cont(value, 0.5) AS base, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM events GROUP BY 1)
SELECT event_id, round((base - value) / 40, 6) + 0.0 AS value_mv, round(CASE WHEN hi <= lo THEN value ELSE least(greatest((value - lo) / (hi - lo) * 255, 0), 255) END, 5) AS stretched FROM events JOIN b USING (user_id)""")
def sg_calibrate_stretch(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "value")
    b = e.groupBy("user_id").agg(F.median("value").alias("base"), F.percentile("value", F.lit(0.01)).alias("lo"), F.percentile("value", F.lit(0.99)).alias("hi"))
    v, lo, hi = F.col("value"), F.col("lo"), F.col("hi")
    inside = F.least(F.greatest(F.try_divide(v - lo, hi - lo) * 255, F.lit(0.0)), F.lit(255.0))
    return e.join(b, "user_id").select("event_id", (F.round((F.col("base") - v) / 40, 6) + 0.0).alias("value_mv"), F.round(F.when(hi <= lo, v).otherwise(inside), 5).alias("stretched"))


@query(f"""{_S}, c AS (SELECT vec_id, list_avg(s) AS m, sqrt(list_sum(list_transform(s, lambda x: (x - list_avg(s)) ** 2))) AS r, s FROM s)
SELECT vec_id, round(list_max(list_transform(s, lambda x: abs(x - m))) / r, 6) AS peak, round(ln(1 + r), 6) AS log_radius, round(exp(-r * r / 2), 6) AS gauss FROM c""")
def sg_center_radial(spark, d):
    mean = F.aggregate("s", F.lit(0.0), lambda a, x: a + x) / F.size("s")
    c = _signals(spark, d).withColumn("m", mean)
    c = c.withColumn("r", F.sqrt(F.aggregate(F.transform("s", lambda x: (x - F.col("m")) * (x - F.col("m"))), F.lit(0.0), lambda a, x: a + x)))
    peak = F.try_divide(F.array_max(F.transform("s", lambda x: F.abs(x - F.col("m")))), F.col("r"))
    return c.select("vec_id", F.round(peak, 6).alias("peak"), F.round(F.log1p("r"), 6).alias("log_radius"), F.round(F.exp(-F.col("r") * F.col("r") / 2), 6).alias("gauss"))


@query("""WITH m AS (SELECT label, first(embedding ORDER BY vec_id) AS m FROM embeddings GROUP BY 1),
x AS (SELECT vec_id, list_transform(embedding, lambda x: 1 / (1 + exp(-x::DOUBLE))) AS p, list_transform(m, lambda x: (x > 0)::INT::DOUBLE) AS y FROM embeddings JOIN m USING (label)),
s AS (SELECT vec_id, list_sum(list_transform(list_zip(p, y), lambda z: z[1] * z[2])) AS b, list_sum(p) AS p, list_sum(y) AS y FROM x)
SELECT vec_id, round(1 - (2 * b + 1) / (p + y + 1), 6) AS smooth, round(1 - (2 * b + 1e-6::DOUBLE) / (p + y + 1e-6::DOUBLE), 6) AS plain FROM s""")
def ev_soft_dice_samples(spark, d):
    """Soft Dice loss of each sample's logits against the signs of its label's first one, smoothed by 1 and by 1e-6."""
    e = table(spark, d, "embeddings")
    masks = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("m"))
    x = e.join(masks, "label").select("vec_id", F.transform("embedding", lambda z: 1 / (1 + F.exp(-z.cast("double")))).alias("p"), F.transform("m", lambda z: (z > 0).cast("double")).alias("y"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v)
    x = x.select("vec_id", C.dot(F.col("p"), F.col("y")).alias("b"), (total("p") + total("y")).alias("n"))
    loss = lambda smooth: F.round(1 - (2 * F.col("b") + smooth) / (F.col("n") + smooth), 6)
    return x.select("vec_id", loss(1.0).alias("smooth"), loss(1e-6).alias("plain"))
