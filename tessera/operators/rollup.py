"""Telemetry: hourly rollup, profiles, monthly means, splits and correlations."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import columns as C


def hourly(events: DataFrame, keys: Sequence[str], ts: str, order: Sequence[str], mean: Mapping[str, str] = {}, least: Mapping[str, str] = {}, greatest: Mapping[str, str] = {}, first: Mapping[str, str] = {}) -> DataFrame:
    """One row per key and hour: n, and by output name the mean, least, greatest and first (in this order) of any number of columns. A first
    value may be null."""
    hour = F.date_trunc("hour", F.col(ts)).cast("timestamp_ntz")
    kinds = ((mean, F.avg), (least, F.min), (greatest, F.max), (first, lambda c: F.min_by(c, F.struct(*order))))
    return events.groupBy(*keys, hour.alias("hour")).agg(F.count("*").alias("n"), *[f(c).alias(out) for names, f in kinds for out, c in names.items()])


def engineered(rows: DataFrame, inverse: bool = False) -> DataFrame:
    """Adds products, sums, differences and the ratio of the readings t3..t13, t1_max and x3; a division by zero gives an infinity or NaN, as
    floating point does. inverse adds the ratio the other way round."""
    t = {i: F.col(f"t{i}").cast("double") for i in (3, 4, 5, 6, 8, 10, 11, 13)}
    made = {"a1": t[4] * t[8], "a2": C.ieee_divide(t[4], t[8]), "a4": t[4] + t[8], "a5": t[4] * t[13], "b1": t[5] - t[3], "b2": t[6] - t[4], "b3": F.col("x3") * (1 - F.col("t1_max")), "c1": t[3] - t[4], "c2": t[5] - t[6], "c3": t[10] - t[11]}
    return rows.withColumns(made | ({"a3": C.ieee_divide(t[8], t[4])} if inverse else {}))


def calendar(rows: DataFrame, ts: str) -> DataFrame:
    """Adds year, month, month_cos and hour_sin."""
    return rows.withColumns({"year": F.year(ts), "month": F.month(ts), "month_cos": C.cyclic(F.month(ts), 12), "hour_sin": C.cyclic(F.hour(ts), 24, 5, F.sin)})


def feature_columns(rows: DataFrame, apart: Sequence[str] = ("x2", "deviceId", "year", "month", "timedate", "hour", "period")) -> list[str]:
    """The columns a model is fitted on, in order: all but the target, the keys and the raw times."""
    return [c for c in rows.columns if c not in apart]


def matching(rows: DataFrame, pattern: str) -> list[str]:
    """Columns whose whole name fits a pattern, as t\\d+ fits t1 but neither t1_min nor timedate."""
    return [c for c in rows.columns if re.fullmatch(pattern, c)]


def monthly_mean(rows: DataFrame, device: str, ts: str, value: str) -> DataFrame:
    """Mean of values clipped at 0 by device, year and month; rows with a null key are left out."""
    keyed = rows.filter(F.col(device).isNotNull() & F.col(ts).isNotNull())
    return keyed.groupBy(device, F.year(ts).cast("long").alias("year"), F.month(ts).cast("long").alias("month")).agg(F.avg(C.clip_low(F.col(value))).alias("prediction"))


def positional_split(rows: DataFrame, order: Sequence[str], share: float = 0.8) -> DataFrame:
    """Adds in_train: whether a row is among the first share of all rows in this order.

    Rows are range-partitioned by the order; partitions are numbered and only their sizes are summed up, so no single task
    sees all rows, as a window without a partition would.
    """
    keys = [F.col(c) for c in order]
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # Ids count up within each sorted range: the partition in the high bits, the row in the low 33.
    dealt = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    part, row = F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = dealt.groupBy(part).agg(F.count("*").alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col("_part").alias("_of"), F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"), F.sum("_size").over(Window.partitionBy(F.lit(1))).alias("_all"))
    numbered = dealt.join(F.broadcast(offsets), F.shiftright("_at", 33) == F.col("_of"))
    return numbered.withColumn("in_train", row + 1 + F.col("_before") <= F.floor(F.lit(share) * F.col("_all"))).drop("_at", "_of", "_before", "_all")


def correlations(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """(a, b, r) for all pairs in one aggregation; null where a column is constant."""
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    sums = rows.agg(*[F.struct(F.covar_pop(a, b).alias("c"), (F.stddev_pop(a) * F.stddev_pop(b)).alias("s")).alias(f"{a}|{b}") for a, b in pairs])
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.try_divide(F.col(f"`{a}|{b}`.c"), F.col(f"`{a}|{b}`.s")).alias("r")) for a, b in pairs])
    return sums.select(F.explode(cells).alias("x")).select("x.a", "x.b", "x.r")
