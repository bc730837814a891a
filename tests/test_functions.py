"""Hand-derived values of the column functions, readers and the streaming rollup."""

import numpy as np
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.operators import tracking
from tessera.sources import files
from tessera.streaming.rollup import hourly_stream


def one(spark, **cols):
    r = spark.range(1).select(*[v.alias(k) for k, v in cols.items()]).first()
    return r.asDict(recursive=True)


def test_paths_and_lines(spark):
    p = lambda a, b: C.path_distance(F.lit(a), F.lit(b))
    got = one(spark, a=p("a/b/c.py", "a/b/d/e.py"), b=p("a/x.py", "a/y.py"), c=p("a/x.py", "a/x.py"), d=C.lines(F.lit("a\r\nb\rc\n")), e=C.lines(F.lit("")), f=C.lines(F.lit("\n")))
    assert got == {"a": 3, "b": 2, "c": 0, "d": ["a", "b", "c"], "e": [], "f": [""]}


def test_chunks_and_tokens(spark):
    text = "\n".join(f"line {i}" for i in range(31))
    got = one(spark, c=C.sliding_chunks(C.lines(F.lit(text))), **C.token_estimates(F.lit("a b c")))
    assert [(c["pos"], c["text"].count("\n") + 1) for c in got["c"]] == [(0, 30), (15, 16), (30, 1)]
    assert (got["words_int"], round(got["words_float"], 6), got["chars4"], got["chars35"]) == (3, 3.9, 1, 1)


def test_division_and_clip(spark):
    d = lambda a, b: C.ieee_divide(F.lit(a), F.lit(b))
    got = one(spark, a=d(1.0, 0.0), b=d(-1.0, 0.0), c=d(0.0, 0.0), d=d(1.0, 4.0), e=C.clip_low(F.lit(None).cast("double")), f=C.clip_low(F.lit(-2.0)))
    assert got["a"] == float("inf") and got["b"] == -float("inf") and np.isnan(got["c"]) and got["d"] == 0.25 and got["e"] is None and got["f"] == 0


def test_greedy(spark):
    item = lambda i, f, c: F.struct(F.lit(i).alias("pos"), F.lit(f).alias("file"), F.lit(float(c)).alias("cost"))
    a = F.array(item(0, "x", 5), item(1, "x", 7), item(2, "x", 3))
    b = F.array(item(0, "x", 5), item(1, "y", 4), item(2, "z", 1), item(3, "x", 3), item(4, "y", 2))
    got = one(spark, a=C.greedy_fill(a, 9, 9), b=C.greedy_fill(b, 12, 2), c=C.greedy_distinct(F.array(*[F.array(*map(F.lit, s)) for s in ("abc", "abcd", "x")])))
    assert (got["a"]["taken"], got["a"]["used"]) == ([0, 2], 8) and (got["b"]["taken"], got["b"]["used"]) == ([0, 1, 3], 12) and got["c"] == [0, 2]


def test_signals(spark):
    arr = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    got = one(spark, a=C.resample(arr(0, 10, 20), 5), b=C.resample(F.array().cast("array<double>"), 3), c=C.resample(arr(7), 2), d=C.top_peaks(arr(0, 3, 1, 5, 2, 4, 0), 2, 3), e=C.local_maxima(arr(0, 3, 1, 5, 2, 4, 0)))
    assert got == {"a": [0, 5, 10, 15, 20], "b": [0, 0, 0], "c": [7, 7], "d": [3], "e": [1, 3, 5]}
    score = np.zeros((12, 9))
    line = [3, 3, 4, 5, 5, 4, 3, 2, 2]
    score[line, range(9)] = 1
    assert tracking.track(score, 3).tolist() == line


def test_indentation(spark):
    assert one(spark, a=C.indentation(F.lit(" \tx")), b=C.indentation(F.lit("x")), c=C.indentation(F.lit("\t  y"))) == {"a": 4, "b": 0, "c": 6}


def test_wfdb_and_points(spark, tmp_path):
    (tmp_path / "r1.hea").write_text("r1 2 500 3\nr1.dat 16 1000(0)/mV 16 0 0 0 0 I\nr1.dat 16 200.0(10)/mV 16 0 0 0 0 II\n")
    (tmp_path / "r1.dat").write_bytes(np.array([[1000, 210], [0, 10], [-500, 410]], "<i2").tobytes())
    got = {(r.lead, r.sample_idx): r.value_mv for r in files.read_records(spark, str(tmp_path)).collect()}
    assert got == {("I", 0): 1.0, ("I", 1): 0.0, ("I", 2): -0.5, ("II", 0): 1.0, ("II", 1): 0.0, ("II", 2): 2.0}
    (tmp_path / "p.jsonl").write_text('{"repo": "a", "prefix": "x"}\n{"repo": "b", "modified": ["m.py"]}\n')
    assert [r.modified for r in files.completion_points(spark, str(tmp_path / "p.jsonl")).orderBy("repo").collect()] == [[], ["m.py"]]


def test_repository(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.py").write_text("x\n" * 10)
    (tmp_path / "d" / "b.py").write_text("x\n" * 9)
    (tmp_path / "d" / "c.py").write_bytes(b"\xff\n" * 20)
    assert [r.n_lines for r in files.repository(spark, str(tmp_path), "python").collect()] == [10]


def test_stream_closes_hours(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = hourly_stream(stream, "user_id", "event_type", "ts", "value").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.user_id, r.event_type, r.hour): r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = {(r.user_id, r.event_type, r.hour): r.n for r in hourly_stream(events, "user_id", "event_type", "ts", "value").collect()}
    assert got and got.items() <= batch.items()


def test_strip_and_softmax(spark):
    odd = [" a ", "\u00a0\ta\x0b", "\u3000", "", "a b", "\x1fa\u2028", "é"]
    df = spark.createDataFrame([(x,) for x in odd], "x string")
    got = [r[0] for r in df.select(C.strip(F.col("x"))).collect()]
    assert got == [r[0] for r in df.select(F.regexp_replace("x", C.STRIP, "")).collect()] and got[:5] == ["a", "a", "", "", "a b"]
    z = one(spark, s=C.softmax(F.array(*[F.lit(float(x)) for x in (1, 2, 3)])), n=C.softmax(F.lit(None).cast("array<double>")))
    e = np.exp([1, 2, 3])
    assert np.allclose(z["s"], e / e.sum()) and z["n"] is None


def test_layout(spark):
    got = one(spark, b=C.row_bounds(F.array(*map(F.lit, (100, 200, 300, 400))), F.lit(500)), a=C.px_per_mm(F.array(F.lit(250)), F.lit(None).cast("double")), l=C.px_per_mm(F.array().cast("array<int>"), F.lit(1000.0)), n=C.px_per_mm(F.array().cast("array<int>"), F.lit(None).cast("double")))
    assert [(x["y0"], x["y1"]) for x in got["b"]] == [(30, 150), (150, 250), (250, 350), (350, 470)] and (got["a"], got["l"], got["n"]) == (4.0, 4.0, 4.0)


def test_calibration_end(spark):
    flat = np.full(1000, 100.0)
    pulse = flat.copy()
    pulse[10:30] = 60  # 20 pixels wide, 40 high, at 4 pixels a millimetre
    assert (tracking.calibration_end(flat, 4.0), tracking.calibration_end(pulse, 4.0), tracking.calibration_end(pulse[:15], 4.0)) == (0, 36, 0)
    df = spark.createDataFrame([(1, pulse.tolist(), 4.0), (2, None, 4.0)], "k bigint, y array<double>, s double")
    assert sorted(map(tuple, tracking.calibration_ends(df, "k", "y", "s").collect())) == [(1, 36), (2, 0)]


def test_repository_and_recents(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "pkg" / "a.py").write_text("x\n" * 12)
    (tmp_path / "b.py").write_text("x\n" * 3)
    (tmp_path / "c.py").write_bytes(b"\xff\n" * 12)
    got = files.repository(spark, str(tmp_path), "python")
    assert [(r.rel_path, r.n_lines) for r in got.collect()] == [("pkg/a.py", 12)]
    repo = got.select(F.lit("r").alias("repo"), F.lit(1).alias("f"), F.col("rel_path").alias("path"), "n_lines")
    points = spark.createDataFrame([(0, "r", ["b.py", "pkg/a.py", "gone.py"]), (1, "other", ["pkg/a.py"]), (2, "r", None)], "q bigint, repo string, modified array<string>")
    assert [tuple(r) for r in files.recent_files(points, repo).collect()] == [(0, 1, "pkg/a.py", 1)]


def test_writers_and_annotations(spark, tmp_path):
    df = spark.createDataFrame([("r", "I", [0.5, 1.5])], "record string, lead string, values array<double>")
    files.write_signals(df, str(tmp_path / "long"))
    assert sorted((r.sample_idx, r.value_mv) for r in spark.read.option("header", True).csv(str(tmp_path / "long")).collect()) == [("0", "0.5"), ("1", "1.5")]
    files.write_submission(df.select("record"), str(tmp_path / "sub"))
    assert spark.read.parquet(str(tmp_path / "sub/parquet")).count() == spark.read.option("header", True).csv(str(tmp_path / "sub/csv")).count() == 1
    for _ in range(2):
        files.append_metrics(spark.range(1).withColumnRenamed("id", "epoch"), str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == 2
    (tmp_path / "x.json").write_text('{"leads": [{"lead_name": "I", "plotted_pixels": [[1, 2], [3, 4.5]]}],\n "other": 1}')
    assert sorted(map(tuple, files.annotations(spark, str(tmp_path / "x.json")).collect())) == [("x.json", "I", 0, 1.0, 2.0), ("x.json", "I", 1, 3.0, 4.5)]


def test_telemetry_csv(spark, tmp_path):
    names = "deviceId,period,timedate,deviceType," + ",".join(f"t{i}" for i in range(1, 14)) + ",x1,x2,x3"
    (tmp_path / "d.csv").write_text(f"{names}\nd1,train,2024-03-01 05:55:00 UTC,7," + ",".join(["1.5"] * 12 + ["NaN"]) + ",1,2,3\n")
    r = files.telemetry(spark, str(tmp_path / "d.csv")).first()
    assert str(r.ts) == "2024-03-01 05:55:00" and r.t12 == 1.5 and r.t13 is None and r.x3 == 3.0
    from tessera.operators import rollup

    e = rollup.calendar(rollup.engineered(files.telemetry(spark, str(tmp_path / "d.csv")).withColumn("t1_max", F.lit(0.5)), inverse=True), "ts")
    assert rollup.matching(e, r"t\d+") == [f"t{i}" for i in range(1, 14)] and "x2" not in rollup.feature_columns(e) and "a3" in rollup.feature_columns(e)
    got = e.first()
    assert (got.a1, got.a2, got.a5, got.b3, got.a3, got.month) == (2.25, 1.0, None, 1.5, 1.0, 3)
