"""Array files and ordered outputs: round trips, retries, corrupt files, input order."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.sources import arrays, files


def test_keyed_arrays(spark, tmp_path):
    arrays.register(spark)
    at = str(tmp_path / "out")
    rows = [(f"r{i}_II", [i + 0.1, 70000.0, None]) for i in range(20)] + [("empty", []), ("null", None)]
    df = spark.createDataFrame(rows, "key string, values array<double>").repartition(3)
    df.write.format("keyed_arrays").mode("append").save(at)
    found = {}
    for p in (tmp_path / "out").iterdir():
        assert p.name.startswith("part-") and p.suffix == ".npz"
        with np.load(p) as z:
            found |= {k: z[k] for k in z.files}
    with np.errstate(over="ignore"):
        want = {k: np.array([np.nan if x is None else x for x in v or []]).astype(np.float16) for k, v in rows}
    assert set(found) == set(want) and all(np.array_equal(found[k], want[k], equal_nan=True) and found[k].dtype == np.float16 for k in want)
    back = {r.key: r["values"] for r in spark.read.format("keyed_arrays").load("file:" + at).collect()}
    assert set(back) == set(want) and all(np.array_equal(back[k], want[k].astype(float), equal_nan=True) for k in want)
    df.limit(1).write.format("keyed_arrays").mode("overwrite").save("file://" + at)
    assert spark.read.format("keyed_arrays").load(at).count() == 1
    for bad in ([(None, [1.0])], [("a", [1.0]), ("a", [2.0])]):
        with pytest.raises(Exception, match="keyed_arrays: (a key is null|two arrays)"):
            spark.createDataFrame(bad, "key string, values array<double>").coalesce(1).write.format("keyed_arrays").mode("append").save(at)
    assert spark.read.format("keyed_arrays").load(at).count() == 1 and len(list((tmp_path / "out").iterdir())) == 1  # failures leave nothing
    with pytest.raises(Exception, match="key and values"):
        df.withColumnRenamed("key", "k").write.format("keyed_arrays").mode("append").save(at)


def test_a_retried_task_leaves_one_copy(tmp_path):
    """Two attempts of one partition have written; only the one whose message reached the driver is kept."""
    w = arrays.ArrayWriter(str(tmp_path), False)
    for attempt in (0, 1):
        np.savez(tmp_path / f".{w.id}-0-{attempt}.npz", a=np.ones(2))
        (tmp_path / f".{w.id}-0-{attempt}.npz").rename(tmp_path / f".{w.id}-0-{attempt}")
    (tmp_path / ".other-0-0").write_text("another write's")
    w.commit([arrays.Written(f"{tmp_path}/.{w.id}-0-1", 0), arrays.Written(None, 1), None])
    assert sorted(p.name for p in tmp_path.iterdir()) == sorted([".other-0-0", f"part-00000-{w.id}.npz"])
    w.abort([])
    assert len(list(tmp_path.iterdir())) == 2


def test_point_clouds(spark, tmp_path):
    arrays.register(spark)
    for label in (3, 11):
        (tmp_path / str(label)).mkdir()
        for i in range(2):
            np.savez(tmp_path / str(label) / f"b{i}.npz", indices=np.array([[0, i, 1]]), values=np.array([label], np.float32), shape=np.array([1, 2, 2]))
    (tmp_path / "3" / "bad.npz").write_bytes(b"PK no archive")
    np.savez(tmp_path / "3" / "lacks.npz", indices=np.array([[0, 0, 0]]))
    (tmp_path / "3" / "note.txt").write_text("x")
    (tmp_path / "other").mkdir()
    np.savez(tmp_path / "other" / "b.npz", indices=np.zeros((1, 3)), values=np.ones(1), shape=np.ones(3))
    got = sorted((r.label, r.file, r.indices, r["values"], r.shape) for r in spark.read.format("point_clouds").load(str(tmp_path)).collect())
    assert got == [(label, f"b{i}.npz", [[0, i, 1]], [float(label)], [1, 2, 2]) for label in (3, 11) for i in range(2)]
    with pytest.raises(Exception):  # noqa: B017
        spark.read.format("point_clouds").option("corrupt", "fail").load(str(tmp_path)).collect()


def test_dealt_by_size():
    class Info:
        def __init__(self, path, size):
            self.path, self.size = path, size

    groups = arrays._dealt([Info(f"f{i}", arrays.PART_BYTES // 2) for i in range(5)])
    assert [g.paths for g in groups] == [["f0", "f1"], ["f2", "f3"], ["f4"]] and arrays._dealt([]) == []


def test_predictions_in_input_order(spark, tmp_path):
    """Two input files, read in blocks, shuffled by a join: the output's files put end to end are in the input's order."""
    (tmp_path / "in").mkdir()
    n = 300
    for k in range(2):
        (tmp_path / "in" / f"{k}.jsonl").write_text("".join(json.dumps({"repo": f"r{k}-{i}", "prefix": "x" * 50}) + "\n" for i in range(n)))
    small = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        points = files.completion_points(spark, str(tmp_path / "in"))
        made = points.repartition(7, F.xxhash64("repo")).select("ordinal", F.col("repo").alias("context"))
        files.write_predictions(made, str(tmp_path / "out"))
        files.write_predictions(made.limit(0), str(tmp_path / "none"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", small)
    lines = [json.loads(x) for p in sorted((tmp_path / "out").glob("part-*.json")) for x in p.read_text().splitlines()]
    assert lines == [{"context": f"r{k}-{i}"} for k in range(2) for i in range(n)]
    assert spark.read.schema("context string").json(str(tmp_path / "none")).count() == 0


def test_root_that_comes_again_below(spark, tmp_path):
    root = tmp_path / "app"
    (root / "src" / "app").mkdir(parents=True)
    inner = root / "src" / str(root).strip("/")
    inner.mkdir(parents=True)
    for d in (root / "src" / "app", inner):
        (d / "main.py").write_text("x\n" * 10)
    got = {r.rel_path for r in files.repository(spark, str(root), "python").collect()}
    assert got == {"src/app/main.py", "src/" + str(root).strip("/") + "/main.py"}


def test_by_period(spark, tmp_path):
    rows = spark.createDataFrame([("d1", "train", 1.5), ("d2", "test", None), ("d3", None, 2.0)], "deviceId string, period string, t1 double")
    files.write_by_period(rows, str(tmp_path / "p"))
    assert {p.name for p in (tmp_path / "p").iterdir() if p.is_dir()} == {"period=train", "period=test", "period=__HIVE_DEFAULT_PARTITION__"}
    assert [r.deviceId for r in spark.read.option("header", True).csv(str(tmp_path / "p")).filter("period = 'test'").collect()] == ["d2"]


def test_image_lists(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("b.PNG", "a.jpeg", "note.txt", "sub/c.webp", "sub/a.jpeg"):
        (tmp_path / name).write_bytes(b"x" * len(name))
    names = lambda df: [r.name for r in df.collect()]
    assert names(files.images(spark, str(tmp_path))) == ["a.jpeg", "b.PNG"]
    assert names(files.images(spark, str(tmp_path), recursive=True)) == ["a.jpeg", "b.PNG", "a.jpeg", "c.webp"]
    assert names(files.images(spark, str(tmp_path / "*.*"))) == ["a.jpeg", "b.PNG"] and names(files.images(spark, str(tmp_path / "note.txt"))) == ["note.txt"]
    pairs = files.image_pairs(files.images(spark, str(tmp_path)), files.images(spark, str(tmp_path / "sub"))).collect()
    assert [(r.name, r.left.endswith("/a.jpeg"), r.right.endswith("/sub/a.jpeg")) for r in pairs] == [("a.jpeg", True, True)]
