"""Faults of the third review: nearest imports without files times imports, rounding as the SQL rounds, pairs of files without dealing out
those that frequent lines make."""

import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.jobs import catalog
from tessera.operators import retrieval


def test_nearest_import(spark):
    """Against the distance to every import; paths share parts, hold backslashes, begin with a slash or are a directory of others."""
    rnd = random.Random(5)
    some = lambda n: {rnd.choice(["", "/"]) + rnd.choice(["/", "\\"]).join(rnd.choice("abc") for _ in range(rnd.randint(1, 4))) for _ in range(n)}
    pairs = [(q, f"{q}-{i}", p) for q in range(4) for i, p in enumerate(sorted(some(60)))]
    imports = [(q, p) for q in (0, 1, 3) for p in sorted(some(3 * q + 1))] + [(1, None)]
    pair, known = spark.createDataFrame(pairs, "q int, f string, path string"), spark.createDataFrame(imports, "q int, path string")
    got = {(r.q, r.path): (r.is_import, r._near) for r in retrieval.nearest_import(pair, known).collect()}
    refs = known.groupBy("q").agg(F.collect_set("path").alias("refs"))
    plain = pair.join(refs, "q", "left").select("q", "path", F.coalesce(F.array_contains("refs", F.col("path")), F.lit(False)), F.array_min(F.transform("refs", lambda r: C.path_distance(F.col("path"), r))))
    assert got == {(q, path): (own, near) for q, path, own, near in plain.collect()} and len(got) == len(pairs)


def test_files_do_not_meet_every_import(spark):
    """No row of a file carries a list of its repository's imports."""
    points = spark.createDataFrame([(1, "r", "a/x.py", "t")], "q long, repo string, path string, text string")
    files = spark.createDataFrame([(1, "r", "a/x.py", "t"), (2, "r", "a/y.py", "t")], "f long, repo string, path string, text string")
    signals = retrieval.file_signals(points, files, points.select("q", F.lit(2).alias("f")), files.filter("f = 2").select(F.lit(1).alias("q"), "path"))
    assert "collect_set" not in signals._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.f, r.is_import, r.ref_dist, r.dist) for r in signals.collect()] == [(2, True, 0, 2)]


def test_engineered_features_round_as_their_sql(spark, tmp_path):
    """On finer prices and quantities than the given ones, where products meet a half."""
    rnd, n = np.random.default_rng(1), 100_000
    rows = pd.DataFrame({"l_orderkey": np.arange(n), "l_linenumber": 1, "l_quantity": rnd.integers(100, 5000, n) / 100, "l_tax": rnd.integers(0, 200, n) / 1000, "l_discount": rnd.integers(0, 1000, n) / 10000, "l_extendedprice": rnd.integers(10**6, 10**9, n) / 10000})
    rows.to_parquet(tmp_path / "lineitem.parquet")
    got = catalog.QUERIES["ts_engineered_features"](spark, str(tmp_path)).toPandas().sort_values("l_orderkey").reset_index(drop=True)
    lineitem = rows  # noqa: F841  read by DuckDB
    want = duckdb.sql(catalog.ORACLE_SQL["ts_engineered_features"]).df().sort_values("l_orderkey").reset_index(drop=True)
    assert {c: int((got[c] != want[c]).sum()) for c in want.columns} == dict.fromkeys(want.columns, 0)
    edge = [0.0, -2.5, 2.5, 0.49999999999999994, 1e308, -1e308, float("inf"), float("nan"), None]
    made = spark.createDataFrame([(x,) for x in edge], "x double").select(C.round_scaled(F.col("x"), 0), C.round_scaled(F.col("x"), 3)).collect()
    assert [r[0] for r in made[:4]] == [0, -3, 3, 0] and [r[1] for r in made[4:7]] == edge[4:7] and np.isnan(made[7][1]) and made[8][1] is None


@pytest.mark.parametrize(("heavy", "tile"), [(64, 1000), (3, 4), (1, 1)])
def test_shared_lines(spark, heavy, tile):
    """Against all pairs: frequent and rare lines, copies, files of one line, without long lines, null; nothing comes up twice."""
    rnd = random.Random(3)
    pick = lambda: [f"frequent line {int(rnd.expovariate(0.5))}" for _ in range(rnd.randint(0, 3))] + [f"a rarer line {rnd.randint(0, 60)}" for _ in range(rnd.randint(0, 4))]
    texts = [(i * 7 - 90, "\n".join(pick())) for i in range(80)]
    texts += [(1000 + i, t) for i, (_, t) in enumerate(texts[:15])] + [(2000, None), (2001, ""), (2002, "short\nlines"), (2003, "a line of its own"), (2004, "\n".join(["frequent line 0"] * 3))]
    sets = {i: {x for x in (t or "").split("\n") if len(x) >= 10} for i, t in texts}
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b and sets[a] & sets[b]}
    got = retrieval.shared_lines(spark.createDataFrame(texts, "id bigint, text string"), heavy=heavy, tile=tile).collect()
    assert {(r.a, r.b): pytest.approx(r.iou) for r in got} == want and len(got) == len(want) > 500


def shuffled(df):
    """The rows that the exchanges of a query wrote."""
    df.collect()
    nodes, n = [df._jdf.queryExecution().executedPlan()], 0
    for node in nodes:
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec" or kind.endswith("QueryStageExec"):
            nodes.append(node.executedPlan() if kind == "AdaptiveSparkPlanExec" else node.plan())
            continue
        written = node.metrics().get("shuffleRecordsWritten")
        n += written.get().value() if written.isDefined() else 0
        nodes.extend(node.children().apply(i) for i in range(node.children().size()))
    return n


def test_pairs_of_a_frequent_line_are_not_dealt_out(spark):
    """300 files that share two lines make 44,850 pairs; the files are dealt out, the pairs aren't."""
    files = spark.range(300).select("id", F.concat(F.lit("the line of all\nline number two of all\nline of file "), F.col("id")).alias("text"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as large tables are joined
    try:
        found = retrieval.shared_lines(files).groupBy("iou").count()
        dealt = shuffled(found)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert [(round(r.iou, 9), r["count"]) for r in found.collect()] == [(0.5, 44_850)]
    assert dealt < 3000


def test_files_of_a_frequent_line_are_no_candidates(spark):
    """300 files of an own line and a common one share a third: none of their 44,850 pairs leaves the join, and texts are read once."""
    files = spark.range(300).select("id", F.concat(F.lit("the line of all\nline of file "), F.col("id")).alias("text"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        members, pairs = retrieval.similar_files(files, 0.5)
        assert shuffled(pairs) < 5000 and pairs.count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert all("split(" not in x._jdf.queryExecution().optimizedPlan().toString() for x in (members, pairs))


@pytest.mark.parametrize("limit", [0.3, 0.5, 0.8])
def test_similar_files_with_frequent_lines(spark, limit):
    """Against all pairs, where most files hold some of a few frequent lines, before or behind their own."""
    rnd = random.Random(11)
    sets = {i: frozenset([f"frequent line {int(rnd.expovariate(0.7))}" for _ in range(rnd.randint(1, 4))] + [f"a rarer line {rnd.randint(0, 40)}" for _ in range(rnd.randint(0, 3))]) for i in range(120)}
    members, pairs = retrieval.similar_files(spark.createDataFrame([(i, "\n".join(x)) for i, x in sets.items()], "id bigint, text string"), limit)
    rep = {i: min(j for j in sets if sets[j] == sets[i]) for i in sets}
    assert {r.f: r.rep for r in members.collect()} == rep
    own = sorted(set(rep.values()))
    want = {(a, b): iou for a in own for b in own if a < b and (iou := len(sets[a] & sets[b]) / len(sets[a] | sets[b])) >= limit}
    got = pairs.collect()
    assert {(r.a, r.b): pytest.approx(r.iou) for r in got} == want and len(got) == len(want) > 1
