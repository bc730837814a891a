"""Faults of the fourth review: features by null divisors and zeros below nothing, rows dealt out for a line that many files share."""

import itertools
import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from test_findings_r03 import shuffled

from tessera.jobs import catalog
from tessera.operators import retrieval

ODD = [None, float("nan"), float("inf"), 0.0, -0.0, -1e-7, 4e-8, 0.0005, 2.5, 17.0, 1e300, -1e300]


@pytest.mark.parametrize(("name", "odd"), [("ts_engineered_features", ODD), ("ts_ratio_features", [None, 0.0, 0.07, 2.5, 17.0])])
def test_features_of_odd_readings(spark, tmp_path, name, odd):
    """Against the SQL, value by value, the sign of a zero included, that of NaN not."""
    rows = list(itertools.product(odd, odd, [None, 0.0, -0.0, 0.06], [None, 0.0, 1234.56, -0.00004]))
    columns = dict(zip(("l_quantity", "l_tax", "l_discount", "l_extendedprice"), zip(*rows)))
    keys = {"l_orderkey": pa.array(range(len(rows)), pa.int64()), "l_linenumber": pa.array([1] * len(rows), pa.int32())}
    pq.write_table(pa.table(keys | {c: pa.array(x, pa.float64(), from_pandas=False) for c, x in columns.items()}), tmp_path / "lineitem.parquet")
    catalog.QUERIES[name](spark, str(tmp_path)).write.parquet(str(tmp_path / "got"))
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet'")
    told = lambda rows: sorted(tuple(str(v).replace("-nan", "nan") for v in r) for r in rows.fetchall())
    got, want = told(con.sql(f"select * from '{tmp_path}/got/*.parquet'")), told(con.sql(catalog.ORACLE_SQL[name]))
    assert got == want and len(got) > 100


@pytest.fixture()
def large(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as large tables are joined
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rows_dealt_out_grow_as_the_files(spark, large):
    """Twice the files of one line make four times the pairs, but no more than twice the rows dealt out, however small the blocks."""
    dealt = []
    for n in (1500, 3000):
        files = spark.range(n).select("id", F.concat(F.lit("the line of all\nline of file "), F.col("id")).alias("text"))
        found = retrieval.shared_lines(files, tile=10).groupBy("iou").count()
        dealt.append(shuffled(found))
        assert [(round(r.iou, 9), r["count"]) for r in found.collect()] == [(round(1 / 3, 9), n * (n - 1) // 2)]
    assert dealt[1] < 2.2 * dealt[0] < 30_000


def test_copies_meet_once(spark, large):
    """Copies share all their lines, but meet at their set of lines alone."""
    files = spark.range(400).select("id", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: F.concat(F.lit("line of a pair "), F.col("id") % 200, F.lit("-"), i)), "\n").alias("text"))
    found = retrieval.shared_lines(files)
    assert shuffled(found) < 2000
    assert {(r.b - r.a, r.iou) for r in found.collect()} == {(200, 1.0)} and found.count() == 200


@pytest.mark.parametrize(("heavy", "tile"), [(64, 4000), (8, 20), (1, 3)])
def test_shared_lines_of_lists(spark, heavy, tile):
    """Against all pairs: lists longer than a row, copies more and less frequent than ``heavy``, rare lines shared besides frequent ones."""
    rnd = random.Random(17)
    texts = {i: [f"frequent line {k}" for k in range(3) if rnd.random() < 0.3] + [f"a rarer line {rnd.randint(0, 90)}" for _ in range(rnd.randint(0, 3))] for i in range(240)}
    texts |= {1000 + i: texts[i % 5] for i in range(30)} | {2000 + i: ["a line of copies alone", "and another of them"] for i in range(80)} | {3000 + i: [f"of two only {i // 2}", "frequent line 0"] for i in range(20)}
    sets = {i: frozenset(x) for i, x in texts.items()}
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b and sets[a] & sets[b]}
    got = retrieval.shared_lines(spark.createDataFrame([(i, "\n".join(x)) for i, x in texts.items()], "id bigint, text string"), heavy=heavy, tile=tile).collect()
    assert {(r.a, r.b): pytest.approx(r.iou) for r in got} == want and len(got) == len(want) > 10_000
