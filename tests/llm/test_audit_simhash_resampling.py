"""Filter audit, SimHash and resampling against brute force: nulls, ties, copies, empty tables, clashing columns, hot anchors."""

import hashlib
import math
import random
import re
from itertools import permutations
from zlib import crc32

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import filter_audit, queries, resampling, simhash

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, mask string, part string, fp string, pos string, bucket int"
LABELS = "doc_id bigint, quality int, toxic int, good string"
ODD = [None, "", " \t\n", "a", "A b C d", "a b c d", "word " * 60, " ".join(f"w{i}" for i in range(60)), " ".join(f"W{i}" for i in range(60)), "é ü z q [x] {y} C9-z", "x|y " + " ".join(f"w{i}" for i in range(60)), "k" * 20000, "w1 w2 " * 3000]


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, None, s, 0, "m", "p", "f", "o", 1) for i, t, s in rows], DOCS)


def odd_rows():
    rows = [(i, t, f"s{i % 2}") for i, t in enumerate(ODD)]
    rows += [(50 + i, t, None if i % 3 else "") for i, t in enumerate(ODD)]  # copies under larger ids
    rows += [(None, ODD[7], "s0"), (None, ODD[7], "s0"), (7, ODD[7], "s1"), (57, ODD[7], "s1"), (3, ODD[10], None)]  # null and repeated ids
    return rows


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def audited(rows, labels):
    good, toxic = {i for i, q, _, _ in labels if q == 1}, {i for i, _, t, _ in labels if t == 1}
    failed = []
    for i, t, s in rows:
        t = t or ""
        w = WORD.findall(t)
        f = {x for x, bad in zip("ABCD", (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), re.search("[#$%&*|]", t)), strict=True) if bad}
        if i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows):
            f.add("E")
        failed.append((s or "", f, i is not None and i in good, i is not None and i in toxic))
    out = {}
    for part in {p for p, *_ in failed}:
        own = [x[1:] for x in failed if x[0] == part]
        removals = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, x in enumerate(order, 1):
                gone = [d for d in left if x in d[0]]
                left = [d for d in left if x not in d[0]]
                removals[x] += len(gone)
                out[part, order, step] = [len(left), len(gone), sum(x in d[0] for d in own) - len(gone), sum(d[0] == {x} for d in own), sum(d[1] for d in gone), sum(d[2] for d in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(removals[order[step - 1]])
    return out


def test_audit(spark):
    labels = [(7, 1, 0, "g"), (7, 0, 1, "g"), (None, 1, 1, "g"), (57, None, 1, "g"), (10, 1, None, "g"), (3, 1, 1, "g")]
    got = filter_audit.audit(docs_of(spark, odd_rows()), spark.createDataFrame(labels, LABELS))
    found = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in got.collect()}
    assert found == audited(odd_rows(), labels) and len(found) == 3 * 600
    assert all(kind == "bigint" for c, kind in got.dtypes if c not in ("part", "filter_order", "step"))
    assert filter_audit.audit(docs_of(spark, []), spark.createDataFrame([], LABELS)).count() == 0


def test_potential_is_the_shapley_value(spark):
    """On a random game, against the mean of the marginal worths over all orders."""
    rnd = random.Random(5)
    worth = [0] + [rnd.randrange(1000) for _ in range(31)]
    p = spark.range(1).select(filter_audit.potentials(F.array(*[F.lit(x).cast("long") for x in worth])).alias("p")).first().p
    for i in range(5):
        marginal = [worth[sum(1 << j for j in o[: o.index(i) + 1])] - worth[sum(1 << j for j in o[: o.index(i)])] for o in permutations(range(5))]
        assert p[31] - p[31 - (1 << i)] == sum(marginal)


@pytest.mark.parametrize("name", ["op11_potential_audit", "op13_radix_resampling"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr) != []


def simhash_of(text):
    from xxhash import xxh64_intdigest

    w = WORD.findall(lower(text))
    h = [xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(rows):
    """{row number: (fingerprint, component)} by comparing all pairs."""
    prints = [simhash_of(t) for _, t in rows]
    names = np.arange(len(rows))
    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 4 and names[i] != names[j]:
                names[names == names[i]] = names[j]
    least = {k: min((i for (i, _), n in zip(rows, names, strict=True) if n == k and i is not None), default=None) for k in set(names)}
    return [(i, f"{f:016x}", least[k]) for (i, _), f, k in zip(rows, prints, names, strict=True)]


def texts_near():
    """Texts with copies, near copies of several distances and unrelated ones."""
    rnd = random.Random(8)
    made = []
    for _ in range(12):
        words = [f"t{rnd.randrange(400)}" for _ in range(rnd.choice((3, 40, 150, 400)))]
        made.append(" ".join(words))
        for _ in range(rnd.randrange(12)):
            w = list(words)
            for _ in range(rnd.randrange(1, 4)):
                w[rnd.randrange(len(w))] = f"n{rnd.randrange(50)}"
            made.append(rnd.choice((" ", "\n", "  ")).join(w).upper() if rnd.random() < 0.2 else " ".join(w))
    return made


@pytest.mark.parametrize("tile", [None, 8])
@pytest.mark.parametrize("count", [2, 3])
def test_simhash_components(spark, monkeypatch, tile, count):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(200 - i, t) for i, t in enumerate(texts_near())] + [(None, ODD[7]), (None, "only without an id, five words"), (7, ODD[7]), (7, "x y z")]
    if tile:
        monkeypatch.setattr(simhash, "TILE", tile)  # every anchor of a cluster is cut
        monkeypatch.setattr(simhash, "PER_CELL", 100)
        monkeypatch.setattr(simhash, "PIECE", 7)
    got = simhash.near_duplicates(docs_of(spark, [(i, t, "s") for i, t in rows]), count=count)
    want = linked(rows)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert sum(i != c for i, _, c in want) > 20
    if not tile:
        assert simhash.near_duplicates(docs_of(spark, []), count=count).count() == 0


def test_simhash_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.op12_anchor_points(spark, SF).collect())) == sorted(linked(rows))


@pytest.mark.parametrize("width", [16, 21, 32])
def test_covering_code(width):
    """Every value has one home within the radius, and all anchors of the table are words of the code, within reach."""
    r, rnd = simhash.checks(width), np.random.default_rng(width)
    values = rnd.integers(0, 1 << width, 300, dtype=np.uint64)
    for value, s in zip(values, simhash.syndromes(values, r), strict=True):
        turn, home = simhash.masks(width, 2)[s]
        anchors = value ^ turn
        assert home.sum() == 1 and int(turn[home][0]).bit_count() <= simhash.RADIUS
        assert (simhash.syndromes(anchors, r) == 0).all() and len(set(anchors.tolist())) == len(anchors) and max(map(int.bit_count, turn.tolist())) <= 2


def test_dense_cluster_leaves_few_edges():
    """A cluster of thousands of near fingerprints leaves fewer edges than members."""
    rnd = np.random.default_rng(4)
    fp = np.unique([np.bitwise_xor.reduce(np.uint64(1) << rnd.integers(0, 64, 3, dtype=np.uint64)) for _ in range(4000)]).view(np.int64)
    a, b = simhash.star_edges(np.zeros(len(fp), np.int64), fp, np.ones(len(fp), bool))
    assert len(a) == len(fp) - 1 and set(b) | {a[0]} == set(fp.tolist()) and len(set(a)) == 1


def resampled(rows, target, share=25):
    def found(text):
        w = LETTERS.findall(lower(text))
        return len(w), [crc32(x.encode()) % 10000 for x in w + [" ".join(w[i : i + 2]) for i in range(len(w) - 1)]]

    s, t = [0] * 10000, [0] * 10000
    for side, texts in ((s, [x for _, x in rows]), (t, target)):
        for x in texts:
            for b in found(x)[1]:
                side[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + 10000) / ((s[b] + 1) * (sum(t) + 10000)))) for b in range(10000)]
    out = []
    for i, x in rows:
        words, bs = found(x)
        weight = sum(gain[b] for b in bs) // len(bs) if bs else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(bs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words >= 20])
    able = sorted((x for x in out if x[4]), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    drawn = [tuple(x[:4]) for x in able][: len(able) * share // 100]
    return sorted((tuple(x[:4]) for x in out), key=repr), drawn


@pytest.mark.parametrize("small", [False, True])
def test_resampling(spark, monkeypatch, small):
    rnd = random.Random(2)
    texts = [" ".join(f"v{min(rnd.randrange(300), rnd.randrange(300))}" for _ in range(rnd.randrange(60))) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(ODD)] + [(rnd.choice((1, -1)) * (100 + 3 * i), t) for i, t in enumerate(texts)] + [(None, ODD[8])] * 2 + [(8, ODD[8]), (2**62, ODD[7]), (-(2**62) - 5, ODD[7])]
    target = spark.createDataFrame([(1, "v1 v2 v3 v4 v5 v6", 1), (2, None, 1), (3, "V7 v8", 1)], "item_id int, text string, n int")
    if small:  # many blocks, many passes, texts in pieces
        monkeypatch.setattr(resampling, "DIGIT", 4)
        monkeypatch.setattr(resampling, "BLOCK_BITS", (3, 3))
        monkeypatch.setattr(resampling, "PIECE", 50)
    share = 25 if small else 90
    got = [tuple(r) for r in resampling.resample(docs_of(spark, [(i, t, "s") for i, t in rows]), target, share=share).select("doc_id", "n_features", "weight", "score", "rank").collect()]
    every, drawn = resampled(rows, ["v1 v2 v3 v4 v5 v6", "", "V7 v8"], share)
    assert sorted((r[:4] for r in got), key=repr) == every
    ranked = sorted((r for r in got if r[4] is not None), key=lambda r: r[4])
    assert [r[4] for r in ranked] == list(range(1, len(drawn) + 1)) and [r[:4] for r in ranked] == drawn != []
    if small:
        empty = docs_of(spark, [])
        assert resampling.resample(empty, target).count() == 0
        assert resampling.resample(docs_of(spark, [(1, ODD[7], "s")] * 8), empty.select("text")).filter("rank is not null").count() == 2
