"""Approximate nearest neighbours by low-dimensional stable projections and kd-trees.

Vectors are projected to M dimensions by Gaussian (2-stable) coefficients. For a pair at distance d the squared projected
distance over d^2 follows a chi-square law with M degrees of freedom. So once the next projected neighbour is so far away that a vector
closer than the k-th found would have projected that far with a chance of at most 1 - CONFIDENCE, the search may stop.

Index. A kd-tree over a bounded sample (SAMPLE projections, the only part that goes to the driver) cuts the projected space into regions, at
most MOST_REGIONS; every vector falls into one. A region's vectors are dealt into shards of about ``per_shard``, however many that
takes, and each shard's vectors, projections and kd-tree of small leaves are stored as one row, once.
Search, in two rounds. A query first asks the shards of its own region, then those of every region whose box the stopping test can't rule out
by the k-th distance of the first round. In a shard it walks the leaves by ascending distance of their boxes, and in a leaf
verifies by true distance those vectors whose projections the test doesn't rule out. Queries of a shard come in blocks of PER_BLOCK; a
shard's row is copied for a second block only where so many queries ask it. n_verified is the number of distances that a query took.

Nulls and edges: vectors that are null, zero, or hold nulls or non-finite numbers take no part, nor do rows without vec_id; vectors are only
compared with vectors of equal length; repeated rows are candidates of their own, but a query's own vec_id never is; of unlike
query rows of one vec_id the least vector asks; ties go to the smaller vec_id.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, IntegerType, StructField, StructType

from .common import Scratch, stored

M, LEAF, CONFIDENCE, SEED = 12, 128, 0.95, 17
PER_SHARD, PER_BLOCK, K = 8192, 50_000, 10
SAMPLE, MOST_REGIONS = 20_000, 1024


def chi_square_cdf(x: float, m: int = M) -> float:
    """For even m: 1 - exp(-x/2) * sum over i < m/2 of (x/2)^i / i!."""
    half, term, total = x / 2, 1.0, 0.0
    for i in range(m // 2):
        total += term
        term *= half / (i + 1)
    return 1 - math.exp(-half) * total


def quantile(p: float, m: int = M) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_cdf(mid, m) < p else (low, mid)
    return high


def projection(dim: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dim, M))


class Tree:
    """kd-tree over projected points: split at the median of the widest axis down to leaves."""

    def __init__(self, points: np.ndarray):
        self.lows, self.highs, self.kids, self.rows = [], [], [], []
        self._grow(points, np.arange(len(points)))

    def _grow(self, points: np.ndarray, rows: np.ndarray) -> int:
        at, own = len(self.rows), points[rows]
        low, high = own.min(0), own.max(0)
        self.lows.append(low)
        self.highs.append(high)
        self.kids.append(None)
        self.rows.append(rows)
        if len(rows) > LEAF and (high > low).any():
            axis = int((high - low).argmax())
            order = np.argsort(own[:, axis], kind="stable")
            half = len(rows) // 2
            self.rows[at] = None
            self.kids[at] = (self._grow(points, rows[order[:half]]), self._grow(points, rows[order[half:]]))
        return at

    def box(self, node: int, q: np.ndarray) -> float:
        gap = np.maximum(np.maximum(self.lows[node] - q, q - self.highs[node]), 0)
        return float(gap @ gap)

    def leaves(self, q: np.ndarray) -> Iterator[tuple[float, np.ndarray]]:
        """(squared distance of the box, rows), nearest first."""
        heap = [(self.box(0, q), 0)]
        while heap:
            far, node = heapq.heappop(heap)
            if self.kids[node] is None:
                yield far, self.rows[node]
            else:
                for kid in self.kids[node]:
                    heapq.heappush(heap, (self.box(kid, q), kid))


def regions(points: np.ndarray, most: int) -> list[tuple[int, float, int, int]]:
    """Nodes (axis, cut, left, right) that halve the points at the median of the widest axis into at most so many parts; a part's node has
    axis -1 and its number as cut."""
    nodes: list = []
    parts = 0

    def grow(own: np.ndarray, share: int) -> int:
        nonlocal parts
        at = len(nodes)
        nodes.append(None)
        if share >= 2 and len(own) >= 2 and (own.max(0) > own.min(0)).any():
            axis = int((own.max(0) - own.min(0)).argmax())
            cut = float(np.median(own[:, axis]))
            low = own[:, axis] < cut
            if low.any() and not low.all():
                nodes[at] = (axis, cut, grow(own[low], share // 2), grow(own[~low], share // 2))
                return at
        nodes[at] = (-1, float(parts), -1, -1)
        parts += 1
        return at

    grow(points, most)
    return nodes


def region_of(nodes: list, points: np.ndarray) -> np.ndarray:
    """The number of each point's region."""
    found = np.empty(len(points), np.int32)

    def walk(node: int, rows: np.ndarray) -> None:
        axis, cut, left, right = nodes[node]
        if axis < 0:
            found[rows] = int(cut)
        else:
            low = points[rows, axis] < cut
            walk(left, rows[low])
            walk(right, rows[~low])

    walk(0, np.arange(len(points)))
    return found


def region_gaps(nodes: list, q: np.ndarray) -> dict[int, float]:
    """Squared distance of a point to each region's box."""
    found = {}

    def walk(node: int, off: np.ndarray) -> None:
        axis, cut, left, right = nodes[node]
        if axis < 0:
            found[int(cut)] = float(off @ off)
            return
        for kid, gap in ((left, q[axis] - cut), (right, cut - q[axis])):
            own = off.copy()
            own[axis] = max(own[axis], gap, 0.0)
            walk(kid, own)

    walk(0, np.zeros(len(q)))
    return found


def search(tree: Tree, ids: np.ndarray, vectors: np.ndarray, points: np.ndarray, q_id: int, q: np.ndarray, at: np.ndarray, known: float, k: int, stop: float) -> tuple[np.ndarray, np.ndarray, int]:
    """A shard's k best for a query (ids, distances) and the number verified; known: a bound on the k-th distance from elsewhere."""
    dist, found, verified = np.empty(0), np.empty(0, np.int64), 0
    for far, rows in tree.leaves(at):
        limit = min(known, dist[-1] if len(dist) == k else math.inf)
        if far >= stop * limit**2 > 0:
            break
        gap = points[rows] - at
        rows = rows[(np.einsum("ij,ij->i", gap, gap) <= stop * limit**2) & (ids[rows] != q_id)]
        delta = vectors[rows] - q
        verified += len(rows)
        dist = np.concatenate([dist, np.sqrt(np.einsum("ij,ij->i", delta, delta))])
        found = np.concatenate([found, ids[rows]])
        best = np.lexsort((found, dist))[:k]
        dist, found = dist[best], found[best]
    return found, dist, verified


def _with(rows: DataFrame, name: str, kind: DataType) -> StructType:
    return StructType([*rows.schema.fields, StructField(name, kind)])


def _projected(rows: DataFrame) -> DataFrame:
    """Adds _p, the projections."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            lists, at = b.column("_v"), {}
            p = [None] * b.num_rows
            for i, v in enumerate(lists):
                v = np.asarray(v.values, np.float64)
                if len(v) not in at:
                    at[len(v)] = projection(len(v))
                p[i] = v @ at[len(v)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.list_(pa.float64()))], [*b.schema.names, "_p"])

    return rows.mapInArrow(run, _with(rows, "_p", ArrayType(DoubleType())))


def _placed(rows: DataFrame, nodes: list) -> DataFrame:
    """Adds _region."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            found = region_of(nodes, np.array(b.column("_p").to_pylist()).reshape(-1, M))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.int32())], [*b.schema.names, "_region"])

    return rows.mapInArrow(run, _with(rows, "_region", IntegerType()))


SHARD = ["_dim", "_region", "_shard"]
INDEX = "_dim int, _region int, _shard int, ids binary, vectors binary, points binary, tree binary"
FOUND = "query_id bigint, vec_id bigint, score double, n_verified bigint"


def _indexed(rows: DataFrame) -> DataFrame:
    """One row per shard: its vectors, projections and tree."""

    def run(key, pdf):
        import pickle

        import pandas as pd

        ids, v, p = pdf["_id"].to_numpy(np.int64), np.stack(pdf["_v"].to_numpy()).astype(np.float64), np.stack(pdf["_p"].to_numpy())
        tree = pickle.dumps(Tree(p))  # read back by the library's own tasks only
        return pd.DataFrame([(*(int(k) for k in key), ids.tobytes(), v.tobytes(), p.tobytes(), tree)], columns=INDEX.replace(",", "").split()[::2])

    return rows.groupBy(*SHARD).applyInPandas(run, INDEX)


def _asked(index: DataFrame, visits: DataFrame, sizes: DataFrame, k: int) -> DataFrame:
    """FOUND rows: the k best of each shard for each query that visits it. visits: _dim, _region, _id, _v, _p, _limit."""
    visits = visits.join(F.broadcast(sizes), ["_dim", "_region"]).withColumn("_shard", F.explode(F.sequence(F.lit(0), F.col("_shards") - 1)))
    blocks = visits.groupBy("_dim", "_region").agg(F.count_distinct("_id").alias("_n")).select("_dim", "_region", (F.floor((F.col("_n") - 1) / PER_BLOCK) + 1).cast("int").alias("_blocks"))
    block = F.pmod(F.xxhash64("_id", F.lit(3)), F.col("_blocks")).cast("int").alias("_block")
    asked = visits.join(F.broadcast(blocks), ["_dim", "_region"]).select(*SHARD, block, "_id", "_v", "_p", "_limit")
    left = index.join(F.broadcast(blocks), ["_dim", "_region"]).withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).drop("_blocks")
    stop = quantile(CONFIDENCE)

    def run(shard, queries):
        import pickle

        import pandas as pd

        if not len(shard) or not len(queries):
            return pd.DataFrame([], columns=["query_id", "vec_id", "score", "n_verified"])
        s = shard.iloc[0]
        ids = np.frombuffer(s["ids"], np.int64)
        v, p, tree, out = np.frombuffer(s["vectors"]).reshape(len(ids), -1), np.frombuffer(s["points"]).reshape(len(ids), M), pickle.loads(s["tree"]), []
        for q_id, q, at, limit in zip(queries["_id"], queries["_v"], queries["_p"], queries["_limit"], strict=True):
            found, dist, n = search(tree, ids, v, p, q_id, np.asarray(q, np.float64), np.asarray(at), limit, k, stop)
            out += [(q_id, int(i), float(d), n if not j else 0) for j, (i, d) in enumerate(zip(found, dist, strict=True))]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score", "n_verified"])

    keys = [*SHARD, "_block"]
    return left.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(run, FOUND)


def nearest(vectors: DataFrame, is_query: Column, k: int = K, per_shard: int = PER_SHARD, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance in double precision), n_verified."""
    scratch = Scratch(vectors.sparkSession)
    v = F.col("_v")
    usable = v.isNotNull() & ~F.exists("_v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("_v", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(vec_col).alias("_v"), F.coalesce(is_query, F.lit(False)).alias("_q")).filter(usable & F.col("_id").isNotNull())
    rows = rows.select("_id", F.col("_v").cast("array<double>").alias("_v"), "_q", F.size("_v").alias("_dim"))
    n = rows.count()
    # The sample: a share of the rows by hash, about SAMPLE of them; rows that repeat have one hash, hence the limit.
    drawn = rows.filter(F.pmod(F.xxhash64("_id", "_v", F.lit(5)), F.lit(1 << 30)) < F.lit(int(min(1.0, SAMPLE / max(1, n)) * (1 << 30)))).limit(2 * SAMPLE)
    sample = np.array([r["_p"] for r in _projected(drawn).select("_p").collect()]).reshape(-1, M)
    nodes = regions(sample, min(MOST_REGIONS, max(1, n // per_shard)))
    placed = scratch.stored(_placed(_projected(rows), nodes), "placed")
    sizes = placed.groupBy("_dim", "_region").agg(F.count("*").alias("_n")).select("_dim", "_region", (F.floor((F.col("_n") - 1) / per_shard) + 1).cast("int").alias("_shards"))
    sizes = scratch.stored(sizes, "sizes")  # at most MOST_REGIONS rows for each length of vectors
    dealt = placed.join(F.broadcast(sizes), ["_dim", "_region"]).withColumn("_shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("_shards")).cast("int"))
    index = scratch.stored(_indexed(dealt.select(*SHARD, "_id", "_v", "_p")), "index")
    asks = placed.filter("_q").groupBy("_id").agg(F.min(F.struct("_v", "_dim", "_p", "_region")).alias("q")).select("_id", "q.*")
    asks = scratch.stored(asks, "asks")
    home = scratch.stored(_asked(index, asks.withColumn("_limit", F.lit(float("inf"))), sizes, k), "home")
    by_query = Window.partitionBy("query_id").orderBy("score", "vec_id")
    bound = home.withColumn("r", F.row_number().over(by_query)).filter(F.col("r") == k).select(F.col("query_id").alias("_id"), F.col("score").alias("_limit"))
    known = asks.join(bound, "_id", "left").withColumn("_limit", F.coalesce("_limit", F.lit(float("inf"))))
    stop = quantile(CONFIDENCE)

    def far(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            p, own, limit = b.column("_p").to_pylist(), b.column("_region").to_pylist(), b.column("_limit").to_pylist()
            more = [[r for r, gap in region_gaps(nodes, np.array(x)).items() if r != o and gap <= stop * m**2] for x, o, m in zip(p, own, limit, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(more, pa.list_(pa.int32()))], [*b.schema.names, "_more"])

    visits = known.mapInArrow(far, _with(known, "_more", ArrayType(IntegerType()))).withColumn("_region", F.explode("_more")).drop("_more")
    found = home.unionByName(_asked(index, visits, sizes, k))
    total = F.sum("n_verified").over(Window.partitionBy("query_id"))
    ranked = found.withColumn("n_verified", total).withColumn("rank", F.row_number().over(by_query)).filter(F.col("rank") <= k)
    result = stored(ranked.select("query_id", "rank", "vec_id", "score", "n_verified"), "nearest")
    scratch.drop()
    return result
