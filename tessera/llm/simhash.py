"""SimHash near duplicates: 64-bit fingerprints of 4-word shingles, linked where at most 4 bits differ, found through anchor points.

Two fingerprints that differ in at most 4 bits differ in at most 4 // BANDS of one of BANDS bands. The anchors of a band are the
words of a covering code: a Hamming code of the longest length that the band holds, the band's further bits free, so that every value
lies within RADIUS = 1 of an anchor, its home. A fingerprint goes to every anchor within RADIUS plus the band's threshold; then the home of one
of a near pair always has the other. Which anchors these are depends on the value's syndrome alone, so they are a table of masks per syndrome.

Per anchor the fingerprints at home are compared with all that came. An anchor's fingerprints are kept as components, not pairs: every
block of comparisons looks at pairs of different components only, and what leaves is one edge from each member to its component's
first. So a cluster costs its size in edges, never its square. Anchors are dealt to tasks in cells of about PER_CELL rows. An anchor
with more than TILE rows is cut into tiles, every block of homes against every block of rows, so no task holds a hot anchor whole.

Copies are gone before that: only distinct fingerprints, with their least doc_id, are compared, and the edges are joined to components in Spark.

Nulls and edges: a null, empty or wordless text has fingerprint zero and is linked like any other; fewer than four words are one shingle; rows
of one text or id are rows of their own with one fingerprint each; a null doc_id gets its component's least id, and null where there is none. A
shingle counts as often as it occurs, and a bit that exactly half of them set is 0. An empty table gives no rows. Very long texts are hashed whole,
in pieces. Other columns aren't read, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .jaccard import components

WIDTH, SEED, BITS, THRESHOLD = 4, 42, 64, 4
BANDS = 3
RADIUS = 1
PER_CELL, TILE = 50_000, 50_000
PIECE = 100_000  # shingles whose bits are counted at once
PAIRS = 2_000_000  # pairs compared at once


def fingerprint(text: str | None) -> int:
    """The SimHash of a text as an unsigned integer."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, width = b" ".join(words), min(WIDTH, len(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.append(0, ends[:-1] + 1)[: len(words) - width + 1].tolist()
    ends = ends[width - 1 :].tolist()
    ones = np.zeros(BITS, np.int64)
    for lo in range(0, len(starts), PIECE):
        found = [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[lo : lo + PIECE], ends[lo : lo + PIECE], strict=True)]
        ones += np.unpackbits(np.array(found, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id bigint, fp bigint")


def bands(count: int = BANDS) -> list[tuple[int, int]]:
    """(first bit, width) of each band."""
    cuts = [BITS * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def checks(width: int) -> int:
    """r of the Hamming code of length 2**r - 1, the longest within the width."""
    return (width + 1).bit_length() - 1


def syndromes(values: np.ndarray, r: int) -> np.ndarray:
    """The exclusive or of the places (from 1) of the bits that are set among the first 2**r - 1."""
    out = np.zeros(len(values), np.int64)
    for place in range(1, 1 << r):
        out ^= np.where(values >> np.uint64(place - 1) & np.uint64(1), place, 0)
    return out


def masks(width: int, reach: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """By syndrome: the masks that lead from a value to the anchors within reach, and which of them leads home.

    A mask turns bits of the code's part so that the syndrome becomes 0, and any free bits. Home is the mask that turns one bit of the
    code's part, or none where the syndrome is 0 already.
    """
    r = checks(width)
    length, found = (1 << r) - 1, [[] for _ in range(1 << r)]
    for weight in range(reach + 1):
        for places in combinations(range(1, width + 1), weight):
            syndrome = 0
            for p in places:
                syndrome ^= p if p <= length else 0
            found[syndrome].append((sum(1 << (p - 1) for p in places), weight == 0 or weight == 1 and places[0] <= length))
    return [(np.array([m for m, _ in x], np.uint64), np.array([h for _, h in x])) for x in found]


def anchored(distinct: DataFrame, count: int = BANDS) -> DataFrame:
    """(anchor, fp, home) for every fingerprint of distinct and every anchor it goes to; the anchor's number holds its band's."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        tables = [(at, width, masks(width, RADIUS + THRESHOLD // count)) for at, width in bands(count)]
        for batch in batches:
            every = np.asarray(batch.column(0)).view(np.uint64)
            for lo in range(0, len(every), 20_000):
                fp = every[lo : lo + 20_000]
                for band, (at, width, table) in enumerate(tables):
                    values = fp >> np.uint64(at) & np.uint64((1 << width) - 1)
                    own = syndromes(values, checks(width))
                    for s, (turn, home) in enumerate(table):
                        chosen = own == s
                        if chosen.any():
                            anchor = (values[chosen][:, None] ^ turn) * np.uint64(count) + np.uint64(band)
                            columns = [anchor.ravel().view(np.int64), np.repeat(fp[chosen], len(turn)).view(np.int64), np.tile(home, int(chosen.sum()))]
                            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor", "fp", "home"])

    return distinct.select("fp").mapInArrow(run, "anchor bigint, fp bigint, home boolean")


def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """label (of every node the least of its component) after the links a - b."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(label, up := label[label]):
            label = up


def star_edges(anchor: np.ndarray, fp: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (a, b) that join the fingerprints which links within the anchors join: from each to its component's first."""
    order = np.argsort(anchor, kind="stable")
    anchor, fp, home = anchor[order], fp[order], home[order]
    nodes, at = np.unique(fp, return_inverse=True)
    label = np.arange(len(nodes))
    first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
    size = np.diff(np.append(first, len(anchor)))
    row_first, row_size = np.repeat(first, size), np.repeat(size, size)
    homes = np.flatnonzero(home & (row_size > 1))
    done = np.cumsum(row_size[homes])
    lo = 0
    while lo < len(homes):
        hi = max(lo + 1, int(np.searchsorted(done, (done[lo - 1] if lo else 0) + PAIRS, "right")))
        own, counts = homes[lo:hi], row_size[homes[lo:hi]]
        left = np.repeat(own, counts)
        right = np.repeat(row_first[own] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        a, b = at[left], at[right]
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
        near = np.bitwise_count((nodes[a] ^ nodes[b]).view(np.uint64)) <= THRESHOLD
        label = joined(label, a[near], b[near])
        lo = hi
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[moved]], nodes[moved]


def edges(anchors: DataFrame, rows: int) -> DataFrame:
    """(a, b): edges between fingerprints that join all that are linked."""
    cells = max(1, -(-rows // PER_CELL))
    hot = anchors.groupBy("anchor").agg(F.count("*").alias("_n")).filter(F.col("_n") > TILE).select(F.col("anchor").alias("_hot"), F.ceil(F.col("_n") / TILE).cast("int").alias("_k"))
    placed = anchors.join(hot, F.col("anchor") == F.col("_hot"), "left").withColumn("_k", F.coalesce("_k", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("_k")).cast("int")
    # A tile is a block of homes and a block of rows. A row goes to its block's tiles as one to compare with, and if at home also to
    # those of its own block of homes; where both are the same tile it goes once.
    span = F.sequence(F.lit(0), F.col("_k") - 1)
    tiles = F.transform(span, lambda i: F.struct(i.alias("i"), own.alias("j"), (F.col("home") & (i == own)).alias("h")))
    also = F.when(F.col("home"), F.transform(F.filter(span, lambda j: j != own), lambda j: F.struct(own.alias("i"), j.alias("j"), F.lit(True).alias("h"))))
    tiled = placed.select("anchor", "fp", F.explode(F.when(F.col("_k") == 1, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.col("home").alias("h")))).otherwise(F.concat(tiles, F.coalesce(also, F.array_repeat(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(True).alias("h")), 0))))).alias("t"))
    # Tiles are told apart within a cell by a hash of 64 bits: two that fell together would only be compared for nothing.
    keyed = tiled.select(F.when((F.col("t.i") == 0) & (F.col("t.j") == 0), F.col("anchor")).otherwise(F.xxhash64("anchor", "t.i", "t.j")).alias("key"), "fp", F.col("t.h").alias("home"))

    def run(table):
        import pyarrow as pa

        cell = table.combine_chunks()
        a, b = star_edges(cell.column("key").to_numpy(), cell.column("fp").to_numpy(), cell.column("home").to_numpy(zero_copy_only=False))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return keyed.withColumn("cell", F.pmod(F.xxhash64("key"), F.lit(cells))).groupBy("cell").applyInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count: int = BANDS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the least doc_id reachable by links, for every row of docs."""
    scratch, result = Scratch(docs.sparkSession), Scratch(docs.sparkSession)
    try:
        rows = result.stored(fingerprints(docs, id_col, text_col), "fingerprints")
        distinct = scratch.stored(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
        anchors = scratch.stored(anchored(distinct, count), "anchors")
        labels = components(edges(anchors, anchors.count()), scratch)
        known = distinct.join(labels, distinct["fp"] == labels["node"], "left").select(distinct["fp"], "rep", "label")
        linked = known.filter("label is not null")
        least = linked.groupBy("label").agg(F.min("rep").alias("component_id"))
        named = linked.join(least, "label").select("fp", "component_id").unionByName(known.filter("label is null").select("fp", F.col("rep").alias("component_id")))
        named = result.stored(named.select(F.col("fp").alias("_fp"), "component_id"), "named")
    finally:
        scratch.drop()
    return rows.join(named, F.col("fp") == F.col("_fp")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
