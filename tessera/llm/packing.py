"""Best-fit packing into bins of several permitted capacities.

A document of n tokens becomes pieces of the largest capacity and a rest. Pieces are dealt to shards by hash, about
``per_shard`` in each, and each shard is packed by itself, longest piece first: a piece goes where it leaves the least room. If it
fits nowhere, a bin opens: for every capacity the pieces still to come are laid into it on trial, longest first where they fit, and the
capacity of least cost per token so filled is opened, priced as the smallest bin that holds the trial's contents. So short bins and
long ones compete for each piece by what the shard's own rest can fill. Later pieces may find a tighter place than the trial gave them; at the
end every bin shrinks to the smallest capacity that holds its contents. A bin costs its capacity, a quadratic share for
attention (COST_LENGTH: the length at which both are equal) and a fixed OVERHEAD (a launch, its padding), so that neither the least nor the largest
size wins by itself: between the two middle ones the price of a full token is equal, and what fills them best decides. The number of shards follows the number of pieces, so no task
grows with the input.

Nulls and edges: null and empty texts have no tokens and no row; a null doc_id is packed like any other; repeated rows are packed once
each; pieces of equal length are placed by doc_id (nulls last), then piece. An empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, words

CAPACITIES = (512, 1024, 2048, 4096)
COST_LENGTH = 4096.0
OVERHEAD = 512.0
PER_SHARD = 4000
SCHEMA = "doc_id bigint, piece int, n_tokens int, bin_id string, opened int, capacity int, position int"


def cost(capacity: int) -> float:
    return OVERHEAD + capacity + capacity * capacity / COST_LENGTH


def fill(sizes: list[int], room: int, start: int, low: list[int]) -> int:
    """Tokens of sizes[start:] (descending; low: the negatives) that go into the room, longest first where they fit."""
    used, at = 0, start
    while room and (at := bisect_left(low, -room, at)) < len(sizes):
        used, room, at = used + sizes[at], room - sizes[at], at + 1
    return used


def pack(sizes: list[int], capacities: tuple[int, ...] = CAPACITIES) -> tuple[list[int], list[int], list[int]]:
    """(bin of each size, capacity each bin opened with, final capacity of each bin); sizes descending, none above the largest capacity."""
    opened: list[int] = []
    used: list[int] = []  # tokens in each bin
    free: list[tuple[int, int]] = []  # (room left, bin), sorted
    placed, low = [], [-s for s in sizes]
    least = lambda n: next(c for c in capacities if c >= n)

    def price(capacity: int, size: int, after: int) -> tuple[float, int]:
        tokens = size + fill(sizes, capacity - size, after, low)
        return cost(least(tokens)) / tokens, capacity

    for i, size in enumerate(sizes):
        at = bisect_left(free, (size, -1))
        if at < len(free):
            room, b = free.pop(at)
        else:
            room = min(price(c, size, i + 1) for c in capacities if c >= size)[1]
            b = len(opened)
            opened.append(room)
            used.append(0)
        used[b] += size
        placed.append(b)
        if room > size:
            insort(free, (room - size, b))
    return placed, opened, [least(n) for n in used]


def best_fit(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, per_shard: int = PER_SHARD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece: its bin, the capacity the bin was opened with and ended with, and the piece's place in it. A token is a word here."""
    sizes = tuple(sorted(set(capacities)))
    top = sizes[-1]
    counted = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.size(words(F.col(text_col))).alias("n")).filter(F.when(F.col("n") > 0, True).otherwise(False))
    pieces = stored(counted.select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.ceil(F.col("n") / top).cast("int") - 1), lambda i: F.least(F.lit(top), F.col("n") - i * top))).alias("piece", "n_tokens")), "pieces")
    shards = max(1, -(-pieces.count() // per_shard))
    # Copies of one row share doc_id, so the hash takes in a number of the row's own; pieces are stored, hence it never changes.
    dealt = pieces.withColumn("_shard", F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(shards)).cast("int"))

    def run(table):
        import pyarrow as pa

        table = table.sort_by([("n_tokens", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        sizes_of, shard = table.column("n_tokens").to_pylist(), table.column("_shard")[0].as_py()
        placed, opened, caps = pack(sizes_of, sizes)
        at, position = [0] * len(caps), []
        for b, n in zip(placed, sizes_of, strict=True):
            position.append(at[b])
            at[b] += n
        own = lambda of, kind: pa.array([of[b] for b in placed], kind)
        return pa.table([table.column("doc_id"), table.column("piece"), table.column("n_tokens"), own([f"{shard}-{b}" for b in range(len(caps))], pa.string()), own(opened, pa.int32()), own(caps, pa.int32()), pa.array(position, pa.int32())], names=SCHEMA.replace(",", "").split()[::2])

    return dealt.groupBy("_shard").applyInArrow(run, SCHEMA)
