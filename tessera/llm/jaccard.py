"""Near-duplicate documents: an exact set-similarity self-join on 5-word shingles by grouped prefixes.

Shingles are ordered rarest first. Two sets of Jaccard similarity 3/4 or more share a shingle among the first
s - ceil(3s/4) + 1 of each, so only these prefixes are joined. Documents with equal word sequences form a class; classes with
identical prefix and size form a group, and groups are what the join sees; size and position filters drop group pairs, what
is left is expanded to classes and verified on the sets.

Rarity. Texts are dealt into chunks of about CHUNK characters. A chunk sends the heads (leading bits, some more than the input's
size needs) of its distinct shingles, in sorted runs, to the range of heads they lie in; a range adds up the counts and answers each chunk
with those heads that occur twice and the logarithm of their counts. Chunk and answers meet by chunk; the texts lie bucketed by it, so
they don't move. Ranges and heads grow with the input, and nothing is broadcast. A shingle that occurs once takes its place in the prefix
but is never joined, and sets shrink to what they share with any other text: that is all an intersection can hold.

Verification. Every class has an outline, a bitmap of 2 to 4 bits a shingle. What one set has and the other's outline lacks is not shared, so
pairs that can't reach the limit are dropped on the outlines (an upper bound, so none is lost) before any set travels.

Components. Only links between different components matter. Each bucket (a shingle and the groups whose prefix has it) first
links its members to one pivot; verified links join components. What remains is every pair of a bucket that still spans
components; these pairs are enumerated in full. So a large cluster costs its size, not its square, and no link is lost.

Nulls and edges: a null, empty or wordless text has no shingles and is linked with nothing; a text of fewer than five words is one
shingle; a null doc_id keeps its row, with a null component unless linked; repeated rows fall into one class. Tables written on the
way are deleted before the result is returned, but for the two small ones it reads.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, WORD, Scratch, stored

WIDTH = 5
CHUNK = 8_000_000  # characters whose shingles meet in one group
PER_RANGE = 8_000_000  # characters whose shingles one range counts
PER_BUCKET, MOST_BUCKETS = 16_000_000, 50_000  # characters a bucket; the second bounds files, buckets then hold more chunks
STAR_ROUNDS = 2
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(words: list[bytes]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text's words."""
    from pandas.util import hash_array

    if not words:
        return np.empty(0, np.uint64)
    w = hash_array(np.array(words, object), categorize=False)
    n = min(WIDTH, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for j in range(n):
        h = (h ^ w[j : len(w) - n + 1 + j]) * _MIX
        h ^= h >> np.uint64(29)
    h.sort()
    return h[np.append(True, h[1:] != h[:-1])]


def _digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()[:32]


def node_of(text: Column) -> Column:
    """The digest of a text's words, the same as Python's, by SQL functions. A-Z are lower-cased, other letters aren't."""
    low = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.left(F.sha2(F.trim(F.regexp_replace(low, SPACES + "+", " ")), 256), F.lit(32))


def packed(values: np.ndarray) -> bytes:
    """Ascending integers: the first, then the byte planes of their differences."""
    if not len(values):
        return b""
    steps = np.diff(values)
    width = (int(steps.max(initial=0)).bit_length() + 7) // 8
    return values[:1].tobytes() + np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T[:width]).tobytes()


def unpacked(blob: bytes, n: int) -> np.ndarray:
    steps = np.zeros((n, 8), np.uint8)
    if n:
        steps[0] = np.frombuffer(blob, np.uint8, 8)
    if n > 1:
        planes = np.frombuffer(blob, np.uint8, offset=8).reshape(-1, n - 1)
        steps[1:, : len(planes)] = planes.T
    return np.cumsum(steps.view(np.uint64).ravel(), dtype=np.uint64)


def outline(hashes: np.ndarray, size: int) -> np.ndarray:
    """A bitmap of 2 to 4 bits for each of size shingles, as 64-bit words."""
    bits = np.zeros(1 << max(6, (2 * size - 1).bit_length()), np.uint8)
    bits[(hashes & np.uint64(len(bits) - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.int64)


def most_shared(a: Column, n_a: Column, b: Column, n_b: Column) -> Column:
    """No fewer than two sets of n_a and n_b hashes share: what one has where the other's outline is empty isn't shared. The larger outline is
    folded to the smaller's size, where a hash keeps its low bits; sets that pass the size filter differ by one fold at most."""
    size = F.least(F.size(a), F.size(b))
    fold = lambda o: F.when(F.size(o) > size, F.zip_with(F.slice(o, F.lit(1), size), F.slice(o, size + 1, size), lambda x, y: x.bitwiseOR(y))).otherwise(o)
    lacks = F.zip_with(fold(a), fold(b), lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y))).cast("long") * (1 << 32) + F.bit_count(y.bitwiseAND(F.bitwise_not(x))))
    both = F.aggregate(lacks, F.lit(0).cast("long"), lambda s, x: s + x)
    return F.transform(F.array(both), lambda v: F.least(n_a - F.shiftright(v, 32), n_b - v.bitwiseAND(F.lit((1 << 32) - 1))))[0]


ROWS = "chunk bigint, _id bigint, node string, size bigint, text string"


def _dealt(docs: DataFrame) -> DataFrame:
    """A row per document: its chunk, the digest of its words (node; null for none), and for the first of a node in the chunk the text and
    its length."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        chunk, held, seen = TaskContext.get().partitionId() << 32, 0, set()
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                chunks, nodes, sizes, texts = [], [], [], []
                for t in part.column(1).to_pylist():
                    words = _words(t)
                    node = _digest(b" ".join(words)) if words else None
                    fresh = node is not None and node not in seen
                    chunks.append(chunk)
                    nodes.append(node)
                    sizes.append(len(t) if fresh else 0)
                    texts.append(t if fresh else None)
                    if fresh:
                        seen.add(node)
                        held += len(t)
                        if held >= CHUNK:
                            chunk, held, seen = chunk + 1, 0, set()
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.string()]
                c, n, s, x = (pa.array(v, k) for v, k in zip((chunks, nodes, sizes, texts), kinds, strict=True))
                yield pa.RecordBatch.from_arrays([c, part.column(0), n, s, x], ["chunk", "_id", "node", "size", "text"])

    return docs.select("_id", "_text").mapInArrow(run, ROWS)


def _answered(texts: DataFrame, total: int, bits: int) -> DataFrame:
    """(chunk, n, heads, levels): to each chunk the heads that occur twice or more, and log2 of their counts, by range."""
    parts = max(1, -(-total // PER_RANGE))

    def ask(batches: Iterator) -> Iterator:
        import pyarrow as pa

        cuts = np.array([-(-(i << bits) // parts) for i in range(1, parts)], np.uint64)

        def sent(chunk: int, sets: list[np.ndarray]):
            heads, counts = np.unique(np.concatenate(sets) >> np.uint64(64 - bits), return_counts=True)
            at = [0, *np.searchsorted(heads, cuts), len(heads)]
            own = [(i, a, b) for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)) if b > a]
            counts = np.minimum(counts, 255).astype(np.uint8)
            cols = [[i for i, _, _ in own], [chunk] * len(own), [int(b - a) for _, a, b in own], [packed(heads[a:b]) for _, a, b in own], [counts[a:b].tobytes() for _, a, b in own]]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["part", "chunk", "n", "heads", "counts"])

        now, sets = None, []
        for batch in batches:
            for chunk, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if chunk != now and sets:
                    yield sent(now, sets)
                    sets = []
                now = chunk
                sets.append(shingles(_words(text.as_py())))
        if sets:
            yield sent(now, sets)

    def answer(pdf):
        import pandas as pd

        runs = [unpacked(b, n) for b, n in zip(pdf["heads"], pdf["n"], strict=True)]
        _, at = np.unique(np.concatenate(runs), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate([np.frombuffer(c, np.uint8) for c in pdf["counts"]]))
        level, out, lo = np.log2(total).astype(np.uint8)[at], [], 0
        for chunk, heads in zip(pdf["chunk"], runs, strict=True):
            own = level[lo : lo + len(heads)]
            lo += len(heads)
            if own.any():
                out.append((chunk, int((own > 0).sum()), packed(heads[own > 0]), own[own > 0].tobytes()))
        return pd.DataFrame(out, columns=["chunk", "n", "heads", "levels"])

    asked = texts.select("chunk", "text").filter("text is not null").mapInArrow(ask, "part bigint, chunk bigint, n int, heads binary, counts binary")
    return asked.groupBy("part").applyInPandas(answer, "chunk bigint, n int, heads binary, levels binary")


CLASSES = "key string, n bigint, shared bigint, prefix string, post array<bigint>, place array<bigint>, outline array<bigint>, hashes binary"


def _sketched(texts: DataFrame, answers: DataFrame, bits: int) -> DataFrame:
    """Per class and chunk: its digest (key) and set size, and where its prefix has a shared shingle: digest of the prefix, these shingles
    with their places, and the shared shingles of the whole set with their outline."""
    columns = CLASSES.replace(",", "").split()[::2]

    def run(left, right):
        import pandas as pd

        if not len(left):
            return pd.DataFrame([], columns=columns)
        sets = [shingles(_words(t)) for t in left["text"]]
        n = np.array([len(s) for s in sets])
        every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
        heads, levels = np.empty(0, np.uint64), np.empty(0, np.uint8)
        if len(right):
            heads = np.concatenate([unpacked(b, c) for b, c in zip(right["heads"], right["n"], strict=True)])
            heads, first = np.unique(heads, return_index=True)
            levels = np.concatenate([np.frombuffer(b, np.uint8) for b in right["levels"]])[first]
            own = every >> np.uint64(64 - bits)
            at = np.minimum(np.searchsorted(heads, own), len(heads) - 1)
            hit = heads[at] == own
            every, owner, levels = every[hit], owner[hit], levels[at[hit]]
        else:
            every, owner = every[:0], owner[:0]
        order = np.lexsort((every, levels, owner))
        ordered, shared = every[order], np.bincount(owner, minlength=len(sets))
        ends, out = np.cumsum(shared), []
        for i, key in enumerate(left["node"]):
            size, own = int(n[i]), ordered[ends[i] - shared[i] : ends[i]]
            alone = size - len(own)
            post = own[: max(0, size - (3 * size + 3) // 4 + 1 - alone)]
            if len(post):
                # The single shingles of a prefix are no other set's, so such a class is a group of its own.
                prefix = _digest(post.tobytes() + (key.encode() if alone else b""))
                own = np.sort(own)
                out.append((key, size, len(own), prefix, post.view(np.int64), alone + np.arange(len(post)), outline(own, size), own.tobytes()))
            else:
                out.append((key, size, len(own), None, None, None, None, None))
        return pd.DataFrame(out, columns=columns)

    rows = texts.select("chunk", "node", "text").filter("text is not null")
    return rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(run, CLASSES)


def _passes(n1: Column, r1: Column, n2: Column, r2: Column) -> Column:
    """Size filter, and position filter: what follows the shared shingle, itself included, must hold enough of both."""
    return (4 * F.least(n1, n2) >= 3 * F.greatest(n1, n2)) & (7 * F.least(r1, r2) >= 3 * (n1 + n2))


def _bounded(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """The (hub, spoke) whose outlines leave room for enough shared shingles."""
    side = lambda end, i: names.select(F.col("node").alias(end), *[F.col(c).alias(f"{c}{i}") for c in ("n", "shared", "outline")])
    enough = 7 * most_shared(F.col("outline1"), F.col("shared1"), F.col("outline2"), F.col("shared2")) >= 3 * (F.col("n1") + F.col("n2"))
    return pairs.join(side("spoke", 2), "spoke").join(side("hub", 1), "hub").filter(enough).select("hub", "spoke")


def _verified(pairs: DataFrame, names: DataFrame, sets: DataFrame) -> DataFrame:
    """The (hub, spoke) whose sets are similar enough. Sets are bucketed by digest, so the pairs travel to them. A hub may be in very many
    pairs: the last join shuffles the hubs' sets alone, plainly, so that adaptive execution can split a hot one."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            keep = []
            for x, y, n in zip(batch.column(2), batch.column(3), batch.column(4).to_pylist(), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= 75 * (n - both))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["hub", "spoke"]).filter(pa.array(keep, pa.bool_()))

    keys = names.select(F.col("node").alias("_node"), "key", "n")
    near = pairs.join(keys, F.col("spoke") == F.col("_node")).select("hub", "spoke", "key", F.col("n").alias("n2"))
    spokes = near.join(sets, "key").select("hub", "spoke", "n2", F.col("hashes").alias("spoke_set"))
    wanted = keys.join(pairs.select(F.col("hub").alias("_node")).distinct(), "_node")
    hubs = wanted.join(sets, "key").select(F.col("_node").alias("hub"), F.col("n").alias("n1"), F.col("hashes").alias("hub_set"))
    return spokes.join(hubs, "hub").select("hub", "spoke", "hub_set", "spoke_set", (F.col("n1") + F.col("n2")).alias("n")).mapInArrow(run, "hub bigint, spoke bigint")


def _unseen(pairs: DataFrame, done: DataFrame | None) -> DataFrame:
    """The pairs that are not in done, in either direction."""
    if done is None:
        return pairs
    ends = lambda df: df.withColumns({"a": F.least("hub", "spoke"), "b": F.greatest("hub", "spoke")})
    return ends(pairs).join(ends(done).select("a", "b"), ["a", "b"], "left_anti").select("hub", "spoke")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label) for every node of the edges (a, b): the smallest node reachable. Labels spread to neighbours and jump to their
    label's label until none changes; every round is stored."""
    both = scratch.stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = scratch.stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        new = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = scratch.stored(new.join(up, "label").select("node", "old", F.least("label", "up").alias("label")), "labels")
        labels = new.select("node", "label")
        if new.filter("label != old").isEmpty():
            return labels


def _named(df: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """df with the label of its node; a node without links is its own."""
    return df.join(labels.select(F.col("node").alias("_node"), "label"), F.col(key) == F.col("_node"), "left").drop("_node").withColumn("label", F.coalesce("label", key))


def _merged(labels: DataFrame | None, links: DataFrame, scratch: Scratch) -> DataFrame:
    """labels after more links (hub, spoke): only components that the links join are looked at again."""
    if labels is None:
        return components(links.select(F.col("hub").alias("a"), F.col("spoke").alias("b")), scratch)
    ends = _named(_named(links, labels, "hub").withColumnRenamed("label", "a"), labels, "spoke").withColumnRenamed("label", "b")
    joined = components(ends.filter("a != b").select("a", "b"), scratch)
    moved = labels.join(joined.select(F.col("node").alias("label"), F.col("label").alias("_to")), "label", "left").select("node", F.coalesce("_to", "label").alias("label"))
    return scratch.stored(moved.unionByName(joined.join(labels.select("node"), "node", "left_anti")), "labels")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id for every row of docs."""
    rows, classes = _grouped(docs, id_col, text_col)
    empty = rows.filter("node is null").select("_id", F.lit(0).cast("long").alias("n"), F.col("_id").alias("component_id"))
    first = classes.groupBy("label").agg(F.min("rep").alias("component_id"))
    # Most classes are their component's only one; they need no join.
    known = classes.filter("label is not null").join(first, "label").select("node", "n", "component_id").unionByName(classes.filter("label is null").select("node", "n", F.col("rep").alias("component_id")))
    found = rows.filter("node is not null").join(known, "node").select("_id", "n", "component_id")
    return empty.unionByName(found).select(F.col("_id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows (_id, node) and classes (node, n, rep, label), both stored: node is the digest of a text's words, n the size of its set, rep the
    least id; classes linked with others share a label, those linked with none have a null one."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    total = rows.agg(F.sum(F.length("_text"))).first()[0] or 0
    buckets, bits = max(1, min(MOST_BUCKETS, -(-total // PER_BUCKET))), min(63, total.bit_length() + 6)
    first, scratch = Scratch(spark), Scratch(spark)
    texts = first.bucketed(_dealt(rows), "chunk", "texts", buckets)
    rows = stored(texts.select("_id", "node"), "rows")
    sketch = _sketched(texts, _answered(texts, total, bits), bits)
    one = sketch.repartition(buckets, "key").groupBy("key").agg(*[F.first(c).alias(c) for c in ("n", "shared", "prefix", "post", "place", "outline", "hashes")])
    classes = scratch.bucketed(one, "key", "classes", buckets)
    first.drop()
    joined = classes.filter("post is not null")
    sets = joined.select("key", "hashes")
    # From here a class goes by a number, a group by the least number of its classes; digests only lead to the sets.
    names = scratch.stored(joined.select("key", "n", "shared", "prefix", "outline", F.monotonically_increasing_id().alias("node")), "numbers")
    names = scratch.stored(names.join(names.groupBy("n", "prefix").agg(F.min("node").alias("head")), ["n", "prefix"]).drop("prefix"), "names")
    heads = names.filter("node = head").select("key", "head")
    postings = joined.select("key", "n", "post", "place").join(heads, "key").select("n", "head", F.explode(F.arrays_zip("post", "place")).alias("x"))
    postings = postings.select(F.col("x.post").alias("x"), "n", "head", (F.col("n") - F.col("x.place")).alias("r"))
    labels = _linked(scratch.stored(postings, "postings"), names, sets, scratch)
    reps = rows.filter("node is not null").groupBy("node").agg(F.min("_id").alias("rep"))
    known = names.select("key", "node").join(labels, "node").select("key", "label")
    found = classes.select(F.col("key").alias("node"), "n", "key").join(reps, "node").join(known, "key", "left").select("node", "n", "rep", "label")
    found = stored(found, "classes")
    scratch.drop()
    return rows, found


def _linked(postings: DataFrame, names: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label) of all nodes that are linked with others."""
    members = names.select("head", "node")
    # Star within groups, and in every bucket from its pivot to the members of its other groups.
    within = members.filter("node != head").select(F.col("head").alias("hub"), F.col("node").alias("spoke"))
    done, labels = None, None
    for turn in range(STAR_ROUNDS):
        labelled = postings
        if labels is not None:
            labelled = _named(postings, labels, "head")
            spans = labelled.groupBy("x").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low != high").select("x")
            labelled = labelled.join(spans, "x", "left_semi")
        # The first round prefers the same pivot everywhere, which joins tight clusters with few pairs; later ones draw a pivot per bucket.
        order = F.xxhash64("head") if not turn else F.xxhash64("head", "x", F.lit(turn))
        pivot = labelled.groupBy("x").agg(F.min(F.struct(order.alias("o"), "head", "n", "r", *(["label"] if labels is not None else []))).alias("p"), F.count("*").alias("c")).filter("c > 1")
        star = labelled.join(pivot, "x").filter((F.col("head") != F.col("p.head")) & _passes(F.col("n"), F.col("r"), F.col("p.n"), F.col("p.r")))
        if labels is not None:
            star = star.filter(F.col("label") != F.col("p.label"))
        star = star.select(F.col("p.head").alias("hub"), "head").distinct().join(members, "head").select("hub", F.col("node").alias("spoke"))
        fresh = scratch.stored(_unseen(star.distinct() if turn else star.unionByName(within).distinct(), done), "pairs")
        links = scratch.stored(_verified(scratch.stored(_bounded(fresh, names), "bounded"), names, sets), "links")
        done = fresh if done is None else done.unionByName(fresh)
        if labels is not None and links.isEmpty():
            break
        labels = _merged(labels, links, scratch)
    # Every pair of a bucket that still spans components.
    named = scratch.stored(_named(members, labels, "node"), "named")
    reach = named.groupBy("head").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    spans = postings.join(reach, "head").groupBy("x").agg(F.min("low").alias("low"), F.max("high").alias("high")).filter("low != high").select("x")
    at = scratch.stored(postings.join(spans, "x", "left_semi").join(named, "head").select("x", "n", "r", "node", "label", (F.ceil(3 * F.col("n") / 4) - 1).alias("past")), "open")
    # Nodes of two components share such shingles only, so no others are compared; a node has at most those of its prefix.
    # The order by place: all sets share it, so the first shared shingle of one is that of the other.
    ordered = F.transform(F.sort_array(F.collect_set(F.struct((F.col("n") - F.col("r")).alias("place"), "x"))), lambda p: p["x"])
    at = at.join(at.groupBy("node").agg(ordered.alias("post")), "node").join(names.select("node", "shared", "outline"), "node")
    # Both sides are one frame under two names, so that it is shuffled once.
    one, two = (lambda c: F.col(f"one.{c}")), (lambda c: F.col(f"two.{c}"))
    # A pair comes up once, in the bucket of its first shared shingle, where the position filter holds; what the outlines leave must be
    # enough, and so must the shingles shared within the prefixes and all that lies past the prefix.
    common, need = F.array_intersect(one("post"), two("post")), 3 * (one("n") + two("n"))
    enough = (one("label") < two("label")) & _passes(one("n"), one("r"), two("n"), two("r"))
    enough &= 7 * most_shared(one("outline"), one("shared"), two("outline"), two("shared")) >= need
    enough &= (F.get(common, F.lit(0)) == one("x")) & (7 * (F.size(common) + F.greatest(one("past"), two("past"))) >= need)
    rest = at.alias("one").join(at.alias("two"), one("x") == two("x")).filter(enough).select(one("node").alias("hub"), two("node").alias("spoke"))
    inside = named.join(named.select("head", F.col("node").alias("node2"), F.col("label").alias("label2")), "head").filter("label < label2")
    ends = [F.col("node").alias("hub"), F.col("node2").alias("spoke")]
    rest = rest.unionByName(_bounded(inside.select(*ends), names)).distinct()
    more = scratch.stored(_verified(scratch.stored(_unseen(rest, done), "pairs"), names, sets), "links")
    return labels if more.isEmpty() else _merged(labels, more, scratch)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for every component, with its own columns, and every row that is linked with none. Rows are told apart by
    their words, not by ids: of a component the class of least id (null ids last), then of least digest, and of that class's rows the
    one of least id stays; rows without words stay all."""
    _, classes = _grouped(docs, id_col, text_col)
    linked = classes.filter("label is not null")
    heads = linked.groupBy("label").agg(F.min(F.struct(F.col("rep").isNull().alias("last"), "rep", "node")).alias("h")).select(F.col("h.node").alias("node"))
    others = linked.select("node").join(heads, "node", "left_anti").select(F.col("node").alias("_node"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    text = F.coalesce(F.col(text_col), F.lit(""))
    order = F.struct(F.col(id_col).isNull().alias("last"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("text"))
    # One row of each class first, which copies reach the shuffle as; then a class has one row, however many copies it had.
    some = docs.filter(text.rlike(WORD)).select(row.alias("_row"), order.alias("_order"), node_of(text).alias("_node"))
    once = some.groupBy("_node").agg(F.min_by("_row", "_order").alias("_row")).join(others, "_node", "left_anti")
    return docs.filter(~text.rlike(WORD)).unionByName(once.select("_row.*"))
