"""Importance resampling of documents towards a target text distribution, ranked by a distributed radix sort.

Features of a text are its words and pairs of neighbouring words, hashed into BUCKETS buckets. A bucket's gain compares its share in the
target with its share in all documents; a document's weight is the floored mean of its features' gains. Weights plus seeded Gumbel noise
are scores, and the highest scores are a draw without replacement in proportion to the weights.

Counts of the buckets are summed in each task and then over tasks; the gains, an array of BUCKETS integers, are all that goes to the tasks.

Ranks come from a least-significant-digit radix sort of (score descending, id ascending). Every pass takes one digit of at most DIGIT
bits and is a stable counting sort: blocks of neighbouring positions count their digits, sums over lower digits and over earlier blocks
of the same digit give each block's offset for a digit, and a row's new position is that offset plus its place among the block's rows of
that digit. Rows, counts and offsets stay distributed: the largest group is a block, or one digit's counts, and both have a bound that doesn't
depend on how keys are spread. Each pass is written and read again, so a lost executor repeats one pass at most.

Nulls and edges: null and empty texts have no features and weight 0; documents of fewer than MIN_WORDS words are scored, never drawn. A null
id is drawn like any other (its noise is that of the empty id), after equal scores with an id; rows of equal score and id keep the order in
which they were scored. Repeated rows are rows of their own. Very long texts are read in pieces. An empty table gives no rows; other columns
aren't read, so their names can't clash. An empty target gives every bucket the count 0.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

BUCKETS = 10_000
MIN_WORDS, SHARE, SEED = 20, 25, 7
DIGIT = 11
BLOCK_BITS = (12, 20)  # positions of a block: more where there are more rows
PIECE = 1 << 17  # bytes of a text that are split into words at once; features that are counted at once
_LETTERS = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c > 127 else 32 for c in range(256))
OUT = ("doc_id", "n_features", "weight", "score")


def features(text: str | None) -> Iterator[tuple[int, np.ndarray]]:
    """The text's words, counted, and the buckets of its features, piece by piece."""
    data = (text or "").encode("utf-8", "surrogatepass").lower().translate(_LETTERS)
    at, last = 0, None
    while at < len(data):
        end = data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        words, at = data[at:end].split(), end
        if words:
            ones = list(map(crc32, words))
            # A pair's checksum goes on from that of its first word.
            before = ones if last is None else [last, *ones]
            pairs = map(crc32, [b" " + w for w in (words[1:] if last is None else words)], before)
            last = ones[-1]
            yield len(words), np.array([*ones, *pairs], np.int64) % BUCKETS


def bucket_counts(texts: DataFrame) -> DataFrame:
    """(bucket, n) over all texts of the one column."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total, held, size = np.zeros(BUCKETS, np.int64), [], 0
        for batch in batches:
            for text in batch.column(0):
                for _, found in features(text.as_py()):
                    held.append(found)
                    size += len(found)
                    if size > PIECE:
                        total += np.bincount(np.concatenate(held), minlength=BUCKETS)
                        held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["bucket", "n"])

    return texts.mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame) -> np.ndarray:
    """The floored thousandfold log ratio of every bucket's smoothed shares; BUCKETS rows of each side come to the driver."""

    def counted(texts: DataFrame) -> list[int]:
        out = [0] * BUCKETS
        for bucket, n in bucket_counts(texts).collect():
            out[bucket] = n
        return out

    s, t = counted(raw), counted(target)
    all_s, all_t = float(sum(s) + BUCKETS), float(sum(t) + BUCKETS)
    return np.array([math.floor(1000 * math.log((b + 1) * all_s / ((a + 1) * all_t))) for a, b in zip(s, t, strict=True)], np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """Floored thousandfold Gumbel noise, fixed by the id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """docs (doc_id, text) with n_words, n_features, weight and score in place of the text."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                n_words = n = total = 0
                for words, found in features(text.as_py()):
                    n_words, n, total = n_words + words, n + len(found), total + int(gain[found].sum())
                weight = total // n if n else 0
                out.append((n_words, n, weight, weight + noise(doc_id)))
            columns = zip(*out, strict=True) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in columns]], ["doc_id", "n_words", *OUT[1:]])

    return docs.mapInArrow(run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint, score bigint")


def digits(key: Column, bits: int) -> list[Column]:
    """The digits of an unsigned key, lowest first, all of about the same width."""
    parts = -(-bits // DIGIT)
    cuts = [bits * i // parts for i in range(parts + 1)] if parts else []
    return [F.shiftrightunsigned(key, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).cast("int") for a, b in zip(cuts, cuts[1:], strict=False)]


def counting_pass(rows: DataFrame, digit: Column, block: Column, scratch: Scratch) -> DataFrame:
    """rows with pos replaced by the rows' places after a stable sort by digit; pos orders the rows of a block."""
    keyed, own = rows.withColumns({"_digit": digit, "_block": block}), Scratch(rows.sparkSession)
    try:
        counts = own.stored(keyed.groupBy("_digit", "_block").agg(F.count("*").alias("_n")), "counts")
        # One row per digit value, 2 ** DIGIT at most.
        base = counts.groupBy("_digit").agg(F.sum("_n").alias("_all")).select("_digit", (F.sum("_all").over(Window.orderBy("_digit")) - F.col("_all")).alias("_base"))
        earlier = F.sum("_n").over(Window.partitionBy("_digit").orderBy("_block")) - F.col("_n")
        offsets = counts.select("_digit", "_block", earlier.alias("_earlier")).join(base, "_digit").select("_digit", "_block", (F.col("_base") + F.col("_earlier")).alias("_offset"))
        place = F.row_number().over(Window.partitionBy("_block", "_digit").orderBy("pos")) - 1
        moved = keyed.withColumn("_place", place).join(offsets, ["_block", "_digit"]).withColumn("pos", F.col("_offset") + F.col("_place"))
        return scratch.stored(moved.select(*rows.columns), "pass")
    finally:
        own.drop()


def radix_sorted(rows: DataFrame) -> DataFrame:
    """rows (stored; with score, doc_id and any distinct pos) with pos counting from 0 by score descending, doc_id ascending, nulls last."""
    low, high, low_id, high_id, n, ids = rows.agg(F.min("score"), F.max("score"), F.min("doc_id"), F.max("doc_id"), F.count("*"), F.count("doc_id")).first()
    keys: list[Column] = []
    if ids:
        width = high_id - low_id
        # Beyond 63 bits the difference has no place in a long; the sign bit turned, the id itself is an unsigned key.
        key = F.col("doc_id") - F.lit(low_id) if width < 1 << 63 else F.col("doc_id").bitwiseXOR(F.lit(-(1 << 63)))
        keys += digits(F.coalesce(key, F.lit(0)), min(64, width.bit_length() if width < 1 << 63 else 64))
    if ids < n:
        keys.append(F.col("doc_id").isNull().cast("int"))
    if n:
        keys += digits(F.lit(high) - F.col("score"), (high - low).bit_length())
    keys = keys or [F.lit(0)]
    bits = max(BLOCK_BITS[0], min(BLOCK_BITS[1], n.bit_length() - 10))
    # At first positions have gaps, so blocks are drawn by hash; any order is right there, as later passes sort by the other digits.
    block, last = F.pmod(F.xxhash64("pos"), F.lit((n >> bits) + 1)), None
    for digit in keys:
        scratch = Scratch(rows.sparkSession)
        try:
            rows = counting_pass(rows, digit, block, scratch)
        except BaseException:
            scratch.drop()
            raise
        finally:
            if last is not None:
                last.drop()
        block, last = F.shiftright("pos", bits), scratch
    return rows


def resample(docs: DataFrame, target: DataFrame, share: int = SHARE, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of docs: share percent of the rows with MIN_WORDS words or more are drawn and
    ranked from 1 by score (ties: smaller id first); the others' rank is null."""
    own, scratch = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), Scratch(docs.sparkSession)
    gain = gains(own.select("text"), target.select(F.col(target_text_col)))
    rows = scratch.stored(scored(own, gain).withColumn("pos", F.monotonically_increasing_id()), "scored")
    able = rows.filter(F.col("n_words") >= MIN_WORDS)
    drawn = able.count() * share // 100
    ranked = radix_sorted(able.select(*OUT, "pos")).select(*OUT, F.when(F.col("pos") < drawn, F.col("pos") + 1).alias("rank"))
    return ranked.unionByName(rows.filter(F.col("n_words") < MIN_WORDS).select(*OUT, F.lit(None).cast("long").alias("rank")))
