"""How filters interact: what every filter removes in every order, and its Shapley value by the Hart-Mas-Colell potential.

The removal game's worth of a coalition of filters is the number of documents that fail at least one of them. A document counts only by the set
of filters it fails, so all that is kept per part is a count for each of the 32 sets. The potential of the empty coalition is 0 and of
another (worth + sum of the potentials of the coalitions with one filter less) / size; a filter's Shapley value is the grand coalition's
potential minus the potential without it. Potentials are kept times 120, where they are integers, which also is the sum over all orders. What a step
removes is the worth of the coalition with the filter less that without it; good and toxic documents have games of their own.

Filters, of a whole text: A under 50 words; B distinct words under 65 % of the words; C capitals A-Z over 5 % of the characters; D any of
#$%&*|; E a smaller doc_id has the same text.

Nulls and edges: a null text is the empty text (fails A only, and E as a copy of other empty ones); a null source is the part of the empty
string; a null doc_id is neither smaller than others nor larger, so it never fails E, and has no labels. Rows that repeat an id and its text
fail E alike. A label counts if any of the id's label rows has it. A part's rows come out whether a filter removes anything or not; an empty
table has no parts and gives no rows. Other columns aren't read, so their names can't clash. Very long texts are judged whole.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, stored, words

FILTERS = "ABCDE"
GRAND = (1 << len(FILTERS)) - 1
ORDERS = tuple("".join(p) for p in permutations(FILTERS))
GAMES = ("n", "good", "toxic")


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """Per row: doc_id, part, digest of the text, and mask, a bit for each filter but E that the text alone fails."""
    t = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    t = t.withColumn("_w", words(F.col("_t")))
    conditions = (
        F.size("_w") < 50,
        100 * F.size(F.array_distinct("_w")).cast("long") < 65 * F.size("_w").cast("long"),
        100 * F.length(F.regexp_replace("_t", "[^A-Z]+", "")).cast("long") > 5 * F.length("_t").cast("long"),
        F.col("_t").rlike("[#$%&*|]"),
    )
    mask = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(conditions)), F.lit(0))
    return t.select("doc_id", "part", F.substring(F.unhex(F.sha2("_t", 256)), 1, 16).alias("digest"), mask.alias("mask"))


def labelled(labels: DataFrame, id_col: str = "doc_id", good_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """One row per id that is good or toxic."""
    one = labels.select(F.col(id_col).cast("long").alias("_id"), *[F.coalesce(F.col(c) == 1, F.lit(False)).alias(g) for c, g in ((good_col, "good"), (toxic_col, "toxic"))]).filter("_id is not null and (good or toxic)")
    return one.groupBy("_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))


def profile(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic), stored: documents by the set of filters they fail, at most 32 rows a part. Tables written on the way are deleted.

    Texts are read once and don't travel. Both joins are of plainly shuffled rows, so that adaptive execution can split a hot text or id.
    """
    scratch = Scratch(docs.sparkSession)
    try:
        rows = scratch.stored(failures(docs), "failures")
        copies = rows.groupBy("digest").agg(F.min("doc_id").alias("_first"), F.count("*").alias("_n")).filter("_n > 1 and _first is not null")
        copies = scratch.stored(copies.select(F.col("digest").alias("_digest"), "_first"), "copies")
        known = scratch.stored(labelled(labels), "labelled")
        marked = rows.join(copies, F.col("digest") == F.col("_digest"), "left")
        copy = F.coalesce(F.col("doc_id") > F.col("_first"), F.lit(False))
        # Rows without an id have no labels; a random key of their own keeps them from meeting in one task.
        spread = F.when(F.col("doc_id").isNull(), F.xxhash64("digest", F.monotonically_increasing_id())).otherwise(0)
        marked = marked.select("part", (F.col("mask") + F.when(copy, 1 << FILTERS.index("E")).otherwise(0)).alias("mask"), "doc_id", spread.alias("_spread"))
        found = marked.join(known.withColumn("_zero", F.lit(0).cast("long")), (F.col("doc_id") == F.col("_id")) & (F.col("_spread") == F.col("_zero")), "left")
        counts = found.groupBy("part", "mask").agg(F.count("*").alias("n"), *[F.count_if(F.coalesce(g, F.lit(False))).alias(g) for g in GAMES[1:]])
        return stored(counts, "profile")
    finally:
        scratch.drop()


def worths(game: str) -> Column:
    """The worth of every coalition, by its number: documents that fail at least one of its filters. counts: an array of (mask, n, good, toxic)."""
    worth = lambda s: F.aggregate(F.filter("counts", lambda c: c["mask"].bitwiseAND(s) != 0), F.lit(0).cast("long"), lambda a, c: a + c[game])
    return F.transform(F.sequence(F.lit(0), F.lit(GRAND)), worth)


def potentials(worth: Column) -> Column:
    """120 times the potential of every coalition, by its number. Coalitions with one filter less have smaller numbers, so one pass in
    ascending order finds them done."""
    bits = F.array(*[F.lit(1 << i) for i in range(len(FILTERS))])
    less = lambda p, s: F.aggregate(F.filter(bits, lambda b: s.bitwiseAND(b) != 0), F.lit(0).cast("long"), lambda a, b: a + F.get(p, s - b))
    step = lambda p, s: F.array_append(p, F.call_function("div", len(ORDERS) * F.get(worth, s) + less(p, s), F.bit_count(s).cast("long")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(GRAND)), F.array(F.lit(0).cast("long")), step)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley."""
    counts = profile(docs, labels)
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", *GAMES)).alias("counts"))
    bits = [F.lit(1 << i) for i in range(len(FILTERS))]

    def total(holds: Callable[[Column], Column]) -> Column:
        return F.aggregate(F.filter("counts", lambda c: holds(c["mask"])), F.lit(0).cast("long"), lambda a, c: a + c["n"])

    def failing(bit: Column) -> Column:
        return total(lambda mask: mask.bitwiseAND(bit) != 0)

    def only(bit: Column) -> Column:
        return total(lambda mask: mask == bit)

    games = parts.select("part", *[worths(g).alias(g) for g in GAMES], total(lambda mask: mask >= 0).alias("all"), F.array(*map(failing, bits)).alias("failing"), F.array(*map(only, bits)).alias("only"))
    games = games.withColumn("potential", potentials(F.col("n")))
    bit = lambda letter: F.call_function("shiftleft", F.lit(1), F.ascii(letter) - ord(FILTERS[0]))
    steps = games.withColumn("filter_order", F.explode(F.array(*[F.lit(o) for o in ORDERS]))).select("*", F.posexplode(F.split("filter_order", "")).alias("_before", "_filter")).filter("_filter != ''")
    before = F.aggregate(F.slice(F.split("filter_order", ""), F.lit(1), F.col("_before")), F.lit(0), lambda s, x: s + bit(x))
    steps = steps.withColumns({"_s": before, "_bit": bit(F.col("_filter"))})
    own = lambda of: F.get(of, F.ascii("_filter") - ord(FILTERS[0]))
    gained = lambda of: F.get(of, F.col("_s") + F.col("_bit")) - F.get(of, F.col("_s"))
    return steps.select(
        "part",
        "filter_order",
        (F.col("_before") + 1).alias("step"),
        (F.col("all") - F.get("n", F.col("_s") + F.col("_bit"))).alias("kept"),
        gained("n").alias("removed"),
        (own("failing") - gained("n")).alias("redundant"),
        own("only").alias("unique_fails"),
        gained("good").alias("good_lost"),
        gained("toxic").alias("toxic_lost"),
        (F.get("potential", F.lit(GRAND)) - F.get("potential", GRAND - F.col("_bit"))).alias("shapley"),
    )
