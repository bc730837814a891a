"""Quality rules with risk-controlled cutoffs.

Every rule rejects a document whose feature exceeds a cutoff. Cutoffs are not guessed: for each stratum (language) one fixed sequence of
joint settings, from lenient to strict, is tested on labelled good documents that pass the base rule. Each setting tightens one rule by
one rung of its ladder, the rules in turn. The null hypothesis of a setting is that its rules together would reject more than
``false_rejection`` of the stratum's good documents; its p-value is the exact binomial tail. Settings are tested in order and the
sequence ends at the first that isn't rejected, so no setting needs a correction of its own; the strata share ``delta`` by Bonferroni. With
probability 1 - delta every stratum's setting rejects at most that share of the good documents that pass the base rule. As all rules stand in one
sequence, a stratum needs only as many labels as one test at that level does: some 230 where none is rejected.

Nulls and edges: a null text counts as empty; empty texts have no words and fail the base rule; a null or unknown language
belongs to the pooled stratum; labels with null quality or doc_id are ignored; if labels name a document twice, one good
label makes it good; copies of one text count once in the holdout. Where labels are too few to prove a setting, the rules are
off. Repeated rows are judged alike, each on its own row.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, stored, words

MIN_WORDS, MAX_REPEATED = 50, 50
POS_BITS = 20
STRATA = ("en", "fr", "de", "es")
POOLED = "other"
#: Ladders of cutoffs, lenient first. They don't depend on the data, as the test's guarantee asks.
LADDERS = {
    "symbols": tuple(round(0.60 * 0.85**i, 6) for i in range(20)),
    "dup_lines": tuple(round(0.95 - 0.045 * i, 6) for i in range(20)),
    "repeats": tuple(round(0.50 - 0.023 * i, 6) for i in range(20)),
    "word_length": tuple(round(60 * 0.9**i, 6) for i in range(20)),
}
OUT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: _id, _stratum, the counts of OUT and one ratio per rule (_r_<rule>); native expressions only.

    ``keep`` columns are packed into the struct _row, so that their names never clash.
    """
    top, low = F.lit(-(1 << POS_BITS)), F.lit((1 << POS_BITS) - 1)
    row = [F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row")] if keep else []
    t = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), F.when(F.col(lang_col).isin(*STRATA), F.col(lang_col)).otherwise(POOLED).alias("_stratum"), *row)
    carried = ["_id", "_stratum", *(["_row"] if keep else [])]
    w = t.select(
        *carried,
        words(F.col("_text")).alias("_w"),
        F.filter(F.split("_text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
        F.length(F.regexp_replace("_text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.xxhash64("_text").alias("_copy"),
    )
    word_at = lambda i: F.get("_w", i)
    kept = [*carried, "_copy", "n_symbols"]
    # 3-word windows, by hash first. Most texts have no two alike and are done. For the others the hash is packed with the
    # position into one long, which sorts as a primitive, and only windows that agree there with a neighbour are compared as
    # strings; a text with too many words for the packing compares all its windows.
    p = w.select(
        *kept,
        "_w",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.size("_lines").cast("long").alias("_n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("_w") >= 3, F.slice(F.transform("_w", lambda x, i: F.xxhash64(x, word_at(i + 1), word_at(i + 2))), F.lit(1), F.size("_w") - 2)).alias("_h"),
    )
    kept += ["n_words", "word_chars", "_n_lines", "n_dup_lines"]
    p = p.select(*kept, "_w", "_h", (F.size(F.array_distinct("_h")) < F.size("_h")).alias("_dups"))
    p = p.select(*kept, "_w", "_dups", F.when(F.col("_dups") & (F.size("_h") < (1 << POS_BITS)), F.sort_array(F.transform("_h", lambda h, i: h.bitwiseAND(top).bitwiseOR(i.cast("long"))))).alias("_packed"))
    c = p.select(*kept, "_w", "_dups", "_packed", F.array_compact(F.transform("_packed", lambda v, j: F.when(F.shiftrightunsigned(v.bitwiseXOR(F.get("_packed", j + 1)), POS_BITS) == 0, j))).alias("_pairs"))
    low_of = lambda j: F.get("_packed", j).bitwiseAND(low).cast("int")
    c = c.select(
        *kept,
        "_w",
        F.when(F.col("_pairs").isNotNull(), F.array_distinct(F.flatten(F.transform("_pairs", lambda j: F.array(low_of(j), low_of(j + 1))))))
        .when(F.col("_dups"), F.sequence(F.lit(0), F.size("_w") - 3))
        .otherwise(F.array().cast("array<int>"))
        .alias("_cand"),
    )
    s = c.select(*kept, F.sort_array(F.transform("_cand", lambda i: F.struct(F.concat_ws(" ", word_at(i), word_at(i + 1), word_at(i + 2)).alias("k"), i.alias("p")))).alias("_cand"))
    same = lambda v, j: v["k"].eqNullSafe(F.get("_cand", j)["k"])
    r = s.select(*kept, F.transform(F.filter("_cand", lambda v, j: same(v, j - 1) | same(v, j + 1)), lambda v: v["p"]).alias("_pos"))
    r = r.select(*kept, F.size(F.array_distinct(F.flatten(F.transform("_pos", lambda i: F.array(i, i + 1, i + 2))))).cast("long").alias("n_repeat_words"))
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return r.select(
        *carried,
        "_copy",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))).alias("base_failed"),
        share("n_symbols", "word_chars").alias("_r_symbols"),
        share("n_dup_lines", "_n_lines").alias("_r_dup_lines"),
        share("n_repeat_words", "n_words").alias("_r_repeats"),
        share("word_chars", "n_words").alias("_r_word_length"),
    )


def log_gamma(x: Column) -> Column:
    """ln(gamma(x)) for x >= 1 as a Spark expression: Stirling's series at x + 7, then the recurrence back."""
    z = x + 7.0
    series = 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    return (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + series - reduce(add, [F.ln(x + float(i)) for i in range(7)])


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), exact to double precision; 1 where k >= n * p, as no test rejects there.

    The sum runs from the term of k downwards, where each term is smaller than the one before; terms further than
    40 sqrt(n) + 50 from it are below a double's precision.
    """
    k, n = k.cast("double"), n.cast("double")
    first = F.exp(log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
    steps = F.sequence(F.lit(0), F.least(k, F.ceil(40 * F.sqrt(n)) + 50).cast("int"))
    zero = F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum"))
    fold = lambda a, i: F.struct((a["term"] * (k - i) / (n - k + i + 1) * ((1 - p) / p)).alias("term"), (a["sum"] + a["term"]).alias("sum"))
    return F.when(k >= n * p, 1.0).otherwise(F.least(F.lit(1.0), first * F.aggregate(steps, zero, fold, lambda a: a["sum"])))


def cutoffs(feats: DataFrame, labels: DataFrame, false_rejection: float = 0.02, delta: float = 0.05, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """feats: stored features, as a filter on computed ones would be pushed below and compute them anew. One row per stratum with a proven
    setting: _stratum and _c_<rule>, the rule's cutoff in it or null.

    At most len(STRATA) + 1 rows, whatever the input. Before grouping, the labelled rows shrink to counts per stratum and setting.
    """
    level, rules, rungs = delta / (len(STRATA) + 1), list(LADDERS), len(next(iter(LADDERS.values())))
    good = labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_good")).filter("_id is not null and _good is not null").groupBy("_id").agg(F.max("_good").alias("_good")).filter("_good = 1")

    def first(i: int, rule: str) -> Column:
        """The first setting at which the rule rejects a document: it exceeds the cutoffs of its m strictest rungs."""
        m = F.size(F.filter(F.array(*[F.lit(c) for c in LADDERS[rule]]), lambda c: F.col(f"_r_{rule}") > c))
        return F.when(m > 0, (rungs - m) * len(rules) + i)

    never = len(rules) * rungs
    setting = F.coalesce(F.least(*[first(i, r) for i, r in enumerate(rules)]), F.lit(never)).alias("setting")
    held = feats.filter(~F.col("base_failed")).select("_id", "_stratum", "_copy", setting).join(good, "_id", "left_semi").drop("_id").dropDuplicates(["_stratum", "_copy"])
    counts = held.groupBy("_stratum", "setting").agg(F.count("*").alias("n"))
    totals = counts.groupBy("_stratum").agg(F.sum("n").alias("total")).withColumn("setting", F.explode(F.sequence(F.lit(0), F.lit(never - 1))))
    upto = Window.partitionBy("_stratum").orderBy("setting")
    tested = totals.join(counts, ["_stratum", "setting"], "left").withColumn("k", F.sum(F.coalesce("n", F.lit(0))).over(upto)).withColumn("p", binomial_tail(F.col("k"), F.col("total"), false_rejection))
    proven = tested.withColumn("worst", F.max("p").over(upto)).filter(F.col("worst") <= level).groupBy("_stratum").agg(F.max("setting").alias("last"))
    rung = lambda i: F.floor((F.col("last") - i) / len(rules)).cast("int")
    return proven.select("_stratum", *[F.get(F.array(*[F.lit(c) for c in LADDERS[r]]), rung(i)).alias(f"_c_{r}") for i, r in enumerate(rules)])


def judge(feats: DataFrame, cuts: DataFrame) -> DataFrame:
    """Adds kept (boolean) and failed_rules (array of rule names, base first) to the features."""
    broken = F.array_compact(F.array(F.when(F.col("base_failed"), "base"), *[F.when(F.col(f"_r_{r}") > F.col(f"_c_{r}"), r) for r in LADDERS]))
    joined = feats.join(F.broadcast(cuts), "_stratum", "left").withColumn("failed_rules", broken)
    return joined.withColumn("kept", F.size("failed_rules") == 0)


def assess(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, failed_rules for every row of docs; see the module's text."""
    feats = stored(features(docs), "quality")
    return judge(feats, cutoffs(feats, labels, **params)).select(F.col("_id").alias("doc_id"), *OUT, "kept", "failed_rules")


def keep_good(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """The rows of docs that are kept, with their own columns. Texts are never shuffled; features are computed twice instead."""
    columns = tuple(docs.columns)
    cuts = cutoffs(stored(features(docs), "quality"), labels, **params)
    judged = judge(features(docs, keep=columns), cuts)
    return judged.filter(F.when(F.col("kept"), True).otherwise(False)).select("_row.*")
