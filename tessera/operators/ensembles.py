"""Retrieval in two stages: files are scored, chunks of the best are scored, both scores are fused, and chunks fill a token budget.

A point's candidates are a bounded list (3 * most_files files, per_file chunks each), so everything after the file scores works on rows that
no point has many of: normalising, the greedy fill, the removal of near copies and the assembly are folds over that list.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.operators import code, retrieval
from tessera.operators.retrieval import TOKEN_SETS, Similarity

#: strategy of the file scores, what a normalised score is where all are equal, whether chunks without a line are dropped as copies.
ENSEMBLES = {"tiers": ("bm25", 0.0, False), "boosted": ("boosted", 1.0, True)}
CHUNK_WEIGHT, FILE_WEIGHT = 0.6, 0.4
CHARS = 3.5  # characters a token
SCORE_DIGITS = 9


def cost(text: Column) -> Column:
    return C.token_estimates(text)["chars35"]


def fused(chunks: DataFrame, flat: float) -> DataFrame:
    """Adds total: chunk and file scores of a point's chunks, each brought to 0 to 1 and weighted. Where all are equal, each counts as flat."""
    w = Window.partitionBy("q")

    def unit(c: str) -> Column:
        span = F.max(c).over(w) - F.min(c).over(w)
        return F.when(span == 0, flat).otherwise(F.try_divide(F.col(c) - F.min(c).over(w), span))

    return chunks.withColumn("total", CHUNK_WEIGHT * unit("sim") + FILE_WEIGHT * unit("file_score"))


def filled(chunks: DataFrame, budget: int, most_files: int, drop_blank: bool, limit: float = 0.6) -> DataFrame:
    """(q, charged, files): the greedy fill of each point's chunks (q, path, file_score, text, total), best first (ties: greater path, then text).

    A chunk that would exceed the budget or open one file too many is passed over. Then each file's chunks lose those whose lines are nearly those
    of one before; what these were charged stays charged. files: structs (file_score, turn, path, text), text being the file's chunks.
    """
    item = F.struct("total", "path", "text", "file_score", cost(F.col("text")).cast("double").alias("cost"), C.long_lines(F.col("text"), 1).alias("lines"))
    listed = chunks.groupBy("q").agg(F.sort_array(F.collect_list(item), asc=False).alias("items"))  # a bounded list, see the module's text
    listed = listed.withColumn("fill", C.greedy_fill(F.transform("items", lambda x, i: F.struct(i.alias("pos"), x["path"].alias("file"), x["cost"].alias("cost"))), budget, most_files))
    listed = listed.withColumn("taken", F.transform("fill.taken", lambda i: F.get("items", i)))

    def file(path: Column, turn: Column) -> Column:
        own = F.filter("taken", lambda x: (x["path"] == path) & ((F.size(x["lines"]) > 0) | F.lit(not drop_blank)))
        kept = lambda x: F.transform(C.greedy_distinct(F.transform(x, lambda c: c["lines"]), limit), lambda i: F.get(x, i)["text"])
        score = F.filter("taken", lambda x: x["path"] == path)[0]["file_score"]
        return F.struct(score.alias("file_score"), turn.alias("turn"), path.alias("path"), C.bound(own, kept).alias("texts"))

    return listed.select("q", F.col("fill.used").cast("long").alias("charged"), F.transform("fill.files", file).alias("files"))


def assembled(fills: DataFrame, budget: int, worth: int = 200) -> DataFrame:
    """(q, n_files, n_chunks, charged, used, context): files by ascending score (ties: first chosen first), so that the best stand last."""
    n = F.aggregate("files", F.lit(0).cast("long"), lambda s, x: s + F.size(x["texts"]))
    parts = F.transform(F.sort_array("files"), lambda x: F.struct(x["path"].alias("path"), F.array_join(x["texts"], "\n...\n").alias("text")))
    made = fills.select("q", "charged", n.alias("n_chunks"), retrieval.within_budget(parts, budget, CHARS, worth, cost).alias("a"))
    return made.select("q", F.size("a.parts").cast("long").alias("n_files"), "n_chunks", "charged", "a.used", F.array_join("a.parts", "").alias("context"))


def ensemble_context(
    asks: DataFrame,
    files: DataFrame,
    recents: DataFrame,
    imports: DataFrame,
    anchors: DataFrame,
    ensemble: str = "tiers",
    chunk_lines: int = 40,
    per_file: int = 3,
    most_files: int = 5,
    budget: int = 14000,
    similarity: Similarity = TOKEN_SETS,
    cut: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """(q, n_files, n_chunks, charged, used, context) of every point that any file scores for.

    asks (q, repo, path, text, embedding_query), files (f, repo, path, text), recents (q, f), imports (q, path), anchors (q, anchor).
    tiers: recents 3 + half their BM25 over the greatest, imports 2, others BM25 over distance; boosted: BM25 over its 95th percentile, over
    distance, times 2 for recents or 1.5 for imports. File scores are rounded to SCORE_DIGITS, so that equal texts tie; of equal files the lesser
    path is first. cut gives a file's chunks; by default functions and classes of at most chunk_lines lines.

    Nulls and edges: a null or empty file has no chunks and can only enter whole, at no cost; a point whose repository holds no other file has no
    row; repeated recents, imports and files of one path count once for the score, and a file under two ids twice.
    """
    if ensemble not in ENSEMBLES:
        raise ValueError(f"unknown ensemble {ensemble!r}; known are {', '.join(ENSEMBLES)}")
    strategy, flat, drop_blank = ENSEMBLES[ensemble]
    files = files.withColumn("text", F.coalesce("text", F.lit("")))
    signals = retrieval.file_signals(asks, files, recents, imports, anchors=anchors)
    scored = retrieval.file_scores(signals, strategy).select("q", "f", "path", F.round("score", SCORE_DIGITS).alias("file_score"))
    few = retrieval.top(scored, "q", 3 * most_files, F.desc("file_score"), F.col("path")).drop("rank")
    queries = asks.select("q", F.col("embedding_query").alias("text"))
    chunks = retrieval.scored_chunks(few, files, queries, cut or (lambda lines: code.function_chunks(lines, chunk_lines)), per_file, similarity)
    return assembled(filled(fused(chunks, flat), budget, most_files, drop_blank), budget)


def point_context(points: DataFrame, files: DataFrame, recents: DataFrame, ensemble: str = "tiers", extension: str = ".py", **params) -> DataFrame:
    """ensemble_context of completion points (q, repo, path, prefix, suffix), whose query texts, imports and anchor come from the code around them."""
    texts = code.completion_texts(points, files, extension)
    imports = code.import_files(points, files, extension)
    query = texts.select("q", F.concat_ws("\n", "retrieval_prefix", "retrieval_suffix").alias("text"), "embedding_query")
    asks = points.select("q", "repo", "path").join(query, "q")
    return ensemble_context(asks, files, recents, imports, code.anchors(points, files, imports, extension), ensemble, **params)


def smart_context(points: DataFrame, files: DataFrame, candidates: DataFrame, asks: DataFrame, most_files: int = 4, per_file: int = 3, size: int = 30, budget: int = 6000, least: int = 2, similarity: Similarity = TOKEN_SETS) -> DataFrame:
    """(q, n_files, n_chunks, used, context): the best chunks over all of a point's candidate files, the files in the order they were first chosen.

    points (q, repo), files (f, repo, path, text), candidates (q, path, tier, pos): imports first (tier 0), then recents (tier 1), each in its order; a file named
    twice counts where it comes first. A point with fewer than ``least`` candidates gets the repository's other files behind them, by path.
    Only the first 4 * most_files candidates are read. A file without chunks adds nothing.

    Nulls and edges: candidates that name no file of the repository don't count; a point for which no chunk is chosen has no row.
    """
    known = files.join(points.select("q", "repo").distinct(), "repo").select("q", "f", "path")
    named = candidates.groupBy("q", "path").agg(F.min(F.struct("tier", "pos")).alias("at")).join(known, ["q", "path"]).select("q", "f", "path", F.col("at.tier").alias("tier"), F.col("at.pos").cast("long").alias("pos"))
    short = points.select("q").distinct().join(named.groupBy("q").agg(F.count("*").alias("n")), "q", "left").filter(F.coalesce("n", F.lit(0)) < least).select("q")
    pad = known.join(short, "q", "left_semi").join(named.select("q", "f"), ["q", "f"], "left_anti").select("q", "f", "path", F.lit(2).alias("tier"), F.lit(0).cast("long").alias("pos"))
    few = retrieval.top(named.unionByName(pad), "q", 4 * most_files, "tier", "pos", "path").select("q", "f", "path", F.col("rank").alias("place"))
    cut = lambda lines: F.transform(C.sliding_chunks(lines, size), lambda x: x["text"])
    best = retrieval.scored_chunks(few, files.withColumn("text", F.coalesce("text", F.lit(""))), asks, cut, per_file, similarity, whole=False)
    words = C.token_estimates(F.col("text"))["words_int"].cast("double")
    item = F.struct((-F.col("sim")).alias("s"), "place", "pos", "path", "text", words.alias("cost"))
    listed = best.groupBy("q").agg(F.sort_array(F.collect_list(item)).alias("items"))  # at most 4 * most_files * per_file
    listed = listed.withColumn("fill", C.greedy_fill(F.transform("items", lambda x, i: F.struct(i.alias("pos"), x["path"].alias("file"), x["cost"].alias("cost"))), budget, most_files))
    listed = listed.withColumn("taken", F.transform("fill.taken", lambda i: F.get("items", i)))
    blocks = F.transform("fill.files", lambda p: retrieval.block(p, F.array_join(F.transform(F.filter("taken", lambda t: t["path"] == p), lambda t: t["text"]), "\n...\n")))
    made = listed.select("q", F.size("fill.files").cast("long").alias("n_files"), F.size("taken").cast("long").alias("n_chunks"), F.col("fill.used").cast("long").alias("used"), F.array_join(blocks, "").alias("context"))
    return made.filter("n_chunks > 0")


def best_by_encoding(asks: DataFrame, files: DataFrame, similarity: Similarity, by: str = "repo") -> DataFrame:
    """(q, f, sim): the file of the point's group that is most similar to it (ties: least f). asks (q, by, text), files (f, by, text); ``text`` may be any
    column that the similarity prepares, vectors included. A point isn't compared with the file of its own id.

    Points are few beside files: each file's prepared text meets the points of its group, and only the best of each point is kept, on the map side too.
    """
    q = asks.select("q", F.col(by).alias("_by"), similarity.prepare(F.col("text")).alias("_q"))
    pairs = files.select("f", F.col(by).alias("_by"), similarity.prepare(F.col("text")).alias("_c")).join(q, "_by").filter("q != f")
    best = pairs.select("q", "f", (-similarity.compare(F.col("_q"), F.col("_c"))).alias("less")).groupBy("q").agg(F.min(F.struct("less", "f")).alias("b"))
    return best.select("q", "b.f", (-F.col("b.less")).alias("sim"))
