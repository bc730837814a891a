"""Source code around a completion point: imports and the files they name, scopes, prefixes and suffixes, chunks by function.

Points are rows (q, repo, prefix, suffix), files rows (repo, path). Imports meet files by an equi-join on repository and path, so no point
carries its repository's list of files.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import columns as C

# What opens a scope that ends the climb, and what opens a top-level block.
STRONG = ("def ", "async def ", "class ", "for ", "while ", "with ")
TOP = ("def ", "async def ", "class ")
BRACKETS = r"^[\s}\)\]:,;]*$"


def starts(line: Column, words: tuple[str, ...]) -> Column:
    return line.rlike("^(" + "|".join(words) + ")")


def is_import(line: Column) -> Column:
    return starts(C.strip(line), ("import ", "from "))


def module_name(line: Column) -> Column:
    """First part of the module an import line names; null for other lines. Of several modules the first counts."""
    s = C.strip(line)
    word = F.regexp_extract(s, r"^(?:from|import) +([^\s]+)", 1)
    name = F.rtrim(F.split(word, r"\.")[0], F.lit(","))
    return F.when(is_import(line) & (word != ""), name)


def _last_scope(lines: Column, cursor: Column) -> Column:
    """Index of the line that opens the scope of lines[cursor]: upwards, a line of less indentation that ends in a colon is the scope so far;
    a strong one ends the climb. 0 if there is none."""
    zero = F.struct(C.indentation(F.get(lines, cursor)).alias("indent"), F.lit(0).alias("start"), F.lit(False).alias("done"))

    def step(s: Column, i: Column) -> Column:
        line = F.get(lines, i)
        bare, indent = C.strip(line), C.indentation(line)
        opens = ~s["done"] & (bare != "") & (indent < s["indent"]) & bare.endswith(":")
        return F.when(opens, F.struct(indent.alias("indent"), i.alias("start"), starts(bare, STRONG).alias("done"))).otherwise(s)

    above = F.when(cursor > 0, F.reverse(F.sequence(F.lit(0), cursor - 1))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(above, zero, step, lambda s: s["start"])


def retrieval_suffix(suffix: Column) -> Column:
    """Nothing of a suffix that only closes brackets."""
    return F.when(C.strip(suffix).rlike(BRACKETS), "").otherwise(suffix)


def suffix_of(suffix: Column, mode: str = "filtered") -> Column:
    """filtered: nothing of a suffix that only closes brackets; none: nothing; full: all of it."""
    if mode not in ("filtered", "none", "full"):
        raise ValueError(f"unknown mode {mode!r}; known are filtered, none, full")
    return {"filtered": retrieval_suffix(suffix), "none": F.when(suffix.isNotNull(), ""), "full": suffix}[mode]


def suffix_head(suffix: Column, limit: int = 10) -> Column:
    """The first lines of a suffix."""
    return F.array_join(F.slice(C.lines(suffix), F.lit(1), F.lit(limit)), "\n")


def _tail(lines: Column, limit: int) -> Column:
    return F.when(F.size(lines) > limit, F.slice(lines, F.size(lines) - limit + 1, F.lit(limit))).otherwise(lines)


def _at_margin(line: Column) -> Column:
    """Whether an import stands at the margin."""
    return line.startswith("import ") | line.startswith("from ")


def submission_prefix(prefix: Column, mode: str = "smart", limit: int = 10) -> Column:
    """full: the prefix as it is; simple: its last lines; smart: the import lines at the margin and the last lines, each line once. A prefix of
    no more lines than the limit stays as it is."""
    if mode not in ("full", "simple", "smart"):
        raise ValueError(f"unknown mode {mode!r}; known are full, simple, smart")
    if mode == "full":
        return prefix
    simple = lambda x: _tail(x, limit)
    smart = lambda x: F.array_distinct(F.concat(F.filter(x, _at_margin), _tail(x, limit)))
    cut = lambda x: F.when(F.size(x) <= limit, prefix).otherwise(F.array_join((simple if mode == "simple" else smart)(x), "\n"))
    return C.bound(C.lines(prefix), cut)


def plain_query(prefix: Column, suffix: Column, limit: int = 20) -> Column:
    """The last code lines (imports at the margin left out) and the filtered suffix."""
    code = C.bound(F.filter(C.lines(prefix), lambda x: ~_at_margin(x)), lambda x: F.array_join(_tail(x, limit), "\n"))
    return C.strip(F.concat(code, F.lit("\n"), suffix_of(suffix)))


def submission_suffix(suffix: Column, limit: int = 20) -> Column:
    """The first lines from the first one with content on; where none has, from the start."""
    lines = C.lines(suffix)
    content = F.array_position(F.transform(lines, lambda x: (C.strip(x) != "") & ~x.rlike(BRACKETS)), True)
    return F.array_join(F.slice(lines, F.greatest(content.cast("int"), F.lit(1)), F.lit(limit)), "\n")


def python_imports(points: DataFrame) -> DataFrame:
    """(q, repo, module, plain) of the modules a prefix imports by its syntax tree; a prefix that doesn't parse has none."""

    def run(batches: Iterator) -> Iterator:
        import ast
        import warnings

        import pandas as pd

        warnings.simplefilter("ignore", SyntaxWarning)
        for pdf in batches:
            out = []
            for q, repo, prefix in zip(pdf["q"], pdf["repo"], pdf["prefix"], strict=True):
                try:
                    nodes = list(ast.walk(ast.parse(prefix or "")))
                except (SyntaxError, ValueError, RecursionError):
                    continue
                found = {(n.module, False) for n in nodes if isinstance(n, ast.ImportFrom) and n.module}
                found |= {(a.name, True) for n in nodes if isinstance(n, ast.Import) for a in n.names}
                out += [(q, repo, m, plain) for m, plain in sorted(found)]
            yield pd.DataFrame(out, columns=["q", "repo", "module", "plain"])

    return points.select("q", "repo", "prefix").mapInPandas(run, "q bigint, repo string, module string, plain boolean")


def import_files(points: DataFrame, files: DataFrame, extension: str = ".py") -> DataFrame:
    """(q, path), distinct: the file of every imported module; of a from-import that has no file the package's __init__."""
    at = F.replace("module", F.lit("."), F.lit("/"))
    named = python_imports(points).select("q", "repo", "module", F.posexplode(F.array_compact(F.array(F.concat(at, F.lit(extension)), F.when(~F.col("plain"), F.concat(at, F.lit("/__init__" + extension)))))).alias("turn", "path"))
    found = named.join(files.select("repo", "path").distinct(), ["repo", "path"])
    return found.groupBy("q", "module").agg(F.min_by("path", "turn").alias("path")).select("q", "path").distinct()


def local_lines(points: DataFrame, files: DataFrame, extension: str = ".py") -> DataFrame:
    """(q, local): the import lines of the prefix, in order, whose module is a file or package of the repository."""
    lines = points.select("q", "repo", F.posexplode(F.filter(C.lines(F.col("prefix")), is_import)).alias("pos", "line"))
    name = module_name(F.col("line"))
    dotted = F.when(C.strip(F.col("line")).startswith("from "), F.regexp_extract(C.strip(F.col("line")), r"^from +([^\s]+)", 1))
    paths = F.array_compact(F.array(F.concat(name, F.lit(extension)), F.concat(name, F.lit("/__init__" + extension)), F.concat(F.replace(dotted, F.lit("."), F.lit("/")), F.lit(extension))))
    known = lines.withColumn("path", F.explode(paths)).join(files.select("repo", "path").distinct(), ["repo", "path"], "left_semi").select("q", "pos", "line").distinct()
    return known.groupBy("q").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]).alias("local"))


def completion_texts(points: DataFrame, files: DataFrame, extension: str = ".py", above: int = 8, suffix_lines: int = 10, limit: int = 20, all_imports: bool = False) -> DataFrame:
    """(q, retrieval_prefix, retrieval_suffix, embedding_query, submission_prefix, submission_suffix) of every point.

    Retrieval: local imports and the last code lines (all_imports: every import, and the last of all lines). Embedding: lines above the
    scope, the scope to the cursor, the suffix's first lines. Submission: local imports and the last top-level block, or the last code lines.
    """
    none = F.array().cast("array<string>")
    p = points.select("q", C.lines(F.coalesce("prefix", F.lit(""))).alias("lines"), retrieval_suffix(F.coalesce("suffix", F.lit(""))).alias("rs"), submission_suffix(F.coalesce("suffix", F.lit("")), limit).alias("ss"))
    p = p.join(local_lines(points, files, extension), "q", "left").withColumn("local", F.coalesce("local", none))
    p = p.withColumn("code", F.filter("lines", lambda x: ~is_import(x))).withColumn("imports", F.filter("lines", is_import))
    p = p.withColumn("n", F.size("code")).withColumn("bare", F.transform("code", C.strip)).withColumn("flat", F.transform("code", C.indentation))
    p = p.withColumn("cursor", F.coalesce(F.array_max(F.transform("bare", lambda x, i: F.when(x != "", i))), F.lit(0)))
    tops = F.array_max(F.zip_with(F.transform("bare", lambda x, i: F.when(starts(x, TOP), i)), F.col("flat"), lambda i, w: F.when(w == 0, i)))
    p = p.withColumn("scope", F.when(F.col("n") > 0, _last_scope(F.col("code"), F.col("cursor"))).otherwise(0)).withColumn("top", tops)
    last = lambda x: F.when(F.size(x) > limit, F.slice(x, F.size(x) - limit + 1, F.lit(limit))).otherwise(x)
    joined = lambda *x: F.array_join(F.array_distinct(F.concat(*x)), "\n")
    retrieval = joined(F.col("imports"), last(F.col("lines"))) if all_imports else joined(F.col("local"), last(F.col("code")))
    start = F.greatest(F.col("scope") - above, F.lit(0))
    head = F.array_join(F.slice("code", start + 1, F.col("scope") - start), "\n")
    body = F.array_join(F.slice("code", F.col("scope") + 1, F.col("cursor") - F.col("scope") + 1), "\n")
    tail = F.array_join(F.slice(C.lines(F.col("rs")), F.lit(1), F.lit(suffix_lines)), "\n")
    query = F.when(F.col("n") == 0, tail).otherwise(C.strip(F.array_join(F.filter(F.array(head, body, tail), lambda x: C.strip(x) != ""), "\n")))
    block = F.when(F.col("top").isNotNull(), F.slice("code", F.col("top") + 1, F.col("n"))).otherwise(last(F.col("code")))
    submission = F.when(F.col("n") == 0, F.array_join("local", "\n")).otherwise(joined(F.col("local"), block))
    return p.select("q", retrieval.alias("retrieval_prefix"), F.col("rs").alias("retrieval_suffix"), query.alias("embedding_query"), submission.alias("submission_prefix"), F.col("ss").alias("submission_suffix"))


def anchors(points: DataFrame, files: DataFrame, imports: DataFrame, extension: str = ".py") -> DataFrame:
    """(q, anchor) where one is found: a file of the repository that a comment in the first five lines names, else the imported file of least
    mean distance to the other imported ones (ties to the lesser path)."""
    head = F.slice(C.lines(F.col("prefix")), F.lit(1), F.lit(5))
    hints = points.select("q", "repo", F.posexplode(head).alias("row", "line")).withColumn("line", C.strip(F.col("line"))).filter(F.col("line").startswith("#") & (F.col("line").contains(extension) | F.col("line").contains("path:")))
    hints = hints.select("q", "repo", "row", F.posexplode(F.split("line", r"\s+")).alias("col", "word")).filter(F.col("word").endswith(extension) & ~F.col("word").startswith("#")).withColumn("path", F.ltrim("word", F.lit("/")))
    hinted = hints.join(files.select("repo", "path").distinct(), ["repo", "path"]).groupBy("q").agg(F.min_by("path", F.struct("row", "col")).alias("hint"))
    pair = imports.select("q", "path").join(imports.select("q", F.col("path").alias("other")), "q")
    apart = pair.groupBy("q", "path").agg(F.avg(F.when(F.col("path") != F.col("other"), C.path_distance(F.col("path"), F.col("other")))).alias("mean"))
    middle = apart.groupBy("q").agg(F.min_by("path", F.struct("mean", "path")).alias("middle"))
    return points.select("q").join(hinted, "q", "left").join(middle, "q", "left").select("q", F.coalesce("hint", "middle").alias("anchor")).filter("anchor is not null")


def function_chunks(lines: Column, most: int = 60, least: int = 5) -> Column:
    """Chunk texts of a file's lines, cut where a function, a class or a decorator above one begins, at least so many lines apart. A shorter
    part joins the chunk before it (the first is dropped); a longer one is cut every so many lines; with one part only, sliding windows."""
    bare = lambda i: C.strip(F.get(lines, i))
    opens = lambda i: starts(bare(i), TOP) | (bare(i).startswith("@") & F.coalesce(starts(bare(i + 1), TOP), F.lit(False)))
    n = F.size(lines)
    spots = F.when(n > 1, F.filter(F.sequence(F.lit(1), n - 1), opens)).otherwise(F.array().cast("array<int>"))
    cuts = F.aggregate(spots, F.array(F.lit(0)), lambda a, i: F.when(i - F.element_at(a, -1) >= least, F.concat(a, F.array(i))).otherwise(a))
    text = lambda a, k: F.array_join(F.slice(lines, a + 1, k), "\n")

    def chunks(c: Column) -> Column:
        ends = F.concat(F.slice(c, F.lit(2), F.size(c)), F.array(n))

        def step(done: Column, part: Column) -> Column:
            a, size = part["a"], part["b"] - part["a"]
            starts_at = F.when(size > most, F.sequence(a, part["b"] - 1, F.lit(most))).otherwise(F.array(a))
            whole = F.filter(F.transform(starts_at, lambda j: text(j, F.least(F.lit(most), part["b"] - j))), lambda t: C.strip(t) != "")
            short = F.when(F.size(done) > 0, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.concat(F.element_at(done, -1), F.lit("\n"), text(a, size))))).otherwise(done)
            return F.when(size < least, short).otherwise(F.concat(done, whole))

        return F.aggregate(F.zip_with(c, ends, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), F.array().cast("array<string>"), step)

    sliding = F.transform(C.sliding_chunks(lines, most), lambda x: x["text"])
    return F.transform(F.array(cuts), lambda c: F.when(F.size(c) > 1, chunks(c)).otherwise(sliding))[0]
