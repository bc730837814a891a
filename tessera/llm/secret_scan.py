"""Secret scans: fixed patterns, then character Markov models of random strings against ordinary identifiers.

Spans are (kind, start, end) in code points, end exclusive. Three kinds come from patterns (fixed values below). The fourth,
markov, takes runs of 16 or more identifier characters whose mean log-likelihood ratio per character pair, random string
against ordinary identifier, exceeds a cutoff. Both models are first-order chains over the same alphabet, which fall back to
single characters' shares (add-one smoothing) where pairs are rare. Labelled samples are all of the corpus: values found by
the patterns are random strings; runs of 8 or more characters that no pattern's span touches are ordinary identifiers.
The cutoff is set on the quarter of the runs (by hash) that the models scoring them have not seen; the final models see all. It
lets through MOST_FALSE of the ordinary runs, unless that would miss more than MOST_MISSED of the patterns' values: then
(some of the unlabelled runs are secrets themselves, or the two sides overlap) the misses decide. It is never below 0, where
both models are equally likely. Pattern spans are cut out of a run and what remains on either side is judged. A run that
does not exceed the cutoff as a whole (a path with a random key, say) is judged by windows of 16 characters; windows that do are joined
and widened to the next of / _ = - or the run's end.

Nulls and edges: a null or empty text has no spans; without any pattern hit the random model is uniform; an empty table gives
an empty result; repeated rows each get their own result. Main path: DataFrame expressions only.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds in their order, patterns, group that carries the value, least length of that group.
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
MIN_ASSIGN = 6

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
N = len(ALPHABET)
RUN = "[A-Za-z0-9+/_=-]"
MIN_RUN, MIN_ORDINARY = 16, 8
BACK_OFF = 16
MOST_FALSE, MOST_MISSED = 0.01, 0.05
BINS = 100  # of a unit of score, for the cutoff
MASK = "[SECRET]"
MARK = "\x01"
BLOCK = 256

_SPAN = "array<struct<start:bigint,k:int,end:bigint,kind:string,value:string>>"


def _let(x: Column, f) -> Column:
    """f of x, with x computed once."""
    return F.transform(F.array(x), f)[0]


def _spans(text: Column, pattern: str, kind: str, value: Column | None = None) -> Column:
    """All leftmost non-overlapping matches with their places: the texts between matches and the matches alternate. Places are summed
    up within blocks of BLOCK matches, then over the blocks, so that many matches don't copy a long list each."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    values = found if value is None else value
    pieces = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(found)).alias("gap"), found.alias("hit"), values.alias("value"))
    start = lambda a, x: a["at"] + F.length(x["gap"])
    one = lambda a, x: F.array(F.struct(start(a, x).alias("start"), F.lit(KINDS.index(kind)).alias("k"), (start(a, x) + F.length(x["hit"])).alias("end"), F.lit(kind).alias("kind"), x["value"].alias("value")))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(_SPAN).alias("spans"))
    step = lambda a, x: F.struct((start(a, x) + F.length(x["hit"])).alias("at"), F.concat(a["spans"], one(a, x)).alias("spans"))
    blocks = _let(pieces, lambda p: F.transform(F.sequence(F.lit(0), F.size(p), F.lit(BLOCK)), lambda i: F.aggregate(F.slice(p, i + 1, F.lit(BLOCK)), zero, step)))
    moved = lambda a, b: F.transform(b["spans"], lambda x: F.struct((a["at"] + x["start"]).alias("start"), x["k"].alias("k"), (a["at"] + x["end"]).alias("end"), x["kind"].alias("kind"), x["value"].alias("value")))
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{_SPAN}>").alias("all"))
    return F.aggregate(blocks, begin, lambda a, b: F.struct((a["at"] + b["at"]).alias("at"), F.concat(a["all"], F.array(moved(a, b))).alias("all")), lambda a: F.flatten(a["all"]))


def _if(condition: Column, spans: Column) -> Column:
    return F.when(condition, spans).otherwise(F.array().cast(_SPAN))


def with_base(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """_id, _text and _base: the patterns' spans by start, then kind. ``keep`` columns are packed into the struct _row."""
    row = [F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row")] if keep else []
    carried = ["_id", "_text", *(["_row"] if keep else [])]
    t = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), *row)
    text = F.col("_text")
    s = t.select(
        *carried,
        _if((text.contains("=") | text.contains(":")) & text.rlike(ASSIGN), _spans(text, ASSIGN, "assign", F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(1)))).alias("_assign"),
        _if(text.contains("AKIA") & text.rlike(ACCESS), _spans(text, ACCESS, "access")).alias("_access"),
        _if(text.rlike(HEX), _spans(text, HEX, "hex")).alias("_hex"),
    )
    enough = F.filter("_assign", lambda x: F.length(x["value"]) >= MIN_ASSIGN)
    return s.select(*carried, F.sort_array(F.concat(enough, "_access", "_hex")).alias("_base"))


def _replaced(text: Column, spans: Column, fill) -> Column:
    """The text with fill(at, span) in place of every span; at is where the spans before it end, so that overlapping ones can be told.

    Spans are taken in blocks of BLOCK: a block's stretch of the text is cut out once, and its parts are cut from that, so the work is the text's
    length per block, not per span.
    """

    def piece(part: Column, base: Column, block: Column) -> Column:
        zero = F.struct(base.alias("at"), F.array().cast("array<string>").alias("out"))
        kept = lambda a, s: F.substr(part, (a["at"] - base + 1).cast("int"), F.greatest(s["start"] - a["at"], F.lit(0)).cast("int"))
        step = lambda a, s: F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.concat(a["out"], F.array(kept(a, s), fill(a["at"], s))).alias("out"))
        return F.aggregate(block, zero, step, lambda a: F.array_join(a["out"], ""))

    def step(a: Column, block: Column) -> Column:
        end = F.greatest(a["at"], F.array_max(F.transform(block, lambda s: s["end"])))
        part = F.substr(text, (a["at"] + 1).cast("int"), (end - a["at"]).cast("int"))
        return F.struct(end.alias("at"), F.concat(a["out"], F.array(_let(part, lambda p: piece(p, a["at"], block)))).alias("out"))

    blocks = F.when(F.size(spans) > 0, F.transform(F.sequence(F.lit(0), F.size(spans) - 1, F.lit(BLOCK)), lambda i: F.slice(spans, i + 1, F.lit(BLOCK)))).otherwise(F.array().cast(f"array<{_SPAN}>"))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(blocks, zero, step, lambda a: F.array_join(F.concat(a["out"], F.array(F.substr(text, (a["at"] + 1).cast("int"), F.length(text)))), ""))


def _without(text: Column, spans: Column) -> Column:
    """The text with blanks in place of the spans, so that all other places stay."""
    return _replaced(text, spans, lambda at, s: F.rpad(F.lit(""), F.greatest(s["end"] - F.greatest(s["start"], at), F.lit(0)).cast("int"), F.lit(" ")))


def _pairs(runs: DataFrame) -> DataFrame:
    """(random, held, pair) rows, a pair of adjacent characters each."""
    pairs = _let(F.split("run", ""), lambda c: F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c) - 1), lambda a, b: F.concat(a, b)))
    return runs.filter(F.length("run") >= 2).select("random", "held", F.explode(pairs).alias("pair"))


def _labelled(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(random, run): the patterns' values and, outside of them, runs of ordinary identifiers; of all rows, in one pass."""
    based = with_base(docs, id_col, text_col)
    # A run that a pattern's span is part of is no ordinary identifier: spans leave a mark, and runs beside a mark don't count.
    marked = F.when(F.size("_base") > 0, _replaced(F.col("_text"), F.col("_base"), lambda at, s: F.lit(MARK))).otherwise(F.col("_text"))
    beside = RUN.replace("[", "[" + MARK)
    free = F.regexp_extract_all(marked, F.lit(f"(?<!{beside}){RUN}{{{MIN_ORDINARY},}}+(?!{MARK})"), F.lit(0))
    of = lambda runs, random: F.transform(runs, lambda r: F.struct(F.lit(random).alias("random"), r.alias("run")))
    return based.select(F.explode(F.concat(of(F.col("_base.value"), True), of(free, False))).alias("x")).select("x.random", "x.run")


def _cutoff(counts: dict[bool, dict[int, int]]) -> float:
    """The cutoff from the number of values (True) and of ordinary runs (False) by score bin."""

    def least(bins: dict[int, int], share: float) -> int | None:
        """The least bin with at most this share of all above it."""
        above, all_ = 0, sum(bins.values())
        for b in sorted(bins, reverse=True):
            above += bins[b]
            if above > share * all_:
                return b
        return None

    false, missed = least(counts[False], MOST_FALSE), least(counts[True], 1 - MOST_MISSED)
    # The upper end of the ordinary runs' bin, the lower end of the values' bin.
    ends = ([(false + 1) / BINS] if false is not None else []) + ([missed / BINS] if missed is not None else [])
    return max(0.0, min(ends, default=0.0))


def _held_out(run: Column) -> Column:
    return F.pmod(F.xxhash64(run, F.lit(3)), F.lit(4)) == 0


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[float], float]:
    """The log-likelihood ratios of N x N character pairs, row by row, and the cutoff. Both have a fixed size."""
    labelled = _labelled(docs, id_col, text_col)
    seen = {True: Counter(), False: Counter()}
    every = {True: Counter(), False: Counter()}
    pairs = _pairs(labelled.withColumn("held", _held_out(F.col("run")))).filter(F.col("pair").rlike(f"^{RUN}{{2}}$"))
    for r in pairs.groupBy("random", "held", "pair").count().toLocalIterator():  # at most 4 * N * N rows
        every[r["random"]][r["pair"]] += r["count"]
        if not r["held"]:
            seen[r["random"]][r["pair"]] += r["count"]

    def logs(c: dict) -> list[float]:
        ends = {b: sum(c.get(a + b, 0) for a in ALPHABET) for b in ALPHABET}
        alone = {b: (ends[b] + 1) / (sum(ends.values()) + N) for b in ALPHABET}
        starts = {a: sum(c.get(a + b, 0) for b in ALPHABET) for a in ALPHABET}
        return [math.log((c.get(a + b, 0) + BACK_OFF * alone[b]) / (starts[a] + BACK_OFF)) for a in ALPHABET for b in ALPHABET]

    ratios = lambda c: [round(x - y, 6) for x, y in zip(logs(c[True]), logs(c[False]), strict=True)]
    apart = labelled.filter((F.length("run") >= MIN_RUN) & _held_out(F.col("run")))
    bins = apart.select("random", F.floor(BINS * score(F.col("run"), ratios(seen))).alias("bin"))
    found = {True: {}, False: {}}
    for r in bins.groupBy("random", "bin").count().toLocalIterator():  # scores are bounded, so are their bins
        found[r["random"]][r["bin"]] = r["count"]
    return ratios(every), _cutoff(found)


def score(run: Column, ratios: list[float]) -> Column:
    """Mean log-likelihood ratio of a run's character pairs, in one walk over its characters. The table is one folded constant of N * N numbers."""
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<double>")
    codes = F.transform(F.split(run, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    pairs = _let(codes, lambda c: F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c) - 1), lambda a, b: F.coalesce(F.get(table, a * N + b), F.lit(0.0))))
    return F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x) / (F.length(run) - 1)


def _windows(r: Column, ratios: list[float], threshold: float) -> Column:
    """Spans of the run r's joined windows of MIN_RUN characters above the threshold, widened to delimiters."""
    table, value, n = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<double>"), r["value"], MIN_RUN - 1
    codes = F.transform(F.split(value, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    pairs = _let(codes, lambda c: F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c) - 1), lambda a, b: F.coalesce(F.get(table, a * N + b), F.lit(0.0))))
    moves = _let(pairs, lambda p: F.zip_with(p, F.concat(F.array_repeat(F.lit(0.0), n), F.slice(p, F.lit(1), F.size(p) - n)), lambda a, b: F.struct(a.alias("to"), b.alias("off"))))
    none = F.array().cast("array<struct<a:int,b:int>>")
    zero = F.struct(F.lit(0).alias("i"), F.lit(0.0).alias("sum"), F.lit(-1).alias("a"), F.lit(-1).alias("b"), none.alias("done"))

    def step(s, m):
        now, end = s["sum"] + m["to"] - m["off"], s["i"] + 2  # the window ends before this character
        hit = (s["i"] >= n - 1) & (now > n * threshold + 1e-9)
        apart = hit & (end - MIN_RUN > s["b"])
        done = F.when(apart & (s["b"] >= 0), F.concat(s["done"], F.array(F.struct(s["a"], s["b"])).cast("array<struct<a:int,b:int>>"))).otherwise(s["done"])
        return F.struct((s["i"] + 1).alias("i"), now.alias("sum"), F.when(apart, end - MIN_RUN).otherwise(s["a"]).alias("a"), F.when(hit, end).otherwise(s["b"]).alias("b"), done.alias("done"))

    found = F.aggregate(moves, zero, step, lambda s: F.when(s["b"] >= 0, F.concat(s["done"], F.array(F.struct(s["a"], s["b"])).cast("array<struct<a:int,b:int>>"))).otherwise(s["done"]))
    rest = "[^/_=-]*"
    before = lambda w: F.length(F.regexp_extract(F.substr(value, F.lit(1), w["a"]), rest + "$", 0))
    after = lambda w: F.length(F.regexp_extract(F.substr(value, w["b"] + 1, F.length(value)), "^" + rest, 0))

    def span(w):
        a, b = w["a"] - before(w), w["b"] + after(w)
        return F.struct((r["start"] + a).alias("start"), r["k"].alias("k"), (r["start"] + b).alias("end"), r["kind"].alias("kind"), F.substr(value, a + 1, b - a).alias("value"))

    return F.array_distinct(F.transform(found, span)).cast(_SPAN)


def with_spans(docs: DataFrame, model: tuple[list[float], float], id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Adds _all to with_base(): the patterns' and the models' spans by start, then kind."""
    ratios, threshold = model
    base = with_base(docs, id_col, text_col, keep)
    run = RUN + "{%d,}" % MIN_RUN
    cut = base.withColumn("_cut", F.when(F.size("_base") > 0, _without(F.col("_text"), F.col("_base"))).otherwise(F.col("_text")))
    runs = cut.withColumn("_runs", _if(F.col("_cut").rlike(run), _spans(F.col("_cut"), run, "markov")))
    random = F.flatten(F.transform("_runs", lambda r: F.when(score(r["value"], ratios) > threshold, F.array(r)).otherwise(_windows(r, ratios, threshold))))
    return runs.withColumn("_all", F.sort_array(F.concat("_base", random))).drop("_runs", "_cut")


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, counts per kind, a digest of the patterns' spans and all spans, a row for each row of docs."""
    found = with_spans(docs, train(docs))
    of = lambda kind: F.size(F.filter("_base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(F.col("_id").alias("doc_id"), of("assign"), of("access"), of("hex"), F.sha2(listed(F.col("_base")), 256).alias("base_sha256"), listed(F.col("_all")).alias("spans"))


def masked(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs, every secret in the text replaced by MASK; overlapping spans are replaced as one. Other columns stay."""
    columns = docs.columns
    found = with_spans(docs, train(docs), keep=tuple(columns))
    clean = _replaced(F.col("_text"), F.col("_all"), lambda at, s: F.when(s["start"] >= at, MASK).otherwise(""))
    text = F.when(F.size("_all") > 0, clean).otherwise(F.col("_row")[text_col])
    return found.select(*[text.alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in columns])
