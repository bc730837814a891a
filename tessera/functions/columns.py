"""Column functions: pure expressions that Catalyst plans; no Python runs on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STRIP = r"(?U)^\s+|\s+$"


def ieee_divide(n: Column, d: Column) -> Column:
    """Division as floating point does it: x/0 is an infinity and 0/0 is NaN, where ANSI mode would raise. By null it is null."""
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    by_zero = F.when(n > 0, inf).when(n < 0, -inf).when(n == 0, nan)
    return F.when(d != 0, n / F.when(d != 0, d)).when(d == 0, by_zero)


def clip_low(x: Column, low: float = 0.0) -> Column:
    """greatest() alone would turn null into the bound."""
    return F.when(x.isNotNull(), F.greatest(x, F.lit(low)))


def round_scaled(x: Column, digits: int) -> Column:
    """x times a power of ten, rounded half away from zero, over that power, all in doubles, as SQL engines without decimals round. Spark's own round goes by
    the shortest decimal of x and takes other sides where the product meets a half. What overflows stays as it is, and a zero
    keeps the sign of what was rounded to it."""
    scaled = x * 10.0**digits
    even = F.rint(scaled)  # halves go to the even number; unlike round(), no decimals are made
    away = F.when((scaled > 0) & (scaled - even == 0.5), even + 1).when((scaled < 0) & (scaled - even == -0.5), even - 1).otherwise(even)
    return F.when(F.abs(scaled) == float("inf"), x).otherwise(away / 10.0**digits)


def cyclic(x: Column, period: float, phase: float = 0.0, wave=F.cos) -> Column:
    return wave(2 * F.pi() * (x + phase) / period)


def bound(x: Column, f) -> Column:
    """f of x, with x computed once, however often f names it."""
    return F.transform(F.array(x), f)[0]


def strip(text: Column) -> Column:
    """Without white space at either end. The pattern, which knows every kind of it, runs only where a character beyond ASCII or a control
    character is left at an end."""
    return bound(F.trim(text), lambda t: F.when(t.rlike(r"^[\x00-\x1f\x7f-\x{10ffff}]|[\x00-\x1f\x7f-\x{10ffff}]$"), F.regexp_replace(t, STRIP, "")).otherwise(t))


def lines(text: Column) -> Column:
    """Lines of a text; none for an empty one, and no empty piece behind a final line end."""
    return bound(F.split(text, r"\r\n|\r|\n"), lambda cut: F.when(F.element_at(cut, -1) == "", F.slice(cut, F.lit(1), F.size(cut) - 1)).otherwise(cut))


def long_lines(text: Column, least: int = 10) -> Column:
    """Distinct stripped lines of at least so many characters."""
    return F.array_distinct(F.filter(F.transform(lines(text), strip), lambda x: F.length(x) >= least))


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return F.array_remove(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", " "), " "), "")


def path_distance(a: Column, b: Column) -> Column:
    """Steps up from one file to the deepest common part and down to the other; siblings are 2 apart."""
    x, y = F.split(F.replace(a, F.lit("\\"), F.lit("/")), "/"), F.split(F.replace(b, F.lit("\\"), F.lit("/")), "/")
    differs = F.array_position(F.zip_with(x, y, lambda p, q: p.eqNullSafe(q)), False)
    common = F.when(differs > 0, differs - 1).otherwise(F.size(x)).cast("int")
    return F.size(x) + F.size(y) - 2 * common


def token_estimates(text: Column) -> dict[str, Column]:
    """Four estimates in use: words x 1.3 cut or not, characters / 4, characters / 3.5."""
    words = F.size(F.array_remove(F.split(strip(text), r"(?U)\s+"), ""))
    return {"words_int": F.floor(words * 1.3).cast("long"), "words_float": (words * 1.3).cast("double"), "chars4": F.floor(F.length(text) / 4).cast("long"), "chars35": F.floor(F.length(text) / 3.5).cast("long")}


def indentation(line: Column, tab: int = 4) -> Column:
    """Width of the leading white space, tabs going to the next stop."""
    lead = F.regexp_extract(line, r"^([ \t]*)", 1)
    return F.aggregate(F.split(lead, ""), F.lit(0), lambda w, c: F.when(c == "\t", w + tab - w % tab).when(c == " ", w + 1).otherwise(w))


def sliding_chunks(text_lines: Column, size: int = 30) -> Column:
    """Structs (pos, text) of overlapping windows that start every half window; blank ones are left out."""
    step = max(1, size // 2)
    starts = F.when(F.size(text_lines) > 0, F.sequence(F.lit(0), F.size(text_lines) - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    chunks = F.transform(starts, lambda i: F.struct(i.alias("pos"), F.array_join(F.slice(text_lines, i + 1, F.lit(size)), "\n").alias("text")))
    return F.filter(chunks, lambda c: F.length(strip(c["text"])) > 0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null where a side has no length."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def greedy_fill(items: Column, budget: int, most_files: int) -> Column:
    """Positions taken of an array of structs (pos, file, cost), in its order: an item that would exceed the budget, or would open
    one file too many, is skipped and costs nothing."""
    zero = F.struct(F.lit(0.0).alias("used"), F.array().cast("array<string>").alias("files"), F.array().cast("array<int>").alias("taken"))

    def step(a, x):
        known = F.array_contains(a["files"], x["file"])
        fits = (a["used"] + x["cost"] <= budget) & (known | (F.size(a["files"]) < most_files))
        more = F.struct((a["used"] + x["cost"]).cast("double").alias("used"), F.when(known, a["files"]).otherwise(F.concat(a["files"], F.array(x["file"]))).alias("files"), F.concat(a["taken"], F.array(x["pos"])).alias("taken"))
        return F.when(fits, more).otherwise(a)

    return F.aggregate(items, zero, step)


def greedy_distinct(sets: Column, limit: float = 0.6) -> Column:
    """Indexes kept of an array of sets, in order: one that is as similar as the limit to any kept before is dropped."""
    zero = F.struct(F.lit(0).alias("i"), F.array().cast("array<int>").alias("kept"))
    jaccard = lambda a, b: F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))
    step = lambda s, x: F.struct((s["i"] + 1).alias("i"), F.when(F.exists(s["kept"], lambda k: jaccard(F.get(sets, k), x) >= limit), s["kept"]).otherwise(F.concat(s["kept"], F.array(s["i"]))).alias("kept"))
    return F.aggregate(sets, zero, step, lambda s: s["kept"])


def resample(values: Column, n: int) -> Column:
    """Linear interpolation at n evenly spaced places; zeros for no value, a constant for one."""
    last = F.size(values) - 1
    at = lambda j: j * last / F.lit(float(max(1, n - 1)))
    low = lambda p: F.get(values, F.floor(p).cast("int"))
    high = lambda p: F.get(values, F.ceil(p).cast("int"))
    line = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: low(at(j)) + (high(at(j)) - low(at(j))) * (at(j) - F.floor(at(j))))
    return F.when(F.size(values) == 0, F.array_repeat(F.lit(0.0), n)).otherwise(line)


def local_maxima(values: Column) -> Column:
    """Interior positions (0-based) not below the left neighbour and above the right one."""
    return F.filter(F.when(F.size(values) > 2, F.sequence(F.lit(1), F.size(values) - 2)).otherwise(F.array().cast("array<int>")), lambda i: (F.get(values, i) >= F.get(values, i - 1)) & (F.get(values, i) > F.get(values, i + 1)))


def top_peaks(values: Column, most: int, apart: int) -> Column:
    """Local maxima by height, each at least so far from those taken before, at most so many; in order of place."""
    ranked = F.array_sort(F.transform(local_maxima(values), lambda i: F.struct((-F.get(values, i)).alias("h"), i.alias("i"))))
    take = lambda a, x: F.when((F.size(a) < most) & ~F.exists(a, lambda k: F.abs(k - x["i"]) < apart), F.concat(a, F.array(x["i"]))).otherwise(a)
    return F.sort_array(F.aggregate(ranked, F.array().cast("array<int>"), take))


def softmax(z: Column) -> Column:
    top = lambda z: bound(F.array_max(z).cast("double"), lambda m: F.transform(z, lambda x: F.exp(x.cast("double") - m)))
    share = lambda e: bound(F.aggregate(e, F.lit(0.0), lambda s, y: s + y), lambda t: F.transform(e, lambda x: x / t))
    return bound(bound(z, top), share)


def log_sum_exp(z: Column) -> Column:
    return bound(F.array_max(z).cast("double"), lambda top: top + F.ln(F.aggregate(z, F.lit(0.0), lambda s, x: s + F.exp(x.cast("double") - top))))


def row_bounds(centres: Column, height: Column) -> Column:
    """Structs (y0, y1) of the rows around ascending centres: midpoints between them, 0.7 of a step beyond the outer two, within the height."""
    at, last = lambda i: F.get(centres, i).cast("double"), F.size(centres) - 1
    low = lambda i: F.when(i == 0, F.greatest(F.lit(0.0), at(i) - 0.7 * (at(i + 1) - at(i)))).otherwise((at(i - 1) + at(i)) / 2)
    high = lambda i: F.when(i == last, F.least(height.cast("double"), at(i) + 0.7 * (at(i) - at(i - 1)))).otherwise((at(i) + at(i + 1)) / 2)
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(low(i).cast("int").alias("y0"), high(i).cast("int").alias("y1")))


def px_per_mm(short_widths: Column, long_width: Column, short_mm: float = 62.5) -> Column:
    """Pixels a millimetre: the median width of the short leads, else a quarter of the long one's, else 250 pixels, over their millimetres."""
    wide = F.sort_array(F.transform(short_widths, lambda w: F.greatest(w, F.lit(1)).cast("double")))
    n = F.size(short_widths)
    median = bound(wide, lambda w: (F.get(w, F.floor((n - 1) / 2).cast("int")) + F.get(w, F.floor(n / 2).cast("int"))) / 2)
    width = F.when(n > 0, median).otherwise(F.coalesce(F.when(long_width.isNotNull(), F.greatest(long_width / 4.0, F.lit(1.0))), F.lit(250.0)))
    return F.greatest(width / short_mm, F.lit(1e-3))
