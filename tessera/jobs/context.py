"""Context retrieval queries: documents stand for the files of repositories."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.jobs.registry import query, table
from tessera.operators import code, retrieval

_PATH = "regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '^/', '')"
_TRIM = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
_LINES = "(CASE WHEN text = '' THEN [] ELSE string_split(text, chr(10)) END)"
_TOKENS = "list_filter(string_split(regexp_replace(lower(text), '[^\\p{L}\\p{N}_]+', ' ', 'g'), ' '), lambda x: x <> '')"


def _path():
    return F.regexp_replace(F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1), "^/", "")


@query(f"""WITH p AS (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host, string_split({_PATH}, '/') AS a FROM pages),
r AS (SELECT host, first(a ORDER BY page_id) AS b FROM p GROUP BY host),
k AS (SELECT page_id, a, b, coalesce(list_position(list_transform(range(1, least(len(a), len(b)) + 1), lambda i: a[i] = b[i]), false), 0) AS x FROM p JOIN r USING (host)),
l AS (SELECT page_id, len(a) + len(b) - 2 * (CASE WHEN x > 0 THEN x - 1 ELSE least(len(a), len(b)) END) AS dist FROM k)
SELECT page_id, dist::BIGINT AS dist, round(1 / (dist + 1.0::DOUBLE), 9) AS proximity FROM l""")
def cr_path_distance(spark, d):
    p = table(spark, d, "pages").select("page_id", F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"), _path().alias("path"))
    first = p.groupBy("host").agg(F.min_by("path", "page_id").alias("ref"))
    dist = C.path_distance(F.col("path"), F.col("ref"))
    return p.join(first, "host").select("page_id", dist.cast("long").alias("dist"), F.round(1 / (dist + 1.0), 9).alias("proximity"))


@query(f"""WITH w AS (SELECT doc_id, text, len(list_filter(regexp_split_to_array({_TRIM.format('text')}, '\\s+'), lambda x: x <> '')) AS n FROM documents)
SELECT doc_id, floor(n * 1.3::DOUBLE)::BIGINT AS words_int, round(n * 1.3::DOUBLE, 6) AS words_float, floor(length(text) / 4)::BIGINT AS chars4, floor(length(text) / 3.5::DOUBLE)::BIGINT AS chars35 FROM w""")
def cr_token_estimates(spark, d):
    e = C.token_estimates(F.col("text"))
    e["words_float"] = F.round(e["words_float"], 6)
    return table(spark, d, "documents").select("doc_id", *[v.alias(k) for k, v in e.items()])


@query(f"SELECT doc_id, len({_TOKENS})::BIGINT AS n_tokens, len(list_distinct({_TOKENS}))::BIGINT AS n_distinct FROM documents")
def cr_tokenize_counts(spark, d):
    t = C.tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"))


@query(f"""SELECT doc_id, len({_LINES})::BIGINT AS n_lines, len({_LINES}) >= 10 AS long_enough,
len(list_distinct(list_filter(list_transform({_LINES}, lambda x: {_TRIM.format('x')}), lambda x: length(x) >= 10)))::BIGINT AS n_long FROM documents""")
def cr_splitlines_min10(spark, d):
    n = F.size(C.lines(F.col("text")))
    return table(spark, d, "documents").select("doc_id", n.cast("long").alias("n_lines"), (n >= 10).alias("long_enough"), F.size(C.long_lines(F.col("text"))).cast("long").alias("n_long"))


@query(r"""SELECT conv_id, turn, CASE WHEN regexp_full_match(regexp_replace(text, '^\s+|\s+$', '', 'g'), '[\s}\)\]:,;]*') THEN '' ELSE text END AS suffix FROM conversations""")
def cr_bracket_suffix(spark, d):
    text = F.col("text")
    return table(spark, d, "conversations").select("conv_id", "turn", F.when(C.strip(text).rlike(r"^[\s}\)\]:,;]*$"), "").otherwise(text).alias("suffix"))


@query(f"SELECT doc_id, array_to_string({_LINES}[greatest(len({_LINES}) - 19, 1):], chr(10)) AS tail, array_to_string({_LINES}[:20], chr(10)) AS head FROM documents")
def cr_prefix_suffix(spark, d):
    x = C.lines(F.col("text"))
    tail = F.when(F.size(x) > 0, F.slice(x, F.greatest(F.size(x) - 19, F.lit(1)), F.lit(20))).otherwise(x)
    return table(spark, d, "documents").select("doc_id", F.array_join(tail, "\n").alias("tail"), F.array_join(F.slice(x, 1, 20), "\n").alias("head"))


@query(f"""WITH l AS (SELECT doc_id, unnest({_LINES}) AS line, generate_subscripts({_LINES}, 1) AS pos FROM documents),
f AS (SELECT doc_id, line, min(pos) AS pos FROM l GROUP BY ALL) SELECT doc_id, count(*) AS n, md5(string_agg(line, chr(10) ORDER BY pos)) AS digest FROM f GROUP BY 1""")
def cr_ordered_distinct_lines(spark, d):
    x = F.array_distinct(C.lines(F.col("text")))
    return table(spark, d, "documents").filter(F.size(C.lines(F.col("text"))) > 0).select("doc_id", F.size(x).cast("long").alias("n"), F.md5(F.array_join(x, "\n")).alias("digest"))


@query(f"""WITH s AS (SELECT doc_id, {_LINES} AS x FROM documents), c AS (SELECT doc_id, unnest(range(0, len(x), 15)) AS pos, x FROM s WHERE len(x) > 0),
t AS (SELECT doc_id, pos, array_to_string(x[pos + 1:pos + 30], chr(10)) AS text FROM c)
SELECT doc_id, pos::BIGINT AS pos, length(text)::BIGINT AS n_chars, md5(text) AS digest FROM t WHERE {_TRIM.format('text')} <> ''""")
def cr_sliding_chunks(spark, d):
    c = table(spark, d, "documents").select("doc_id", F.explode(C.sliding_chunks(C.lines(F.col("text")))).alias("c"))
    return c.select("doc_id", F.col("c.pos").cast("long").alias("pos"), F.length("c.text").cast("long").alias("n_chars"), F.md5("c.text").alias("digest"))


@query(f"""WITH l AS (SELECT doc_id, unnest(list_distinct(list_filter(list_transform({_LINES}, lambda x: {_TRIM.format('x')}), lambda x: length(x) >= 10))) AS line FROM documents),
n AS (SELECT doc_id, count(*) AS n FROM l GROUP BY 1), b AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS k FROM l p JOIN l q ON p.line = q.line AND p.doc_id < q.doc_id GROUP BY ALL)
SELECT a, b, round(k / (x.n + y.n - k)::DOUBLE, 9) AS iou FROM b JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b""")
def cr_lines_iou(spark, d):
    return retrieval.shared_lines(table(spark, d, "documents"), "doc_id").withColumn("iou", C.round_scaled(F.col("iou"), 9))


_BM25 = f"""t AS (SELECT doc_id AS f, unnest({_TOKENS}) AS term FROM documents), tf AS (SELECT f, term, count(*) AS tf FROM t GROUP BY ALL),
len AS (SELECT doc_id AS f, len({_TOKENS}) AS len FROM documents), st AS (SELECT count(*) AS n, avg(len) AS mean FROM len),
df AS (SELECT term, ln((n - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM tf, st GROUP BY term, n), fl AS (SELECT avg(idf) * 0.25::DOUBLE AS floor FROM df),
idf AS (SELECT term, CASE WHEN idf < 0 THEN floor ELSE idf END AS idf FROM df, fl),
a AS (SELECT item_id AS q, unnest({_TOKENS}) AS term FROM benchmark), q AS (SELECT q, term, count(*) AS times FROM a GROUP BY ALL),
s AS (SELECT q, f, sum(times * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean))) AS score FROM q JOIN idf USING (term) JOIN tf USING (term) JOIN len USING (f), st GROUP BY ALL)"""


def _bm25(spark, d):
    return retrieval.bm25(table(spark, d, "benchmark").select(F.col("item_id").alias("q"), "text"), table(spark, d, "documents").select(F.col("doc_id").alias("f"), "text"))


@query(f"WITH {_BM25}, r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 6) DESC, f) AS rank FROM s) SELECT q, f, round(score, 6) AS score, rank FROM r WHERE rank <= 10")
def cr_bm25_topk(spark, d):
    s = _bm25(spark, d).withColumn("score", F.round("score", 6))
    return retrieval.top(s, "q", 10, F.desc("score"), F.col("f")).withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {_BM25} SELECT q, f, round(score / max(score) OVER (PARTITION BY q), 6) AS norm FROM s")
def cr_bm25_norm_max(spark, d):
    return _bm25(spark, d).select("q", "f", F.round(F.col("score") / F.max("score").over(Window.partitionBy("q")), 6).alias("norm"))


@query(f"""WITH {_BM25}, p AS (SELECT q, list_sort(list(score)) AS l FROM s GROUP BY q), m AS (SELECT q, l[greatest(trunc(len(l) * 0.95::DOUBLE)::BIGINT - 1, 0) + 1] AS p95 FROM p)
SELECT q, f, round(least(score / CASE WHEN p95 = 0 THEN 1.0 ELSE p95 END, 1.0), 6) AS norm FROM s JOIN m USING (q)""")
def cr_bm25_norm_p95(spark, d):
    return retrieval.over_p95(_bm25(spark, d)).select("q", "f", F.round("norm", 6).alias("norm"))


@query(f"WITH {_BM25} SELECT q, arg_max(f, (round(score, 6), -f)) AS f FROM s GROUP BY q")
def rs_bm25_best(spark, d):
    return _bm25(spark, d).groupBy("q").agg(F.max_by("f", F.struct(F.round("score", 6), -F.col("f"))).alias("f"))


_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"


@query(f"""WITH r AS (SELECT label, first(embedding ORDER BY vec_id) AS e FROM embeddings GROUP BY 1),
s AS (SELECT label, vec_id, round({_DOT.format('embedding', 'e')} / (sqrt({_DOT.format('embedding', 'embedding')}) * sqrt({_DOT.format('e', 'e')})), 6) AS sim FROM embeddings JOIN r USING (label)),
t AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sim DESC, vec_id) AS rank FROM s) SELECT label, vec_id, sim, rank FROM t WHERE rank <= 5""")
def cr_topk_chunks_per_file(spark, d):
    e = table(spark, d, "embeddings")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("e"))
    s = e.join(first, "label").select("label", "vec_id", F.round(C.cosine(F.col("embedding"), F.col("e")), 6).alias("sim"))
    return retrieval.top(s, "label", 5, F.desc("sim"), F.col("vec_id")).withColumn("rank", F.col("rank").cast("long"))


@query("SELECT d.doc_id, l.doc_id IS NOT NULL AS recent, coalesce(l.quality, 0)::BIGINT AS pinned FROM documents d LEFT JOIN labels l USING (doc_id)")
def cr_recent_semi(spark, d):
    l = table(spark, d, "labels").select("doc_id", "quality", F.lit(True).alias("recent"))
    return table(spark, d, "documents").select("doc_id").join(l, "doc_id", "left").select("doc_id", F.coalesce("recent", F.lit(False)).alias("recent"), F.coalesce("quality", F.lit(0)).cast("long").alias("pinned"))


@query("SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def cr_seen_anti_pad(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("""SELECT doc_id, round(CASE WHEN max(n_chars) OVER w = min(n_chars) OVER w THEN 0 ELSE (n_chars - min(n_chars) OVER w) / (max(n_chars) OVER w - min(n_chars) OVER w)::DOUBLE END, 9) AS norm
FROM documents WINDOW w AS (PARTITION BY lang)""")
def cr_minmax_fusion(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    ends = docs.groupBy("lang").agg(F.min("n_chars").alias("lo"), F.max("n_chars").alias("hi"))
    return docs.join(ends, "lang").select("doc_id", F.round(F.coalesce(F.try_divide(F.col("n_chars") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0)), 9).alias("norm"))


@query(r"""WITH RECURSIVE c AS (SELECT conv_id, turn, role, floor(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) * 1.3::DOUBLE) AS cost,
row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
g(conv_id, i, used, n) AS (SELECT DISTINCT conv_id, 0::BIGINT, 0::DOUBLE, 0::BIGINT FROM c UNION ALL
SELECT g.conv_id, c.i, CASE WHEN used + cost <= 300 THEN used + cost ELSE used END, n + CASE WHEN used + cost <= 300 THEN 1 ELSE 0 END FROM g JOIN c ON c.conv_id = g.conv_id AND c.i = g.i + 1)
SELECT conv_id, max(used) AS used, max(n) AS n_taken FROM g GROUP BY 1""")
def cr_greedy_budget(spark, d):
    cost = C.token_estimates(F.col("text"))["words_int"].cast("double")
    item = F.struct("turn", F.col("role").alias("file"), cost.alias("cost"))
    listed = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(item)).alias("x"))
    fill = C.greedy_fill(F.transform("x", lambda x, i: F.struct(i.alias("pos"), x["file"], x["cost"])), 300, 100)
    return listed.select("conv_id", fill.alias("g")).select("conv_id", F.col("g.used").alias("used"), F.size("g.taken").cast("long").alias("n_taken"))


@query(f"""WITH RECURSIVE c AS (SELECT conv_id, turn, list_distinct(list_filter(list_transform({_LINES}, lambda x: {_TRIM.format('x')}), lambda x: length(x) >= 1)) AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
g(conv_id, i, turn, kept, took) AS (SELECT DISTINCT conv_id, 0::BIGINT, 0::BIGINT, []::VARCHAR[][], false FROM c UNION ALL
SELECT conv_id, i, turn, CASE WHEN ok THEN list_append(kept, s) ELSE kept END, ok FROM (SELECT g.conv_id, c.i, c.turn, kept, s,
len(list_filter(kept, lambda k: coalesce(len(list_intersect(k, s)) / nullif(len(k) + len(s) - len(list_intersect(k, s)), 0)::DOUBLE, 0) >= 0.6)) = 0 AS ok FROM g JOIN c ON c.conv_id = g.conv_id AND c.i = g.i + 1))
SELECT conv_id, turn FROM g WHERE took""")
def cr_greedy_dedup(spark, d):
    """Turns of each conversation that are no near copy of one kept before."""
    listed = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", C.long_lines(F.col("text"), 1).alias("s")))).alias("x"))
    kept = listed.select("conv_id", "x", F.transform("x", lambda x: x["s"]).alias("sets")).select("conv_id", F.explode(F.transform(C.greedy_distinct(F.col("sets")), lambda i: F.get("x", i)["turn"])).alias("turn"))
    return kept.select("conv_id", "turn")


@query("""SELECT lang, first(doc_id ORDER BY md5(doc_id::VARCHAR || '-7'), doc_id) AS doc_id FROM documents GROUP BY 1""")
def rs_random_seeded(spark, d):
    h = F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("-7")))
    return table(spark, d, "documents").groupBy("lang").agg(F.min_by("doc_id", F.struct(h, "doc_id")).alias("doc_id"))


@query("""SELECT d.lang, coalesce(min(CASE WHEN l.quality = 1 THEN d.doc_id END), min(d.doc_id)) AS doc_id FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1""")
def rs_recent_first(spark, d):
    l = table(spark, d, "labels").filter("quality = 1").select("doc_id", F.lit(True).alias("recent"))
    return table(spark, d, "documents").select("doc_id", "lang").join(l, "doc_id", "left").groupBy("lang").agg(F.coalesce(F.min(F.when(F.col("recent"), F.col("doc_id"))), F.min("doc_id")).alias("doc_id"))


def _repositories(spark, d):
    """Points (q, repo, path, text), files (f, repo, path, text), recents (q, f), imports (q, path): (lang, source) is a repository, the first document of
    each its completion point. Labels stand for the editor's state: quality 1 for recent files, toxic 1 for imported ones."""
    docs = table(spark, d, "documents").select(F.concat_ws("/", "lang", "source").alias("repo"), F.col("doc_id").alias("f"), F.format_string("m%d/%d.txt", F.col("doc_id") % 4, F.col("doc_id")).alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    first = docs.groupBy("repo").agg(F.min("f").alias("q"))
    points = first.join(docs.select(F.col("f").alias("q"), "path", "text"), "q")
    own = first.join(docs.select("repo", "f", "path"), "repo")
    marked = lambda label: own.join(table(spark, d, "labels").filter(f"{label} = 1").select(F.col("doc_id").alias("f")), "f", "left_semi")
    return points, docs, marked("quality").select("q", "f"), marked("toxic").select("q", "path")


_SIGNALS = f"""d AS (SELECT lang || '/' || source AS repo, doc_id AS f, 'm' || doc_id % 4 || '/' || doc_id || '.txt' AS path, doc_id % 4 AS folder, text, list_distinct(list_filter(list_transform({_LINES}, lambda x: {_TRIM.format('x')}), lambda x: length(x) >= 10)) AS l FROM documents),
p AS (SELECT repo, f AS q, path AS own, folder AS home, text, l AS pl FROM d WHERE f IN (SELECT min(f) FROM d GROUP BY repo)),
t AS (SELECT repo, f, unnest({_TOKENS}) AS term FROM d), tf AS (SELECT repo, f, term, count(*) AS tf FROM t GROUP BY ALL), len AS (SELECT repo, f, len({_TOKENS}) AS len FROM d),
st AS (SELECT repo, count(*) AS n, avg(len) AS mean FROM len GROUP BY 1), df AS (SELECT repo, term, ln((n - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM tf JOIN st USING (repo) GROUP BY repo, term, n),
fl AS (SELECT repo, avg(idf) * 0.25::DOUBLE AS floor FROM df GROUP BY 1), idf AS (SELECT repo, term, CASE WHEN idf < 0 THEN floor ELSE idf END AS idf FROM df JOIN fl USING (repo)),
a AS (SELECT repo, q, unnest({_TOKENS}) AS term FROM p), qt AS (SELECT repo, q, term, count(*) AS times FROM a GROUP BY ALL),
b AS (SELECT q, f, sum(times * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean))) AS score FROM qt JOIN idf USING (repo, term) JOIN tf USING (repo, term) JOIN len USING (repo, f) JOIN st USING (repo) GROUP BY ALL),
g AS (SELECT q, d.f, path, len(list_intersect(pl, l)) AS k, len(pl) + len(l) AS u, CASE WHEN home = folder THEN 2 ELSE 4 END AS dist, d.f IN (SELECT doc_id FROM labels WHERE toxic = 1) AS is_import, d.f IN (SELECT doc_id FROM labels WHERE quality = 1) AS is_recent, folder, p.repo FROM p JOIN d ON p.repo = d.repo AND own <> path),
r AS (SELECT repo, list(DISTINCT folder) AS folders FROM d WHERE f IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY 1),
h AS (SELECT q, g.f, path, coalesce(k / nullif(u - k, 0)::DOUBLE, 0) AS iou, dist, CASE WHEN is_import THEN 0 WHEN folders IS NULL THEN 2 WHEN list_contains(folders, folder) THEN 2 ELSE 4 END AS ref_dist, is_import, is_recent, coalesce(score, 0) AS score FROM g LEFT JOIN r USING (repo) LEFT JOIN b USING (q, f)),
o AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score) AS i, count(*) OVER (PARTITION BY q) AS n FROM h), w AS (SELECT q, max(CASE WHEN i = greatest(trunc(n * 0.95::DOUBLE)::BIGINT - 1, 0) + 1 THEN score END) AS p95, max(score) AS top FROM o GROUP BY q),
s AS (SELECT h.*, coalesce(score / nullif(top, 0), 0) AS bm25, least(score / CASE WHEN p95 = 0 THEN 1.0 ELSE p95 END, 1.0) AS bm25_p95, 1 / (dist + 1.0::DOUBLE) AS near, 1 / (ref_dist + 1.0::DOUBLE) AS ref FROM h JOIN w USING (q))"""

_MM = "coalesce(({0} - min({0}) OVER (PARTITION BY q)) / nullif(max({0}) OVER (PARTITION BY q) - min({0}) OVER (PARTITION BY q), 0)::DOUBLE, 0)"
_SCORES = {
    "final": "CASE WHEN is_recent OR is_import THEN 1.0 ELSE iou * near END",
    "tiers": "CASE WHEN is_import THEN 3.0 WHEN is_recent THEN 2.0 ELSE iou * ref END",
    "fused": f"CASE WHEN is_import THEN 2.0 ELSE 0.4 * {_MM.format('(-ref_dist)')} + 0.4 * {_MM.format('iou')} + 0.2 * {_MM.format('is_recent::INT')} END",
    "lines": "iou + CASE WHEN is_import THEN 0.3 WHEN is_recent THEN 0.1 ELSE 0 END",
    "distance": "iou / 2 - CASE WHEN is_import THEN 0 WHEN is_recent THEN least(ref_dist, 1) ELSE ref_dist END",
    "bm25": "CASE WHEN is_recent THEN 3.0 + 0.5 * bm25 WHEN is_import THEN 2.0 ELSE bm25 * ref END",
    "boosted": "bm25_p95 * ref * CASE WHEN is_recent THEN 2.0 WHEN is_import THEN 1.5 ELSE 1.0 END",
}


def _scored(strategy):
    """Registers the score of every point and file of its repository under a strategy."""

    def run(spark, d):
        scored = retrieval.file_scores(retrieval.file_signals(*_repositories(spark, d)), strategy)
        return scored.select("q", "f", (F.round("score", 6) + 0.0).alias("score"))

    run.__name__ = f"rs_score_{strategy}"
    return query(f"WITH {_SIGNALS} SELECT q, f, round(({_SCORES[strategy]})::DOUBLE, 6) + 0.0 AS score FROM s")(run)


for _name in _SCORES:
    _scored(_name)


@query(rf"""WITH RECURSIVE {_SIGNALS}, z AS (SELECT q, f, path, row_number() OVER (PARTITION BY q ORDER BY {_SCORES['distance']} DESC, path) AS rank FROM s QUALIFY rank <= 5),
y AS (SELECT q, path, text, row_number() OVER (PARTITION BY q ORDER BY rank DESC) AS i FROM z JOIN (SELECT f, text FROM d) USING (f)),
c(q, i, used, n, context) AS (SELECT DISTINCT q, 0::BIGINT, 0::BIGINT, 0::BIGINT, '' FROM y UNION ALL
SELECT q, i, used + coalesce(floor(len(list_filter(regexp_split_to_array({_TRIM.format('x')}, '\s+'), lambda w: w <> '')) * 1.3::DOUBLE)::BIGINT, 0), n + (x IS NOT NULL)::INT, context || coalesce('<|file_sep|>' || path || chr(10) || x, '') FROM (
SELECT c.q, y.i, used, n, context, path, CASE WHEN used + floor(len(list_filter(regexp_split_to_array({_TRIM.format('text')}, '\s+'), lambda w: w <> '')) * 1.3::DOUBLE)::BIGINT <= 500 THEN text WHEN (500 - used) * 4 > 200 THEN substr(text, 1, ((500 - used) * 4)::INT) END AS x FROM c JOIN y ON y.q = c.q AND y.i = c.i + 1))
SELECT q, n AS n_files, used, md5(context) AS digest FROM c QUALIFY i = max(i) OVER (PARTITION BY q)""")
def rs_distance_whole_files(spark, d):
    """The nearest files whole, within a budget that cuts one of them."""
    points, files, recents, imports = _repositories(spark, d)
    scored = retrieval.file_scores(retrieval.file_signals(points, files, recents, imports), "distance")
    return retrieval.whole_files(scored, files, budget=500).select("q", "n_files", "used", F.md5("context").alias("digest"))


@query()
def rs_best_final(spark, d):
    """The whole retrieval strategy: the first document of every repository is the completion point, its text the prefix."""
    points, files, recents, _ = _repositories(spark, d)
    points = points.select("q", "repo", "path", F.col("text").alias("prefix"), F.lit("").alias("suffix"))
    return retrieval.best_context(points, files, recents, extension=".txt")


@query(f"""WITH d AS (SELECT doc_id, text, {_LINES} AS l FROM documents), t AS (SELECT *, l[greatest(len(l) - 4, 1):] AS t FROM d)
SELECT doc_id, CASE WHEN len(l) <= 5 THEN text ELSE array_to_string(t, chr(10)) END AS simple, length(CASE WHEN len(l) <= 5 THEN text ELSE array_to_string((SELECT list(x ORDER BY i) FROM (SELECT x, min(i) AS i FROM (SELECT unnest(t) AS x, unnest(range(0, len(t))) AS i) GROUP BY 1)), chr(10)) END)::BIGINT AS smart_chars,
md5({_TRIM.format("array_to_string(l[greatest(len(l) - 19, 1):], chr(10)) || chr(10) || array_to_string(l[1:2], chr(10))")}) AS query FROM t""")
def cr_prefix_modes(spark, d):
    """Submission prefixes of at most five lines in two modes, and the plain query, the first two lines as suffix."""
    text = F.col("text")
    return table(spark, d, "documents").select("doc_id", code.submission_prefix(text, "simple", 5).alias("simple"), F.length(code.submission_prefix(text, "smart", 5)).cast("long").alias("smart_chars"), F.md5(code.plain_query(text, code.suffix_head(text, 2))).alias("query"))


@query(f"""WITH l AS (SELECT doc_id, list_sort(list_distinct(list_filter(list_transform({_LINES}, lambda x: {_TRIM.format('x')}), lambda x: length(x) >= 10))) AS l FROM documents), m AS (SELECT doc_id, l, min(doc_id) OVER (PARTITION BY l) AS rep FROM l),
r AS (SELECT rep, len(l) AS n, unnest(l) AS x FROM m WHERE doc_id = rep), b AS (SELECT p.rep AS a, q.rep AS b, count(*) / (p.n + q.n - count(*))::DOUBLE AS iou FROM r p JOIN r q ON p.x = q.x AND p.rep <> q.rep GROUP BY p.rep, q.rep, p.n, q.n HAVING iou >= 0.5),
s AS (SELECT a AS rep, count(*) AS n, max(iou) AS most FROM b GROUP BY 1) SELECT doc_id, rep, coalesce(n, 0)::BIGINT AS n_similar, round(coalesce(most, 0), 9) AS most FROM m LEFT JOIN s USING (rep)""")
def cr_similar_files(spark, d):
    """Every document's representative by its set of long lines, and how many other sets overlap it by half or more."""
    members, pairs = retrieval.similar_files(table(spark, d, "documents"), 0.5, "doc_id")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("rep"), "iou")
    found = ends.groupBy("rep").agg(F.count("*").alias("n"), F.max("iou").alias("most"))
    return members.join(found, "rep", "left").select(F.col("f").alias("doc_id"), "rep", F.coalesce("n", F.lit(0)).cast("long").alias("n_similar"), F.round(F.coalesce("most", F.lit(0.0)), 9).alias("most"))
