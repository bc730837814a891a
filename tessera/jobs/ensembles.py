"""Two-stage retrieval queries, over the repositories of the context queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.jobs.context import _LINES, _TOKENS, _TRIM, _repositories
from tessera.jobs.registry import query, table
from tessera.operators import code, ensembles
from tessera.operators.retrieval import encoded, hashed_tokens

CHUNK, PER_FILE, FILES, BUDGET = 6, 3, 5, 1200


_D = f"""d AS (SELECT lang || '/' || source AS repo, doc_id AS f, 'm' || doc_id % 4 || '/' || doc_id || '.txt' AS path, doc_id % 4 AS folder, text,
list_distinct(list_filter(list_transform({_LINES}, lambda x: {_TRIM.format('x')}), lambda x: length(x) >= 10)) AS l, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS is_recent, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS is_import FROM (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents)),
p AS (SELECT repo, f AS q, path AS own, folder AS home, text, l AS pl FROM d QUALIFY f = min(f) OVER (PARTITION BY repo))"""

#: Signals as in the file scores' SQL; the anchor is the imported file of least mean distance to the others.
_SIGNALS = f"""{_D}, t AS (SELECT repo, f, unnest({_TOKENS}) AS term FROM d), tf AS (SELECT repo, f, term, count(*) AS tf FROM t GROUP BY ALL), len AS (SELECT repo, f, len({_TOKENS}) AS len FROM d),
st AS (SELECT repo, count(*) AS n, avg(len) AS mean FROM len GROUP BY 1), df AS (SELECT repo, term, ln((n - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM tf JOIN st USING (repo) GROUP BY repo, term, n),
fl AS (SELECT repo, avg(idf) * 0.25::DOUBLE AS floor FROM df GROUP BY 1), idf AS (SELECT repo, term, CASE WHEN idf < 0 THEN floor ELSE idf END AS idf FROM df JOIN fl USING (repo)),
a AS (SELECT repo, q, unnest({_TOKENS}) AS term FROM p), qt AS (SELECT repo, q, term, count(*) AS times FROM a GROUP BY ALL),
b AS (SELECT q, f, sum(times * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean))) AS score FROM qt JOIN idf USING (repo, term) JOIN tf USING (repo, term) JOIN len USING (repo, f) JOIN st USING (repo) GROUP BY ALL),
i AS (SELECT q, d.path, d.folder FROM p JOIN d USING (repo) WHERE is_import), c0 AS (SELECT x.q, x.path, x.folder, avg(CASE WHEN x.folder = y.folder THEN 2 ELSE 4 END) FILTER (WHERE x.path <> y.path) AS mean FROM i x JOIN i y USING (q) GROUP BY ALL),
an AS (SELECT q, path AS anchor, folder AS near FROM c0 QUALIFY row_number() OVER (PARTITION BY q ORDER BY mean, path) = 1),
h AS (SELECT q, d.f, d.path, CASE WHEN anchor IS NULL THEN 2 WHEN anchor = d.path THEN 0 WHEN near = d.folder THEN 2 ELSE 4 END AS ref_dist, is_import, is_recent, coalesce(score, 0) AS score FROM p JOIN d ON p.repo = d.repo AND own <> d.path LEFT JOIN an USING (q) LEFT JOIN b ON b.q = p.q AND b.f = d.f),
o AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score) AS i, count(*) OVER (PARTITION BY q) AS n FROM h), w AS (SELECT q, max(CASE WHEN i = greatest(trunc(n * 0.95::DOUBLE)::BIGINT - 1, 0) + 1 THEN score END) AS p95, max(score) AS top FROM o GROUP BY q),
s AS (SELECT h.*, coalesce(score / nullif(top, 0), 0) AS bm25, least(score / CASE WHEN p95 = 0 THEN 1.0 ELSE p95 END, 1.0) AS bm25_p95, 1 / (ref_dist + 1.0::DOUBLE) AS ref FROM h JOIN w USING (q))"""
_SCORES = {"tiers": "CASE WHEN is_recent THEN 3.0 + 0.5 * bm25 WHEN is_import THEN 2.0 ELSE bm25 * ref END", "boosted": "bm25_p95 * ref * CASE WHEN is_recent THEN 2.0 WHEN is_import THEN 1.5 ELSE 1.0 END"}
_SET = _TOKENS.replace("list_filter(", "list_distinct(list_filter(", 1) + ")"
_SIM = f"coalesce(len(list_intersect(qt, ct)) / sqrt(greatest(len(qt), 1)::DOUBLE * greatest(len(ct), 1)), 0)"


def _chunks(size: int) -> str:
    """Windows of so many lines that start every half of them; k: the files. A text without code has one part only, hence these."""
    cut = f"list_filter(list_transform(range(0, len(ln), {size // 2}), lambda i: array_to_string(ln[i + 1:i + {size}], chr(10))), lambda x: {_TRIM.format('x')} <> '')"
    return f"""ln AS (SELECT f, text, {_LINES} AS ln FROM d WHERE f IN (SELECT f FROM k)), cut AS (SELECT f, text AS whole, {cut} AS cut FROM ln),
ck AS (SELECT f, i AS pos, cut[i + 1] AS text, false AS whole FROM cut, unnest(range(0, len(cut))) AS x(i) UNION ALL SELECT f, 0, whole, true FROM cut WHERE len(cut) = 0)"""


def _ensemble_sql(kind: str) -> str:
    flat, blank = {"tiers": ("0.0", "true"), "boosted": ("1.0", "len(x.ls) > 0")}[kind]
    unit = lambda c: f"(CASE WHEN max({c}) OVER (PARTITION BY q) = min({c}) OVER (PARTITION BY q) THEN {flat} ELSE ({c} - min({c}) OVER (PARTITION BY q)) / (max({c}) OVER (PARTITION BY q) - min({c}) OVER (PARTITION BY q)) END)"
    return f"""WITH RECURSIVE {_SIGNALS}, k AS (SELECT q, f, path, round(({_SCORES[kind]})::DOUBLE, 9) AS fs FROM s QUALIFY row_number() OVER (PARTITION BY q ORDER BY fs DESC, path) <= {3 * FILES}), {_chunks(CHUNK)},
cs AS (SELECT f, pos, text, whole, {_SET} AS ct FROM ck), ps AS (SELECT q, {_SET} AS qt FROM p),
m AS (SELECT q, path, fs, pos, text, CASE WHEN whole THEN 0.0::DOUBLE ELSE {_SIM} END AS sim FROM k JOIN cs USING (f) JOIN ps USING (q) QUALIFY row_number() OVER (PARTITION BY q, f ORDER BY sim DESC, pos) <= {PER_FILE}),
z AS (SELECT *, 0.6::DOUBLE * {unit('sim')} + 0.4::DOUBLE * {unit('fs')} AS total FROM m),
r AS (SELECT q, path, fs, text, floor(length(text) / 3.5::DOUBLE) AS cost, list_distinct(list_filter(list_transform({_LINES}, lambda x: {_TRIM.format('x')}), lambda x: length(x) >= 1)) AS ls, row_number() OVER (PARTITION BY q ORDER BY total DESC, path DESC, text DESC) AS i FROM z),
g(q, i, used, files, took) AS (SELECT DISTINCT q, 0::BIGINT, 0::DOUBLE, []::VARCHAR[], false FROM r UNION ALL
SELECT q, i, CASE WHEN ok THEN used + cost ELSE used END, CASE WHEN ok AND NOT list_contains(files, path) THEN list_append(files, path) ELSE files END, ok FROM (SELECT g.q, r.i, used, files, path, cost, used + cost <= {BUDGET} AND (list_contains(files, path) OR len(files) < {FILES}) AS ok FROM g JOIN r ON r.q = g.q AND r.i = g.i + 1)),
e AS (SELECT q, used AS charged, files FROM g QUALIFY i = max(i) OVER (PARTITION BY q)),
x AS (SELECT r.*, list_position(e.files, r.path) AS turn, row_number() OVER (PARTITION BY r.q, r.path ORDER BY r.i) AS j FROM g JOIN r USING (q, i) JOIN e USING (q) WHERE took),
v AS (SELECT q, path, fs, turn, text, ls, row_number() OVER (PARTITION BY q, path ORDER BY j) AS j FROM x WHERE {blank}),
u(q, path, j, kept, texts) AS (SELECT DISTINCT q, path, 0::BIGINT, []::VARCHAR[][], []::VARCHAR[] FROM x UNION ALL
SELECT q, path, j, CASE WHEN ok THEN list_append(kept, ls) ELSE kept END, CASE WHEN ok THEN list_append(texts, text) ELSE texts END FROM (SELECT u.q, u.path, v.j, kept, texts, ls, text,
len(list_filter(kept, lambda k: coalesce(len(list_intersect(k, ls)) / nullif(len(k) + len(ls) - len(list_intersect(k, ls)), 0)::DOUBLE, 0) >= 0.6)) = 0 AS ok FROM u JOIN v ON v.q = u.q AND v.path = u.path AND v.j = u.j + 1)),
y AS (SELECT q, path, array_to_string(texts, chr(10) || '...' || chr(10)) AS text, len(texts) AS n, row_number() OVER (PARTITION BY q ORDER BY fs, turn) AS i FROM (SELECT * FROM u QUALIFY j = max(j) OVER (PARTITION BY q, path)) JOIN (SELECT DISTINCT q, path, fs, turn FROM x) USING (q, path)),
c(q, i, used, n, context) AS (SELECT DISTINCT q, 0::BIGINT, 0::BIGINT, 0::BIGINT, '' FROM y UNION ALL
SELECT q, i, used + coalesce(floor(length(t) / 3.5::DOUBLE)::BIGINT, 0), n + (t IS NOT NULL)::INT, context || coalesce('<|file_sep|>' || path || chr(10) || t, '') FROM (
SELECT c.q, y.i, used, c.n, context, path, CASE WHEN used + floor(length(text) / 3.5::DOUBLE)::BIGINT <= {BUDGET} THEN text WHEN floor(({BUDGET} - used) * 3.5::DOUBLE) > 200 THEN substr(text, 1, floor(({BUDGET} - used) * 3.5::DOUBLE)::INT) END AS t FROM c JOIN y ON y.q = c.q AND y.i = c.i + 1))
SELECT q, c.n AS n_files, (SELECT sum(n) FROM y WHERE y.q = c.q)::BIGINT AS n_chunks, charged::BIGINT AS charged, used, md5(context) AS digest FROM c JOIN e USING (q) QUALIFY i = max(i) OVER (PARTITION BY q)"""


def _ensemble(spark, d, kind):
    points, files, recents, imports = _repositories(spark, d)
    anchors = code.anchors(points.withColumn("prefix", F.col("text")), files, imports, ".txt")
    made = ensembles.ensemble_context(points.withColumn("embedding_query", F.col("text")), files, recents, imports, anchors, kind, CHUNK, PER_FILE, FILES, BUDGET)
    return made.select("q", "n_files", "n_chunks", "charged", "used", F.md5("context").alias("digest"))


@query(_ensemble_sql("tiers"))
def rs_ensemble_tiers(spark, d):
    """Recent files first, then imports, then BM25; chunks fused with file scores, charged, then cleared of near copies."""
    return _ensemble(spark, d, "tiers")


@query(_ensemble_sql("boosted"))
def rs_ensemble_boosted(spark, d):
    """One scale for all files, BM25 over its 95th percentile; otherwise as rs_ensemble_tiers."""
    return _ensemble(spark, d, "boosted")


@query(f"""WITH RECURSIVE {_D}, n AS (SELECT p.q, d.f, d.path, CASE WHEN is_import THEN 0 ELSE 1 END AS tier, CASE WHEN is_import THEN f ELSE -f END AS pos FROM p JOIN d ON p.repo = d.repo AND own <> d.path WHERE is_import OR is_recent),
few AS (SELECT p.q FROM p LEFT JOIN n USING (q) GROUP BY p.q HAVING count(n.f) < 2),
al AS (SELECT * FROM n UNION ALL SELECT p.q, d.f, d.path, 2, 0 FROM p JOIN few USING (q) JOIN d USING (repo) ANTI JOIN n ON n.q = p.q AND n.f = d.f),
k AS (SELECT q, f, path, row_number() OVER (PARTITION BY q ORDER BY tier, pos, path) AS place FROM al QUALIFY place <= 16), {_chunks(CHUNK)},
cs AS (SELECT f, pos, text, {_SET} AS ct FROM ck WHERE NOT whole), ps AS (SELECT q, {_SET} AS qt FROM p),
m AS (SELECT q, path, place, pos, text, {_SIM} AS sim FROM k JOIN cs USING (f) JOIN ps USING (q) QUALIFY row_number() OVER (PARTITION BY q, f ORDER BY sim DESC, pos) <= 3),
r AS (SELECT q, path, text, floor(len(list_filter(regexp_split_to_array({_TRIM.format('text')}, '\\s+'), lambda x: x <> '')) * 1.3::DOUBLE) AS cost, row_number() OVER (PARTITION BY q ORDER BY sim DESC, place, pos) AS i FROM m),
g(q, i, used, files, took) AS (SELECT DISTINCT q, 0::BIGINT, 0::DOUBLE, []::VARCHAR[], false FROM r UNION ALL
SELECT q, i, CASE WHEN ok THEN used + cost ELSE used END, CASE WHEN ok AND NOT list_contains(files, path) THEN list_append(files, path) ELSE files END, ok FROM (SELECT g.q, r.i, used, files, path, cost, used + cost <= 400 AND (list_contains(files, path) OR len(files) < 4) AS ok FROM g JOIN r ON r.q = g.q AND r.i = g.i + 1)),
e AS (SELECT q, used, files FROM g QUALIFY i = max(i) OVER (PARTITION BY q)), x AS (SELECT r.q, r.path, string_agg(text, chr(10) || '...' || chr(10) ORDER BY i) AS text, count(*) AS n FROM g JOIN r USING (q, i) WHERE took GROUP BY ALL)
SELECT q, len(files)::BIGINT AS n_files, sum(n)::BIGINT AS n_chunks, used::BIGINT AS used, md5(string_agg('<|file_sep|>' || path || chr(10) || text, '' ORDER BY list_position(files, path))) AS digest FROM x JOIN e USING (q) GROUP BY q, files, used""")
def rs_smart_multi(spark, d):
    """The best chunks over imported files and recent ones, latest first; other files behind them where these are fewer than two."""
    points, files, recents, imports = _repositories(spark, d)
    own = points.select("q", F.col("path").alias("own"))
    first = imports.join(files.select("f", "path"), "path").select("q", "path", F.lit(0).alias("tier"), F.col("f").alias("pos"))
    then = recents.join(files.select("f", "path"), "f").select("q", "path", F.lit(1).alias("tier"), (-F.col("f")).alias("pos"))
    candidates = first.unionByName(then).join(own, "q").filter("path != own")
    made = ensembles.smart_context(points, files, candidates, points.select("q", "text"), most_files=4, size=CHUNK, budget=400)
    return made.select("q", "n_files", "n_chunks", "used", F.md5("context").alias("digest"))


_NORM = "list_sum(list_transform({0}, lambda x: x::DOUBLE * x))"


@query(f"""WITH e AS (SELECT vec_id, label, embedding AS v, {_NORM.format('embedding')} AS n FROM embeddings), q AS (SELECT * FROM e QUALIFY vec_id = min(vec_id) OVER (PARTITION BY label)),
s AS (SELECT q.vec_id AS q, e.vec_id AS f, coalesce(list_sum(list_transform(list_zip(q.v, e.v), lambda x: x[1]::DOUBLE * x[2])) / nullif(sqrt(q.n) * sqrt(e.n), 0), 0) AS sim FROM q JOIN e ON q.label = e.label AND q.vec_id <> e.vec_id)
SELECT q, f, round(sim, 6) AS sim FROM s QUALIFY row_number() OVER (PARTITION BY q ORDER BY sim DESC, f) = 1""")
def rs_best_embedding(spark, d):
    """For the first vector of every label, the other one nearest to it by cosine: the encoder is the column itself."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("f"), F.col("label").alias("repo"), F.col("embedding").alias("text"))
    asks = e.groupBy("repo").agg(F.min("f").alias("q")).join(e.select(F.col("f").alias("q"), "text"), "q")
    return ensembles.best_by_encoding(asks, e, encoded(lambda c: c)).select("q", "f", F.round("sim", 6).alias("sim"))
