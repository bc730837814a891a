"""Registered queries of the corpus operators, each over its whole table, and their SQL where SQL can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import quality
from .common import table


def op1_risk_controlled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", *quality.OUT, "kept")


def op2_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import warc

    return warc.round_trip(table(spark, sf_dir, "pages"))


def op3_link_graph_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import url_graph

    return url_graph.judge(table(spark, sf_dir, "pages"))


def op4_viterbi_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import viterbi

    return viterbi.count_pieces(table(spark, sf_dir, "documents"), viterbi.read_pieces(public_tokenizers.path("piece_bpe_32k.model")))


def op5_conv_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import bpe

    return bpe.digests(table(spark, sf_dir, "documents"), bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import secret_scan

    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op8_grouped_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import jaccard

    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op9_variable_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing

    return packing.best_fit(table(spark, sf_dir, "documents"))


def op10_stable_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import neighbours

    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op11_potential_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import filter_audit

    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_anchor_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import simhash

    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op13_radix_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import resampling

    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_risk_controlled_rules,
        op2_warc_transactions,
        op3_link_graph_filter,
        op4_viterbi_counts,
        op5_conv_toxicity,
        op6_bpe_round_trip,
        op7_secret_scan,
        op8_grouped_prefix_join,
        op9_variable_bins,
        op10_stable_projections,
        op11_potential_audit,
        op12_anchor_points,
        op13_radix_resampling,
    )
}


_WORDS = "list_filter(regexp_split_to_array({0}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"


def _quality_sql(false_rejection: float = 0.02, delta: float = 0.05) -> str:
    """op1: the counts, the holdout's first rejecting setting by document, exact binomial tails, the last proven setting."""
    rules, rungs, level = list(quality.LADDERS), len(quality.LADDERS["symbols"]), delta / (len(quality.STRATA) + 1)
    ladder = {r: str([float(c) for c in v]) for r, v in quality.LADDERS.items()}
    first = ", ".join(f"CASE WHEN len(list_filter({ladder[r]}, lambda c: r_{r} > c)) > 0 THEN ({rungs} - len(list_filter({ladder[r]}, lambda c: r_{r} > c))) * {len(rules)} + {i} END" for i, r in enumerate(rules))
    broken = " OR ".join(f"coalesce(r_{r} > {ladder[r]}[floor((last - {i}) / {len(rules)})::INT + 1], false)" for i, r in enumerate(rules))
    strata = ", ".join(f"'{x}'" for x in quality.STRATA)
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, CASE WHEN lang IN ({strata}) THEN lang ELSE '{quality.POOLED}' END AS stratum FROM documents),
w AS (SELECT *, {_WORDS.format('t')} AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
i AS (SELECT rid, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) > 2), k AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM i),
g AS (SELECT rid, unnest(list(i)) AS i FROM k GROUP BY rid, k HAVING count(*) > 1), o AS (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM g), n AS (SELECT rid, count(DISTINCT p) AS n FROM o GROUP BY rid),
c AS (SELECT rid, doc_id, t, stratum, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
(len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines FROM w LEFT JOIN n USING (rid)),
f AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEATED} * n_words AS base_failed, coalesce(n_symbols / nullif(word_chars, 0)::DOUBLE, 0) AS r_symbols,
coalesce(n_dup_lines / nullif(n_lines, 0)::DOUBLE, 0) AS r_dup_lines, coalesce(n_repeat_words / nullif(n_words, 0)::DOUBLE, 0) AS r_repeats, coalesce(word_chars / nullif(n_words, 0)::DOUBLE, 0) AS r_word_length FROM c),
l AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id HAVING max(quality) = 1),
h AS (SELECT DISTINCT stratum, t, coalesce(least({first}), {len(rules) * rungs}) AS s FROM f SEMI JOIN l USING (doc_id) WHERE NOT base_failed),
a AS (SELECT stratum, count(*) AS total FROM h GROUP BY 1), b AS (SELECT stratum, total, unnest(range(0, {len(rules) * rungs})) AS s FROM a),
e AS (SELECT b.stratum, b.total, b.s, (SELECT count(*) FROM h WHERE h.stratum = b.stratum AND h.s <= b.s) AS k FROM b),
p AS (SELECT stratum, s, CASE WHEN k >= total * {false_rejection}::DOUBLE THEN 1.0::DOUBLE ELSE list_sum(list_transform(range(0, k + 1), lambda x: exp(lgamma(total + 1) - lgamma(x + 1) - lgamma(total - x + 1) + x * ln({false_rejection}::DOUBLE) + (total - x) * ln(1 - {false_rejection}::DOUBLE)))) END AS p FROM e),
m AS (SELECT stratum, s, max(p) OVER (PARTITION BY stratum ORDER BY s) AS worst FROM p), z AS (SELECT stratum, max(s) AS last FROM m WHERE worst <= {level}::DOUBLE GROUP BY 1)
SELECT doc_id, {", ".join(quality.OUT)}, NOT base_failed AND NOT ({broken}) AS kept FROM f LEFT JOIN z USING (stratum)"""


def _audit_sql() -> str:
    """op11 by definition: every order's steps over the counts by failed filters; a filter's share is its removals summed over all orders."""
    letters = ", ".join(f"(SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS {c})" for c in "pqrst")
    unlike = " AND ".join(f"{a} <> {b}" for i, a in enumerate("pqrst") for b in "pqrst"[:i])
    return f"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
m AS (SELECT doc_id, part, (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
+ 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask FROM d),
l AS (SELECT doc_id, bool_or(quality = 1) AS g, bool_or(toxic = 1) AS x FROM labels GROUP BY 1),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE g) AS good, count(*) FILTER (WHERE x) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL),
o AS (SELECT p || q || r || s || t AS filter_order, unnest(range(1, 6)) AS step FROM {letters} WHERE {unlike}),
e AS (SELECT *, 1 << (ascii(substr(filter_order, step, 1)) - 65) AS bit, coalesce(list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(substr(filter_order, i, 1)) - 65))), 0)::INT AS past FROM o),
r AS (SELECT part, filter_order, step, bit, sum(n) FILTER (WHERE (mask & (past | bit)) = 0) AS kept, sum(n) FILTER (WHERE (mask & past) = 0 AND (mask & bit) > 0) AS removed, sum(n) FILTER (WHERE (mask & past) > 0 AND (mask & bit) > 0) AS redundant,
sum(n) FILTER (WHERE mask = bit) AS unique_fails, sum(good) FILTER (WHERE (mask & past) = 0 AND (mask & bit) > 0) AS good_lost, sum(toxic) FILTER (WHERE (mask & past) = 0 AND (mask & bit) > 0) AS toxic_lost FROM c, e GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, {", ".join(f"coalesce({c}, 0)::BIGINT AS {c}" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"))}, coalesce(sum(removed) OVER (PARTITION BY part, bit), 0)::BIGINT AS shapley FROM r"""


def _resampling_sql() -> str:
    """op13: checksums of the distinct features byte by byte, gains by bucket, one sort by score."""
    from . import resampling as r

    split = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    return f"""WITH w AS (SELECT true AS own, row_number() OVER () AS rid, doc_id, {split} AS w FROM documents UNION ALL SELECT false, row_number() OVER (), NULL, {split} FROM benchmark),
f AS (SELECT own, rid, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM w),
k AS (SELECT list(list_reduce(range(0, 8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) ORDER BY b) AS k FROM range(0, 256) AS x(b)),
b AS (SELECT f, xor(list_reduce(list_transform(range(0, octet_length(encode(f))), lambda i: ('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::BIGINT), lambda c, x: xor(c >> 8, k[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) % {r.BUCKETS} AS bucket FROM (SELECT DISTINCT f FROM f), k),
n AS (SELECT own, rid, bucket, count(*) AS n FROM f JOIN b USING (f) GROUP BY ALL),
c AS (SELECT bucket, coalesce(sum(n) FILTER (WHERE own), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (WHERE NOT own), 0)::DOUBLE AS t FROM n GROUP BY 1),
g AS (SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM c) + {r.BUCKETS}) / ((s + 1) * ((SELECT sum(t) FROM c) + {r.BUCKETS})))) AS gain FROM c),
v AS (SELECT rid, sum(n)::BIGINT AS n, floor(sum(n * gain) / sum(n))::BIGINT AS weight FROM n JOIN g USING (bucket) WHERE own GROUP BY 1),
z AS (SELECT doc_id, len(w) AS words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('{r.SEED}:' || coalesce(doc_id::VARCHAR, '')), 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
FROM w LEFT JOIN v USING (rid) WHERE own),
p AS (SELECT *, row_number() OVER (PARTITION BY words >= {r.MIN_WORDS} ORDER BY score DESC, doc_id) AS place, count(*) FILTER (WHERE words >= {r.MIN_WORDS}) OVER () AS able FROM z)
SELECT doc_id, n_features, weight, score, CASE WHEN words >= {r.MIN_WORDS} AND place <= able * {r.SHARE} // 100 THEN place END AS rank FROM p"""


#: SQL has no iteration to a tolerance, no training and no tokenizer, so the other queries are tested against brute force.
ORACLE_SQL = {
    "op1_risk_controlled_rules": _quality_sql(),
    "op2_warc_transactions": """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), d AS (SELECT page_id, h, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS last FROM p)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(x, (i // 4 * 5 + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::INT, 1)), '') AS payload_digest,
CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM d""",
    "op8_grouped_prefix_join": f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS x FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), b AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS k FROM s p JOIN s q ON p.x = q.x AND p.doc_id <> q.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM b JOIN n u ON u.doc_id = a JOIN n v ON v.doc_id = b WHERE 100 * k >= 75 * (u.n + v.n - k)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT w.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, least(w.doc_id, min(r.b)) AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.a = w.doc_id GROUP BY w.doc_id""",
    "op11_potential_audit": _audit_sql(),
    "op13_radix_resampling": _resampling_sql(),
}
