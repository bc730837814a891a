"""The corpus operators against brute force, on small inputs with nulls, ties, copies, empty tables and clashing columns."""

import base64
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, jaccard, neighbours, packing, quality, secret_scan, toxicity, url_graph, viterbi, warc

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, _text string"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 0, "k", "t") for i, t in enumerate(texts)], DOCS)


ODD = [None, "", " \t\n", "a", "a b c a b c", "a b c d", "x y\nx y\n\nx y", "#*$ %&|<> \x0b w", "é ü\u00a0z\x0cq", "a a a a a a", "w " * 3000, "k" * 20000, "a b c a b c"]


def base(text):
    w = WORD.findall(text or "")
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    twice = {t for t in tri if tri.count(t) > 1} if len(tri) < 100 else {t for t in set(tri) if sum(x == t for x in tri) > 1}
    marked = {j for i, t in enumerate(tri) if t in twice for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(marked)


def test_quality_counts(spark):
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 0), (2, None, 0)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in quality.assess(docs_of(spark, ODD), labels).collect()}
    for i, t in enumerate(ODD):
        r, want = got[i], base(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, (i, want)
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and r.kept == (not r.base_failed)
    assert quality.assess(docs_of(spark, []), labels).count() == 0
    assert quality.keep_good(docs_of(spark, ["word%d " % i for i in range(3)] + [" ".join(f"w{i}" for i in range(60))]), labels).columns == [c.split()[0] for c in DOCS.split(", ")]


def test_quality_cutoffs_hold(spark):
    """Each stratum stands for one trial: uniform ratios of one rule, so a cutoff's true rejection share is known."""
    n, trials = 500, 120
    rows = spark.range(n * trials).select(F.col("id").alias("_id"), F.concat(F.lit("s"), F.floor(F.col("id") / n)).alias("_stratum"), F.col("id").alias("_copy"), F.lit(False).alias("base_failed"), F.rand(11).alias("u"))
    none = F.lit(0.0)
    feats = quality.stored(rows.select("_id", "_stratum", "_copy", "base_failed", (F.when(F.col("u") < 0.1, F.col("u") * 6)).otherwise(0.0).alias("_r_symbols"), none.alias("_r_dup_lines"), none.alias("_r_repeats"), none.alias("_r_word_length")), "trials")
    labels = spark.range(n * trials).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    cuts = {r._stratum: r._c_symbols for r in quality.cutoffs(feats, labels).collect()}
    # u is below 0.1 in one row of ten, where the ratio is uniform up to 0.6: a cutoff c rejects (0.6 - c) / 6 of the documents.
    shares = [(0.6 - c) / 6 for c in cuts.values() if c is not None]
    assert len(cuts) > 0.9 * trials and max(shares) > 0.005 and sum(x > 0.02 for x in shares) <= 0.05 * trials
    few = feats.filter("_id < 200")
    assert quality.cutoffs(few, labels).count() == 0  # 200 labels can't prove 2 % at this level


def test_quality_sql(spark):
    import duckdb

    from tessera.llm import queries

    d = "/root/testdata/sf0.1"
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    sql = queries.ORACLE_SQL["op1_risk_controlled_rules"]
    want = sorted(con.sql(f"SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM ({sql})").fetchall())
    got = sorted(map(tuple, queries.op1_risk_controlled_rules(spark, d).collect()))
    assert got == want and any(not r[6] and not r[7] for r in got)


@pytest.mark.parametrize("name, table", [("op2_warc_transactions", "pages"), ("op8_grouped_prefix_join", "documents")])
def test_archive_and_near_duplicate_sql(spark, name, table):
    import duckdb

    from tessera.llm import queries

    con = duckdb.connect()
    con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr) != []


def test_binomial_tail(spark):
    cases = [(0, 1500), (3, 1500), (9, 5000), (150, 40000), (20, 1500)]
    rows = spark.createDataFrame(cases, "k int, n int")
    for r in rows.select("k", "n", quality.binomial_tail(F.col("k"), F.col("n"), 0.005).alias("p")).collect():
        want = sum(math.exp(math.lgamma(r.n + 1) - math.lgamma(i + 1) - math.lgamma(r.n - i + 1) + i * math.log(0.005) + (r.n - i) * math.log1p(-0.005)) for i in range(r.k + 1))
        assert r.p == pytest.approx(want, rel=1e-8) if r.k < r.n * 0.005 else r.p == 1


def test_secret_spans(spark):
    texts = [None, "", 'é password = "abc" token: abcdef1 x', "PASSWD=abc=def secret=ab api_key='Zz09+/_.=-' AKIA" + "A1" * 9, "AKIAAKIA" + "0" * 9 + " " + "0a" * 14 + " zz", "password=token:abcdefg", "plain words only"]
    got = {r.doc_id: r for r in secret_scan.scan(docs_of(spark, texts)).collect()}
    assign = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for i, t in enumerate(texts):
        t = t or ""
        spans = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(t) if len(m[1]) >= 6]
        spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        want = ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), (i, want, got[i].spans)
        assert set(filter(None, want.split(","))) <= set(got[i].spans.split(","))
    masked = {r.doc_id: r.text for r in secret_scan.masked(docs_of(spark, texts)).collect()}
    assert masked[0] is None and masked[6] == texts[6] and "abcdef1" not in masked[2] and masked[2].startswith("é ")
    assert secret_scan.scan(docs_of(spark, [])).count() == 0


def test_markov_finds_random_strings(spark):
    rnd = random.Random(3)
    secret = "".join(rnd.choice("ABCDEFGHJKLMNPQRSTUVWXYZ0123456789abcdefghkmnpqrstuvwxyz") for _ in range(40))
    known = ["token=" + "".join(rnd.choice("ABCDEFGHJKLMNPQRSTUVWXYZ0123456789abcdefghkmnpqrstuvwxyz") for _ in range(30)) for _ in range(60)]
    plain = ["the_quick_brown_foxes jumping overlazydogs inthemorning sunshine_again"] * 40
    model = secret_scan.train(docs_of(spark, known + plain))
    found = secret_scan.with_spans(docs_of(spark, [f"here {secret} ends", *plain]), model)
    got = {r._id: r.spans for r in found.select("_id", secret_scan.listed(F.col("_all")).alias("spans")).collect()}
    assert got[0] == "markov:5:45" and all(not got[i] for i in range(1, 41))


def test_markov_among_numbers_and_unlabelled_secrets(spark):
    rnd = random.Random(8)
    key = lambda n: "".join(rnd.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    plain = ["the_quick_brown_foxes jumping overlazydogs inthemorning sunshine_again"] * 300
    texts = [f"token={key(30)}" for _ in range(600)] + [f"card {rnd.randrange(10**15, 10**16)} paid" for _ in range(30)] + [f"see {key(40)} there" for _ in range(10)] + plain
    model = secret_scan.train(docs_of(spark, texts))
    fresh = [f"see {key(40)} there" for _ in range(40)]
    got = {r._id: r.spans for r in secret_scan.with_spans(docs_of(spark, fresh + plain), model).select("_id", secret_scan.listed(F.col("_all")).alias("spans")).collect()}
    assert sum(got[i] == "markov:4:44" for i in range(40)) >= 36 and not any(got[i] for i in range(40, 340))


def test_markov_inside_runs(spark):
    rnd = random.Random(9)
    key = lambda n: "".join(rnd.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    path = "the_quick_brown_foxes/overlazydogs/inthemorning/sunshine_again"
    model = secret_scan.train(docs_of(spark, [f"token={key(30)}" for _ in range(600)] + [f"{path} jumping"] * 300))
    one, two = key(24), key(40)
    texts = [f"é {path}/{path}/{one}/{path}/{path}", "0a" * 12 + "/" + two, f"{path}/{path}", f"{path}/{path}/{one}/{path}/{path}/{path}/{two}/{path}/{path}"]
    got = [r.text for r in secret_scan.with_spans(docs_of(spark, texts), model).select("_id", F.transform("_all", lambda s: s["value"]).alias("text")).orderBy("_id").collect()]
    assert one in " ".join(got[0]) and sum(map(len, got[0])) < 60 and got[1][0] == "0a" * 12 and two in " ".join(got[1][1:])
    assert not got[2] and len(got[3]) == 2 and one in got[3][0] and two in got[3][1]


def test_markov_in_long_runs(spark):
    import time

    rnd = random.Random(5)
    key = lambda n: "".join(rnd.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    model = secret_scan.train(docs_of(spark, [f"token={key(30)}" for _ in range(300)] + ["the_quick_brown_foxes/overlazydogs"] * 300))
    began = time.time()
    texts = [key(300_000), "é " + "/".join(["overlazydogs"] * 30_000) + " " + key(40), " ".join(["the_quick_brown_foxes"] * 20_000)]
    got = {r._id: r.spans for r in secret_scan.with_spans(docs_of(spark, texts), model).select("_id", secret_scan.listed(F.col("_all")).alias("spans")).collect()}
    assert got[0] == "markov:0:300000" and got[1] == f"markov:{len(texts[1]) - 40}:{len(texts[1])}" and not got[2] and time.time() - began < 60


def test_bpe(spark):
    import public_tokenizers as P
    import tiktoken

    ranks = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(5)
    texts = [t or "" for t in ODD] + ["".join(rnd.choice("abab éß日本語 \n01") for _ in range(n)) for n in (10, 300, 3000)] + ["<|endoftext|>", "ab" * 5000]
    got = {r.doc_id: r for r in bpe.digests(docs_of(spark, [None, *texts]), ranks, P.PATTERN).collect()}
    for i, t in enumerate(["", *texts]):
        ids = own.encode_ordinary(t)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert [r.ids for r in bpe.encode_texts(docs_of(spark, ["a b"]), ranks, P.PATTERN).collect()] == [own.encode_ordinary("a b")]


def test_secrets_many_spans_in_one_text(spark):
    """Time in proportion to the spans, and places that hold across blocks of them, overlaps included."""
    import time

    rnd = random.Random(6)
    value = lambda: "".join(rnd.choice("abcdefghXYZ0123456789") for _ in range(8))
    parts = [f"é token={value()} word " if rnd.random() < 0.9 else "secret=" + "0a" * 14 + " " for _ in range(16_000)]
    text = "".join(parts)
    model = secret_scan.train(docs_of(spark, ["token=" + value() + value(), "ordinary_identifier"]))
    docs = docs_of(spark, [text]).select("doc_id", "text")
    secret_scan.with_spans(docs_of(spark, ["token=abcdefg x"]), model).count()  # compiled once
    began = time.time()
    row = secret_scan.with_spans(docs, model).select(F.size("_base").alias("n"), secret_scan._without(F.col("_text"), F.col("_base")).alias("cut")).first()
    assert time.time() - began < 12
    spans = [m.span() for m in re.finditer(r"(?:token|secret)=[a-zA-Z0-9]+", text)]
    want = list(text)
    for a, b in spans:
        want[a:b] = " " * (b - a)
    assert row.n == len(spans) + text.count("secret=") and row.cut == "".join(want)
    clean = secret_scan.masked(docs).first().text
    assert clean.count(secret_scan.MASK) == len(spans) and "token=" not in clean and clean.startswith("é ")


def test_toxicity_sample_is_bounded(spark):
    """One id on half of all rows, copies and unlike texts: the sample keeps its bound."""
    rows = [(1, f"bad words {i % 40}", "en") for i in range(400)] + [(i, f"fine words {i}", "en") for i in range(2, 60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, int(i == 1)) for i in range(1, 60)], "_id bigint, _y int")
    got = toxicity._sample(docs, labels, 12, "doc_id", "text", "lang")
    assert len(got) == 24 and sum(y for *_, y in got) == 12 and len({(i, x.tobytes()) for i, x, _, _ in got}) == 24


@pytest.mark.parametrize("leaf", [1, 2, 8, 32])
def test_bpe_tree_at_every_leaf(monkeypatch, leaf):
    """Pieces of the table's texts and long runs; the joins do run."""
    import duckdb
    import public_tokenizers as P
    import regex
    import tiktoken

    monkeypatch.setattr(bpe, "LEAF", leaf)
    monkeypatch.setattr(bpe, "IDS", leaf)
    ranks = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    tree, joins = bpe.Tree(ranks), []
    join = tree.join
    monkeypatch.setattr(tree, "join", lambda a, b: joins.append(1) or join(a, b))
    rnd, cut = random.Random(leaf), regex.compile(P.PATTERN)
    texts = [r[0] or "" for r in duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet'").fetchall()]
    texts += ["".join(rnd.choice("abcé日 ") for _ in range(n)) for n in (7, 90, 900)] + ["a" * 700, "ab" * 400, "\U0001f600" * 50]
    for t in texts:
        ids = [i for p in cut.findall(t) for i in tree.encode(p.encode())]
        assert ids == own.encode_ordinary(t) and tree.decode(ids) == t.encode()
    assert len(joins) > (1000 if leaf <= 8 else 50)


def test_packing_sizes_compete():
    """On the lengths of a whole table: larger bins than the first piece needs are opened, and some bins shrink."""
    import duckdb

    n = [len((r[0] or "").encode().split()) for r in duckdb.sql("SELECT text FROM '/root/testdata/sf0.1/documents.parquet' ORDER BY doc_id").fetchall()]
    sizes = sorted((p for x in n for p in [4096] * (x // 4096) + [x % 4096] if p), reverse=True)
    placed, opened, final = packing.pack(sizes)
    first = {}
    for size, b in zip(sizes, placed, strict=True):
        first.setdefault(b, size)
    larger = sum(o > min(c for c in packing.CAPACITIES if c >= first[b]) for b, o in enumerate(opened))
    assert larger > 0.2 * len(opened) and len(set(final)) >= 3 and all(f <= o for f, o in zip(final, opened, strict=True))


def test_bpe_and_packing_of_empty_tables(spark):
    import public_tokenizers as P

    ranks = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    assert bpe.digests(docs_of(spark, []), ranks, P.PATTERN).count() == 0 and bpe.encode_texts(docs_of(spark, []), ranks, P.PATTERN).count() == 0
    assert viterbi.count_pieces(docs_of(spark, []), viterbi.read_pieces(P.path("piece_bpe_32k.model"))).count() == 0
    assert jaccard.near_duplicates(docs_of(spark, [])).count() == 0


def test_viterbi(spark):
    from tokenizers import Tokenizer, models, pre_tokenizers
    import public_tokenizers as P

    for pieces, fallback in ((viterbi.read_pieces(P.path("piece_bpe_32k.model")), True), ([("▁", -1.0), ("a", -1.0), ("aa", -2.0), ("▁a", -2.0), ("aaa", -3.0), ("b", -2.5)], False)):
        tk = Tokenizer(models.Unigram([("<unk>", 0.0), *pieces], unk_id=0, byte_fallback=fallback))
        tk.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
        texts = [t or "" for t in ODD if len(t or "") < 10000] + [" a  b ", "aaaa aab xx日yy", "▁▁a"]
        got = {r.doc_id: r.n_pieces for r in viterbi.count_pieces(docs_of(spark, texts), pieces).collect()}
        for i, t in enumerate(texts):
            assert got[i] == len(tk.encode(t, add_special_tokens=False).ids), repr(t[:40])


def brute_components(texts):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(texts)))
    for _ in texts:
        for a in range(len(sets)):
            for b in range(a):
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    return [(len(s), c) for s, c in zip(sets, label, strict=True)]


def test_near_duplicates(spark):
    rnd = random.Random(2)
    word = lambda: rnd.choice("abcdefgh") + rnd.choice("ijkl") + rnd.choice("mnop")
    texts = [*ODD, "A B C a b C"]
    common = [word() for _ in range(60)]
    for _ in range(12):  # chains of edits, around the limit
        t = [word() for _ in range(rnd.choice([6, 20, 60]))]
        for _ in range(5):
            texts.append(" ".join(t))
            t = list(t)
            t[rnd.randrange(len(t))] = word()
    for _ in range(25):  # copies of one text with edits, and a passage that many share
        t = list(common)
        for _ in range(rnd.choice([0, 1, 2])):
            t[rnd.randrange(len(t))] = word()
        texts += [" ".join(t), " ".join([word() for _ in range(rnd.choice([3, 15, 40]))] + common)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs_of(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts)
    kept = jaccard.one_of_each(docs_of(spark, texts))
    assert kept.columns == [c.split()[0] for c in DOCS.split(", ")] and kept.count() == len({c for _, c in brute_components(texts)})


def test_near_duplicates_of_shared_passages(spark):
    parts = [" ".join(f"w{i}x{j}" for j in range(16)) for i in range(8)]
    texts = [f"{a} {b}" for a in parts for b in parts if a != b]  # a b and b a: 24 of 32 shingles; every passage is in 14 texts
    texts += [a.rsplit(" ", 1)[0] for a in parts] * 8  # all but the last shingle of a passage are more frequent
    random.Random(6).shuffle(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs_of(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts)


def test_one_of_each_by_row(spark):
    words = lambda k: " ".join(f"{k}{i}" for i in range(30))
    rows = [(None, words("a")), (None, words("b")), (None, words("b")), (1, words("c")), (1, words("d")), (2, words("d")), (2, words("e")), (3, words("f")), (None, words("f")), (None, None), (4, ""), (4, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(map(tuple, jaccard.one_of_each(df).collect()), key=str)
    assert got == sorted([(None, words("a")), (None, words("b")), (1, words("c")), (1, words("d")), (2, words("e")), (3, words("f")), (None, None), (4, ""), (4, "")], key=str)


def test_toxicity(spark):
    rnd = random.Random(4)
    plain = [" ".join(rnd.choice("red green blue tree house river stone cloud".split()) for _ in range(40)) for _ in range(400)]
    texts = [(t + " vile scum.") if i % 4 == 0 else t for i, t in enumerate(plain)] + [None, ""]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)] + [(None, 1, 1), (3, 1, None)], "doc_id bigint, quality int, toxic int")
    got = toxicity.classify(docs_of(spark, texts), labels).toPandas().set_index("doc_id")
    held = got[got.held_out & (got.index < 400)]
    assert len(held) > 60 and ((held.predicted == 1) == (held.index % 4 == 0)).mean() > 0.95
    assert got.score.between(0, 1).all() and got.loc[400].score == got.loc[401].score
    assert toxicity.classify(docs_of(spark, texts), labels.limit(0)).filter("predicted = 1").count() == 0


def test_toxicity_thresholds_use_all_labels(spark):
    rows = [(i, f"red green blue w{i % 7}" + (" vile scum" if i % 4 == 0 else ""), "de" if i % 3 else "en", int(i % 4 == 0)) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, toxic int")
    _, cuts = toxicity.train(df, df.select("doc_id", "toxic"), per_class=50)
    assert set(cuts) == {None, "de", "en"}  # with 50 rows a class for the fit, each language still has over 40 toxic rows


def test_packing(spark):
    sizes = [10, 300, 513, 4096, 9000, 1, 1, 700, 2000]
    texts = [None, "", *(" ".join(["w"] * n) for n in sizes)]
    got = packing.best_fit(docs_of(spark, texts)).toPandas()
    bins = got.groupby("bin_id").agg(used=("n_tokens", "sum"), capacity=("capacity", "first"))
    assert got.groupby("doc_id").n_tokens.sum().to_dict() == {i + 2: n for i, n in enumerate(sizes)}
    assert (bins.used <= bins.capacity).all() and all(c == min(x for x in packing.CAPACITIES if x >= u) for u, c in bins.itertuples(index=False))
    assert packing.best_fit(docs_of(spark, [])).count() == 0
    big = spark.createDataFrame([(None, "a b"), (9007199254740993, "a")], "doc_id bigint, text string")
    assert {r.doc_id for r in packing.best_fit(big).collect()} == {None, 9007199254740993}


def least_cost(sizes, caps):
    """Exhaustive: every way to deal the sizes into bins."""
    best = [math.inf]

    def go(i, bins):
        if i == len(sizes):
            best[0] = min(best[0], sum(packing.cost(min(c for c in caps if c >= b)) for b in bins))
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= caps[-1]:
                go(i + 1, [*bins[:k], bins[k] + sizes[i], *bins[k + 1 :]])
        go(i + 1, [*bins, sizes[i]])

    go(0, [])
    return best[0]


def test_packing_chooses_capacities():
    placed, opened, final = packing.pack([300, 300, 300], (512, 1024))
    assert opened == [1024] and final == [1024] and placed == [0, 0, 0]  # three bins of 512 would cost more
    _, opened, final = packing.pack([3588, 1758, 1105, 957, 591, 435])
    assert any(a > b for a, b in zip(opened, final, strict=True))  # a bin shrinks, as a piece of its trial found a tighter place
    rnd, own, best = random.Random(1), 0.0, 0.0
    for _ in range(120):
        sizes = sorted((rnd.randrange(1, 4097) if rnd.random() < 0.3 else rnd.randrange(1, 900) for _ in range(rnd.randrange(1, 7))), reverse=True)
        cost, least = sum(map(packing.cost, packing.pack(sizes)[2])), least_cost(sizes, packing.CAPACITIES)
        assert least <= cost <= 1.3 * least
        own, best = own + cost, best + least
    assert own <= 1.02 * best
    sizes = sorted((min(4096, int(rnd.lognormvariate(5.5, 1.2)) + 1) for _ in range(2000)), reverse=True)
    only = packing.pack(sizes, (4096,))[2]  # the one capacity that takes every piece
    assert sum(map(packing.cost, packing.pack(sizes)[2])) < 0.9 * sum(map(packing.cost, only))


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(600, 16)).astype(np.float32)
    v[7] = v[8]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(600, None), (601, [0.0] * 16), (602, [float("nan")] * 16), (603, [None] * 16), (None, v[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = neighbours.nearest(df, F.col("vec_id") % 20 == 0, per_shard=100).toPandas()
    hits = 0
    for q in range(0, 600, 20):
        dist = np.sqrt(((v.astype(float) - v[q].astype(float)) ** 2).sum(1))
        dist[q] = np.inf
        want = np.lexsort((np.arange(600), dist))[:10]
        own = got[got.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 11)) and np.allclose(own.score, dist[own.vec_id])
        hits += len(set(own.vec_id) & set(want))
    assert hits >= 0.9 * 300
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_neighbours_prune_and_block(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PER_BLOCK", 7)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 32)) * 2
    v = centres[rng.integers(0, 30, 3000)] + rng.normal(size=(3000, 32)) * 0.3
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(0, v[5].tolist()), (3000, v[0].tolist()), (3000, v[0].tolist())]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") % 50 == 0, per_shard=200).toPandas()
    ids, every, hits = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), 0
    for q in range(0, 3001, 50):
        own = got[got.query_id == q].sort_values("rank")
        asks = min(every[ids == q].tolist())  # of unlike rows of one id the least asks
        dist = np.sqrt(((every - asks) ** 2).sum(1))
        dist[ids == q] = np.inf
        want = np.lexsort((ids, dist))[:10]
        assert own["rank"].tolist() == list(range(1, 11)) and np.all(own.score.to_numpy() >= dist[want] - 1e-9)
        hits += int(np.isclose(own.score.to_numpy(), dist[want]).sum())
    assert hits >= 0.9 * 610 and got.groupby("query_id").n_verified.first().mean() < 0.2 * len(rows)


def test_warc(spark, tmp_path):
    pages = [(1, "http://a/", "<p>é</p>"), (2, "http://b/", "<p>é</p>"), (3, None, None), (4, "http://c/", ""), (5, "x", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"), (6, "y", "one")]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    got = {r.page_id: r for r in warc.round_trip(df).collect()}
    last = {}
    for i, _, h in pages:
        last[h or ""] = i
    for i, _, h in pages:
        b, r = (h or "").encode(), got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if last[h or ""] == i else ("revisit", last[h or ""]))
    warc.write_archives(df, str(tmp_path / "w"))
    captures = warc.assemble(warc.read_archives(spark, str(tmp_path / "w")))
    assert {(r.n_requests, r.n_metadata) for r in captures.collect()} == {(1, 1)} and captures.filter("response.payload is not null").count() == 4
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_odd_archives(spark, tmp_path):
    import gzip

    record = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\nContent-Length: 22\r\n\r\nHTTP/1.1 200 OK\r\n\r\nabc\r\n\r\n"
    broken = record.replace(b": 22", b": many").replace(b"<a>", b"<b>")
    cut = gzip.compress(record * 2000)
    files = {"cut.gz": cut[: len(cut) // 2], "odd.warc": broken + record, "tail.warc": record + record[:-12], "none.warc": b"", "junk.gz": b"\x1f\x8bxx"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = warc.read_archives(spark, str(tmp_path)).select("record_id", "payload").collect()
    assert {(r.record_id, bytes(r.payload)) for r in got} == {("<a>", b"abc")} and len(got) > 2


def test_node_of_matches_python(spark):
    texts = ["", " \t\n", "A b", "\x0bA  B\x0c\r\n c ", "ÀÉ İ ſ K a\u00a0B \u2003x\x1cY\x85z", "Straße SS ΣΑΣ", "𝒜 \x00 Q", "W " * 5000]
    rows = docs_of(spark, texts).select("text", jaccard.node_of(F.col("text")).alias("node")).collect()
    assert [r.node for r in rows] == [jaccard._digest(b" ".join(jaccard._words(r.text))) for r in rows] and len({r.node for r in rows}) == 7


def test_warc_whole_transactions(spark, monkeypatch):
    """Every side record of a capture is emitted, over any number of steps, with or without identifier, in parts where there are many."""
    side = [("q1", "request", ["r"]), ("q2", "request", ["r"]), ("m1", "metadata", ["q1"]), ("m2", "metadata", ["m1"]), ("m3", "metadata", ["m2", "nowhere"]), ("m4", "metadata", None), ("m5", "metadata", ["m4"]), (None, "metadata", ["r"])]
    lost = [("o1", "metadata", ["o2"]), ("o2", "request", ["o1"]), ("o3", "metadata", [])]
    main = [("r", "response", []), ("v", "revisit", ["m4"]), ("bare", "response", None), (None, "response", ["q1"])]
    rows = [(i, k, f"u-{i}", c, None, None, 1, "h", {"of": str(i)} if k == "metadata" else {}, None) for i, k, c in main + side + side[:3] + lost]
    records = spark.createDataFrame(rows, warc.RECORDS).withColumn("part", F.lit("clash"))
    want = {"r": {"q1", "q2", "m1", "m2", "m3", None}, "v": {"m4", "m5"}, "bare": set(), None: set()}
    for most in (1000, 2):
        monkeypatch.setattr(warc, "PART", most)
        got = warc.assemble(records).collect()
        found = {}
        for r in got:
            assert (r.n_requests, r.n_metadata) == (len(r.requests), len(r.metadata)) and r.response.record_id == r.record_id and r.response.part == "clash"
            assert all(m.fields == {"of": str(m.record_id)} and m.target_uri == f"u-{m.record_id}" for m in r.metadata)
            found.setdefault(r.record_id, []).extend(x.record_id for x in r.requests + r.metadata)
        assert {k: set(v) for k, v in found.items()} == want and all(len(v) == len(set(v)) for v in found.values())
        assert (len(got) == 4) if most == 1000 else (len({r.part for r in got if r.record_id == "r"}) > 1)
    assert warc.assemble(records.limit(0)).count() == 0


def test_url_ranks(spark):
    """Both rankings against the dense solution in which hosts without out-links return their mass to the seeds."""
    rnd = random.Random(4)
    hosts = [f"h{i}" for i in range(12)]
    edges = sorted({(a, b): rnd.randrange(1, 5) for a in hosts[:9] for b in rnd.sample(hosts, 3) if a != b}.items())
    rows = [(a, b, n) for (a, b), n in edges]
    seeds = [("h0", "trust", 0.5), ("h3", "trust", 0.5), ("h7", "distrust", 1.0)]
    got = {(r.host, r.kind): r["rank"] for r in url_graph.propagate(spark.createDataFrame(rows, "src string, dst string, links bigint"), spark.createDataFrame(seeds, "host string, kind string, share double"), 1e-9).collect()}
    for kind in ("trust", "distrust"):
        w, s = np.zeros((12, 12)), np.array([sum(x for h, k, x in seeds if (h, k) == (y, kind)) for y in hosts])
        for a, b, n in rows:
            i, j = (hosts.index(a), hosts.index(b)) if kind == "trust" else (hosts.index(b), hosts.index(a))
            w[j, i] += n
        out = w.sum(0)
        w = np.where(out > 0, w / np.where(out > 0, out, 1), s[:, None])
        r = np.linalg.solve(np.eye(12) - 0.85 * w, 0.15 * s)
        own = np.array([got.get((h, kind), 0.0) for h in hosts])
        assert np.allclose(own / own.sum(), r, atol=1e-8)


def test_url_filter(spark):
    cases = {
        None: ("", "", None), "": ("", "", None), "nohost": ("", "", None), "http://A.Net/x?y": ("a.net", "/x", "net/"), "http://example.net/en/1#f": ("example.net", "/en/1", "example.net/en/"),
        "https://m.example.com/de/": ("m.example.com", "/de/", "example.com/de/"), "http://x.org/fr/a": ("x.org", "/fr/a", "org/fr/"), "http://x.org/en": ("x.org", "/en", None), "http://net?x": ("net", "", None), "a://b://c/d": ("b:", "//c/d", None), "http://badexample.com/de/": ("badexample.com", "/de/", None),
    }
    html = '<a href="http://good.test/x">g</a> <A class=q HREF=\'http://evil.net/\'>'
    rows = [(i, u, html if u == "http://x.org/en" else None) for i, u in enumerate(cases)] + [(100, "http://links.test/", '<a href="http://evil.net/a">' * 3), (101, "http://evil.net/q", "")]
    got = {r.page_id: r for r in url_graph.judge(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    for i, (u, want) in enumerate(cases.items()):
        assert (got[i].host, got[i].path, got[i].rule) == want, u
    assert [got[i].verdict for i in (0, 3, 4, 5, 6)] == ["allow", "block", "allow", "block", "allow"]
    assert got[100].verdict == "block" and got[100].distrust > 0.5
    edges = url_graph.host_edges(spark.createDataFrame(rows, "page_id bigint, url string, html string"))
    assert ("links.test", "evil.net", 3) in {tuple(r) for r in edges.collect()}


def test_toxicity_keeps_clean(spark):
    rows = [(i, f"red green blue w{i % 7}" + (" vile scum" if i % 4 == 0 else ""), "en" if i % 3 else None, f"x{i}") for i in range(1200)] + [(None, None, None, None), (5000, "", "en", "y")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, _score string")
    kept = toxicity.keep_clean(df, spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(1200)], "doc_id bigint, toxic int"))
    assert kept.columns == df.columns
    got = {r.doc_id for r in kept.collect()}
    assert len({i for i in range(0, 1200, 4)} & got) <= 6 and len({i for i in range(1200) if i % 4} - got) <= 9 and None in got


def test_pipeline(spark, tmp_path):
    """Each stage's decision against what its operator says of its input, over nulls, copies and clashing column names; then no rows."""
    import corpus_pipeline

    rnd = random.Random(12)
    prose = lambda n: " ".join(rnd.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()) + str(rnd.randrange(50)) for _ in range(n))
    base = [prose(80) for _ in range(40)]
    texts = base + base[:5] + [base[5] + " tail"] + [None, "", "short"] + [prose(60) + " token=" + "Ab9" * 8, prose(5000)]
    rows = [(i if i != 7 else None, t, "en", "s", len(t or ""), "a", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, _row string, _text int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    at = docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == docs.columns, name
        seen[name] = [(r.doc_id, r.text) for r in at.collect()]
    long_enough = [(r[0], r[1]) for r in rows if len((r[1] or "").split()) >= 50]
    assert sorted(seen["quality rules"], key=str) == sorted(long_enough, key=str) == sorted(seen["toxicity"], key=str)
    unlike = {t: i for i, t in reversed(long_enough) if not t.endswith(" tail")}
    assert sorted(t for _, t in seen["near duplicates"]) == sorted(unlike)
    assert not any("Ab9Ab9" in t for _, t in seen["secrets"]) and len(seen["secrets"]) == len(unlike)
    packed = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert packed.n_tokens.sum() == sum(len(t.split()) for _, t in seen["secrets"])
    empty = tmp_path / "empty"
    docs.limit(0).write.parquet(str(empty / "documents.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(empty / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
