"""A convolutional text classifier for toxicity, trained in numpy on a bounded sample.

Words (lower case, outer punctuation off) are hashed into BUCKETS embeddings. Filters of several widths slide over a text, each
keeps its greatest response anywhere in the text, and a logistic layer weighs them. The fit uses at most ``per_class``
labelled rows of each class (those of smallest hash; of them texts of up to FIT_CHARS characters; copies of a row count once), weighted back to the classes' true shares, which are counted over all
labelled rows; all other labelled rows (a quarter, by hash) are scored and counted by language, score bin and label, and these
counts scale the scores (Platt) and set a threshold per language where it has enough positives, else for all languages together. The first dimension of an embedding starts from how the word goes with the label in the sample; the fit moves all of them. Scores come from the text alone. Every row is scored, over
its whole text, with filters folded into the embeddings, so that a word costs one table row per filter offset.

Nulls and edges: null and empty texts are scored as an empty text; labels with nulls are ignored; a doc_id with several
labels counts by its greatest; without labels of both classes every score is the share of toxic labels (0 without any);
repeated rows get equal scores; an empty table gives no rows; only the named columns are read, so others can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

BUCKETS, DIM, WIDTHS, FILTERS = 1 << 15, 16, (1, 2, 3), 12
PER_CLASS, EPOCHS, MOST_EPOCHS, STEPS, BATCH = 3000, 4, 12, 800, 32
FIT_CHARS = 20_000  # longer texts are not drawn for the fit, so its sample is bounded in bytes too; they are calibrated on and scored like all
MIN_POSITIVES = 40
BINS = 200  # of a unit of logit, for scale and thresholds
OUTER = ".,;:!?\"'()[]{}*#$%&|<>«»¡¿-"


class Hashed(dict):
    """word -> bucket; bucket 0 is padding. Emptied when full."""

    def __missing__(self, word: str) -> int:
        import zlib

        if len(self) >= 500_000:
            self.clear()
        found = self[word] = 1 + zlib.crc32(word.strip(OUTER).encode("utf-8", "surrogatepass")) % (BUCKETS - 1)
        return found


def word_ids(text: str, known: Hashed) -> np.ndarray:
    """Buckets of a text's words and the padding behind them."""
    words = text.lower().split()
    ids = np.zeros(len(words) + max(WIDTHS), np.int32)
    if words:
        ids[: len(words)] = np.fromiter(map(known.__getitem__, words), np.int32, len(words))
    return ids


class Net:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
        self.emb[0] = 0
        self.w = [rng.normal(0, 0.3, (k, DIM, FILTERS)).astype(np.float32) for k in WIDTHS]
        self.b = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out, self.bias = rng.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32), np.float32(0)
        self.scale, self.shift = 1.0, 0.0

    def fit(self, texts: list[np.ndarray], y: np.ndarray, weight: np.ndarray, seed: int = 7) -> None:
        rng, rate = np.random.default_rng(seed), 0.02
        params = [*self.w, *self.b, self.out]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
        seen, t = np.full((BUCKETS, 1), 1e-6, np.float32), 0
        share = float((weight * y).sum() / weight.sum())
        self.bias = np.float32(np.log(share / (1 - share)))
        # First dimension: how much more often than by chance a word's documents are toxic, in standard deviations.
        with_word = [np.bincount(np.concatenate([np.empty(0, np.int64), *(np.unique(x) for x, c in zip(texts, y, strict=True) if c == k)]), minlength=BUCKETS) for k in (0, 1)]
        share = float(y.mean())
        chance = (with_word[0] + with_word[1]) * share
        self.emb[:, 0] += np.clip((with_word[1] - chance) / np.sqrt(chance * (1 - share) + 1), -3, 6).astype(np.float32) / 3
        self.emb[0] = 0
        self.w[0][0, 0, : FILTERS // 3] += 1
        for _ in range(int(min(MOST_EPOCHS, max(EPOCHS, STEPS * BATCH // len(texts))))):
            order = rng.permutation(len(texts))
            for lo in range(0, len(order), BATCH):
                part = order[lo : lo + BATCH]
                ids = np.concatenate([texts[i] for i in part])
                starts = np.cumsum([0, *(len(texts[i]) for i in part)])
                x, tops, places = self.emb[ids], [], []
                for k, w, b in zip(WIDTHS, self.w, self.b, strict=True):
                    z = sum((x @ w[j] if not j else np.vstack([x[j:] @ w[j], np.zeros((j, FILTERS), np.float32)])) for j in range(k)) + b
                    at = np.stack([s + z[s : e - max(WIDTHS) + 1].argmax(0) for s, e in zip(starts[:-1], starts[1:], strict=True)])
                    tops.append(np.take_along_axis(z, at, 0))
                    places.append(at)
                top = np.hstack(tops)
                act = np.maximum(top, 0)
                p = 1 / (1 + np.exp(-(act @ self.out + self.bias)))
                err = ((p - y[part]) * weight[part] / weight.mean() / len(part)).astype(np.float32)
                back = err[:, None] * self.out * (top > 0)
                grads_w, grads_b = [], []
                for n, (k, w, at) in enumerate(zip(WIDTHS, self.w, places, strict=True)):
                    g = back[:, n * FILTERS : (n + 1) * FILTERS]
                    gw = np.zeros_like(w)
                    for j in range(k):
                        gw[j] = np.einsum("nfd,nf->df", x[at + j], g)
                        word, step = ids[at + j].ravel(), (g[:, :, None] * w[j].T).reshape(-1, DIM)
                        np.add.at(seen, word, (step**2).mean(1, keepdims=True))
                        np.add.at(self.emb, word, -0.1 * step / np.sqrt(seen[word]))
                    grads_w.append(gw)
                    grads_b.append(g.sum(0))
                self.emb[0] = 0
                t += 1
                self.bias -= np.float32(rate * err.sum())
                for param, grad, (m, v) in zip(params, [*grads_w, *grads_b, act.T @ err], moments, strict=True):
                    m += 0.1 * (grad - m)
                    v += 0.001 * (grad**2 - v)
                    param -= (rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)).astype(np.float32)

    def folded(self) -> tuple:
        """Per width and offset the response of every word, so that scoring needs no product."""
        return [[(self.emb @ w[j] + (b if not j else 0)).astype(np.float32) for j in range(k)] for k, w, b in zip(WIDTHS, self.w, self.b, strict=True)], self.out, float(self.bias), self.scale, self.shift


def logit(model: tuple, ids: np.ndarray) -> float:
    tables, out, bias, _, _ = model
    n, tops = len(ids) - max(WIDTHS) + 1, []
    for rows in tables:
        z = rows[0][ids[:n]]
        for j in range(1, len(rows)):
            z += rows[j][ids[j : n + j]]
        tops.append(z.max(0))
    return float(np.maximum(np.concatenate(tops), 0) @ out + bias)


def _sample(docs: DataFrame, labels: DataFrame, per_class: int, id_col: str, text_col: str, lang_col: str) -> list:
    """Buckets, label and language of at most per_class rows of each class; texts are hashed on the executors."""
    picked = None
    for c in (0, 1):
        one = labels.filter(F.col("_y") == c).orderBy(F.xxhash64("_id", F.lit(11)), "_id").limit(per_class)
        picked = one if picked is None else picked.unionByName(one)
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), F.col(lang_col).alias("_lang")).join(F.broadcast(picked), "_id").filter(F.length("_text") <= FIT_CHARS)

    def hashed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        known, seen = Hashed(), set()
        for b in batches:
            ids = [word_ids(t.as_py(), known) for t in b.column(1)]
            keys = [(i, hashlib.sha256(np.asarray(x, np.int32).tobytes()).digest()) for i, x in zip(b.column(0).to_pylist(), ids, strict=True)]
            fresh = []
            for key in keys:
                fresh.append(key not in seen)
                seen.add(key)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32())), b.column(2), b.column(3)], ["id", "ids", "lang", "y"]).filter(pa.array(fresh, pa.bool_()))

    # Copies of a row go on the executors, and of an id with very many texts no more than per_class rows come here.
    found = rows.select("_id", "_text", "_lang", "_y").mapInArrow(hashed, "id bigint, ids array<int>, lang string, y int").groupBy("id", "ids").agg(F.min("lang").alias("lang"), F.max("y").alias("y"))
    found, out = stored(found, "sample"), []
    for c in (0, 1):
        one = found.filter(F.col("y") == c).orderBy(F.xxhash64("id", "ids"), "id").limit(per_class).toArrow()
        ids = [np.asarray(x.values, np.int32) for x in one.column("ids")]
        out += zip(one.column("id").to_pylist(), ids, one.column("lang").to_pylist(), one.column("y").to_pylist(), strict=True)
    return sorted(out, key=lambda r: (r[0], len(r[1]), r[1].tobytes()))


def _counted(docs: DataFrame, labels: DataFrame, model: tuple, id_col: str, text_col: str, lang_col: str) -> list:
    """Rows of every labelled document's language, bin of its logit and label, with their count, in a fixed order."""
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang")).join(labels, "_id")
    found = scores(rows, model, ["_lang", "_y"], "_text")
    p = F.greatest(F.least("_score", F.lit(1 - 1e-15)), F.lit(1e-15))
    counts = found.select("_lang", "_y", F.floor(F.log(p / (1 - p)) * BINS).alias("_bin")).groupBy("_lang", "_bin", "_y").count()
    return sorted(counts.collect(), key=lambda r: (r["_lang"] or "", r["_bin"], r["_y"]))  # bounded by languages x bins


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic") -> tuple[tuple, dict]:
    """The folded model and the thresholds by language (None: all the others). labels must not hold held-out rows."""
    y = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("_y")).filter("_id is not null and _y in (0, 1)").groupBy("_id").agg(F.max("_y").alias("_y"))
    share = {r["_y"]: r["count"] for r in y.groupBy("_y").count().collect()}
    net = Net()
    if len(share) < 2:
        net.out[:] = 0
        net.bias = np.float32(30.0 if 1 in share else -30.0)
        return net.folded(), {None: 0.3}
    calibrates = F.pmod(F.xxhash64("_id", F.lit(5)), F.lit(4)) == 0
    first = _sample(docs, y.filter(~calibrates), per_class, id_col, text_col, lang_col)

    def arrays(rows: list) -> tuple[list, np.ndarray, np.ndarray]:
        labels = np.array([r[3] for r in rows], np.float32)
        weight = np.where(labels == 1, share[1] / max(1, labels.sum()), share[0] / max(1, (1 - labels).sum())).astype(np.float64)
        return [r[1] for r in rows], labels, weight

    if len({r[3] for r in first}) == 2:
        net.fit(*arrays(first))
    model = net.folded()
    counts = _counted(docs, y.filter(calibrates), model, id_col, text_col, lang_col)
    truth, weight = np.array([r["_y"] for r in counts], np.float64), np.array([r["count"] for r in counts], np.float64)
    if len(set(truth)) < 2:
        return model, {None: 0.3}
    z = np.array([(r["_bin"] + 0.5) / BINS for r in counts])
    a, b = 1.0, 0.0
    for _ in range(300):  # Platt's scaling with a weak pull to a = 1, b = 0
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
        e = (p - truth) * weight / weight.sum()
        a, b = a - 0.3 * ((e * z).sum() + 0.01 * (a - 1)), b - 0.3 * (e.sum() + 0.01 * b)
    net.scale, net.shift = float(np.clip(a, 0.3, 5)), float(np.clip(b, -5, 5))
    scores = 1 / (1 + np.exp(-np.clip(net.scale * z + net.shift, -40, 40)))

    def best(mask: np.ndarray) -> float:
        """The threshold of greatest F1; halfway between two scores."""
        order = np.argsort(-scores[mask], kind="stable")
        s, t, w = scores[mask][order], truth[mask][order], weight[mask][order]
        hit, all_ = np.cumsum(t * w), np.cumsum(w)
        f1 = 2 * hit / (all_ + (t * w).sum())
        f1[:-1][s[:-1] == s[1:]] = 0
        i = int(f1.argmax())
        return float(min(max((s[i] + s[i + 1]) / 2 if i + 1 < len(s) else s[i], 0.05), 0.9))

    langs = np.array([r["_lang"] or "" for r in counts])
    cuts = {None: best(np.ones(len(z), bool)) if (weight * truth).sum() >= MIN_POSITIVES else 0.5}
    for lang in sorted(set(langs) - {""}):
        own = langs == lang
        if (weight * truth)[own].sum() >= MIN_POSITIVES and (weight * (1 - truth))[own].sum() >= MIN_POSITIVES:
            cuts[lang] = best(own)
    return net.folded(), cuts


def scores(docs: DataFrame, model: tuple, columns: list[str], text_col: str = "text") -> DataFrame:
    """``columns`` of docs and _score; the model (a fixed size, about 9 MB) travels in a broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = docs.select(*[F.col(f"`{c}`") for c in columns]).schema.add("_score", "double")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        known, model = Hashed(), shared.value
        for b in batches:
            z = np.array([logit(model, word_ids(t.as_py(), known)) for t in b.column(b.num_columns - 1)])
            p = 1 / (1 + np.exp(-np.clip(model[3] * z + model[4], -40, 40)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(p, pa.float64())], [*columns, "_score"])

    return docs.select(*[F.col(f"`{c}`") for c in columns], F.coalesce(F.col(text_col), F.lit("")).alias("_text_")).mapInArrow(run, fields)


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string")) % 4 == 2


def over(cuts: dict, lang, score):
    """Whether a score reaches its language's threshold."""
    rest = F.lit(cuts[None])
    for name, cut in cuts.items():
        if name is not None:
            rest = F.when(lang == name, cut).otherwise(rest)
    return score >= rest


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.3) and toxic (score reaches the language's threshold)."""
    model, cuts = train(docs, labels.filter(~held_out()))
    found = scores(docs.select("doc_id", "lang", "text"), model, ["doc_id", "lang"])
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.3).cast("int").alias("predicted"), over(cuts, F.col("lang"), F.col("_score")).alias("toxic"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs whose score stays below their language's threshold, with their own columns."""
    model, cuts = train(docs, labels)
    plain = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("lang").alias("_lang"), F.col("text").alias("text"))
    found = scores(plain, model, ["_row", "_lang"])
    return found.filter(~over(cuts, F.col("_lang"), F.col("_score"))).select("_row.*")
