"""Operator 7: toxicity by a classifier chain.

Categories are predicted one after another by logistic regressions over word presence. Each later model also reads the
probabilities of the earlier categories; in training those are out-of-fold predictions, so that a later model learns
from probabilities as uncertain as the ones it meets in scoring. The last category is the verdict.

Training is on a bounded sample: at most ``max_labelled`` labelled documents, those with the smallest hashes of doc_id,
and on those of the ``max_words`` words that part the sample's classes beyond chance. Counting words is done by Spark over the sample's
whole texts; only word presence by document reaches the driver. Scoring reads every whole text.

Categories that the labels lack are derived for the sample: ``direct`` (toxic, with a word that is strongly tied to
toxic documents), ``repeated`` (toxic, with two of them). For a document in a fold, these words and the words that its
out-of-fold prediction may use are those of the other folds.

Edge cases: null and empty texts have no words and get the base probability; without labels, or with one class only,
every probability is 0; repeated rows are scored alike; of different texts with one labelled doc_id the one of smallest
hash is learned from; texts of any length are read whole; label columns that clash with document columns don't meet
them; columns named like the added ones are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feira.llm.common import fresh, small_batches, table, texts, written

MAX_LABELLED = 20_000
MAX_WORDS = 2_000
FOLDS = 5
#: Smoothed share of a word's documents that are toxic, from which the word is strongly tied to them.
STRONG = 0.8
CATEGORIES = ("direct", "repeated", "toxic")

#: A-Z to a-z; what is neither letter, digit nor part of a longer UTF-8 sequence to a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))


@dataclass
class Chain:
    """Words with weights (words x categories), biases and the weights of earlier categories (category x category)."""

    words: dict[bytes, int]
    weights: np.ndarray
    bias: np.ndarray
    links: np.ndarray
    threshold: float = 0.5

    def probabilities(self, found: list[int]) -> np.ndarray:
        out = np.zeros(len(self.bias))
        sums = self.weights[found].sum(axis=0) if found else np.zeros(len(self.bias))
        for k in range(len(out)):
            out[k] = _sigmoid(sums[k] + self.bias[k] + self.links[k, :k] @ out[:k])
        return out


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def _fit(rows: list[np.ndarray], extra: np.ndarray, y: np.ndarray, n_words: int, penalty: float = 1e-4, steps: int = 300) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression on sparse presence (places of words by row) and dense ``extra`` columns, by accelerated
    gradient descent with an L2 penalty."""
    n, e = len(y), extra.shape[1]
    at = np.concatenate(rows).astype(np.int64) if n else np.empty(0, np.int64)
    of = np.repeat(np.arange(n), [len(r) for r in rows])
    w, v = np.zeros(n_words + e + 1), np.zeros(n_words + e + 1)
    u = np.ones(len(w))
    for _ in range(12):  # the curvature's bound, by power iteration
        u /= max(np.linalg.norm(u), 1e-12)
        z = np.bincount(of, u[at], n) + extra @ u[n_words : n_words + e] + u[-1]
        u = np.concatenate([np.bincount(at, z[of], n_words), extra.T @ z, [z.sum()]]) / max(n, 1)
    rate = 1.0 / (0.25 * 1.1 * max(np.linalg.norm(u), 1e-6) + penalty)
    for step in range(steps):
        look = w + (step / (step + 3)) * v
        z = np.bincount(of, look[at], n) + extra @ look[n_words : n_words + e] + look[-1]
        g = (_sigmoid(z) - y) / n
        grad = np.concatenate([np.bincount(at, g[of], n_words), extra.T @ g, [g.sum()]]) + penalty * np.append(look[:-1], 0.0)
        new = look - rate * grad
        w, v = new, new - w
    return w[:n_words], w[n_words : n_words + e], float(w[-1])


def _gains(a: np.ndarray, b: np.ndarray, n1: np.ndarray, n0: np.ndarray) -> np.ndarray:
    """The log-likelihood ratio of word and class, as in ``fit``, from numpy arrays of counts."""
    part = lambda x, e: np.where(x > 0, x * np.log(np.maximum(x, 1e-9) / np.maximum(e, 1e-9)), 0.0)
    has = (a + b) / np.maximum(n1 + n0, 1)
    return 2 * (part(a, has * n1) + part(b, has * n0) + part(n1 - a, (1 - has) * n1) + part(n0 - b, (1 - has) * n0))


def train_chain(rows: list[np.ndarray], labels: np.ndarray, folds: np.ndarray, n_words: int, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Weights, biases, links and the last category's out-of-fold predictions of a chain over ``labels`` (documents x categories); ``folds`` numbers each document. ``known`` (words x folds): the
    words that predictions for a fold may use, chosen without its documents."""
    n, m = labels.shape
    weights, bias, links = np.zeros((n_words, m)), np.zeros(m), np.zeros((m, m))
    earlier = np.zeros((n, 0))
    for k in range(m):
        y = labels[:, k].astype(float)
        if y.min(initial=1) == y.max(initial=0):  # one class only: nothing to part
            bias[k] = 30.0 if n and y[0] else -30.0
            earlier = np.column_stack([earlier, y])
            continue
        weights[:, k], links[k, :k], bias[k] = _fit(rows, earlier, y, n_words)
        ahead = np.zeros(n)
        for f in np.unique(folds):
            out, rest = np.flatnonzero(folds == f), np.flatnonzero(folds != f)
            mine = (lambda x: x) if known is None else (lambda x, ok=known[:, f]: x[ok[x]])
            w, e, b = _fit([mine(rows[i]) for i in rest], earlier[rest], y[rest], n_words)
            ahead[out] = [_sigmoid(w[mine(rows[i])].sum() + earlier[i] @ e + b) for i in out]
        earlier = np.column_stack([earlier, ahead])
    return weights, bias, links, earlier[:, -1]


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The cut of highest F1, halfway between two predictions; 0.5 if none parts the classes."""
    order = np.argsort(-p, kind="stable")
    p, hits = p[order], np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + max(1, y.sum()))
    ends = np.flatnonzero(np.append(p[:-1] - p[1:] > 1e-4, False))
    if not len(ends):
        return 0.5
    k = ends[np.argmax(f1[ends])]
    return float((p[k] + p[k + 1]) / 2)


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_words: int = MAX_WORDS) -> Chain:
    """A chain for CATEGORIES from ``labels`` (doc_id, toxic) of ``docs``."""
    one = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    one = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    small_batches(docs.sparkSession)

    def distinct_words(batches):
        import pyarrow as pa

        for b in batches:
            sets = [list(set(t.translate(FOLD).split())) for t in texts(b)]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "toxic": b.column("toxic"), "words": pa.array(sets, pa.list_(pa.binary()))})

    # at most max_labelled rows of two numbers go out, so the texts stay where they are; of texts with one doc_id the
    # one of smallest hash counts
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(one), "doc_id")
    known = known.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select("doc_id", F.col("toxic").cast("int").alias("toxic"), "t.text")
    sample = written(known.mapInArrow(distinct_words, "doc_id long, toxic int, words array<binary>"), "tox-sample")
    size = sample.groupBy("toxic").count().collect()
    n = {r.toxic: r["count"] for r in size}
    if not (n.get(0) and n.get(1)):
        return Chain({}, np.zeros((0, len(CATEGORIES))), np.full(len(CATEGORIES), -30.0), np.zeros((len(CATEGORIES),) * 2))
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int")
    word = sample.select("toxic", fold.alias("fold"), F.explode("words").alias("word")).groupBy("word")
    by_fold = lambda f, c: F.sum(F.when(F.col("fold") == f, c).otherwise(0))
    folded = F.array(*[F.struct(by_fold(f, F.col("toxic")).alias("a"), by_fold(f, 1 - F.col("toxic")).alias("b")) for f in range(FOLDS)])
    counts = word.agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"), folded.alias("folds")).filter("a + b >= 3")
    # the log-likelihood ratio of word and class; by chance alone it passes 2 ln(words) for about one word
    part = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    whole, a, b = n[0] + n[1], F.col("a"), F.col("b")
    has = (a + b) / whole
    gain = 2 * (part(a, has * n[1]) + part(b, has * n[0]) + part(n[1] - a, (1 - has) * n[1]) + part(n[0] - b, (1 - has) * n[0]))
    counts = written(counts.withColumn("gain", gain), "tox-words")
    floor = 2 * math.log(max(counts.count(), 2))
    best = counts.filter(F.col("gain") >= floor).orderBy(F.desc("gain"), "word").limit(max_words).collect()
    words = {bytes(r.word): k for k, r in enumerate(best)}
    # what each fold may know of words: counts without its own documents
    in_fold = np.array([[(x.a, x.b) for x in r.folds] for r in best], float).reshape(len(best), FOLDS, 2)
    rest = in_fold.sum(axis=1, keepdims=True) - in_fold
    of_fold = {(r.fold, r.toxic): r["count"] for r in sample.groupBy(fold.alias("fold"), "toxic").count().collect()}
    held = np.array([[n[k] - of_fold.get((f, k), 0) for k in (1, 0)] for f in range(FOLDS)], float)
    share = (rest + 0.5) / (held + 1.0)
    loud = share[:, :, 0] / share.sum(axis=2) >= STRONG
    known_words = _gains(rest[:, :, 0], rest[:, :, 1], held[:, 0], held[:, 1]) >= floor

    def places(batches):
        import pyarrow as pa

        for b in batches:
            found = [sorted(words[w] for w in x if w in words) for x in b.column("words").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "toxic": b.column("toxic"), "fold": b.column("fold"), "at": pa.array(found, pa.list_(pa.int32()))})

    rows = sample.withColumn("fold", fold).select("doc_id", "toxic", "fold", "words").mapInArrow(places, "doc_id long, toxic int, fold int, at array<int>")
    rows = sorted(rows.collect(), key=lambda r: r.doc_id)
    at = [np.array(r.at, np.int64) for r in rows]
    toxic = np.array([r.toxic for r in rows])
    folds = np.array([r.fold for r in rows])
    hits = np.array([loud[x, f].sum() for x, f in zip(at, folds, strict=True)])
    y = np.column_stack([toxic & (hits >= 1), toxic & (hits >= 2), toxic])
    *model, ahead = train_chain(at, y, folds, len(words), known_words)
    return Chain(words, *model, best_threshold(ahead, toxic))


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """``docs`` with p_direct, p_repeated and p_toxic; every whole text is read, in one pass over the input."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(chain)  # at most MAX_WORDS words

    @F.arrow_udf("array<double>")
    def probabilities(text):
        import pyarrow as pa

        chain = shared.value
        words = chain.words
        none, seen, out = chain.probabilities([]), {}, []
        for t in text.cast(pa.binary()).to_pylist():
            found = words.keys() & t.translate(FOLD).split() if t else ()
            if not found:
                out.append(none)
                continue
            key = tuple(sorted(words[w] for w in found))
            if key not in seen:
                seen[key] = chain.probabilities(list(key))
            out.append(seen[key])
        return pa.array([x.tolist() for x in out], pa.list_(pa.float64()))

    docs = fresh(docs, "tox_p", *(f"p_{c}" for c in CATEGORIES))
    out = docs.withColumn("tox_p", probabilities("text"))
    return out.withColumns({f"p_{c}": F.col("tox_p")[k] for k, c in enumerate(CATEGORIES)}).drop("tox_p")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float | None = None) -> DataFrame:
    """``docs`` with the chain's probabilities and ``toxic`` (p_toxic at ``threshold`` or above; by default the
    threshold of highest F1 over the out-of-fold predictions)."""
    chain = fit(docs, labels)
    out = score(fresh(docs, "toxic"), chain)
    return out.withColumn("toxic", F.col("p_toxic") >= (chain.threshold if threshold is None else threshold))


def op7_toxicity(spark, sf_dir):
    out = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", *(F.round(f"p_{c}", 6).alias(f"p_{c}") for c in CATEGORIES), "toxic")


QUERIES = {"op7_toxicity": op7_toxicity}
