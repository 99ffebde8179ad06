"""Operator 1: quality rules, then gradient-boosted trees over document statistics.

Every whole text gives counts and ratios in one pass. Base rules reject short and repetitive texts. Trees trained on
labelled documents (bounded sample: at most ``max_labelled``, those with the smallest hashes of doc_id) judge the rest.
Splits are found on feature histograms; chosen features are monotonic (MONOTONE): more repetition or more symbols never
raises the score. The trees are flattened into arrays of nodes, so that scoring a batch is a few numpy steps per level.

Edge cases: null and empty texts have no words and fail the base rules; without labels of both classes the trees keep
everything that passes the base rules; repeated rows get equal verdicts; label columns that clash with document columns
don't meet them; columns named like the added ones are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feira.llm.common import WordHasher, gram_hashes, small_batches, table, texts, written

MAX_LABELLED = 20_000
WINDOW = 8
SYMBOLS = b"#*$%&|<>"

#: Base counts of a text, in the order of the query's columns.
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Further statistics, as ratios.
RATIOS = ("log_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "stop_share", "distinct_share", "mean_line", "bang_share")
#: -1: the score never rises with the feature.
MONOTONE = {"symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "bang_share": -1}

_UPPER, _DIGIT, _LETTER, _BANG = (bytes(c for c in range(256) if f(c)) for f in (lambda c: 65 <= c <= 90, lambda c: 48 <= c <= 57, lambda c: 65 <= c <= 90 or 97 <= c <= 122, lambda c: c in b"!?"))
_SPACES = b" \t\n\x0b\x0c\r"
_TAILS = bytes(range(0x80, 0xC0))  # UTF-8 bytes that go on with a code point
_HASHERS: list[WordHasher] = []


def repeated_words(hashes: np.ndarray, words: list[bytes], window: int = WINDOW) -> int:
    """Words inside runs of ``window`` words that stand twice or more in the text, the first included."""
    grams = gram_hashes(hashes, window)
    if len(grams) < 2:
        return 0
    order = np.sort(grams)
    if not (order[1:] == order[:-1]).any():
        return 0
    # equal hashes are only candidates: compare the runs themselves
    _, inverse, counts = np.unique(grams, return_inverse=True, return_counts=True)
    where = np.flatnonzero(counts[inverse] > 1)
    ids = {w: i for i, w in enumerate(dict.fromkeys(words))}
    codes = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
    runs = np.lib.stride_tricks.sliding_window_view(codes, window)[where]
    _, inverse, counts = np.unique(runs, axis=0, return_inverse=True, return_counts=True)
    covered = np.zeros(len(words) + 1, np.int64)
    starts = where[counts[inverse.ravel()] > 1]
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + window, -1)
    return int((np.cumsum(covered)[:-1] > 0).sum())


def statistics(text: bytes, hasher: WordHasher) -> tuple[list[int], list[float]]:
    """BASE counts and RATIOS of one text."""
    words = text.split()
    n = len(words)
    if not n:
        return [0, 0, len(text) - len(text.translate(None, SYMBOLS)), 0, 0], [0.0] * len(RATIOS)
    packed = text.translate(None, _SPACES)
    chars = len(packed.translate(None, _TAILS))
    symbols = len(packed) - len(packed.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    dup = len(lines) - len(set(lines))
    repeat = repeated_words(hasher(words), words)
    letters = len(packed) - len(packed.translate(None, _LETTER))
    upper = len(packed) - len(packed.translate(None, _UPPER))
    digits = len(packed) - len(packed.translate(None, _DIGIT))
    bangs = len(packed) - len(packed.translate(None, _BANG))
    short = sum(len(w) <= 3 for w in words)
    ratios = [np.log1p(n), chars / n, symbols / chars, dup / len(lines), repeat / n, upper / max(1, letters), digits / chars, short / n, len(set(words)) / n, n / len(lines), bangs / n]
    return [n, chars, symbols, dup, repeat], [float(x) for x in ratios]


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, BASE (long) and RATIOS (double) of every whole text."""
    small_batches(docs.sparkSession)

    def measure(batches):
        import pyarrow as pa

        _HASHERS[:] = _HASHERS or [WordHasher()]
        for b in batches:
            rows = [statistics(t, _HASHERS[0]) for t in texts(b)]
            counts = np.array([r[0] for r in rows], np.int64).reshape(-1, len(BASE))
            ratios = np.array([r[1] for r in rows], np.float64).reshape(-1, len(RATIOS))
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id")} | {c: counts[:, k] for k, c in enumerate(BASE)} | {c: ratios[:, k] for k, c in enumerate(RATIOS)})

    kinds = ", ".join(["doc_id long", *(f"{c} long" for c in BASE), *(f"{c} double" for c in RATIOS)])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(measure, kinds)


@dataclass
class Trees:
    """Flattened trees: node arrays one after another; a node with feature -1 is a leaf. ``roots``: each tree's first."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    start: float

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[at]
                go_left = x[rows, np.maximum(f, 0)] <= self.cut[at]
                at = np.where(f < 0, at, np.where(go_left, self.left[at], self.right[at]))
            out += self.value[at]
        return out


def train(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, least: float = 1.0) -> Trees:
    """Boosted trees for the logistic loss. A split of a monotonic feature must order its sides' values, and the
    halfway value then bounds what nodes below each side may take."""
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(m)]
    binned = np.column_stack([np.searchsorted(edges[f], x[:, f], "left") for f in range(m)])
    share = min(max(y.mean(), 1e-6), 1 - 1e-6)
    start = float(np.log(share / (1 - share)))
    margin = np.full(n, start)
    nodes: list[list[float]] = []
    roots = []

    def leaf(g, h, low, high):
        return float(np.clip(-g / (h + 1.0), low, high))

    def grow(rows, grad, hess, low, high, level):
        me = len(nodes)
        nodes.append([-1, 0.0, me, me, rate * leaf(grad[rows].sum(), hess[rows].sum(), low, high)])
        if level == depth or len(rows) < 2:
            return me
        g, h = grad[rows].sum(), hess[rows].sum()
        best = (1e-6, None)
        for f in range(m):
            if not len(edges[f]):
                continue
            gs = np.cumsum(np.bincount(binned[rows, f], grad[rows], len(edges[f]) + 1))[:-1]
            hs = np.cumsum(np.bincount(binned[rows, f], hess[rows], len(edges[f]) + 1))[:-1]
            a, b = np.clip(-gs / (hs + 1.0), low, high), np.clip(-(g - gs) / (h - hs + 1.0), low, high)
            gain = gs**2 / (hs + 1.0) + (g - gs) ** 2 / (h - hs + 1.0) - g**2 / (h + 1.0)
            ok = (hs >= least) & (h - hs >= least)
            if monotone[f]:
                ok &= monotone[f] * (b - a) >= 0
            if ok.any():
                k = int(np.argmax(np.where(ok, gain, -np.inf)))
                if gain[k] > best[0]:
                    best = (gain[k], (f, k, a[k], b[k]))
        if best[1] is None:
            return me
        f, k, a, b = best[1]
        middle = (a + b) / 2
        left, right = [low, high], [low, high]
        if monotone[f] > 0:
            left[1], right[0] = middle, middle
        elif monotone[f] < 0:
            left[0], right[1] = middle, middle
        go = binned[rows, f] <= k
        below = grow(rows[go], grad, hess, *left, level + 1), grow(rows[~go], grad, hess, *right, level + 1)
        nodes[me] = [f, float(edges[f][k]), *below, 0.0]
        return me

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        first = len(nodes)
        roots.append(first)
        grow(np.arange(n), p - y, np.maximum(p * (1 - p), 1e-6), -np.inf, np.inf, 0)
        part = np.array(nodes[first:])
        tree = Trees(part[:, 0].astype(int), part[:, 1], part[:, 2].astype(int) - first, part[:, 3].astype(int) - first, part[:, 4], np.array([0]), depth, 0.0)
        margin += tree.margins(x)
    flat = np.array(nodes)
    return Trees(flat[:, 0].astype(np.int64), flat[:, 1], flat[:, 2].astype(np.int64), flat[:, 3].astype(np.int64), flat[:, 4], np.array(roots), depth, start)


def fit(stats: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Trees | None:
    """Trees for quality 1, from a bounded sample of labelled rows; None without both classes."""
    one = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    one = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    known = stats.join(F.broadcast(one), "doc_id")  # at most max_labelled rows go out; of several texts the least counts
    rows = known.groupBy("doc_id", "quality").agg(F.min(F.struct(*RATIOS)).alias("r")).select("doc_id", "quality", "r.*").collect()
    rows.sort(key=lambda r: r.doc_id)
    y = np.array([float(r.quality == 1) for r in rows])
    if not len(y) or y.min() == y.max():
        return None
    return train(np.array([r[2:] for r in rows], float), y, np.array([MONOTONE.get(c, 0) for c in RATIOS]))


def quality(docs: DataFrame, labels: DataFrame, min_words: int = 20, max_repeat: int = 30, threshold: float = 0.5) -> DataFrame:
    """A row for each document: doc_id, BASE, base_failed, kept, score (the trees' probability of good quality) and RATIOS.

    base_failed: fewer than ``min_words`` words, or more than ``max_repeat`` percent of words in repeated runs.
    """
    stats = written(document_statistics(docs), "quality-stats")
    trees = fit(stats, labels)

    @F.arrow_udf("double")
    def score(*columns):
        import pyarrow as pa

        x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in columns])
        return pa.array(1 / (1 + np.exp(-trees.margins(x))))

    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    out = stats.withColumns({"base_failed": failed, "score": F.lit(1.0) if trees is None else score(*RATIOS)})
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
    return out.select("doc_id", *BASE, "base_failed", "kept", F.round("score", 6).alias("score"), *RATIOS)


def op1_quality(spark, sf_dir):
    out = quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", *BASE, "base_failed", "kept", "score")


QUERIES = {"op1_quality": op1_quality}
