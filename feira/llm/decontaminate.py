"""Operator 9: benchmark decontamination by pigeonhole edit matching.

Texts and test items are compared as sequences of folded words (A-Z lower-cased; letters, digits and anything beyond
ASCII make words). An item of m words may occur with up to k = floor(m * error_rate) word edits. Cut into k + 1 pieces,
any such occurrence holds at least one piece unchanged, so exact piece hits find every candidate; Myers' bit-parallel
distance over the words around a hit then gives the least edit distance and where the occurrence ends.

Items go out in blocks of at most ``block_words`` words, the bound of what is broadcast at once; more items take more
blocks, each over all documents.

Edge cases: null and empty texts match nothing; items too short for an edit (up to six words at the default rate) are
found where they stand exactly; items without a word, or without an id, can't be found; equal items are searched once each under their
own ids; of several equally good places the first counts; repeated documents give repeated rows; empty tables give no
rows; clashing extra columns are not read; texts of any length are searched whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feira.llm.common import small_batches, table, texts
from feira.llm.toxicity import FOLD

ERROR_RATE = 0.15
#: Words from which an item that a document holds makes it contaminated.
MIN_WORDS = 6
BLOCK_WORDS = 1_000_000
FOUND = "doc_id long, item_id long, edits int, n_item_words int, first_word long, last_word long"


def folded(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def pieces(words: list[bytes], k: int) -> list[tuple[int, tuple[bytes, ...]]]:
    """``words`` in k + 1 runs of near equal length, each with its place."""
    cuts = [len(words) * i // (k + 1) for i in range(k + 2)]
    return [(a, tuple(words[a:b])) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(pattern: list[bytes], text: list[bytes]) -> tuple[int, int]:
    """Least edit distance of ``pattern`` to any run of ``text``, and where the first such run ends (exclusive).

    Myers' bit vectors over words; a Python int holds the whole pattern.
    """
    m = len(pattern)
    at: dict[bytes, int] = {}
    for i, w in enumerate(pattern):
        at[w] = at.get(w, 0) | 1 << i
    full, high = (1 << m) - 1, 1 << (m - 1)
    up, down, d = full, 0, m
    best, end = m, 0
    for j, w in enumerate(text):
        eq = at.get(w, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph, mh = down | ~(xh | up) & full, up & xh
        d += bool(ph & high) - bool(mh & high)
        ph, mh = ph << 1 & full, mh << 1 & full
        up, down = mh | ~(xv | ph) & full, ph & xv
        if d < best:
            best, end = d, j + 1
    return best, end


class Index:
    """Pieces of a block of items, by their first two words (one for pieces of one word)."""

    def __init__(self, items: list[tuple[int, list[bytes]]], rate: float):
        self.items = {i: (words, int(len(words) * rate)) for i, words in items}
        self.by: dict[bytes, list[tuple[tuple[bytes, ...], int, int]]] = {}
        for i, (words, k) in self.items.items():
            for place, piece in pieces(words, k):
                self.by.setdefault(b" ".join(piece[:2]), []).append((piece, place, i))
        self.single = any(b" " not in key for key in self.by)
        self.first = {key.split(b" ")[0] for key in self.by}

    def search(self, words: list[bytes]) -> list[tuple[int, int, int, int, int]]:
        """(item, edits, item words, first, last word) of each item within its budget, at its best place."""
        near: dict[int, set[int]] = {}
        first = self.first
        for j in [j for j, w in enumerate(words) if w in first]:
            for key in (b" ".join(words[j : j + 2]), *([words[j]] if self.single else ())):
                for piece, place, i in self.by.get(key, ()):
                    if len(piece) <= 2 or tuple(words[j : j + len(piece)]) == piece:
                        near.setdefault(i, set()).add(j - place)
        out = []
        for i, starts in near.items():
            item, k = self.items[i]
            best = None
            spans: list[list[int]] = []
            for s in sorted(starts):  # windows around hits, joined where they overlap
                a, b = max(0, s - k), s + len(item) + k
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], b)
                else:
                    spans.append([a, b])
            for a, b in spans:
                d, end = myers(item, words[a:b])
                if d <= k and (best is None or d < best[0]):
                    back, length = myers(item[::-1], words[max(a, a + end - len(item) - k) : a + end][::-1])
                    best = (d, a + end - max(length, 1), a + end - 1)
            if best:
                out.append((i, best[0], len(item), best[1], best[2]))
        return out


def matches(docs: DataFrame, items: DataFrame, error_rate: float = ERROR_RATE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """A row for each document and test item it holds: doc_id, item_id, edits, n_item_words, first_word, last_word."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def search(part: list[tuple[int, list[bytes]]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(part)

        def find(batches):
            import pyarrow as pa

            index = Index(shared.value, error_rate)
            for b in batches:
                rows = [(d, *m) for d, t in zip(b.column("doc_id").to_pylist(), texts(b), strict=True) for m in index.search(folded(t))]
                columns = list(zip(*rows, strict=True)) or [[]] * 6
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
                names = [c.split()[0] for c in FOUND.split(", ")]
                yield pa.RecordBatch.from_pydict({n: pa.array(c, k) for n, c, k in zip(names, columns, kinds, strict=True)})

        return docs.mapInArrow(find, FOUND)

    found: list[DataFrame] = []
    block: list[tuple[int, list[bytes]]] = []
    held = 0
    for r in items.filter("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").toLocalIterator(prefetchPartitions=True):
        words = folded((r.text or "").encode())
        if not words:
            continue
        if held and held + len(words) > block_words:  # the driver holds one block of items at a time
            found.append(search(block))
            block, held = [], 0
        block.append((r.item_id, words))
        held += len(words)
    return reduce(DataFrame.unionAll, [*found, search(block)])


def clean(docs: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, **options) -> DataFrame:
    """``docs`` without those that hold a test item of ``min_words`` words or more: shorter ones are found, but any text may
    hold them by chance. Rows without a doc_id can't be told apart and stay."""
    hit = matches(docs, items, **options).filter("doc_id is not null").filter(F.col("n_item_words") >= min_words).select("doc_id").distinct()
    return docs.join(hit, "doc_id", "left_anti").select(*docs.columns)


def op9_decontaminate(spark, sf_dir):
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op9_decontaminate": op9_decontaminate}
