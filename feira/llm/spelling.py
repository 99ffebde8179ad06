"""Operator 12: spelling variant grouping by neighbourhoods over a reduced alphabet.

Letters are hashed to SYMBOLS symbols. Two words that differ by one edit differ by at most one edit once reduced, so the
words near a word are among those whose reduced form lies in its full one-edit neighbourhood: itself and each inserted,
deleted or replaced symbol. The neighbourhoods join the reduced vocabulary and pairs are verified on the words as they are.

Forms are 64-bit polynomial hashes, so a neighbour is made from the hashes of what stands before and after it, for all
words of a length at once. Each neighbour is made once (an edit within a run of one symbol counts at one of its places),
so a pair meets once. Neighbours that are no form of
the vocabulary are left out before they move, by a filter of bounded size. Words of more than LONG letters travel by number and are fetched for the pairs that meet.

Counting is done within a task before anything moves. A word has at most a few hundred near words per letter, so no group
grows with the corpus; crowded reduced forms are join keys, which adaptive execution may split.

Edge cases: null and empty texts hold no runs; a null doc_id is hashed as an empty one; words of any length are compared;
repeated rows count like others; ties for the form go to the smallest word in code-point order; an empty table gives an
empty result. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feira.llm.common import mix64, small_batches, table, texts, written

#: Symbols of the reduced alphabet: more of them make longer neighbourhoods and fewer words of one form.
SYMBOLS = 8
#: Least code points and occurrences of a word.
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: A letter is left out of a run whose hash this divides.
SLIP = 97
#: Letters beyond which a word is fetched by its number.
LONG = 64
#: Slots of the filter of known forms: for each word, and at most (16 MB of bits).
SLOTS_A_WORD, MAX_SLOTS = 16, 1 << 27
#: Words a task counts before it passes them on; values of neighbourhoods made at once.
HELD, MADE = 400_000, 1 << 20

_BASE, _WORD = 0x9E3779B97F4A7C15, (1 << 64) - 1


def count_runs(docs: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """word, n: the runs of letters of all texts in lower case (A-Z only), with the slips that the corpus is given: of a
    run whose crc32 with its doc_id 97 divides, the letter at that crc32 modulo its length is missing."""
    small_batches(docs.sparkSession)

    def count(batches):
        import pyarrow as pa

        runs = re.compile(rf"[a-zÀ-ÿ]{{{least_length},}}")
        total: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_pydict({"word": list(total), "n": pa.array(total.values(), pa.int64())})
            total.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True):
                seed = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
                seed = zlib.crc32(b":", seed)
                own = Counter(runs.findall(text.lower().decode()))  # bytes.lower changes A-Z only
                for w in own:
                    h = zlib.crc32(w.encode(), seed)
                    if h % SLIP == 0:
                        at = h % len(w)
                        cut = w[:at] + w[at + 1 :]
                        if len(cut) >= least_length:
                            total[cut] += own[w]
                    else:
                        total[w] += own[w]
                if len(total) > HELD:
                    yield flush()
        if total:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame) -> DataFrame:
    """id, word, n of the words of at least LEAST_COUNT occurrences, as a written table."""
    kept = count_runs(docs).filter(F.col("n") >= LEAST_COUNT)
    return written(kept.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "spelling-words")


def reduced(words: np.ndarray) -> np.ndarray:
    """Symbols (from 1) of the code points of words, by a hash of the letter."""
    x = (words.astype(np.uint64) + np.uint64(1)) * np.uint64(_BASE)
    return (x >> np.uint64(40)) % np.uint64(SYMBOLS) + np.uint64(1)


def _powers(n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = np.multiply.accumulate(np.full(n - 1, _BASE, np.uint64))
    return out


def form_hashes(s: np.ndarray) -> np.ndarray:
    """The hash of each row of symbols."""
    return (s * _powers(s.shape[1])[::-1]).sum(axis=1, dtype=np.uint64)


def neighbourhoods(s: np.ndarray):
    """(rows, hashes) in parts: the hash of every distinct string within one edit of each row of symbols, once each."""
    m, length = s.shape
    power = _powers(length + 2)
    terms = s * power[:length][::-1]
    after = np.zeros((m, length + 1), np.uint64)  # hash of the symbols from a place on
    after[:, :-1] = np.cumsum(terms[:, ::-1], axis=1, dtype=np.uint64)[:, ::-1]
    before = after[:, :1] - after  # of the symbols before a place, with the weights they have in the word
    here = power[np.arange(length)][::-1]  # weight of each place
    rows = np.arange(m)
    yield rows, after[:, 0]
    # the weights of what stands before change with the length: by one power of the base
    inverse = np.uint64(pow(_BASE, -1, 1 << 64))
    gone = before[:, :-1] * inverse + after[:, 1:]
    first = np.ones((m, length), bool)  # of a run of one symbol
    first[:, 1:] = s[:, 1:] != s[:, :-1]
    at = np.nonzero(first)
    yield at[0], gone[at]
    gap = power[np.arange(length + 1)][::-1]  # weight of a symbol inserted before a place
    for c in range(1, SYMBOLS + 1):
        c64 = np.uint64(c)
        other = s != c64
        at = np.nonzero(other)
        yield at[0], (after[:, :1] + (c64 - s) * here)[at]
        put = before * np.uint64(_BASE) + after + c64 * gap
        free = np.ones((m, length + 1), bool)  # before another symbol, or at the end
        free[:, :-1] = other
        at = np.nonzero(free)
        yield at[0], put[at]


def _by_length(words: list[str]):
    """(places, code points) of the words of each length, few enough for their neighbourhoods to be made at once."""
    sizes = np.array([len(w) for w in words])
    for n in np.unique(sizes).tolist():
        places = np.flatnonzero(sizes == n)
        step = max(1, MADE // (n + 1))
        for k in range(0, len(places), step):
            mine = places[k : k + step]
            raw = "".join(words[i] for i in mine.tolist()).encode("utf-32-le")
            yield mine, np.frombuffer(raw, "<u4").reshape(len(mine), n)


def form_rows(words: DataFrame, long: bool) -> DataFrame:
    """form, near (its number if ``long``), near_n: the reduced form of each word."""

    def make(batches):
        import pyarrow as pa

        for batch in batches:
            own = batch.column("id" if long else "word")
            for places, points in _by_length(batch.column("word").to_pylist()):
                at = pa.array(places)
                yield pa.RecordBatch.from_pydict({"form": pa.array(form_hashes(reduced(points)).view(np.int64)), "near": own.take(at), "near_n": batch.column("n").take(at)})

    return words.mapInArrow(make, f"form long, near {'long' if long else 'string'}, near_n long")


def neighbour_rows(words: DataFrame, known: np.ndarray, long: bool) -> DataFrame:
    """form, word (its number if ``long``): the whole neighbourhood of each word's reduced form, but for forms that no word
    of the vocabulary has (``known``: a bit for each slot of forms)."""
    held = words.sparkSession.sparkContext.broadcast(known)

    def make(batches):
        import pyarrow as pa

        bits = held.value
        for batch in batches:
            own = batch.column("id" if long else "word")
            for places, points in _by_length(batch.column("word").to_pylist()):
                for rows, hashes in neighbourhoods(reduced(points)):
                    slot = _slot(hashes, len(bits) * 8)
                    hit = np.flatnonzero(bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1)
                    yield pa.RecordBatch.from_pydict({"form": pa.array(hashes[hit].view(np.int64)), "word": own.take(pa.array(places[rows[hit]]))})

    return words.mapInArrow(make, f"form long, word {'long' if long else 'string'}")


def _slot(forms: np.ndarray, bits: int) -> np.ndarray:
    """The slot of each form among a power of two."""
    return mix64(forms) & np.uint64(bits - 1)


def known_slots(words: DataFrame) -> np.ndarray:
    """A bit for each slot that a word's reduced form falls into: about SLOTS_A_WORD slots a word and MAX_SLOTS at most, so
    what is broadcast is bounded; beyond, it only filters less."""
    n = words.count()
    bits = 1 << 15
    while bits < min(MAX_SLOTS, n * SLOTS_A_WORD):
        bits *= 2

    def slots(batches):
        import pyarrow as pa

        for batch in batches:
            for _, points in _by_length(batch.column("word").to_pylist()):
                yield pa.RecordBatch.from_pydict({"slot": pa.array(_slot(form_hashes(reduced(points)), bits).view(np.int64))})

    found = words.select("word").mapInArrow(slots, "slot long")
    parts = found.groupBy(F.expr("slot div 32768").alias("part")).agg(F.bitmap_construct_agg(F.expr("slot % 32768")).alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for r in parts.toLocalIterator():
        out[r.part * 4096 : (r.part + 1) * 4096] = np.frombuffer(bytes(r.bits), np.uint8)[:4096]
    return out


def near_pairs(words: DataFrame) -> DataFrame:
    """word, near, near_n: each word and each word one edit from it, both ways round."""
    known = known_slots(words)

    def met(some: DataFrame, long: bool) -> DataFrame:
        return neighbour_rows(some, known, long).join(form_rows(some, long), "form")

    one_edit = F.levenshtein("word", "near", 1) == 1
    short = met(words.filter(F.length("word") <= LONG), False).filter(one_edit).select("word", "near", "near_n")
    # pairs of which one is long: meet by numbers, once, then fetch the words
    by_id = words.filter(F.length("word") >= LONG)
    named = by_id.select("id", F.col("word").alias("text"))
    long = met(by_id, True).select("word", "near", "near_n").distinct()
    long = long.join(named.toDF("word", "a"), "word").join(named.toDF("near", "b"), "near").select(F.col("a").alias("word"), F.col("b").alias("near"), "near_n")
    return short.unionByName(long.filter((F.length("word") > LONG) | (F.length("near") > LONG)).filter(one_edit))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: from each word with a form, the last of its forms, by doubling how far a word looks each round. A form
    has at least twice the count of its word, so there are at most 63 steps and seven rounds."""
    seen = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = seen.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ahead = seen.join(on, "root", "left")
        if not ahead.filter("next is not null").take(1):
            return seen
        seen = written(ahead.select("word", F.coalesce("next", "root").alias("root")), "spelling-roots")


def group_variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word of the vocabulary."""
    words = vocabulary(docs)
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("near"))).alias("best")
    found = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), best)
    known = words.join(found, "word", "left")
    good = -F.col("best.minus") >= 2 * F.col("n")
    known = known.select(
        "word",
        F.when(good, F.col("best.near")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(good, -F.col("best.minus")).alias("form_n"),
    )
    known = written(known, "spelling-known")
    last = roots(known.filter("form is not null").select("word", "form"))
    out = known.join(last, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark, sf_dir):
    return group_variants(table(spark, sf_dir, "documents"))


QUERIES = {"op12_spelling": op12_spelling}
