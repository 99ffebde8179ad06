"""Names that are alike, compared exactly and without comparing all with all.

The likeness of two names is the better of two: 2 * matching letters / all letters (longest matching blocks), and 2 * shared
words / all words, whichever order the words have. ``alike_candidates`` finds every pair that can reach a likeness:

- the letters in matching blocks leave at most (1 - least) * all letters outside, so there are few blocks, and a block of m letters
  holds m - q + 1 runs of q letters; both names then share a known number of runs, counting repeated ones;
- a name must therefore share one of its rarest runs with the other, as many as it may lack and one more; only these are joined;
- names too short for runs of q letters to say anything are met by single letters, for which the bound always holds;
- names that share enough words meet by their rarest words in the same way.

Pairs that met are kept if their lengths and common letters allow the likeness, an upper bound that is exact for words.

At a low likeness single letters are all that names must share, so nearly all would meet. ``most_alike`` then scores one good partner
of each name first, and looks for better ones only: blocks of names are multiplied as counts of letters, which gives the letters that
all pairs of two blocks have in common, and the few pairs that can reach the partner's score leave the task.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from feira.functions.values import sequence_ratio, token_dice
from feira.plans.public import saved

#: Against rounding: a bound is only taken as missed beyond this.
ROUNDING = 1e-9
#: Names of a block, rows of a block multiplied at once, pairs looked at closer at once, and counts that runs of letters are hashed to.
BLOCK, STRIP, LOT, HASHED = 4000, 400, 50_000, 256


def plain_name(c: Column | str) -> Column:
    """The words of letters a to z and digits of a name in lower case, one space apart."""
    return F.array_join(F.regexp_extract_all(F.lower(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)), " ")


def _words(c: str) -> Column:
    return F.array_distinct(F.filter(F.split(c, " "), lambda w: w != ""))


def likeness(a: str, b: str) -> Column:
    """Of two ``plain_name`` columns, 0 to 1; 0 where one is empty."""
    score = F.greatest(sequence_ratio(a, b), token_dice(_words(a), _words(b)))
    return F.when((F.col(a) != "") & (F.col(b) != ""), score).otherwise(0.0)


def _runs(c: str, q: int) -> Column:
    """Runs of ``q`` letters, each with how many equal ones come before it."""
    n = F.length(c) - (q - 1)
    runs = F.array_sort(F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substr(F.col(c), i, F.lit(q)))).otherwise(F.array().cast("array<string>")))
    return F.transform(runs, lambda x, i: F.concat(x, F.lit("\u0001"), (i + 1 - F.array_position(runs, x)).cast("string")))


@F.pandas_udf(DoubleType())
def letter_bound(a, b):
    """2 * common letters (each as often as both have it) / all letters of two plain names."""
    import pandas as pd

    codes, names = pd.factorize(pd.concat([a, b]))
    raw = np.frombuffer("".join(names).encode("latin-1", "replace"), np.uint8)
    sizes = np.array([len(x) for x in names])
    counts = np.zeros((len(names), 256), np.int16)
    np.add.at(counts, (np.repeat(np.arange(len(names)), sizes), raw), 1)
    counts = counts[:, counts.any(axis=0)]
    x, y = codes[: len(a)], codes[len(a) :]
    return pd.Series(2 * np.minimum(counts[x], counts[y]).sum(axis=1, dtype=np.int64) / np.maximum(1, sizes[x] + sizes[y]))


def _run_length(least: float) -> int:
    return next(q for q in (3, 2, 1) if least - 2 * (1 - least) * (q - 1) > 0)


def _shared_runs(n: Column, least: float, q: int) -> Column:
    """Runs of ``q`` letters that a name of ``n`` letters shares with any name alike."""
    both = n + F.ceil(n * (least / (2 - least)) - ROUNDING)
    return F.ceil(both * least / 2 - (both * (1 - least) + 1) * (q - 1) - ROUNDING)


def _rarest(names: DataFrame, by: list[str], often: DataFrame, shared: Column) -> DataFrame:
    """by, name, token: of each name's ``tokens`` the rarest, one more than it may lack if it must share ``shared``."""
    each = names.withColumn("most", F.size("tokens") - shared + 1).filter("most > 0")
    each = each.select(*by, "name", "most", F.explode("tokens").alias("token")).join(often.hint("merge"), [*by, "token"])
    order = Window.partitionBy(*by, "name").orderBy("n", "token")
    return each.withColumn("at", F.row_number().over(order)).filter("at <= most").select(*by, "name", "token")


def _met(left: DataFrame, right: DataFrame, by: list[str], shared) -> DataFrame:
    """by, a, b of names (by, name, tokens) that share one of their rarest tokens."""
    left, right = saved(left, "tokens"), saved(right, "tokens")
    often = left.unionByName(right).select(*by, F.explode("tokens").alias("token")).groupBy(*by, "token").agg(F.count("*").alias("n"))
    a, b = (_rarest(x, by, often, shared) for x in (left, right))
    return a.withColumnRenamed("name", "a").join(b.withColumnRenamed("name", "b").hint("merge"), [*by, "token"]).select(*by, "a", "b")


def _distinct_names(side: DataFrame, column: str, by: list[str]) -> DataFrame:
    return side.select(*by, F.col(column).alias("name")).filter("name <> ''").distinct()


def _met_in_words(x: DataFrame, y: DataFrame, least: float, by: list[str]) -> DataFrame:
    in_words = lambda df: df.withColumn("tokens", _words("name"))
    return _met(in_words(x), in_words(y), by, F.ceil(F.size("tokens") * (least / (2 - least)) - ROUNDING))


def alike_candidates(left: DataFrame, right: DataFrame, least: float, by: list[str] | None = None) -> DataFrame:
    """by, a, b, most: of distinct plain names of ``left`` (by, a) and ``right`` (by, b) every pair whose likeness may be
    ``least`` or more, with an upper bound of it."""
    by = by or []
    x, y = saved(_distinct_names(left, "a", by), "names"), saved(_distinct_names(right, "b", by), "names")
    q, n = _run_length(least), F.length("name")
    runs = lambda df, k: df.withColumn("tokens", _runs("name", k))
    long = _shared_runs(n, least, q) > 0
    parts = [_met(runs(x.filter(long), q), runs(y.filter(long), q), by, _shared_runs(n, least, q))]
    if q > 1:
        one = _shared_runs(n, least, 1)
        # a short name meets only names of about its length
        edge = lambda df: df.filter(~long).agg(F.coalesce(F.max(n), F.lit(0))).first()[0] * (2 - least) / least + 1
        parts += [_met(runs(x.filter(~long), 1), runs(y.filter(n <= edge(x)), 1), by, one), _met(runs(x.filter(long & (n <= edge(y))), 1), runs(y.filter(~long), 1), by, one)]
    parts.append(_met_in_words(x, y, least, by))
    pairs = parts[0]
    for part in parts[1:]:
        pairs = pairs.unionByName(part)
    total = F.length("a") + F.length("b")
    near = pairs.distinct().withColumn("dice", token_dice(_words("a"), _words("b")))
    near = near.filter((F.col("dice") >= least - ROUNDING) | (2 * F.least(F.length("a"), F.length("b")) >= least * total - ROUNDING))
    return near.withColumn("most", F.greatest("dice", letter_bound("a", "b"))).filter(F.col("most") >= least - ROUNDING).drop("dice")


def _letters(names: list[str], most: np.ndarray) -> np.ndarray:
    """A row for each name: for each character as many places as any name has of it at most, the first as many as it has at 1."""
    counts = np.zeros((len(names), 256), np.int32)
    for i, name in enumerate(names):
        counts[i] = np.bincount(np.frombuffer(name.encode("latin-1", "replace"), np.uint8), minlength=256)
    return np.concatenate([(counts[:, [c]] > np.arange(most[c])[None, :]) for c in np.flatnonzero(most)], axis=1).astype(np.float32)


def _most_of_each(names: list[str]) -> np.ndarray:
    return np.max([np.bincount(np.frombuffer(x.encode("latin-1", "replace"), np.uint8), minlength=256) for x in names], axis=0)


def _hashed_runs(names: list[str], q: int) -> np.ndarray:
    out = np.zeros((len(names), HASHED), np.uint16)
    for i, name in enumerate(names):
        for at in range(len(name) - q + 1):
            out[i, crc32(name[at : at + q].encode()) % HASHED] += 1
    return out


def _reaching(a: list[str], least: np.ndarray, b: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Places of the names of ``a`` and ``b`` whose ratio of matching letters may be ``least`` or more."""
    most = np.minimum(_most_of_each(a), _most_of_each(b))
    long_a, long_b = (np.array([len(x) for x in side]) for side in (a, b))
    runs = {q: (_hashed_runs(a, q), _hashed_runs(b, q)) for q in (2, 3)}
    left, right = (_letters(side, most) if most.any() else np.zeros((len(side), 1), np.float32) for side in (a, b))
    found_a, found_b = [], []
    for at in range(0, len(a), STRIP):
        strip = slice(at, at + STRIP)
        both = long_a[strip, None] + long_b[None, :]
        i, j = np.nonzero(2 * (left[strip] @ right.T) >= least[strip, None] * both - ROUNDING)
        i += at
        for lot in range(0, len(i), LOT):
            x, y = i[lot : lot + LOT], j[lot : lot + LOT]
            for q, (own, theirs) in runs.items():
                total = long_a[x] + long_b[y]
                need = total * least[x] / 2 - (total * (1 - least[x]) + 1) * (q - 1) - ROUNDING
                fit = np.minimum(own[x], theirs[y]).sum(axis=1, dtype=np.int64) >= need
                x, y = x[fit], y[fit]
            found_a.append(x)
            found_b.append(y)
    none = [np.zeros(0, np.int64)]
    return np.concatenate(none + found_a), np.concatenate(none + found_b)


def _in_blocks(names: DataFrame, by: list[str], block: str, *lists: str) -> tuple[DataFrame, DataFrame]:
    """(blocks, count): names dealt to blocks of about BLOCK names as (by, block, a list for each column), and how many each has."""
    count = names.groupBy(*by).agg(F.ceil(F.count("*") / BLOCK).alias("n_blocks"))
    dealt = names.join(count, by).withColumn(block, F.pmod(F.xxhash64(lists[0]), F.col("n_blocks")))
    return dealt.groupBy(*by, block).agg(F.collect_list(F.struct(*lists)).alias("x")).select(*by, block, *[F.col("x")[c].alias(c) for c in lists]), count


def _letters_reach(x: DataFrame, y: DataFrame, by: list[str]) -> DataFrame:
    """by, a, b: pairs of ``x`` (by, a, least) and ``y`` (by, b) whose ratio of matching letters may be ``least`` or more."""
    left, _ = _in_blocks(x, by, "block_a", "a", "least")
    right, count = _in_blocks(y, by, "block_b", "b")
    each = left.join(count, by).withColumn("block_b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)))
    tasks = int(x.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = each.join(right.hint("merge"), [*by, "block_b"]).select(*by, "block_a", "block_b", "a", "least", "b").repartition(tasks, *by, "block_a", "block_b")

    def compare(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            for row in batch.itertuples(index=False):
                a, b = list(row.a), list(row.b)
                i, j = _reaching(a, np.asarray(row.least, float), b)
                for lot in range(0, len(i), LOT):
                    of = {"a": [a[k] for k in i[lot : lot + LOT]], "b": [b[k] for k in j[lot : lot + LOT]]}
                    yield pd.DataFrame({c: [getattr(row, c)] * len(of["a"]) for c in by} | of)

    kinds = dict(x.dtypes)
    return pairs.mapInPandas(compare, ", ".join([f"`{c}` {kinds[c]}" for c in by] + ["a string", "b string"]))


def _partners(x: DataFrame, y: DataFrame, by: list[str], tokens) -> DataFrame:
    """by, a, b: for each name a name that has its rarest token."""
    told = y.select(*by, F.col("name").alias("b"), F.explode(tokens).alias("token")).groupBy(*by, "token").agg(F.count("*").alias("n"), F.min("b").alias("b"))
    own = x.select(*by, F.col("name").alias("a"), F.explode(tokens).alias("token")).join(told.hint("merge"), [*by, "token"])  # tokens are many more than their file lets expect
    return own.groupBy(*by, "a").agg(F.min(F.struct("n", "token", "b")).alias("f")).select(*by, "a", "f.b")


def _better_pairs(left: DataFrame, right: DataFrame, least: float, by: list[str]) -> DataFrame:
    """by, a, b: every pair of distinct plain names that may be as alike as a first partner of ``a`` that is quickly found."""
    everywhere = [] if by else ["everywhere"]
    x, y = (_distinct_names(side, c, by).withColumns({e: F.lit(0) for e in everywhere}) for side, c in ((left, "a"), (right, "b")))
    x, y, by = saved(x, "names"), saved(y, "names"), [*by, *everywhere]
    partners = _partners(x, y, by, _words("name")).unionByName(_partners(x, y, by, _runs("name", 3)))
    floor = partners.distinct().withColumn("score", likeness("a", "b")).groupBy(*by, "a").agg(F.max("score").alias("score"))
    own = saved(x.withColumnRenamed("name", "a").join(floor.hint("merge"), [*by, "a"], "left").select(*by, "a", F.greatest(F.lit(least), F.coalesce("score", F.lit(0.0))).alias("least")), "floors")
    in_words = _met_in_words(x, y, least, by).distinct().join(own.hint("merge"), [*by, "a"]).filter(token_dice(_words("a"), _words("b")) >= F.col("least") - ROUNDING)
    near = _letters_reach(own, y.withColumnRenamed("name", "b"), by).unionByName(in_words.select(*by, "a", "b")).distinct()
    return near.drop(*everywhere)


def alike_names(left: DataFrame, right: DataFrame, least: float, by: list[str] | None = None) -> DataFrame:
    """by, a, b, score of all pairs of plain names whose likeness is ``least`` or more."""
    met = alike_candidates(left, right, least, by)
    return met.withColumn("score", likeness("a", "b")).filter(F.col("score") >= least).drop("most")


def most_alike(left: DataFrame, right: DataFrame, least: float, by: list[str] | None = None) -> DataFrame:
    """by, a, b, score: for each name of ``left`` the most alike of ``right``, all that tie, from ``least`` on.

    Names that someone has in the same words can't be more alike to another, so they are settled by words alone. For the others
    the pair with the highest bound is scored first (at a low likeness a partner with a rare word or run); of the rest only those
    whose bound reaches its score.
    """
    by = by or []
    left, right = (saved(_distinct_names(side, c, by).withColumnRenamed("name", c), "names") for side, c in ((left, "a"), (right, "b")))
    same = _met_in_words(_distinct_names(left, "a", by), _distinct_names(right, "b", by), 1.0, by).distinct()
    same = saved(same.filter((F.col("a") == F.col("b")) | (token_dice(_words("a"), _words("b")) == 1.0)).withColumn("score", F.lit(1.0)), "alike")
    top = F.max("score").over(Window.partitionBy(*by, "a"))
    open_ = left.join(same.select(*by, "a").distinct(), [*by, "a"], "left_anti")
    if _run_length(least) == 1:
        scored = _better_pairs(open_, right, least, by).withColumn("score", likeness("a", "b")).filter(F.col("score") >= least)
        return scored.withColumn("top", top).filter(F.col("score") == F.col("top")).select(*by, "a", "b", "score").unionByName(same.select(*by, "a", "b", "score"))
    met = saved(alike_candidates(open_, right, least, by), "alike")
    first = met.groupBy(*by, "a").agg(F.max(F.struct("most", "b")).alias("f")).select(*by, "a", F.col("f.b").alias("first")).withColumn("found", likeness("a", "first"))
    rest = met.join(saved(first, "alike"), [*by, "a"]).filter(F.col("most") >= F.greatest("found", F.lit(least)) - ROUNDING)
    scored = rest.withColumn("score", likeness("a", "b")).filter(F.col("score") >= least)
    return scored.withColumn("top", top).filter(F.col("score") == F.col("top")).select(*by, "a", "b", "score").unionByName(same.select(*by, "a", "b", "score"))
