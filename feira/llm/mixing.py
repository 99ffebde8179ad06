"""Operator 10: mixing sources to target weights by hierarchical budgeting.

The tree is domain - language - source. A token budget goes down the tree in proportion to weights, never above what
the documents below a node can give (their tokens times ``max_epochs``). What a node can't take goes to its siblings
first; only what all of them can't take reaches the parent's siblings. Each leaf then takes a prefix of its documents:
whole epochs first, then the start of one more, each epoch in its own seeded order.

Edge cases: null language, source or text count as empty strings; a document without words has 0 tokens and comes
along when the prefix reaches it (never in a leaf without any word); rows with the same doc_id share one place in the order and are taken together; an
empty table gives an empty result; columns named like the added ones are replaced, all others stay; a branch of weight 0
gets nothing, and its parent counts as that much smaller; equal order keys (only rows of one doc_id) go together; texts
of any length are counted whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feira.llm.common import aside, count_words, fresh, small_batches, table, written

LEVELS = ("mix_domain", "mix_lang", "mix_source")

#: Hex digits of the order key by which a leaf is summed in each narrowing round.
DIGITS = 2
#: Narrowing rounds before the exact order inside what remains (a 1/65536 part of a leaf).
ROUNDS = 2


def _weight(level: dict[str, float], column: str) -> Column:
    out = F.lit(float(level.get("*", 1.0)))
    for name, w in level.items():
        if name != "*":
            out = F.when(F.col(column) == name, F.lit(float(w))).otherwise(out)
    return out


def _key(seed: int, epoch: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def leaf_budgets(leaves: DataFrame, weights: dict[str, dict[str, float]], total: Column, max_epochs: int) -> DataFrame:
    """``leaves`` (LEVELS, size) with the tokens ``budget`` of each leaf.

    At a node with budget B, children get least(capacity, x * weight) with one x such that the parts sum to B: in order
    of capacity / weight, x is the largest of (B - capacities before) / weights from here on.
    """
    for level in LEVELS:  # what a branch of weight 0 holds is no capacity of the nodes above it
        leaves = leaves.filter(_weight(weights.get(level.removeprefix("mix_"), {}), level) > 0)
    nodes = leaves.withColumn("cap", F.col("size").cast("double") * max_epochs).withColumn("part", total.cast("double"))
    for depth, level in enumerate(LEVELS):
        path = list(LEVELS[: depth + 1])
        caps = nodes.groupBy(*path).agg(F.sum("cap").alias("node_cap"), F.max("part").alias("node_part"))
        caps = caps.withColumn("w", _weight(weights.get(level.removeprefix("mix_"), {}), level)).filter("w > 0 and node_cap > 0")
        siblings = Window.partitionBy(*LEVELS[:depth]) if depth else Window.partitionBy(F.lit(0))
        order = siblings.orderBy(F.col("node_cap") / F.col("w"), level)
        before = F.coalesce(F.sum("node_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        rest = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
        caps = caps.withColumn("x", (F.least("node_part", F.sum("node_cap").over(siblings)) - before) / rest)
        caps = caps.withColumn("granted", F.least("node_cap", F.max("x").over(siblings) * F.col("w")))
        nodes = nodes.join(caps.select(*path, "granted"), path).withColumn("part", F.col("granted")).drop("granted")
    return nodes.select(*LEVELS, "size", F.floor(F.col("part") + 1e-6).cast("long").alias("budget"))


def mix(
    docs: DataFrame,
    weights: dict[str, dict[str, float]] | None = None,
    budget_share: float = 0.5,
    total_tokens: int | None = None,
    seed: int = 7,
    max_epochs: int = 2,
    domain: Column | None = None,
) -> DataFrame:
    """Documents chosen for the mix, one row for each epoch a document is in, with mix_domain and mix_epoch (from 0).

    weights: for each of "domain", "lang" and "source", weights by name ("*": the default, 1). The budget is
    ``total_tokens``, or the share ``budget_share`` of all tokens.
    """
    spark = docs.sparkSession
    small_batches(spark)
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    docs = fresh(docs, *LEVELS, "mix_epoch")
    whole, cut, more = aside(docs, "whole", "cut", "more")
    docs = docs.withColumns(
        {"mix_domain": F.coalesce(F.lit("all") if domain is None else domain, F.lit("")), "mix_lang": empty("lang"), "mix_source": empty("source")}
    )
    sizes = written(docs.select("doc_id", *LEVELS, count_words("text").alias("tokens")), "mix-sizes")
    leaves = sizes.groupBy(*LEVELS).agg(F.sum("tokens").alias("size"))
    all_tokens = sizes.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    total = total_tokens if total_tokens is not None else int(all_tokens * budget_share)
    leaves = leaf_budgets(leaves, weights or {}, F.lit(total), max_epochs)
    leaves = leaves.withColumn("whole", F.floor(F.col("budget") / F.col("size")).cast("int"))
    leaves = written(leaves.withColumn("rest", F.col("budget") - F.col("whole") * F.col("size")), "mix-leaves")

    # the key at which each leaf's partial epoch ends: sums by growing key prefixes, then the exact order in what is left
    leaf = list(LEVELS)
    within = Window.partitionBy(*leaf).orderBy("piece")
    before = F.coalesce(F.sum("tokens").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_ = leaves.filter("rest > 0").select(*leaf, "whole", "rest", F.lit("").alias("prefix"))
    for level in range(1, ROUNDS + 2):
        keyed = sizes.join(open_, leaf).withColumn("key", _key(seed, F.col("whole"))).filter(F.col("key").startswith(F.col("prefix")))
        piece = F.substring("key", 1, DIGITS * level) if level <= ROUNDS else F.col("key")
        sums = keyed.groupBy(*leaf, "whole", "rest", piece.alias("piece")).agg(F.sum("tokens").alias("tokens"))
        sums = sums.withColumn("before", before).filter("before < rest")
        last = sums.groupBy(*leaf, "whole").agg(F.max_by(F.struct("piece", (F.col("rest") - F.col("before")).alias("left")), "piece").alias("last"))
        open_ = written(last.select(*leaf, "whole", F.col("last.left").alias("rest"), F.col("last.piece").alias("prefix")), "mix-cut")
    cuts = leaves.join(open_.select(*leaf, F.col("prefix").alias(cut)), leaf, "left").select(*leaf, F.col("whole").alias(whole), cut)
    chosen = docs.join(cuts, leaf).withColumn(more, F.col(cut).isNotNull() & (_key(seed, F.col(whole)) <= F.col(cut)))
    times = F.col(whole) + F.col(more).cast("int")
    chosen = chosen.filter(times > 0).withColumn("mix_epoch", F.explode(F.sequence(F.lit(0), times - 1)))
    return chosen.drop(whole, cut, more, "mix_lang", "mix_source")


#: The mix of the query: weights by domain, language and source.
WEIGHTS = {"domain": {"domain0": 4, "domain1": 3, "domain2": 2, "domain3": 1}, "lang": {"en": 3, "*": 1}, "source": {"src0": 1, "*": 2}}


def source_domain() -> Column:
    """The domain of a source: its trailing number modulo 4 (sources without one: domain0)."""
    number = F.expr("try_cast(nullif(regexp_extract(coalesce(source, ''), '([0-9]{1,9})$', 1), '') as int)")
    return F.concat(F.lit("domain"), (F.coalesce(number, F.lit(0)) % 4).cast("string"))


def op10_mixing(spark, sf_dir):
    out = mix(table(spark, sf_dir, "documents"), WEIGHTS, budget_share=0.6, seed=7, max_epochs=2, domain=source_domain())
    return out.select("doc_id", "lang", "source", F.col("mix_domain").alias("domain"), F.col("mix_epoch").alias("epoch"))


def _level_sql(depth: int, source: str, weight: str) -> str:
    path, up = ", ".join("dls"[: depth + 1]), ", ".join("dls"[:depth]) or "1"
    return f"""
c{depth} AS (SELECT {path}, sum(cap) AS cap, max(part) AS part, {weight} AS w FROM {source} GROUP BY {path} HAVING sum(cap) > 0),
x{depth} AS (SELECT *, (least(part, sum(cap) OVER (PARTITION BY {up}))
    - coalesce(sum(cap) OVER (PARTITION BY {up} ORDER BY cap / w, {"dls"[depth]} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(w) OVER (PARTITION BY {up} ORDER BY cap / w, {"dls"[depth]} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS x FROM c{depth}),
g{depth} AS (SELECT {path}, least(cap, max(x) OVER (PARTITION BY {up}) * w) AS granted FROM x{depth}),
n{depth} AS (SELECT {source}.* REPLACE (granted AS part) FROM {source} JOIN g{depth} USING ({path})),"""


ORACLE_SQL = {
    "op10_mixing": f"""
WITH t AS (SELECT doc_id, lang, source, coalesce(lang, '') AS l, coalesce(source, '') AS s,
    'domain' || (coalesce(try_cast(nullif(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1), '') AS INT), 0) % 4) AS d,
    coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS tokens FROM documents),
leaf AS (SELECT d, l, s, sum(tokens) AS size, sum(tokens)::DOUBLE * 2 AS cap,
    floor((SELECT sum(tokens) FROM t)::DOUBLE * 0.6) AS part FROM t GROUP BY d, l, s),
{_level_sql(0, "leaf", "CASE d WHEN 'domain0' THEN 4.0 WHEN 'domain1' THEN 3.0 WHEN 'domain2' THEN 2.0 ELSE 1.0 END::DOUBLE")}
{_level_sql(1, "n0", "CASE l WHEN 'en' THEN 3.0 ELSE 1.0 END::DOUBLE")}
{_level_sql(2, "n1", "CASE s WHEN 'src0' THEN 1.0 ELSE 2.0 END::DOUBLE")}
b AS (SELECT d, l, s, size, floor(part + 1e-6)::BIGINT AS budget FROM n2),
q AS (SELECT *, (budget // size)::INT AS whole, budget - (budget // size) * size AS rest FROM b),
r AS (SELECT t.*, whole, rest, coalesce(sum(tokens) OVER (PARTITION BY d, l, s ORDER BY md5('7:' || whole || ':' || doc_id)
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t JOIN q USING (d, l, s)),
e AS (SELECT *, whole + CASE WHEN before < rest THEN 1 ELSE 0 END AS times FROM r)
SELECT doc_id, lang, source, d AS domain, unnest(range(0, times))::INT AS epoch FROM e WHERE times > 0
"""
}

QUERIES = {"op10_mixing": op10_mixing}
