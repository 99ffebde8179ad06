"""One receipt from several readings of it: each line's values by weighted vote, with the printed sum and arithmetic against it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from feira.sources.domain import pick, receipt_lines, with_tables

# Amounts within VOTE_TOLERANCE are one value; a line's arithmetic holds within MATH_TOLERANCE; names of a line from
# SAME_NAME on are alike, those of a line without number from STRAY_NAME on; readings of a code that are kept.
VOTE_TOLERANCE, MATH_TOLERANCE = 0.02, 0.03
SAME_NAME, STRAY_NAME = 65.0, 80.0
MOST_READS = 6

ITEM = "receipt_id long, place long, weight double, line_no long, name string, code string, code_reads array<string>, qty double, unit string, unit_price double, discount double, total double, printed_total double"


def _common(masks: dict[str, int], n: int, other: str) -> int:
    """Length of the longest common subsequence of a text of ``n`` letters (their places as bits) and another."""
    full = (1 << n) - 1
    v = full
    for c in other:
        u = v & masks.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def part_ratio(a: str, b: str) -> float:
    """0 to 100: how well the shorter text matches its best place in the longer one (2 * common letters / all letters)."""
    if not a or not b:
        return 100.0 if a == b else 0.0
    if len(a) > len(b):
        a, b = b, a
    if a in b:
        return 100.0
    best = 0.0
    for short, long in ((a, b), (b, a)) if len(a) == len(b) else ((a, b),):
        n = len(short)
        masks: dict[str, int] = {}
        for i, c in enumerate(short):
            masks[c] = masks.get(c, 0) | 1 << i
        for i in range(1 - n, len(long)):
            part = long[max(0, i) : i + n]
            if 2 * len(part) / (n + len(part)) * 100 > best:
                best = max(best, 200 * _common(masks, n, part) / (n + len(part)))
    return best


@F.pandas_udf(DoubleType())
def ratio_of_names(a, b):
    import pandas as pd

    known: dict[tuple[str, str], float] = {}
    out = []
    for pair in zip(a.fillna("").str.upper(), b.fillna("").str.upper(), strict=True):
        if pair not in known:
            known[pair] = part_ratio(*pair)
        out.append(known[pair])
    return pd.Series(out, dtype=float)


@F.pandas_udf(StringType())
def best_name(names):
    """Of each row's names, the first being the strongest reading's: the shortest that is alike to the first, first of equals."""
    import pandas as pd

    known: dict[tuple[str, ...], str] = {}
    out = []
    for row in names:
        row = tuple(x or "" for x in row)
        if row not in known:
            alike = [x for x in row if part_ratio(row[0].upper(), x.upper()) >= SAME_NAME] or [row[0]]
            known[row] = min(alike, key=len) or row[0]
        out.append(known[row])
    return pd.Series(out, dtype=object)


def lines_of(items: DataFrame) -> DataFrame:
    """``items`` with ``line`` and ``turn`` (their order within it): an item without number joins the first line of its
    receipt whose first name is alike, after the numbered items; one that is alike to none is left out."""
    numbered = items.filter("line_no is not null").withColumns({"line": F.col("line_no"), "turn": F.struct(F.lit(0).alias("stray"), F.col("place").alias("place"))})
    first = numbered.groupBy("receipt_id", "line").agg(F.min(F.struct("place", "name")).alias("f")).select("receipt_id", F.col("line").alias("to"), "f.*")
    strays = items.filter("line_no is null")
    near = strays.select("receipt_id", F.col("place").alias("own"), F.col("name").alias("stray")).join(first, "receipt_id")
    near = near.withColumn("ratio", ratio_of_names("stray", "name")).filter(F.col("ratio") >= STRAY_NAME)
    near = near.groupBy("receipt_id", F.col("own").alias("place")).agg(F.min(F.struct("place", "to")).alias("m")).select("receipt_id", "place", F.col("m.to").alias("line"))
    joined = strays.join(near, ["receipt_id", "place"]).withColumn("turn", F.struct(F.lit(1).alias("stray"), F.col("place").alias("place")))
    return numbered.unionByName(joined)


def _vote(values: Column) -> Column:
    """struct(votes, value) of an array of struct(value, weight): the value that most weight agrees with, first of equals."""
    said = F.filter(values, lambda x: x["value"].isNotNull())
    votes = F.transform(
        said,
        lambda x: F.struct(F.aggregate(F.filter(said, lambda u: F.abs(u["value"] - x["value"]) <= VOTE_TOLERANCE), F.lit(0.0), lambda s, u: s + u["weight"]).alias("votes"), x["value"].alias("value")),
    )
    none = F.lit(None).cast("struct<votes:double,value:double>")
    return F.aggregate(votes, none, lambda best, x: F.when(best.isNull() | (x["votes"] > best["votes"]), x).otherwise(best))


def _pairs(field: str, keep=lambda x: F.lit(True)) -> Column:
    return F.transform(F.filter("items", keep), lambda x: F.struct(x[field].alias("value"), x["weight"].alias("weight")))


def _by_votes(said: Column) -> Column:
    """Texts of an array of struct(text, weight), most weight first, first said of equals."""
    texts = F.array_distinct(F.transform(said, lambda x: x["text"]))
    scored = F.transform(
        texts, lambda t, i: F.struct((-F.aggregate(F.filter(said, lambda x: x["text"] == t), F.lit(0.0), lambda s, x: s + x["weight"])).alias("votes"), i.alias("turn"), t.alias("text"))
    )
    return F.transform(F.array_sort(scored), lambda x: x["text"])


def consensus(items: DataFrame) -> DataFrame:
    """receipt_id, line_no, name, code, code_reads, qty, unit, unit_price, discount, total, printed_total, contested of each line.

    items: as ITEM, ``place`` being an item's turn among all items of its receipt, reading by reading. A line has an item or
    few of each reading, so it is one row with its items in an array, and votes are taken over that array.
    A discount counts if it is within the total. The voted total gives way to that of an item with a printed sum and
    right arithmetic, if another item's isn't so and no such item agrees with the vote. A line is contested if its vote
    lacks some weight and some reading's total differs from the one chosen.
    """
    rows = F.struct("turn", *[c for c in items.columns if c != "receipt_id"])
    by = lines_of(items).groupBy("receipt_id", "line").agg(F.array_sort(F.collect_list(rows)).alias("items"))
    by = by.withColumns(
        {
            "t": _vote(_pairs("total")),
            "q": _vote(_pairs("qty")),
            "u": _vote(_pairs("unit_price")),
            "d": _vote(_pairs("discount", lambda x: x["discount"].isNull() | ((x["discount"] > 0) & (x["discount"] <= x["total"])))),
            # printed sums are weighed by their turn among the printed ones
            "p": _vote(F.transform(F.filter("items", lambda x: x["printed_total"].isNotNull()), lambda x, i: F.struct(x["printed_total"].alias("value"), F.get(F.col("items.weight"), i).alias("weight")))),
        }
    )
    sums = lambda x: F.abs(x["qty"] * x["unit_price"] - F.coalesce(x["discount"], F.lit(0.0)) - x["total"]) <= MATH_TOLERANCE
    sound = lambda x: x["printed_total"].isNotNull() & F.coalesce(sums(x), F.lit(False))
    priced = F.filter("items", lambda x: x["total"].isNotNull())
    good = F.filter(priced, sound)
    agreed = F.exists(good, lambda x: F.abs(x["total"] - F.col("t.value")) <= VOTE_TOLERANCE)
    strongest = F.aggregate(good, F.lit(None).cast("struct<weight:double,total:double>"), lambda b, x: F.when(b.isNull() | (x["weight"] > b["weight"]), F.struct(x["weight"].alias("weight"), x["total"].alias("total"))).otherwise(b))
    over = (F.size(good) > 0) & (F.size(good) < F.size(priced)) & ~agreed
    by = by.withColumn("chosen", F.when(over, strongest["total"]).otherwise(F.col("t.value")))
    weight = F.aggregate("items", F.lit(0.0), lambda s, x: s + x["weight"])
    apart = F.exists("items", lambda x: x["total"].isNotNull() & (F.abs(x["total"] - F.col("chosen")) > VOTE_TOLERANCE))
    top = F.array_max(F.col("items.weight")) - 1e-9
    said = lambda x, c: F.struct(c.alias("text"), x["weight"].alias("weight"))
    codes = F.transform(F.filter("items", lambda x: F.coalesce(x["code"], F.lit("")) != ""), lambda x: said(x, x["code"]))
    reads = F.flatten(F.transform("items", lambda x: F.transform(F.coalesce(x["code_reads"], F.array().cast("array<string>")), lambda r: said(x, r))))
    return by.select(
        "receipt_id",
        F.col("line").alias("line_no"),
        best_name(F.transform(F.filter("items", lambda x: x["weight"] >= top), lambda x: F.coalesce(x["name"], F.lit("")))).alias("name"),
        F.get(_by_votes(codes), F.lit(0)).alias("code"),
        F.slice(_by_votes(reads), 1, MOST_READS).alias("code_reads"),
        F.col("q.value").alias("qty"),
        F.get(F.filter(F.col("items.unit"), lambda u: F.coalesce(u, F.lit("")) != ""), F.lit(0)).alias("unit"),
        F.col("u.value").alias("unit_price"),
        F.col("d.value").alias("discount"),
        F.col("chosen").alias("total"),
        F.col("p.value").alias("printed_total"),
        F.coalesce((F.size("items") > 1) & (F.col("t.votes") < weight) & F.col("chosen").isNotNull() & apart, F.lit(False)).alias("contested"),
    )


def _readings(s, d) -> DataFrame:
    """Four readings of each receipt line: cut or foreign names, slips in sums, amounts and codes, missing values and numbers."""
    line = receipt_lines(s, d).groupBy("receipt_id", "line_no").agg(F.max(F.struct("total", "qty", "unit_price", "discount", "product_id")).alias("b")).select("receipt_id", "line_no", "b.*")
    k, r = F.col("receipt_id") * 7 + F.col("line_no"), F.col("reading")
    own = line.withColumn("reading", F.explode(F.array(*[F.lit(i) for i in range(4)])))
    name = F.upper(F.substring(F.md5(F.col("product_id").cast("string")), 1, 16))  # names of no kinship, so that SQL can tell alike from different
    hit = lambda m, at: (k % m == at) & (r == at % 4)
    code = F.concat(F.lit("789"), F.lpad(F.col("product_id").cast("string"), 10, "0"))
    slip = F.concat(F.lit("780"), F.lpad((F.col("product_id") + r).cast("string"), 10, "0"))
    total = F.round(F.col("total").cast("double") + F.when(hit(5, 0), 3.0).when(hit(7, 1), 3.0).when(hit(3, 2), 0.01).otherwise(0.0), 2)
    return own.select(
        "receipt_id",
        (r * 1_000_000 + F.col("line_no")).cast("long").alias("place"),
        pick(("1", "0.75", "1", "0.5"), r).cast("double").alias("weight"),
        F.when(~hit(11, 3), F.col("line_no")).cast("long").alias("line_no"),
        F.when(hit(6, 2), F.substring(name, 1, 6)).when(hit(13, 0), None).otherwise(name).alias("name"),
        F.when(hit(4, 1), slip).when(k % 9 != 4, code).alias("code"),
        F.array_compact(F.array(F.when(k % 9 != 4, code), F.when(k % 8 == r, slip))).alias("code_reads"),
        (F.col("qty").cast("double") + F.when(hit(10, 1), 1.0).otherwise(0.0)).alias("qty"),
        F.when(r >= 2, F.lit("kg")).alias("unit"),
        F.when(~hit(12, 0), F.col("unit_price").cast("double")).alias("unit_price"),
        F.when(k % 2 == 0, F.round(F.col("discount").cast("double") + F.when(hit(14, 2), 9999.0).otherwise(0.0), 2)).alias("discount"),
        F.when(~hit(15, 3), total).alias("total"),
        F.when(k % 3 == r % 3, total).alias("printed_total"),
    )


def _q_consensus(s, d) -> DataFrame:
    return consensus(_readings(s, d)).withColumn("code_reads", F.array_join("code_reads", "|"))


QUERIES = {"ag_receipt_consensus": _q_consensus}


def _vote_sql(name: str, source: str) -> str:
    """CTE ``name``: receipt_id, line, votes, value: of ``source`` (receipt_id, line, turn, value, weight) the first value with most weight."""
    return f"""{name}0 AS ({source}), {name} AS (SELECT receipt_id, line, max(votes) AS votes, arg_min(value, (-votes, turn)) AS value FROM (SELECT a.receipt_id, a.line, a.turn, a.value, sum(b.weight) AS votes FROM {name}0 a JOIN {name}0 b
      ON a.receipt_id = b.receipt_id AND a.line = b.line AND abs(a.value - b.value) <= {VOTE_TOLERANCE} GROUP BY a.receipt_id, a.line, a.turn, a.value) GROUP BY 1, 2)"""


def _field(value: str, where: str = "true") -> str:
    return f"SELECT receipt_id, line, turn, weight, {value} AS value FROM it WHERE {where} AND {value} IS NOT NULL"


_SOUND = f"total IS NOT NULL AND printed IS NOT NULL AND coalesce(abs(qty * unit_price - coalesce(discount, 0) - total) <= {MATH_TOLERANCE}, false)"
# names here are equal, cut or missing, so a ratio is 100 or far too low
_SQL = with_tables(f"""WITH b AS (SELECT receipt_id, line_no, max((total, qty, unit_price, discount, product_id)) AS b FROM receipt_lines GROUP BY 1, 2),
  r0 AS (SELECT receipt_id, line_no, b[1]::DOUBLE AS total0, b[2]::DOUBLE AS qty0, b[3]::DOUBLE AS unit0, b[4]::DOUBLE AS disc0, b[5] AS pid, receipt_id * 7 + line_no AS k, unnest([0, 1, 2, 3]) AS r FROM b),
  r1 AS (SELECT *, r * 1000000 + line_no AS place, [1.0, 0.75, 1.0, 0.5][r + 1]::DOUBLE AS weight, upper(md5(pid::VARCHAR)[:16]) AS nm, '789' || lpad(pid::VARCHAR, 10, '0') AS c0, '780' || lpad((pid + r)::VARCHAR, 10, '0') AS c1,
    round(total0 + (CASE WHEN k % 5 = 0 AND r = 0 THEN 3 WHEN k % 7 = 1 AND r = 1 THEN 3 WHEN k % 3 = 2 AND r = 2 THEN 0.01 ELSE 0 END)::DOUBLE, 2) AS t1 FROM r0),
  r2 AS (SELECT receipt_id, place, weight, CASE WHEN NOT (k % 11 = 3 AND r = 3) THEN line_no END AS line_no, CASE WHEN k % 6 = 2 AND r = 2 THEN nm[:6] WHEN k % 13 = 0 AND r = 0 THEN NULL ELSE nm END AS name,
    CASE WHEN k % 4 = 1 AND r = 1 THEN c1 WHEN k % 9 <> 4 THEN c0 END AS code, list_filter([CASE WHEN k % 9 <> 4 THEN c0 END, CASE WHEN k % 8 = r THEN c1 END], lambda x: x IS NOT NULL) AS reads, qty0 + CASE WHEN k % 10 = 1 AND r = 1 THEN 1 ELSE 0 END AS qty,
    CASE WHEN r >= 2 THEN 'kg' END AS unit, CASE WHEN NOT (k % 12 = 0 AND r = 0) THEN unit0 END AS unit_price, CASE WHEN k % 2 = 0 THEN round(disc0 + CASE WHEN k % 14 = 2 AND r = 2 THEN 9999 ELSE 0 END, 2) END AS discount,
    CASE WHEN NOT (k % 15 = 3 AND r = 3) THEN t1 END AS total, CASE WHEN k % 3 = r % 3 THEN t1 END AS printed FROM r1),
  f AS (SELECT receipt_id, line_no, arg_min(coalesce(name, ''), place) AS name, min(place) AS place FROM r2 WHERE line_no IS NOT NULL GROUP BY 1, 2),
  st AS (SELECT r2.receipt_id, r2.place, arg_min(f.line_no, f.place) AS line FROM r2 JOIN f ON r2.receipt_id = f.receipt_id AND r2.name = f.name WHERE r2.line_no IS NULL GROUP BY 1, 2),
  it AS (SELECT r2.*, line_no AS line, (0, place) AS turn FROM r2 WHERE line_no IS NOT NULL UNION ALL SELECT r2.*, st.line, (1, r2.place) FROM r2 JOIN st ON r2.receipt_id = st.receipt_id AND r2.place = st.place WHERE line_no IS NULL),
  g AS (SELECT receipt_id, line, list(weight ORDER BY turn) AS ws, sum(weight) AS w, max(weight) AS top, count(*) AS n, arg_min(unit, turn) FILTER (WHERE unit IS NOT NULL) AS unit, count(*) FILTER (WHERE {_SOUND}) AS n_good, count(total) AS n_priced,
    arg_min(total, (-weight, turn)) FILTER (WHERE {_SOUND}) AS strongest FROM it GROUP BY 1, 2),
  {_vote_sql("t", _field("total"))}, {_vote_sql("q", _field("qty"))}, {_vote_sql("u", _field("unit_price"))}, {_vote_sql("d", _field("discount", "(discount > 0 AND discount <= total)"))},
  {_vote_sql("p", "SELECT receipt_id, line, turn, ws[row_number() OVER (PARTITION BY receipt_id, line ORDER BY turn)] AS weight, printed AS value FROM it JOIN g USING (receipt_id, line) WHERE printed IS NOT NULL")},
  ag AS (SELECT it.receipt_id, it.line, bool_or(({_SOUND}) AND abs(total - t.value) <= {VOTE_TOLERANCE}) AS agreed FROM it JOIN t USING (receipt_id, line) GROUP BY 1, 2),
  ch AS (SELECT g.*, t.votes, CASE WHEN n_good > 0 AND n_good < n_priced AND NOT agreed THEN strongest ELSE t.value END AS chosen FROM g LEFT JOIN t USING (receipt_id, line) LEFT JOIN ag USING (receipt_id, line)),
  nm AS (SELECT receipt_id, line, arg_min(coalesce(name, ''), (length(coalesce(name, '')), turn)) AS name FROM (SELECT it.*, first_value(coalesce(name, '')) OVER (PARTITION BY it.receipt_id, it.line ORDER BY turn) AS ref FROM it JOIN g USING (receipt_id, line) WHERE weight = top)
    WHERE CASE WHEN ref = '' THEN coalesce(name, '') = '' ELSE starts_with(ref, coalesce(name, 'x')) OR starts_with(name, ref) END GROUP BY 1, 2),
  cd AS (SELECT receipt_id, line, arg_min(code, (-w, turn)) AS code FROM (SELECT receipt_id, line, code, sum(weight) AS w, min(turn) AS turn FROM it WHERE code IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2),
  rd AS (SELECT receipt_id, line, array_to_string((list(x ORDER BY -w, pos))[:{MOST_READS}], '|') AS reads FROM (SELECT receipt_id, line, x, sum(weight) AS w, min((turn, i)) AS pos FROM (SELECT receipt_id, line, turn, weight, unnest(reads) AS x, generate_subscripts(reads, 1) AS i FROM it) GROUP BY 1, 2, 3) GROUP BY 1, 2)
  SELECT ch.receipt_id, ch.line AS line_no, nm.name, cd.code, coalesce(rd.reads, '') AS code_reads, q.value AS qty, ch.unit, u.value AS unit_price, d.value AS discount, chosen AS total, p.value AS printed_total,
    n > 1 AND ch.votes < ch.w AND coalesce((SELECT bool_or(abs(x.total - chosen) > {VOTE_TOLERANCE}) FROM it x WHERE x.receipt_id = ch.receipt_id AND x.line = ch.line), false) AS contested
  FROM ch LEFT JOIN nm USING (receipt_id, line) LEFT JOIN cd USING (receipt_id, line) LEFT JOIN rd USING (receipt_id, line) LEFT JOIN q USING (receipt_id, line) LEFT JOIN u USING (receipt_id, line) LEFT JOIN d USING (receipt_id, line) LEFT JOIN p USING (receipt_id, line)""", "receipt_lines")

ORACLE_SQL = {"ag_receipt_consensus": _SQL}
