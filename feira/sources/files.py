"""Curated files and stored tables: CSV and JSON readers that say which rows are wrong, and keyed tables that can be
written again without harm."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feira.functions.text import clean
from feira.functions.values import code_read, digits, gs1_check, normalize_code, tolerant_json
from feira.sources.domain import code_table, products, receipt_lines, taxonomy, with_tables

_OWN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only in a local session, whose executors are the driver."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        _OWN[:] = _OWN or ["file://" + tempfile.mkdtemp(prefix="spark-shared-")]
        folder = _OWN[0]
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


class KeyedTable:
    """Rows by key, in a folder with a Parquet version for each write. A version counts once its job has committed, so a
    write that fails or is done again leaves the same table; an empty input writes nothing."""

    def __init__(self, spark: SparkSession, folder: str, key: list[str]):
        self.spark, self.folder, self.key = spark, folder, key

    def version(self) -> int:
        try:
            found = self.spark.read.option("basePath", self.folder).parquet(self.folder)
        except AnalysisException:
            return 0
        return found.agg(F.max("version")).first()[0] or 0

    def read(self) -> DataFrame | None:
        n = self.version()
        return self.spark.read.parquet(f"{self.folder}/version={n}") if n else None

    def save(self, rows: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> DataFrame:
        """The table after ``rows`` (one for each key) replaced those of equal key, or after ``merge(old, rows)``."""
        old, n = self.read(), self.version()
        if not rows.take(1):
            return rows if old is None else old
        if old is not None:
            rows = merge(old, rows) if merge else old.join(rows.select(*self.key), self.key, "left_anti").unionByName(rows)
        path = f"{self.folder}/version={n + 1}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)


class BucketTable:
    """Rows by key in ``buckets`` partitions of a folder: a save reads and rewrites only the buckets its rows fall into.

    The buckets are replaced when the job commits, and a save whose rows are all there already leaves the same table, so
    one that fails half way is simply done again. ``merge`` may change and add keys, not drop them. One writer at a time.
    """

    def __init__(self, spark: SparkSession, folder: str, key: list[str], buckets: int = 16):
        self.spark, self.folder, self.key, self.buckets = spark, folder, key, buckets

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.expr(f"cast(pmod(xxhash64({', '.join(self.key)}), {self.buckets}) as int)"))

    def read(self, touched: list[int] | None = None) -> DataFrame | None:
        """The table, or only some buckets of it; None before the first save."""
        try:
            found = self.spark.read.parquet(self.folder)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            return None
        return (found if touched is None else found.filter(F.col("bucket").isin(touched))).drop("bucket")

    def save(self, rows: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> DataFrame | None:
        """The table after ``rows`` (one for each key) replaced those of equal key, or after ``merge(old, rows)``. Without rows nothing changes."""
        own = self._bucketed(rows)
        touched = [r.bucket for r in own.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
        if touched:
            old = self.read(touched)
            if old is not None:
                rows = merge(old, rows) if merge else old.join(rows.select(*self.key), self.key, "left_anti").unionByName(rows)
            spread = self._bucketed(rows).repartition("bucket", F.expr(f"pmod(hash({', '.join(self.key)}), 8)"))  # a bucket may be large
            spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.folder)
        return self.read()


def added(key: list[str]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A merge that only adds: rows whose key is there already are left out."""
    return lambda old, new: old.unionByName(new.join(old.select(*key), key, "left_anti"))


def saved_in_turn(table: KeyedTable | BucketTable, batches: list[DataFrame], merge: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> DataFrame:
    """What ``table`` holds after the batches, the last of them again, and one without rows."""
    for batch in [*batches, batches[-1], batches[-1].limit(0)]:
        table.save(batch, merge)
    return table.read()


def read_csv(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """The named columns of CSV files with a header (missing ones null), trimmed, with ``line`` in the order of the file."""
    raw = spark.read.csv(path, header=True, encoding="UTF-8", multiLine=True, escape='"')
    raw = raw.toDF(*[c.removeprefix("﻿").strip() for c in raw.columns])
    have = [F.trim(c).alias(c) if c in raw.columns else F.lit(None).cast("string").alias(c) for c in columns]
    return raw.select(F.monotonically_increasing_id().alias("line"), *have)


def refuse(bad: DataFrame, what: str) -> None:
    """Raise with a few of the ``bad`` rows, if there are any: a curated file with a wrong row isn't used at all."""
    some = bad.limit(3).collect()
    if some:
        raise ValueError(f"{what}: {'; '.join(str(r.asDict()) for r in some)}")


def _last(rows: DataFrame, key: str) -> DataFrame:
    """Of rows with an equal key the last one of the file."""
    others = [c for c in rows.columns if c not in (key, "line")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), "line").alias("r")).select(key, "r.*")


CATEGORY_MAP = ("category_slug", "category_path", "category_name", "ncm_code", "ncm_description", "confidence", "source", "reason")


def category_map(spark: SparkSession, path: str, codes: DataFrame | None = None) -> DataFrame:
    """slug, code, confidence, source, reason of a category map; a slug with a malformed code, or one that ``codes`` lacks, fails."""
    rows = read_csv(spark, path, "category_slug", "ncm_code", "confidence", "source", "reason").filter("category_slug <> ''")
    rows = rows.select("line", F.col("category_slug").alias("slug"), normalize_code(F.col("ncm_code")).alias("code"), "ncm_code", F.col("confidence").try_cast("double").alias("confidence"), F.coalesce(F.nullif("source", F.lit("")), F.lit("manual")).alias("source"), F.coalesce("reason", F.lit("")).alias("reason"))
    refuse(rows.filter("code is null").select("slug", "ncm_code"), "categories without a valid code")
    if codes is not None:
        refuse(rows.join(codes.select("code"), "code", "left_anti").select("slug", "code"), "categories with an unknown code")
    return _last(rows.drop("ncm_code"), "slug")


def write_category_map(rows: DataFrame, path: str) -> str:
    """Category map rows (CATEGORY_MAP; missing columns empty) as one CSV file in order of slug; the path."""
    have = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in rows.columns else F.lit("").alias(c) for c in CATEGORY_MAP]
    # a map of categories is small by nature: the feature is one sorted file
    rows.select(*have).orderBy("category_slug").coalesce(1).write.mode("overwrite").csv(path, header=True, escape='"', emptyValue="")
    return path


def heading_departments(spark: SparkSession, path: str) -> DataFrame:
    """prefix, department; rows without a valid code or department are left out."""
    rows = read_csv(spark, path, "ncm", "department").select("line", normalize_code(F.col("ncm")).alias("prefix"), "department")
    return _last(rows.filter("prefix is not null and department <> ''"), "prefix")


def product_overrides(spark: SparkSession, path: str) -> DataFrame:
    """folded (name), code of corrections by hand; a name without a valid code fails."""
    rows = read_csv(spark, path, "name", "ncm_code").filter("name <> ''").withColumn("code", normalize_code(F.col("ncm_code")))
    refuse(rows.filter("code is null").select("name", "ncm_code"), "corrections without a valid code")
    return _last(rows.select("line", clean("name").alias("folded"), "code"), "folded")


def gtin_answers(spark: SparkSession, path: str, codes: DataFrame) -> DataFrame:
    """gtin (14 digits), code: barcode answers under either pair of column names; rows without a valid barcode or a known
    code are left out."""
    rows = read_csv(spark, path, "gtin", "code", "ncm", "ncm_code")
    number = digits(F.coalesce(F.nullif("gtin", F.lit("")), "code"))
    rows = rows.select("line", F.when(F.length(number).isin(8, 12, 13, 14), F.lpad(number, 14, "0")).alias("gtin"), normalize_code(F.coalesce(F.nullif("ncm", F.lit("")), "ncm_code")).alias("code"))
    return _last(rows.filter("gtin is not null and code is not null").join(codes.select("code"), "code", "left_semi"), "gtin")


def lookup_rows(spark: SparkSession, path: str) -> DataFrame:
    """line, num, name, gtin, file, status (ok or review) of an operator's lookup; rows marked otherwise are left out."""
    rows = read_csv(spark, path, "num", "name", "gtin_input", "file", "status")
    status = F.when(F.upper("status") == "OK", "ok").when(F.upper("status") == "REVIEW", "review")
    return rows.select("line", F.col("num").try_cast("int").alias("num"), "name", F.nullif("gtin_input", F.lit("")).alias("gtin"), F.coalesce("file", F.lit("")).alias("file"), status.alias("status")).filter("status is not null")


SNAPSHOT = "etag string, generated_at string, products array<struct<id:string,name:string,brand:string,gtin:string,image_url:string>>, offers array<struct<product_id:string,price_cents:int,retailer_name:string,price_observed_at:string>>"


def snapshots(spark: SparkSession, path: str) -> DataFrame:
    """key, etag, generated_at, sha256, products, offers of snapshot files (one JSON text each): the key is made of the
    first 12 hex digits of the text's hash, which also is the etag of a file without one."""
    raw = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).withColumn("sha256", F.sha2("value", 256)).withColumn("j", F.from_json("value", SNAPSHOT))
    key = F.conv(F.substring("sha256", 1, 12), 16, 10).cast("long")
    return raw.select(key.alias("key"), F.coalesce("j.etag", "sha256").alias("etag"), "j.generated_at", "sha256", F.coalesce("j.products", F.array()).alias("products"), F.coalesce("j.offers", F.array()).alias("offers"))


READING = "items array<struct<line:string,name:string,code:string,qty:double,unit:string,unit_price:double,discount:double,printed_total:double>>"


def receipt_readings(replies: DataFrame) -> DataFrame:
    """Typed lines of readers' replies (reading_id, reply: JSON, maybe with talk around it).

    A line number is the number a line begins with; the total is the printed one, else quantity (1 if unread) times unit
    price less the discount. A reply without JSON gives one row with ``failed``.
    """
    parsed = replies.withColumn("j", tolerant_json(F.col("reply"), READING))
    rows = parsed.select("reading_id", F.col("j").isNull().alias("failed"), F.posexplode_outer("j.items").alias("place", "x")).filter("failed or x is not null")
    line = F.regexp_extract(F.trim("x.line"), r"^\D{0,2}(\d{1,4})\b", 1).try_cast("int")
    off = F.abs("x.discount")
    total = F.coalesce("x.printed_total", F.round(F.coalesce("x.qty", F.lit(1.0)) * F.col("x.unit_price") - F.coalesce(off, F.lit(0.0)), 2))
    return rows.select("reading_id", "failed", "place", line.alias("line_no"), F.coalesce("x.name", F.lit("")).alias("name"), gs1_check(F.col("x.code")).alias("code"), code_read(F.col("x.code")).alias("code_read"), "x.qty", "x.unit", "x.unit_price", off.alias("discount"), total.alias("total"))


def _as_csv(df: DataFrame, name: str) -> str:
    path = new_folder(df.sparkSession, name)
    df.write.csv(path, header=True, escape='"')
    return path


def _map_rows(s, d) -> DataFrame:
    """A category map for the leaves of the tree, with codes of the code table."""
    leaves = taxonomy(s, d).filter("is_leaf")
    code = code_table(s, d).filter("length(code) = 8").agg(F.min("code").alias("ncm_code"))
    return leaves.join(F.broadcast(code)).select(F.col("slug").alias("category_slug"), F.col("path").alias("category_path"), F.col("name").alias("category_name"), "ncm_code", F.lit("0.5").alias("confidence"), F.when(F.length("slug") % 2 == 0, "manual").otherwise("").alias("source"), F.lit("a, \"b\"").alias("reason"))


def _q_category_map(s, d):
    return category_map(s, write_category_map(_map_rows(s, d), new_folder(s, "category-map")), code_table(s, d))


def _q_written_map(s, d):
    return s.read.csv(write_category_map(_map_rows(s, d), new_folder(s, "category-map")), header=True, escape='"')


def _q_departments(s, d):
    c = code_table(s, d)
    dotted = F.concat(F.substring("code", 1, 4), F.when(F.length("code") > 4, ".").otherwise(""), F.substring("code", 5, 4))
    return heading_departments(s, _as_csv(c.select(dotted.alias("ncm"), F.when(F.length("code") > 2, F.concat(F.lit(" d"), F.substring("code", 1, 2))).alias("department")), "departments"))


def _q_overrides(s, d):
    p = products(s, d)
    return product_overrides(s, _as_csv(p.groupBy(F.concat(F.lit(" "), F.upper("name")).alias("name")).agg(F.lpad(F.max("id").cast("string"), 8, "1").alias("ncm_code")), "overrides"))


def _q_gtin_answers(s, d):
    p = products(s, d)
    code = F.lpad(((F.col("id") * 7919) % 90_000_000 + 10_000_000).cast("string"), 8, "0")
    return gtin_answers(s, _as_csv(p.select(F.when(F.col("id") % 2 == 0, F.col("gtin")).alias("gtin"), F.col("gtin").alias("code"), F.when(F.col("id") % 3 == 0, code).alias("ncm"), code.alias("ncm_code")).filter("code is not null").dropDuplicates(["code"]).orderBy("code"), "answers"), code_table(s, d))


def _q_lookup(s, d):
    p = products(s, d)
    k = F.col("id")
    rows = p.select(k.cast("string").alias("num"), "name", F.col("gtin").alias("gtin_input"), F.concat(k.cast("string"), F.lit(".webp")).alias("file"), F.when(k % 3 == 0, "ok").when(k % 3 == 1, "Review").otherwise("NONE").alias("status"))
    return lookup_rows(s, _as_csv(rows, "lookup")).drop("line")


def _q_snapshot(s, d):
    p = products(s, d).groupBy((F.col("id") % 5).alias("part")).agg(F.sort_array(F.collect_list(F.struct(F.col("id").cast("string").alias("id"), "name", "brand", "gtin"))).alias("products"), F.count("*").alias("n"))
    path = new_folder(s, "snapshots")
    body = F.to_json(F.struct(F.concat(F.lit("tag-"), F.col("part").cast("string")).alias("etag"), "products"))
    p.select(body.alias("value"), "part").repartition("part").write.partitionBy("part").text(path)  # a file for each
    return snapshots(s, path).select(F.posexplode("products").alias("i", "p"), "etag").select("etag", F.col("p.id").cast("long").alias("id"), "p.name")


def _q_readings(s, d):
    r = receipt_lines(s, d)
    k = F.col("line_no")
    item = F.struct(F.concat(F.when(k % 2 == 0, "#").otherwise(""), k.cast("string"), F.lit(".")).alias("line"), F.concat(F.lit("P"), F.col("product_id").cast("string")).alias("name"), F.col("qty").cast("double").alias("qty"), F.col("unit_price"), (-F.col("discount")).alias("discount"), F.when(k % 3 == 0, F.round("total", 2)).alias("printed_total"))
    by = r.groupBy("receipt_id").agg(F.to_json(F.struct(F.sort_array(F.collect_list(item)).alias("items"))).alias("j"))
    replies = by.select(F.col("receipt_id").alias("reading_id"), F.concat(F.lit("Here it is:\n```json\n"), "j", F.lit("\n```")).alias("reply"))
    return receipt_readings(replies).select("reading_id", "line_no", "name", "qty", F.round("discount", 2).alias("discount"), F.round("total", 2).alias("total"))


QUERIES = {
    "src_category_map_csv": _q_category_map,
    "src_heading_departments_csv": _q_departments,
    "src_overrides_csv": _q_overrides,
    "src_gtin_answers_csv": _q_gtin_answers,
    "src_lookup_csv": _q_lookup,
    "src_snapshot_json": _q_snapshot,
    "src_receipt_readings": _q_readings,
    "snk_category_map": _q_written_map,
}

_MAP = "(SELECT *, (SELECT min(code) FROM code_table WHERE length(code) = 8) AS code FROM taxonomy WHERE is_leaf)"
ORACLE_SQL = {
    "src_category_map_csv": with_tables(f"SELECT slug, code, 0.5::DOUBLE AS confidence, 'manual' AS source, 'a, \"b\"' AS reason FROM {_MAP}", "taxonomy", "code_table"),
    "snk_category_map": with_tables(f"SELECT slug AS category_slug, path AS category_path, name AS category_name, code AS ncm_code, NULL AS ncm_description, '0.5' AS confidence, CASE WHEN length(slug) % 2 = 0 THEN 'manual' END AS source, 'a, \"b\"' AS reason FROM {_MAP}", "taxonomy", "code_table"),
    "src_heading_departments_csv": with_tables("SELECT code AS prefix, 'd' || code[:2] AS department FROM code_table WHERE length(code) > 2", "code_table"),
    "src_overrides_csv": with_tables("SELECT trim(regexp_replace(lower(strip_accents(name)), '\\s+', ' ', 'g')) AS folded, lpad(max(id)::VARCHAR, 8, '1') AS code FROM products GROUP BY 1", "products"),
    "src_lookup_csv": with_tables("SELECT id::INT AS num, name, gtin, id || '.webp' AS file, CASE WHEN id % 3 = 0 THEN 'ok' ELSE 'review' END AS status FROM products WHERE id % 3 < 2", "products"),
    "src_snapshot_json": with_tables("SELECT 'tag-' || (id % 5) AS etag, id, name FROM products", "products"),
    "src_receipt_readings": with_tables("""SELECT receipt_id AS reading_id, line_no::INT AS line_no, 'P' || product_id AS name, qty::DOUBLE AS qty, round(discount, 2) AS discount,
        round(CASE WHEN line_no % 3 = 0 THEN total ELSE qty * unit_price - discount END, 2) AS total FROM receipt_lines""", "receipt_lines"),
}
