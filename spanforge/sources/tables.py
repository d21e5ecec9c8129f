"""Readers with declared behaviour for broken input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def evidence_log(spark: SparkSession, path: str, schema: T.StructType | str, skip_corrupt: bool = False) -> DataFrame:
    """JSON lines of audit records; a corrupt line fails the read unless told otherwise."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED" if skip_corrupt else "FAILFAST").json(path)


def record_files(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One JSON document a file, with the file it came from."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path).withColumn("file", F.col("_metadata.file_name"))


def fixed_width_index(spark: SparkSession, path: str) -> DataFrame:
    """(form, rest) of index lines whose first twelve characters name the form."""
    return spark.read.text(path).select(F.trim(F.substring("value", 1, 12)).alias("form"), F.trim(F.expr("substring(value, 13)")).alias("rest")).where("form <> ''")


def label_csv(spark: SparkSession, path: str) -> DataFrame:
    """Gold labels ``label,Content`` with the item code that a begin or inside label names; row order in ``line``."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return rows.select(
        F.monotonically_increasing_id().alias("line"), "label", "Content", F.when(F.col("label").rlike("^[BI].+"), F.upper(F.expr("substring(label, 2)"))).alias("item")
    )


def append_evidence(records: DataFrame, path: str) -> None:
    """Audit records are only ever added, a folder a run."""
    records.write.mode("append").partitionBy("run_id").json(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of every file under a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def report_list(spark: SparkSession, path: str) -> DataFrame:
    """A CSV list of reports under plain names, all trimmed; a byte order mark is no part of the first name."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    names = {"company name": "company", "Link to edgar": "link", "SIC": "sic"}
    clean = [(c, c.lstrip("﻿").strip()) for c in rows.columns]
    return rows.select(*(F.trim(F.coalesce(F.col(f"`{c}`"), F.lit(""))).alias(names.get(n, n)) for c, n in clean))


def csv_rows_of(spark: SparkSession, path: str, keys: DataFrame, key: str) -> DataFrame:
    """Rows of a large CSV whose key another frame has; Spark picks the join, so no list of keys passes through the driver."""
    return spark.read.option("header", True).csv(path).join(keys.select(key).distinct(), key, "left_semi")


def first_records(spark: SparkSession, path: str, schema: T.StructType | str, k: int) -> DataFrame:
    """The first k records of each file of JSON lines, in the order of their lines, with the file they came from.

    A line's place comes from where it lies in its file, so files are ranked apart.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("place")).where(F.trim("value") != "")
    rank = F.row_number().over(Window.partitionBy("file").orderBy("place"))
    return lines.withColumn("rank", rank).where(F.col("rank") <= k).select("file", "rank", F.from_json("value", schema).alias("record")).select("file", "rank", "record.*")


def ids_by_ticker(wanted: DataFrame, index: DataFrame) -> DataFrame:
    """The wanted tickers with the id that the index has for them, without regard to case and blanks; null where it has none."""
    key = F.upper(F.trim("ticker"))
    known = index.select(key.alias("_key"), "cik").dropDuplicates(["_key"])
    return wanted.withColumn("_key", key).join(known, "_key", "left").drop("_key")


def numbered_files(spark: SparkSession, path: str, pattern: str = r"agent-(\d+)\.png$") -> DataFrame:
    """(path, length, number) of files in the order of the number in their name; those without one come last."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", F.nullif(F.regexp_extract("path", pattern, 1), F.lit("")).cast("long").alias("number"))
    return files.orderBy(F.col("number").asc_nulls_last(), "path")


def decoded_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, replaced): files as UTF-8, with the number of replacement characters that bad bytes brought in; those that a file holds itself don't count. Spark reads no empty files, so these give no row."""
    mark = "�"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"), F.hex("content").alias("_hex"))
    count = lambda c, s: F.length(c) - F.length(F.replace(c, F.lit(s), F.lit("")))
    literal = F.regexp_count(F.regexp_replace("_hex", "(..)", "$1 "), F.lit("EF BF BD"))
    return files.select("path", "text", F.greatest(F.lit(0), count(F.col("text"), mark) - literal).alias("replaced"))


_HITS = "hits struct<hits: array<struct<_id: string, _source: struct<adsh: string, ciks: array<string>, file_date: string, form: string, display_names: array<string>>>>>"


def search_hits(answers: DataFrame, column: str = "value", forms: str = "10-K", limit: int = 40) -> DataFrame:
    """Rows of full-text search answers (JSON), the first ``limit`` hits of each; what a hit lacks has a plain default. Answers without hits give no row."""
    listed = answers.select(F.explode(F.slice(F.from_json(column, _HITS)["hits"]["hits"], 1, limit)).alias("h"))
    id_, source = F.coalesce("h._id", F.lit("")), "h._source."
    first = lambda c, default: F.coalesce(F.get(F.col(source + c), F.lit(0)), F.lit(default))
    adsh = F.nullif(F.coalesce(F.col(source + "adsh"), F.lit("")), F.lit(""))
    return listed.select(
        F.coalesce(adsh, F.substring_index(id_, ":", 1)).alias("accession"), first("ciks", "0").cast("long").alias("cik"),
        F.when(id_.contains(":"), F.substring_index(id_, ":", -1)).otherwise("").alias("primary_document"), F.coalesce(F.col(source + "file_date"), F.lit("")).alias("file_date"),
        F.coalesce(F.col(source + "form"), F.lit(forms)).alias("form"), first("display_names", "").alias("display"),
    )


def task_states(marks: DataFrame) -> DataFrame:
    """(task_id, status, written_at) of each task from the marks it left: its last done or error, else incomplete, which tells that it died midway."""
    order = F.struct((F.col("status") != "incomplete").alias("ended"), "written_at", "status")
    return marks.groupBy("task_id").agg(F.max(order).alias("m")).select("task_id", "m.status", "m.written_at")


def write_artifact(frame: DataFrame, path: str) -> None:
    """A result as JSON in place of the one before; ``frame`` must not read from ``path``."""
    frame.write.mode("overwrite").json(path)


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a keyed store after new rows came in: a new row takes the place of the old one of its key. Columns are those of ``old``; the new have one row a key.

    Null keys are keys like others.
    """
    both = old.withColumn("_new", F.lit(0)).unionByName(new.select(*old.columns).withColumn("_new", F.lit(1)))
    latest = F.max_by(F.struct(*old.columns), "_new").alias("_row")
    return both.groupBy(*(F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys))).agg(latest).select("_row.*")


def nested_payloads(items: DataFrame, gaps: DataFrame, exhibits: DataFrame) -> DataFrame:
    """(doc_id, payload): a JSON object a document with its items (by ``ord``), gaps and exhibits (each by all their columns); documents without items are left out."""

    def listed(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*(c for c in rows.columns if c != "doc_id")))).alias(name))

    ordered = items.select("doc_id", "ord", *(c for c in items.columns if c not in ("doc_id", "ord")))
    joined = listed(ordered, "items").join(listed(gaps, "gaps"), "doc_id", "left").join(listed(exhibits, "exhibits"), "doc_id", "left")
    filled = (F.coalesce(c, F.array()).alias(c) for c in ("gaps", "exhibits"))
    counts = F.transform("items", lambda i: i.dropFields("ord")).alias("items")
    return joined.select("doc_id", F.to_json(F.struct(counts, *filled)).alias("payload"))
