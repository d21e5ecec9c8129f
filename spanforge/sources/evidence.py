"""The audit log by run, as batch and as stream; package listings; manifests of inputs and of a run."""

from __future__ import annotations

import json
import os
import platform
import subprocess
import sys
from datetime import datetime, timezone
from importlib import metadata

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

CORRUPT = "_corrupt"


def safe_run_id(run_id: Column | str) -> Column:
    """The run's id; one that is null, empty or could lead out of the log's folder fails the job."""
    col = F.col(run_id) if isinstance(run_id, str) else run_id
    bad = F.coalesce(col, F.lit("")).rlike(r"^$|/|\\|\.\.")
    return F.when(bad, F.raise_error(F.concat(F.lit("invalid run_id: "), F.coalesce(col, F.lit("null"))))).otherwise(col)


def _schema(schema: T.StructType | str) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)


def append_runs(records: DataFrame, root: str) -> None:
    """Records of the log are only ever added, a folder a run (``run_id``); an id that could lead elsewhere fails the write."""
    records.withColumn("run_id", safe_run_id("run_id")).write.mode("append").partitionBy("run_id").json(root)


def append_runs_stream(records: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """The same for a stream: all there is now, each record once, also after a restart from the checkpoint. Such a log counts what streams wrote, so batches go to another."""
    checked = records.withColumn("run_id", safe_run_id("run_id"))
    return checked.writeStream.format("json").partitionBy("run_id").option("path", root).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _parsed(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """Lines with ``r`` (their record) and ``bad``; blank ones go."""
    marked = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    read = lines.where(F.trim("value") != "").withColumn("r", F.from_json("value", marked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}))
    return read.withColumn("bad", F.col("r").isNull() | F.col(f"r.{CORRUPT}").isNotNull())


def _lines(spark: SparkSession, root: str) -> DataFrame | None:
    """(value, run_id, file, place) of a log, None where there is none yet."""
    try:
        return spark.read.schema("value string, run_id string").text(root).select("value", "run_id", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("place"))
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" in str(missing):
            return None
        raise


def corrupt_lines(spark: SparkSession, root: str, schema: T.StructType | str) -> DataFrame:
    """(file, line, value) of the lines that are no records, counted from 1 with blank ones. Only files that have such lines are counted through."""
    lines = _lines(spark, root)
    if lines is None:
        return spark.createDataFrame([], "file string, line long, value string")
    bad = _parsed(lines, _schema(schema)).where("bad").select("file", "place", "value")
    files = lines.select("file", "place").join(bad.select("file").distinct(), "file", "left_semi")
    numbered = files.withColumn("line", F.row_number().over(Window.partitionBy("file").orderBy("place")).cast("long"))
    return numbered.join(bad, ["file", "place"]).select("file", "line", "value")


def read_runs(spark: SparkSession, root: str, schema: T.StructType | str, run_id: str | None = None) -> DataFrame:
    """Records of all runs, or of one; a run or a log that is not there has no records. A line that is no record raises an error with its file and line."""
    if run_id is not None and (not run_id or "/" in run_id or "\\" in run_id or ".." in run_id):
        raise ValueError(f"invalid run_id: {run_id!r}")
    fields = _schema(schema)
    own = T.StructType([f for f in fields.fields if f.name != "run_id"])
    lines = _lines(spark, root)
    if lines is None:
        return spark.createDataFrame([], T.StructType([*own.fields, T.StructField("run_id", T.StringType())]))
    wanted = lines if run_id is None else lines.where(F.col("run_id") == run_id)
    if not _parsed(wanted, own).where("bad").isEmpty():
        first = corrupt_lines(spark, root, own).orderBy("file", "line").first()
        raise ValueError(f"{first.file}:{first.line}: corrupt evidence record")
    return _parsed(wanted, own).select(*(F.col(f"r.`{f.name}`") for f in own.fields), "run_id")


def stream_runs(spark: SparkSession, root: str, schema: T.StructType | str) -> DataFrame:
    """A stream of the log's records, with ``fault``: null, or the file and text of a line that is none."""
    own = T.StructType([f for f in _schema(schema).fields if f.name != "run_id"])
    lines = spark.readStream.schema("value string, run_id string").text(root).select("value", "run_id", F.col("_metadata.file_path").alias("file"))
    fault = F.when(F.col("bad"), F.concat_ws(": ", "file", "value"))
    return _parsed(lines, own).select(*(F.col(f"r.`{f.name}`") for f in own.fields), "run_id", fault.alias("fault"))


_LISTING = "directory struct<item: array<struct<name: string, type: string, size: string>>>"


def package_files(answers: DataFrame, column: str = "value") -> DataFrame:
    """The columns of package listings (JSON) with (name, type, size) of each file: no type is empty, no size is 0. Listings without files give no row."""
    listed = answers.withColumn("_f", F.explode(F.from_json(column, _LISTING)["directory"]["item"]))
    size = F.coalesce(F.nullif(F.col("_f.size"), F.lit("")).cast("long"), F.lit(0).cast("long"))
    return listed.select(*(c for c in answers.columns if c != column), F.col("_f.name").alias("name"), F.coalesce("_f.type", F.lit("")).alias("type"), size.alias("size"))


def _canonical(ascii_only: bool):
    def work(values: pd.Series) -> pd.Series:
        return values.map(lambda v: json.dumps(json.loads(v), ensure_ascii=ascii_only, separators=(",", ":"), sort_keys=True))

    return F.pandas_udf(work, "string")


def input_manifest(spark: SparkSession, root: str) -> DataFrame:
    """One row (input_manifest_sha256, inputs): the hash of every JSON file under a folder in canonical form, by path, and one hash over this list.

    The list is one row, as the manifest is one document; the files are read and hashed where they lie.
    """
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json")
    base = F.regexp_replace(F.lit(root.rstrip("/")), r"^file:/+|^/+", "/")
    at = F.regexp_replace(F.col("_metadata.file_path"), r"^file:/+", "/")
    hashed = files.select(F.url_decode(F.substr(at, F.length(base) + 2)).alias("path"), F.sha2(_canonical(False)(F.regexp_replace("value", "^\ufeff", "")), 256).alias("sha256"))
    listed = hashed.agg(F.array_sort(F.collect_list(F.struct("path", "sha256"))).alias("inputs"))
    return listed.select(F.sha2(_canonical(True)(F.to_json("inputs")), 256).alias("input_manifest_sha256"), "inputs")


def run_manifest(spark: SparkSession, task_set: str | None = None, seeds: dict | None = None, budget_caps: dict | None = None, packages: tuple[str, ...] = ("pyspark", "pandas", "pyarrow", "numpy"), repository: str = ".") -> dict:
    """What a run needs to be run again: commit and changed files, versions, the task set's hash, seeds, caps, command line. Holds no secrets; what is unknown is null."""

    def git(*words: str) -> str:
        try:
            return subprocess.run(["git", "-C", repository, *words], capture_output=True, text=True, timeout=20, check=False).stdout
        except OSError:
            return ""

    def version(name: str) -> str | None:
        try:
            return metadata.version(name)
        except metadata.PackageNotFoundError:
            return None

    status = [s for s in git("status", "--porcelain").splitlines() if s.strip()]
    changed = [s[3:] for s in status if not s.startswith("??")]
    tasks = None
    if task_set is not None:
        row = spark.read.format("binaryFile").load(task_set).select(F.sha2("content", 256).alias("sha256")).first()
        tasks = {"path": task_set, "sha256": row.sha256}
    return {
        "schema": "repro-manifest/1", "created_at": datetime.now(timezone.utc).isoformat(timespec="seconds"),
        "git": {"commit": git("rev-parse", "HEAD").strip() or None, "dirty": bool(changed), "dirty_files": changed, "untracked": [s[3:] for s in status if s.startswith("??")]},
        "seeds": seeds if seeds is not None else {"PYTHONHASHSEED": os.environ.get("PYTHONHASHSEED")}, "task_set": tasks,
        "packages": {"python": platform.python_version(), **{p: version(p) for p in packages}, "spark": spark.version}, "os": {"platform": platform.platform(), "machine": platform.machine()},
        "budget_caps": budget_caps, "argv": list(sys.argv),
    }
