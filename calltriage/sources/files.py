"""Readers and writers of call corpora and of voice data sets' lists."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CALLS = "id string, source string, text string, label int, scam_type string, origin string"
# Folder names of genuine and of made voices.
REAL_FOLDERS = ("real", "bona-fide", "bonafide", "bona_fide", "genuine")
FAKE_FOLDERS = ("fake", "spoof", "spoofed", "deepfake")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share; a local session may do without one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def drop(spark: SparkSession, path: str) -> None:
    """Deletes files that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def read_calls(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with the common schema; broken lines raise."""
    return spark.read.schema(CALLS).option("mode", "FAILFAST").json(path)


def read_eval_calls(spark: SparkSession, path: str) -> DataFrame:
    """Calls for evaluation: a missing type is ``unknown``, the text is the transcript."""
    return read_calls(spark, path).select("id", "label", F.coalesce("scam_type", F.lit("unknown")).alias("scam_type"), F.col("text").alias("transcript"))


def write_calls(calls: DataFrame, path: str, *partitions: str) -> None:
    calls.write.partitionBy(*partitions).json(path)


def write_report(tables: dict[str, DataFrame], path: str) -> None:
    """Each table of a report to a folder of its own."""
    for name, df in tables.items():
        df.write.json(f"{path}/{name}")


def write_document(document: DataFrame, path: str) -> None:
    """A few rows as one JSON file."""
    document.coalesce(1).write.json(path)


def read_baseline(spark: SparkSession, path: str, block: str, fields: dict[str, str]) -> DataFrame:
    """One row with the fields (name: type) of a block of a JSON document; nulls if file, block or field is missing."""
    schema = T.StructType([T.StructField(block, T.StructType.fromDDL(", ".join(f"`{k}` {v}" for k, v in fields.items())))])
    try:
        found = spark.read.schema(schema).option("multiLine", True).json(path).limit(1)
        found.isEmpty()
    except AnalysisException:
        found = spark.createDataFrame([], schema)
    return found.agg(*[F.first(f"{block}.{k}").alias(k) for k in fields])


def append_metrics(metrics: DataFrame, run: str, path: str) -> None:
    """(run, split, metric, value) rows, added to those of other runs; a repeated run replaces its own."""
    rows = metrics.select(F.lit(run).alias("run"), "split", "metric", "value")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path)


def read_spoof_protocol(spark: SparkSession, path: str, audio_dir: str) -> DataFrame:
    """(path, label, utt_id) of white-space separated lines with five fields or more."""
    f = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(f.alias("f")).filter(F.size("f") >= 5).select(F.get("f", F.lit(1)).alias("utt_id"), F.lower(F.element_at("f", -1)).alias("key"))
    kept = rows.filter(F.col("key").isin("bonafide", "spoof"))
    return kept.select(F.concat(F.lit(f"{audio_dir}/"), "utt_id", F.lit(".flac")).alias("path"), F.when(F.col("key") == "spoof", 1).otherwise(0).alias("label"), "utt_id")


def read_voice_meta(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """(path, label) of a CSV list; the separator is taken from its first line if not given."""
    if separator is None:
        head = spark.read.text(path).first()
        separator = max(",;\t", key=(head[0] if head else "").count)
    raw = spark.read.option("header", True).option("sep", separator).csv(path)
    rows = raw.toDF(*[c.strip().lower() for c in raw.columns])
    label, file = F.lower(F.trim("label")), F.trim("file")
    return rows.filter(label.isin("bona-fide", "spoof")).select(F.when(~file.rlike(r"\.[^.]+$"), F.concat(file, F.lit(".wav"))).otherwise(file).alias("path"), F.when(label == "spoof", 1).otherwise(0).alias("label"))


def folder_of(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/[^/]*$", 1)


def label_from_folder(path: Column) -> Column:
    """0 for a genuine voice's folder, 1 for a made one's, else null."""
    name = F.lower(folder_of(path))
    return F.when(name.isin(*REAL_FOLDERS), 0).when(name.isin(*FAKE_FOLDERS), 1)


def list_files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """(path) of all files below a folder whose name fits; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path")


def densest_folder(files: DataFrame) -> DataFrame:
    """The folder with most files whose stem is a number (one row)."""
    rows = files.select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder"), F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?$", 1).alias("stem"))
    return rows.filter(F.col("stem").rlike(r"^\d+$")).groupBy("folder").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "folder").limit(1)


def marked_folders(spark: SparkSession, root: str, marker: str) -> DataFrame:
    """(folder) of all folders below ``root`` that hold a file whose name fits the marker; raises if there is none."""
    folders = list_files(spark, root, marker).select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder")).distinct()
    if folders.isEmpty():
        raise FileNotFoundError(f"no file like {marker} below {root}")
    return folders


def existing(items: DataFrame, files: DataFrame) -> tuple[DataFrame, int]:
    """(the items whose file exists, how many were dropped); raises if none is left."""
    there = files.select("path").distinct()
    dropped, kept = items.join(there, "path", "left_anti").count(), items.join(there, "path", "left_semi")
    if kept.isEmpty():
        raise FileNotFoundError("none of the items' files exists")
    return kept, dropped
