"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z, and the same in lower case. Other letters keep their case.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the session's own setting.

    Only a local session (tests) may leave ``spark.checkpoint.dir`` unset; a
    folder under its warehouse is used then.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        configured = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
    return configured.rstrip("/")


def scratch_table(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` once under the shared checkpoint folder and reads it back.

    What is written survives lost executors, and the plan above it starts at
    the files.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def drop_scratch(table: DataFrame) -> None:
    """Deletes the files of a ``scratch_table`` that nothing reads any more."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table.scratch_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def numbered(docs: DataFrame) -> DataFrame:
    """The columns as c0, c1, ..., so that no name clashes with one of an operator, and ``rid``, which tells rows apart."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]).withColumn("rid", F.monotonically_increasing_id())


def renamed(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows of ``numbered`` columns with the columns of ``docs`` again."""
    return rows.select(*[f"c{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)


def slices(batch: pa.RecordBatch, text: str, chars: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(first row, slice) with about ``chars`` characters of a column each; one row at least."""
    lens = np.cumsum(np.array(pc.coalesce(pc.utf8_length(batch.column(text)), 0), np.int64))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(lens, (lens[at - 1] if at else 0) + chars)))
        yield at, batch.slice(at, end - at)
        at = end


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def with_words(df: DataFrame, text_col: str, out: str, separator_class: str) -> DataFrame:
    """Adds the array of the maximal runs of characters outside a regex class.

    ``text_col`` must not be null. No words: an empty array.
    """
    df = df.withColumn("__split", F.split(text_col, f"[{separator_class}]+"))
    # only the first and the last part can be empty
    ends = (F.element_at("__split", 1) == "") | (F.element_at("__split", -1) == "")
    return df.withColumn(out, F.when(ends, F.filter("__split", lambda w: w != "")).otherwise(F.col("__split"))).drop("__split")


def with_window_hashes(df: DataFrame, hashes: str, out: str, n: int) -> DataFrame:
    """Adds one 64-bit hash for each run of ``n`` consecutive values of an array.

    ``hashes`` is an array of longs; with fewer than ``n`` values the result is
    an empty array. Runs double in length step by step, so that each step
    handles an element once, whatever ``n`` is.
    """

    def joined(a: str, b: str, shift: int, name: str) -> None:
        nonlocal df
        m = F.greatest(F.least(F.size(a), F.size(b) - shift), F.lit(0))
        df = df.withColumn(name, F.zip_with(F.slice(a, 1, m), F.slice(b, shift + 1, m), lambda x, y: F.xxhash64(x, y)))

    powers, k = {1: hashes}, 1
    while 2 * k <= n:
        joined(powers[k], powers[k], k, f"__run{2 * k}")
        k *= 2
        powers[k] = f"__run{k}"
    have, name = k, powers[k]
    while have < n:
        k = max(p for p in powers if p <= n - have)
        joined(name, powers[k], have, f"__run{have + k}")
        have, name = have + k, f"__run{have + k}"
    made = [c for c in df.columns if c.startswith("__run")]
    return df.withColumn(out, F.col(name)).drop(*made)


def run_hash(hashes: Column, n: int) -> Column:
    """The hash that ``with_window_hashes`` has for the first ``n`` values, as one expression."""

    def power(at: int, k: int) -> Column:
        return F.get(hashes, at) if k == 1 else F.xxhash64(power(at, k // 2), power(at + k // 2, k // 2))

    have = 1 << (n.bit_length() - 1)
    out = power(0, have)
    while have < n:
        k = 1 << ((n - have).bit_length() - 1)
        out, have = F.xxhash64(out, power(have, k)), have + k
    return out
