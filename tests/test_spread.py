import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from calltriage.operators import signatures
from calltriage.plans import fixtures as fx
from calltriage.plans import registry, textscores


@pytest.fixture
def small_splits(spark):
    """Files are split into many more tasks than there are cores."""
    conf = {"spark.sql.files.maxPartitionBytes": "16k", "spark.sql.files.openCostInBytes": "1k"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k in conf:
        spark.conf.unset(k)


def documents(path, row_group: int) -> str:
    n = 4000
    t = pa.table({"doc_id": range(n), "text": [f"text {i} {i * i}" for i in range(n)], "lang": ["en"] * n, "source": ["a"] * n})
    pq.write_table(t, path / "documents.parquet", row_group_size=row_group, compression="none")
    return str(path)


def tasks(df) -> list[int]:
    return [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]


def test_one_row_group_is_dealt_out(spark, tmp_path, small_splits):
    """one task reads a row group, however many splits its file has; the others had nothing to do."""
    d = documents(tmp_path, 4000)
    t = fx.table(spark, d, "documents")
    assert t.rdd.getNumPartitions() >= 4 and tasks(t) == [4000]
    c = fx.calls(spark, d)
    assert max(tasks(c)) < 2000 and c.select("call_id").distinct().count() == c.count() == 4000


def test_many_row_groups_stay_where_they_are(spark, tmp_path, small_splits):
    t = fx.table(spark, documents(tmp_path, 200), "documents")
    assert fx.spread(t, "doc_id") is t


def test_empty_table(spark, tmp_path, small_splits):
    pq.write_table(pa.table({"doc_id": pa.array([], pa.int64()), "text": pa.array([], pa.string())}), tmp_path / "documents.parquet")
    assert fx.spread(fx.table(spark, str(tmp_path), "documents"), "doc_id").count() == 0


def test_hits_come_from_all_tasks(spark, tmp_path, small_splits):
    """the rules' work on one row group is shared, and no hit is lost."""
    found = registry.queries()["sig_hits_long"](spark, documents(tmp_path, 4000))
    n = tasks(found)
    assert len(n) >= 4 and max(n) < sum(n) / 2
    said = spark.createDataFrame(list(enumerate(fx.TEMPLATES)), "k long, t string")
    flags = said.select("k", *[signatures.flag(F.col("t"), r).alias(r.id) for r in signatures.RULES]).collect()
    want = {(f["k"], r.id) for f in flags for r in signatures.RULES if f[r.id]}
    got = [(r["call_id"] % fx.K, r["id"]) for r in found.select("call_id", "id").collect()]
    assert set(got) == want and len(got) == 4000 // fx.K * len(want)


def test_turns_of_one_row_group_are_dealt_out(spark, tmp_path, small_splits):
    """no worker has the terms of all turns."""
    n = 4000
    t = pa.table({"conv_id": [i // 4 for i in range(n)], "turn": [i % 4 for i in range(n)], "role": ["user"] * n, "text": [f"turn {i} says {i * i}" for i in range(n)]})
    pq.write_table(t, tmp_path / "conversations.parquet", row_group_size=n, compression="none")
    d = textscores.turns(spark, str(tmp_path))
    assert max(tasks(d)) < n / 2 and d.select("id").distinct().count() == d.count() == n
