"""Call tables made from the given tables, for Spark and, with the same meaning, as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sentences put before a document's text; the first SCAMS of them are scams.
TEMPLATES = (
    "Please share the OTP that just came to your phone.",
    "There is an arrest warrant in your name and you are under digital arrest now.",
    "Kindly install AnyDesk so that I see your screen.",
    "To get the refund scan this QR code and enter your UPI PIN to receive it.",
    "Do not tell anyone in your family about this matter.",
    "You must decide within 10 minutes, this is the last warning.",
    "You won the lucky draw of 25 lakh and the winner pays a processing fee for the prize.",
    "Your KYC has expired and the account will be blocked today by RBI. Share your card number.",
    "Move the money to a safe account for RBI verification, what is your CVV, stay on the video call.",
    "We will send your edited photos to all contacts in your contact list gallery.",
    "I am posted with the army and pay by QR. Scan my QR code, collect request comes in the next five minutes.",
    "Guaranteed monthly profit, double your money with 20% return every month.",
    "You do not need to share your OTP with anybody.",
    "I will share a pin location for the parcel.",
    "The bank never asks you to read out the code, have a good day.",
    "Shall we meet for lunch tomorrow at the station?",
)
SCAMS = 12
K = len(TEMPLATES)
SPOKEN, BLANK = 53, 17


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """A table that is read in fewer tasks than there are cores, or mostly by a few of them, dealt out anew; others stay as they are.

    Files are split by their bytes, but a row group is read by one task. Its rows are counted without reading a column.
    """
    cores, tasks = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    if tasks >= cores:
        rows = df.groupBy(F.spark_partition_id().alias("task")).count().agg(F.max("count").alias("most"), F.sum("count").alias("all")).first()
        if (rows["most"] or 0) * cores <= 2 * (rows["all"] or 0):
            return df
    return df.repartition(max(cores, tasks), key)


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(call_id, text, label, scam_type, source, lang, text_score, audio_score)."""
    k = F.col("doc_id") % K
    sentence = F.get(F.array(*map(F.lit, TEMPLATES)), k.cast("int"))
    label = F.when(k < SCAMS, 1).otherwise(0)
    return spread(table(spark, sf_dir, "documents"), "doc_id").select(
        F.col("doc_id").alias("call_id"),
        F.concat(F.lit("Caller: "), sentence, F.lit(" "), F.coalesce("text", F.lit(""))).alias("text"),
        label.alias("label"),
        F.when(label == 1, F.when(k % 2 == 0, "bank_fraud").otherwise("refund_scam")).otherwise("none").alias("scam_type"),
        "source",
        "lang",
        F.when(F.col("doc_id") % 7 != 0, (F.col("doc_id") * 37 % 101) / 100.0).alias("text_score"),
        F.when(F.col("doc_id") % 3 != 0, (F.col("doc_id") * 53 % 101) / 100.0).alias("audio_score"),
    )


def as_chunks(events: DataFrame) -> DataFrame:
    """(session_id, seq, ts, chunk, risk_score) of events, batch or stream; one chunk in SPOKEN says a sentence, one in BLANK is blank."""
    e = F.col("event_id")
    sentence = F.get(F.array(*map(F.lit, TEMPLATES)), F.floor(e / SPOKEN).cast("int") % K)
    plain = F.concat(F.col("event_type"), F.lit(" number "), e.cast("string"), F.when(e % SPOKEN == 0, F.concat(F.lit(" "), sentence)).otherwise(""), F.lit(" "))
    chunk = F.when(e % BLANK == 0, "  ").otherwise(plain)
    return events.select(F.col("user_id").alias("session_id"), e.alias("seq"), "ts", chunk.alias("chunk"), ((e * 37 % 101) / 100.0).alias("risk_score"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_chunks(table(spark, sf_dir, "events"))


_VALUES = ", ".join("({}, '{}')".format(i, t.replace("'", "''")) for i, t in enumerate(TEMPLATES))
CALLS_SQL = f"""
templates(k, t) AS (VALUES {_VALUES}),
calls AS (
  SELECT doc_id AS call_id, 'Caller: ' || t || ' ' || coalesce(text, '') AS text,
    CASE WHEN k < {SCAMS} THEN 1 ELSE 0 END AS label,
    CASE WHEN k >= {SCAMS} THEN 'none' WHEN k % 2 = 0 THEN 'bank_fraud' ELSE 'refund_scam' END AS scam_type, source, lang,
    CASE WHEN doc_id % 7 <> 0 THEN (doc_id * 37 % 101) / 100.0::DOUBLE END AS text_score,
    CASE WHEN doc_id % 3 <> 0 THEN (doc_id * 53 % 101) / 100.0::DOUBLE END AS audio_score
  FROM documents JOIN templates ON doc_id % {K} = k)
"""
CHUNKS_SQL = f"""
sentences(k, t) AS (VALUES {_VALUES}),
chunks AS (
  SELECT user_id AS session_id, event_id AS seq, ts,
    CASE WHEN event_id % {BLANK} = 0 THEN '  ' ELSE event_type || ' number ' || event_id || CASE WHEN event_id % {SPOKEN} = 0 THEN ' ' || t ELSE '' END || ' ' END AS chunk,
    (event_id * 37 % 101) / 100.0::DOUBLE AS risk_score FROM events JOIN sentences ON (event_id // {SPOKEN}) % {K} = k)
"""
#: The rolling text at each chunk, as the state has it.
TEXTS_SQL = f"""{CHUNKS_SQL},
said AS (SELECT session_id, seq, nullif(rtrim(chunk), '') AS s, count(nullif(rtrim(chunk), '')) OVER (PARTITION BY session_id ORDER BY seq) AS n FROM chunks),
texts AS (SELECT session_id, seq, right(coalesce(string_agg(s, ' ') OVER (PARTITION BY session_id ORDER BY n RANGE BETWEEN 1500 PRECEDING AND CURRENT ROW), ''), 3000) AS transcript FROM said)
"""
