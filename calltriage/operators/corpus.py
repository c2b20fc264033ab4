"""Corpus building: adapters, pooling, dedup, split, statistics and checks."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bloom
from .normalize import normalize_speakers, unify_type, word_count

FIELDS = ("id", "source", "text", "label", "scam_type", "origin")
RATIOS = (0.8, 0.1)


@dataclass(frozen=True)
class Source:
    """How a source names its columns. ``tag`` is None where it has no types."""

    slug: str
    text: str = "dialogue"
    label: str = "label"
    tag: str | None = "type"
    origin: str = "synthetic"


# The sources' column names and origins.
SOURCES = (
    Source("dialogues"),
    Source("multi-agent", label="labels"),
    Source("single-agent", label="labels"),
    Source("conversations", text="conversation", tag=None),
    Source("real-calls", label="labels", origin="real"),
)


def adapt(df: DataFrame, source: Source, split: str | Column, index: Column) -> DataFrame:
    """A source's rows in the common schema; ids are slug-split-index. Columns that the source doesn't name are left out."""
    lab = F.col(source.label).cast("int")
    kind = unify_type(F.col(source.tag) if source.tag else F.lit(None).cast("string"), lab)
    split = F.lit(split) if isinstance(split, str) else split
    return df.select(
        F.concat_ws("-", F.lit(source.slug), split, index.cast("string")).alias("id"), F.lit(source.slug).alias("source"), normalize_speakers(F.col(source.text)).alias("text"), lab.alias("label"), kind.alias("scam_type"), F.lit(source.origin).alias("origin")
    )


def pool(sources: list[DataFrame]) -> DataFrame:
    """All sources in order; ``source_rank`` is the place in the list."""
    return reduce(lambda a, b: a.unionByName(b), [s.withColumn("source_rank", F.lit(i)) for i, s in enumerate(sources)])


def dedup_keep_first(df: DataFrame, text: str, *order: str) -> DataFrame:
    """One row for each text: the first by ``order``. Partial aggregation, no window."""
    row = F.struct(*df.columns)
    return df.groupBy(F.sha2(F.col(text), 256).alias("__k")).agg(F.min_by(row, F.struct(*order)).alias("r")).select("r.*")


def stratified_split(df: DataFrame, strata: list[str], id_col: str, seed: int = 42) -> DataFrame:
    """Adds ``split``: in each stratum, 80 % / 10 % / 10 % by the hash of the id (sizes rounded half to even).

    Exact sizes need the ids at two ranks of each stratum. A stratum is counted
    by the first digits of the hash, and only the rows of the two buckets that
    hold these ranks are ranked; texts aren't moved. ``hash_split`` does without
    ranks.
    """
    digest = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"|{seed}")))
    keys = df.select(*[F.col(c).alias(f"s{i}") for i, c in enumerate(strata)], F.struct(digest.alias("h"), F.col(id_col).alias("id")).alias("k")).withColumn("b", F.substring("k.h", 1, 3))
    s = [f"s{i}" for i in range(len(strata))]
    # 4096 buckets for each stratum at most
    sizes = keys.groupBy(*s, "b").agg(F.count("*").alias("c"))
    run = Window.partitionBy(*s).orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    sizes = sizes.withColumns({"upto": F.sum("c").over(run), "n": F.sum("c").over(Window.partitionBy(*s))})
    first = F.bround(F.col("n") * RATIOS[0])
    cuts = F.array(first, first + F.bround(F.col("n") * RATIOS[1]))
    wanted = sizes.select(*[F.col(c).alias(f"of_{c}") for c in (*s, "b")], F.posexplode(cuts).alias("which", "at"), (F.col("upto") - F.col("c")).alias("before"), "upto").filter("at > before and at <= upto")
    ranked = keys.join(wanted, reduce(and_, [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in (*s, "b")]))
    ranked = ranked.withColumn("r", F.row_number().over(Window.partitionBy(*s, "which").orderBy("k"))).filter("r = at - before")
    limits = ranked.groupBy(*s).agg(F.max(F.when(F.col("which") == 0, F.col("k"))).alias("train_upto"), F.max(F.when(F.col("which") == 1, F.col("k"))).alias("val_upto"))
    d = df.withColumn("__k", F.struct(digest.alias("h"), F.col(id_col).alias("id")))
    on = reduce(and_, [F.col(c).eqNullSafe(F.col(f"__{x}")) for c, x in zip(strata, s, strict=True)])
    limits = limits.select(*[F.col(c).alias(f"__{c}") for c in s], "train_upto", "val_upto")
    d = d.join(limits, on, "left")  # one row for each stratum
    split = F.when(F.col("__k") <= F.col("train_upto"), "train").when(F.col("__k") <= F.col("val_upto"), "val").otherwise("test")
    return d.select(*df.columns, split.alias("split"))


def hash_split(df: DataFrame, id_col: str, seed: int = 42) -> DataFrame:
    """Adds ``split`` by thresholds on a hash: no shuffle, sizes right on average."""
    u = pick(F.lit(1000), F.col(id_col).cast("string"), F.lit(str(seed)))
    return df.withColumn("split", F.when(u < 1000 * RATIOS[0], "train").when(u < 1000 * (RATIOS[0] + RATIOS[1]), "val").otherwise("test"))


def shuffled(df: DataFrame, split: str, id_col: str, seed: int = 42) -> DataFrame:
    """Rows in the order of split and a seeded hash of the id, which is added as ``place``."""
    return df.withColumn("place", F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"|{seed}")))).orderBy(split, "place", id_col)


def counts(df: DataFrame) -> DataFrame:
    """(split, facet, value, n): rows, labels, sources and types per split, in one pass."""
    sets = df.groupingSets([["split"], ["split", "label"], ["split", "source"], ["split", "scam_type"]], "split", "label", "source", "scam_type").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    facet = F.when(F.col("g") == 7, "rows").when(F.col("g") == 3, "label").when(F.col("g") == 5, "source").otherwise("scam_type")
    value = F.when(F.col("g") == 3, F.col("label").cast("string")).when(F.col("g") == 5, F.col("source")).when(F.col("g") == 6, F.col("scam_type"))
    return sets.select("split", facet.alias("facet"), value.alias("value"), "n")


def length_stats(df: DataFrame, text: str = "text", by: str = "split") -> DataFrame:
    w = word_count(F.col(text))
    return df.groupBy(by).agg(F.bround(F.avg(w), 2).alias("mean_words"), F.median(w).alias("median_words"))


def violations(df: DataFrame, text: str = "text") -> DataFrame:
    """(rule, n): rows that break a rule of the common schema, in one pass."""
    bad = {
        "missing_field": reduce(lambda a, b: a | b, [F.col(c).isNull() for c in FIELDS]),
        "label_range": ~F.coalesce(F.col("label").isin(0, 1), F.lit(False)),
        "blank_text": F.coalesce(F.trim(F.col(text)) == "", F.lit(True)),
    }
    one = df.agg(*[F.sum(F.when(c, 1).otherwise(0)).alias(k) for k, c in bad.items()])
    return one.select(F.explode(F.create_map(*[x for k in bad for x in (F.lit(k), F.coalesce(F.col(k), F.lit(0)))])).alias("rule", "n"))


def statistics(splits: DataFrame, pooled: DataFrame, text: str, seed: int = 42) -> DataFrame:
    """(split, facet, value, n) of a corpus: counts, words, and (split ``_meta``) what dedup dropped, seed and ratios.

    ``pooled`` are the rows before dedup, ``splits`` those after it.
    """
    words = length_stats(splits, text).select("split", F.lit("words").alias("facet"), F.explode(F.create_map(F.lit("mean"), F.col("mean_words"), F.lit("median"), F.col("median_words"))).alias("value", "n"))
    sizes = pooled.select(F.lit(1).alias("p"), F.lit(0).alias("k")).unionByName(splits.select(F.lit(0).alias("p"), F.lit(1).alias("k"))).agg(F.sum("p").alias("p"), F.sum("k").alias("k"))
    meta = {"pooled": F.col("p"), "dropped": F.col("p") - F.col("k"), "seed": F.lit(seed), "train": F.lit(RATIOS[0]), "val": F.lit(RATIOS[1])}
    made = sizes.select(F.lit("_meta").alias("split"), F.lit("corpus").alias("facet"), F.explode(F.create_map(*[x for k, v in meta.items() for x in (F.lit(k), v.cast("double"))])).alias("value", "n"))
    return counts(splits).withColumn("n", F.col("n").cast("double")).unionByName(words).unionByName(made)


#: The share of texts that aren't held out and are yet looked at exactly.
LEAK_ERROR = 0.01


def leak_candidates(splits: DataFrame, held_out: DataFrame, text: str = "text", error: float = LEAK_ERROR) -> DataFrame:
    """The rows that may have a held-out text: all that have, and about ``error`` of the others. No row moves."""
    longs = bloom.size(held_out.count(), error)
    return bloom.may_hold(splits, F.col(text), bloom.build(held_out, F.col(text), longs), longs)


def leaks(splits: DataFrame, held_out: DataFrame, source: str = "source", text: str = "text") -> DataFrame:
    """(rule, n): rows to learn from that come from a held-out source, and those with the text of a held-out row.

    Only candidates are compared exactly, so what is shuffled is their digests and those of the held-out texts.
    """
    names = held_out.select(source).distinct()
    texts = held_out.select(F.sha2(text, 256).alias("__k")).distinct()
    by_source = splits.join(names, source, "left_semi").agg(F.lit("source").alias("rule"), F.count("*").alias("n"))
    found = leak_candidates(splits, held_out, text).select(F.sha2(text, 256).alias("__k"))
    by_text = found.join(texts, "__k", "left_semi").agg(F.lit("text").alias("rule"), F.count("*").alias("n"))
    return by_source.unionByName(by_text)


def scenario_violations(rows: DataFrame, id_col: str, family: str, label: str) -> DataFrame:
    """(rule, n): repeated ids, families with both labels, and how many more rows one label has than the other."""
    ids = rows.groupBy(id_col).agg(F.count("*").alias("c")).agg(F.lit("repeated_id").alias("rule"), F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("n"))
    mixed = rows.groupBy(family).agg((F.min(label) != F.max(label)).alias("m")).agg(F.lit("mixed_label").alias("rule"), F.count_if("m").alias("n"))
    uneven = rows.agg(F.lit("uneven").alias("rule"), F.abs(F.count_if(F.col(label) == 1) - F.count_if(F.col(label) == 0)).alias("n"))
    return ids.unionByName(mixed).unionByName(uneven)


def require(violations: DataFrame, *rules: str) -> DataFrame:
    """The (rule, n) rows, if none of the rules named (all, if none is) is broken; otherwise raises."""
    bad = violations.filter(F.col("n") > 0).filter(F.col("rule").isin(*rules) if rules else F.lit(True)).collect()  # a few rules
    if bad:
        raise ValueError("; ".join(f"{r['rule']}: {r['n']} rows" for r in bad))
    return violations


def first_strategy(rows: DataFrame, priority: str) -> DataFrame:
    """The rows of the first strategy that found any."""
    least = rows.agg(F.min(priority).alias("__least"))  # one row
    return rows.join(F.broadcast(least), F.col(priority) == F.col("__least")).drop("__least")


def pick(n: Column, *keys: Column) -> Column:
    """A number below n that follows from the keys (by md5, as other engines have it)."""
    return (F.conv(F.substring(F.md5(F.concat_ws("|", *keys)), 1, 8), 16, 10).cast("long") % n).cast("int")


def expand_templates(attempts: DataFrame, families: list[tuple[str, list[tuple[str, list[str]]]]], pools: dict[str, list[str]], keep: int, seed: int = 13) -> DataFrame:
    """(scenario, attempt, text): transcripts made of templates.

    ``attempts`` has (scenario, attempt). A family's turns are (speaker,
    phrasings); an attempt picks one phrasing a turn and one value for each
    ``{slot}``. Of equal texts of a scenario the first attempt stays, and
    ``keep`` texts for each scenario.
    """
    key = lambda what: (F.col("scenario"), F.col("attempt").cast("string"), what, F.lit(str(seed)))
    known = attempts.sparkSession.createDataFrame(families, "scenario string, turns array<struct<who:string,said:array<string>>>")
    turn = lambda t, i: F.concat(t["who"], F.lit(": "), F.get(t["said"], pick(F.size(t["said"]), *key(F.concat(F.lit("turn"), i.cast("string"))))))
    rows = attempts.join(F.broadcast(known), "scenario").withColumn("text", F.array_join(F.transform("turns", turn), " "))  # the families given
    for slot, values in pools.items():
        value = F.get(F.array(*map(F.lit, values)), pick(F.lit(len(values)), *key(F.lit(slot))))
        rows = rows.withColumn("text", F.replace(F.col("text"), F.lit("{" + slot + "}"), value))
    made = rows.groupBy("scenario", "text").agg(F.min("attempt").alias("attempt"))
    w = Window.partitionBy("scenario").orderBy("attempt")  # the distinct texts of a family, which its templates bound
    return made.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= keep).select("scenario", "attempt", "text")
