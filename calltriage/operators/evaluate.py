"""Evaluation of detectors: confusion, rates, ROC, EER, latency and class metrics."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import scratch_path

CONFIGS = ("text_only", "signatures_only", "fusion_notlow", "fusion_high")


def predictions(text_score: Column, max_severity: Column, level: Column) -> dict[str, Column]:
    return {
        "text_only": F.coalesce(text_score >= 0.5, F.lit(False)),
        "signatures_only": F.coalesce(max_severity, F.lit(0)) >= 2,
        "fusion_notlow": level != "low",
        "fusion_high": level == "high",
    }


def unpivot(calls: DataFrame, *keep: str) -> DataFrame:
    """One row per call and configuration: (config, predicted)."""
    return calls.unpivot(list(keep), list(CONFIGS), "config", "predicted")


def confusion(rows: DataFrame, *by: str) -> DataFrame:
    """tp, fn, fp, tn and the rates (null without scams, or without benign calls)."""
    p, y = F.col("predicted"), F.col("label") == 1
    c = rows.groupBy(*by).agg(F.count_if(p & y).alias("tp"), F.count_if(~p & y).alias("fn"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & ~y).alias("tn"))
    return c.withColumns({"tpr": F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), "fpr": F.try_divide(F.col("fp"), F.col("fp") + F.col("tn"))})


def class_metrics(rows: DataFrame, *by: str) -> DataFrame:
    """n, accuracy, precision, recall and F1; a rate over nothing is 0."""
    z = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fn, fp, tn = map(F.col, ("tp", "fn", "fp", "tn"))
    c = confusion(rows, *by).withColumns({"precision": z(tp, tp + fp), "recall": z(tp, tp + fn)})
    p, r = F.col("precision"), F.col("recall")
    return c.select(*by, (tp + fn + fp + tn).alias("n"), z(tp + tn, tp + fn + fp + tn).alias("accuracy"), p, r, z(2 * p * r, p + r).alias("f1"))


def running_sums(rows: DataFrame, order: Column, values: dict[str, str], *by: str) -> DataFrame:
    """Adds running sums along ``order`` and totals, both of ``by``'s groups: {column: name} gives name and name_all.

    Rows are dealt out by ranges of the order and summed range by range; then
    each range starts from the sum of those before it. No task has all rows of
    a group. Rows of equal order must not matter to each other.
    """
    path = scratch_path(rows.sparkSession, "ranges")
    # written out, as another run of the same plan may cut the ranges elsewhere
    ranged = rows.repartitionByRange(rows.sparkSession.sparkContext.defaultParallelism, *by, order).withColumn("__part", F.spark_partition_id())
    ranged.write.parquet(path)
    ranged = rows.sparkSession.read.schema(ranged.schema).parquet(path)
    inside = Window.partitionBy(*by, "__part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    d = ranged.withColumns({name: F.sum(c).over(inside) for c, name in values.items()})
    # one row for each range and group
    totals = ranged.groupBy(*by, "__part").agg(*[F.sum(c).alias(name) for c, name in values.items()])
    group = Window.partitionBy(*by)
    before = group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*[F.col(c).alias(f"by_{c}") for c in (*by, "__part")], *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"{n}_before") for n in values.values()], *[F.sum(n).over(group).alias(f"{n}_all") for n in values.values()])
    on = reduce(and_, [F.col(c).eqNullSafe(F.col(f"by_{c}")) for c in (*by, "__part")])
    d = d.join(totals, on)
    return d.select(*rows.columns, *[(F.col(n) + F.col(f"{n}_before")).alias(n) for n in values.values()], *[f"{n}_all" for n in values.values()])


def roc_curve(scored: DataFrame, *by: str) -> DataFrame:
    """(score, fpr, tpr) from (inf, 0, 0) on, then at each distinct score, highest first, counting that score as positive.

    Rows are first counted by score; the running sums go over distinct scores,
    in ranges.
    """
    return _points(scored, *by).select(*by, "score", "fpr", "tpr").unionByName(_origin(scored, *by))


def _points(scored: DataFrame, *by: str) -> DataFrame:
    c = scored.groupBy(*by, "score").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n"))
    c = running_sums(c, F.desc("score"), {"p": "cp", "n": "cn"}, *by)
    rate = lambda x, y: F.try_divide(F.col(x), F.col(y))
    before = [rate("before_n", "cn_all").alias("fpr_before"), rate("before_p", "cp_all").alias("tpr_before")]
    c = c.withColumns({"before_p": F.col("cp") - F.col("p"), "before_n": F.col("cn") - F.col("n")})
    return c.select(*by, "score", rate("cn", "cn_all").alias("fpr"), rate("cp", "cp_all").alias("tpr"), *before)


def roc_auc(scored: DataFrame, *by: str) -> DataFrame:
    """Area under the curve by trapezoids; null if a class is missing."""
    area = F.sum((F.col("fpr") - F.col("fpr_before")) * (F.col("tpr") + F.col("tpr_before")) / 2)
    return _points(scored, *by).groupBy(*by).agg(area.alias("auc"))


def eer(scored: DataFrame, *by: str) -> DataFrame:
    """Equal error rate: the first point where the two rates differ least."""
    gap = F.abs(1 - F.col("tpr") - F.col("fpr"))
    best = roc_curve(scored, *by).groupBy(*by).agg(F.min_by(F.struct("fpr", "tpr"), F.struct(F.round(gap, 12), -F.col("score"))).alias("b"))
    return best.select(*by, ((F.col("b.fpr") + 1 - F.col("b.tpr")) / 2).alias("eer"))


def _origin(scored: DataFrame, *by: str) -> DataFrame:
    return scored.groupBy(*by).agg(F.lit(float("inf")).alias("score"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))


def latency_stats(runs: DataFrame, ms: str) -> DataFrame:
    """n, median, p95 (the sorted value at floor(.95 n)), min, max, mean.

    Counted by value first; the running count goes over distinct values, in ranges.
    """
    c = running_sums(runs.groupBy(F.col(ms).alias("ms")).agg(F.count("*").alias("c")), F.asc("ms"), {"c": "upto"})
    n = F.col("upto_all")
    at = F.least(n - 1, F.floor(n * 0.95))
    p95 = F.min(F.when(F.col("upto") > at, F.col("ms")))
    lo, hi = F.floor((n - 1) / 2), F.floor(n / 2)
    median = (F.min(F.when(F.col("upto") > lo, F.col("ms"))) + F.min(F.when(F.col("upto") > hi, F.col("ms")))) / 2
    mean = F.sum(F.col("ms") * F.col("c")) / F.max(n)
    return c.agg(F.max(n).alias("n"), F.round(median, 3).alias("median"), F.round(p95, 3).alias("p95"), F.round(F.min("ms"), 3).alias("min"), F.round(F.max("ms"), 3).alias("max"), F.round(mean, 3).alias("mean"))


def probe_figures(calls: DataFrame) -> DataFrame:
    """n, n_flagged and recall of calls with a score ``prob``; recall is null if there are none."""
    flagged = F.count_if(F.col("prob") >= 0.5)
    return calls.filter(F.col("prob").isNotNull()).agg(F.count("*").alias("n"), flagged.alias("n_flagged"), F.try_divide(flagged, F.count("*")).alias("recall"))


def probe(calls: DataFrame) -> DataFrame:
    """Each call with a score ``prob``, whether it is flagged, and the figures of all."""
    each = calls.filter(F.col("prob").isNotNull()).withColumn("flagged", F.col("prob") >= 0.5)
    return each.join(F.broadcast(probe_figures(calls)), F.lit(True))  # one row


#: Size of a quantile sketch.
SKETCH = 1024


def rank_error(k: int = SKETCH) -> float:
    """How far, as a share of all rows, a sketch's quantile is from its rank: 99 in 100 are nearer (the published bound of KLL sketches)."""
    return 2.296 / k**0.9723


def sketches(rows: DataFrame, value: Column, *by: str, k: int = SKETCH) -> DataFrame:
    """(by, n, sketch): a bounded summary of the values of each group, which can be kept and merged; nothing is sorted."""
    return rows.groupBy(*by).agg(F.count(value).alias("n"), F.kll_sketch_agg_double(value.cast("double"), F.lit(k)).alias("sketch"))


def merged(kept: DataFrame, *by: str) -> DataFrame:
    """The sketches of coarser groups, from those of finer ones; their rows aren't read again."""
    return kept.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))


def sketch_quantiles(kept: DataFrame, quantiles: dict[str, float], *by: str) -> DataFrame:
    """(by, n, one column for each named quantile)."""
    return kept.select(*by, "n", *[F.kll_sketch_get_quantile_double("sketch", F.lit(float(q))).alias(name) for name, q in quantiles.items()])


def rank_gaps(rows: DataFrame, value: Column, found: DataFrame, quantiles: dict[str, float], *by: str) -> DataFrame:
    """(by, n, one column for each quantile): how far, as a share, the found values are from their ranks, counted exactly.

    ``found`` has a row a group, of few groups.
    """
    r = rows.select(*by, value.cast("double").alias("__v")).filter("__v is not null").join(F.broadcast(found.select(*by, *quantiles)), [*by])

    def gap(name: str, q: float) -> Column:
        below, upto = (F.count_if(c) / F.count("*") for c in (F.col("__v") < F.col(name), F.col("__v") <= F.col(name)))
        return F.greatest(below - q, q - upto, F.lit(0.0)).alias(name)

    return r.groupBy(*by).agg(F.count("*").alias("n"), *[gap(n, q) for n, q in quantiles.items()])
