"""Exact binary metrics by group, ties and empty denominators settled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitemill.functions.shared import shared_table


def _share(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def _counts(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    return scores.groupBy(*by).agg(*_hits())


def _hits() -> list[Column]:
    hit = lambda label, pred: F.count_if((F.col("label") == label) & (F.col("pred") == pred))
    return [hit(1, 1).alias("tp"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"), hit(0, 0).alias("tn")]


def _f1(tp: Column, fp: Column, fn: Column) -> Column:
    return _share(2.0 * tp, 2 * tp + fp + fn)


def binary_metrics(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """accuracy, precision, recall, f1 and mcc of each group (label, pred); a zero denominator gives 0."""
    return _metrics(_counts(scores, by), by)


def _metrics(counts: DataFrame, by: Sequence[str], *more: str) -> DataFrame:
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    mcc = _share(tp * tn - fp * fn, F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn))
    return counts.select(
        *by, _share(tp + tn, tp + fp + fn + tn).alias("accuracy"), _share(tp, tp + fp).alias("precision"), _share(tp, tp + fn).alias("recall"), _f1(tp, fp, fn).alias("f1"), mcc.alias("mcc"), *more
    )


def classification_report(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per group rows for classes 0 and 1, and for the accuracy, macro and weighted averages: precision, recall, f1, support."""
    c = _counts(scores, by)
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    n1, n0 = tp + fn, tn + fp
    cls = {
        "0": (_share(tn, tn + fn), _share(tn, tn + fp), _f1(tn, fn, fp), n0),
        "1": (_share(tp, tp + fp), _share(tp, tp + fn), _f1(tp, fp, fn), n1),
    }
    whole, right = n0 + n1, _share(tp + tn, n0 + n1)
    cls["accuracy"] = (right, right, right, whole)
    cls["macro avg"] = (*[(cls["0"][k] + cls["1"][k]) / 2 for k in range(3)], whole)
    cls["weighted avg"] = (*[_share(cls["0"][k] * n0 + cls["1"][k] * n1, whole) for k in range(3)], whole)
    rows = [F.struct(F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"), f.alias("f1"), n.cast("long").alias("support")) for name, (p, r, f, n) in cls.items()]
    return c.select(*by, F.inline(F.array(*rows)))


def _by_score(scores: DataFrame, by: Sequence[str], buckets: int, also: Sequence[Column] = ()) -> DataFrame:
    """Positives and negatives of each distinct score, and those of all higher scores; also: further sums of each distinct score.

    A running sum in two levels: scores fall in buckets between quantiles of the distinct scores, so that none holds many more than
    another wherever scores crowd; the buckets' totals are few, and within a bucket a window sums on.
    """
    per = scores.groupBy(*by, "prob").agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"), *also)
    per = shared_table(per, "scores")
    cuts = sorted({q for q in per.approxQuantile("prob", [k / buckets for k in range(1, buckets)], 1 / (4 * buckets))})
    bucketed = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="_p", outputCol="_b", handleInvalid="keep").transform(per.withColumn("_p", F.col("prob").cast("double"))).drop("_p")
    totals = bucketed.groupBy(*by, "_b").agg(F.sum("pos").alias("bp"), F.sum("neg").alias("bn"))
    above = W.partitionBy(*by).orderBy(F.desc("_b")).rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(*by, "_b", F.coalesce(F.sum("bp").over(above), F.lit(0)).alias("ap"), F.coalesce(F.sum("bn").over(above), F.lit(0)).alias("an"))
    inside = W.partitionBy(*by, "_b").orderBy(F.desc("prob")).rowsBetween(W.unboundedPreceding, -1)
    bucketed = bucketed.withColumns({"ip": F.coalesce(F.sum("pos").over(inside), F.lit(0)), "ineg": F.coalesce(F.sum("neg").over(inside), F.lit(0))})
    out = bucketed.join(totals, [*by, "_b"])
    return out.withColumns({"pos_above": F.col("ap") + F.col("ip"), "neg_above": F.col("an") + F.col("ineg")}).drop("_b", "ap", "an", "ip", "ineg")


def _curves() -> tuple[Column, Column]:
    """(area under the ROC curve, average precision) of rows that _by_score gives; NaN for a group of one class."""
    n1, n0 = F.sum("pos"), F.sum("neg")
    tp, n = F.col("pos_above") + F.col("pos"), F.col("pos_above") + F.col("pos") + F.col("neg_above") + F.col("neg")
    or_nan = lambda value: F.when((n1 == 0) | (n0 == 0), F.lit(float("nan"))).otherwise(value)
    won = F.sum(F.col("neg") * (F.col("pos_above") + F.col("pos") / 2.0))
    return or_nan(won / (n1 * n0)).alias("auc"), or_nan(F.sum(F.col("pos") * tp / n) / n1).alias("average_precision")


def auc_roc(scores: DataFrame, by: Sequence[str], buckets: int = 1024) -> DataFrame:
    """Area under the ROC curve; ties count half. NaN for a group of one class."""
    return _by_score(scores, by, buckets).groupBy(*by).agg(_curves()[0])


def pr_curve(scores: DataFrame, by: Sequence[str], buckets: int = 1024) -> DataFrame:
    """Precision and recall at each distinct score as threshold (at least it)."""
    s = _by_score(scores, by, buckets)
    n1 = s.groupBy(*by).agg(F.sum("pos").alias("n1"))
    tp, n = F.col("pos_above") + F.col("pos"), F.col("pos_above") + F.col("pos") + F.col("neg_above") + F.col("neg")
    return s.join(n1, list(by)).select(*by, F.col("prob").alias("threshold"), (tp / n).alias("precision"), _share(tp.cast("double"), F.col("n1")).alias("recall"))


def average_precision(scores: DataFrame, by: Sequence[str], buckets: int = 1024) -> DataFrame:
    """Sum over distinct thresholds of the step in recall times precision. NaN for a group of one class."""
    return _by_score(scores, by, buckets).groupBy(*by).agg(_curves()[1])


def f1_per_interaction(scores: DataFrame, by: Sequence[str] = ("interaction",)) -> DataFrame:
    c = _counts(scores, by)
    return c.select(*by, _f1(F.col("tp").cast("double"), F.col("fp"), F.col("fn")).alias("f1"))


def top_interactions(scores: DataFrame, k: int) -> DataFrame:
    """The k interactions of each split with the best positive-class F1, with their label arrays in residue order."""
    f1 = f1_per_interaction(scores, ("split", "interaction"))
    best = f1.withColumn("rank", F.row_number().over(W.partitionBy("split").orderBy(F.desc("f1"), "interaction"))).filter(F.col("rank") <= k)
    rows = scores.join(best, ["split", "interaction"]).groupBy("split", "interaction", "rank", "f1").agg(F.array_sort(F.collect_list(F.struct("ord", "label", "pred"))).alias("r"))
    return rows.select("split", "interaction", "rank", "f1", F.transform("r", lambda x: x["label"]).alias("y_true"), F.transform("r", lambda x: x["pred"]).alias("y_pred"))


def evaluate_splits(scores: DataFrame, buckets: int = 1024) -> DataFrame:
    """All metrics of each split, from one pass over the scores."""
    by, counts = ["split"], ("tp", "fp", "fn", "tn")
    s = _by_score(scores, by, buckets, _hits())
    return _metrics(s.groupBy(*by).agg(*[F.sum(c).alias(c) for c in counts], *_curves()), by, "auc", "average_precision")


def prediction_parity(a: DataFrame, b: DataFrame, on: Sequence[str], tol: float = 1e-6) -> DataFrame:
    """One row: differences of mean and population std, largest absolute difference, and whether all are close."""
    both = a.select(*on, F.col("prob").alias("p")).join(b.select(*on, F.col("prob").alias("q")), list(on))
    return both.agg(
        (F.avg("p") - F.avg("q")).alias("d_mean"), (F.stddev_pop("p") - F.stddev_pop("q")).alias("d_std"), F.max(F.abs(F.col("p") - F.col("q"))).alias("max_abs"),
        F.bool_and(F.abs(F.col("p") - F.col("q")) <= tol).alias("all_close"),
    )


def positive_rate(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.avg("label").alias("positive_rate"))


def class_counts(interactions: DataFrame) -> DataFrame:
    """Positives and negatives of each interaction's targets, and in total (key null)."""
    per = interactions.select("key", F.size(F.filter("targets", lambda t: t == 1)).cast("long").alias("positives"), F.size(F.filter("targets", lambda t: t == 0)).cast("long").alias("negatives"))
    total = per.agg(F.coalesce(F.sum("positives"), F.lit(0)).alias("positives"), F.coalesce(F.sum("negatives"), F.lit(0)).alias("negatives"))
    return per.unionByName(total.select(F.lit(None).cast("string").alias("key"), "positives", "negatives"))
