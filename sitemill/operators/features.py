"""Screening, masking and scaling of feature vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitemill.functions.moments import moments

def screen_features(vectors: DataFrame) -> DataFrame:
    """(pos, has_nan, has_inf, is_constant) of each dimension; a null counts as NaN, and a dimension of NaNs only as constant."""
    constant = F.col("low") >= F.col("high")  # without a value the range is empty: from infinity down to its negative
    return moments(vectors).select("pos", "has_nan", "has_inf", constant.alias("is_constant"))


def feature_mask(vectors: DataFrame) -> DataFrame:
    """One row: the dimensions that are fine, in order, as an array."""
    fine = screen_features(vectors).filter("not (has_nan or has_inf or is_constant)")
    return fine.agg(F.array_sort(F.collect_list("pos")).alias("mask"))


def apply_mask(vectors: DataFrame, mask: DataFrame) -> DataFrame:
    """vectors with the mask's dimensions only; the mask is one row, no larger than a vector."""
    return vectors.crossJoin(F.broadcast(mask)).withColumn("features", F.transform("mask", lambda i: F.get("features", i))).drop("mask")


def verify_features(vectors: DataFrame) -> DataFrame:
    """One row: how many dimensions still hold a NaN, an infinity or one value only."""
    return screen_features(vectors).agg(*[F.count_if(c).alias(f"n_{c}") for c in ("has_nan", "has_inf", "is_constant")])


def fit_scaler(vectors: DataFrame) -> DataFrame:
    """(pos, mean, std) over entities stored once each, std of the population. Nulls are left out; of nulls only both are null."""
    known = F.col("n") > 0
    return moments(vectors).select("pos", F.when(known, F.col("mean")).alias("mean"), F.when(known, F.sqrt(F.col("m2") / F.col("n"))).alias("std"))


def apply_scaler(vectors: DataFrame, scaler: DataFrame) -> DataFrame:
    """(x - mean) / std, a std of 0 taken as 1. The scaler becomes one row of arrays, no larger than a vector, and is broadcast."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "mean", "std")))
    row = scaler.agg(ordered.alias("_s"))
    scaled = F.transform(
        F.arrays_zip(F.col("features").alias("x"), F.col("_s").alias("s")), lambda z: (z["x"].cast("double") - z["s"]["mean"]) / F.when(z["s"]["std"] == 0, 1.0).otherwise(z["s"]["std"])
    )
    return vectors.crossJoin(F.broadcast(row)).withColumn("features", scaled).drop("_s")


def shape_report(vectors: DataFrame, n: int, entity: str) -> DataFrame:
    """The first n entities: rows, width, mean and population std of all their values, and the first ten of the first row."""
    first = vectors.select(entity).distinct().orderBy(entity).limit(n)
    rows = vectors.join(F.broadcast(first), entity, "left_semi")  # n rows at most
    shape = rows.groupBy(entity).agg(F.count("*").alias("n_rows"), F.max(F.size("features")).alias("width"), F.min_by(F.slice("features", 1, 10), "ord").alias("head"))
    moments = rows.select(entity, F.explode(F.col("features").cast("array<double>")).alias("v")).groupBy(entity).agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    return shape.join(moments, entity)
