"""Training, search and scoring with spark.ml."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any, NamedTuple

from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier, MultilayerPerceptronClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitemill.functions.scalar import residue_ordinal, threshold_label
from sitemill.operators.features import apply_scaler


def _as_vectors(df: DataFrame) -> DataFrame:
    return df.withColumn("features", array_to_vector(F.col("features").cast("array<double>"))).withColumn("label", F.col("label").cast("double"))


def train_boosted(train: DataFrame, val: DataFrame, params: Mapping[str, Any]) -> Model:
    """Boosted trees on (features array, label) with the positive class weighted and a fixed validation set that stops them.

    params: those of GBTClassifier, and positive_weight (default: negatives per positive of train).
    """
    params = dict(params)
    weight = params.pop("positive_weight", None)
    if weight is None:
        pos, n = train.select(F.count_if(F.col("label") == 1), F.count("*")).first()
        weight = (n - pos) / pos if pos else 1.0
    rows = _as_vectors(train).withColumn("validation", F.lit(False)).unionByName(_as_vectors(val).withColumn("validation", F.lit(True)), allowMissingColumns=True)
    rows = rows.withColumn("weight", F.when(F.col("label") == 1, float(weight)).otherwise(1.0))
    return GBTClassifier(weightCol="weight", validationIndicatorCol="validation", **params).fit(rows.select("features", "label", "weight", "validation"))


def f1_of(model: Model, rows: DataFrame) -> float:
    """Positive-class F1."""
    return MulticlassClassificationEvaluator(metricName="fMeasureByLabel", metricLabel=1.0, predictionCol="prediction", labelCol="label").evaluate(model.transform(_as_vectors(rows)))


def _weighted(rows: DataFrame, weight: float) -> DataFrame:
    """rows with each positive as often as its weight says: whole copies, and one more for the share of them that the rest names."""
    rest = F.pmod(F.xxhash64(F.col("features").cast("string")), F.lit(1 << 20)) < F.lit(round((weight - int(weight)) * (1 << 20)))
    copies = F.when(F.col("label") == 1, F.lit(int(weight)) + rest.cast("int")).otherwise(F.lit(1))
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.greatest(copies, F.lit(1))))).drop("_copy")


def train_network(train: DataFrame, val: DataFrame, params: Mapping[str, Any]) -> tuple[Model, float]:
    """(a feed-forward classifier, its validation F1): the best state of a run that stops early.

    The solver goes on from its own weights in epochs of params["step"] (5) steps, max_iter (50) in all; after patience (5) epochs without
    a better F1 on val it ends, and the best epoch's model is returned, not the last one's. positive_weight: the weight of a positive
    row in the loss (default: negatives per positive of train, at least 1), by repeating it. Other params: MultilayerPerceptronClassifier.
    """
    params = dict(params)
    hidden, most, step, patience = (params.pop(k, d) for k, d in (("hidden", [16]), ("max_iter", 50), ("step", 5), ("patience", 5)))
    weight = params.pop("positive_weight", None)
    if weight is None:
        pos, n = train.select(F.count_if(F.col("label") == 1), F.count("*")).first()
        weight = (n - pos) / pos if pos else 1.0
    width = len(train.select("features").first()[0])
    rows = _as_vectors(_weighted(train.select("features", "label"), max(1.0, float(weight)))).persist()
    best: tuple[Model, float] | None = None
    weights, waited = None, 0
    try:
        for at in range(0, most, step):
            fit = MultilayerPerceptronClassifier(layers=[width, *hidden, 2], maxIter=min(step, most - at), **params)
            model = (fit.setInitialWeights(weights) if weights is not None else fit).fit(rows)
            weights, score = model.weights, f1_of(model, val)
            if best is None or score > best[1]:
                best, waited = (model, score), 0
            else:
                waited += 1
                if waited >= patience:
                    break
    finally:
        rows.unpersist()
    return best


@dataclass(frozen=True)
class Uniform:
    """Real numbers from low to high, evenly, or evenly in their logarithms."""

    low: float
    high: float
    log: bool = False

    def at(self, u: float) -> float:
        return self.low * (self.high / self.low) ** u if self.log else self.low + u * (self.high - self.low)


@dataclass(frozen=True)
class Integers:
    """Whole numbers from low to high, both included, in steps."""

    low: int
    high: int
    step: int = 1

    def at(self, u: float) -> int:
        return self.low + self.step * int(u * ((self.high - self.low) // self.step + 1))


@dataclass(frozen=True)
class Rungs:
    """Successive halving: all trials are fitted with the parameter at its first value, the best share of them with the next, and so on."""

    param: str
    values: tuple[Any, ...]
    keep: float = 1 / 3


class Trial(NamedTuple):
    number: int
    params: dict[str, Any]
    score: float
    rung: int = 0


def drawn(space: Mapping[str, Any], seed: int, number: int) -> dict[str, Any]:
    """A trial's parameters. Each hangs on the seed, the trial's number and its own name alone: never on other trials or their order."""
    out = {}
    for name, values in sorted(space.items()):
        u = int(hashlib.md5(f"{seed}:{number}:{name}".encode()).hexdigest()[:13], 16) / 16**13
        out[name] = values.at(u) if hasattr(values, "at") else list(values)[int(u * len(values))]
    return out


def search(
    train: DataFrame, val: DataFrame, space: Mapping[str, Any], n: int, seed: int, fit: Callable = train_boosted, history: Sequence[Trial] = (), parallelism: int = 1, rungs: Rungs | None = None
) -> tuple[dict[str, Any], float, list[Trial]]:
    """(best parameters, their validation F1, all fits as Trial) of n seeded draws from the space: lists, Uniform and Integers by name.

    Up to parallelism fits run at a time, each a set of Spark jobs in a scheduler pool of its own; the result is the same for any number.
    With rungs a trial that is not among the best of its rung is fitted no further, and the best of the last rung wins; ties go to the
    smaller number. A search goes on from the history of an earlier one of the same seed, space and rungs: what it holds is not fitted
    again. Equal draws are fitted once. fit gives a model, or a model and its F1. train and val are kept while the search runs.
    """
    known = {(t.number, t.rung): t.score for t in history}
    by_params: dict[str, float] = {}
    trials: list[Trial] = []
    context = train.sparkSession.sparkContext
    train, val = train.persist(), val.persist()

    def one(number: int, params: dict[str, Any]) -> float:
        context.setLocalProperty("spark.scheduler.pool", f"trial-{number % max(1, parallelism)}")
        try:
            made = fit(train, val, dict(params))
            return made[1] if isinstance(made, tuple) else f1_of(made, val)
        finally:
            context.setLocalProperty("spark.scheduler.pool", None)

    try:
        numbers = list(range(n))
        with ThreadPoolExecutor(max(1, parallelism)) as threads:
            for rung, value in enumerate(rungs.values if rungs else (None,)):
                params = {k: drawn(space, seed, k) | ({rungs.param: value} if rungs else {}) for k in numbers}
                by_params |= {repr(params[k]): known[k, rung] for k in numbers if (k, rung) in known}
                new = {repr(params[k]): k for k in reversed(numbers) if repr(params[k]) not in by_params}
                by_params |= dict(zip(new, threads.map(lambda k, p=params: one(k, p[k]), new.values()), strict=True))
                now = [Trial(k, params[k], by_params[repr(params[k])], rung) for k in numbers]
                trials += now
                now.sort(key=lambda t: (-t.score, t.number))
                if rungs and rung + 1 < len(rungs.values):
                    numbers = sorted(t.number for t in now[: max(1, math.ceil(rungs.keep * len(now)))])
    finally:
        train.unpersist(), val.unpersist()
    best = now[0] if trials else Trial(0, {}, -1.0)
    return best.params, best.score, trials


def score_pairs(pairs: DataFrame, ids: DataFrame, residues: DataFrame, ligands: DataFrame, scaler: DataFrame | None, model: Model, cut: float = 0.5) -> DataFrame:
    """A probability and label for each residue of each pair (pdb, chain, lig_id, sequence, smiles).

    ids: seq_id, sequence; residues: seq_id, ord, features; ligands: smiles, features, keyed by the text itself, so an id with two texts
    keeps both. A pair's sequence becomes its number before it is dealt out by residues, so no residue carries a text but the ligand's.
    """
    rows = residue_ordinal(pairs.distinct().join(ids, "sequence")).withColumn("ord", F.col("position") - 1).drop("sequence")
    rows = rows.join(residues.withColumnRenamed("features", "_r"), ["seq_id", "ord"]).join(ligands.withColumnRenamed("features", "_l"), "smiles")
    rows = rows.withColumn("features", F.concat(F.col("_r").cast("array<double>"), F.col("_l").cast("array<double>"))).drop("_r", "_l")
    if scaler is not None:
        rows = apply_scaler(rows, scaler)
    scored = model.transform(rows.withColumn("features", array_to_vector("features")))
    probability = vector_to_array("probability")[1]
    out = scored.select("pdb", "chain", "lig_id", "smiles", "position", "residue", probability.alias("probability"))
    return out.withColumn("pred", threshold_label(F.col("probability"), cut))
