"""Moments of every dimension of vectors: accumulators that are arrays, one a task, merged as arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitemill.functions.shipping import ship_package

#: Numbers that a task looks at together.
VALUES_AT_ONCE = 1 << 20
FIELDS = {"n": "bigint", "mean": "double", "m2": "double", "low": "double", "high": "double", "has_nan": "boolean", "has_inf": "boolean"}
_KINDS = {"bigint": (np.int64, pa.int64()), "double": (np.float64, pa.float64()), "boolean": (np.bool_, pa.bool_())}


class Moments:
    """Of each dimension: how many values are known (not null), their mean and sum of squared deviations, the range of what is no NaN,
    and whether a null or NaN, or an infinity, was met. Vectors may differ in length."""

    def __init__(self, parts: dict[str, np.ndarray] | None = None):
        self.parts = parts or {k: np.zeros(0, _KINDS[t][0]) for k, t in FIELDS.items()}

    @classmethod
    def of(cls, x: np.ndarray, known: np.ndarray) -> Moments:
        """x, known: a row for each vector."""
        n = known.sum(axis=0)
        with np.errstate(all="ignore"):
            mean = np.where(known, x, 0).sum(axis=0) / np.maximum(n, 1)
            m2 = np.where(known, (x - mean) ** 2, 0).sum(axis=0)
        nan = ~known | np.isnan(x)
        low, high = np.where(nan, np.inf, x).min(axis=0, initial=np.inf), np.where(nan, -np.inf, x).max(axis=0, initial=-np.inf)
        return cls({"n": n, "mean": mean, "m2": m2, "low": low, "high": high, "has_nan": nan.any(axis=0), "has_inf": (np.isinf(x) & known).any(axis=0)})

    def _to(self, width: int) -> dict[str, np.ndarray]:
        blank = {"low": np.inf, "high": -np.inf}
        return {k: np.concatenate((v, np.full(width - len(v), blank.get(k, 0), v.dtype))) for k, v in self.parts.items()}

    def merge(self, other: Moments) -> Moments:
        width = max(len(self.parts["n"]), len(other.parts["n"]))
        a, b = self._to(width), other._to(width)
        n = a["n"] + b["n"]
        with np.errstate(all="ignore"):
            apart = b["mean"] - a["mean"]
            both = np.where(np.isfinite(apart), a["mean"] + apart * (b["n"] / np.maximum(n, 1)), a["mean"] + b["mean"])  # infinities and NaNs stay
            mean = np.where(a["n"] == 0, b["mean"], np.where(b["n"] == 0, a["mean"], both))
            across = np.where((a["n"] == 0) | (b["n"] == 0), 0.0, apart * apart * (a["n"] * (b["n"] / np.maximum(n, 1))))
        return Moments(
            {"n": n, "mean": mean, "m2": a["m2"] + b["m2"] + across, "low": np.minimum(a["low"], b["low"]), "high": np.maximum(a["high"], b["high"]),
             "has_nan": a["has_nan"] | b["has_nan"], "has_inf": a["has_inf"] | b["has_inf"]}
        )

    def add(self, vectors: pa.ListArray) -> Moments:
        out, sizes = self, np.diff(vectors.offsets.to_numpy())
        values = vectors.values.slice(vectors.offsets[0].as_py(), int(sizes.sum()))
        flat = values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
        known = np.ones(len(flat), bool) if not values.null_count else values.is_valid().to_numpy(zero_copy_only=False)
        starts = np.cumsum(sizes) - sizes
        for width in np.unique(sizes[sizes > 0]).tolist():
            own = starts[sizes == width]
            step = max(1, VALUES_AT_ONCE // width)
            for k in range(0, len(own), step):
                at = own[k : k + step, None] + np.arange(width)
                out = out.merge(Moments.of(flat[at], known[at]))
        return out


def _merged(rows: DataFrame, last: bool) -> DataFrame:
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = Moments()
        for batch in batches:
            for i in range(batch.num_rows):
                now = now.merge(Moments({k: batch.column(j)[i].values.to_numpy(zero_copy_only=False).astype(_KINDS[t][0]) for j, (k, t) in enumerate(FIELDS.items())}))
        if last:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(now.parts["n"]), dtype=np.int32)), *(pa.array(v) for v in now.parts.values())], names=["pos", *FIELDS])
        elif len(now.parts["n"]):
            yield _row(now)

    return rows.mapInArrow(merge, "pos int, " + ", ".join(f"{k} {t}" for k, t in FIELDS.items()) if last else _ROW)


_ROW = ", ".join(f"{k} array<{t}>" for k, t in FIELDS.items())


def _row(now: Moments) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([now.parts[k]], pa.list_(_KINDS[t][1])) for k, t in FIELDS.items()], names=list(FIELDS))


def moments(vectors: DataFrame) -> DataFrame:
    """(pos, n, mean, m2, low, high, has_nan, has_inf) of each dimension of the vectors (features), null vectors left aside.

    A task gives one row of arrays, however many vectors it reads. These rows are merged by as many tasks as there are shuffle partitions
    and then by one, so that no task meets the rows of all.
    """
    ship_package(vectors.sparkSession)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = Moments()
        for batch in batches:
            now = now.add(batch.column(0))
        if len(now.parts["n"]):
            yield _row(now)

    rows = vectors.select(F.col("features").cast("array<double>").alias("features")).filter(F.col("features").isNotNull()).mapInArrow(add, _ROW)
    spread = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _merged(_merged(rows.repartition(spread), False).repartition(1), True)
