"""Nearest neighbours by an inverted multi-index: both halves of a vector are quantised, and cells are visited nearest first."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitemill.llm.common import read, shared_table

#: Centroids of each half: a quarter of the root of the rows, within these bounds, and twice as many as long as a row of the sample would
#: share its cell with more than CELL_ROWS others in the whole table.
LEAST_CENTROIDS, MOST_CENTROIDS, CELL_ROWS = 8, 2048, 32
#: The fitted sample, those of the smallest hashes: so many rows, and so many numbers, at most; and its rows for each centroid, at least.
SAMPLE_ROWS, SAMPLE_VALUES, ROWS_A_CENTROID = 50_000, 1 << 22, 8
#: Rows whose true neighbours in the whole table tell how far one must look, and the share of these that the looked-at cells shall hold.
TRIAL_QUERIES, TARGET = 200, 0.97
#: Rows of one block of cells, and queries that meet it at a time.
BLOCK_ROWS, BLOCK_QUERIES = 16_384, 4096
#: Candidates of a query, by compact codes, for each neighbour asked for; these are measured on whole vectors.
CANDIDATES = 8
NEIGHBOURS = 10


def kmeans(x: np.ndarray, k: int, rounds: int = 15, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    x = x.astype(np.float64)
    k = min(k, len(x))
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = nearest(x, centres)
        sums, n = np.zeros_like(centres), np.bincount(own, minlength=k)
        np.add.at(sums, own, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (centres * centres).sum(1)[None, :] - 2 * x @ centres.T, 0)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return squared(x, centres).argmin(axis=1)


def visit(first: np.ndarray, second: np.ndarray, counts: np.ndarray, need: int) -> list[int]:
    """Cells (i * len(second) + j) by rising first[i] + second[j], until they hold need rows.

    The multi-sequence walk: a heap holds the border of the pairs seen, and a pair is put in once both pairs before it are out.
    """
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, out, seen, got = [(first[a[0]] + second[b[0]], 0, 0)], [], {(0, 0)}, 0
    while heap and got < need:
        _, i, j = heapq.heappop(heap)
        cell = int(a[i]) * len(b) + int(b[j])
        if counts[cell]:
            out.append(cell)
            got += int(counts[cell])
        for p, q in ((i + 1, j), (i, j + 1)):
            if p < len(a) and q < len(b) and (p, q) not in seen:
                seen.add((p, q))
                heapq.heappush(heap, (first[a[p]] + second[b[q]], p, q))
    return out


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding): rows that are not zero and hold no null or non-finite component, of any length."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    return rows.filter(fine & F.exists(v, lambda x: x != 0)).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("embedding"))


def _matrix(column) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.zeros((0, 1))


def quantisers(x: np.ndarray, half: int, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of both halves from distinct sampled rows x of n_rows, as fine as the rows are dense where they lie."""
    k = int(min(MOST_CENTROIDS, max(LEAST_CENTROIDS, n_rows**0.5 / 4)))
    most = min(MOST_CENTROIDS, max(k, len(x) // ROWS_A_CENTROID))
    while True:
        sides = [kmeans(x[:, :half], k), kmeans(x[:, half:], k)]
        _, own, n = np.unique(nearest(x[:, :half], sides[0]) * len(sides[1]) + nearest(x[:, half:], sides[1]), return_inverse=True, return_counts=True)
        if (n[own].mean() - 1) * n_rows / len(x) <= CELL_ROWS or k >= most:
            break
        k = min(most, 2 * k)
    # Neighbouring centroids get neighbouring numbers, so that the cells of a block lie together.
    return tuple(c[np.argsort(nearest(c, kmeans(c, int(len(c) ** 0.5))), kind="stable")] for c in sides)


def needed_rows(sums: Iterator[tuple[np.ndarray, np.ndarray]], counts: np.ndarray, target: float = TARGET) -> int:
    """Rows that cells must hold, visited nearest first, to bring a share target of the true neighbours of trial queries.

    sums: of each query its distance from every cell, and the cells of its neighbours in the whole table. counts: distinct rows of cells.
    """
    seen, used = [], np.flatnonzero(counts)
    for away, cells in sums:
        order = used[np.argsort(away[used], kind="stable")]
        upto = np.zeros(len(counts), np.int64)
        upto[order] = np.cumsum(counts[order])
        seen.append(upto[cells])
    return int(np.ceil(np.quantile(np.concatenate(seen), target))) if seen else int(counts.sum())


def true_neighbours(index: DataFrame, queries: np.ndarray, k: int) -> DataFrame:
    """(trial, cell, away) of the k rows of index (embedding, cell) nearest to each of few queries, equal ones left out.

    Each task keeps k rows a query of what it reads, so what is shuffled does not grow with the rows of a task.
    """

    def nearest_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best, cells = np.full((len(queries), k), np.inf), np.zeros((len(queries), k), np.int64)
        for pdf in batches:
            for at in range(0, len(pdf), 4096):
                part = pdf.iloc[at : at + 4096]
                away = squared(queries, _matrix(part["embedding"]))
                away[away <= 1e-12 * (queries * queries).sum(axis=1)[:, None]] = np.inf
                both = np.concatenate((best, away), axis=1)
                own = np.concatenate((cells, np.broadcast_to(part["cell"].to_numpy(), away.shape)), axis=1)
                first = np.argpartition(both, k - 1, axis=1)[:, :k]
                best, cells = np.take_along_axis(both, first, 1), np.take_along_axis(own, first, 1)
        trial, place = np.nonzero(np.isfinite(best))
        yield pd.DataFrame({"trial": trial, "cell": cells[trial, place], "away": best[trial, place]})

    found = index.select("embedding", "cell").mapInPandas(nearest_rows, "trial long, cell long, away double")
    order = W.partitionBy("trial").orderBy("away", "cell")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).drop("place")


class Codes:
    """A byte for each component: its place between the sample's extremes of that component."""

    def __init__(self, sample: np.ndarray):
        self.low = sample.min(axis=0)
        self.step = np.maximum(sample.max(axis=0) - self.low, 1e-30) / 255

    def of(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.rint((x - self.low) / self.step), 0, 255).astype(np.uint8)

    def back(self, codes: np.ndarray) -> np.ndarray:
        return self.low + codes * self.step


RESULT = "query_id long, rank int, vec_id long, score double"


def search(vectors: DataFrame, every: int, k: int = NEIGHBOURS, dim: int | None = None) -> DataFrame:
    """The k nearest rows found for each row whose vec_id is divisible by every, nearest first, ties to the smaller vec_id.

    vectors: vec_id, embedding. dim: the vectors' length, else the commonest one, of equally common ones the larger; rows of another
    length, and null, zero or non-finite ones, take no part. A row is no neighbour of its own vec_id. Without usable rows the result is
    empty. A query row that is repeated is answered once; rows of one vec_id with different embeddings are answered one by one, each with
    ranks from 1. A row that is repeated is a neighbour as often as it stands. Other columns are left aside.

    Centroids and codes are fitted on a bounded sample; every row is indexed. How many rows a query must see is measured: the true
    neighbours of TRIAL_QUERIES rows in the whole table are sought by brute force, and the number holds TARGET of them. It is a number
    of distinct rows, not a share of all: it rises far slower than the rows where vectors have structure, as centroids grow in number
    with the rows until cells are small. A query visits cells by a heap over centroid pairs until they hold that many. Cells that lie
    together form blocks of at most BLOCK_ROWS rows, larger cells are dealt over several blocks, and a block is repeated only as often
    as BLOCK_QUERIES queries visit it. There only the rows of visited cells are looked at: CANDIDATES * k rows a query are chosen by
    compact codes; their whole vectors are joined and measured.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    if dim is None:
        commonest = rows.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
        if commonest is None:
            return spark.createDataFrame([], RESULT)
        dim = commonest["dim"]
    rows = rows.filter(F.size("embedding") == dim)
    n_rows = rows.count()
    if not n_rows:
        return spark.createDataFrame([], RESULT)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(1, min(SAMPLE_ROWS, SAMPLE_VALUES // dim))).select("embedding").toArrow()
    fitted = np.unique(sample.column(0).combine_chunks().flatten().to_numpy().reshape(-1, dim), axis=0)
    half, codes = max(1, dim // 2), Codes(fitted)
    left, right = quantisers(fitted, half, n_rows)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = _matrix(pdf["embedding"])
            if len(pdf):
                cell = nearest(x[:, :half], left) * len(right) + nearest(x[:, half:], right)
                yield pdf.assign(cell=cell.astype(np.int32), code=[c.tobytes() for c in codes.of(x)])

    index = shared_table(rows.mapInPandas(assign, "vec_id long, embedding array<double>, cell int, code binary").withColumn("row", F.monotonically_increasing_id()), "ann-index")
    # Copies of one vector count once in what a query needs, else a common vector would end its walk.
    sizes = index.groupBy("cell").agg(F.count("*"), F.approx_count_distinct(F.xxhash64("embedding"))).collect()  # cells at most
    counts, distinct = np.zeros(len(left) * len(right), np.int64), np.zeros(len(left) * len(right), np.int32)
    for cell, n, m in sizes:
        counts[cell], distinct[cell] = n, max(1, m)
    trials = index.orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id").limit(TRIAL_QUERIES).select("embedding").toPandas()
    trials = np.unique(_matrix(trials["embedding"]), axis=0)
    near: dict[int, list[int]] = {}
    for trial, cell, _ in true_neighbours(index, trials, k).collect():  # k rows of each trial
        near.setdefault(trial, []).append(cell)
    apart = lambda q: (squared(q[None, :half], left)[0][:, None] + squared(q[None, half:], right)[0][None, :]).ravel()
    need = needed_rows(((apart(trials[t]), np.array(cells)) for t, cells in near.items()), distinct)
    # Blocks: cells in order, a new block where the next cell would not fit; a large cell gets blocks of its own.
    start, spread, block, held = np.zeros(len(counts), np.int32), np.ones(len(counts), np.int32), 0, 0
    for cell in np.flatnonzero(counts).tolist():
        n = int(counts[cell])
        if held and held + n > BLOCK_ROWS:
            block, held = block + 1, 0
        start[cell], spread[cell] = block, max(1, -(-n // BLOCK_ROWS))
        block, held = (block + int(spread[cell]), 0) if spread[cell] > 1 else (block, held + n)
    cells_ = spark.sparkContext.broadcast((distinct, start, spread))  # MOST_CENTROIDS squared places at most
    # query_row tells the rows of one vec_id apart.
    asking = index.filter(F.col("vec_id") % every == 0).select("vec_id", "embedding", F.xxhash64("embedding").alias("query_row")).dropDuplicates(["vec_id", "query_row"])

    def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        distinct, start, spread = cells_.value
        for pdf in batches:
            x = _matrix(pdf["embedding"])
            for at in range(0, len(pdf), 256):
                out, part = [], pdf.iloc[at : at + 256]
                for query_id, row, q in zip(part["vec_id"].tolist(), part["query_row"].tolist(), x[at : at + 256], strict=True):
                    near: dict[int, list[int]] = {}
                    for cell in visit(squared(q[None, :half], left)[0], squared(q[None, half:], right)[0], distinct, need):
                        for b in range(start[cell], start[cell] + spread[cell]):
                            near.setdefault(int(b), []).append(cell)
                    out += [(query_id, row, q, b, cells) for b, cells in near.items()]
                yield pd.DataFrame(out, columns=["query_id", "query_row", "embedding", "block", "cells"])

    queries = shared_table(asking.mapInPandas(visits, "query_id long, query_row long, embedding array<double>, block long, cells array<int>"), "ann-visits")
    # Each block's rows are given as many times as its queries need; a block that no query visits is left out.
    rounds = shared_table(queries.groupBy("block").agg(F.ceil(F.count("*") / BLOCK_QUERIES).alias("rounds")), "ann-rounds")
    queries = queries.join(rounds, "block").withColumn("round", F.pmod(F.xxhash64("query_id"), F.col("rounds")))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, start, spread = cells_.value
        for pdf in batches:
            cell = pdf["cell"].to_numpy()
            yield pdf.assign(start=start[cell].astype(np.int64), spread=spread[cell].astype(np.int64))

    data = index.select("row", "vec_id", "cell", "code").mapInPandas(place, "row long, vec_id long, cell int, code binary, start long, spread long")
    data = data.withColumn("block", F.col("start") + F.pmod(F.xxhash64("row"), F.col("spread"))).join(rounds, "block")
    data = data.withColumn("round", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rounds") - 1)))
    n_candidates = CANDIDATES * k

    def choose(rows_: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(rows_) and len(asked):
            rows_ = rows_.sort_values("cell", kind="stable")
            x = codes.back(np.frombuffer(b"".join(rows_["code"]), np.uint8).reshape(len(rows_), -1))
            ids, own = rows_["vec_id"].to_numpy(), rows_["row"].to_numpy()
            known, first = np.unique(rows_["cell"].to_numpy(), return_index=True)
            last = np.r_[first[1:], len(rows_)]
            for at in range(0, len(asked), 64):
                part = asked.iloc[at : at + 64]
                queries, whole = _matrix(part["embedding"]), None
                for i, (query_id, row, cells) in enumerate(zip(part["query_id"].tolist(), part["query_row"].tolist(), part["cells"], strict=True)):
                    # The rows of visited cells that lie in this block, and only these.
                    met = np.unique(np.searchsorted(known, np.asarray(cells)))
                    met = met[met < len(known)]
                    met = met[np.isin(known[met], cells)]
                    may = np.concatenate([np.arange(first[m], last[m]) for m in met.tolist()]) if len(met) else np.zeros(0, np.int64)
                    may = may[ids[may] != query_id]
                    if not len(may):
                        continue
                    if 4 * len(may) > len(x):  # most of the block: all queries' distances at once
                        whole = squared(queries, x) if whole is None else whole
                        rough = whole[i, may]
                    else:
                        rough = squared(queries[i : i + 1], x[may])[0]
                    if len(may) > n_candidates:  # of rows with equal codes the smaller ids
                        border = np.partition(rough, n_candidates - 1)[n_candidates - 1]
                        close = rough <= border + 1e-9 * (1 + border)
                        may, rough = may[close], rough[close]
                    best = np.lexsort((ids[may], np.round(rough, 9)))[:n_candidates]
                    found += zip([query_id] * len(best), [row] * len(best), own[may[best]].tolist(), rough[best].tolist(), ids[may[best]].tolist(), strict=True)
        return pd.DataFrame(found, columns=["query_id", "query_row", "row", "rough", "vec_id"])

    chosen = (
        data.select("block", "round", "row", "vec_id", "code", "cell").groupBy("block", "round")
        .cogroup(queries.select("block", "round", "query_id", "query_row", "embedding", "cells").groupBy("block", "round"))
        .applyInPandas(choose, "query_id long, query_row long, row long, rough double, vec_id long")
    )
    by_code = W.partitionBy("query_id", "query_row").orderBy(F.round("rough", 9), "vec_id")
    chosen = chosen.withColumn("place", F.row_number().over(by_code)).filter(F.col("place") <= n_candidates).select("query_id", "query_row", "row")
    measured = chosen.join(index.select("row", "vec_id", F.col("embedding").alias("found")), "row").join(
        asking.select(F.col("vec_id").alias("query_id"), "query_row", F.col("embedding").alias("asked")), ["query_id", "query_row"]
    )
    squares = F.zip_with("found", "asked", lambda a, b: (a - b) * (a - b))
    measured = measured.withColumn("score", F.sqrt(F.aggregate(squares, F.lit(0.0), lambda a, x: a + x)))
    order = W.partitionBy("query_id", "query_row").orderBy("score", "vec_id")
    return measured.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), every=100)
