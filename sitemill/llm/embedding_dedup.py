"""Near copies among vectors: sign hashes of random hyperplanes in several tables, cosines of whole vectors, connected components."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitemill.llm.ann import usable
from sitemill.llm.common import fresh, partitions, read, shared_table
from sitemill.llm.near_dedup import components

#: Vectors at this cosine or above are linked.
COSINE = 0.95
#: The share of pairs just at the threshold that the tables shall bring together.
RECALL = 0.9999
#: Vectors that share a table's bucket by chance, about: hashes get longer as vectors grow in number.
BUCKET = 16
#: Sign bits of the sketch by which a bucket's vectors are compared, and the standard deviations below the threshold's agreement that pass.
SKETCH_BITS, DEVIATIONS = 256, 5.0
#: A bucket above this size is not compared by sketches: its vectors are all tied to its first.
MOST_BUCKET = 1000
#: Vectors of which a task holds all cosines at a time. Larger components are split into slices of that size, which meet in pairs.
BLOCK = 2048
#: So often a large component's vectors that are in no core get a leader; what is near a leader is its core and is linked without comparison.
LEADER_ROUNDS = 4
#: Rows whose cosines with all others a task holds at once.
ROWS_AT_ONCE = 256
#: The side of a group that is compared with itself.
ALONE = 2


def hash_bits(n: int) -> int:
    return max(4, min(48, round(math.log2(max(1, n) / BUCKET))))


def n_tables(bits: int, cosine: float, recall: float = RECALL) -> int:
    """Tables for the recall: two vectors share a sign with probability 1 - angle / pi, and a table's bucket with that power bits."""
    same = (1 - math.acos(cosine) / math.pi) ** bits
    return 1 if same >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - same))


@functools.lru_cache(maxsize=4)
def hyperplanes(dim: int, n: int) -> np.ndarray:
    return np.random.default_rng([12, dim]).standard_normal((dim, n))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1)[:, None]  # squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def signatures(classes: DataFrame, bits: int, tables: int) -> DataFrame:
    """(cls, dim, keys, sketch) for vectors (cls, embedding): the bucket in each table, and SKETCH_BITS signs as bytes."""
    n = max(SKETCH_BITS, bits * tables)
    weights = 1 << np.arange(bits, dtype=np.int64)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, part in pdf.groupby(pdf["embedding"].map(len), sort=False):
                signs = _unit(np.stack(part["embedding"].to_numpy())) @ hyperplanes(dim, n) > 0
                keys = signs[:, : bits * tables].reshape(len(part), tables, bits) @ weights
                yield pd.DataFrame({"cls": part["cls"].to_numpy(), "dim": dim, "keys": list(keys), "sketch": [r.tobytes() for r in np.packbits(signs[:, :SKETCH_BITS], axis=1)]})

    return classes.select("cls", "embedding").mapInPandas(rows, "cls long, dim int, keys array<long>, sketch binary")


def _forest(n: int, linked) -> np.ndarray:
    """The smallest index that each of n nodes reaches; linked(rows) gives their links to all nodes as a matrix. Each row is asked once."""
    root = np.full(n, -1)
    if n <= ROWS_AT_ONCE:
        whole = linked(np.arange(n))
        whole[np.arange(n), np.arange(n)] = False
        alone = ~whole.any(axis=1)
        root[alone] = np.flatnonzero(alone)
        linked = whole.__getitem__
    for start in range(n):
        if root[start] >= 0:
            continue
        root[start], queue = start, np.array([start])
        while len(queue):
            now, queue = queue[:ROWS_AT_ONCE], queue[ROWS_AT_ONCE:]
            new = np.flatnonzero(linked(now).any(axis=0) & (root < 0))
            root[new] = start
            queue = np.concatenate((queue, new))
    return root


def sketch_ties(nodes: DataFrame, cosine: float) -> DataFrame:
    """(a, b) that tie each bucket's likely pairs together, at most one a vector; nodes of MOST_BUCKET vectors at most: (node, cls, sketch)."""
    same = 1 - math.acos(cosine) / math.pi
    least = SKETCH_BITS * same - DEVIATIONS * math.sqrt(SKETCH_BITS * same * (1 - same))

    def judge(cls: list[int], sketches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        s, ids = np.frombuffer(b"".join(sketches), np.uint64).reshape(len(cls), -1), np.array(cls, np.int64)
        root = _forest(len(ids), lambda rows: sum(np.bitwise_count(s[rows, None, k] ^ s[None, :, k]).astype(np.int16) for k in range(s.shape[1])) <= SKETCH_BITS - least)
        tied = np.flatnonzero(root != np.arange(len(ids)))
        return ids[root[tied]], ids[tied]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, cls, sketches, found = None, [], [], []
        for batch in batches:
            for key, c, s in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if key != node:
                    if len(cls) > 1:
                        found.append(judge(cls, sketches))
                    node, cls, sketches = key, [], []
                cls.append(c), sketches.append(s)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names=["a", "b"])
                found = []
        if len(cls) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in judge(cls, sketches)], names=["a", "b"])

    dealt = nodes.select("node", "cls", "sketch").repartition(partitions(nodes.sparkSession), "node").sortWithinPartitions("node", "cls")
    return dealt.mapInArrow(rows, "a long, b long")


def likely_ties(signed: DataFrame, cosine: float) -> DataFrame:
    """(a, b) that tie together what shares a bucket: by sketches, and in buckets above MOST_BUCKET all with the first, by a join."""
    spread = signed.select("cls", "dim", "sketch", F.posexplode("keys").alias("tab", "key")).select("cls", "sketch", F.xxhash64("dim", "tab", "key").alias("node"))
    large = spread.groupBy("node").agg(F.count("*").alias("members"), F.min("cls").alias("first")).filter(F.col("members") > MOST_BUCKET).select("node", "first")
    large = shared_table(large, "vec-buckets")
    if large.isEmpty():
        return sketch_ties(spread, cosine).distinct()
    placed = spread.join(large, "node", "left")
    ties = placed.filter(F.col("first") < F.col("cls")).select(F.col("first").alias("a"), F.col("cls").alias("b"))
    return sketch_ties(placed.filter(F.col("first").isNull()), cosine).unionByName(ties).distinct()


def _met(rows_: DataFrame, keys: list[str], cosine: float) -> DataFrame:
    """(cls, links, root) within each group of rows_ (*keys, side, cls, m, embedding): linked vectors, and the first cls reached.

    Only vectors of different sides are compared, or all where the side is ALONE.
    """

    def judge(side: list[int], cls: list[int], m: list[int], vectors: list) -> list:
        u, m_, ids, s = _unit(np.array(vectors)), np.array(m, np.int64), np.array(cls, np.int64), np.array(side)
        links = np.zeros(len(cls), np.int64)

        def linked(rows: np.ndarray) -> np.ndarray:
            out = u[rows] @ u.T >= cosine
            out[np.arange(len(rows)), rows] = False
            if side[0] != ALONE:
                out &= s[rows][:, None] != s[None, :]
            links[rows] = out @ m_
            return out

        root = _forest(len(ids), linked)
        return [ids, links, ids[root]]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in judge(*zip(*held, strict=True))], names=["cls", "links", "root"])

        for batch in batches:
            vectors = batch.column(batch.num_columns - 1)
            flat, at = vectors.flatten().to_numpy(), vectors.offsets.to_numpy() - vectors.offsets[0].as_py()
            for i, row in enumerate(zip(*(c.to_pylist() for c in batch.columns[:-1]), strict=True)):
                if row[: len(keys)] != group:
                    if held:
                        yield told()
                    group, held = row[: len(keys)], []
                held.append((*row[len(keys) :], flat[at[i] : at[i + 1]]))
        if held:
            yield told()

    dealt = rows_.select(*keys, "side", "cls", "m", "embedding").repartition(partitions(rows_.sparkSession), *keys).sortWithinPartitions(*keys, "cls")
    return dealt.mapInArrow(rows, "cls long, links long, root long")


def _cores(members: DataFrame, cosine: float) -> DataFrame:
    """members (comp, cls, m, embedding) with the core of each, or null: vectors within half the threshold's angle of a leader, so all linked.

    The leader of a round is a vector of the component that is in no core yet, by hash: a group that holds much of it is likely met.
    """
    near = math.cos(math.acos(cosine) / 2 - 1e-7)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    open_, cores = members, []
    for k in range(LEADER_ROUNDS):
        leaders = open_.groupBy("comp").agg(F.min_by(F.struct("cls", F.col("embedding").alias("v")), F.xxhash64("cls", F.lit(k))).alias("lead"))
        leaders = shared_table(leaders.select("comp", F.col("lead.cls").alias("core"), F.col("lead.v").alias("v")), "vec-leaders")
        led = open_.join(leaders, "comp")
        fits = (F.size("v") == F.size("embedding")) & (dot("v", "embedding") >= near * F.sqrt(dot("v", "v")) * F.sqrt(dot("embedding", "embedding")))
        led = shared_table(led.select("comp", "cls", "m", "embedding", F.when(fits | (F.col("cls") == F.col("core")), F.col("core")).alias("core")), "vec-led")
        cores.append(led.filter(F.col("core").isNotNull()))
        open_ = led.filter(F.col("core").isNull()).drop("core")
        if open_.isEmpty():
            break
    return functools.reduce(DataFrame.unionByName, [*cores, open_.withColumn("core", F.lit(None).cast("long"))])


def _by_cores(members: DataFrame, cosine: float) -> tuple[DataFrame, DataFrame]:
    """(cls, links) and edges (a, b) of components above BLOCK; members: (comp, cls, m, embedding).

    A core's vectors are counted, not compared. All others, and different cores, meet slice by slice, each pair of slices once.
    """
    placed = shared_table(_cores(members, cosine), "vec-cores")
    core = F.coalesce("core", F.lit(-1).cast("long"))
    sizes = placed.groupBy("comp", core.alias("core_")).agg(F.sum("m").alias("all"), F.ceil(F.count("*") / (BLOCK // 2)).alias("slices"))
    sizes = shared_table(sizes, "vec-slices")
    own = placed.filter(F.col("core").isNotNull()).join(sizes.select("comp", F.col("core_").alias("core"), "all"), ["comp", "core"])
    links = own.select("cls", (F.col("all") - F.col("m")).alias("links"))
    edges = own.filter("cls <> core").select(F.col("core").alias("a"), F.col("cls").alias("b"))
    # A slice is (core, number within it). Slices of one core don't meet, all others of a component do, and slices without core meet themselves.
    sliced = placed.withColumn("core_", core).join(sizes.select("comp", "core_", "slices"), ["comp", "core_"])
    sliced = sliced.select("comp", F.struct("core_", F.pmod(F.xxhash64("cls", F.lit(9)), F.col("slices")).alias("at")).alias("slice"), "cls", "m", "embedding")
    each = sizes.select("comp", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1), lambda i: F.struct("core_", i.alias("at")))).alias("slice"))
    x, y = each.withColumnRenamed("slice", "p"), each.withColumnRenamed("slice", "q")
    met = x.join(y, "comp").filter((F.col("p") <= F.col("q")) & ((F.col("p.core_") != F.col("q.core_")) | (F.col("p.core_") < 0)))
    met = met.select("comp", "p", "q", F.struct("p", "q").alias("pair"))
    first = met.select("comp", "pair", F.col("p").alias("slice"), F.when(F.col("p") == F.col("q"), ALONE).otherwise(0).alias("side"))
    second = met.filter("p <> q").select("comp", "pair", F.col("q").alias("slice"), F.lit(1).alias("side"))
    asked = sliced.join(first.unionByName(second), ["comp", "slice"])
    found = shared_table(_met(asked, ["comp", "pair"], cosine), "vec-met")
    links = links.unionByName(found.filter("links > 0").select("cls", "links"))
    return links, edges.unionByName(found.filter("root <> cls").select(F.col("root").alias("a"), F.col("cls").alias("b")))


def linked_classes(classes: DataFrame, cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """(cls, links, root) of the vectors (cls, m, embedding) that have links: linked rows of other classes, and the first class reached."""
    bits = hash_bits(classes.count())
    signed = signatures(classes, bits, n_tables(bits, cosine, recall))
    likely = components(likely_ties(signed, cosine))
    members = shared_table(likely.withColumnRenamed("cid", "cls").join(classes, "cls").select("comp", "cls", "m", "embedding"), "vec-members")
    large = members.groupBy("comp").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK).select("comp")
    large = shared_table(large, "vec-large")
    small = members.join(large, "comp", "left_anti").withColumn("side", F.lit(ALONE))
    out = shared_table(_met(small, ["comp"], cosine), "vec-small").filter("links > 0")
    if large.isEmpty():
        return out
    links, edges = _by_cores(members.join(large, "comp", "left_semi"), cosine)
    labels = components(edges).select(F.col("cid").alias("cls"), F.col("comp").alias("root"))
    return out.unionByName(links.groupBy("cls").agg(F.sum("links").alias("links")).join(labels, "cls"))


def near_copies(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """vectors (vec_id, embedding, any other columns) with n_links, component_id and kept, which replace columns of these names.

    Vectors of one length are linked where their cosine, the product of their unit vectors in double precision, is at least cosine; of
    pairs just there the tables find a share recall, of nearer ones more. n_links counts the other vectors that one is linked with, its
    copies among them; component_id is the smallest vec_id that links reach, and kept tells whether it is the row's own. Null, empty and
    zero vectors, those with null or non-finite components, and rows without vec_id link with nothing (without vec_id component_id is
    null and kept is true). A repeated row counts as one vector and is returned as often as it stands; rows of one vec_id with different
    embeddings are vectors of their own. An empty table gives an empty one.

    Equal vectors are one class with a count, so copies cost one row. Buckets only say which vectors are likely near: sketches, not
    vectors, are shuffled for each table, ties within a bucket make a forest, and the cosines of its components decide. Components up to
    BLOCK are compared in one task, larger ones by cores and slices, so that a group of near copies is counted without all its pairs.
    """
    rows = usable(vectors).dropDuplicates(["vec_id", "embedding"])
    classes = rows.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m")).withColumn("cls", F.monotonically_increasing_id())
    classes = shared_table(classes, "vec-classes")
    found = shared_table(linked_classes(classes.select("cls", "m", "embedding"), cosine, recall), "vec-links")
    told = classes.join(found, "cls", "left").select("embedding", "rep", "cls", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("root", "cls").alias("root"))
    told = shared_table(told, "vec-told")
    least = told.groupBy("root").agg(F.min("rep").alias("component_id"))
    # Only classes that have links, or copies, are joined with the rows; all other rows are alone.
    told = told.filter("n_links > 0").join(least, "root")
    kept = vectors.select(*[c for c in vectors.columns if c.lower() not in ("n_links", "component_id", "kept")])
    own, twin = fresh(kept, "own_vector"), fresh(kept, "class_vector")
    told = told.select(F.col("embedding").alias(twin), "n_links", "component_id")
    out = kept.withColumn(own, F.when(F.col("vec_id").isNotNull(), F.col("embedding").cast("array<double>")))
    out = out.join(told, F.col(own) == F.col(twin), "left").drop(own, twin)
    own = F.col("vec_id").cast("long")
    return out.withColumns({"n_links": F.coalesce("n_links", F.lit(0).cast("long")), "component_id": F.coalesce("component_id", own)}).withColumn("kept", F.coalesce(F.col("component_id") == own, F.lit(True)))


def op12_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(read(spark, sf_dir, "embeddings").select("vec_id", "embedding")).select("vec_id", "n_links", "component_id", "kept")


#: All pairs, where the operator meets only those that a table brings together.
ORACLE = r"""
WITH RECURSIVE v AS (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
c(vec_id, r) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.y, c.r FROM c JOIN l ON l.x = c.vec_id),
m AS (SELECT vec_id, min(r) AS component_id FROM c GROUP BY vec_id), n AS (SELECT x, count(*) AS n_links FROM l GROUP BY x)
SELECT e.vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN m ON m.vec_id = e.vec_id LEFT JOIN n ON n.x = e.vec_id
"""
