"""The prefix tree of conversations: double arrays over the turns of bounded shards, whose shared upper nodes are merged globally."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitemill.llm.common import partitions, read, shared_table

#: Conversation c begins with the first turns of conversation c - c % FAMILY: fewer than SHARED.
FAMILY, SHARED = 20, 4
#: Turns of one shard, about; a longer conversation is a shard of its own.
SHARD_TURNS = 200_000
#: Bytes of a turn's digest, of its place in a sequence and of a node's key: the first of a SHA-256.
DIGEST = 16
#: Bytes of sequences by which they are dealt to tasks, and of a chunk of ids that goes into a digest.
DEALT_BYTES, CHUNK = 64 * DIGEST, 1 << 20
#: Free places that are tried for a node's children before the array is lengthened for them.
TRIES = 64
NO_ENDS = hashlib.sha256(b"").hexdigest()


class DoubleArray:
    """A trie whose node s has its child by label c at base[s] + c, if check there is s. Labels count from 0, the root is place 0.

    Sequences are distinct and sorted: starts and sizes say where each lies in labels.
    """

    def __init__(self, labels: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        self.base, self.check = np.zeros(1024, np.int64), np.full(1024, -1, np.int64)
        self.check[0], self.free, self.end = 0, 1, 1
        starts_, sizes_ = starts.tolist(), sizes.tolist()
        stack = [(0, 0, len(sizes_), 0)]
        while stack:
            node, lo, hi, depth = stack.pop()
            if lo < hi and sizes_[lo] == depth:
                lo += 1
            if lo == hi:
                continue
            own = labels[starts[lo:hi] + depth]
            first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            places = self._place(node, own[first])
            ends = [*first[1:].tolist(), hi - lo]
            stack += [(p, lo + a, lo + b, depth + 1) for p, a, b in zip(places.tolist(), first.tolist(), ends, strict=True)]

    def _place(self, node: int, children: np.ndarray) -> np.ndarray:
        span = int(children[-1] - children[0])
        place, at = self.end, self.free
        for _ in range(TRIES):
            while at < self.end and self.check[at] >= 0:
                at += 1
            self._reach(at + span)
            if (self.check[children + (at - children[0])] < 0).all():
                place = at
                break
            at += 1
        self._reach(place + span)
        self.base[node] = place - children[0]
        places = children + self.base[node]
        self.check[places] = node
        self.end = max(self.end, place + span + 1)
        while self.free < self.end and self.check[self.free] >= 0:
            self.free += 1
        return places

    def _reach(self, place: int) -> None:
        if place >= len(self.check):
            more = max(len(self.check), place + 1 - len(self.check))
            self.base, self.check = np.r_[self.base, np.zeros(more, np.int64)], np.r_[self.check, np.full(more, -1, np.int64)]

    def step(self, nodes: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """The child of each node by its label, -1 where it has none."""
        at = self.base[nodes] + labels
        fine = (at > 0) & (at < self.end)
        at = np.where(fine, at, 0)
        return np.where(fine & (self.check[at] == nodes), at, -1)


class Shard:
    """Sorted distinct sequences (bytes of turns, words of each, members, smallest member, digest of the ids that end there) as node rows.

    A node on the path of the first or last sequence is open: other shards may know it too. All that lies below any other node is here.
    """

    def __init__(self, rows: list[tuple]):
        seqs = [r[0] for r in rows]
        self.first, self.last = seqs[0], seqs[-1]
        sizes = np.array([len(s) // DIGEST for s in seqs], np.int64)
        starts = np.cumsum(sizes) - sizes
        _, labels = np.unique(np.frombuffer(b"".join(seqs), f"S{DIGEST}"), return_inverse=True)
        words = np.concatenate([np.asarray(r[1], np.int64) for r in rows])
        trie = DoubleArray(labels, starts, sizes)
        n = trie.end
        self.parent, self.depth, self.words = trie.check[:n].copy(), np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.n, self.least, self.ends = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), [None] * n
        members, least = np.array([r[2] for r in rows], np.int64), np.array([r[3] for r in rows], np.int64)
        active, at = np.arange(len(rows)), np.zeros(len(rows), np.int64)
        self.path, self.tail = [], []
        for d in range(int(sizes.max()) + 1):
            np.add.at(self.n, at, members[active])
            np.minimum.at(self.least, at, least[active])
            self.depth[at] = d
            if active[0] == 0:
                self.path.append(int(at[0]))
            if active[-1] == len(rows) - 1:
                self.tail.append(int(at[-1]))
            for i, place in zip(*(x[sizes[active] == d].tolist() for x in (active, at)), strict=True):
                self.ends[place] = rows[i][4]
            goes = sizes[active] > d
            active, at = active[goes], at[goes]
            if not len(active):
                break
            self.words[(to := trie.step(at, labels[starts[active] + d]))] = words[starts[active] + d]
            at = to
        self.used = np.flatnonzero(self.parent >= 0)
        self.open = np.zeros(n, bool)
        self.open[self.path + self.tail] = True
        self.fork = sum(a == b for a, b in zip(self.path, self.tail, strict=False)) - 1
        inner = self.used[self.used != 0]
        self.children = np.bincount(self.parent[inner], minlength=n)
        self.leaves, self.saved = ((self.children == 0) & ~self.open).astype(np.int64), np.where(self.open, 0, (self.n - 1) * self.words)
        by_depth = inner[np.argsort(-self.depth[inner], kind="stable")]
        for level in np.split(by_depth, np.flatnonzero(np.diff(self.depth[by_depth])) + 1):
            for total in (self.leaves, self.saved):
                np.add.at(total, self.parent[level], total[level])
        # Open children are counted where they are merged.
        self.children -= np.bincount(self.parent[inner[self.open[inner]]], minlength=n)

    def rows(self, shard: int) -> pa.RecordBatch:
        keys, parts = {}, []
        for seq, path in ((self.first, self.path), (self.last, self.tail)):
            h = hashlib.sha256()
            for d, place in enumerate(path):
                keys[place] = h.digest()[:DIGEST]
                h.update(seq[d * DIGEST : (d + 1) * DIGEST])
        chain = np.zeros(len(self.n), np.int64)
        chain[self.tail[self.fork + 1 :]] = 1
        at = self.used
        parent = self.parent[at]
        above = np.where(self.open[parent], -1, self.least[parent])
        parts = {
            "open": self.open[at], "shard": np.full(len(at), shard), "chain": chain[at], "fork": np.full(len(at), self.fork), "key": [keys.get(p) for p in at.tolist()],
            "parent_key": [keys.get(p) if i else None for i, p in zip(at.tolist(), parent.tolist(), strict=True)], "conv_id": self.least[at], "depth": self.depth[at],
            "parent_conv_id": pa.array(above, mask=self.open[parent]), "n_convs": self.n[at], "n_children": self.children[at], "n_leaves": self.leaves[at],
            "saved_tokens": self.saved[at], "words": self.words[at], "ends_sha256": pa.array([self.ends[p] for p in at.tolist()], pa.string()),
        }
        arrays = [pa.array(v, pa.binary()) if "key" in k else v if isinstance(v, pa.Array) else pa.array(v) for k, v in parts.items()]
        return pa.RecordBatch.from_arrays(arrays, names=list(parts))


NODES = (
    "open boolean, shard long, chain long, fork long, key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, "
    "n_children long, n_leaves long, saved_tokens long, words long, ends_sha256 string"
)


def rebuilt(turns: DataFrame, family: int = FAMILY, shared: int = SHARED) -> DataFrame:
    """(conv_id, key, seq, words) of every conversation: its first h turns are those of the family's first, h = crc32(conv_id) % shared.

    turns: conv_id, turn, role, text. Turns are ordered by turn (null first), then role and the digest of the text; null role or text is
    empty; rows without conv_id are left out. seq holds a digest of (role, text) for each turn, and key a digest of seq.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.sha2(role, 256), F.sha2(text, 256)), 256), 1, 2 * DIGEST)
    order = [F.col("turn").isNotNull().alias("told"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"), role.alias("role"), F.sha2(text, 256).alias("t")]
    turn = F.struct(*order, digest.alias("d"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("w"))
    rows = turns.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("x"))
    own = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    own = own.select("conv_id", F.transform("x", lambda x: F.struct(x["d"].alias("d"), x["w"].alias("w"))).alias("own"))
    own = shared_table(own, "trie-own")
    heads = own.filter(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("base"), F.slice("own", 1, shared - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % shared).cast("int")
    both = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % family).join(heads, "base", "left")
    none = F.slice("own", 1, 0)
    turns_ = F.concat(F.slice(F.coalesce("head", none), F.lit(1), h), F.slice("own", h + 1, F.size("own")))
    out = both.select("conv_id", turns_.alias("x")).select("conv_id", F.unhex(F.array_join("x.d", "")).alias("seq"), F.col("x.w").alias("words"))
    return out.withColumn("key", F.unhex(F.sha2("seq", 256)))


def ends(members: DataFrame) -> DataFrame:
    """(key, ends_sha256) of members (key, conv_id): the digest of each key's ids in rising order, as decimals with commas between.

    Ids are ordered over all tasks and joined to chunks there, so that a key with many ids costs its digest's task few rows.
    """
    k = partitions(members.sparkSession)

    def runs(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[bool, list]]:
        """Rows with whether they begin a key."""
        key = None
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(width)), strict=True):
                yield row[0] != key, row
                key = row[0]

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size, held = [], 0, 0
        for new, (key, conv_id) in runs(batches, 2):
            if new or held > CHUNK:
                out.append((key, conv_id, []))
                held = 0
                if size > CHUNK:
                    yield told(out[:-1])
                    out, size = out[-1:], 0
            text = str(conv_id)
            out[-1][2].append(text)
            held, size = held + len(text) + 1, size + len(text) + 33
        if out:
            yield told(out)

    def told(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.int64()), pa.array([",".join(x[2]) for x in out])], names=["key", "first", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, h = [], None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1].hexdigest() for x in out])], names=["key", "ends_sha256"])

        for new, (key, _, ids) in runs(batches, 3):
            if new:
                if len(out) >= 10_000:
                    yield done()
                    out = []
                h = hashlib.sha256()
                out.append((key, h))
            else:
                h.update(b",")
            h.update(ids.encode())
        if out:
            yield done()

    dealt = members.select("key", "conv_id").repartitionByRange(k, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    joined = dealt.mapInArrow(chunks, "key binary, first long, ids string")
    return joined.repartition(k, "key").sortWithinPartitions("key", "first").mapInArrow(digests, "key binary, ends_sha256 string")


def tries(sequences: DataFrame) -> DataFrame:
    """Node rows (NODES) of each shard of sequences (seq, words, n, least, ends_sha256), which are dealt and sorted by their turns."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, turns = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                held.append(row)
                turns += len(row[1]) + 1
                if turns >= SHARD_TURNS:
                    yield Shard(held).rows(shard)
                    shard, held, turns = shard + 1, [], 0
        if held:
            yield Shard(held).rows(shard)

    dealt = sequences.select("seq", "words", "n", "least", "ends_sha256").repartitionByRange(partitions(sequences.sparkSession), F.substring("seq", 1, DEALT_BYTES)).sortWithinPartitions("seq")
    return dealt.mapInArrow(rows, NODES)


def _merged(open_: DataFrame) -> DataFrame:
    """The open nodes of all shards (NODES), each once, with what is known of them in all shards together.

    Below an open node lie closed nodes, whose sums the shards give, and open ones, whose members are known here only. Each open node is
    given to one shard that knows it: that shard knows all nodes above it too, so sums along its paths add each open node once.
    """
    nodes = open_.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("closed"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"),
        F.max("ends_sha256").alias("ends_sha256"), F.first("parent_key").alias("parent_key"), F.first("depth").alias("depth"), F.first("words").alias("words"), F.min("shard").alias("owner"),
    )
    kids = nodes.filter(F.col("parent_key").isNotNull()).groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("opened"))
    nodes = nodes.join(kids, "key", "left").withColumn("n_children", F.col("closed") + F.coalesce("opened", F.lit(0)))
    nodes = shared_table(nodes.drop("closed", "opened"), "trie-open")
    own = nodes.select("key", "owner", (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("save"))
    given = open_.select("shard", "chain", "fork", "depth", "key").join(own, "key")
    mine = F.col("owner") == F.col("shard")
    below = W.partitionBy("shard", "chain").orderBy(F.desc("depth")).rowsBetween(W.unboundedPreceding, 0)
    sums = given.withColumns({c: F.sum(F.when(mine, F.col(c)).otherwise(0)).over(below) for c in ("leaf", "save")})
    # The last sequence's own nodes (chain 1) also lie below the nodes that it shares with the first.
    fork = sums.filter("chain = 1").groupBy("shard").agg(F.max(F.struct(-F.col("depth"), "leaf", "save")).alias("x")).select("shard", F.col("x.leaf").alias("leaf_"), F.col("x.save").alias("save_"))
    sums = sums.join(fork, "shard", "left")
    shared = (F.col("chain") == 0) & (F.col("depth") <= F.col("fork"))
    both = lambda c: F.col(c) + F.when(shared, F.coalesce(F.col(f"{c}_"), F.lit(0))).otherwise(0)
    sums = sums.groupBy("key").agg(F.sum(both("leaf")).alias("leaf"), F.sum(both("save")).alias("save"))
    return nodes.join(sums, "key").withColumns({"n_leaves": F.col("n_leaves") + F.col("leaf"), "saved_tokens": F.col("saved_tokens") + F.col("save")})


RESULT = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def prefix_tree(turns: DataFrame, family: int = FAMILY, shared: int = SHARED) -> DataFrame:
    """A row (RESULT) for each node of the tree of rebuilt conversations; turns: conv_id, turn, role, text, other columns are left aside.

    See rebuilt for the order of turns, nulls and ties; repeated rows are turns of their own. A conversation may have no turns and is a
    member of the root then. Without conversations there are no nodes. Turns are told apart by 128 bits of a SHA-256 of role and text.
    A conversation's digests are one row, 16 bytes a turn; its texts are not gathered.

    Distinct sequences are sorted over all tasks by their turns, and each task cuts them into shards of SHARD_TURNS. A shard is a double
    array; nodes that it may share with other shards lie on the paths of its first and last sequence, and are merged afterwards. So a hot
    first turn is spread over tasks, and equal conversations are one sequence with a count.
    """
    members = shared_table(rebuilt(turns, family, shared), "trie-rebuilt")
    sequences = members.groupBy("key").agg(F.first("seq").alias("seq"), F.first("words").alias("words"), F.count("*").alias("n"), F.min("conv_id").alias("least"))
    nodes = shared_table(tries(sequences.join(ends(members), "key")), "trie-nodes")
    merged = shared_table(_merged(nodes.filter("open")), "trie-merged")
    above = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above"))
    closed = nodes.filter("not open")
    inner = closed.filter(F.col("parent_key").isNull())
    border = closed.filter(F.col("parent_key").isNotNull()).drop("parent_conv_id").join(above, "parent_key").withColumnRenamed("above", "parent_conv_id")
    upper = merged.join(above, "parent_key", "left").withColumnRenamed("above", "parent_conv_id")
    out = inner.select(*RESULT).unionByName(border.select(*RESULT)).unionByName(upper.select(*RESULT))
    return out.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS)))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_tree(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


ORACLE = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list({'k': sha256(sha256(role) || sha256(text)), 'w': len(regexp_extract_all(text, '[^ \t-\r]+'))} ORDER BY turn NULLS FIRST, role, sha256(text)) AS own FROM t GROUP BY conv_id),
h AS (SELECT conv_id, own, xor(list_reduce(list_prepend(4294967295::BIGINT, [ord(x)::BIGINT FOR x IN string_split(conv_id::VARCHAR, '')]),
        lambda c, x: list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, i: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384::BIGINT) ELSE a // 2 END)), 4294967295::BIGINT) % 4 AS h FROM o),
r AS (SELECT c.conv_id, list_concat(coalesce(p.own, [])[1:c.h], c.own[c.h + 1:]) AS seq FROM h c LEFT JOIN o p ON p.conv_id = c.conv_id - c.conv_id % 20),
m AS (SELECT conv_id, d, len(seq) AS size, seq[d].w AS w, [x.k FOR x IN seq[1:d]] AS node FROM r, unnest(generate_series(0, len(seq))) AS u(d)),
n AS (SELECT node, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(any_value(w), 0) AS w,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (size = d), '')) AS ends_sha256 FROM m GROUP BY node, d),
k AS (SELECT node[1:depth - 1] AS node, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k ON k.node = n.node),
s AS (SELECT node[1:a] AS node, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * w)::BIGINT AS saved_tokens FROM f, unnest(generate_series(0, depth)) AS u(a) GROUP BY ALL)
SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens, f.ends_sha256
FROM f JOIN s ON s.node = f.node LEFT JOIN f p ON p.depth = f.depth - 1 AND p.node = f.node[1:f.depth - 1]
"""
