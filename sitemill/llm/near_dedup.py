"""Set similarity join by chosen paths: trees of minwise tokens bring likely pairs together, whole shingle sets confirm them."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitemill.llm.common import forget, fresh, partitions, read, shared_table

#: Shingle length and similarity where a caller names none.
WORDS, PERCENT = 5, 80
#: Tokens that a path may choose, one below the other, and the share of pairs at the threshold that the trees shall bring together.
DEPTH, RECALL = 3, 0.99999
#: A node above this size branches on by its next token; at full depth its members are tied to its first without further comparison.
NODE = 200
#: Sketch agreement below which a pair in a node is no candidate: so many standard deviations under what the threshold gives.
DEVIATIONS = 6.0
#: Distinct sets, and their shingles, that one task confirms at a time, about. A larger component goes by its leaders, in slices of that size.
BLOCK_SETS, BLOCK_SHINGLES = 3000, 1 << 21
#: So often are the sets that are far from a leader given a leader of their own, and only while it is linked with that share of what is left.
LEADER_ROUNDS, LEADER_SHARE = 4, 0.05
#: A rare token that at most so many sets of a component share brings them together pair by pair; sets that share a commoner one meet in slices.
RARE_SETS = 100
#: Tokens are counted by so many values of their hash, to tell rare from common ones.
_COUNTED = 1 << 18
#: Words that a worker remembers, and the bytes of the longest it does, which together bound what it holds.
_CACHE_WORDS, _CACHE_BYTES = 400_000, 64
_U = np.uint64


def n_trees(percent: int, depth: int = DEPTH, recall: float = RECALL) -> int:
    """Independent trees for the recall: a pair at the threshold shares a tree's whole path with probability threshold ** depth."""
    return math.ceil(math.log(1 - recall) / math.log(1 - (percent / 100) ** depth))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Shingler:
    """Sets of word shingles as sorted distinct 64-bit hashes; A-Z are lower-cased, words parted by ASCII blanks."""

    def __init__(self, words: int):
        self.words, self.known = words, {}

    def of(self, text: str | None) -> np.ndarray:
        tokens = (text or "").encode("utf-8").lower().split()
        if not tokens:
            return np.zeros(0, np.uint64)
        missing = set(tokens).difference(self.known)
        if missing:
            if len(self.known) + len(missing) > _CACHE_WORDS:
                self.known.clear()
                missing = set(tokens)
            self.known.update((w, xxhash.xxh3_64_intdigest(w)) for w in missing)
        h = np.fromiter(map(self.known.__getitem__, tokens), np.uint64, len(tokens))
        for w in missing:
            if len(w) > _CACHE_BYTES:
                del self.known[w]
        k = min(self.words, len(h))  # fewer words: the whole sequence is one shingle
        out = np.full(len(h) - k + 1, k, np.uint64)
        for j in range(k):
            out = _mix(out * _U(0x9E3779B97F4A7C15) + h[j : len(h) - k + 1 + j])
        return np.unique(out)


def minwise(tokens: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The smallest hash of the set's tokens under each seed."""
    out = np.full(len(seeds), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(tokens), 4096):
        part = tokens[at : at + 4096]
        np.minimum(out, _mix(part[None, :] ^ seeds[:, None]).min(axis=1), out=out)
    return out


SKETCHES = "did long, th long, n long, d1 long, d2 long, path array<long>, sketch binary"


def sketches(docs: DataFrame, words: int, trees: int, depth: int = DEPTH) -> DataFrame:
    """One row per document (did, th, text): set size, a digest of the set, the token each tree chooses at each depth, and a byte of each."""
    seeds = np.random.default_rng(17).integers(0, 1 << 63, trees * depth, dtype=np.uint64)
    types = [pa.int64()] * 5 + [pa.list_(pa.int64()), pa.binary()]
    names = [c.split()[0] for c in SKETCHES.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                out = []
                for did, th, text in zip(*(batch.slice(k, 1024).column(i).to_pylist() for i in range(3)), strict=True):
                    s = shingler.of(text)
                    if len(s):
                        path = minwise(s, seeds)
                        digest = [int(_mix(s ^ _U(salt)).sum(dtype=np.uint64).astype(np.int64)) for salt in (0x1234567, 0x89ABCDEF01)]
                        out.append((did, th, len(s), *digest, path.view(np.int64), (path & _U(255)).astype(np.uint8).tobytes()))
                    else:
                        out.append((did, th, 0, 0, 0, [], b""))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return docs.mapInArrow(rows, SKETCHES)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes reaches over edges a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def likely_links(nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b) that tie each node's likely pairs together, at most one a member; nodes of NODE members at most: (node, cid, n, sketch).

    A node's members are compared pair by pair; sizes must allow the threshold and sketches must agree but for chance.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None

        def judge(node, cid, n, sketch) -> pa.RecordBatch:
            m, width, p = len(node), sketch.shape[1], percent / 100
            least = width * p - DEVIATIONS * math.sqrt(width * p * (1 - p))
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for lag in range(1, m):
                i = np.flatnonzero(node[lag:] == node[:-lag])
                if not len(i):
                    break
                j = i + lag
                lo, hi = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
                keep = 100 * lo >= percent * hi
                i, j = i[keep], j[keep]
                for at in range(0, len(i), 1 << 18):
                    x, y = i[at : at + (1 << 18)], j[at : at + (1 << 18)]
                    keep = (sketch[x] == sketch[y]).sum(axis=1) >= least
                    a.append(x[keep]), b.append(y[keep])
            root = _roots(m, np.concatenate(a), np.concatenate(b))
            tied = np.flatnonzero(root != np.arange(m))
            a, b = cid[root[tied]], cid[tied]
            keep = a != b
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[keep]), pa.array(np.maximum(a, b)[keep])], names=["a", "b"])

        for batch in batches:
            now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            now.append(np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(len(now[0]), -1))
            if rest is not None:
                now = [np.concatenate((x, y)) for x, y in zip(rest, now, strict=True)]
            if len(now[0]):
                cut = int(np.flatnonzero(np.r_[True, now[0][1:] != now[0][:-1]])[-1])
                if cut:
                    yield judge(*(x[:cut] for x in now))
                rest = [x[cut:] for x in now]
        if rest is not None:
            yield judge(*rest)

    k = partitions(nodes.sparkSession)
    dealt = nodes.repartition(k, "node").sortWithinPartitions("node", "cid")
    return dealt.mapInArrow(rows, "a long, b long")


def chosen_path_ties(classes: DataFrame, percent: int, trees: int, depth: int = DEPTH) -> DataFrame:
    """(a, b) that tie likely pairs: each set goes to a node in each tree, which branches on by its members' next token while it is large.

    A node that is large at full depth is tied to its first member by a join, which Spark splits: ties only say what is confirmed together.
    """
    spread = classes.select("cid", "n", "sketch", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.slice("path", t * depth + 1, depth))).alias("tree", "way"))
    keys = [F.xxhash64("tree", *[F.col("way")[i] for i in range(d + 1)]) for d in range(depth)]
    rows = spread.select("cid", "n", "sketch", *[k.alias(f"k{d}") for d, k in enumerate(keys)])
    out = rows.withColumn("node", F.col("k0")).withColumn("deep", F.lit(0))
    ties = None
    for d in range(depth):
        # Only rows that are still in a large node need their count.
        large = shared_table(out.filter(F.col("deep") == d).groupBy("node").agg(F.count("*").alias("members"), F.min("cid").alias("first")).filter(F.col("members") > NODE).select("node", "first"), "near-nodes")
        if large.isEmpty():
            break
        if large.count() <= 10_000:
            large = F.broadcast(large)
        out = out.join(large.withColumn("large", F.lit(True)), "node", "left")
        on = F.col("large").isNotNull() & (F.col("deep") == d)
        if d == depth - 1:
            ties = out.filter(on & (F.col("cid") != F.col("first"))).select(F.col("first").alias("a"), F.col("cid").alias("b"))
            out = out.filter(~on)
            break
        out = out.select("cid", "n", "sketch", *[f"k{x}" for x in range(depth)], F.when(on, F.col(f"k{d + 1}")).otherwise(F.col("node")).alias("node"), F.when(on, d + 1).otherwise(F.col("deep")).alias("deep"))
    links = likely_links(out.select("node", "cid", "n", "sketch"), percent)
    return (links if ties is None else links.unionByName(ties)).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(cid, comp): the smallest id that each node of the edges (a, b) reaches. Labels fall to the neighbours' least and then jump on."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = shared_table(both.filter("a <> b").distinct(), "links")
    labels = shared_table(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("cid"), F.least("a", "m").alias("comp")), "labels")
    last = labels
    while True:
        ask = labels.select(F.col("cid").alias("b"), F.col("comp").alias("m"))
        lower = both.join(ask, "b").groupBy("a").agg(F.min("m").alias("m"))
        lower = labels.join(lower.withColumnRenamed("a", "cid"), "cid").select("cid", F.col("comp").alias("old"), F.least("comp", "m").alias("via"))
        jump = lower.join(labels.select(F.col("cid").alias("via"), F.col("comp").alias("far")), "via")
        new = shared_table(jump.select("cid", F.least("via", "far").alias("comp"), (F.least("via", "far") < F.col("old")).alias("moved")), "labels")
        forget(last)
        last, labels = new, new.select("cid", "comp")
        if new.filter("moved").isEmpty():
            forget(both)
            return labels


def confirmed(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """The smallest index that each set reaches over links of full sets: 100 * intersection >= percent * union. All sets hold a token.

    One pass compares a set with all others. Jaccard distance keeps the triangle inequality: where b is linked to the leader L and c is
    at more than twice the threshold's distance from L, b and c have no link. So once all unlinked sets within that reach of L have
    passes of their own, the sets linked to L need none. Leaders are the sets of the commonest tokens, as the centre of a group has.
    """
    m, block = len(sets), _Block(sets, percent)
    often = np.bincount(block.ids)
    score = np.add.reduceat(often[block.ids], block.starts) / block.sizes
    order = np.argsort(-score, kind="stable")
    done, passed = np.zeros(m, bool), np.zeros(m, bool)
    a, b = [], []

    def compare(i: int) -> np.ndarray:
        reach = block.reach(i)
        at = np.flatnonzero(reach == 2)
        a.append(np.full(len(at), i)), b.append(at)
        passed[i] = done[i] = True
        return reach

    for lead in order.tolist():
        if done[lead]:
            continue
        reach = compare(lead)
        for c in np.flatnonzero((reach == 1) & ~passed).tolist():
            compare(c)
        done |= reach == 2
    return _roots(m, np.concatenate(a), np.concatenate(b))


class _Block:
    """Sets as one run of token ids, to compare one with all."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.sizes, self.percent = np.array([len(s) for s in sets], np.int64), percent
        _, self.ids = np.unique(np.concatenate(sets), return_inverse=True)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.mark = np.zeros(int(self.ids.max()) + 1, bool)

    def reach(self, i: int) -> np.ndarray:
        """Of each set: 2 where linked with set i, 1 where one linked with set i may be linked with it, else 0."""
        own = self.ids[self.starts[i] : self.starts[i] + self.sizes[i]]
        self.mark[own] = True
        shared = np.add.reduceat(self.mark[self.ids].view(np.int8), self.starts, dtype=np.int64)
        self.mark[own] = False
        union = self.sizes + self.sizes[i] - shared
        return np.where(100 * shared >= self.percent * union, 2, np.where(100 * shared >= (2 * self.percent - 100) * union, 1, 0))


def _within(members: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b): each set of a small component and the smallest it reaches within it; members: (comp, cid, text)."""

    def judge(ids: list[int], sets: list[np.ndarray], _: list[bool]) -> list[tuple[int, int]]:
        root = confirmed(sets, percent) if len(sets) > 1 else [0]
        return [(ids[r], c) for r, c in zip(root, ids, strict=True)]

    return _by_group(members.select("comp", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(False).alias("lead"), "cid", "text"), words, "a long, b long", judge)


def _by_group(rows_: DataFrame, words: int, schema: str, judge) -> DataFrame:
    """judge(ids, sets, leads) over the rows (comp, i, j, lead, cid, text) of each group (comp, i, j), leads first, a repeated row once."""
    names = [c.split()[0] for c in schema.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        group, ids, sets, leads = None, [], [], []

        def told() -> pa.RecordBatch:
            found = judge(ids, sets, leads)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*found, strict=True) if found else [[]] * len(names))], names=names)

        for batch in batches:
            for *key, lead, cid, text in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if key != group:
                    if sets:
                        yield told()
                    group, ids, sets, leads = key, [], [], []
                if not ids or (ids[-1], leads[-1]) != (cid, lead):
                    ids.append(cid), sets.append(shingler.of(text)), leads.append(lead)
        if sets:
            yield told()

    dealt = rows_.repartition(partitions(rows_.sparkSession), "comp", "i", "j").sortWithinPartitions("comp", "i", "j", F.desc("lead"), "cid")
    return dealt.mapInArrow(rows, schema)


def _slices(rows: DataFrame, by: str, name: str) -> DataFrame:
    """rows (by, n, cid) with the number of slices that each group needs and the slice that each row is in."""
    sizes = rows.groupBy(by).agg(F.count("*").alias("_m"), F.sum("n").alias("_s"))
    slices = F.greatest(F.ceil(F.col("_m") / BLOCK_SETS), F.ceil(F.col("_s") / BLOCK_SHINGLES)).cast("long")
    out = rows.join(sizes.select(by, slices.alias(f"{name}s")), by)
    return out.withColumn(name, F.pmod(F.xxhash64("cid", F.lit(7)), F.col(f"{name}s")))


def _centres(members: DataFrame) -> DataFrame:
    """(comp, cid) of the member of each component (comp, cid, sketch) whose sketch agrees most with those of all, ties to the smaller."""
    each = members.select("comp", "cid", F.posexplode(F.split(F.hex("sketch"), "(?<=\\G..)")).alias("at", "byte"))
    often = each.groupBy("comp", "at", "byte").agg(F.count("*").alias("n"))
    usual = often.groupBy("comp", "at").agg(F.max_by("byte", F.struct("n", "byte")).alias("byte"))
    usual = usual.groupBy("comp").agg(F.array_sort(F.collect_list(F.struct("at", "byte"))).alias("usual"))
    bytes_ = F.split(F.hex("sketch"), "(?<=\\G..)")
    agree = F.size(F.filter(F.arrays_zip(bytes_.alias("x"), F.col("usual.byte").alias("y")), lambda z: z["x"] == z["y"]))
    scored = members.join(usual, "comp").select("comp", "cid", agree.alias("agree"))
    return scored.groupBy("comp").agg(F.max_by("cid", F.struct("agree", -F.col("cid"))).alias("cid"))


def _rarity(members: DataFrame, words: int) -> np.ndarray:
    """For each of _COUNTED values of a token's hash how often the members' (text) sets hold it, as a byte of the logarithm."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, n = Shingler(words), np.zeros(_COUNTED, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                np.add.at(n, (shingler.of(text) % _U(_COUNTED)).astype(np.int64), 1)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["at", "n"])

    found = members.select("text").mapInArrow(rows, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(_COUNTED, np.uint8)
    out[found["at"].to_numpy()] = np.minimum(255, 8 * np.log2(found["n"].to_numpy() + 1.0))
    return out


def _prefixes(members: DataFrame, words: int, percent: int) -> DataFrame:
    """(comp, cid, waits, n, token, place) of the rarest tokens of each set, so many that linked sets share one of them; members: (comp, cid, waits, text).

    Any order of tokens that is the same for all sets does: of 100 tokens 80 are shared, so not all of 21 can be missing on the other side.
    """
    rarity = _rarity(members, words)
    types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64()]
    names = ["comp", "cid", "waits", "n", "token", "place"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                sets = [shingler.of(text) for text in part.column(3).to_pylist()]
                own = [s[np.argsort(rarity[(s % _U(_COUNTED)).astype(np.int64)], kind="stable")[: len(s) - (percent * len(s) + 99) // 100 + 1]] for s in sets]
                each = np.array([len(x) for x in own])
                out = [np.repeat(part.column(i).to_numpy(zero_copy_only=False), each) for i in range(3)]
                out += [np.repeat([len(s) for s in sets], each), np.concatenate(own).view(np.int64), np.concatenate([np.arange(n) for n in each])]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)

    return members.select("comp", "cid", "waits", "text").mapInArrow(rows, "comp long, cid long, waits boolean, n long, token long, place long")


def _rare_pairs(prefixes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(comp, a, b) of sets that share a rare token and may be linked, one of which waits; (comp, cid) of those that share a commoner one.

    A linked pair is in the first, or both its sets are in the second: at the first token that they share, what is left of both must do.
    """
    on = ["comp", "token"]
    often = prefixes.groupBy(*on).agg(F.count("*").alias("m"), F.bool_or("waits").alias("w")).filter((F.col("m") > 1) & F.col("w"))
    met = shared_table(prefixes.join(often.select(*on, "m"), on), "near-prefixes")
    groups = met.filter(F.col("m") <= RARE_SETS).groupBy(*on).agg(F.collect_list(F.struct("cid", "waits", "n", "place")).alias("g"))
    pairs = groups.select("comp", F.explode("g").alias("x"), "g").select("comp", "x", F.explode("g").alias("y")).filter("x.cid < y.cid AND (x.waits OR y.waits)")
    left = F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place"))
    near = (100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")) & ((100 + percent) * left >= percent * (F.col("x.n") + F.col("y.n")))
    return pairs.filter(near).select("comp", F.col("x.cid").alias("a"), F.col("y.cid").alias("b")).distinct(), met.filter(F.col("m") > RARE_SETS).select("comp", "cid").distinct()


def _forest(links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """As many of the links as connect the same."""
    root: dict[int, int] = {}
    for ra, rb in sorted(set(links)):
        while root.get(ra, ra) != ra:
            ra = root[ra]
        while root.get(rb, rb) != rb:
            rb = root[rb]
        root[max(ra, rb)] = min(ra, rb)
    return [(a, b) for b, a in root.items() if a != b]


def _by_leaders(members: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b): links of components too large for one task, enough for their connection; members: (comp, cid, n, sketch, text).

    All sets of a component meet its leader in slices. Those linked with it are settled among themselves. Jaccard distance keeps the
    triangle inequality, so sets at more than twice the threshold's distance are linked with none of these, and get a leader of their
    own. Sets between both, and those that leaders leave, wait: they meet the others with which they share one of their rarest tokens,
    pair by pair where few share it, else slice by slice.
    """

    def led(ids: list[int], sets: list[np.ndarray], leads: list[bool]) -> list[tuple[int, int, int]]:
        return [(ids[0], c, r) for c, r in zip(ids[1:], _Block(sets, percent).reach(0)[1:].tolist(), strict=True)]

    def met(ids: list[int], sets: list[np.ndarray], leads: list[bool]) -> list[tuple[int, int]]:
        block, out = _Block(sets, percent), []
        for i in range(sum(leads)):
            out += [(min(ids[i], ids[k]), max(ids[i], ids[k])) for k in np.flatnonzero(block.reach(i) == 2).tolist() if ids[k] != ids[i]]
        return _forest(out)

    def paired(ids: list[int], sets: list[np.ndarray], leads: list[list[int] | None]) -> list[tuple[int, int]]:
        at, out = {c: k for k, (c, other) in enumerate(zip(ids, leads, strict=True)) if other is None}, []
        for own, a, others in zip(sets, ids, leads, strict=True):
            if others is None:
                break
            ks = [at[b] for b in others]
            sizes, tokens = np.array([len(sets[k]) for k in ks]), np.concatenate([sets[k] for k in ks])
            held = own[np.minimum(np.searchsorted(own, tokens), len(own) - 1)] == tokens
            shared = np.add.reduceat(held, np.cumsum(sizes) - sizes, dtype=np.int64)
            out += [(a, others[k]) for k in np.flatnonzero(100 * shared >= percent * (sizes + len(own) - shared)).tolist()]
        return _forest(out)

    open_, links, waiting = members.select("comp", "cid", "n", "sketch"), [], []
    for _ in range(LEADER_ROUNDS):
        sliced = _slices(open_, "comp", "i")
        leader = shared_table(_centres(open_), "near-leaders")
        rows = sliced.join(leader.select("comp", F.col("cid").alias("leader")), "comp").filter("cid <> leader").select("comp", "i", F.lit(False).alias("lead"), "cid")
        all_slices = F.explode(F.sequence(F.lit(0).cast("long"), F.col("is") - 1))
        leads = leader.join(sliced.select("comp", "is").distinct(), "comp").select("comp", all_slices.alias("i"), F.lit(True).alias("lead"), "cid")
        asked = rows.unionByName(leads).join(members.select("comp", "cid", "text"), ["comp", "cid"])
        found = shared_table(_by_group(asked.select("comp", "i", F.lit(0).alias("j"), "lead", "cid", "text"), words, "a long, b long, reach long", led), "near-led")
        links.append(found.filter("reach = 2").select("a", "b"))
        worth = found.groupBy("a").agg(F.avg((F.col("reach") == 2).cast("int")).alias("share")).filter(F.col("share") >= LEADER_SHARE)
        far = found.filter("reach = 0")
        waiting += [found.filter("reach = 1").select(F.col("b").alias("cid")), far.join(worth, "a", "left_anti").select(F.col("b").alias("cid"))]
        open_ = shared_table(open_.join(far.join(worth, "a", "left_semi").select(F.col("b").alias("cid")), "cid", "left_semi"), "near-far")
        if open_.isEmpty():
            break
    waiting = functools.reduce(DataFrame.unionByName, [*waiting, open_.select("cid")]).withColumn("waits", F.lit(True))
    texts = members.select("comp", "cid", "text")
    marked = shared_table(texts.join(waiting, "cid", "left").withColumn("waits", F.coalesce("waits", F.lit(False))), "near-waiting")
    pairs, common = _rare_pairs(_prefixes(marked, words, percent), percent)
    slices = _slices(members.select("comp", "cid", "n"), "comp", "j").select("comp", F.col("js").alias("s")).distinct()
    place = lambda c: F.pmod(F.xxhash64(c, F.lit(7)), F.col("s"))
    placed = shared_table(pairs.join(slices, "comp").select("comp", place("a").alias("i"), place("b").alias("j"), "a", "b"), "near-pairs")
    asked = placed.groupBy("comp", "i", "j", F.col("a").alias("cid")).agg(F.collect_list("b").alias("lead"))
    asked = asked.unionByName(placed.select("comp", "i", "j", F.col("b").alias("cid"), F.lit(None).cast("array<long>").alias("lead")).distinct())
    asked = asked.join(texts, ["comp", "cid"]).select("comp", "i", "j", "lead", "cid", "text")
    links.append(_by_group(asked, words, "a long, b long", paired))
    common = shared_table(members.select("comp", "cid", "n").join(common, ["comp", "cid"], "left_semi").join(marked.select("cid", "waits"), "cid"), "near-common")
    if not common.isEmpty():
        own, others = _slices(common.filter("waits"), "comp", "i"), _slices(common, "comp", "j")
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        asked = own.join(others.select("comp", "js").distinct(), "comp").select("comp", "i", every("js").alias("j"), F.lit(True).alias("lead"), "cid")
        asked = asked.unionByName(others.join(own.select("comp", "is").distinct(), "comp").select("comp", every("is").alias("i"), "j", F.lit(False).alias("lead"), "cid"))
        asked = asked.join(texts, ["comp", "cid"]).select("comp", "i", "j", "lead", "cid", "text")
        links.append(_by_group(asked, words, "a long, b long", met))
    return functools.reduce(DataFrame.unionByName, links)


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, th, n_shingles, component_id) for each row of docs; th is xxhash64 of its text.

    A document's set holds its distinct word shingles; with fewer words the whole sequence is one. Documents are linked where 100 *
    intersection >= percent * union; component_id is the smallest doc_id that links reach. Null, empty and blank texts have no set and
    are linked with nothing, and neither are rows without doc_id (their component_id is null). Rows that repeat a doc_id count as one
    document where they fall in the same component. Equal sets are one class, so groups of copies cost one row beyond their count; sets
    count as equal by their size and two 64-bit sums over their shingles' hashes, and only links between classes are confirmed on sets.
    """
    trees = n_trees(percent)
    keyed = docs.select(F.col("doc_id").cast("long").alias("did"), F.xxhash64("text").alias("th"), "text")
    made = shared_table(sketches(keyed, words, trees), "near-sketches")
    own = ["n", "d1", "d2"]
    usable = made.filter((F.col("n") > 0) & F.col("did").isNotNull())
    classes = usable.groupBy(*own).agg(F.min(F.struct("did", "th")).alias("rep"), F.first("path").alias("path"), F.first("sketch").alias("sketch"))
    classes = shared_table(classes.select(*own, F.col("rep.did").alias("cid"), F.col("rep.th").alias("th"), "path", "sketch"), "near-classes")
    likely = components(chosen_path_ties(classes, percent, trees))
    placed = shared_table(likely.join(classes.select("cid", "th", "n", "sketch"), "cid"), "near-placed")
    blocks = placed.groupBy("comp").agg(F.count("*").alias("members"), F.sum("n").alias("shingles"))
    large = shared_table(blocks.filter((F.col("members") > BLOCK_SETS) | (F.col("shingles") > BLOCK_SHINGLES)).select("comp"), "near-blocks")
    # Texts are shuffled once, for components of every size. Members grow with them: both sides are always sorted, none is broadcast.
    chosen = placed.join(large.withColumn("large", F.lit(True)), "comp", "left").withColumn("large", F.coalesce("large", F.lit(False)))
    texts = keyed.withColumnRenamed("did", "cid").join(chosen.hint("merge"), ["cid", "th"]).dropDuplicates(["cid", "th"])
    texts = shared_table(texts, "near-members")
    links = _within(texts.filter(~F.col("large")), words, percent)
    roots = links.select(F.col("b").alias("cid"), F.col("a").alias("root"))
    if not large.isEmpty():
        linked = _by_leaders(texts.filter("large").drop("large"), words, percent)
        roots = roots.unionByName(components(linked).select("cid", F.col("comp").alias("root")))
    roots = classes.select(*own, "cid").join(roots.filter("cid <> root"), "cid", "left").select(*own, F.coalesce("root", "cid").alias("root"))
    out = made.select("did", "th", *own).join(shared_table(roots, "near-roots"), own, "left")
    return out.select(F.col("did").alias("doc_id"), "th", F.col("n").alias("n_shingles"), F.when(F.col("did").isNotNull(), F.coalesce("root", "did")).alias("component_id"))


def drop_near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs with one document of each component: that of the smallest doc_id, repeated rows of it once. Rows without doc_id stay."""
    found = near_duplicates(docs, words, percent)
    did, th = fresh(docs, "_did"), fresh(docs, "_th")
    keep = found.filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias(did), F.col("th").alias(th)).distinct()
    keyed = docs.withColumns({did: F.col("doc_id").cast("long"), th: F.xxhash64("text")})
    named = keyed.filter(F.col(did).isNotNull()).join(keep, [did, th], "left_semi").dropDuplicates([did, th])
    return named.unionByName(keyed.filter(F.col(did).isNull())).select(*docs.columns)


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"), words=2)
    return found.select("doc_id", "n_shingles", "component_id", (F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))).alias("kept"))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\v\f\r]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) >= 2 THEN w[i] || ' ' || w[i + 1] ELSE w[1] END AS g FROM d, unnest(generate_series(1, greatest(len(w) - 1, 1))) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * k >= 80 * (nx.n + ny.n - k)),
e AS (SELECT x AS a, y AS b FROM l UNION ALL SELECT y, x FROM l),
c(doc_id, r) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, c.r FROM c JOIN e ON e.a = c.doc_id)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(c.r) AS component_id, d.doc_id = min(c.r) AS kept
FROM d JOIN c ON c.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""
