"""Exact removal of long repeated byte strings, by suffix order and longest-previous-factor arrays around content-defined anchors.

Every string of L bytes holds one anchor: the L/4-byte gram of the smallest hash within it, the leftmost of equals. Equal strings have
equal anchors, so all that may match a string meets it in its anchor's group, and nothing is lost. What surrounds an anchor (its
context) holds every L-byte string it stands for. Contexts that are alike are counted, not gathered; of those that differ under one
anchor each is fetched once. Their suffixes are put in order with common-prefix lengths, previous and next smaller positions in that
order give each suffix its longest previous factor, and a string repeats where a factor reaches its length. Contexts count as alike by
the hash of their anchor and a digest of 128 bits.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitemill.llm.common import forget, fresh, partitions, read, shared_table

MIN_BYTES = 400
#: Contexts that a task orders at a time, and above which an anchor's contexts are dealt anew by the bytes that strings around it share.
BATCH_CONTEXTS, MAX_GROUP = 6000, 1200
#: Bytes of a text that are hashed at a time, and the bits of a sort key that hold a place among them.
_STRETCH, _PLACE_BITS = 1 << 22, 24
_BASE = 0x9E3779B97F4A7C15 | 1
_OUTSIDE = 256
_NO_ID = -(1 << 63)


@functools.cache
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of the base, of its inverse, and a random word for each byte, modulo 2^64."""
    n = _STRETCH + (1 << 16)
    inverse = np.uint64(pow(_BASE, -1, 1 << 64))
    powers = lambda b: np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(n - 1, b, dtype=np.uint64), dtype=np.uint64)))
    words = np.random.default_rng(3).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return powers(np.uint64(_BASE)), powers(inverse), words


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every gram of so many bytes."""
    up, down, words = _powers()
    n = len(data)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words[data] * up[:n], dtype=np.uint64)))
    h = (sums[size:] - sums[:-size]) * down[: n - size + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(x.dtype).max, dtype=x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, gram hashes) of the anchors of every string of length bytes, in order; none for shorter texts."""
    gram = length // 4
    places, hashes = [], []
    for at in range(0, len(data) - length + 1, _STRETCH):
        part = data[at : at + _STRETCH + length - 1]
        h = gram_hashes(part, gram)
        mask = np.uint64((1 << _PLACE_BITS) - 1)
        key = (h & ~mask) | np.arange(len(h), dtype=np.uint64)
        found = (sliding_minimum(key, length - gram + 1) & mask).astype(np.int64)
        found = found[np.r_[True, found[1:] != found[:-1]]]
        places.append(found + at)
        hashes.append(h[found])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    place, first = np.unique(np.concatenate(places), return_index=True)
    return place, np.concatenate(hashes)[first]


def context(data: bytes, place: int, length: int) -> tuple[int, bytes]:
    """(bytes before the anchor, the bytes around it): all that strings which hold the anchor's gram can reach."""
    left = min(place, length - length // 4)
    return left, data[place - left : place + length]


def smaller_before(rank: np.ndarray, common: np.ndarray) -> np.ndarray:
    """For each place of a suffix order the common prefix with the nearest place before it of smaller rank; 0 where there is none.

    common[i] is the common prefix of places i - 1 and i, common[0] is 0. Every place first looks at the one before it; while that has
    the larger rank, the place takes over where that one looks, and the smaller of both common prefixes. What lies between a place and
    where it looks always has larger ranks, so the nearest smaller place is found, in few rounds over ever fewer places.
    """
    m = len(rank)
    to, shared = np.arange(-1, m - 1), common[:m].copy()
    ranks = np.r_[rank, -1]  # -1, before the first place, is smaller than all
    larger = np.flatnonzero(ranks[to] > rank)
    while len(larger):
        via = to[larger]
        shared[larger] = np.minimum(shared[larger], shared[via])
        to[larger] = to[via]
        larger = larger[ranks[to[larger]] > rank[larger]]
    return shared


def previous_factors(rank: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The longest previous factor of each place of a suffix order: the longer of the common prefixes with the previous and with the
    next smaller rank. common has one entry more than rank, 0 at both ends."""
    return np.maximum(smaller_before(rank, common), smaller_before(rank[::-1], common[::-1])[::-1])


def longest_factors(contexts: np.ndarray, length: int, rank: np.ndarray, later: bool) -> np.ndarray:
    """Longest-previous-factor array of the suffixes of aligned contexts: (contexts, starts), over all starts that leave length bytes.

    A suffix's longest previous factor is the longest prefix it shares with a suffix of a context of smaller rank at the same start;
    with later, of any other context: the longer of the factors by rank and by falling rank. Factors below length are given as 0.
    contexts: rows aligned at their anchors. The suffix order at a column comes from that at the column after it by one stable sort on
    the column's bytes, and common prefixes of neighbours from the smallest between them. Only where neighbours share length bytes can
    a factor reach it, so the previous and next smaller ranks are sought within such stretches.
    """
    m, width = contexts.shape
    out = np.zeros((m, width - length + 1), dtype=np.int32)
    columns = np.ascontiguousarray(contexts.T)
    order, common = np.arange(m), np.zeros(m + 1, dtype=np.int32)  # common[i]: of order[i - 1] and order[i]
    for at in range(width - 1, -1, -1):
        byte = columns[at][order]
        step = np.argsort(byte, kind="stable")
        byte = byte[step]
        same = np.flatnonzero(byte[1:] == byte[:-1]) + 1
        new = np.zeros(m + 1, dtype=np.int32)
        if len(same):
            ends = np.empty(2 * len(same), dtype=np.int64)
            ends[0::2], ends[1::2] = step[same - 1] + 1, step[same] + 1
            new[same] = np.minimum.reduceat(common, ends)[0::2] + 1
        order, common = order[step], new
        if at <= width - length:
            long = common >= length
            places = np.flatnonzero(long[:m] | long[1:])
            if len(places):
                own = order[places]
                shared = np.r_[np.where(long[places], common[places], 0), 0]
                factors = previous_factors(rank[own], shared)
                if later:
                    factors = np.maximum(factors, previous_factors(m - 1 - rank[own], shared))
                out[own, at] = np.where(factors >= length, factors, 0)
    return out


def _grid(rows: list[tuple], length: int) -> np.ndarray:
    """Contexts (group, left, bytes) as aligned rows. Places outside a text hold a value that is no byte, and the anchor's first byte,
    which every start's string holds, gives way to the number of the group: only contexts of one group are alike there."""
    before = length - length // 4
    grid = np.full((len(rows), before + length), _OUTSIDE, dtype=np.uint16)
    for i, (group, left, data) in enumerate(rows):
        grid[i, before - left : before - left + len(data)] = np.frombuffer(data, np.uint8)
        grid[i, before] = _OUTSIDE + 1 + group
    return grid


def _whole(grid: np.ndarray, length: int) -> np.ndarray:
    """Which starts have length bytes inside the text."""
    inside = np.concatenate((np.zeros((len(grid), 1), np.int32), np.cumsum(grid != _OUTSIDE, axis=1, dtype=np.int32)), axis=1)
    return inside[:, length:] - inside[:, :-length] == length


def _runs(flags: np.ndarray, before: int) -> list[list[int]]:
    """[first, last] of each run of true starts, from the anchor's place."""
    edges = np.flatnonzero(np.diff(np.r_[0, flags.view(np.int8), 0]))
    return [[int(a) - before, int(b) - 1 - before] for a, b in edges.reshape(-1, 2)]


ANCHORS = "did long, th long, pos int, ah long, ch long, cl long"
_RUNS = pa.list_(pa.list_(pa.int32()))
#: What names a context: the hash of its anchor's gram and 128 bits of a digest of its bytes and the anchor's place in them.
_CONTEXT = ["ah", "ch", "cl"]


def _anchor_rows(docs: DataFrame, length: int) -> DataFrame:
    names = [c.split()[0] for c in ANCHORS.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                did, th, pos, ah, digests = [], [], [], [], []
                for d, t, text in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    data = (text or "").encode("utf-8")
                    if len(data) < length:
                        continue
                    place, h = anchors(np.frombuffer(data, np.uint8), length)
                    did.append(np.full(len(place), d, np.int64))
                    th.append(np.full(len(place), t, np.int64))
                    pos.append(place.astype(np.int32))
                    ah.append(h.view(np.int64))
                    seen = (context(data, p, length) for p in place.tolist())
                    digests += [xxhash.xxh3_128_digest(c, left) for left, c in seen]
                if did:
                    halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                    columns = [*(np.concatenate(x) for x in (did, th, pos, ah)), halves[:, 0].copy(), halves[:, 1].copy()]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=names)

    return docs.mapInArrow(rows, ANCHORS)


def _fetch(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of wanted contexts (did, th, pos, ah, ch, cl): (ah, ch, cl, did, pos, left, data)."""
    by_doc = wanted.groupBy("did", "th").agg(F.collect_list(F.struct("pos", *_CONTEXT)).alias("wanted"))
    schema = "ah long, ch long, cl long, did long, pos int, left int, data binary"
    types = [pa.int64()] * 4 + [pa.int32(), pa.int32(), pa.binary()]
    names = [c.split()[0] for c in schema.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256).to_pylist()
                out = []
                for r in part:
                    data = r["text"].encode("utf-8")
                    out += [(w["ah"], w["ch"], w["cl"], r["did"], w["pos"], *context(data, w["pos"], length)) for w in r["wanted"]]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return docs.join(by_doc, ["did", "th"]).mapInArrow(rows, schema)


def _ordered(contexts: DataFrame, length: int, first: bool) -> DataFrame:
    """(ah, ch, cl, runs) of contexts (group1, group2, ah, ch, cl, did, pos, left, data) with repeated strings.

    Suffix order and longest previous factors within groups, which lie whole within a batch; ranks are places in the corpus.
    """
    before = length - length // 4
    types = [pa.int64()] * 3 + [_RUNS]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple] = {}
        group, number = None, 0

        def judge() -> pa.RecordBatch:
            keys, items = list(held), list(held.values())
            grid = _grid([(k[0], *v[2:]) for k, v in zip(keys, items, strict=True)], length)
            rank = np.empty(len(items), np.int64)
            rank[sorted(range(len(items)), key=lambda i: items[i][:2])] = np.arange(len(items))
            hits = (longest_factors(grid, length, rank, later=not first) >= length) & _whole(grid, length)
            at = np.flatnonzero(hits.any(axis=1)).tolist()
            columns = [*([keys[i][c] for i in at] for c in (1, 2, 3)), [_runs(hits[i], before) for i in at]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[*_CONTEXT, "runs"])

        for batch in batches:
            for g1, g2, ah, ch, cl, did, pos, left, data in zip(*(batch.column(i).to_pylist() for i in range(9)), strict=True):
                if (g1, g2) != group:
                    if len(held) >= BATCH_CONTEXTS:
                        yield judge()
                        held.clear()
                        number = 0
                    group, number = (g1, g2), number + 1
                held.setdefault((number, ah, ch, cl), (did, pos, left, data))
        if held:
            yield judge()

    groups = ["group1", "group2"]
    rows_ = contexts.select(*groups, *_CONTEXT, "did", "pos", "left", "data")
    dealt = rows_.repartition(partitions(contexts.sparkSession), *groups).sortWithinPartitions(*groups, *_CONTEXT)
    return dealt.mapInArrow(rows, "ah long, ch long, cl long, runs array<array<int>>")


#: Of one half of a range of starts: its first and last start, the digest of what its strings share and that of all they reach.
_HALF = "lo int, hi int, group1 long, group2 long, whole1 long, whole2 long"
_HALF_ARROW = pa.struct([(c.split()[0], pa.int32() if c.endswith("int") else pa.int64()) for c in _HALF.split(", ")])


def _parts(contexts: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Ranges of starts in two halves: contexts (ah, ch, cl, did, pos, left, data, ranges) to the halves where a string fits, and their table.

    Every string that starts in a range holds the bytes from the range's end to its start and length on, so contexts that share such a
    string have equal groups, a digest of those bytes. whole is a digest of all bytes that the range's strings reach.
    """
    own = ["did", "pos", *_CONTEXT]

    def half(data: bytes, left: int, a: int, b: int) -> dict | None:
        first, last = max(a, -left), min(b, len(data) - left - length)
        if first > last:
            return None
        shared = xxhash.xxh3_128_digest(data[left + b : left + a + length], a + length)
        reached = xxhash.xxh3_128_digest(data[left + first : left + last + length], (first - a) * length + b - last)
        g1, g2, w1, w2 = np.frombuffer(shared + reached, np.int64).tolist()
        return {"lo": a, "hi": b, "group1": g1, "group2": g2, "whole1": w1, "whole2": w2}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, lower, upper = [], [], []
            for k, r in enumerate(batch.select(["left", "data", "ranges"]).to_pylist()):
                for lo, hi in r["ranges"]:
                    middle = (lo + hi) // 2
                    of.append(k)
                    lower.append(half(r["data"], r["left"], lo, middle))
                    upper.append(half(r["data"], r["left"], middle + 1, hi))
            kept = batch.select(own).take(pa.array(of, pa.int32()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(lower, _HALF_ARROW), pa.array(upper, _HALF_ARROW)], names=[*own, "lower", "upper"])

    struct = f"struct<{_HALF.replace(' int', ':int').replace(' long', ':long')}>"
    both = shared_table(contexts.mapInArrow(rows, f"did long, pos int, ah long, ch long, cl long, lower {struct}, upper {struct}"), "suffix-parts")
    one = lambda c: both.filter(F.col(c).isNotNull()).select(*own, f"{c}.*")
    return one("lower").unionByName(one("upper")), both


def _split(contexts: DataFrame, length: int, first: bool) -> tuple[DataFrame, list[DataFrame]]:
    """As _ordered, for anchors of more than MAX_GROUP contexts: (ah, ch, cl, runs), and the tables that are read for it.

    An anchor's contexts are dealt anew by ever smaller ranges of starts and the bytes that all strings of a range hold, until a group
    has MAX_GROUP contexts at most and is ordered like any other. Of contexts that are alike over a range the first goes on alone: the
    range is a run of all others, and so of the first where later copies count. A range of one start ends so, and a group of one context
    ends at once. The contexts' bytes are joined anew in each round; what is stored are digests.
    """
    contexts = shared_table(contexts.dropDuplicates(_CONTEXT), "suffix-large")
    edge = length - length // 4
    rows, found, small, read_ = contexts.withColumn("ranges", F.array(F.array(F.lit(-edge), F.lit(0)))), [], [], [contexts]
    group, alike, own = ["group1", "group2", "lo"], ["group1", "group2", "lo", "hi", "whole1", "whole2"], ["did", "pos", *_CONTEXT]
    while True:
        parts, table = _parts(rows, length)
        classes = shared_table(parts.groupBy(*alike).agg(F.count("*").alias("n"), F.min(F.struct(*own)).alias("rep")), "suffix-classes")
        hits = parts.join(classes.filter("n > 1"), alike)
        if first:
            hits = hits.filter(F.struct(*own) != F.col("rep"))
        found.append(hits.select(*_CONTEXT, F.array(F.array("lo", "hi")).alias("runs")))
        sizes = shared_table(classes.filter("lo < hi").groupBy(*group).agg(F.count("*").alias("members")).filter("members > 1"), "suffix-sizes")
        met = shared_table(classes.join(sizes, group).select("group1", "group2", "lo", "hi", "members", "rep.*"), "suffix-met-parts")
        small.append(met.filter(F.col("members") <= MAX_GROUP).select("group1", "group2", *_CONTEXT))
        read_ += [table, classes, sizes, met]
        open_ = met.filter(F.col("members") > MAX_GROUP)
        if open_.isEmpty():
            break
        rows = contexts.join(open_.groupBy(*_CONTEXT).agg(F.collect_list(F.array("lo", "hi")).alias("ranges")), _CONTEXT)
    ordered = functools.reduce(DataFrame.unionByName, small).join(contexts, _CONTEXT)
    runs = functools.reduce(DataFrame.unionByName, [*found, _ordered(ordered, length, first)])
    return runs.groupBy(*_CONTEXT).agg(F.flatten(F.collect_list("runs")).alias("runs")), read_


def repeated_spans(docs: DataFrame, length: int, first: bool) -> DataFrame:
    """(did, th, marks): for each text with repeats, its anchors' places with the runs of repeated starts around them.

    docs: did, th, text. A mark without runs stands for a context that other texts, or another place, hold as it is.
    """
    every = shared_table(_anchor_rows(docs, length), "suffix-anchors")
    # An anchor that stands once in all texts has no partner; most are such, and only their hashes are shuffled to tell.
    met = shared_table(every.groupBy("ah").agg(F.count("*").alias("n_places")).filter("n_places > 1").select("ah"), "suffix-met")
    found = shared_table(every.join(met, "ah", "left_semi"), "suffix-places")
    forget(every, met)
    where = F.struct("did", "th", "pos")
    contexts = shared_table(found.groupBy(*_CONTEXT).agg(F.count("*").alias("n"), F.min(where).alias("rep")), "suffix-contexts")
    # Written, so that the join by anchor has plain exchanges on both sides: Spark then splits an anchor of very many contexts.
    per_anchor = shared_table(contexts.groupBy("ah").agg(F.count("*").alias("n_contexts")).filter("n_contexts > 1"), "suffix-differing")
    differing = contexts.join(per_anchor, "ah").select(*_CONTEXT, "rep.did", "rep.th", "rep.pos")
    fetched = shared_table(_fetch(docs, differing, length), "suffix-texts")
    large = per_anchor.filter(F.col("n_contexts") > MAX_GROUP).select("ah")
    grouped = fetched.withColumns({"group1": F.col("ah"), "group2": F.lit(0).cast("long")})
    read_ = [per_anchor, fetched]
    if large.isEmpty():
        runs = _ordered(grouped, length, first)
    else:
        runs = _ordered(grouped.join(large, "ah", "left_anti"), length, first)
        split, more = _split(fetched.join(large, "ah", "left_semi"), length, first)
        runs, read_ = runs.unionByName(split), read_ + more
    runs = shared_table(runs, "suffix-runs")
    forget(*read_)
    marks = contexts.join(runs, _CONTEXT, "left").filter(F.col("runs").isNotNull() | (F.col("n") > 1))
    # Written once, so that both sides of the join below are plain exchanges: Spark then splits the contexts that very many texts hold.
    marks = shared_table(marks, "suffix-marks")
    forget(runs, contexts)
    hits = found.join(marks, _CONTEXT)
    alike = F.col("n") > 1
    if first:  # the first of equal contexts keeps what no other context has before it
        alike = alike & (where != F.col("rep"))
    hits = hits.select("did", "th", "pos", F.when(~alike, F.col("runs")).alias("runs"), alike.alias("alike")).filter(F.col("alike") | F.col("runs").isNotNull())
    return hits.groupBy("did", "th").agg(F.collect_list(F.struct("pos", "alike", "runs")).alias("marks"))


def removed_bytes(n: int, marks: list[dict] | None, length: int) -> np.ndarray:
    """Which of a text's n bytes lie in a repeated string."""
    if not marks:
        return np.zeros(n, dtype=bool)
    before = length - length // 4
    step = np.zeros(n + 1, dtype=np.int32)
    for mark in marks:
        place = mark["pos"]
        for lo, hi in [[-before, 0]] if mark["alike"] else mark["runs"]:
            start, last = max(0, place + lo), min(place + hi, n - length)
            if start <= last:
                step[start] += 1
                step[last + length] -= 1
    return np.cumsum(step[:n]) > 0


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("did"), F.xxhash64("text").alias("th"), "text")


CUT = "doc_id long, n_bytes long, removed array<struct<start:long,end:long>>, kept binary"
_CUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])


def cut_repeats(docs: DataFrame, length: int = MIN_BYTES) -> DataFrame:
    """One row per document: its bytes' number, the spans of bytes in strings of length bytes that also start elsewhere, and the rest.

    Null texts are empty; texts shorter than length lose nothing. Repeated rows are copies of each other, and so are rows of one doc_id
    or without one. No rows give no rows.
    """
    keyed = _keyed(docs)
    spans = repeated_spans(keyed, length, first=False)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                out = []
                for r in batch.slice(k, 512).to_pylist():
                    data = np.frombuffer((r["text"] or "").encode("utf-8"), np.uint8)
                    gone = removed_bytes(len(data), r["marks"], length)
                    edges = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8))).tolist()
                    removed = [{"start": a, "end": b} for a, b in zip(edges[::2], edges[1::2], strict=True)]
                    out.append((None if r["did"] == _NO_ID else r["did"], len(data), removed, data[~gone].tobytes()))
                yield pa.record_batch([list(c) for c in zip(*out, strict=True)], schema=_CUT)

    return keyed.join(spans, ["did", "th"], "left").mapInArrow(rows, CUT)


def repeat_digests(docs: DataFrame, length: int = MIN_BYTES) -> DataFrame:
    """cut_repeats as numbers, spans and a digest of what is kept."""
    size = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    n_spans = F.size("removed").cast("long")
    return cut_repeats(docs, length).select("doc_id", "n_bytes", size.alias("n_removed"), n_spans.alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "removed")


def remove_later_copies(docs: DataFrame, length: int) -> DataFrame:
    """docs with the text of later copies taken out: of strings of length bytes that repeat, the first by doc_id and place stays.

    Only whole characters go, so the text stays valid. Other columns are as they were; null texts stay null.
    """
    spans = repeated_spans(_keyed(docs), length, first=True)
    names = docs.columns
    did, th, found = fresh(docs, "_did"), fresh(docs, "_th"), fresh(docs, "_marks")
    keyed = docs.withColumns({did: F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)), th: F.xxhash64("text")})
    joined = keyed.join(spans.select(F.col("did").alias(did), F.col("th").alias(th), F.col("marks").alias(found)), [did, th], "left")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, marks in zip(batch.column("text").to_pylist(), batch.column(found).to_pylist(), strict=True):
                if marks:
                    data = np.frombuffer(text.encode("utf-8"), np.uint8)
                    gone = removed_bytes(len(data), marks, length)
                    heads = np.flatnonzero((data & 0xC0) != 0x80)
                    whole = np.logical_and.reduceat(gone, heads)
                    gone = np.repeat(whole, np.diff(np.r_[heads, len(data)]))
                    text = data[~gone].tobytes().decode("utf-8")
                texts.append(text)
            columns = [pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.select(*names, found).mapInArrow(rows, docs.schema)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_digests(read(spark, sf_dir, "documents").select("doc_id", "text"))
