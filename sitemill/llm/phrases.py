"""Phrase collocations: n-grams of word ids counted exactly in counting quotient filters that are merged over shards."""

from __future__ import annotations

import itertools
import math
import struct
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitemill.llm.common import partitions, read, shared_table

#: Words of the longest phrase, its least count, the share (in percent) of a phrase's count at which a longer one takes its place, and rows of each language.
LONGEST, LEAST, COVERED, TOP = 4, 30, 80, 2000
#: A score counts in so many parts.
PARTS = 2_000_000
#: Characters that end a piece, and the mark for them: a byte that UTF-8 never holds.
ENDS, MARK = ".,;:!?\n\x0b\x0c\r", b"\xff"
#: Distinct words and bytes of texts between two deliveries of a task's word counts.
HELD_WORDS, HELD_BYTES = 400_000, 1 << 26
#: Frequent words, and their bytes, that each task holds as a dictionary; a larger vocabulary is joined with the words of the texts.
MOST_WORDS, MOST_WORD_BYTES = 500_000, 1 << 25
#: N-grams of one shard's filters, and about as many of one merged bucket.
SHARD_GRAMS = 1 << 21
#: Frequent n-grams that each task holds, to leave out longer ones that hold an infrequent one; of more, longer ones are all counted.
MOST_GRAMS = 1 << 22
_TABLE = bytes(255 if chr(c) in ENDS else c + 32 if 65 <= c <= 90 else c for c in range(256))
_U = np.uint64


def words_of(text: bytes) -> list[bytes]:
    """Words in order, with MARK between pieces; A-Z are lower-cased."""
    return text.translate(_TABLE).replace(MARK, b" " + MARK + b" ").split()


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word binary, f) of words that stand LEAST times or more in their language, and a row without word for all its words."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held = {}, 0

        def told() -> pa.RecordBatch:
            out = [(lang, w, n) for lang, own in counts.items() for w, n in own.items()]
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.binary(), pa.int64()))], names=["lang", "word", "f"])

        for batch in batches:
            for i in range(batch.num_rows):
                lang, text = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                own = counts.setdefault(lang, Counter())
                words = words_of(text)
                own.update(words)
                own[None] += len(words) - own.pop(MARK, 0)
                held += len(text)
                if held > HELD_BYTES or len(own) > HELD_WORDS:
                    yield told()
                    counts, held = {}, 0
        if counts:
            yield told()

    found = docs.select("lang", "text").mapInArrow(rows, "lang string, word binary, f long")
    return found.groupBy("lang", "word").agg(F.sum("f").alias("f")).filter(F.col("word").isNull() | (F.col("f") >= LEAST))


def numbered(words: DataFrame) -> DataFrame:
    """words (lang, word, f) with dense ids from 1: places within hashed buckets, behind the sizes of the buckets before."""
    k = partitions(words.sparkSession)
    dealt = words.withColumn("bucket", F.pmod(F.xxhash64("lang", "word"), F.lit(k)).cast("int"))
    place = F.row_number().over(W.partitionBy("bucket").orderBy("lang", "word"))
    dealt = shared_table(dealt.withColumn("place", place), "phrase-words")
    sizes = dict(dealt.groupBy("bucket").count().collect())  # k rows at most
    before = list(itertools.accumulate((sizes.get(i, 0) for i in range(k)), initial=0))
    first = F.element_at(F.array(*[F.lit(x) for x in before]), F.col("bucket") + 1)
    return dealt.select((first + F.col("place")).cast("int").alias("id"), "lang", "word", "f")


def encoded(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(ids) of each text: its words' ids in order, 0 for other words and between pieces and at the end."""
    size = vocabulary.agg(F.count("*"), F.sum(F.length("word"))).first()
    if size[0] <= MOST_WORDS and (size[1] or 0) <= MOST_WORD_BYTES:
        known: dict[str, dict[bytes, int]] = {}
        for lang, word, i in vocabulary.select("lang", "word", "id").toLocalIterator():
            known.setdefault(lang, {})[bytes(word)] = i
        held = docs.sparkSession.sparkContext.broadcast(known)

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out, size = [], 0
                for i in range(batch.num_rows):
                    words = words_of(batch.column(1)[i].as_py())
                    words.append(MARK)
                    out.append(np.fromiter(map(held.value.get(batch.column(0)[i].as_py(), {}).get, words, itertools.repeat(0)), np.int32, len(words)))
                    size += len(words)
                    if size > SHARD_GRAMS or i == batch.num_rows - 1:
                        at = np.cumsum([0, *map(len, out)]).astype(np.int32)
                        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(out)))], names=["ids"])
                        out, size = [], 0

        return docs.select("lang", "text").mapInArrow(rows, "ids array<int>")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    cleaned = F.translate(F.col("text").cast("string"), upper + ENDS, lower + "\n" * len(ENDS))
    tokens = F.split(F.regexp_replace(cleaned, "\n", " \n "), "[ \t]+")
    each = docs.select("lang", F.monotonically_increasing_id().alias("row"), tokens.alias("tokens")).select("lang", "row", F.posexplode("tokens").alias("pos", "word"))
    # Blank tokens at a text's ends are no words: they stand where a piece ends anyway.
    word = F.when(~F.col("word").isin("\n", ""), F.col("word").cast("binary")).alias("word")
    met = each.select("lang", "row", "pos", word).join(vocabulary.select("lang", "word", "id"), ["lang", "word"], "left")
    ids = met.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("id", F.lit(0)).alias("id")))).alias("x"))
    return ids.select(F.concat(F.col("x.id"), F.array(F.lit(0))).alias("ids"))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Permutation:
    """A bijection of pairs of half-bit numbers (a Feistel network), so that any keys spread evenly and can be had back."""

    ROUNDS = tuple(_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))

    def __init__(self, half: int):
        self.mask = _U((1 << half) - 1)

    def there(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for k in self.ROUNDS:
            a, b = b, a ^ (_mix(b ^ k) & self.mask)
        return a, b

    def back(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for k in reversed(self.ROUNDS):
            a, b = b ^ (_mix(a ^ k) & self.mask), a
        return a, b


def merged(a: np.ndarray, b: np.ndarray, n: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys (a, b) in rising order, each once, with their counts n added up. The sort merges runs that are sorted already."""
    if not len(a):
        return a, b, n
    order = np.argsort((a << _U(half)) | b, kind="stable") if 2 * half <= 64 else np.lexsort((b, a))
    a, b, n = a[order], b[order], n[order]
    first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    return a[first], b[first], np.add.reduceat(n, first)


class QuotientFilter:
    """A counting quotient filter as bytes: keys of one bucket, permuted, distinct and rising, each with a count.

    A key has 2 * half bits, of which the first top name the bucket. The next quotient bits are a run's number: a bit for each number tells
    whether it is occupied, a bit for each slot whether its run ends there. All bits that are left, the whole remainder, are kept in
    the slot, so nothing is lost. A count takes a byte; larger ones follow at the end.
    """

    HEAD = struct.Struct("<BBBqq")

    @classmethod
    def pack(cls, a: np.ndarray, b: np.ndarray, n: np.ndarray, half: int, top: int) -> bytes:
        q = min(max(1, len(a).bit_length()), half - top)
        rest = half - top - q
        quotient = ((a >> _U(rest)) & _U((1 << q) - 1)).astype(np.int64)
        occupied = np.zeros(1 << q, bool)
        occupied[quotient] = True
        run_ends = np.r_[quotient[1:] != quotient[:-1], True]
        upper = a & _U((1 << rest) - 1)
        slots = np.stack((b | (upper << _U(half)), upper >> _U(64 - half)), axis=1).astype("<u8").view(np.uint8)[:, : -(-(half + rest) // 8)]
        large = n[n >= 255]
        parts = (np.packbits(occupied), np.packbits(run_ends), np.ascontiguousarray(slots), np.minimum(n, 255).astype(np.uint8), large.astype("<i8"))
        return cls.HEAD.pack(half, top, q, len(a), len(large)) + b"".join(p.tobytes() for p in parts)

    @classmethod
    def unpack(cls, bucket: int, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        half, top, q, size, n_large = cls.HEAD.unpack_from(data)
        rest = half - top - q
        width, at = -(-(half + rest) // 8), cls.HEAD.size
        take = lambda n: np.frombuffer(data, np.uint8, n, at)
        occupied = np.flatnonzero(np.unpackbits(take(-(-(1 << q) // 8)), count=1 << q))
        at += -(-(1 << q) // 8)
        run_ends = np.unpackbits(take(-(-size // 8)), count=size)
        at += -(-size // 8)
        slots = np.zeros((size, 16), np.uint8)
        slots[:, :width] = take(size * width).reshape(size, width)
        at += size * width
        n = take(size).astype(np.int64)
        n[n == 255] = np.frombuffer(data, "<i8", n_large, at + size)
        quotient = occupied[np.cumsum(run_ends) - run_ends].astype(np.uint64)
        low, high = slots.view("<u8").astype(np.uint64).T
        upper = (low >> _U(half)) | (high << _U(64 - half))
        return (_U(bucket) << _U(half - top)) | (quotient << _U(rest)) | (upper & _U((1 << rest) - 1)), low & _U((1 << half) - 1), n


def gram_keys(ids: np.ndarray, n: int, bits: int, pairs: np.ndarray | None, triples: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of ids without a 0, as two halves: one id each for two words, else two with 0 for no word.

    pairs, triples: the frequent ones (see _held); an n-gram is left out if a shorter one within it is infrequent.
    """
    x = ids.astype(np.uint64)
    at = np.flatnonzero(np.logical_and.reduce([x[i : len(x) - n + 1 + i] > 0 for i in range(n)])) if len(x) >= n else np.zeros(0, np.int64)
    if n == 2:
        return x[at], x[at + 1]
    if pairs is not None:
        pair = lambda p: (x[p] << _U(bits)) | x[p + 1]
        found = np.searchsorted(pairs, pair(at))
        fine = (found < len(pairs)) & (pairs[np.minimum(found, len(pairs) - 1)] == pair(at)) if len(pairs) else np.zeros(len(at), bool)
        number = np.full(len(x), -1, np.int64)  # of the frequent pair at each place
        number[at[fine]] = found[fine]
        last = at + n - 2
        found = np.searchsorted(pairs, pair(last))
        tail = (found < len(pairs)) & (pairs[np.minimum(found, len(pairs) - 1)] == pair(last)) if len(pairs) else np.zeros(len(at), bool)
        number[last[tail]] = found[tail]
        keep = fine & tail
        at, found = at[keep], found[keep]
        if n == 4 and triples is not None:
            middle = np.searchsorted(pairs, pair(at + 1))
            known = (middle < len(pairs)) & (pairs[np.minimum(middle, len(pairs) - 1)] == pair(at + 1)) if len(pairs) else np.zeros(len(at), bool)
            for first, p in ((number[at], at), (middle, at + 1)):
                triple = (first.astype(np.uint64) << _U(bits)) | x[p + 2]
                place = np.searchsorted(triples, triple)
                known &= (triples[np.minimum(place, len(triples) - 1)] == triple) & (place < len(triples)) if len(triples) else False
            at = at[known]
    high = (x[at] << _U(bits)) | x[at + 1]
    return high, (x[at + 2] << _U(bits)) | (x[at + 3] if n == 4 else _U(0))


def gram_counts(texts: DataFrame, n: int, bits: int, total: int, pairs: np.ndarray | None, triples: np.ndarray | None) -> DataFrame:
    """(hi, lo, f) of the n-grams of texts (ids) that stand LEAST times or more: hi holds the first two words' ids, lo the others'.

    A task's n-grams become a filter for each bucket of permuted keys; a bucket's filters are merged in one task, some at a time. There
    are so many buckets that one holds SHARD_GRAMS n-grams, about, when all are distinct; the permutation makes them even.
    """
    spark, half = texts.sparkSession, bits if n == 2 else 2 * bits
    top = min(half, max(1, math.ceil(math.log2(max(2 * partitions(spark), total / SHARD_GRAMS)))))
    shared = spark.sparkContext.broadcast((pairs, triples))

    def filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, permute = [], 0, Permutation(half)

        def told() -> pa.RecordBatch:
            a, b = permute.there(*(np.concatenate(x) for x in zip(*held, strict=True)))
            a, b, f = merged(a, b, np.ones(len(a), np.int64), half)
            bucket = (a >> _U(half - top)).astype(np.int64)
            cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(a) else [0]
            packed = [QuotientFilter.pack(a[i:j], b[i:j], f[i:j], half, top) for i, j in itertools.pairwise(cuts)]
            return pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]], pa.int64()), pa.array(packed, pa.binary())], names=["bucket", "filter"])

        for batch in batches:
            ids = batch.column(0).flatten().to_numpy()
            for at in range(0, len(ids), SHARD_GRAMS):
                keys = gram_keys(ids[at : at + SHARD_GRAMS + n - 1], n, bits, *shared.value)
                held.append(keys)
                size += len(keys[0])
                if size >= SHARD_GRAMS:
                    yield told()
                    held, size = [], 0
        if size:
            yield told()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size, permute = None, [], 0, Permutation(half)

        def gathered() -> list:
            return [merged(*(np.concatenate(x) for x in zip(*held, strict=True)), half)]

        def told() -> pa.RecordBatch:
            a, b, f = gathered()[0]
            often = f >= LEAST
            a, b = permute.back(a[often], b[often])
            if n == 2:
                a, b = (a << _U(bits)) | b, np.zeros(len(a), np.uint64)
            return pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64)), pa.array(f[often])], names=["hi", "lo", "f"])

        for batch in batches:
            for bucket, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if bucket != now:
                    if held:
                        yield told()
                    now, held, size = bucket, [], 0
                held.append(QuotientFilter.unpack(bucket, data.as_py()))
                size += len(held[-1][0])
                if size > 2 * max(SHARD_GRAMS, len(held[0][0])):
                    held = gathered()
                    size = len(held[0][0])
        if held:
            yield told()

    made = texts.mapInArrow(filters, "bucket long, filter binary")
    dealt = made.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(merge, "hi long, lo long, f long")


def _held(grams: DataFrame, key: Column) -> np.ndarray | None:
    """The sorted keys of frequent n-grams, where they are few enough for each task to hold."""
    if grams.count() > MOST_GRAMS:
        return None
    return np.sort(grams.select(key.alias("key")).toArrow().column(0).to_numpy().astype(np.uint64))


def _packed(words: list[Column], bits: int) -> Column:
    """A gram's key (hi, lo) from up to four ids."""
    w = [*words, *[F.lit(0).cast("long")] * (LONGEST - len(words))]
    return F.struct(F.shiftleft(w[0], bits).bitwiseOR(w[1]).alias("hi"), F.shiftleft(w[2], bits).bitwiseOR(w[3]).alias("lo"))


def frequent_grams(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(grams, vocabulary, sizes, bits): (n, hi, lo, f) of frequent n-grams of 1 to LONGEST words, (id, lang, word), (lang, n)."""
    counts = shared_table(word_counts(docs), "phrase-counts")
    sizes = counts.filter(F.col("word").isNull()).select("lang", F.col("f").alias("n"))
    vocabulary = shared_table(numbered(counts.filter(F.col("word").isNotNull())), "phrase-vocabulary")
    total = int(sizes.agg(F.sum("n")).first()[0] or 0)
    bits = max(1, vocabulary.count().bit_length())  # ids fit 31 bits
    texts = shared_table(encoded(docs, vocabulary), "phrase-texts")
    one = vocabulary.select(F.lit(1).alias("n"), F.shiftleft(F.col("id").cast("long"), bits).alias("hi"), F.lit(0).cast("long").alias("lo"), "f")
    grams, pairs, triples, previous = one, None, None, None
    for n in range(2, LONGEST + 1):
        if n == 3:
            pairs = _held(previous, F.col("hi"))
        if n == 4 and pairs is not None:
            # A triple is the number of its first pair and its last word.
            if previous.count() <= MOST_GRAMS:
                t = previous.select("hi", F.shiftright("lo", bits).alias("last")).toArrow()
                number = np.searchsorted(pairs, t.column(0).to_numpy().astype(np.uint64)).astype(np.uint64)
                triples = np.sort((number << _U(bits)) | t.column(1).to_numpy().astype(np.uint64))
        previous = shared_table(gram_counts(texts, n, bits, total, pairs, triples), "phrase-grams")
        grams = grams.unionByName(previous.select(F.lit(n).alias("n"), "hi", "lo", "f"))
    return grams, vocabulary, sizes, bits


def collocations(docs: DataFrame, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first top phrases of 2 to LONGEST words; docs: text, lang.

    Texts are lower-cased (A-Z), ended pieces at .,;:!? and line ends, and split into words at spaces and tabs; null text is empty, null
    lang is und, and an empty lang stays one of its own. a counts a phrase in its language within pieces, l and r the parts of the cut
    with the smallest floor(PARTS * a / (l + r)), of equal ones the first. A phrase goes if a longer one that holds it has COVERED
    percent of its count or more. Order: score, a, falling, then the phrase's bytes. Repeated rows count again; other columns are left
    aside; empty tables, and texts without frequent phrases, give no row.

    All counts are exact: words get dense ids, ids are packed and permuted one to one, filters hold whole remainders. An n-gram with an
    infrequent word or part is itself infrequent, so it is not counted; what tasks hold to know that is bounded (MOST_WORDS, MOST_GRAMS),
    and beyond the bounds words are joined and all n-grams counted. A vocabulary of 2 ** 31 frequent words is the largest.
    """
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    grams, vocabulary, sizes, bits = frequent_grams(rows)
    grams = shared_table(grams, "phrase-all")
    mask = (1 << bits) - 1
    ids = [F.shiftright("hi", bits), F.col("hi").bitwiseAND(mask), F.shiftright("lo", bits), F.col("lo").bitwiseAND(mask)]
    long = grams.filter("n > 1").withColumnRenamed("f", "a")
    # Both parts of every cut, looked up as rows.
    cuts = [F.when(F.col("n") > k, F.array(F.struct(F.lit(f"l{k}").alias("part"), _packed(ids[:k], bits).alias("key")), F.struct(F.lit(f"r{k}").alias("part"), _packed(ids[k:], bits).alias("key")))) for k in range(1, LONGEST)]
    asked = long.select("n", "hi", "lo", "a", F.explode(F.flatten(F.filter(F.array(*cuts), lambda x: x.isNotNull()))).alias("x"))
    asked = asked.select("n", "hi", "lo", "a", "x.part", F.col("x.key.hi").alias("part_hi"), F.col("x.key.lo").alias("part_lo"))
    counts = grams.select(F.col("hi").alias("part_hi"), F.col("lo").alias("part_lo"), "f")
    parts = [F.max(F.when(F.col("part") == p, F.col("f"))).alias(p) for k in range(1, LONGEST) for p in (f"l{k}", f"r{k}")]
    whole = asked.join(counts, ["part_hi", "part_lo"]).groupBy("n", "hi", "lo", "a").agg(*parts)
    exact = lambda c: F.col(c).cast("decimal(20,0)")
    scores = [F.when(F.col(f"l{k}").isNotNull(), F.struct(F.expr(f"(cast({PARTS} as decimal(10,0)) * cast(a as decimal(20,0))) div (cast(l{k} as decimal(20,0)) + cast(r{k} as decimal(20,0)))").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in range(1, LONGEST)]
    scored = whole.select("hi", "lo", "a", F.array_min(F.filter(F.array(*scores), lambda x: x.isNotNull())).alias("best"))
    # What a longer phrase holds, with the largest count of such a phrase.
    holds = [F.when(F.col("n") >= i + m, _packed(ids[i : i + m], bits)) for m in range(2, LONGEST) for i in range(LONGEST - m + 1)]
    proper = [F.when(F.col("n") > m, h) for m, h in zip([m for m in range(2, LONGEST) for _ in range(LONGEST - m + 1)], holds, strict=True)]
    held = long.filter("n > 2").select("a", F.explode(F.filter(F.array(*proper), lambda x: x.isNotNull())).alias("x"))
    held = held.groupBy(F.col("x.hi").alias("hi"), F.col("x.lo").alias("lo")).agg(F.max("a").alias("longer"))
    kept = scored.join(held, ["hi", "lo"], "left").filter(F.col("longer").isNull() | (exact("longer") * 100 < exact("a") * COVERED))
    first = kept.withColumn("id", F.shiftright("hi", bits).cast("int")).join(vocabulary.select("id", "lang"), "id")
    first = first.select("lang", "hi", "lo", "a", "best.l", "best.r", "best.score")
    # Words are only looked up for what may be among the first.
    front = first.withColumn("front", F.rank().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))).filter(F.col("front") <= top).drop("front")
    spelt = front.select("lang", "hi", "lo", "a", "l", "r", "score", F.posexplode(F.array(*[i.cast("int") for i in ids])).alias("pos", "id")).filter("id > 0")
    spelt = spelt.join(vocabulary.select("id", F.col("word").cast("string").alias("word")), "id").groupBy("lang", "hi", "lo", "a", "l", "r", "score")
    spelt = spelt.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = spelt.withColumn("rank", rank).filter(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents").select("text", "lang"))


ORACLE = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n-\r]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS w FROM d),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM w, unnest([1, 2, 3, 4]) AS u(k), unnest(generate_series(1, len(w) - k + 1)) AS t(i)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
e AS (SELECT * FROM f WHERE f >= 30),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM e WHERE k > 1),
p AS (SELECT lang, phrase, a, i, array_to_string(w[1:i], ' ') AS x, array_to_string(w[i + 1:], ' ') AS y FROM c, unnest([1, 2, 3]) AS u(i) WHERE i < k),
s AS (SELECT p.*, x.f AS l, y.f AS r, 2000000 * a::HUGEINT // (x.f + y.f) AS score FROM p JOIN e x ON x.lang = p.lang AND x.phrase = p.x JOIN e y ON y.lang = p.lang AND y.phrase = p.y),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
h AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longer FROM c, unnest([2, 3]) AS u(m), unnest(generate_series(1, k - m + 1)) AS t(i) WHERE m < k GROUP BY ALL),
o AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank FROM b LEFT JOIN h ON h.lang = b.lang AND h.phrase = b.phrase WHERE longer IS NULL OR 100 * longer < 80 * a)
SELECT o.lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM o JOIN n ON n.lang = o.lang WHERE rank <= 2000
"""
