"""Vector bin packing of tokenized texts into sequences, under limits on tokens, segments and loss-bearing tokens."""

from __future__ import annotations

import base64
import functools
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from sitemill.llm.common import one_thread, read, tokenizer_path

END_ID = 1
#: Characters without a change between blank and non-blank from which a text counts as one with a long run.
LONG_RUN = 1000
#: Pieces that are packed together. A task packs its pieces in blocks of so many, so what it holds is bounded.
BLOCK_PIECES = 8192


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold."""

    tokens: int = 2048
    segments: int = 256
    loss_tokens: int = 2048


def pack_vectors(sizes: np.ndarray, capacity: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bin, place within it) of each row of sizes (items by dimensions), no bin above capacity in any dimension.

    Bins are filled one after another. Of the items that still fit, the one whose sizes have the largest dot product with what is left
    of the bin, both in shares of capacity and weighted by the whole's demand, goes in next; ties take the earlier item. Items with
    equal sizes are one kind with a count, so that a step costs the number of kinds.
    """
    kinds, kind_of = np.unique(sizes, axis=0, return_inverse=True)
    order = np.argsort(kind_of.ravel(), kind="stable")
    left = np.bincount(kind_of.ravel(), minlength=len(kinds))
    taken = np.concatenate(([0], np.cumsum(left)[:-1]))
    shares = kinds / capacity
    demand = sizes.sum(axis=0) / capacity
    weight = shares * (demand / max(demand.max(), 1e-9))
    bins, places = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
    if (kinds > capacity).any():
        raise ValueError("an item is larger than a sequence")
    current, room, place, waiting = 0, capacity.astype(np.int64).copy(), 0, len(sizes)
    while waiting:
        fits = (left > 0) & (kinds <= room).all(axis=1)
        if not fits.any():
            current, room, place = current + 1, capacity.astype(np.int64).copy(), 0
            continue
        score = np.where(fits, weight @ (room / capacity), -1.0)
        best = int(score.argmax())
        item = order[taken[best]]
        taken[best] += 1
        left[best] -= 1
        bins[item], places[item] = current, place
        room -= kinds[best]
        place += 1
        waiting -= 1
    return bins, places


class Encoder:
    """Ids of the tokenizers library's byte-level BPE.

    A vocabulary that lies beside it as ranks (same name, .tiktoken) gives the same ids several times as fast. Texts that hold a special
    token go to the tokenizers library, and so do texts with a long run without a break, on which merging by ranks is not linear.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        one_thread()
        self.exact = Tokenizer.from_file(path)
        specials = [re.escape(t.content) for t in self.exact.get_added_tokens_decoder().values()]
        run = rf"\S{{{LONG_RUN}}}|\s{{{LONG_RUN}}}"
        self.needs_exact = re.compile("|".join([*specials, run])).search
        self.quick = None
        ranks = os.path.splitext(path)[0] + ".tiktoken"
        if os.path.exists(ranks):
            with open(ranks, "rb") as f:
                table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
            self.quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
            self.sizes = np.zeros(max(table.values()) + 1, dtype=np.int64)  # bytes of each token
            for token, rank in table.items():
                self.sizes[rank] = len(token)

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if self.quick is None or self.needs_exact(text):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return self.quick.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()

    def bearing(self, text: str, ids: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
        """Whether each token of text (ids: what encode gives) shares a character with one of the spans of code points."""
        if self.quick is None or self.needs_exact(text):
            places = np.array(self.exact.encode(text, add_special_tokens=False).offsets, dtype=np.int64).reshape(-1, 2)
            first, last = places[:, 0], places[:, 1]
        else:  # a token's characters: from the one its first byte lies in to the one its last byte lies in
            opens = (np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80
            of_byte, ends = np.cumsum(opens) - 1, np.cumsum(self.sizes[ids])
            first, last = of_byte[ends - self.sizes[ids]], of_byte[ends - 1] + 1
        marked = np.zeros(len(text) + 1, dtype=np.int64)
        for start, end in spans:
            marked[max(start, 0) + 1 : end + 1] = 1
        upto = np.cumsum(marked)
        return upto[last] > upto[first]


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>, loss_spans array<struct<start:int,end:int>>"
_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])
#: The columns that are single numbers.
NUMBERS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
_ARROW = pa.schema([*((n, pa.int64()) for n in NUMBERS), ("ids", pa.list_(pa.int32())), ("loss_spans", pa.list_(_SPAN))])
#: Ids of one batch that is handed on, about.
BATCH_IDS = 1 << 20


@dataclass(frozen=True)
class _Piece:
    """A stretch of a document's ids, those that bear loss as spans within it."""

    doc_id: int | None
    start: int
    length: int
    doc_tokens: int
    ids: bytes
    spans: list[tuple[int, int]]

    @property
    def loss(self) -> int:
        return sum(e - s for s, e in self.spans)


def _true_runs(mask: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.r_[False, mask, False].astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def cut(doc_id: int | None, data: bytes, mask: np.ndarray | None, limits: Limits) -> Iterator[_Piece]:
    """The document's pieces, each as long as the limits on tokens and on loss-bearing ones allow. No mask: every token bears loss."""
    n, start = len(data) // 4, 0
    upto = None if mask is None else np.r_[0, np.cumsum(mask)]
    while start < n:
        end = min(n, start + (min(limits.tokens, limits.loss_tokens) if mask is None else limits.tokens))
        if upto is not None:
            end = min(end, int(np.searchsorted(upto, upto[start] + limits.loss_tokens, side="right")) - 1)
        spans = [(0, end - start)] if mask is None else _true_runs(mask[start:end])
        yield _Piece(doc_id, start, end - start, n, data[4 * start : 4 * end], spans)
        start = end


class _Block:
    """Pieces of one task that wait for their sequence."""

    def __init__(self, limits: Limits, first_sequence: int):
        self.limits, self.next, self.rows = limits, first_sequence, []

    def whole(self, piece: _Piece) -> tuple:
        """A piece that fills a sequence alone."""
        self.next += 1
        return piece, self.next - 1, 0

    def flush(self) -> list[tuple]:
        if not self.rows:
            return []
        lengths = np.array([p.length for p in self.rows], dtype=np.int64)
        sizes = np.stack([lengths, np.ones_like(lengths), np.array([p.loss for p in self.rows], dtype=np.int64)], axis=1)
        capacity = np.array([self.limits.tokens, self.limits.segments, self.limits.loss_tokens], dtype=np.int64)
        bins, places = pack_vectors(sizes, capacity)
        by = np.lexsort((places, bins))
        ends = np.cumsum(lengths[by])
        first = np.r_[True, bins[by][1:] != bins[by][:-1]]
        base = np.maximum.accumulate(np.where(first, ends - lengths[by], 0))
        out = [(self.rows[i], self.next + int(bins[i]), int(o)) for i, o in zip(by.tolist(), (ends - lengths[by] - base).tolist(), strict=True)]
        self.next += int(bins.max()) + 1
        self.rows = []
        return out


def _record_batch(out: list[tuple]) -> pa.RecordBatch:
    """Placed pieces (piece, sequence, offset) as rows of SCHEMA."""
    pieces = [p for p, _, _ in out]
    numbers = [(p.doc_id, p.start, p.length, zlib.crc32(p.ids), p.doc_tokens, sequence, offset) for p, sequence, offset in out]
    columns = [pa.array(c, pa.int64()) for c in (zip(*numbers, strict=True) if out else [[] for _ in NUMBERS])]
    ids = np.frombuffer(b"".join(p.ids for p in pieces), dtype="<u4").astype(np.int32)
    spans = np.array([x for p in pieces for x in p.spans], dtype=np.int32).reshape(-1, 2)
    ends = lambda sizes: pa.array(np.cumsum([0, *sizes]), pa.int32())
    columns.append(pa.ListArray.from_arrays(ends([p.length for p in pieces]), pa.array(ids)))
    columns.append(pa.ListArray.from_arrays(ends([len(p.spans) for p in pieces]), pa.StructArray.from_arrays([pa.array(spans[:, 0]), pa.array(spans[:, 1])], fields=list(_SPAN))))
    return pa.record_batch(columns, schema=_ARROW)


def _batches(out: list[tuple]) -> Iterator[pa.RecordBatch]:
    part, held = [], 0
    for row in out:
        part.append(row)
        held += row[0].length
        if held >= BATCH_IDS:
            yield _record_batch(part)
            part, held = [], 0
    yield _record_batch(part)


def pack(docs: DataFrame, path: str, limits: Limits = Limits(), loss: str | None = None) -> DataFrame:
    """One row per piece of a document: its ids, which of them bear loss, their checksum, and the piece's place in a sequence.

    loss: a column of docs, array<struct<start, end>>, with the spans of the text in code points that bear loss (as chat_format gives
    them); a token that shares a character with one bears loss, and the closing id if the last character does. Without the column, or
    where it is null, every token and the closing id bear loss. loss_spans of a piece count in its ids.
    A document is cut only where it is longer than a sequence, or bears more loss: full pieces are sequences of their own, the rest is
    packed. Null and empty texts are the closing id alone. Every task packs what it reads, in blocks, without a shuffle; sequence ids
    hold the partition above bit 40. Repeated rows are packed one by one.
    """
    if min(limits.tokens, limits.segments, limits.loss_tokens) < 1:
        raise ValueError("a sequence must hold something")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        block = _Block(limits, TaskContext.get().partitionId() << 40)
        closing = np.uint32(END_ID).tobytes()
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part, out = batch.slice(k, 512), []
                for doc_id, text, spans in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    text = text or ""
                    data, mask = own.encode(text), None
                    if spans is not None:
                        pairs = [(x["start"], x["end"]) for x in spans]
                        mask = np.r_[own.bearing(text, np.frombuffer(data, "<u4"), pairs), any(s < len(text) <= e for s, e in pairs)]
                    for piece in cut(doc_id, data + closing, mask, limits):
                        if piece.length == min(limits.tokens, limits.loss_tokens if mask is None else limits.tokens):
                            out.append(block.whole(piece))
                        else:
                            block.rows.append(piece)
                if len(block.rows) >= BLOCK_PIECES:
                    out += block.flush()
                yield from _batches(out)
        yield from _batches(block.flush())

    spans = f"transform(`{loss}`, x -> struct(cast(x.start as long) as start, cast(x.end as long) as end))" if loss else "cast(null as array<struct<start:long,end:long>>)"
    return docs.selectExpr("cast(doc_id as long) as doc_id", "text", f"{spans} as loss").mapInArrow(rows, SCHEMA)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json")).select(*NUMBERS)
