"""Vectors from a caller's encoder, each distinct text encoded once."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitemill.functions.shared import shared_table
from sitemill.functions.shipping import ship_package

RESIDUES = "ACDEFGHIKLMNPQRSTVWYX"
TOKENS = ("C", "N", "O", "S", "P", "F", "Cl", "Br", "I", "=", "#", "(", "[", "1", "2")


def one_hot_residues(sequence: str) -> list[list[float]]:
    """A vector for each letter: its place in the alphabet."""
    return [[float(c == a) for a in RESIDUES] for c in sequence]


def count_tokens(smiles: str) -> list[float]:
    """How often each token stands in a SMILES string."""
    found = re.findall(r"Cl|Br|.", smiles)
    return [float(found.count(t)) for t in TOKENS]


#: Numbers of one batch that an encoder's worker hands on, about.
BATCH_VALUES = 1 << 20


#: Residues of one call of an encoder that takes lists, padding counted, and how much longer its longest sequence may be than its shortest.
CALL_RESIDUES, LIKE = 1 << 14, 1.25


def sequence_ids(df: DataFrame, seq: str = "sequence") -> DataFrame:
    """(seq_id, sequence): a number for each distinct sequence, stored. Rows of residues carry the number, not the text."""
    return shared_table(df.select(seq).filter(F.col(seq).isNotNull()).distinct().withColumn("seq_id", F.monotonically_increasing_id()).select("seq_id", seq), "sequence-ids")


def like_lengths(sequences: Iterable[tuple[int, str]]) -> Iterator[list[tuple[int, str]]]:
    """Calls of (seq_id, sequence), which come by length: as many as CALL_RESIDUES and LIKE allow, one at least."""
    held: list[tuple[int, str]] = []
    for row in sequences:
        n = len(row[1])
        if held and ((len(held) + 1) * n > CALL_RESIDUES or n > LIKE * len(held[0][1])):
            yield held
            held = []
        held.append(row)
    if held:
        yield held


def encode_sequences(ids: DataFrame, encoder: Callable, seq: str = "sequence", lists: bool = False) -> DataFrame:
    """(seq_id, ord, features): a row per residue of each sequence of ids (sequence_ids).

    encoder gives a sequence's vectors; with lists it takes several sequences of like length and gives the vectors of each, so that a model
    pads little. Another number of vectors than residues is an error. A worker holds one call's vectors and BATCH_VALUES numbers beside.
    """
    ship_package(ids.sparkSession)

    def one_by_one(rows: Iterable[tuple[int, str]]) -> Iterator[tuple[int, str, Sequence]]:
        for i, s in rows:
            yield i, s, encoder(s)

    def together(rows: Iterable[tuple[int, str]]) -> Iterator[tuple[int, str, Sequence]]:
        for call in like_lengths(rows):
            found = encoder([s for _, s in call])
            if len(found) != len(call):
                raise ValueError(f"{len(found)} results for {len(call)} sequences")
            yield from ((i, s, v) for (i, s), v in zip(call, found, strict=True))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = (x for batch in batches for x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        for i, s, vectors in (together if lists else one_by_one)(told):
            if len(vectors) != len(s):
                raise ValueError(f"{len(vectors)} vectors for {len(s)} residues")
            each = max(1, BATCH_VALUES // max(1, len(vectors[0]) if len(vectors) else 1))
            for at in range(0, len(vectors), each):
                part = [np.asarray(v, dtype=np.float32) for v in vectors[at : at + each]]
                ends = pa.array(np.cumsum([0, *map(len, part)]), pa.int32())
                columns = [pa.array(np.full(len(part), i)), pa.array(np.arange(at, at + len(part), dtype=np.int32)), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(part)))]
                yield pa.RecordBatch.from_arrays(columns, names=["seq_id", "ord", "features"])

    ordered = ids.select("seq_id", seq)
    ordered = ordered.repartition("seq_id").sortWithinPartitions(F.length(seq), "seq_id") if lists else ordered
    return ordered.mapInArrow(rows, "seq_id long, ord int, features array<float>")


def with_residue_vectors(df: DataFrame, encoder: Callable, seq: str = "sequence", lists: bool = False) -> DataFrame:
    """(sequence, ord, features): encode_sequences of df's distinct sequences, by the texts themselves."""
    ids = sequence_ids(df, seq)
    return encode_sequences(ids, encoder, seq, lists).join(ids, "seq_id").select(seq, "ord", "features")


def with_ligand_vectors(df: DataFrame, encoder: Callable[[str], Sequence[float]], names: Sequence[str], smiles: str = "smiles") -> DataFrame:
    """(smiles, features): one row per distinct ligand; vectors of another width than the names are skipped."""
    ship_package(df.sparkSession)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), each):
                out = [(s, np.asarray(v, dtype=np.float32)) for s in pdf[smiles].iloc[at : at + each] if len(v := encoder(s)) == len(names)]
                yield pd.DataFrame(out, columns=[smiles, "features"])

    each = max(1, BATCH_VALUES // max(1, len(names)))
    return df.select(smiles).filter(F.col(smiles).isNotNull()).distinct().mapInPandas(rows, f"`{smiles}` string, features array<float>")
