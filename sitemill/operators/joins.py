"""Key joins, set operations, and the distance join that labels contacts."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from sitemill.functions.scalar import euclid
from sitemill.functions.shared import shared_table
from sitemill.functions.shipping import ship_package
from sitemill.operators.curate import contact_label

#: Shared vectors of so many bytes go whole to every executor; of more, a task holds so many of either side at a time, and gives out so many at once.
BROADCAST_BYTES, BLOCK_BYTES, BATCH_BYTES = 8 << 20, 64 << 20, 8 << 20


def restrict_to_keys(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inner join on distinct keys, so that a repeated key adds no rows."""
    return df.join(keys.select(*on).distinct(), list(on), "inner")


def attach(df: DataFrame, dim: DataFrame, on: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Left join of a dimension's columns; Spark broadcasts it where its size allows."""
    return df.join(dim.select(*on, *cols), list(on), "left")


def semi(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(keys, list(on), "left_semi")


def anti(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(keys, list(on), "left_anti")


def patch_unknown(df: DataFrame, corrections: DataFrame, on: Sequence[str], col: str, unknown: str = "unknown") -> DataFrame:
    """col from the corrections where it is unknown and a correction exists; one correction a key, the smallest. patched marks them."""
    fix = corrections.groupBy(*on).agg(F.min(col).alias("_fix"))
    hit = (F.col(col) == unknown) & F.col("_fix").isNotNull()
    return df.join(fix, list(on), "left").withColumns({"patched": F.coalesce(hit, F.lit(False)), col: F.when(hit, F.col("_fix")).otherwise(F.col(col))}).drop("_fix")


def coverage_audit(expected: DataFrame, actual: DataFrame, on: Sequence[str]) -> DataFrame:
    """Expected keys that are missing."""
    return expected.select(*on).distinct().join(actual.select(*on), list(on), "left_anti")


def lookup(df: DataFrame, mapping: DataFrame, key: str, value: str) -> DataFrame:
    """Left join of a map; of several values of a key the smallest, null for a key without one."""
    return df.join(mapping.groupBy(key).agg(F.min(value).alias(value)), key, "left")


_POINT = ("x", "y", "z")

#: Residue atoms of a structure that one task pairs with all of the structure's ligand atoms.
PAIRED_ATOMS = 4096
#: Width of a grid cell in cutoffs. An atom of the repeated side goes to 20 cells of one cutoff's width, about, to 3 of four.
CELL_CUTOFFS = 4
#: Atoms of a grid cell above which it is cut into parts, how often it may be halved along each axis, and room for rounding at borders.
CROWD, MOST_LEVEL, _SLACK = 64, 7, 1e-9


def _sides(protein: DataFrame, ligand: DataFrame, entry: str) -> tuple[DataFrame, DataFrame]:
    name = lambda df, side: df.select(entry, *[F.col(c).alias(f"{side}_{c}") for c in df.columns if c != entry])
    return name(protein, "p"), name(ligand, "l")


def _distance() -> Column:
    return euclid([F.col(f"p_{c}") for c in _POINT], [F.col(f"l_{c}") for c in _POINT])


def atom_pairs(protein: DataFrame, ligand: DataFrame, cutoff: float = 4.5, entry: str = "pdb_id") -> DataFrame:
    """Every residue atom with every ligand atom of its structure: distance to 3 places, and the label by the distance as measured.

    For reports on few structures. Where only contacts matter use contacts_within, which does not make the far pairs. Residue atoms of
    large structures are dealt to parts, and ligand atoms repeated for each, so that one structure's pairs are many tasks' work.
    """
    p, q = _sides(protein, ligand, entry)
    most = p.groupBy(entry).count().agg(F.max("count")).first()[0] or 0
    parts, on = max(1, math.ceil(most / PAIRED_ATOMS)), [entry]
    if parts > 1:
        n = int(p.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        p = p.withColumn("_part", F.pmod(F.xxhash64(*p.columns), F.lit(parts))).repartition(n, entry, "_part")  # pairs are many where rows are few
        q, on = q.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))), [entry, "_part"]
    out = p.join(q, on).withColumn("_d", _distance()).drop("_part")
    return out.withColumns({"distance": F.round("_d", 3), "interacting": contact_label(F.col("_d"), cutoff)}).drop("_d")


def crowded_cells(dealt: DataFrame, place: Sequence[str], entry: str) -> DataFrame:
    """(entry, _cx, _cy, _cz, _level) of grid cells with more than CROWD atoms; the others are left whole, at level 0.

    place: columns of coordinates in units of a cell's width. A cell of level k is cut into 2 ** k parts along each axis, so that a part
    holds CROWD atoms, about, where they lie evenly; MOST_LEVEL is where parts get smaller than atoms come close to each other.
    """
    cell = [F.floor(c).alias(f"_c{x}") for c, x in zip(place, _POINT, strict=True)]
    level = F.least(F.lit(MOST_LEVEL), F.ceil(F.log(8.0, F.col("n") / CROWD)).cast("int"))
    return dealt.groupBy(entry, *cell).agg(F.count("*").alias("n")).filter(F.col("n") > CROWD).select(entry, *[f"_c{x}" for x in _POINT], level.alias("_level"))


def cells_around(atoms: DataFrame, place: Sequence[str]) -> DataFrame:
    """Atoms repeated for each grid cell (_cx, _cy, _cz) that a cube around their cutoff's ball reaches; place: see crowded_cells."""
    reach = 1 / CELL_CUTOFFS + _SLACK
    for x, c in zip(place, _POINT, strict=True):
        atoms = atoms.withColumn(f"_c{c}", F.explode(F.sequence(F.floor(F.col(x) - reach), F.floor(F.col(x) + reach))))
    return atoms


def contacts_within(protein: DataFrame, ligand: DataFrame, cutoff: float = 4.5, entry: str = "pdb_id") -> DataFrame:
    """The pairs of atom_pairs up to the cutoff, by a grid of cells of CELL_CUTOFFS that are cut finer where atoms crowd.

    Atoms of the larger side are dealt to the part of a cell that they lie in, those of the smaller side to every part that their cutoff's
    ball reaches, and pairs meet in a plain equi join on structure and part. So neither a crowded cell nor a large structure is one task's,
    and in crowded cells fewer far pairs are made. Atoms without a coordinate have no contact.
    """
    p, q = _sides(protein, ligand, entry)
    sides, repeated = {"p": p, "l": q}, "l" if q.count() <= p.count() else "p"
    dealt = "p" if repeated == "l" else "l"
    for side, df in sides.items():
        sides[side] = df.withColumns({f"_{side}{c}": F.col(f"{side}_{c}") / (cutoff * CELL_CUTOFFS) for c in _POINT})
    crowded = shared_table(crowded_cells(sides[dealt], [f"_{dealt}{c}" for c in _POINT], entry), "crowded-cells")
    on = [entry, *[f"_c{c}" for c in _POINT]]
    level = F.coalesce("_level", F.lit(0))
    parts = F.pow(F.lit(2.0), level)
    own = sides[dealt].withColumns({f"_c{c}": F.floor(f"_{dealt}{c}") for c in _POINT}).join(crowded, on, "left")
    own = own.withColumns({f"_n{c}": F.floor(F.col(f"_{dealt}{c}") * parts) for c in _POINT} | {"_k": level}).drop("_level", *on[1:])
    around, reach = cells_around(sides[repeated], [f"_{repeated}{c}" for c in _POINT]), 1 / CELL_CUTOFFS + _SLACK
    around = around.join(crowded, on, "left").withColumns({"_k": level, "_parts": parts})
    gaps = []
    for c in _POINT:
        x, first = F.col(f"_{repeated}{c}"), F.col(f"_c{c}") * F.col("_parts")
        low = F.greatest(F.floor((x - reach) * F.col("_parts")), first.cast("long"))
        high = F.least(F.floor((x + reach) * F.col("_parts")), (first + F.col("_parts") - 1).cast("long"))
        around = around.filter(low <= high).withColumn(f"_n{c}", F.explode(F.sequence(low, high)))
        part = F.col(f"_n{c}") / F.col("_parts")
        gaps.append(F.greatest(part - x, x - part - 1 / F.col("_parts"), F.lit(0.0)))
    reached = sum((g * g for g in gaps), F.lit(0.0)) <= 1 / CELL_CUTOFFS**2 + _SLACK
    around = around.filter(reached).drop("_level", "_parts", *on[1:])
    out = own.join(around, [entry, "_k", *[f"_n{c}" for c in _POINT]]).withColumn("_d", _distance()).filter(F.col("_d") <= cutoff)
    names = [entry, *[c for c in p.columns if c != entry], *[c for c in q.columns if c != entry]]
    return out.select(*names, F.round("_d", 3).alias("distance"))


def residue_labels(residues: DataFrame, hits: DataFrame, on: Sequence[str]) -> DataFrame:
    """Each residue and site with 1 if any of its atoms is in contact, else 0; residues: distinct keys, carried columns with them."""
    touched = hits.select(*on).distinct().withColumn("_hit", F.lit(1))
    return residues.join(touched, list(on), "left").withColumn("interacting", F.coalesce("_hit", F.lit(0))).drop("_hit")


def keep_sites_with_contact(labels: DataFrame, site: Sequence[str]) -> DataFrame:
    """Rows of sites that have a positive residue."""
    return labels.join(labels.filter("interacting = 1").select(*site).distinct(), list(site), "left_semi")


def assemble_examples(interactions: DataFrame, residues: DataFrame, ligands: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """A row per interaction and residue: residue vector and ligand vector in one, and the label.

    interactions: key, pdb_id, chain_id, lig_site, targets; residues: pdb_id, chain_id, ord, features; ligands: lig_site, features.
    Interactions without one of the sides give no rows. Labels are dealt out before the residue join, ligand vectors come last.
    Where entities share vectors, both carry vec_id in place of features, and vectors (vec_id, features; one row each) are met last, so
    that the joins by entity shuffle numbers only. Vectors that are many meet in blocks where that deals out fewer than one for each row.
    """
    own = "features" if vectors is None else "vec_id"
    rows = interactions.select("key", "pdb_id", "chain_id", "lig_site", F.posexplode("targets").alias("ord", "label"))
    rows = rows.join(residues.withColumnRenamed(own, "_r"), ["pdb_id", "chain_id", "ord"])
    rows = rows.join(ligands.withColumnRenamed(own, "_l"), "lig_site")
    if vectors is not None:
        many, size = vectors.agg(F.count("*"), F.coalesce(F.sum(8 * F.greatest(F.size("features"), F.lit(0))), F.lit(0))).first()
        blocks = max(math.ceil(size / BLOCK_BYTES), math.ceil(math.sqrt(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
        if size > BROADCAST_BYTES and 2 * blocks * many < (interactions.agg(F.sum(F.size("targets"))).first()[0] or 0):
            rows = vectors_in_blocks(rows, vectors, "_r", "_l", blocks)
        else:
            near = F.broadcast if size <= BROADCAST_BYTES else lambda df: df
            for side in ("_r", "_l"):
                rows = rows.join(near(vectors.select(F.col("vec_id").alias(side), F.col("features").alias(f"{side}v"))), side).drop(side).withColumnRenamed(f"{side}v", side)
    return rows.withColumn("features", F.concat("_r", "_l")).drop("_r", "_l")


def vectors_in_blocks(rows: DataFrame, vectors: DataFrame, left: str, right: str, blocks: int) -> DataFrame:
    """rows with the vectors in place of their numbers in the columns left and right; rows that miss one of both go.

    vectors: vec_id, features; one row each. Both sides' numbers are hashed to blocks, a row goes to the cell of its two blocks, and a
    vector to the cells of its row and its column. So numbers are shuffled once and each vector 2 * blocks times, but none with a row.
    """
    ship_package(rows.sparkSession)
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    kept = [c for c in rows.columns if c not in (left, right)]
    features = vectors.schema["features"].dataType
    numbers = [F.col(c).cast("long").alias(c) for c in (left, right)]
    dealt = rows.select(*kept, *numbers, F.lit(2).alias("_kind"), F.lit(None).cast(features).alias("_v")).filter(F.col(left).isNotNull() & F.col(right).isNotNull())
    dealt = dealt.withColumns({"_a": block(left), "_b": block(right)})
    known = vectors.select(F.col("vec_id").cast("long").alias(left), F.col("features").alias("_v")).filter(F.col(left).isNotNull())
    for kind, own, other in ((0, "_a", "_b"), (1, "_b", "_a")):
        dealt = dealt.unionByName(known.select(left, F.lit(kind).alias("_kind"), "_v", block(left).alias(own), every.alias(other)), allowMissingColumns=True)
    # A cell is a task, as hashing would put several of few cells into one; one number for cell and kind is sorted without comparing rows.
    dealt = dealt.withColumn("_cell", F.col("_a") * blocks + F.col("_b")).withColumn("_place", 3 * F.col("_cell") + F.col("_kind"))
    dealt = dealt.repartitionById(blocks * blocks, F.col("_cell").cast("int")).sortWithinPartitions("_place").select(*kept, left, right, "_v", "_place")
    schema = StructType([*(StructField(c, rows.schema[c].dataType) for c in kept), *(StructField(c, ArrayType(features.elementType)) for c in (left, right))])
    n = len(kept)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, found, sides = None, [], []

        def side(kind: int) -> tuple[np.ndarray, np.ndarray, pa.Array] | None:
            """Of a block's vectors: sorted numbers, where they stand, and the vectors."""
            parts = [(ids, v) for k, ids, v in found if k == kind]
            if not parts:
                return None
            ids = np.concatenate([x for x, _ in parts])
            order = np.argsort(ids, kind="stable")
            return ids[order], order, pa.concat_arrays([v for _, v in parts])

        for batch in batches:
            place = batch.column(n + 3).to_numpy()
            cuts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])[: batch.num_rows].tolist()
            for at, end in zip(cuts, [*cuts[1:], batch.num_rows], strict=False):
                part = batch.slice(at, end - at)
                now, kind = divmod(int(place[at]), 3)
                if now != cell:
                    cell, found, sides = now, [], []
                if kind < 2:
                    found.append((kind, part.column(n).to_numpy(), part.column(n + 2)))
                    continue
                if not sides:
                    sides, found = [side(0), side(1)], []
                if sides[0] is None or sides[1] is None:
                    continue
                step = max(1, BATCH_BYTES // (8 * max(1, sum(len(v.flatten()) // len(v) for _, _, v in sides))))
                for k in range(0, part.num_rows, step):
                    few = part.slice(k, step)
                    asked = [few.column(n + i).to_numpy() for i in (0, 1)]
                    at_ = [np.minimum(np.searchsorted(ids, a), len(ids) - 1) for (ids, _, _), a in zip(sides, asked, strict=True)]
                    there = np.logical_and(*(ids[x] == a for (ids, _, _), x, a in zip(sides, at_, asked, strict=True)))
                    columns = [few.column(i).filter(pa.array(there)) for i in range(n)]
                    columns += [v.take(pa.array(order[x[there]])) for (_, order, v), x in zip(sides, at_, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, names=[*kept, left, right])

    return dealt.mapInArrow(met, schema)


def check_sequence(labels: DataFrame, fasta: DataFrame, site: Sequence[str], chain: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(kept, skipped): sites whose residues in order spell the chain's sequence, and the others' keys.

    labels: position and residue_1l; fasta: chain keys and sequence.
    """
    spelled = labels.groupBy(*site).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "residue_1l"))), lambda r: r["residue_1l"]), "").alias("_spelled"))
    joined = spelled.join(fasta.select(*chain, "sequence"), list(chain), "left")
    same = F.coalesce(F.col("_spelled") == F.col("sequence"), F.lit(False))
    return labels.join(joined.filter(same), list(site), "left_semi"), joined.filter(~same).select(*site)


def zip_residues(df: DataFrame, seq1: str, seq3: str, positions: str, sep: str = "-") -> DataFrame:
    """One row per residue of a chain: letters, three-letter names and digit-only positions, up to the shortest of the three."""
    one = F.filter(F.split(F.col(seq1), ""), lambda x: x != "")
    three = F.split(F.col(seq3), sep)
    pos = F.filter(F.split(F.col(positions), sep), lambda x: x.rlike("^[0-9]+$"))
    n = F.least(F.size(one), F.size(three), F.size(pos))
    rows = F.arrays_zip(F.slice(one, 1, n).alias("residue_1l"), F.slice(three, 1, n).alias("residue_3l"), F.slice(pos, 1, n).alias("position"))
    keep = [c for c in df.columns if c not in (seq1, seq3, positions)]
    return df.select(*keep, F.posexplode(rows).alias("ord", "_r")).select(*keep, "ord", "_r.residue_1l", "_r.residue_3l", F.col("_r.position").cast("int").alias("position"))


def remap_modified(atoms: DataFrame, mods: DataFrame, standard: Sequence[str]) -> DataFrame:
    """Atoms with listed modifications resolved: a hetero atom whose parent is standard becomes an ATOM of the parent; any other listed
    one is dropped, and so is marked in a column ambiguous before that.

    mods: pdb_id, asym, seq_id, comp, parent; one parent a key, the smallest.
    """
    on = ["pdb_id", "asym", "seq_id", "comp"]
    out = atoms.join(mods.groupBy(*on).agg(F.min("parent").alias("_parent")), on, "left")
    listed = (F.col("group") == "HETATM") & F.col("_parent").isNotNull()
    converts = listed & F.col("_parent").isin(*standard)
    return out.withColumns({"ambiguous": listed & ~converts, "group": F.when(converts, "ATOM").otherwise(F.col("group")), "comp": F.when(converts, F.col("_parent")).otherwise(F.col("comp"))}).drop("_parent")


def union_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)


def union_distinct(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def except_keys(a: DataFrame, b: DataFrame) -> DataFrame:
    """Keys of one side only, with the side that has them."""
    return a.subtract(b).withColumn("side", F.lit("left")).unionByName(b.subtract(a).withColumn("side", F.lit("right")))


def require_same_keys(a: DataFrame, b: DataFrame) -> None:
    found = except_keys(a, b).take(5)
    if found:
        raise ValueError(f"keys of one side only: {[tuple(r) for r in found]}")


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)
