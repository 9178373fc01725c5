"""Chains, residues and binding-site patterns from atom rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitemill.functions.scalar import aa_one_letter
from sitemill.operators.curate import NO_LIGAND


def build_chains(atoms: DataFrame) -> DataFrame:
    """One row per chain: three-letter, one-letter and position lists of its residues in first-seen order, and the entry's ligands.

    atoms: pdb_id, line_no, group, comp, asym, seq_id. A residue is named by the first of its atoms. Ligands are entry-wide: the sorted
    names of all hetero atoms, or NO_LIGAND.
    """
    residues = atoms.filter(F.col("group") == "ATOM").groupBy("pdb_id", "asym", "seq_id").agg(F.min(F.struct("line_no", "comp")).alias("first"))
    residues = aa_one_letter(residues.select("pdb_id", "asym", "seq_id", "first.line_no", "first.comp"), "comp", "one")
    rows = F.array_sort(F.collect_list(F.struct("line_no", "seq_id", "comp", F.coalesce("one", F.lit("X")).alias("one"))))
    chains = residues.groupBy("pdb_id", "asym").agg(rows.alias("r"))
    joined = lambda f, sep: F.array_join(F.transform("r", lambda x: x[f].cast("string")), sep)
    chains = chains.select("pdb_id", F.col("asym").alias("chain_id"), joined("comp", "-").alias("sequence_3l"), joined("one", "").alias("sequence_1l"), joined("seq_id", "-").alias("positions"))
    ligands = atoms.filter(F.col("group") == "HETATM").groupBy("pdb_id").agg(F.array_join(F.array_sort(F.collect_set("comp")), ",").alias("ligand_id"))
    return chains.join(ligands, "pdb_id", "left").withColumn("ligand_id", F.coalesce("ligand_id", F.lit(NO_LIGAND)))


def filter_ambiguous(atoms: DataFrame, ambiguous: Column, most: float = 0.0) -> DataFrame:
    """Atoms of chains whose ambiguous rows are at most this share of their ordinary ATOM rows; a chain without ordinary ones goes."""
    bad = F.count_if(ambiguous)
    plain = F.count_if((F.col("group") == "ATOM") & ~ambiguous)
    keep = atoms.groupBy("pdb_id", "asym").agg(bad.alias("bad"), plain.alias("plain")).filter((F.col("plain") > 0) & (F.col("bad") / F.col("plain") <= most))
    return atoms.join(keep.select("pdb_id", "asym"), ["pdb_id", "asym"], "left_semi")


def residue_author_map(atoms: DataFrame) -> DataFrame:
    """One row per residue: its label numbering, and the author numbering of its first atom."""
    first = atoms.groupBy("pdb_id", "asym", "seq_id").agg(F.min(F.struct("line_no", "auth_seq", "auth_asym")).alias("f"))
    return first.select("pdb_id", "asym", "seq_id", "f.auth_seq", "f.auth_asym")


def filter_structures(atoms: DataFrame, chains: DataFrame, ligands: DataFrame) -> DataFrame:
    """Of listed chains (pdb_id, asym) the ATOM rows and the hetero rows of curated ligands (comp); chains without ATOM rows go."""
    on = ["pdb_id", "asym"]
    listed = atoms.join(chains.select(*on).distinct(), on, "left_semi")
    own = listed.filter(F.col("group") == "ATOM")
    het = listed.filter(F.col("group") == "HETATM").join(ligands.select("comp").distinct(), "comp", "left_semi").select(*atoms.columns)
    return own.unionByName(het.join(own.select(*on).distinct(), on, "left_semi").select(*atoms.columns))


def concat_distinct(df: DataFrame, keys: Sequence[str], col: str, sep: str = "; ") -> DataFrame:
    return df.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set(col)), sep).alias(col))


def concat_nonempty(df: DataFrame, keys: Sequence[str], order: str, col: str, sep: str = "; ") -> DataFrame:
    """Values that are not blank joined in the order of another column."""
    rows = F.array_sort(F.collect_list(F.when(F.trim(col) != "", F.struct(F.col(order).alias("o"), F.col(col).alias("v")))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(rows, lambda r: r["v"]), sep).alias(col))


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "variable", value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(values), name, value)


def residue_pattern(labels: DataFrame, site: Sequence[str]) -> DataFrame:
    """Per site its positive residues as sorted position_residue names, and how many."""
    name = F.concat_ws("_", F.col("position").cast("string"), "residue_1l")
    out = labels.filter("interacting = 1").groupBy(*site).agg(F.array_sort(F.collect_set(name)).alias("pattern"))
    return out.withColumn("n_interacting", F.size("pattern"))


def filter_scattered(labels: DataFrame, site: Sequence[str]) -> DataFrame:
    """Sites with two positive residues at least that do not all follow each other."""
    rows = labels.filter("interacting = 1").select(*site, "position").distinct()
    spread = rows.groupBy(*site).agg(F.count("*").alias("n"), (F.max("position") - F.min("position")).alias("span"))
    return spread.filter((F.col("n") >= 2) & (F.col("span") != F.col("n") - 1)).select(*site)


def _site_order(keys: Sequence[str], order: Sequence[str]):
    return W.partitionBy(*keys).orderBy(*order)


ENTRY_KEYS = ("pdb_id", "sequence_1l", "lig_id", "pattern")
ENTRY_ORDER = ("lig_chain", "row_id")
ACROSS_KEYS = ("sequence_1l", "lig_id", "pattern")
ACROSS_ORDER = ("resolution", "pdb_id", "chain_id", "lig_chain", "row_id")


def dedup_within_entry(sites: DataFrame) -> DataFrame:
    """Of sites of one entry with equal sequence, ligand and pattern, the first by ligand chain, then input order."""
    return sites.withColumn("_rn", F.row_number().over(_site_order(ENTRY_KEYS, ENTRY_ORDER))).filter("_rn = 1").drop("_rn")


def dedup_across_entries(sites: DataFrame) -> DataFrame:
    """Of sites with equal sequence, ligand and pattern, the one of the lowest resolution; ties by entry, chain and ligand chain."""
    return sites.withColumn("_rn", F.row_number().over(_site_order(ACROSS_KEYS, ACROSS_ORDER))).filter("_rn = 1").drop("_rn")


def dedup_audit(sites: DataFrame) -> DataFrame:
    """Each removed site with the site kept for it and the pass that removed it."""

    def passed(df: DataFrame, keys: Sequence[str], order: Sequence[str], reason: str) -> DataFrame:
        # The kept site of a key is one row of a plain aggregate, whose join back Spark splits where a key is hot.
        kept = df.groupBy(*keys).agg(F.min_by(F.struct("row_id", "resolution"), F.struct(*order)).alias("_kept"))
        out = df.join(kept, list(keys)).filter(F.struct("row_id", "resolution") != F.col("_kept"))
        return out.select(F.col("row_id").alias("removed_row"), F.col("_kept.row_id").alias("kept_row"), F.col("resolution").alias("removed_resolution"), F.col("_kept.resolution").alias("kept_resolution"), F.lit(reason).alias("reason"))

    first = passed(sites, ENTRY_KEYS, ENTRY_ORDER, "same entry")
    return first.unionByName(passed(dedup_within_entry(sites), ACROSS_KEYS, ACROSS_ORDER, "across entries"))


def sorted_distinct(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct().orderBy(col)


def cluster_sizes(clusters: DataFrame, cluster: str = "cluster_id", member: str = "pdb_chain") -> DataFrame:
    """One row: clusters, smallest, integer mean and largest size, and the smallest members of the largest cluster's."""
    sizes = clusters.groupBy(cluster).agg(F.count("*").alias("n"), F.min(member).alias("sample"))
    return sizes.agg(
        F.count("*").alias("n_clusters"), F.min("n").alias("smallest"), F.floor(F.sum("n") / F.count("*")).alias("mean_size"), F.max("n").alias("largest"),
        F.min(F.struct((-F.col("n")).alias("n"), F.col(cluster).alias("c"), "sample"))["sample"].alias("sample"),
    )
