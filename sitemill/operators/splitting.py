"""Leakage-safe splits: whole groups, blind sets by sequence, cluster and scaffold, and balanced assignment."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitemill.functions.shared import shared_table

#: Digits by which hash prefixes grow, and the keys of one prefix that are ordered to find the cut among them.
PREFIX_DIGITS, FEW_KEYS, _HASH_DIGITS = 3, 10_000, 32
#: A group above this part of the smallest target is dealt out before the others.
LARGE_PART = 64


@dataclass(frozen=True)
class SplitConfig:
    """Shares, seed, and what proteins and ligands are held together by."""

    test: float
    val: float
    blind: float
    seed: int
    protein: str
    ligand: str


#: The five split settings; both embedding kinds use each.
CONFIGS = {
    "base": SplitConfig(0.05, 0.1, 0.07, 42, "sequence", "lig_id"),
    "cluster_90": SplitConfig(0.1, 0.1, 0.1, 27, "cluster_90", "scaffold"),
    "cluster_40": SplitConfig(0.1, 0.1, 0.1, 52, "cluster_40", "scaffold"),
    "nonredundant_90": SplitConfig(0.1, 0.1, 0.1, 98, "cluster_90", "scaffold"),
    "nonredundant_40": SplitConfig(0.1, 0.1, 0.1, 87, "cluster_40_nonredundant", "scaffold"),
}


def seeded(seed: int, key: Column) -> Column:
    """A stable order for a seed: the same wherever rows lie."""
    return F.md5(F.concat(F.lit(str(seed)), key.cast("string")))


def _upto(inside: DataFrame, col: str, seed: int, wanted: int, weight: Column) -> Column:
    """The condition on col that holds up to the key at which weights, summed in the order of the seeded hash, reach wanted.

    Counts of hash prefixes get longer until few rows share the cut's prefix; only these rows' keys are ordered. Their whole weight
    reaches wanted, which is above 0.
    """
    hashed, prefix, before = seeded(seed, F.col(col)), "", 0
    while True:
        length = min(_HASH_DIGITS, len(prefix) + PREFIX_DIGITS)
        counts = inside.groupBy(F.substring(hashed, 1, length).alias("p")).agg(F.sum(weight).alias("w"), F.count("*").alias("n"))
        for prefix, held, n in sorted(map(tuple, counts.collect())):  # 16 ** PREFIX_DIGITS rows at most
            if before + held >= wanted:
                break
            before += held
        if before + held == wanted:
            return F.substring(hashed, 1, length) <= prefix
        inside = inside.filter(F.substring(hashed, 1, length) == prefix)
        if n <= FEW_KEYS or length == _HASH_DIGITS:
            few = inside.groupBy(hashed.alias("_h"), F.col(col).alias("_k")).agg(F.sum(weight).alias("w")).orderBy("_h", "_k").collect()
            for last in few:
                before += last["w"]
                if before >= wanted:
                    break
            return (hashed < last["_h"]) | ((hashed == last["_h"]) & (F.col(col) <= F.lit(last["_k"])))


def _sampled(keys: DataFrame, col: str, share: float, seed: int) -> tuple[DataFrame, Column]:
    distinct = shared_table(keys.select(col).filter(F.col(col).isNotNull()).distinct(), "distinct-keys")
    n = distinct.count()
    return distinct, _upto(distinct, col, seed, max(1, int(share * n)), F.lit(1)) if n else F.lit(False)


def sample_keys(keys: DataFrame, col: str, share: float, seed: int) -> DataFrame:
    """max(1, floor(share * n)) distinct non-null keys, those of the smallest seeded hashes; none of none.

    The last key that belongs to the sample is found first. The sample is then a filter on the distinct keys, which are stored: nothing
    is sorted, and no task holds the sample.
    """
    distinct, inside = _sampled(keys, col, share, seed)
    return distinct.filter(inside)


def in_sample(keys: DataFrame, col: str, share: float, seed: int) -> Column:
    """The sample of sample_keys as a condition on col, so that rows are told without a join; a null is never in it."""
    return F.coalesce(_sampled(keys, col, share, seed)[1], F.lit(False))


def group_key(pdb: Column, sequence: Column, lig_site: Column) -> Column:
    """An atomic group's name; a chain without a known sequence has None in its place."""
    return F.concat_ws(":", pdb, F.coalesce(sequence, F.lit("None")), lig_site)


def blind_entries(chains: DataFrame, sampled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blind entries, blind sequences): entries with a chain of a sampled sequence, then all sequences of these entries; one step."""
    entries = chains.join(sampled.select("sequence").distinct(), "sequence", "left_semi").select("pdb_id").distinct()
    return entries, sequences_of(chains, entries)


def sequences_of(chains: DataFrame, entries: DataFrame) -> DataFrame:
    """The known sequences of the entries' chains."""
    return chains.join(entries, "pdb_id", "left_semi").select("sequence").filter("sequence is not null").distinct()


def blind_chains_by_cluster(chains: DataFrame, sampled: DataFrame) -> DataFrame:
    """Chains of entries that hold a chain of a sampled cluster."""
    entries = chains.join(sampled.select("cluster_id").distinct(), "cluster_id", "left_semi").select("pdb_id").distinct()
    return chains.join(entries, "pdb_id", "left_semi").select("pdb_id", "chain_id").distinct()


def blind_ligands_by_scaffold(ligands: DataFrame, sampled: DataFrame) -> DataFrame:
    """Ligands of a sampled scaffold; one without a scaffold never is."""
    return ligands.join(sampled.select("scaffold").filter("scaffold is not null").distinct(), "scaffold", "left_semi").select("lig_id").distinct()


def _flag(df: DataFrame, keys: DataFrame, on: list[str], name: str) -> DataFrame:
    marked = keys.select(*on).distinct().withColumn(name, F.lit(True))
    return df.join(marked, on, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def classify_base(interactions: DataFrame, entries: DataFrame, sequences: DataFrame, ligands: DataFrame) -> DataFrame:
    """(group, n, category) of atomic groups by entry, sequence and ligand.

    Entry and ligand blind: blind. Entry blind: blind_protein. Ligand blind: blind_ligand, or test where the sequence is blind too.
    Sequence blind: test. Others are candidates.
    """
    rows = _flag(_flag(_flag(interactions, entries, ["pdb_id"], "e"), sequences, ["sequence"], "s"), ligands, ["lig_id"], "l")
    g = rows.groupBy("group").agg(F.count("*").alias("n"), *[F.bool_or(c).alias(c) for c in ("e", "s", "l")])
    e, s, lig = F.col("e"), F.col("s"), F.col("l")
    kind = F.when(e & lig, "blind").when(e, "blind_protein").when(lig & ~s, "blind_ligand").when(s, "test").otherwise("candidate")
    return g.select("group", "n", kind.alias("category"))


def classify_cluster(interactions: DataFrame, chains: DataFrame, ligands: DataFrame) -> DataFrame:
    """(group, n, category): any chain and ligand blind: blind; chain: blind_protein; ligand: blind_ligand; others are candidates."""
    rows = _flag(_flag(interactions, chains, ["pdb_id", "chain_id"], "c"), ligands, ["lig_id"], "l")
    g = rows.groupBy("group").agg(F.count("*").alias("n"), F.bool_or("c").alias("c"), F.bool_or("l").alias("l"))
    c, lig = F.col("c"), F.col("l")
    return g.select("group", "n", F.when(c & lig, "blind").when(c, "blind_protein").when(lig, "blind_ligand").otherwise("candidate").alias("category"))


def _within_groups(rows: DataFrame, marks: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """rows (pdb_id, group) with n, the rows of their group, and each flag if any row of the group has it.

    marks: few columns, one row an entry. Rows are dealt out once, by entry, as a group lies in one.
    """
    whole = W.partitionBy("pdb_id", "group")
    any_row = {name: F.bool_or(F.coalesce(c, F.lit(False))).over(whole).alias(name) for name, c in flags.items()}
    return rows.join(marks, "pdb_id", "left").select(*rows.columns, F.count("*").over(whole).alias("n"), *any_row.values())


def with_base_kinds(rows: DataFrame, chains: DataFrame, sequences: Column, ligands: Column) -> DataFrame:
    """rows (pdb_id, group, sequence, lig_id) with their group's n and category, as classify_base gives them for blind_entries.

    chains: pdb_id, sequence, stored, distinct. sequences, ligands: conditions of in_sample. What sequences tell is worked out on chains
    alone and comes back as one row an entry.
    """
    entries = chains.filter(sequences).select("pdb_id").distinct().withColumn("_e", F.lit(True))
    told = shared_table(chains.join(entries, "pdb_id", "left"), "blind-entries")
    blind = told.filter("_e and sequence is not null").select("sequence").distinct().withColumn("_s", F.lit(True))
    marks = told.join(blind, "sequence", "left").filter("_e or _s").groupBy("pdb_id")
    marks = marks.agg(F.bool_or(F.coalesce("_e", F.lit(False))).alias("_entry"), F.collect_set(F.when(F.col("_s"), F.col("sequence"))).alias("_blind"))
    out = _within_groups(rows.withColumn("_ligand", ligands).drop("lig_id"), marks, {"_e": F.col("_entry"), "_s": F.array_contains("_blind", F.col("sequence")), "_l": F.col("_ligand")})
    e, s, lig = F.col("_e"), F.col("_s"), F.col("_l")
    kind = F.when(e & lig, "blind").when(e, "blind_protein").when(lig & ~s, "blind_ligand").when(s, "test").otherwise("candidate")
    return out.withColumn("category", kind).drop("_e", "_s", "_l", "_ligand")


def with_group_kinds(rows: DataFrame, chains: DataFrame, clusters: Column, scaffolds: Column) -> DataFrame:
    """(key, group, n, category, scaffold_blind) of rows (key, pdb_id, chain_id, group, scaffold); n: rows of the group.

    As classify_cluster, with candidates that remove_leakage takes a row of set aside as a whole: test. chains: pdb_id, chain_id,
    cluster_id, stored, one row a chain. clusters, scaffolds: conditions of in_sample. What chains tell is worked out on chains alone and comes
    back as one row a blind or leaking entry.
    """
    entries = chains.filter(clusters).select("pdb_id").distinct().withColumn("_e", F.lit(True))
    told = shared_table(chains.join(entries, "pdb_id", "left"), "blind-chains")
    blind = told.filter("_e and chain_id is not null and cluster_id is not null").select("cluster_id").distinct().withColumn("_leaks", F.lit(True))
    told = told.join(blind, "cluster_id", "left").filter("(_e or _leaks) and chain_id is not null")
    marks = told.groupBy("pdb_id").agg(F.bool_or(F.coalesce("_e", F.lit(False))).alias("_entry"), F.collect_set(F.when(F.col("_leaks"), F.col("chain_id"))).alias("_leaking"))
    flags = {"_c": F.col("_entry") & F.col("chain_id").isNotNull(), "_l": F.col("scaffold_blind"), "_t": F.array_contains("_leaking", F.col("chain_id"))}
    out = _within_groups(rows.withColumn("scaffold_blind", scaffolds).drop("scaffold"), marks, flags)
    kind = F.when(F.col("_c") & F.col("_l"), "blind").when(F.col("_c"), "blind_protein").when(F.col("_l"), "blind_ligand").when(F.col("_t"), "test").otherwise("candidate")
    return out.select("key", "group", "n", kind.alias("category"), "scaffold_blind")


def remove_leakage(candidates: DataFrame, blind_clusters: DataFrame, blind_scaffolds: DataFrame) -> DataFrame:
    """Candidates that share neither a cluster with a blind chain nor a blind scaffold."""
    out = candidates.join(blind_clusters.select("cluster_id").filter("cluster_id is not null").distinct(), "cluster_id", "left_anti")
    return out.join(blind_scaffolds.select("scaffold").filter("scaffold is not null").distinct(), "scaffold", "left_anti")


def deal_large(groups: list[tuple[str, int]], targets: dict[str, float]) -> dict[str, str]:
    """A split for each (group, n), one after the other: that which lacks most of its target then, of equal ones the first of targets.

    targets is brought down by what each split gets.
    """
    out = {}
    for group, n in groups:
        out[group] = max(targets, key=targets.__getitem__)
        targets[out[group]] -= n
    return out


def balanced_split(rows: DataFrame, val: float, test: float, seed: int, weight: Column | None = None) -> Column:
    """The split of rows (group, n) as a condition on both, towards targets that are shares of all weights, rounded; train gets what is left.

    rows: stored, one a group (weight: n), or one a member of a group of n (weight: 1).
    A group of more than a LARGE_PART of the smallest target is large. Large groups go first, the largest first, each to the split that
    lacks most, so they are met by what is still wanted; there are few of them, LARGE_PART over the smallest share at most. The small
    ones fill up test, then val, then train in the order of a seeded hash, so a target that large groups did not pass is missed by
    less than a small group. Two cuts in that order tell the splits: groups are neither sorted nor shuffled.
    """
    weight = F.col("n") if weight is None else weight
    total = rows.agg(F.sum(weight)).first()[0] or 0
    targets = {"test": math.floor(total * test + 0.5), "val": math.floor(total * val + 0.5)}
    targets["train"] = total - sum(targets.values())
    bound = min((t for t in targets.values() if t > 0), default=0) / LARGE_PART
    large = rows.filter(F.col("n") > bound).select("group", "n").distinct().orderBy(F.desc("n"), seeded(seed, F.col("group")), "group").collect() if total else []
    dealt = deal_large([(r["group"], r["n"]) for r in large], targets)
    small = rows.filter((F.col("n") <= bound) & F.col("group").isNotNull())
    filled, upto, at = small.agg(F.sum(weight)).first()[0] or 0, F.lit("train"), 0
    cuts = []
    for split in ("test", "val"):
        at += max(targets[split], 0)
        cuts.append((split, F.lit(True) if at > filled else _upto(small, "group", seed, at, weight) if at else F.lit(False)))
    for split, inside in reversed(cuts):
        upto = F.when(inside, split).otherwise(upto)
    for split in sorted(set(dealt.values())):
        upto = F.when((F.col("n") > bound) & F.col("group").isin([g for g, s in dealt.items() if s == split]), split).otherwise(upto)
    return upto


def assign_balanced(groups: DataFrame, val: float, test: float, seed: int) -> DataFrame:
    """(group, n, split) of whole groups by balanced_split; groups is stored."""
    rows = shared_table(groups.select("group", "n"), "groups")
    return rows.select("group", "n", balanced_split(rows, val, test, seed).alias("split"))


def add_collateral(splits: DataFrame, collateral: DataFrame) -> DataFrame:
    """Rows set aside go to test only."""
    return splits.unionByName(collateral.withColumn("split", F.lit("test")).select(*splits.columns))


def disjoint_report(splits: DataFrame, key: str = "key") -> DataFrame:
    """Keys that are in more than one split; empty if all is well."""
    return splits.select(key, "split").distinct().groupBy(key).agg(F.count("*").alias("n_splits")).filter("n_splits > 1")


def assert_disjoint(splits: DataFrame, key: str = "key", blind_scaffolds: DataFrame | None = None) -> None:
    found = splits.groupBy(key).agg(F.min("split").alias("_a"), F.max("split").alias("_b"), F.bool_or(F.col("split").isNull()).alias("_none")).filter("_a <> _b or (_none and _a is not null)").take(3)
    if found:
        raise ValueError(f"keys in several splits: {[r[0] for r in found]}")
    if blind_scaffolds is not None:
        leaked = splits.filter(F.col("split").isin("train", "val")).join(blind_scaffolds.select("scaffold").distinct(), "scaffold", "left_semi").take(3)
        if leaked:
            raise ValueError("a blind scaffold is in train or val")


def split_of_keys(rows: DataFrame) -> DataFrame:
    """(key, split) of rows (key, split, and scaffold_blind if need be), each key once and stored; the assertions of assert_disjoint are
    made on them. Rows are dealt out by key once, not once for each assertion."""
    leaked = F.bool_or(F.col("scaffold_blind") & F.col("split").isin("train", "val")) if "scaffold_blind" in rows.columns else F.lit(False)
    keyed = shared_table(rows.groupBy("key").agg(F.min("split").alias("split"), F.max("split").alias("_other"), leaked.alias("_leaked")), "splits")
    if found := keyed.filter("split <> _other").take(3):
        raise ValueError(f"keys in several splits: {[r[0] for r in found]}")
    if keyed.filter("_leaked").take(1):
        raise ValueError("a blind scaffold is in train or val")
    return keyed.select("key", "split")


def materialise_splits(interactions: DataFrame, splits: DataFrame | None, residues: DataFrame, ligands: DataFrame) -> dict[str, DataFrame]:
    """Interactions with their split, and for each split the entities that it uses. Without splits interactions carry theirs.

    Used chains are dealt out by the keys that they are joined on, and told apart there.
    """
    own = interactions if splits is None else interactions.join(splits.select("key", "split"), "key")
    chains = own.select("split", "pdb_id", "chain_id").repartition("pdb_id", "chain_id").distinct()
    sites = own.select("split", "lig_site").distinct()
    return {"interactions": own, "protein_residues": residues.join(chains, ["pdb_id", "chain_id"]), "ligand_features": ligands.join(sites, "lig_site")}


def split_summary(splits: DataFrame) -> DataFrame:
    return splits.groupBy("split").agg(F.count("*").alias("n"), F.count_if("collateral").alias("n_collateral"))


def keep_representatives(interactions: DataFrame, chains: DataFrame, representatives: DataFrame) -> DataFrame:
    """Interactions of chains whose whole sequence equals a representative's."""
    keep = chains.join(representatives.select("sequence").distinct(), "sequence", "left_semi").select("pdb_id", "chain_id").distinct()
    return interactions.join(keep, ["pdb_id", "chain_id"], "left_semi")


def restrict_dataset(interactions: DataFrame, residues: DataFrame, ligands: DataFrame, keys: DataFrame, check: bool = True) -> dict[str, DataFrame]:
    """The interactions of the keys and the entities they use; with check an error where a key has no interaction. Interactions are stored.

    Keys are marked as they are joined, so interactions and keys meet once: the join keeps all keys, and one without an interaction is seen.
    """
    wanted = keys.select("key").distinct()
    own = shared_table(interactions.withColumn("_met", F.lit(True)).join(wanted, "key", "right" if check else "inner"), "restricted")
    if check:
        missing = own.filter("_met is null").select("key").take(5)
        if missing:
            raise ValueError(f"keys without an interaction: {[r[0] for r in missing]}")
    return with_entities(own.drop("_met"), residues, ligands)


def with_entities(own: DataFrame, residues: DataFrame, ligands: DataFrame) -> dict[str, DataFrame]:
    """The interactions and the entities they use."""
    return {
        "interactions": own,
        "protein_residues": residues.join(own.select("pdb_id", "chain_id").distinct(), ["pdb_id", "chain_id"], "left_semi"),
        "ligand_features": ligands.join(own.select("lig_site").distinct(), "lig_site", "left_semi"),
    }
