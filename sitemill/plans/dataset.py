"""The dataset build and the scoring of new pairs, composed of the operators. Contacts, features, splits and examples are stored once."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitemill.functions import scalar
from sitemill.operators import chains, curate, encoders, evaluate, features, joins, models, splitting
from sitemill.plans.registry import stored
from sitemill.sources import sinks
from sitemill.sources.sinks import ENTITY_KEYS


def site_labels(atoms: DataFrame, ligands: DataFrame, cutoff: float = 4.5) -> DataFrame:
    """Per residue and ligand site of an entry: pdb_id, chain_id, lig_id, lig_chain, position, residue_1l, interacting.

    atoms: as sources.readers.read_atoms gives them; ligands: curated ids in comp. Sites without a contact are left out.
    """
    a = curate.drop_solvent_and_hydrogen(curate.first_model(atoms))
    protein = a.filter(F.col("group") == "ATOM").select("pdb_id", F.col("asym").alias("chain_id"), F.col("seq_id").alias("position"), "comp", "x", "y", "z")
    sites = a.filter(F.col("group") == "HETATM").join(ligands.select("comp").distinct(), "comp", "left_semi")
    sites = sites.select("pdb_id", F.col("comp").alias("lig_id"), F.col("asym").alias("lig_chain"), "x", "y", "z")
    on = ["pdb_id", "chain_id", "position", "lig_id", "lig_chain"]
    hits = joins.contacts_within(protein, sites, cutoff)
    hits = hits.select("pdb_id", F.col("p_chain_id").alias("chain_id"), F.col("p_position").alias("position"), F.col("l_lig_id").alias("lig_id"), F.col("l_lig_chain").alias("lig_chain"))
    residues = protein.groupBy("pdb_id", "chain_id", "position").agg(F.min("comp").alias("residue_3l"))
    # Only chains that a site touches get rows for it, so the residues are not paired with every site of a large entry.
    touched = hits.select("pdb_id", "chain_id", "lig_id", "lig_chain").distinct()
    labels = joins.residue_labels(residues.join(touched, ["pdb_id", "chain_id"]), hits, on)
    named = scalar.aa_one_letter(labels, "residue_3l", "residue_1l").withColumn("residue_1l", F.coalesce("residue_1l", F.lit("X")))
    return stored(named, "site-labels")


SITE = ("pdb_id", "chain_id", "lig_id", "lig_chain")


def distinct_sites(labels: DataFrame, resolutions: DataFrame) -> DataFrame:
    """The sites left after both passes of deduplication: their keys, sequence_1l, pattern and resolution.

    resolutions: pdb_id, resolution; sites of entries without a numeric one of at most 5 are left out, and so are scattered ones' opposite:
    sites of one residue, or of neighbours only.
    """
    pattern = chains.residue_pattern(labels, SITE).withColumn("pattern", F.array_join("pattern", ","))
    spelled = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "residue_1l"))), lambda r: r["residue_1l"]), "")
    sequences = labels.groupBy(*SITE).agg(spelled.alias("sequence_1l"))
    rows = joins.semi(pattern.join(sequences, list(SITE)), chains.filter_scattered(labels, SITE), SITE)
    fine = curate.filter_resolution(resolutions).select("pdb_id", F.col("resolution").cast("double").alias("resolution"))
    rows = rows.join(fine, "pdb_id").withColumn("row_id", scalar.make_key(F.col("pdb_id"), F.col("chain_id"), F.concat_ws("_", "lig_id", "lig_chain")))
    return stored(chains.dedup_across_entries(chains.dedup_within_entry(rows)), "sites")


@dataclass(frozen=True)
class Dataset:
    interactions: DataFrame
    protein_residues: DataFrame
    ligand_features: DataFrame


def build_dataset(
    labels: DataFrame, sites: DataFrame, smiles: DataFrame, residue_encoder: Callable[[str], Sequence], ligand_encoder: Callable[[str], Sequence[float]], names: Sequence[str]
) -> Dataset:
    """Targets of each kept site and the vectors of the chains and ligands they use; smiles: lig_id, smiles. Each text is encoded once."""
    kept = joins.semi(labels, sites, SITE)
    targets = F.transform(F.array_sort(F.collect_list(F.struct("position", "interacting"))), lambda r: r["interacting"].cast("tinyint"))
    interactions = kept.groupBy(*SITE).agg(targets.alias("targets")).join(sites.select(*SITE, "sequence_1l"), list(SITE))
    interactions = interactions.withColumn("lig_site", F.concat_ws("_", "lig_id", "lig_chain")).withColumn("key", scalar.make_key(F.col("pdb_id"), F.col("chain_id"), F.col("lig_site")))
    interactions = stored(interactions, "interactions")
    by_chain = interactions.select("pdb_id", "chain_id", F.col("sequence_1l").alias("sequence")).distinct()
    residues = by_chain.join(encoders.with_residue_vectors(by_chain, residue_encoder), "sequence").drop("sequence")
    by_site = joins.lookup(interactions.select("lig_site", "lig_id").distinct(), smiles, "lig_id", "smiles")
    ligands = by_site.join(encoders.with_ligand_vectors(by_site, ligand_encoder, names), "smiles").select("lig_site", "features")
    return Dataset(interactions, stored(residues, "protein-residues"), stored(ligands, "ligand-features"))


def clean(data: Dataset) -> Dataset:
    """Without dimensions that hold a NaN, an infinity or one value only, told apart for residues and ligands."""
    residues = features.apply_mask(data.protein_residues, features.feature_mask(data.protein_residues))
    ligands = features.apply_mask(data.ligand_features, features.feature_mask(data.ligand_features))
    return Dataset(data.interactions, residues, ligands)


def laid_out(data: Dataset, name: str, path: str | None = None, buckets: int | None = None) -> Dataset:
    """The dataset with its entities as bucketed tables (name_protein_residues, name_ligand_features) by the keys that examples join on.

    Without a number of buckets there are as many as shuffle partitions, which is what lets a join leave them where they are.
    """
    n = buckets or int(data.interactions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lay = lambda df, k: sinks.write_bucketed(df, f"{name}_{k}", ENTITY_KEYS[k], n, path and f"{path}/{k}")
    return Dataset(data.interactions, lay(data.protein_residues, "protein_residues"), lay(data.ligand_features, "ligand_features"))


def split_base(data: Dataset, config: splitting.SplitConfig) -> DataFrame:
    """(key, split) by entry, sequence and ligand: blind sets, whole groups for the rest, set-aside groups in test."""
    group = splitting.group_key(F.col("pdb_id"), F.col("sequence_1l"), F.col("lig_site"))
    rows = data.interactions.select("key", "pdb_id", F.col("sequence_1l").alias("sequence"), "lig_id", group.alias("group"))
    entries, _ = splitting.blind_entries(rows, splitting.sample_keys(rows, "sequence", config.blind, config.seed))
    entries = stored(entries, "blind-entries")
    sequences = stored(splitting.sequences_of(rows, entries), "blind-sequences")
    kinds = splitting.classify_base(rows, entries, sequences, splitting.sample_keys(rows, "lig_id", config.blind, config.seed))
    assigned = splitting.assign_balanced(kinds.filter("category = 'candidate'"), config.val, config.test, config.seed)
    blind = kinds.filter("category like 'blind%'").select("group", "n", F.col("category").alias("split"))
    groups = splitting.add_collateral(assigned.unionByName(blind), kinds.filter("category = 'test'").select("group", "n"))
    out = stored(rows.join(groups.select("group", "split"), "group").select("key", "split"), "splits")
    splitting.assert_disjoint(out)
    return out


def keep_nonredundant(data: Dataset, representatives: DataFrame) -> Dataset:
    """The interactions of chains whose whole sequence is a representative's (sequence), stored, and the entities these use."""
    chains_ = data.interactions.select("pdb_id", "chain_id", F.col("sequence_1l").alias("sequence"))
    kept = stored(splitting.keep_representatives(data.interactions, chains_, representatives), "representatives")
    return Dataset(**splitting.with_entities(kept, data.protein_residues, data.ligand_features))


#: Ligands up to which each task holds all of them with their scaffolds; beyond it interactions are dealt out to meet theirs.
HELD_LIGANDS = 500_000


def split_cluster(data: Dataset, config: splitting.SplitConfig, clusters: DataFrame, ligands: DataFrame) -> DataFrame:
    """(key, split) by sequence cluster and scaffold: blind sets widened to whole entries, groups that share a cluster with a blind chain
    set aside for test, whole groups for the rest.

    clusters: pdb_id, chain_id, cluster_id, as the listing gives them; of a chain in several clusters the smallest counts, so that its
    interactions count once. ligands: lig_id, scaffold (null: none), one row each.
    """
    group = splitting.group_key(F.col("pdb_id").cast("string"), F.col("sequence_1l"), F.col("lig_site"))
    rows = data.interactions.select("key", "pdb_id", "chain_id", "lig_id", group.alias("group"))
    one = clusters.groupBy("pdb_id", "chain_id").agg(F.min("cluster_id").alias("cluster_id"))
    chains_ = stored(rows.select("pdb_id", "chain_id").distinct().join(one, ["pdb_id", "chain_id"], "left"), "chains")
    ligands = stored(ligands, "scaffolds")
    ligands = F.broadcast(ligands) if ligands.count() <= HELD_LIGANDS else ligands
    used = joins.semi(ligands, rows.select("lig_id").distinct(), ("lig_id",))
    in_clusters = splitting.in_sample(chains_, "cluster_id", config.blind, config.seed)
    in_scaffolds = splitting.in_sample(used, "scaffold", config.blind, config.seed)
    rows = rows.join(ligands, "lig_id", "left").drop("lig_id")
    kinds = stored(splitting.with_group_kinds(rows, chains_, in_clusters, in_scaffolds), "kinds")
    balanced = splitting.balanced_split(kinds.filter("category = 'candidate'"), config.val, config.test, config.seed, F.lit(1))
    split = F.when(F.col("category") == "candidate", balanced).otherwise(F.col("category"))
    return splitting.split_of_keys(kinds.select("key", split.alias("split"), "scaffold_blind"))


def evaluate_model(model: Model, rows: DataFrame, k: int = 3, cut: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(metrics of each split, its k best interactions with their labels) of a trained model on examples (key, ord, label, features, split)."""
    scored = model.transform(rows.withColumn("features", array_to_vector(F.col("features").cast("array<double>"))))
    prob = vector_to_array("probability")[1]
    scores = scored.select("split", F.col("key").alias("interaction"), "ord", F.col("label").cast("int").alias("label"), prob.alias("prob"), scalar.threshold_label(prob, cut).alias("pred"))
    scores = stored(scores, "scores")
    return evaluate.evaluate_splits(scores), evaluate.top_interactions(scores, k)


def tuned(
    rows: DataFrame, space: Mapping[str, Any], n: int, seed: int, path: str, fit: Callable = models.train_boosted, parallelism: int = 1, rungs: models.Rungs | None = None, k: int = 3
) -> tuple[dict[str, Any], DataFrame, DataFrame]:
    """(best parameters, metrics of each split, its k best interactions) from a search to the evaluated model; rows: see evaluate_model.

    The best parameters' model is fitted once more, saved under path and read again, and what is read must score every row as the one in
    memory does: it is the one that is evaluated. The metrics are a table beside it, so that a later run finds both.
    """
    from pyspark.ml.util import DefaultParamsReader

    train, val = (rows.filter(F.col("split") == s).select("features", "label") for s in ("train", "val"))
    params, _, _ = models.search(train, val, space, n, seed, fit, parallelism=parallelism, rungs=rungs)
    made = fit(train, val, params)
    model = made[0] if isinstance(made, tuple) else made
    model.write().overwrite().save(f"{path}/model")
    again = DefaultParamsReader.loadParamsInstance(f"{path}/model", rows.sparkSession)
    vectors = rows.select("key", "ord", array_to_vector(F.col("features").cast("array<double>")).alias("features"))
    told = lambda m: m.transform(vectors).select("key", "ord", vector_to_array("probability")[1].alias("prob"))
    parity = evaluate.prediction_parity(told(model), told(again), ["key", "ord"]).first()
    if parity["all_close"] is False:
        raise ValueError(f"the saved model scores rows otherwise, by up to {parity['max_abs']}")
    metrics, best = evaluate_model(again, rows, k)
    metrics.write.mode("overwrite").parquet(f"{path}/metrics")
    return params, metrics, best


def examples(data: Dataset, splits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(examples with their split, scaler): vectors of both sides in one, scaled by the train split's entities, each counted once."""
    own = data.interactions.join(splits, "key")
    train = own.filter("split = 'train'")
    residue_scaler = features.fit_scaler(joins.semi(data.protein_residues, train, ("pdb_id", "chain_id")))
    ligand_scaler = features.fit_scaler(joins.semi(data.ligand_features, train, ("lig_site",)))
    rows = joins.assemble_examples(own, features.apply_scaler(data.protein_residues, residue_scaler), features.apply_scaler(data.ligand_features, ligand_scaler))
    width = residue_scaler.agg(F.count("*").alias("w"))
    both = residue_scaler.unionByName(ligand_scaler.crossJoin(F.broadcast(width)).withColumn("pos", (F.col("pos") + F.col("w")).cast("int")).drop("w"))
    return stored(rows.join(splits, "key"), "examples"), stored(both, "scaler")


def score_new(
    pairs: DataFrame, residue_encoder: Callable[[str], Sequence], ligand_encoder: Callable[[str], Sequence[float]], names: Sequence[str], scaler: DataFrame, model: Model, cut: float = 0.5
) -> DataFrame:
    """Probability and label of each residue of new pairs, column names bound without regard to case, blank ones left out."""
    columns = ("pdb", "chain", "lig_id", "sequence", "smiles")
    bound = curate.drop_blank(curate.bind_columns(pairs, columns), ["sequence", "smiles"])
    bound = bound.withColumn("sequence", scalar.clean_sequence(F.col("sequence"))).distinct()
    ids = encoders.sequence_ids(bound)
    return models.score_pairs(bound, ids, encoders.encode_sequences(ids, residue_encoder), encoders.with_ligand_vectors(bound, ligand_encoder, names), scaler, model, cut)
