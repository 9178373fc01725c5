"""The dataset build and scoring, end to end on made-up structures small enough to reason about."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sitemill.operators import encoders, joins, models, splitting
from sitemill.plans import dataset

RESIDUES = ["ALA", "CYS", "ASP", "GLU", "PHE", "GLY"]


@pytest.fixture(scope="module")
def atoms(spark):
    """Forty entries of one six-residue chain along x, and a ligand above residues 1, 3 and 5 (and one out of reach)."""
    rows, line = [], 0
    for e in range(40):
        for k, r in enumerate(RESIDUES[e % 3 :] + RESIDUES[: e % 3]):
            line += 1
            rows.append((f"p{e:02d}", line, "ATOM", "C", "CA", r, "A", k + 1, None, None, "1", 6.0 * k, 0.0, 0.0))
        for k, (comp, y) in enumerate([("LIG", 4.0), ("LIG", 4.0), ("LIG", 4.0), ("FAR", 99.0)]):
            line += 1
            rows.append((f"p{e:02d}", line, "HETATM", "C", "C1", comp, "B" if comp == "LIG" else "C", -1, None, None, "1", 12.0 * k, y, float(e % 2) * 0.1))
        rows.append((f"p{e:02d}", line + 1, "HETATM", "O", "O", "HOH", "D", -1, None, None, "1", 0.0, 0.0, 0.0))
    return spark.createDataFrame(rows, "pdb_id string, line_no long, group string, element string, atom string, comp string, asym string, seq_id int, auth_seq string, auth_asym string, model string, x double, y double, z double")


def test_build_split_and_score(spark, atoms):
    ligands = spark.createDataFrame([("LIG",), ("FAR",)], "comp string")
    labels = dataset.site_labels(atoms, ligands)
    one = labels.filter("pdb_id = 'p00'").orderBy("position").collect()
    assert [r["interacting"] for r in one] == [1, 0, 1, 0, 1, 0] and {r["lig_id"] for r in one} == {"LIG"}
    assert "".join(r["residue_1l"] for r in one) == "ACDEFG"

    resolutions = spark.createDataFrame([(f"p{e:02d}", "N/A" if e == 1 else str(1.0 + e / 10)) for e in range(40)], "pdb_id string, resolution string")
    sites = dataset.distinct_sites(labels, resolutions)
    assert sorted(r["pdb_id"] for r in sites.collect()) == ["p00", "p02", "p04"]  # the best of each of three sequences

    everything = labels.select("pdb_id", "chain_id", "lig_id", "lig_chain").distinct()
    spelled = labels.groupBy("pdb_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "residue_1l"))), lambda r: r["residue_1l"]), "").alias("sequence_1l"))
    smiles = spark.createDataFrame([("LIG", "CCN"), ("LIG", "CCO")], "lig_id string, smiles string")
    data = dataset.build_dataset(labels, everything.join(spelled, "pdb_id"), smiles, encoders.one_hot_residues, encoders.count_tokens, encoders.TOKENS)
    assert data.interactions.count() == 40 and data.protein_residues.count() == 240 and data.ligand_features.count() == 1
    cleaned = dataset.clean(data)
    assert cleaned.protein_residues.first()["features"].__len__() == 6  # letters that never stand, or always, are gone

    splits = dataset.split_base(data, splitting.CONFIGS["base"])
    assert splits.count() == 40
    config = splitting.SplitConfig(0.2, 0.2, 0.0, 1, "sequence", "lig_id")
    free = splitting.assign_balanced(data.interactions.select(F.col("key").alias("group"), F.lit(1).alias("n")), config.val, config.test, 1).select(F.col("group").alias("key"), "split")
    rows, scaler = dataset.examples(data, free)
    assert rows.count() == 240 and scaler.count() == len(encoders.RESIDUES) + len(encoders.TOKENS)

    model = models.train_boosted(rows.filter("split = 'train'"), rows.filter("split = 'val'"), {"maxIter": 4, "maxDepth": 3, "seed": 1})
    pairs = spark.createDataFrame([("x", "A", "L", "acd", "CCN"), ("x", "A", "L", "acd", "CCN"), ("y", "A", "L", "", "CCN")], "PDB string, Chain string, Lig_ID string, Sequence string, SMILES string")
    scored = dataset.score_new(pairs, encoders.one_hot_residues, encoders.count_tokens, encoders.TOKENS, scaler, model).orderBy("position").collect()
    assert [(r["position"], r["residue"]) for r in scored] == [(1, "A"), (2, "C"), (3, "D")] and all(0 <= r["probability"] <= 1 and r["pred"] in (0, 1) for r in scored)


def test_cluster_split_leaves_no_leak(spark):
    """Planted leakage: an entry whose chains fall in two clusters, and a free entry in the second of them."""
    config = splitting.SplitConfig(0.2, 0.2, 0.2, 3, "cluster", "scaffold")
    rows = [(f"p{e}", c, f"S{e}{c}", f"L{e % 4}", f"L{e % 4}_B") for e in range(40) for c in "AB"]
    own = spark.createDataFrame(rows, "pdb_id string, chain_id string, sequence_1l string, lig_id string, lig_site string").withColumn("key", F.concat_ws(":", "pdb_id", "chain_id", "lig_site"))
    clusters = spark.createDataFrame([(f"p{e}", c, e // 2 + (20 if c == "B" and e % 2 else 0)) for e in range(40) for c in "AB"], "pdb_id string, chain_id string, cluster_id int")
    ligands = spark.createDataFrame([("L0", "f0"), ("L1", None), ("L2", "f2"), ("L3", "f2")], "lig_id string, scaffold string")
    data = dataset.Dataset(own, own.select("pdb_id", "chain_id").distinct(), own.select("lig_site").distinct())
    reps = spark.createDataFrame([(f"S{e}{c}",) for e in range(38) for c in "AB"], "sequence string")
    data = dataset.keep_nonredundant(data, reps)
    assert data.interactions.count() == 76 and data.protein_residues.count() == 76
    split = {r["key"]: r["split"] for r in dataset.split_cluster(data, config, clusters, ligands).collect()}
    assert set(split) == {r["key"] for r in data.interactions.collect()}
    cluster = {(r["pdb_id"], r["chain_id"]): r["cluster_id"] for r in clusters.collect()}
    scaffold = {"L0": "f0", "L1": None, "L2": "f2", "L3": "f2"}
    blind_entries = {k.split(":")[0] for k, s in split.items() if s in ("blind", "blind_protein")}
    blind_clusters = {cluster[tuple(k.split(":")[:2])] for k in split if k.split(":")[0] in blind_entries}
    blind_scaffolds = {scaffold[k.split(":")[2].split("_")[0]] for k, s in split.items() if s in ("blind", "blind_ligand")}
    assert blind_entries and blind_scaffolds and None not in blind_scaffolds
    aside = 0
    for k, s in split.items():
        pdb, chain, site = k.split(":")
        if pdb in blind_entries:
            assert s in ("blind", "blind_protein")
        elif cluster[pdb, chain] in blind_clusters:
            aside += s == "test"
            assert s in ("test", "blind_ligand")
        if s in ("train", "val"):
            assert cluster[pdb, chain] not in blind_clusters and scaffold[site.split("_")[0]] not in blind_scaffolds
    assert aside and {"train", "val", "test"} <= set(split.values())


def test_trained_model_to_best_interactions(spark):
    rows = [("train" if i % 3 else "val", f"k{i // 6}", i % 6, int(i % 2), [float(i % 2), float(i % 5)]) for i in range(90)]
    df = spark.createDataFrame(rows, "split string, key string, ord int, label int, features array<double>")
    model = models.train_boosted(df.filter("split = 'train'"), df.filter("split = 'val'"), {"maxIter": 3, "maxDepth": 2, "seed": 1})
    metrics, best = dataset.evaluate_model(model, df, 2)
    assert {(r["split"], r["f1"], r["auc"]) for r in metrics.collect()} == {("train", 1.0, 1.0), ("val", 1.0, 1.0)}
    assert best.count() == 4 and all(r["y_true"] == r["y_pred"] for r in best.collect())


def test_from_a_search_to_the_evaluated_model(spark, tmp_path):
    rows = [("train" if i % 3 else "val", f"k{i // 6}", i % 6, int(i % 2), [float(i % 2), float(i % 5)]) for i in range(90)]
    df = spark.createDataFrame(rows, "split string, key string, ord int, label int, features array<double>")
    space = {"maxDepth": models.Integers(1, 3), "stepSize": models.Uniform(0.01, 0.3, log=True), "seed": [1]}
    params, metrics, best = dataset.tuned(df, space, 2, 7, str(tmp_path / "run"), rungs=models.Rungs("maxIter", (1, 2), 0.5), parallelism=2, k=1)
    assert params["maxIter"] == 2 and {(r["split"], r["f1"]) for r in metrics.collect()} == {("train", 1.0), ("val", 1.0)} and best.count() == 2
    assert spark.read.parquet(str(tmp_path / "run" / "metrics")).count() == 2


def test_bucketed_entities_are_not_shuffled(spark):
    own = spark.createDataFrame([(f"k{i}", f"p{i % 7}", "A", f"s{i % 3}", [i % 2, 1, 0]) for i in range(40)], "key string, pdb_id string, chain_id string, lig_site string, targets array<int>")
    residues = spark.createDataFrame([(f"p{i}", "A", k, [float(i), float(k)]) for i in range(7) for k in range(3)], "pdb_id string, chain_id string, ord int, features array<double>")
    ligands = spark.createDataFrame([(f"s{i}", [float(i)]) for i in range(3)], "lig_site string, features array<double>")
    data = dataset.laid_out(dataset.Dataset(own, residues, ligands), "bucket_test")
    want = sorted(map(str, joins.assemble_examples(own, residues, ligands).collect()))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = joins.assemble_examples(data.interactions, data.protein_residues, data.ligand_features)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(str, out.collect())) == want and len(want) == 120
        assert plan.count("Bucketed: true") == 2 and plan.count("Exchange hashpartitioning") == 2  # the examples, once for each join
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for name in ("protein_residues", "ligand_features"):
            spark.sql(f"DROP TABLE bucket_test_{name}")
