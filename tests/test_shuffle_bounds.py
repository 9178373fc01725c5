"""Steps that deal rows out as often as they need to, and no more."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitemill.operators import joins, splitting


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_samples_and_balanced_splits_are_conditions(spark):
    rows = spark.range(3000).select(F.concat(F.lit("g"), F.col("id") % 1500).alias("group"), F.col("id")).groupBy("group").agg(F.count("*").alias("n")).localCheckpoint()
    inside = rows.filter(splitting.in_sample(rows, "group", 0.2, 7))
    assert exchanges(inside) == 0
    ordered = sorted((r["h"], r["group"], r["n"]) for r in rows.withColumn("h", splitting.seeded(7, F.col("group"))).collect())
    assert sorted(r["group"] for r in inside.collect()) == sorted(g for _, g, _ in ordered[: len(ordered) // 5])
    out = splitting.assign_balanced(rows, 0.1, 0.2, 7)
    assert exchanges(out) == 0
    at, want = 0, {}
    for _, group, n in ordered:
        want[group] = "test" if at < 600 else "val" if at < 900 else "train"
        at += n
    assert {r["group"]: r["split"] for r in out.collect()} == want


def test_the_kind_of_a_group_is_its_rows_together(spark):
    rows = spark.createDataFrame(
        [("a", 1, "A", "1:g", None), ("b", 1, "B", "1:h", "s"), ("c", 2, "A", "2:g", "t"), ("d", 3, "A", "3:g", None), ("e", 3, "A", "3:g", "s"), ("f", 4, None, "4:g", None)],
        "key string, pdb_id long, chain_id string, group string, scaffold string",
    )
    chains = spark.createDataFrame([(1, "A", 10), (1, "B", 11), (2, "A", 11), (3, "A", 12), (4, None, None)], "pdb_id long, chain_id string, cluster_id long")
    out = splitting.with_group_kinds(rows, chains, F.coalesce(F.col("cluster_id") == 10, F.lit(False)), F.coalesce(F.col("scaffold") == "s", F.lit(False)))
    got = {r["key"]: (r["n"], r["category"]) for r in out.collect()}
    assert got == {"a": (1, "blind_protein"), "b": (1, "blind"), "c": (1, "test"), "d": (2, "blind_ligand"), "e": (2, "blind_ligand"), "f": (1, "candidate")}


def test_kinds_with_rows_are_those_of_classify_base(spark):
    rows = spark.range(400).selectExpr(
        "concat('k', id) as key", "id % 60 as pdb_id", "'A' as chain_id", "case when id % 7 > 0 then concat('s', (id % 60) div 2 + id % 3) end as sequence", "id % 11 as lig_id", "concat(id % 11, '_', id % 2) as lig_site"
    )
    rows = rows.withColumn("group", splitting.group_key(F.col("pdb_id").cast("string"), F.col("sequence"), F.col("lig_site"))).localCheckpoint()
    sampled, ligands = splitting.sample_keys(rows, "sequence", 0.1, 3), splitting.sample_keys(rows, "lig_id", 0.2, 3)
    want = {tuple(r) for r in splitting.classify_base(rows, *splitting.blind_entries(rows, sampled), ligands).collect()}
    chains = rows.select("pdb_id", "sequence").distinct()
    out = splitting.with_base_kinds(rows, chains, splitting.in_sample(rows, "sequence", 0.1, 3), splitting.in_sample(rows, "lig_id", 0.2, 3))
    assert out.count() == 400 and {tuple(r) for r in out.select("group", "n", "category").collect()} == want and len({k for _, _, k in want}) >= 4


def test_used_chains_are_dealt_out_once(spark):
    own = spark.range(50).selectExpr("id as key", "id % 9 as pdb_id", "concat('c', id % 9) as chain_id", "concat(id % 5, '_x') as lig_site", "case when id % 2 = 0 then 'train' else 'val' end as split")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = splitting.materialise_splits(own, None, own.select("pdb_id", "chain_id").distinct(), own.select("lig_site").distinct())
        assert exchanges(out["protein_residues"]) == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert out["protein_residues"].count() == 18 and out["interactions"].count() == 50


def test_an_atom_goes_to_few_cells(spark):
    atoms = spark.range(2000).selectExpr("id", "rand(1) * 50 as x", "rand(2) * 50 as y", "rand(3) * 50 - 25 as z")
    assert 2000 < joins.cells_around(atoms, ["x", "y", "z"]).count() < 4.5 * 2000
    assert joins.cells_around(atoms.selectExpr("id", "x", "cast(null as double) as y", "z"), ["x", "y", "z"]).count() == 0
