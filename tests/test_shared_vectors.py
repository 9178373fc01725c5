"""Examples whose entities carry their vectors' numbers: as with the vectors themselves, and none is shuffled by entity."""

from pyspark.sql import functions as F

from sitemill.operators import joins


def test_examples_by_vector_numbers(spark):
    own = spark.createDataFrame([("a", 1, "A", 7, [0, 1]), ("b", 2, "A", 8, [1]), ("c", 2, "B", 9, [1])], "key string, pdb_id long, chain_id string, lig_site long, targets array<int>")
    residues = spark.createDataFrame([(1, "A", 0, 0), (1, "A", 1, 2), (2, "A", 0, 0), (2, "B", 0, 5)], "pdb_id long, chain_id string, ord int, vec_id long")
    ligands = spark.createDataFrame([(7, 1), (8, 2), (9, 1)], "lig_site long, vec_id long")
    vectors = spark.createDataFrame([(k, [float(k), k / 2]) for k in range(3)], "vec_id long, features array<double>")
    whole = [df.join(vectors, "vec_id").drop("vec_id") for df in (residues, ligands)]
    rows = lambda df: sorted(map(str, df.select("key", "ord", "label", "features").collect()))
    got = joins.assemble_examples(own, residues, ligands, vectors)
    assert rows(got) == rows(joins.assemble_examples(own, *whole)) and got.filter(F.col("key") == "c").isEmpty()


def test_many_vectors_meet_in_blocks(spark, monkeypatch):
    """No exchange deals out a vector with a row; vectors that are missing, null, or of other widths are as in a plain join."""
    own = spark.range(90).selectExpr("cast(id as string) as key", "id as pdb_id", "'A' as chain_id", "id % 7 as lig_site", "array(0, 1, 0, 1, 0, 1, 0, 1) as targets")
    residues = own.select("pdb_id", "chain_id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("ord")).selectExpr("*", "if(ord = 3 and pdb_id < 5, null, (pdb_id + 31 * ord) % 24) as vec_id")
    ligands = spark.range(7).selectExpr("id as lig_site", "id * 3 + 1 as vec_id")
    vectors = spark.createDataFrame([(k, None if k == 5 else [k + i / 4 for i in range(k % 3 + 1)]) for k in range(22) if k != 9], "vec_id long, features array<double>")
    rows = lambda df: sorted(map(str, df.collect()))
    want = rows(joins.assemble_examples(own, residues, ligands, vectors))
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(joins, "BATCH_BYTES", 100)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for size in (64 << 20, 100):
            monkeypatch.setattr(joins, "BLOCK_BYTES", size)
            got = joins.assemble_examples(own, residues, ligands, vectors)
            assert rows(got) == want and 400 < len(want) < 720
            if size > 100:
                plan = got._jdf.queryExecution().executedPlan().toString()
                assert "MapInArrow" in plan and "SortMergeJoin" not in plan.split("MapInArrow")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_laid_out_entities_hold_numbers_only(spark, tmp_path):
    from sitemill.plans import q_features

    spark.createDataFrame([(1, "A", 1, 7, 3.0, 5), (1, "A", 2, 8, 30.0, 6)], "l_orderkey long, l_returnflag string, l_linenumber int, l_suppkey long, l_quantity double, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, [float(k)] * 64) for k in range(9)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    _, residues, ligands = q_features._sides(spark, str(tmp_path))
    assert residues.columns == ["pdb_id", "chain_id", "ord", "vec_id"] and ligands.columns == ["lig_site", "vec_id"]


def test_bucketed_numbers_meet_vectors_in_blocks(spark, monkeypatch):
    """Buckets stay where they are: rows are dealt out by residue, by ligand and by the cell of their vectors' blocks, and vectors with none of these."""
    from sitemill.plans import dataset

    own = spark.range(60).selectExpr("cast(id as string) as key", "id as pdb_id", "'A' as chain_id", "id % 5 as lig_site", "array(0, 1, 0, 1) as targets").localCheckpoint()
    residues = own.select("pdb_id", "chain_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("ord")).selectExpr("*", "(pdb_id + 31 * ord) % 20 as vec_id")
    vectors = spark.createDataFrame([(k, [float(k), k / 2]) for k in range(20)], "vec_id long, features array<double>")
    ligands = spark.range(5).selectExpr("id as lig_site", "id * 3 as vec_id")
    want = sorted(map(str, joins.assemble_examples(own, residues, ligands, vectors).collect()))
    data = dataset.laid_out(dataset.Dataset(own, residues, ligands), "block_test")
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = joins.assemble_examples(data.interactions, data.protein_residues, data.ligand_features, vectors)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Bucketed: true") == 2 and plan.count("Exchange hashpartitioning") == 2 and plan.count("Exchange ") == 3 and "MapInArrow" in plan
        assert sorted(map(str, out.collect())) == want and len(want) == 240
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for name in ("protein_residues", "ligand_features"):
            spark.sql(f"DROP TABLE block_test_{name}")
