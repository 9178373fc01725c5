"""The restricted dataset is made by one join of keys, which also tells keys without an interaction."""

import pytest

from sitemill.operators import splitting


def test_restricted_by_one_join(spark, monkeypatch):
    rows = spark.createDataFrame([("a", 1, "A", "s"), ("b", 1, "B", "t"), ("b", 2, "B", "t"), (None, 3, "C", "u")], "key string, pdb_id long, chain_id string, lig_site string")
    entities = rows.select("pdb_id", "chain_id"), rows.select("lig_site").distinct()
    made = []
    real = splitting.shared_table
    monkeypatch.setattr(splitting, "shared_table", lambda df, name: made.append(name) or real(df, name))
    keys = spark.createDataFrame([("b",), ("b",)], "key string")
    out = splitting.restrict_dataset(rows, *entities, keys)
    told = {k: sorted(map(tuple, df.collect())) for k, df in out.items()}
    assert told == {"interactions": [("b", 1, "B", "t"), ("b", 2, "B", "t")], "protein_residues": [(1, "B"), (2, "B")], "ligand_features": [("t",)]}
    assert made == ["restricted"]
    with pytest.raises(ValueError, match="z"):
        splitting.restrict_dataset(rows, *entities, spark.createDataFrame([("b",), ("z",)], "key string"))
