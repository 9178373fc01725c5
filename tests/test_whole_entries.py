"""Entries are dealt over the whole table: vectors that lie far apart in it still meet."""

import math

import pytest

import __spark_entry__ as entry
from sitemill.operators import joins


@pytest.fixture(scope="module")
def far_apart(spark, tmp_path_factory):
    """Residue atoms 0 to 9, and ligand atoms 1000 to 1009 in contact with those of the same last digit."""
    d = str(tmp_path_factory.mktemp("far"))
    rows = [(k, 0, [0.1, 0.1, 0.1]) for k in range(10)] + [(1000 + k, 5, [0.1, 0.1, 0.1 + k / 100]) for k in range(10)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{d}/embeddings.parquet")
    return d


def test_atom_pairs_of_the_whole_table(spark, far_apart):
    got = sorted((r["p_vec_id"], r["l_vec_id"]) for r in entry.queries()["atom_pairs"](spark, far_apart).collect())
    assert got == [(k, 1000 + k) for k in range(10)]


def test_pairs_of_a_large_structure_in_parts(spark, monkeypatch):
    monkeypatch.setattr(joins, "PAIRED_ATOMS", 3)
    a = spark.createDataFrame([(k % 2, k, float(k), 0.0, 0.0) for k in range(20)], "pdb_id long, id long, x double, y double, z double")
    got = sorted((r["p_id"], r["l_id"], r["distance"]) for r in joins.atom_pairs(a.filter("id < 12"), a.filter("id >= 12"), 4.5).collect())
    assert got == [(p, q, math.fabs(p - q)) for p in range(12) for q in range(12, 20) if p % 2 == q % 2]


def test_contacts_of_the_whole_table(spark, far_apart):
    got = sorted((r["p_vec_id"], r["l_vec_id"]) for r in entry.queries()["contacts_within"](spark, far_apart).collect())
    assert got == [(k, 1000 + k) for k in range(8)]  # the last two are more than 0.8 away


def test_labels_of_the_whole_table(spark, far_apart):
    got = sorted(tuple(r) for r in entry.queries()["residue_labels"](spark, far_apart).select("pdb_id", "residue", "site", "interacting").collect())
    assert got == [(k, k, 5, int(k < 8)) for k in range(10)]


def test_sites_with_contact_of_the_whole_table(spark, far_apart):
    got = sorted((r["pdb_id"], r["site"]) for r in entry.queries()["keep_sites_with_contact"](spark, far_apart).collect())
    assert got == [(k, 5) for k in range(8)]
