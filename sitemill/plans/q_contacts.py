"""Contacts and labels. Stand-in atoms: three components of each embedding as a point, labels below 5 as protein, others as ligand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitemill.functions.scalar import euclid
from sitemill.operators.curate import contact_label, drop_solvent_and_hydrogen
from sitemill.operators.joins import atom_pairs, contacts_within, keep_sites_with_contact, residue_labels
from sitemill.plans.registry import query, table

CUTOFF = 0.8
#: Entries, whatever the table's size: every one is a whole sample of it, and all its pairs count.
ENTRIES = 10

ATOMS_SQL = f"""
atoms AS (SELECT vec_id, vec_id % {ENTRIES} AS pdb_id, vec_id % 50 AS residue, label AS site, embedding[1]::DOUBLE * 10 AS x,
                 embedding[2]::DOUBLE * 10 AS y, embedding[3]::DOUBLE * 10 AS z FROM embeddings),
p AS (SELECT * FROM atoms WHERE site < 5), l AS (SELECT * FROM atoms WHERE site >= 5),
pairs AS (SELECT p.pdb_id, p.vec_id AS p_vec_id, l.vec_id AS l_vec_id, p.residue AS p_residue, l.site AS l_site,
                 sqrt((p.x - l.x) * (p.x - l.x) + (p.y - l.y) * (p.y - l.y) + (p.z - l.z) * (p.z - l.z)) AS d FROM p JOIN l USING (pdb_id))
"""
LABELS_SQL = f"""
res AS (SELECT DISTINCT pdb_id, residue FROM p), sites AS (SELECT DISTINCT pdb_id, site FROM l),
labels AS (SELECT res.pdb_id, res.residue, sites.site, CASE WHEN EXISTS (SELECT 1 FROM pairs q WHERE q.pdb_id = res.pdb_id AND q.p_residue = res.residue
           AND q.l_site = sites.site AND q.d <= {CUTOFF}) THEN 1 ELSE 0 END AS interacting FROM res JOIN sites USING (pdb_id))
"""


def atoms(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    point = [(F.col("embedding")[i].cast("double") * 10).alias(c) for i, c in enumerate("xyz")]
    a = table(spark, d, "embeddings").select("vec_id", (F.col("vec_id") % ENTRIES).alias("pdb_id"), (F.col("vec_id") % 50).alias("residue"), F.col("label").alias("site"), *point)
    return a.filter("site < 5"), a.filter("site >= 5")


def _labels(spark: SparkSession, d: str) -> DataFrame:
    p, q = atoms(spark, d)
    hits = contacts_within(p, q, CUTOFF).select("pdb_id", F.col("p_residue").alias("residue"), F.col("l_site").alias("site"))
    keys = p.select("pdb_id", "residue").distinct().join(q.select("pdb_id", "site").distinct(), "pdb_id")
    return residue_labels(keys, hits, ["pdb_id", "residue", "site"]).select("pdb_id", "residue", "site", "interacting")


@query("atom_pairs", f"WITH {ATOMS_SQL} SELECT pdb_id, p_vec_id, l_vec_id, round(d, 3) AS distance, (d <= {CUTOFF})::INT AS interacting FROM pairs")
def q_atom_pairs(spark, d):
    return atom_pairs(*atoms(spark, d), CUTOFF).select("pdb_id", "p_vec_id", "l_vec_id", "distance", "interacting")


@query("contacts_within", f"WITH {ATOMS_SQL} SELECT pdb_id, p_vec_id, l_vec_id, round(d, 3) AS distance FROM pairs WHERE d <= {CUTOFF}")
def q_contacts_within(spark, d):
    return contacts_within(*atoms(spark, d), CUTOFF).select("pdb_id", "p_vec_id", "l_vec_id", "distance")


@query(
    "contacts_in_crowds",
    """WITH a AS (SELECT l_orderkey // 100 AS pdb_id, l_orderkey * 10 + l_linenumber AS id, l_linenumber <= 3 AS protein, CASE WHEN l_suppkey % 3 = 0 THEN 0.1 ELSE 4.0 END * (l_partkey % 17) AS x,
                 CASE WHEN l_suppkey % 3 = 0 THEN 0.1 ELSE 4.0 END * (l_suppkey % 13) AS y, CASE WHEN l_suppkey % 3 = 0 THEN 0.1 ELSE 4.0 END * (l_orderkey % 11) AS z FROM lineitem)
       SELECT p.pdb_id, p.id AS p_id, l.id AS l_id, round(sqrt((p.x - l.x) * (p.x - l.x) + (p.y - l.y) * (p.y - l.y) + (p.z - l.z) * (p.z - l.z)), 3) AS distance
       FROM a p JOIN a l ON p.pdb_id = l.pdb_id AND p.protein AND NOT l.protein WHERE sqrt((p.x - l.x) * (p.x - l.x) + (p.y - l.y) * (p.y - l.y) + (p.z - l.z) * (p.z - l.z)) <= 0.75""",
)
def q_contacts_in_crowds(spark, d):
    """A third of an entry's atoms crowd into one corner of it, where cells are cut into parts."""
    step = F.when(F.col("l_suppkey") % 3 == 0, 0.1).otherwise(4.0)
    point = [(step * (F.col(c) % m)).alias(x) for c, m, x in (("l_partkey", 17, "x"), ("l_suppkey", 13, "y"), ("l_orderkey", 11, "z"))]
    a = table(spark, d, "lineitem").select(F.floor(F.col("l_orderkey") / 100).alias("pdb_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_linenumber") <= 3).alias("protein"), *point)
    return contacts_within(a.filter("protein").drop("protein"), a.filter("not protein").drop("protein"), 0.75).select("pdb_id", "p_id", "l_id", "distance")


@query("residue_labels", f"WITH {ATOMS_SQL}, {LABELS_SQL} SELECT pdb_id, residue, site, interacting FROM labels")
def q_residue_labels(spark, d):
    return _labels(spark, d)


@query(
    "keep_sites_with_contact",
    f"WITH {ATOMS_SQL}, {LABELS_SQL} SELECT pdb_id, residue, site, interacting FROM labels WHERE (pdb_id, site) IN (SELECT (pdb_id, site) FROM labels WHERE interacting = 1)",
)
def flagship(spark, d):
    return keep_sites_with_contact(_labels(spark, d), ["pdb_id", "site"])


@query(
    "contact_label",
    f"WITH {ATOMS_SQL} SELECT vec_id, site, (sqrt(x * x + y * y + z * z) <= 2.0)::INT AS interacting FROM atoms",
)
def q_contact_label(spark, d):
    p, q = atoms(spark, d)
    zero = [F.lit(0.0)] * 3
    return p.unionByName(q).select("vec_id", "site", contact_label(euclid([F.col(c) for c in "xyz"], zero), 2.0).alias("interacting"))


@query("euclid", f"WITH {ATOMS_SQL} SELECT vec_id, round(sqrt((x - 1) * (x - 1) + (y - 1) * (y - 1) + (z - 1) * (z - 1)), 3) AS distance FROM atoms")
def q_euclid(spark, d):
    p, q = atoms(spark, d)
    return p.unionByName(q).select("vec_id", F.round(euclid([F.col(c) for c in "xyz"], [F.lit(1.0)] * 3), 3).alias("distance"))


@query(
    "drop_solvent_and_hydrogen",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem
       WHERE NOT (l_returnflag = 'N' AND l_suppkey % 5 = 0) AND l_linestatus || (l_partkey % 3)::VARCHAR <> 'F0'""",
)
def q_drop_solvent_and_hydrogen(spark, d):
    a = table(spark, d, "lineitem").withColumns(
        {
            "group": F.when(F.col("l_returnflag") == "N", "HETATM").otherwise("ATOM"),
            "comp": F.when(F.col("l_suppkey") % 5 == 0, "HOH").otherwise("LIG"),
            "element": F.when((F.col("l_linestatus") == "F") & (F.col("l_partkey") % 3 == 0), "H").otherwise("C"),
        }
    )
    return drop_solvent_and_hydrogen(a).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
