"""Chains, residues, binding sites and their deduplication. Stand-ins: lineitem as atoms and as sites, documents and part as texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitemill.functions import scalar
from sitemill.operators import chains, joins
from sitemill.plans.registry import query, table
from sitemill.sources.sinks import export_distinct

T = table
_AA = sorted(scalar.AA3)
#: Atoms from lineitem: the order is the entry, the flag the kind, the part the residue. Lines get a number of their own.
ATOMS_SQL = f"""
a AS (SELECT l_orderkey % 2000 AS pdb_id, l_orderkey * 100 + l_linenumber * 10 + l_partkey % 10 AS line_no, CASE WHEN l_returnflag = 'N' THEN 'HETATM' ELSE 'ATOM' END AS grp,
             {_AA}[(l_partkey % 20 + 1)::INT] AS aa, CASE WHEN l_returnflag = 'N' THEN 'L' || l_suppkey % 9 ELSE {_AA}[(l_partkey % 20 + 1)::INT] END AS comp,
             l_linestatus AS asym, (l_partkey % 12)::INT AS seq_id, l_suppkey::VARCHAR AS auth_seq, l_shipdate::DATE::VARCHAR AS auth_asym, l_suppkey, l_partkey FROM lineitem)
"""


def atoms(spark, d):
    aa = F.get(F.array(*map(F.lit, _AA)), (F.col("l_partkey") % 20).cast("int"))
    het = F.col("l_returnflag") == "N"
    return T(spark, d, "lineitem").select(
        (F.col("l_orderkey") % 2000).alias("pdb_id"), (F.col("l_orderkey") * 100 + F.col("l_linenumber") * 10 + F.col("l_partkey") % 10).alias("line_no"),
        F.when(het, "HETATM").otherwise("ATOM").alias("group"), F.when(het, F.concat(F.lit("L"), (F.col("l_suppkey") % 9).cast("string"))).otherwise(aa).alias("comp"),
        F.col("l_linestatus").alias("asym"), (F.col("l_partkey") % 12).cast("int").alias("seq_id"), F.col("l_suppkey").cast("string").alias("auth_seq"),
        F.col("l_shipdate").cast("date").cast("string").alias("auth_asym"), "l_suppkey", "l_partkey",
    )


@query(
    "build_chains",
    f"""WITH {ATOMS_SQL}, f AS (SELECT pdb_id, asym, seq_id, min({{'l': line_no, 'c': comp}}) AS m FROM a WHERE grp = 'ATOM' GROUP BY ALL),
    one AS (SELECT MAP {{{", ".join(f"'{k}': '{v}'" for k, v in scalar.AA3.items())}}} AS t),
    r AS (SELECT pdb_id, asym, seq_id, m.l AS l, m.c AS c, coalesce(t[m.c], 'X') AS o FROM f, one),
    g AS (SELECT pdb_id, string_agg(DISTINCT comp, ',' ORDER BY comp) AS ligand_id FROM a WHERE grp = 'HETATM' GROUP BY 1)
    SELECT r.pdb_id, asym AS chain_id, string_agg(c, '-' ORDER BY l, seq_id, c) AS sequence_3l, string_agg(o, '' ORDER BY l, seq_id, c) AS sequence_1l,
           string_agg(seq_id::VARCHAR, '-' ORDER BY l, seq_id, c) AS positions, coalesce(any_value(ligand_id), 'NO_LIGAND') AS ligand_id
    FROM r LEFT JOIN g ON g.pdb_id = r.pdb_id GROUP BY r.pdb_id, asym""",
)
def q_build_chains(spark, d):
    return chains.build_chains(atoms(spark, d))


@query(
    "filter_ambiguous",
    f"""WITH {ATOMS_SQL}, k AS (SELECT pdb_id, asym FROM a GROUP BY ALL HAVING count_if(grp = 'ATOM' AND l_partkey % 11 <> 0) > 0
    AND count_if(l_partkey % 11 = 0)::DOUBLE / count_if(grp = 'ATOM' AND l_partkey % 11 <> 0) <= 0.1) SELECT pdb_id, asym, line_no FROM a WHERE (pdb_id, asym) IN (SELECT (pdb_id, asym) FROM k)""",
)
def q_filter_ambiguous(spark, d):
    return chains.filter_ambiguous(atoms(spark, d), F.col("l_partkey") % 11 == 0, 0.1).select("pdb_id", "asym", "line_no")


@query(
    "residue_author_map",
    f"WITH {ATOMS_SQL}, m AS (SELECT pdb_id, asym, seq_id, min({{'l': line_no, 's': auth_seq, 'a': auth_asym}}) AS m FROM a GROUP BY ALL) SELECT pdb_id, asym, seq_id, m.s AS auth_seq, m.a AS auth_asym FROM m",
)
def q_residue_author_map(spark, d):
    return chains.residue_author_map(atoms(spark, d))


@query(
    "filter_structures",
    f"""WITH {ATOMS_SQL}, o AS (SELECT * FROM a WHERE grp = 'ATOM' AND (pdb_id, asym) IN (SELECT (pdb_id, asym) FROM a WHERE seq_id = 0))
    SELECT pdb_id, asym, line_no, comp FROM o UNION ALL SELECT pdb_id, asym, line_no, comp FROM a WHERE grp = 'HETATM' AND comp IN ('L1', 'L4')
    AND (pdb_id, asym) IN (SELECT (pdb_id, asym) FROM o)""",
)
def q_filter_structures(spark, d):
    a = atoms(spark, d)
    listed = a.filter("seq_id = 0").select("pdb_id", "asym")
    return chains.filter_structures(a, listed, a.filter(F.col("comp").isin("L1", "L4")).select("comp")).select("pdb_id", "asym", "line_no", "comp")


@query(
    "remap_modified",
    f"""WITH {ATOMS_SQL}, m AS (SELECT pdb_id, asym, seq_id, comp, min(CASE WHEN l_suppkey % 2 = 0 THEN 'SER' ELSE 'ZZZ' END) AS parent FROM a WHERE grp = 'HETATM' AND l_partkey % 3 = 0 GROUP BY ALL)
    SELECT a.pdb_id, a.line_no, CASE WHEN grp = 'HETATM' AND parent = 'SER' THEN 'ATOM' ELSE grp END AS "group", CASE WHEN grp = 'HETATM' AND parent = 'SER' THEN 'SER' ELSE a.comp END AS comp
    FROM a LEFT JOIN m ON m.pdb_id = a.pdb_id AND m.asym = a.asym AND m.seq_id = a.seq_id AND m.comp = a.comp WHERE NOT (grp = 'HETATM' AND coalesce(parent, '') = 'ZZZ')""",
)
def q_remap_modified(spark, d):
    a = atoms(spark, d)
    mods = a.filter("group = 'HETATM' and l_partkey % 3 = 0").select("pdb_id", "asym", "seq_id", "comp", F.when(F.col("l_suppkey") % 2 == 0, "SER").otherwise("ZZZ").alias("parent"))
    return joins.remap_modified(a, mods, _AA).filter("not ambiguous").select("pdb_id", "line_no", "group", "comp")


@query("aa_one_letter", f"WITH {ATOMS_SQL}, one AS (SELECT MAP {{{', '.join(f'{chr(39)}{k}{chr(39)}: {chr(39)}{v}{chr(39)}' for k, v in scalar.AA3.items())}}} AS t) SELECT line_no, comp, t[comp] AS one FROM a, one")
def q_aa_one_letter(spark, d):
    return scalar.aa_one_letter(atoms(spark, d), "comp", "one").select("line_no", "comp", "one")


@query("residue_ordinal", "SELECT p_partkey, i::INT AS position, p_name[i] AS residue FROM part, unnest(generate_series(1, length(p_name))) AS s(i)")
def q_residue_ordinal(spark, d):
    return scalar.residue_ordinal(T(spark, d, "part").select("p_partkey", "p_name"), "p_name").select("p_partkey", "position", "residue")


def _spelled(more, item):
    """Items for each letter of the name and some more, joined by dashes."""
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length("p_name") + more), item), "-")


@query(
    "zip_residues",
    """WITH z AS (SELECT p_partkey, p_name AS s, list_transform(generate_series(1, length(p_name) + 2), lambda i: chr((65 + i % 26)::INT) || 'LA') AS t, list_transform(generate_series(1, length(p_name) + 1), lambda i: (7 * i)::VARCHAR) AS p FROM part)
    SELECT p_partkey, (i - 1)::INT AS ord, s[i] AS residue_1l, t[i] AS residue_3l, p[i]::INT AS position FROM z, unnest(generate_series(1, least(length(s), len(t), len(p)))) AS g(i)""",
)
def q_zip_residues(spark, d):
    rows = T(spark, d, "part").select("p_partkey", "p_name", _spelled(2, lambda i: F.concat(F.char(65 + i % 26), F.lit("LA"))).alias("three"), F.concat(_spelled(1, lambda i: (7 * i).cast("string")), F.lit("-x")).alias("positions"))
    return joins.zip_residues(rows, "p_name", "three", "positions")


@query(
    "check_sequence",
    """SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'skipped' ELSE 'kept' END AS part FROM part""",
)
def q_check_sequence(spark, d):
    p = T(spark, d, "part").select("p_partkey", F.col("p_name").alias("sequence"))
    labels = scalar.residue_ordinal(p).withColumnRenamed("residue", "residue_1l").drop("sequence")
    labels = labels.filter("not (p_partkey % 5 = 0 and position = 2)")
    kept, skipped = joins.check_sequence(labels, p, ["p_partkey"], ["p_partkey"])
    return kept.select("p_partkey").distinct().withColumn("part", F.lit("kept")).unionByName(skipped.withColumn("part", F.lit("skipped")))


@query("concat_distinct", "SELECT source, string_agg(DISTINCT lang, '; ' ORDER BY lang) AS lang FROM documents GROUP BY source")
def q_concat_distinct(spark, d):
    return chains.concat_distinct(T(spark, d, "documents"), ["source"], "lang")


@query("concat_nonempty", "SELECT doc_id // 8 AS entry, coalesce(string_agg(lang, '; ' ORDER BY doc_id) FILTER (WHERE doc_id % 4 <> 0), '') AS lang FROM documents GROUP BY 1")
def q_concat_nonempty(spark, d):
    docs = T(spark, d, "documents").withColumn("lang", F.when(F.col("doc_id") % 4 == 0, " ").otherwise(F.col("lang"))).withColumn("entry", F.floor(F.col("doc_id") / 8))
    return chains.concat_nonempty(docs, ["entry"], "doc_id", "lang")


@query("melt", "SELECT p_partkey, 'p_brand' AS variable, p_brand AS value FROM part UNION ALL SELECT p_partkey, 'p_type', p_type FROM part")
def q_melt(spark, d):
    return chains.melt(T(spark, d, "part").select("p_partkey", "p_brand", "p_type"), ["p_partkey"], ["p_brand", "p_type"])


#: Binding sites: an entry, a ligand and a chain; residues by part, positive by quantity.
SITES_SQL = """
sl AS (SELECT l_orderkey % 500 AS pdb_id, l_suppkey % 10 AS lig_id, l_returnflag AS lig_chain, l_linestatus AS sequence_1l, (l_partkey % 7)::INT AS position,
              chr((65 + l_partkey % 7)::INT) AS residue_1l, max((l_quantity > 20)::INT) AS interacting, min(l_tax) AS resolution FROM lineitem GROUP BY ALL)
"""
_SITE = ["pdb_id", "sequence_1l", "lig_id", "lig_chain"]
_ROWS_SQL = f"""{SITES_SQL}, pat AS (SELECT pdb_id, sequence_1l, lig_id, lig_chain, string_agg(position || '_' || residue_1l, ',' ORDER BY position || '_' || residue_1l) AS pattern,
    count(*)::INT AS n_interacting FROM sl WHERE interacting = 1 GROUP BY ALL),
res AS (SELECT pdb_id, sequence_1l, lig_id, lig_chain, min(resolution) AS resolution FROM sl GROUP BY ALL),
st AS (SELECT *, pdb_id || ':' || sequence_1l || ':' || lig_id || '_' || lig_chain AS row_id, sequence_1l AS chain_id FROM pat JOIN res USING (pdb_id, sequence_1l, lig_id, lig_chain)),
w1 AS (SELECT *, row_number() OVER w AS rn, first(row_id) OVER w AS kr, first(resolution) OVER w AS kres FROM st WINDOW w AS (PARTITION BY pdb_id, sequence_1l, lig_id, pattern ORDER BY lig_chain, row_id)),
w2 AS (SELECT * EXCLUDE (rn, kr, kres), row_number() OVER w AS rn, first(row_id) OVER w AS kr, first(resolution) OVER w AS kres FROM w1 WHERE rn = 1
       WINDOW w AS (PARTITION BY sequence_1l, lig_id, pattern ORDER BY resolution, pdb_id, chain_id, lig_chain, row_id))"""


def site_labels(spark, d):
    rows = T(spark, d, "lineitem").select(
        (F.col("l_orderkey") % 500).alias("pdb_id"), (F.col("l_suppkey") % 10).alias("lig_id"), F.col("l_returnflag").alias("lig_chain"), F.col("l_linestatus").alias("sequence_1l"),
        (F.col("l_partkey") % 7).cast("int").alias("position"), F.char(65 + F.col("l_partkey") % 7).alias("residue_1l"), "l_quantity", "l_tax",
    )
    return rows.groupBy("pdb_id", "lig_id", "lig_chain", "sequence_1l", "position", "residue_1l").agg(
        F.max((F.col("l_quantity") > 20).cast("int")).alias("interacting"), F.min("l_tax").alias("resolution")
    )


def sites(spark, d):
    labels = site_labels(spark, d)
    pattern = chains.residue_pattern(labels, _SITE).withColumn("pattern", F.array_join("pattern", ","))
    resolution = labels.groupBy(*_SITE).agg(F.min("resolution").alias("resolution"))
    row_id = F.concat(F.col("pdb_id").cast("string"), F.lit(":"), "sequence_1l", F.lit(":"), F.col("lig_id").cast("string"), F.lit("_"), "lig_chain")
    return pattern.join(resolution, _SITE).withColumns({"row_id": row_id, "chain_id": F.col("sequence_1l")})


@query("residue_pattern", f"WITH {_ROWS_SQL} SELECT pdb_id, sequence_1l, lig_id, lig_chain, pattern, n_interacting FROM st")
def q_residue_pattern(spark, d):
    return sites(spark, d).select(*_SITE, "pattern", "n_interacting")


@query(
    "filter_scattered",
    f"WITH {SITES_SQL} SELECT pdb_id, sequence_1l, lig_id, lig_chain FROM sl WHERE interacting = 1 GROUP BY ALL HAVING count(DISTINCT position) >= 2 AND max(position) - min(position) <> count(DISTINCT position) - 1",
)
def q_filter_scattered(spark, d):
    return chains.filter_scattered(site_labels(spark, d), _SITE)


@query("dedup_within_entry", f"WITH {_ROWS_SQL} SELECT row_id, resolution FROM w1 WHERE rn = 1")
def q_dedup_within_entry(spark, d):
    return chains.dedup_within_entry(sites(spark, d)).select("row_id", "resolution")


@query("dedup_across_entries", f"WITH {_ROWS_SQL} SELECT row_id, resolution FROM w2 WHERE rn = 1")
def q_dedup_across_entries(spark, d):
    return chains.dedup_across_entries(chains.dedup_within_entry(sites(spark, d))).select("row_id", "resolution")


@query(
    "dedup_audit",
    f"""WITH {_ROWS_SQL} SELECT row_id AS removed_row, kr AS kept_row, resolution AS removed_resolution, kres AS kept_resolution, 'same entry' AS reason FROM w1 WHERE rn > 1
    UNION ALL SELECT row_id, kr, resolution, kres, 'across entries' FROM w2 WHERE rn > 1""",
)
def q_dedup_audit(spark, d):
    return chains.dedup_audit(sites(spark, d))


@query("sorted_distinct", "SELECT DISTINCT l_suppkey FROM lineitem ORDER BY 1")
def q_sorted_distinct(spark, d):
    return chains.sorted_distinct(T(spark, d, "lineitem"), "l_suppkey")


@query("export_distinct", "SELECT DISTINCT l_returnflag || chr(9) || l_suppkey AS value FROM lineitem ORDER BY 1")
def q_export_distinct(spark, d):
    return export_distinct(T(spark, d, "lineitem"), ["l_returnflag", "l_suppkey"])


@query(
    "cluster_sizes",
    """WITH s AS (SELECT l_partkey % 40 AS c, count(*) AS n, min(l_orderkey || ':' || l_linenumber) AS sample FROM lineitem GROUP BY 1)
    SELECT count(*) AS n_clusters, min(n) AS smallest, floor(sum(n) / count(*))::BIGINT AS mean_size, max(n) AS largest, (SELECT sample FROM s ORDER BY n DESC, c LIMIT 1) AS sample FROM s""",
)
def q_cluster_sizes(spark, d):
    rows = T(spark, d, "lineitem").select((F.col("l_partkey") % 40).alias("cluster_id"), F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("pdb_chain"))
    return chains.cluster_sizes(rows)
