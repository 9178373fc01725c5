"""Curation, joins and set operations. Stand-ins: part as ligands, documents as chain-organism lists, orders and lineitem as entries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitemill.functions import scalar
from sitemill.operators import curate, joins
from sitemill.plans.registry import query, table

T = table

#: Ligands from part: a name, type, chemical type, two identifiers and descriptors, all from its columns.
LIGANDS_SQL = """
lig AS (SELECT p_partkey AS id, p_name AS name, p_type AS kind, p_brand AS chem, p_brand || '-' || p_size % 7 AS smiles,
               CASE WHEN p_size % 5 = 0 THEN '' ELSE p_type || '-' || p_size % 11 END AS inchi, p_size, p_retailprice FROM part)
"""


def ligands(spark, d):
    p = T(spark, d, "part")
    return p.select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.col("p_brand").alias("chem"),
        F.concat_ws("-", "p_brand", (F.col("p_size") % 7).cast("string")).alias("smiles"),
        F.when(F.col("p_size") % 5 == 0, "").otherwise(F.concat_ws("-", "p_type", (F.col("p_size") % 11).cast("string"))).alias("inchi"), "p_size", "p_retailprice",
    )


@query("normalise_keys", "SELECT c_custkey::VARCHAR AS c_custkey, trim(c_name) AS c_name FROM customer")
def q_normalise_keys(spark, d):
    padded = T(spark, d, "customer").withColumn("c_name", F.concat(F.lit("  "), "c_name", F.lit(" ")))
    return curate.normalise_keys(padded, ["c_custkey", "c_name"]).select("c_custkey", "c_name")


@query("filter_chains", "SELECT doc_id FROM documents WHERE source <> 'src0' AND length(text) >= 1500")
def q_filter_chains(spark, d):
    docs = T(spark, d, "documents").withColumn("ligand_id", F.when(F.col("source") == "src0", curate.NO_LIGAND).otherwise(F.col("source")))
    return curate.filter_chains(docs, 1500, "text").select("doc_id")


@query("project", "SELECT o_orderkey AS entry, o_orderpriority AS method FROM orders")
def q_project(spark, d):
    return curate.project(T(spark, d, "orders"), {"o_orderkey": "entry", "o_orderpriority": "method"})


@query("keyword_flag", "SELECT p_partkey, regexp_matches(lower(p_type), 'steel|tin') AS flag FROM part")
def q_keyword_flag(spark, d):
    return T(spark, d, "part").select("p_partkey", curate.keyword_flag(F.col("p_type"), ["STEEL", "Tin"]).alias("flag"))


_ORGANISMS_SQL = "o AS (SELECT source, string_agg(DISTINCT lang, '; ' ORDER BY lang) AS organisms FROM documents GROUP BY source)"


def _organisms(spark, d):
    from sitemill.operators.chains import concat_distinct

    docs = T(spark, d, "documents").withColumnRenamed("lang", "organisms")
    return concat_distinct(docs, ["source"], "organisms").select("source", "organisms")


@query("all_items_match", f"WITH {_ORGANISMS_SQL} SELECT source, coalesce(len(list_filter(string_split(organisms, '; '), lambda x: x NOT IN ('en', 'fr', 'de'))) = 0, true) AS flag FROM o")
def q_all_items_match(spark, d):
    return _organisms(spark, d).select("source", curate.all_items_match(F.col("organisms"), ";", ["en", "fr", "de"]).alias("flag"))


@query("split_by_predicate", "SELECT doc_id, CASE WHEN lang = 'en' THEN 'match' ELSE 'rest' END AS part FROM documents")
def q_split_by_predicate(spark, d):
    a, b = curate.split_by_predicate(T(spark, d, "documents").select("doc_id", "lang"), F.col("lang") == "en")
    return a.withColumn("part", F.lit("match")).unionByName(b.withColumn("part", F.lit("rest"))).drop("lang")


_WORDS = ["steel", "copper"]


@query("forbidden_term_flag", r"SELECT p_partkey, regexp_matches(p_name, '(?i)\b(steel|copper)\b') OR regexp_matches(p_type, '(?i)\b(steel|copper)\b') AS flag FROM part")
def q_forbidden_term_flag(spark, d):
    return T(spark, d, "part").select("p_partkey", curate.forbidden_term_flag([F.col("p_name"), F.col("p_type")], _WORDS).alias("flag"))


def _kinds(spark, d):
    return [r[0] for r in T(spark, d, "part").select("p_type").distinct().orderBy("p_type").limit(3).collect()]  # three names


@query(
    "allowed_type_flag",
    "WITH k AS (SELECT DISTINCT p_type FROM part ORDER BY p_type LIMIT 3) SELECT p_partkey, p_type IN (SELECT p_type FROM k) AND lower(p_brand) IN ('brand#1', 'brand#2', 'brand#12') AS flag FROM part",
)
def q_allowed_type_flag(spark, d):
    return T(spark, d, "part").select("p_partkey", curate.allowed_type_flag(F.col("p_type"), F.col("p_brand"), _kinds(spark, d), ["BRAND#1", "Brand#2", "Brand#12"]).alias("flag"))


_RULES_SQL = """r AS (SELECT id, p_size, CASE WHEN p_size < 5 THEN 'too small' WHEN inchi = '' THEN 'no identifier' WHEN p_retailprice > 1500 THEN 'too dear'
                      WHEN regexp_matches(kind, '(?i)\\b(steel)\\b') THEN 'forbidden term' END AS reason FROM lig)"""


def _waterfall(spark, d):
    rules = [
        (F.col("p_size") < 5, "too small"), (F.col("inchi") == "", "no identifier"), (F.col("p_retailprice") > 1500, "too dear"),
        (curate.forbidden_term_flag([F.col("kind")], ["steel"]), "forbidden term"),
    ]
    return curate.rule_waterfall(ligands(spark, d), rules)


@query("rule_waterfall", f"WITH {LIGANDS_SQL}, {_RULES_SQL} SELECT id, reason FROM r")
def q_rule_waterfall(spark, d):
    return _waterfall(spark, d).select("id", "reason")


@query("review_rows", f"WITH {LIGANDS_SQL}, {_RULES_SQL} SELECT id FROM r WHERE reason IS NULL AND p_size > 40")
def q_review_rows(spark, d):
    return curate.review_rows(_waterfall(spark, d), F.col("p_size") > 40).select("id")


@query("count_by_reason", f"WITH {LIGANDS_SQL}, {_RULES_SQL} SELECT reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY reason")
def q_count_by_reason(spark, d):
    return curate.count_by_reason(_waterfall(spark, d))


@query(
    "preferred_descriptor",
    """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_name WHEN p_size % 3 = 1 THEN p_type END AS smiles,
              CASE WHEN p_size % 2 = 0 THEN p_brand END AS inchikey FROM part""",
)
def q_preferred_descriptor(spark, d):
    item = lambda kind, program, value: F.struct(F.lit(kind).alias("dtype"), F.lit(program).alias("program"), F.col(value).alias("value"))
    size = F.col("p_size")
    all_of = F.array(
        F.when(size % 3 != 2, item("SMILES_CANONICAL", "CACTVS 3", "p_type")), F.when(size % 3 == 0, item("SMILES_CANONICAL", "OpenEye", "p_name")), F.when(size % 2 == 0, item("InChIKey", "InChI", "p_brand")),
    )
    rows = T(spark, d, "part").withColumn("descriptors", F.filter(all_of, lambda x: x.isNotNull()))
    return rows.select(
        "p_partkey", curate.preferred_descriptor(F.col("descriptors"), ["SMILES_CANONICAL"], curate.SMILES_PROGRAMS).alias("smiles"), curate.preferred_descriptor(F.col("descriptors"), ["InChIKey"]).alias("inchikey")
    )


#: SMILES-like texts from part: a fixed list of real strings, picked by key.
_SMILES = ("CCO", "c1ccccc1Cl", "C[C@H](N)C(=O)O", "[Na+].[Cl-]", "OS(=O)(=O)c1ccc(Br)cc1", "[Fe]", "FC(F)(F)I", "[2H]O[2H]")


def _smiles(spark, d):
    pick = F.get(F.array(*map(F.lit, _SMILES)), (F.col("p_partkey") % len(_SMILES)).cast("int"))
    return T(spark, d, "part").select("p_partkey", pick.alias("smiles"))


_SMILES_SQL = "SELECT p_partkey, {0} AS {1} FROM part"


@query("smiles_elements", _SMILES_SQL.format("[['C','O'],['C','Cl'],['C','N','O'],['Cl','Na'],['Br','C','O','S'],['Fe'],['C','F','I'],['H','O']][p_partkey % 8 + 1]", "elements"))
def q_smiles_elements(spark, d):
    return _smiles(spark, d).select("p_partkey", curate.smiles_elements(F.col("smiles")).alias("elements"))


@query("allowed_elements_flag", _SMILES_SQL.format("p_partkey % 8 NOT IN (3, 5)", "flag"))
def q_allowed_elements_flag(spark, d):
    return _smiles(spark, d).select("p_partkey", curate.allowed_elements_flag(F.col("smiles")).alias("flag"))


@query("heavy_atom_count", _SMILES_SQL.format("[3, 7, 6, 2, 11, 1, 5, 1][p_partkey % 8 + 1]", "heavy") + " WHERE p_partkey % 8 NOT IN (0, 3, 5, 7)")
def q_heavy_atom_count(spark, d):
    return _smiles(spark, d).select("p_partkey", curate.heavy_atom_count(F.col("smiles")).alias("heavy")).filter("heavy >= 4")


@query(
    "first_model",
    "WITH f AS (SELECT l_orderkey, min({'a': l_linenumber, 'b': l_returnflag}).b AS m FROM lineitem GROUP BY 1) SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem JOIN f USING (l_orderkey) WHERE l_returnflag = m",
)
def q_first_model(spark, d):
    return curate.first_model(T(spark, d, "lineitem"), "l_orderkey", "l_returnflag", "l_linenumber").select("l_orderkey", "l_linenumber", "l_returnflag")


@query("filter_resolution", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber <> 3 AND l_tax * 100 <= 5.0")
def q_filter_resolution(spark, d):
    rows = T(spark, d, "lineitem").withColumn("resolution", F.when(F.col("l_linenumber") == 3, "N/A").otherwise((F.col("l_tax") * 100).cast("string")))
    return curate.filter_resolution(rows).select("l_orderkey", "l_linenumber")


@query("drop_null_atoms", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey % 7 <> 0 AND l_suppkey % 5 <> 0")
def q_drop_null_atoms(spark, d):
    rows = T(spark, d, "lineitem").withColumns({"a": F.when(F.col("l_partkey") % 7 != 0, "CA"), "b": F.when(F.col("l_suppkey") % 5 != 0, "C1")})
    return curate.drop_null_atoms(rows, ["a", "b"]).select("l_orderkey", "l_linenumber")


@query("bind_columns", "SELECT n_nationkey AS N_NationKey, n_name AS N_NAME FROM nation")
def q_bind_columns(spark, d):
    return curate.bind_columns(T(spark, d, "nation"), ["N_NationKey", "N_NAME"])


@query("clean_sequence", "SELECT p_partkey, regexp_replace(regexp_replace(upper(p_name), '\\s+', '', 'g'), '[UZOB]', 'X', 'g') AS sequence FROM part")
def q_clean_sequence(spark, d):
    return T(spark, d, "part").select("p_partkey", scalar.clean_sequence(F.col("p_name")).alias("sequence"))


@query("drop_blank", "SELECT doc_id FROM documents WHERE doc_id % 4 <> 0 AND doc_id % 5 <> 0")
def q_drop_blank(spark, d):
    rows = T(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 4 != 0, F.col("source")).alias("a"), F.when(F.col("doc_id") % 5 == 0, " ").otherwise("x").alias("b"))
    return curate.drop_blank(rows, ["a", "b"]).select("doc_id")


@query("conflict_members", f"WITH {LIGANDS_SQL} SELECT id FROM lig WHERE inchi <> '' AND inchi IN (SELECT inchi FROM lig GROUP BY inchi HAVING count(DISTINCT smiles) > 1)")
def q_conflict_members(spark, d):
    return curate.conflict_members(ligands(spark, d), "inchi", "smiles", nonempty=True).select("id")


@query("duplicate_ids", f"WITH {LIGANDS_SQL} SELECT id FROM lig QUALIFY row_number() OVER (PARTITION BY smiles, inchi ORDER BY id) > 1")
def q_duplicate_ids(spark, d):
    return curate.duplicate_ids(ligands(spark, d), ["smiles", "inchi"], "id", "id")


@query(
    "resolve_conflicts",
    f"""WITH {LIGANDS_SQL}, fine AS (SELECT *, p_partkey2 AS k2 FROM (SELECT *, id % 40 AS p_partkey2 FROM lig)), g AS (SELECT id, kind || k2 AS smiles, CASE WHEN id % 9 = 0 THEN '' ELSE chem || k2 || (id % 97 = 0)::INT END AS inchi FROM fine),
    bad AS (SELECT id FROM g WHERE smiles IN (SELECT smiles FROM g GROUP BY 1 HAVING count(DISTINCT inchi) > 1)
      UNION SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY smiles, inchi ORDER BY id) AS rn FROM g) WHERE rn > 1
      UNION SELECT id FROM g WHERE inchi <> '' AND inchi IN (SELECT inchi FROM g GROUP BY 1 HAVING count(DISTINCT smiles) > 1))
    SELECT id, CASE WHEN id IN (SELECT id FROM bad) THEN 'removed' ELSE 'kept' END AS part FROM g""",
)
def q_resolve_conflicts(spark, d):
    k2 = (F.col("id") % 40).cast("string")
    inchi = F.when(F.col("id") % 9 == 0, "").otherwise(F.concat("chem", k2, (F.col("id") % 97 == 0).cast("int").cast("string")))
    g = ligands(spark, d).select("id", F.concat("kind", k2).alias("smiles"), inchi.alias("inchi"))
    kept, removed = curate.resolve_conflicts(g, "id", "smiles", "inchi", "id")
    return kept.select("id", F.lit("kept").alias("part")).unionByName(removed.select("id", F.lit("removed").alias("part")))


@query(
    "duplicate_report",
    f"""WITH {LIGANDS_SQL}, v AS (SELECT inchi, count(*) AS n FROM lig WHERE inchi <> '' GROUP BY 1)
    SELECT count_if(n > 1)::BIGINT AS repeated_values, coalesce(sum(n) FILTER (WHERE n > 1), 0)::BIGINT AS repeated_rows, count(*) AS n_distinct, sum(n)::BIGINT AS total FROM v""",
)
def q_duplicate_report(spark, d):
    return curate.duplicate_report(ligands(spark, d), "inchi")


@query(
    "dataset_summary",
    """SELECT 'l_orderkey' AS what, count(DISTINCT l_orderkey) AS n FROM lineitem UNION ALL SELECT 'l_partkey', count(DISTINCT l_partkey) FROM lineitem
       UNION ALL SELECT 'l_suppkey', count(DISTINCT l_suppkey) FROM lineitem UNION ALL SELECT 'l_returnflag', count(DISTINCT l_returnflag) FROM lineitem""",
)
def q_dataset_summary(spark, d):
    return curate.dataset_summary(T(spark, d, "lineitem"), ["l_orderkey", "l_partkey", "l_suppkey", "l_returnflag"])


@query("restrict_to_keys", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 100000)")
def q_restrict_to_keys(spark, d):
    keys = T(spark, d, "orders").filter("o_totalprice > 100000").select(F.col("o_orderkey").alias("l_orderkey"))
    return joins.restrict_to_keys(T(spark, d, "lineitem"), keys.union(keys), ["l_orderkey"]).select("l_orderkey", "l_linenumber")


@query("attach", "SELECT o_orderkey, c_name, c_mktsegment FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def q_attach(spark, d):
    dim = T(spark, d, "customer").withColumnRenamed("c_custkey", "o_custkey")
    return joins.attach(T(spark, d, "orders"), dim, ["o_custkey"], ["c_name", "c_mktsegment"]).select("o_orderkey", "c_name", "c_mktsegment")


@query("semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def q_semi(spark, d):
    keys = T(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return joins.semi(T(spark, d, "customer"), keys, ["c_custkey"]).select("c_custkey")


@query("anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def q_anti(spark, d):
    keys = T(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return joins.anti(T(spark, d, "customer"), keys, ["c_custkey"]).select("c_custkey")


@query(
    "patch_unknown",
    """WITH c AS (SELECT source, min(lang) AS fix FROM documents WHERE lang IS NOT NULL GROUP BY source)
       SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND fix IS NOT NULL THEN fix WHEN doc_id % 3 = 0 THEN 'unknown' ELSE lang END AS organism, doc_id % 3 = 0 AND fix IS NOT NULL AS patched
       FROM documents LEFT JOIN c USING (source)""",
)
def q_patch_unknown(spark, d):
    docs = T(spark, d, "documents")
    rows = docs.select("doc_id", "source", F.when(F.col("doc_id") % 3 == 0, "unknown").otherwise(F.col("lang")).alias("organism"))
    fixes = docs.filter("lang is not null").select("source", F.col("lang").alias("organism"))
    return joins.patch_unknown(rows, fixes, ["source"], "organism").select("doc_id", "organism", "patched")


@query("coverage_audit", "SELECT DISTINCT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000")
def q_coverage_audit(spark, d):
    return joins.coverage_audit(T(spark, d, "customer").select(F.col("c_custkey").alias("k")), T(spark, d, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("k")), ["k"])


@query("lookup", "SELECT l_orderkey, l_linenumber, m.p_name AS p_name FROM lineitem LEFT JOIN (SELECT p_partkey, min(p_name) AS p_name FROM part WHERE p_size > 10 GROUP BY 1) m ON m.p_partkey = l_partkey")
def q_lookup(spark, d):
    m = T(spark, d, "part").filter("p_size > 10").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    return joins.lookup(T(spark, d, "lineitem"), m, "l_partkey", "p_name").select("l_orderkey", "l_linenumber", "p_name")


@query("union_rows", "SELECT c_custkey AS k FROM customer UNION ALL SELECT o_custkey FROM orders")
def q_union_rows(spark, d):
    return joins.union_rows(T(spark, d, "customer").select(F.col("c_custkey").alias("k")), T(spark, d, "orders").select(F.col("o_custkey").alias("k")))


@query("union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier UNION SELECT n_nationkey FROM nation")
def q_union_distinct(spark, d):
    return joins.union_distinct(
        T(spark, d, "customer").select(F.col("c_nationkey").alias("k")), T(spark, d, "supplier").select(F.col("s_nationkey").alias("k")), T(spark, d, "nation").select(F.col("n_nationkey").alias("k"))
    )


@query(
    "except_keys",
    "WITH a AS (SELECT c_custkey AS k FROM customer), b AS (SELECT o_custkey + 3 AS k FROM orders) SELECT k, 'left' AS side FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT k, 'right' FROM (SELECT k FROM b EXCEPT SELECT k FROM a)",
)
def q_except_keys(spark, d):
    return joins.except_keys(T(spark, d, "customer").select(F.col("c_custkey").alias("k")), T(spark, d, "orders").select((F.col("o_custkey") + 3).alias("k")))


@query("overlap", "SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders")
def q_overlap(spark, d):
    return joins.overlap(T(spark, d, "customer").select(F.col("c_custkey").alias("k")), T(spark, d, "orders").select(F.col("o_custkey").alias("k")))


@query("make_key", "SELECT l_orderkey, l_linenumber, l_orderkey || ':' || l_returnflag || ':' || l_suppkey || '_' || l_linestatus AS key FROM lineitem")
def q_make_key(spark, d):
    site = F.concat_ws("_", F.col("l_suppkey").cast("string"), "l_linestatus")
    return T(spark, d, "lineitem").select("l_orderkey", "l_linenumber", scalar.make_key(F.col("l_orderkey").cast("string"), F.col("l_returnflag"), site).alias("key"))


@query("parse_key", "SELECT l_linenumber, l_orderkey::VARCHAR AS pdb_id, l_returnflag AS chain_id, l_suppkey || '_' || l_linestatus AS lig_site, l_suppkey::VARCHAR AS lig_id FROM lineitem")
def q_parse_key(spark, d):
    return scalar.parse_key(q_make_key(spark, d)).select("l_linenumber", "pdb_id", "chain_id", "lig_site", "lig_id")


@query("explode_list", f"WITH {_ORGANISMS_SQL} SELECT source, unnest(string_split(organisms, '; ')) AS organism FROM o")
def q_explode_list(spark, d):
    return scalar.explode_list(_organisms(spark, d), "organisms", "organism", ";").select("source", "organism")


@query("safe_name", "SELECT p_partkey, regexp_replace(p_brand || ' ' || p_type, '[^A-Za-z0-9._-]', '_', 'g') AS name FROM part")
def q_safe_name(spark, d):
    return T(spark, d, "part").select("p_partkey", scalar.safe_name(F.concat_ws(" ", "p_brand", "p_type")).alias("name"))


@query("quoted_tokens", """SELECT p_partkey, [p_brand, p_name, 'x'] AS tokens FROM part""")
def q_quoted_tokens(spark, d):
    return T(spark, d, "part").select("p_partkey", scalar.quoted_tokens(F.concat("p_brand", F.lit(' "'), "p_name", F.lit('"  x'))).alias("tokens"))


@query("drop_repeat_rows", "SELECT p_brand, p_type, min(p_partkey) AS p_partkey FROM part GROUP BY 1, 2")
def q_drop_repeat_rows(spark, d):
    return scalar.drop_repeat_rows(T(spark, d, "part").select("p_partkey", "p_brand", "p_type"), ["p_brand", "p_type"])
