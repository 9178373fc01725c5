"""Readers, writers, encoders and models. The text files are written from the driver's tables to the shared folder, then read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitemill.operators import encoders, models
from sitemill.operators.features import fit_scaler
from sitemill.plans.registry import query, scratch, table
from sitemill.sources import readers, sinks

T = table


def _text(df: DataFrame, name: str) -> str:
    path = scratch(df.sparkSession, name)
    df.write.text(path)
    return path


@query("read_id_list", "SELECT lower(trim(c_name)) AS id FROM customer")
def q_read_id_list(spark, d):
    lines = T(spark, d, "customer").select(F.concat(F.lit(" "), F.upper("c_name"), F.lit("  \n")).alias("value"))
    return readers.read_id_list(spark, _text(lines, "ids"))


@query("read_token_list", "SELECT DISTINCT upper(p_brand) AS token FROM part WHERE p_partkey % 9 <> 0")
def q_read_token_list(spark, d):
    lines = T(spark, d, "part").select(F.concat(F.when(F.col("p_partkey") % 9 == 0, '""').otherwise(F.col("p_brand")), F.lit("\t"), "p_name").alias("value"))
    return readers.read_token_list(spark, _text(lines, "tokens"))


@query("read_table", "SELECT c_custkey::VARCHAR AS c_custkey, CASE WHEN c_nationkey % 5 = 0 THEN 'NA' WHEN c_nationkey % 5 = 1 THEN '' ELSE c_name END AS c_name FROM customer")
def q_read_table(spark, d):
    name = F.when(F.col("c_nationkey") % 5 == 0, "NA").when(F.col("c_nationkey") % 5 == 1, "").otherwise(F.col("c_name"))
    rows = T(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("c_custkey"), name.alias("c_name"))
    path = scratch(spark, "table")
    rows.write.csv(path, header=True, emptyValue="")
    return readers.read_table(spark, path, "c_custkey string, c_name string")


@query("read_headerless", "SELECT p_partkey::VARCHAR AS id, p_brand AS name, p_type AS Org_0, CASE WHEN p_size % 2 = 0 THEN p_name END AS Org_1 FROM part")
def q_read_headerless(spark, d):
    line = F.concat_ws(",", F.col("p_partkey").cast("string"), "p_brand", "p_type", F.when(F.col("p_size") % 2 == 0, F.col("p_name")))
    return readers.read_headerless(spark, _text(T(spark, d, "part").select(line.alias("value")), "headerless"), ["id", "name"], "Org_", 2)


@query("read_fasta", "SELECT 'p' || p_partkey AS id, replace(p_name, ' ', '') || upper(replace(p_type, ' ', '')) AS sequence FROM part")
def q_read_fasta(spark, d):
    record = F.concat(F.lit(">p"), F.col("p_partkey").cast("string"), F.lit(" some > words\n"), "p_name", F.lit("\n"), F.upper("p_type"))
    return readers.read_fasta(spark, _text(T(spark, d, "part").select(record.alias("value")), "fasta"))


@query("read_cluster_listing", "SELECT (p_partkey // 50)::VARCHAR AS cluster_id, p_partkey || ':chain_' || p_size AS pdb_chain FROM part")
def q_read_cluster_listing(spark, d):
    member = F.concat(F.lit(">"), F.col("p_partkey").cast("string"), F.lit("_chain_"), F.col("p_size").cast("string"))
    # Clusters of fifty members at most, so that their number grows with the table.
    blocks = T(spark, d, "part").groupBy(F.floor(F.col("p_partkey") / 50).alias("c")).agg(F.array_join(F.collect_list(member), "\n").alias("m"))
    return readers.read_cluster_listing(spark, _text(blocks.select(F.concat(F.lit("Cluster# "), F.col("c").cast("string"), F.lit("\n"), "m").alias("value")), "clusters"))


_CIF_HEAD = "\n".join(["loop_", *[f"_atom_site.{c}" for c in ("group_PDB", "id", "type_symbol", "label_atom_id", "label_comp_id", "label_asym_id", "label_seq_id", "Cartn_x", "Cartn_y", "Cartn_z")]])


@query("read_atoms", "SELECT vec_id AS \"serial\", CASE WHEN label < 5 THEN 'ATOM' ELSE 'HETATM' END AS \"group\", CASE WHEN label < 5 THEN (vec_id % 50)::INT ELSE -1 END AS seq_id, round(embedding[1]::DOUBLE * 10, 3) AS x, round(embedding[2]::DOUBLE * 10, 3) AS y, round(embedding[3]::DOUBLE * 10, 3) AS z FROM embeddings")
def q_read_atoms(spark, d):
    """A file for each of some entries; the serial number stands in the atom's name."""
    e = T(spark, d, "embeddings")
    num = lambda i: F.round(F.col("embedding")[i].cast("double") * 10, 3).cast("string")
    line = F.concat_ws(
        " ", F.when(F.col("label") < 5, "ATOM").otherwise("HETATM"), F.lit("1"), F.lit("C"), F.concat(F.lit('"A '), F.col("vec_id").cast("string"), F.lit('"')), F.lit("ALA"), F.lit("A"),
        F.when(F.col("label") < 5, (F.col("vec_id") % 50).cast("string")).otherwise("."), num(0), num(1), num(2),
    )
    files = e.groupBy(F.floor(F.col("vec_id") / 1000).alias("f")).agg(F.concat(F.lit(_CIF_HEAD + "\n"), F.array_join(F.collect_list(line), "\n"), F.lit("\n#\nshort line\n")).alias("value"))
    path = scratch(spark, "structures")
    files.repartition(F.col("f")).write.partitionBy("f").text(path)
    return readers.read_atoms(spark, f"{path}/*/*").select(F.split_part("atom", F.lit(" "), F.lit(2)).cast("long").alias("serial"), "group", "seq_id", "x", "y", "z")


_MOD_HEAD = "\n".join(["loop_", *[f"_pdbx_struct_mod_residue.{c}" for c in ("id", "label_asym_id", "label_seq_id", "label_comp_id", "parent_comp_id")]])


@query("read_modified_residues", "SELECT chr((65 + p_size % 26)::INT) AS asym, p_partkey::VARCHAR AS seq_id, 'MSE' AS comp, 'MET' AS parent FROM part")
def q_read_modified_residues(spark, d):
    line = F.concat_ws(" ", F.lit("1"), F.char(65 + F.col("p_size") % 26), F.col("p_partkey").cast("string"), F.lit("MSE"), F.lit("MET"))
    files = T(spark, d, "part").groupBy(F.floor(F.col("p_partkey") / 1000).alias("f")).agg(F.concat(F.lit(_MOD_HEAD + "\n"), F.array_join(F.collect_list(line), "\n"), F.lit("\n#")).alias("value"))
    path = scratch(spark, "modified")
    files.repartition(F.col("f")).write.partitionBy("f").text(path)
    return readers.read_modified_residues(spark, f"{path}/*/*").select("asym", "seq_id", "comp", "parent")


@query("read_components", "SELECT 'L' || p_partkey AS id, 'HETAIN' AS type, 'non-polymer ' || p_brand AS chem_type, p_name AS name, p_type AS smiles, 1 AS n_descriptors FROM part")
def q_read_components(spark, d):
    ident = F.concat(F.lit("L"), F.col("p_partkey").cast("string"))
    block = F.concat(
        F.lit("data_"), ident, F.lit("\n_chem_comp.id "), ident, F.lit('\n_chem_comp.name "'), "p_name", F.lit("\"\n_chem_comp.type 'non-polymer "), "p_brand", F.lit("'\n_chem_comp.pdbx_type HETAIN\nloop_\n"),
        ident, F.lit(' SMILES "OpenEye OEToolkits" 1.7 "'), "p_type", F.lit('"\nXXX SMILES other 1.0 "none"'),
    )
    out = readers.read_components(spark, _text(T(spark, d, "part").select(block.alias("value")), "components"))
    return out.select("id", "type", "chem_type", "name", F.get("descriptors", 0)["value"].alias("smiles"), F.size("descriptors").alias("n_descriptors"))


@query(
    "entity_organisms",
    """SELECT p_partkey AS pdb_id, 'X-ray' AS experimental_method, p_size::DOUBLE AS resolution, c AS chain_id, CASE WHEN p_size % 3 = 0 THEN p_brand WHEN p_size % 3 = 1 THEN 'guessed' ELSE 'unknown' END AS organism
    FROM part, (VALUES ('A'), ('B')) AS v(c) WHERE p_size % 2 = 0""",
)
def q_entity_organisms(spark, d):
    source = F.when(F.col("p_size") % 3 == 0, F.array(F.struct(F.col("p_brand").alias("organism_scientific_name")))).otherwise(F.array().cast("array<struct<organism_scientific_name:string>>"))
    name = F.when(F.col("p_size") % 3 == 1, "some Viral thing").otherwise("enzyme")
    entity = F.array(
        F.struct(F.lit("polypeptide(L)").alias("molecule_type"), F.array(F.lit("A"), F.lit("B")).alias("in_struct_asyms"), F.array(name).alias("molecule_name"), F.array(F.lit("syn")).alias("synonym"), source.alias("source"))
    )
    landed = T(spark, d, "part").select(
        F.col("p_partkey").alias("pdb_id"), F.when(F.col("p_size") % 2 == 0, "X-ray").otherwise("").alias("experimental_method"), F.array(F.col("p_size").cast("double")).alias("resolutions"), F.to_json(entity).alias("entities")
    )
    return readers.entity_organisms(landed, ["viral"], "guessed")


@query("read_sites", "SELECT '1abc' AS pdb_id, l_returnflag AS chain_id, 'LIG' AS lig_id, l_linestatus AS lig_chain, l_orderkey::VARCHAR AS v FROM lineitem")
def q_read_sites(spark, d):
    """A file for each of the six sites in the lineitem flags, written once more under names as the reader wants them."""
    rows = T(spark, d, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_orderkey").cast("string").alias("v"))
    path = scratch(spark, "sites")
    rows.write.partitionBy("l_returnflag", "l_linestatus").csv(path + "/parts", header=True, compression="gzip")
    sc = spark.sparkContext
    fs_path = sc._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(sc._jsc.hadoopConfiguration())
    for k, found in enumerate(fs.globStatus(fs_path(path + "/parts/*/*/part-*"))):  # names only
        at = found.getPath()
        chain, lig_chain = (x.getName().split("=")[1] for x in (at.getParent().getParent(), at.getParent()))
        fs.mkdirs(fs_path(f"{path}/named/{k}"))
        fs.rename(at, fs_path(f"{path}/named/{k}/1abc_{chain}_LIG_{lig_chain}.csv.gz"))
    return readers.read_sites(spark, path + "/named/*", "v string").select("pdb_id", "chain_id", "lig_id", "lig_chain", "v")


@query("write_partitioned", "SELECT l_returnflag, l_linestatus, l_orderkey FROM lineitem")
def q_write_partitioned(spark, d):
    """Written in two runs: the second finds the first one's groups and adds the others only."""
    rows = T(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_orderkey")
    path = scratch(spark, "by-site")
    keys = ["l_returnflag", "l_linestatus"]
    sinks.write_partitioned(rows.filter("l_returnflag = 'N'"), keys, path)
    sinks.write_partitioned(rows, keys, path)
    return spark.read.parquet(path).select(*keys, "l_orderkey")


@query("write_examples", "SELECT p_partkey AS id, [p_size % 2, p_size % 3]::BIGINT[] AS y_true FROM part")
def q_write_examples(spark, d):
    path = scratch(spark, "examples")
    sinks.write_examples(T(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array((F.col("p_size") % 2).cast("long"), (F.col("p_size") % 3).cast("long")).alias("y_true")), path)
    return spark.read.schema("id long, y_true array<bigint>").json(path)


@query("with_residue_vectors", "WITH s AS (SELECT DISTINCT upper(replace(p_name, ' ', '')) AS sequence FROM part) SELECT sequence, (i - 1)::INT AS ord, strpos('ACDEFGHIKLMNPQRSTVWYX', sequence[i])::INT AS place, (strpos('ACDEFGHIKLMNPQRSTVWYX', sequence[i]) > 0)::INT AS total FROM s, unnest(generate_series(1, length(sequence))) AS g(i)")
def q_with_residue_vectors(spark, d):
    seqs = T(spark, d, "part").select(F.upper(F.replace("p_name", F.lit(" "), F.lit(""))).alias("sequence"))
    out = encoders.with_residue_vectors(seqs, encoders.one_hot_residues)
    place = F.array_position("features", F.lit(1.0).cast("float")).cast("int")
    return out.select("sequence", "ord", place.alias("place"), F.aggregate("features", F.lit(0.0), lambda a, x: a + x).cast("int").alias("total"))


@query("with_ligand_vectors", "WITH s AS (SELECT DISTINCT p_name AS smiles FROM part) SELECT smiles, list_transform(['C', 'N', 'O', 'S', 'P', 'F', 'Cl', 'Br', 'I', '=', '#', '(', '[', '1', '2'], lambda t: len(list_filter(regexp_extract_all(smiles, 'Cl|Br|.'), lambda x: x = t))::INT) AS counts FROM s")
def q_with_ligand_vectors(spark, d):
    out = encoders.with_ligand_vectors(T(spark, d, "part").select(F.col("p_name").alias("smiles")), encoders.count_tokens, encoders.TOKENS)
    return out.select("smiles", F.transform("features", lambda x: x.cast("int")).alias("counts"))


#: Labels by the vectors' own classes; beside the whole embedding stands a component that tells them, so what a sound model says is known.
_KNOWN_SQL = "SELECT vec_id, (label < 5)::INT AS label, (label < 5)::INT AS pred FROM embeddings WHERE vec_id % 5 = 0"


def _labelled(spark, d):
    label = (F.col("label") < 5).cast("int")
    own = F.transform("embedding", lambda x: x.cast("double"))
    rows = T(spark, d, "embeddings").select("vec_id", F.concat(own, F.array((label * 10 - 5).cast("double"))).alias("features"), label.alias("label"))
    return rows.filter("vec_id % 5 > 1"), rows.filter("vec_id % 5 = 1"), rows.filter("vec_id % 5 = 0")


_TREES = {"maxIter": 5, "maxDepth": 3, "seed": 1}


def _predictions(model, rows):
    return model.transform(models._as_vectors(rows)).select("vec_id", F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("pred"))


@query("train_boosted", _KNOWN_SQL)
def q_train_boosted(spark, d):
    train, val, test = _labelled(spark, d)
    return _predictions(models.train_boosted(train, val, _TREES), test)


@query("train_network", _KNOWN_SQL)
def q_train_network(spark, d):
    train, val, test = _labelled(spark, d)
    return _predictions(models.train_network(train, val, {"hidden": [8], "max_iter": 40, "step": 10, "patience": 2, "seed": 1})[0], test)


#: Nine trials of a cut and of which quantity is cut; on the first rung a quarter of the orders judges them, on the second all do.
_TRIALS, _SEARCH_SEED = 9, 42
_UNIT = "('0x' || substr(md5('{seed}:' || i || ':{name}'), 1, 13))::BIGINT / 16.0::DOUBLE ** 13"
_SEARCH_SQL = f"""
d AS (SELECT i::INT AS number, 0.001::DOUBLE * (50.0::DOUBLE / 0.001::DOUBLE) ** ({_UNIT.format(seed=_SEARCH_SEED, name='cut')}) AS cut,
             1 + ({_UNIT.format(seed=_SEARCH_SEED, name='times')} * 3)::DOUBLE AS u FROM generate_series(0, {_TRIALS - 1}) AS s(i)),
e AS (SELECT number, cut, floor(u)::INT AS times FROM d),
x AS (SELECT l_orderkey, (l_discount > 0.05)::INT AS y, l_quantity::DOUBLE AS q FROM lineitem),
c AS (SELECT number, cut, times, r, count(*) FILTER (WHERE q * times > cut AND y = 1) AS tp, count(*) FILTER (WHERE q * times > cut AND y = 0) AS fp, count(*) FILTER (WHERE q * times <= cut AND y = 1) AS fn
      FROM e, (VALUES (0, 1), (1, 4)) AS v(r, part) JOIN x ON l_orderkey % 4 < part GROUP BY number, cut, times, r),
f AS (SELECT *, 2.0::DOUBLE * tp / (2 * tp + fp + fn) AS f1 FROM c),
k AS (SELECT number FROM f WHERE r = 0 ORDER BY f1 DESC, number LIMIT 3)"""


@query(
    "search",
    f"""WITH {_SEARCH_SQL} SELECT number AS trial, r::INT AS rung, round(cut, 9) AS cut, times, round(f1, 9) AS f1, r = 1 AND row_number() OVER (PARTITION BY r ORDER BY f1 DESC, number) = 1 AS best
    FROM f WHERE r = 0 OR number IN (SELECT number FROM k)""",
)
def q_search(spark, d):
    """A search over a real and a whole number by two rungs, three trials at a time, the last after a resume. What is fitted is a rule."""
    rows = T(spark, d, "lineitem").select("l_orderkey", (F.col("l_discount") > 0.05).cast("int").alias("y"), F.col("l_quantity").cast("double").alias("q"))

    def fit(train, val, params):
        hit, y = F.col("q") * params["times"] > params["cut"], F.col("y") == 1
        tp, fp, fn = val.filter(F.col("l_orderkey") % 4 < params["part"]).agg(F.count_if(hit & y), F.count_if(hit & ~y), F.count_if(~hit & y)).first()
        return None, 2.0 * tp / (2 * tp + fp + fn)

    space = {"cut": models.Uniform(0.001, 50.0, log=True), "times": models.Integers(1, 3)}
    rungs = models.Rungs("part", (1, 4), 1 / 3)
    _, _, half = models.search(rows, rows, space, 5, _SEARCH_SEED, fit, rungs=rungs)
    best, score, trials = models.search(rows, rows, space, _TRIALS, _SEARCH_SEED, fit, history=half, parallelism=3, rungs=rungs)
    told = [(t.number, t.rung, round(t.params["cut"], 9), t.params["times"], round(t.score, 9), t.rung == 1 and t.params == best and t.score == score) for t in trials]
    return spark.createDataFrame(told, "trial int, rung int, cut double, times int, f1 double, best boolean")


@query(
    "score_pairs",
    """WITH p AS (SELECT p_partkey::VARCHAR AS pdb, p_brand AS lig_id, p_type AS smiles, upper(replace(p_name, ' ', '')) AS s FROM part)
    SELECT pdb, 'A' AS chain, lig_id, smiles, i::INT AS position, s[i] AS residue, (s[i] IN ('A', 'E', 'I'))::INT AS pred, true AS agrees FROM p, unnest(generate_series(1, length(s))) AS g(i)""",
)
def q_score_pairs(spark, d):
    """Pairs of part names as sequences and types as ligands. The label is a matter of the residue's letter, so predictions are known."""
    p = T(spark, d, "part").select(F.col("p_partkey").cast("string").alias("pdb"), F.lit("A").alias("chain"), F.col("p_brand").alias("lig_id"), F.upper(F.replace("p_name", F.lit(" "), F.lit(""))).alias("sequence"), F.col("p_type").alias("smiles"))
    residues = encoders.with_residue_vectors(p, encoders.one_hot_residues)
    ligands = encoders.with_ligand_vectors(p, encoders.count_tokens, encoders.TOKENS)
    rows = residues.withColumnRenamed("features", "_r").join(p.select("sequence", "smiles").distinct(), "sequence").join(ligands.withColumnRenamed("features", "_l"), "smiles")
    rows = rows.select("ord", F.concat("_r", "_l").alias("features"), (F.substring(F.col("sequence"), F.col("ord") + 1, F.lit(1)).isin("A", "E", "I")).cast("int").alias("label"))
    scaler = fit_scaler(rows.filter("ord % 3 <> 0"))
    from sitemill.operators.features import apply_scaler

    scaled = apply_scaler(rows, scaler)
    model = models.train_boosted(scaled.filter("ord % 3 = 1"), scaled.filter("ord % 3 = 2"), _TREES)
    ids = encoders.sequence_ids(p)
    out = models.score_pairs(p, ids, encoders.encode_sequences(ids, lambda texts: [encoders.one_hot_residues(s) for s in texts], lists=True), ligands, scaler, model)
    return out.withColumn("agrees", (F.col("probability") >= 0.5) == (F.col("pred") == 1)).drop("probability")
