"""Text sources as DataFrames. Files of blocks are read by lines, whose headers are carried on, so that any file may be read by many tasks."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitemill.functions.scalar import quoted_tokens
from sitemill.operators.curate import keyword_flag


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """One id a line, trimmed and lower-cased; blank lines are dropped."""
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("id")).filter("id <> ''")


def read_token_list(spark: SparkSession, paths: str | Sequence[str], column: int = 0) -> DataFrame:
    """The n-th token of each line in upper case, distinct over all files; lines without it, and empty quotes, are dropped."""
    rows = spark.read.text(paths if isinstance(paths, str) else list(paths))
    token = F.upper(F.get(F.split(F.trim("value"), r"\s+"), column))
    return rows.select(token.alias("token")).filter("token is not null and token not in ('', '\"\"')").distinct()


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header; values are taken as they stand, so NA is a text. Blank fields are empty texts."""
    df = spark.read.schema(schema).option("enforceSchema", "false").csv(path, header=True, nullValue="\0", emptyValue="")
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.fillna("", subset=texts)


def read_headerless(spark: SparkSession, path: str, fixed: Sequence[str], overflow_prefix: str, overflow: int) -> DataFrame:
    """CSV without a header: fixed columns, then so many more that are named by prefix and number; short rows have nulls there."""
    names = [*fixed, *[f"{overflow_prefix}{i}" for i in range(overflow)]]
    return spark.read.schema(", ".join(f"`{n}` string" for n in names)).csv(path, header=False, mode="PERMISSIVE")


def read_sites(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """Many CSV files, one a site; pdb_id, chain_id, lig_id and lig_chain come from the name. Other names are skipped."""
    rows = spark.read.schema(schema).csv(glob, header=True, nullValue="\0", emptyValue="")
    name = F.col("_metadata.file_name")
    pattern = r"^([^_]+)_([^_]+)_([^_.]+)_([^_.]+)\.csv(?:\.gz)?$"
    part = lambda k: F.regexp_extract(F.col("_file"), pattern, k)
    out = rows.select("*", name.alias("_file")).filter(F.col("_file").rlike(pattern))
    return out.withColumns({"pdb_id": part(1), "chain_id": part(2), "lig_id": part(3), "lig_chain": part(4)}).drop("_file")


def numbered_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(file, block, line_no, line) of text files: lines count from 0 within their file, a block is a split that a task reads.

    In two levels, so that a large file is read by many tasks: a scan counts the lines of each split, the few counts of a file are summed
    on, and the second scan adds them to each line's place within its split.
    """
    meta = F.col("_metadata")
    rows = spark.read.text(path if isinstance(path, str) else list(path))
    rows = rows.select(meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("_at"), F.col("value").alias("line"))
    blocks = rows.groupBy("file", "block").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    earlier = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    # A split's lines are read together, so their places follow one another.
    return rows.join(blocks, ["file", "block"]).select("file", "block", (F.col("_at") - F.col("_first") + F.col("_before")).alias("line_no"), "line")


def under_headers(lines: DataFrame, header: Column) -> DataFrame:
    """lines (file, block, line_no, line) with the last header at or above each, and the line it stands in (head_no); none: left out.

    header: the header's value in its line, else null. The last header is carried on within a split by a window, and from one split of a
    file to the next over the splits' last headers, which are few.
    """
    seen = lines.withColumn("_h", F.when(header.isNotNull(), F.struct(F.col("line_no").alias("head_no"), header.alias("header"))))
    within = W.partitionBy("file", "block").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    last = seen.groupBy("file", "block").agg(F.max("_h").alias("_last"))
    carried = F.last("_last", ignorenulls=True).over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    last = last.select("file", "block", carried.alias("_carried"))
    out = seen.withColumn("_h", F.last("_h", ignorenulls=True).over(within)).join(last, ["file", "block"])
    return out.withColumn("_h", F.coalesce("_h", "_carried")).filter(F.col("_h").isNotNull()).select(*lines.columns, "_h.head_no", "_h.header")


def _captured(text: Column, pattern: str) -> Column:
    """The first group of the pattern, null where it does not match."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(id, sequence) of a multi-line FASTA file: the first token of a line that begins with >, and the lines below it joined.

    Lines above the first header are left out; a header without lines has an empty sequence; repeated headers are records of their own.
    """
    rows = under_headers(numbered_lines(spark, path), _captured(F.col("line"), r"^>(\S*)"))
    body = F.when(F.col("line_no") == F.col("head_no"), "").otherwise(F.regexp_replace("line", r"\s+", ""))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", body.alias("body")))), lambda x: x["body"]), "")
    return rows.groupBy("file", "head_no").agg(F.first("header").alias("id"), joined.alias("sequence")).select("id", "sequence")


def read_cluster_listing(spark: SparkSession, path: str) -> DataFrame:
    """(cluster_id, pdb_chain) of lines "Cluster# n" with members ">entry_chain" below; the first underscore becomes a colon.

    The id stays a text, so numbers and names both do. A member is a row of its own from the start, so a cluster of any size is many tasks'.
    """
    rows = under_headers(numbered_lines(spark, path), _captured(F.col("line"), r"Cluster#\s*(\S+)"))
    members = F.regexp_extract_all(F.regexp_replace("line", r"^.*Cluster#\s*\S+", ""), F.lit(r">\s*(\S+)"), F.lit(1))
    return rows.select(F.col("header").alias("cluster_id"), F.explode(members).alias("_m")).select("cluster_id", F.regexp_replace("_m", r"^([^_]*)_", "$1:").alias("pdb_chain"))


ATOM_SCHEMA = (
    "pdb_id string, line_no long, group string, element string, atom string, comp string, asym string, seq_id int, auth_seq string, "
    "auth_asym string, model string, x double, y double, z double"
)
MODIFIED_SCHEMA = "pdb_id string, asym string, seq_id string, comp string, parent string"
#: Column names of the atom loop, required ones first.
_ATOM_COLUMNS = {
    "group": "group_PDB", "element": "type_symbol", "atom": "label_atom_id", "comp": "label_comp_id", "asym": "label_asym_id", "seq_id": "label_seq_id",
    "x": "Cartn_x", "y": "Cartn_y", "z": "Cartn_z", "auth_seq": "auth_seq_id", "auth_asym": "auth_asym_id", "model": "pdbx_PDB_model_num",
}
_ATOM_REQUIRED = 9


#: Column names of the loop of modified residues.
_MODIFIED_COLUMNS = {"asym": "label_asym_id", "seq_id": "label_seq_id", "comp": "label_comp_id", "parent": "parent_comp_id"}


def loop_rows(spark: SparkSession, glob: str, category: str) -> DataFrame:
    """(pdb_id, line_no, columns, tokens) of each row of a category's first loop in each file; lines with too few tokens are left out.

    The loop's column lines and its end are found first, one row a file; then every line between them is a row by itself, so that a large
    file is read by many tasks. A blank line, or one that begins with #, loop_, data_ or another name, ends a loop.
    """
    lines = numbered_lines(spark, glob).withColumn("line", F.trim(F.regexp_replace("line", r"\s", " ")))
    name = _captured(F.col("line"), rf"^{re.escape(category)}\.(\S*)")
    ends = name.isNull() & F.col("line").rlike("^(#|loop_|_|data_|$)")
    marks = lines.filter(name.isNotNull() | ends).select("file", "line_no", name.alias("name"))
    first = marks.filter("name is not null").groupBy("file").agg(F.min("line_no").alias("start"))
    marks = marks.join(first, "file").filter("line_no >= start")
    names = F.array_sort(F.collect_list(F.when(F.col("name").isNotNull(), F.struct("line_no", "name"))))
    loops = marks.groupBy("file", "start").agg(F.min(F.when(F.col("name").isNull(), F.col("line_no"))).alias("stop"), names.alias("names"))
    upto = F.coalesce("stop", F.lit((1 << 63) - 1))
    loops = loops.select("file", "start", upto.alias("stop"), F.transform(F.filter("names", lambda x: x["line_no"] < upto), lambda x: x["name"]).alias("columns"))
    quoted = F.regexp_extract_all("line", F.lit(r"""'[^']*'(?=\s|$)|"[^"]*"(?=\s|$)|\S+"""), F.lit(0))
    bare = F.transform(quoted, lambda t: F.when(t.rlike(r"""^('.*'|".*")$"""), F.substring(t, F.lit(2), F.length(t) - 2)).otherwise(t))
    rows = lines.join(loops, "file").filter((F.col("line_no") > F.col("start")) & (F.col("line_no") < F.col("stop")) & name.isNull())
    pdb_id = F.lower(F.regexp_extract(F.url_decode(F.substring_index("file", "/", -1)), r"^([^.]*)", 1))
    return rows.select(pdb_id.alias("pdb_id"), "line_no", "columns", bare.alias("tokens")).filter(F.size("tokens") >= F.size("columns"))


def _column(name: str) -> Column:
    """A loop row's value by the column's name, null where the loop has none."""
    return F.get("tokens", F.when(F.array_contains("columns", name), F.array_position("columns", F.lit(name)).cast("int") - 1))


def read_atoms(spark: SparkSession, glob: str) -> DataFrame:
    """Atom rows (ATOM_SCHEMA) of structure files. Columns are found by name; short and unparsable lines are skipped; a residue id that
    is no number is -1; a file whose loop lacks a required column is an error. Only what is selected is parsed."""
    rows = loop_rows(spark, glob, "_atom_site")
    required = F.array(*[F.lit(n) for n in list(_ATOM_COLUMNS.values())[:_ATOM_REQUIRED]])
    missing = F.array_except(required, F.col("columns"))
    error = F.raise_error(F.concat("pdb_id", F.lit(": the atom loop lacks "), F.array_join(missing, ", "))).cast("boolean")
    rows = rows.filter(F.when(F.size(missing) > 0, error).otherwise(True))
    value = {k: _column(n) for k, n in _ATOM_COLUMNS.items()}
    value |= {k: value[k].try_cast("double") for k in "xyz"}
    value["seq_id"] = F.coalesce(value["seq_id"].try_cast("int"), F.lit(-1))
    value["model"] = F.when(value["model"] != "", value["model"]).otherwise("1")
    names = [f.name for f in T._parse_datatype_string(ATOM_SCHEMA)]
    out = rows.select(*[value[k].alias(k) if k in value else F.col(k) for k in names])
    return out.filter("x is not null and y is not null and z is not null")


def read_modified_residues(spark: SparkSession, glob: str) -> DataFrame:
    """(pdb_id, asym, seq_id, comp, parent) of the structure files' modified residues."""
    return loop_rows(spark, glob, "_pdbx_struct_mod_residue").select("pdb_id", *[_column(n).alias(k) for k, n in _MODIFIED_COLUMNS.items()])


def read_components(spark: SparkSession, path: str) -> DataFrame:
    """One row per component (a line "data_ID" and those below): id, type, chem_type, name, descriptors in the order of their lines.

    Of a field the first line counts. A descriptor line counts only under its own component's id.
    """
    rows = under_headers(numbered_lines(spark, path), _captured(F.col("line"), r"^data_(\S+)"))
    line, first = F.col("line"), lambda value: F.min(F.when(value.isNotNull(), F.struct("line_no", value.alias("value"))))["value"]
    field = lambda tag: _captured(line, rf"^_chem_comp\.{tag}[ \t]+(.*)$")
    text = lambda tag: F.trim(F.regexp_replace(field(tag), "^[\"']|[\"']$", ""))
    last = F.element_at(F.concat(F.array(F.lit("")), quoted_tokens(field("pdbx_type"))), -1)
    tokens = quoted_tokens(line)
    wanted = (F.get(F.split(F.trim(line), r"\s+"), 0) == F.col("header")) & (F.size(tokens) >= 5) & F.get(tokens, 1).rlike("(?i)^(SMILES|SMILES_CANONICAL|InChI|InChIKey)$")
    found = F.when(wanted, F.struct("line_no", F.struct(F.get(tokens, 1).alias("dtype"), F.get(tokens, 2).alias("program"), F.element_at(tokens, -1).alias("value")).alias("d")))
    # Each field is taken from its own lines, which are few beside a component's atoms.
    kept = rows.select("file", "head_no", "header", "line_no", last.alias("type"), text("type").alias("chem_type"), text("name").alias("name"), found.alias("found"))
    kept = kept.filter("line_no = head_no or type is not null or chem_type is not null or name is not null or found is not null")
    out = kept.groupBy("file", "head_no").agg(F.first("header").alias("id"), *[F.coalesce(first(F.col(c)), F.lit("")).alias(c) for c in ("type", "chem_type", "name")], F.array_sort(F.collect_list("found")).alias("found"))
    return out.select("id", "type", "chem_type", "name", F.transform("found", lambda x: x["d"]).alias("descriptors"))


ENTITY_SCHEMA = (
    "array<struct<molecule_type:string, in_struct_asyms:array<string>, molecule_name:array<string>, synonym:array<string>, "
    "source:array<struct<organism_scientific_name:string>>>>"
)


def entity_organisms(df: DataFrame, keywords: Sequence[str], guess: str) -> DataFrame:
    """(pdb_id, experimental_method, resolution, chain_id, organism) of landed entity JSON.

    df: pdb_id, experimental_method, resolutions array<double>, entities (JSON). Entries need a method and a molecule whose type holds
    "peptide". Of these molecules each chain is paired with each source: its organism; without a source the guess if a name or synonym
    holds a keyword; else unknown.
    """
    rows = df.filter(F.coalesce("experimental_method", F.lit("")) != "").withColumn("e", F.explode(F.from_json("entities", ENTITY_SCHEMA)))
    rows = rows.filter(F.lower("e.molecule_type").contains("peptide"))
    names = F.array_join(F.concat(F.coalesce("e.molecule_name", F.array()), F.coalesce("e.synonym", F.array())), " ")
    rows = rows.select("pdb_id", "experimental_method", F.get("resolutions", 0).alias("resolution"), "e", names.alias("_n"), F.explode_outer("e.in_struct_asyms").alias("chain_id"))
    rows = rows.select("*", F.explode_outer("e.source").alias("s"))
    organism = F.coalesce("s.organism_scientific_name", F.when(F.col("s").isNull() & keyword_flag(F.col("_n"), keywords), guess), F.lit("unknown"))
    return rows.filter("chain_id is not null").select("pdb_id", "experimental_method", "resolution", "chain_id", organism.alias("organism"))
