"""Column functions: keys, lists, tokens, distances, vectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Three-letter to one-letter names of the twenty residues.
AA3 = {
    "ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I",
    "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V",
}


def make_key(pdb: Column, chain: Column, lig_site: Column) -> Column:
    """pdb:chain:ligand_ligandchain."""
    return F.concat_ws(":", pdb, chain, lig_site)


def parse_key(df: DataFrame, key: str = "key") -> DataFrame:
    """df with pdb_id, chain_id, lig_site and lig_id, the site's text before its first underscore."""
    part = lambda k: F.split_part(F.col(key), F.lit(":"), F.lit(k))
    return df.withColumns({"pdb_id": part(1), "chain_id": part(2), "lig_site": part(3), "lig_id": F.split_part(part(3), F.lit("_"), F.lit(1))})


def explode_list(df: DataFrame, col: str, out: str, sep: str = ",") -> DataFrame:
    """One row per item of a separated list; empty items are dropped."""
    items = F.filter(F.transform(F.split(F.col(col), sep), lambda x: F.trim(x)), lambda x: x != "")
    return df.withColumn(out, F.explode(items))


def safe_name(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Za-z0-9._-]", "_")


def quoted_tokens(c: Column) -> Column:
    """Tokens parted by blanks, phrases in double quotes kept whole and unquoted."""
    return F.transform(F.regexp_extract_all(c, F.lit(r'"[^"]*"|\S+'), F.lit(0)), lambda t: F.regexp_replace(t, '^"|"$', ""))


def euclid(a: list[Column], b: list[Column]) -> Column:
    """Distance of two points; round for output only."""
    return F.sqrt(reduce(lambda s, t: s + t, [(x - y) * (x - y) for x, y in zip(a, b, strict=True)]))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def threshold_label(p: Column, cut: float = 0.5, strict: bool = False) -> Column:
    return F.when(p > cut if strict else p >= cut, 1).otherwise(0)


def align_features(values: Column, names: Column, wanted: Column) -> Column:
    """The vector in the wanted names' order: what is missing, null, NaN or infinite is 0."""
    by_name = F.map_from_arrays(names, values)

    def one(n: Column) -> Column:
        v = F.try_element_at(by_name, n)
        return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), F.lit(0.0)).otherwise(v)

    return F.transform(wanted, one)


def concat_features(residue: Column, ligand: Column) -> Column:
    return F.concat(residue, ligand)


def drop_repeat_rows(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Distinct rows, or distinct values of cols with the rest of the smallest row of each, so that the choice is stable."""
    if cols is None:
        return df.distinct()
    rest = [c for c in df.columns if c not in cols]
    if not rest:
        return df.select(*cols).distinct()
    return df.groupBy(*cols).agg(F.min(F.struct(*rest)).alias("_row")).select(*cols, "_row.*").select(*df.columns)


def aa_one_letter(df: DataFrame, col: str, out: str) -> DataFrame:
    """df with the one-letter name of a three-letter residue, null for any other."""
    table = F.create_map(*[F.lit(x) for pair in AA3.items() for x in pair])
    return df.withColumn(out, F.try_element_at(table, F.col(col)))


def clean_sequence(c: Column, rare: str = "UZOB") -> Column:
    """Upper case, blanks out, rare letters to X."""
    return F.regexp_replace(F.regexp_replace(F.upper(c), r"\s+", ""), f"[{rare}]", "X")


def residue_ordinal(df: DataFrame, seq: str = "sequence") -> DataFrame:
    """One row per letter of a sequence, with its place from 1."""
    letters = F.filter(F.split(F.col(seq), ""), lambda x: x != "")
    return df.select(*df.columns, F.posexplode(letters).alias("_at", "residue")).withColumn("position", F.col("_at") + 1).drop("_at")
