"""Filters, flags and rule waterfalls over chains, organisms, ligands and structures."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed values of ligand curation.
ALLOWED_ELEMENTS = ("H", "C", "N", "O", "F", "P", "S", "Cl", "Br", "I")
SMILES_PROGRAMS = ("OpenEye", "CACTVS")
NO_LIGAND = "NO_LIGAND"


def normalise_keys(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Key columns as trimmed strings."""
    return df.withColumns({c: F.trim(F.col(c).cast("string")) for c in cols})


def filter_chains(df: DataFrame, min_len: int = 30, seq: str = "sequence_1l", ligand: str = "ligand_id") -> DataFrame:
    """Chains with a ligand and a sequence long enough."""
    return df.filter((F.col(ligand) != NO_LIGAND) & (F.length(seq) >= min_len))


def project(df: DataFrame, keep: dict[str, str]) -> DataFrame:
    """Columns by {old name: new name}; helper columns that are not named go."""
    return df.select(*[F.col(a).alias(b) for a, b in keep.items()])


def _any_word(words: Sequence[str]) -> str:
    return "|".join(re.escape(w.lower()) for w in words)


def keyword_flag(c: Column, words: Sequence[str]) -> Column:
    """Whether any keyword is part of the text, case ignored."""
    return F.lower(c).rlike(_any_word(words))


def all_items_match(c: Column, sep: str, words: Sequence[str]) -> Column:
    """Whether every item of a separated list that is not blank holds a keyword; true for an empty list."""
    items = F.filter(F.transform(F.split(c, re.escape(sep)), lambda x: F.trim(x)), lambda x: x != "")
    return F.forall(items, lambda x: keyword_flag(x, words))


def split_by_predicate(df: DataFrame, p: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that match, and all others (those for which p is null with them)."""
    return df.filter(p), df.filter(~F.coalesce(p, F.lit(False)))


def forbidden_term_flag(cols: Sequence[Column], words: Sequence[str]) -> Column:
    """Whether any column holds one of the words whole, case ignored."""
    pattern = rf"(?i)\b({_any_word(words)})\b"
    out = F.lit(False)
    for c in cols:
        out = out | F.coalesce(c.rlike(pattern), F.lit(False))
    return out


def allowed_type_flag(kind: Column, chem: Column, kinds: Sequence[str], chems: Sequence[str]) -> Column:
    """Type in its list (case counts) or unknown (?), and chemical type in its list (case ignored)."""
    return (kind.isin(*kinds) | (kind == "?")) & F.lower(chem).isin(*[c.lower() for c in chems])


def rule_waterfall(df: DataFrame, rules: Sequence[tuple[Column, str]], out: str = "reason") -> DataFrame:
    """df with the reason of the first rule that holds; null for rows that none excludes."""
    (first, name), *rest = rules
    reason = F.when(first, name)
    for rule, name in rest:
        reason = reason.when(rule, name)
    return df.withColumn(out, reason)


def review_rows(df: DataFrame, doubtful: Column, reason: str = "reason") -> DataFrame:
    """Rows that stay although they look doubtful."""
    return df.filter(F.col(reason).isNull() & doubtful)


def preferred_descriptor(descriptors: Column, kinds: Sequence[str], programs: Sequence[str] | None = None) -> Column:
    """The first value of the kinds, by the programs' order if they are given; null without one."""
    of_kind = F.filter(descriptors, lambda d: d["dtype"].isin(*kinds))
    if programs is None:
        return F.get(of_kind, 0)["value"]

    def first_of(program: str) -> Column:
        return F.get(F.filter(of_kind, lambda d: d["program"].startswith(program)), 0)["value"]

    return F.coalesce(*[first_of(p) for p in programs])


def smiles_atoms(smiles: Column) -> Column:
    """Element symbols of a SMILES string, one per atom: bracket atoms and the organic subset; aromatic ones in upper case."""
    tokens = F.regexp_extract_all(smiles, F.lit(r"\[[^\]]*\]|Cl|Br|[BCNOPSFI]|[bcnops]"), F.lit(0))
    symbol = lambda t: F.regexp_extract(t, r"^\[?[0-9]*([A-Z][a-z]?|[a-z][a-z]?)", 1)
    # In a bracket a second small letter belongs to the symbol unless it is an aromatic atom's own.
    return F.transform(tokens, lambda t: F.initcap(symbol(t)))


def smiles_elements(smiles: Column) -> Column:
    return F.array_sort(F.array_distinct(smiles_atoms(smiles)))


def allowed_elements_flag(smiles: Column, allowed: Sequence[str] = ALLOWED_ELEMENTS) -> Column:
    return F.size(F.array_except(smiles_elements(smiles), F.array(*map(F.lit, allowed)))) == 0


def heavy_atom_count(smiles: Column) -> Column:
    return F.size(F.filter(smiles_atoms(smiles), lambda e: e != "H"))


def first_model(atoms: DataFrame, entry: str = "pdb_id", model: str = "model", line: str = "line_no") -> DataFrame:
    """Atoms of the first model number seen in each entry; of models on one line the smallest."""
    first = atoms.groupBy(entry).agg(F.min(F.struct(line, model))[model].alias("_first"))
    return atoms.join(first, entry).filter(F.col(model) == F.col("_first")).drop("_first")


def drop_solvent_and_hydrogen(atoms: DataFrame) -> DataFrame:
    """Atoms but water among the hetero atoms, and hydrogen."""
    return atoms.filter(~((F.col("group") == "HETATM") & (F.col("comp") == "HOH")) & (F.col("element") != "H"))


def filter_resolution(df: DataFrame, col: str = "resolution", most: float = 5.0) -> DataFrame:
    """Rows with a numeric resolution of at most so much."""
    return df.filter(F.col(col).cast("string").try_cast("double") <= most)


def drop_null_atoms(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(cols))


def bind_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """The required columns under their own names, bound without regard to case; an error lists what is missing."""
    by_lower = {c.lower().strip(): c for c in df.columns}
    missing = [r for r in required if r.lower() not in by_lower]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}; found: {', '.join(df.columns)}")
    return df.select(*[F.col(f"`{by_lower[r.lower()]}`").alias(r) for r in required])


def drop_blank(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows in which none of the columns is null or blank."""
    for c in cols:
        df = df.filter(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != "")
    return df


def contact_label(distance: Column, cutoff: float = 4.5) -> Column:
    """1 up to the cutoff, on the distance as measured."""
    return F.when(distance <= cutoff, 1).otherwise(0)


def count_by_reason(df: DataFrame, reason: str = "reason") -> DataFrame:
    return df.filter(F.col(reason).isNotNull()).groupBy(reason).agg(F.count("*").alias("n"))


def conflict_members(df: DataFrame, key: str, other: str, nonempty: bool = False) -> DataFrame:
    """All rows of a key that has more than one distinct other value; with nonempty blank keys are no key."""
    rows = df.filter(F.col(key) != "") if nonempty else df
    bad = rows.groupBy(key).agg(F.count_distinct(F.coalesce(F.col(other), F.lit(""))).alias("_n")).filter("_n > 1").select(key)
    return rows.join(bad, key, "left_semi")


def duplicate_ids(df: DataFrame, keys: Sequence[str], order: str, id_col: str) -> DataFrame:
    """Ids of the rows after the first, by order and then id, of each key; a null is a key like any other.

    The first of each key is an aggregate that is joined back, so a key that many rows share, as blanks are, is no single task's.
    """
    rows = df.groupBy(*keys, order, id_col).agg(F.count("*").alias("_n"))
    at = F.struct(order, id_col)
    first = rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.min(at).alias("_first"))
    met = rows.join(first, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]))
    return met.filter((at > F.col("_first")) | (F.col("_n") > 1)).select(id_col)


def resolve_conflicts(df: DataFrame, id_col: str, smiles: str, inchi: str, order: str) -> tuple[DataFrame, DataFrame]:
    """(kept, removed): ids in a SMILES conflict, later duplicates, and ids in an InChI conflict go."""
    bad = (
        conflict_members(df, smiles, inchi).select(id_col)
        .union(duplicate_ids(df, [smiles, inchi], order, id_col))
        .union(conflict_members(df, inchi, smiles, nonempty=True).select(id_col)).distinct()
    )
    return df.join(bad, id_col, "left_anti"), df.join(bad, id_col, "left_semi")


def duplicate_report(df: DataFrame, col: str) -> DataFrame:
    """One row: how many values repeat and how many rows they have, distinct and total counts; blanks do not count."""
    values = df.filter(F.coalesce(F.col(col), F.lit("")) != "").groupBy(col).agg(F.count("*").alias("n"))
    return values.agg(
        F.count_if(F.col("n") > 1).alias("repeated_values"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("repeated_rows"),
        F.count("*").alias("n_distinct"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
    )


def dataset_summary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row of distinct counts; the counts are taken one after another by plain aggregation, not by expanding each row."""
    parts = [df.select(F.col(c).cast("string").alias("v")).filter("v is not null").distinct().agg(F.count("*").alias("n")).select(F.lit(c).alias("what"), "n") for c in cols]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
