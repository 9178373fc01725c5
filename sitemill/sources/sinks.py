"""Writers: datasets, partitioned tables that go on where they stopped, exports and examples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

#: Keys of the dataset's tables: an entity is stored once.
ENTITY_KEYS = {"protein_residues": ["pdb_id", "chain_id", "ord"], "ligand_features": ["lig_site"], "feature_names": ["entity", "pos"]}


def write_dataset(tables: Mapping[str, DataFrame], path: str) -> None:
    """Each table as Parquet under path; entities once a key, interactions by split where they have one."""
    for name, df in tables.items():
        if name in ENTITY_KEYS:
            df = df.dropDuplicates(ENTITY_KEYS[name])
        writer = df.write.mode("overwrite")
        if name == "interactions" and "split" in df.columns:
            writer = writer.partitionBy("split")
        writer.parquet(f"{path}/{name}")


def read_dataset(spark: SparkSession, path: str, names: Sequence[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def write_bucketed(df: DataFrame, table: str, keys: Sequence[str], buckets: int, path: str | None = None) -> DataFrame:
    """df as a table in so many buckets of the keys, each one file that is sorted by them; read back.

    A join on the keys reads the buckets as they lie: this side is neither shuffled nor sorted again, and the other side alone is dealt to
    as many partitions. For what is joined again and again, as residue vectors are with each split's examples. The files lie in the
    warehouse, or under path.
    """
    writer = df.repartition(buckets, *keys).write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return df.sparkSession.table(table)


def write_partitioned(df: DataFrame, keys: Sequence[str], path: str) -> None:
    """Append the groups of keys that are not there yet; the keys found are read from the folder names alone.

    REBALANCE deals rows by key in partitions of like size: a large group goes to several tasks, small ones share one.
    """
    spark = df.sparkSession
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs_path):
        done = spark.read.parquet(path).select(*keys).distinct()
        df = df.join(done, list(keys), "left_anti")
    df.hint("rebalance", *keys).write.mode("append").partitionBy(*keys).parquet(path)


def export_distinct(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Sorted distinct values, as one text column, for write.text."""
    from pyspark.sql import functions as F

    return df.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in cols]).alias("value")).distinct().orderBy("value")


def write_examples(df: DataFrame, path: str) -> None:
    """Nested examples as JSON lines."""
    df.write.mode("overwrite").json(path)
