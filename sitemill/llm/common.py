"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitemill.functions.shared import forget, shared_table
from sitemill.functions.shipping import ship_package

__all__ = ["BLANKS", "forget", "fresh", "let", "one_thread", "partitions", "read", "shared_table", "tokenizer_path"]

#: The characters that part words: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def let(value: Column, body) -> Column:
    """body(value), with value computed once a row however often body uses it."""
    return F.transform(F.array(value), body)[0]


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def one_thread() -> None:
    """Spark deals out the cores; the tokenizers library shall not start threads of its own in a task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"


def fresh(df: DataFrame, base: str) -> str:
    """A column name that df does not have yet."""
    taken, name = {c.lower() for c in df.columns}, base
    while name.lower() in taken:
        name += "_"
    return name
