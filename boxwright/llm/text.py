"""Column expressions and small helpers the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def body(column: Column) -> Column:
    """Text with null read as empty."""
    return F.coalesce(column, F.lit(""))


def word_count(column: Column) -> Column:
    """Number of words; null has none."""
    return F.regexp_count(body(column), F.lit(WORD)).cast("long")


def lower_ascii(column: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(body(column), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(column: Column) -> Column:
    """Words of a text in order; null has none."""
    return F.filter(F.split(body(column), GAP), lambda w: w != "")


def crc_of_id(column: Column) -> Column:
    """crc32 of the id's decimal text; a null id counts as an empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")))
