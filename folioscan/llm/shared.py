"""What the operators of this subpackage share: columns for words, and tables in the cluster's shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.storage import fresh_path, shared_folder, stored

__all__ = ["fresh_path", "lower_ascii", "n_words_of", "read_table", "shared_folder", "stored", "text_of", "words_of"]

#: Words are runs of anything but these six ASCII characters.
SPACES = "\\x20\\x09-\\x0D"


def text_of(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """Array of the words of a text."""
    return F.filter(F.split(text, f"[{SPACES}]+"), lambda w: w != "")


def n_words_of(text: Column) -> Column:
    """Number of words, counted as the places where a word starts, without making an array of strings."""
    pieces = F.size(F.split(F.concat(F.lit("x "), text, F.lit(" x")), f"[{SPACES}]+", -1))
    return (pieces - 2).cast("long")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
