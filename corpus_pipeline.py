"""A training-data pipeline over ``documents``: quality rules, near duplicates, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.llm import mixing, ngram_join, packing, quality_rules, secret_scans
from folioscan.llm.shared import fresh_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def rule_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules; those without text, as of all under 50 words, do not.  Repeated rows stay repeated."""
    return quality_rules.judged(docs, keep=COLUMNS).where("kept").select(*COLUMNS)


def named(docs: DataFrame, *columns: str) -> DataFrame:
    """The columns of documents and _row, 128 bits of the named columns with nulls told from empty texts: what is equal in them is one row."""
    each = (F.coalesce(F.md5(F.col(c).cast("string").cast("binary")), F.lit("null")) for c in columns)
    return docs.select(*COLUMNS, F.md5(F.concat_ws(":", *each)).alias("_row"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (5-word shingles, Jaccard 0.8 or more) the document with the smallest id.

    Groups are told by their texts, not by ids: an id on unrelated texts stays
    once for each of them, and copies without an id or with one id are copies too.
    A null id comes last, and equal ids go by a hash of the text.  Documents
    without words are in no group; of rows with equal id and text one stays.
    """
    rows = named(docs, "doc_id", "text")
    found = ngram_join.joined(rows, percent=80, size=5, keep=("doc_id", "_row"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_row")).alias("first")
    winners = found.where("root is not null").groupBy("root").agg(first).select("first._row").union(found.where("root is null").select("_row").distinct())
    return rows.dropDuplicates(["_row"]).join(winners, "_row", "left_semi").select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mask; n_chars follows the text where it changed.  Null texts and repeated rows stay as they are."""
    found = secret_scans.scanned(docs, keep=COLUMNS, mask=True)
    changed = F.size("found") > 0
    return found.select("doc_id", F.when(changed, F.col("masked")).otherwise(F.col("text")).alias("text"), "lang", "source", F.when(changed, F.length("masked").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: whole repetitions, and one more if half of the words or more of the partial one are taken.

    The null source is a source; documents without words are not taken; of
    repeated rows each is taken for itself.  Only keys and sizes are ordered; texts are
    joined once, to the sum over equal rows.
    """
    rows = named(docs, *COLUMNS)
    taken = mixing.mixed(rows, keep=("doc_id", "_row"))
    times = F.col("n_whole") + F.when((F.col("n_extra") > 0) & (2 * F.col("n_extra") >= F.col("size")), 1).otherwise(0)
    times = taken.where("size > 0").groupBy("_row").agg(F.sum(times).cast("int").alias("_times")).where("_times > 0")
    return rows.dropDuplicates(["_row"]).join(times, "_row").withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("_times")))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their length buckets and batches; documents without words have none, repeated rows have their own."""
    return packing.packed(docs)


STAGES = [("quality_rules", rule_out), ("ngram_join", one_of_each), ("secret_scans", mask_secrets), ("mixing", mix), ("packing", pack)]
ORACLE_SQL = None  # a random field and a dynamic program are beyond SQL; tests/llm compares with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again by the next one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
