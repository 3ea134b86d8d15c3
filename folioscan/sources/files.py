"""Files as tables: integrity against a manifest, headers of raw files, and reports as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

METRICS = "schema int, os string, arch string, runs int, cold map<string,double>, metrics map<string,struct<value:double,unit:string,higher_is_better:boolean,tracked:boolean,floor:double>>"


def binary_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """id (file name) and content of raw files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("id"), "content")


def file_status(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """id, status: verified, corrupt, missing (listed only) or unlisted (found only)."""
    found = files.select("id", F.sha2("content", 256).alias("_sha"))
    rows = manifest.select("id", "sha256").withColumn("_m", F.lit(True)).join(found, "id", "full_outer")
    status = F.when(F.col("_sha").isNull(), "missing").when(F.col("_m").isNull(), "unlisted").when(F.col("_sha") == F.col("sha256"), "verified").otherwise("corrupt")
    return rows.select("id", status.alias("status"))


def headers(files: DataFrame) -> DataFrame:
    """id, version, linearized: by the first 1,024 bytes."""
    head = F.decode(F.substring("content", 1, 1024), "ISO-8859-1")
    version = F.regexp_extract(head, r"%PDF-([0-9]\.[0-9])", 1)
    first = F.regexp_extract(head, r"(?s)\bobj(.*?)endobj", 1)
    return files.select("id", F.when(version != "", version).alias("version"), F.contains(first, F.lit("/Linearized")).alias("linearized"))


def capped_json(columns: list[str], lists: dict[str, Column], most: int) -> Column:
    """A row as JSON of at most ``most`` bytes, with one or two lists of strings as {items, total, truncated}.

    Items go one by one from the end of the list that is longer then, the first one if both are
    as long, until the row fits; if it does not even without items, the JSON is null.  Which items go by the
    k-th step follows from the lengths, so the step is found from running sums of bytes
    (an item has three bytes or more, so no more than a third of ``most`` can stay).
    """
    none = F.expr("cast(array() as array<string>)")
    (name_a, list_a), (name_b, list_b) = [*lists.items(), ("", none)][:2]

    def capped(given: Column) -> Column:
        a, b = given["a"], given["b"]
        n_a, n_b = F.size(a), F.size(b)
        level = F.least(n_a, n_b)
        beyond = lambda k: F.greatest(k - F.abs(n_a - n_b), F.lit(0))  # steps after both are as long
        left_a = lambda k: F.when(n_a > level, F.greatest(n_a - k, level)).otherwise(level) - F.ceil(beyond(k) / 2).cast("int")
        left_b = lambda k: F.when(n_b > level, F.greatest(n_b - k, level)).otherwise(level) - F.floor(beyond(k) / 2).cast("int")
        part = lambda items, n, cut, name: [F.struct(items.alias("items"), n.alias("total"), cut.alias("truncated")).alias(name)] if name else []
        row = lambda x, y, cut_x, cut_y: F.to_json(F.struct(*columns, *part(x, n_a, cut_x, name_a), *part(y, n_b, cut_y, name_b)))
        sizes = lambda items: F.transform(F.slice(items, F.lit(1), F.lit(most // 3 + 1)), lambda x: F.octet_length(F.to_json(F.array(x))) - 1)
        sums = lambda items: F.aggregate(sizes(items), F.array(F.lit(0)), lambda s, n: F.concat(s, F.array(F.element_at(s, -1) + n)))  # bytes of the first n items and their commas, one too many
        sized = F.struct(sums(a).alias("a"), sums(b).alias("b"), F.octet_length(row(none, none, F.lit(False), F.lit(False))).alias("bare"))
        bytes_of = lambda s, left: F.greatest(F.coalesce(F.get(s, left), F.lit(most + 2)) - 1, F.lit(0))  # more items than sums are too many
        fits = lambda s, k: s["bare"] + bytes_of(s["a"], left_a(k)) + bytes_of(s["b"], left_b(k)) - F.when(left_a(k) < n_a, 1).otherwise(0) - F.when(left_b(k) < n_b, 1).otherwise(0) <= most  # "true" is shorter
        step = F.transform(F.array(sized), lambda s: F.array_min(F.filter(F.sequence(F.lit(0), n_a + n_b), lambda k: fits(s, k))))
        return F.get(F.transform(step, lambda k: F.when(k.isNotNull(), row(F.slice(a, F.lit(1), left_a(k)), F.slice(b, F.lit(1), left_b(k)), left_a(k) < n_a, left_b(k) < n_b))), F.lit(0))

    return F.get(F.transform(F.array(F.struct(list_a.alias("a"), list_b.alias("b"))), capped), F.lit(0))


def _reports(spark: SparkSession, path: str, lines: bool) -> DataFrame:
    rows = spark.read.schema(METRICS).json(path, multiLine=not lines)
    return rows.where(F.assert_true(F.coalesce(F.col("schema") == 1, F.lit(False)), "a metric file of another schema").isNull())


def read_metrics(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Metric files, or with ``lines`` files of one report a line, as rows; another schema version is refused."""
    return _reports(spark, path, lines).select("os", "arch", "runs", F.explode("metrics").alias("name", "m")).select("os", "arch", "runs", "name", "m.*")


def read_cold(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """os, arch, runs, name, value: the first runs that metric files tell of."""
    return _reports(spark, path, lines).select("os", "arch", "runs", F.explode("cold").alias("name", "value"))


def write_metrics(metrics: DataFrame, path: str, cold: DataFrame | None = None) -> None:
    """Metric files, one object for each report (report, os, arch, name, value, unit, higher_is_better, tracked, floor, and runs, 1 if there is no such column); names are unique in a report.

    cold: report, os, arch, name, value of the first runs, of reports with metrics.
    """
    entry = F.struct("name", F.struct("value", "unit", "higher_is_better", "tracked", "floor").alias("m"))
    runs = F.max("runs") if "runs" in metrics.columns else F.lit(1)
    key = ["report", "os", "arch"]
    rows = metrics.groupBy(*key).agg(F.map_from_entries(F.collect_list(entry)).alias("metrics"), runs.cast("int").alias("runs"))
    none = F.expr("map()").cast("map<string,double>")
    if cold is not None:
        rows = rows.join(cold.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("cold")), key, "left")
    kept = none if cold is None else F.coalesce("cold", none)
    rows.select(F.lit(1).alias("schema"), "os", "arch", "runs", kept.alias("cold"), "metrics").write.json(path)


def write_text(selected: DataFrame, path: str, form: str = "parquet") -> None:
    """Chosen pages of documents (doc_id, text): a Parquet file set, or with form "text" a folder of text for each document, its pages parted by form feeds and a line end after the last."""
    if form == "text":
        selected.select("doc_id", F.col("text").alias("value")).write.partitionBy("doc_id").text(path)
    else:
        selected.write.parquet(path)
