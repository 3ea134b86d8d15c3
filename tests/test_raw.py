"""The data source over raw files: ranged reads, in batch and as a stream."""

from folioscan.plans.graph_queries import _ran
from folioscan.sources import files, raw


def made(folder, numbers, size=60_000):
    for k in numbers:
        head = f"%PDF-1.{k % 8}\n1 0 obj << {'/Linearized 1' if k % 2 else '/Type'} >> endobj\n".encode()
        (folder / f"sub{k % 3}").mkdir(exist_ok=True)
        (folder / f"sub{k % 3}" / f"f{k:03d}.pdf").write_bytes(head if k == 5 else head + b"x" * size)


def test_headers_from_a_kilobyte_a_file(spark, tmp_path):
    made(tmp_path, range(40))
    (tmp_path / "other.txt").write_text("no")
    got = raw.heads(spark, str(tmp_path), "*.pdf")
    rows = {r["id"]: r for r in got.collect()}
    assert len(rows) == 40 and all(r["read"] == min(1024, r["size"]) == len(r["content"]) for r in rows.values())
    assert sum(r["read"] for r in rows.values()) <= 40 * 1024 < sum(r["size"] for r in rows.values()) / 50
    whole = files.binary_files(spark, str(tmp_path), "*.pdf")
    assert sorted(map(tuple, files.headers(got).collect())) == sorted(map(tuple, files.headers(whole).collect()))
    assert {r["size"] for r in rows.values()} == {len(r["content"]) for r in whole.collect()}
    assert raw.heads(spark, f"file://{tmp_path}", "*.pdf", 10).agg({"read": "sum"}).first()[0] == 400
    assert raw.heads(spark, str(tmp_path), "*.none").count() == 0
    assert got.sparkSession.read.format("raw_heads").option("path", str(tmp_path)).option("files_per_task", "7").load().rdd.getNumPartitions() == 6


def test_files_as_they_come(spark, tmp_path):
    folder, check = tmp_path / "in", str(tmp_path / "check")
    folder.mkdir()
    out = str(tmp_path / "out")

    def drained():
        stream = raw.heads(spark, str(folder), "*.pdf", stream=True).select("id", "read")
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
        return sorted(r["id"] for r in spark.read.parquet(out).collect())

    made(folder, range(6))
    assert drained() == [f"f{k:03d}.pdf" for k in range(6)]
    made(folder, range(6, 11))
    assert drained() == [f"f{k:03d}.pdf" for k in range(11)]
    assert drained() == [f"f{k:03d}.pdf" for k in range(11)]
    assert sorted(r["id"] for r in _ran(spark, raw.heads(spark, str(folder), stream=True), "raw").collect()) == [f"f{k:03d}.pdf" for k in range(11)]
