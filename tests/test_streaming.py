from pyspark.sql import functions as F

import pytest

from leafgrid.streaming.documents import whole_documents
from leafgrid.streaming.watch import for_each_batch, watch_files

SCHEMA = "doc_id string, page_num int, num_pages int, payload string, ts timestamp"
T = "2024-05-01 10:{:02}:00"


def batches(spark, folder, parts):
    """One file for each micro-batch, in order of name."""
    for i, rows in enumerate(parts):
        table = spark.createDataFrame([(*r[:4], T.format(r[4])) for r in rows], SCHEMA.replace("timestamp", "string")).withColumn("ts", F.to_timestamp("ts"))
        table.coalesce(1).write.parquet(f"{folder}/part={i:03}")


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


def test_documents_are_held_until_whole_and_a_killed_stream_goes_on(spark, tmp_path):
    batches(spark, tmp_path / "in", [
        [("a", 0, 3, "a0", 0), ("b", 0, 1, "b0", 0), ("c", 1, 2, "c1", 0), (None, 0, 1, "no", 0)],
        [("a", 2, 3, "a2", 1), ("a", 0, 3, "again", 1), ("d", 0, 2, "d0", 1), ("d", 7, 2, "out", 1)],
        [("a", 1, 3, "a1", 2), ("c", 0, 2, "c0", 2)],
        [("e", 0, 1, "e0", 40)],
        [("f", 0, 1, "f0", 50)],
    ])
    done, died = [], []

    def keep(batch):
        rows = batch.collect()
        if rows and any(r.doc_id == "a" for r in rows) and not died:
            died.append(True)
            raise RuntimeError("killed")
        done.extend(rows)
        return batch

    run = lambda: for_each_batch(whole_documents(stream(spark, str(tmp_path / "in")), "10 minutes"), keep, str(tmp_path / "out"), str(tmp_path / "state"))
    with pytest.raises(Exception, match="killed"):
        run().awaitTermination(120)
    assert {r.doc_id for r in done} == {"b"}
    run().awaitTermination(120)
    found = spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "out")).collect()
    by = {}
    for r in sorted(found, key=lambda r: (r.doc_id, r.page_num)):
        by.setdefault((r.doc_id, r.complete), []).append(r.payload)
    assert by == {("a", True): ["a0", "a1", "a2"], ("b", True): ["b0"], ("c", True): ["c0", "c1"], ("d", False): ["d0"], ("e", True): ["e0"], ("f", True): ["f0"]}
    run().awaitTermination(120)
    assert spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "out")).count() == len(found)


def test_watched_files_are_read_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.pdf").write_bytes(b"first")
    seen = []
    run = lambda: for_each_batch(watch_files(spark, str(tmp_path / "in")), lambda b: (seen.extend(b.collect()), b)[1], str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(60)
    run()
    (tmp_path / "in" / "two.pdf").write_bytes(b"second")
    (tmp_path / "in" / "note.txt").write_bytes(b"other")
    run()
    assert [(r.doc_id, bytes(r.content)) for r in seen] == [("one", b"first"), ("two", b"second")]
