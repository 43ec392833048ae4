"""Stream tables with a bucket count of their own, and their compaction."""

import glob
import os

import pytest

from adloom.sources import files
from adloom.streaming import dedup

SCHEMA = "id string, pos bigint"


@pytest.fixture
def run(spark, tmp_path):
    """Append batches of ids to the table, each a file of the stream."""
    at = {"n": 0}

    def run(*batches, **options):
        for ids in batches:
            rows = [(k, at["n"] * 1000 + i) for i, k in enumerate(ids)]
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{at['n']}"))
            at["n"] += 1
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
        source = stream.parquet(str(tmp_path / "in"))
        dedup.append_unseen(source, str(tmp_path / "t"), "id", "pos", str(tmp_path / "state"), **options).awaitTermination()
        return str(tmp_path / "t")

    return run


def ids(spark, table):
    return sorted(r.id for r in spark.read.parquet(table).collect())


def most_files(table):
    return max(len(glob.glob(f"{b}/*.parquet")) for b in glob.glob(f"{table}/_bucket=*"))


def test_compaction_keeps_rows_and_later_batches_exact(spark, run, monkeypatch):
    batches = [[f"k{b}-{k}" for k in range(12)] for b in range(6)]
    table = run(*batches, buckets=3)
    want = sorted(k for b in batches for k in b)
    assert dedup.buckets_of(spark, table) == 3 and len(glob.glob(f"{table}/_bucket=*")) == 3
    assert ids(spark, table) == want and most_files(table) > 3
    assert dedup.compact(spark, table, files=3) == 3
    assert ids(spark, table) == want and most_files(table) == 1
    assert dedup.compact(spark, table, files=3) == 0
    # The number of buckets stays that of the first batch, whatever a later run asks for.
    run(["k0-1", "new"], buckets=50)
    assert dedup.buckets_of(spark, table) == 3 and ids(spark, table) == sorted([*want, "new"])

    # A compaction that stops between its two renamings of a bucket.
    calls = []

    def failing(spark, source, target):
        calls.append(source)
        if len(calls) == 2:
            raise OSError("lost")
        files.rename(spark, source, target)

    monkeypatch.setattr(dedup, "rename", failing)
    with pytest.raises(OSError, match="lost"):
        dedup.compact(spark, table, files=0)
    monkeypatch.undo()
    assert len(ids(spark, table)) < len(want)
    run(["k0-2", "k5-3", "newer"])
    assert ids(spark, table) == sorted([*want, "new", "newer"])
    assert not os.path.exists(f"{table}/{dedup.REPLACED}") and not os.path.exists(f"{table}/{dedup.FRESH}")
    # Small files: a bucket is cut into several.
    assert dedup.compact(spark, table, files=0, file_bytes=1000) == 3
    assert ids(spark, table) == sorted([*want, "new", "newer"]) and most_files(table) > 1


def test_tables_without_buckets_stay_so(spark, run, tmp_path):
    spark.createDataFrame([("a", 1)], SCHEMA).write.parquet(str(tmp_path / "t"))
    table = run(["a", "b", "b"])
    assert ids(spark, table) == ["a", "b"] and "_bucket" not in spark.read.parquet(table).columns
    assert dedup.compact(spark, table) == 0
