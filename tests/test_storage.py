"""CSV scans and sinks, clean-up in place, streams."""

import csv
import glob
import os
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from adloom.operators.shape import align
from adloom.plans.cleanup import check_duplicates, clean_errors
from adloom.plans.ingest import target_of
from adloom.schema import ADS_COLUMNS
from adloom.session import session, shared_dir
from adloom.sources import ads as src
from adloom.streaming.dedup import append_unseen, first_seen_stream

HEADER = ",".join(ADS_COLUMNS)


def line(ident, title="t", description="d"):
    return f"{ident},u,{title},,,,,,,{description}"


RAW = "\n".join(
    [
        HEADER,
        line("1", '"said ""hi"", twice"'),
        line("2", description='"two\nlines"'),
        "",
        line("3", '""'),
        "4,u,short",
        line("5") + ",extra",
        line("6", " 403 ERROR "),
        line("7", "back\\slash"),
    ]
)


@pytest.fixture
def raw(tmp_path):
    path = tmp_path / "jobs.csv"
    path.write_text(RAW + "\n", encoding="utf-8")
    return str(path)


def test_scan_matches_a_csv_reader(spark, raw):
    got = src.read_csv(spark, raw, positions=True, quarantine=True).orderBy("pos").collect()
    with open(raw, encoding="utf-8", newline="") as f:
        want = list(enumerate(csv.DictReader(f), start=2))
    assert [(r["pos"], *[r[c] for c in ADS_COLUMNS]) for r in got] == [
        (pos, *[row[c] or "" for c in ADS_COLUMNS]) for pos, row in want
    ]
    assert [r["id"] for r in got if r["_bad"] is not None] == ["4", "5"]


def test_positions_run_on_over_files(spark, tmp_path):
    for name, idents in [("b", "45"), ("a", "123"), ("c", "6")]:
        (tmp_path / f"{name}.csv").write_text("\n".join([HEADER, *[line(i) for i in idents]]))
    got = src.read_csv(spark, str(tmp_path), positions=True).orderBy("pos").collect()
    assert [(r["pos"], r["id"]) for r in got] == [(i + 1, str(i)) for i in range(1, 7)]


def test_positions_over_splits_of_one_file(spark, tmp_path):
    """Lines, so that a file is cut into many splits."""
    path = tmp_path / "lines.txt"
    path.write_text("".join(f"{i}\n" for i in range(20000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        df = spark.read.text(str(path))
        assert df.rdd.getNumPartitions() > 8
        bad = src.record_positions(df).filter(F.col("pos") != F.col("value").cast("bigint") + 2)
        assert bad.count() == 0 and src.record_positions(df).count() == 20000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_missing_files_are_empty_tables(spark, tmp_path):
    nowhere = str(tmp_path / "none.csv")
    assert src.read_csv(spark, nowhere).count() == 0
    assert src.read_csv(spark, nowhere, positions=True, quarantine=True).columns == ["pos", *ADS_COLUMNS, "_bad"]
    assert src.read_parquet(spark, nowhere).columns == ADS_COLUMNS
    assert clean_errors(spark, nowhere) is None


def test_a_header_in_another_order_is_refused(spark, tmp_path):
    path = tmp_path / "other.csv"
    path.write_text("url,id," + ",".join(ADS_COLUMNS[2:]) + "\n" + line("1") + "\n")
    with pytest.raises(Exception, match="CSV header"):
        src.read_csv(spark, str(path)).collect()
    row = align(src.read_csv_columns(spark, str(path))).first()
    assert (row["id"], row["url"]) == ("u", "1")


def test_target_of_another_table(spark, raw, tmp_path):
    assert target_of(spark, str(tmp_path / "none.csv")) is None
    assert spark.range(1).select(target_of(spark, raw)).first()[0] == 6


def test_files_with_and_without_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\n".join([HEADER, line("1"), line("2")]))
    (tmp_path / "b.csv").write_text("\n".join([line("3"), line("4")]))
    got = src.read_mixed_headers(spark, str(tmp_path))
    assert sorted(r["id"] for r in got.collect()) == ["1", "2", "3", "4"]


TRICKY = ["", " padded ", 'quo"te', "a,b", "line\nbreak", "cr\rx", "back\\", '"', "tab\t", "é£"]


def test_round_trip(spark, make_ads, tmp_path):
    ads = make_ads([{"id": str(i), "title": t, "description": t[::-1]} for i, t in enumerate(TRICKY)])
    path = str(tmp_path / "out")
    src.write_csv(ads, path)
    back = src.read_csv(spark, path, quarantine=True)
    assert sorted((r["id"], r["title"], r["description"], r["_bad"]) for r in back.collect()) == sorted(
        (str(i), t, t[::-1], None) for i, t in enumerate(TRICKY)
    )
    src.write_csv(ads, path, mode="append")
    assert src.read_csv(spark, path).count() == 2 * len(TRICKY)
    for part in glob.glob(f"{path}/*.csv"):
        assert open(part, encoding="utf-8", newline="").readline().strip() == HEADER


def test_clean_keeps_a_backup_and_is_idempotent(spark, raw):
    with pytest.raises(ValueError, match="1 records"):
        clean_errors(spark, raw)
    text = RAW.replace(",extra", "") + "\n"
    with open(raw, "w", encoding="utf-8") as file:
        file.write(text)
    before = src.read_csv(spark, raw).count()
    done = clean_errors(spark, raw, now=datetime(2024, 5, 1, 8, 0, 0))
    assert (done.total, done.removed, done.remaining) == (before, 1, before - 1)
    assert done.backup == f"{raw}.backup_20240501_080000"
    assert open(done.backup, encoding="utf-8").read() == text
    assert sorted(r["id"] for r in src.read_csv(spark, raw).collect()) == ["1", "2", "3", "4", "5", "7"]
    again = clean_errors(spark, raw)
    assert (again.removed, again.backup) == (0, None)
    assert len(glob.glob(f"{raw}.*")) == 1


def test_clean_without_backup_and_with_other_columns(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("title,more\na,1\n403 ERROR,2\n")
    assert clean_errors(spark, str(path), backup=False).backup is None
    assert sorted(os.listdir(tmp_path)) == ["x.csv"]
    assert [tuple(r) for r in src.read_csv_columns(spark, str(path)).collect()] == [("a", "1")]


def test_clean_refuses_what_it_would_lose(spark, tmp_path):
    for name, texts in {
        "long": ["id,url,title\n1,u,t,EXTRA,MORE\n2,u,403 ERROR\n"],
        "mixed": ["id,company,title\n1,c,t\n", "id,title,company\n2,403 ERROR,c\n"],
    }.items():
        folder = tmp_path / name
        folder.mkdir()
        for k, text in enumerate(texts):
            (folder / f"{k}.csv").write_text(text)
        with pytest.raises(Exception):
            clean_errors(spark, str(folder))
        assert sorted(os.listdir(tmp_path / name)) == [f"{k}.csv" for k in range(len(texts))]
        assert [(folder / f"{k}.csv").read_text() for k in range(len(texts))] == texts


def test_clean_puts_the_old_table_back(spark, tmp_path, monkeypatch):
    from adloom.sources import files

    path, rename = tmp_path / "x.csv", files.rename
    path.write_text("title,more\na,1\n403 ERROR,2\n")

    def failing(spark, source, target):
        if "staging" in source:
            raise OSError("no")
        rename(spark, source, target)

    monkeypatch.setattr(files, "rename", failing)
    with pytest.raises(OSError):
        clean_errors(spark, str(path))
    assert path.read_text() == "title,more\na,1\n403 ERROR,2\n"


def test_clean_keeps_an_earlier_backup_and_checks_duplicates(spark, make_ads, tmp_path):
    path, now = str(tmp_path / "t"), datetime(2024, 5, 1, 8, 0, 0)
    ads = make_ads([{"id": "a", "title": "403 ERROR"}, {"id": "a", "title": "x"}]).drop("pos")
    ads.write.parquet(path)
    assert clean_errors(spark, path, "parquet", now=now, check=True).excess == {"ID": 1, "URL": 0, "Title+Company": 0}
    ads.write.mode("overwrite").parquet(path)
    with pytest.raises(FileExistsError):
        clean_errors(spark, path, "parquet", now=now)
    assert spark.read.parquet(path).count() == 2


def test_check_before_cleaning_counts_error_records(make_ads):
    ads = make_ads([{"id": "a", "title": "403 ERROR"}, {"id": "a", "title": "x"}, {"id": "b", "title": "y"}])
    summed, preview = check_duplicates(ads)
    assert {r["type"]: r["excess"] for r in summed.collect()} == {"ID": 1, "URL": 0, "Title+Company": 0}
    assert [(r["key"], r["pos"]) for r in preview.collect()] == [("a", 3)]


EVENTS = "id string, ts timestamp, pos bigint"


def batches_in(spark, folder, *batches):
    for i, rows in enumerate(batches):
        df = spark.createDataFrame([(k, datetime(2024, 1, 1, 0, m), p) for k, m, p in rows], EVENTS)
        df.coalesce(1).write.mode("append").parquet(folder)
        # Files are taken in the order of their times.
        for f in glob.glob(f"{folder}/*.parquet"):
            if os.path.getmtime(f) > 1000000:
                os.utime(f, (1000 + i, 1000 + i))
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(folder)


def test_append_unseen_over_batches_and_restart(spark, tmp_path):
    folder, table, state = (str(tmp_path / n) for n in ("in", "table", "state"))
    stream = batches_in(spark, folder, [("a", 1, 2), ("a", 1, 1), ("b", 2, 3)], [("b", 3, 4), ("c", 3, 5)])
    append_unseen(stream, table, "id", "pos", state).awaitTermination()
    assert sorted((r["id"], r["pos"]) for r in spark.read.parquet(table).collect()) == [("a", 1), ("b", 3), ("c", 5)]
    stream = batches_in(spark, folder, [("c", 9, 6), ("d", 9, 7)])
    append_unseen(stream, table, "id", "pos", state).awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(table).collect()) == ["a", "b", "c", "d"]
    # All batches once more, as after a lost checkpoint: nothing is added twice.
    append_unseen(stream, table, "id", "pos", str(tmp_path / "fresh")).awaitTermination()
    assert spark.read.parquet(table).count() == 4


def test_a_batch_reads_its_own_buckets(spark, tmp_path, monkeypatch):
    folder, table, state = (str(tmp_path / n) for n in ("in", "table", "state"))
    many = [(f"k{k}", 1, k) for k in range(300)]
    append_unseen(batches_in(spark, folder, many), table, "id", "pos", state).awaitTermination()
    assert len(glob.glob(f"{table}/_bucket=*")) > 50
    append_unseen(batches_in(spark, folder, [("k7", 2, 900), ("new", 2, 901)]), table, "id", "pos", state).awaitTermination()
    stored = spark.read.parquet(table)
    assert stored.count() == 301
    text = stored.filter(F.col("_bucket").isin([1, 2])).select("id")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[_bucket#\d+ IN", text)


@pytest.mark.parametrize("spread", [1, 4])
def test_first_seen_stream(spark, tmp_path, spread):
    rows = [("hot", m, m) for m in range(30)] + [("a", 1, 50), ("b", 2, 51)]
    stream = batches_in(spark, str(tmp_path / "in"), rows, [("hot", 31, 60), ("b", 31, 61), ("c", 31, 62)])
    out = str(tmp_path / "out")
    seen = first_seen_stream(stream, ["id"], "ts", "2 hours", spread)
    writer = seen.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state"))
    writer.trigger(availableNow=True).start(out).awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == ["a", "b", "c", "hot"]


def test_shared_dir_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert session().sparkContext is spark.sparkContext


def test_local_folders_are_refused_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        class _jsc:
            @staticmethod
            def hadoopConfiguration():
                return {"fs.defaultFS": "file:///"}

    class Conf(dict):
        pass

    class Session:
        sparkContext = Context

        def __init__(self, folder):
            self.conf = Conf({"spark.checkpoint.dir": folder} if folder else {})

    for folder in (None, "file:///tmp/x", "/tmp/x"):
        with pytest.raises(ValueError):
            shared_dir(Session(folder))
    assert shared_dir(Session("hdfs://name/x/")) == "hdfs://name/x"


def test_single_line_files_can_be_split(spark, make_ads, tmp_path):
    path = str(tmp_path / "flat")
    src.write_csv(make_ads([{"id": str(k), "title": 'a "b"'} for k in range(50)]), path)
    flat = src.read_csv(spark, path, multiline=False)
    assert sorted(map(tuple, flat.collect())) == sorted(map(tuple, src.read_csv(spark, path).collect()))
