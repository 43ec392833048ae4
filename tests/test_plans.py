"""What the plans look like: shuffles, joins, windows, pushed columns."""

import re

import pytest
from pyspark.sql import functions as F

from adloom.catalog import bindings as b
from adloom.operators import batches, crawl
from adloom.operators import duplicates as dup
from adloom.operators import incremental as inc
from adloom.operators import validity as v
from adloom.operators.running import running_totals
from adloom.sources import pages as pg

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    """The plan before anything has run."""
    return df._jdf.queryExecution().executedPlan().toString()


def ran(df):
    """The plan that was carried out, without the one it started from."""
    df.collect()
    return plan(df).split("== Initial Plan ==")[0]


def shuffles(text):
    return len(re.findall(r"Exchange hashpartitioning", text))


def test_all_criteria_share_one_shuffle(spark):
    marked = dup.marks(b.ads(spark, FOLDER))
    assert shuffles(plan(dup.key_counts(marked))) == 1
    # The second one is over the four criteria only, the single one over one row of each.
    assert shuffles(plan(dup.summary(marked))) == 2


def test_report_scans_and_shuffles_the_marks_once(spark):
    text = ran(dup.report(dup.duplicates(dup.marks(b.ads(spark, FOLDER)))))
    assert text.count("ReusedExchange") >= 1
    assert text.count("FileScan") == 1


def test_no_cross_joins_and_no_window_over_everything(spark):
    ads, stored = b.ads(spark, FOLDER), b.stored(spark, FOLDER)
    links = b.links(spark, FOLDER)
    ids = inc.stored_ids(stored)
    frames = [
        dup.duplicates(dup.marks(ads)),
        dup.preview_first(dup.duplicates(dup.marks(ads))),
        dup.preview_second(dup.marks(ads)),
        inc.accepted(links, ids, "id"),
        inc.skipped(links, ids, "id"),
        inc.page_stats(links, ids, "id", ["page_num"]),
        inc.skipped_preview(inc.skipped(links, ids, "id"), ["crawl_id", "page_num"]),
        inc.budget_cut(links, 50, by=["crawl_id"]),
        running_totals(links, ["crawl_id"], "pos", {"n": F.lit(1)}),
    ]
    for df in frames:
        text = plan(df)
        assert "CartesianProduct" not in text and "NestedLoop" not in text
        assert "Exchange SinglePartition" not in text
        assert "BatchEvalPython" not in text


def test_windows_that_pick_a_few_rows_cut_before_the_shuffle(spark):
    marked = dup.marks(b.ads(spark, FOLDER))
    for df in (dup.second_occurrence(marked), dup.preview_first(dup.duplicates(marked))):
        text = plan(df)
        assert re.search(r"WindowGroupLimit.*Partial", text) and re.search(r"WindowGroupLimit.*Final", text)


def test_counts_are_combined_before_the_shuffle(spark):
    text = plan(dup.key_counts(dup.marks(b.ads(spark, FOLDER))))
    assert "partial_count" in text
    text = plan(inc.first_seen(b.links(spark, FOLDER), "id"))
    assert "partial_min_by" in text


def test_only_needed_columns_are_read(spark):
    ads = spark.read.parquet(f"{FOLDER}/documents.parquet")
    table = ads.select(F.col("lang").alias("title"), "source", "text")
    assert "struct<lang:string>" in plan(v.stored_count(table))
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    assert "struct<page_id:bigint,html:string>" in plan(pg.extract_links(pages, b.HOST))


def test_pages_are_parsed_once(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    assert plan(pg.extract_ads(pages)).count("ArrowEvalPython") == 1


def test_big_tables_are_not_spread(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    assert "RoundRobinPartitioning" in plan(pg.extract_ads(pages))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        assert "RoundRobinPartitioning" not in plan(pg.extract_ads(pages))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("name", ["duplicates", "accepted"])
def test_ten_times_the_rows_keep_the_plan(spark, name):
    """The number of shuffles does not depend on the table."""
    ads = b.ads(spark, FOLDER)
    big = ads.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(10)))).withColumn("pos", F.col("pos") * 10 + F.col("copy")).drop("copy")
    def build(df):
        return dup.duplicates(dup.marks(df)) if name == "duplicates" else inc.accepted(df, inc.stored_ids(df), "id")
    assert shuffles(plan(build(ads))) == shuffles(plan(build(big)))


def test_new_links_take_one_scan_and_one_join(spark):
    links, stored = b.links(spark, FOLDER), b.stored(spark, FOLDER)
    text = plan(inc.not_stored(links, inc.stored_ids(stored), "id"))
    assert text.count("FileScan") == 2 and text.count("LeftAnti") == 1


def test_crawls_end_without_running_sums(spark):
    """One window over slabs and one inside them find stuck pages; the rest is one aggregate and one join."""
    log = b.crawl_log(spark, FOLDER)
    text = plan(crawl.crawl_prefix(log))
    assert len(re.findall(r"Window \[", text)) <= 3 and shuffles(text) <= 5


def test_batches_take_one_aggregate_and_one_join(spark):
    log = b.batch_log(spark, FOLDER).select("crawl_id", "rn")
    assert "Window" not in plan(batches.batch_assign(spark.createDataFrame(log.limit(5).collect(), log.schema)))
