"""Totals that are counted while a table is written."""

from pyspark.sql import functions as F

from adloom.operators.incremental import crawl_summary
from adloom.plans.cleanup import clean_errors
from adloom.schema import ERROR_TITLE
from adloom.session import materialize, materialize_counted, observed


def executions(spark):
    """Actions of the session so far."""
    return spark._jsparkSession.sharedState().statusStore().executionsCount()


def scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan")


def test_rows_are_counted_while_written(spark):
    df = spark.range(1000).withColumn("hot", F.lit(1))
    joined = df.repartition(7).join(df.withColumnRenamed("hot", "h"), "id").filter("id % 3 = 0")
    before = executions(spark)
    table, n = materialize_counted(joined, "counted")
    assert executions(spark) - before == 1
    assert n == table.count() == 334
    empty, none = materialize_counted(df.filter("id < 0"), "counted")
    assert none == empty.count() == 0
    assert materialize_counted(df.limit(0), "counted")[1] == 0


def test_figures_of_rows_that_a_filter_drops(spark):
    rows, seen = observed(spark.range(100), n=F.count("*"), odd=F.count_if(F.col("id") % 2 == 1))
    assert materialize(rows.filter("id < 10"), "observed").count() == 10
    assert seen.get == {"n": 100, "odd": 50}


def test_clean_up_reads_the_table_once_to_count_and_write(spark, tmp_path, make_ads):
    titles = ["a", ERROR_TITLE, "", f" {ERROR_TITLE} ", "b"] * 40
    path = f"{tmp_path}/ads"
    make_ads([{"title": t} for t in titles]).repartition(4).write.parquet(path)
    before = executions(spark)
    done = clean_errors(spark, path, "parquet")
    assert executions(spark) - before == 2  # is there any error; the writing
    assert (done.total, done.removed, done.remaining) == (200, 80, 120)
    assert spark.read.parquet(path).count() == 120 and spark.read.parquet(done.backup).count() == 200
    again = clean_errors(spark, path, "parquet")
    assert (again.total, again.removed, again.remaining, again.backup) == (120, 0, 120, None)


def test_totals_of_a_run_read_the_stored_table_alone(spark, make_ads):
    stored = materialize(make_ads([{"title": "a"}, {"title": ""}]), "stored")
    found, n = materialize_counted(spark.range(9).toDF("pos"), "found")
    totals = crawl_summary(stored, n, 4)
    assert tuple(totals.first()) == (9, 1, 4, 5) == tuple(crawl_summary(stored, found, found.limit(4)).first())
    assert totals.columns == ["found", "before", "new", "total_after"]
    assert scans(totals) == 1
