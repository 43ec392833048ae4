"""Order by any columns, against plain loops."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from adloom.operators import ordering


@pytest.fixture(scope="module")
def rows(spark):
    """A third of the rows has one value, some have none, names clash with working columns."""
    rng = random.Random(3)
    data = []
    for k in range(900):
        value = "same" if k % 3 == 0 else rng.choice([None, "", "a", "zz", "é", "Ω"])
        data.append((k * 7919 % 900, value, rng.randint(-3, 9) if k % 5 else None, "hot" if k % 3 else "cold", k))
    return spark.createDataFrame(data, "uid long, value string, n int, grp string, _rank int")


def place(r):
    return (r["value"] is not None, (r["value"] or "").encode(), r["uid"])


@pytest.mark.parametrize("range_rows", [7, 100, 100_000])
@pytest.mark.parametrize("by", [[], ["grp"]])
def test_totals_and_ranks(rows, range_rows, by):
    got = ordering.running_totals(
        rows, ["value", "uid"], {"sum": F.col("n"), "at": F.lit(1)}, by, {"at": "all"}, range_rows
    ).collect()
    want = {}
    groups = {}
    for r in sorted(rows.collect(), key=place):
        groups.setdefault(r["grp"] if by else "", []).append(r)
    for members in groups.values():
        total = 0
        for k, r in enumerate(members):
            total += r["n"] or 0
            want[r["uid"]] = (total, k + 1, len(members))
    assert {r["uid"]: (r["sum"], r["at"], r["all"]) for r in got} == want and len(got) == 900
    assert set(got[0].asDict()) == {*rows.columns, "sum", "at", "all"}


def test_a_hot_value_is_cut_into_ranges(rows):
    sizes = [r["count"] for r in ordering.in_ranges(rows, ["value", "uid"], range_rows=50).groupBy("_slab").count().collect()]
    assert len(sizes) >= 15 and max(sizes) < 150 and sum(sizes) == 900


def test_rows_alike_in_the_whole_order_get_places_of_their_own(spark):
    same = spark.range(500).select(F.lit("x").alias("v"))
    assert sorted(r["k"] for r in ordering.rank(same, ["v"], "k", range_rows=50).collect()) == list(range(1, 501))


@pytest.mark.parametrize("budget", [0, 1, 301, 5000])
def test_budget(rows, budget):
    order = [F.col("value").desc(), "uid"]
    got = {r["uid"] for r in ordering.first_rows(rows, budget, order, range_rows=40).collect()}
    ordered = sorted(rows.collect(), key=lambda r: r["uid"])
    ordered.sort(key=lambda r: (r["value"] is not None, (r["value"] or "").encode()), reverse=True)
    assert got == {r["uid"] for r in ordered[:budget]}


def test_budget_of_each_group_from_a_column(rows):
    got = ordering.first_rows(rows, F.when(F.col("grp") == "hot", 4).otherwise(2), ["value", "uid"], ["grp"], 40).collect()
    assert sorted(r["grp"] for r in got) == ["cold"] * 2 + ["hot"] * 4


def test_times_nothing_and_missing_groups(spark, rows):
    at = datetime.datetime(2024, 5, 1)
    times = spark.createDataFrame([(at, 2), (at, 1), (None, 3)], "ts timestamp_ntz, id int")
    assert [r["id"] for r in ordering.rank(times, ["ts", "id"], "k").orderBy("k").collect()] == [3, 1, 2]
    assert ordering.rank(rows.limit(0), ["uid"], "k", by=["grp"]).collect() == []
    assert ordering.first_rows(rows.limit(0), 5, ["uid"]).collect() == []
    with pytest.raises(Exception, match="without value"):
        ordering.rank(rows, ["uid"], "k", by=["value"])


def test_no_task_ranks_what_a_budget_leaves_out(rows):
    plan = ordering.first_rows(rows, 10, ["value", "uid"], range_rows=50)._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window " in line and "_rank" in line or "row_number" in line]
    assert all("_slab" in line for line in windows)
