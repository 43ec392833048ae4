"""Filters and duplicate counts beside a table."""

import pytest
from pyspark.sql import functions as F

from adloom.operators import duplicates as dup
from adloom.operators import membership as mem
from adloom.plans import dupstate
from adloom.session import staging_path
from adloom.sources.files import children

SHAPES = [mem.Shape(1, 1), mem.Shape(4, 3), mem.sized(400)]


def keys(spark, values, name="id"):
    return spark.createDataFrame([(v, k) for k, v in enumerate(values)], f"{name} string, block int")


@pytest.fixture(scope="module")
def stored(spark):
    return keys(spark, [f"s{k}" for k in range(400)] + [None, "", "é", "hot"] + ["hot"] * 50)


@pytest.fixture(scope="module")
def links(spark):
    return keys(spark, [f"s{k}" for k in range(300, 500)] + [None, None, "", "E"] + ["hot"] * 200 + ["cool"] * 200)


@pytest.mark.parametrize("shape", SHAPES)
def test_equals_the_anti_join_whatever_the_filter_says(stored, links, shape):
    got = mem.not_stored(links, stored, "id", mem.key_filter(stored, "id", shape), shape)
    want = links.join(stored.select("id"), "id", "left_anti")
    assert got.columns == links.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*links.columns).collect()))


def test_a_filter_knows_its_keys_and_few_others(spark, stored):
    shape = mem.sized(400)
    filter_ = mem.key_filter(stored, "id", shape)
    known = mem.flagged(stored.filter("id IS NOT NULL"), "id", filter_, shape)
    assert known.filter("NOT _maybe").count() == 0
    others = mem.flagged(keys(spark, [f"x{k}" for k in range(4000)]), "id", filter_, shape)
    assert others.filter("_maybe").count() < 120
    assert mem.flagged(stored.filter("id IS NULL"), "id", filter_, shape).filter("_maybe").count() == 0


def test_merged_filters_are_the_filter_of_the_union(spark, stored):
    shape = mem.Shape(4, 3)
    parts = [mem.key_filter(stored.filter(F.col("block") % 3 == k), "id", shape) for k in range(3)]
    whole = sorted(map(tuple, mem.key_filter(stored, "id", shape).collect()))
    assert sorted(map(tuple, mem.merged(*parts, parts[1]).collect())) == whole
    path = staging_path(spark, "filter")
    for k in (0, 1, 1, 2):
        got = mem.add_to_filter(spark, path, stored.filter(F.col("block") % 3 == k), "id", shape)
    assert sorted(map(tuple, got.collect())) == whole


def test_surely_new_links_never_meet_the_stored_keys(spark, stored, links):
    shape = mem.sized(400)
    df = mem.not_stored(links, stored, "id", mem.key_filter(stored, "id", shape), shape)
    plan = df._jdf.queryExecution().optimizedPlan()
    union = [line for line in plan.toString().splitlines() if line.lstrip(" :+-").startswith("Union")]
    sides = [plan.children().apply(k).toString() for k in range(2)]
    assert union and "LeftAnti" not in sides[0] and "LeftAnti" in sides[1]
    assert "_maybe" in sides[1] or "Filter" in sides[1]


def test_empty_tables_and_shapes(spark, stored, links):
    shape = mem.sized(0)
    nothing = stored.limit(0)
    assert mem.not_stored(links, nothing, "id", mem.key_filter(nothing, "id", shape), shape).count() == links.count()
    assert mem.not_stored(links.limit(0), stored, "id", mem.key_filter(stored, "id", shape), shape).count() == 0
    assert mem.sized(10**12).buckets * mem.sized(10**12).blocks <= mem.MOST_BLOCKS
    with pytest.raises(ValueError):
        mem.Shape(0, 5)


def marks(spark, *rows):
    return spark.createDataFrame([(t, k, p) for p, (t, k) in enumerate(rows)], "type string, key string, pos long")


def state_of(spark, path):
    return {(r["type"], r["key"]): r["n"] for r in dupstate.counts(spark, path).collect()}


def test_batches_add_remove_and_repeat(spark):
    path = staging_path(spark, "state")
    one = marks(spark, (dup.ID, "a"), (dup.ID, "a"), (dup.URL, "a"), (dup.ID, "b"))
    assert dupstate.apply_batch(spark, path, "1", added=one, buckets=5)
    assert not dupstate.apply_batch(spark, path, "1", added=one)
    assert state_of(spark, path) == {(dup.ID, "a"): 2, (dup.URL, "a"): 1, (dup.ID, "b"): 1}
    gone = marks(spark, (dup.ID, "a"), (dup.ID, "b"))
    assert dupstate.apply_batch(spark, path, "2", added=marks(spark, (dup.URL, "a")), removed=gone, buckets=99)
    assert state_of(spark, path) == {(dup.ID, "a"): 1, (dup.URL, "a"): 2}
    rows = {r["type"]: (r["duplicated_keys"], r["excess"]) for r in dupstate.summary(spark, path).collect()}
    assert rows == {dup.ID: (0, 0), dup.URL: (1, 1), dup.TITLE_COMPANY: (0, 0), dup.FULL_CONTENT: (0, 0)}
    with pytest.raises(Exception, match="not there"):
        dupstate.apply_batch(spark, path, "3", removed=gone)
    assert state_of(spark, path) == {(dup.ID, "a"): 1, (dup.URL, "a"): 2}
    assert dupstate.apply_batch(spark, path, "3", removed=marks(spark, (dup.ID, "a"), (dup.URL, "a"), (dup.URL, "a")))
    assert state_of(spark, path) == {}
    assert sorted(children(spark, f"{path}/manifest")) == ["1", "2", "3"]
    dupstate.clean_up(spark, path)
    assert children(spark, f"{path}/manifest") == ["3"] and state_of(spark, path) == {}


def test_a_batch_that_stopped_halfway_is_run_again_and_touches_its_buckets_only(spark):
    path = staging_path(spark, "state")
    many = marks(spark, *[(dup.ID, f"k{k}") for k in range(200)])
    dupstate.apply_batch(spark, path, "1", added=many, buckets=16)
    # What a lost driver leaves: counts and half a manifest of the next version.
    spark.createDataFrame([("x", "y", 9, 3)], "type string, key string, n long, _bucket int").write.partitionBy("_bucket").parquet(
        f"{path}/counts/version=2"
    )
    spark.createDataFrame([(1,)], "bucket int").write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(
        f"{path}/manifest/2"
    )
    assert len(state_of(spark, path)) == 200
    assert dupstate.apply_batch(spark, path, "2", added=marks(spark, (dup.ID, "k7")))
    got = state_of(spark, path)
    assert got[dup.ID, "k7"] == 2 and len(got) == 200
    touched = [n for n in children(spark, f"{path}/counts/version=2") if n.startswith("_bucket")]
    assert len(touched) == 1
    assert dupstate.apply_batch(spark, path, "3", added=marks(spark).limit(0))
    assert state_of(spark, path) == got
