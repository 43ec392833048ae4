"""Streams with state machines, in shuffled batches and over restarts, against plain loops."""

import random
from datetime import datetime, timedelta

import pytest

from adloom.session import staging_path
from adloom.streaming import stateful
from adloom.streaming.stateful import crawl_prefix_stream, first_by_time_stream

START = datetime(2024, 1, 1)


def run(spark, batches, schema, made):
    """One file for each batch, one start of the query for each list of batches."""
    path = staging_path(spark, "stream")
    for part in batches:
        for rows in part:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
        writer = made(stream).writeStream.format("parquet").option("checkpointLocation", f"{path}/state")
        writer.trigger(availableNow=True).start(f"{path}/out").awaitTermination()
    return spark.read.parquet(f"{path}/out").collect()


PAGES = "crawl_id long, page_num long, n_links long, fp string, ts timestamp"


def page(crawl, number, n=2, fp=None, minute=0):
    return (crawl, number, n, fp or (f"{crawl}/{number}" if n else None), START + timedelta(minutes=minute or number))


def reached(pages):
    last, out = None, []
    for number, n, fp in pages:
        if n == 0 or (last is not None and fp == last):
            break
        out.append(number)
        last = fp
    return out


def test_crawls_from_pages_in_any_order_and_over_a_restart(spark):
    rng = random.Random(6)
    rows, want = [], {}
    for crawl in range(12):
        pages = []
        for number in range(1, rng.randint(2, 14)):
            n = 0 if rng.random() < 0.08 else 2
            fp = pages[-1][2] if pages and pages[-1][1] and n and rng.random() < 0.1 else f"{crawl}/{number}"
            pages.append((number, n, fp if n else None))
        want[crawl] = reached(pages)
        rows += [(crawl, number, n, fp, START + timedelta(minutes=number)) for number, n, fp in pages]
    rows += rows[:10]  # pages that come twice
    rng.shuffle(rows)
    thirds = [rows[k::3] for k in range(3)]
    got = run(spark, [thirds[:2], thirds[2:]], PAGES, lambda s: crawl_prefix_stream(s, "10 days", 864_000))
    by = {}
    for r in got:
        by.setdefault(r["crawl_id"], []).append(r["page_num"])
    assert {k: sorted(v) for k, v in by.items()} == {k: v for k, v in want.items() if v}


def test_a_quiet_crawl_is_closed_and_pages_behind_a_gap_are_taken(spark):
    first = [page(1, 1), page(1, 3), page(1, 4, fp="1/3"), page(2, 2), page(2, 3, n=0), page(2, 4)]
    later = [page(9, 1, minute=600)]
    last = [page(9, 2, minute=1200)]
    got = run(spark, [[first], [later, last]], PAGES, lambda s: crawl_prefix_stream(s, "1 hour", 3600))
    assert sorted((r["crawl_id"], r["page_num"]) for r in got) == [(1, 1), (1, 3), (2, 2), (9, 1), (9, 2)]


@pytest.mark.parametrize("hot", [1, 60])
def test_the_earliest_row_of_a_key(spark, hot):
    rng = random.Random(hot)
    keys = ["hot"] * hot + ["a", "b", None]
    rows = [(rng.choice(keys), START + timedelta(seconds=rng.randrange(300)), k, f"v{k}") for k in range(200)]
    want = {}
    for key, ts, order, value in sorted(rows, key=lambda r: (r[1], r[2])):
        want.setdefault(key, (ts, order, value))
    rng.shuffle(rows)
    end = [("end", START + timedelta(days=9), -1, "x")]
    schema = "k string, ts timestamp, n long, v string"
    got = run(spark, [[rows[:90], rows[90:150]], [rows[150:], end]], schema, lambda s: first_by_time_stream(s, "k", "ts", "n", "1 day", 86_400 * 30))
    assert {r["k"]: (r["ts"], r["n"], r["v"]) for r in got if r["k"] != "end"} == want and len(got) == len(want)


def test_values_beside_nulls_and_equal_times_stay_as_they_are(spark):
    big = 2**53 + 1
    rows = [(f"k{k}", START + timedelta(seconds=k % 7), big + k, None if k % 3 else big + k, k % 2 == 0 or None) for k in range(60)]
    end = [("end", START + timedelta(days=9), -1, None, None)]
    later = [(f"k{k}", START, 0 if k % 2 else None, big, True) for k in range(60)]
    schema = "k string, ts timestamp, n long, m long, b boolean"
    got = run(spark, [[rows, later], [end]], schema, lambda s: first_by_time_stream(s, "k", "ts", "n", "1 day", 86_400 * 30, buckets=2))
    want = {r[0]: r for r in rows} | {r[0]: r for k, r in enumerate(later) if k % 2 or k % 7}
    assert {r["k"]: tuple(r) for r in got} == want and len(got) == len(want)


class Store:
    """A state value and the timers of one bucket, and how often they are touched."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def getValueState(self, name, schema):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def clear(self):
        self.value = None

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)

    def fire(self, machine, watermark):
        """Timers before the watermark, as Spark calls them."""
        self.getExpiryTimeInMs, self.getCurrentWatermarkInMs = lambda: fired, lambda: watermark
        out = []
        for fired in sorted(t for t in self.timers if t < watermark):
            out += machine.handleExpiredTimer((0,), self, self)
            self.timers.remove(fired)
        return [tuple(r) for r in out]


def test_state_is_touched_once_for_all_keys_of_a_bucket(spark):
    from pyspark.sql import Row
    from pyspark.sql import types as T

    store, schema = Store(), T._parse_datatype_string("k string, ts long, n long, _at long")
    machine = stateful.Earliest(schema, "k", "ts", "n", 100)
    machine.init(store)
    take = Row("k", "ts", "n", "_at", "_bucket")
    rows = [take(f"k{k}", 1000 + k, k, 1000 + k, 0) for k in range(1000)]
    assert list(machine.handleInputRows((0,), iter(rows), None)) == [] and store.calls == 2 and store.timers == {1000}
    assert list(machine.handleInputRows((0,), iter([take("k9", 990, 1, 990, 0), take("k8", 1008, 9, 1008, 0)]), None)) == []
    assert store.timers == {990} and store.calls == 6
    out = store.fire(machine, 1005)
    assert sorted(out) == [("k0", 1000, 0, 1000), *((f"k{k}", 1000 + k, k, 1000 + k) for k in range(1, 5)), ("k9", 990, 1, 990)]
    assert store.timers == {1005} and store.calls == 9
    # Known keys are passed over until the horizon has gone by: that of k9 ends at 1090.
    machine.handleInputRows((0,), iter([take("k1", 1, 1, 1, 0), take("k9", 1080, 1, 1080, 0)]), None)
    assert sorted(r[0] for r in store.fire(machine, 1095)) == sorted(f"k{k}" for k in range(5, 95) if k != 9)
    assert store.timers == {1095} and store.fire(machine, 1095) == []
    machine.handleInputRows((0,), iter([take("k9", 1500, 1, 1500, 0)]), None)
    assert len(out := store.fire(machine, 5000)) == 906 and ("k9", 1500, 1, 1500) in out
    while store.timers:
        assert store.fire(machine, 5000) == []
    assert store.value is None
    with pytest.raises(ValueError):
        machine.handleInputRows((0,), iter([take("k1", None, 1, None, 0)]), None)
