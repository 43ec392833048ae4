"""The most frequent keys and categories by term tables, beside plain loops."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from adloom.operators import heavy
from adloom.operators.terms import category_terms, phrases, term_index
from adloom.session import materialize, staging_path

MARKS = "type string, key string, pos long"


def top(rows, k):
    out = set()
    by = {}
    for (t, key), n in Counter((t, key) for t, key, _ in rows if t is not None and key is not None).items():
        by.setdefault(t, []).append((n, key))
    for t, counts in by.items():
        for n, key in counts:
            rank = 1 + sum(m > n for m, _ in counts)
            if rank <= k:
                out.add((t, key, n, rank))
    return out


def skewed():
    """A key on a third of the rows, a hundred keys that matter, and a long tail of single ones; nulls and an empty key."""
    rng = random.Random(3)
    rows = [("a", "hot", k) for k in range(4000)]
    rows += [("a", f"k{min(int(rng.expovariate(0.05)), 99)}", k) for k in range(3000)]
    rows += [("a", f"x{k}", k) for k in range(5000)]
    rows += [("b", f"y{k % 40}", k) for k in range(400)] + [("b", "", 1), ("b", None, 1), (None, "z", 1), ("c", "only", 1)]
    return rows


@pytest.mark.parametrize("k", [1, 20, 20_000])
def test_heavy_keys_with_ties(spark, k):
    rows = skewed()
    df = spark.createDataFrame(rows, MARKS).repartition(7)
    got = heavy.heavy_keys(df, heavy.sketch(df), k).collect()
    assert len(got) == len({(r.type, r.key) for r in got})
    assert {tuple(r) for r in got} == top(rows, k)


@pytest.mark.parametrize("width", [64, 192])
def test_right_whatever_the_sketch_rules_out(spark, monkeypatch, width):
    monkeypatch.setattr(heavy, "WIDTH", width)
    rows = skewed()
    df = spark.createDataFrame(rows, MARKS)
    wider = df.unionByName(spark.createDataFrame([("a", "gone", 1)] * 6000 + [("d", "gone", 1)] * 10, MARKS))
    assert {tuple(r) for r in heavy.heavy_keys(df, heavy.sketch(wider), 5).collect()} == top(rows, 5)


def test_sketches_of_batches_add_up(spark):
    df = spark.createDataFrame(skewed(), MARKS)
    path = staging_path(spark, "sketches")
    for k in (0, 1, 1, 2):
        heavy.store_sketch(path, f"day/{k}", df.filter(F.col("pos") % 3 == k))
    whole = sorted(map(tuple, heavy.sketch(df).collect()))
    assert sorted(map(tuple, heavy.stored_sketch(spark, path).collect())) == whole


def test_second_pass_shuffles_candidates_alone(spark):
    df = materialize(spark.createDataFrame(skewed(), MARKS), "marks")
    sizes = materialize(heavy.sketch(df), "sizes")
    least = materialize(heavy.surely_reached(df, sizes, 5), "least")
    few = heavy.candidates(df, sizes, least)
    wanted = {(t, key) for t, key, *_ in top(skewed(), 5)}
    kept = {tuple(r) for r in few.distinct().collect()}
    assert wanted <= kept and len(kept) < 120
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan.split("BroadcastExchange")[0] and "Exchange hashpartitioning(key" not in plan


def test_nothing_and_too_much(spark):
    none = spark.createDataFrame([], MARKS)
    assert heavy.heavy_keys(none, heavy.sketch(none), 3).collect() == []
    one = spark.createDataFrame([("a", "x", 1)], MARKS)
    with pytest.raises(ValueError):
        heavy.heavy_keys(one, heavy.sketch(one), 0)
    many = spark.createDataFrame([(f"t{k}", "x", 1) for k in range(heavy.MOST_TYPES + 1)], MARKS)
    with pytest.raises(ValueError):
        heavy.heavy_keys(many, heavy.sketch(many), 1)


TERMS = "rule int, category string, term string, anchor string"


def words(text):
    return re.findall(r"\w+", (text or "").lower())


def by_loop(texts, terms):
    out = {}
    for key, text in texts:
        said = words(text)
        for rule, category, term, _ in terms:
            w = words(term)
            if rule is not None and w and any(said[k : k + len(w)] == w for k in range(len(said))):
                found = (rule, category, term)
                out[key] = min(out.get(key, found), found)
    return out


def test_category_terms(spark):
    rng = random.Random(8)
    vocab = ["bar", "staff", "Night", "shift", "CHEF", "é", "de", "la", "x1", "a_b"]
    texts = [(k, rng.choice([" ", "-", ", "]).join(rng.choices(vocab, k=rng.randint(0, 7)))) for k in range(400)]
    texts += [(1000, None), (1001, ""), (1002, "barstaff"), (1003, "bar\nstaff!"), (1004, "the bar the bar"), (1004, "chef")]
    texts += [(k, "bar staff") for k in range(2000, 2300)]
    terms = [(rng.randint(1, 30), f"c{k % 4}", " ".join(rng.choices(vocab, k=rng.randint(1, 4))), "clash") for k in range(60)]
    terms += [(2, "d", "Bar  STAFF", None), (2, "c", "bar-staff", None), (0, "never", "unheard of", None)]
    terms += [(0, "no word", "!!", None), (0, "null", None, None), (None, "no rule", "bar", None), (0, "empty", "", None)]
    rows = spark.createDataFrame([(*t, "clash", 1) for t in texts], "ad long, title string, phrase string, rule int")
    table = spark.createDataFrame(terms, TERMS)
    got = {r.ad: (r["rule"], r.category, r.term) for r in category_terms(rows, table, "ad", "title").collect()}
    assert got == by_loop(texts, terms) and 1002 not in got
    assert category_terms(rows.limit(0), table, "ad", "title").collect() == []
    assert category_terms(rows, table.limit(0), "ad", "title").collect() == []


def test_terms_are_filed_under_their_rarest_word(spark):
    texts = spark.createDataFrame([("bar staff",), ("bar",), ("bar",), ("staff",), ("rare bar",)], "title string")
    terms = spark.createDataFrame([(1, "c", "bar staff", None), (2, "c", "rare staff", None), (3, "c", "bar unheard", None)], TERMS)
    index = {r.phrase: r.anchor for r in term_index(texts, phrases(terms), "title").collect()}
    assert index == {" bar staff ": "staff", " rare staff ": "rare"}


def test_null_keys_are_one(spark):
    rows = spark.createDataFrame([(None, "bar"), (None, "chef")], "ad long, title string")
    terms = spark.createDataFrame([(2, "x", "bar", None), (1, "y", "chef", None)], TERMS)
    assert [tuple(r) for r in category_terms(rows, terms, "ad", "title").collect()] == [(None, 1, "y", "chef")]
