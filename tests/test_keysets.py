"""Sets of keys as bitmaps against plain sets."""

import random

import pytest

from adloom.operators import keysets as ks

KEYS = "k string, num string"


def table(spark, keys):
    return spark.createDataFrame([(k, "other") for k in keys], KEYS)


def told(keys, numbers):
    return {r.k for r in ks.members(keys, numbers, "k").collect()}


def test_sets_equal_plain_ones(spark):
    rng = random.Random(3)
    a = [f"k{rng.randrange(700)}" for _ in range(500)] + ["hot"] * 400 + [None, ""]
    b = [f"k{rng.randrange(900)}" for _ in range(300)] + ["hot", "hot", None]
    ta, tb = table(spark, a), table(spark, b)
    first = ks.numbered(ta, "k", range_rows=50).cache()
    numbers = ks.extended(first, tb, "k", range_rows=50).cache()
    pa, pb = set(a) - {None}, set(b) - {None}
    assert sorted(r.num for r in numbers.collect()) == list(range(len(pa | pb)))
    assert set(first.collect()) <= set(numbers.collect())
    sa, sb = ks.key_set(ta, "k", first), ks.key_set(tb, "k", numbers)
    assert told(sa, numbers) == pa and told(sb, numbers) == pb
    assert told(ks.union(sa, sb, sa), numbers) == pa | pb
    assert told(ks.intersection(sa, sb), numbers) == pa & pb
    assert told(ks.difference(sa, sb), numbers) == pa - pb
    assert told(ks.difference(sb, sa), numbers) == pb - pa
    assert tuple(ks.sizes(sa, sb).first()) == (len(pa | pb), len(pa & pb), len(pa - pb), len(pb - pa))
    assert ks.size(sb).first().n == len(pb)
    assert sa.count() <= len(pa) // 64 + 1


def test_every_bit_of_a_word(spark):
    """The sign bit is a key like any other."""
    keys = [f"{k:03}" for k in range(130)]
    numbers = ks.numbered(table(spark, keys), "k").cache()
    whole = ks.key_set(table(spark, keys), "k", numbers)
    for k in (0, 62, 63, 64, 127, 129):
        one = ks.key_set(table(spark, [keys[k]]), "k", numbers)
        assert told(one, numbers) == {keys[k]} and told(ks.difference(whole, one), numbers) == set(keys) - {keys[k]}


def test_empty_sets_and_unknown_keys(spark):
    none, some = table(spark, []), table(spark, ["a", "b"])
    numbers = ks.extended(ks.numbered(none, "k"), some, "k")
    empty, full = ks.key_set(none, "k", numbers), ks.key_set(some, "k", numbers)
    assert tuple(ks.sizes(empty, full).first()) == (2, 0, 0, 2) and tuple(ks.sizes(empty, empty).first()) == (0, 0, 0, 0)
    assert told(ks.difference(full, empty), numbers) == {"a", "b"} and ks.size(empty).first().n == 0
    with pytest.raises(Exception, match="no number for key c"):
        ks.key_set(table(spark, ["a", "c"]), "k", numbers).collect()
