"""Validity, duplicates, previews and verdicts."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from adloom.operators import duplicates as dup
from adloom.operators import validity as v
from adloom.plans.uniqueness import analyze, write_report

ERR = "403 ERROR"


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def brute(ads, criteria=dup.CRITERIA, exclude_errors=True):
    """Positions of every key, record by record."""
    found = defaultdict(list)
    for r in sorted(ads.collect(), key=lambda r: r["pos"]):
        f = {k: (x or "").strip() for k, x in r.asDict().items() if k != "pos"}
        if exclude_errors and f["title"] == ERR:
            continue
        keys = {dup.ID: f["id"], dup.URL: f["url"], dup.FULL_CONTENT: "|".join(f.values())}
        if f["title"] and f["company"]:
            keys[dup.TITLE_COMPANY] = f"{f['title']}|{f['company']}"
        for t in criteria:
            if keys.get(t) or t == dup.FULL_CONTENT:
                found[t, keys[t]].append(r["pos"])
    return {k: p for k, p in found.items() if len(p) > 1}


def random_ads(make_ads, n=400, seed=7):
    rnd = random.Random(seed)
    return make_ads(
        [
            {
                "id": rnd.choice(["", " a ", "a", "hot", "hot", "hot", f"i{i}"]),
                "url": rnd.choice(["u", f"u{i}", f"u{i // 2}"]),
                "title": rnd.choice(["x", "y ", ERR, f" {ERR} ", "", f"t{i // 3}"]),
                "company": rnd.choice(["", "c", " c\t"]),
            }
            for i in range(n)
        ]
    )


def test_two_validity_tests_differ(make_ads):
    ads = make_ads([{"title": t} for t in [ERR, f" {ERR} ", "", "  ", "job"]])
    assert rows(v.stored_ads(ads), "pos") == [(3,), (5,), (6,)]
    assert rows(v.without_errors(ads), "pos") == [(4,), (5,), (6,)]
    assert v.stored_count(ads).first()["n"] == 3
    assert tuple(v.quality_counts(ads).first()) == (5, 3, 2)


def test_report_of_two_pairs(make_ads):
    """455 records with the pairs at 221/242 and 274/456, companies blank on them."""
    pairs = {221: "shop", 242: "shop", 274: "burger", 456: "burger"}
    ads = make_ads(
        [
            {
                "id": pairs.get(p, f"id{p}"),
                "url": f"https://ads.example.com/{pairs.get(p, f'id{p}')}.html",
                "title": f"title {p}",
                "company": "" if p in pairs else f"c{p}",
                "description": f"text {p}",
            }
            for p in range(2, 457)
        ]
    )
    got = [tuple(r) for r in dup.report(dup.in_report_order(analyze(ads).duplicates)).collect()]
    assert got == [
        ("ID", "shop", "221,242", 2, 0),
        ("ID", "burger", "274,456", 2, 0),
        ("URL", "https://ads.example.com/shop.html", "221,242", 2, 0),
        ("URL", "https://ads.example.com/burger.html", "274,456", 2, 0),
    ]


def test_duplicates_match_brute_force(make_ads):
    ads = random_ads(make_ads)
    want = brute(ads)
    got = dup.duplicates(dup.marks(ads)).collect()
    assert len(got) == len(want)
    assert sorted((r["type"], tuple(r["positions"]), r["n"]) for r in got) == sorted(
        (t, tuple(p), len(p)) for (t, _), p in want.items()
    )
    raw = brute(ads, dup.DECISIVE, exclude_errors=False)
    summed = dup.summary(dup.marks(ads, dup.DECISIVE, exclude_errors=False), dup.DECISIVE)
    assert {r["type"]: (r["duplicated_keys"], r["excess"]) for r in summed.collect()} == {
        t: (sum(k[0] == t for k in raw), sum(len(p) - 1 for k, p in raw.items() if k[0] == t)) for t in dup.DECISIVE
    }


def test_hot_key_goes_on_over_several_parts(make_ads):
    ads = random_ads(make_ads)
    marked = dup.marks(ads)
    whole = {(r["type"], r["key"]): r["positions"] for r in dup.duplicates(marked).collect()}
    found = dup.duplicates(marked, positions_per_part=32)
    parts = defaultdict(list)
    for r in found.orderBy("part").collect():
        assert len(r["positions"]) < 64 and r["n"] == len(whole[r["type"], r["key"]])
        assert r["part"] == 0 or r["n"] > 32
        parts[r["type"], r["key"]] += r["positions"]
    assert parts == whole
    assert dup.report(found).agg(F.sum("Count")).first()[0] == sum(map(len, whole.values()))
    sizes = defaultdict(int)
    for r in dup.preview_first(found, limit=3).collect():
        sizes[r["type"], r["rank"]] += len(r["row_positions"].split(", "))
        assert r["rank"] <= 3
    firsts = sorted((p[0], t, len(p)) for (t, _), p in whole.items() if t != dup.FULL_CONTENT)
    for t in dup.DECISIVE:
        lengths = [n for _, kind, n in firsts if kind == t][:3]
        assert [sizes[t, i + 1] for i in range(len(lengths))] == lengths


def test_records_without_position_are_refused(spark, make_ads):
    ads = make_ads([{"id": "a"}, {"id": "a"}]).withColumn("pos", F.when(F.col("pos") > 2, F.col("pos")))
    marked = dup.marks(ads, [dup.ID])
    for df in (dup.summary(marked, [dup.ID]), dup.report(dup.duplicates(marked)), dup.key_counts(marked)):
        with pytest.raises(Exception, match="without position"):
            df.collect()


def test_error_records_take_a_position_but_are_not_compared(make_ads):
    ads = make_ads([{"id": "a", "title": ERR}, {"id": "a", "title": "t"}, {"id": "a", "title": "u"}])
    found = dup.duplicates(dup.marks(ads, [dup.ID]))
    assert rows(found, "key", "positions") == [("a", [3, 4])]
    raw = dup.duplicates(dup.marks(ads, [dup.ID], exclude_errors=False))
    assert rows(raw, "key", "positions") == [("a", [2, 3, 4])]


def test_preview_orders_differ(make_ads):
    """a is first to appear, b first to appear again."""
    ads = make_ads([{"id": i, "url": f"u{n}"} for n, i in enumerate("abba")])
    marked = dup.marks(ads, [dup.ID])
    assert [r["shown"] for r in dup.preview_first(dup.duplicates(marked)).orderBy("rank").collect()] == ["a", "b"]
    assert [r["key"] for r in dup.preview_second(marked).orderBy("rank").collect()] == ["b", "a"]


def test_more_than_shown(make_ads):
    ads = make_ads([{"id": f"i{n % 8}", "url": f"u{n % 8}"} for n in range(16)])
    got = dup.preview_second(dup.marks(ads, dup.DECISIVE, exclude_errors=False)).collect()
    assert {(r["type"], r["more"]) for r in got} == {(dup.ID, 3), (dup.URL, 5)}
    assert sum(r["type"] == dup.ID for r in got) == 5 and sum(r["type"] == dup.URL for r in got) == 3


def test_joined_keys_collide_unless_exact(make_ads):
    ads = make_ads([{"id": "1", "title": "a|b", "company": "c"}, {"id": "2", "title": "a", "company": "b|c"}])
    found = dup.duplicates(dup.marks(ads, [dup.TITLE_COMPANY]))
    assert rows(found, "key") == [("a|b|c",)]
    shown = dup.preview_first(dup.duplicates(dup.marks(ads, [dup.TITLE_COMPANY]))).first()
    assert (shown["shown"], shown["company"]) == ("a", "b|c")
    assert dup.duplicates(dup.marks(ads, [dup.TITLE_COMPANY], exact_keys=True)).count() == 0
    tricky = make_ads([{"title": "a\\", "company": "b|c"}, {"title": "a|b", "company": "c"}])
    assert dup.duplicates(dup.marks(tricky, [dup.TITLE_COMPANY], exact_keys=True)).count() == 0


def test_full_content_counts_apart(make_ads, tmp_path):
    ads = make_ads([{"title": "t"}, {"title": "t"}])
    a = analyze(ads)
    assert rows(a.verdict, "type", "verdict") == [
        ("Full_Content", "WARNING"), ("ID", "OK"), ("Overall", "OK"), ("Title+Company", "OK"), ("URL", "OK"),
    ]
    assert a.report.first()["Value"].endswith("...")
    assert not write_report(a, str(tmp_path / "none"))
    ads = make_ads([{"id": "x", "title": "t"}, {"id": "x", "title": "u"}])
    out = str(tmp_path / "report")
    assert write_report(analyze(ads), out)
    again = ads.sparkSession.read.csv(out, header=True)
    assert [tuple(r) for r in again.collect()] == [("ID", "x", "2,3", "2", "0")]


def test_full_content_takes_all_columns(spark, make_ads):
    ads = make_ads([{"id": "1"}, {"id": "1"}])
    more = ads.selectExpr("*", "cast(pos as string) as extra")
    assert dup.duplicates(dup.marks(ads, [dup.FULL_CONTENT])).count() == 1
    assert dup.duplicates(dup.marks(more, [dup.FULL_CONTENT])).count() == 0


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_result_does_not_depend_on_partitions(make_ads, parts):
    ads = random_ads(make_ads).repartition(parts)
    want = brute(ads)
    summed = dup.summary(dup.marks(ads))
    for r in summed.collect():
        own = [p for (t, _), p in want.items() if t == r["type"]]
        assert (r["duplicated_keys"], r["excess"]) == (len(own), sum(len(p) - 1 for p in own))
