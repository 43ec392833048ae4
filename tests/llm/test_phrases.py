"""Collocations against plain counting, and the trie against a table."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from adloom.llm import phrases
from adloom.llm.phrases import Filter, HatTrie, Words, _place, collocations, filter_of, phrase_counts, split


def words_of(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", piece) for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower)]


def brute(rows, longest=3, least=10, best=2000):
    f, total = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for ws in words_of(text):
            total[lang] += len(ws)
            for k in range(1, 4):
                f.update((lang, *ws[i : i + k]) for i in range(len(ws) - k + 1))
    cand = {p: a for p, a in f.items() if 2 < len(p) <= longest + 1 and a >= least}
    out = []
    for lang in total:
        mine = []
        for p, a in cand.items():
            if p[0] != lang:
                continue
            inside = any(
                len(q) > len(p) and q[0] == lang and 100 * b >= 50 * a
                and any(q[i : i + len(p) - 1] == p[1:] for i in range(1, len(q) - len(p) + 2))
                for q, b in cand.items()
            )
            if inside:
                continue
            cuts = [(10**6 * a * a // (f[p[:k]] * f[(lang, *p[k:])]), k) for k in range(2, len(p))]
            score, k = min(cuts)
            mine.append((-score, -a, " ".join(p[1:]).encode(), f[p[:k]], f[(lang, *p[k:])]))
        for rank, (s, a, phrase, left, right) in enumerate(sorted(mine)[:best], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -s))
    return sorted(out)


def found(spark, rows, **options):
    df = spark.createDataFrame([(i, t, k, "src", 1, 2, "p", "w") for i, t, k in rows],
                               "doc_id long, text string, lang string, source string, n long, a long, phrase string, w1 string")
    return sorted(tuple(r) for r in collocations(df.repartition(3), **options).collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    common = ["the", "The", "of", "a", "naïve", "ÉTÉ", "été", "中文", "x\x00y", "I am", "new", "york", "city", "🙂"]
    out = []
    for k in range(160):
        words = []
        for _ in range(rng.randint(0, 60)):
            words.append(rng.choice(common) if rng.random() < 0.9 else f"rare{rng.randrange(400)}")
            if rng.random() < 0.2:
                words += ["New", "York", "City"]
            if rng.random() < 0.1:
                words[-1] += rng.choice([".", ", ", "\n", "!?", "\x0b", "\r\n", " ;", "\t", "  "])
        out.append((k, " ".join(words), rng.choice(["en", "en", "en", "de", None, ""])))
    odd = [(None, None, None), (1, "", "fr"), (2, " \t . ", "fr"), (3, "a a a a a a a a a a a a a", "fr"), (4, "b", "und"),
           (4, "word " * 3000, "en"), (4, "x" * 50_000, "en"), (5, "same same. " * 40, "en")]
    return out + odd + out[:20]


def test_equals_plain_counting(spark, rows):
    want = brute(rows)
    assert found(spark, rows) == want and len(want) > 50


def test_spills_bursts_and_long_texts_change_nothing(spark, rows, monkeypatch):
    """The task side run here with tiny bounds: every subtree is spilled again and again."""
    for name, value in {"CAPACITY": 40, "BURST": 8, "WORDS": 25, "WORDS_AT_ONCE": 30, "BYTES_AT_ONCE": 64}.items():
        monkeypatch.setattr(phrases, name, value)
    import pyarrow as pa

    class Plain:
        def mapInArrow(self, run, schema):
            text = pa.array([(t or "").encode() for _, t, _ in rows], pa.binary())
            lang = pa.array(["und" if k is None else k for *_, k in rows], pa.string())
            return list(run(iter([pa.RecordBatch.from_arrays([lang, text], names=["lang", "text"])])))

    for depth in (1, 2, 3):
        got, runs = Counter(), phrases.counted(Plain(), depth)
        for run in runs:
            lines = [(*r["key"].split(" ", depth), r["n"]) for r in run.to_pylist()]
            if lines[0][0]:
                order = [[w.encode() for w in line[:depth]] for line in lines]
                assert order == sorted(order) and len({line[depth] for line in lines}) == 1
            for *key, n in lines:
                got[tuple(key)] += n
        want = Counter()
        for _, text, lang in rows:
            for ws in words_of(text):
                if depth == 1 and ws:
                    want["", "und" if lang is None else lang] += len(ws)
                for i in range(len(ws) - depth + 1):
                    want[*ws[i : i + depth], "und" if lang is None else lang] += 1
        assert {k: v for k, v in got.items() if v} == dict(want) and len(runs) > 20


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_trie(depth, monkeypatch):
    monkeypatch.setattr(phrases, "BURST", 50)
    rng = np.random.default_rng(depth)
    trie, want, got = HatTrie(depth), Counter(), Counter()
    for step in range(30):
        ids = rng.zipf(1.3, (400, depth)) % 300 + 1
        keys = np.zeros(400, np.int64)
        for k in range(depth):
            keys = keys << phrases.ID_BITS | ids[:, k]
        trie.add(keys)
        want.update(keys.tolist())
        if step % 7 == 6:
            for run, counts in trie.spill(trie.size // 2):
                got.update(dict(zip(run.tolist(), counts.tolist())))
    assert trie.size == trie.root.size() and (depth == 1 or trie.root.children)
    for run, counts in trie.spill(0):
        got.update(dict(zip(run.tolist(), counts.tolist())))
    assert got == want and trie.size == 0


def test_filter_keeps_all_and_little_else(spark):
    df = spark.createDataFrame([(f"l{k % 3}", f"w{k}", f"é{k * 7}") for k in range(3000)], "lang string, w1 string, w2 string")
    keep, ids = filter_of(df, ["w1", "w2"]), Words()
    first = ids([f"w{k}".encode() for k in range(6000)])
    second = ids([f"é{k * 7}".encode() for k in range(6000)])
    hits = np.zeros(6000, bool)
    for lang in range(3):
        mine = np.arange(6000) % 3 == lang
        hits[mine] = keep(_place(f"l{lang}", ids.hashes[first[mine]], ids.hashes[second[mine]]))
    assert hits[:3000].all() and hits[3000:].mean() < 0.15


def test_runs_are_shuffled_once(spark):
    runs = spark.createDataFrame([("a b en", 3)], phrases.COUNTED)
    plan = phrases.merged(runs, 2, 1)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    lang = spark.createDataFrame([("a b x  y ", 3), ("a b ", 1)], phrases.COUNTED)
    assert sorted(map(tuple, phrases.merged(lang, 2, 1).collect())) == [("", "a", "b", 1), ("x  y ", "a", "b", 3)]


def test_split():
    assert list(split("A b.C\td\n".encode())) == [[b"a", b"b", b"\xff", b"c", b"d", b"\xff", b"\xff"]]
    assert list(split(b"")) == [] and Filter(15, [])(np.zeros(2, np.uint64)).tolist() == [False, False]


def test_large_counts_are_exact(spark):
    a, left, right = 3_037_000_499_123, 3_037_000_499_777, 3_037_000_499_124
    df = spark.createDataFrame([(a, left, right)], "a long, l long, r long")
    assert df.select(phrases._score("a", "l", "r")).first()[0] == 10**6 * a * a // (left * right)


def test_nothing_pairs_only_and_few(spark, rows):
    assert found(spark, []) == [] and found(spark, [(1, "a b", None)]) == []
    assert found(spark, rows, longest=2, best=7) == brute(rows, longest=2, best=7)
    assert [t.count() for t in phrase_counts(spark.createDataFrame([("a b c", "en")], "text string, lang string"), least=1)] == [4, 2, 1]
