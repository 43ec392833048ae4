import sys
from collections import Counter
from pathlib import Path

import pytest
import xxhash

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from adloom.llm.packing import pieces  # noqa: E402
from adloom.llm.quality import measure  # noqa: E402

from .test_copies_and_passages import linked, passages, slow_fingerprint  # noqa: E402
from .test_quality_and_secrets import SECRETS, spans_of  # noqa: E402

ITEMS = [(1, " ".join(f"word{k}" for k in range(20)) + "."), (2, None)]


@pytest.fixture
def folder(spark, texts, tmp_path):
    long = " ".join(f"w{k}" for k in range(80)) + "."
    more = [f"{long} {ITEMS[0][1]}", *[f"{t} {k} {long}" for k, t in enumerate(SECRETS[:4])], f"{long}\nMenu | Home | News"]
    rows = [(k, t, "en", f"src{k % 3}", len(t or "")) for k, t in enumerate([*texts, *more])]
    again = [rows[0], (None, long[::-1], None, None, None), (None, long[::-1], "de", None, None), (None, rows[1][1], None, None, None),
             (4, rows[2][1], None, "s", 1), (4, rows[6][1] + " " + long, None, "s", 1)]
    docs = spark.createDataFrame([*rows, *again], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def slow(rows):
    """The texts that reach packing, by doc_id."""
    kept = {(i, measure(t)[9]) for i, t in rows if measure(t)[6]}
    prints = {t: slow_fingerprint(t) for _, t in kept}
    root = linked(sorted(set(prints.values())), lambda a, b: (a ^ b).bit_count() <= 4)
    first = {}
    for i, t in kept:
        row = (i is None, i or 0, xxhash.xxh64_intdigest(t.encode(), 42) + (1 << 63) & (1 << 64) - 1, i, t)
        first[root[prints[t]]] = min(row, first.get(root[prints[t]], row))
    kept = {row[3:] for row in first.values()}
    kept = {(i, t) for i, t in kept if not passages(t, ITEMS[:1])[0]}
    out = []
    for i, t in kept:
        made, at = "", 0
        for a, _, b, _ in spans_of(t):
            if a >= at:
                made += t[at:a] + "[secret]"
            at = max(at, b)
        out.append((i, made + t[at:]))
    return out


def test_pipeline_equals_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = slow([(r.doc_id, r.text) for r in docs.collect()])
    got = corpus_pipeline.run(spark, folder)
    cut = pieces(spark.createDataFrame(want, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got.collect()) == Counter(map(tuple, cut))
    assert 0 < len(want) < docs.count()


def test_stages_return_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", "1 as _quality", "2 as _secrets0")
    assert [name for name, _ in corpus_pipeline.STAGES][-1] == "packing"
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns
        assert stage(spark, docs.limit(0), folder).collect() == []
    assert corpus_pipeline.ORACLE_SQL is None
