"""The queries that stage tables, on a cluster whose shared folder is a mount."""

import os
import sys
from datetime import datetime, timedelta

import pytest

duckdb = pytest.importorskip("duckdb")

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as contract  # noqa: E402

from adloom.session import shared_dir  # noqa: E402

STAGING = [
    "budget_cut", "budget_cut_by_source", "budget_cut_by_time", "budget_cut_by_user_time", "budget_cut_pages",
    "category_terms", "clean_backup", "clean_errors", "crawl_prefix", "crawl_prefix_capped", "crawl_progress",
    "crawl_summary", "dup_summary_incremental", "heavy_keys", "incremental_append", "incremental_by_id",
    "incremental_by_title", "ingest_run", "ingest_run_target", "ingest_run_totals", "key_counts_incremental",
    "key_set_new_titles", "key_sets", "missing_input",
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A few documents with copies, events and parts."""
    at = str(tmp_path_factory.mktemp("tables"))
    start = datetime(2024, 1, 1)
    tables = {
        "documents": (
            [(k, f"title {k % 40}\nthe text of ad {k % 50}", "en", f"src{k % 7}", 20) for k in range(120)],
            "doc_id bigint, text string, lang string, source string, n_chars bigint",
        ),
        "events": (
            [
                (k, start + timedelta(minutes=(k * 37) % 90), k % 9, ("view", "click", "error")[k * k % 7 % 3])
                for k in range(150)
            ],
            "event_id bigint, ts timestamp, user_id bigint, event_type string",
        ),
        "part": (
            [(k, f"large brass {k % 13} case", f"Brand#{k % 5}", f"TYPE {k % 4}", k % 50 + 1) for k in range(90)],
            "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int",
        ),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{at}/{name}.parquet")
    return at


@pytest.fixture
def cluster(spark, monkeypatch):
    """The session with the name of a cluster; its checkpoint folder is one of the machine."""
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    return spark


def shown(row):
    return tuple(repr(v) if isinstance(v, float) else str(v) for v in row)


@pytest.mark.parametrize("name", STAGING)
def test_query_equals_its_sql_on_a_cluster(cluster, folder, name):
    con = duckdb.connect()
    for table in ("documents", "events", "part"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    df = contract.queries()[name](cluster, folder)
    result = con.execute(contract.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    got = sorted(shown(r) for r in df.select(*columns).collect())
    assert got == sorted(shown(r) for r in result.fetchall()) != []


def test_a_shared_folder_is_tried_once(cluster, monkeypatch):
    folder = cluster.conf.get("spark.checkpoint.dir")
    assert shared_dir(cluster) == folder
    monkeypatch.setattr(type(cluster), "range", None)
    assert shared_dir(cluster) == folder
    assert not [x for x in os.listdir(folder) if x.startswith("trial-")]


def test_a_folder_that_cannot_be_written_is_refused(cluster, monkeypatch, tmp_path):
    (tmp_path / "file").write_text("x")
    at = f"file://{tmp_path}/file/below"
    monkeypatch.setattr(type(cluster.conf), "get", lambda self, key, default=None: at)
    with pytest.raises(ValueError, match="below is none"):
        shared_dir(cluster)
