"""Duplicates kept up to date: counts of keys in buckets, changed by what a batch adds or removes.

The state is a folder. `counts/version=N` has (type, key, n) by `_bucket`, rows of the buckets that batch N touched.
`manifest/N`, written last, tells for each bucket and criterion which version counts and how many keys are duplicated
there, and names all batches so far; the one with the greatest N is the state. A batch reads and writes its own
buckets only. One that stops halfway leaves no manifest and is run again; one that is known changes nothing. One writer at a
time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adloom.operators import duplicates as dup
from adloom.session import materialize
from adloom.sources.files import children, delete, exists

MANIFEST = "bucket int, version long, type string, keys long, duplicated_keys long, excess long, batch string"


def _latest(spark: SparkSession, path: str) -> tuple[int, DataFrame]:
    """Number and rows of the last manifest that was written in full."""
    done = [int(n) for n in children(spark, f"{path}/manifest") if exists(spark, f"{path}/manifest/{n}/_SUCCESS")]
    if not done:
        return 0, spark.createDataFrame([], MANIFEST)
    return max(done), spark.read.schema(MANIFEST).parquet(f"{path}/manifest/{max(done)}")


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("type", "key"), F.lit(buckets)).cast("int")


def _deltas(added: DataFrame | None, removed: DataFrame | None) -> DataFrame:
    signed = [m.select("type", "key", F.lit(s).cast("long").alias("n")) for m, s in ((added, 1), (removed, -1)) if m is not None]
    whole = signed[0] if len(signed) == 1 else signed[0].unionByName(signed[1])
    return whole.groupBy("type", "key").agg(F.sum("n").alias("n")).filter("n <> 0")


def apply_batch(
    spark: SparkSession,
    path: str,
    batch: str,
    added: DataFrame | None = None,
    removed: DataFrame | None = None,
    buckets: int = 64,
) -> bool:
    """Count a batch of marks (`duplicates.marks`) in or out; False if the state has seen the batch before.

    A key that would be left with fewer than no records stops the job, and the state stays as it was. `buckets` counts for
    the first batch only, later ones take those of the state.
    """
    if added is None and removed is None:
        raise ValueError("a batch adds or removes something")
    number, manifest = _latest(spark, path)
    if manifest.filter(F.col("batch") == batch).limit(1).count():
        return False
    places = manifest.filter("bucket IS NOT NULL")
    if number:
        buckets = manifest.filter("bucket IS NULL AND type = 'buckets'").first()["keys"]
    deltas = materialize(_deltas(added, removed).withColumn("_bucket", _bucket(buckets)), "deltas")
    touched = [r[0] for r in deltas.select("_bucket").distinct().collect()]  # at most as many as there are buckets
    old = _counts(spark, path, places.filter(F.col("bucket").isin(touched)))
    n = F.when(F.sum("n") < 0, F.raise_error(F.lit("a batch removes records that are not there"))).otherwise(F.sum("n"))
    counts = old.unionByName(deltas).groupBy("_bucket", "type", "key").agg(n.cast("long").alias("n")).filter("n <> 0")
    target = f"{path}/counts/version={number + 1}"
    counts.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(target)

    written = spark.read.schema("type string, key string, n long, _bucket int").parquet(target)
    sums = written.groupBy(F.col("_bucket").alias("bucket"), "type").agg(
        F.count("*").alias("keys"), F.count_if(F.col("n") > 1).alias("duplicated_keys"), F.sum(F.col("n") - 1).alias("excess")
    )
    none = F.lit(None)
    ledger = manifest.filter("bucket IS NULL AND type = 'batch'")
    news = [(None, None, "batch", None, None, None, batch)]
    news += [] if number else [(None, None, "buckets", buckets, None, None, None)]
    rows = places.filter(~F.col("bucket").isin(touched)).unionByName(
        sums.select("bucket", F.lit(number + 1).cast("long").alias("version"), "type", "keys", "duplicated_keys", "excess",
                    none.cast("string").alias("batch"))
    )
    rows = rows.unionByName(ledger).unionByName(manifest.filter("bucket IS NULL AND type = 'buckets'"))
    rows = rows.unionByName(spark.createDataFrame(news, MANIFEST))
    rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/{number + 1}")
    return True


def _counts(spark: SparkSession, path: str, places: DataFrame) -> DataFrame:
    """Stored counts of the given buckets, each from the version that counts."""
    schema = "_bucket int, type string, key string, n long"
    by_version: dict[int, list[int]] = {}
    for r in places.select("bucket", "version").distinct().collect():  # at most as many as there are buckets
        by_version.setdefault(r["version"], []).append(r["bucket"])
    folders = [f"{path}/counts/version={v}/_bucket={b}" for v, bs in by_version.items() for b in bs]
    if not folders:
        return spark.createDataFrame([], schema)
    found = spark.read.schema("type string, key string, n long, _bucket int, version long")
    return found.option("basePath", f"{path}/counts").parquet(*folders).select("_bucket", "type", "key", "n")


def counts(spark: SparkSession, path: str) -> DataFrame:
    """All keys and how many records have each: type, key, n."""
    return _counts(spark, path, _latest(spark, path)[1].filter("bucket IS NOT NULL")).select("type", "key", "n")


def summary(spark: SparkSession, path: str, criteria: Sequence[str] = dup.CRITERIA) -> DataFrame:
    """Duplicated keys and excess records by criterion, as `duplicates.summary` has them, from the manifest alone."""
    known = _latest(spark, path)[1].filter("bucket IS NOT NULL")
    per_type = known.groupBy("type").agg(F.sum("duplicated_keys").alias("duplicated_keys"), F.sum("excess").alias("excess"))
    every = spark.createDataFrame([(c,) for c in criteria], "type string")
    zero = F.lit(0).cast("long")
    return every.join(per_type, "type", "left").select(
        "type", F.coalesce("duplicated_keys", zero).alias("duplicated_keys"), F.coalesce("excess", zero).alias("excess")
    )


def clean_up(spark: SparkSession, path: str) -> None:
    """Delete counts and manifests that the state no longer points to; only when nobody reads an older state."""
    number, manifest = _latest(spark, path)
    wanted = {f"version={r[0]}" for r in manifest.filter("version IS NOT NULL").select("version").distinct().collect()}
    for name in children(spark, f"{path}/counts"):
        if name not in wanted:
            delete(spark, f"{path}/counts/{name}")
    for name in children(spark, f"{path}/manifest"):
        if name != str(number):
            delete(spark, f"{path}/manifest/{name}")
