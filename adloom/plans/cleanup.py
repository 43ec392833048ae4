"""Removing error records from a stored table."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adloom.operators import duplicates as dup
from adloom.operators.validity import is_no_error
from adloom.session import observed
from adloom.sources import files
from adloom.sources.ads import WRITING, read_csv_whole


@dataclass(frozen=True)
class Cleaned:
    total: int
    removed: int
    remaining: int
    backup: str | None
    excess: dict[str, int] | None = None


def check_duplicates(ads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Excess per criterion and a preview, error records included, full records not compared."""
    marked = dup.marks(ads, dup.DECISIVE, exclude_errors=False)
    return dup.summary(marked, dup.DECISIVE), dup.preview_second(marked)


def _read(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """The table at `path`; files whose headers or records do not fit each other stop the job before anything is written."""
    if fmt != "csv":
        return spark.read.format(fmt).load(path)
    return read_csv_whole(spark, path)


def clean_errors(
    spark: SparkSession,
    path: str,
    fmt: str = "csv",
    backup: bool = True,
    now: datetime | None = None,
    check: bool = False,
) -> Cleaned | None:
    """Rewrite the table at `path` without error records; None if there is no table.

    A table without error records is left alone. Records are counted while the new table is written. It is written beside the old one and takes its place by
    renaming; the old one becomes the backup. If the second renaming fails, the old table gets its place back. A record
    with more or fewer fields than the header, or files with unlike headers, fail the job and leave the table as it is.
    With `check`, the result also has the excess per criterion before cleaning, error records included.
    """
    if not files.exists(spark, path):
        return None
    table = _read(spark, path, fmt)
    found = None
    if check:
        numbered = table.withColumn("pos", F.monotonically_increasing_id())
        found = {r["type"]: r["excess"] for r in check_duplicates(numbered)[0].collect()}
    if table.filter(~is_no_error()).isEmpty():  # ends with the first one found
        total = table.count()
        return Cleaned(total, 0, total, None, found)
    kept = f"{path}.backup_{(now or datetime.now()):%Y%m%d_%H%M%S}"
    if files.exists(spark, kept):
        raise FileExistsError(f"there is a backup at {kept} already")
    fresh = f"{path}.staging_{uuid.uuid4().hex}"
    rows, seen = observed(table, total=F.count("*"), errors=F.count_if(~is_no_error()))
    writer = rows.filter(is_no_error()).write
    if fmt == "csv":
        writer.options(**WRITING).csv(fresh)
    else:
        writer.format(fmt).save(fresh)
    total, errors = seen.get["total"], seen.get["errors"]
    files.rename(spark, path, kept)
    try:
        files.rename(spark, fresh, path)
    except BaseException:
        files.rename(spark, kept, path)
        raise
    if not backup:
        files.delete(spark, kept)
    return Cleaned(total, errors, total - errors, kept if backup else None, found)
