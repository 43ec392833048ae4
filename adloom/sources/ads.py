"""Ad tables as CSV or Parquet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adloom.operators.shape import align
from adloom.schema import ADS_COLUMNS, ADS_SCHEMA, BAD_RECORD, FIRST_POSITION
from adloom.sources.files import exists, is_folder

# RFC-style quoting: quotes are doubled and fields may span lines.
QUOTING = {"quote": '"', "escape": '"', "multiLine": "true"}

# Empty text stays bare and blanks around a value are kept.
WRITING = {
    "header": "true",
    "escape": '"',
    "emptyValue": "",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def empty_ads(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], ADS_SCHEMA)


def _with_bad(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(BAD_RECORD, T.StringType())])


def read_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    header: bool = True,
    positions: bool = False,
    quarantine: bool = False,
    multiline: bool = True,
) -> DataFrame:
    """Scan an ad CSV; missing fields and missing files give empty text and an empty table.

    `positions` adds `pos`. `quarantine` adds `_bad` with the text of records that have too few
    or too many fields; they stay in the table, filled up or cut. Files without line ends inside quotes can be read in
    splits, with `multiline=False`. The header must name the ad
    columns in their order; `read_csv_columns` with `align` takes any other.
    """
    columns = [*(["pos"] if positions else []), *ADS_COLUMNS, *([BAD_RECORD] if quarantine else [])]
    if isinstance(path, str) and not exists(spark, path):
        nothing = {"pos": F.lit(None).cast("bigint"), BAD_RECORD: F.lit(None).cast("string")}
        return empty_ads(spark).withColumns(nothing).select(columns)
    reading = {**QUOTING, "multiLine": str(multiline).lower()}
    df = (
        spark.read.schema(_with_bad(ADS_SCHEMA))
        .options(header=str(header).lower(), enforceSchema="false", columnNameOfCorruptRecord=BAD_RECORD, **reading)
        .csv(path)
    )
    if positions:
        df = record_positions(df)
    return df.na.fill("", ADS_COLUMNS).select(columns)


def read_csv_columns(spark: SparkSession, path: str) -> DataFrame:
    """Scan a CSV with whatever columns its header names, all as text."""
    df = spark.read.options(header="true", inferSchema="false", **QUOTING).csv(path)
    return df.na.fill("")


def read_csv_whole(spark: SparkSession, path: str) -> DataFrame:
    """Scan a CSV like `read_csv_columns` for rewriting it: nothing may be lost.

    Files whose header is another fail the scan, and so does, before it, a record with more fields than the header. Fields
    that are missing are empty.
    """
    options = {"header": "true", "inferSchema": "false", **QUOTING}
    schema = spark.read.options(**options).csv(path).schema
    strict = {"enforceSchema": "false", "columnNameOfCorruptRecord": BAD_RECORD, "columnPruning": "false"}
    df = spark.read.schema(_with_bad(schema)).options(**options, **strict).csv(path)
    wider = ", ".join(f"_{k} string" for k in range(len(schema) + 1))
    surplus = F.from_csv(BAD_RECORD, wider, QUOTING)[f"_{len(schema)}"].isNotNull()
    # The text of a record is only there beside its fields, so those are counted as well.
    n = df.agg(F.count_if(surplus), *[F.count(c) for c in schema.names]).first()[0]
    if n:
        raise ValueError(f"{n} records of {path} have more fields than their header")
    return df.drop(BAD_RECORD).na.fill("")


def read_mixed_headers(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Scan files of which some have a header line and some have none."""
    heading = F.array(*[F.col(c) for c in ADS_COLUMNS]) == F.array(*[F.lit(c) for c in ADS_COLUMNS])
    return read_csv(spark, path, header=False).filter(~heading)


def record_positions(df: DataFrame, name: str = "pos") -> DataFrame:
    """Number the records of a file scan from 2, by file name and place in the file.

    Must be applied to the scan itself, before any filter. Only one row per file split is ranked
    globally; records get the offset of their split.
    """
    split = {"_file": F.col("_metadata.file_path"), "_start": F.col("_metadata.file_block_start")}
    rows = df.select("*", *[c.alias(n) for n, c in split.items()], F.monotonically_increasing_id().alias("_at"))
    before = W.orderBy("_file", "_start").rowsBetween(W.unboundedPreceding, -1)
    splits = (
        rows.groupBy("_file", "_start")
        .agg(F.count("*").alias("_n"), F.min("_at").alias("_from"))
        .select("_file", "_start", "_from", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    return (
        rows.join(splits, ["_file", "_start"])
        .withColumn(name, F.col("_at") - F.col("_from") + F.col("_offset") + FIRST_POSITION)
        .select(name, *df.columns)
    )


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", header: bool = True) -> None:
    """Write the ad columns in their order."""
    align(df).write.mode(mode).options(**{**WRITING, "header": str(header).lower()}).csv(path)


def append_parquet(df: DataFrame, path: str) -> None:
    """Append ads to the stored table."""
    df.write.mode("append").parquet(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Stored ads, or an empty table if nothing has been stored yet."""
    return spark.read.parquet(path) if exists(spark, path) else empty_ads(spark)


def stream_parquet(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Follow a Parquet folder, or a single Parquet file as a stream that ends with it."""
    if is_folder(spark, path):
        return spark.readStream.schema(schema).parquet(path)
    parent, name = path.rsplit("/", 1)
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(parent)
