"""Words, lines and the batches in which Python functions see texts."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Fixed value: a word is a run of characters other than space and the ASCII controls 9 to 13.
WORD = re.compile(r"[^\x20\x09-\x0D]+")

#: Rows that a Python worker is sent, and holds as objects, at once. Texts may be long.
ROWS = 256


def small_batches() -> None:
    """Let the session send Python workers at most `ROWS` rows at once; a smaller setting stays."""
    spark, name = SparkSession.getActiveSession(), "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark and not 0 < int(spark.conf.get(name)) <= ROWS:
        spark.conf.set(name, ROWS)


def words(text: str | None) -> list[str]:
    """The words of a text; none for null."""
    return WORD.findall(text) if text else []


def map_rows(df: DataFrame, schema: str, rows: Callable[[Iterator[dict[str, list]]], Iterator[dict[str, list]]]) -> DataFrame:
    """Apply a function from columns to columns to slices of at most `ROWS` rows of every partition.

    `rows` gets an iterator of dicts (column name to list of values) and yields dicts of the columns of `schema`.
    One iterator goes over one partition, so the function can keep what the rows of a partition share.
    """
    small_batches()
    out = T._parse_datatype_string(schema)
    arrow, names = to_arrow_schema(out), list(df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def slices() -> Iterator[dict[str, list]]:
            for batch in batches:
                for start in range(0, batch.num_rows, ROWS):
                    part = batch.slice(start, ROWS)
                    yield {name: part.column(i).to_pylist() for i, name in enumerate(names)}

        for columns in rows(slices()):
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, out)


def text_struct(column, schema: str, fields: Callable[[str | None], tuple]):
    """A struct column worked out from one text at a time; `fields` gives the values in the order of `schema`."""
    small_batches()
    out = T._parse_datatype_string(schema)
    arrow = pa.struct(list(to_arrow_schema(out)))

    @F.arrow_udf(out)
    def run(texts: pa.Array) -> pa.Array:
        parts = []
        for start in range(0, len(texts), ROWS):
            values = list(zip(*map(fields, texts.slice(start, ROWS).to_pylist()), strict=True))
            arrays = [pa.array(v, f.type) for v, f in zip(values, arrow, strict=True)]
            parts.append(pa.StructArray.from_arrays(arrays, fields=list(arrow)))
        return pa.concat_arrays(parts) if parts else pa.array([], arrow)

    return run(column)
