"""The ad table: column order, types and the values every operator agrees on."""

from __future__ import annotations

from pyspark.sql import types as T

# Column order of the ad table.
ADS_COLUMNS = [
    "id",
    "url",
    "title",
    "company",
    "salary",
    "location",
    "work_time",
    "contract_type",
    "scraped_at",
    "description",
]

# Fixed value: title stored for a page that could not be fetched.
ERROR_TITLE = "403 ERROR"

# Fixed value: position of the first record (the header is line 1).
FIRST_POSITION = 2

ADS_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ADS_COLUMNS])

# Column that holds the raw text of records with too few or too many fields.
BAD_RECORD = "_bad"
