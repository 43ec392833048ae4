"""Batches of a crawl: numbering, running averages and the estimated end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adloom.functions.text import one_decimal
from adloom.operators.running import SLAB_WIDTH, running_totals

# Ads per batch, the pause per batch that the estimate assumes, and the pause that is
# really made between two batches (seconds).
BATCH_SIZE = 5
ASSUMED_PAUSE = 5
MADE_PAUSE = 10


def batch_assign(links: DataFrame, size: int = BATCH_SIZE) -> DataFrame:
    """Add `batch_no` and `n_batches` to links numbered by `rn` from 1 within their crawl.

    The number is the rank, so the last one tells how many links there are.
    """
    last = links.groupBy("crawl_id").agg(F.max("rn").alias("_links"))
    return (
        links.join(last, "crawl_id")
        .withColumns(
            {
                "batch_no": F.floor((F.col("rn") - 1) / size) + 1,
                "n_batches": F.ceil(F.col("_links") / size),
            }
        )
        .select(*links.columns, "batch_no", "n_batches")
    )


def batch_eta(log: DataFrame, start: Column | None = None, width: int = SLAB_WIDTH) -> DataFrame:
    """After each batch of a timing log: running average and estimated time to the end.

    `log` has crawl_id, rn (batch number from 1) and duration_cents. The estimate is null after
    the last batch. With `start`, the time the crawl began, it is also given as a time of day.
    """
    sums = {"_cents": F.col("duration_cents"), "_done": F.lit(1).cast("bigint")}
    summed = running_totals(log, ["crawl_id"], "rn", sums, {"_done": "n_batches"}, width)
    left = F.col("n_batches") - F.col("_done")
    seconds = F.col("_cents").cast("double") / 100
    average = seconds / F.col("_done")
    eta = F.when(left > 0, left * average + left * ASSUMED_PAUSE)
    out = summed.select(
        "crawl_id",
        "rn",
        "n_batches",
        (seconds + (F.col("_done") - 1) * MADE_PAUSE).alias("elapsed"),
        average.alias("avg_batch_time"),
        eta.alias("eta_seconds"),
    ).withColumns(
        {
            "elapsed_text": one_decimal(F.col("elapsed"), "s"),
            "remaining_text": F.when(
                F.col("eta_seconds").isNotNull(), one_decimal(F.col("eta_seconds") / 60, " min")
            ),
        }
    )
    if start is not None:
        spent = F.col("elapsed") + F.col("eta_seconds")
        finish = start + F.make_dt_interval(secs=spent.cast("decimal(18,6)"))
        out = out.withColumn("eta_time", F.date_format(finish, "HH:mm:ss"))
    return out


def batch_summary(log: DataFrame) -> DataFrame:
    """Per crawl: batches, total and average time, also as text."""
    totals = log.groupBy("crawl_id").agg(
        F.count("*").alias("batches"), F.sum("duration_cents").alias("total_cents")
    )
    seconds = F.col("total_cents").cast("double") / 100
    total = seconds + (F.col("batches") - 1) * MADE_PAUSE
    return totals.select(
        "crawl_id",
        "batches",
        total.alias("total_time"),
        (seconds / F.col("batches")).alias("avg_batch_time"),
        F.concat(one_decimal(total, "s"), F.lit(" ("), one_decimal(total / 60, " min"), F.lit(")")).alias("total_text"),
    )
