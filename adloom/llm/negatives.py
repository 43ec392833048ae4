"""Hard negatives by bounds from segment summaries: means and deviations of vector segments.

A vector is cut into segments. Within one, the inner product of two vectors is the number of components times the
product of their means, plus or minus at most the product of their deviations (the root of the summed squares around the
mean). Summed over the segments this bounds a score from both sides without looking at the components. Each row
stores these summaries for few long and for many short segments: pairs that the long ones cannot decide are bounded again
by the short ones, and only what is left is scored exactly.

Anchors are a stated part of the rows, a hundredth of them say. Rows are dealt into groups of bounded size, and all anchors
stream past each group in batches, so a task holds one group and one batch, whatever the size of the table or of a label.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from adloom.operators.ordering import ranges_of
from adloom.session import materialize

#: Rows of a group, about, in tables of so many that the tasks of a shuffle would get more.
GROUP = 16_384

#: Anchors that meet a group at once.
BATCH = 64

#: Segments of the coarse and of the fine summary.
LEVELS = (4, 16)

#: Whole numbers up to here are exact as doubles.
EXACT = 2.0**53

STORED = "vec_id long, label long, print long, q array<double>, means array<double>, deviations array<double>"


def vectors(table: DataFrame, ident: str, vector: str, label: Column, scale: int = 256) -> DataFrame:
    """Rows that take part, each different one once: vec_id, label, print, q (components times `scale`, rounded down).

    Rows with a null id, label or vector, or a null or non-finite component, take no part. `print` is a hash of label and
    components, which tells rows of one id apart.
    """

    def scaled(v: Column) -> Column:
        v = v.cast("double") * F.lit(float(scale))
        # Large doubles are whole already and may be beyond the numbers of 64 bits.
        return F.when(F.abs(v) < F.lit(EXACT), F.floor(v).cast("double")).otherwise(v)

    sound = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = table.filter(F.col(ident).isNotNull() & label.isNotNull() & F.col(vector).isNotNull() & sound)
    rows = rows.select(F.col(ident).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.transform(vector, scaled).alias("q"))
    return rows.withColumn("print", F.xxhash64("label", "q")).dropDuplicates(["vec_id", "label", "q"])


def edges(dims: int, segments: int) -> np.ndarray:
    """Where the segments of vectors of `dims` components begin; as many as there are components at most."""
    return np.linspace(0, dims, min(segments, max(dims, 1)), endpoint=False).astype(int)


def summaries(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of the segments of each row, those of all levels side by side."""
    n, dims = q.shape
    means, deviations = [], []
    for level in LEVELS:
        at = edges(dims, level)
        sizes = np.diff([*at, dims])
        mean = np.add.reduceat(q, at, axis=1) / sizes if dims else np.zeros((n, 1))
        around = q - np.repeat(mean, sizes, axis=1) if dims else q
        square = np.add.reduceat(around * around, at, axis=1) if dims else np.zeros((n, 1))
        means.append(mean)
        deviations.append(np.sqrt(square))
    return np.hstack(means), np.hstack(deviations)


def _matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    """Lists of numbers as rows of `dims` doubles; shorter ones end in zeros."""
    out = np.zeros((len(column), dims))
    sizes = np.asarray(column.value_lengths())
    flat = np.asarray(column.flatten(), dtype=float)
    if len(flat) == out.size:
        return flat.reshape(out.shape)
    out[np.arange(dims) < sizes[:, None]] = flat
    return out


def summarised(rows: DataFrame, dims: int) -> DataFrame:
    """Rows with vectors of `dims` components and the summaries of their segments."""
    schema = T._parse_datatype_string(STORED)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = _matrix(batch.column("q"), dims)
            lists = [pa.array(list(x), pa.list_(pa.float64())) for x in (q, *summaries(q))]
            plain = [batch.column(c) for c in ("vec_id", "label", "print")]
            yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(plain + lists, arrow, strict=True)], schema=arrow)

    return rows.select("vec_id", "label", "print", "q").mapInArrow(run, schema)


class Block:
    """Rows side by side: ids, labels, prints, components, and summaries by level, means weighted for inner products."""

    def __init__(self, batch: pa.RecordBatch, dims: int):
        self.ids, self.labels, self.prints = (np.asarray(batch.column(c)) for c in ("vec_id", "label", "print"))
        self.q = _matrix(batch.column("q"), dims)
        counts = [len(edges(dims, level)) for level in LEVELS]
        means, deviations = (_matrix(batch.column(c), sum(counts)) for c in ("means", "deviations"))
        self.levels, start = [], 0
        for level, n in zip(LEVELS, counts, strict=True):
            root = np.sqrt(np.diff([*edges(dims, level), dims]))
            self.levels.append((means[:, start : start + n] * root, deviations[:, start : start + n]))
            start += n
        self.norms = np.sqrt((self.q * self.q).sum(axis=1))
        self.largest = float(np.abs(self.q).max(initial=0))
        self.limits = batch.column("limits").to_pylist()


def bounds(rows: Block, anchors: Block, level: int, a, r=slice(None)) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score of anchors `a` (a number or slice) with rows `r`, from the summaries of a level."""
    (rm, rd), (am, ad) = rows.levels[level], anchors.levels[level]
    centre = am[a] @ rm[r].T
    rounding = np.multiply.outer(anchors.norms[a], rows.norms[r]) * 1e-9
    spread = ad[a] @ rd[r].T + rounding
    return centre - spread, centre + spread


def scores(rows: Block, anchors: Block, a: int, r: np.ndarray) -> np.ndarray:
    """Exact scores of an anchor with rows; those beyond 64 bits stop the job."""
    if rows.largest * anchors.largest * max(rows.q.shape[1], 1) < EXACT:
        return (rows.q[r] @ anchors.q[a]).astype(np.int64)
    own = [int(x) for x in anchors.q[a]]
    exact = [sum(int(x) * y for x, y in zip(v, own, strict=True)) for v in rows.q[r]]
    if any(not -(1 << 63) <= x < 1 << 63 for x in exact):
        raise ValueError("a score does not fit into 64 bits")
    return np.array(exact, np.int64)


def _kth(values: np.ndarray, k: int) -> float:
    """The k-th greatest value, or minus infinity where there are fewer."""
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else -math.inf


def _best(rows: Block, r: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((rows.prints[r], rows.ids[r], -score))[:k]


def nearest(rows: Block, anchors: Block, k: int) -> Iterator[tuple]:
    """The best `k` rows of a group for each anchor among the others of its label."""
    low, high = bounds(rows, anchors, 0, slice(None))
    for a in range(len(anchors.ids)):
        other = (rows.ids != anchors.ids[a]) | (rows.prints != anchors.prints[a])
        r = np.flatnonzero((rows.labels == anchors.labels[a]) & other)
        r = r[high[a, r] >= _kth(low[a, r], k)]
        below, above = bounds(rows, anchors, 1, a, r)
        r = r[above >= _kth(np.maximum(below, low[a, r]), k)]
        score = scores(rows, anchors, a, r)
        for i in _best(rows, r, score, k):
            yield anchors.ids[a], anchors.prints[a], rows.ids[r[i]], rows.prints[r[i]], score[i]


def within_limits(rows: Block, anchors: Block, k: int) -> Iterator[tuple]:
    """For each anchor and each of its limits, the best `k` rows of a group of other labels with scores between them."""
    low, high = bounds(rows, anchors, 0, slice(None))
    for a, limits in enumerate(anchors.limits):
        other = np.flatnonzero(rows.labels != anchors.labels[a])
        below, above = low[a, other], high[a, other]
        wanted = [(x["least"], x["most"]) for x in limits if x["least"] <= x["most"]]
        near = other[_undecided(below, above, wanted, k)]
        finer = bounds(rows, anchors, 1, a, near)
        below, above = np.maximum(low[a, near], finer[0]), np.minimum(high[a, near], finer[1])
        r = near[_undecided(below, above, wanted, k)]
        score = scores(rows, anchors, a, r)
        for x in limits:
            fits = np.flatnonzero((score >= x["least"]) & (score <= x["most"]))
            for i in fits[_best(rows, r[fits], score[fits], k)]:
                yield (anchors.ids[a], anchors.prints[a], x["id"], x["print"], x["score"],
                       rows.ids[r[i]], rows.prints[r[i]], score[i])


def _undecided(below: np.ndarray, above: np.ndarray, wanted: list[tuple[int, int]], k: int) -> np.ndarray:
    """Which rows may be among the best `k` within any of the limits, by the bounds of their scores."""
    keep = np.zeros(len(below), bool)
    for least, most in wanted:
        sure = _kth(below[(below >= least) & (above <= most)], k)
        keep |= (above >= max(least, sure)) & (below <= most)
    return keep


LIMITS = "array<struct<id: long, print: long, score: long, least: long, most: long>>"


def against(
    rows: DataFrame, anchors: DataFrame, dims: int, groups: int, schema: str, found: Callable[[Block, Block], Iterator[tuple]]
) -> DataFrame:
    """Let all anchors (rows with `limits`) pass each of so many groups of rows; gives what `found` yields.

    Rows are dealt by a hash, each group comes sorted before the anchors that pass it.
    """
    out = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(out)
    number = F.pmod(F.xxhash64("vec_id", "print"), F.lit(groups)).cast("int")
    ours = rows.select("*", F.lit(None).cast(LIMITS).alias("limits"), number.alias("_group"), F.lit(0).alias("_kind"))
    theirs = anchors.select("*", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("_group"), F.lit(1).alias("_kind"))
    dealt = ours.unionByName(theirs.select(ours.columns)).repartition(groups, "_group")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, parts, block = None, [], None
        for batch in batches:
            places = np.asarray(batch.column("_group")) * 2 + np.asarray(batch.column("_kind"))
            starts = [0, *(np.flatnonzero(np.diff(places)) + 1).tolist(), batch.num_rows]
            for start, end in zip(starts, starts[1:]):
                if start == end:
                    continue
                number, kind = divmod(int(places[start]), 2)
                if number != group:
                    group, parts, block = number, [], None
                if not kind:
                    parts.append(batch.slice(start, end - start))
                    continue
                if block is None and parts:
                    whole = pa.Table.from_batches(parts).combine_chunks()
                    block, parts = Block(whole.to_batches()[0], dims), []
                if block is None:
                    continue
                for at in range(start, end, BATCH):
                    result = list(found(block, Block(batch.slice(at, min(BATCH, end - at)), dims)))
                    columns = zip(*result) if result else [[]] * len(arrow)
                    arrays = [pa.array(list(c), f.type) for c, f in zip(columns, arrow, strict=True)]
                    yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return dealt.sortWithinPartitions("_group", "_kind").mapInArrow(run, out)


def hard_negatives(
    table: DataFrame,
    ident: str = "vec_id",
    vector: str = "embedding",
    label: str | Column = "label",
    every: int = 100,
    positives: int = 5,
    negatives: int = 10,
    least_percent: int = 30,
    most_percent: int = 90,
) -> DataFrame:
    """One row per anchor, positive and negative: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Scores are inner products of components times 256, rounded down. Anchors are rows whose id is divisible by
    `every`; positives their best other rows of the same label; negatives the best rows of other labels whose scores lie
    between the two percentages of the positive's. Higher scores come first, ties by smaller id.

    Rows with a null id, label or vector or a null or non-finite component take no part; equal rows (id, label,
    components) are one; rows that share an id stay apart, ties between them go by a hash of their content; shorter vectors
    end in zeros; an anchor with fewer positives or negatives has fewer rows, without any it has none; no rows give
    none; other columns are left out. Vectors with their summaries, positives and limits are written to the shared folder.
    """
    label = F.col(label) if isinstance(label, str) else label
    clean = materialize(vectors(table, ident, vector, label), "vectors")
    size = clean.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("q")), F.lit(0)).alias("dims")).first()
    groups = ranges_of(clean, size["n"], GROUP)
    rows = materialize(summarised(clean, size["dims"]), "summaries")
    anchors = rows.filter(F.pmod("vec_id", F.lit(every)) == 0)

    near = against(
        rows, anchors.withColumn("limits", F.array().cast(LIMITS)), size["dims"], groups,
        "anchor_id long, anchor_print long, id long, print long, score long", lambda r, a: nearest(r, a, positives),
    )
    key = ["anchor_id", "anchor_print"]
    by_score = W.partitionBy(*key).orderBy(F.desc("score"), "id", "print")
    best = near.withColumn("_rank", F.row_number().over(by_score)).filter(F.col("_rank") <= positives)
    score = F.col("score").cast("decimal(38,0)")
    # 100 * negative lies between least * positive and most * positive, in whole numbers.
    limit = F.struct(
        "id",
        "print",
        "score",
        F.ceil(score * least_percent / 100).cast("long").alias("least"),
        F.floor(score * most_percent / 100).cast("long").alias("most"),
    )
    limits = best.groupBy(*key).agg(F.sort_array(F.collect_list(limit)).cast(LIMITS).alias("limits"))
    limits = limits.withColumnsRenamed({"anchor_id": "vec_id", "anchor_print": "print"})
    passing = materialize(anchors.join(limits, ["vec_id", "print"]), "anchors")

    found = against(
        rows, passing, size["dims"], groups,
        "anchor_id long, anchor_print long, positive_id long, positive_print long, positive_score long,"
        " negative_id long, negative_print long, negative_score long",
        lambda r, a: within_limits(r, a, negatives),
    )
    by_score = W.partitionBy(*key, "positive_id", "positive_print").orderBy(
        F.desc("negative_score"), "negative_id", "negative_print"
    )
    ranked = found.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def moved_label() -> Column:
    """The label of the query: one on, in a circle of ten, where vec_id is divisible by seven."""
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


def negatives_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth embedding among all embeddings."""
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), label=moved_label())


QUERIES = {"op11_segment_summaries": negatives_query}

ORACLE = {
    "op11_segment_summaries": """WITH v AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
            list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
        FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
            CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
        FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
    p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
    n AS (SELECT anchor_id, positive_id, positive_score, id AS negative_id, score AS negative_score,
            CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INT) AS rank
        FROM p JOIN s USING (anchor_id)
        WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
    SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10""",
}
