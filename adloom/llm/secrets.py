"""Secrets in texts by a trigram inverted index: Boolean trigram queries from each pattern, postings, verification."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adloom.session import materialize


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a pattern, and a group of it that must have `least` characters (0: the whole match)."""

    kind: str
    pattern: str
    group: int
    least: int


# The three base kinds.
BASE = [
    Rule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        8,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
]

#: Formats of keys that are public knowledge.
KEYS = [
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("stripe", r"sk_(?:live|test)_[A-Za-z0-9]+", 0, 24),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    Rule("private", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
]

RULES = [*BASE, *KEYS]

#: Most strings a part of a pattern is spelled out in; a part with more counts as anything.
SPELLED = 64

Clauses = list[frozenset[str]]


def trigram_query(pattern: str) -> Clauses:
    """The trigrams of a match of the pattern in lower case: alternatives, each a set that must all be there.

    No alternatives stand for a pattern without mandatory trigrams, which has to be tried on every text.
    """
    from re import _parser as parser

    def lowered(strings: set[str]) -> set[str] | None:
        return {s.lower() for s in strings} if len(strings) <= SPELLED else None

    def spelled(op, arg) -> set[str] | None:
        """All strings a part stands for, if they are few."""
        name = str(op)
        if name == "LITERAL":
            return {chr(arg).lower()}
        if name == "IN":
            if any(str(o) not in ("LITERAL", "RANGE") for o, _ in arg):
                return None
            size = sum(1 if str(o) == "LITERAL" else a[1] - a[0] + 1 for o, a in arg)
            if size > SPELLED:
                return None
            return lowered({chr(c) for o, a in arg for c in ([a] if str(o) == "LITERAL" else range(a[0], a[1] + 1))})
        if name == "SUBPATTERN":
            return joined(arg[3])
        if name == "BRANCH":
            parts = [joined(x) for x in arg[1]]
            return None if None in parts else lowered(set().union(*parts))
        if name == "MAX_REPEAT" and arg[1] == 1:
            inner = joined(arg[2])
            return None if inner is None else inner | ({""} if arg[0] == 0 else set())
        return None

    def joined(parts) -> set[str] | None:
        out = {""}
        for op, arg in parts:
            some = spelled(op, arg)
            if some is None or len(out) * len(some) > SPELLED:
                return None
            out = {a + b for a, b in product(out, some)}
        return out

    def grams(strings: set[str]) -> Clauses:
        return [frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings]

    def both(a: Clauses, b: Clauses) -> Clauses:
        if not a or not b:
            return a or b
        return [x | y for x, y in product(a, b)] if len(a) * len(b) <= SPELLED else a

    def query(parts) -> Clauses:
        """Runs of spelled parts give their trigrams; parts between them are asked for what they hold."""
        out: Clauses = []
        run = {""}

        def close() -> None:
            nonlocal out
            found = grams(run)
            if all(found):
                out = both(out, found)

        for op, arg in parts:
            some = spelled(op, arg)
            if some is not None and len(run) * len(some) <= SPELLED:
                run = {a + b for a, b in product(run, some)}
                continue
            close()
            run = some if some is not None else {""}
            if some is None and str(op) == "SUBPATTERN":
                out = both(out, query(arg[3]))
            elif some is None and str(op) == "MAX_REPEAT" and arg[0] > 0:
                out = both(out, query(arg[2]))
        close()
        return out

    found = set(query(parser.parse(pattern)))
    return sorted((c for c in found if not any(other < c for other in found)), key=sorted)


def postings(docs: DataFrame, grams: list[str]) -> DataFrame:
    """The inverted index of the lower-cased texts for the given trigrams: trigram, doc_id."""
    low = F.lower(F.col("text"))
    present = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(g)), F.lit(g)) for g in grams]))
    return docs.select("doc_id", F.explode(present).alias("trigram"))


def candidates(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The kinds each document may hold: doc_id and `_kinds`, for rules with mandatory trigrams."""
    spark = docs.sparkSession
    terms = [
        (rule.kind, k, len(clause), gram)
        for rule in rules
        for k, clause in enumerate(trigram_query(rule.pattern))
        for gram in sorted(clause)
    ]
    index = postings(docs, sorted({t[3] for t in terms}))
    asked = spark.range(1).select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(a).alias("kind"), F.lit(b).alias("clause"), F.lit(n).alias("n"), F.lit(g).alias("trigram"))
                    for a, b, n, g in terms
                ]
            )
        )
    )
    # `asked` has a row for each trigram of each clause of the rules, whatever the data.
    met = index.distinct().join(F.broadcast(asked), "trigram").groupBy("doc_id", "kind", "clause", "n").count()
    return met.filter("count = n").groupBy("doc_id").agg(F.collect_set("kind").alias("_kinds"))


def found_by(rule: Rule, text: Column, order: int) -> Column:
    """All matches of a rule from left to right without those that are too short: start, order, end, kind.

    The text between the matches and the matches themselves give the positions, in code points.
    """
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    between = F.transform(F.split(text, rule.pattern, -1), F.char_length)
    steps = F.zip_with(
        F.arrays_zip(F.transform(whole, F.char_length).alias("a"), F.transform(part, F.char_length).alias("b")),
        F.slice(between, 1, F.size(whole)),
        lambda m, gap: F.struct(gap.alias("gap"), m["a"].alias("size"), m["b"].alias("asked")),
    )
    none = F.expr("cast(array() as array<struct<start:int,rank:int,end:int,kind:string>>)")
    zero = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        end = start + x["size"]
        span = F.struct(start.alias("start"), F.lit(order).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        longer = F.concat(state["out"], F.array(span))
        return F.struct(end.alias("at"), F.when(x["asked"] >= rule.least, longer).otherwise(state["out"]).alias("out"))

    spans = F.aggregate(steps, zero, step, lambda state: state["out"])
    return F.when(F.rlike(text, F.lit(rule.pattern)), spans).otherwise(none)


def secret_spans(docs: DataFrame, rules: list[Rule] | None = None, name: str = "secrets") -> DataFrame:
    """Add the array `name` of start, rank, end and kind of all secrets, by start and then by rule.

    A text is searched with the rules whose trigram query its postings meet, and with those that have no mandatory
    trigrams. A null text is empty and has none. Rows with a null or repeated doc_id are searched as well: what the
    postings of equal ids meet together is tried on each. Other columns stay, save one called `name`, which is replaced.
    """
    rules = rules or RULES
    maybe = candidates(docs.select("doc_id", "text"), rules).withColumnRenamed("doc_id", "_doc_id")
    own = [c for c in docs.columns if c != name]
    joined = docs.select(*own).join(maybe, F.col("doc_id").eqNullSafe(F.col("_doc_id")), "left")
    text = F.coalesce(F.col("text"), F.lit(""))
    found = []
    for order, rule in enumerate(rules):
        spans = found_by(rule, text, order)
        if trigram_query(rule.pattern):
            none = F.expr("cast(array() as array<struct<start:int,rank:int,end:int,kind:string>>)")
            spans = F.when(F.coalesce(F.array_contains("_kinds", rule.kind), F.lit(False)), spans).otherwise(none)
        found.append(spans)
    return joined.select(*own, F.array_sort(F.concat(*found)).alias(name))


def written(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with every run of overlapping spans replaced by a mark."""
    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(state: Column, s: Column) -> Column:
        apart = F.concat(state["out"], F.substring(text, state["at"] + 1, s["start"] - state["at"]), F.lit(mark))
        fresh = (s["start"] >= state["at"]) & ((s["start"] > 0) | (state["out"] == ""))
        return F.struct(
            F.when(fresh, apart).otherwise(state["out"]).alias("out"), F.greatest(state["at"], s["end"]).alias("at")
        )

    rest = lambda state: F.concat(state["out"], F.substring(text, state["at"] + 1, F.char_length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, zero, step, rest)).otherwise(text)


def _of_kind(kind: str) -> Callable[[Column], Column]:
    return lambda span: span["kind"] == kind


def secrets_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and spans of the secrets of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    base = F.filter("secrets", lambda s: s["rank"] < len(BASE))
    return secret_spans(docs).select(
        "doc_id",
        *[
            F.size(F.filter("secrets", _of_kind(rule.kind))).cast("long").alias(f"n_{rule.kind}")
            for rule in BASE
        ],
        F.sha2(written(base), 256).alias("base_sha256"),
        written(F.col("secrets")).alias("spans"),
    )


def _kind_sql(order: int, rule: Rule) -> str:
    pattern = rule.pattern.replace("'", "''")
    return f"""
    SELECT r, {order} AS ord, '{rule.kind}' AS kind, pos AS start, pos + length(m[i]) AS stop, length(g[i]) AS asked
    FROM (
        SELECT r, m, g, i, (list_sum(list_transform(p[1:i], lambda x: length(x)))
            + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS pos
        FROM (
            SELECT r, m, unnest(range(1, len(m) + 1)) AS i, string_split_regex(text, '{pattern}') AS p,
                regexp_extract_all(text, '{pattern}', {rule.group}) AS g
            FROM (SELECT r, text, regexp_extract_all(text, '{pattern}', 0) AS m FROM d)
        )
    ) WHERE length(g[i]) >= {rule.least}"""


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
s AS ({" UNION ALL ".join(_kind_sql(k, rule) for k, rule in enumerate(RULES))}
), per AS (
    SELECT r, {", ".join(f"count(*) FILTER (kind = '{rule.kind}') AS n_{rule.kind}" for rule in BASE)},
        string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) FILTER (ord < {len(BASE)}) AS base,
        string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) AS spans
    FROM s GROUP BY r
)
SELECT doc_id, {", ".join(f"coalesce(n_{rule.kind}, 0) AS n_{rule.kind}" for rule in BASE)},
    sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN per USING (r)
"""

QUERIES = {"op6_secret_scan": secrets_query}
ORACLE = {"op6_secret_scan": SQL}
