"""Ordered keyword rules that put an ad title into a category."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Categories and the terms they are searched by.
CATEGORY_TERMS = {
    "retail": ["shop assistant", "cashier"],
    "warehouse": ["warehouse operative", "picker packer"],
    "production": ["production worker", "factory operative"],
    "delivery": ["delivery driver", "courier"],
    "hospitality": ["kitchen assistant", "bar staff"],
    "cleaning": ["cleaner", "cleaning operative"],
}


def category_of(text: Column, rules: Mapping[str, Sequence[str]] = CATEGORY_TERMS) -> Column:
    """The first category with a term that is a whole word in the text, else null."""
    def hit(terms: Sequence[str]) -> Column:
        return text.rlike(r"(?iU)\b(?:" + "|".join(re.escape(t) for t in terms) + r")\b")

    return F.coalesce(*[F.when(hit(terms), F.lit(name)) for name, terms in rules.items()])


def category_filter(
    df: DataFrame, text: str = "title", rules: Mapping[str, Sequence[str]] = CATEGORY_TERMS
) -> DataFrame:
    """Keep the ads that fall into one of the categories and name it."""
    return df.withColumn("category", category_of(F.col(text), rules)).filter("category IS NOT NULL")
