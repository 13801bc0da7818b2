"""Column-name slugs for free-text keywords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .calendar import as_column

# Fixed value: the name used when nothing of the keyword survives.
EMPTY_SLUG = "keyword"


def slug(text: Column | str) -> Column:
    """Lower-case letters and digits joined by single underscores."""
    spaced = F.regexp_replace(F.lower(as_column(text)), r"[^\p{L}\p{N}]+", "_")
    trimmed = F.regexp_replace(spaced, "^_|_$", "")
    return F.when(trimmed == "", F.lit(EMPTY_SLUG)).otherwise(trimmed)


def add_slug(df: DataFrame, column: str, output: str, spelling: DataFrame | None = None) -> DataFrame:
    """Slug of ``column``; ``spelling(text, latin)`` optionally transliterates it.

    ``spelling`` is joined without a hint, so its known file size decides
    between broadcast and shuffle.
    """
    if spelling is None:
        return df.withColumn(output, slug(column))
    words = spelling.select(F.col("text").alias(column), F.col("latin").alias("_latin")).dropDuplicates([column])
    joined = df.join(words, column, "left")
    return joined.withColumn(output, slug(F.coalesce("_latin", column))).drop("_latin")
