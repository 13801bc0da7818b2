"""Benchmark decontamination by a prefix-filtered set join.

A window is ``width`` consecutive words of a benchmark item (the whole item if shorter). Words
are ordered by how rare they are in the documents, counted over all of them. A document that
contains a window contains its rarest word, so one word per window is the necessary prefix: the
words of the documents are joined with those alone. The offset of the word in its window gives
the place where the window would have to start; places outside the document are dropped, and the
rest is compared word for word. The documents are never shuffled for this: the benchmark side is
broadcast, in as many blocks as its measured size asks for.

Words are runs of letters, digits and non-ASCII characters with A-Z, and nothing else, in lower case:
other capitals stay, since their lower case can depend on what stands beside them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monthgrid.llm.common import materialize, text_or_empty

WIDTH = 10
#: Largest benchmark block that is broadcast at once; a larger benchmark takes several passes.
BLOCK_BYTES = 16 << 20
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    """``text`` with A-Z in lower case. For ASCII the built-in does just that, and faster."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def split_words(text: Column) -> Column:
    """Words in order; the first and last element may be empty."""
    return F.split(text, SEPARATORS, -1)


def word_count(words: Column) -> Column:
    size = F.size(words)
    ends = (F.element_at(words, 1) == "").cast("int") + F.when(size > 1, (F.element_at(words, -1) == "").cast("int")).otherwise(0)
    return (size - ends).cast("bigint")


def item_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """item_id, window (its words, spaced), n (words). Items without words have none."""
    words = split_words(lowered(text_or_empty(text_col)))
    words = benchmark.select(F.col(id_col).alias("item_id"), F.array_remove(words, "").alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1)))
    return words.select("item_id", "w", F.explode(starts).alias("s")).select(
        "item_id", F.array_join(F.slice("w", F.col("s"), F.lit(width)), " ").alias("window"),
        F.least(F.size("w"), F.lit(width)).alias("n"),
    )


def _blocks(df: DataFrame, bytes_of: Column, key: str) -> list[DataFrame]:
    total = df.agg(F.sum(bytes_of)).first()[0] or 0
    n = -(-int(total) // BLOCK_BYTES)
    if n <= 1:
        return [df]
    return [df.where(F.pmod(F.xxhash64(key), F.lit(n)) == i) for i in range(n)]


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def prefixes(docs: DataFrame, windows: DataFrame, text_col: str = "text") -> DataFrame:
    """For each distinct window its rarest word: token, at (its offset in the window), window, n."""
    distinct = windows.select("window", "n").distinct()
    placed = distinct.select("window", "n", F.posexplode(F.split("window", " ")).alias("at", "token"))
    vocabulary = materialize(placed.select("token").distinct(), "vocabulary")
    words = docs.select(F.explode(split_words(lowered(text_or_empty(text_col)))).alias("token"))
    counted = _union([
        words.join(F.broadcast(part), "token").groupBy("token").agg(F.count("*").alias("seen"))
        for part in _blocks(vocabulary, F.octet_length("token") + 16, "token")
    ])
    rarest = F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "token", "at"))
    return (
        placed.join(counted, "token", "left").groupBy("window", "n").agg(rarest.alias("r"))
        .select("r.token", "r.at", "window", "n", "r.seen").where("seen > 0")
    )


def occurrences(docs: DataFrame, windows: DataFrame, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """``id_cols``, text_key, start (index into ``split_words``), n, window: every occurrence in the documents.

    ``text_key`` tells rows with equal ids and different texts apart.
    """
    index = materialize(prefixes(docs, windows, text_col), "prefixes")
    words = docs.select(*id_cols, F.xxhash64(text_or_empty(text_col)).alias("text_key"), split_words(lowered(text_or_empty(text_col))).alias("_words"))
    placed = words.select(*id_cols, "text_key", "_words", F.posexplode("_words").alias("_pos", "token"))
    found = []
    for part in _blocks(index, F.octet_length("window") + F.octet_length("token") + 32, "window"):
        start = F.col("_pos") - F.col("at")
        near = placed.join(F.broadcast(part), "token").where((start >= 0) & (start + F.col("n") <= F.size("_words")))
        # Filters may be evaluated in any order, so the slice must not fail outside the bounds either.
        there = F.array_join(F.slice("_words", F.greatest(start, F.lit(0)) + 1, F.col("n")), " ")
        found.append(near.where(there == F.col("window")).select(*id_cols, "text_key", start.alias("start"), "n", "window"))
    return _union(found)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """id, text_key, n_words, hits (distinct word indexes inside an occurrence, from 0) and items (their ids, sorted).

    One row per input row, repeated rows alike. NULL and empty texts have no words and no hits,
    as have items without words; NULL ids are carried, NULL item ids count as hits but are not
    listed. Other columns are not read, so their names cannot clash. Empty tables are allowed
    on both sides.
    """
    windows = materialize(item_windows(benchmark, item_col, item_text_col, width), "windows")
    ids = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    found = materialize(occurrences(ids, windows, ["_id"], "_t"), "occurrences")
    places = found.groupBy("_id", "text_key").agg(
        F.collect_set(F.struct("start", "n")).alias("spans")
    )
    items = found.join(windows.select("window", "item_id"), "window").groupBy("_id", "text_key").agg(
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items")
    )
    rows = ids.select(
        "_id",
        F.xxhash64(text_or_empty("_t")).alias("text_key"),
        word_count(split_words(text_or_empty("_t"))).alias("n_words"),
        (F.element_at(split_words(text_or_empty("_t")), 1) == "").cast("int").alias("_lead"),
    )
    places = places.toDF("_id_p", "_key_p", "spans")
    items = items.toDF("_id_i", "_key_i", "items")
    same = lambda x: F.col("_id").eqNullSafe(F.col(f"_id_{x}")) & (F.col("text_key") == F.col(f"_key_{x}"))
    inside = F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["n"] - 1)))
    return (
        rows.join(places, same("p"), "left").join(items, same("i"), "left")
        .select(
            F.col("_id").alias(id_col), "text_key", "n_words",
            F.coalesce(F.transform(F.array_sort(F.array_distinct(inside)), lambda i: i - F.col("_lead")), F.array().cast("array<int>")).alias("hits"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        )
    )
