"""From raw documents to token ids: five stages, each on all that the one before kept.

Every stage reads a written table and returns the columns of its input, the last one ids and
digests. Columns of any name are carried along. NULL and empty texts and NULL ids have a defined
place in each stage, given below; empty tables pass through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from monthgrid.llm import bpe, decontaminate, language, lines, neardup
from monthgrid.llm.common import materialize, read, text_or_empty
from monthgrid.llm.common import ship as ship_package


#: Rows sent to a Python worker at once. Workers of all stages live on, so what a batch takes counts for the rest, too.
BATCH_ROWS = 1000


def ship(spark: SparkSession) -> None:
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def _packed(docs: DataFrame) -> DataFrame:
    """``row``, a struct of all columns, beside the id and the text, so that added names cannot clash."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return docs.select(whole, F.col("doc_id").alias("id"), F.col("text").alias("text"))


def _keyed(docs: DataFrame) -> DataFrame:
    """Adds join keys that hold for NULL ids too and tell texts under one id apart."""
    return (
        _packed(docs).withColumn("row_key", F.xxhash64(text_or_empty("text")))
        .withColumn("no_id", F.col("id").isNull()).withColumn("known_id", F.coalesce("id", F.lit(0)))
    )


KEYS = ["known_id", "no_id", "row_key"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents written in one of the languages of the ``lang`` column.

    Profiles are learned from all rows with text and language, as is the cosine that a text has to
    reach: more than unrelated texts have, or less where the shortness of the text lets expect less, so
    that short clean texts stay. A text without any letter, NULL and empty ones
    among them, has no language and goes. Without labelled rows all go.
    """
    ship(spark)
    profiles = language.learn(docs)
    # Written once: all scores are seen before the first row is judged.
    found = materialize(language.identify(_packed(docs), profiles, ["row"]), "languages")
    fade, least = language.levels(found.where("row.lang IS NOT NULL"))
    return found.where(language.accepted(fade, least)).select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated runs of lines out of the texts; a document that has no line left by this goes.

    Texts without a line, NULL ones among them, stay as they are, as do rows with a NULL id. ``n_chars``
    follows the new text.
    """
    ship(spark)
    found = lines.dedup_lines(docs)
    out = found.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(F.col("kept_text").alias(c))
        elif c == "n_chars":
            columns.append(F.when(F.col("n_removed") > 0, F.length("kept_text").cast(docs.schema[c].dataType)).otherwise(F.col("row.n_chars")).alias(c))
        else:
            columns.append(F.col(f"row.`{c}`").alias(c))
    return out.select(*columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, the one with the smallest id.

    Of rows repeated as a whole one stays. Rows without words, NULL texts among them, have no
    duplicates and stay. In a group without any id one row stays.
    """
    ship(spark)
    found = materialize(neardup.near_duplicates(docs), "near_duplicates")
    groups = found.where("component IS NOT NULL AND coalesce(kept, true)")
    chosen = groups.groupBy("component").agg(F.min(F.struct("doc_id", "row_key")).alias("best")).select("best.doc_id", "best.row_key")
    chosen = chosen.select(F.coalesce("doc_id", F.lit(0)).alias("known_id"), F.col("doc_id").isNull().alias("no_id"), "row_key")
    rows = _keyed(docs).withColumn("blank", F.trim(F.translate(text_or_empty("text"), "\t\n\x0b\x0c\r", "     ")) == "")
    kept = rows.where("NOT blank").join(chosen, KEYS).dropDuplicates(KEYS)
    return kept.select("row.*").unionByName(rows.where("blank").select("row.*"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a window of a benchmark item occurs. NULL and empty texts stay."""
    ship(spark)
    found = decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))
    hit = found.where(F.size("hits") > 0).select(
        F.coalesce("doc_id", F.lit(0)).alias("known_id"), F.col("doc_id").isNull().alias("no_id"), F.col("text_key").alias("row_key")
    ).distinct()
    return _keyed(docs).join(hit, KEYS, "left_anti").select("row.*")


RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document; NULL texts count as empty."""
    ship(spark)
    found = bpe.encode(docs, ["doc_id"], RANKS, public_tokenizers.PATTERN, decoded=True)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return found.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("byte-level BPE", byte_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Language profiles and the tokenizer have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
