"""Secret scans over an incremental ledger of content-addressed blobs.

Every version of every path is addressed by the SHA-256 of its text. A ledger of
two Parquet tables remembers which (blob, rule, rule version) pairs were scanned and
what was found in them; a run scans only the pairs it has not seen, once per blob
however many paths carry it, and joins the findings back to all paths and versions.

Match positions come from the pieces between the matches: ``split`` and
``regexp_extract_all`` with one pattern alternate, so running sums of their lengths
are the code point offsets. Everything is built-in functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from monthgrid.llm.common import scratch_path, text_or_empty

SCANS_SCHEMA = "blob_id string, rule string, rule_version int"
FINDINGS_SCHEMA = "blob_id string, rule string, rule_version int, start bigint, end bigint"


@dataclass(frozen=True)
class Rule:
    """A pattern; of its leftmost non-overlapping matches those stay whose ``group`` has ``min_chars``."""

    name: str
    version: int
    pattern: str
    group: int = 0
    min_chars: int = 1

    @property
    def label(self) -> str:
        return f"{self.name}@{self.version}"


RULES = (
    Rule(
        "assign", 1,
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2, min_chars=8,
    ),
    Rule("access", 1, r"AKIA[A-Z0-9]+", min_chars=16),
    # A run of hex digits is maximal, so asking for its length in the pattern finds the same matches.
    Rule("hex", 1, r"[0-9a-f]{32,}", min_chars=32),
)


def address_versions(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``blob_id``. NULL texts address the empty blob."""
    return docs.withColumn("blob_id", F.sha2(text_or_empty(text_col), 256))


def _pieces(text: Column, rule: Rule) -> Column:
    """Lengths of (text before the match, match, checked group) for each match; NULL without any."""
    pattern = F.lit(rule.pattern)
    found = F.arrays_zip(
        F.split(text, rule.pattern, -1).alias("before"),
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("whole"),
        F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("checked"),
    )
    lengths = F.transform(
        found,
        lambda x: F.struct(
            F.length(x["before"]).alias("before"), F.length(x["whole"]).alias("whole"), F.length(x["checked"]).alias("checked")
        ),
    )
    return F.when(text.rlike(rule.pattern), lengths)


def scan(unseen: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``unseen``: blob_id, text, seen (labels of rules not to run). One row per scanned pair, with match lengths."""
    pairs = F.array(
        *[
            F.struct(
                F.lit(r.name).alias("rule"),
                F.lit(r.version).alias("rule_version"),
                F.array_contains("seen", r.label).alias("known"),
                F.when(~F.array_contains("seen", r.label), _pieces(F.col("text"), r)).alias("pieces"),
            )
            for r in rules
        ]
    )
    return (
        unseen.select("blob_id", F.explode(pairs).alias("p"))
        .where("NOT p.known")
        .select("blob_id", "p.rule", "p.rule_version", "p.pieces")
    )


def spans(scanned: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Findings with code point offsets, end exclusive."""
    order = Window.partitionBy("blob_id", "rule", "rule_version").orderBy("i")
    least = F.coalesce(*[F.when(F.col("rule") == r.name, F.lit(r.min_chars)) for r in rules])
    return (
        scanned.where("pieces IS NOT NULL")
        .select("blob_id", "rule", "rule_version", F.posexplode("pieces").alias("i", "x"))
        .withColumn("end", F.sum(F.col("x.before").cast("bigint") + F.coalesce("x.whole", F.lit(0))).over(order))
        .where("x.whole IS NOT NULL")
        .where(F.col("x.checked") >= least)
        .select("blob_id", "rule", "rule_version", (F.col("end") - F.col("x.whole")).alias("start"), "end")
    )


class Ledger:
    """Scanned pairs and findings below one shared folder; runs only append."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        for name, schema in (("scans", SCANS_SCHEMA), ("findings", FINDINGS_SCHEMA)):
            spark.createDataFrame([], schema).write.mode("append").parquet(f"{path}/{name}")

    def scans(self) -> DataFrame:
        return self.spark.read.schema(SCANS_SCHEMA).parquet(f"{self.path}/scans")

    def findings(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """Findings of these rule versions, once each even if a lost run was repeated."""
        labels = [r.label for r in rules]
        found = self.spark.read.schema(FINDINGS_SCHEMA).parquet(f"{self.path}/findings")
        return found.where(F.concat_ws("@", "rule", F.col("rule_version").cast("string")).isin(labels)).distinct()

    def update(self, versions: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> None:
        """Scan the unseen pairs. Findings land before the pairs count as seen, so a lost run is only repeated."""
        labels = F.array(*[F.lit(r.label) for r in rules])
        seen = self.scans().groupBy("blob_id").agg(
            F.collect_set(F.concat_ws("@", "rule", F.col("rule_version").cast("string"))).alias("seen")
        )
        blobs = versions.select("blob_id", text_or_empty(text_col).alias("text")).groupBy("blob_id").agg(F.first("text").alias("text"))
        unseen = (
            blobs.join(seen, "blob_id", "left")
            .withColumn("seen", F.coalesce("seen", F.array().cast("array<string>")))
            .where(F.size(F.array_except(labels, F.col("seen"))) > 0)
        )
        run = scratch_path(self.spark, "scan")
        scan(unseen, rules).write.parquet(run)
        scanned = self.spark.read.parquet(run)
        spans(scanned, rules).write.mode("append").parquet(f"{self.path}/findings")
        scanned.select("blob_id", "rule", "rule_version").write.mode("append").parquet(f"{self.path}/scans")


def scan_secrets(docs: DataFrame, id_cols: list[str], ledger: Ledger | None = None, rules: tuple[Rule, ...] = RULES,
                 text_col: str = "text") -> DataFrame:
    """Findings of every path and version: ``id_cols``, blob_id and ``spans``, an array of (start, kind, rule, end).

    One row per input row, also for repeated rows; NULL and empty texts have no findings,
    and NULL ids are carried. Other columns are not read, so their names cannot clash.
    Spans are ordered by start, then by the order of ``rules``. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    ledger = ledger or Ledger(spark, scratch_path(spark, "ledger"))
    versions = address_versions(docs.select(*id_cols, text_col), text_col)
    ledger.update(versions, rules, text_col)
    kind = F.coalesce(*[F.when(F.col("rule") == r.name, F.lit(i)) for i, r in enumerate(rules)])
    by_blob = (
        ledger.findings(rules)
        .groupBy("blob_id")
        .agg(F.array_sort(F.collect_list(F.struct("start", kind.alias("kind"), "rule", "end"))).alias("spans"))
    )
    none = F.array().cast(by_blob.schema["spans"].dataType)
    return versions.select(*id_cols, "blob_id").join(by_blob, "blob_id", "left").withColumn("spans", F.coalesce("spans", none))
