"""Input tables: names, files, prefixes and column roles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.calendar import parse_month
from ..functions.names import DERIVED_MARKERS, has_marker
from ..functions.numeric import nan_to_null


@dataclass(frozen=True)
class SourceTable:
    """One input file; ``prefix`` and ``flag`` apply when it is merged."""

    name: str
    path: str
    kind: str  # sector_month | sector | city_year | city_search | ids
    prefix: str = ""
    flag: str = ""


# The ten input files, their column prefixes and presence flags.
SOURCE_TABLES = (
    SourceTable("new_house", "train/new_house_transactions.csv", "sector_month", "nh_", "has_new_house"),
    SourceTable(
        "new_house_nearby",
        "train/new_house_transactions_nearby_sectors.csv",
        "sector_month",
        "nhnbr_",
        "has_new_house_nearby",
    ),
    SourceTable("pre_owned", "train/pre_owned_house_transactions.csv", "sector_month", "po_", "has_pre_owned"),
    SourceTable(
        "pre_owned_nearby",
        "train/pre_owned_house_transactions_nearby_sectors.csv",
        "sector_month",
        "ponbr_",
        "has_pre_owned_nearby",
    ),
    SourceTable("land", "train/land_transactions.csv", "sector_month", "land_", "has_land"),
    SourceTable(
        "land_nearby", "train/land_transactions_nearby_sectors.csv", "sector_month", "landnbr_", "has_land_nearby"
    ),
    SourceTable("poi", "train/sector_POI.csv", "sector", "poi_", "has_poi"),
    SourceTable("city_indexes", "train/city_indexes.csv", "city_year", "macro_", "has_macro"),
    SourceTable("city_search", "train/city_search_index.csv", "city_search", "search_", "has_search"),
    SourceTable("test", "test.csv", "ids"),
)
SECTOR_PREFIXES = tuple(t.prefix for t in SOURCE_TABLES if t.kind == "sector_month")
CITY_PREFIXES = ("search_", "macro_")

# Key columns of each kind of table; all other columns are doubles.
KEY_TYPES = {
    "month": T.StringType(),
    "sector": T.StringType(),
    "keyword": T.StringType(),
    "source": T.StringType(),
    "id": T.StringType(),
    "city_indicator_data_year": T.IntegerType(),
}


def schema_for(columns: Sequence[str]) -> T.StructType:
    """Keys by name, every other column a double."""
    return T.StructType([T.StructField(c, KEY_TYPES.get(c, T.DoubleType())) for c in columns])


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, mode: str = "FAILFAST") -> DataFrame:
    """A headed CSV file. Without a schema only the header line is read ahead.

    ``enforceSchema`` is off, so a header that differs from the schema fails. A
    cell that does not read as its type, such as ``1,234.5`` or ``12%``, fails
    when it is read; ``mode="PERMISSIVE"`` makes it NULL instead. Empty cells are NULL.
    """
    reader = spark.read.option("header", True)
    if schema is None:
        schema = schema_for(reader.csv(path).columns)
    table = reader.schema(schema).option("enforceSchema", False).option("nanValue", "NaN").option("mode", mode).csv(path)
    doubles = {f.name: nan_to_null(f.name) for f in schema if isinstance(f.dataType, T.DoubleType)}
    return table.withColumns(doubles) if doubles else table


def read_sources(
    spark: SparkSession, base_dir: str, schemas: Mapping[str, T.StructType] | None = None
) -> dict[str, DataFrame]:
    """All input tables by name; a missing file fails here, before any job."""
    schemas = schemas or {}
    return {t.name: read_csv(spark, f"{base_dir}/{t.path}", schemas.get(t.name)) for t in SOURCE_TABLES}


def keyed(table: DataFrame, index: DataFrame) -> DataFrame:
    """``(sector, month)`` text keys to ``(sector_id, panel_month)``."""
    rows = table.withColumn("panel_month", parse_month("month")).withColumnRenamed("sector", "sector_label")
    return rows.join(index, "sector_label").drop("sector_label", "month")


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    """A stored panel, its month as a date."""
    return spark.read.parquet(path).withColumn("panel_month", F.to_date("panel_month"))


def column_roles(df: DataFrame, target: str) -> dict[str, str]:
    """``key, target, flag, derived, static, city_metric, sector_metric`` or ``other``."""
    roles = {}
    for c in df.columns:
        if c in ("sector_id", "sector_label", "panel_month", "month_idx", "is_future_horizon"):
            roles[c] = "key"
        elif c == target:
            roles[c] = "target"
        elif c.startswith(("has_", "missing_", "imputed_", "is_")):
            roles[c] = "flag"
        elif has_marker(c, DERIVED_MARKERS):
            roles[c] = "derived"
        elif c.startswith("poi_"):
            roles[c] = "static"
        elif c.startswith(CITY_PREFIXES):
            roles[c] = "city_metric"
        elif c.startswith(SECTOR_PREFIXES):
            roles[c] = "sector_metric"
        else:
            roles[c] = "other"
    return roles
