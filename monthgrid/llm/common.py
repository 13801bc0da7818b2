"""Reading, cut points and row keys shared by the corpus operators."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from monthgrid.session import materialize, scratch_path

__all__ = ["Remembered", "content_key", "materialize", "read", "scratch_path", "ship", "shuffle_width", "text_or_empty"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def content_key(col: str = "text") -> Column:
    """128-bit key of a text as a hex string; NULL and empty texts share one."""
    return F.md5(F.encode(text_or_empty(col), "UTF-8"))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        folder = tempfile.mkdtemp(prefix="package-")  # of the driver, which serves it to the executors
        spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/monthgrid_package", "zip", root, "monthgrid"))
        _SHIPPED.add(app)


class Remembered:
    """A bounded memory of what was made before: what is still in use when it fills up outlives the rest."""

    def __init__(self, make, limit: int) -> None:
        self.make, self.limit = make, limit
        self.new: dict = {}
        self.old: dict = {}

    def __call__(self, key):
        value = self.new.get(key)
        if value is None:
            value = self.old.get(key)
            if value is None:
                value = self.make(key)
            if len(self.new) >= self.limit:
                self.old, self.new = self.new, {}
            self.new[key] = value
        return value
