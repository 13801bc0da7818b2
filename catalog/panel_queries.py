"""Sources, sinks, the grid and everything merged onto it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from monthgrid.functions import calendar as ca
from monthgrid.functions import numeric as nu
from monthgrid.functions import text as tx
from monthgrid.operators import citywide as ci
from monthgrid.operators import folds as fo
from monthgrid.operators import grid as gr
from monthgrid.operators import sectors as sc
from monthgrid.operators import series as se
from monthgrid.session import materialize, scratch_path
from monthgrid.sources import artefacts as ar
from monthgrid.sources import sinks as si
from monthgrid.sources import tables as ta

from . import fixtures as fx
from .registry import query

KEY, MONTH = fx.KEY, fx.MONTH


def rounded(df: DataFrame, columns, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _labelled(df: DataFrame) -> DataFrame:
    return df.select(
        F.date_format(MONTH, "yyyy-MMM").alias("month"),
        F.concat(F.lit("sector "), F.col(KEY).cast("string")).alias("sector"),
        *[c for c in df.columns if c not in (KEY, MONTH)],
    )


# --- sources and sinks -----------------------------------------------------


@query(
    "scan_sources",
    """
SELECT 'new_house' AS source, COUNT(*) AS row_count, COUNT(DISTINCT sector_id) AS sectors,
       MIN(panel_month) AS first_month, MAX(panel_month) AS last_month, ROUND(SUM(amount), 2) AS total FROM nh
UNION ALL
SELECT 'pre_owned', COUNT(*), COUNT(DISTINCT sector_id), MIN(panel_month), MAX(panel_month), ROUND(SUM(amount), 2) FROM po
UNION ALL
SELECT 'land', COUNT(*), COUNT(DISTINCT sector_id), MIN(panel_month), MAX(panel_month), ROUND(SUM(amount), 2) FROM land
""",
    ("nh", "po", "land"),
)
def scan_sources(spark: SparkSession, d: str) -> DataFrame:
    """Three CSV sources with text months and sectors, written out and read back."""
    made = {"new_house": fx.new_house(spark, d), "pre_owned": fx.pre_owned(spark, d), "land": fx.land(spark, d)}
    base = scratch_path(spark, "sources")
    out = None
    for name, df in made.items():
        path = f"{base}/{name}.csv"
        labelled = _labelled(df)
        si.write_csv(labelled, path)
        read = ta.read_csv(spark, path, ta.schema_for(labelled.columns))
        one = read.agg(
            F.count(F.lit(1)).alias("row_count"),
            F.count_distinct("sector").alias("sectors"),
            F.min(ca.parse_month("month")).alias("first_month"),
            F.max(ca.parse_month("month")).alias("last_month"),
            F.round(F.sum("amount"), 2).alias("total"),
        ).select(F.lit(name).alias("source"), "*")
        out = one if out is None else out.unionByName(one)
    return out


# Each of the ten input tables: the subquery it is made from and the measure that is summed up.
_SOURCES = {
    "new_house": ("nh", "amount"),
    "new_house_nearby": ("nhnbr", "amount"),
    "pre_owned": ("po", "amount"),
    "pre_owned_nearby": ("ponbr", "amount"),
    "land": ("land", "amount"),
    "land_nearby": ("landnbr", "amount"),
    "poi": ("statics", "poi_max_price"),
    "city_indexes": ("city_indexes", "total_price"),
    "city_search": ("searches", "search_volume"),
    "test": ("test_ids", "CAST(length(id) AS DOUBLE)"),
}


@query(
    "scan_all_sources",
    "\nUNION ALL\n".join(
        f"SELECT '{name}' AS source, COUNT(*) AS row_count, COUNT({m}) AS filled, ROUND(SUM({m}), 2) AS total FROM {t}"
        for name, (t, m) in _SOURCES.items()
    ),
    tuple(t for t, _ in _SOURCES.values()),
)
def scan_all_sources(spark: SparkSession, d: str) -> DataFrame:
    """All ten input files, written as CSV under their names and read back by ``read_sources``."""
    cells = fx.source_cells(spark, d)
    made = {}
    for name, (made_from, _) in _SOURCES.items():
        if made_from in cells:
            table = cells[made_from]
            made[name] = _labelled(table.toDF(*[c.removeprefix(f"{made_from}_") for c in table.columns]))
    statics = fx.statics(spark, d)
    label = F.concat(F.lit("sector "), F.col(KEY).cast("string")).alias("sector")
    made["poi"] = statics.select(label, *[c for c in statics.columns if c not in (KEY, "given_cluster")])
    made["city_indexes"] = fx.city_indexes(spark, d).withColumnRenamed("data_year", "city_indicator_data_year")
    month = F.date_format(MONTH, "yyyy-MMM").alias("month")
    made["city_search"] = fx.searches(spark, d).select(month, "keyword", "source", "search_volume")
    made["test"] = fx.test_ids(spark, d)
    base = scratch_path(spark, "sources")
    for t in ta.SOURCE_TABLES:
        si.write_csv(made[t.name], f"{base}/{t.path}")
    out = []
    for name, read in ta.read_sources(spark, base).items():
        measure = F.expr(_SOURCES[name][1])
        found = read.agg(
            F.count(F.lit(1)).alias("row_count"), F.count(measure).alias("filled"), F.round(F.sum(measure), 2).alias("total")
        )
        out.append(found.select(F.lit(name).alias("source"), "*"))
    return reduce(DataFrame.unionByName, out)


@query(
    "scan_parquet",
    """
SELECT o_custkey + 1 AS sector_id, CAST(o_orderdate AS DATE) AS panel_month, o_totalprice AS amount
FROM orders
""",
)
def scan_parquet(spark: SparkSession, d: str) -> DataFrame:
    """A stored panel read back, its month a date again."""
    stored = spark.read.parquet(f"{d}/orders.parquet").select(
        (F.col("o_custkey") + 1).alias(KEY),
        F.col("o_orderdate").alias(MONTH),
        F.col("o_totalprice").alias("amount"),
    )
    path = scratch_path(spark, "panel")
    si.write_parquet(stored, path)
    return ta.read_panel(spark, path)


@query(
    "sink_parquet",
    """
SELECT CAST(year(panel_month) AS INTEGER) AS panel_year, COUNT(*) AS row_count, COUNT(amount) AS filled,
       ROUND(SUM(amount), 2) AS total
FROM panel GROUP BY 1
""",
    ("panel",),
)
def sink_parquet(spark: SparkSession, d: str) -> DataFrame:
    """The dense panel written by year, read back and counted."""
    path = scratch_path(spark, "panel")
    si.write_panel(fx.panel(spark, d), path)
    back = ta.read_panel(spark, path)
    return back.groupBy("panel_year").agg(
        F.count(F.lit(1)).alias("row_count"), F.count("amount").alias("filled"), F.round(F.sum("amount"), 2).alias("total")
    )


@query(
    "sink_csv",
    """
SELECT sector_id, panel_month, printf('%.6f', amount) AS amount, printf('%.6f', num) AS num FROM cells
""",
    ("cells",),
)
def sink_csv(spark: SparkSession, d: str) -> DataFrame:
    """Numbers written with six decimals, read back as the text that was printed."""
    path = scratch_path(spark, "cells_csv")
    si.write_csv(fx.cells(spark, d), path, decimals=6)
    schema = "sector_id bigint, panel_month date, amount string, num string"
    return spark.read.option("header", True).schema(schema).csv(path)


@query(
    "project_selected",
    """
SELECT sector_id, panel_month, num, poi_max_price, CAST(0.0 AS DOUBLE) AS absent_feature
FROM panel JOIN statics USING (sector_id)
""",
    ("panel", "statics"),
)
def project_selected(spark: SparkSession, d: str) -> DataFrame:
    """A feature list with the target and a repeat, as an ordered projection."""
    wide = fx.panel(spark, d).join(fx.statics(spark, d), KEY).withColumn("label", F.lit("text"))
    listed = ["num", "amount", "poi_max_price", "label", "num"]
    features = ar.numeric_features(wide, ar.model_features(listed, target="amount"))
    return ar.project_features(wide, [KEY, MONTH], [*features, "absent_feature"])


@query(
    "sector_index",
    """
SELECT 'sector ' || (c_custkey * 3 + 7) AS sector_label,
       row_number() OVER (ORDER BY c_custkey) AS sector_id
FROM customer
""",
)
def sector_index(spark: SparkSession, d: str) -> DataFrame:
    """Labels with gaps in their numbers get dense ids; saved and read back."""
    labels = fx.table(spark, d, "customer").select(
        F.concat(F.lit("sector "), (F.col("c_custkey") * 3 + 7).cast("string")).alias("sector_label")
    )
    path = scratch_path(spark, "sector_index")
    ar.write_sector_index(sc.sector_index(labels), path)
    return ar.read_sector_index(spark, path)


@query(
    "sector_union",
    """
SELECT DISTINCT 'sector ' || sector_id AS sector_label FROM (
  SELECT sector_id FROM nh UNION ALL SELECT sector_id FROM po UNION ALL SELECT sector_id FROM land
  UNION ALL SELECT sector_id FROM cust
  UNION ALL SELECT CAST(split_part(id, '_sector ', 2) AS BIGINT) FROM test_ids)
""",
    ("nh", "po", "land", "cust", "test_ids"),
)
def sector_union(spark: SparkSession, d: str) -> DataFrame:
    ids = fx.test_ids(spark, d).select(
        F.concat(F.lit("sector "), ca.id_sector("id").cast("string")).alias("sector")
    )
    tables = [_labelled(t) for t in (fx.new_house(spark, d), fx.pre_owned(spark, d), fx.land(spark, d))]
    customers = fx.sectors(spark, d).select(F.concat(F.lit("sector "), F.col(KEY).cast("string")).alias("sector"))
    return sc.sector_union([*tables, customers, ids])


# --- keys and calendar -----------------------------------------------------

_SPELLED = """
SELECT o_orderkey, CASE CAST(substr(o_orderpriority, 1, 1) AS INTEGER)
         WHEN 1 THEN strftime(o_orderdate, '%Y-%b') WHEN 2 THEN strftime(o_orderdate, '%Y %b')
         WHEN 3 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 4 THEN 'no month' END AS month_text, o_orderdate, o_orderpriority
FROM orders"""


@query(
    "month_parse",
    f"""
SELECT o_orderkey, month_text, CAST(CASE WHEN CAST(substr(o_orderpriority, 1, 1) AS INTEGER) <= 3
       THEN date_trunc('month', o_orderdate) END AS DATE) AS panel_month
FROM ({_SPELLED})
""",
)
def month_parse(spark: SparkSession, d: str) -> DataFrame:
    """Three spellings of a month, an unreadable one and a missing one."""
    kind = F.substring("o_orderpriority", 1, 1)
    text = (
        F.when(kind == "1", F.date_format("o_orderdate", "yyyy-MMM"))
        .when(kind == "2", F.date_format("o_orderdate", "yyyy MMM"))
        .when(kind == "3", F.date_format("o_orderdate", "yyyy-MM-dd"))
        .when(kind == "4", F.lit("no month"))
    )
    spelled = fx.table(spark, d, "orders").select("o_orderkey", text.alias("month_text"))
    return spelled.withColumn(MONTH, ca.parse_month("month_text"))


@query(
    "parse_ids",
    """
SELECT id, CAST(strptime(split_part(id, '_sector ', 1), '%Y %b') AS DATE) AS panel_month,
       CAST(split_part(id, '_sector ', 2) AS BIGINT) AS sector_id
FROM test_ids
""",
    ("test_ids",),
)
def parse_ids(spark: SparkSession, d: str) -> DataFrame:
    return fx.test_ids(spark, d).select("id", ca.id_month("id").alias(MONTH), ca.id_sector("id").alias(KEY))


@query(
    "keyword_slug",
    r"""
SELECT p_partkey, p_name || ' / ' || p_brand AS keyword,
       trim(regexp_replace(lower(p_name || ' / ' || p_brand), '[^\p{L}\p{N}]+', '_', 'g'), '_') AS keyword_slug,
       'keyword' AS empty_slug
FROM part
""",
)
def keyword_slug(spark: SparkSession, d: str) -> DataFrame:
    part = fx.table(spark, d, "part")
    words = part.select("p_partkey", F.concat_ws(" / ", "p_name", "p_brand").alias("keyword"))
    return tx.add_slug(words, "keyword", "keyword_slug").withColumn("empty_slug", tx.slug(F.lit("--")))


@query(
    "skeleton",
    f"""
SELECT sector_id, panel_month,
       CAST((year(panel_month) - 1995) * 12 + month(panel_month) - 1 AS INTEGER) AS month_idx,
       CAST(panel_month >= DATE '{fx.HORIZON}' AS INTEGER) AS is_future_horizon
FROM cust CROSS JOIN months
""",
    ("cust", "months"),
)
def skeleton(spark: SparkSession, d: str) -> DataFrame:
    return gr.skeleton(fx.sectors(spark, d), fx.START, fx.END, fx.HORIZON)


@query(
    "seasonality",
    """
SELECT o_orderkey, CAST(month(o_orderdate) AS INTEGER) AS month, CAST(quarter(o_orderdate) AS INTEGER) AS quarter,
       ROUND(sin(2 * pi() * month(o_orderdate) / 12), 6) AS month_sin,
       ROUND(cos(2 * pi() * month(o_orderdate) / 12), 6) AS month_cos
FROM orders
""",
)
def seasonality(spark: SparkSession, d: str) -> DataFrame:
    df = fx.table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    df = df.withColumns(ca.seasonality("o_orderdate")).drop("o_orderdate")
    return rounded(df, ["month_sin", "month_cos"])


# Holiday months.
HOLIDAYS = {"is_spring_festival": [1, 2], "is_may_day": [5], "is_golden_week": [10], "is_double11": [11]}


@query(
    "holiday_flags",
    """
SELECT o_orderkey, CAST(month(o_orderdate) IN (1, 2) AS INTEGER) AS is_spring_festival,
       CAST(month(o_orderdate) = 5 AS INTEGER) AS is_may_day, CAST(month(o_orderdate) = 10 AS INTEGER) AS is_golden_week,
       CAST(month(o_orderdate) = 11 AS INTEGER) AS is_double11
FROM orders
""",
)
def holiday_flags(spark: SparkSession, d: str) -> DataFrame:
    df = fx.table(spark, d, "orders")
    return df.select("o_orderkey", *[c.alias(n) for n, c in ca.holiday_flags("o_orderdate", HOLIDAYS).items()])


# --- scalar expressions ----------------------------------------------------


@query(
    "safe_ratio",
    """
SELECT sector_id, panel_month, n.amount / NULLIF(p.num - 1, 0) AS ratio, CAST(NULL AS DOUBLE) AS absent_ratio
FROM nh n FULL JOIN po p USING (sector_id, panel_month)
""",
    ("nh", "po"),
)
def safe_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Divisors that are zero and operands that are missing."""
    n = fx.new_house(spark, d).select(KEY, MONTH, "amount")
    p = fx.pre_owned(spark, d).select(KEY, MONTH, (F.col("num") - 1).alias("divisor"))
    joined = n.join(p, [KEY, MONTH], "full")
    return joined.select(
        KEY, MONTH, nu.safe_ratio("amount", "divisor").alias("ratio"), nu.safe_ratio("amount", None).alias("absent_ratio")
    )


@query(
    "log_roundtrip",
    """
SELECT o_orderkey, ROUND(ln(greatest(x, 0) + CAST(1e-3 AS DOUBLE)), 6) AS logged,
       ROUND(greatest(exp(ln(greatest(x, 0) + CAST(1e-3 AS DOUBLE))) - CAST(1e-3 AS DOUBLE), 0), 4) AS restored,
       CASE WHEN x IS NOT NULL THEN greatest(x, 100.0) END AS clipped
FROM (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice - 100000 END AS x FROM orders)
WHERE x IS NOT NULL
UNION ALL
SELECT o_orderkey, NULL, NULL, NULL FROM orders WHERE o_orderstatus = 'P'
""",
)
def log_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Negative, positive and missing values through the target transform and the clip."""
    x = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") - 100000)
    df = fx.table(spark, d, "orders").select("o_orderkey", x.alias("x"))
    return df.select(
        "o_orderkey",
        F.round(nu.log_target("x"), 6).alias("logged"),
        F.round(nu.inverse_log_target(nu.log_target("x")), 4).alias("restored"),
        nu.floored("x", 100.0).alias("clipped"),
    )


@query(
    "has_flags",
    """
SELECT sector_id, CAST(poi_resident_population IS NOT NULL AND poi_number_of_shops IS NOT NULL AS INTEGER) AS has_both,
       CAST(poi_catering IS NOT NULL AS INTEGER) AS has_catering, 0 AS has_nothing
FROM statics
""",
    ("statics",),
)
def has_flags(spark: SparkSession, d: str) -> DataFrame:
    flags = {
        "has_both": ["poi_resident_population", "poi_number_of_shops"],
        "has_catering": ["poi_catering"],
        "has_nothing": [],
    }
    return gr.add_presence_flags(fx.statics(spark, d), flags).select(KEY, *flags)


@query(
    "missing_flags",
    """
SELECT sector_id, panel_month, amount, amount AS amount_lag1, CAST(amount IS NULL AS INTEGER) AS missing_amount,
       0 AS missing_num
FROM panel
""",
    ("panel",),
)
def missing_flags(spark: SparkSession, d: str) -> DataFrame:
    """Derived columns get no flag, and a flag that exists is kept."""
    df = fx.panel(spark, d).withColumns({"amount_lag1": F.col("amount"), "missing_num": F.lit(0)})
    return gr.add_missing_flags(df, ["amount", "num", "amount_lag1"]).drop("num")


# --- merging ---------------------------------------------------------------

_SOURCE_SQL = ["nh", "po", "land", "nhnbr", "ponbr", "landnbr"]
_WITH_NUM = ("nh", "po")


def _merge_sql() -> str:
    columns, joins = [], []
    for s in _SOURCE_SQL:
        columns.append(f"{s}.amount AS {s}_amount")
        both = f"{s}.amount IS NOT NULL"
        if s in _WITH_NUM:
            columns.append(f"{s}.num AS {s}_num")
            both += f" AND {s}.num IS NOT NULL"
        columns.append(f"CAST({both} AS INTEGER) AS has_{s}")
        joins.append(f"LEFT JOIN {s} ON {s}.sector_id = c.sector_id AND {s}.panel_month = m.panel_month")
    return (
        "SELECT c.sector_id, m.panel_month, " + ",\n".join(columns) + "\nFROM cust c CROSS JOIN months m\n" + "\n".join(joins)
    )


def merged(spark: SparkSession, d: str) -> DataFrame:
    parts = fx.source_cells(spark, d)
    df = gr.dense_grid(fx.sectors(spark, d), parts, fx.START, fx.END)
    flags = {f"has_{name}": [c for c in t.columns if c not in (KEY, MONTH)] for name, t in parts.items()}
    return gr.add_presence_flags(df, flags)


@query("merge_sources", _merge_sql(), ("cust", "months", *_SOURCE_SQL))
def merge_sources(spark: SparkSession, d: str) -> DataFrame:
    """Six sparse tables on the full grid, with presence flags."""
    return merged(spark, d)


@query(
    "merge_static",
    """
SELECT sector_id, panel_month, amount, poi_number_of_shops, poi_resident_population,
       CAST(poi_number_of_shops IS NOT NULL AND poi_resident_population IS NOT NULL AS INTEGER) AS has_poi
FROM panel LEFT JOIN statics USING (sector_id)
""",
    ("panel", "statics"),
)
def merge_static(spark: SparkSession, d: str) -> DataFrame:
    statics = fx.statics(spark, d).select(KEY, "poi_number_of_shops", "poi_resident_population")
    return gr.merge_static(fx.panel(spark, d).drop("num"), statics)


@query(
    "merge_month_dim",
    """
SELECT sector_id, p.panel_month, p.amount, g.macro_total, CAST(g.macro_total IS NOT NULL AS INTEGER) AS has_macro
FROM panel p LEFT JOIN (
  SELECT panel_month, CAST(SUM(CAST(round(amount * 100) AS BIGINT)) AS DOUBLE) / 100 AS macro_total
  FROM cells WHERE month(panel_month) <> 12 GROUP BY panel_month) g ON g.panel_month = p.panel_month
""",
    ("panel", "cells"),
)
def merge_month_dim(spark: SparkSession, d: str) -> DataFrame:
    """City-wide totals, absent in December, joined to every sector."""
    totals = (
        fx.cells(spark, d)
        .where(F.month(MONTH) != 12)
        .groupBy(MONTH)
        .agg(fx.money(F.sum(fx.cents("amount"))).alias("macro_total"))
    )
    return gr.merge_months(fx.panel(spark, d).drop("num"), totals, "has_macro")


@query(
    "validate_panel",
    """
SELECT (SELECT COUNT(*) FROM cust) * (SELECT COUNT(*) FROM months) AS expected_rows, COUNT(*) AS panel_rows,
       COUNT(*) - COUNT(DISTINCT (sector_id, panel_month)) AS repeated_keys
FROM panel
""",
    ("cust", "months", "panel"),
)
def validate_panel(spark: SparkSession, d: str) -> DataFrame:
    return gr.panel_checks(fx.panel(spark, d), fx.sectors(spark, d), fx.START, fx.END)


# --- city-wide tables ------------------------------------------------------

_SEARCH_NAME = "'search_' || keyword || '_' || replace(source, ' ', '_')"
_NAMES = [f"search_{k}_{s}" for k in ("click", "error", "purchase", "signup", "view") for s in ("pc", "yi_dong")]


@query(
    "search_pivot",
    "SELECT panel_month, "
    + ", ".join(f"SUM(search_volume) FILTER (WHERE {_SEARCH_NAME} = '{n}') AS {n}" for n in _NAMES)
    + " FROM searches GROUP BY panel_month",
    ("searches",),
)
def search_pivot(spark: SparkSession, d: str) -> DataFrame:
    sums = materialize(ci.search_sums(fx.searches(spark, d)), "search_sums")
    return ci.search_wide(sums, ci.pivot_columns(sums))


# Texts of the test tables in other letters; two keywords become one.
_SPELLING = {"click": "Visit", "view": "visit", "yi dong": "mobile"}
_SPELT = [f"search_{k}_{s}" for k in ("error", "purchase", "signup", "visit") for s in ("mobile", "pc")]
_SPELT_NAME = "'search_' || CASE WHEN keyword IN ('click', 'view') THEN 'visit' ELSE keyword END || CASE source WHEN 'yi dong' THEN '_mobile' ELSE '_pc' END"


@query(
    "search_spelling",
    "SELECT panel_month, "
    + ", ".join(f"SUM(search_volume) FILTER (WHERE {_SPELT_NAME} = '{n}') AS {n}" for n in _SPELT)
    + ", "
    + ", ".join(f"COALESCE(SUM(search_volume) FILTER (WHERE regexp_replace({_SPELT_NAME}, '_[a-z]*$', '') = 'search_{k}'), 0.0) AS search_{k}_all" for k in ("error", "purchase", "signup", "visit"))
    + " FROM searches GROUP BY panel_month",
    ("searches",),
)
def search_spelling(spark: SparkSession, d: str) -> DataFrame:
    """Volumes and totals by transliterated keywords and sources."""
    spelling = spark.createDataFrame(list(_SPELLING.items()), "text string, latin string")
    searched = fx.searches(spark, d)
    sums = materialize(ci.search_sums(searched, spelling=spelling), "search_sums")
    totals = materialize(ci.search_totals(searched, spelling=spelling), "search_totals")
    return ci.search_wide(sums, ci.pivot_columns(sums)).join(ci.totals_wide(totals, ci.pivot_columns(totals)), MONTH)


_KEYWORDS = ("click", "error", "purchase", "signup", "view")


@query(
    "search_all",
    "SELECT panel_month, "
    + ", ".join(
        f"COALESCE(SUM(search_volume) FILTER (WHERE keyword = '{k}' AND source = '{source}'), 0.0) AS search_{k}{tail}_all"
        for k in _KEYWORDS
        for source, tail in (("pc", ""), ("yi dong", "_yi"))
    )
    + " FROM searches GROUP BY panel_month",
    ("searches",),
)
def search_all(spark: SparkSession, d: str) -> DataFrame:
    """Totals by the name minus its last token: a two-word source keeps its own."""
    totals = materialize(ci.search_totals(fx.searches(spark, d)), "search_totals")
    return ci.totals_wide(totals, ci.pivot_columns(totals))


@query(
    "search_surge",
    """
SELECT keyword, panel_month, search_volume, ROUND(level, 6) AS search_surge_level,
       COALESCE(CAST(search_volume > level AS INTEGER), 0) AS search_surge
FROM (SELECT *, CASE WHEN COUNT(search_volume) OVER w >= 3 THEN quantile_cont(search_volume, 0.75) OVER w END AS level
      FROM (SELECT keyword, panel_month, SUM(search_volume) AS search_volume FROM searches GROUP BY keyword, panel_month)
      WINDOW w AS (PARTITION BY keyword ORDER BY panel_month ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))
""",
    ("searches",),
)
def search_surge(spark: SparkSession, d: str) -> DataFrame:
    daily = fx.searches(spark, d).groupBy("keyword", MONTH).agg(F.sum("search_volume").alias("search_volume"))
    out = ci.add_surge(daily, "search_volume", ["keyword"], MONTH, "search_surge")
    return rounded(out, ["search_surge_level"])


@query(
    "dedupe_last",
    """
SELECT data_year, revision, total_price, order_count FROM city_indexes
QUALIFY row_number() OVER (PARTITION BY data_year ORDER BY revision DESC) = 1
""",
    ("city_indexes",),
)
def dedupe_last(spark: SparkSession, d: str) -> DataFrame:
    return ci.latest_rows(fx.city_indexes(spark, d), ["data_year"], ["revision"])


def yearly(spark: SparkSession, d: str) -> DataFrame:
    return ci.latest_rows(fx.city_indexes(spark, d), ["data_year"], ["revision"]).drop("revision")


LAST_YEAR, EXTRAPOLATED_FROM = 2003, 2001
_MACRO_SQL = f"""
SELECT make_date(y.y, m.m, 1) AS panel_month, total_price AS macro_total_price, order_count AS macro_order_count,
       CAST(y.y >= {EXTRAPOLATED_FROM} AS INTEGER) AS macro_is_extrapolated
FROM (SELECT CAST(unnest(generate_series(1995, {LAST_YEAR})) AS INTEGER) AS y) y
CROSS JOIN (SELECT CAST(unnest(generate_series(1, 12)) AS INTEGER) AS m) m
JOIN (SELECT *, LEAD(data_year) OVER (ORDER BY data_year) AS next_year FROM (
        SELECT * FROM city_indexes QUALIFY row_number() OVER (PARTITION BY data_year ORDER BY revision DESC) = 1)) t
  ON y.y >= t.data_year AND (t.next_year IS NULL OR y.y < t.next_year)"""


@query("macro_expand", _MACRO_SQL, ("city_indexes",))
def macro_expand(spark: SparkSession, d: str) -> DataFrame:
    """Years to months; the absent years 1997, 1999 and those after 2001 are carried."""
    return ci.expand_years(yearly(spark, d), "data_year", LAST_YEAR, EXTRAPOLATED_FROM)


MACRO = ["macro_total_price", "macro_order_count"]


def macro_months(spark: SparkSession, d: str) -> DataFrame:
    """The monthly indicators with interpolation and yearly growth: one row per month."""
    monthly = materialize(macro_expand(spark, d), "macro_months")
    return se.add_yoy(se.add_interpolation(monthly, MACRO, [], MONTH), MACRO, [], MONTH)


_INTERP = """
COALESCE({c}, ({b} - {a}) / NULLIF({bp} - {ap}, 0) * (pos - {ap}) + {a}, {a})"""


def interpolation_sql(source: str, key: str, columns: list[str]) -> str:
    part = f"PARTITION BY {key}" if key else ""
    marks = ", ".join(
        f"""last_value({c} IGNORE NULLS) OVER back AS {c}_a,
        last_value(CASE WHEN {c} IS NOT NULL THEN pos END IGNORE NULLS) OVER back AS {c}_ap,
        first_value({c} IGNORE NULLS) OVER ahead AS {c}_b,
        first_value(CASE WHEN {c} IS NOT NULL THEN pos END IGNORE NULLS) OVER ahead AS {c}_bp"""
        for c in columns
    )
    interp = ", ".join(
        _INTERP.format(c=c, a=f"{c}_a", b=f"{c}_b", ap=f"{c}_ap", bp=f"{c}_bp") + f" AS {c}_interp" for c in columns
    )
    return f"""
SELECT * EXCLUDE (pos, {', '.join(f'{c}_a, {c}_ap, {c}_b, {c}_bp' for c in columns)}), {interp}
FROM (SELECT *, {marks} FROM (
        SELECT *, row_number() OVER ({part} ORDER BY panel_month) AS pos FROM {source})
      WINDOW back AS ({part} ORDER BY panel_month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
             ahead AS ({part} ORDER BY panel_month ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


@query(
    "macro_yoy",
    "SELECT panel_month, macro_is_extrapolated, "
    + ", ".join(
        f"{c}, ROUND({c}_interp, 4) AS {c}_interp, "
        f"ROUND({c}_interp / NULLIF(LAG({c}_interp, 12) OVER (ORDER BY panel_month), 0) - 1, 6) AS {c}_yoy"
        for c in MACRO
    )
    + f" FROM ({interpolation_sql('(' + _MACRO_SQL + ')', '', MACRO)})",
    ("city_indexes",),
)
def macro_yoy(spark: SparkSession, d: str) -> DataFrame:
    out = rounded(macro_months(spark, d), [f"{c}_interp" for c in MACRO], 4)
    return rounded(out, [f"{c}_yoy" for c in MACRO])


# --- filters ---------------------------------------------------------------


@query(
    "train_cutoff",
    f"SELECT sector_id, panel_month, amount FROM cells WHERE panel_month <= DATE '{fx.TRAIN_END}' AND amount IS NOT NULL",
    ("cells",),
)
def train_cutoff(spark: SparkSession, d: str) -> DataFrame:
    return fo.training_rows(fx.panel(spark, d).drop("num"), fx.TRAIN_END, "amount")
