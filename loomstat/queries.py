"""The operators as queries on the driver's tables, each with its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import Derived, Thresholds
from .functions import columns as C
from .operators import correlate, density, groups, missing, outliers, panel, profile, quality, rules, transforms
from .operators.longform import to_long
from .operators.patterns import Patterns

T = Thresholds()
READINGS = ("r1", "r2", "r3")
LINE_COLUMNS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
LANGUAGES = {"en": "English", "fr": "French", "de": "German"}  # es is left unmapped
SIZE_BINS = ((0.0, 19.0, "01-19"), (19.0, 39.0, "20-39"), (39.0, 45.0, "40-45"))
VALUE_RANGE = {"value": (0.0, 25.0)}

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(sql: str):
    def registered(f):
        _QUERIES[f.__name__] = f
        _SQL[f.__name__] = sql
        return f

    return registered


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rounded(df: DataFrame, places: int = 4) -> DataFrame:
    return df.select(*(F.round(c, places).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


def readings_panel(spark: SparkSession, sf_dir: str, flags: bool = False) -> DataFrame:
    """One row a customer with up to three readings: mean price of urgent orders of status F, O and P, all from one aggregate."""
    urgent = _t(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT' and o_orderstatus in ('F', 'O', 'P')")
    means = (F.avg(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice"))).alias(r) for r, s in zip(READINGS, "FOP"))
    readings = urgent.groupBy(F.col("o_custkey").alias("c_custkey")).agg(*means)
    customers = _t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    return panel.left_join_chain(customers, {"readings": readings}, "c_custkey", flags)


PANEL = """panel AS (
  SELECT c.c_custkey, c.c_nationkey, c.c_acctbal, c.c_mktsegment, r1.r1, r2.r2, r3.r3 FROM customer c
  LEFT JOIN (SELECT o_custkey k, avg(o_totalprice) r1 FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' GROUP BY 1) r1 ON r1.k = c.c_custkey
  LEFT JOIN (SELECT o_custkey k, avg(o_totalprice) r2 FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'O' GROUP BY 1) r2 ON r2.k = c.c_custkey
  LEFT JOIN (SELECT o_custkey k, avg(o_totalprice) r3 FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P' GROUP BY 1) r3 ON r3.k = c.c_custkey)"""
LABELLED = "labelled AS (SELECT d.doc_id, d.lang, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"


def labelled(spark: SparkSession, sf_dir: str, flags: bool = False) -> DataFrame:
    documents = _t(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return panel.left_join_chain(documents, {"labels": _t(spark, sf_dir, "labels")}, "doc_id", flags)


# --- scans, checks, joins ---------------------------------------------------------------------


@_query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def scan_project(spark, sf_dir):
    return quality.require_columns(_t(spark, sf_dir, "orders"), ["o_orderkey"], "scan").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@_query(f"""WITH {PANEL} SELECT p.c_custkey, n.n_name, r.r_name, round(p.r1, 4) r1, round(p.r2, 4) r2, round(p.r3, 4) r3
  FROM panel p LEFT JOIN nation n ON n.n_nationkey = p.c_nationkey LEFT JOIN region r ON r.r_regionkey = n.n_regionkey""")
def left_join_chain(spark, sf_dir):
    nation = _t(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    found = panel.left_join_chain(readings_panel(spark, sf_dir), {"nation": nation}, "c_nationkey")
    region = _t(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    found = panel.left_join_chain(found, {"region": region}, "n_regionkey")
    return _rounded(found.select("c_custkey", "n_name", "r_name", *READINGS))


@_query("""SELECT l_orderkey, l_linenumber, count(*) n, count(*) - 1 n_surplus FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def key_uniqueness(spark, sf_dir):
    return quality.duplicate_keys(_t(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@_query("""SELECT CAST(sum(n) AS BIGINT) n_rows, count(*) n_keys, count(*) FILTER (n > 1) n_duplicate_keys,
  CAST(sum(n - 1) AS BIGINT) n_surplus, CAST(0 AS BIGINT) n_null_keys
  FROM (SELECT count(*) n FROM lineitem GROUP BY l_orderkey, l_linenumber)""")
def key_report(spark, sf_dir):
    return quality.key_report(_t(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@_query("""SELECT 'labels' dataset, count(l.doc_id) n_matched, count(*) - count(l.doc_id) n_unmatched,
  2 * (count(*) - count(l.doc_id)) n_added_nulls, count(l.toxic) n_last_col_present
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def join_match_report(spark, sf_dir):
    return panel.match_report(labelled(spark, sf_dir, flags=True), {"labels": ["quality", "toxic"]})


# --- cleaning rules -----------------------------------------------------------------------------


@_query("SELECT p_partkey, p_name, p_size FROM part WHERE p_size BETWEEN 20 AND 40")
def range_filter(spark, sf_dir):
    return transforms.range_filter(_t(spark, sf_dir, "part"), "p_size", 20, 40).select("p_partkey", "p_name", "p_size")


@_query(f"WITH {LABELLED} SELECT doc_id, quality, CASE WHEN quality IS NOT DISTINCT FROM 1 THEN n_chars END n_chars FROM labelled")
def null_unless_valid(spark, sf_dir):
    return transforms.null_unless_valid(labelled(spark, sf_dir), "quality", 1, ["n_chars"]).select("doc_id", "quality", "n_chars")


@_query(f"WITH {LABELLED} SELECT doc_id, toxic, CASE WHEN toxic IS DISTINCT FROM 1 THEN n_chars END n_chars FROM labelled")
def null_if_flagged(spark, sf_dir):
    return transforms.null_if_flagged(labelled(spark, sf_dir), "toxic", 1, ["n_chars"]).select("doc_id", "toxic", "n_chars")


@_query(f"""WITH {LABELLED} SELECT 'valid' AS variable, count(*) FILTER (n_chars IS NULL) n_null_before,
  count(*) FILTER (quality IS DISTINCT FROM 1) n_null_after, count(*) FILTER (quality IS DISTINCT FROM 1) - count(*) FILTER (n_chars IS NULL) n_nulled FROM labelled
  UNION ALL SELECT 'flagged', count(*) FILTER (n_chars IS NULL), count(*) FILTER (toxic = 1), count(*) FILTER (toxic = 1) - count(*) FILTER (n_chars IS NULL) FROM labelled""")
def null_change_counts(spark, sf_dir):
    both = labelled(spark, sf_dir).withColumns({"valid": F.col("n_chars"), "flagged": F.col("n_chars")})
    rule: dict[str, Column] = {"valid": C.null_unless(F.col("quality"), 1, F.col("valid")), "flagged": C.null_if(F.col("toxic"), 1, F.col("flagged"))}
    return transforms.null_changes(both, rule)


@_query(f"""WITH {PANEL} SELECT c_custkey, round((coalesce(r1, 0) + coalesce(r2, 0) + coalesce(r3, 0)) /
  nullif((r1 IS NOT NULL)::INT + (r2 IS NOT NULL)::INT + (r3 IS NOT NULL)::INT, 0), 4) reading,
  (r1 IS NOT NULL)::INT + (r2 IS NOT NULL)::INT + (r3 IS NOT NULL)::INT n_readings FROM panel""")
def row_mean_skipna(spark, sf_dir):
    averaged = transforms.average_readings(readings_panel(spark, sf_dir), {"reading": READINGS})
    return averaged.select("c_custkey", F.round("reading", 4).alias("reading"), C.count_present(*READINGS).alias("n_readings"))


@_query("""SELECT l_orderkey, l_partkey, l_linenumber, round(l_extendedprice * (1 - l_discount) / 405, 8) scaled_price,
  round(l_extendedprice / nullif(l_quantity, 0), 8) unit_price, round(l_extendedprice / nullif(l_discount, 0), 8) price_per_discount FROM lineitem""")
def derived_ratios(spark, sf_dir):
    made = transforms.derive(
        _t(spark, sf_dir, "lineitem"),
        [
            Derived("scaled_price", "l_extendedprice * (1 - l_discount) / 405.0D", ("l_extendedprice", "l_discount")),
            Derived("unit_price", "try_divide(l_extendedprice, l_quantity)", ("l_extendedprice", "l_quantity")),
            Derived("price_per_discount", "try_divide(l_extendedprice, l_discount)", ("l_extendedprice", "l_discount")),
        ],
    )
    return _rounded(made.select("l_orderkey", "l_partkey", "l_linenumber", "scaled_price", "unit_price", "price_per_discount"), 8)


# --- missing values ------------------------------------------------------------------------------

_PANEL_COLUMNS = ("c_acctbal", *READINGS)


@_query(f"""WITH {PANEL}, counts AS (""" + " UNION ALL ".join(f"SELECT '{c}' AS variable, count(*) - count({c}) missing_count, count({c}) present_count, count(*) n FROM panel" for c in _PANEL_COLUMNS) + """)
  SELECT variable, missing_count, round_even(missing_count * 100.0::DOUBLE / n, 2) missing_pct, present_count, missing_count * 100.0 / n > 40 is_high FROM counts""")
def missing_table(spark, sf_dir):
    return missing.missing_table(readings_panel(spark, sf_dir), _PANEL_COLUMNS, T.high_missing_pct)


@_query(f"""WITH {PANEL}, counts AS (""" + " UNION ALL ".join(f"SELECT '{c}' AS variable, count(*) - count({c}) missing_count, count({c}) present_count, count(*) n FROM panel" for c in _PANEL_COLUMNS) + """)
  SELECT variable, missing_count, round_even(missing_count * 100.0::DOUBLE / n, 2) missing_pct, variable IN ('r1', 'r2') AS expected FROM counts WHERE missing_count * 100.0 / n > 40""")
def expected_missing(spark, sf_dir):
    table = missing.missing_table(readings_panel(spark, sf_dir), _PANEL_COLUMNS, T.high_missing_pct)
    return missing.expected(table, ("r1", "r2")).select("variable", "missing_count", "missing_pct", "expected")


@_query(f"""WITH {PANEL} SELECT c_custkey, (c_acctbal IS NULL)::INT c_acctbal, (r1 IS NULL)::INT r1, (r2 IS NULL)::INT r2, (r3 IS NULL)::INT r3 FROM panel""")
def missing_indicator_matrix(spark, sf_dir):
    return missing.missing_matrix(readings_panel(spark, sf_dir), _PANEL_COLUMNS, keep=("c_custkey",))


@_query(f"""WITH {PANEL}, counts AS (SELECT count(*) n, 4 * count(*) - count(c_acctbal) - count(r1) - count(r2) - count(r3) m FROM panel)
  SELECT n n_rows, CAST(4 AS BIGINT) n_columns, 4 * n n_cells, m n_missing, round(m * 100.0::DOUBLE / (4 * n), 4) missing_pct FROM counts""")
def missing_cells(spark, sf_dir):
    return _rounded(missing.missing_cells(readings_panel(spark, sf_dir), _PANEL_COLUMNS))


@_query(f"""WITH {PANEL} SELECT (r1 IS NOT NULL)::INT + (r2 IS NOT NULL)::INT + (r3 IS NOT NULL)::INT n_readings, count(*) n_rows FROM panel GROUP BY 1""")
def readings_histogram(spark, sf_dir):
    return missing.readings_histogram(readings_panel(spark, sf_dir), READINGS)


@_query(f"""WITH {PANEL} SELECT count(*) n_rows, count(coalesce(r1, r2, r3)) n_any, count(r1 + r2 + r3) n_all, count(r1) n_first,
  count(coalesce(r1, r2, r3)) - count(r1) n_gained FROM panel""")
def coverage_report(spark, sf_dir):
    return missing.coverage(readings_panel(spark, sf_dir), READINGS)


_SETS = {"all": _PANEL_COLUMNS, "core": ("c_acctbal",), "first_two": ("r1", "r2"), "no_third": ("c_acctbal", "r1", "r2")}


@_query(f"""WITH {PANEL}""" + " UNION ALL ".join(f" SELECT '{s}' column_set, CAST({len(cs)} AS BIGINT) n_columns, count(*) FILTER ({' AND '.join(c + ' IS NOT NULL' for c in cs)}) n_complete, count(*) n_rows FROM panel" for s, cs in _SETS.items()))
def complete_cases(spark, sf_dir):
    return missing.complete_cases(readings_panel(spark, sf_dir), _SETS)


_INDICATORS = """ind AS (SELECT (r1 IS NULL)::INT::DOUBLE r1, (r2 IS NULL)::INT::DOUBLE r2, (r3 IS NULL)::INT::DOUBLE r3, (l.doc_id IS NULL)::INT::DOUBLE label
  FROM panel p LEFT JOIN labels l ON l.doc_id = p.c_custkey)"""
_PHI = " UNION ALL ".join(f"SELECT '{a}' variable_1, '{b}' variable_2, count(*) n_pairs, corr({a}, {b}) r FROM ind" for a, b in (("r1", "r2"), ("r1", "r3"), ("r1", "label"), ("r2", "r3"), ("r2", "label"), ("r3", "label")))


def _indicator_panel(spark, sf_dir):
    label = _t(spark, sf_dir, "labels").select(F.col("doc_id").alias("c_custkey"), F.col("quality").alias("label"))
    return panel.left_join_chain(readings_panel(spark, sf_dir), {"label": label}, "c_custkey")


@_query(f"WITH {PANEL}, {_INDICATORS} SELECT variable_1, variable_2, n_pairs, round(r, 6) r FROM ({_PHI}) WHERE r IS NOT NULL AND NOT isnan(r)")
def missing_corr(spark, sf_dir):
    return _rounded(missing.missing_corr(_indicator_panel(spark, sf_dir), (*READINGS, "label")), 6)


@_query("""WITH ind AS (SELECT (l.quality IS NULL)::INT::DOUBLE quality, (l.toxic IS NULL)::INT::DOUBLE toxic, (d.n_chars > 1000)::INT::DOUBLE n_long
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
  pairs AS (SELECT 'quality' variable_1, 'toxic' variable_2, corr(quality, toxic) r FROM ind UNION ALL SELECT 'n_long', 'quality', corr(n_long, quality) FROM ind UNION ALL SELECT 'n_long', 'toxic', corr(n_long, toxic) FROM ind)
  SELECT variable_1, variable_2, round_even(r, 3) AS "corr" FROM pairs WHERE abs(r) >= 0.70""")
def co_missing_pairs(spark, sf_dir):
    shown = labelled(spark, sf_dir).withColumn("n_long", F.when(F.col("n_chars") <= 1000, 1))
    return missing.co_missing(missing.missing_corr(shown, ("quality", "toxic", "n_long")), T.co_missing)


_PATTERN = " || ".join(f"(CASE WHEN {c} IS NULL THEN '1' ELSE '0' END)" for c in _PANEL_COLUMNS)
_MISSED = ", ".join(f"CASE WHEN {c} IS NULL THEN '{c}' END" for c in _PANEL_COLUMNS)


@_query(f"""WITH {PANEL} SELECT {_PATTERN} AS pattern, concat_ws(',', {_MISSED}) AS missing, count(*) n FROM panel GROUP BY 1, 2""")
def missing_patterns(spark, sf_dir):
    return Patterns.of(readings_panel(spark, sf_dir), _PANEL_COLUMNS).named()


@_query(f"WITH {PANEL}, {_INDICATORS} SELECT variable_1, variable_2, n_pairs, round(r, 6) r FROM ({_PHI}) WHERE r IS NOT NULL AND NOT isnan(r)")
def missing_corr_of_patterns(spark, sf_dir):
    return _rounded(Patterns.of(_indicator_panel(spark, sf_dir), (*READINGS, "label")).missing_corr(), 6)


@_query(f"""WITH {PANEL}""" + " UNION ALL ".join(f" SELECT '{s}' column_set, CAST({len(cs)} AS BIGINT) n_columns, count(*) FILTER ({' AND '.join(c + ' IS NOT NULL' for c in cs)}) n_complete, count(*) n_rows FROM panel" for s, cs in _SETS.items()))
def complete_cases_of_patterns(spark, sf_dir):
    return Patterns.of(readings_panel(spark, sf_dir), _PANEL_COLUMNS).complete_cases(_SETS)


# --- distributions -------------------------------------------------------------------------------


def _lines(spark, sf_dir):
    return to_long(_t(spark, sf_dir, "lineitem"), LINE_COLUMNS)


_LINES = "long AS (" + " UNION ALL ".join(f"SELECT '{c}' AS variable, {c}::DOUBLE AS value FROM lineitem" for c in LINE_COLUMNS) + ")"


@_query(f"""WITH {_LINES} SELECT variable, count(value) n_valid, round(avg(value), 4) mean, round(stddev_samp(value), 4) std, min(value) min, max(value) max,
  round(quantile_cont(value, 0.25), 4) p25, round(quantile_cont(value, 0.5), 4) median, round(quantile_cont(value, 0.75), 4) p75 FROM long GROUP BY variable""")
def describe_features(spark, sf_dir):
    return _rounded(profile.describe(_lines(spark, sf_dir)))


_SHAPES = " UNION ALL ".join(
    [f"SELECT '{c}' AS variable, count({c}) n_valid, skewness({c}::DOUBLE) s, kurtosis({c}::DOUBLE) k FROM lineitem" for c in LINE_COLUMNS]
    + ["SELECT 'value', count(value), skewness(value), kurtosis(value) FROM events"]
)


def _shapes(spark, sf_dir):
    values = to_long(_t(spark, sf_dir, "events"), ["value"])
    return profile.shape(_lines(spark, sf_dir).unionByName(values))


@_query(f"SELECT variable, n_valid, round(s, 4) skewness, round(k, 4) kurtosis FROM ({_SHAPES})")
def shape_moments(spark, sf_dir):
    return _rounded(_shapes(spark, sf_dir))


@_query(f"""SELECT variable, round(s, 4) skewness, CASE WHEN abs(s) > 2 THEN 'HEAVILY SKEWED (' || CASE WHEN s > 0 THEN 'right' ELSE 'left' END || ')'
  WHEN abs(s) > 1 THEN 'Moderately skewed (' || CASE WHEN s > 0 THEN 'right' ELSE 'left' END || ')' ELSE 'Approximately symmetric' END skew_class FROM ({_SHAPES})""")
def skew_class(spark, sf_dir):
    shown = _shapes(spark, sf_dir)
    return shown.select("variable", F.round("skewness", 4).alias("skewness"), C.skew_class(F.col("skewness"), T.heavy_skew, T.moderate_skew).alias("skew_class"))


@_query("""SELECT l_partkey, round(quantile_cont(l_extendedprice::DOUBLE, 0.05), 4) p05, round(quantile_cont(l_extendedprice::DOUBLE, 0.5), 4) median,
  round(quantile_cont(l_extendedprice::DOUBLE, 0.95), 4) p95 FROM lineitem GROUP BY l_partkey""")
def quantiles_of_many_groups(spark, sf_dir):
    prices = _t(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_extendedprice").cast("double").alias("value"))
    found = profile.quantiles(prices, (0.05, 0.5, 0.95), ["l_partkey"], in_memory=0)  # by radix selection
    return _rounded(found.select("l_partkey", *(F.col("q")[k].alias(name) for k, name in enumerate(("p05", "median", "p95")))))


@_query(f"""WITH {_LINES} SELECT variable, round(quantile_cont(value, 0.25), 4) q1, round(quantile_cont(value, 0.5), 4) median, round(quantile_cont(value, 0.75), 4) q3 FROM long GROUP BY variable""")
def quantiles_by_radix(spark, sf_dir):
    found = profile.quantiles(_lines(spark, sf_dir), in_memory=0)
    return _rounded(found.select("variable", *(F.col("q")[k].alias(name) for k, name in enumerate(("q1", "median", "q3")))))


_FENCES = """fences AS (SELECT quantile_cont(value::DOUBLE, 0.25) q1, quantile_cont(value::DOUBLE, 0.75) q3, quantile_cont(value::DOUBLE, 0.5) median FROM events)"""


def _values(spark, sf_dir):
    return to_long(_t(spark, sf_dir, "events"), ["value"])


@_query(f"""WITH {_FENCES} SELECT 'value' AS variable, (SELECT count(value) FROM events) n_valid, round(q1, 4) q1, round(q3, 4) q3, round(q3 - q1, 4) iqr, round(q1 - 1.5 * (q3 - q1), 4) lower_mild,
  round(q3 + 1.5 * (q3 - q1), 4) upper_mild, round(q1 - 3 * (q3 - q1), 4) lower_extreme, round(q3 + 3 * (q3 - q1), 4) upper_extreme,
  (SELECT round(min(value), 4) FROM events) min_value, (SELECT round(max(value), 4) FROM events) max_value FROM fences""")
def tukey_fences(spark, sf_dir):
    return _rounded(outliers.fences(_values(spark, sf_dir), T.mild_fence, T.extreme_fence))


@_query("""SELECT min(p_size)::INT min, max(p_size)::INT max, round_even(avg(p_size::DOUBLE), 1) mean, quantile_cont(p_size::DOUBLE, 0.5) median FROM part""")
def age_scalars(spark, sf_dir):
    return profile.scalars(_t(spark, sf_dir, "part"), "p_size")


@_query("""WITH long AS (SELECT 'p_size' AS variable, p_size::DOUBLE AS value FROM part UNION ALL SELECT 'n_nationkey', n_nationkey::DOUBLE FROM nation UNION ALL SELECT 'r_regionkey', r_regionkey::DOUBLE FROM region)
  SELECT variable, count(value) n_valid, quantile_cont(value, 0.25) q1, quantile_cont(value, 0.75) q3 FROM long GROUP BY variable HAVING count(value) >= 10""")
def enough_values(spark, sf_dir):
    tables = (("part", "p_size"), ("nation", "n_nationkey"), ("region", "r_regionkey"))
    first, *others = (to_long(_t(spark, sf_dir, name), [column]) for name, column in tables)
    for other in others:
        first = first.unionByName(other)
    return outliers.fences(first, min_values=T.min_values).select("variable", "n_valid", "q1", "q3")


@_query("""SELECT 'string' AS type, CAST(3 AS BIGINT) n_columns, count(text) + count(lang) + count(source) n_values,
  CAST(sum(coalesce(strlen(text), 0) + coalesce(strlen(lang), 0) + coalesce(strlen(source), 0)) AS BIGINT) n_bytes FROM documents
  UNION ALL SELECT 'bigint', 2, count(doc_id) + count(n_chars), 8 * (count(doc_id) + count(n_chars)) FROM documents""")
def type_frequency(spark, sf_dir):
    return profile.type_frequency(_t(spark, sf_dir, "documents"))


_BEYOND = f"""{_FENCES}, met AS (SELECT value, value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) mild, value < q1 - 3 * (q3 - q1) OR value > q3 + 3 * (q3 - q1) far,
  CASE WHEN value BETWEEN 0 AND 25 THEN 'p' WHEN value < 0 OR value > 50 THEN 'r' ELSE 's' END kind FROM events, fences WHERE value IS NOT NULL)"""


@_query(f"""WITH {_BEYOND} SELECT 'value' AS variable, count(*) n_valid, count(*) FILTER (mild) n_mild_outliers, round_even(count(*) FILTER (mild) * 100.0::DOUBLE / count(*), 2) pct_mild,
  count(*) FILTER (far) n_extreme_outliers, round_even(count(*) FILTER (far) * 100.0::DOUBLE / count(*), 2) pct_extreme FROM met""")
def outlier_counts(spark, sf_dir):
    found = outliers.outlier_counts(_values(spark, sf_dir), VALUE_RANGE, T.mild_fence, T.extreme_fence)
    return found.select("variable", "n_valid", "n_mild_outliers", "pct_mild", "n_extreme_outliers", "pct_extreme")


@_query(f"""WITH {_BEYOND} SELECT 'value' AS variable, count(*) FILTER (far AND kind = 'p') n_plausible, count(*) FILTER (far AND kind = 's') n_suspicious,
  count(*) FILTER (far AND kind = 'r') n_requires_inv FROM met""")
def plausibility_counts(spark, sf_dir):
    found = outliers.outlier_counts(_values(spark, sf_dir), VALUE_RANGE, T.mild_fence, T.extreme_fence)
    return found.select("variable", "n_plausible", "n_suspicious", "n_requires_inv")


@_query("""WITH ends AS (SELECT min(value) lo, max(value) hi, (max(value) - min(value)) / 40.0::DOUBLE w FROM events),
  counts AS (SELECT least(floor((value - lo) / w), 39)::INT bin, count(*) n FROM events, ends WHERE value IS NOT NULL GROUP BY 1)
  SELECT b.bin::INT bin, round(lo + b.bin * w, 6) low, round(lo + (b.bin + 1) * w, 6) high, coalesce(n, 0) n FROM range(40) b(bin) CROSS JOIN ends LEFT JOIN counts c ON c.bin = b.bin""")
def histogram_bins(spark, sf_dir):
    return _rounded(profile.histogram(_t(spark, sf_dir, "events"), "value", 40), 6)


@_query("""WITH q AS (SELECT event_type, quantile_cont(value::DOUBLE, 0.25) q1, quantile_cont(value::DOUBLE, 0.5) median, quantile_cont(value::DOUBLE, 0.75) q3 FROM events GROUP BY 1)
  SELECT e.event_type, round(q1, 4) q1, round(median, 4) median, round(q3, 4) q3, count(value) n_valid,
  round(min(CASE WHEN value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN value END), 4) whisker_low,
  round(max(CASE WHEN value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN value END), 4) whisker_high,
  count(*) FILTER (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) n_fliers
  FROM events e JOIN q ON q.event_type = e.event_type GROUP BY e.event_type, q1, median, q3""")
def box_stats(spark, sf_dir):
    return _rounded(profile.box_stats(_t(spark, sf_dir, "events"), "value", ["event_type"]))


@_query("""WITH q AS (SELECT event_type, quantile_cont(value::DOUBLE, 0.25) q1, quantile_cont(value::DOUBLE, 0.75) q3 FROM events GROUP BY 1)
  SELECT e.event_type, round(value, 4) AS value, CASE WHEN value < q1 THEN 'low' ELSE 'high' END side, count(*) n FROM events e JOIN q ON q.event_type = e.event_type
  WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) GROUP BY e.event_type, value, q1""")
def box_fliers(spark, sf_dir):
    return _rounded(profile.fliers(_t(spark, sf_dir, "events"), "value", ["event_type"]))


_MANY = "long AS (" + " UNION ALL ".join([f"SELECT '{c}' AS variable, {c}::DOUBLE AS value FROM lineitem" for c in LINE_COLUMNS] + ["SELECT 'value', value::DOUBLE FROM events"]) + ")"


def _many(spark, sf_dir):
    return _lines(spark, sf_dir).unionByName(_values(spark, sf_dir))


@_query(f"""WITH {_MANY}, ends AS (SELECT variable, count(value) n, min(value) lo, max(value) hi, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) iqr FROM long GROUP BY variable),
  widths AS (SELECT *, (hi - lo) / (log2(n) + 1) sturges, 2 * iqr / pow(n, 1.0::DOUBLE / 3) fd FROM ends),
  bins AS (SELECT variable, lo, CAST(least(ceil((hi - lo) / CASE WHEN fd > 0 AND fd < sturges THEN fd ELSE sturges END), 10000) AS INTEGER) bins, hi - lo AS span FROM widths),
  counts AS (SELECT l.variable, least(floor((value - lo) / (span / bins)), bins - 1)::INT bin, count(*) n FROM long l JOIN bins b ON b.variable = l.variable WHERE value IS NOT NULL GROUP BY 1, 2),
  every AS (SELECT variable, lo, span / bins w, unnest(range(bins))::INT bin FROM bins)
  SELECT e.variable, e.bin, round(lo + e.bin * w, 6) low, round(lo + (e.bin + 1) * w, 6) high, coalesce(n, 0) n FROM every e LEFT JOIN counts c ON c.variable = e.variable AND c.bin = e.bin""")
def histogram_auto_bins(spark, sf_dir):
    return _rounded(density.auto_histogram(_many(spark, sf_dir)), 6)


_GRID = 128  # points of the curve that SQL draws too


@_query(f"""WITH {_MANY}, ends AS (SELECT variable, count(value) n, min(value) lo, max(value) hi, stddev_samp(value) / pow(count(value), 0.2) h FROM long WHERE value IS NOT NULL GROUP BY variable),
  frame AS (SELECT variable, n, h, lo - 4 * h AS lo, (hi - lo + 8 * h) / {_GRID - 1} AS step FROM ends),
  shared AS (SELECT l.variable, least(floor((value - lo) / step), {_GRID - 2})::INT g, (value - lo) / step AS place FROM long l JOIN frame f ON f.variable = l.variable WHERE value IS NOT NULL),
  parts AS (SELECT variable, g, sum(1 - (place - g)) w FROM shared GROUP BY 1, 2 UNION ALL SELECT variable, g + 1, sum(place - g) FROM shared GROUP BY 1, 2),
  weights AS (SELECT variable, g, sum(w) w FROM parts GROUP BY 1, 2)
  SELECT f.variable, p.point::INT point, round(lo + p.point * step, 4) x, round(h * sum(w * exp(-pow((p.point - g) * step / h, 2) / 2)) / (n * h * sqrt(2 * pi())), 6) scaled_density,
    round(h, 6) bandwidth, round(pow(step / h, 2) / (8 * sqrt(2 * pi())), 6) scaled_bound
  FROM frame f JOIN weights w ON w.variable = f.variable CROSS JOIN range({_GRID}) p(point) GROUP BY f.variable, p.point, lo, step, h, n""")
def density_curve(spark, sf_dir):
    curve = density.density(_many(spark, sf_dir), grid=_GRID)  # densities in units of the bandwidth, which are alike for all variables
    h = F.col("bandwidth")
    return curve.select("variable", "point", F.round("x", 4).alias("x"), F.round(F.col("density") * h, 6).alias("scaled_density"), F.round(h, 6).alias("bandwidth"), F.round(F.col("error_bound") * h, 6).alias("scaled_bound"))


# --- correlations --------------------------------------------------------------------------------

_CORR_COLUMNS = (*LINE_COLUMNS, "net_price")
_PAIRS = [(a, b) for k, a in enumerate(_CORR_COLUMNS) for b in _CORR_COLUMNS[k + 1 :]]
_CORR = "net AS (SELECT *, l_extendedprice * (1 - l_discount) net_price FROM lineitem), pairs AS (" + " UNION ALL ".join(
    f"SELECT '{a}' variable_1, '{b}' variable_2, CAST(regr_count({a}, {b}) AS BIGINT) n_pairs, corr({a}, {b}) r FROM net" for a, b in _PAIRS
) + ")"


def _line_pairs(spark, sf_dir):
    net = _t(spark, sf_dir, "lineitem").withColumn("net_price", F.expr("l_extendedprice * (1 - l_discount)"))
    return correlate.pearson(net, _CORR_COLUMNS, T.min_pairs)


@_query(f"WITH {_CORR} SELECT variable_1, variable_2, n_pairs, round(r, 6) r FROM pairs")
def pearson_matrix(spark, sf_dir):
    return _rounded(_line_pairs(spark, sf_dir), 6)


@_query(f"""WITH {_CORR} SELECT variable_1, variable_2, round_even(r, 4) pearson_r, round_even(abs(r), 4) abs_r,
  CASE WHEN abs(r) >= 0.9 THEN 'VERY HIGH' ELSE 'HIGH' END AS "level" FROM pairs WHERE abs(r) >= 0.75 AND n_pairs >= 30""")
def high_corr_pairs(spark, sf_dir):
    return correlate.high_pairs(_line_pairs(spark, sf_dir), T.high_corr, T.very_high_corr)


@_query(f"""WITH {PANEL} """ + " UNION ALL ".join(f"SELECT '{a}' variable_1, '{b}' variable_2, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) n_pairs, CASE WHEN count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) >= 30 THEN round(corr({a}, {b}), 6) END r FROM panel" for a, b in (("r1", "r2"), ("r1", "r3"), ("r2", "r3"))))
def pairwise_null_corr(spark, sf_dir):
    return _rounded(correlate.pearson(readings_panel(spark, sf_dir), READINGS, T.min_pairs), 6)


_ODD = {
    "quantity": "CAST(l_quantity AS DOUBLE)",
    "price": "CASE WHEN l_partkey % 7 = 0 THEN CAST('NaN' AS DOUBLE) WHEN l_partkey % 11 > 0 THEN l_extendedprice END",
    "tax": "CASE WHEN l_partkey % 501 = 3 THEN CAST('Infinity' AS DOUBLE) WHEN l_partkey % 501 = 5 THEN CAST('-Infinity' AS DOUBLE) ELSE l_tax END",
    "discount": "CASE WHEN l_partkey % 501 > 5 THEN l_discount WHEN l_partkey % 2 = 0 THEN CAST('NaN' AS DOUBLE) END",
    "constant": "CASE WHEN l_partkey % 5 = 0 THEN 2.5D END",
}
_SQL_ODD = "odd AS (SELECT " + ", ".join(f"CASE WHEN isnan(({sql})) THEN NULL ELSE ({sql}) END AS {c}" for c, sql in ((c, x.replace("2.5D", "2.5::DOUBLE")) for c, x in _ODD.items())) + " FROM lineitem)"


@_query(f"WITH {_SQL_ODD} " + " UNION ALL ".join(
    f"""SELECT '{a}' variable_1, '{b}' variable_2, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) n_pairs,
  CASE WHEN count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL AND (isinf({a}) OR isinf({b}))) = 0 AND '{b}' <> 'constant' THEN round(corr(CASE WHEN isfinite({a}) THEN {a} END, CASE WHEN isfinite({b}) THEN {b} END), 6) END r FROM odd"""
    for k, a in enumerate(_ODD) for b in list(_ODD)[k + 1 :]))
def pearson_nonfinite(spark, sf_dir):
    odd = _t(spark, sf_dir, "lineitem").select(*(F.expr(sql).alias(c) for c, sql in _ODD.items()))
    return _rounded(correlate.pearson(odd, _ODD, T.min_pairs), 6)


_BLOCK_COLUMNS = (*LINE_COLUMNS, "net_price", "charge", "unit_price", "l_linenumber", "suppkey", "returned")
_BLOCK = "wide AS (SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_extendedprice * (1 - l_discount) net_price, l_extendedprice * (1 - l_discount) * (1 + l_tax) charge, l_extendedprice / nullif(l_quantity, 0) unit_price, l_linenumber::DOUBLE l_linenumber, CASE WHEN l_suppkey % 3 > 0 THEN l_suppkey::DOUBLE END suppkey, CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE WHEN l_returnflag = 'A' THEN 0.0::DOUBLE END returned FROM lineitem)"


def _wide_lines(spark, sf_dir):
    made = {
        "net_price": "l_extendedprice * (1 - l_discount)",
        "charge": "l_extendedprice * (1 - l_discount) * (1 + l_tax)",
        "unit_price": "try_divide(l_extendedprice, l_quantity)",
        "suppkey": "CASE WHEN l_suppkey % 3 > 0 THEN l_suppkey END",
        "returned": "CASE l_returnflag WHEN 'R' THEN 1.0D WHEN 'A' THEN 0.0D END",
    }
    return _t(spark, sf_dir, "lineitem").withColumns({name: F.expr(sql) for name, sql in made.items()})


@_query(f"WITH {_BLOCK} " + " UNION ALL ".join(f"SELECT '{a}' variable_1, '{b}' variable_2, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) n_pairs, round(corr({a}, {b}), 6) r FROM wide" for k, a in enumerate(_BLOCK_COLUMNS) for b in _BLOCK_COLUMNS[k + 1 :]))
def pearson_many_columns(spark, sf_dir):
    return _rounded(correlate.pearson(_wide_lines(spark, sf_dir), _BLOCK_COLUMNS, T.min_pairs), 6)


_SQUARE = ", ".join(f"round(max(CASE WHEN variable_2 = '{c}' THEN r END), 6) AS \"{c}\"" for c in _CORR_COLUMNS)


@_query(f"""WITH {_CORR}, both_ways AS (SELECT variable_1, variable_2, r FROM pairs UNION ALL SELECT variable_2, variable_1, r FROM pairs""" + "".join(f" UNION ALL SELECT '{c}', '{c}', 1.0::DOUBLE" for c in _CORR_COLUMNS) + f""")
  SELECT variable_1 AS variable, {_SQUARE} FROM both_ways GROUP BY variable_1""")
def correlation_square(spark, sf_dir):
    return _rounded(correlate.matrix(_line_pairs(spark, sf_dir), _CORR_COLUMNS), 6)


_NOTES = {frozenset({"l_extendedprice", "net_price"}): "the net price is computed from the price", frozenset({"l_tax", "l_discount"}): "both are rates"}


@_query(f"""WITH {_CORR} SELECT variable_1, variable_2, round_even(r, 4) pearson_r, CASE WHEN abs(r) >= 0.9 THEN 'VERY HIGH' ELSE 'HIGH' END AS "level",
  CASE WHEN least(variable_1, variable_2) = 'l_extendedprice' AND greatest(variable_1, variable_2) = 'net_price' THEN 'the net price is computed from the price'
  WHEN least(variable_1, variable_2) = 'l_discount' AND greatest(variable_1, variable_2) = 'l_tax' THEN 'both are rates' END note FROM pairs WHERE abs(r) >= 0.75 AND n_pairs >= 30""")
def pair_notes(spark, sf_dir):
    high = correlate.high_pairs(_line_pairs(spark, sf_dir), T.high_corr, T.very_high_corr)
    return correlate.noted(high, _NOTES).select("variable_1", "variable_2", "pearson_r", "level", "note")


# --- groups --------------------------------------------------------------------------------------

_LANG_CASE = "CASE lang " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LANGUAGES.items()) + " END"


@_query(f"SELECT {_LANG_CASE} AS language, count(*) n FROM documents WHERE {_LANG_CASE} IS NOT NULL GROUP BY 1")
def label_map_freq(spark, sf_dir):
    return groups.frequency(_t(spark, sf_dir, "documents").select(C.label_of(F.col("lang"), LANGUAGES).alias("language")), "language")


@_query(f"WITH {LABELLED} SELECT quality, count(*) n FROM labelled GROUP BY quality")
def code_freq_with_nulls(spark, sf_dir):
    return groups.code_frequency(labelled(spark, sf_dir), "quality")


@_query("""WITH b AS (SELECT CASE WHEN p_size > 0 AND p_size <= 19 THEN '01-19' WHEN p_size > 19 AND p_size <= 39 THEN '20-39' WHEN p_size > 39 AND p_size <= 45 THEN '40-45' END size_bin FROM part)
  SELECT size_bin, count(*) n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM b), 4) pct FROM b WHERE size_bin IS NOT NULL GROUP BY size_bin""")
def age_bins(spark, sf_dir):
    return _rounded(groups.label_shares(_t(spark, sf_dir, "part").select(C.bin_of(F.col("p_size"), SIZE_BINS).alias("size_bin")), "size_bin"))


@_query(" UNION ALL ".join(f"SELECT '{c}' AS variable, round(avg({c}) FILTER (l_returnflag = 'A'), 4) AS \"A\", round(avg({c}) FILTER (l_returnflag = 'N'), 4) AS \"N\", round(avg({c}) FILTER (l_returnflag = 'R'), 4) AS \"R\" FROM lineitem" for c in LINE_COLUMNS))
def group_means(spark, sf_dir):
    return _rounded(groups.group_means(_t(spark, sf_dir, "lineitem"), LINE_COLUMNS, "l_returnflag", ["A", "N", "R"]))


@_query("WITH means AS (" + " UNION ALL ".join(f"SELECT '{c}' AS variable, round_even(avg({c}) FILTER (l_returnflag = 'A'), 3) a, round_even(avg({c}) FILTER (l_returnflag = 'R'), 3) r FROM lineitem" for c in LINE_COLUMNS) + """)
  SELECT variable, round(a, 3) AS "A", round(r, 3) AS "R", round((a - r) * 100 / nullif(r, 0), 4) diff_pct FROM means""")
def group_diff_pct(spark, sf_dir):
    means = groups.group_means(_t(spark, sf_dir, "lineitem"), LINE_COLUMNS, "l_returnflag", ["A", "R"])
    return groups.group_diff_pct(means, "A", "R").select("variable", "A", "R", F.round("diff_pct", 4).alias("diff_pct"))


_MEASURES = """count({c}) n_valid, round(avg({c}), 4) mean, round(stddev_samp({c}), 4) std, round(min({c}), 4) min, round(max({c}), 4) max,
  round(quantile_cont({c}::DOUBLE, 0.25), 4) q1, round(quantile_cont({c}::DOUBLE, 0.5), 4) median, round(quantile_cont({c}::DOUBLE, 0.75), 4) q3"""


@_query("WITH labelled AS (SELECT *, CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS flag, CAST(l_linenumber AS VARCHAR) AS line FROM lineitem) " + " UNION ALL ".join(
    f"""SELECT CASE GROUPING(flag) * 2 + GROUPING(line) WHEN 3 THEN 'all' WHEN 1 THEN 'flag' ELSE 'line' END label_set, coalesce(flag, line) AS label, count(*) n_rows, '{c}' AS variable, {_MEASURES.format(c=c)}
  FROM labelled GROUP BY GROUPING SETS ((), (flag), (line))""" for c in LINE_COLUMNS))
def label_sets(spark, sf_dir):
    lines = _t(spark, sf_dir, "lineitem").withColumns({"flag": F.expr("CASE WHEN l_returnflag <> 'N' THEN l_returnflag END"), "line": F.col("l_linenumber").cast("string")})
    return _rounded(groups.label_sets(lines, LINE_COLUMNS, ["flag", "line"]))


# --- rules ---------------------------------------------------------------------------------------


_FOUND = f"""found AS (SELECT 'distributions' AS source, '007' AS decision, (SELECT count(*) FROM shapes WHERE abs(s) > 2) n_found
  UNION ALL SELECT 'outliers', '007', CAST((SELECT count(*) FROM met WHERE far AND kind = 'r') > 0 AS BIGINT)
  UNION ALL SELECT 'correlations', '008', (SELECT count(*) FROM pairs WHERE n_pairs > 0 AND variable_1 = 'l_extendedprice' AND variable_2 = 'net_price'))"""


@_query(f"""WITH {_CORR}, shapes AS ({_SHAPES}), {_BEYOND}, {_FOUND} SELECT source, decision, n_found, n_found > 0 AS applies FROM found""")
def recommendations(spark, sf_dir):
    beyond = outliers.outlier_counts(_values(spark, sf_dir), VALUE_RANGE, T.mild_fence, T.extreme_fence)
    return rules.applied(_shapes(spark, sf_dir), beyond, _line_pairs(spark, sf_dir), [("l_extendedprice", "net_price")], T.heavy_skew)
