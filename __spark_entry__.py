"""

Every query reads the driver's parquet tables under ``sf_dir`` (whole tables; the derived
views below only inject deterministic defects with plain key arithmetic, see FIXTURES.md)
and runs one library operator. ``oracle_sql`` gives the same computation for DuckDB with
the same column names; doubles are rounded to 6 decimals on both sides.
"""

from __future__ import annotations

import importlib
import os
import sys
import uuid
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

SF_SMOKE = "/root/testdata/sf0.001"

_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def deco(fn):
        _Q[name] = fn
        if sql is not None:
            _SQL[name] = " ".join(sql.split())
        return fn

    return deco


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    from tamis.session import workers_find_package

    workers_find_package(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(c):
    return F.round(c, 6)


def _prep(spark: SparkSession):
    from tamis.session import checkpoint_dir

    checkpoint_dir(spark)
    import tamis.operators  # noqa: F401


# ---- derived inputs (FIXTURES.md §2), in Spark and in SQL -------------------------------------


def orders_missing(spark, sf):
    o = _t(spark, sf, "orders")
    k = F.col("o_orderkey")
    return o.select(
        "o_orderkey",
        "o_custkey",
        F.when(k % 11 != 0, F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(k % 7 != 0, F.col("o_totalprice")).alias("o_totalprice"),
        "o_orderdate",
        F.when(k % 10 >= 6, F.col("o_orderpriority")).alias("o_orderpriority"),
    )


def orders_dups(spark, sf):
    o = _t(spark, sf, "orders")
    return o.unionByName(o.where(F.col("o_orderkey") % 20 == 0))


def events_gaps(spark, sf):
    e = _t(spark, sf, "events")
    return e.where(~F.hour("ts").isin(3, 4)).withColumn("value", F.when(F.col("event_id") % 5 != 0, F.col("value")))


def events_nulls(spark, sf):
    e = _t(spark, sf, "events")
    return e.withColumn("value", F.when(F.col("event_id") % 5 != 0, F.col("value")))


def events_nan(spark, sf):
    e, k = _t(spark, sf, "events"), F.col("event_id")
    return e.withColumn("value", F.when(k % 5 == 0, F.lit(float("nan"))).when(k % 7 != 0, F.col("value").cast("double")))


def events_outliers(spark, sf):
    e = _t(spark, sf, "events")
    return e.withColumn("value", F.when(F.col("event_id") % 97 == 0, F.col("value") * 50).otherwise(F.col("value")))


def part_messy(spark, sf):
    p = _t(spark, sf, "part")
    messy = F.concat(F.lit("  "), F.replace(F.upper("p_name"), F.lit(" "), F.lit("  ")), F.lit("!  "))
    return p.withColumn("p_name", F.when(F.col("p_partkey") % 3 == 0, messy).otherwise(F.col("p_name")))


def orders_text_dates(spark, sf):
    o = _t(spark, sf, "orders")
    k = F.col("o_orderkey") % 3
    d = (
        F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
        .when(k == 1, F.date_format("o_orderdate", "dd/MM/yyyy"))
        .otherwise(F.lit("bad"))
    )
    return o.select("o_orderkey", d.alias("o_orderdate"))


def part_types(spark, sf):
    p = _t(spark, sf, "part")
    size_text = F.when(F.col("p_partkey") % 13 == 0, F.lit("n/a")).otherwise(F.col("p_size").cast("string"))
    flag = (F.col("p_size") % 2).cast("string")
    return p.select("p_partkey", size_text.alias("p_size_text"), flag.alias("p_flag"))


def line_corr(spark, sf):
    li = _t(spark, sf, "lineitem")
    return li.withColumn("l_derived", F.col("l_extendedprice") * 2 + F.col("l_quantity")).withColumn("l_const", F.lit(1.0))


def label_docs(spark, sf):
    return _t(spark, sf, "documents").join(_t(spark, sf, "labels"), "doc_id")


VIEWS = {
    "orders_missing": """SELECT o_orderkey, o_custkey,
        CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus,
        CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice,
        o_orderdate,
        CASE WHEN o_orderkey % 10 < 6 THEN NULL ELSE o_orderpriority END AS o_orderpriority
        FROM orders""",
    "orders_dups": "SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderkey % 20 = 0",
    "events_gaps": """SELECT event_id, ts, user_id, event_type,
        CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS value, props
        FROM events WHERE hour(ts) NOT IN (3, 4)""",
    "events_nulls": """SELECT event_id, ts, user_id, event_type,
        CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS value, props FROM events""",
    "events_nan": """SELECT event_id, ts, user_id, event_type,
        CASE WHEN event_id % 5 = 0 OR event_id % 7 = 0 THEN NULL ELSE value END AS value, props FROM events""",
    "events_outliers": """SELECT event_id, ts, user_id, event_type,
        CASE WHEN event_id % 97 = 0 THEN value * 50 ELSE value END AS value, props FROM events""",
    "part_messy": """SELECT p_partkey,
        CASE WHEN p_partkey % 3 = 0 THEN '  ' || replace(upper(p_name), ' ', '  ') || '!  ' ELSE p_name END AS p_name,
        p_brand, p_type, p_size, p_retailprice FROM part""",
    "orders_text_dates": """SELECT o_orderkey,
        CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d')
             WHEN o_orderkey % 3 = 1 THEN strftime(o_orderdate, '%d/%m/%Y') ELSE 'bad' END AS o_orderdate
        FROM orders""",
    "part_types": """SELECT p_partkey,
        CASE WHEN p_partkey % 13 = 0 THEN 'n/a' ELSE CAST(p_size AS VARCHAR) END AS p_size_text,
        CAST(p_size % 2 AS VARCHAR) AS p_flag FROM part""",
    "line_corr": "SELECT *, l_extendedprice * 2 + l_quantity AS l_derived, 1.0::DOUBLE AS l_const FROM lineitem",
    "label_docs": "SELECT d.*, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id)",
}


def with_views(sql: str, *names: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in names) + " " + sql


def _step(df: DataFrame, kind: str, **params) -> DataFrame:
    from tamis.plans.pipeline import make_step

    return make_step({"kind": kind, "params": params}).fit_transform(df)


# ---- flagship -----------------------------------------------------------------------------


def _flagship(spark, sf):
    _prep(spark)
    from tamis.plans.pipeline import run_pipeline

    li = _t(spark, sf, "lineitem")
    li = li.withColumn("l_extendedprice", F.when(F.col("l_orderkey") % 7 != 0, F.col("l_extendedprice")))
    steps = [
        {"kind": "impute", "params": {"columns": ["l_extendedprice"], "strategy": "median"}},
        {"kind": "scale", "params": {"columns": ["l_extendedprice", "l_quantity"], "method": "standard"}},
    ]
    out = run_pipeline(li, steps)
    return out.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"),
        r6(F.avg("l_extendedprice")).alias("avg_price_z"),
        r6(F.avg("l_quantity")).alias("avg_qty_z"),
        r6(F.max("l_extendedprice")).alias("max_price_z"),
    )


_FLAGSHIP_SQL = """
WITH li AS (SELECT l_returnflag, l_linestatus, l_quantity,
                   CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_extendedprice END AS p FROM lineitem),
imp AS (SELECT l_returnflag, l_linestatus, l_quantity,
               coalesce(p, (SELECT quantile_cont(p, 0.5) FROM li)) AS p FROM li),
st AS (SELECT avg(p) AS mp, stddev_pop(p) AS sp, avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq FROM imp),
z AS (SELECT l_returnflag, l_linestatus, (p - mp) / sp AS pz, (l_quantity - mq) / sq AS qz FROM imp, st)
SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(pz), 6) AS avg_price_z,
       round(avg(qz), 6) AS avg_qty_z, round(max(pz), 6) AS max_price_z
FROM z GROUP BY l_returnflag, l_linestatus
"""


@_query("flagship_impute_scale_summary", _FLAGSHIP_SQL)
def q_flagship(spark, sf):
    return _flagship(spark, sf)


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: lineitem with injected gaps → impute(median) → scale(standard) → summary."""
    return _flagship(spark, SF_SMOKE)


# ---- T1 impute ------------------------------------------------------------------------------


@_query(
    "impute_mean",
    with_views("SELECT o_orderkey, round(coalesce(o_totalprice, (SELECT avg(o_totalprice) FROM orders_missing)), 6) AS o_totalprice FROM orders_missing", "orders_missing"),
)
def q_impute_mean(spark, sf):
    _prep(spark)
    d = _step(orders_missing(spark, sf), "impute", columns=["o_totalprice"], strategy="mean")
    return d.select("o_orderkey", r6(F.col("o_totalprice")).alias("o_totalprice"))


@_query(
    "impute_median",
    with_views(
        "SELECT o_orderkey, round(coalesce(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.5) FROM orders_missing)), 6) AS o_totalprice FROM orders_missing",
        "orders_missing",
    ),
)
def q_impute_median(spark, sf):
    _prep(spark)
    d = _step(orders_missing(spark, sf), "impute", columns=["o_totalprice"], strategy="median")
    return d.select("o_orderkey", r6(F.col("o_totalprice")).alias("o_totalprice"))


@_query(
    "impute_mode",
    with_views(
        """SELECT o_orderkey, coalesce(o_orderstatus, (SELECT o_orderstatus FROM orders_missing WHERE o_orderstatus IS NOT NULL
           GROUP BY o_orderstatus ORDER BY count(*) DESC, o_orderstatus LIMIT 1)) AS o_orderstatus FROM orders_missing""",
        "orders_missing",
    ),
)
def q_impute_mode(spark, sf):
    _prep(spark)
    d = _step(orders_missing(spark, sf), "impute", columns=["o_orderstatus"], strategy="mode")
    return d.select("o_orderkey", "o_orderstatus")


@_query(
    "impute_constant",
    with_views("SELECT o_orderkey, coalesce(o_orderpriority, 'UNKNOWN') AS o_orderpriority FROM orders_missing", "orders_missing"),
)
def q_impute_constant(spark, sf):
    _prep(spark)
    d = _step(orders_missing(spark, sf), "impute", columns=["o_orderpriority"], strategy="constant", constant_value="UNKNOWN")
    return d.select("o_orderkey", "o_orderpriority")


@_query(
    "impute_ffill",
    with_views(
        """SELECT event_id, round(last_value(value IGNORE NULLS) OVER (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS value
           FROM events_nulls""",
        "events_nulls",
    ),
)
def q_impute_ffill(spark, sf):
    _prep(spark)
    d = _step(events_nulls(spark, sf), "impute", columns=["value"], strategy="ffill", order_by=["ts"])
    return d.select("event_id", r6(F.col("value")).alias("value"))


@_query(
    "impute_bfill",
    with_views(
        """SELECT event_id, round(first_value(value IGNORE NULLS) OVER (ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS value
           FROM events_nulls""",
        "events_nulls",
    ),
)
def q_impute_bfill(spark, sf):
    _prep(spark)
    d = _step(events_nulls(spark, sf), "impute", columns=["value"], strategy="bfill", order_by=["ts"])
    return d.select("event_id", r6(F.col("value")).alias("value"))


@_query(
    "impute_ffill_by_user",
    with_views(
        """SELECT event_id, round(last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS value FROM events_nulls""",
        "events_nulls",
    ),
)
def q_impute_ffill_by_user(spark, sf):
    _prep(spark)
    d = _step(events_nulls(spark, sf), "impute", columns=["value"], strategy="ffill", order_by=["ts"], partition_by=["user_id"])
    return d.select("event_id", r6(F.col("value")).alias("value"))


@_query(
    "impute_knn",
    with_views(
        """, near AS (SELECT n.event_id, d.value, row_number() OVER (PARTITION BY n.event_id
               ORDER BY power(n.event_id - d.event_id, 2) + power(n.user_id - d.user_id, 2), d.event_id) AS k
           FROM events_nulls n JOIN events_nulls d ON n.value IS NULL AND d.value IS NOT NULL)
           SELECT event_id, round(value, 6) AS value FROM events_nulls WHERE value IS NOT NULL
           UNION ALL SELECT event_id, round(avg(value), 6) FROM near WHERE k <= 5 GROUP BY event_id""",
        "events_nulls",
    ),
)
def q_impute_knn(spark, sf):
    _prep(spark)
    d = events_nulls(spark, sf).select("event_id", "user_id", "value")
    out = _step(d, "impute", columns=["value"], strategy="knn", n_neighbors=5)
    return out.select("event_id", r6(F.col("value")).alias("value"))


@_query("impute_random_forest")
def q_impute_rf(spark, sf):
    _prep(spark)
    d = orders_missing(spark, sf).select("o_orderkey", "o_custkey", "o_totalprice")
    out = _step(d, "impute", columns=["o_totalprice"], strategy="random_forest", n_estimators=20)
    return out.select("o_orderkey", r6(F.col("o_totalprice")).alias("o_totalprice"))


# ---- T2 drop_missing --------------------------------------------------------------------------


@_query("drop_missing_rows_subset", with_views("SELECT * FROM orders_missing WHERE o_totalprice IS NOT NULL", "orders_missing"))
def q_drop_rows_subset(spark, sf):
    _prep(spark)
    return _step(orders_missing(spark, sf), "drop_missing", axis="rows", columns=["o_totalprice"])


@_query(
    "drop_missing_rows_any",
    with_views(
        """SELECT * FROM orders_missing WHERE o_orderkey IS NOT NULL AND o_custkey IS NOT NULL AND o_orderstatus IS NOT NULL
           AND o_totalprice IS NOT NULL AND o_orderdate IS NOT NULL AND o_orderpriority IS NOT NULL""",
        "orders_missing",
    ),
)
def q_drop_rows_any(spark, sf):
    _prep(spark)
    return _step(orders_missing(spark, sf), "drop_missing", axis="rows")


@_query(
    "drop_missing_rows_ratio",
    with_views(
        """SELECT * FROM orders_missing WHERE ((o_orderstatus IS NULL)::INT + (o_totalprice IS NULL)::INT
           + (o_orderpriority IS NULL)::INT) / 6.0 <= 0.2""",
        "orders_missing",
    ),
)
def q_drop_rows_ratio(spark, sf):
    _prep(spark)
    return _step(orders_missing(spark, sf), "drop_missing", axis="rows", by_ratio=True, threshold=0.2)


@_query(
    "drop_missing_columns_ratio",
    with_views("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate FROM orders_missing", "orders_missing"),
)
def q_drop_cols_ratio(spark, sf):
    _prep(spark)
    return _step(orders_missing(spark, sf), "drop_missing", axis="columns", threshold=0.5)


# ---- T3 / T17 text ---------------------------------------------------------------------------


@_query(
    "normalize_text",
    with_views(
        r"""SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g') AS p_name
            FROM part_messy""",
        "part_messy",
    ),
)
def q_normalize_text(spark, sf):
    _prep(spark)
    return _step(part_messy(spark, sf), "normalize_text", columns=["p_name"]).select("p_partkey", "p_name")


@_query(
    "normalize_text_special",
    with_views(
        r"""SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(lower(p_name), '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g'),
            '[^\p{L}\p{N}_\s]', '', 'g') AS p_name FROM part_messy""",
        "part_messy",
    ),
)
def q_normalize_text_special(spark, sf):
    _prep(spark)
    return _step(part_messy(spark, sf), "normalize_text", columns=["p_name"], remove_special=True).select("p_partkey", "p_name")


def _stop_sql():
    from tamis.functions.fixed import ENGLISH_STOP_WORDS

    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in ENGLISH_STOP_WORDS) + "]"


def _clean_sql(stop: bool) -> str:
    from tamis.functions.fixed import TOKEN_PATTERN

    pat = TOKEN_PATTERN.replace("'", "''")
    toks = f"regexp_extract_all(lower(text), '{pat}')"
    if stop:
        toks = f"list_filter({toks}, lambda t: NOT list_contains({_stop_sql()}, t) AND length(t) > 1)"
    return f"SELECT doc_id, CASE WHEN text IS NULL THEN '' ELSE array_to_string({toks}, ' ') END AS text FROM documents"


@_query("clean_text", _clean_sql(False))
def q_clean_text(spark, sf):
    _prep(spark)
    return _step(_t(spark, sf, "documents"), "clean_text", column="text").select("doc_id", "text")


@_query("clean_text_stopwords", _clean_sql(True))
def q_clean_text_stop(spark, sf):
    _prep(spark)
    return _step(_t(spark, sf, "documents"), "clean_text", column="text", remove_stopwords=True).select("doc_id", "text")


# ---- T4 / T5 / T6 ------------------------------------------------------------------------------


def _dates_sql():
    fmts = ["%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M", "%Y-%m-%d", "%Y/%m/%d", "%m/%d/%Y", "%d/%m/%Y", "%m-%d-%Y", "%d.%m.%Y"]
    tries = ", ".join(f"try_strptime(trim(o_orderdate), '{f}')" for f in fmts)
    return with_views(f"SELECT o_orderkey, strftime(coalesce({tries}), '%Y/%m/%d') AS o_orderdate FROM orders_text_dates", "orders_text_dates")


@_query("standardize_dates", _dates_sql())
def q_standardize_dates(spark, sf):
    _prep(spark)
    return _step(orders_text_dates(spark, sf), "standardize_dates", columns=["o_orderdate"], format="%Y/%m/%d")


@_query("unit_convert", "SELECT o_orderkey, round(o_totalprice * 0.001, 6) AS o_totalprice FROM orders")
def q_unit_convert(spark, sf):
    _prep(spark)
    d = _step(_t(spark, sf, "orders"), "unit_convert", column="o_totalprice", factor=0.001)
    return d.select("o_orderkey", r6(F.col("o_totalprice")).alias("o_totalprice"))


_DOMAIN_SQL = r"""
WITH s AS (SELECT page_id, url, regexp_replace(url, '^\s+|\s+$', '', 'g') AS s FROM pages),
u AS (SELECT page_id, url, s, CASE WHEN starts_with(s, 'http://') OR starts_with(s, 'https://') THEN s ELSE 'http://' || s END AS u FROM s),
d AS (SELECT page_id, url, s, u, lower(regexp_extract(u, '^https?://([^/?#]*)', 1)) AS dom FROM u)
SELECT page_id, CASE WHEN url IS NULL OR s = '' THEN '' WHEN NOT contains(dom, '.') OR length(dom) > 253 THEN u ELSE dom END AS url
FROM d
"""


@_query("extract_domain", _DOMAIN_SQL)
def q_extract_domain(spark, sf):
    _prep(spark)
    return _step(_t(spark, sf, "pages"), "extract_domain", column="url").select("page_id", "url")


# ---- T7 outliers --------------------------------------------------------------------------------


@_query(
    "outliers_iqr",
    with_views(
        """, q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events_outliers)
        SELECT event_id, round(CASE WHEN value IS NULL THEN NULL ELSE least(greatest(value, q1 - 1.5 * (q3 - q1)), q3 + 1.5 * (q3 - q1)) END, 6) AS value
        FROM events_outliers, q""",
        "events_outliers",
    ),
)
def q_outliers_iqr(spark, sf):
    _prep(spark)
    d = _step(events_outliers(spark, sf), "outliers", columns=["value"], method="iqr", factor=1.5)
    return d.select("event_id", r6(F.col("value")).alias("value"))


@_query(
    "outliers_zscore",
    with_views(
        """, s AS (SELECT avg(value) AS m, stddev_samp(value) AS sd FROM events_outliers)
        SELECT event_id, round(CASE WHEN abs(value - m) <= 3.0 * sd THEN value ELSE m END, 6) AS value FROM events_outliers, s""",
        "events_outliers",
    ),
)
def q_outliers_zscore(spark, sf):
    _prep(spark)
    d = _step(events_outliers(spark, sf), "outliers", columns=["value"], method="zscore", factor=3.0)
    return d.select("event_id", r6(F.col("value")).alias("value"))


# ---- T8 duplicates --------------------------------------------------------------------------------

_LI_COLS = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"
_LI_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


@_query("dedupe_full_rows", with_views("SELECT DISTINCT * FROM orders_dups", "orders_dups"))
def q_dedupe_full(spark, sf):
    _prep(spark)
    return _step(orders_dups(spark, sf), "duplicates")


@_query(
    "dedupe_subset_first",
    f"""SELECT {_LI_COLS} FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
        ORDER BY {", ".join(_LI_ORDER)}) AS rn FROM lineitem) WHERE rn = 1""",
)
def q_dedupe_first(spark, sf):
    _prep(spark)
    return _step(_t(spark, sf, "lineitem"), "duplicates", subset=["l_orderkey", "l_linenumber"], keep="first", order_by=_LI_ORDER)


@_query(
    "dedupe_subset_last",
    f"""SELECT {_LI_COLS} FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
        ORDER BY {", ".join(c + " DESC" for c in _LI_ORDER)}) AS rn FROM lineitem) WHERE rn = 1""",
)
def q_dedupe_last(spark, sf):
    _prep(spark)
    return _step(_t(spark, sf, "lineitem"), "duplicates", subset=["l_orderkey", "l_linenumber"], keep="last", order_by=_LI_ORDER)


@_query(
    "dedupe_drop_all_copies",
    f"SELECT {_LI_COLS} FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber) = 1",
)
def q_dedupe_none(spark, sf):
    _prep(spark)
    return _step(_t(spark, sf, "lineitem"), "duplicates", subset=["l_orderkey", "l_linenumber"], keep=False)


@_query(
    "duplicate_count",
    with_views("SELECT count(*) AS n_rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM orders_dups)) AS duplicates FROM orders_dups", "orders_dups"),
)
def q_duplicate_count(spark, sf):
    _prep(spark)
    from tamis.operators.duplicates import duplicate_count

    d = orders_dups(spark, sf)
    n = d.count()
    return spark.createDataFrame([(n, duplicate_count(d))], "n_rows long, duplicates long")


# ---- T9 encode ---------------------------------------------------------------------------------------


def _onehot_sql(table, key, c, values, keep=None, rare="OTHER"):
    s = c
    if keep is not None:
        inlist = ", ".join("'" + v + "'" for v in keep)
        s = f"CASE WHEN {c} IS NULL THEN NULL WHEN {c} IN ({inlist}) THEN {c} ELSE '{rare}' END"
    cols = ", ".join(f"coalesce(({s} = '{v}')::INT, 0) AS \"{c}_{v}\"" for v in values)
    return f"SELECT {key}, {cols} FROM {table}"


@_query(
    "encode_onehot",
    _onehot_sql("orders", "o_orderkey", "o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]),
)
def q_encode_onehot(spark, sf):
    _prep(spark)
    d = _t(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return _step(d, "encode", columns=["o_orderpriority"], method="onehot")


def _onehot_top_sql():
    top = """(SELECT p_brand FROM part GROUP BY p_brand ORDER BY count(*) DESC, p_brand LIMIT 3)"""
    return f"""WITH t AS (SELECT p_partkey, CASE WHEN p_brand IS NULL THEN NULL WHEN p_brand IN {top} THEN p_brand ELSE 'OTHER' END AS b FROM part),
        v AS (SELECT DISTINCT b FROM t WHERE b IS NOT NULL)
        SELECT t.p_partkey, v.b AS category, (t.b = v.b)::INT AS flag FROM t, v"""


@_query("encode_onehot_top", _onehot_top_sql())
def q_encode_onehot_top(spark, sf):
    _prep(spark)
    d = _t(spark, sf, "part").select("p_partkey", "p_brand")
    out = _step(d, "encode", columns=["p_brand"], method="onehot", max_categories=3)
    dummies = [c for c in out.columns if c.startswith("p_brand_")]
    # long form (key, category, flag) so the result does not depend on which brands won
    stacked = out.select(
        "p_partkey",
        F.explode(F.array(*[F.struct(F.lit(c[len("p_brand_"):]).alias("category"), F.col(f"`{c}`").alias("flag")) for c in dummies])).alias("r"),
    )
    return stacked.select("p_partkey", "r.category", "r.flag")


@_query(
    "encode_label",
    """SELECT p_partkey, (SELECT count(*) FROM (SELECT DISTINCT p_brand AS b FROM part WHERE p_brand IS NOT NULL) x WHERE x.b < part.p_brand) AS p_brand
       FROM part""",
)
def q_encode_label(spark, sf):
    _prep(spark)
    d = _t(spark, sf, "part").select("p_partkey", "p_brand")
    return _step(d, "encode", columns=["p_brand"], method="label")


_ORDINAL = {"1-URGENT": 5, "2-HIGH": 4, "3-MEDIUM": 3, "4-NOT SPECIFIED": 2, "5-LOW": 1}


@_query(
    "encode_ordinal",
    "SELECT o_orderkey, CAST(CASE o_orderpriority "
    + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _ORDINAL.items())
    + " END AS DOUBLE) AS o_orderpriority FROM orders",
)
def q_encode_ordinal(spark, sf):
    _prep(spark)
    d = _t(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return _step(d, "encode", columns=["o_orderpriority"], method="ordinal", ordinal_mappings={"o_orderpriority": _ORDINAL}, unmapped="null")


@_query(
    "encode_target",
    """SELECT c_custkey, round(m, 6) AS c_mktsegment FROM customer
       LEFT JOIN (SELECT c_mktsegment AS k, avg(c_acctbal) AS m FROM customer GROUP BY c_mktsegment) t ON customer.c_mktsegment = t.k""",
)
def q_encode_target(spark, sf):
    _prep(spark)
    d = _t(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    out = _step(d, "encode", columns=["c_mktsegment"], method="target_encode", target_column="c_acctbal")
    return out.select("c_custkey", r6(F.col("c_mktsegment")).alias("c_mktsegment"))


@_query(
    "encode_frequency",
    "SELECT p_partkey, count(*) OVER (PARTITION BY p_type) AS p_type FROM part",
)
def q_encode_frequency(spark, sf):
    _prep(spark)
    d = _t(spark, sf, "part").select("p_partkey", "p_type")
    return _step(d, "encode", columns=["p_type"], method="frequency_encode")


def _hash_sql(expr, seed):
    return f"('0x' || substr(md5(concat_ws('|', '{seed}', coalesce(CAST({expr} AS VARCHAR), chr(0)))), 1, 15))::UBIGINT"


def _hashing_sql(n=8):
    b = f"({_hash_sql('p_brand', 0)} % {n})"
    sign = f"(CASE WHEN {_hash_sql('p_brand', 1)} % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END)"
    cols = ", ".join(f"CASE WHEN p_brand IS NOT NULL AND {b} = {i} THEN {sign} ELSE 0.0::DOUBLE END AS p_brand_hash_{i}" for i in range(n))
    return f"SELECT p_partkey, {cols} FROM part"


@_query("encode_hashing", _hashing_sql())
def q_encode_hashing(spark, sf):
    _prep(spark)
    d = _t(spark, sf, "part").select("p_partkey", "p_brand")
    return _step(d, "encode", columns=["p_brand"], method="hashing_encode", n_components=8)


# ---- T10 scale -----------------------------------------------------------------------------------------


@_query(
    "scale_standard",
    """WITH s AS (SELECT avg(l_extendedprice) AS m1, stddev_pop(l_extendedprice) AS s1, avg(l_quantity) AS m2, stddev_pop(l_quantity) AS s2 FROM lineitem)
       SELECT l_orderkey, l_linenumber, round((l_extendedprice - m1) / s1, 6) AS l_extendedprice, round((l_quantity - m2) / s2, 6) AS l_quantity
       FROM lineitem, s""",
)
def q_scale_standard(spark, sf):
    _prep(spark)
    d = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    out = _step(d, "scale", columns=["l_extendedprice", "l_quantity"], method="standard")
    return out.select("l_orderkey", "l_linenumber", r6(F.col("l_extendedprice")).alias("l_extendedprice"), r6(F.col("l_quantity")).alias("l_quantity"))


@_query(
    "scale_minmax",
    """WITH s AS (SELECT min(l_extendedprice) AS a, max(l_extendedprice) - min(l_extendedprice) AS b FROM lineitem)
       SELECT l_orderkey, l_linenumber, round((l_extendedprice - a) / b, 6) AS l_extendedprice_scaled FROM lineitem, s""",
)
def q_scale_minmax(spark, sf):
    _prep(spark)
    d = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    out = _step(d, "scale", columns=["l_extendedprice"], method="minmax", keep_original=True)
    return out.select("l_orderkey", "l_linenumber", r6(F.col("l_extendedprice_scaled")).alias("l_extendedprice_scaled"))


@_query(
    "scale_robust",
    """WITH s AS (SELECT quantile_cont(l_extendedprice, 0.5) AS med, quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25) AS iqr FROM lineitem)
       SELECT l_orderkey, l_linenumber, round((l_extendedprice - med) / iqr, 6) AS l_extendedprice FROM lineitem, s""",
)
def q_scale_robust(spark, sf):
    _prep(spark)
    d = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    out = _step(d, "scale", columns=["l_extendedprice"], method="robust")
    return out.select("l_orderkey", "l_linenumber", r6(F.col("l_extendedprice")).alias("l_extendedprice"))


# ---- T11 rebalance ---------------------------------------------------------------------------------------

_LABEL_HASH = _hash_sql("doc_id", 42).replace(
    "coalesce(CAST(doc_id AS VARCHAR), chr(0))",
    "coalesce(CAST(doc_id AS VARCHAR), chr(0)), coalesce(CAST(quality AS VARCHAR), chr(0)), coalesce(CAST(toxic AS VARCHAR), chr(0))",
)

_REBALANCE_BASE = f"""
pos AS (SELECT doc_id, quality, toxic,
        row_number() OVER (PARTITION BY toxic ORDER BY {_LABEL_HASH}, doc_id, quality, toxic) - 1 AS p FROM labels WHERE toxic IS NOT NULL),
cnt AS (SELECT toxic, count(*) AS n FROM labels WHERE toxic IS NOT NULL GROUP BY toxic)
"""


@_query(
    "rebalance_undersample",
    f"""WITH {_REBALANCE_BASE}
        SELECT doc_id, quality, toxic FROM pos WHERE p < greatest((SELECT min(n) FROM cnt), 100)""",
)
def q_rebalance_under(spark, sf):
    _prep(spark)
    return _step(_t(spark, sf, "labels"), "rebalance", target="toxic", method="undersample", ratio=1.0)


@_query(
    "rebalance_oversample",
    f"""WITH {_REBALANCE_BASE},
        maj AS (SELECT toxic, n FROM cnt ORDER BY n DESC, CAST(toxic AS VARCHAR) LIMIT 1),
        plan AS (SELECT c.toxic, c.n, least((SELECT n FROM maj), c.n * 10) AS m FROM cnt c WHERE c.toxic <> (SELECT toxic FROM maj)),
        draws AS (SELECT plan.toxic, ({_hash_sql('x', 42).replace("coalesce(CAST(x AS VARCHAR), chr(0))", "coalesce(CAST(plan.toxic AS VARCHAR), chr(0)), coalesce(CAST(g.i AS VARCHAR), chr(0))")} % plan.n) AS dp
                  FROM plan, LATERAL (SELECT unnest(range(plan.m)) AS i) g)
        SELECT doc_id, quality, toxic FROM pos WHERE toxic = (SELECT toxic FROM maj)
        UNION ALL
        SELECT pos.doc_id, pos.quality, pos.toxic FROM draws JOIN pos ON pos.toxic = draws.toxic AND pos.p = draws.dp""",
)
def q_rebalance_over(spark, sf):
    _prep(spark)
    return _step(_t(spark, sf, "labels"), "rebalance", target="toxic", method="oversample", ratio=1.0)


@_query("class_distribution", "SELECT toxic, count(*) AS count FROM labels GROUP BY toxic")
def q_class_distribution(spark, sf):
    from tamis.operators.profile import class_distribution

    return class_distribution(_t(spark, sf, "labels"), "toxic")


# ---- T12 type_convert -------------------------------------------------------------------------------------


@_query("type_convert_int", with_views("SELECT p_partkey, CAST(trunc(coalesce(TRY_CAST(p_size_text AS DOUBLE), 0)) AS BIGINT) AS p_size_text FROM part_types", "part_types"))
def q_type_int(spark, sf):
    _prep(spark)
    return _step(part_types(spark, sf), "type_convert", column="p_size_text", type="int").select("p_partkey", "p_size_text")


@_query("type_convert_float", with_views("SELECT p_partkey, TRY_CAST(p_size_text AS DOUBLE) AS p_size_text FROM part_types", "part_types"))
def q_type_float(spark, sf):
    _prep(spark)
    return _step(part_types(spark, sf), "type_convert", column="p_size_text", type="float").select("p_partkey", "p_size_text")


@_query("type_convert_bool", with_views("SELECT p_partkey, coalesce(TRY_CAST(p_flag AS DOUBLE), 0) <> 0 AS p_flag FROM part_types", "part_types"))
def q_type_bool(spark, sf):
    _prep(spark)
    return _step(part_types(spark, sf), "type_convert", column="p_flag", type="bool").select("p_partkey", "p_flag")


# ---- T13 skew ----------------------------------------------------------------------------------------------


@_query("skew_log", "SELECT event_id, round(CASE WHEN value IS NULL THEN NULL ELSE ln(1 + greatest(value, 0)) END, 6) AS value FROM events")
def q_skew_log(spark, sf):
    _prep(spark)
    d = _step(_t(spark, sf, "events"), "skewness_transform", columns=["value"], method="log")
    return d.select("event_id", r6(F.col("value")).alias("value"))


@_query("skew_sqrt", "SELECT event_id, round(CASE WHEN value IS NULL THEN NULL ELSE sqrt(greatest(value, 0)) END, 6) AS value FROM events")
def q_skew_sqrt(spark, sf):
    _prep(spark)
    d = _step(_t(spark, sf, "events"), "skewness_transform", columns=["value"], method="sqrt")
    return d.select("event_id", r6(F.col("value")).alias("value"))


@_query("skew_boxcox")
def q_skew_boxcox(spark, sf):
    _prep(spark)
    d = _step(_t(spark, sf, "events"), "skewness_transform", columns=["value"], method="boxcox")
    return d.select("event_id", r6(F.col("value")).alias("value"))


# ---- T14 / A5 PII -----------------------------------------------------------------------------------------------


def _mask_sql():
    from tamis.functions.fixed import PII_MASK_ORDER, PII_PATTERNS

    e = "text"
    for k in PII_MASK_ORDER:
        pat, rep = PII_PATTERNS[k]
        e = f"regexp_replace({e}, '{pat.replace(chr(39), chr(39) * 2)}', '{rep}', 'g')"
    return f"SELECT doc_id, {e} AS text FROM documents"


@_query("mask_pii", _mask_sql())
def q_mask_pii(spark, sf):
    _prep(spark)
    return _step(_t(spark, sf, "documents"), "mask_pii", columns=["text"]).select("doc_id", "text")


def _detect_sql():
    from tamis.functions.fixed import PII_DETECT_PATTERNS

    parts = []
    cols = ["text", "lang", "source"]
    for ci, c in enumerate(cols):
        for ti, (t, p) in enumerate(PII_DETECT_PATTERNS.items()):
            parts.append(
                f"SELECT '{c}' AS \"column\", '{t}' AS pii_type FROM documents HAVING bool_or(coalesce(regexp_matches({c}, '{p}'), false))"
            )
    return " UNION ALL ".join(parts)


@_query("detect_pii", _detect_sql())
def q_detect_pii(spark, sf):
    from tamis.operators.pii import detect_pii

    return detect_pii(_t(spark, sf, "documents"))


# ---- T15 / T16 time series ------------------------------------------------------------------------------------------


@_query(
    "smooth_moving_average",
    "SELECT event_id, round(avg(value) OVER (ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS value FROM events",
)
def q_smooth_ma(spark, sf):
    _prep(spark)
    d = _step(_t(spark, sf, "events"), "smooth_time_series", column="value", method="moving_average", window=5, order_by=["ts"])
    return d.select("event_id", r6(F.col("value")).alias("value"))


def _savgol_sql(w=7, order=3):
    import numpy as np

    from tamis.functions.ordering import savgol_coeffs

    h = w // 2
    mid = savgol_coeffs(w, order)
    lag_terms = " + ".join(
        f"({float(mid[k])!r}) * coalesce({'lag' if k < h else 'lead'}(x, {abs(k - h)}) OVER (ORDER BY rn), 0)" if k != h else f"({float(mid[k])!r}) * x"
        for k in range(w)
    )
    head = {i: savgol_coeffs(w, order, i) for i in range(h)}
    tail = {i: savgol_coeffs(w, order, w - 1 - i) for i in range(h)}
    nth_first = lambda k: f"nth_value(x, {k + 1}) OVER (ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    nth_last = lambda k: f"nth_value(x, {w - k}) OVER (ORDER BY rn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    cases = []
    for i in range(h):
        cases.append(f"WHEN rn = {i + 1} THEN " + " + ".join(f"({float(head[i][k])!r}) * {nth_first(k)}" for k in range(w)))
        # i-th row from the end: position n-1-i; last window rows in order k = 0..w-1 are positions n-w+k
        cases.append(f"WHEN rn = n - {i} THEN " + " + ".join(f"({float(tail[i][k])!r}) * {nth_last(k)}" for k in range(w)))
    body = f"""WITH m AS (SELECT avg(value) AS mv FROM events),
        b AS (SELECT event_id, coalesce(value, mv) AS x, row_number() OVER (ORDER BY ts) AS rn, count(*) OVER () AS n FROM events, m),
        c AS (SELECT event_id, rn, n, x, {lag_terms} AS interior, CASE {" ".join(cases)} ELSE NULL END AS edge FROM b)
        SELECT event_id, round(coalesce(edge, interior), 6) AS value FROM c"""
    return body


@_query("smooth_savgol", _savgol_sql())
def q_smooth_savgol(spark, sf):
    _prep(spark)
    d = _step(_t(spark, sf, "events"), "smooth_time_series", column="value", method="savitzky_golay", window=7, order_by=["ts"])
    return d.select("event_id", r6(F.col("value")).alias("value"))


@_query(
    "interpolate_linear",
    with_views(
        """, b AS (SELECT event_id, ts, value, row_number() OVER (ORDER BY ts) AS rn FROM events_nulls),
        c AS (SELECT event_id, value, rn,
             last_value(value IGNORE NULLS) OVER (ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pv,
             last_value(CASE WHEN value IS NOT NULL THEN rn END IGNORE NULLS) OVER (ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pp,
             first_value(value IGNORE NULLS) OVER (ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nv,
             first_value(CASE WHEN value IS NOT NULL THEN rn END IGNORE NULLS) OVER (ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS np
             FROM b)
        SELECT event_id, round(CASE WHEN value IS NOT NULL THEN value WHEN pv IS NULL THEN NULL WHEN nv IS NULL THEN pv
                                    ELSE pv + (nv - pv) * (rn - pp) / (np - pp) END, 6) AS value FROM c""",
        "events_nulls",
    ),
)
def q_interpolate(spark, sf):
    _prep(spark)
    # the interpolation stage of smooth_time_series on its own
    from tamis.functions.ordering import InterpolateKernel, ordered_scan

    e = events_nulls(spark, sf)
    out = ordered_scan(e, InterpolateKernel(["value"]), ["ts"])
    return out.select("event_id", r6(F.col("value")).alias("value"))


def _resample_sql(func: str, fill0: bool):
    agg = {"mean": "avg", "sum": "sum", "count": "count", "max": "max"}[func]
    cols = ["event_id", "user_id", "value"]
    sel = ", ".join((f"coalesce(g.{c}, 0)" if fill0 else f"g.{c}") + f" AS {c}" for c in cols)
    rnd = {c: (f"round({c}, 6)" if func == "mean" or (func == "sum" and c == "value") else c) for c in cols}
    typed = {c: (f"{agg}({c})::BIGINT" if func == "sum" and c != "value" else f"{agg}({c})") for c in cols}
    return with_views(
        f""", o AS (SELECT date_trunc('day', min(ts)) AS origin FROM events_gaps),
        k AS (SELECT floor((epoch_us(ts) - epoch_us(origin)) / 3600000000)::BIGINT AS b, event_id, user_id, value FROM events_gaps, o),
        g AS (SELECT b, {", ".join(f"{typed[c]} AS {c}" for c in cols)} FROM k GROUP BY b),
        bk AS (SELECT unnest(range(0, (SELECT max(b) FROM k) + 1)) AS b),
        j AS (SELECT bk.b, {sel} FROM bk LEFT JOIN g ON bk.b = g.b)
        SELECT (SELECT origin FROM o) + to_microseconds(j.b * 3600000000) AS ts, {", ".join(rnd[c] + " AS " + c for c in cols)} FROM j""",
        "events_gaps",
    )


@_query("resample_hourly_mean", _resample_sql("mean", False))
def q_resample_mean(spark, sf):
    _prep(spark)
    d = _step(events_gaps(spark, sf).drop("event_type", "props"), "resample_time_series", time_column="ts", freq="1h", agg_func="mean")
    return d.select("ts", *[r6(F.col(c)).alias(c) for c in ("event_id", "user_id", "value")])


@_query("resample_hourly_sum", _resample_sql("sum", True))
def q_resample_sum(spark, sf):
    _prep(spark)
    d = _step(events_gaps(spark, sf).drop("event_type", "props"), "resample_time_series", time_column="ts", freq="1h", agg_func="sum")
    return d.select("ts", "event_id", "user_id", r6(F.col("value")).alias("value"))


@_query("resample_hourly_count", _resample_sql("count", True))
def q_resample_count(spark, sf):
    _prep(spark)
    d = _step(events_gaps(spark, sf).drop("event_type", "props"), "resample_time_series", time_column="ts", freq="1h", agg_func="count")
    return d.select("ts", "event_id", "user_id", "value")


@_query(
    "rolling_mean_full_window",
    """SELECT event_id, round(CASE WHEN count(value) OVER w = 7 THEN avg(value) OVER w END, 6) AS rolling_mean
       FROM events WINDOW w AS (ORDER BY ts ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""",
)
def q_rolling_full(spark, sf):
    _prep(spark)
    from tamis.operators.profile import rolling_mean_full

    d = rolling_mean_full(_t(spark, sf, "events"), "value", ["ts"], 7)
    return d.select("event_id", r6(F.col("rolling_mean")).alias("rolling_mean"))


# ---- F1–F4, F6 features ------------------------------------------------------------------------------


@_query(
    "polynomial_features",
    """SELECT l_orderkey, l_linenumber, round(l_quantity * l_quantity, 6) AS "l_quantity^2",
       round(l_quantity * l_discount, 6) AS "l_quantity l_discount", round(l_discount * l_discount, 6) AS "l_discount^2" FROM lineitem""",
)
def q_polynomial(spark, sf):
    _prep(spark)
    d = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    out = _step(d, "create_polynomial_features", columns=["l_quantity", "l_discount"], degree=2)
    new = ["l_quantity^2", "l_quantity l_discount", "l_discount^2"]
    return out.select("l_orderkey", "l_linenumber", *[r6(F.col(f"`{c}`")).alias(c) for c in new])


@_query(
    "datetime_features",
    """SELECT o_orderkey, year(o_orderdate)::INTEGER AS o_orderdate_year, month(o_orderdate)::INTEGER AS o_orderdate_month,
       day(o_orderdate)::INTEGER AS o_orderdate_day, (isodow(o_orderdate) - 1)::INTEGER AS o_orderdate_dayofweek,
       quarter(o_orderdate)::INTEGER AS o_orderdate_quarter FROM orders""",
)
def q_datetime_features(spark, sf):
    _prep(spark)
    d = _t(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    out = _step(d, "extract_datetime_features", columns=["o_orderdate"], features=["year", "month", "day", "dayofweek", "quarter"])
    return out.drop("o_orderdate")


def _bins_sql(b=10):
    probs = ", ".join(str(i / b) for i in range(b + 1))
    return f"""WITH e AS (SELECT list_sort(list_distinct(quantile_cont(value, [{probs}]))) AS edges FROM events),
        x AS (SELECT event_id, value, edges FROM events, e)
        SELECT event_id, CASE WHEN value IS NOT NULL AND value >= edges[1] AND value <= edges[len(edges)]
               THEN len(list_filter(edges[2:len(edges) - 1], lambda t: t < value))::INTEGER END AS value_binned FROM x"""


@_query("bin_features", _bins_sql())
def q_bins(spark, sf):
    _prep(spark)
    d = _t(spark, sf, "events").select("event_id", "value")
    return _step(d, "bin_features", columns=["value"], bins=10).select("event_id", "value_binned")


_CORR_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_derived"]


def _corr_drop_sql(thr=0.8):
    parts = []
    for j, b in enumerate(_CORR_COLS):
        if j == 0:
            continue
        conds = " OR ".join(f"abs(corr({a}, {b})) > {thr}" for a in _CORR_COLS[:j])
        parts.append(f"SELECT '{b}' AS \"column\", {j} AS ord FROM line_corr HAVING {conds}")
    return with_views("SELECT \"column\" FROM (" + " UNION ALL ".join(parts) + ")", "line_corr")


@_query("select_features_correlation", _corr_drop_sql())
def q_select_corr(spark, sf):
    _prep(spark)
    from tamis.plans.pipeline import make_step

    f = make_step({"kind": "select_features_correlation", "params": {"threshold": 0.8}}).fit(line_corr(spark, sf))
    return spark.createDataFrame([(c,) for c in f.state["dropped"]], "column string")


@_query(
    "text_features",
    r"""WITH w AS (SELECT doc_id, coalesce(text, '') AS s FROM documents),
        x AS (SELECT doc_id, s, list_filter(regexp_split_to_array(trim(s, ' '), '\s+'), lambda t: length(t) > 0) AS words FROM w)
        SELECT doc_id, length(s) AS len_text, len(words) AS word_count_text,
               length(regexp_replace(s, '[^0-9]', '', 'g')) AS digit_count_text,
               length(regexp_replace(s, '[a-zA-Z0-9\s]', '', 'g')) AS special_char_count_text,
               round(CASE WHEN len(words) > 0 THEN list_sum(list_transform(words, lambda t: length(t))) / len(words) ELSE 0.0 END, 6) AS avg_word_length_text
        FROM x""",
)
def q_text_features(spark, sf):
    _prep(spark)
    from tamis.operators.features import choose, text_offers

    d = _t(spark, sf, "documents").select("doc_id", "text")
    out = d.select("doc_id", *[f.value.alias(f.name) for f in choose(text_offers(d, {"text_cols": ["text"]}), 10, d.columns)])
    return out.select(
        "doc_id",
        F.col("len_text").cast("long").alias("len_text"),
        F.col("word_count_text").cast("long").alias("word_count_text"),
        F.col("digit_count_text").cast("long").alias("digit_count_text"),
        F.col("special_char_count_text").cast("long").alias("special_char_count_text"),
        r6(F.col("avg_word_length_text").cast("double")).alias("avg_word_length_text"),
    )


@_query(
    "datetime_family",
    """SELECT event_id, (isodow(ts) >= 6)::INT AS ts_is_weekend, (CAST(ts AS DATE) = last_day(ts))::INT AS ts_is_month_end,
       round(sin(2 * pi() * month(ts) / 12), 6) AS ts_month_sin, round(cos(2 * pi() * month(ts) / 12), 6) AS ts_month_cos,
       epoch(date_trunc('second', ts))::BIGINT AS ts_timestamp FROM events""",
)
def q_datetime_family(spark, sf):
    _prep(spark)
    from tamis.operators.features import choose, datetime_offers

    d = _t(spark, sf, "events").select("event_id", "ts")
    new = {f.name: f.value for f in choose(datetime_offers(d, {"datetime_cols": ["ts"]}), 20, d.columns)}
    return d.select(
        "event_id",
        new["ts_is_weekend"].alias("ts_is_weekend"),
        new["ts_is_month_end"].alias("ts_is_month_end"),
        r6(new["ts_month_sin"]).alias("ts_month_sin"),
        r6(new["ts_month_cos"]).alias("ts_month_cos"),
        new["ts_timestamp"].alias("ts_timestamp"),
    )


@_query(
    "categorical_family",
    """WITH f AS (SELECT p_type, count(*) AS n FROM part GROUP BY p_type),
       r AS (SELECT p_type, n, rank() OVER (ORDER BY n DESC) + (count(*) OVER (PARTITION BY n) - 1) / 2.0 AS rk FROM f)
       SELECT p_partkey, r.n AS freq_p_type, r.rk::DOUBLE AS rank_p_type FROM part JOIN r USING (p_type)""",
)
def q_categorical_family(spark, sf):
    _prep(spark)
    from tamis.operators.features import add_features, categorical_offers, choose

    d = _t(spark, sf, "part").select("p_partkey", "p_type")
    prof = {"categorical_cols": ["p_type"], "high_cardinality_cols": [], "stats": {"p_type": {"unique_count": 6}}}
    return add_features(d, choose(categorical_offers(d, prof), 2, d.columns)).select("p_partkey", "freq_p_type", "rank_p_type")


@_query("automated_features")
def q_auto(spark, sf):
    _prep(spark)
    d = _t(spark, sf, "customer")
    return _step(d, "automated_feature_engineering", max_features=20)


@_query("kmeans_features")
def q_kmeans(spark, sf):
    _prep(spark)
    from tamis.operators.features import clustering_family
    from tamis.operators.profile import analyze_dataset_advanced

    d = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount")
    prof = analyze_dataset_advanced(d.drop("l_orderkey", "l_linenumber"), as_dict=True, with_correlations=False)
    new = clustering_family(d, prof, 2, list(d.columns))
    return d.select("l_orderkey", "l_linenumber", *[e.alias(n) for n, e in new.items()])


@_query("pca_features")
def q_pca(spark, sf):
    _prep(spark)
    from tamis.operators.features import pca_family
    from tamis.operators.profile import analyze_dataset_advanced

    d = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    prof = analyze_dataset_advanced(d.drop("l_orderkey", "l_linenumber"), as_dict=True, with_correlations=False)
    new = pca_family(d, prof, 3, list(d.columns))
    return d.select("l_orderkey", "l_linenumber", *[r6(e).alias(n) for n, e in new.items()])


# ---- T18 / A18 text statistics -----------------------------------------------------------------------------


def _tfidf_sql(k=100):
    from tamis.functions.fixed import TFIDF_TOKEN_PATTERN

    return f"""WITH d AS (SELECT doc_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '{TFIDF_TOKEN_PATTERN}'),
                  lambda t: NOT list_contains({_stop_sql()}, t)) AS toks FROM documents),
        n AS (SELECT count(*) AS n FROM documents),
        tt AS (SELECT doc_id, unnest(toks) AS term FROM d),
        pd AS (SELECT doc_id, term, count(*) AS c FROM tt GROUP BY doc_id, term),
        st AS (SELECT term, sum(c) AS tf, count(*) AS df FROM pd GROUP BY term),
        v AS (SELECT term, ln((1 + n) / (1 + df)) + 1 AS idf FROM st, n WHERE df >= 2 AND df <= 0.95 * n ORDER BY tf DESC, term LIMIT {k}),
        x AS (SELECT pd.doc_id, pd.term, pd.c * v.idf AS raw FROM pd JOIN v USING (term))
        SELECT doc_id, term, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)), 6) AS tfidf FROM x"""


@_query("tfidf", _tfidf_sql())
def q_tfidf(spark, sf):
    _prep(spark)
    d = _t(spark, sf, "documents")
    out = _step(d, "extract_tfidf", column="text", max_features=100, id_column="doc_id", form="long")
    return out.select("doc_id", "term", r6(F.col("tfidf")).alias("tfidf"))


def _wordfreq_sql():
    from tamis.functions.fixed import TFIDF_TOKEN_PATTERN

    return f"""WITH t AS (SELECT unnest(list_filter(regexp_extract_all(lower(coalesce(text, '')), '{TFIDF_TOKEN_PATTERN}'),
                  lambda t: NOT list_contains({_stop_sql()}, t))) AS word FROM documents)
        SELECT word, count(*) AS count FROM t GROUP BY word ORDER BY count DESC, word LIMIT 200"""


@_query("word_frequencies", _wordfreq_sql())
def q_wordfreq(spark, sf):
    from tamis.operators.tfidf import word_frequencies

    return word_frequencies(_t(spark, sf, "documents"), "text", 200)


# ---- A1–A4, A10, A16–A23 profiles -------------------------------------------------------------------------

_DESC_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _describe_sql():
    parts = [
        f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
            round(min({c}), 6)::DOUBLE AS min, round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50,
            round(quantile_cont({c}, 0.75), 6) AS q75, round(max({c}), 6)::DOUBLE AS max FROM lineitem"""
        for c in _DESC_COLS
    ]
    return " UNION ALL ".join(parts)


@_query("describe", _describe_sql())
def q_describe(spark, sf):
    _prep(spark)
    from tamis.operators.profile import describe

    d = describe(_t(spark, sf, "lineitem").select(*_DESC_COLS))
    return d.select("column", "count", *[r6(F.col(c)).alias(c) for c in ("mean", "std", "min", "q25", "q50", "q75", "max")])


def _missing_sql():
    cols = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
    parts = [
        f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing, round((count(*) - count({c})) / count(*), 6) AS missing_ratio FROM orders_missing"
        for c in cols
    ]
    return with_views(" UNION ALL ".join(parts), "orders_missing")


@_query("missing_summary", _missing_sql())
def q_missing_summary(spark, sf):
    from tamis.operators.profile import missing_summary

    m = missing_summary(orders_missing(spark, sf))
    return m.select("column", "missing", r6(F.col("missing_ratio")).alias("missing_ratio"))


@_query(
    "quality_metrics",
    with_views(
        """SELECT count(*) AS rows, 0::BIGINT AS missing, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM orders_dups)) AS duplicate_rows,
           1.0::DOUBLE AS completeness, round(1 - (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM orders_dups))) / count(*), 6) AS uniqueness
           FROM orders_dups""",
        "orders_dups",
    ),
)
def q_quality(spark, sf):
    from tamis.operators.profile import quality_metrics

    q = quality_metrics(orders_dups(spark, sf))
    return q.select("rows", "missing", "duplicate_rows", r6(F.col("completeness")).alias("completeness"), r6(F.col("uniqueness")).alias("uniqueness"))


def _analysis_sql():
    num = {"o_orderkey": True, "o_custkey": True, "o_totalprice": True}
    cols = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
    parts = []
    for c in cols:
        if c in num:
            x = f"CAST({c} AS DOUBLE)"
            m2 = f"(avg(power({x} - (SELECT avg({x}) FROM orders_missing), 2)))"
            m3 = f"(avg(power({x} - (SELECT avg({x}) FROM orders_missing), 3)))"
            m4 = f"(avg(power({x} - (SELECT avg({x}) FROM orders_missing), 4)))"
            parts.append(
                f"""SELECT '{c}' AS "column", 'numeric' AS kind, count(DISTINCT {c}) AS unique_count,
                round((count(*) - count({c})) / count(*), 6) AS missing_rate, round(var_samp({x}) / power(10, floor(log10(var_samp({x})))), 9) AS variance,
                round({m3} / power({m2}, 1.5), 6) AS skewness, round({m4} / power({m2}, 2) - 3, 6) AS kurtosis, NULL::DOUBLE AS avg_length
                FROM orders_missing"""
            )
        elif c == "o_orderdate":
            parts.append(
                f"""SELECT '{c}', 'datetime', count(DISTINCT {c}), round((count(*) - count({c})) / count(*), 6), NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE FROM orders_missing"""
            )
        else:
            parts.append(
                f"""SELECT '{c}', CASE WHEN count(DISTINCT {c}) / count(*) > 0.8 OR avg(length({c})) > 20 THEN 'text' ELSE 'categorical' END,
                count(DISTINCT {c}), round((count(*) - count({c})) / count(*), 6), NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, round(avg(length({c})), 6)
                FROM orders_missing"""
            )
    return with_views(" UNION ALL ".join(parts), "orders_missing")


@_query("dataset_analysis", _analysis_sql())
def q_analysis(spark, sf):
    from tamis.operators.profile import analyze_dataset_advanced

    a = analyze_dataset_advanced(orders_missing(spark, sf), with_correlations=False)
    return a.select(
        "column", "kind", "unique_count", r6(F.col("missing_rate")).alias("missing_rate"),
        F.round(F.col("variance") / F.pow(F.lit(10.0), F.floor(F.log10("variance"))), 9).alias("variance"),
        r6(F.col("skewness")).alias("skewness"), r6(F.col("kurtosis")).alias("kurtosis"), r6(F.col("avg_length")).alias("avg_length"),
    )


@_query(
    "histogram",
    """WITH q AS (SELECT quantile_cont(l_extendedprice, 0.01) AS lo, quantile_cont(l_extendedprice, 0.99) AS hi FROM lineitem),
       b AS (SELECT least(floor((l_extendedprice - lo) / ((hi - lo) / 50))::INT, 49) AS bin, lo, hi FROM lineitem, q
             WHERE l_extendedprice >= lo AND l_extendedprice <= hi)
       SELECT bin, round(min(lo) + bin * (min(hi) - min(lo)) / 50, 6) AS lo, round(min(lo) + (bin + 1) * (min(hi) - min(lo)) / 50, 6) AS hi, count(*) AS count
       FROM b GROUP BY bin""",
)
def q_histogram(spark, sf):
    _prep(spark)
    from tamis.operators.profile import histogram

    h = histogram(_t(spark, sf, "lineitem"), "l_extendedprice", 50)
    return h.select("bin", r6(F.col("lo")).alias("lo"), r6(F.col("hi")).alias("hi"), "count")


@_query(
    "box_summary",
    """WITH q AS (SELECT quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS q2, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem),
       f AS (SELECT q1, q2, q3, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
       SELECT round(min(q1), 6) AS q1, round(min(q2), 6) AS median, round(min(q3), 6) AS q3,
              round(min(CASE WHEN l_extendedprice >= lo AND l_extendedprice <= hi THEN l_extendedprice END), 6) AS lower_whisker,
              round(max(CASE WHEN l_extendedprice >= lo AND l_extendedprice <= hi THEN l_extendedprice END), 6) AS upper_whisker,
              count(CASE WHEN l_extendedprice < lo OR l_extendedprice > hi THEN 1 END) AS outliers FROM lineitem, f""",
)
def q_box(spark, sf):
    _prep(spark)
    from tamis.operators.profile import box_summary

    b = box_summary(_t(spark, sf, "lineitem"), "l_extendedprice")
    return b.select(*[r6(F.col(c)).alias(c) for c in ("q1", "median", "q3", "lower_whisker", "upper_whisker")], "outliers")


def _missing_matrix_sql():
    cols = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
    parts = [f"SELECT o_orderkey // 100 AS \"row\", '{c}' AS \"column\", ({c} IS NULL)::INT AS m FROM orders_missing" for c in cols]
    return with_views(f"SELECT \"row\", \"column\", sum(m)::BIGINT AS missing FROM ({' UNION ALL '.join(parts)}) GROUP BY \"row\", \"column\"", "orders_missing")


@_query("missing_matrix", _missing_matrix_sql())
def q_missing_matrix(spark, sf):
    from tamis.operators.profile import missing_matrix

    m = missing_matrix(orders_missing(spark, sf), "o_orderkey", 100)
    return m.select("row", "column", F.col("missing").cast("long").alias("missing"))


@_query(
    "line_series",
    """WITH b AS (SELECT epoch_us(ts) AS us, value FROM events), r AS (SELECT min(us) AS lo, max(us) AS hi FROM b),
       g AS (SELECT floor((us - lo) / ((hi - lo) // 1000 + 1)) AS bk, avg(value) AS value, min(us) AS t FROM b, r GROUP BY bk)
       SELECT make_timestamp(t) AS ts, round(value, 6) AS value FROM g""",
)
def q_line_series(spark, sf):
    from tamis.operators.profile import line_series

    s = line_series(_t(spark, sf, "events"), "ts", "value", 1000)
    return s.select("ts", r6(F.col("value")).alias("value"))


@_query("scatter_pairs", "SELECT l_quantity, l_extendedprice FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL")
def q_scatter(spark, sf):
    from tamis.operators.profile import scatter_pairs

    return scatter_pairs(_t(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")


# ---- A7 / A8 / A11 correlations ----------------------------------------------------------------------------

_PEARSON_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_derived"]


def _pearson_sql():
    parts = []
    for a in _PEARSON_COLS:
        for b in _PEARSON_COLS:
            if a == b:
                parts.append(f"SELECT '{a}' AS Variable1, '{b}' AS Variable2, 1.0::DOUBLE AS correlation")
            else:
                parts.append(f"SELECT '{a}', '{b}', round(coalesce(corr({a}, {b}), 0), 6) FROM line_corr")
    return with_views(" UNION ALL ".join(parts), "line_corr")


@_query("pearson_matrix", _pearson_sql())
def q_pearson(spark, sf):
    _prep(spark)
    from tamis.operators.correlation import pearson_matrix

    m = pearson_matrix(line_corr(spark, sf), _PEARSON_COLS)
    return m.select("Variable1", "Variable2", r6(F.col("correlation")).alias("correlation"))


_SPEARMAN_COLS = ["event_id", "user_id", "value"]


def _spearman_sql():
    ranks = ", ".join(
        f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS r_{c}" for c in _SPEARMAN_COLS
    )
    parts = []
    for a in _SPEARMAN_COLS:
        for b in _SPEARMAN_COLS:
            if a == b:
                parts.append(f"SELECT '{a}' AS Variable1, '{b}' AS Variable2, 1.0::DOUBLE AS correlation")
            else:
                parts.append(f"SELECT '{a}', '{b}', round(corr(r_{a}, r_{b}), 6) FROM rk")
    return f"WITH rk AS (SELECT {ranks} FROM events) " + " UNION ALL ".join(parts)


@_query("spearman_matrix", _spearman_sql())
def q_spearman(spark, sf):
    _prep(spark)
    from tamis.operators.correlation import spearman_matrix

    m = spearman_matrix(_t(spark, sf, "events"), _SPEARMAN_COLS)
    return m.select("Variable1", "Variable2", r6(F.col("correlation")).alias("correlation"))


@_query(
    "heatmap_top_pairs",
    with_views(
        ", m AS (" + _pearson_sql().split(" ", 1)[1].split(") ", 1)[1] + """)
        SELECT Variable1, Variable2, correlation FROM m WHERE Variable1 <> Variable2 ORDER BY abs(correlation) DESC, Variable1, Variable2 LIMIT 10""",
        "line_corr",
    ),
)
def q_heatmap(spark, sf):
    _prep(spark)
    from tamis.operators.correlation import heatmap_top_pairs, pearson_matrix

    m = pearson_matrix(line_corr(spark, sf), _PEARSON_COLS)
    m = m.select("Variable1", "Variable2", r6(F.col("correlation")).alias("correlation"), "n", "p_value")
    return heatmap_top_pairs(m)


def _highcorr_sql():
    parts = []
    for i, a in enumerate(_CORR_COLS):
        for b in _CORR_COLS[i + 1 :]:
            parts.append(f"SELECT '{a}' AS feature1, '{b}' AS feature2, round(abs(corr({a}, {b})), 6) AS correlation FROM line_corr")
    return with_views("SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE correlation > 0.7", "line_corr")


@_query("high_correlation_pairs", _highcorr_sql())
def q_highcorr(spark, sf):
    _prep(spark)
    from tamis.operators.correlation import high_correlation_pairs

    h = high_correlation_pairs(line_corr(spark, sf), _CORR_COLS)
    return h.select("feature1", "feature2", r6(F.col("correlation")).alias("correlation"))


@_query(
    "kendall_tau",
    """WITH d AS (SELECT row_number() OVER () AS i, CAST(user_id AS DOUBLE) AS x, value AS y FROM events
                 WHERE user_id IS NOT NULL AND value IS NOT NULL),
       p AS (SELECT sum(sign(a.x - b.x) * sign(a.y - b.y)) AS s, sum(CASE WHEN a.x = b.x THEN 1 ELSE 0 END) AS tx,
                    sum(CASE WHEN a.y = b.y THEN 1 ELSE 0 END) AS ty, count(*) AS n0 FROM d a JOIN d b ON a.i < b.i)
       SELECT round(s / sqrt((n0 - tx) * (n0 - ty)), 6) AS tau, (SELECT count(*) FROM d) AS n FROM p""",
)
def q_kendall(spark, sf):
    _prep(spark)
    from tamis.operators.correlation import kendall_tau_b

    tau, n, _ = kendall_tau_b(_t(spark, sf, "events"), "user_id", "value")
    return spark.createDataFrame([(round(tau, 6), n)], "tau double, n long")


@_query(
    "significant_pairs",
    "WITH every AS (" + _pearson_sql() + """)
        SELECT Variable1, Variable2, correlation, 0.0::DOUBLE AS p_value, CASE WHEN abs(correlation) >= 0.7 THEN 'strong' ELSE 'moderate' END AS strength
        FROM every WHERE Variable1 < Variable2 AND abs(correlation) >= 0.3""",  # so many rows: p is 0 to six places
)
def q_significant(spark, sf):
    _prep(spark)
    from tamis.operators.correlation import pearson_matrix, significant_pairs

    found = significant_pairs(pearson_matrix(line_corr(spark, sf), _PEARSON_COLS))
    return found.withColumns({c: r6(F.col(c)) for c in ("correlation", "p_value")})


# ---- A12–A14 importance --------------------------------------------------------------------------------------


def _fscore_sql():
    feats = ["doc_id", "n_chars", "quality"]
    parts = []
    for c in feats:
        parts.append(
            f"""SELECT '{c}' AS feature, round(((sum(ng * power(mg - gm, 2))) / (count(*) - 1)) / (sum(ssw) / (sum(ng) - count(*))), 4) AS f_score
            FROM (SELECT count({c}) AS ng, avg({c}) AS mg, sum(power({c} - (SELECT avg({c}) FROM label_docs l2 WHERE l2.toxic = g.toxic), 2)) AS ssw,
                         (SELECT avg({c}) FROM label_docs) AS gm
                  FROM label_docs g GROUP BY toxic) s"""
        )
    return with_views(" UNION ALL ".join(parts), "label_docs")


@_query("f_scores", _fscore_sql())
def q_fscores(spark, sf):
    from tamis.operators.importance import f_scores

    f = f_scores(label_docs(spark, sf), "toxic", ["doc_id", "n_chars", "quality"])
    return f.select("feature", F.round("f_score", 4).alias("f_score"))


def _mi_sql(b=10):
    feats = ["n_chars", "quality", "doc_id"]
    probs = ", ".join(str(i / b) for i in range(b + 1))
    parts = []
    for c in feats:
        parts.append(
            f"""SELECT '{c}' AS feature, CAST(toxic AS VARCHAR) AS y,
               coalesce(CASE WHEN {c} >= e.edges[1] AND {c} <= e.edges[len(e.edges)] THEN len(list_filter(e.edges[2:len(e.edges) - 1], lambda t: t < {c})) END, -1) AS bx
               FROM label_docs, (SELECT list_sort(list_distinct(quantile_cont({c}, [{probs}]))) AS edges FROM label_docs) e"""
        )
    return with_views(
        f""", cells AS ({" UNION ALL ".join(parts)}),
        c AS (SELECT feature, bx, y, count(*) AS n FROM cells GROUP BY feature, bx, y),
        p AS (SELECT feature, n / sum(n) OVER (PARTITION BY feature) AS pxy,
                     sum(n) OVER (PARTITION BY feature, bx) / sum(n) OVER (PARTITION BY feature) AS px,
                     sum(n) OVER (PARTITION BY feature, y) / sum(n) OVER (PARTITION BY feature) AS py FROM c)
        SELECT feature, round(sum(pxy * ln(pxy / (px * py))), 6) AS mutual_info FROM p GROUP BY feature""",
        "label_docs",
    )


@_query("mutual_information", _mi_sql())
def q_mi(spark, sf):
    _prep(spark)
    from tamis.operators.importance import mutual_information

    m = mutual_information(label_docs(spark, sf), "toxic", ["n_chars", "quality", "doc_id"])
    return m.select("feature", r6(F.col("mutual_info")).alias("mutual_info"))


@_query("forest_importance")
def q_forest(spark, sf):
    _prep(spark)
    from tamis.operators.importance import forest_importance

    return forest_importance(label_docs(spark, sf), "toxic", ["n_chars", "quality", "doc_id"], trees=20)


@_query("feature_impact")
def q_feature_impact(spark, sf):
    _prep(spark)
    from tamis.operators.importance import evaluate_features

    d = label_docs(spark, sf).withColumn("len_x_quality", F.col("n_chars") * F.col("quality"))
    r = evaluate_features(d, "toxic", ["n_chars"], ["quality", "len_x_quality"])
    return spark.createDataFrame([(r["metric"], r["before"], r["after"], r["improvement"])], "metric string, before double, after double, improvement double")


@_query("feature_preview")
def q_feature_preview(spark, sf):
    _prep(spark)
    from tamis.operators.features import batch_feature_preview

    d = _t(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    return batch_feature_preview(d)


# ---- R recommendations ---------------------------------------------------------------------------------------


_REC_COLS = [
    ("o_orderkey", "int"), ("o_custkey", "int"), ("o_orderstatus", "str"),
    ("o_totalprice", "float"), ("o_orderdate", "str"), ("o_orderpriority", "str"),
]


def _recommend_sql():
    parts = []
    seq = [0]

    def add(typ, c, sev, prio, value, src, cond):
        cs = "NULL" if c is None else f"'{c}'"
        parts.append(
            f"SELECT {seq[0]} AS seq, '{typ}' AS type, {cs} AS \"column\", '{sev}' AS severity, {prio}::DOUBLE AS priority, "
            f"CAST({value} AS DOUBLE) AS value FROM ({src}) WHERE {cond}"
        )
        seq[0] += 1

    nrows = "(SELECT count(*) FROM orders_missing)"
    for c, _ in _REC_COLS:  # R1
        add("missing_data", c, "high", 0.9, "(n - k) / n", f"SELECT count(*) AS n, count({c}) AS k FROM orders_missing", "(n - k) / n > 0.1")
    for c, t in _REC_COLS:  # R2
        if t == "str":
            continue
        src = (f"SELECT k, s, (SELECT count(*) FROM orders_missing, (SELECT avg({c}) AS m2, stddev_pop({c}) AS s2 FROM orders_missing) "
               f"WHERE s2 > 0 AND abs(({c} - m2) / s2) > 3) AS o FROM (SELECT count({c}) AS k, stddev_pop({c}) AS s FROM orders_missing)")
        add("outliers", c, "medium", 0.7, "o", src, f"k >= 2 AND s > 0 AND o > {nrows} * 0.05")
    for c, t in _REC_COLS:  # R3–R7
        if t != "str":
            continue
        vc = f"SELECT CAST({c} AS VARCHAR) AS v, count(*) AS k FROM orders_missing WHERE {c} IS NOT NULL GROUP BY 1"
        src = (f"SELECT sum(k) AS t, max(k) AS mx, min(k) AS mn, count(CASE WHEN k / (SELECT sum(k) FROM ({vc})) < 0.01 THEN 1 END) AS rare, "
               f"(SELECT count(DISTINCT {c}) FROM orders_missing) AS u FROM ({vc})")
        add("bias_risk", c, "medium", 0.8, "mx / t", src, "t IS NOT NULL AND mx / t > 0.8")
        add("class_imbalance", c, "high", 0.8, "mn / t", src, "t IS NOT NULL AND mn / t < 0.05")
        add("constant_category", c, "medium", 0.6, "mx / t", src, "t IS NOT NULL AND mx / t > 0.99")
        add("rare_categories", c, "low", 0.5, "rare", src, "t IS NOT NULL AND rare > 0")
        add("high_cardinality", c, "medium", 0.7, "u", src, f"t IS NOT NULL AND (u > {nrows} * 0.1 OR u > 50)")
    add("duplicates", None, "medium", 0.6, "d", f"SELECT {nrows} - (SELECT count(*) FROM (SELECT DISTINCT * FROM orders_missing)) AS d", f"d > {nrows} * 0.01")
    for c, t in _REC_COLS:  # R10
        if t == "int":
            add("numeric_to_categorical", c, "low", 0.5, "u", f"SELECT count(DISTINCT {c}) AS u FROM orders_missing", "u <= 20")
    for c, t in _REC_COLS:  # R11
        if t == "str":
            continue
        mom = (f"SELECT avg(power({c} - m, 2)) AS m2, avg(power({c} - m, 3)) AS m3 FROM orders_missing, "
               f"(SELECT avg({c}) AS m FROM orders_missing) WHERE {c} IS NOT NULL")
        add("high_skew", c, "medium", 0.7, "m3 / power(m2, 1.5)", mom, "m2 > 0 AND abs(m3 / power(m2, 1.5)) > 2")
    for c, t in _REC_COLS:  # R12
        if t == "str":
            continue
        add("boolean_disguised", c, "low", 0.5, "NULL", f"SELECT bool_and({c} IN (0, 1)) AS b, count({c}) AS k FROM orders_missing", "k > 0 AND b")
    for c, t in _REC_COLS:  # R13
        if t == "str":
            continue
        add("wide_numeric_range", c, "medium", 0.6, "r", f"SELECT max({c}) - min({c}) AS r FROM orders_missing", "r > 1e6")
    body = " UNION ALL ".join(parts)
    return with_views(
        f""", f AS ({body})
        SELECT (row_number() OVER (ORDER BY priority DESC, seq) - 1)::INTEGER AS rank, type, "column", severity, priority, round(value, 6) AS value FROM f""",
        "orders_missing",
    )


@_query("recommendations", _recommend_sql())
def q_recommendations(spark, sf):
    _prep(spark)
    from tamis.plans.recommend import analyze_dataset

    r = analyze_dataset(orders_missing(spark, sf))
    return r.select("rank", "type", "column", "severity", "priority", r6(F.col("value")).alias("value"))


# ---- K sinks and S sources: written to the shared scratch folder, read back ------------------------------------


def _scratch(spark, name):
    """A folder of this run under the checkpoint folder, which every executor shares."""
    from tamis.session import checkpoint_dir

    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


_SINK_SQL = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate, o_orderpriority FROM orders"
_SINK_SCHEMA = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate date, o_orderpriority string"


def _sink_rows(spark, sf):
    _prep(spark)
    return _t(spark, sf, "orders").select(*[F.col(c).cast("date").alias(c) if c == "o_orderdate" else c for c in (f.split()[0] for f in _SINK_SCHEMA.split(", "))])


@_query("sink_csv", _SINK_SQL)
def q_sink_csv(spark, sf):
    from tamis.sources.csv import read_csv
    from tamis.sources.sinks import write_csv

    path = _scratch(spark, "csv")
    write_csv(_sink_rows(spark, sf), path)
    return read_csv(spark, path, _SINK_SCHEMA)


@_query("sink_csv_gzip_inferred", _SINK_SQL.replace("CAST(o_orderdate AS DATE) AS o_orderdate", "CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS o_orderdate"))
def q_sink_csv_gzip(spark, sf):
    from tamis.sources.csv import read_csv
    from tamis.sources.sinks import write_csv

    path = _scratch(spark, "gzip")
    write_csv(_sink_rows(spark, sf), path, compression="gzip")
    return read_csv(spark, path)


@_query("source_csv_rejects", _SINK_SQL.replace("o_orderpriority FROM", "o_orderpriority, CAST(NULL AS VARCHAR) AS rejected FROM"))
def q_source_rejects(spark, sf):
    from tamis.sources.csv import read_csv

    path = _scratch(spark, "semicolons")
    _sink_rows(spark, sf).write.option("header", True).option("sep", ";").option("encoding", "iso-8859-1").csv(path)
    return read_csv(spark, path, _SINK_SCHEMA, encoding="latin-1", delimiter=";", rejects="rejected")


@_query("sink_parquet_partitioned", _SINK_SQL)
def q_sink_parquet(spark, sf):
    from tamis.sources.sinks import write_parquet

    path = _scratch(spark, "parquet")
    write_parquet(_sink_rows(spark, sf), path, compression="zstd", partition_by=["o_orderstatus"])
    return spark.read.schema(_SINK_SCHEMA).parquet(path)


@_query("sink_chosen_columns", "SELECT o_orderkey, o_totalprice FROM orders")
def q_sink_columns(spark, sf):
    from tamis.sources.sinks import export_columns

    path = _scratch(spark, "columns")
    export_columns(_sink_rows(spark, sf), path, ["o_orderkey", "o_totalprice"], fmt="parquet")
    return spark.read.parquet(path)


@_query("sink_matrix", _pearson_sql())
def q_sink_matrix(spark, sf):
    from tamis.operators.correlation import pearson_matrix
    from tamis.sources.csv import read_csv
    from tamis.sources.sinks import write_matrix

    _prep(spark)
    path = _scratch(spark, "matrix")
    write_matrix(pearson_matrix(line_corr(spark, sf), _PEARSON_COLS), path)
    m = read_csv(spark, path, "Variable1 string, Variable2 string, correlation double, n long, p_value double")
    return m.select("Variable1", "Variable2", r6(F.col("correlation")).alias("correlation"))


@_query("sink_bundle", "SELECT o_orderkey, (o_totalprice - lo) / (hi - lo) AS o_totalprice FROM orders, (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)")
def q_sink_bundle(spark, sf):
    from tamis.plans.pipeline import run_pipeline
    from tamis.sources.bundle import export_bundle, import_bundle

    path = _scratch(spark, "bundle")
    steps = [{"kind": "scale", "params": {"columns": ["o_totalprice"], "method": "minmax"}}]
    export_bundle(_sink_rows(spark, sf).select("o_orderkey", "o_totalprice"), steps, path)
    rows, steps, _ = import_bundle(spark, path)
    return run_pipeline(rows, steps)


@_query(
    "smooth_after_bfill",
    with_views(
        """, b AS (SELECT event_id, row_number() OVER (ORDER BY ts) AS rn, value FROM events_nulls),
        f AS (SELECT event_id, rn, first_value(value IGNORE NULLS) OVER (ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value FROM b)
        SELECT event_id, round(avg(value) OVER (ORDER BY rn ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS value FROM f""",
        "events_nulls",
    ),
)
def q_smooth_bfill(spark, sf):
    _prep(spark)
    d = _step(events_nulls(spark, sf), "smooth_time_series", column="value", method="moving_average", window=7, interpolate="bfill", order_by=["ts"])
    return d.select("event_id", r6(F.col("value")).alias("value"))


@_query(
    "spearman_with_gaps",
    with_views(
        """, p AS (SELECT event_id, user_id, value FROM events_nulls),
        r AS (SELECT rank() OVER (ORDER BY event_id) + (count(*) OVER (PARTITION BY event_id) - 1) / 2.0 AS a,
            rank() OVER (ORDER BY user_id) + (count(*) OVER (PARTITION BY user_id) - 1) / 2.0 AS b FROM p),
        s AS (SELECT rank() OVER (ORDER BY event_id) + (count(*) OVER (PARTITION BY event_id) - 1) / 2.0 AS a,
            rank() OVER (ORDER BY user_id) + (count(*) OVER (PARTITION BY user_id) - 1) / 2.0 AS b,
            rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS c FROM p WHERE value IS NOT NULL)
        SELECT 'event_id' AS x, 'user_id' AS y, round(corr(a, b), 6) AS correlation FROM r
        UNION ALL SELECT 'event_id', 'value', round(corr(a, c), 6) FROM s UNION ALL SELECT 'user_id', 'value', round(corr(b, c), 6) FROM s""",
        "events_nulls",
    ),
)
def q_spearman_gaps(spark, sf):
    _prep(spark)
    from tamis.operators.correlation import spearman_matrix

    m = spearman_matrix(events_nulls(spark, sf), ["event_id", "user_id", "value"]).where("Variable1 < Variable2")
    return m.select(F.col("Variable1").alias("x"), F.col("Variable2").alias("y"), r6(F.col("correlation")).alias("correlation"))


# ---- Q / P surface, S4 sample --------------------------------------------------------------------------------

_SQL_TEXT = "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM df WHERE o_orderdate >= TIMESTAMP '1995-01-01' GROUP BY o_orderstatus"


@_query("sql_over_table", _SQL_TEXT.replace("FROM df", "FROM orders"))
def q_sql(spark, sf):
    from tamis.plans.query import run_sql

    return run_sql(_t(spark, sf, "orders"), _SQL_TEXT)


@_query("filter_rows", "SELECT * FROM orders WHERE o_totalprice > 100000 AND o_orderstatus IN ('F', 'O')")
def q_filter(spark, sf):
    from tamis.plans.query import filter_rows

    return filter_rows(_t(spark, sf, "orders"), "o_totalprice > 100000 AND o_orderstatus IN ('F', 'O')")


@_query(
    "expression_column",
    "SELECT o_orderkey, round(CASE WHEN o_custkey = 0 THEN NULL ELSE ln(o_totalprice) / o_custkey END, 6) AS price_per_cust FROM orders",
)
def q_expression(spark, sf):
    from tamis.plans.query import add_expression_column

    d = add_expression_column(_t(spark, sf, "orders"), "log(o_totalprice) / o_custkey", "price_per_cust")
    return d.select("o_orderkey", r6(F.col("price_per_cust")).alias("price_per_cust"))


@_query("page_rows", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 100 OFFSET 300")
def q_page(spark, sf):
    from tamis.plans.query import page

    return page(_t(spark, sf, "orders"), ["o_orderkey"], 3, 100)


@_query(
    "column_finders",
    """SELECT 'date_like' AS finder, 'o_orderdate' AS "column" FROM orders_text_dates HAVING bool_or(regexp_matches(o_orderdate, '^\\d{4}-\\d{2}-\\d{2}'))
       UNION ALL SELECT 'url', 'url' FROM pages HAVING bool_or(regexp_matches(url, '^https?://'))
       UNION ALL SELECT 'boolean_like', 'p_flag' FROM part_types HAVING bool_and(coalesce(p_flag IN ('0', '1'), false))
       UNION ALL SELECT 'boolean_like', 'p_size_text' FROM part_types HAVING bool_and(coalesce(p_size_text IN ('0', '1'), false))""".replace(
        "FROM orders_text_dates", "FROM (" + VIEWS["orders_text_dates"] + ")"
    ).replace("FROM part_types", "FROM (" + VIEWS["part_types"] + ")"),
)
def q_finders(spark, sf):
    from tamis.plans.query import boolean_like_columns, date_like_columns, url_columns

    rows = [("date_like", c) for c in date_like_columns(orders_text_dates(spark, sf).select("o_orderdate"))]
    rows += [("url", c) for c in url_columns(_t(spark, sf, "pages").select("url"))]
    rows += [("boolean_like", c) for c in boolean_like_columns(part_types(spark, sf).select("p_flag", "p_size_text"))]
    return spark.createDataFrame(rows, "finder string, column string")


@_query(
    "sample_preview",
    f"SELECT * FROM orders ORDER BY {_hash_sql('o_orderkey', 42)}, o_orderkey LIMIT 1000",
)
def q_sample(spark, sf):
    from tamis.sources.sample import sample_for_preview

    return sample_for_preview(_t(spark, sf, "orders"), 1000, 42, ["o_orderkey"])


# ---- contract ------------------------------------------------------------------------------------------------


# ---- missing as NaN, integer columns, many columns and values ---------------------------------


@_query("impute_mean_integer", """SELECT p_partkey, round(coalesce(CASE WHEN p_partkey % 5 <> 0 THEN p_size END,
    (SELECT avg(p_size) FROM part WHERE p_partkey % 5 <> 0)), 6) AS p_size FROM part""")
def q_impute_mean_integer(spark, sf):
    d = _t(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 5 != 0, F.col("p_size")).alias("p_size"))
    return _step(d, "impute", columns=["p_size"], strategy="mean").select("p_partkey", r6(F.col("p_size")).alias("p_size"))


@_query("impute_mean_nan", with_views("SELECT event_id, round(coalesce(value, (SELECT avg(value) FROM events_nan)), 6) AS value FROM events_nan", "events_nan"))
def q_impute_mean_nan(spark, sf):
    out = _step(events_nan(spark, sf), "impute", columns=["value"], strategy="mean")
    return out.select("event_id", r6(F.col("value")).alias("value"))


@_query("scale_nan", with_views(
    "SELECT event_id, round((value - (SELECT avg(value) FROM events_nan)) / (SELECT stddev_pop(value) FROM events_nan), 6) AS value FROM events_nan", "events_nan"
))
def q_scale_nan(spark, sf):
    out = _step(events_nan(spark, sf), "scale", columns=["value"], method="standard")
    return out.select("event_id", r6(F.col("value")).alias("value"))


@_query("f_scores_shifted", _fscore_sql().replace("'n_chars' AS feature", "'far' AS feature"))
def q_f_scores_shifted(spark, sf):
    from tamis.operators.importance import f_scores

    d = label_docs(spark, sf).withColumn("far", F.col("n_chars") + F.lit(1e9))
    return f_scores(d, "toxic", ["doc_id", "far", "quality"]).select("feature", F.round("f_score", 4).alias("f_score"))


@_query("expression_modulo", """SELECT o_orderkey, round((o_custkey % 7) / 2.0 - o_totalprice / (o_custkey + (o_orderkey)) / -3.0 + 1.3e-8, 6) AS v,
    round(ln(abs(o_totalprice)) / nullif(o_custkey % 3, 0) + 1.3e-8, 6) AS w FROM orders""")
def q_expression_modulo(spark, sf):
    from tamis.plans.query import add_expression_column

    d = _t(spark, sf, "orders")
    d = add_expression_column(d, "o_custkey % 7 / 2 - o_totalprice / (o_custkey + (o_orderkey)) / -3", "v")
    d = add_expression_column(d, "log(abs(o_totalprice)) / (o_custkey % 3)", "w", check=False)
    # the small addend keeps exact halves off the rounding boundary, where engines differ
    return d.select("o_orderkey", r6(F.col("v") + F.lit(1.3e-8)).alias("v"), r6(F.col("w") + F.lit(1.3e-8)).alias("w"))


@_query("smooth_savgol_short_group", """SELECT o_orderkey, round(1.3e-6 + avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
    ROWS BETWEEN 50 PRECEDING AND CURRENT ROW), 4) AS o_totalprice FROM orders""")
def q_savgol_short(spark, sf):
    _prep(spark)
    d = _t(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    out = _step(d, "smooth_time_series", column="o_totalprice", method="savitzky_golay", window=51, order_by=["o_orderdate", "o_orderkey"], partition_by=["o_custkey"])
    return out.select("o_orderkey", F.round(F.col("o_totalprice") + F.lit(1.3e-6), 4).alias("o_totalprice"))


@_query("encode_ordinal_default", "SELECT o_orderkey, CAST(CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _ORDINAL.items()) + " END AS BIGINT) AS o_orderpriority FROM orders")
def q_ordinal_default(spark, sf):
    d = _t(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return _step(d, "encode", columns=["o_orderpriority"], method="ordinal", ordinal_mappings={"o_orderpriority": _ORDINAL})


@_query("encode_label_many_values", "SELECT o_orderkey, row_number() OVER (ORDER BY CAST(o_orderkey AS VARCHAR)) - 1 AS code FROM orders")
def q_label_many(spark, sf):
    _prep(spark)
    d = _t(spark, sf, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("code"))
    return _step(d, "encode", columns=["code"], method="label")


_MANY = 120


@_query("encode_onehot_many_values", "SELECT p_partkey, " + ", ".join(f"CAST(p_partkey % {_MANY} = {i} AS INTEGER) AS v_{i}" for i in range(_MANY)) + " FROM part")
def q_onehot_many(spark, sf):
    d = _t(spark, sf, "part").select("p_partkey", (F.col("p_partkey") % _MANY).cast("string").alias("v"))
    out = _step(d, "encode", columns=["v"], method="onehot", max_columns=_MANY)
    return out.select("p_partkey", *[F.col(c) if c in out.columns else F.lit(0).alias(c) for c in (f"v_{i}" for i in range(_MANY))])


def _many_columns(spark, sf):
    li = _t(spark, sf, "lineitem")
    return li.select(*[(F.col("l_extendedprice") + i * i * F.col("l_quantity")).alias(f"c{i:02d}") for i in range(24)])


_MANY_SQL = "WITH m AS (SELECT " + ", ".join(f"l_extendedprice + {i * i} * l_quantity AS c{i:02d}" for i in range(24)) + " FROM lineitem), r AS (SELECT " + ", ".join(
    f"corr(c{i:02d}, c{j:02d}) AS r{i}_{j}" for i in range(24) for j in range(i + 1, 24)
) + " FROM m) "


@_query("pearson_many_columns", _MANY_SQL + " UNION ALL ".join(
    f"SELECT 'c{i:02d}' AS a, 'c{j:02d}' AS b, round(r{min(i, j)}_{max(i, j)}, 6) AS r FROM r" for i in range(24) for j in range(24) if i != j
))
def q_pearson_many(spark, sf):
    from tamis.operators.correlation import pearson_matrix

    m = pearson_matrix(_many_columns(spark, sf)).where("Variable1 <> Variable2")
    return m.select(F.col("Variable1").alias("a"), F.col("Variable2").alias("b"), r6(F.col("correlation")).alias("r"))


def _knn_many_columns(d):
    return d.select("c_custkey", *[((F.col("c_custkey") * (i + 3)) % (17 + i)).cast("double").alias(f"x{i}") for i in range(23)],
                    F.when(F.col("c_custkey") % 6 != 0, F.col("c_acctbal")).alias("y"))


@_query("impute_knn_many_columns", "WITH m AS (SELECT c_custkey, " + ", ".join(f"CAST((c_custkey * {i + 3}) % {17 + i} AS DOUBLE) AS x{i}" for i in range(23)) + """,
    CASE WHEN c_custkey % 6 <> 0 THEN c_acctbal END AS y FROM customer),
    near AS (SELECT n.c_custkey, d.y, row_number() OVER (PARTITION BY n.c_custkey ORDER BY power(n.c_custkey - d.c_custkey, 2) + """ + " + ".join(
    f"power(n.x{i} - d.x{i}, 2)" for i in range(23)
) + """, d.c_custkey) AS k FROM m n JOIN m d ON n.y IS NULL AND d.y IS NOT NULL)
    SELECT c_custkey, round(y, 6) AS y FROM m WHERE y IS NOT NULL UNION ALL SELECT c_custkey, round(avg(y), 6) FROM near WHERE k <= 5 GROUP BY c_custkey""")
def q_knn_many(spark, sf):
    _prep(spark)
    out = _step(_knn_many_columns(_t(spark, sf, "customer")), "impute", columns=["y"], strategy="knn", n_neighbors=5)
    return out.select("c_custkey", r6(F.col("y")).alias("y"))


def _corpus_queries() -> tuple[dict, dict]:
    """Queries and SQL of the corpus operators; empty where that subpackage is not installed."""
    found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    sql: dict[str, str] = {}
    try:
        llm = importlib.import_module("tamis.llm.queries")
        found |= llm.QUERIES
        sql |= llm.ORACLE_SQL
        import corpus_pipeline

        found["pipeline"] = corpus_pipeline.run
        if corpus_pipeline.ORACLE_SQL:
            sql["pipeline"] = corpus_pipeline.ORACLE_SQL
    except ModuleNotFoundError as missing:
        if missing.name not in ("tamis.llm", "tamis.llm.queries", "corpus_pipeline"):
            raise
    return found, sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _Q | _corpus_queries()[0]


def oracle_sql() -> dict[str, str]:
    return _SQL | _corpus_queries()[1]
