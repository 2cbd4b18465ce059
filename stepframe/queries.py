"""One query for each operator and plan-level feature, over whole tables, with the SQL that checks it."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import Col, Plan, frame_hash
from .sources import read_table, shared_folder
from .streaming import stream_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def query(name: str, source: str, plan: Callable[[Plan], Plan], sql: str | None = None, order_by: str | None = None, references: dict[str, str] | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        others = {k: table(spark, sf_dir, v) for k, v in (references or {}).items()}
        return plan(Plan()).transform(table(spark, sf_dir, source), others, order_by=order_by)

    QUERIES[name] = run
    if sql is not None:
        ORACLE[name] = sql


def rounded(x: str, digits: int = 4) -> str:
    """The same rounding in Spark and in DuckDB."""
    return f"floor({x} * 1e{digits} + 0.5) / 1e{digits}"


_SECONDS = "CAST(date_diff('microsecond', {}, {}) AS DOUBLE) / 1e6"

# -- column operators
query("col_drop", "customer", lambda p: p.col_drop(["c_acctbal", "c_name"]), "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")
query("col_rename", "customer", lambda p: p.col_rename("c_name", "name"), "SELECT c_custkey, c_name AS name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
query("col_cast", "customer", lambda p: p.col_cast("c_custkey", "String").col_cast("c_nationkey", "Float64").col_drop("c_acctbal"), "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS DOUBLE) AS c_nationkey, c_mktsegment FROM customer")
query("col_reorder", "customer", lambda p: p.col_reorder(["c_mktsegment", "c_custkey"]), "SELECT c_mktsegment, c_custkey FROM customer")
query("col_select", "orders", lambda p: p.col_select(["o_orderkey", "o_totalprice"]), "SELECT o_orderkey, o_totalprice FROM orders")
query("col_duplicate", "nation", lambda p: p.col_duplicate("n_name", "copy"), "SELECT *, n_name AS copy FROM nation")
query("col_fill_null", "orders", lambda p: p.col_select(["o_orderkey", "o_orderstatus"]).map_value_to_null("o_orderstatus", "P").col_fill_null("o_orderstatus", "?"), "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'P'), '?') AS o_orderstatus FROM orders")
query("col_fill_null_zero", "lineitem", lambda p: p.col_select(["l_orderkey", "l_linenumber"]).map_value_to_null("l_linenumber", 3).col_fill_null("l_linenumber", strategy="zero"), "SELECT l_orderkey, coalesce(nullif(l_linenumber, 3), 0) AS l_linenumber FROM lineitem")
query("col_fill_null_forward", "events", lambda p: p.col_select(["event_id", "event_type"]).map_value_to_null("event_type", "error").col_fill_null("event_type", strategy="forward"), "SELECT event_id, last_value(nullif(event_type, 'error') IGNORE NULLS) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS event_type FROM events", "event_id")
query("col_fill_null_backward", "events", lambda p: p.col_select(["event_id", "event_type"]).map_value_to_null("event_type", "error").col_fill_null("event_type", strategy="backward"), "SELECT event_id, first_value(nullif(event_type, 'error') IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS event_type FROM events", "event_id")
query("col_fill_null_min_max", "events", lambda p: p.col_select(["event_id", "user_id", "event_type"]).map_value_to_null("user_id", 7).map_value_to_null("event_type", "view").col_fill_null("user_id", strategy="max").col_fill_null("event_type", strategy="min"), "SELECT event_id, coalesce(nullif(user_id, 7), (SELECT max(nullif(user_id, 7)) FROM events)) AS user_id, coalesce(nullif(event_type, 'view'), (SELECT min(nullif(event_type, 'view')) FROM events)) AS event_type FROM events")
query("col_drop_null", "orders", lambda p: p.col_select(["o_orderkey", "o_orderstatus"]).map_value_to_null("o_orderstatus", "F").col_drop_null("o_orderstatus"), "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F'")
query("col_drop_zero", "lineitem", lambda p: p.col_select(["l_orderkey", "l_discount"]).col_drop_zero("l_discount"), "SELECT l_orderkey, l_discount FROM lineitem WHERE l_discount <> 0")
query("col_add", "region", lambda p: p.col_add("flag", value="x").col_add("n", value=7).col_add("copy", "r_name"), "SELECT *, 'x' AS flag, CAST(7 AS BIGINT) AS n, r_name AS copy FROM region")


def uuids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids are random; how many there are, that all differ, and their length are not."""
    out = Plan().col_add_uuid("uid", 12).transform(table(spark, sf_dir, "customer"))
    return out.agg(F.count("c_custkey").alias("n"), F.count_distinct("uid").alias("different"), F.min(F.length("uid")).alias("shortest"), F.max(F.length("uid")).alias("longest"))


QUERIES["col_add_uuid"] = uuids
ORACLE["col_add_uuid"] = "SELECT count(*) AS n, count(*) AS different, CAST(12 AS INTEGER) AS shortest, CAST(12 AS INTEGER) AS longest FROM customer"
query("col_hash", "orders", lambda p: p.col_select(["o_orderkey", "o_orderstatus", "o_orderpriority"]).col_hash(["o_orderkey", "o_orderpriority"], "h", salt="s1"), "SELECT o_orderkey, o_orderstatus, o_orderpriority, substr(sha256(CAST(o_orderkey AS VARCHAR) || '|' || o_orderpriority || 's1'), 1, 16) AS h FROM orders")
query("col_coalesce", "customer", lambda p: p.col_select(["c_custkey", "c_mktsegment", "c_name"]).map_value_to_null("c_mktsegment", "BUILDING").col_coalesce(["c_mktsegment", "c_name"], "first"), "SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS c_mktsegment, c_name, coalesce(nullif(c_mktsegment, 'BUILDING'), c_name) AS first FROM customer")
query("col_expr", "part", lambda p: p.col_select(["p_partkey", "p_size"]).col_expr("big", "p_size * 2 > 50"), "SELECT p_partkey, p_size, p_size * 2 > 50 AS big FROM part")

# -- math operators
query("math_add", "lineitem", lambda p: p.col_select(["l_orderkey", "l_quantity", "l_tax"]).math_add(["l_quantity", "l_tax"], 1.5), "SELECT l_orderkey, l_quantity + 1.5::DOUBLE AS l_quantity, l_tax + 1.5::DOUBLE AS l_tax FROM lineitem")
query("math_subtract", "lineitem", lambda p: p.col_select(["l_orderkey", "l_partkey"]).math_subtract("l_partkey", 3), "SELECT l_orderkey, l_partkey - 3 AS l_partkey FROM lineitem")
query("math_multiply", "lineitem", lambda p: p.col_select(["l_orderkey", "l_quantity"]).math_multiply("l_quantity", 3), "SELECT l_orderkey, l_quantity * 3 AS l_quantity FROM lineitem")
query("math_divide", "lineitem", lambda p: p.col_select(["l_orderkey", "l_extendedprice", "l_tax"]).math_divide("l_extendedprice", 7).math_divide("l_tax", 0), "SELECT l_orderkey, l_extendedprice / 7 AS l_extendedprice, CASE WHEN l_tax = 0 THEN 'nan'::DOUBLE ELSE 'inf'::DOUBLE END AS l_tax FROM lineitem")
query("math_clamp", "part", lambda p: p.col_select(["p_partkey", "p_size"]).map_value_to_null("p_size", 5).math_clamp("p_size", 10, 40), "SELECT p_partkey, CASE WHEN p_size = 5 THEN NULL WHEN p_size < 10 THEN 10 WHEN p_size > 40 THEN 40 ELSE p_size END::BIGINT AS p_size FROM part")
query("math_add_columns", "lineitem", lambda p: p.math_add_columns("l_discount", "l_tax", "x").col_select(["l_orderkey", "x"]), "SELECT l_orderkey, l_discount + l_tax AS x FROM lineitem")
query("math_subtract_columns", "lineitem", lambda p: p.math_subtract_columns("l_partkey", "l_suppkey", "x").col_select(["l_orderkey", "x"]), "SELECT l_orderkey, l_partkey - l_suppkey AS x FROM lineitem")
query("math_multiply_columns", "lineitem", lambda p: p.math_multiply_columns("l_extendedprice", "l_discount", "x").col_select(["l_orderkey", "x"]), "SELECT l_orderkey, l_extendedprice * l_discount AS x FROM lineitem")
query("math_divide_columns", "lineitem", lambda p: p.math_divide_columns("l_extendedprice", "l_tax", "x").col_select(["l_orderkey", "x"]), "SELECT l_orderkey, CASE WHEN l_tax = 0 THEN 'inf'::DOUBLE ELSE l_extendedprice / nullif(l_tax, 0) END AS x FROM lineitem")
query("math_set_min", "part", lambda p: p.col_select(["p_partkey", "p_retailprice"]).math_set_min("p_retailprice", 1000.5), "SELECT p_partkey, CASE WHEN p_retailprice < 1000.5 THEN 1000.5::DOUBLE ELSE p_retailprice END AS p_retailprice FROM part")
query("math_set_max", "part", lambda p: p.col_select(["p_partkey", "p_retailprice"]).math_set_max("p_retailprice", 1200.5), "SELECT p_partkey, CASE WHEN p_retailprice > 1200.5 THEN 1200.5::DOUBLE ELSE p_retailprice END AS p_retailprice FROM part")
query("math_abs", "customer", lambda p: p.col_select(["c_custkey", "c_acctbal"]).math_abs("c_acctbal"), "SELECT c_custkey, abs(c_acctbal) AS c_acctbal FROM customer")
query("math_round", "customer", lambda p: p.col_select(["c_custkey", "c_acctbal"]).math_round("c_acctbal", 1), "SELECT c_custkey, sign(c_acctbal * 10) * floor(abs(c_acctbal * 10) + 0.5) / 10 AS c_acctbal FROM customer")
query("math_percent_of", "lineitem", lambda p: p.math_percent_of("l_tax", "l_quantity", "pct").col_select(["l_orderkey", "pct"]), "SELECT l_orderkey, l_tax / l_quantity * 100 AS pct FROM lineitem")
query("math_cumsum", "events", lambda p: p.math_cumsum("event_id", "run", group_by="user_id").col_select(["event_id", "user_id", "run"]), "SELECT event_id, user_id, CAST(sum(event_id) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM events", "event_id")
query("math_cumsum_all", "events", lambda p: p.math_cumsum("user_id", "run").col_select(["event_id", "run"]), "SELECT event_id, CAST(sum(user_id) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM events", "ts")
for _m, _e in {"ordinal": "row_number() OVER (PARTITION BY user_id ORDER BY event_type, event_id)", "dense": "dense_rank() OVER w", "min": "rank() OVER w", "max": "rank() OVER w + count(*) OVER (PARTITION BY user_id, event_type) - 1", "average": "rank() OVER w + (count(*) OVER (PARTITION BY user_id, event_type) - 1) / 2.0::DOUBLE"}.items():
    query(f"math_rank_{_m}", "events", lambda p, m=_m: p.math_rank("event_type", "r", m, group_by="user_id").col_select(["event_id", "r"]), f"SELECT event_id, CAST({_e} AS {'DOUBLE' if _m == 'average' else 'BIGINT'}) AS r FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_type)", "event_id")
query("math_rank_descending", "customer", lambda p: p.math_rank("c_acctbal", "r", "dense", descending=True, group_by="c_nationkey").col_select(["c_custkey", "r"]), "SELECT c_custkey, dense_rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) AS r FROM customer")
query("math_rank_random", "events", lambda p: p.math_rank("event_type", "r", "random", group_by="user_id").col_select(["user_id", "r"]), "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events")
for _a, _e in {"min": "min", "max": "max", "count": "count", "sum": "sum"}.items():
    query(f"math_diff_from_agg_{_a}", "events", lambda p, a=_a: p.math_diff_from_agg("event_id", a, "d", group_by="user_id").col_select(["event_id", "d"]), f"SELECT event_id, CAST(event_id - {_e}(event_id) OVER (PARTITION BY user_id) AS BIGINT) AS d FROM events")
query("math_diff_from_agg_first", "events", lambda p: p.math_diff_from_agg("user_id", "first", "d", group_by="event_type").col_select(["event_id", "d"]), "SELECT event_id, user_id - first_value(user_id) OVER (PARTITION BY event_type ORDER BY event_id) AS d FROM events", "event_id")
query("math_diff_from_agg_all", "orders", lambda p: p.math_diff_from_agg("o_totalprice", "median", "m").math_diff_from_agg("o_orderkey", "min", "d").col_expr("dm", rounded("m")).col_select(["o_orderkey", "dm", "d"]), f"SELECT o_orderkey, {rounded('(o_totalprice - (SELECT median(o_totalprice) FROM orders))')} AS dm, o_orderkey - (SELECT min(o_orderkey) FROM orders) AS d FROM orders")
query("math_diff_from_agg_mean", "orders", lambda p: p.math_diff_from_agg("o_totalprice", "mean", "m", group_by="o_orderstatus").col_expr("d", rounded("m", 2)).col_select(["o_orderkey", "d"]), f"SELECT o_orderkey, {rounded('(o_totalprice - avg(o_totalprice) OVER (PARTITION BY o_orderstatus))', 2)} AS d FROM orders")
query("math_diff_from_agg_time", "events", lambda p: p.math_diff_from_agg("ts", "min", "d", group_by="user_id").col_expr("s", "CAST(d AS DECIMAL(38, 6)) * 1.0").col_expr("seconds", "CAST(s AS DOUBLE)").col_select(["event_id", "seconds"]), f"SELECT event_id, {_SECONDS.format('min(ts) OVER (PARTITION BY user_id)', 'ts')} AS seconds FROM events")
query("math_diff_lag", "events", lambda p: p.math_diff_lag("event_id", order_by="ts", new_column="d", group_by="user_id", lag=2).col_select(["event_id", "d"]), "SELECT event_id, event_id - lag(event_id, 2) OVER (PARTITION BY user_id ORDER BY ts) AS d FROM events")
query("math_diff_lag_all", "events", lambda p: p.math_diff_lag("user_id", order_by="ts", new_column="d").col_select(["event_id", "d"]), "SELECT event_id, user_id - lag(user_id) OVER (ORDER BY ts) AS d FROM events")
query("math_standardize", "orders", lambda p: p.math_standardize("o_totalprice", new_column="z").col_expr("s", rounded("z")).col_select(["o_orderkey", "s"]), f"SELECT o_orderkey, {rounded('((o_totalprice - (SELECT avg(o_totalprice) FROM orders)) / (SELECT stddev_samp(o_totalprice) FROM orders))')} AS s FROM orders")
query("math_minmax", "orders", lambda p: p.math_minmax("o_totalprice", feature_range=(-1, 1), new_column="z").col_expr("s", rounded("z")).col_select(["o_orderkey", "s"]), f"SELECT o_orderkey, {rounded('(-1 + (o_totalprice - (SELECT min(o_totalprice) FROM orders)) * 2 / (SELECT max(o_totalprice) - min(o_totalprice) FROM orders))')} AS s FROM orders")
query("math_robust_scale", "orders", lambda p: p.math_robust_scale("o_totalprice", new_column="z").col_expr("s", rounded("z")).col_select(["o_orderkey", "s"]), f"SELECT o_orderkey, {rounded('((o_totalprice - (SELECT quantile_cont(o_totalprice, 0.5) FROM orders)) / (SELECT quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25) FROM orders))')} AS s FROM orders")
query("math_log", "lineitem", lambda p: p.math_log("l_quantity", base=2, offset=1, new_column="z").math_log("l_discount", new_column="zero").col_expr("s", rounded("z", 6)).col_expr("inf", "zero = double('-infinity')").col_select(["l_orderkey", "s", "inf"]), f"SELECT l_orderkey, {rounded('(ln(l_quantity + 1) / ln(2.0::DOUBLE))', 6)} AS s, l_discount = 0 AS inf FROM lineitem")
query("math_sqrt", "lineitem", lambda p: p.math_sqrt("l_quantity", new_column="z").col_expr("s", rounded("z", 6)).col_select(["l_orderkey", "s"]), f"SELECT l_orderkey, {rounded('sqrt(l_quantity)', 6)} AS s FROM lineitem")
query("math_power", "lineitem", lambda p: p.math_power("l_quantity", 1.5, new_column="z").col_expr("s", rounded("z", 6)).col_select(["l_orderkey", "s"]), f"SELECT l_orderkey, {rounded('pow(l_quantity, 1.5::DOUBLE)', 6)} AS s FROM lineitem")
query("math_winsorize", "orders", lambda p: p.math_winsorize("o_totalprice", lower=0.05, upper=0.9, new_column="z").col_expr("s", rounded("z", 2)).col_select(["o_orderkey", "s"]), f"SELECT o_orderkey, {rounded('least(greatest(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.05) FROM orders)), (SELECT quantile_cont(o_totalprice, 0.9) FROM orders))', 2)} AS s FROM orders")

# -- row operators
query("rows_drop_nulls", "orders", lambda p: p.col_select(["o_orderkey", "o_orderstatus"]).map_value_to_null("o_orderstatus", "O").rows_drop_nulls(), "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'O'")
query("rows_unique_first", "events", lambda p: p.rows_unique(["user_id", "event_type"]).col_select(["event_id", "user_id", "event_type"]), "SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1", "event_id")
query("rows_unique_last", "events", lambda p: p.rows_unique("user_id", keep="last").col_select(["event_id", "user_id"]), "SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1", "event_id")
query("rows_unique_any", "lineitem", lambda p: p.col_select(["l_returnflag", "l_linestatus", "l_linenumber"]).rows_unique(keep="any"), "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
query("rows_unique_none", "lineitem", lambda p: p.col_select(["l_orderkey", "l_linenumber", "l_partkey"]).rows_unique(["l_orderkey", "l_linenumber"], keep="none"), "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber) = 1")
query("rows_filter", "orders", lambda p: p.rows_filter((Col("o_totalprice").between(50000, 200000) & ~Col("o_orderstatus").is_in(["P"])) | Col("o_orderpriority").str_starts_with("1-")), "SELECT * FROM orders WHERE (o_totalprice BETWEEN 50000 AND 200000 AND NOT o_orderstatus IN ('P')) OR starts_with(o_orderpriority, '1-')")
query("rows_filter_compare", "orders", lambda p: p.rows_filter((Col("o_totalprice") > 1000) & (Col("o_orderdate") >= dt.datetime(1996, 6, 1)) & (Col("o_orderstatus") != "F") & ((Col("o_custkey") <= 900) | (Col("o_custkey") == 1000) | (Col("o_custkey") < 5))), "SELECT * FROM orders WHERE o_totalprice > 1000 AND o_orderdate >= TIMESTAMP '1996-06-01' AND o_orderstatus <> 'F' AND (o_custkey <= 900 OR o_custkey = 1000 OR o_custkey < 5)")
query("rows_filter_strings", "part", lambda p: p.map_value_to_null("p_brand", "Brand#11").rows_filter((Col("p_type").str_contains("a") | Col("p_type").str_contains("^[S-Z].*D$", literal=False) | Col("p_name").str_ends_with("1") | Col("p_brand").is_null()) & (Col("p_brand").is_not_null() | (Col("p_brand") == None))), "SELECT p_partkey, p_name, nullif(p_brand, 'Brand#11') AS p_brand, p_type, p_size, p_retailprice FROM part WHERE contains(p_type, 'a') OR regexp_matches(p_type, '^[S-Z].*D$') OR ends_with(p_name, '1') OR nullif(p_brand, 'Brand#11') IS NULL")  # noqa: E711
query("rows_drop", "orders", lambda p: p.col_select(["o_orderkey", "o_orderstatus"]).map_value_to_null("o_orderstatus", "P").rows_drop(Col("o_orderstatus") == "F"), "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'O'")
query("rows_deduplicate", "events", lambda p: p.rows_deduplicate("user_id", "ts", keep="last").col_select(["event_id", "user_id"]), "SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) = 1")
query("rows_explode", "embeddings", lambda p: p.col_select(["vec_id", "embedding"]).rows_explode("embedding"), "SELECT vec_id, unnest(embedding) AS embedding FROM embeddings")
query("rows_melt", "customer", lambda p: p.col_cast("c_nationkey", "Float64").rows_melt(["c_custkey"], ["c_nationkey", "c_acctbal"], "what", "v"), "SELECT c_custkey, 'c_nationkey' AS what, CAST(c_nationkey AS DOUBLE) AS v FROM customer UNION ALL SELECT c_custkey, 'c_acctbal', c_acctbal FROM customer")


def sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rows a sample has is random; that they are rows of the table, how many, and that none comes twice is not."""
    orders = table(spark, sf_dir, "orders")
    out = []
    for name, params in (("tenth", {"fraction": 0.1}), ("hundred", {"n": 100}), ("all", {"fraction": 1.0}), ("none", {"n": 0})):
        rows = Plan().rows_sample(**params, seed=3).transform(orders).join(orders.select("o_orderkey", F.col("o_custkey").alias("own")), "o_orderkey", "left")
        out.append(rows.agg(F.lit(name).alias("sample"), F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderkey").alias("different"), F.count_if(F.col("own") == F.col("o_custkey")).alias("found")))
    return out[0].union(out[1]).union(out[2]).union(out[3])


QUERIES["rows_sample"] = sampled
ORACLE["rows_sample"] = """
SELECT sample, n, n AS different, n AS found
FROM (SELECT count(*) AS c FROM orders), LATERAL (VALUES ('tenth', CAST(floor(c * 0.1) AS BIGINT)), ('hundred', least(c, 100)), ('all', c), ('none', 0)) t(sample, n)
"""
query("rows_head", "events", lambda p: p.rows_head(25), "SELECT * FROM events ORDER BY event_id LIMIT 25", "event_id")
query("rows_tail", "events", lambda p: p.rows_tail(25), "SELECT * FROM events ORDER BY event_id DESC LIMIT 25", "event_id")
query("rows_sort", "orders", lambda p: p.rows_sort(["o_totalprice", "o_orderkey"], descending=[True, False]).col_select(["o_orderkey", "o_totalprice"]), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey")
query("rows_sort_head", "orders", lambda p: p.rows_sort(["o_totalprice", "o_orderkey"], descending=True).rows_head(40).col_select(["o_orderkey", "o_totalprice"]), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 40")
query("rows_flag", "orders", lambda p: p.rows_flag(Col("o_totalprice") > 150000, "big", true_value="yes", false_value="no").col_select(["o_orderkey", "big"]), "SELECT o_orderkey, CASE WHEN o_totalprice > 150000 THEN 'yes' ELSE 'no' END AS big FROM orders")
query("rows_pivot", "lineitem", lambda p: p.rows_pivot("l_returnflag", "l_linenumber", "l_orderkey", "count"), "SELECT l_returnflag, " + ", ".join(f"count(*) FILTER (WHERE l_linenumber = {i}) AS \"{i}\"" for i in range(1, 8)) + " FROM lineitem GROUP BY l_returnflag")
query("rows_pivot_sum", "events", lambda p: p.rows_pivot("user_id", "event_type", "event_id", "sum"), "SELECT user_id, " + ", ".join(f"CAST(sum(event_id) FILTER (WHERE event_type = '{k}') AS BIGINT) AS \"{k}\"" for k in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY user_id")
query("rows_pivot_first", "events", lambda p: p.rows_pivot("user_id", "event_type", "event_id", "first"), "SELECT user_id, " + ", ".join(f"arg_min(event_id, event_id) FILTER (WHERE event_type = '{k}') AS \"{k}\"" for k in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY user_id", "event_id")

# -- string operators
query("str_replace", "orders", lambda p: p.col_select(["o_orderkey", "o_orderpriority"]).col_duplicate("o_orderpriority", "x").str_replace("o_orderpriority", "-", ": ").str_replace("x", r"(\d)-(\w+)", "$2/$1", literal=False), r"SELECT o_orderkey, replace(o_orderpriority, '-', ': ') AS o_orderpriority, regexp_replace(o_orderpriority, '(\d)-(\w+)', '\2/\1', 'g') AS x FROM orders")
query("str_slice", "documents", lambda p: p.col_select(["doc_id", "text", "lang"]).str_slice("text", -9, 4).str_slice("lang", 1), "SELECT doc_id, CASE WHEN length(text) >= 9 THEN substr(text, length(text) - 8, 4) ELSE substr(text, 1, greatest(length(text) - 5, 0)) END AS text, substr(lang, 2) AS lang FROM documents")
query("str_truncate", "documents", lambda p: p.col_select(["doc_id", "text"]).str_truncate("text", 40), "SELECT doc_id, CASE WHEN length(text) > 40 THEN substr(text, 1, 37) || '...' ELSE text END AS text FROM documents")
query("str_split", "orders", lambda p: p.col_select(["o_orderkey", "o_orderpriority"]).str_split("o_orderpriority", "-", ["level", "label", "none"]), "SELECT o_orderkey, split_part(o_orderpriority, '-', 1) AS level, split_part(o_orderpriority, '-', 2) AS label, CAST(NULL AS VARCHAR) AS \"none\" FROM orders")
query("str_split_rows", "documents", lambda p: p.col_select(["doc_id", "text"]).str_split("text", "\n"), "SELECT doc_id, unnest(string_split(text, chr(10))) AS text FROM documents")
query("str_lower", "documents", lambda p: p.col_select(["doc_id", "text"]).str_lower("text"), "SELECT doc_id, lower(text) AS text FROM documents")
query("str_upper", "customer", lambda p: p.str_upper(["c_name", "c_mktsegment"]).col_select(["c_custkey", "c_name", "c_mktsegment"]), "SELECT c_custkey, upper(c_name) AS c_name, upper(c_mktsegment) AS c_mktsegment FROM customer")
query("str_strip", "customer", lambda p: p.col_expr("x", "concat(' \t', c_name, '\n ')").str_strip("x").str_strip("c_name", "Cr#0").col_select(["c_custkey", "x", "c_name"]), "SELECT c_custkey, c_name AS x, trim(c_name, 'Cr#0') AS c_name FROM customer")
query("str_pad", "nation", lambda p: p.str_pad("n_name", 8, "*").col_select(["n_nationkey", "n_name"]), "SELECT n_nationkey, CASE WHEN length(n_name) < 8 THEN lpad(n_name, 8, '*') ELSE n_name END AS n_name FROM nation")
query("str_concat", "orders", lambda p: p.map_value_to_null("o_orderstatus", "P").str_concat(["o_orderstatus", "o_orderpriority"], "x", " / ").col_select(["o_orderkey", "x"]), "SELECT o_orderkey, nullif(o_orderstatus, 'P') || ' / ' || o_orderpriority AS x FROM orders")
query("str_extract", "orders", lambda p: p.str_extract("o_orderpriority", r"^[1-3]-(\w+)", 1, "x").col_select(["o_orderkey", "x"]), r"SELECT o_orderkey, CASE WHEN regexp_matches(o_orderpriority, '^[1-3]-(\w+)') THEN regexp_extract(o_orderpriority, '^[1-3]-(\w+)', 1) END AS x FROM orders")

# -- date and time operators
for _f in ("year", "month", "day", "week", "quarter"):
    query(f"dt_{_f}", "orders", lambda p, f=_f: p.add(f"dt_{f}", "o_orderdate", "x").col_select(["o_orderkey", "x"]), f"SELECT o_orderkey, CAST({_f}(o_orderdate) AS BIGINT) AS x FROM orders")
query("dt_year_month", "orders", lambda p: p.dt_year_month("o_orderdate", "x").col_select(["o_orderkey", "x"]), "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS x FROM orders")
query("dt_quarter_year", "orders", lambda p: p.dt_quarter_year("o_orderdate", "x").col_select(["o_orderkey", "x"]), "SELECT o_orderkey, 'Q' || quarter(o_orderdate) || '-' || year(o_orderdate) AS x FROM orders")
query("dt_calendar_week", "orders", lambda p: p.dt_calendar_week("o_orderdate", "x").col_select(["o_orderkey", "x"]), "SELECT o_orderkey, strftime(o_orderdate, '%G-W%V') AS x FROM orders")
query("dt_parse", "orders", lambda p: p.dt_format("o_orderdate", "%d/%m/%Y", "s").dt_parse("s", "%d/%m/%Y", "x").dt_parse("o_orderpriority").col_select(["o_orderkey", "x", "o_orderpriority"]), "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS x, CAST(NULL AS DATE) AS o_orderpriority FROM orders")
query("dt_format", "events", lambda p: p.dt_format("ts", "%d.%m.%Y at %H:%M:%S, day %j (%a)", "x").col_select(["event_id", "x"]), "SELECT event_id, strftime(ts, '%d.%m.%Y at %H:%M:%S, day %j (%a)') AS x FROM events")
query("dt_diff_days", "events", lambda p: p.col_expr("t0", "TIMESTAMP_NTZ '2024-01-01 12:00:00'").dt_diff_days("ts", "t0", "x").col_select(["event_id", "x"]), "SELECT event_id, CAST(trunc(date_diff('microsecond', TIMESTAMP '2024-01-01 12:00:00', ts) / 86400000000) AS BIGINT) AS x FROM events")
query("dt_age_years", "orders", lambda p: p.col_expr("now", "TIMESTAMP_NTZ '2000-06-30 00:00:00'").dt_age_years("o_orderdate", "now", "x").col_select(["o_orderkey", "x"]), "SELECT o_orderkey, CAST(floor(trunc(date_diff('microsecond', o_orderdate, TIMESTAMP '2000-06-30') / 86400000000) / 365) AS BIGINT) AS x FROM orders")
for _u, _w in {"1mo": "month", "1w": "week", "1q": "quarter", "1y": "year", "1d": "day", "1h": "hour"}.items():
    query(f"dt_truncate_{_w}", "events", lambda p, u=_u: p.dt_truncate("ts", u, "x").col_select(["event_id", "x"]), f"SELECT event_id, CAST(date_trunc('{_w}', ts) AS TIMESTAMP) AS x FROM events")
query("dt_truncate_multiple", "events", lambda p: p.dt_truncate("ts", "15m", "x").col_select(["event_id", "x"]), "SELECT event_id, time_bucket(INTERVAL '15 minutes', ts, TIMESTAMP '1970-01-01') AS x FROM events")
query("dt_is_between", "orders", lambda p: p.dt_is_between("o_orderdate", "1996-03-01", "1998-01-01", "x", closed="left").col_select(["o_orderkey", "x"]), "SELECT o_orderkey, o_orderdate >= TIMESTAMP '1996-03-01' AND o_orderdate < TIMESTAMP '1998-01-01' AS x FROM orders")

# -- mapping and encoding operators
_SEGMENTS = {"BUILDING": "B", "MACHINERY": "M"}
query("map_values", "customer", lambda p: p.map_values("c_mktsegment", _SEGMENTS).col_select(["c_custkey", "c_mktsegment"]), "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'B' WHEN 'MACHINERY' THEN 'M' ELSE c_mktsegment END AS c_mktsegment FROM customer")
query("map_values_default", "customer", lambda p: p.map_values("c_mktsegment", _SEGMENTS, default="?", keep_unmapped=False).col_select(["c_custkey", "c_mktsegment"]), "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'B' WHEN 'MACHINERY' THEN 'M' ELSE '?' END AS c_mktsegment FROM customer")
query("map_values_large", "lineitem", lambda p: p.map_values("l_suppkey", {i: i * 7 for i in range(2000)}, default=-1, keep_unmapped=False).col_select(["l_orderkey", "l_suppkey"]), "SELECT l_orderkey, CASE WHEN l_suppkey < 2000 THEN l_suppkey * 7 ELSE -1 END AS l_suppkey FROM lineitem")
query("map_discretize", "part", lambda p: p.map_discretize("p_size", [10, 25], new_column="x").map_discretize("p_size", [10, 25], ["s", "m", "l"], "y", right=False).col_select(["p_partkey", "x", "y"]), "SELECT p_partkey, CASE WHEN p_size <= 10 THEN '(-inf, 10]' WHEN p_size <= 25 THEN '(10, 25]' ELSE '(25, inf]' END AS x, CASE WHEN p_size < 10 THEN 's' WHEN p_size < 25 THEN 'm' ELSE 'l' END AS y FROM part")
query("map_bool_to_int", "part", lambda p: p.col_expr("x", "p_size > 20").map_bool_to_int("x").col_select(["p_partkey", "x"]), "SELECT p_partkey, CAST(p_size > 20 AS BIGINT) AS x FROM part")
query("map_null_to_value", "orders", lambda p: p.map_value_to_null("o_orderstatus", "P").map_null_to_value("o_orderstatus", "none").col_select(["o_orderkey", "o_orderstatus"]), "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'none' ELSE o_orderstatus END AS o_orderstatus FROM orders")
query("map_value_to_null", "orders", lambda p: p.map_value_to_null("o_orderstatus", "P").col_select(["o_orderkey", "o_orderstatus"]), "SELECT o_orderkey, nullif(o_orderstatus, 'P') AS o_orderstatus FROM orders")
query("map_case", "orders", lambda p: p.map_case("o_orderstatus", [("F", 1), ("O", 2), ("F", 3)], default=0, new_column="x").col_select(["o_orderkey", "x"]), "SELECT o_orderkey, CAST(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS BIGINT) AS x FROM orders")
query("map_from_column", "nation", lambda p: p.map_from_column("n_regionkey", "n_nationkey", "n_name", "x", default="?").col_select(["n_nationkey", "x"]), "SELECT a.n_nationkey, coalesce(b.n_name, '?') AS x FROM nation a LEFT JOIN nation b ON a.n_regionkey = b.n_nationkey", "n_nationkey")
query("map_onehot", "orders", lambda p: p.col_select(["o_orderkey", "o_orderstatus"]).map_onehot("o_orderstatus", prefix="s"), "SELECT o_orderkey, CAST(o_orderstatus = 'F' AS BIGINT) AS s_F, CAST(o_orderstatus = 'O' AS BIGINT) AS s_O, CAST(o_orderstatus = 'P' AS BIGINT) AS s_P FROM orders")
query("map_onehot_given", "orders", lambda p: p.col_select(["o_orderkey", "o_orderstatus"]).map_onehot("o_orderstatus", ["F", "O"], prefix="s", drop="first", unknown_value="ignore", drop_original=False), "SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus IN ('F', 'O') THEN CAST(o_orderstatus = 'O' AS BIGINT) END AS s_O FROM orders")
query("map_ordinal", "orders", lambda p: p.col_select(["o_orderkey", "o_orderstatus"]).map_ordinal("o_orderstatus", ["O", "F"], "x"), "SELECT o_orderkey, CAST(CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'F' THEN 1 ELSE -1 END AS BIGINT) AS x FROM orders")
query("map_label", "orders", lambda p: p.col_select(["o_orderkey", "o_orderpriority"]).map_label("o_orderpriority"), "SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS o_orderpriority FROM orders")

# -- join
query("join", "orders", lambda p: p.join("o_custkey", "customer", left_on="o_custkey", right_on="c_custkey", select_columns=["c_name", "c_mktsegment"]), "SELECT o.*, c.c_name, c.c_mktsegment FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey", references={"customer": "customer"})
query("join_left", "customer", lambda p: p.rows_filter(Col("c_acctbal") > 0).join("c_nationkey", "n", "left", right_on="n_nationkey").join("n_regionkey", "r", "left", left_on="n_regionkey", right_on="r_regionkey").col_select(["c_custkey", "n_name", "r_name"]), "SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal > 0", references={"n": "nation", "r": "region"})
query("join_suffix", "nation", lambda p: p.join("n_nationkey", "other", suffix="_2", left_on="n_regionkey", right_on="n_nationkey"), "SELECT a.n_nationkey, a.n_name, a.n_regionkey, b.n_name AS n_name_2, b.n_regionkey AS n_regionkey_2 FROM nation a JOIN nation b ON a.n_regionkey = b.n_nationkey", references={"other": "nation"})


# -- plan-level features
def revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: filter, compute, round, group by running order, sort and take the top."""
    plan = (
        Plan()
        .section("select")
        .rows_filter(Col("l_discount").between(0.05, 0.07) & (Col("l_quantity") < 24))
        .section("compute")
        .math_multiply_columns("l_extendedprice", "l_discount", "revenue")
        .math_round("revenue", 2)
        .because("cents")
        .col_select(["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "revenue"])
        .rows_sort(["revenue", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"], descending=[True, False, False, False, False])
        .rows_head(100)
    )
    return plan.transform(table(spark, sf_dir, "lineitem"))


QUERIES["plan_revenue"] = revenue
ORACLE["plan_revenue"] = "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, floor(l_extendedprice * l_discount * 100 + 0.5) / 100 AS revenue FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24 ORDER BY revenue DESC, l_orderkey, l_partkey, l_suppkey, l_linenumber LIMIT 100"

_AUDITED = Plan().rows_filter(Col("o_orderstatus") == "F").col_select(["o_orderkey", "o_totalprice", "o_orderpriority"]).rows_sort("o_orderkey").rows_head(1000).rows_unique("o_orderpriority", keep="any")


def audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and columns after each step, as the audit saw them."""
    _, protocol = _AUDITED.process(table(spark, sf_dir, "orders"), audit="shape")
    return protocol.to_dataframe(spark).select("step", "operation", "rows_after", F.col("columns_after").cast("long").alias("columns_after"))


QUERIES["plan_audit"] = audited
ORACLE["plan_audit"] = """
WITH f AS (SELECT * FROM orders WHERE o_orderstatus = 'F'), h AS (SELECT * FROM f ORDER BY o_orderkey LIMIT 1000)
SELECT CAST(1 AS INTEGER) AS step, 'rows_filter' AS operation, count(*) AS rows_after, CAST(6 AS BIGINT) AS columns_after FROM f
UNION ALL SELECT 2, 'col_select', count(*), 3 FROM f UNION ALL SELECT 3, 'rows_sort', count(*), 3 FROM f
UNION ALL SELECT 4, 'rows_head', count(*), 3 FROM h UNION ALL SELECT 5, 'rows_unique', count(DISTINCT o_orderpriority), 3 FROM h
"""


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan that went through JSON and code."""
    plan = Plan().rows_filter(Col("o_orderdate") < dt.datetime(1997, 5, 1)).map_values("o_custkey", {1: 100, 2: 200}).dt_year("o_orderdate", "year").col_select(["o_orderkey", "o_custkey", "year"])
    scope: dict = {}
    exec(Plan.from_json(plan.to_json()).to_python("rebuilt"), scope)  # noqa: S102  our own code
    return scope["rebuilt"].transform(table(spark, sf_dir, "orders"))


QUERIES["plan_round_trip"] = stored
ORACLE["plan_round_trip"] = "SELECT o_orderkey, CASE o_custkey WHEN 1 THEN 100 WHEN 2 THEN 200 ELSE o_custkey END AS o_custkey, year(o_orderdate) AS year FROM orders WHERE o_orderdate < TIMESTAMP '1997-05-01'"


def chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = Plan().math_cumsum("l_linenumber", "run", group_by="l_orderkey").rows_unique("l_orderkey", keep="none").col_select(["l_orderkey", "l_partkey"])
    return plan.process_chunked(f"{sf_dir}/lineitem.parquet" if "://" not in sf_dir else table(spark, sf_dir, "lineitem"), partition_key="l_orderkey", chunk_size=10_000, spark=spark)[0]


QUERIES["plan_chunked"] = chunked
ORACLE["plan_chunked"] = "SELECT l_orderkey, l_partkey FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey) = 1"


def chunk_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, protocol = Plan().rows_filter(Col("o_orderstatus") == "O").process_chunked(table(spark, sf_dir, "orders"), chunk_size=4000)
    return spark.createDataFrame([(x.chunk_index, x.input_rows) for x in protocol.chunks], "chunk long, input_rows long")


QUERIES["plan_chunk_report"] = chunk_report
ORACLE["plan_chunk_report"] = "SELECT i AS chunk, CAST(least(4000, (SELECT count(*) FROM orders) - 4000 * i) AS BIGINT) AS input_rows FROM range((SELECT CAST(ceil(count(*) / 4000) AS BIGINT) FROM orders)) t(i)"


def dry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a dry run says of each step."""
    plan = Plan().col_drop("c_name").math_add("c_mktsegment", 1).col_rename("c_acctbal", "balance").math_add("balance", 1)
    customers = table(spark, sf_dir, "customer")
    run = plan.dry_run(customers)
    steps = spark.createDataFrame([(s.number, s.operation, len(s.schema_after), s.error) for s in run.steps], "step long, operation string, n long, error string")
    # the plan without its wrong step really gives the columns that the dry run told
    out = Plan().col_drop("c_name").col_rename("c_acctbal", "balance").math_add("balance", 1).transform(customers).select(*run.output_columns)
    return steps.crossJoin(F.broadcast(out.agg(F.floor(F.sum("balance")).cast("long").alias("balance"))))  # one row


QUERIES["plan_dry_run"] = dry
ORACLE["plan_dry_run"] = "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'col_drop', CAST(4 AS BIGINT), NULL), (2, 'math_add', 4, 'Column ''c_mktsegment'' is string, expected numeric'), (3, 'col_rename', 4, NULL), (4, 'math_add', 4, NULL)) t(step, operation, n, error), (SELECT CAST(floor(sum(c_acctbal + 1)) AS BIGINT) AS balance FROM customer)"


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The content hash ignores the order of rows and columns and sees a changed value."""
    d = table(spark, sf_dir, "orders")
    first = frame_hash(d)
    turned = frame_hash(d.select(*reversed(d.columns)).repartition(5))
    changed = frame_hash(d.withColumn("o_custkey", F.when(F.col("o_orderkey") == F.lit(d.agg(F.min("o_orderkey")).first()[0]), -1).otherwise(F.col("o_custkey"))))
    # hashes of the rows of each status differ just where the rows do
    parts = {r[0]: frame_hash(d.where(F.col("o_orderstatus") == r[0]).select("o_orderpriority")) for r in d.select("o_orderstatus").distinct().collect()}
    rows = [(k, first == turned, first == changed, len(h), d.where(F.col("o_orderstatus") == k).count(), h == frame_hash(d.where(F.col("o_orderstatus") == k).select("o_orderpriority").repartition(3))) for k, h in parts.items()]
    return spark.createDataFrame(rows, "status string, same boolean, same_after_change boolean, digits long, n long, repeated boolean")


QUERIES["plan_frame_hash"] = hashes
ORACLE["plan_frame_hash"] = "SELECT o_orderstatus AS status, true AS same, false AS same_after_change, CAST(16 AS BIGINT) AS digits, count(*) AS n, true AS repeated FROM orders GROUP BY o_orderstatus"


def streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row-wise plan on a stream that reads the table as files and writes Parquet."""
    plan = Plan().rows_filter(Col("event_type") == "purchase").math_multiply("value", 2).col_select(["event_id", "value"])
    return stream_table(spark, plan, f"{sf_dir}/events.parquet", shared_folder(spark))


QUERIES["stream_plan"] = streamed
ORACLE["stream_plan"] = "SELECT event_id, value * 2 AS value FROM events WHERE event_type = 'purchase'"
