"""Queries for profiling (§2.2) and cleaning (§2.3) operators."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabforge.functions.columns import ROW_ID, user_columns
from tabforge.operators import profile
from tabforge.plans.cleaning import apply_ops, preview_clean
from tabforge.queries.fixtures import ORDERS_N_SQL, customer, events, lineitem, orders_n, part
from tabforge.queries.registry import R, query, rounded
from tabforge.sources.scan import load_table

W = f"WITH {ORDERS_N_SQL}\n"
ORDERS_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "price", "o_orderdate", "priority"]


def _orders_select(price_expr: str = "price", custkey_expr: str = "o_custkey", src: str = "orders_n") -> str:
    return (f"SELECT o_orderkey, {custkey_expr} AS o_custkey, o_orderstatus, {R(price_expr, 4)} AS price, "
            f"o_orderdate, priority FROM {src}")


def _visible(df):
    return df.select(user_columns(df))


# ------------------------------------------------------------------ profiling

@query("shape", W + "SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(6 AS BIGINT) AS n_columns FROM orders_n")
def q_shape(spark, sf):
    return profile.shape(orders_n(spark, sf))


def _union_sql(template: str) -> str:
    return W + "\nUNION ALL\n".join(template.format(c=c) for c in ORDERS_COLS)


@query("null_counts", _union_sql(
    "SELECT '{c}' AS column_name, CAST(count_if({c} IS NULL) AS BIGINT) AS null_count FROM orders_n"))
def q_null_counts(spark, sf):
    return profile.null_counts(orders_n(spark, sf))


@query("null_summary", _union_sql(
    "SELECT '{c}' AS column_name, CAST(count_if({c} IS NULL) AS BIGINT) AS null_count, "
    "ROUND(100.0 * count_if({c} IS NULL) / count(*), 1) AS null_pct FROM orders_n"))
def q_null_summary(spark, sf):
    return profile.null_summary(orders_n(spark, sf))


@query("null_bars", W + "SELECT * FROM (" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, CAST(count_if({c} IS NULL) AS BIGINT) AS null_count FROM orders_n"
    for c in ORDERS_COLS) + ") t WHERE null_count > 0")
def q_null_bars(spark, sf):
    return profile.null_bars(orders_n(spark, sf))


@query("numeric_stats", W + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, "
    f"{R(f'avg({c})', 4)} AS mean, {R(f'stddev_samp({c})', 4)} AS std FROM orders_n"
    for c in ["o_orderkey", "o_custkey", "price"]))
def q_numeric_stats(spark, sf):
    st = profile.numeric_stats(orders_n(spark, sf))
    return rounded(st, 4, ["mean", "std"])


_DTYPE = {"o_orderkey": "int64", "o_custkey": "int64", "o_orderstatus": "object", "price": "float64",
          "o_orderdate": "datetime64[ns]", "priority": "object"}


@query("describe_dataset", W + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, '{_DTYPE[c]}' AS dtype, CAST(count_if({c} IS NULL) AS BIGINT) AS null_count, "
    + (f"CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, {R(f'avg({c})', 4)} AS mean, "
       f"{R(f'stddev_samp({c})', 4)} AS std" if _DTYPE[c] in ("int64", "float64") else
       "CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max, CAST(NULL AS DOUBLE) AS mean, "
       "CAST(NULL AS DOUBLE) AS std") + " FROM orders_n" for c in ORDERS_COLS))
def q_describe_dataset(spark, sf):
    return rounded(profile.describe_columns(orders_n(spark, sf)), 4, ["mean", "std"])


@query("dtypes", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, '{t}' AS dtype" for c, t in _DTYPE.items()))
def q_dtypes(spark, sf):
    from tabforge.functions.columns import dtypes

    return spark.createDataFrame(list(dtypes(orders_n(spark, sf)).items()), "column_name string, dtype string")


@query("preview_head", W + "SELECT * FROM orders_n ORDER BY o_orderkey LIMIT 50")
def q_preview_head(spark, sf):
    return profile.preview_head(orders_n(spark, sf), 50)


@query("preview_page", W + "SELECT * FROM orders_n ORDER BY o_orderkey LIMIT 50 OFFSET 150")
def q_preview_page(spark, sf):
    return profile.preview_page(orders_n(spark, sf), page=3, page_size=50)


# ------------------------------------------------------------------ fills

def _clean_orders(spark, sf, ops, digits=4):
    out = apply_ops(orders_n(spark, sf), ops)
    return rounded(_visible(out), digits)


@query("fill_mean", W + _orders_select("COALESCE(price, (SELECT avg(price) FROM orders_n))"))
def q_fill_mean(spark, sf):
    return _clean_orders(spark, sf, [("fill_missing", {"column": "price", "strategy": "mean"})])


@query("fill_median", W + _orders_select("COALESCE(price, (SELECT quantile_cont(price, 0.5) FROM orders_n))"))
def q_fill_median(spark, sf):
    return _clean_orders(spark, sf, [("fill_missing", {"column": "price", "strategy": "median"})])


@query("fill_mode", W + """SELECT o_orderkey, o_custkey, o_orderstatus, ROUND(price, 4) + 0.0 AS price, o_orderdate,
  COALESCE(priority, (SELECT priority FROM orders_n WHERE priority IS NOT NULL
                      GROUP BY priority ORDER BY count(*) DESC, priority LIMIT 1)) AS priority
FROM orders_n""")
def q_fill_mode(spark, sf):
    return _clean_orders(spark, sf, [("fill_missing", {"column": "priority", "strategy": "mode"})])


@query("fill_constant", W + """SELECT o_orderkey, o_custkey, o_orderstatus, ROUND(COALESCE(price, 0), 4) + 0.0 AS price,
  o_orderdate, COALESCE(priority, 'UNKNOWN') AS priority FROM orders_n""")
def q_fill_constant(spark, sf):
    return _clean_orders(spark, sf, [
        ("fill_missing", {"column": "price", "strategy": "constant", "value": 0}),
        ("fill_missing", {"column": "priority", "strategy": "constant", "value": "UNKNOWN"}),
    ])


@query("fill_all_mean", W + _orders_select(
    "COALESCE(price, (SELECT avg(price) FROM orders_n))",
    R("COALESCE(o_custkey, (SELECT avg(o_custkey) FROM orders_n))", 4)))
def q_fill_all_mean(spark, sf):
    return _clean_orders(spark, sf, [("fill_missing", {"strategy": "mean"})])


@query("fill_all_median", W + _orders_select(
    "COALESCE(price, (SELECT quantile_cont(price, 0.5) FROM orders_n))",
    R("COALESCE(o_custkey, (SELECT quantile_cont(o_custkey, 0.5) FROM orders_n))", 4)))
def q_fill_all_median(spark, sf):
    return _clean_orders(spark, sf, [("fill_missing", {"strategy": "median"})])


# ------------------------------------------------------------------ rows / columns

@query("drop_nulls", W + _orders_select() + " WHERE o_custkey IS NOT NULL AND price IS NOT NULL "
       "AND priority IS NOT NULL")
def q_drop_nulls(spark, sf):
    return _clean_orders(spark, sf, [("drop_nulls", {})])


@query("drop_nulls_subset", W + _orders_select() + " WHERE price IS NOT NULL")
def q_drop_nulls_subset(spark, sf):
    return _clean_orders(spark, sf, [("drop_nulls", {"subset": ["price"]})])


@query("drop_duplicates", """SELECT event_id, ts, user_id, event_type, value, props FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS rn FROM events) t
WHERE rn = 1""")
def q_drop_duplicates(spark, sf):
    out = apply_ops(events(spark, sf), [("drop_duplicates", {"subset": ["user_id", "event_type"]})])
    return _visible(out)


@query("drop_duplicates_all", W + """SELECT o_custkey, o_orderstatus, min(o_orderkey) AS first_orderkey
FROM orders_n GROUP BY o_custkey, o_orderstatus""")
def q_drop_duplicates_all(spark, sf):
    df = orders_n(spark, sf).select(ROW_ID, "o_custkey", "o_orderstatus")
    out = apply_ops(df, [("drop_duplicates", {})])
    return out.select("o_custkey", "o_orderstatus", F.col(ROW_ID).alias("first_orderkey"))


@query("drop_columns", W + f"SELECT o_orderkey, o_orderstatus, {R('price', 4)} AS price, priority FROM orders_n")
def q_drop_columns(spark, sf):
    return _clean_orders(spark, sf, [("drop_columns", {"columns": "o_orderdate, o_custkey, not_a_column"})])


@query("rename_column", W + f"SELECT o_orderkey, o_custkey, o_orderstatus, {R('price', 4)} AS total_price, "
       "o_orderdate, priority FROM orders_n")
def q_rename_column(spark, sf):
    return _clean_orders(spark, sf, [("rename_column", {"old_name": "price", "new_name": "total_price"})])


# ------------------------------------------------------------------ filters

@query("filter_eq", "SELECT * FROM customer WHERE c_nationkey = 7")
def q_filter_eq(spark, sf):
    out = apply_ops(customer(spark, sf), [("filter_rows", {"column": "c_nationkey", "operator": "==", "value": "7"})])
    return _visible(out)


@query("filter_eq_text", "SELECT * FROM customer WHERE c_mktsegment = 'BUILDING'")
def q_filter_eq_text(spark, sf):
    out = apply_ops(customer(spark, sf),
                    [("filter_rows", {"column": "c_mktsegment", "operator": "==", "value": "BUILDING"})])
    return _visible(out)


@query("filter_ne", W + _orders_select() + " WHERE priority IS DISTINCT FROM '1-URGENT'")
def q_filter_ne(spark, sf):
    return _clean_orders(spark, sf, [("filter_rows", {"column": "priority", "operator": "!=", "value": "1-URGENT"})])


@query("filter_gt", W + _orders_select() + " WHERE price > 250000")
def q_filter_gt(spark, sf):
    return _clean_orders(spark, sf, [("filter_rows", {"column": "price", "operator": ">", "value": "250000"})])


@query("filter_lt", W + _orders_select() + " WHERE price < 100000.5")
def q_filter_lt(spark, sf):
    return _clean_orders(spark, sf, [("filter_rows", {"column": "price", "operator": "<", "value": 100000.5})])


@query("filter_ge", W + _orders_select() + " WHERE o_orderdate >= TIMESTAMP '1995-06-01 00:00:00'")
def q_filter_ge(spark, sf):
    return _clean_orders(spark, sf, [("filter_rows", {"column": "o_orderdate", "operator": ">=",
                                                      "value": "1995-06-01"})])


@query("filter_le", W + _orders_select() + " WHERE o_custkey <= 500")
def q_filter_le(spark, sf):
    return _clean_orders(spark, sf, [("filter_rows", {"column": "o_custkey", "operator": "<=", "value": "500"})])


# ------------------------------------------------------------------ casts

@query("cast_float", "SELECT p_partkey, CAST(p_size AS DOUBLE) AS p_size FROM part")
def q_cast_float(spark, sf):
    out = apply_ops(part(spark, sf), [("cast_dtype", {"column": "p_size", "dtype": "float64"})])
    return out.select("p_partkey", "p_size")


@query("cast_float_text", "SELECT p_partkey, p_retailprice FROM part")
def q_cast_float_text(spark, sf):
    out = apply_ops(part(spark, sf), [("cast_dtype", {"column": "p_retailprice", "dtype": "str"}),
                                      ("cast_dtype", {"column": "p_retailprice", "dtype": "float"})])
    return out.select("p_partkey", "p_retailprice")


@query("cast_float_fail", "SELECT p_partkey, p_brand FROM part")
def q_cast_float_fail(spark, sf):
    out = apply_ops(part(spark, sf), [("cast_dtype", {"column": "p_brand", "dtype": "float64"})])
    return out.select("p_partkey", "p_brand")


@query("cast_int", "SELECT p_partkey, CAST(trunc(p_retailprice) AS BIGINT) AS p_retailprice FROM part")
def q_cast_int(spark, sf):
    out = apply_ops(part(spark, sf), [("cast_dtype", {"column": "p_retailprice", "dtype": "int64"})])
    return out.select("p_partkey", "p_retailprice")


@query("cast_int_strict", W + f"SELECT o_orderkey, {R('price', 4)} AS price FROM orders_n")
def q_cast_int_strict(spark, sf):
    out = apply_ops(orders_n(spark, sf), [("cast_dtype", {"column": "price", "dtype": "int64"})])
    return rounded(out.select("o_orderkey", "price"), 4)


@query("cast_str", "SELECT p_partkey, CAST(p_size AS VARCHAR) AS p_size FROM part")
def q_cast_str(spark, sf):
    out = apply_ops(part(spark, sf), [("cast_dtype", {"column": "p_size", "dtype": "str"})])
    return out.select("p_partkey", "p_size")


@query("cast_bool", """SELECT l_orderkey, l_linenumber,
  CASE WHEN l_discount IS NULL THEN NULL ELSE l_discount <> 0 END AS l_discount FROM lineitem""")
def q_cast_bool(spark, sf):
    out = apply_ops(lineitem(spark, sf), [("cast_dtype", {"column": "l_discount", "dtype": "bool"})])
    return out.select("l_orderkey", "l_linenumber", "l_discount")


# ------------------------------------------------------------------ op chain

CHAIN = [
    {"op": "fill_missing", "params": {"column": "price", "strategy": "median"}},
    {"op": "filter_rows", "params": {"column": "priority", "operator": "!=", "value": "1-URGENT"}},
    {"op": "drop_duplicates", "params": {"subset": ["o_custkey", "o_orderstatus"]}},
    {"op": "rename_column", "params": {"old_name": "price", "new_name": "total_price"}},
    {"op": "drop_columns", "params": {"columns": ["o_orderdate"]}},
]


@query("apply_ops", W + f""", f1 AS (
  SELECT o_orderkey, o_custkey, o_orderstatus,
         COALESCE(price, (SELECT quantile_cont(price, 0.5) FROM orders_n)) AS price, o_orderdate, priority
  FROM orders_n),
f2 AS (SELECT * FROM f1 WHERE priority IS DISTINCT FROM '1-URGENT'),
f3 AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS rn FROM f2)
SELECT o_orderkey, o_custkey, o_orderstatus, {R('price', 4)} AS total_price, priority FROM f3 WHERE rn = 1""")
def q_apply_ops(spark, sf):
    return _clean_orders(spark, sf, CHAIN)


CHAIN_SQL = f""", f1 AS (
  SELECT o_orderkey, o_custkey, o_orderstatus,
         COALESCE(price, (SELECT quantile_cont(price, 0.5) FROM orders_n)) AS price, o_orderdate, priority
  FROM orders_n),
f2 AS (SELECT * FROM f1 WHERE priority IS DISTINCT FROM '1-URGENT'),
f3 AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS rn FROM f2),
f4 AS (SELECT o_orderkey, o_custkey, o_orderstatus, {R('price', 4)} AS total_price, priority FROM f3 WHERE rn = 1)
"""


@query("preview_clean", W + CHAIN_SQL + "SELECT * FROM f4 ORDER BY o_orderkey LIMIT 50")
def q_preview_clean(spark, sf):
    """The first 50 rows of the op chain's result, as the clean preview returns them."""
    df = orders_n(spark, sf)
    fields = [f for f in apply_ops(df, CHAIN).schema.fields if f.name != ROW_ID]
    rows = [tuple(r[f.name] for f in fields) for r in preview_clean(df, CHAIN)["preview"]]
    return rounded(spark.createDataFrame(rows, T.StructType(fields)), 4)


@query("preview_clean_counts", W + CHAIN_SQL + """SELECT 'original_rows' AS item, count(*) AS value FROM orders_n
UNION ALL SELECT 'original_cols', 6
UNION ALL SELECT 'result_rows', count(*) FROM f4
UNION ALL SELECT 'result_cols', 5
""" + "\n".join(f"UNION ALL SELECT 'nulls of {c}', count(*) - count({c}) FROM f4"
               for c in ("o_orderkey", "o_custkey", "o_orderstatus", "total_price", "priority")))
def q_preview_clean_counts(spark, sf):
    """Shapes, column names and null counts of the clean preview."""
    found = preview_clean(orders_n(spark, sf), CHAIN)
    rows = [(k, int(found[k])) for k in ("original_rows", "original_cols", "result_rows", "result_cols")]
    rows += [(f"nulls of {c}", found["null_counts"][c]) for c in found["column_names"]]
    return spark.createDataFrame(rows, "item string, value long")


@query("preview_page_deep", W + """SELECT * FROM orders_n WHERE priority IS DISTINCT FROM '1-URGENT'
ORDER BY o_orderkey LIMIT 50 OFFSET 10000""")
def q_preview_page_deep(spark, sf):
    """A deep page of a filtered (sparse row id) dataset: the first row is
    located by bucketed counting instead of a take-ordered of 10,050 rows."""
    out = apply_ops(orders_n(spark, sf), [("filter_rows", {"column": "priority", "operator": "!=",
                                                           "value": "1-URGENT"})])
    return profile.preview_page(out, page=200, page_size=50)


@query("cast_many", """SELECT p_partkey, CAST(p_size AS DOUBLE) AS p_size, p_brand,
  CAST(trunc(p_retailprice) AS BIGINT) AS p_retailprice FROM part""")
def q_cast_many(spark, sf):
    """Three adjacent casts checked by one aggregate; the text one fails and
    leaves its column unchanged."""
    out = apply_ops(part(spark, sf), [("cast_dtype", {"column": "p_size", "dtype": "float64"}),
                                      ("cast_dtype", {"column": "p_brand", "dtype": "float64"}),
                                      ("cast_dtype", {"column": "p_retailprice", "dtype": "int64"})])
    return out.select("p_partkey", "p_size", "p_brand", "p_retailprice")


@query("cast_int32_fail", "SELECT o_orderkey, o_orderkey + 3000000000 AS large, CAST(o_custkey AS INTEGER) AS small FROM orders")
def q_cast_int32_fail(spark, sf):
    """A column that 32 bits cannot hold is left as it is."""
    df = load_table(spark, sf, "orders", order_by="o_orderkey").select(
        ROW_ID, "o_orderkey", (F.col("o_orderkey") + F.lit(3_000_000_000)).alias("large"), F.col("o_custkey").alias("small"))
    return apply_ops(df, [{"op": "cast_dtype", "params": {"column": c, "dtype": "int32"}} for c in ("large", "small")]).drop(ROW_ID)


@query("filter_eq_bigint", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = (SELECT 7)")
def q_filter_eq_bigint(spark, sf):
    """An equality on a 64-bit key reaches the scan (tests/test_verdict.py reads the pushed filter)."""
    df = load_table(spark, sf, "orders", order_by="o_orderkey")
    return apply_ops(df, [{"op": "filter_rows", "params": {"column": "o_custkey", "operator": "==", "value": "7"}}]).select(
        "o_orderkey", "o_custkey")


_ODD = {"it's": "o_orderkey", "a.b": "o_totalprice", "c`d": "o_custkey", "e f": "o_orderstatus"}


@query("odd_names", "\nUNION ALL\n".join(
    "SELECT '" + n.replace("'", "''") + f"' AS column_name, count(*) - count({c}) AS null_count, "
    + (f"CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max" if c != "o_orderstatus"
       else "CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max") + " FROM orders" for n, c in _ODD.items()))
def q_odd_names(spark, sf):
    """A profile over column names with quotes, dots, backticks and blanks."""
    df = load_table(spark, sf, "orders").select(*[F.col(c).alias(n) for n, c in _ODD.items()])
    return profile.describe_columns(df).select("column_name", "null_count", "min", "max")
