"""Queries for evaluation (§2.6) and result exploration (§2.7).

Prediction tables are derived from the driver tables by a fixed rule so
that SQL can state the same thing: ``labels`` (actual = quality,
predicted = toxic), ``events`` (actual = event_type, predicted = a rule on
value) and ``lineitem`` (actual = price / 1000, predicted = a linear
formula of quantity).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tabforge.functions.columns import ROW_ID
from tabforge.operators import evaluate as ev
from tabforge.operators import explore as ex
from tabforge.queries.fixtures import events, lineitem
from tabforge.queries.registry import R, query, rounded
from tabforge.sources.scan import load_table

CLF_SQL = "p AS (SELECT doc_id AS id, quality AS actual, toxic AS predicted FROM labels)"
MULTI_RULE_SQL = ("CASE WHEN value < 100 THEN 'click' WHEN value < 200 THEN 'view' "
                  "WHEN value < 300 THEN 'purchase' WHEN value < 400 THEN 'signup' ELSE 'error' END")
MULTI_SQL = f"p AS (SELECT event_id AS id, event_type AS actual, {MULTI_RULE_SQL} AS predicted FROM events)"
REG_SQL = ("p AS (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice / 1000 AS actual, "
           "l_quantity * 0.95 + 1.0 AS predicted FROM lineitem)")


def predictions_clf(spark, sf):
    return load_table(spark, sf, "labels", order_by="doc_id").select(
        ROW_ID, F.col("doc_id").alias("id"), F.col("quality").alias("actual"), F.col("toxic").alias("predicted"))


def predictions_multi(spark, sf):
    v = F.col("value")
    rule = (F.when(v < 100, "click").when(v < 200, "view").when(v < 300, "purchase")
            .when(v < 400, "signup").otherwise("error"))
    return events(spark, sf).select(ROW_ID, F.col("event_id").alias("id"),
                                    F.col("event_type").alias("actual"), rule.alias("predicted"))


def predictions_reg(spark, sf):
    return lineitem(spark, sf).select(
        "l_orderkey", "l_linenumber", "l_quantity",
        (F.col("l_extendedprice") / 1000).alias("actual"),
        (F.col("l_quantity") * 0.95 + 1.0).alias("predicted"))


def _metrics_sql(src: str, cols=("accuracy", "precision", "recall", "f1")) -> str:
    exprs = {
        "accuracy": "sum(tp) / sum(support)",
        "precision": "sum(support * CASE WHEN pn > 0 THEN tp / pn ELSE 0 END) / sum(support)",
        "recall": "sum(support * CASE WHEN support > 0 THEN tp / support ELSE 0 END) / sum(support)",
        "f1": "sum(support * CASE WHEN support + pn > 0 THEN 2.0 * tp / (support + pn) ELSE 0 END) / sum(support)",
    }
    sel = ", ".join(f"{R(exprs[c], 9)} AS {c}" for c in cols)
    return f"""WITH {src},
c AS (SELECT actual, predicted, count(*) AS n FROM p GROUP BY actual, predicted),
a AS (SELECT actual AS label, sum(n) AS support, sum(CASE WHEN actual = predicted THEN n ELSE 0 END) AS tp
      FROM c GROUP BY actual),
pp AS (SELECT predicted AS label, sum(n) AS pn FROM c GROUP BY predicted),
pc AS (SELECT coalesce(a.label, pp.label) AS label, coalesce(tp, 0) AS tp, coalesce(support, 0) AS support,
              coalesce(pn, 0) AS pn FROM a FULL OUTER JOIN pp ON a.label = pp.label)
SELECT {sel} FROM pc"""


def _metrics(df, cols):
    return rounded(ev.classification_metrics(df).select(*cols), 9)


@query("classification_metrics", _metrics_sql(CLF_SQL))
def q_classification_metrics(spark, sf):
    return _metrics(predictions_clf(spark, sf), ["accuracy", "precision", "recall", "f1"])


@query("classification_metrics_multi", _metrics_sql(MULTI_SQL))
def q_classification_metrics_multi(spark, sf):
    return _metrics(predictions_multi(spark, sf), ["accuracy", "precision", "recall", "f1"])


@query("accuracy", _metrics_sql(CLF_SQL, ["accuracy"]))
def q_accuracy(spark, sf):
    return _metrics(predictions_clf(spark, sf), ["accuracy"])


@query("f1_weighted", _metrics_sql(MULTI_SQL, ["f1"]))
def q_f1_weighted(spark, sf):
    return _metrics(predictions_multi(spark, sf), ["f1"])


@query("precision_weighted", _metrics_sql(MULTI_SQL, ["precision"]))
def q_precision_weighted(spark, sf):
    return _metrics(predictions_multi(spark, sf), ["precision"])


@query("recall_weighted", _metrics_sql(MULTI_SQL, ["recall"]))
def q_recall_weighted(spark, sf):
    return _metrics(predictions_multi(spark, sf), ["recall"])


def _cm_sql(src: str) -> str:
    return f"""WITH {src},
l AS (SELECT actual AS v FROM p UNION SELECT predicted AS v FROM p),
c AS (SELECT actual, predicted, count(*) AS n FROM p GROUP BY actual, predicted)
SELECT a.v AS actual, b.v AS predicted, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM l a CROSS JOIN l b LEFT JOIN c ON c.actual = a.v AND c.predicted = b.v"""


@query("confusion_matrix", _cm_sql(CLF_SQL))
def q_confusion_matrix(spark, sf):
    return ev.confusion_matrix(predictions_clf(spark, sf))


@query("confusion_matrix_multi", _cm_sql(MULTI_SQL))
def q_confusion_matrix_multi(spark, sf):
    return ev.confusion_matrix(predictions_multi(spark, sf))


def _rates_sql(src: str) -> str:
    return f"""WITH {src},
c AS (SELECT actual, predicted, count(*) AS n FROM p GROUP BY actual, predicted),
a AS (SELECT actual AS label, sum(n) AS support, sum(CASE WHEN actual = predicted THEN n ELSE 0 END) AS tp
      FROM c GROUP BY actual),
pp AS (SELECT predicted AS label, sum(n) AS pn FROM c GROUP BY predicted),
pc AS (SELECT coalesce(a.label, pp.label) AS label, coalesce(tp, 0) AS tp, coalesce(support, 0) AS support,
              coalesce(pn, 0) AS pn FROM a FULL OUTER JOIN pp ON a.label = pp.label),
k AS (SELECT *, sum(support) OVER () AS nn FROM pc),
r AS (SELECT label, tp, support - tp AS fn, pn - tp AS fp, nn - support - pn + tp AS tn FROM k)
SELECT label,
  CASE WHEN tp + fn > 0 THEN ROUND(tp * 100.0 / (tp + fn), 1) END AS tpr,
  CASE WHEN tn + fp > 0 THEN ROUND(tn * 100.0 / (tn + fp), 1) END AS tnr,
  CASE WHEN tn + fp > 0 THEN ROUND(fp * 100.0 / (tn + fp), 1) END AS fpr FROM r"""


@query("confusion_rates", _rates_sql(CLF_SQL))
def q_confusion_rates(spark, sf):
    return ev.confusion_rates(predictions_clf(spark, sf))


@query("confusion_rates_multi", _rates_sql(MULTI_SQL))
def q_confusion_rates_multi(spark, sf):
    return ev.confusion_rates(predictions_multi(spark, sf))


@query("regression_metrics", f"""WITH {REG_SQL}
SELECT {R("CASE WHEN var_pop(actual) > 0 THEN 1 - avg((actual - predicted) * (actual - predicted)) / var_pop(actual) "
          "WHEN avg((actual - predicted) * (actual - predicted)) = 0 THEN 1 ELSE 0 END", 9)} AS r2,
       {R("avg((actual - predicted) * (actual - predicted))", 6)} AS mse,
       {R("sqrt(avg((actual - predicted) * (actual - predicted)))", 6)} AS rmse FROM p""")
def q_regression_metrics(spark, sf):
    m = ev.regression_metrics(predictions_reg(spark, sf))
    return rounded(rounded(m, 9, ["r2"]), 6, ["mse", "rmse"])


@query("residual", f"""WITH {REG_SQL}
SELECT l_orderkey, l_linenumber, {R("actual", 9)} AS actual, {R("predicted", 9)} AS predicted,
       {R("actual - predicted", 9)} AS residual FROM p""")
def q_residual(spark, sf):
    p = predictions_reg(spark, sf)
    return rounded(p.select("l_orderkey", "l_linenumber", "actual", "predicted", ev.residual()), 9)


# ------------------------------------------------------------------ exploration

def _hist_sql(closed: bool) -> str:
    last = "WHEN value = mx AND mx > mn THEN 13 " if closed else ""
    return f"""WITH s AS (SELECT min(value) AS mn, max(value) AS mx FROM events),
z AS (SELECT mn, mx, CASE WHEN (mx - mn) / 14 = 0 THEN 1 ELSE (mx - mn) / 14 END AS size FROM s),
g AS (SELECT value, mn, mx, size, CAST(floor((value - mn) / size) AS INTEGER) AS gs
      FROM events, z WHERE value IS NOT NULL),
b AS (SELECT CASE {last}WHEN value < mn + gs * size THEN gs - 1
                 WHEN value >= mn + (gs + 1) * size THEN gs + 1 ELSE gs END AS bin FROM g),
cnt AS (SELECT bin, count(*) AS n FROM b WHERE bin >= 0 AND bin < 14 GROUP BY bin),
fr AS (SELECT CAST(range AS INTEGER) AS bin FROM range(14))
SELECT fr.bin, {R("mn + fr.bin * size", 6)} AS bin_start, CAST(coalesce(cnt.n, 0) AS BIGINT) AS count
FROM fr CROSS JOIN z LEFT JOIN cnt ON cnt.bin = fr.bin"""


@query("histogram", _hist_sql(True))
def q_histogram(spark, sf):
    return rounded(ex.histogram(events(spark, sf), "value"), 6)


@query("histogram_open", _hist_sql(False))
def q_histogram_open(spark, sf):
    return rounded(ex.histogram(events(spark, sf), "value", closed_last=False), 6)


@query("histogram_inf", _hist_sql(True))
def q_histogram_inf(spark, sf):
    """Infinite values are no part of the range and are not counted."""
    ev = events(spark, sf).select("value")
    far = ev.select(F.lit(float("inf")).alias("value")).union(ev.select(F.lit(float("-inf")).alias("value")))
    return rounded(ex.histogram(ev.union(far), "value"), 6)


@query("scatter_sample", """SELECT row_number() OVER (ORDER BY event_id) - 1 AS i, value AS x, user_id AS y,
  event_type AS c FROM events ORDER BY event_id LIMIT 400""")
def q_scatter_sample(spark, sf):
    return ex.scatter_sample(events(spark, sf), "value", "user_id", "event_type")


@query("scatter_sample_seeded", """WITH s AS (SELECT * FROM events ORDER BY md5(CAST(event_id AS VARCHAR) || '-7'), event_id LIMIT 400)
SELECT row_number() OVER (ORDER BY event_id) - 1 AS i, value AS x, user_id AS y, event_type AS c FROM s""")
def q_scatter_sample_seeded(spark, sf):
    """A sample of all rows, the same whatever the layout."""
    return ex.scatter_sample(events(spark, sf).repartition(5, "value"), "value", "user_id", "event_type", seed=7)


@query("line_series", """SELECT row_number() OVER (ORDER BY event_id) - 1 AS i, value AS val
FROM events ORDER BY event_id LIMIT 80""")
def q_line_series(spark, sf):
    return ex.line_series(events(spark, sf), "value")


@query("color_scale", """WITH s AS (SELECT min(value) AS mn, max(value) AS mx FROM events),
r AS (SELECT event_id, value, (value - mn) / (mx - mn) AS t FROM events, s)
SELECT event_id, CASE WHEN value IS NULL THEN 'rgb(0, 144, 255)' ELSE
  'rgb(' || CAST(CAST(floor(0.0 + t * 0.0 + 0.5) AS BIGINT) AS VARCHAR) || ', '
         || CAST(CAST(floor(144.0 + t * 85.0 + 0.5) AS BIGINT) AS VARCHAR) || ', '
         || CAST(CAST(floor(255.0 + t * -95.0 + 0.5) AS BIGINT) AS VARCHAR) || ')' END AS color FROM r""")
def q_color_scale(spark, sf):
    df = events(spark, sf)
    return df.select("event_id", ex.color_scale(df, "value").alias("color"))


@query("filter_predictions", """SELECT * FROM events
WHERE (value > 100 OR value IS NULL) AND coalesce(event_type, 'null') <> 'click'
  AND contains(lower(coalesce(props, 'null')), '"k": 1')""")
def q_filter_predictions(spark, sf):
    df = events(spark, sf)
    out = ex.filter_predictions(df, [("value", ">", "100"), ("event_type", "!=", "click"),
                                     ("props", "contains", '"k": 1')])
    return out.drop(ROW_ID)


@query("filter_contains", """SELECT * FROM events WHERE contains(lower(coalesce(props, 'null')), lower('K": 4'))""")
def q_filter_contains(spark, sf):
    out = ex.filter_predictions(events(spark, sf), [{"col": "props", "op": "contains", "val": 'K": 4'}])
    return out.drop(ROW_ID)


@query("filter_mixed_compare", """SELECT * FROM events WHERE user_id >= 50 AND props <> '{"k": 69}'""")
def q_filter_mixed_compare(spark, sf):
    out = ex.filter_predictions(events(spark, sf), [("user_id", ">=", "50"), ("event_type", ">", "a"),
                                                    ("props", "!=", '{"k": 69}'), ("value", "<", "abc")])
    return out.drop(ROW_ID)


@query("filter_mixed_compare_js", """SELECT * FROM events WHERE value < 120 AND props <> 'x'""")
def q_filter_mixed_compare_js(spark, sf):
    out = ex.filter_predictions(events(spark, sf), [("value", "<", "120abc"), ("props", "!=", "x")],
                                js_compat=True)
    return out.drop(ROW_ID)


@query("color_scale_binary", """SELECT doc_id, CASE WHEN TRY_CAST(CAST(toxic AS VARCHAR) AS DOUBLE) = 1
  THEN 'rgb(0, 229, 160)' ELSE 'rgb(0, 144, 255)' END AS color FROM labels""")
def q_color_scale_binary(spark, sf):
    """A text column colours by whether its value reads as 1."""
    df = load_table(spark, sf, "labels").withColumn("toxic", F.col("toxic").cast("string"))
    return df.select("doc_id", ex.color_scale(df, "toxic").alias("color"))
