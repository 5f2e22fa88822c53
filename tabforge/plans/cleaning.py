"""An ordered, replayable list of cleaning ops folded into ONE lazy plan.

The fold builds a single Catalyst logical plan (projections collapse,
filters push into the scan); statistics needed by fill ops are computed by
small aggregates on the plan prefix. Adjacent fills of the same kind on
different columns share one aggregate, since filling one column cannot
change another column's statistic; adjacent casts of different columns
share one validity aggregate for the same reason.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.functions.columns import user_columns
from tabforge.operators.clean import (
    OpContext,
    OpReport,
    apply_operation,
    cast_columns,
    fill_with_stats,
)
from tabforge.operators.profile import PREVIEW_ROWS, null_count_exprs, preview_head
from tabforge.session import materialize


@dataclass(frozen=True)
class CleanOp:
    op: str
    params: dict = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps({"op": self.op, "params": self.params}, sort_keys=True, default=str)

    @staticmethod
    def of(item) -> "CleanOp":
        if isinstance(item, CleanOp):
            return item
        if isinstance(item, dict):
            return CleanOp(item["op"], dict(item.get("params") or {}))
        op, params = item
        return CleanOp(op, dict(params or {}))


def _stat_fill(op: CleanOp, df: DataFrame):
    if op.op != "fill_missing":
        return None
    strategy = op.params.get("strategy", "mean")
    col = op.params.get("column")
    if strategy in ("mean", "median") and col and col in user_columns(df):
        return strategy, col
    return None


def _cast_op(op: CleanOp, df: DataFrame):
    if op.op != "cast_dtype":
        return None
    col = op.params.get("column")
    strict = op.params.get("strict", True)
    if isinstance(strict, str):
        strict = strict.lower() != "false"
    if col and col in user_columns(df) and strict is True:
        return col, op.params.get("dtype", "float")
    return None


def _needs_data(op: CleanOp) -> bool:
    """Whether the op reads the data to be planned (a statistic, a validity count)."""
    if op.op == "fill_missing":
        return op.params.get("strategy", "mean") != "constant"
    return op.op == "cast_dtype"


def apply_ops(df: DataFrame, ops, strict: bool = False,
              reports: list[OpReport] | None = None) -> DataFrame:
    """Fold ops left to right. Unknown op names raise.

    An op that reads the data after one that shuffles it (de-duplication)
    would repeat the shuffle in each of its passes and in the result, so
    the prefix is written to the shared scratch folder once.
    """
    return _fold(df, ops, strict, reports)[0]


def _fold(df: DataFrame, ops, strict: bool, reports: list[OpReport] | None) -> tuple[DataFrame, bool]:
    """(result, whether its plan ends in a shuffle that a second read would repeat)"""
    ctx = OpContext(strict=strict)
    ops = [CleanOp.of(o) for o in ops]
    i, shuffled = 0, False
    while i < len(ops):
        if shuffled and _needs_data(ops[i]):
            df, shuffled = materialize(df, "clean-prefix"), False
        shuffled = shuffled or ops[i].op == "drop_duplicates"
        first = _stat_fill(ops[i], df)
        if first is not None:
            strategy, cols = first[0], [first[1]]
            j = i + 1
            while j < len(ops):
                nxt = _stat_fill(ops[j], df)
                if nxt is None or nxt[0] != strategy or nxt[1] in cols:
                    break
                cols.append(nxt[1])
                j += 1
            if j - i > 1:
                df = fill_with_stats(df, strategy, cols)
                ctx.reports.extend(OpReport(o.op, o.params) for o in ops[i:j])
                i = j
                continue
        first_cast = _cast_op(ops[i], df)
        if first_cast is not None:
            casts, j = [first_cast], i + 1
            while j < len(ops):
                nxt = _cast_op(ops[j], df)
                if nxt is None or nxt[0] in {c for c, _ in casts}:
                    break
                casts.append(nxt)
                j += 1
            if j - i > 1:
                df, failed = cast_columns(df, casts)
                for o, (c, _) in zip(ops[i:j], casts):
                    if c in failed:
                        ctx.skipped(o.op, o.params, f"some values of {c!r} do not convert to {o.params.get('dtype')}")
                    else:
                        ctx.reports.append(OpReport(o.op, o.params))
                i = j
                continue
        df = apply_operation(df, ops[i].op, ops[i].params, ctx)
        i += 1
    if reports is not None:
        reports.extend(ctx.reports)
    return df, shuffled


def preview_clean(df: DataFrame, ops, preview_rows: int = PREVIEW_ROWS) -> dict:
    """Shapes before/after, names, null counts and the first rows."""
    original_rows = df.count()
    original_cols = len(user_columns(df))
    reports: list[OpReport] = []
    out, shuffled = _fold(df, ops, False, reports)
    if shuffled:  # read for the counts and for the preview
        out = materialize(out, "clean-preview")
    cols = user_columns(out)
    row = out.agg(F.count(F.lit(1)).alias("__rows"), *null_count_exprs(out)).first()
    return {
        "original_rows": original_rows,
        "original_cols": original_cols,
        "result_rows": int(row["__rows"]),
        "result_cols": len(cols),
        "column_names": cols,
        "null_counts": {c: int(row[f"__nulls_{i}"]) for i, c in enumerate(cols)},
        "preview": [r.asDict() for r in preview_head(out, preview_rows).collect()],
        "reports": [r.__dict__ for r in reports],
    }
