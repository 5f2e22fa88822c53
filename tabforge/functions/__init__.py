"""Column expressions and coercion rules used by every operator."""

from tabforge.functions.columns import (  # noqa: F401
    ROW_ID,
    dtypes,
    dtype_name,
    field_type,
    is_numeric,
    nan_to_null,
    normalize_nans,
    numeric_columns,
    require_columns,
    user_columns,
)
from tabforge.functions.coerce import (  # noqa: F401
    INTEGER_TEXT,
    NULL_TOKENS,
    NUMERIC_TEXT,
    filter_literal,
    truthiness,
)
