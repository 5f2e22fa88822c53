"""Every registered query, imported for its registration side effect."""

from tabforge.queries import catalog_queries  # noqa: F401
from tabforge.queries import evaluation_queries  # noqa: F401
from tabforge.queries import feature_queries  # noqa: F401
from tabforge.queries import model_queries  # noqa: F401
from tabforge.queries import profiling_cleaning  # noqa: F401
from tabforge.queries.registry import ORACLES, QUERIES  # noqa: F401
