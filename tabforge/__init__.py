"""tabforge: the tabular ML data lifecycle as Spark jobs.

Ingest -> profile -> declarative cleaning -> feature steps -> Spark ML
training -> evaluation -> exploration of the full predictions table.
Every operator is a DataFrame / Spark ML composition; statistics are
computed by distributed aggregates and only O(columns) numbers ever
reach the driver.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions that run inside Python workers (Arrow-batched UDFs) are shipped
# by value, so executors do not need this package installed.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

from tabforge.errors import (  # noqa: F401,E402
    TabforgeError,
    UnknownOperation,
    UnknownStep,
    ColumnNotFound,
    InvalidParameter,
    DatasetNotFound,
)
from tabforge.session import get_spark, checkpoint_dir  # noqa: F401,E402
from tabforge.functions.columns import ROW_ID  # noqa: F401,E402

__all__ = [
    "get_spark",
    "checkpoint_dir",
    "ROW_ID",
]
