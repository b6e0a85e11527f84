"""tidewatch: trend detection over large tables and streams of short posts, on Spark."""

import sys

from pyspark import cloudpickle

from tidewatch.schema import POSTS_SCHEMA, TrendParams

# Functions sent to executors carry their code, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["POSTS_SCHEMA", "TrendParams"]
