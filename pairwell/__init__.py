"""Matched cohorts, balance diagnostics and training-data operators on Spark DataFrames."""

import sys

from pyspark.cloudpickle import cloudpickle as _cloudpickle

# Functions that run on executors travel by value, so that executors need no copy of this package.
_cloudpickle.register_pickle_by_value(sys.modules[__name__])
