"""Spark-native engine for event-integration semantics and corpus preparation."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions travel to executors by value, so these need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
