"""Spark-native document retrieval, analytics and corpus preparation."""

import sys

from pyspark import cloudpickle

# Functions of this package that run on executors travel by value, so a
# cluster needs no installed copy and no PYTHONPATH of its own.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
