"""Spark-native record linkage: normalize, block, compare, decide, evaluate."""

import sys

from pyspark import cloudpickle

# Functions reach Python workers by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
