"""Spark-native operators for measuring how people respond to advertising and to changes around them."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel inside the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
