"""Spark-native similarity, graph and evidence analytics on ordinary DataFrames."""

import sys

from pyspark import cloudpickle

# Python functions of the package travel to the executors with the plan, so that workers need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
