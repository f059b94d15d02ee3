"""Corpus preparation and evaluation as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Helpers that run inside Python workers (Arrow functions, the token shard
# source) travel with the task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
