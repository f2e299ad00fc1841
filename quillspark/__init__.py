"""Spark-first analytics over personal-knowledge data: traces, pages, drops, commits."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value, so that workers need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
