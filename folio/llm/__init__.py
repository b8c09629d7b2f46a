"""Operators of a training-data pipeline over Spark DataFrames."""

import sys

from pyspark import cloudpickle

# functions that run in tasks carry their code along: executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
